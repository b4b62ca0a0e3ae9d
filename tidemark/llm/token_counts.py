"""Token counts under a unigram model by dynamic programming over a shared trie.

A text is cut into pre-tokens at white space.  The distinct pre-tokens of a
task's texts go into one trie.  A node stands for a prefix and holds the best
forward score of any segmentation of that prefix and the number of pieces in it;
it is computed once, when the node is made, from the nodes above it, and shared
by every pre-token that begins so.  The node where a pre-token ends is its
terminal, and its piece count is the pre-token's token count.  A text's count is
the sum over its pre-tokens.

The trie is a task's working store: when it holds ``MAX_NODES`` nodes it is
emptied and filled anew, which changes no count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import byte_blocks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"      # begins every pre-token
MAX_NODES = 600_000
MAX_HELD = 64 << 20  # bytes of pre-tokens whose counts are kept
DEEP = 48            # prefixes longer than this are not kept in the trie
BLOCK = 4 << 20


@dataclass(frozen=True)
class UnigramModel:
    """Scores of pieces in millionths of a natural logarithm (whole numbers, so
    sums are exact), and the score of one byte of a character no piece covers."""

    scores: dict[str, int]
    byte_score: int
    tails: frozenset[str]  # every suffix of a piece: a longer look back ends where none is left

    @staticmethod
    def of(scores: dict[str, int], byte_score: int) -> UnigramModel:
        return UnigramModel(scores, byte_score, frozenset(p[i:] for p in scores for i in range(len(p))))


def load_model(path: str = VOCABULARY) -> UnigramModel:
    """Pieces of a SentencePiece file in their order; the score of a piece is the
    logarithm of a Zipf law over its rank, as the file holds no probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = sum(1 / (r + 10) for r in range(len(pieces) + 1))

    def score(rank: int) -> int:
        return round(1e6 * math.log(1 / (rank + 10) / total))

    return UnigramModel.of({p: score(r) for r, p in reversed(list(enumerate(pieces)))}, score(len(pieces)))


class PrefixTrie:
    """Forward scores per prefix.  A state is one whole number, the score times
    2**24 less the pieces: the larger is better, and equal scores go to the
    segmentation of fewer pieces."""

    def __init__(self, model: UnigramModel) -> None:
        self.tails = model.tails
        self.gain = {piece: (score << 24) - 1 for piece, score in model.scores.items()}
        self.byte_gain = (model.byte_score << 24) - 1
        self.child: dict[int, int] = {}  # node and next character, as one number
        self.state: list[int] = [0]

    def __len__(self) -> int:
        return len(self.state)

    def _forward(self, text: str, i: int, states: list[int]) -> int:
        """The best state of ``text[:i]`` from the states of its shorter prefixes."""
        tails, gain = self.tails, self.gain
        best = None
        for start in range(i - 1, -1, -1):
            piece = text[start:i]
            if piece not in tails:
                break
            own = gain.get(piece)
            if own is not None and (best is None or states[start] + own > best):
                best = states[start] + own
        if text[i - 1] in gain:
            return best
        spelled = states[i - 1] + self.byte_gain * len(text[i - 1].encode("utf-8", "surrogatepass"))
        return spelled if best is None or spelled > best else best

    def count(self, word: str) -> int:
        """Pieces of ``word``; makes the nodes that are missing."""
        node, states, child_of = 0, [0], self.child
        near = min(len(word), DEEP)
        for i in range(near):
            key = node * 0x110000 + ord(word[i])
            child = child_of.get(key)
            if child is None:
                child = child_of[key] = len(self.state)
                self.state.append(self._forward(word, i + 1, states))
            node = child
            states.append(self.state[node])
        for i in range(near + 1, len(word) + 1):
            states.append(self._forward(word, i, states))
        return -states[-1] & 0xFFFFFF


def token_counts(docs: DataFrame, model: UnigramModel | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pretokens, n_tokens.

    Null and empty texts, and texts of white space, have none.  Every pre-token
    begins with MARK, so an empty one does not occur.  Repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or load_model())  # the vocabulary, some hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(shared.value)
        counts: dict[bytes, int] = {}
        held = 0
        for block in byte_blocks(batches, "text", BLOCK):
            words_of, tokens_of = [], []
            for text in block.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist():
                words = text.split() if text else []
                for word in sorted(set(words).difference(counts)):
                    counts[word] = trie.count(MARK + word.decode("utf-8", "replace"))
                    held += len(word)
                words_of.append(len(words))
                tokens_of.append(sum(map(counts.__getitem__, words)))
                if len(trie) > MAX_NODES or held > MAX_HELD:  # begun anew; no count depends on it
                    trie, counts, held = PrefixTrie(shared.value), {}, 0
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").combine_chunks(), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())],
                ["doc_id", "n_pretokens", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_pretokens long, n_tokens long")
