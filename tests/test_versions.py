"""Atomic versions, keyed tables: what survives a run that dies, what a batch writes."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources import files, versions
from tidemark.sources.keyed import KeyedTable


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def dying(spark):
    """Rows whose write fails after some tasks are done."""
    return spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 999, F.col("id")).otherwise(
        F.raise_error(F.lit("executor lost")).cast("long")).alias("id"))


def test_a_run_that_dies_while_writing_leaves_the_last_version(spark):
    path = scratch_path(spark, "versions")
    files.publish_snapshot(spark.range(3), path)
    with pytest.raises(Exception, match="executor lost"):
        files.publish_snapshot(dying(spark), path)
    assert ids(files.read_snapshot(spark, path)) == [0, 1, 2]
    assert versions.latest(spark, path).number == 1


def test_a_run_that_dies_before_or_in_its_version_file_leaves_the_last_one(spark):
    path = scratch_path(spark, "versions")
    files.publish_snapshot(spark.range(3), path)
    files.write_attempt(spark.range(9), path)  # died before the version
    assert ids(files.read_snapshot(spark, path)) == [0, 1, 2]
    with open(f"{path}/versions/_000000000002.x", "w") as f:  # died before the rename
        f.write('{"folders": [')
    with open(f"{path}/versions/000000000007.json", "w") as f:  # a file that is not whole
        f.write('{"folders": [')
    assert ids(files.read_snapshot(spark, path)) == [0, 1, 2]
    assert files.publish_snapshot(spark.range(4), path).number == 8  # a number is used once
    assert ids(files.read_snapshot(spark, path)) == [0, 1, 2, 3]


def test_a_reader_keeps_its_version(spark):
    path = scratch_path(spark, "versions")
    first = files.publish_snapshot(spark.range(3), path, note="a")
    reading = files.read_snapshot(spark, path)
    files.publish_snapshot(spark.range(5), path)
    assert ids(reading) == [0, 1, 2] and ids(files.read_snapshot(spark, path, first)) == [0, 1, 2]
    assert [v.number for v in versions.history(spark, path)] == [2, 1]
    assert versions.history(spark, path)[1].body["note"] == "a"


def test_a_table_without_version(spark):
    path = scratch_path(spark, "versions")
    assert versions.latest(spark, path) is None and versions.history(spark, path) == []
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, path)


def test_writers_do_not_overwrite_each_other(spark):
    path = scratch_path(spark, "versions")
    one = files.publish_snapshot(spark.range(1), path)
    assert versions.commit(spark, path, one.folders, one, only_after=True).number == 2
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, path, one.folders, one, only_after=True)
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, path, one.folders, None, only_after=True)
    assert versions.latest(spark, path).number == 2
    assert not versions._rename(spark, versions._file(path, 1), versions._file(path, 2))


def test_retire_by_age(spark):
    path = scratch_path(spark, "versions")
    for n in range(1, 5):
        files.publish_snapshot(spark.range(n), path)
    lost = files.write_attempt(spark.range(2), path)
    assert versions.retire(spark, path, keep=2) == []  # nothing is old yet
    time.sleep(0.05)
    assert sorted(versions.retire(spark, path, keep=2, older_than_seconds=0)) == [1, 2]
    assert [v.number for v in versions.history(spark, path)] == [4, 3]
    assert not os.path.exists(lost) and len(os.listdir(f"{path}/attempts")) == 2
    assert ids(files.read_snapshot(spark, path)) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        versions.retire(spark, path, keep=0)


# --- keyed tables -----------------------------------------------------------------

SCHEMA = "k string, n long, at timestamp_ntz, tags array<string>"
AT = dt.datetime(2026, 1, 1)


def rows(spark, keys, n=0):
    return spark.createDataFrame([(k, n, AT, ["a", None]) for k in keys], SCHEMA)


def table(spark, n=1000, **options):
    return KeyedTable.create(spark, scratch_path(spark, "keyed"), rows(spark, [f"k{i:05d}" for i in range(n)]), "k", **options)


def setting(n):
    return lambda df: df.withColumn("n", F.lit(n).cast("long"))


def state(df):
    return {r.k: r.n for r in df.collect()}


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_a_batch_writes_what_it_changes(spark):
    t = table(spark, 20_000)
    before = written(t.path)
    t.apply("b1", rows(spark, ["k00003", "k19999", "k99999"]), setting(7))
    assert written(t.path) - before < before / 20
    got = state(t.read())
    assert len(got) == 20_000 and got["k00003"] == 7 and got["k19999"] == 7 and got["k00004"] == 0 and "k99999" not in got
    assert t.read().schema == rows(spark, []).schema


def test_a_batch_applied_again_changes_nothing(spark):
    t = table(spark)
    one = t.apply("b1", rows(spark, ["k00003"]), setting(7))
    size = written(t.path)
    again = t.apply("b1", rows(spark, ["k00003"]), setting(8))
    assert again.number == one.number and written(t.path) == size and state(t.read())["k00003"] == 7


def test_later_batches_win_and_old_versions_stay(spark):
    t = table(spark)
    one = t.apply("b1", rows(spark, ["k00003", "k00004"]), setting(7))
    t.apply("b2", rows(spark, ["k00003"]), lambda df: df.withColumn("n", F.col("n") + 1))
    t.apply("b3", rows(spark, ["k00500"]), setting(1))
    got = state(t.read())
    assert (got["k00003"], got["k00004"], got["k00500"]) == (8, 7, 1)
    assert state(t.read(one))["k00003"] == 7 and state(t.read(one))["k00500"] == 0
    marked = {r.k for r in t.read(mark="changed").filter("changed").collect()}
    assert marked == {"k00003", "k00004", "k00500"}


def test_inserts_and_null_keys(spark):
    t = KeyedTable.create(spark, scratch_path(spark, "keyed"), rows(spark, [None, "a", "b"]), "k")
    new = rows(spark, ["c", None], 5)
    t.apply("b1", new, lambda held: new)
    assert sorted((r.k or "", r.n) for r in t.read().collect()) == [("", 0), ("a", 0), ("b", 0), ("c", 5)]
    t.compact()
    assert sorted((r.k or "", r.n) for r in t.read().collect()) == [("", 0), ("a", 0), ("b", 0), ("c", 5)]


def test_an_empty_table_takes_rows(spark):
    t = KeyedTable.create(spark, scratch_path(spark, "keyed"), rows(spark, []), "k")
    assert t.read().count() == 0 and t.lookup(rows(spark, ["a"])).count() == 0
    t.compact()
    t.apply("b1", rows(spark, ["a"]), lambda held: rows(spark, ["a"], 2))
    assert state(t.read()) == {"a": 2}
    t.compact()
    assert state(t.read()) == {"a": 2} and state(t.lookup(rows(spark, ["a", "z"]))) == {"a": 2}


def test_compaction_rewrites_only_hit_ranges(spark):
    t = table(spark, 4000, ranges=8)
    t.apply("b1", rows(spark, ["k00001", "k00002"]), setting(7))
    t.apply("b2", rows(spark, ["k00002"]), setting(9))
    before, want = t.version(), state(t.read())
    after = t.compact()
    assert state(t.read()) == want and after.body["changes"] == [] and after.body["batches"] == ["b1", "b2"]
    moved = [i for i, (a, b) in enumerate(zip(before.body["base"], after.body["base"])) if a["folder"] != b["folder"]]
    assert moved == [0]
    assert t.apply("b1", rows(spark, ["k00001"]), setting(1)).number == after.number  # still known
    t.apply("b3", rows(spark, ["k03999", "k04500"]), lambda df: df.union(rows(spark, ["k04500"])).transform(setting(3)))
    t.compact()
    got = state(t.read())
    assert len(got) == 4001 and got["k03999"] == got["k04500"] == 3 and got["k00002"] == 9


def test_a_compaction_that_dies_changes_nothing(spark, monkeypatch):
    t = table(spark)
    t.apply("b1", rows(spark, ["k00001"]), setting(7))
    monkeypatch.setattr(versions, "_rename", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        t.compact()
    assert state(t.read())["k00001"] == 7 and t.version().number == 2


def test_two_writers(spark):
    t = table(spark)
    seen = []

    def change(df):
        if not seen:  # another writer publishes while this one works
            seen.append(1)
            t.apply("other", rows(spark, ["k00001"]), setting(50))
        return df.withColumn("n", F.col("n") + 1)

    t.apply("b1", rows(spark, ["k00001"]), change)
    assert state(t.read())["k00001"] == 51


def test_clones_share_their_base(spark):
    t = table(spark)
    c = t.clone(scratch_path(spark, "keyed"))
    c.apply("b1", rows(spark, ["k00001"]), setting(7))
    assert state(c.read())["k00001"] == 7 and state(t.read())["k00001"] == 0
    c.compact()
    assert state(c.read())["k00001"] == 7 and state(t.read())["k00001"] == 0


def test_lookup_reads_ranges_and_pushes_keys(spark):
    t = table(spark, 4000, ranges=8)
    t.apply("b1", rows(spark, ["k00002"]), setting(7))
    got = t.lookup(rows(spark, ["k00001", "k00002", None, "zzz", "k00001"]))
    assert state(got) == {"k00001": 0, "k00002": 7}
    few = table(spark, 4000, ranges=8).lookup(rows(spark, ["k00001"]))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "In(k, [k00001])" in plan.replace("EqualTo(k,k00001)", "In(k, [k00001])") and "Exchange" not in plan
    assert len(few.inputFiles()) == 1
    many = rows(spark, [f"k{i:05d}" for i in range(0, 4000, 2)])
    assert t.lookup(many).count() == 2000 and state(t.lookup(many))["k00002"] == 7


@pytest.mark.parametrize("make", [
    lambda i: i, lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i), lambda i: dt.datetime(2020, 1, 1, 0, 0, 0, i),
])
def test_key_types(spark, make):
    df = spark.createDataFrame([(make(i), i) for i in range(300)], "k " + {int: "long", dt.date: "date", dt.datetime: "timestamp_ntz"}[type(make(0))] + ", n int")
    t = KeyedTable.create(spark, scratch_path(spark, "keyed"), df, "k", ranges=4)
    t.apply("b", df.filter("n in (5, 250)"), lambda rows_: rows_.withColumn("n", F.lit(-1)))
    t.compact()
    assert sorted(r.n for r in t.read().collect()) == sorted([-1, -1] + [i for i in range(300) if i not in (5, 250)])


def test_version_files_are_small_json(spark):
    t = table(spark)
    t.apply("b1", rows(spark, ["k00001"]), setting(7))
    with open(f"{t.path}/versions/000000000002.json") as f:
        body = json.load(f)
    assert body["folders"] == [r["folder"] for r in body["base"]] + body["changes"]
