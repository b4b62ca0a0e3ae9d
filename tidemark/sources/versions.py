"""Versions of a stored table, published atomically.

A version is one small JSON file ``<table>/versions/<number>.json`` that says which
folders the table is made of.  Data is written first, into a folder whose name is used
once (``attempt_folder``); the version file is written beside its place and then renamed
to a number that no file has, which fails where another writer was faster.  Nothing that
a version names is ever overwritten, so a run that dies at any point leaves the last
version as it was, and a reader holds its version while the next one is published.

Renaming without overwriting is atomic on file systems that rename atomically (HDFS,
local disks); on object stores it is as good as the connector's rename, so one writer
per table at a time is assumed there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Another writer has published since the version that this one started from."""


@dataclass(frozen=True)
class Version:
    """A published version: its number and what its file says (``folders`` among it)."""
    number: int
    body: dict = field(compare=False)

    @property
    def folders(self) -> list[str]:
        return list(self.body["folders"])


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def attempt_folder(path: str) -> str:
    """A folder of table ``path`` that no run has used or will use."""
    return f"{path}/attempts/{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all version files, newest first."""
    folder, fs = _path(spark, f"{path}/versions"), _fs(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _file(path: str, number: int) -> str:
    return f"{path}/versions/{number:012d}.json"


def _read(spark: SparkSession, path: str, number: int) -> Version | None:
    """The version of that number; None where its file is not whole."""
    stream = _fs(spark, path).open(_path(spark, _file(path, number)))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        body = json.loads(text)
    except ValueError:
        return None
    return Version(number, body) if isinstance(body, dict) and "folders" in body else None


def newest_first(spark: SparkSession, path: str) -> Iterator[Version]:
    """The whole versions, newest first; each file is read when it is asked for."""
    for number in _numbers(spark, path):
        version = _read(spark, path, number)
        if version is not None:
            yield version


def latest(spark: SparkSession, path: str) -> Version | None:
    """The newest whole version; None for a table that was never published."""
    return next(newest_first(spark, path), None)


def history(spark: SparkSession, path: str) -> list[Version]:
    """All whole versions, newest first."""
    return list(newest_first(spark, path))


def commit(spark: SparkSession, path: str, folders: list[str], after: Version | None = None, only_after: bool = False,
           **info) -> Version:
    """Publish ``folders`` as the table's next version; ``info`` (JSON values) is kept in
    its file.  With ``only_after`` the newest version must be ``after`` (None: there is
    none), else VersionConflict is raised and nothing has changed."""
    body = {"folders": folders, **info, "committed_at": time.time()}
    fs = _fs(spark, path)
    fs.mkdirs(_path(spark, f"{path}/versions"))
    while True:
        numbers = _numbers(spark, path)
        if only_after and latest(spark, path) != after:
            raise VersionConflict(f"{path}: version {after.number if after else 0} is not the newest any more")
        number = (numbers[0] if numbers else 0) + 1
        beside = f"{path}/versions/_{number:012d}.{uuid.uuid4().hex}"
        out = fs.create(_path(spark, beside), False)
        try:
            out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        finally:
            out.close()
        if _rename(spark, beside, _file(path, number)):
            return Version(number, body)
        fs.delete(_path(spark, beside), False)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename without overwriting; False where ``target`` is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    fs = _fs(spark, target)
    source, target = (fs.makeQualified(_path(spark, p)) for p in (source, target))
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, options)
    except Py4JJavaError as exc:
        if "FileAlreadyExists" in exc.java_exception.getClass().getName():
            return False
        raise
    return True


def retire(spark: SparkSession, path: str, keep: int = 3, older_than_seconds: float = 7 * 86400) -> list[int]:
    """Drop versions older than the ``keep`` newest and than the given age, then attempt
    folders that no version names and that are as old (runs that died before their
    version).  A version's file goes before its folders.  Returns the numbers dropped."""
    if keep < 1:
        raise ValueError("the newest version stays")
    fs, now = _fs(spark, path), time.time()
    versions = history(spark, path)
    old = [v for v in versions[keep:] if v.body.get("committed_at", 0) <= now - older_than_seconds]
    for v in old:
        fs.delete(_path(spark, _file(path, v.number)), False)
    named = {f for v in versions if v not in old for f in v.folders}
    root = f"{path}/attempts"
    if fs.exists(_path(spark, root)):
        for status in fs.listStatus(_path(spark, root)):
            name = status.getPath().getName()
            if status.getModificationTime() / 1000 <= now - older_than_seconds and not any(f"/attempts/{name}" in f for f in named):
                fs.delete(status.getPath(), True)
    return [v.number for v in old]
