"""Session construction and shared-storage paths.

Scratch output (sinks in tests, streaming checkpoints, written snapshots) is
placed under the folder the cluster names in ``spark.checkpoint.dir``.  A
private folder is only chosen when that setting is absent (local tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a production job carries: adaptive execution (coalescing, skew
# splitting), dynamic partition overwrite for idempotent sinks, UTC session
# time, Arrow for the few pandas functions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.forceDeleteTempCheckpointLocation": "true",
}


# Sizing for the large-cluster target (~100 TB, ~1000 executors).  Shuffles
# start with many partitions and AQE coalesces them to ~256 MB each, so a
# partition fits executor memory without spilling and small stages do not pay
# for 16k tiny tasks; scans split files into 512 MB input partitions; a side
# is broadcast at run time only when AQE has measured it under 64 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "16384",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(master: str | None = None, app: str = "tidemark",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None, profile: str = "local") -> SparkSession:
    """Session with the recommended settings; ``profile="cluster"`` adds the
    partition sizing for the large-cluster target (CLUSTER_CONF)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written snapshots.

    Reads ``spark.checkpoint.dir`` from the session.  Where the setting is missing a
    private folder is made in local mode (as in unit tests); on a cluster, whose
    machines share no such folder, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder of this application below the shared checkpoint root."""
    return f"{_scratch_root(spark)}/{name}/{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/tidemark/{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has staged with ``scratch_path``.  For the end of a
    job whose results are written elsewhere: frames read from staged folders are gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Bytes of an Arrow batch on its way to a Python worker.  Spark's own bounds (10,000 rows,
# 64 MB) let batches of long texts take tens of MB in the JVM and again in each worker.
ARROW_BATCH_CONF, ARROW_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_SHIPPED: set[str] = set()


def bound_arrow_batches(spark: SparkSession) -> None:
    """Arrow batches of about ARROW_BATCH_BYTES (one row at least), unless the session
    sets a bound of its own."""
    if spark.conf.get(ARROW_BATCH_CONF, None) is None:
        spark.conf.set(ARROW_BATCH_CONF, f"{ARROW_BATCH_BYTES}b")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application), and bound
    the batches that go to them.

    Functions that run in executors (the pandas scorer) are pickled by
    reference to their modules, so executors need the package: it is zipped
    and added with ``addPyFile``, which Spark distributes to every executor.
    The zip goes to the shared checkpoint folder when that is a local or
    ``file:`` path, else to a driver-side temporary folder (code only: executors
    fetch it from the driver, never from that path).
    """
    import os
    import zipfile

    bound_arrow_batches(spark)
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = checkpoint_root(spark)
    local_root = root[len("file:"):] if root.startswith("file:") else root
    if "://" in local_root or not os.path.isabs(local_root):
        local_root = tempfile.mkdtemp(prefix="tidemark-pyfiles-")
    out_dir = os.path.join(local_root, "tidemark", "pyfiles", app)
    os.makedirs(out_dir, exist_ok=True)
    zpath = os.path.join(out_dir, "tidemark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, names in os.walk(pkg_dir):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
