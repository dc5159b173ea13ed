"""Session defaults and table access shared by every plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Engine settings that change plans but not results.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "docgrain") -> SparkSession:
    """A session for tests and single-node runs; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory}
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan, dealt over all cores where the files are too few to keep them busy.

    A file is read by one task for each of its row groups at most. Tables of many files, and files of many splits,
    stay as they are, so that nothing large is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if 2 * len(rows.inputFiles()) > cores or rows.rdd.getNumPartitions() >= 4 * cores:
        return rows
    return rows.repartition(cores)


def dealt(rows: DataFrame, *keys: str, n: int, most: int = 200_000) -> DataFrame:
    """``rows`` dealt by ``keys`` so that a task gets about ``most`` of the ``n`` rows there are, however large the table.

    Spark sizes tasks by the bytes that it reads; where a row becomes many, the memory of a task follows the rows.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // most)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local session gets a folder of its own; a cluster without it is an error, since a machine's
    own folder is not seen by the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docgrain-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What this process has written to the shared folder and not deleted.
_written: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which :func:`release` deletes."""
    path = f"{shared_dir(spark)}/docgrain-{label}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this process has put into the shared folder; results that still read it must have been written."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay until :func:`forget` or :func:`release`, since results are read late; those of its shuffles go at
    once, since nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote; it must not be read again."""
    for root in {name.rpartition("/")[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, root)
        _written.difference_update([p for p in _written if p.rpartition("/")[2] == root.rpartition("/")[2]])
