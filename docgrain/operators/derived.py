"""Tables that are made of other tables and kept: rebuilt only where what they were made of has changed.

What stands for a key (a document's table rows, a community's summary) follows from the source rows of that key alone.
A kept table is a folder of segments, each with the keys that it has made anew (key, print; a null print: gone) and
their rows; a later segment overrules earlier ones. A versioned list names the live segments and the version of the
source, so that a stale table is noticed and an interrupted refresh leaves nothing half done.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.session import materialise
from docgrain.sources import files

#: Live segments after which a refresh rewrites the table as one.
SEGMENTS = 8


def state(spark: SparkSession, root: str) -> tuple[int, list[int], str | None]:
    """(number of the list, live segments, version of the source); (0, [], None) where nothing is kept."""
    number = files.latest_version(spark, f"{root}/lists")
    if not number:
        return 0, [], None
    row = files.read_version(spark, f"{root}/lists", number).first()
    return number, list(row["segments"]), row["version"]


def is_stale(spark: SparkSession, root: str, version: str) -> bool:
    """Whether the kept table was made of another version of its source."""
    return state(spark, root)[2] != version


def _read(spark: SparkSession, root: str, segments: list[int], kind: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/segments/{n}/{kind}").withColumn("__segment", F.lit(n)) for n in segments])


def read(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The rows of the kept table, each key's from the segment that made it last."""
    _, segments, _ = state(spark, root)
    if not segments:
        raise FileNotFoundError(f"nothing kept below {root}")
    rows = _read(spark, root, segments, "rows")
    if len(segments) > 1:
        last = _read(spark, root, segments[1:], "keys").groupBy(key).agg(F.max("__segment").alias("__last"))
        rows = rows.join(last, key, "left").where("__last is null or __segment >= __last").drop("__last")
    return rows.drop("__segment")


def refresh(source: DataFrame, root: str, version: str, key: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table that ``derive`` makes of ``source``, by ``key``, kept below ``root`` and brought to this version.

    A table of this version is read as it is. Otherwise the hashes of each key's source rows are compared with those
    that the kept rows were made of; only new and changed keys go through ``derive``, and keys that are gone lose
    their rows. ``derive`` keeps the column ``key`` and must not mix keys. Source rows without a key are left out. The
    order and the repetition of a key's source rows do count as its content only by number: equal rows are counted.
    """
    spark = source.sparkSession
    number, segments, known = state(spark, root)
    if known == version:
        return read(spark, root, key)
    rows = source.where(F.col(key).isNotNull())
    prints = rows.groupBy(key).agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string").alias("print"))
    changed = prints.withColumn("was", F.lit(None).cast("string"))
    if segments:
        old = _read(spark, root, segments, "keys").groupBy(key).agg(F.max_by("print", "__segment").alias("was")).where("was is not null")
        changed = prints.join(old, key, "full_outer").where(~F.col("print").eqNullSafe(F.col("was")))
    changed = materialise(changed, "changed")
    segment = max(segments, default=0) + 1
    fresh = changed.where("print is not null").select(key)
    derive(rows.join(fresh, key, "left_semi").select(*rows.columns)).write.mode("overwrite").parquet(f"{root}/segments/{segment}/rows")
    changed.select(key, "print").write.mode("overwrite").parquet(f"{root}/segments/{segment}/keys")
    _commit(spark, root, number, [*segments, segment], version)
    if len(segments) >= SEGMENTS:
        compact(spark, root, key)
    return read(spark, root, key)


def _commit(spark: SparkSession, root: str, number: int, segments: list[int], version: str) -> None:
    row = spark.createDataFrame([(segments, version)], "segments array<int>, version string")
    files.write_version(row.coalesce(1), f"{root}/lists", number)


def compact(spark: SparkSession, root: str, key: str) -> None:
    """Write the kept table as one segment; older lists stay readable."""
    number, segments, version = state(spark, root)
    segment = max(segments) + 1
    read(spark, root, key).write.mode("overwrite").parquet(f"{root}/segments/{segment}/rows")
    keys = _read(spark, root, segments, "keys").groupBy(key).agg(F.max_by("print", "__segment").alias("print")).where("print is not null")
    keys.write.mode("overwrite").parquet(f"{root}/segments/{segment}/keys")
    _commit(spark, root, number, [segment], version)
