"""A store of records behind Spark's Python data sources: partitioned reads, batches that are written once.

``docgrain_store`` keeps records (id, payload) as a folder of Parquet parts and a log of batches, in place of an outside
vector or search store; another store has the same shape with its client in ``write`` and ``read``. A task of a write
stages one part and reports it; the batch counts from the moment that its log entry, which names the parts, is there.
Tasks that are repeated or lose a race leave parts that no entry names, an aborted batch leaves no entry, and a batch
that is in the log already is not written again. The newest batch says what an id holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "id string, payload string, batch string, at long"


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _log(path: str) -> list[dict]:
    """Entries of the log, in order."""
    fs, root = _fs(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/log", allow_not_found=True))
    return [json.loads(fs.open_input_file(f.path).read()) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json")]


@dataclass
class _Part(InputPartition):
    name: str
    batch: str
    at: int


@dataclass
class _Staged(WriterCommitMessage):
    name: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        return [_Part(p, e["batch"], n) for n, e in enumerate(_log(self.path)) for p in e["parts"]] or [_Part("", "", -1)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _fs(self.path)
        for batch in pq.ParquetFile(fs.open_input_file(f"{root}/parts/{partition.name}")).iter_batches():
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("payload"), pa.array([partition.batch] * n), pa.array([partition.at] * n, pa.int64())], names=["id", "payload", "batch", "at"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str, batch: str, fail: str):
        self.path, self.batch, self.fail = path, batch, fail

    def write(self, iterator) -> _Staged:
        from pyspark import TaskContext

        task = TaskContext.get()
        rows = [(r["id"], r["payload"]) for r in iterator]
        if self.fail == "once" and task.attemptNumber() == 0 and task.partitionId() == 0:
            raise OSError("lost")  # for tests: the first task loses its executor once
        if self.fail == "always":
            raise OSError("refused")
        fs, root = _fs(self.path)
        fs.create_dir(f"{root}/parts", recursive=True)
        name = f"{self.batch}-{task.partitionId()}-{uuid.uuid4().hex}.parquet"
        table = pa.table({"id": pa.array([i for i, _ in rows], pa.string()), "payload": pa.array([p for _, p in rows], pa.string())})
        with fs.open_output_stream(f"{root}/parts/{name}") as out:
            pq.write_table(table, out)
        return _Staged(name, len(rows))

    def commit(self, messages: list) -> None:
        if any(e["batch"] == self.batch for e in _log(self.path)):
            return self.abort(messages)
        fs, root = _fs(self.path)
        fs.create_dir(f"{root}/log", recursive=True)
        entry = {"batch": self.batch, "parts": [m.name for m in messages if m and m.rows], "rows": sum(m.rows for m in messages if m)}
        number = len(_log(self.path))
        with fs.open_output_stream(f"{root}/log/{self.batch}.tmp") as out:
            out.write(json.dumps(entry).encode())
        fs.move(f"{root}/log/{self.batch}.tmp", f"{root}/log/{number:08d}.json")
        return None

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/parts/{m.name}")


class StoreSource(DataSource):
    """Options: path; for writing, batch, a name that is the same when a write is repeated."""

    @classmethod
    def name(cls) -> str:
        return "docgrain_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("batch") or uuid.uuid4().hex, self.options.get("fail", ""))


def put(rows: DataFrame, path: str, batch: str, fail: str = "") -> None:
    """Write records (id, payload) as a batch; one of that name that is there already stays as it is. Rows without an id are left out.

    Of rows with one id in a batch the largest payload counts.
    """
    rows.sparkSession.dataSource.register(StoreSource)
    one = rows.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.max("payload").alias("payload"))
    full = one.select("id", "payload", F.lit(batch).alias("batch"), F.lit(0).cast("long").alias("at"))
    full.write.format("docgrain_store").option("path", path).option("batch", batch).option("fail", fail).mode("append").save()


def get(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload, batch): the newest payload of every id; ids whose newest payload is null are deleted."""
    spark.dataSource.register(StoreSource)
    rows = spark.read.format("docgrain_store").option("path", path).load()
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))
    return rows.withColumn("r", newest).where("r = 1 and payload is not null").select("id", "payload", "batch")
