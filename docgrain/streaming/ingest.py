"""Incremental ingestion with Structured Streaming: new files once, jobs as an event log, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docgrain.functions import text as T
from docgrain.operators.chunking import chunk


def chunk_stream(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", delay: str | None = None, time_col: str | None = None) -> DataFrame:
    """Chunks of a stream of documents, equal texts once.

    With ``time_col`` and ``delay`` equal texts are recognised within the watermark only, and the state is bounded;
    without, for as long as the query lives.
    """
    rows = docs.withColumn("__md5", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    if time_col and delay:
        rows = rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["__md5"])
    else:
        rows = rows.dropDuplicates(["__md5"])
    return chunk(rows.drop("__md5"), id_col, text_col)


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Chunk the documents that arrive as JSON lines below ``source`` into Parquet at ``sink``.

    What is done is in ``checkpoint``: a restart goes on where the last run ended, and a batch that is repeated
    overwrites itself, since its folder is named by its number. A failed batch is tried again by the restart.
    """
    docs = spark.readStream.schema(schema).json(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        chunk(rows.dropDuplicates(["text"])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value); works on tables and, with ``delay``, on streams."""
    rows = events.withWatermark("ts", delay) if delay else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of bursts of events no further than ``gap`` apart."""
    rows = events.withWatermark("ts", delay) if delay else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def document_key(name_col: str = "source_name"):
    """Key under which a document is known again."""
    return T.document_id(F.col(name_col))
