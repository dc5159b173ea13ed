"""Streams whose memory is state: several batches and a restart against one batch."""

import pytest
from pyspark.sql import functions as F

from docgrain.operators import extraction, resolution
from docgrain.plans import data_queries, text_queries
from docgrain.session import new_path
from docgrain.streaming import state
from tests.oracle import assert_same, connect

NAMES = ["Acme Works", "Acme Work", "Zeta Ltd", "ACME  works", "Acmé Works", "Beta Corp", "Beta Korp", "Acme Worksx", "Zeta Limited", "", None, "Beta Corp"]


def test_batches_and_a_restart_equal_one_batch(spark):
    rows = [(n, "maker" if i % 5 else "dealer", i) for i, n in enumerate(NAMES * 2)]
    frame = lambda part: spark.createDataFrame(part, "name string, type string, seq long")
    source, sink, check = (new_path(spark, x) for x in ("names", "sink", "state"))
    for part in (rows[:7], rows[7:9], rows[9:]):  # a run for each, from the checkpoint of the one before
        frame(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema("name string, type string, seq long").parquet(source)
        state.run(state.resolve_stream(stream), sink, check).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.select("batch").distinct().count() >= 3
    want = resolution.resolve(frame(rows).where("type is not null")).where("canonical <> ''")
    key = lambda d: sorted(set(map(tuple, d.select("name", "type", "canonical").collect())))
    assert key(got) == key(want) and got.count() == sum(bool(n) for n, *_ in rows)


def test_journal_knows_what_earlier_runs_have_seen(spark):
    runs = [[("a", "one", 1), ("b", "two", 2)], [("a", "one", 3), ("b", "2", 4), ("c", None, 5), (None, "x", 6)], [("c", "", 7), ("b", "two", 8), ("b", "two", 9)]]
    source, sink, check = (new_path(spark, x) for x in ("texts", "sink", "state"))
    schema = "chunk_id string, text string, seq long"
    for part in runs:
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        state.run(state.journal_stream(spark.readStream.schema(schema).parquet(source)), sink, check).awaitTermination()
    got = sorted((r["seq"], r["id"], r["status"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "a", "new"), (2, "b", "new"), (3, "a", "unchanged"), (4, "b", "updated"), (5, "c", "new"), (7, "c", "unchanged"), (8, "b", "updated"), (9, "b", "unchanged")]


def test_only_what_is_new_is_enriched(spark):
    batch = spark.createDataFrame([("a", "x", "new"), ("b", "y", "unchanged"), ("c", "z", "updated")], "id string, text string, status string")
    seen = lambda rows: rows.withColumn("n", F.length("text"))
    assert {r["chunk_id"] for r in state.enriched(batch, seen).collect()} == {"a", "c"}
    assert {r["chunk_id"] for r in state.enriched(batch, seen, F.col("text") == "z").collect()} == {"c"}
    assert state.enriched(batch, extraction.enrich).count() == 0  # too short to be worth it


def test_streams_over_tables(spark, sf):
    """The registry in three runs gives what one pass over the whole table gives; the journal what its SQL gives."""
    key = lambda d: sorted(set(map(tuple, d.select("name", "type", "canonical").collect())))
    assert key(data_queries.registry_stream(spark, sf)) == key(text_queries.entity_resolve(spark, sf).where("canonical <> ''"))
    assert_same(data_queries.journal_stream(spark, sf).toPandas(), connect(sf).execute(data_queries.SQL["journal_stream"]).df())


@pytest.mark.parametrize("form", ["ac", "acme works"])
def test_forms_keep_their_order(form):
    forms = resolution.Forms()
    forms.add(form)
    assert forms.place(form) == form and forms.place(form + "s") == (form if len(form) > 5 else form + "s")
