"""Derived tables that are kept, a store behind a data source, and the answer plan with tables and graph."""

import os

import pytest
from pyspark.sql import functions as F

from docgrain.operators import derived, tables
from docgrain.plans import answer
from docgrain.session import new_path
from docgrain.sources import store


def words(rows):
    return rows.select("k", F.explode(F.split("t", " ")).alias("w"))


def test_only_changed_keys_are_derived_again(spark):
    root, seen = new_path(spark, "kept"), []

    def derive(rows):
        seen.append(sorted({r["k"] for r in rows.collect()}))
        return words(rows)

    runs = [[(k, f"a{k} b") for k in range(200)], [(k, f"a{k} b" if k not in (7, 8) else "new") for k in range(1, 201)], [(7, "new"), (7, "more"), (None, "x")], [], [(1, "a1 b")]]
    for n, rows in enumerate(runs):
        source = spark.createDataFrame(rows, "k long, t string").repartition(3)
        assert derived.is_stale(spark, root, str(n))
        got = derived.refresh(source, root, str(n), "k", derive)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, words(source.where("k is not null")).collect()))
        assert not derived.is_stale(spark, root, str(n)) and derived.refresh(source, root, str(n), "k", derive).count() == got.count()
    assert seen == [list(range(200)), [7, 8, 200], [7], [], [1]]
    derived.compact(spark, root, "k")
    assert derived.state(spark, root)[1] == [6] and sorted(map(tuple, derived.read(spark, root, "k").collect())) == [(1, "a1"), (1, "b")]


def test_a_store_holds_every_row_once(spark, tmp_path):
    """One task fails once; a repeated batch, an aborted one and later payloads."""
    path = str(tmp_path / "store")
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("p"), "id").alias("payload")).repartition(4)
    store.put(rows, path, "one")
    assert len(os.listdir(f"{path}/log")) == 1
    store.put(rows, path, "one")
    with pytest.raises(Exception, match="refused"):
        store.put(rows, path, "two", fail="always")
    change = spark.createDataFrame([("5", "new"), ("6", None), ("900", "more"), (None, "x")], "id string, payload string")
    store.put(change, path, "three")
    got = {r["id"]: r["payload"] for r in store.get(spark, path).collect()}
    assert got == {str(i): f"p{i}" for i in range(400) if i != 6} | {"5": "new", "900": "more"}
    assert store.get(spark, str(tmp_path / "none")).count() == 0
    raw = spark.read.format("docgrain_store").option("path", path).load()
    assert raw.count() == 403 and raw.rdd.getNumPartitions() >= 2


def test_computed_results_come_first_and_the_graph_finds_more(spark):
    cells = "named_struct('columns', array('name', 'n'), 'rows', array(array('zeta', '3'), array('eta', '4')))"
    source = spark.sql(f"select 't' as chunk_id, 'src' as source, 1 as page, '' as document_date, 'T' as title, {cells} as cells")
    kept = answer.Store(*tables.build_store(source))
    chunks = spark.createDataFrame([(1, "the zeta report says much about the work of the plant in spring"), (2, "wholly other matters of no interest to anybody in this whole town")], "chunk_id long, text string")
    chunks = chunks.selectExpr("chunk_id", "text", "'s' as doc_source", "'text' as content_type", "'' as document_date", "false as has_metadata", "1.0D as confidence", "false as has_cells")
    asked = spark.createDataFrame([(1, "tell me of the zeta report")], "query_id long, question string")
    graph = answer.Graph(
        spark.createDataFrame([("zeta", "zeta"), ("theta", "theta")], "key string, label string"),
        spark.createDataFrame([("theta", "2")], "key string, chunk_id string"),
        spark.createDataFrame([("zeta", "theta", "sold_to", 1.0, True)], "src string, dst string, rel string, weight double, typed boolean"),
    )
    statements = [(1, "SELECT c1 FROM t1 WHERE c2 = '3'", ["t"]), (1, "DROP TABLE t1", ["t"]), (1, "SELECT nothing FROM t1", ["t"])]
    cited = answer.answer(chunks, asked, answer.Settings(dense=False, min_evidence=0.0), store=kept, graph=graph, statements=statements).first()["citations"]
    names = [c["chunk_id"] for c in cited]
    assert names[0].startswith("sql:") and {"1", "2"} <= set(names)
