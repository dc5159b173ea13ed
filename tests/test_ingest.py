import pandas as pd
from pyspark.sql import functions as F

from docgrain.operators import graph
from docgrain.plans import answer, ingest

REPORT = "OVERVIEW OF CASES\nCase No. AB-2022-001 was opened in Milwaukee, WI on Jan 5, 2022. A Glock pistol was sold to Quick Pawn and purchased by John Miller after a theft. " * 3
GRID = "Counts by state\n| State | 2022 | 2023 |\n| --- | --- | --- |\n| Texas | 1,234 | 1,310 |\n| Ohio | 12 | 14 |"


def documents(spark):
    rows = [(1, "a.txt", REPORT), (2, "b.txt", REPORT), (3, "c.txt", GRID), (4, "d.txt", None), (5, "e.txt", ""), (6, "f.txt", "tiny")]
    return spark.createDataFrame(rows, "document_id long, source_name string, text string")


def test_documents_become_chunks_tables_vectors_and_graph(spark):
    got = ingest.ingest(documents(spark))
    status = {r["document_id"]: r["status"] for r in got.journal.collect()}
    assert status == {1: "new", 2: "duplicate", 3: "new", 4: "empty", 5: "duplicate", 6: "empty"}
    chunks = got.chunks.collect()
    assert {r["document_id"] for r in chunks} == {1, 3} and all(len(r["embedding"]) == 384 for r in chunks)
    assert got.tables.count() == 1 and got.rows.count() == 2
    types = {r["key"]: r["type"] for r in got.nodes.collect()}
    assert types["glock"] == "manufacturer" and types["milwaukee, wi"] == "location" or "milwaukee  wi" in types or "milwaukee wi" in types
    assert got.edges.count() > 3


def test_known_documents_are_skipped_and_changed_ones_replaced(spark):
    docs = documents(spark)
    first = ingest.ingest(docs)
    changed = docs.withColumn("text", F.when(F.col("document_id") == 3, F.concat("text", F.lit("\n| Utah | 3 | 4 |"))).otherwise(F.col("text")))
    second = ingest.ingest(changed, first.journal.select("document_id", "hash"))
    status = {r["document_id"]: r["status"] for r in second.journal.collect()}
    assert status == {1: "unchanged", 2: "duplicate", 3: "updated", 4: "unchanged", 5: "duplicate", 6: "unchanged"}
    both = ingest.replace_documents(first.chunks, second)
    assert both.where("document_id = 3").count() == 1 and "Utah" in both.where("document_id = 3").first()["text"]
    assert ingest.ingest(docs.limit(0)).journal.count() == 0


def test_typed_relations_win_over_meeting(spark):
    chunks = spark.createDataFrame([("c1", "pdf", ["colt"], ["Quick Pawn"], [], "", "", "", "", ["Ann Lee"])], "chunk_id string, corpus string, manufacturers array<string>, sellers array<string>, buyers array<string>, item_type string, incident_type string, location string, case_reference string, entities array<string>")
    found = spark.createDataFrame([("c1", [{"source": "Colt", "target": "Quick Pawn", "type": "sold_to", "description": "d"}])], "chunk_id string, relations array<struct<source:string,target:string,type:string,description:string>>")
    nodes, edges = ingest.build_graph(chunks, found)
    rel = {(r["src"], r["dst"]): (r["rel"], r["weight"]) for r in edges.collect()}
    assert rel == {("colt", "quick pawn"): ("SOLD_TO", 2), ("colt", "ann lee"): ("co_occurs", 1), ("quick pawn", "ann lee"): ("co_occurs", 1)}
    assert {r["key"]: r["count"] for r in nodes.collect()} == {"colt": 3, "quick pawn": 3, "ann lee": 2}


def test_node_verification(spark):
    nodes = spark.createDataFrame([("colt", "Colt", "manufacturer", 5), ("table", "Table", "entity", 9), ("thing", "Thing", "entity", 1), ("ann", "Ann Lee", "person", 1)], "key string, label string, type string, count long")
    edges = spark.createDataFrame([("colt", "ann"), ("colt", "table"), ("thing", "ann")], "src string, dst string")
    kept, left, verdicts = graph.verify_nodes(nodes, edges, lambda names: {"Thing"})
    assert {r["key"] for r in kept.collect()} == {"colt", "ann"} and [tuple(r) for r in left.collect()] == [("ann", "colt")[::-1]]
    assert {r["key"]: r["verdict"] for r in verdicts.collect()} == {"thing": "drop", "ann": "keep"}
    again = graph.verify_nodes(nodes, edges, lambda names: set(names), verdicts)
    assert {r["key"] for r in again[0].collect()} == {"colt", "ann"}
    assert {r["key"] for r in graph.verify_nodes(nodes, edges)[0].collect()} == {"colt", "thing", "ann"}
    assert [r["key"] for r in graph.top_nodes(nodes, 2).collect()] == ["table", "colt"]


def test_numbers_without_a_source_are_marked(spark):
    answers = spark.createDataFrame([(1, "There were 1,234 cases.", 0.9), (2, "There were 77 and 88 cases.", 0.9), (3, "About 55 items.", 0.3)], "query_id int, answer string, confidence double")
    contexts = spark.createDataFrame([(1, "1234 cases"), (2, "88 only")], "query_id int, context string")
    got = {r["query_id"]: r for r in answer.grounded(answers, contexts).collect()}
    assert got[1]["answer"] == "There were 1,234 cases." and got[1]["confidence"] == 0.9
    assert "77 " in got[2]["answer"] and got[2]["answer"].endswith("treat with caution.") and got[2]["confidence"] == 0.4 and got[3]["confidence"] == 0.3
    better = lambda bad: bad.select("query_id", F.lit("There were 88 cases.").alias("answer"))
    got = {r["query_id"]: r for r in answer.grounded(answers, contexts, better).collect()}
    assert got[2]["answer"] == "There were 88 cases." and got[2]["confidence"] == 0.9 and "55" in got[3]["answer"]


def test_dense_lane_with_ids_of_text(spark):
    chunks = spark.createDataFrame(pd.DataFrame({"chunk_id": ["x1", "x2", "x3"], "text": ["pistol traces in ohio", "rifle exports by year", ""]}))
    asked = spark.createDataFrame([("q", "traces of pistols in ohio: pistol traces")], "query_id string, question string")
    assert [r["chunk_id"] for r in answer.dense_lane(chunks, asked, 2).collect()] == ["x1"]


def test_summaries_are_chunks_of_their_own(spark):
    docs = spark.createDataFrame([("d", "report_2021.txt", "TITLE\n\nThe harbour was rebuilt after the storm of that winter, people say."), ("e", "x", None)], "document_id string, source_name string, text string")
    batch = ingest.ingest(docs, summaries=True)
    texts = [r["text"] for r in batch.chunks.collect()]
    assert sum("[DOC SUMMARY: report_2021.txt (2021)]" in t for t in texts) == 1 and len(texts) == 2
    assert batch.chunks.select("chunk_id").distinct().count() == 2
    assert {r["document_id"]: r["status"] for r in batch.journal.collect()} == {"d": "new", "e": "empty"}


def test_few_bytes_of_documents_are_dealt_to_many_tasks(spark):
    """Chunking and enrichment are long work on few bytes: tasks sized by bytes did it one after another."""
    docs = spark.createDataFrame([(i, f"{i}.txt", f"Agent Mary Stone sold rifle number {i} in Dayton, OH to a dealer of the town.") for i in range(40)], "document_id long, source_name string, text string").coalesce(1)
    done = ingest.ingest(docs)
    assert done.chunks.count() == 40
    assert len(done.chunks.inputFiles()) > 1
