import base64

import pytest
from pyspark.sql import functions as F

from docgrain.functions import vectors
from docgrain.operators import audit, graph, tables
from docgrain.plans import ingest
from docgrain.sources import files
from docgrain.streaming import jobs


def test_jobs_run_in_blocks_and_try_again(spark, tmp_path):
    root, tries = str(tmp_path / "jobs"), {}
    job = jobs.create(spark, root)
    assert jobs.listing(jobs.events(spark, root)).first()["status"] == "staging"
    jobs.add(spark.createDataFrame([(n, f"/{n}") for n in ("a", "b", "c", "d", "bad")], "name string, path string"), root, job)
    jobs.finalise(spark, root, job)

    def work(block):
        names = [r["name"] for r in block.collect()]
        for n in names:
            tries[n] = tries.get(n, 0) + 1
        if "bad" in names:
            raise OSError("broken file")
        rows = [(f"/{n}", "failed" if n == "b" and tries[n] == 1 else "skipped" if n == "c" else "done", 2, None) for n in names if n != "d"]
        return spark.createDataFrame(rows, "path string, status string, chunks int, error string")

    seen = []
    jobs.run(spark, root, job, work, block=2, on_stage=lambda *x: seen.append(x))
    row = jobs.states(jobs.events(spark, root)).first()
    assert (row["total"], row["done"], row["skipped"], row["failed"], row["chunks"], row["status"]) == (5, 2, 1, 2, 6, "completed")
    assert {r["name"]: r["error"] for r in jobs.failures(jobs.events(spark, root), job).collect()} == {"bad": "broken file", "d": "no result"}
    assert tries["b"] == 2 and seen[:2] == [("ingesting", 2), ("written", 2)] and jobs.active(jobs.events(spark, root)).isEmpty()
    jobs.run(spark, root, job, lambda block: pytest.fail("nothing is left"))
    assert not jobs.cancel(spark, root, job) and not jobs.cancel(spark, root, "other")


def test_cancelled_jobs_stop_before_the_next_block(spark, tmp_path):
    root = str(tmp_path / "jobs")
    assert jobs.listing(jobs.events(spark, root)).isEmpty()
    job = jobs.create(spark, root, "web")
    jobs.add(spark.createDataFrame([(n, n) for n in "abc"], "name string, path string"), root, job)

    def work(block):
        assert jobs.cancel(spark, root, job)
        return block.select("path", F.lit("done").alias("status"), F.lit(1).alias("chunks"), F.lit(None).cast("string").alias("error"))

    jobs.run(spark, root, job, work, block=1)
    row = jobs.states(jobs.events(spark, root)).first()
    assert (row["corpus"], row["done"], row["cancelled"], row["status"]) == ("web", 1, 2, "cancelled")


def test_blobs_seeds_and_uploads(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        files.save_seed(spark, root, "none")
    for n in (1, 2):
        files.write_version(spark.range(n), root)
    assert files.versions(spark, root) == [2, 1]
    assert files.save_seed(spark, root, "../two words")["name"] == "two_words"
    files.write_version(spark.range(9), root)
    assert [s["version"] for s in files.seeds(spark, root)] == [2] and files.restore_seed(spark, root, "two words") == 4
    assert files.read_version(spark, root).count() == 2 and files.restore_version(spark, root, 1) == 5
    path = files.put_blob(spark, f"{root}/x.bin", b"1\x00\xff")
    assert files.get_blob(spark, files.put_blob(spark, path, b"2\x80")) == b"2\x80" and not files.blob_exists(spark, f"{root}/y")
    sent = spark.createDataFrame([("a/../../b.txt", base64.b64encode(b"hi").decode()), ("c.txt", "%%%"), (None, ""), ("d.txt", None)], "name string, content string")
    got = {r["name"]: r["error"] for r in files.stage_uploads(spark, sent, f"{root}/up")}
    assert got == {"b.txt": None, "c.txt": "not base64", "": "no name", "d.txt": "not base64"} and files.get_blob(spark, f"{root}/up/b.txt") == b"hi"
    assert [r["chunk_id"] for r in files.point_get(spark.range(9).withColumnRenamed("id", "chunk_id"), [3, 99]).collect()] == [3]


def test_better_parse(spark):
    good, junk = "A page with more than thirty letters in it.", "\x01\x02" * 40
    first = [("ok", 1, good), ("bad", 1, ""), ("kept", 1, ""), ("alone", 1, None)]
    second = [("ok", 1, junk), ("bad", 1, good), ("kept", 1, ""), ("new", 1, good)]
    page = lambda rows: spark.createDataFrame(rows, "document_id string, page int, text string")
    got = {r["document_id"]: (r["text"], r["verdict"]) for r in audit.better_parse(page(first), page(second), ["document_id"]).collect()}
    assert got == {"ok": (good, "ok"), "bad": (good, "reparsed"), "kept": ("", "poor_kept"), "alone": (None, "poor_no_fallback"), "new": (good, "reparsed")}


def test_self_probe(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(1, "a", text("harbour")), (2, "b", text("storm")), (3, "c", "short")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, text string").withColumn("embedding", vectors.embedding(F.col("text")))
    assert {r["document_id"] for r in audit.self_probe(chunks).collect()} == {"a", "b"}
    lost = chunks.withColumn("embedding", F.when(F.col("chunk_id") == 1, F.array_repeat(F.lit(0.0), 384)).otherwise(F.col("embedding")))
    more = lost.unionByName(spark.range(10, 14).select(F.col("id").alias("chunk_id"), F.lit("z").alias("document_id"), F.lit(text("harbour")).alias("text")).withColumn("embedding", vectors.embedding(F.col("text"))))
    assert {r["document_id"] for r in audit.self_probe(more, spark.createDataFrame([("a",), ("b",)], "document_id string")).collect()} == {"b"}


def test_summary_anchors_and_modes(spark):
    pages = spark.createDataFrame([("d", "report_2021.txt", 1, "  "), ("d", "report_2021.txt", 2, " TITLE \r\n\n line two\n"), ("e", "x", 1, None), ("f", None, 1, "y" * 2000)], "document_id string, source_name string, page int, text string")
    got = {r["document_id"]: r["text"] for r in ingest.summary_anchors(pages).collect()}
    assert got == {"d": "[DOC SUMMARY: report_2021.txt (2021)] TITLE | line two", "f": "[DOC SUMMARY: ] " + "y" * 1200}
    row = spark.range(1).select(ingest.wants_extraction(F.lit(40)).alias("a"), ingest.wants_extraction(F.lit(41)).alias("b"), ingest.wants_extraction(F.lit(41), "on").alias("c"), ingest.wants_extraction(F.lit(1), "off").alias("d")).first()
    assert tuple(row) == (True, False, True, False)
    with pytest.raises(ValueError):
        ingest.wants_extraction(F.lit(1), "maybe")


def test_closed_fields(spark):
    kept = "chunk_id long, manufacturers array<string>, organizations array<string>, location string, item_type string, incident_type string, case_reference string, entities array<string>"
    chunks = spark.createDataFrame([(1, ["B"], None, "", "rifle", None, "", ["Z"]), (2, ["B"], [], "x", "", "", "", [])], kept)
    found = spark.createDataFrame([(1, [("A", "Manufacturer"), ("Oldtown", "location"), ("pistol", "firearm"), ("theft", "incident")])], "chunk_id long, entities array<struct<name:string,type:string>>")
    got = {r["chunk_id"]: r for r in ingest.close_fields(chunks, found).collect()}
    assert (got[1]["manufacturers"], got[1]["location"], got[1]["item_type"], got[1]["incident_type"], got[1]["case_reference"]) == (["A", "B"], "Oldtown", "rifle", "theft", "")
    assert got[1]["entities"] == ["A", "Oldtown", "Z", "pistol", "theft"] and got[2] == chunks.where("chunk_id = 2").first()


def test_backfill(spark):
    text = "| year | n |\n| --- | --- |\n| 2020 | 5 |\n| 2021 | 7 |"
    rows = [("table", text, "x", "Counts", None, None, "", ""), ("text", "plain", None, None, None, "kept", "set", "")]
    chunks = spark.createDataFrame(rows, "content_type string, text string, source_name string, heading string, cells string, table_title string, report_type string, us_state string")
    cells = chunks.drop("cells").withColumn("cells", F.when(F.lit(False), tables.table_cells("text")))
    got = {r["content_type"]: r for r in ingest.backfill(cells).collect()}
    assert got["table"]["cells"] is not None and got["table"]["table_title"] and got["text"]["cells"] is None
    assert (got["text"]["table_title"], got["text"]["report_type"]) == ("kept", "set")


def test_cells_to_markdown(spark):
    grids = [([["a  b", None], ["", " "], ["1"], ["2", "3", "4"]],), ([["", None]],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(grids, "c array<array<string>>").select(tables.cells_markdown(F.col("c"))).collect()]
    assert got == ["| a b |  |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |", "", "", ""]


def test_joint_pagerank_is_that_of_each_query(spark):
    weights = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("x", "y", 3.0)], "a string, b string, weight double")
    seeds = spark.createDataFrame([(1, "a"), (1, "c"), (2, "x"), (3, "nobody")], "query_id int, node string")
    got = {(r["query_id"], r["node"]): r["rank"] for r in graph.personal_pagerank(weights, seeds).collect()}
    expected = {(q, r["node"]): r["rank"] for q in (1, 2) for r in graph.pagerank(weights, seeds.where(F.col("query_id") == q)).collect() if r["rank"] > 0}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)
