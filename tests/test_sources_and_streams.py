import json

import pytest
from pyspark.sql import functions as F

from docgrain.operators import audit
from docgrain.sources import files, html
from docgrain.streaming import ingest


def test_html():
    page = "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><p>One &amp; two</p> <p>three</p></body></html>"
    assert html.text_of(page) == "T\nOne & two\nthree" and html.text_of(None) == ""


def test_html_fields(spark):
    page = '<title> A <b>x</b></title><h1>One <i>two</i></h1><h4>no</h4><meta name="pubdate" content="2024-01-02"><a href="a.pdf?x#y">a</a><a href="/b.pdf">b</a><a href="/c">c</a>'
    row = spark.createDataFrame([("https://x.example/d/", page), (None, None)], "url string, html string")
    got = row.select(html.headings(F.col("html")), html.meta_date(F.col("html"))).collect()
    assert got[0] == (["One two"], "2024-01-02") and got[1] == ([], "")
    assert {r["link"] for r in html.absolute_links(row).collect()} == {"https://x.example/d/a.pdf?x#y", "https://x.example/b.pdf"}
    xml = spark.createDataFrame([("<u xmlns='a'><url><loc> http://a </loc></url><url><s:loc>http://b</s:loc></url></u>",)], "x string")
    assert xml.select(html.sitemap_urls(F.col("x"))).first()[0] == ["http://a", "http://b"]
    assert html.robots_rules("User-agent: *\nDisallow: /private\nCrawl-delay: 2\nUser-agent: other\nDisallow: /x") == (["/private"], 2.0)


def test_reading_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("hello")
    (tmp_path / "two.html").write_text("<p>x</p><script>y</script>")
    (tmp_path / ".hidden.txt").write_text("no")
    got = {r["source_name"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert {k: v["text"] for k, v in got.items()} == {"a/one.txt": "hello", "two.html": "x"} and got["two.html"]["page"] == 1
    (tmp_path / "three.xyz").write_text("?")
    with pytest.raises(Exception, match="no parser for .xyz"):
        files.read_documents(spark, str(tmp_path)).collect()


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    assert files.latest_version(spark, root) == 0
    files.write_version(spark.range(3), root, expected=0)
    files.write_version(spark.range(5), root, expected=1)
    with pytest.raises(RuntimeError, match="version 2, not 1"):
        files.write_version(spark.range(7), root, expected=1)
    assert files.read_version(spark, root).count() == 5 and files.read_version(spark, root, 1).count() == 3


def test_jsonl(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "a int, c string").collect() == [(1, None)]


def test_stream_ingest_goes_on_where_it_ended(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    schema = "document_id string, text string"
    put = lambda name, *rows: (source / name).write_text("\n".join(json.dumps({"document_id": d, "text": t}) for d, t in rows))
    put("1.json", ("a", "word " * 300), ("b", "word " * 300))
    ingest.ingest(spark, str(source), schema, sink, state).awaitTermination()
    first = spark.read.parquet(sink).count()
    put("2.json", ("c", "other " * 100))
    ingest.ingest(spark, str(source), schema, sink, state).awaitTermination()
    rows = spark.read.parquet(sink)
    assert rows.count() > first and {r[0] for r in rows.select("document_id").distinct().collect()} >= {"c"}
    ingest.ingest(spark, str(source), schema, sink, state).awaitTermination()
    assert spark.read.parquet(sink).count() == rows.count()


def test_chunk_stream_drops_repeats(spark, tmp_path):
    spark.createDataFrame([("a", "word " * 100), ("b", "word " * 100), ("c", None)], "document_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "in"))
    query = ingest.chunk_stream(stream).writeStream.format("memory").queryName("chunked").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("chunked").select("document_id").distinct().count() == 1


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 2.0), (1, "2024-01-01 02:00:00", "b", 4.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["event_type"], r["n"], r["total"]) for r in ingest.event_windows(rows).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert sorted(r["n"] for r in ingest.sessions(rows).collect()) == [1, 2]


def test_audits(spark):
    docs = spark.createDataFrame([(2, "x"), (1, "x"), (3, None), (4, ""), (5, "y")], "doc_id int, text string")
    assert sorted(r["doc_id"] for r in audit.exact_dedup(docs).collect()) == [1, 3, 5]
    pages = spark.createDataFrame([("f", "a" * 50), ("f", "\x01\x02" + "b" * 40), ("g", ""), ("g", None)], "f string, text string")
    got = {r["f"]: r for r in audit.parse_quality(pages, ["f"]).collect()}
    assert got["f"]["bad"] and got["f"]["garble_ratio"] == round(2 / 92, 4) and got["g"]["bad"] and got["g"]["empty_ratio"] == 1.0
    rows = spark.createDataFrame([("s", [], 1.0), ("", ["e"], None)], "name string, list array<string>, x double")
    cover = audit.metadata_verdict(audit.coverage(rows, ["name", "list", "x"]), ["name"]).first()
    assert (cover["name"], cover["list"], cover["x"], cover["missing"], cover["verdict"]) == (0.5, 0.5, 0.5, ["name"], "gaps")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, audit.upsert(base, new, "k").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    acts = audit.manifest_actions(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_key string, hash string"), spark.createDataFrame([("a", "1"), ("b", "x")], "doc_key string, hash string"))
    assert {r["doc_key"]: r["action"] for r in acts.collect()} == {"a": "skip", "b": "update", "c": "create"}
    jobs = spark.createDataFrame([("j", "done", 2.0, 3), ("j", "failed", 4.0, 0), ("j", "queued", None, None)], "job_id string, status string, secs double, chunks int")
    j = audit.job_stats(jobs).first()
    assert (j["done"], j["failed"], j["remaining"], j["eta_secs"], j["pct"]) == (1, 1, 1, 3.0, 66.7)


def test_catalog_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, "a", "text", 1, 5), (None, "a", "table", 1, 7), ("c", "a", None, 2, 1)], "corpus string, source_name string, content_type string, page int, ingested_at int")
    got = {r["corpus"]: r for r in audit.document_catalog(rows).collect()}
    assert got[None]["content_types"] == {"table": 1, "text": 1} and got[None]["n_pages"] == 1 and got[None]["last_seen"] == 7
    assert got["c"]["content_types"] == {"": 1} and audit.document_catalog(rows.limit(0)).count() == 0


def test_routes(spark):
    names = ["https://a.example/sitemap_1.xml", "https://a.example/x", "/d/a.pdf", "b.PNG", "c.html", "d.md", "folder/", "e"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(files.route(F.col("s"))["kind"]).collect()]
    assert got == ["sitemap", "url", "pdf", "image", "html", "text", "dir", "unknown"]
