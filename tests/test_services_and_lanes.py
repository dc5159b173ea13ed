from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from docgrain import services, settings
from docgrain.functions import vectors
from docgrain.operators import extraction, graph
from docgrain.plans import lanes
from docgrain.sources import crawl


def test_settings(tmp_path):
    (tmp_path / "settings.json").write_text('{"retrieval": {"top_k": 5}}')
    (tmp_path / "settings.local.json").write_text('{"retrieval": {"graph_hops": 3}}')
    got = settings.load(str(tmp_path), "local", {"DOCGRAIN_RETRIEVAL__HYBRID": "false", "DOCGRAIN_GRAPH__PRUNE__ENABLED": "true", "OTHER": "1"})
    assert (got["retrieval"]["top_k"], got["retrieval"]["graph_hops"], got["retrieval"]["hybrid"], got["graph"]["prune"]["enabled"]) == (5, 3, False, True)
    assert settings.DEFAULTS["retrieval"]["top_k"] == 15


def test_offline_services(spark):
    assert services.offline_chat(["Reply in JSON", "short\n" + "x" * 50]) == ["{}", "x" * 50]
    assert services.is_refusal("I cannot see the image, sorry about that.") and not services.is_refusal("A bar chart of five states and their totals.")
    row = spark.createDataFrame([(1, "The red cat saw the red dog")], "id int, t string")
    dense = row.select(services.apply("embed", F.col("t"), returns="array<double>")).first()[0]
    sparse = {r["slot"]: r["weight"] for r in vectors.hash_embedding(row, "id", "t").collect()}
    assert {i: round(x, 9) for i, x in enumerate(dense) if x} == {i: round(x, 9) for i, x in sparse.items()}


def test_retries():
    waits, calls = [], []

    def busy(items):
        calls.append(1)
        if len(calls) < 3:
            raise HTTPError("u", 429, "busy", None, None)
        return list(items)

    assert services.with_retries(busy, sleep=waits.append)(["a"]) == ["a"] and waits == [0.5, 1.0]

    def refused(items):
        raise HTTPError("u", 401, "no", None, None)

    with pytest.raises(HTTPError):
        services.with_retries(refused, sleep=waits.append)(["a"])


def test_extraction(spark):
    reply = 'Sure: {"entities": [{"name": "Acme", "type": "manufacturer", "description": "d"}, {"name": "Bob", "type": "Person"}, {"name": "x", "type": "planet"}, {"name": " ", "type": "case"}], "relations": [{"source": "Acme", "target": "Bob", "type": "sold_to"}, {"source": "Acme", "target": "acme", "type": "SOLD_TO"}, {"source": "a", "target": "b", "type": "LIKES"}]} done'
    rows = spark.createDataFrame([(reply,), ("nothing",), (None,)], "r string").select(extraction.parse_reply(F.col("r")).alias("g")).collect()
    assert [e["name"] for e in rows[0]["g"]["entities"]] == ["Acme", "Bob"] and len(rows[0]["g"]["relations"]) == 1
    assert rows[1]["g"]["entities"] == [] == rows[2]["g"]["relations"]
    services.register("chat", "fixed", lambda prompts: [reply for _ in prompts])
    chunks = spark.createDataFrame([("1", "words " * 100), ("2", "words " * 100), ("3", "short")], "chunk_id string, text string")
    got = extraction.enrich(chunks, chunks.where("chunk_id = '2'").select("chunk_id"), "fixed")
    assert [r["chunk_id"] for r in got.collect()] == ["1"]
    assert extraction.as_relations(got).select("src", "dst", "rel", "weight").collect() == [("Acme", "Bob", "SOLD_TO", 2)]


def test_lanes(spark):
    rows = [("acme", "dealer one", "SOLD_TO", "c1", 2, "", 0), ("dealer one", "riverside", "co_occurs", "c2", 1, "", 1), ("far", "away", "SOLD_TO", "c9", 1, "", 2)]
    edges = graph.aggregate_edges(spark.createDataFrame(rows, "src string, dst string, rel string, chunk_id string, weight int, description string, seq int")).persist()
    where = (("acme", "c1"), ("dealer one", "c2"), ("riverside", "c3"), ("far", "c9"), ("away", "c9"))
    nodes = spark.createDataFrame([(k, k) for k, _ in where], "key string, label string")
    of_nodes = spark.createDataFrame(where, "key string, chunk_id string")
    asked = spark.createDataFrame([(1, "How is Acme tied to Riverside?"), (2, "zebra")], "query_id int, question string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lanes.graph_lane(nodes, of_nodes, edges, asked).collect()}
    assert got == {(1, "c1"): 0.65, (1, "c2"): 0.65, (1, "c3"): 0.65}
    ranked = {r["chunk_id"]: r["score"] for r in lanes.pagerank_lane(nodes, of_nodes, edges, asked).collect()}
    assert max(ranked.values()) == pytest.approx(0.70) and "c9" not in {c for c, s in ranked.items() if s > 0.5}
    assert [r["text"] for r in lanes.evidence_paths(nodes, edges, asked).collect()] == ["acme --SOLD_TO--> dealer one --co_occurs--> riverside"]
    briefs = spark.createDataFrame([("a", "Community of dealers around Acme.", [("Acme",)]), ("b", "Community of rivers.", [("Nile",)])], "community string, summary string, top array<struct<label:string>>")
    row = lanes.global_answer(briefs, "which dealers recur?").first()
    assert row["communities"] == ["a"] and row["confidence"] == pytest.approx(0.5)
    assert lanes.global_answer(briefs, "zebra").count() == 0


def test_crawl(spark):
    site = {"http://x/sitemap.xml": "<loc>http://x/a</loc><loc>http://x/private/b</loc><loc>http://x/c</loc>", "http://x/robots.txt": "User-agent: *\nDisallow: /private\nCrawl-delay: 3", "http://x/a": "<title>A</title><a href='z'>", "http://x/c": '<title>C</title><p>text</p><a href="r.pdf">r</a>'}
    waits = []
    pages = crawl.crawl(spark, "http://x/sitemap.xml", site.__getitem__, sleep=waits.append)
    assert [r["title"] for r in crawl.page_records(pages).orderBy("url").collect()] == ["A", "C"] and waits == [3.0]


def test_web_results(spark):
    rows = [("Harbour rebuilt", "https://a.gov/x", "The harbour was rebuilt after the storm. " * 10, 0.9), ("Ad", "https://b.com", "buy", 0.9), ("Other", "https://c.com", "Nothing of that kind is told here at all. " * 10, 0.1), ("Harbour again", "https://d.org", "The harbour was rebuilt after the storm. " * 10, 0.8)]
    results = spark.createDataFrame(rows, "title string, url string, content string, score double")
    known = spark.createDataFrame([("https://d.org", 0.95)], "url string, similarity double")
    got = {r["url"]: (r["verdict"], r["reason"]) for r in crawl.judge_results(results, "when was the harbour rebuilt", known).collect()}
    assert got == {"https://a.gov/x": ("add", None), "https://b.com": ("skip", "too thin"), "https://c.com": ("skip", "low relevance"), "https://d.org": ("skip", "redundant")}
