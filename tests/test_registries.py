from pyspark.sql import functions as F

from docgrain import services
from docgrain.operators import audit, evaluation, graph, resolution, search, tables
from docgrain.sources import crawl, files


def test_a_registry_grows_batch_by_batch(spark):
    batch = lambda *names: spark.createDataFrame([(n, "maker", i) for i, n in enumerate(names)], "name string, type string, seq int")
    first = resolution.resolve(batch("Smithson Arms", "Other Works"))
    known = resolution.grow(None, first)
    second = {r["name"]: r["canonical"] for r in resolution.resolve(batch("Smithsons Arms", "Zebra", ""), known=known).collect()}
    alone = {r["name"]: r["canonical"] for r in first.collect()}
    assert second["Smithsons Arms"] == alone["Smithson Arms"] and second["Zebra"] == "zebra" and second[""] == ""
    grown = resolution.grow(known, resolution.resolve(batch("Zebra"), known=known))
    assert grown.count() == 3 and resolution.resolve(batch(), known=known).count() == 0


def test_sitemaps_and_linked_documents(spark):
    spaced = '<s:urlset xmlns:s="u"><s:url><s:loc> http://x/a </s:loc></s:url><s:loc>http://x/b?c=1&amp;d=2</s:loc></s:urlset>'
    assert crawl.sitemap_locations(spaced, 5) == ["http://x/a", "http://x/b?c=1&d=2"] and crawl.sitemap_locations(spaced, 1) == ["http://x/a"]
    assert crawl.sitemap_locations("<loc>http://x/a</loc> & <loc></loc>", 5) == ["http://x/a"] and crawl.sitemap_locations("", 5) == []
    assert crawl.sitemap_locations('<!DOCTYPE u [<!ENTITY e "boom">]><u><loc>&e;</loc></u>', 5) == ["&e;"]
    pages = spark.createDataFrame([("http://x/b/", '<a href="r.pdf?v=1">r</a><a href="/s.PDF">s</a>'), ("http://x/a/", '<a href="/s.PDF">s</a><a href="t.html">t</a>'), ("http://x/c", None)], "url string, html string")
    assert {tuple(r) for r in crawl.linked_documents(pages).collect()} == {("http://x/b/r.pdf?v=1", "http://x/b/", "r.pdf"), ("http://x/s.PDF", "http://x/a/", "s.PDF")}


def test_stored_edges_and_reports(spark):
    edges = spark.createDataFrame([("SOLD_TO", None), ("co_occurs", None), ("co_occurs", True), (None, None)], "rel string, typed boolean")
    assert [r["typed"] for r in graph.with_typed(edges).collect()] == [True, False, True, False]
    assert [r["typed"] for r in graph.with_typed(edges.drop("typed")).collect()] == [True, False, False, False]
    reports = spark.createDataFrame([(i, f"agent{i % 3}") for i in range(300)], "at int, agent string")
    assert [r["at"] for r in audit.latest_reports(reports).collect()] == list(range(299, 99, -1))
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2), (2, None, 0), (2, "c", 1)], "q int, v string, p int")
    assert {r["q"]: r["values"] for r in audit.ordered_distinct(rows, ["q"], "v", "p").collect()} == {1: ["b", "a"], 2: ["c"]}


def test_vector_search_with_a_predicate(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "y")], "chunk_id int, embedding array<double>, label string")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r["chunk_id"] for r in search.vector_topk(vectors, asked, 5, where=F.col("label") == "y").collect()] == [2]


def test_families_get_names_once(spark):
    services.register("chat", "names", lambda prompts: ['{"name": "Counts", "summary": "s"}' if "counts" in p else "no" for p in prompts])
    known = spark.createDataFrame([("t1", "2020", "counts a"), ("t2", "2021", "counts b"), ("t3", "", "else"), ("t4", "", "old")], "table_id string, year string, title string")
    of = spark.createDataFrame([("t1", "f", 1.0), ("t2", "f", 1.0), ("t3", "g", 1.0), ("t4", "h", 1.0)], "table_id string, family string, confidence double")
    named = spark.createDataFrame([("h", "Old"), ("g", "")], "family string, name string")
    assert [r["family"] for r in tables.unnamed_families(known, of, named).collect()] == ["f", "g"]
    assert [tuple(r) for r in tables.name_families(known, of, named, "names").collect()] == [("f", "Counts", "s")]


def test_synthetic_questions(spark):
    services.register("chat", "asks", lambda prompts: ['{"question": "Q?", "answer": "A", "answer_points": []}' if "one" in p.split("\n")[-1] else "{}" for p in prompts])
    sources = spark.createDataFrame([(0, 1, ["one"], ["s", None]), (1, 2, ["x", "two"], ["t"])], "place int, hops int, texts array<string>, sources array<string>")
    rows = evaluation.synthetic_questions(sources, "asks").collect()
    assert [(r["id"], r["question"], r["relevant_doc_files"], r["expected_answer_points"], r["hops"]) for r in rows] == [("syn001", "Q?", ["s"], ["A"], 1)]


def test_sources_are_found_by_path_or_name(spark):
    known = spark.createDataFrame([("a/x.txt", "/r/a/x.txt"), ("b/x.txt", "/r/b/x.txt"), ("y.txt", "/r/y.txt")], "relative_path string, path string")
    wanted = spark.createDataFrame([("b/x.txt",), ("x.txt",), ("q/y.txt",), ("none",)], "name string")
    assert dict(files.resolve_sources(wanted, known).collect()) == {"b/x.txt": "/r/b/x.txt", "x.txt": "/r/a/x.txt", "q/y.txt": "/r/y.txt", "none": None}
