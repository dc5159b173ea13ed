import math

import pytest
from pyspark.sql import functions as F

from docgrain.operators import metrics, search
from docgrain.plans import answer, planner, search_queries

DOCS = [(1, "apple banana apple"), (2, "banana cherry"), (3, ""), (4, "durian"), (5, "apple banana apple")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "chunk_id long, text string")


def test_bm25_by_hand(spark, docs):
    asked = spark.createDataFrame([(7, "Apple apple cherry"), (8, "the of"), (9, None)], "query_id int, question string")
    got = search.bm25_topk(docs, asked, 10).orderBy("query_id", "rank").collect()
    avg, n = 9 / 5, 5
    idf = lambda d: math.log(1 + (n - d + 0.5) / (d + 0.5))
    part = lambda f, dl: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))
    apple, cherry = 2 * idf(2) * part(2, 3), idf(1) * part(1, 2)
    top = max(apple, cherry)
    want = sorted([(1, apple / top), (5, apple / top), (2, cherry / top)], key=lambda x: (-x[1], x[0]))
    assert [(r["chunk_id"], pytest.approx(r["score"])) for r in got] == want
    assert {r["query_id"] for r in got} == {7}


def test_results_do_not_depend_on_partitions(spark, docs):
    asked = spark.createDataFrame([(1, "apple banana"), (2, "cherry durian")], "query_id int, question string")
    a = search.bm25_topk(docs.repartition(7), asked, 3).orderBy("query_id", "rank").collect()
    assert a == search.bm25_topk(docs.coalesce(1), asked, 3).orderBy("query_id", "rank").collect()


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 1), (3, [0.0, 0.0], 0), (4, None, 1), (5, [2.0, 0.0], 1)], "chunk_id long, embedding array<float>, label int")
    asked = rows.where("chunk_id = 1").select(F.col("chunk_id").alias("query_id"), "embedding", "label")
    got = search.vector_topk(rows, asked, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(1, 1.0), (5, 1.0), (2, 0.0)]
    assert [r["chunk_id"] for r in search.vector_topk(rows, asked, 3, match="label").orderBy("rank").collect()] == [1, 3]
    assert search.vector_topk(rows, asked.limit(0), 3).count() == 0
    assert search.novelty(rows, asked).first()["novel"] is False


def test_fusion_keeps_the_best_score_and_the_earlier_lane(spark):
    rows = [(1, 10, 0.5, "vector", 0), (1, 10, 0.5, "bm25", 1), (1, 11, 0.2, "vector", 0), (1, 11, 0.7, "bm25", 1)]
    got = search.fuse(spark.createDataFrame(rows, "query_id int, chunk_id int, score double, source string, lane int")).orderBy("chunk_id").collect()
    assert [(r["score"], r["source"]) for r in got] == [(0.5, "vector"), (0.7, "bm25")]


@pytest.mark.parametrize(("sources", "cap"), [(3, 3), (15, 6)])
def test_cap(spark, sources, cap):
    hits = spark.createDataFrame([(1, 100 * s + i, f"s{s}", 1.0 / (i + 1)) for s in range(sources) for i in range(9)], "query_id int, chunk_id int, doc_source string, score double")
    got = search.cap_sources(hits).groupBy("doc_source").agg(F.count("*"), F.min("score")).collect()
    assert all(r[1] == cap and r[2] == pytest.approx(1 / cap) for r in got)


def test_year_and_small_source_factors(spark):
    rows = spark.createDataFrame([("r2023", ""), ("x", "2022"), ("x", "")], "s string, d string")
    years = F.array(F.lit("2023"))
    score = search.adjusted_score(F.lit(1.0), source=F.col("s"), lane=F.lit("bm25"), quality=F.lit(0.5), years=years, date=F.col("d"), source_chunks=F.lit(400))
    assert [round(r[0], 6) for r in rows.select(score).collect()] == [round(0.5 * y * 1.25, 6) for y in (1.30, 0.80, 0.85)]
    spared = search.adjusted_score(F.lit(1.0), source=F.col("s"), lane=F.lit("table_row"), quality=F.lit(0.5), years=F.array().cast("array<string>"), date=F.col("d"))
    assert rows.select(spared).first()[0] == 1.0


def test_evidence_floor_and_table_guarantee(spark):
    hits = spark.createDataFrame([(1, 1, 0.05), (1, 2, 0.09), (2, 3, 0.5), (2, 4, 0.05)], "query_id int, chunk_id int, eval_score double")
    assert {(r["query_id"], r["chunk_id"]) for r in search.keep_evidence(hits, 1).collect()} == {(1, 2), (2, 3)}
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10, True, i == 5) for i in range(6)], "query_id int, chunk_id int, rerank_score double, numeric boolean, is_table boolean")
    assert [r["chunk_id"] for r in search.final_order(rows, 3).orderBy("rank").collect()] == [5, 0, 1]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcde")] + [("n", "a", 1)], "query_id string, item string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "b")], "query_id string, item string")
    got = {r["query_id"]: r for r in metrics.ranking_metrics(ranked, relevant).collect()}
    assert got["q"]["recall"] == 0.5 and got["q"]["precision"] == 0.2 and got["q"]["mrr"] == 0.5
    assert got["q"]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["n"]["recall"] == got["n"]["ndcg"] == got["n"]["mrr"] == 0.0
    table = lambda **m: spark.createDataFrame(list(m.items()), "metric string, value double")
    ok = {r["metric"]: r["ok"] for r in metrics.gate(table(recall=0.90, mrr=0.80), table(recall=0.91, mrr=0.83)).collect()}
    assert ok == {"recall": True, "mrr": False}


def test_planning(spark):
    asked = ["How many rows are in the table of 2023?", "Who is the dealer?", "What are common themes across documents?", "Compare Texas and Ohio", "exports vs imports"]
    rows = planner.plan_questions(spark.createDataFrame([(q,) for q in asked], "question string"))
    got = {r["question"]: r for r in rows.collect()}
    assert got[asked[0]]["intent"] == "table" and got[asked[0]]["use_metadata"] and got[asked[0]]["mode"] == "local"
    assert got[asked[1]]["intent"] == "entity" and got[asked[1]]["use_graph"]
    assert got[asked[2]]["mode"] == "global" and got[asked[4]]["domain"] == "import"
    targets = rows.select("question", planner.is_comparison(F.col("question")).alias("c"), planner.comparison_targets(F.col("question")).alias("t")).collect()
    assert [(r["c"], r["t"]) for r in targets][3] == (True, ["Ohio", "Texas"])
    assert planner.select_corpora("what does the web corpus say", ["pdf", "web"], ["pdf", "web"]) == ["web"]
    assert planner.select_corpora("anything", ["pdf", "web"], ["pdf", "web"], explicit=["news"]) == ["news"]


def test_answers(spark):
    chunks = spark.createDataFrame(
        [(i, f"The harbour of town {i} was rebuilt after the storm of that winter.\nShort line.", f"s{i % 3}", "text", "", False, 1.0, False) for i in range(12)],
        "chunk_id long, text string, doc_source string, content_type string, document_date string, has_metadata boolean, confidence double, has_cells boolean",
    )
    asked = spark.createDataFrame([(1, "When was the harbour rebuilt?"), (2, "zebra")], "query_id int, question string")
    got = {r["query_id"]: r for r in answer.answer(chunks, asked).collect()}
    assert set(got) == {1} and "harbour" in got[1]["answer"] and len(got[1]["citations"]) == 9 and 0 < got[1]["confidence"] <= 1


def test_a_task_hands_on_k_rows_for_each_query(monkeypatch):
    """However many batches it has read; what it hands on is what sorting all of them gives."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(search, "VECTOR_SLICE", 32)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (5000, 3)).astype(float)
    ids, labels = rng.permutation(5000), [None if i % 7 == 0 else "ab"[i % 2] for i in range(5000)]
    frame = pd.DataFrame({"id": ids, "v": list(vectors), "m": labels})
    group = [{"q": int(ids[i]), "v": vectors[i], "m": labels[i]} for i in range(5)]
    for match in (False, True):
        parts = list(search._batch_best(group, 4, match, True)(frame.iloc[i : i + 500] for i in range(0, 5000, 500)))
        got = pd.concat(parts)
        unit = search._unit(list(vectors), 3)
        wanted = set()
        for i, g in enumerate(group):
            score = np.round(unit @ unit[i], search.PLACES)
            may = [j for j in range(5000) if j != i and (not match or (labels[j] is not None and labels[j] == g["m"]))]
            wanted |= {(g["q"], int(ids[j])) for j in sorted(may, key=lambda j: (-score[j], ids[j]))[:4]}
        assert len(got) == len(wanted) and set(zip(got["q"], got["id"])) == wanted


def test_hybrid_fusion_asks_every_item(spark, tmp_path):
    """Not only those whose ids are divisible by 100."""
    texts = [(1, "red apples grow on old trees"), (2, "green pears grow on young trees"), (3, "nothing of the kind")]
    spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(100, "red apples"), (101, "green pears"), (7, "old trees"), (8, None), (9, "zzz unknown")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r["query_id"], r["chunk_id"], r["score"]) for r in search_queries.hybrid_fusion(spark, str(tmp_path)).collect()]
    best = {q: max((s, -c) for i, c, s in got if i == q) for q, _, _ in got}
    assert {7, 100, 101} <= best.keys() and 8 not in best
    assert {q: -c for q, (_, c) in best.items() if q != 9} == {100: 1, 101: 2, 7: 1}
