import pytest
from pyspark.sql import functions as F

from docgrain import services
from docgrain.operators import evaluation
from docgrain.plans import answer, planner

CHUNK = "chunk_id long, text string, doc_source string, content_type string, document_date string, has_metadata boolean, confidence double, has_cells boolean"


def _chunk(i, text, source="s"):
    return (i, text, source, "text", "", False, 1.0, False)


def test_prefetch_searches_sources_of_the_domain(spark):
    chunks = spark.createDataFrame([_chunk(1, "Pistols by maker and year.", "AFMER_2020.pdf"), _chunk(2, "Pistols manufactured in total.", "other.pdf"), _chunk(3, "Nothing alike.", "nfcta_export.pdf")], CHUNK)
    asked = planner.plan_questions(spark.createDataFrame([(1, "pistols manufactured by year"), (2, "pistols by year")], "query_id int, question string"))
    assert [(r["query_id"], r["chunk_id"]) for r in answer.prefetch_lane(chunks, asked, 5).collect()] == [(1, 1)]
    plain = {r["chunk_id"]: r["score"] for r in answer.retrieve(chunks, asked.withColumn("domain", F.lit("")), answer.Settings()).where("query_id = 1").collect()}
    raised = {r["chunk_id"]: r["score"] for r in answer.retrieve(chunks, asked, answer.Settings()).where("query_id = 1").collect()}
    assert raised[1] == pytest.approx(1.8 * plain[1]) and raised[2] == pytest.approx(plain[2])


def test_source_domains_of_null_and_clashing_names(spark):
    rows = spark.createDataFrame([(None,), ("",), ("Ghost_PMF.pdf",), ("x.pdf",)], "s string").select(planner.source_domains(F.col("s"), planner.BOOSTED_SOURCES).alias("d")).collect()
    assert [r["d"] for r in rows] == [[], [], ["pmf"], []]


def test_refined_plans(spark):
    replies = {"a": 'so: {"intent": "table", "use_graph": true, "top_k": 3}', "b": "no", "c": '{"intent": "poem", "top_k": -1}'}
    services.register("chat", "plans", lambda prompts: [replies[p[-1]] for p in prompts])
    planned = planner.plan_questions(spark.createDataFrame([("a",), ("b",), ("c",)], "question string"))
    got = {r["question"]: (r["intent"], r["use_graph"], r["top_k"]) for r in planner.refine(planned, "plans").collect()}
    assert got == {"a": ("table", True, 3), "b": ("fact", False, None), "c": ("fact", False, None)}


def test_comparisons_ask_for_each_target(spark):
    chunks = spark.createDataFrame([_chunk(1, "Texas had many fires.", "t"), _chunk(2, "Ohio had few storms.", "o"), _chunk(3, "Nothing.", "n")], CHUNK)
    asked = planner.plan_questions(spark.createDataFrame([(7, "Compare Texas and Ohio"), (8, "Texas fires")], "query_id int, question string"))
    got = answer.compare(chunks, asked).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(7, 1), (7, 2)} and len(got) == 2


def test_listwise_reranking(spark):
    services.register("chat", "lists", lambda prompts: ["best: [1, 0, 9]" if "\nQ: one" in p else "none" for p in prompts])
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(3)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "one"), (2, "two")], "query_id int, question string")
    rows = spark.createDataFrame([(q, i, 0.5 - i / 100) for q in (1, 2) for i in range(3)], "query_id int, chunk_id long, rerank_score double")
    got = {(r["query_id"], r["chunk_id"]): r["rerank_score"] for r in answer.listwise(chunks, asked, "lists")(rows).collect()}
    assert got == {(1, 0): 0.6, (1, 1): 0.64, (1, 2): 0.48, (2, 0): 0.5, (2, 1): 0.49, (2, 2): 0.48}


def test_answers_tell_their_stages_and_take_a_service(spark):
    services.register("chat", "shorter", lambda prompts: ['{"top_k": 1}' for _ in prompts])
    chunks = spark.createDataFrame([_chunk(i, f"The harbour of town {i} was rebuilt after the storm of that winter.", f"s{i}") for i in range(4)], CHUNK)
    seen = []
    rows = answer.answer(chunks, spark.createDataFrame([(1, "When was the harbour rebuilt?")], "query_id int, question string"), service="shorter", on_stage=lambda name, secs: seen.append(name)).collect()
    assert [len(r["citations"]) for r in rows] == [1] and seen[:3] == ["questions", "hits", "evidence"] and "answers" in seen


def test_faithfulness(spark):
    services.register("chat", "judge", lambda prompts: ['{"supported": false, "unsupported_claims": ["x"], "score": 0.5}' if "good" in p else "?" for p in prompts])
    rows = spark.createDataFrame([(1, "q", "good", "c"), (2, "q", "bad", None), (3, None, None, None)], "query_id int, question string, answer string, context string")
    got = {r["query_id"]: (r["supported"], r["unsupported_claims"], r["score"], r["skipped"]) for r in evaluation.judge_faithfulness(rows, "judge").collect()}
    assert got == {1: (False, ["x"], 0.5, False), 2: (None, [], None, True), 3: (None, [], None, True)}
    assert all(r["skipped"] for r in evaluation.judge_faithfulness(rows, None).collect())


def test_precision_and_recall_of_contexts(spark):
    services.register("chat", "yes", lambda prompts: ["Yes." if "harbour" in p.rsplit(":", 1)[1] else "no" if "storm" in p.rsplit(":", 1)[1] else "?" for p in prompts])
    passages = spark.createDataFrame([(1, "q", "the harbour", 1), (1, "q", "a storm", 2), (1, "q", "else", 3), (2, "q", None, 1)], "query_id int, question string, text string, rank int")
    assert dict(evaluation.context_precision(passages, "yes").collect()) == {1: 0.5, 2: None}
    truths = spark.createDataFrame([(1, "The harbour was rebuilt. The storm came first; ok."), (2, "")], "query_id int, truth string")
    assert dict(evaluation.context_recall(truths, passages, "yes").collect()) == {1: 0.5}
    points = spark.createDataFrame([(1, ["harbour", "no"])], "query_id int, points array<string>")
    assert dict(evaluation.context_recall(points, passages, "yes").collect()) == {1: 1.0}


def test_sources_of_synthetic_questions(spark):
    chunks = spark.createDataFrame([(i, "x" * 300 if i != 1 else "short", f"s{i}") for i in range(10)], "chunk_id long, text string, doc_source string")
    pairs = spark.createDataFrame([("e", "0", "2", 0, 2), ("f", "0", "1", 0, 1)], "entity string, first_document string, second_document string, first_chunk long, second_chunk long")
    got = {r["place"]: (r["hops"], r["sources"]) for r in evaluation.synthetic_sources(chunks, pairs, 3).collect()}
    assert got == {0: (2, ["s0", "s2"]), 1: (1, ["s8"]), 2: (1, ["s6"])}
    assert evaluation.synthetic_sources(chunks.limit(0)).count() == 0
