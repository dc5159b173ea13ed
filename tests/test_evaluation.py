import json

import pytest
from pyspark.sql import functions as F

from docgrain.operators import audit, evaluation
from docgrain.plans import answer


def test_scores(spark):
    rows = [("The total was 1,234 in Texas, as the table says.", ["texas"], False), ("The report does not contain that.", [], True), ("Nothing of the kind was found here, sadly.", ["ohio"], False), ("It was 5.", [], True)]
    frame = spark.createDataFrame(rows, "answer string, points array<string>, expect_refusal boolean")
    got = evaluation.score_answers(frame).first()
    assert (got["n"], got["hit_rate"], got["refusal_accuracy"], got["correct"]) == (4, 0.5, 0.5, 0.5)
    assert [r[0] for r in frame.select(evaluation.is_insufficient(F.col("answer"))).collect()] == [False, True, False, True]
    assert evaluation.score_answers(frame.limit(0)).first()["hit_rate"] is None


def test_pairs(spark):
    rows = [("e", "d2", 5), ("e", "d1", 9), ("e", "d1", 7), ("e", "d3", 1), ("f", "d1", 2), ("f", "d1", 3)]
    got = evaluation.entity_pairs(spark.createDataFrame(rows, "entity string, document_id string, chunk_id int")).collect()
    assert [tuple(r) for r in got] == [("e", "d1", "d2", 7, 5)]


def test_detail(spark):
    rows = [("d", "text", "text", ["A", "B"], "x"), ("d", "table", "vision", ["B"], ""), ("e", "text", None, [], None)]
    got = {r["document_id"]: r for r in audit.document_detail(spark.createDataFrame(rows, "document_id string, content_type string, extraction_method string, entities array<string>, title string"), ["title"]).collect()}
    assert got["d"]["content_types"] == {"table": 1, "text": 1} and got["d"]["n_entities"] == 2 and got["d"]["title"] == 0.5
    assert got["e"]["methods"] == {"": 1} and got["e"]["n_entities"] == 0
    nodes = spark.createDataFrame([("k", "1"), ("k", "2"), ("m", "9")], "key string, chunk_id string")
    chunks = spark.createDataFrame([("1", "d"), ("2", "d")], "chunk_id string, document_id string")
    assert audit.touching(nodes, chunks).collect() == [("d", "k")]


def test_hops(spark):
    reply = json.dumps({"hops": ["Which town has the harbour?", "When was {hop1} rebuilt?"]})
    assert answer.decompose("x", lambda p: [f"Sure {reply}"]) == ["Which town has the harbour?", "When was {hop1} rebuilt?"]
    assert answer.decompose("x", lambda p: ["{}"]) == answer.decompose("x", lambda p: ["{broken"]) == []
    chunks = spark.createDataFrame([(1, "The harbour lies in Oldtown, on the western coast.", "s", "text", "", False, 1.0, False), (2, "Oldtown was rebuilt in the year after the storm, people say.", "t", "text", "", False, 1.0, False)], "chunk_id long, text string, doc_source string, content_type string, document_date string, has_metadata boolean, confidence double, has_cells boolean")
    done = answer.answer_in_hops(chunks, ["Where is the harbour?", "When was {hop1} rebuilt?"])
    assert "Oldtown" in done[0][1] and "Oldtown" in done[1][0] and "{hop" not in done[1][0]


@pytest.mark.parametrize(("kind", "share"), [("text", 0.4), ("table", 1.0)])
def test_numbers_without_structure_lower_the_confidence(spark, kind, share):
    chunks = spark.createDataFrame([(1, "The harbour was rebuilt with a total of 40 ships.", "s", kind, "", False, 1.0, False)], "chunk_id long, text string, doc_source string, content_type string, document_date string, has_metadata boolean, confidence double, has_cells boolean")
    ranked = spark.createDataFrame([(1, 1, 1, 0.5, True)], "query_id int, chunk_id long, rank int, eval_score double, numeric boolean")
    assert answer.compose(ranked, chunks).first()["confidence"] == pytest.approx(0.5 * share)
