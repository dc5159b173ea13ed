"""The kept BM25 index against the search that reads the corpus."""

import re

import pytest

from docgrain.operators import search, text_index
from docgrain.session import new_path


def found(best):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in best.collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, "nothing like it"), (4, None), (5, "the of")], "query_id int, question string")


def corpus(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)


BEFORE = [("a", "alpha beta"), ("b", "beta beta gamma"), ("c", None), ("d", "delta " * 50), ("e", "alpha"), ("f", "gamma alpha beta")]
AFTER = [("a", "alpha beta"), ("b", "gamma"), ("c", "beta alpha alpha"), ("d", None), ("f", "gamma alpha beta"), ("g", "beta")]


def test_updates_equal_a_new_search(spark, asked):
    root = new_path(spark, "index")
    for number, rows in enumerate([BEFORE, AFTER, BEFORE, [], AFTER], 1):
        assert text_index.is_stale(spark, root, str(number))
        state = text_index.update(corpus(spark, rows), root, str(number), buckets=4)
        assert state.number == number and not text_index.is_stale(spark, root, str(number))
        assert found(text_index.topk(spark, root, asked)) == found(search.bm25_topk(corpus(spark, rows), asked))
    whole = text_index.compact(spark, root)
    assert len(whole.segments) == 1 and found(text_index.topk(spark, root, asked)) == found(search.bm25_topk(corpus(spark, AFTER), asked))


def test_only_what_has_changed_is_written(spark):
    root = new_path(spark, "index")
    text_index.update(corpus(spark, BEFORE), root, "1")
    text_index.update(corpus(spark, AFTER), root, "2")
    docs = spark.read.parquet(f"{root}/segments/2/docs").collect()
    assert sorted((r["id"], r["print"] is None) for r in docs) == [("b", False), ("c", False), ("d", False), ("e", True), ("g", False)]
    assert {r["id"] for r in spark.read.parquet(f"{root}/segments/2/postings").select("id").collect()} == {"b", "c", "g"}


def test_searches_read_the_buckets_of_their_terms(spark, asked):
    root = new_path(spark, "index")
    text_index.update(corpus(spark, BEFORE), root, "1")
    plan = text_index.topk(spark, root, asked.where("query_id = 2"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (= \d+|IN \()", plan) and "PushedFilters: [" in plan and "EqualTo(term,gamma)" in plan.replace(" ", "")


def test_many_terms_are_joined(spark, asked, monkeypatch):
    monkeypatch.setattr(search, "LITERAL_TERMS", 1)
    root = new_path(spark, "index")
    text_index.update(corpus(spark, BEFORE), root, "1")
    assert found(text_index.topk(spark, root, asked)) == found(search.bm25_topk(corpus(spark, BEFORE), asked))


def test_a_writer_of_an_older_list_is_refused(spark, monkeypatch):
    root = new_path(spark, "index")
    older = text_index.update(corpus(spark, BEFORE), root, "1")
    text_index.update(corpus(spark, AFTER), root, "2")
    monkeypatch.setattr(text_index, "state", lambda spark, root: older)
    with pytest.raises(RuntimeError, match="read it again"):
        text_index.update(corpus(spark, BEFORE), root, "3")


def test_an_interrupted_update_is_done_again(spark, asked, monkeypatch):
    root = new_path(spark, "index")
    text_index.update(corpus(spark, BEFORE), root, "1")
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(text_index, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        text_index.update(corpus(spark, AFTER), root, "2")
    assert found(text_index.topk(spark, root, asked)) == found(search.bm25_topk(corpus(spark, BEFORE), asked))
    text_index.update(corpus(spark, AFTER), root, "2")
    assert found(text_index.topk(spark, root, asked)) == found(search.bm25_topk(corpus(spark, AFTER), asked))


def test_rows_without_an_id_and_with_the_same(spark, asked):
    root = new_path(spark, "index")
    rows = [(None, "alpha"), ("a", "alpha"), ("a", "alpha"), ("b", "beta")]
    state = text_index.update(corpus(spark, rows), root, "1")
    assert (state.n_docs, state.total_dl) == (2, 2)
    with pytest.raises(FileNotFoundError):
        text_index.topk(spark, new_path(spark, "index"), asked)


def test_segments_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(text_index, "SEGMENTS", 2)
    root = new_path(spark, "index")
    for k in range(3):
        state = text_index.refresh(corpus(spark, [("a", f"alpha{k}")]), root, str(k))
    assert len(state.segments) == 1 and text_index.refresh(corpus(spark, []), root, "2") == state


def test_versions_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = text_index.corpus_version(spark.read.parquet(path))
    assert text_index.corpus_version(spark.read.parquet(path)) == first
    spark.range(1).write.mode("append").parquet(path)
    assert text_index.corpus_version(spark.read.parquet(path)) != first


def test_terms_are_counted_in_the_row_and_tasks_are_sized_by_postings(spark, tmp_path):
    """Words are those of the column function; repeated ids count once; the postings of a task do not grow with the corpus."""
    from pyspark.sql import functions as F

    from docgrain.functions import text as T
    from docgrain.functions import vectors

    texts = ["", None, "The CAT_2 cat; a I x9 Été İstanbul naïve", "of the and", "b" * 5000 + " b1 b1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    by_column = {r["chunk_id"]: r["w"] or [] for r in rows.select("chunk_id", T.content_tokens(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    assert by_column == {i: vectors.content_words(t) for i, t in enumerate(texts)}
    now = text_index.update(rows.unionByName(rows).unionByName(rows.limit(3)), str(tmp_path / "twice"), "v")
    assert now.n_docs == len(texts) and now.total_dl == sum(map(len, by_column.values()))
    for n in (10**6, 10**8, 10**10):
        tasks, spread = text_index._parts(n, 16, 32)
        assert n / tasks <= text_index.POSTINGS and 32 * spread >= 4 * tasks


def test_postings_of_a_term_leave_a_task_together():
    """What is shuffled and sorted is an array for each term of many texts, not a row for each posting."""
    import pyarrow as pa

    texts = ["alpha beta alpha", "beta Gamma", None, "beta"]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array([1, 2, 3, 4]), pa.array(texts, pa.string())], ["id", "print", "text"])
    rows = pa.Table.from_batches(list(text_index._counted(iter([batch])))).to_pylist()
    held = {r["term"]: [tuple(p.values()) for p in r["held"]] for r in rows if r["term"] is not None}
    assert held == {"alpha": [(5, 3, 2)], "beta": [(5, 3, 1), (6, 2, 1), (8, 1, 1)], "gamma": [(6, 2, 1)]}
    assert [[tuple(d.values()) for d in r["docs"]] for r in rows if r["term"] is None] == [[(5, 1, 3), (6, 2, 2), (7, 3, 0), (8, 4, 1)]]


def test_scores_by_document_are_those_of_joined_rows(spark, tmp_path, monkeypatch):
    """Whole documents are scored in tasks, whatever the batches; ties, copies and ids that are strings included."""
    words = [f"w{i:02d}" for i in range(40)]
    texts = [(f"d{i:03d}", " ".join(words[(i // 2 * j) % 40] for j in range(1, 3 + i // 2 % 17))) for i in range(120)]
    asked = spark.createDataFrame([(q, " ".join(words[(q * j) % 40] for j in range(1, 9))) for q in range(1, 13)] + [(90, "unknown"), (91, None)], "query_id int, question string")
    root = str(tmp_path / "index")
    text_index.update(spark.createDataFrame(texts, "chunk_id string, text string"), root, "1")
    find = lambda: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in text_index.topk(spark, root, asked, 7).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = find()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(text_index.search, "LITERAL_TERMS", 0)
    monkeypatch.setattr(text_index, "_scored", None)
    assert got == find() and len({q for q, *_ in got}) == 12
