"""Answers without a language model: retrieval over all lanes, evaluation, reranking, an extractive reply with citations.

Questions come as a table and are answered together; every step is a DataFrame. Services (chat, embeddings, vision,
search) are functions that a caller may pass; the defaults are the offline behaviour.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrain import services
from docgrain.functions import text as T
from docgrain.operators import search, tables
from docgrain.operators.evaluation import is_insufficient
from docgrain.plans import planner
from docgrain.session import materialise


# Words of questions that ask for a number.
NUMERIC = r"(?i)\b(how many|how much|number of|total|count|rate|percent|percentage|average|figure|amount|share|proportion|sum|exactly)\b"
HOP = re.compile(r"\{hop(\d)\}")


@dataclass(frozen=True)
class Settings:
    """Parameters that change results."""

    top_k: int = 15
    min_evidence: float = 0.10
    visual_boost: float = 1.05
    retries: int = 1
    #: Whether chunks are also searched by their embeddings.
    dense: bool = True


def lexical_similarity(hits: DataFrame, chunks: DataFrame, questions: DataFrame, dim: int = 384) -> DataFrame:
    """``hits`` (query_id, chunk_id) with similarity: cosine of the hashed embeddings of question and chunk."""
    from docgrain.functions.vectors import hash_embedding

    mine = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    c = hash_embedding(mine, "chunk_id", "text", dim)
    q = hash_embedding(questions, "query_id", "question", dim).withColumnRenamed("weight", "qw")
    both = hits.select("query_id", "chunk_id").join(q, "query_id").join(c, ["chunk_id", "slot"])
    sums = both.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("similarity"))
    return hits.join(sums, ["query_id", "chunk_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def dense_lane(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The best ``k`` chunks of each question by the cosine of their embeddings, as a lane; a column ``embedding`` of the chunks is used where there is one."""
    from docgrain.functions.vectors import embedding

    rows = chunks.select("chunk_id", F.col("embedding") if "embedding" in chunks.columns else embedding(F.col("text")).alias("embedding"))
    asked = questions.select("query_id", embedding(F.col("question")).alias("embedding"))
    best = search.vector_topk(rows, asked, k).where("score > 0")
    return best.select("query_id", "chunk_id", "score", F.lit("vector").alias("source"), F.lit(0).alias("lane"))


def prefetch_lane(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The best ``k`` chunks, by their embeddings, of the sources that belong to a question's domain, as a lane; none for other domains."""
    from docgrain.functions.vectors import embedding

    asked = questions.where(F.col("domain").isin(*planner.PREFETCH_SOURCES)).select("query_id", "domain", embedding(F.col("question")).alias("embedding"))
    of = F.explode(planner.source_domains(F.col("doc_source"), planner.PREFETCH_SOURCES)).alias("domain")
    vector = F.col("embedding") if "embedding" in chunks.columns else F.col("text")
    rows = chunks.select("chunk_id", of, vector.alias("embedding"))
    rows = rows if "embedding" in chunks.columns else rows.withColumn("embedding", embedding(F.col("embedding")))
    best = search.vector_topk(rows, asked, k, match="domain").where("score > 0")
    return best.select("query_id", "chunk_id", "score", F.lit("vector").alias("source"), F.lit(0).alias("lane"))


def retrieve(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), lanes: DataFrame | None = None) -> DataFrame:
    """Hits (query_id, chunk_id, score, source, doc_source) of planned questions: embeddings, BM25 and further ``lanes``, adjusted, pooled and capped by source.

    Sources of a question's domain are searched besides and gain. Hits of the lane ``table_row`` that the cut left out come back. chunks: chunk_id, text, doc_source, content_type,
    document_date.
    """
    bm = search.bm25_topk(chunks, questions, 2 * settings.top_k)
    bm = bm.select("query_id", "chunk_id", (search.BM25_SHARE * F.col("score")).alias("score"), F.lit("bm25").alias("source"), F.lit(1).alias("lane"))
    more = [lanes.select(*bm.columns)] if lanes is not None else []
    if settings.dense:
        more += [dense_lane(chunks, questions, 3 * settings.top_k), prefetch_lane(chunks, questions, 2 * settings.top_k)]
    fused = search.fuse(reduce(DataFrame.unionByName, more, bm))
    counts = chunks.groupBy("doc_source").agg(F.count("*").alias("source_chunks"))
    rows = fused.join(chunks.select("chunk_id", "text", "doc_source", "content_type", "document_date"), "chunk_id").join(questions.select("query_id", "question", "intent", "domain"), "query_id").join(counts, "doc_source", "left")
    boost = F.when(F.col("content_type").isin(*search.STRUCTURED) & F.col("intent").isin("table", "visual") & F.col("source").isin("bm25", "vector"), settings.visual_boost).otherwise(1.0)
    score = search.adjusted_score(F.col("score") * boost, source=F.col("doc_source"), lane=F.col("source"), quality=T.chunk_quality(F.col("text")), years=search.question_years(F.col("question")), date=F.col("document_date"), source_chunks=F.coalesce("source_chunks", F.lit(9999)), domain_hit=F.array_contains(planner.source_domains(F.col("doc_source"), planner.BOOSTED_SOURCES), F.col("domain")))
    rows = rows.withColumn("score", score).select("query_id", "chunk_id", "score", "source", "doc_source")
    best = search.cap_sources(search.pool(rows, max(5 * settings.top_k, 60)).drop("rank"))
    if lanes is None:
        return best
    return best.unionByName(rows.where("source = 'table_row'").join(best.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))


# Rows of tables that a question gets at most, and what a computed result is worth.
ROW_HITS, SQL_SCORE, SQL_EVIDENCE, SQL_ROWS = 4, 0.97, 0.95, 20
#: Columns of the chunks that answers are made of.
FIELDS = ("chunk_id", "text", "doc_source", "content_type", "document_date", "has_metadata", "confidence", "has_cells")


@dataclass(frozen=True)
class Store:
    """Structured tables beside the chunks: what ``tables.build_store`` gives; a table's id is its chunk's as text."""

    tables: DataFrame
    rows: DataFrame


@dataclass(frozen=True)
class Graph:
    """The entity graph beside the chunks: nodes, their chunks (key, chunk_id as text) and edges."""

    nodes: DataFrame
    of_nodes: DataFrame
    edges: DataFrame


def _as_chunks(rows: DataFrame) -> DataFrame:
    """Found rows (chunk_id, text, doc_source, document_date) as chunks of tables."""
    return rows.select("chunk_id", "text", "doc_source", F.lit("table").alias("content_type"), "document_date", F.lit(False).alias("has_metadata"), F.lit(1.0).alias("confidence"), F.lit(True).alias("has_cells"))


def row_lane(store: Store, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lane, chunks): rows of tables that questions name, at most ROW_HITS a question, and the chunks that they are.

    A row's chunk is named by its table and its text, and written as ``[TABLE ROW]``, its source and its cells.
    """

    @F.pandas_udf("array<array<string>>")
    def keys(asked: pd.Series) -> pd.Series:
        return asked.map(lambda q: tables.row_keys(q) if q else [])

    wanted = questions.select("query_id", F.explode(keys(F.col("question"))).alias("key"), F.regexp_extract(F.coalesce("question", F.lit("")), T.YEAR, 0).alias("year"))
    found = tables.find_rows(store.tables, store.rows, materialise(wanted, "keys"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "table_id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ROW_HITS)
    found = found.join(store.tables.select("table_id", F.col("source").alias("doc_source"), F.col("year").alias("document_date")), "table_id")
    name = F.concat(F.lit("row:"), "table_id", F.lit(":"), F.lower(F.hex(F.xxhash64("row_text"))))
    found = materialise(found.select("query_id", name.alias("chunk_id"), F.concat(F.lit("[TABLE ROW] "), "doc_source", F.lit("\n"), "row_text").alias("text"), "doc_source", "document_date", "score"), "rows")
    lane = found.select("query_id", "chunk_id", "score", F.lit("table_row").alias("source"), F.lit(3).alias("lane"))
    return lane, _as_chunks(found.dropDuplicates(["chunk_id"]))


def sql_evidence(store: Store, statements: list[tuple]) -> tuple[DataFrame, DataFrame] | None:
    """(hits, chunks) of SELECT statements over candidate tables, each (query_id, sql, table ids); None where none has a result.

    Statements come from a service or a user, a handful at a time; those that are not allowed or fail give nothing.
    The result is computed over all rows of its tables; its first SQL_ROWS rows are the text of a chunk.
    """
    spark, made = store.tables.sparkSession, []
    for query, sql, ids in statements:
        result = tables.run_select(spark, sql, store.tables, store.rows, ids)
        if result is None or not (rows := [tuple(r) for r in result.collect()]):
            continue
        of = store.tables.where(F.col("table_id").isin(list(ids))).select("table_id", "source", "page").collect()
        of = sorted(of, key=lambda r: list(ids).index(r["table_id"]))
        where = "; ".join(f"{r['source']} p.{r['page']}" for r in of[:3])
        lines = [" | ".join(result.columns), *(" | ".join("" if c is None else str(c) for c in r) for r in rows[:SQL_ROWS])]
        text = f"[SQL RESULT] computed from {where}\nquery: {sql}\n" + "\n".join(lines)
        made.append((query, f"sql:{hashlib.md5(f'{sql}|{ids}'.encode()).hexdigest()[:10]}", text, of[0]["source"] if of else "table_store"))
    if not made:
        return None
    frame = spark.createDataFrame(made, "query_id long, chunk_id string, text string, doc_source string").withColumn("document_date", F.lit(""))
    hits = frame.select("query_id", "chunk_id", F.lit(SQL_SCORE).alias("score"), F.lit("sql").alias("source"), "doc_source", F.lit(0.0).alias("similarity"), F.lit(SQL_EVIDENCE).alias("eval_score"))
    return hits, _as_chunks(frame.dropDuplicates(["chunk_id"]))


def expanded(ranked: DataFrame, places: DataFrame) -> DataFrame:
    """``ranked`` hits and, after them, the other tables on the pages of those that are tables; ``places`` says where chunks are."""
    kin = tables.expand_tables(ranked.select("query_id", "chunk_id", "eval_score"), places)
    last = ranked.groupBy("query_id").agg(F.max("rank").alias("last"), F.max("numeric").alias("numeric"))
    order = Window.partitionBy("query_id").orderBy("corpus", "document_id", "page", "chunk_id")
    kin = kin.join(places, "chunk_id").join(last, "query_id").withColumn("rank", F.col("last") + F.row_number().over(order))
    known = {"score": F.col("eval_score"), "source": F.lit("table_page"), "similarity": F.lit(0.0), "rerank_score": F.lit(0.0), "is_table": F.lit(True), "doc_source": F.col("document_id")}
    return ranked.unionByName(kin.select(*[known.get(c, F.col(c)).cast(ranked.schema[c].dataType).alias(c) for c in ranked.columns]))


def compare(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Hits for what comparing questions compare: each target is asked for by itself, in front of the question.

    A chunk that several targets find stands once for a question, with its best score. Other questions give none.
    """
    asked = questions.where(planner.is_comparison(F.col("question")))
    parts = asked.select("*", F.posexplode(planner.comparison_targets(F.col("question"))).alias("__at", "__target")).withColumn("__id", F.concat_ws(":", F.col("query_id").cast("string"), "__at"))
    parts = materialise(parts.withColumn("question", F.concat_ws(" ", "__target", "question")), "targets")
    ids = parts.select(F.col("__id").alias("__sub"), F.col("query_id").alias("__query"))
    found = retrieve(chunks, parts.withColumn("query_id", F.col("__id")).drop("__id", "__at", "__target"), settings)
    found = found.withColumnRenamed("query_id", "__sub").join(ids, "__sub")
    best = found.groupBy(F.col("__query").alias("query_id"), "chunk_id").agg(F.max("score").alias("score"), F.max_by("source", F.struct("score", "source")).alias("source"), F.min("doc_source").alias("doc_source"))
    return best.select("query_id", "chunk_id", "score", "source", "doc_source")


def _with_chunks(hits: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both kept, of the chunks those of hits: their size is known then, so that few hits are broadcast and no other text is shuffled."""
    hits = materialise(hits, "hits")
    return hits, materialise(chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi"), "hit_chunks")


def evaluate(hits: DataFrame, chunks: DataFrame, questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Hits with eval_score, those without evidence left out."""
    hits, chunks = _with_chunks(hits, chunks)
    rows = lexical_similarity(hits, chunks, questions).join(chunks.select("chunk_id", "text", "content_type", "has_metadata", "confidence"), "chunk_id").join(questions.select("query_id", "question", "intent"), "query_id")
    bonus = F.col("intent").isin("table", "visual") & F.col("content_type").isin(*search.STRUCTURED)
    score = search.evaluation_score(similarity=F.col("similarity"), question_tokens=T.content_tokens(F.col("question")), text_tokens=T.content_tokens(F.col("text")), text=F.col("text"), has_metadata=F.col("has_metadata"), structured_bonus=bonus, lane=F.col("source"), confidence=F.col("confidence"))
    rows = rows.withColumn("eval_score", score).select(*hits.columns, "similarity", "eval_score")
    return search.keep_evidence(rows, settings.top_k, least=settings.min_evidence)


def rerank(hits: DataFrame, chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Best hits in their final order; a ``reranker`` may replace rerank_score.

    A column ``top_k`` of the questions, where it is not null, stands for that of the settings.
    """
    hits, chunks = _with_chunks(hits, chunks)
    rows = hits.join(chunks.select("chunk_id", "text", "content_type", "has_cells"), "chunk_id").join(questions.select("query_id", "question", "intent"), "query_id")
    numeric = (F.col("intent") == "table") | F.col("question").rlike(NUMERIC)
    score = search.rerank_score(evidence=F.col("eval_score"), question_tokens=T.content_tokens(F.col("question")), text_tokens=T.content_tokens(F.col("text")), content_type=F.col("content_type"), has_cells=F.col("has_cells"), wants_structure=numeric | (F.col("intent") == "visual"))
    rows = rows.withColumns({"rerank_score": score, "numeric": numeric, "is_table": (F.col("content_type") == "table") & F.col("has_cells")})
    rows = rows.select(*hits.columns, "rerank_score", "numeric", "is_table")
    rows = reranker(rows) if reranker else rows
    if "top_k" not in questions.columns:
        return search.final_order(rows, settings.top_k)
    rows = rows.join(questions.select("query_id", F.coalesce("top_k", F.lit(settings.top_k)).alias("__k")), "query_id")
    return search.final_order(rows, F.col("__k")).drop("__k")


# How many passages a chat service orders, how much of each it reads, and what a place is worth.
LISTED, LISTED_CHARS, PLACE_WORTH = 10, 200, 0.05


def listwise(chunks: DataFrame, questions: DataFrame, service: str) -> Callable[[DataFrame], DataFrame]:
    """A reranker by a chat service that orders the best ten passages of a question: of n places named the first gains 0.05 n, the last 0.05.

    A passage that is named twice gains twice; a reply without a list of numbers, and numbers of no passage, change nothing.
    """
    head = "Rank passages by relevance to the question. Reply with a list of their numbers only, best first, like [3,0,1].\nQ: "

    def apply(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
        first = rows.select("query_id", "chunk_id", (F.row_number().over(order) - 1).alias("place")).where(F.col("place") < LISTED)
        first = materialise(first.join(chunks.select("chunk_id", F.substring("text", 1, LISTED_CHARS).alias("head")), "chunk_id"), "listed")
        line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("head", F.lit("")))
        lists = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))  # LISTED lines
        prompt = F.concat(F.lit(head), F.coalesce("question", F.lit("")), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
        replies = lists.join(questions.select("query_id", "question"), "query_id").select("query_id", services.apply("chat", prompt, service).alias("reply"))
        places = F.from_json(F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)\[.*\]", 0), "array<int>")
        named = replies.select("query_id", places.alias("places")).select("query_id", F.size("places").alias("n"), F.posexplode("places").alias("at", "place"))
        gains = named.groupBy("query_id", "place").agg(F.sum((F.col("n") - F.col("at")) * PLACE_WORTH).alias("gain"))
        gains = first.join(gains, ["query_id", "place"]).select("query_id", "chunk_id", "gain")
        return rows.join(gains, ["query_id", "chunk_id"], "left").withColumn("rerank_score", F.round(F.col("rerank_score") + F.coalesce("gain", F.lit(0.0)), 4)).select(*rows.columns)

    return apply


def compose(ranked: DataFrame, chunks: DataFrame, most_lines: int = 4) -> DataFrame:
    """(query_id, answer, confidence, citations): the first lines of over 40 characters, the mean evidence of the first five hits, what is cited.

    A question that asks for a number and got no structured evidence has 0.4 of that confidence.
    """
    rows = ranked.join(chunks.select("chunk_id", "text", "content_type", F.col("doc_source").alias("__source")), "chunk_id")
    lines = F.filter(F.split("text", r"\n"), lambda x: F.length(T.strip(x)) > 40)
    by = Window.partitionBy("query_id")
    gap = F.max("numeric").over(by) & ~F.max(F.col("content_type").isin(*search.STRUCTURED)).over(by)
    mean = F.avg(F.when(F.col("rank") <= 5, F.col("eval_score"))).over(by)
    rows = rows.withColumn("top5", mean * F.when(gap, 0.4).otherwise(1.0))
    out = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", lines.alias("lines")))).alias("parts"),
        F.round(F.first("top5"), 3).alias("confidence"),
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("ref"), F.col("__source").alias("source"), "chunk_id"))).alias("citations"),
    )
    said = F.array_join(F.slice(F.flatten(F.transform("parts", lambda p: p["lines"])), 1, most_lines), "\n")
    return out.select("query_id", said.alias("answer"), "confidence", "citations")


# How an answer is marked whose numbers the sources do not have, the confidence it has at most, and how many are named.
CAVEAT = "\n\n\u26a0 Verification note: the following figure(s) could not be matched to the cited sources: {} \u2014 treat with caution."
CAVEAT_CONFIDENCE, CAVEAT_NUMBERS = 0.4, 6


def grounded(answers: DataFrame, contexts: DataFrame, regenerate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``answers`` (query_id, answer, confidence, ...) whose numbers are those of their ``contexts`` (query_id, context).

    Answers with other numbers are made once more by ``regenerate``, which gets (query_id, unsupported) and returns
    (query_id, answer), and the one with fewer such numbers stays; what is left is named in a caveat, and confidence is
    cut. An answer without a context has no supported number.
    """
    rows = answers.join(contexts.select("query_id", F.col("context").alias("__context")), "query_id", "left")
    rows = rows.withColumn("__bad", T.unsupported_numbers(F.col("answer"), F.col("__context")))
    if regenerate:
        again = regenerate(rows.where(F.size("__bad") > 0).select("query_id", F.col("__bad").alias("unsupported")))
        rows = rows.join(again.select("query_id", F.col("answer").alias("__again")), "query_id", "left")
        other = T.unsupported_numbers(F.col("__again"), F.col("__context"))
        better = F.col("__again").isNotNull() & (F.size(other) < F.size("__bad"))
        rows = rows.withColumns({"answer": F.when(better, F.col("__again")).otherwise(F.col("answer")), "__bad": F.when(better, other).otherwise(F.col("__bad"))}).drop("__again")
    flagged = F.size("__bad") > 0
    head, tail = CAVEAT.split("{}")
    note = F.concat(F.col("answer"), F.lit(head), F.array_join(F.slice("__bad", 1, CAVEAT_NUMBERS), ", "), F.lit(tail))
    low = F.round(F.least("confidence", F.lit(CAVEAT_CONFIDENCE)), 3)
    rows = rows.withColumns({"answer": F.when(flagged, note).otherwise(F.col("answer")), "confidence": F.when(flagged, low).otherwise(F.col("confidence"))})
    return rows.select(*answers.columns)


def _again(chunks: DataFrame, planned: DataFrame, hits: DataFrame, which: DataFrame, settings: Settings) -> DataFrame:
    """``hits`` with what the content words of some questions find that they have not found yet."""
    again = materialise(which.withColumn("question", planner.reformulate(F.col("question"))), "again")
    if again.isEmpty():
        return hits
    more = retrieve(chunks, again, settings).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return hits.unionByName(materialise(evaluate(materialise(more, "hits"), chunks, planned, settings), "evidence"))


def with_lanes(chunks: DataFrame, planned: DataFrame, store: Store | None = None, graph: Graph | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks, lanes): the chunks, ids as text, with the table rows that questions name, and the lanes of store and graph.

    Questions about relationships or patterns walk the graph by PageRank, others by steps.
    """
    from docgrain.plans import lanes as graph_lanes

    chunks, found = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")), []
    if store:
        lane, rows = row_lane(store, planned)
        found.append(lane)
        chunks = chunks.unionByName(rows, allowMissingColumns=True)
    if graph:
        ranked = F.col("intent").isin("relationship", "pattern")
        found.append(graph_lanes.pagerank_lane(graph.nodes, graph.of_nodes, graph.edges, planned.where(ranked)))
        found.append(graph_lanes.graph_lane(graph.nodes, graph.of_nodes, graph.edges, planned.where(~F.coalesce(ranked, F.lit(False)))))
    columns = ("query_id", "chunk_id", "score", "source", "lane")
    return chunks, materialise(reduce(DataFrame.unionByName, [x.select(*columns) for x in found]), "lanes") if found else None


def answer(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), lanes: DataFrame | None = None, regenerate: Callable[[DataFrame], DataFrame] | None = None, service: str | None = None, on_stage: Callable[[str, float], None] | None = None, store: Store | None = None, graph: Graph | None = None, statements: list[tuple] | None = None) -> DataFrame:
    """Answers to all questions (query_id, question).

    With a ``store`` the rows of tables that a question names are hits too, results of ``statements`` over it come
    first, and where the chunks say their corpus, document_id and page the other tables of a hit's page follow; with a
    ``graph`` its lanes are searched. Ids of chunks are text then.

    Questions that compare are asked for each target besides. A weak first retrieval is repeated with the question's
    content words, and so is one whose answer says nothing; of the two answers the one that says something stays.
    Numbers are checked against the cited chunks. A chat ``service`` refines the plan and orders the best passages.
    ``on_stage`` is told each stage's name and seconds when its result is written.
    """

    def stage(name: str, rows: DataFrame) -> DataFrame:
        start = time.perf_counter()
        out = materialise(rows, name)
        if on_stage:
            on_stage(name, time.perf_counter() - start)
        return out

    planned = planner.plan_questions(questions)
    planned = stage("questions", planner.refine(planned, service) if service else planned)
    places = None
    if store or graph:
        whole, own = with_lanes(chunks, planned, store, graph)
        if {"corpus", "document_id", "page"} <= set(chunks.columns):
            places = whole.where("document_id is not null").select("chunk_id", "corpus", "document_id", "page", "content_type")
        chunks = whole
        lanes = own if lanes is None else lanes.withColumn("chunk_id", F.col("chunk_id").cast("string")).unionByName(own)
    found = stage("hits", retrieve(chunks, planned, settings, lanes))
    if not planned.where(planner.is_comparison(F.col("question"))).isEmpty():
        extra = compare(chunks, planned, settings).join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        found = stage("compared", found.unionByName(extra))
    hits = stage("evidence", evaluate(found, chunks, planned, settings))
    if settings.retries:
        best = hits.groupBy("query_id").agg(F.max("eval_score").alias("best"), F.count("*").alias("n"))
        hits = _again(chunks, planned, hits, planned.join(best, "query_id", "left").where(planner.is_weak(F.col("best"), F.col("n"))).drop("best", "n"), settings)
    computed = sql_evidence(store, statements) if store and statements else None
    if computed:
        hits = hits.unionByName(computed[0].withColumn("query_id", F.col("query_id").cast(hits.schema["query_id"].dataType)).select(*hits.columns))
        chunks = chunks.unionByName(computed[1], allowMissingColumns=True)
    ordered = listwise(chunks, planned, service) if service else None

    def reranker(rows: DataFrame) -> DataFrame:
        rows = ordered(rows) if ordered else rows
        return rows.withColumn("rerank_score", F.when(F.col("source") == "sql", 1.0 + F.col("rerank_score")).otherwise(F.col("rerank_score")))  # before all others

    ranked = stage("ranked", rerank(hits, chunks, planned, settings, reranker))
    if places is not None:
        ranked = stage("expanded", expanded(ranked, places))
    out = stage("answers", compose(ranked, chunks))
    if settings.retries:
        silent = planned.join(out.where(is_insufficient(F.col("answer"))).select("query_id"), "query_id", "left_semi")
        if not silent.isEmpty():
            mine = _again(chunks, silent, hits.join(silent.select("query_id"), "query_id", "left_semi"), silent, settings)
            second = compose(stage("ranked_again", rerank(mine, chunks, silent, settings, reranker)), chunks).where(~is_insufficient(F.col("answer")))
            second = stage("answers_again", second)
            out = out.join(second.select("query_id"), "query_id", "left_anti").unionByName(second)
    cited = out.select("query_id", F.explode("citations.chunk_id").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    contexts = cited.groupBy("query_id").agg(F.array_join(F.collect_list("text"), " ").alias("context"))  # at most top_k chunks a question
    return grounded(out, contexts, regenerate)


def decompose(question: str, chat: Callable[[list[str]], list[str]], most: int = 3) -> list[str]:
    """Two or three questions to ask one after the other, as a chat service splits the question; none offline or for a simple one."""
    reply = chat([f'Reply in JSON {{"hops": [...]}} with sub-questions that lead to the answer, or none: {question}'])[0] or ""
    found = re.search(r"\{.*\}", reply, re.S)
    try:
        hops = json.loads(found[0]).get("hops", []) if found else []
    except ValueError:
        return []
    hops = [h for h in hops if isinstance(h, str) and len(h) > 8][:most]
    return hops if len(hops) >= 2 else []


def answer_in_hops(chunks: DataFrame, hops: list[str], settings: Settings = Settings()) -> list[tuple[str, str]]:
    """(question, answer) of each hop; ``{hopN}`` stands for an earlier answer. One interactive question at a time."""
    spark, done = chunks.sparkSession, []
    for hop in hops:
        asked = HOP.sub(lambda m: done[int(m[1]) - 1][1] if int(m[1]) <= len(done) else "", hop)
        row = answer(chunks, spark.createDataFrame([(1, asked)], "query_id int, question string"), settings).first()
        done.append((asked, row["answer"][:160] if row else "unknown"))
    return done
