"""Search: postings and BM25, exact vector search, fusion, score adjustment, evaluation, reranking.

Queries come as a table and are answered together. Chunks have chunk_id and, where an operator needs them, text,
source, content_type, document_date, confidence. Orders end in the chunk's id, so results do not depend on how the
data are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.session import materialise

#: BM25, lanes and boosts.
K1, B = 1.5, 0.75
LANE_WEIGHT = {"vector": 1.0, "graph": 0.95, "bm25": 0.85, "table_row": 1.0}
BM25_SHARE = 0.75
YEAR_MATCH, YEAR_MISS, YEAR_NONE = 1.30, 0.80, 0.85
SMALL_SOURCE, SMALL_SOURCE_BOOST = 500, 1.5
MIN_EVIDENCE, ROW_FLOOR = 0.10, 0.72
STRUCTURED = ("table", "chart", "figure")

#: Places to which scores are compared, so that sums in another order leave ties as ties.
PLACES = 9
#: Queries that are multiplied with a batch of vectors at once.
QUERY_BLOCK = 1024
#: Bytes of query vectors that one scan of the vectors answers; more are taken by further scans.
QUERY_BYTES = 1 << 26
#: Vectors that a block of queries is multiplied with at once.
VECTOR_SLICE = 2048
#: Rows that a task of vector search hands on at once.
HANDED_ON = 100_000
#: Query terms up to this number are broadcast against the postings.
BROADCAST_TERMS = 200_000
#: Query terms up to this number are part of the plan, so that the corpus is tokenised once.
LITERAL_TERMS = 4_000


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): content tokens counted within their document, in the row, without a shuffle."""
    rows = chunks.select(F.col(id_col).alias("id"), T.content_tokens(F.col(text_col)).alias("words"))
    # The outer form: for the inner one Spark would make the tokens twice, to leave out rows without any first.
    rows = rows.select("id", F.size("words").alias("dl"), F.explode_outer("words").alias("term")).where("term is not null")
    return rows.groupBy("id", "term", "dl").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def corpus_size(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n_docs, avg_dl); empty documents count."""
    dl = F.size(T.content_tokens(F.col(text_col)))
    return chunks.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(dl), F.lit(1.0)).alias("avg_dl"))


def bm25_idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 30, id_col: str = "chunk_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "question") -> DataFrame:
    """Best ``k`` chunks of each query by BM25: (query_id, chunk_id, score, rank), scores divided by the query's best.

    A term that a query repeats counts as often. Ties go to the smaller id. Only terms of queries leave the scan:
    documents are filtered to them before any shuffle, so that what is counted and joined follows the queries.
    """
    words = queries.select(F.col(query_id).alias("q"), F.explode(T.content_tokens(F.col(query_text))).alias("term"))
    wanted = words.groupBy("q", "term").agg(F.count("*").alias("times"))
    terms = wanted.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    rows = chunks.select(F.col(id_col).alias("id"), T.content_tokens(F.col(text_col)).alias("words"))
    if terms.limit(LITERAL_TERMS + 1).count() <= LITERAL_TERMS:
        # The corpus is tokenised once: a row keeps its length and those of its words that any query has.
        known = [r["term"] for r in terms.collect()]
        rows = rows.select("id", F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(*known)).alias("mine"))
        rows = materialise(rows, "matches")
        size = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_dl")).first()
        rows = rows.select("id", "dl", F.explode("mine").alias("term"))
    else:
        size = corpus_size(chunks, text_col).first()
        rows = rows.select("id", F.size("words").alias("dl"), F.explode_outer("words").alias("term"))
        rows = rows.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    tf = rows.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = wanted.join(df, "term").withColumn("idf", bm25_idf(F.col("df"), F.lit(size["n_docs"])) * F.col("times"))
    f, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * (f * (K1 + 1)) / (f + K1 * (1 - B + B * dl / F.lit(size["avg_dl"])))
    scored = tf.join(F.broadcast(weighted) if few else weighted, "term").groupBy("q", "id").agg(F.sum(part).alias("raw"))
    scored = scored.where("raw > 0")
    order = Window.partitionBy("q").orderBy(F.desc(F.round("raw", PLACES)), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = F.max("raw").over(Window.partitionBy("q"))
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), (F.col("raw") / top).alias("score"), "rank")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 45, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", match: str | None = None, exclude_self: bool = False, where: Column | None = None) -> DataFrame:
    """Best ``k`` vectors of each query by cosine: (query_id, chunk_id, score, rank); exact, ties to the smaller id.

    Zero, null and ill-formed vectors score 0. ``match`` names a column of both tables that must agree before ranks
    are given; ``where`` is a predicate on the vectors' table, which reaches the scan. Ids may be numbers or strings. Up to QUERY_BYTES of queries are sent to all tasks; each batch of vectors
    is multiplied with them, block by block, and a task keeps its best ``k`` for each query, so that the vectors are
    scanned once and only k rows a query and task are shuffled.
    """
    wanted = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"), *([F.col(match).alias("m")] if match else []))
    columns = [F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *([F.col(match).alias("m")] if match else [])]
    usable = F.col(id_col).isNotNull()
    rows = vectors.where(usable if where is None else usable & where).select(*columns)
    types = f"q {wanted.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    found = None
    for group in _groups(wanted):
        part = rows.mapInPandas(_batch_best(group, k, bool(match), exclude_self), types)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], types)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", PLACES)), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _groups(wanted: DataFrame) -> Iterator[list]:
    """Query rows in groups of QUERY_BYTES, one group in memory at a time."""
    group, size = [], 0
    for row in wanted.toLocalIterator():
        group.append(row)
        size += 8 * len(row["v"] or ()) + 64
        if size >= QUERY_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _unit(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        if v is not None and len(v) == width:
            x = np.asarray(v, dtype=np.float64)
            n = np.sqrt((x * x).sum())
            if np.isfinite(n) and n > 0:
                out[i] = x / n
    return out


def kept(parts: list, k: int) -> tuple[np.ndarray, ...]:
    """Of candidates (query's place, id, rounded score, score) the best ``k`` of each query."""
    at, ids, places, scores = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.argsort(ids, kind="stable")
    order = order[np.lexsort((-places[order], at[order]))]
    at = at[order]
    first = np.arange(len(at)) - np.searchsorted(at, at)
    order, at = order[first < k], at[first < k]
    return at, ids[order], places[order], scores[order]


def least_kept(held: tuple[np.ndarray, ...], k: int, n: int) -> np.ndarray:
    """For each of ``n`` queries the rounded score of its last of ``k`` candidates; where it has fewer, no bound."""
    full = np.bincount(held[0], minlength=n) >= k
    return np.where(full, np.minimum.reduceat(np.append(held[2], np.inf), np.searchsorted(held[0], np.arange(n))), -np.inf)


def _batch_best(group: list, k: int, match: bool, exclude_self: bool):
    width = max((len(r["v"]) for r in group if r["v"] is not None), default=0)
    blocks = []
    for at in range(0, len(group), QUERY_BLOCK):
        rows = group[at : at + QUERY_BLOCK]
        blocks.append(([r["q"] for r in rows], _unit([r["v"] for r in rows], width), [r["m"] for r in rows] if match else None))

    n, kinds = len(group), np.array([r["q"] for r in group])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task holds its best k of each query so far, and as many candidates again before it sorts them out.
        held, waiting, size, least = None, [], 0, np.full(n, -np.inf)
        limit = max(k * n, VECTOR_SLICE * 64)
        for batch in (b.iloc[i : i + VECTOR_SLICE] for b in batches for i in range(0, len(b), VECTOR_SLICE)):
            mine, unit = batch["id"].to_numpy(), _unit(list(batch["v"]), width).T
            theirs = batch["m"] if match else None
            for block, (ids, matrix, labels) in enumerate(blocks):
                score, start = matrix @ unit, block * QUERY_BLOCK
                ok = score >= least[start : start + len(ids), None] - 10.0**-PLACES
                if match:
                    ok &= np.array([(theirs == x).to_numpy() for x in labels])
                if exclude_self:
                    ok &= np.array([mine != q for q in ids])
                i, j = np.nonzero(ok)
                waiting.append((i + start, mine[j], np.round(score[i, j], PLACES), score[i, j]))
                size += len(i)
                if size >= limit:
                    held, waiting, size = kept(waiting + ([held] if held else []), k), [], 0
                    least = least_kept(held, k, n)
        if waiting:
            held = kept(waiting + ([held] if held else []), k)
        if held:
            for i in range(0, len(held[0]), HANDED_ON):
                at, ids, _, scores = (x[i : i + HANDED_ON] for x in held)
                yield pd.DataFrame({"q": kinds[at], "id": ids, "score": scores})

    return best


def fuse(lanes: DataFrame) -> DataFrame:
    """One hit for each query and chunk of (query_id, chunk_id, score, source, lane): the best score's; ties to the earlier lane."""
    key = F.struct("score", (-F.col("lane")).alias("order"))
    return lanes.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("source", key).alias("source"))


def cap_sources(hits: DataFrame, key: str = "doc_source", query_id: str = "query_id", id_col: str = "chunk_id", many: int = 15, small_cap: int = 3, large_cap: int = 6) -> DataFrame:
    """At most 3 hits of one source, or 6 where a query's hits have 15 sources or more; best scores first."""
    sources = hits.groupBy(query_id).agg(F.count_distinct(key).alias("__n"))
    order = Window.partitionBy(query_id, key).orderBy(F.desc(F.round("score", PLACES)), id_col)
    ranked = hits.withColumn("__rank", F.row_number().over(order)).join(sources, query_id)
    cap = F.when(F.col("__n") >= many, large_cap).otherwise(small_cap)
    return ranked.where(F.col("__rank") <= cap).drop("__rank", "__n")


def pool(hits: DataFrame, size: int, query_id: str = "query_id", id_col: str = "chunk_id", score: str = "score") -> DataFrame:
    """The best ``size`` hits of each query, with their rank."""
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round(score, PLACES)), id_col)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def adjusted_score(score: Column, *, source: Column, lane: Column, quality: Column, years: Column, date: Column, source_chunks: Column | None = None, domain_hit: Column | None = None) -> Column:
    """Score after quality, year, small-source and domain factors; table rows are spared the quality factor.

    ``years`` are the question's; where there are any, a source or date that names one gains, others lose.
    """
    out = score * F.when(lane == "table_row", 1.0).otherwise(quality)
    named = F.exists(years, lambda y: F.contains(F.coalesce(source, F.lit("")), y) | F.contains(F.coalesce(date, F.lit("")), y))
    dated = F.coalesce(date, F.lit("")) != ""
    out = out * F.when(F.size(years) == 0, 1.0).when(named, YEAR_MATCH).when(dated, YEAR_MISS).otherwise(YEAR_NONE)
    if source_chunks is not None:
        boost = F.least(F.lit(SMALL_SOURCE_BOOST), F.lit(float(SMALL_SOURCE)) / F.greatest(source_chunks, F.lit(50)))
        out = out * F.when(source_chunks < SMALL_SOURCE, boost).otherwise(1.0)
    if domain_hit is not None:
        out = out * F.when(domain_hit, 1.80).otherwise(1.0)
    return out


def question_years(question: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(T.YEAR), F.lit(0))


def evaluation_score(*, similarity: Column, question_tokens: Column, text_tokens: Column, text: Column, has_metadata: Column, structured_bonus: Column, lane: Column, confidence: Column) -> Column:
    """Evidence score, rounded to 4 places: similarity, token overlap, length, metadata and structure, by lane and confidence."""
    completeness = F.least(F.lit(1.0), F.length(F.coalesce(text, F.lit(""))) / 400.0)
    raw = 0.45 * similarity + 0.30 * T.overlap(question_tokens, text_tokens) + 0.15 * completeness
    raw = raw + F.when(has_metadata, 0.1).otherwise(0.0) + F.when(structured_bonus, 0.12).otherwise(0.0)
    weight = F.coalesce(*[F.when(lane == name, w) for name, w in LANE_WEIGHT.items()], F.lit(0.8))
    out = raw * weight * F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 1.0).otherwise(confidence)
    return F.round(F.when(lane == "table_row", F.greatest(out, F.lit(ROW_FLOOR))).otherwise(out), 4)


def keep_evidence(hits: DataFrame, k: int, query_id: str = "query_id", id_col: str = "chunk_id", least: float = MIN_EVIDENCE) -> DataFrame:
    """Hits with enough evidence; where a query has none, its best ``k`` of all."""
    any_strong = F.max(F.col("eval_score") >= least).over(Window.partitionBy(query_id))
    order = Window.partitionBy(query_id).orderBy(F.desc("eval_score"), id_col)
    ranked = hits.withColumn("__strong", any_strong).withColumn("__rank", F.row_number().over(order))
    keep = F.when(F.col("__strong"), F.col("eval_score") >= least).otherwise(F.col("__rank") <= k)
    return ranked.where(keep).drop("__strong", "__rank")


def rerank_score(*, evidence: Column, question_tokens: Column, text_tokens: Column, content_type: Column, has_cells: Column, wants_structure: Column) -> Column:
    """Linear blend of evidence and coverage, with a bonus for structure where the question wants it; 4 places."""
    structured = content_type.isin(*STRUCTURED) & wants_structure
    bonus = F.when(structured & (content_type == "table") & has_cells, 0.30).when(structured, 0.18).otherwise(0.0)
    return F.round(0.7 * F.coalesce(evidence, F.lit(0.0)) + 0.3 * T.overlap(question_tokens, text_tokens) + bonus, 4)


def final_order(hits: DataFrame, k: int | Column, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Best ``k`` hits of each query by rerank score, with ranks from 1.

    Where ``numeric`` is true and no table with cells (``is_table``) would be among them, the best such table takes
    the first place. Hits need rerank_score, numeric and is_table.
    """
    by_query = Window.partitionBy(query_id)
    order = by_query.orderBy(F.desc("rerank_score"), id_col)
    ranked = hits.withColumn("__r", F.row_number().over(order))
    table_rank = F.min(F.when(F.col("is_table"), F.col("__r"))).over(by_query)
    moved = F.col("numeric") & (table_rank > k)
    place = F.when(moved & (F.col("__r") == table_rank), 0).otherwise(F.col("__r"))
    ranked = ranked.withColumn("__place", place)
    out = ranked.withColumn("rank", F.row_number().over(by_query.orderBy("__place"))).where(F.col("rank") <= k)
    return out.drop("__r", "__place")


def novelty(vectors: DataFrame, queries: DataFrame, threshold: float = 0.88, **names) -> DataFrame:
    """(query_id, similarity, novel): the closest other vector of each query, and whether it is far enough."""
    best = vector_topk(vectors, queries, k=1, exclude_self=True, **names)
    return best.select(names.get("query_id", "query_id"), F.col("score").alias("similarity"), (F.col("score") < threshold).alias("novel"))


def filter_metadata(chunks: DataFrame, wanted: dict[str, str], years: list[str] | None = None) -> DataFrame:
    """Chunks whose columns contain the wanted values, whatever their case; with years, undated chunks pass, others must name one."""
    out = chunks
    for name, value in wanted.items():
        if name != "domain":
            out = out.where(F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(str(value).lower())))
    if years:
        dates = F.concat(F.coalesce("document_date", F.lit("")), F.coalesce("incident_date", F.lit("")))
        named = [F.contains(dates, F.lit(y)) for y in years]
        ok = dates == ""
        for x in named:
            ok = ok | x
        out = out.where(ok)
    return out
