"""Catalogues, audits and gates over documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.functions.vectors import embedding
from docgrain.operators import search

GARBLED = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b`` for the same keys; null keys are keys, too."""
    named = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(named, on, how).drop(*[f"__{k}" for k in keys])


def exact_dedup(rows: DataFrame, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row, by ``order``, of every text. Only the text's hash and the order are shuffled to find it.

    Null texts are texts that equal each other.
    """
    keyed = rows.withColumn("__md5", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    first = keyed.groupBy("__md5").agg(F.min(order).alias("__first"))
    same = (keyed["__md5"] == first["__md5"]) & keyed[order].eqNullSafe(first["__first"])
    return keyed.join(first, same, "left_semi").drop("__md5")


def document_catalog(chunks: DataFrame, keys: tuple[str, ...] = ("corpus", "source_name"), type_col: str = "content_type", page_col: str = "page", seen_col: str = "ingested_at") -> DataFrame:
    """A row for each document: chunks, distinct pages, chunks by content type (a map), when last seen."""
    types = chunks.groupBy(*keys, type_col).agg(F.count("*").alias("n"))
    types = types.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(type_col), F.lit("")), "n")))).alias("content_types"))
    totals = chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.count_distinct(page_col).alias("n_pages"), F.max(seen_col).alias("last_seen"))
    return _same(totals, types, list(keys))


def filled(c: Column, kind: str) -> Column:
    """Whether a value counts as present: not null, empty text, list or map."""
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def coverage(rows: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of rows, rounded to 2 places, in which each field is present."""
    kinds = dict(rows.dtypes)
    shares = [F.round(F.avg(F.when(filled(F.col(f), kinds[f]), 1.0).otherwise(0.0)), 2).alias(f) for f in fields]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), *shares)


def metadata_verdict(shares: DataFrame, critical: list[str], least: float = 0.9) -> DataFrame:
    """Coverage with the critical fields that fall short, and a verdict."""
    short = F.array_compact(F.array(*[F.when(F.col(f) < least, F.lit(f)) for f in critical]))
    return shares.withColumn("missing", short).withColumn("verdict", F.when(F.size("missing") == 0, "ok").otherwise("gaps"))


def parse_quality(pages: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """Share of near-empty pages, share of garbled characters, mean length, and whether the parse is bad."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(*by, (F.length(T.strip(t)) < 30).cast("int").alias("e"), F.length(t).alias("n"), F.regexp_count(t, F.lit(GARBLED)).alias("g"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_pages"),
        F.round(F.avg("e"), 3).alias("empty_ratio"),
        F.round(F.sum("g") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("garble_ratio"),
        F.floor(F.sum("n") / F.count("*")).alias("avg_chars"),
    )
    return out.withColumn("bad", (F.col("empty_ratio") > 0.7) | (F.col("garble_ratio") > 0.02))


def better_parse(pages: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """The pages of each document, with a verdict: those of the ``fallback`` parser where the first parse is bad and the
    second has fewer empty pages or less garble; both tables have the same columns.

    Verdicts: ok, reparsed, poor_kept (the fallback is no better) and poor_no_fallback. A document that only the
    fallback has is reparsed.
    """
    one = parse_quality(pages, by).select(*by, "bad", F.col("empty_ratio").alias("e1"), F.col("garble_ratio").alias("g1"))
    two = parse_quality(fallback, by).select(*by, F.col("empty_ratio").alias("e2"), F.col("garble_ratio").alias("g2"))
    better = (F.col("e2") < F.col("e1")) | (F.col("g2") < F.col("g1"))
    verdict = F.when(~F.col("bad"), "ok").when(F.col("e2").isNull(), "poor_no_fallback").when(better, "reparsed").otherwise("poor_kept")
    judged = _same(one, two, by, "left").select(*by, verdict.alias("verdict"))
    only = two.join(one.withColumnsRenamed({k: f"__{k}" for k in by}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by], "left_anti")
    judged = judged.unionByName(only.select(*by, F.lit("reparsed").alias("verdict")))
    first = _same(pages, judged.where("verdict <> 'reparsed'"), by)
    return first.unionByName(_same(fallback, judged.where("verdict = 'reparsed'"), by))


#: What a probe needs, how much of it is asked for, and among how many hits its document must be.
PROBE_LEAST, PROBE_CHARS, PROBE_HITS = 120, 300, 3


def self_probe(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(document_id) of documents that are found by the start of their first long chunk, by id, among the first three vectors.

    ``documents`` (document_id) are those to probe, all by default. chunks: chunk_id, document_id, text, embedding.
    """
    long = chunks.where(F.length("text") > PROBE_LEAST)
    long = long if documents is None else long.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    probes = long.groupBy("document_id").agg(F.min_by(F.substring("text", 1, PROBE_CHARS), "chunk_id").alias("text"))
    asked = probes.select(F.col("document_id").alias("query_id"), embedding(F.col("text")).alias("embedding"))
    hits = search.vector_topk(chunks, asked, PROBE_HITS)
    found = hits.join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return found.where(F.col("query_id") == F.col("document_id")).select("document_id").distinct()


def graph_quality(nodes: DataFrame, edges: DataFrame, name_col: str = "label") -> DataFrame:
    """One row: nodes, junk names, their share, typed edges, verdict."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum(T.is_junk_name(F.col(name_col)).cast("int")), F.lit(0)).alias("n_junk"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if("typed").alias("n_typed"))
    ratio = F.col("n_junk") / F.greatest("n_nodes", F.lit(1))
    return n.crossJoin(e).withColumn("junk_ratio", ratio).withColumn("verdict", F.when(ratio < 0.05, "ok").otherwise("noisy"))


def index_audit(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id, n_chunks, tables, with_cells, retrievable): ``found`` lists the documents whose own probe came back among the first three."""
    table = F.col("content_type") == "table"
    rows = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if(table).alias("tables"), F.count_if(table & F.col("cells").isNotNull()).alias("with_cells"))
    ok = found.select("document_id").distinct().withColumn("retrievable", F.lit(True))
    return rows.join(ok, "document_id", "left").withColumn("retrievable", F.coalesce("retrievable", F.lit(False)))


def job_stats(events: DataFrame, by: str = "job_id") -> DataFrame:
    """State of jobs from their events (job, status, secs, chunks): counts, mean seconds, what remains, ETA, files a minute.

    ``status`` is queued, done or failed for each file.
    """
    over = F.col("status").isin("done", "failed")
    rows = events.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.avg(F.when(over, F.col("secs"))).alias("mean_secs"),
    )
    left = F.col("total") - F.col("done") - F.col("failed")
    pct = F.round(100.0 * (F.col("done") + F.col("failed")) / F.greatest("total", F.lit(1)), 1)
    return rows.withColumns({"remaining": left, "eta_secs": left * F.coalesce("mean_secs", F.lit(0.0)), "per_minute": F.when(F.col("mean_secs") > 0, 60.0 / F.col("mean_secs")), "pct": pct})


#: Reports that a caller sees.
REPORTS = 200


def latest_reports(reports: DataFrame, most: int = REPORTS) -> DataFrame:
    """The newest reports (at, agent, stage, verdict, ...), newest first; ties by all columns. The log itself keeps them all."""
    return reports.orderBy(F.desc("at"), *[c for c in reports.columns if c != "at"]).limit(most)


def ordered_distinct(rows: DataFrame, by: list[str], value: str, place: str) -> DataFrame:
    """``by`` with ``values``: the distinct values of each group in the order in which they first come; nulls are left out."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(place).alias("__p"))
    listed = F.array_sort(F.collect_list(F.struct("__p", F.col(value).alias("v"))))
    return first.groupBy(*by).agg(F.transform(listed, lambda x: x["v"]).alias("values"))


def manifest_actions(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_key, hash, action) of incoming files: create, skip where the content is known under the key, update where it changed."""
    known = manifest.select("doc_key", F.col("hash").alias("__known"))
    action = F.when(F.col("__known").isNull(), "create").when(F.col("__known") == F.col("hash"), "skip").otherwise("update")
    return incoming.join(known, "doc_key", "left").select("doc_key", "hash", action.alias("action"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of equal key replaced and new ones added; of rows that repeat a key the last by all columns stays."""
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in rows.columns])
    once = rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    return table.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def delete_document(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks without those of the documents in ``ids`` (document_id)."""
    return chunks.join(ids, "document_id", "left_anti")


def document_detail(chunks: DataFrame, fields: list[str], by: str = "document_id") -> DataFrame:
    """A row for each document: chunks by content type and by method (maps), share of each field filled, distinct entities.

    chunks: content_type, extraction_method, entities and the fields.
    """
    shares = coverage(chunks, fields, [by])
    for name, column in (("content_types", "content_type"), ("methods", "extraction_method")):
        counts = chunks.groupBy(by, column).agg(F.count("*").alias("n"))
        entry = F.struct(F.coalesce(F.col(column), F.lit("")).alias("key"), "n")
        shares = _same(shares, counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name)), [by])
    names = chunks.select(by, F.explode("entities").alias("e")).distinct().groupBy(by).agg(F.count("*").alias("n_entities"))
    return _same(shares, names, [by], "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))


def store_counts(chunks: DataFrame, by: str = "corpus") -> DataFrame:
    """(by, chunks, documents, tables, cells): what a store holds, by corpus. chunks: document_id, content_type, cells."""
    table = F.col("content_type") == "table"
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.count_if(table).alias("tables"), F.count_if(F.col("cells").isNotNull()).alias("cells"))


def document_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of wanted (request, document_id, source_name) documents: by id, or by name where a request has no id."""
    by_id = chunks.join(wanted.where("document_id is not null").select("request", "document_id"), "document_id")
    by_name = chunks.join(wanted.where("document_id is null").select("request", "source_name"), "source_name")
    return by_id.unionByName(by_name)


def touching(of_nodes: DataFrame, chunks: DataFrame, by: str = "document_id") -> DataFrame:
    """Distinct (document, key): the graph's nodes, by (key, chunk_id), that a document's chunks mention."""
    return of_nodes.join(chunks.select("chunk_id", by), "chunk_id").select(by, "key").distinct()
