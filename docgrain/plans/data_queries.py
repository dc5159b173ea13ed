"""Queries of the table, job and streaming operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import audit, derived, evaluation, metrics, tables
from docgrain.plans import answer as answers
from docgrain.plans import ingest as ingestion
from docgrain.plans.text_queries import WORDS_SQL
from docgrain.session import materialise, new_path, spread, table
from docgrain.sources import store
from docgrain.streaming import ingest, jobs, state


def _named_nation() -> Column:
    """A name of at least two words that no other nation has."""
    return F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(" "), F.col("n_name"))


def _nation_tables(spark: SparkSession, sf: str, name: Column | None = None) -> DataFrame:
    """A chunk with a table in pipes for each region: its nations, by name, and their keys."""
    nations = table(spark, sf, "nation")
    rows = (nations if name is None else nations.withColumn("n_name", name)).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.struct("n_name", F.concat(F.lit("| "), F.col("n_name"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |")).alias("line"))
    text = F.array_join(F.concat(F.array(F.lit("| nation | key |"), F.lit("| --- | --- |")), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])), "\n")
    grouped = rows.groupBy("r_name", "r_regionkey").agg(text.alias("text"))
    return grouped.select(F.col("r_name").alias("chunk_id"), F.concat(F.lit("nations_"), F.lower("r_name")).alias("source"), F.lit(1).alias("page"), (F.col("r_regionkey") + 2020).cast("string").alias("document_date"), F.lit("Nations").alias("title"), tables.table_cells("text").alias("cells"))


def _order_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk with an aligned table for each year: orders by priority."""
    rows = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.count("*").alias("n"))
    line = F.concat(F.col("o_orderpriority"), F.lit("    "), F.col("n").cast("string"))
    text = F.array_join(F.concat(F.array(F.lit("priority    orders")), F.array_sort(F.collect_list(line))), "\n")
    grouped = rows.groupBy("y").agg(text.alias("text"))
    return grouped.select(F.concat(F.lit("orders-"), F.col("y").cast("string")).alias("chunk_id"), F.concat(F.lit("orders_by_priority_"), F.col("y").cast("string")).alias("source"), F.lit(1).alias("page"), F.lit("").alias("document_date"), F.concat(F.lit("Orders by priority "), F.col("y").cast("string")).alias("title"), tables.table_cells("text").alias("cells"))


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = materialise(_nation_tables(spark, sf).unionByName(_order_tables(spark, sf)), "tables")
    return tables.build_store(chunks)


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    known, rows = _store(spark, sf)
    return rows.join(known.select("table_id", "year"), "table_id").select("table_id", "year", "idx", F.array_join("cells", "|").alias("cells"))


TABLE_ROWS_SQL = """
SELECT r_name AS table_id, CAST(r_regionkey + 2020 AS VARCHAR) AS year, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INTEGER) AS idx, n_name || '|' || n_nationkey AS cells
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'orders-' || y, CAST(y AS VARCHAR), CAST(row_number() OVER (PARTITION BY y ORDER BY p || '    ' || n) - 1 AS INTEGER), p || '|' || n
FROM (SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL)
"""


def table_families(spark: SparkSession, sf: str) -> DataFrame:
    known, _ = _store(spark, sf)
    known = materialise(known, "store")
    return tables.family_catalog(known, tables.table_families(known))


def row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    known, rows = _store(spark, sf)
    words = F.regexp_extract_all(F.upper("n_name"), F.lit(r"[A-Z0-9]{2,}"), F.lit(0))
    keys = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), words.alias("key"), F.lit("").alias("year"))
    return tables.find_rows(known, rows, keys)


ROW_LOOKUP_SQL = r"""
WITH r AS (
  SELECT r_name AS t, n_name || ' | ' || n_nationkey AS row_text, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS idx,
         regexp_extract_all(upper(n_name), '[A-Z0-9]{2,}') AS w FROM nation JOIN region ON n_regionkey = r_regionkey
), k AS (SELECT n_nationkey AS q, regexp_extract_all(upper(n_name), '[A-Z0-9]{2,}') AS key FROM nation),
a AS (SELECT t, list_distinct(flatten(list(w))) AS all_words FROM r GROUP BY t),
m AS (SELECT q, key, t FROM k JOIN a ON list_has_all(all_words, key)),
h AS (SELECT q, m.t, key, row_text, idx FROM m JOIN r ON r.t = m.t WHERE len(list_filter(key, lambda x: NOT contains(upper(row_text), x))) = 0)
SELECT q AS query_id, t AS table_id, arg_min(row_text, idx) AS row_text, round(CAST(0.86 AS DOUBLE) + 0.02 * least(4, any_value(len(key))), 3) AS score
FROM h GROUP BY q, t
"""


def table_sql(spark: SparkSession, sf: str) -> DataFrame:
    """A guarded SELECT over two tables of the store."""
    known, rows = _store(spark, sf)
    sql = "SELECT year, c1 AS name, CAST(c2 AS BIGINT) AS k FROM t1 UNION ALL SELECT year, c1, CAST(c2 AS BIGINT) FROM t2"
    return tables.run_select(spark, sql, known, rows, ["AFRICA", "EUROPE"])


TABLE_SQL_SQL = "SELECT CAST(r_regionkey + 2020 AS VARCHAR) AS year, n_name AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'EUROPE')"


def job_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The events as jobs' files: a user is a job, purchases are done, errors failed, the value is the seconds."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("queued")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("value").alias("secs"), F.lit(1).alias("chunks"))
    out = audit.job_stats(rows)
    return out.select("job_id", "total", "done", "failed", "remaining", F.round("mean_secs", 6).alias("mean_secs"), F.round("eta_secs", 4).alias("eta_secs"), "pct")


JOB_STATS_SQL = """
WITH j AS (SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed,
  avg(value) FILTER (event_type IN ('purchase', 'error')) AS mean FROM events GROUP BY user_id)
SELECT job_id, total, done, failed, total - done - failed AS remaining, round(mean, 6) AS mean_secs, round((total - done - failed) * coalesce(mean, 0), 4) AS eta_secs,
  round(100.0 * (done + failed) / greatest(total, 1), 1) AS pct FROM j
"""


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.event_windows(table(spark, sf, "events"))
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


EVENT_WINDOWS_SQL = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.sessions(table(spark, sf, "events")).select("user_id", "start", "n")


EVENT_SESSIONS_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s
"""


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of :func:`event_windows` from a stream over the table's file, run until it has read all."""
    schema = table(spark, sf, "events").schema
    path = f"{materialise(spark.range(1), 'stream').inputFiles()[0].rpartition('/')[0]}-out"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    rows = ingest.event_windows(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = rows.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(path).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def manifest_actions(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against a manifest of the labelled ones, in which toxic ones have changed since."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), F.md5("text").alias("hash"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("doc_key"), "toxic")
    manifest = docs.join(labels, "doc_key").select("doc_key", F.when(F.col("toxic") == 1, "changed").otherwise(F.col("hash")).alias("hash"))
    return audit.manifest_actions(docs, manifest)


MANIFEST_ACTIONS_SQL = """
SELECT doc_id AS doc_key, md5(text) AS hash, CASE WHEN toxic IS NULL THEN 'create' WHEN toxic = 1 THEN 'update' ELSE 'skip' END AS action
FROM documents LEFT JOIN labels USING (doc_id)
"""


def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the toxic ones replaced by a notice, then without those of low quality."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    labels = table(spark, sf, "labels")
    new = labels.where("toxic = 1").select("doc_id", F.lit("withheld").alias("digest"))
    out = audit.upsert(docs, new, "doc_id").withColumnRenamed("doc_id", "document_id")
    bad = labels.where("quality = 0").select(F.col("doc_id").alias("document_id"))
    return audit.delete_document(out, bad).select(F.col("document_id").alias("doc_id"), "digest")


UPSERT_DOCUMENTS_SQL = """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN toxic = 1 THEN 'withheld' ELSE md5(text) END AS digest
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
WHERE (d.doc_id IS NOT NULL OR toxic = 1) AND coalesce(quality, 1) <> 0
"""


def answer_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals and numbers among the replies."""
    signals = evaluation.answer_signals(F.col("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", signals.alias("s"), evaluation.is_insufficient(F.col("text")).alias("insufficient"))
    return rows.select("conv_id", "turn", "role", F.col("s.answered").alias("answered"), F.col("s.has_number").alias("has_number"), "insufficient")


ANSWER_CHECKS_SQL = r"""
WITH a AS (SELECT conv_id, turn, role, coalesce(text, '') AS t,
  regexp_matches(lower(coalesce(text, '')), 'does not contain|not contain|cannot provide|no information|insufficient|does not provide|not found|not available|unable to|no relevant|not specify|not include') AS refused FROM conversations)
SELECT conv_id, turn, role, NOT refused AS answered, regexp_matches(t, '\d[\d,]{2,}') AS has_number, refused OR length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 25 AS insufficient FROM a
"""


def entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' first two orders from each supplier: documents that share an entity."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return evaluation.entity_pairs(lines.select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_id")))


ENTITY_PAIRS_SQL = """
WITH o AS (SELECT l_suppkey AS entity, l_orderkey AS d, min(l_linenumber) AS c FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS r FROM o)
SELECT a.entity, a.d AS first_document, b.d AS second_document, a.c AS first_chunk, b.c AS second_chunk FROM r a JOIN r b ON a.entity = b.entity WHERE a.r = 1 AND b.r = 2
"""


def document_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Sources in detail: documents by language, fields filled, distinct capitalised words."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    names = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Z][a-z]+"), F.lit(0)))
    rows = rows.select(F.col("source").alias("document_id"), F.col("lang").alias("content_type"), F.lit("text").alias("extraction_method"), names.alias("entities"), "text", "quality")
    out = audit.document_detail(rows, ["text", "quality"])
    flat = F.array_join(F.transform(F.map_entries("content_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("document_id", "n_rows", "text", "quality", flat.alias("content_types"), "n_entities")


DOCUMENT_DETAIL_SQL = r"""
WITH d AS (SELECT source, coalesce(lang, '') AS lang, text, quality FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT source, lang, count(*) AS n FROM d GROUP BY ALL),
t AS (SELECT source, string_agg(lang || ':' || n, ',' ORDER BY lang) AS content_types FROM k GROUP BY source),
e AS (SELECT source, count(DISTINCT w) AS n_entities FROM (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+')) AS w FROM d) GROUP BY source)
SELECT d.source AS document_id, count(*) AS n_rows, round(avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END), 2) AS text, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) AS quality,
  any_value(content_types) AS content_types, coalesce(any_value(n_entities), 0) AS n_entities
FROM d JOIN t USING (source) LEFT JOIN e USING (source) GROUP BY d.source
"""


def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of conversations as answers: a hit names a word of the turn before, a refusal is expected of short turns."""
    turns = table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 3).alias("points"), (F.length("text") < 40).alias("expect_refusal"))
    return evaluation.score_answers(turns.join(before, ["conv_id", "turn"]).select(F.col("text").alias("answer"), "points", "expect_refusal"))


ANSWER_SCORES_SQL = f"""
WITH r AS (
  SELECT lower(coalesce(a.text, '')) AS answer, string_split(coalesce(b.text, ''), ' ')[1:3] AS points, length(b.text) < 40 AS refuse
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn
), x AS (
  SELECT refuse, ({" OR ".join(f"contains(answer, '{m}')" for m in evaluation.REFUSALS)}) AS refused, len(list_filter(points, lambda p: contains(answer, lower(p)))) > 0 AS named FROM r
), h AS (SELECT *, named AND NOT refused AS hit FROM x)
SELECT count(*) AS n, round(avg(CAST(hit AS DOUBLE)) FILTER (NOT refuse), 4) AS hit_rate, round(avg(CAST(refused AS DOUBLE)) FILTER (refuse), 4) AS refusal_accuracy,
  round(avg(CASE WHEN refuse THEN CAST(refused AS DOUBLE) ELSE CAST(hit AS DOUBLE) END), 4) AS correct FROM h
"""


def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Mean discounts by ship mode of two halves of the years, as metrics that must not fall."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("metric"))
    late, early = F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp"), F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")
    now = rows.agg(F.round(F.avg(F.when(late, F.col("l_tax"))), 4).alias("value"))
    base = rows.agg(F.round(F.avg(F.when(early, F.col("l_tax"))), 4).alias("value"))
    return metrics.gate(now, base, 0.0005)


REGRESSION_GATE_SQL = """
WITH m AS (SELECT l_returnflag AS metric, round(avg(l_tax) FILTER (l_shipdate >= TIMESTAMP '1995-06-17'), 4) AS value, round(avg(l_tax) FILTER (l_shipdate < TIMESTAMP '1995-06-17'), 4) AS base FROM lineitem GROUP BY l_returnflag)
SELECT metric, value, base, coalesce(value >= base - 0.0005, false) AS ok FROM m
"""


def ingest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The journal of documents when those with an even id were indexed before, some with another text."""
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"), "text")
    old = F.when(F.col("document_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    known = docs.where("document_id % 2 = 0").select("document_id", F.md5(F.coalesce(old, F.lit(""))).alias("hash"))
    return ingestion.journal(docs, known)


INGEST_DOCUMENTS_SQL = """
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS hash, md5(coalesce(CASE WHEN doc_id % 10 = 0 THEN text || '.' ELSE text END, '')) AS old FROM documents),
f AS (SELECT hash, min(doc_id) AS first FROM d GROUP BY hash)
SELECT doc_id AS document_id, d.hash, CASE WHEN doc_id <> first THEN 'duplicate' WHEN doc_id % 2 <> 0 THEN 'new' WHEN old = d.hash THEN 'unchanged' ELSE 'updated' END AS status
FROM d JOIN f ON f.hash = d.hash
"""


def ingest_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' texts indexed end to end: the graph's nodes."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("source_name"), F.col("html").alias("text"))
    return ingestion.ingest(pages).nodes.select("key", "type", "count", "n_chunks")


def summary_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The line that stands for each document, under a name with a year."""
    name = F.concat(F.lit("report_"), (1990 + F.col("doc_id") % 40).cast("string"), F.lit(".txt"))
    pages = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("document_id"), name.alias("source_name"), F.lit(1).alias("page"), "text")
    return ingestion.summary_anchors(pages).select("document_id", "text")


SUMMARY_ANCHORS_SQL = r"""
WITH d AS (SELECT doc_id, (1990 + doc_id % 40)::INT::VARCHAR AS year, list_filter(list_transform(regexp_split_to_array(substring(text, 1, 1200), '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines
  FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
SELECT doc_id AS document_id, '[DOC SUMMARY: report_' || year || '.txt (' || year || ')] ' || array_to_string(lines, ' | ') AS text FROM d
"""


def better_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of one parse, some of them empty, and of another, that has other gaps: which one stays."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = F.col("doc_id")
    first = docs.withColumn("text", F.when(n % 4 == 0, F.lit("")).otherwise(F.col("text")))
    second = docs.where(n % 5 != 0).withColumn("text", F.when(n % 8 == 0, F.lit("")).otherwise(F.col("text")))
    return audit.better_parse(first, second, ["doc_id"]).select("doc_id", "verdict", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


BETTER_PARSE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS whole, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(text, '') END AS one, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN '' ELSE coalesce(text, '') END AS two FROM documents),
q AS (SELECT *, (length(regexp_replace(one, '^\s+|\s+$', '', 'g')) < 30)::INT AS e1, (length(regexp_replace(two, '^\s+|\s+$', '', 'g')) < 30)::INT AS e2,
  round(len(regexp_extract_all(one, '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]')) / greatest(length(one), 1), 4) AS g1, round(len(regexp_extract_all(two, '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]')) / greatest(length(two), 1), 4) AS g2 FROM d),
v AS (SELECT *, CASE WHEN NOT (e1 > 0.7 OR g1 > 0.02) THEN 'ok' WHEN two IS NULL THEN 'poor_no_fallback' WHEN e2 < e1 OR g2 < g1 THEN 'reparsed' ELSE 'poor_kept' END AS verdict FROM q)
SELECT doc_id, verdict, length(CASE WHEN verdict = 'reparsed' THEN two ELSE one END) AS n_chars FROM v
"""


def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each user as a job's files, of which every third has no result: its state."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.lit("pdf").alias("corpus"), F.lit("f").alias("name"), F.col("event_id").cast("string").alias("path"), (F.col("event_id") % 1000).alias("k"), F.col("ts").alias("at"), F.col("user_id").alias("u"))
    blank = lambda status: rows.select("job_id", "corpus", "name", "path", F.lit(status).alias("status"), F.lit(None).cast("long").alias("chunks"), F.lit(None).cast("double").alias("secs"), F.lit(None).cast("string").alias("error"), "at", "k", "u")
    status = F.when(F.col("k") % 7 == 0, "failed").when(F.col("k") % 5 == 0, "skipped").otherwise("done")
    over = blank("done").where("k % 3 <> 0 or u % 4 = 0").withColumns({"status": status, "chunks": F.col("k") % 10, "secs": (F.col("k") % 4).cast("double")})
    marks = blank("finalised").where("u % 2 = 0").unionByName(blank("cancel").where("u % 8 = 2"))
    log = blank("queued").unionByName(over).unionByName(marks).drop("k", "u")
    return jobs.states(log).select("job_id", "total", "done", "skipped", "failed", "chunks", "remaining", F.round("eta_secs", 6).alias("eta_secs"), "status")


JOB_STATES_SQL = """
WITH e AS (SELECT user_id AS u, event_id % 1000 AS k FROM events),
r AS (SELECT *, (k % 3 <> 0 OR u % 4 = 0) AS over FROM e),
s AS (SELECT u, count(*) AS total, count(*) FILTER (over AND k % 7 <> 0 AND k % 5 <> 0) AS done, count(*) FILTER (over AND k % 7 <> 0 AND k % 5 = 0) AS skipped, count(*) FILTER (over AND k % 7 = 0) AS failed,
  coalesce(sum(k % 10) FILTER (over), 0)::BIGINT AS chunks, count(*) FILTER (NOT over) AS remaining, coalesce(avg((k % 4)::DOUBLE) FILTER (over), 0) AS mean FROM r GROUP BY u)
SELECT u::VARCHAR AS job_id, total, done, skipped, failed, chunks, remaining, round(remaining * mean, 6) AS eta_secs,
  CASE WHEN u % 8 = 2 AND remaining = 0 THEN 'cancelled' WHEN u % 8 = 2 THEN 'cancelling' WHEN u % 2 <> 0 THEN 'staging' WHEN remaining = 0 THEN 'completed' WHEN remaining < total THEN 'running' ELSE 'queued' END AS status FROM s
"""


def answer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that name a nation, over chunks with tables: the nation's row first, then its table, then the other tables of the page."""
    made = _nation_tables(spark, sf, _named_nation()).join(table(spark, sf, "region").select(F.col("r_name").alias("chunk_id"), "r_regionkey"), "chunk_id")
    made = materialise(made, "tables")
    store = answers.Store(*tables.build_store(made))
    lines = F.array_join(F.transform("cells.rows", lambda r: F.array_join(r, " | ")), "\n")
    chunks = made.select("chunk_id", lines.alias("text"), F.col("source").alias("doc_source"), F.lit("table").alias("content_type"), F.lit("").alias("document_date"), F.lit(False).alias("has_metadata"), F.lit(1.0).alias("confidence"), F.lit(True).alias("has_cells"), F.lit("c").alias("corpus"), F.lit("nations").alias("document_id"), (F.col("r_regionkey") % 2).cast("int").alias("page"))
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit('where is "'), _named_nation(), F.lit('"')).alias("question"))
    out = answers.answer(chunks, asked, answers.Settings(dense=False), store=store)
    cited = out.select("query_id", F.explode("citations").alias("c"))
    kind = F.when(F.col("c.chunk_id").startswith("row:"), F.concat(F.lit("row of "), F.split("c.chunk_id", ":")[1])).otherwise(F.col("c.chunk_id"))
    return cited.select("query_id", F.col("c.ref").cast("int").alias("rank"), kind.alias("cited"))


ANSWER_ROWS_SQL = """
WITH r AS (SELECT r_name, r_regionkey % 2 AS page, r_regionkey FROM region),
n AS (SELECT n_nationkey AS query_id, r_name, page FROM nation JOIN r ON n_regionkey = r_regionkey)
SELECT query_id, CAST(1 AS INTEGER) AS rank, 'row of ' || r_name AS cited FROM n
UNION ALL SELECT query_id, CAST(2 AS INTEGER), r_name FROM n
UNION ALL SELECT query_id, CAST(2 + row_number() OVER (PARTITION BY query_id ORDER BY r.r_name) AS INTEGER), r.r_name FROM n JOIN r ON r.page = n.page AND r.r_name <> n.r_name
"""


def derived_words(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of words kept for documents, of which one in a hundred has changed, some are new and some are gone since."""
    docs, root = table(spark, sf, "documents").select("doc_id", "text"), new_path(spark, "kept")
    older = docs.where("doc_id % 100 <> 2").withColumn("text", F.when(F.col("doc_id") % 100 == 1, F.concat(F.lit("former "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    older = older.unionByName(docs.where("doc_id % 100 = 3").withColumn("doc_id", -1 - F.col("doc_id")))
    count = lambda rows: rows.select("doc_id", F.size(T.content_tokens(F.col("text"))).alias("n_words"))
    derived.refresh(older, root, "older", "doc_id", count)
    return derived.refresh(docs, root, "newer", "doc_id", count)


DERIVED_WORDS_SQL = f"SELECT doc_id, CAST(len({WORDS_SQL.format('text')}) AS INTEGER) AS n_words FROM documents"


def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in a store, written in two batches, the first of them twice; in the second every seventh has another name, every eleventh is deleted."""
    path = new_path(spark, "store")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("payload"))
    store.put(rows, path, "first")
    store.put(rows, path, "first")
    later = rows.where("id % 7 = 0 or id % 11 = 0")
    store.put(later.withColumn("payload", F.when(F.col("id") % 11 != 0, F.concat(F.lit("now "), "payload"))), path, "second")
    return store.get(spark, path)


STORE_ROUND_TRIP_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN 'now ' || c_name ELSE c_name END AS payload,
       CASE WHEN c_custkey % 7 = 0 THEN 'second' ELSE 'first' END AS batch FROM customer WHERE c_custkey % 11 <> 0
"""


def _arrivals(spark: SparkSession, runs: list[DataFrame], query) -> DataFrame:
    """What a stream's query writes in runs of its own, one for each table that arrives, each from the last one's checkpoint."""
    source, sink, checkpoint = (new_path(spark, x) for x in ("arrivals", "written", "state"))
    for rows in runs:
        rows.write.mode("append").parquet(source)
        state.run(query(spark.readStream.schema(rows.schema).parquet(source)), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink)


def journal_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in two runs of a stream: a third first, then all, every fifth of them with another text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = docs.where("doc_id % 3 = 0").withColumn("seq", F.lit(1).cast("long"))
    again = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("now "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))).withColumn("seq", F.lit(2).cast("long"))
    found = _arrivals(spark, [first, again], lambda s: state.journal_stream(s, "doc_id"))
    return found.select("id", "seq", "status")


JOURNAL_STREAM_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS seq, 'new' AS status FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CAST(2 AS BIGINT), CASE WHEN doc_id % 3 <> 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END FROM documents
"""


def registry_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts by brand, resolved as they arrive in three runs of a stream."""
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_partkey").cast("long").alias("seq"))
    ends = rows.selectExpr("percentile(seq, array(0.3, 0.8))").first()[0] or [0, 0]
    runs = [rows.where(F.col("seq") <= ends[0]), rows.where((F.col("seq") > ends[0]) & (F.col("seq") <= ends[1])), rows.where(F.col("seq") > ends[1])]
    return _arrivals(spark, runs, state.resolve_stream).distinct().select("name", "type", "canonical")


QUERIES = {
    "derived_words": derived_words,
    "store_round_trip": store_round_trip,
    "answer_rows": answer_rows,
    "journal_stream": journal_stream,
    "registry_stream": registry_stream,
    "summary_anchors": summary_anchors,
    "better_parse": better_parse,
    "job_states": job_states,
    "ingest_documents": ingest_documents,
    "ingest_graph": ingest_graph,
    "answer_scores": answer_scores,
    "regression_gate": regression_gate,
    "table_rows": table_rows,
    "table_families": table_families,
    "row_lookup": row_lookup,
    "table_sql": table_sql,
    "job_stats": job_stats,
    "event_windows": event_windows,
    "event_sessions": event_sessions,
    "stream_windows": stream_windows,
    "manifest_actions": manifest_actions,
    "upsert_documents": upsert_documents,
    "answer_checks": answer_checks,
    "entity_pairs": entity_pairs,
    "document_detail": document_detail,
}

SQL = {
    "derived_words": DERIVED_WORDS_SQL,
    "store_round_trip": STORE_ROUND_TRIP_SQL,
    "answer_rows": ANSWER_ROWS_SQL,
    "journal_stream": JOURNAL_STREAM_SQL,
    "summary_anchors": SUMMARY_ANCHORS_SQL,
    "better_parse": BETTER_PARSE_SQL,
    "job_states": JOB_STATES_SQL,
    "ingest_documents": INGEST_DOCUMENTS_SQL,
    "answer_scores": ANSWER_SCORES_SQL,
    "regression_gate": REGRESSION_GATE_SQL,
    "table_rows": TABLE_ROWS_SQL,
    "row_lookup": ROW_LOOKUP_SQL,
    "table_sql": TABLE_SQL_SQL,
    "job_stats": JOB_STATS_SQL,
    "event_windows": EVENT_WINDOWS_SQL,
    "event_sessions": EVENT_SESSIONS_SQL,
    "stream_windows": EVENT_WINDOWS_SQL,
    "manifest_actions": MANIFEST_ACTIONS_SQL,
    "upsert_documents": UPSERT_DOCUMENTS_SQL,
    "answer_checks": ANSWER_CHECKS_SQL,
    "entity_pairs": ENTITY_PAIRS_SQL,
    "document_detail": DOCUMENT_DETAIL_SQL,
}
