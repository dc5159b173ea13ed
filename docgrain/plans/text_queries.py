"""Queries of the text, HTML, audit and planning operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.functions import vectors as V
from docgrain.operators import audit, chunking, metadata, resolution
from docgrain.plans import planner
from docgrain.session import spread, table
from docgrain.sources import files, html

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
#: Content tokens of a column, in SQL.
WORDS_SQL = (
    "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+'), lambda t: lower(t)), "
    f"lambda t: length(t) > 1 AND t NOT IN ({STOP_SQL}))"
)
STRIP_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    words = T.content_tokens(F.col("text"))
    return docs.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(words).cast("long").alias("n_content"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


TOKEN_STATS_SQL = f"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS n_tokens,
       len({WORDS_SQL.format('text')}) AS n_content, len(list_distinct({WORDS_SQL.format('text')})) AS n_distinct
FROM documents
"""


def source_names(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.collect_set("lang").alias("langs"))
    return docs.select("source", "n_docs", T.document_id(F.col("source")).alias("document_id"), T.set_hash(F.col("langs")).alias("langs_hash"))


SOURCE_NAMES_SQL = """
SELECT source, count(*) AS n_docs, substr(md5(source), 1, 12) AS document_id,
       substr(md5(array_to_string(list_sort(list_distinct(list(lang))), '|')), 1, 16) AS langs_hash
FROM documents GROUP BY source
"""


def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exact_dedup(table(spark, sf, "documents").select("doc_id", "text", "source")).select("doc_id", "source")


EXACT_DEDUP_SQL = "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1"


def chunk_quality(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.chunk_quality(t).alias("quality"), T.gate_allows(t, F.lit("text"), F.lit("text")).alias("allowed"), T.needs_ocr(t).alias("needs_ocr"))


CHUNK_QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {STRIP_SQL.format("coalesce(text, '')")} AS s,
         {STRIP_SQL.format("regexp_replace(coalesce(text, ''), 'https?://[^\\t\\n\\f\\r ]+', '', 'g')")} AS bare FROM documents
), m AS (
  SELECT *, greatest(1, len(list_filter(string_split(t, chr(10)), lambda x: length({STRIP_SQL.format('x')}) > 0))) AS lines,
         len(regexp_extract_all(t, '(?i)\d{{1,2}}/\d{{1,2}}/\d{{2,4}},?\s*\d{{1,2}}:\d{{2}}\s*(?:AM|PM)?')) AS stamps,
         len(regexp_extract_all(t, '(?mi)^\s*\d+[\.\)]\s+(?:Table|Chart|Figure|Appendix|Graph|Section)\b')) AS toc,
         len(regexp_extract_all(t, '(?m)^\s*\d+(?:\.\d+)*\s+\w.*\s{{4,}}\d+\s*$')) AS outl
  FROM d
), q AS (
  SELECT *, CASE WHEN length(s) < 60 THEN 0.15 WHEN starts_with(t, '[DOC SUMMARY') THEN 0.20 WHEN length(bare) < 50 THEN 0.10
    WHEN stamps >= 1 AND length({STRIP_SQL.format("replace(bare, chr(10), '')")}) < 120 THEN 0.15
    WHEN toc >= 2 AND toc / lines >= 0.25 THEN 0.20 WHEN outl >= 3 AND outl / lines >= 0.30 THEN 0.20 ELSE 1.0 END AS quality
  FROM m
)
SELECT doc_id, CAST(quality AS DOUBLE) AS quality,
       CASE WHEN starts_with(s, '[DOC SUMMARY') THEN true WHEN length(s) < 60 THEN NOT contains(lower(s), 'http') ELSE quality > 0.25 END AS allowed,
       length(regexp_replace(t, '\s', '', 'g')) < 25 AS needs_ocr
FROM q
"""


def redact(spark: SparkSession, sf: str) -> DataFrame:
    g = T.guardrail(F.col("text"), ["worthless"])
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", g.alias("g"))
    return rows.select("doc_id", F.md5("g.text").alias("text_md5"), F.col("g.blocked").alias("blocked"), F.array_join("g.reasons", ",").alias("reasons"))


def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.lit("supplier").alias("type"), F.col("s_name").alias("name"))
    for name, column in (("customer", "c_name"), ("part", "p_name")):
        rows = rows.unionByName(table(spark, sf, name).select(F.lit(name).alias("type"), F.col(column).alias("name")))
    name = F.col("name")
    return rows.select("type", "name", T.entity_name(name).alias("canonical"), T.node_key(name).alias("key"), T.is_junk_name(name).alias("junk"))


def _names_sql() -> str:
    suffixes = "|".join(T.CORPORATE_SUFFIXES)
    cases = " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in T.ALIASES.items())
    words = ", ".join(f"'{w}'" for w in [*T.MONTHS, *T.WEEKDAYS, *T.GENERIC_NAMES])
    return rf"""
WITH n AS (
  SELECT 'supplier' AS type, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'part', p_name FROM part
), f AS (
  SELECT type, name, {STRIP_SQL.format("coalesce(name, '')")} AS s,
         trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({STRIP_SQL.format("coalesce(name, '')")}), '&', ' and '), '[.,/]', ' ', 'g'), '\b(?:{suffixes})\b', ' ', 'g'), '\s+', ' ', 'g')) AS c
  FROM n
), k AS (SELECT *, lower(regexp_replace(s, '\s+', ' ', 'g')) AS key FROM f)
SELECT type, name, CASE {cases} ELSE c END AS canonical, key,
       length(key) < 3 OR regexp_matches(s, '[\n\t]') OR key IN ({words}) OR regexp_matches(key, '^(q[1-4]|fy\d{{2,4}}|[12]\d{{3}}|\d{{1,4}}(st|nd|rd|th)?)$')
         OR length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) / greatest(length(s), 1) < 0.4 OR length(s) > 80 AS junk
FROM k
"""


def entity_resolve(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_partkey").alias("seq"))
    return resolution.resolve(rows)


def document_dates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.first_date(t).alias("first_date"), T.first_year(t).alias("first_year"), T.location(t).alias("location"))


DOCUMENT_DATES_SQL = r"""
SELECT doc_id,
  regexp_extract(coalesce(text, ''), '\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b') AS first_date,
  regexp_extract(coalesce(text, ''), '\b(?:19|20)\d{2}\b') AS first_year,
  CASE WHEN regexp_matches(coalesce(text, ''), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,\s*[A-Z]{2}\b')
       THEN regexp_extract(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})\b', 1) || ', ' || regexp_extract(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})\b', 2) ELSE '' END AS location
FROM documents
"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id").select("doc_id", "ordinal", "chunk_id", "heading", "content_type", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    rows = metadata.enrich(spread(table(spark, sf, "documents")).select("doc_id", "text", F.lit("text").alias("content_type"), F.col("source").alias("source_name")))
    lists = [F.array_join(c, "|").alias(c) for c in ("manufacturers", "sellers", "buyers", "entities", "organizations")]
    return rows.select("doc_id", "document_date", "incident_date", "location", "case_reference", "report_type", "us_state", "item_type", "incident_type", *lists)


def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.hash_embedding(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")
    return rows.select("doc_id", "slot", F.round("weight", 6).alias("weight"))


HASH_EMBEDDING_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents),
g AS (
  SELECT doc_id, unnest(w) AS gram FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM w
), h AS (
  SELECT doc_id, md5(gram) AS m FROM g
), s AS (
  SELECT doc_id, CAST((256 * (CAST('0x' || substr(m, 1, 8) AS BIGINT) + CAST('0x' || substr(m, 9, 8) AS BIGINT) + CAST('0x' || substr(m, 17, 8) AS BIGINT))
         + CAST('0x' || substr(m, 25, 8) AS BIGINT)) % 384 AS INTEGER) AS slot,
         CASE WHEN (CAST('0x' || substr(m, 25, 8) AS BIGINT) >> 8) & 1 = 0 THEN 1 ELSE -1 END AS sign FROM h
), a AS (SELECT doc_id, slot, sum(sign) AS raw FROM s GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM a GROUP BY doc_id)
SELECT doc_id, slot, round(CAST(raw AS DOUBLE) / norm, 6) AS weight FROM a JOIN n USING (doc_id) WHERE raw <> 0
"""


def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", html.title(h).alias("title"), F.array_join(html.headings(h), "|").alias("headings"), F.size(html.links(h)).cast("long").alias("n_links"), F.array_join(html.links(h), "|").alias("links"), html.meta_date(h).alias("meta_date"))


HTML_FIELDS_SQL = r"""
WITH x AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  array_to_string(list_transform(regexp_extract_all(h, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1)[1:10], lambda s: trim(regexp_replace(s, '(?s)<[^>]*>', '', 'g'))), '|') AS headings,
  len(regexp_extract_all(h, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS n_links,
  array_to_string(regexp_extract_all(h, '(?i)<a\s[^>]*?href="([^"]*)"', 1), '|') AS links,
  regexp_extract(h, '(?i)<meta[^>]*(?:name|property)="[^"]*(?:date|time)[^"]*"[^>]*content="([^"]*)"', 1) AS meta_date
FROM x
"""


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", html.html_text("html").alias("t"))
    return rows.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def source_routes(spark: SparkSession, sf: str) -> DataFrame:
    r = files.route(F.col("url"))
    return table(spark, sf, "pages").select("page_id", r["kind"].alias("kind"), r["corpus"].alias("corpus"), T.domain_tier(F.col("url")).alias("tier"))


SOURCE_ROUTES_SQL = r"""
WITH u AS (
  SELECT page_id, url, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1)) AS ext,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages
), k AS (
  SELECT *, CASE WHEN regexp_matches(url, '^https?://') AND regexp_matches(lower(url), 'sitemap[^/]*\.xml') THEN 'sitemap'
    WHEN regexp_matches(url, '^https?://') AND ext <> 'pdf' THEN 'url' WHEN ext = 'pdf' THEN 'pdf'
    WHEN ext IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'tiff', 'webp') THEN 'image' WHEN ext IN ('html', 'htm') THEN 'html'
    WHEN ext IN ('txt', 'md', 'markdown') THEN 'text' WHEN ends_with(url, '/') THEN 'dir' ELSE 'unknown' END AS kind FROM u
)
SELECT page_id, kind, CASE WHEN kind IN ('sitemap', 'url', 'html') THEN 'web' WHEN kind = 'image' THEN 'visual' ELSE 'pdf' END AS corpus,
  CAST(CASE WHEN regexp_matches(host, '\.(gov|mil)$') THEN 1.0 WHEN regexp_matches(host, '\.edu$') THEN 0.9
       WHEN regexp_matches(host, 'blogspot|medium\.com|substack|wordpress|reddit|quora|facebook|twitter|pinterest') THEN 0.4 ELSE 0.65 END AS DOUBLE) AS tier
FROM k
"""


def document_catalog(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars")
    rows = audit.document_catalog(docs, ("source",), "lang", "doc_id", "n_chars")
    entries = F.transform(F.map_entries("content_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return rows.select("source", "n_chunks", "n_pages", "last_seen", F.array_join(F.array_sort(entries), ",").alias("types"))


DOCUMENT_CATALOG_SQL = """
WITH t AS (SELECT source, coalesce(lang, '') AS lang, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT source, array_to_string(list_sort(list(lang || ':' || n)), ',') AS types FROM t GROUP BY source)
SELECT d.source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_pages, max(n_chars) AS last_seen, any_value(s.types) AS types
FROM documents d JOIN s ON s.source IS NOT DISTINCT FROM d.source GROUP BY d.source
"""


def metadata_coverage(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left").select("source", "text", "lang", "quality", "toxic")
    out = audit.metadata_verdict(audit.coverage(rows, ["text", "lang", "quality", "toxic"], ["source"]), ["text", "lang", "quality"])
    return out.select("source", "n_rows", "text", "lang", "quality", "toxic", F.array_join("missing", ",").alias("missing"), "verdict")


METADATA_COVERAGE_SQL = """
WITH r AS (
  SELECT source, count(*) AS n_rows, round(avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END), 2) AS text, round(avg(CASE WHEN lang <> '' THEN 1.0 ELSE 0.0 END), 2) AS lang,
         round(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) AS quality, round(avg(CASE WHEN toxic IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) AS toxic
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
), m AS (SELECT *, list_filter([CASE WHEN text < 0.9 THEN 'text' END, CASE WHEN lang < 0.9 THEN 'lang' END, CASE WHEN quality < 0.9 THEN 'quality' END], lambda x: x IS NOT NULL) AS missing FROM r)
SELECT source, n_rows, text, lang, quality, toxic, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN 'ok' ELSE 'gaps' END AS verdict FROM m
"""


def parse_quality(spark: SparkSession, sf: str) -> DataFrame:
    return audit.parse_quality(table(spark, sf, "documents"), ["source", "lang"])


PARSE_QUALITY_SQL = rf"""
WITH p AS (SELECT source, lang, CASE WHEN length({STRIP_SQL.format("coalesce(text, '')")}) < 30 THEN 1 ELSE 0 END AS e, length(coalesce(text, '')) AS n,
  len(regexp_extract_all(coalesce(text, ''), '[\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F]')) AS g FROM documents)
SELECT source, lang, count(*) AS n_pages, round(avg(e), 3) AS empty_ratio, round(sum(g) / greatest(sum(n), 1), 4) AS garble_ratio,
  CAST(floor(sum(n) / count(*)) AS BIGINT) AS avg_chars, round(avg(e), 3) > 0.7 OR round(sum(g) / greatest(sum(n), 1), 4) > 0.02 AS bad
FROM p GROUP BY ALL
"""


def answer_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of each reply that the turn before it does not contain, and the reply's claims."""
    turns = table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    rows = turns.join(before, ["conv_id", "turn"])
    text = F.col("text")
    return rows.select("conv_id", "turn", F.array_join(T.unsupported_numbers(text, F.col("context")), ",").alias("unsupported"), F.size(T.claims(text)).cast("long").alias("n_claims"))


def plan_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "conversations")).select("conv_id", "turn", F.col("text").alias("question"))
    return planner.plan_questions(rows).select("conv_id", "turn", "intent", "use_graph", "use_metadata", "domain", "mode")


def _plan_sql() -> str:
    any_of = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
    p = planner
    intent = "'fact'"
    for words, name in ((p.RELATION, "relationship"), (p.TIMELINE, "timeline"), (p.TABLE, "table"), (p.VISUAL, "visual"), (p.ENTITY, "entity"), (p.ALL, "multi")):
        intent = f"CASE WHEN {any_of(words)} THEN '{name}' ELSE {intent} END"
    domain = "''"
    for name, words in p.DOMAINS:
        domain = f"CASE WHEN {any_of(words)} THEN '{name}' ELSE {domain} END"
    pattern = "(contains(q, 'pattern') OR contains(q, 'across'))"
    return rf"""
WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations),
i AS (SELECT *, {intent} AS i0 FROM c),
j AS (SELECT *, CASE WHEN {any_of(p.MANUFACTURE)} THEN 'table' WHEN {pattern} AND i0 IN ('fact', 'entity') THEN 'pattern' ELSE i0 END AS intent, regexp_matches(q, '\b(?:19|20)\d{{2}}\b') AS y FROM i),
k AS (SELECT *, {any_of(p.GLOBAL)} OR intent = 'multi' AS g FROM j)
SELECT conv_id, turn, intent, {any_of(p.RELATION)} OR {any_of(p.TIMELINE)} OR {any_of(p.ENTITY)} OR {pattern} AS use_graph,
  {any_of(p.TIMELINE)} OR y OR contains(q, ' in 20') AS use_metadata, {domain} AS domain,
  CASE WHEN g AND (y OR intent = 'table') THEN 'mixed' WHEN g THEN 'global' WHEN intent IN ('relationship', 'pattern') THEN 'mixed' ELSE 'local' END AS mode
FROM k
"""


NUMBERS_SQL = (
    r"list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce({0}, ''), '\[\d+\]|\(?\bp(?:age|\.)?\s*\d+\)?', ' ', 'g'), '\d[\d,]*\.?\d*'), "
    r"lambda x: regexp_replace(x, '[.,]+$', '')), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^(?:19|20)\d{{2}}$'))"
)
ANSWER_GROUNDING_SQL = rf"""
WITH r AS (
  SELECT a.conv_id, a.turn, a.text, replace(coalesce(b.text, ''), ',', '') AS context FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn
), x AS (
  -- RE2 has no look-behind: the stop before a cut is kept by a mark.
  SELECT *, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.;])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+') AS parts FROM r
)
SELECT conv_id, turn, array_to_string(list_filter({NUMBERS_SQL.format('text')}, lambda x: NOT contains(context, replace(x, ',', ''))), ',') AS unsupported,
  least(6, len(list_filter(parts, lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g')) > 8))) AS n_claims FROM x
"""


def report_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Report type, incident type and state of each page's URL and text."""
    t = F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    rows = table(spark, sf, "pages").select("page_id", t.alias("t"))
    hits = T.vocabulary_hits(F.col("t"), metadata.INCIDENT_TYPES)
    return rows.select("page_id", T.first_label(F.col("t"), metadata.REPORT_TYPES).alias("report_type"), metadata.state(F.col("t"), list(metadata.STATES)).alias("us_state"), F.array_join(hits, "|").alias("incidents"))


def _labels_sql() -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(l, {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{name}'" for name, keys in metadata.REPORT_TYPES)
    words = ", ".join(f"'{w}'" for w in sorted(metadata.INCIDENT_TYPES))
    states = "|".join(sorted(metadata.STATES, key=lambda n: (-len(n), n)))
    return rf"""
WITH p AS (SELECT page_id, lower(coalesce(url, '') || ' ' || coalesce(html, '')) AS l FROM pages),
s AS (SELECT *, regexp_extract(l, '\b({states})\b', 1) AS st FROM p)
SELECT page_id, CASE {cases} ELSE '' END AS report_type,
  array_to_string(list_transform(string_split(st, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS us_state,
  array_to_string(list_filter([{words}], lambda w: contains(l, w)), '|') AS incidents FROM s
"""


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of requested hosts: half of the requests give an id, half a name."""
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("chunk_id"), T.document_id(host).alias("document_id"), host.alias("source_name"))
    wanted = table(spark, sf, "pages").where("page_id % 100 = 0").select(F.col("page_id").alias("request"), host.alias("source_name"))
    wanted = wanted.withColumn("document_id", F.when(F.col("request") % 200 == 0, T.document_id(F.col("source_name"))))
    return audit.document_chunks(rows, wanted).select("request", "chunk_id")


DOCUMENT_CHUNKS_SQL = """
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)
SELECT a.page_id AS request, b.page_id AS chunk_id FROM p a JOIN p b ON a.host = b.host WHERE a.page_id % 100 = 0
"""


def store_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.md5("text").alias("document_id"), F.when(F.col("lang") == "en", "table").otherwise("text").alias("content_type"), F.when(F.length("text") > 500, F.lit("x")).alias("cells"))
    return audit.store_counts(rows)


STORE_COUNTS_SQL = """
SELECT source AS corpus, count(*) AS chunks, count(DISTINCT md5(text)) AS documents, count(*) FILTER (lang = 'en') AS tables, count(*) FILTER (length(text) > 500) AS cells
FROM documents GROUP BY source
"""


def metadata_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Share of customers' and documents' fields that are filled, by language, with the critical ones that fall short."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    shares = audit.coverage(rows, ["text", "source", "quality"], ["lang"])
    out = audit.metadata_verdict(shares, ["text", "quality"])
    return out.select("lang", "n_rows", "text", "source", "quality", F.array_join("missing", ",").alias("missing"), "verdict")


METADATA_GAPS_SQL = """
WITH d AS (SELECT lang, count(*) AS n_rows, round(avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END), 2) AS text, round(avg(CASE WHEN source <> '' THEN 1.0 ELSE 0.0 END), 2) AS source,
  round(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 2) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT *, concat_ws(',', CASE WHEN text < 0.9 THEN 'text' END, CASE WHEN quality < 0.9 THEN 'quality' END) AS missing,
  CASE WHEN text < 0.9 OR quality < 0.9 THEN 'gaps' ELSE 'ok' END AS verdict FROM d
"""


QUERIES = {
    "token_stats": token_stats,
    "source_names": source_names,
    "exact_dedup": exact_dedup,
    "chunk_quality": chunk_quality,
    "pii_guardrail": redact,
    "entity_names": entity_names,
    "entity_resolve": entity_resolve,
    "document_dates": document_dates,
    "chunks": chunks,
    "enriched_metadata": enriched,
    "hash_embedding": hash_embedding,
    "html_fields": html_fields,
    "html_text": html_text,
    "source_routes": source_routes,
    "document_catalog": document_catalog,
    "metadata_coverage": metadata_coverage,
    "parse_quality": parse_quality,
    "answer_grounding": answer_grounding,
    "report_labels": report_labels,
    "document_chunks": document_chunks,
    "store_counts": store_counts,
    "metadata_gaps": metadata_gaps,
    "plan_questions": plan_questions,
}

SQL = {
    "answer_grounding": ANSWER_GROUNDING_SQL,
    "report_labels": _labels_sql(),
    "document_chunks": DOCUMENT_CHUNKS_SQL,
    "store_counts": STORE_COUNTS_SQL,
    "metadata_gaps": METADATA_GAPS_SQL,
    "token_stats": TOKEN_STATS_SQL,
    "source_names": SOURCE_NAMES_SQL,
    "exact_dedup": EXACT_DEDUP_SQL,
    "chunk_quality": CHUNK_QUALITY_SQL,
    "entity_names": _names_sql(),
    "document_dates": DOCUMENT_DATES_SQL,
    "hash_embedding": HASH_EMBEDDING_SQL,
    "html_fields": HTML_FIELDS_SQL,
    "source_routes": SOURCE_ROUTES_SQL,
    "document_catalog": DOCUMENT_CATALOG_SQL,
    "metadata_coverage": METADATA_COVERAGE_SQL,
    "parse_quality": PARSE_QUALITY_SQL,
    "plan_questions": _plan_sql(),
}
