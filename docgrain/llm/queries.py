"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.llm import decontam, embed_dedup, fim, hard_negatives, langid, lmscore, mixing, packing, pii, quality, simhash, urlfilter, warc
from docgrain.session import spread

#: Rules of the URL query: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores also where they are in one file."""
    return spread(_read(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors."""
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.with_pii(_documents(spark, sf_dir).select("doc_id", "text"))
    base, spans = F.col("pii.base"), F.col("pii.spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(spans).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontam.with_hits(_documents(spark, sf_dir).select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    hits = F.col("hits")
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hits["items"]), 256).alias("items_sha256"),
        decontam.is_contaminated(hits).alias("contaminated"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = urlfilter.judge_urls(_read(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it is kept."""
    scored = quality.with_quality(_documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", F.col("quality").alias("score"), (F.col("quality") >= 0.5).alias("kept"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.simhash_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return langid.identify(_documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    back = warc.archive_pages(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    scored = lmscore.with_scores(_documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "lm.n_tokens", "lm.log_prob", "lm.mean_log_prob")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mixture of all documents: a row for each use of a document."""
    return mixing.mix(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    vectors = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document for fill-in-middle training, and put together again."""
    made = fim.fill_in_middle(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fim.*")
    sha = lambda text: F.sha2(text, 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents, tokenised and packed into sequences of 2,048; ``tokenizer`` is the path of a JSON file on the driver."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_documents(spark, sf_dir), Path(tokenizer).read_text(encoding="utf-8"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_pii": op2_pii,
        "op3_decontamination": op3_decontamination,
        "op4_url_filter": op4_url_filter,
        "op5_quality": op5_quality,
        "op6_simhash_dedup": op6_simhash_dedup,
        "op7_language": op7_language,
        "op8_warc": op8_warc,
        "op9_lm_score": op9_lm_score,
        "op10_mixing": op10_mixing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_packing": op13_packing,
    }


URL_SQL = """
WITH rules(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), rest AS (
  SELECT page_id, row_number() OVER () AS rid,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages
), parts AS (
  SELECT page_id, rid,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), best AS (
  SELECT p.page_id, p.rid, p.host, p.path,
         arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(action, length(rhost || rpath)) AS action
  FROM parts p LEFT JOIN rules
    ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT rid, vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b, a.vec_id AS va, b.vec_id AS vb
  FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(rid, vec_id) AS (
  SELECT rid, vec_id FROM v
  UNION
  SELECT p.a, r.vec_id FROM reach r JOIN pairs p ON p.b = r.rid
), links AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT v.vec_id, coalesce(any_value(l.n), 0) AS n_links, min(r.vec_id) AS component_id, v.vec_id = min(r.vec_id) AS kept
FROM v JOIN reach r ON r.rid = v.rid LEFT JOIN links l ON l.a = v.rid
GROUP BY v.rid, v.vec_id
"""

DECONTAMINATION_SQL = """
WITH low AS (
  SELECT row_number() OVER () AS rid, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), doc AS (
  SELECT rid, doc_id, regexp_extract_all(t, '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM low
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM sized)
), starts AS (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p
  FROM doc CROSS JOIN (SELECT DISTINCT n FROM windows)
  WHERE len(w) >= n
), met AS (
  SELECT s.rid, s.p, s.n, g.item_id
  FROM starts s JOIN windows g ON g.n = s.n AND g.gram = array_to_string(s.w[s.p:s.p + s.n - 1], ' ')
), hit AS (
  SELECT rid, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS q FROM met) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM met WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN hit h USING (rid) LEFT JOIN named m USING (rid)
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         sha256(coalesce(html, '')) AS k
  FROM pages
), g AS (
  SELECT k, max(page_id) AS last FROM p GROUP BY k
)
SELECT p.page_id, p.payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN p.page_id = g.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = g.last THEN NULL ELSE g.last END AS refers_to
FROM p JOIN g USING (k)
"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings
), ok AS (
  SELECT rid, vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id, a.label = b.label AS same,
         CASE WHEN len(a.e) = 0 THEN 0 ELSE CAST(list_dot_product(a.e, b.e) AS BIGINT) END AS s
  FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY rank <= 5
"""

MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS d3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d4
  FROM d
), parts AS (
  SELECT doc_id, t, n,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 90 THEN 'plain'
              WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(w[1:least(c1, c2)], ''), '') AS p,
         coalesce(array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m,
         coalesce(array_to_string(w[greatest(c1, c2) + 1:], ''), '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op1_embedding_dedup": EMBEDDING_SQL,
        "op3_decontamination": DECONTAMINATION_SQL,
        "op4_url_filter": URL_SQL,
        "op8_warc": WARC_SQL,
        "op11_hard_negatives": NEGATIVES_SQL,
        "op12_fill_in_middle": MIDDLE_SQL,
    }
