"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes.

DataFrame functions only. A URL is expanded into every (host suffix, path prefix) expression whose number of
labels and path length some rule has; expressions meet rules on the first eight hex digits of their SHA-256, and a match
counts only where the full digests agree. Of the rules that fit, the longest host and path win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast (about 200 bytes each); beyond it the join is shuffled and salted.
BROADCAST_RULES = 200_000
#: Copies of each rule, and shares of the URLs, in the shuffled join: splits hosts that hold much of the table.
SALTS = 32
#: Hex digits of the digest that the join compares.
PREFIX = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) as (prefix, digest, rule, action, path_len, labels).

    Hosts are lower-cased; rows with a null host, path or action are no rules. Of equal host and path,
    ``allow`` wins over ``block``. A rule's path begins with ``/``, its text is host and path joined.
    """
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), F.col("action").alias("a"))
    clean = clean.dropna().groupBy("h", "p").agg(F.min("a").alias("action"))
    digest = F.sha2(F.concat_ws("\n", "h", "p"), 256)
    return clean.select(
        F.substring(digest, 1, PREFIX).alias("prefix"),
        digest.alias("digest"),
        F.concat("h", "p").alias("rule"),
        "action",
        F.length("p").alias("path_len"),
        (F.length("h") - F.length(F.replace("h", F.lit("."))) + 1).alias("labels"),
    )


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of digests of the (host suffix, path prefix) expressions of these shapes (labels, path length) that a URL has.

    A suffix is taken from the host's end, so that a host of many labels costs no more than its length.
    """
    n = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1

    def one(labels: int, size: int) -> Column:
        text = F.concat_ws("\n", F.substring_index(host, ".", -labels), F.substring(path, 1, size))
        return F.when((n >= labels) & (F.length(path) >= size), F.sha2(text, 256))

    return F.array_compact(F.array(*[one(*s) for s in shapes]))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for every row of ``pages``: (id, url, host, path, rule, verdict).

    A rule fits its host and all its subdomains where the URL's path starts with the rule's path; the
    longest rule text wins, then the longer path. Rows without a fitting rule get ``default`` and a null
    rule. Null or malformed URLs have empty host and path and can only get ``default``. Repeated rows are
    all returned; null ids are kept. Other columns of ``pages`` are not read. No rules: all ``default``.
    """
    spark = pages.sparkSession
    compiled = compile_rules(rules)
    # At most one row for each shape, and these are bounded by the longest rule.
    seen = compiled.groupBy("labels", "path_len").count().collect()
    shapes = sorted((row["labels"], row["path_len"]) for row in seen)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    if not shapes:
        judged = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
        return judged.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", "verdict")

    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # rows stand for themselves: copies are spread like any other
    exploded = numbered.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), shapes)).alias("digest_u"))
    exploded = exploded.withColumn("prefix", F.substring("digest_u", 1, PREFIX))
    if sum(row["count"] for row in seen) <= BROADCAST_RULES:
        joined = exploded.join(F.broadcast(compiled), "prefix", "left")
    else:
        exploded = exploded.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        salted = compiled.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = exploded.join(salted, ["prefix", "salt"], "left")
    fits = F.col("digest_u") == F.col("digest")  # the full digest confirms the short prefix
    rank = F.when(fits, F.struct(F.length("rule").alias("n"), "path_len", "rule", "action"))
    best = joined.groupBy("row", "id", "url", "host", "path").agg(F.max(rank).alias("best"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
