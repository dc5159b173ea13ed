"""Ranking metrics and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the loss of a metric that the gate accepts.
ALLOWED_DROP = 0.02


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k_recall: int = 5, k_precision: int = 5, k_ndcg: int = 10) -> DataFrame:
    """(query_id, recall, precision, ndcg, mrr) of ranked (query_id, item, rank from 1) and relevant (query_id, item).

    Recall counts distinct relevant items, and is 0 without any; precision divides by what was returned; the ideal of
    NDCG has as many hits as there are relevant items, up to k; MRR looks at any depth. Queries come from ``ranked``.
    """
    rel = relevant.where("item is not null").select("query_id", "item").distinct().withColumn("hit", F.lit(1))
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    rows = ranked.join(rel, ["query_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return judged_metrics(rows, sizes, k_recall, k_precision, k_ndcg)


def judged_metrics(rows: DataFrame, sizes: DataFrame, k_recall: int = 5, k_precision: int = 5, k_ndcg: int = 10) -> DataFrame:
    """:func:`ranking_metrics` of ranked rows that say whether they are a ``hit`` (0 or 1), and sizes (query_id, n_rel).

    For relevance that follows from a column of the items: its pairs with the queries need not be listed.
    """
    discount = F.col("hit") / F.log2(F.col("rank") + 1)
    per = rows.groupBy("query_id").agg(
        F.count_distinct(F.when((F.col("hit") == 1) & (F.col("rank") <= k_recall), F.col("item"))).alias("found"),
        F.sum(F.when(F.col("rank") <= k_precision, F.col("hit"))).alias("precise"),
        F.count(F.when(F.col("rank") <= k_precision, 1)).alias("returned"),
        F.sum(F.when(F.col("rank") <= k_ndcg, discount).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    per = per.join(sizes, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_rel", F.lit(k_ndcg)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    none = F.col("n_rel") == 0
    return per.select(
        "query_id",
        F.when(none, 0.0).otherwise(F.col("found") / F.col("n_rel")).alias("recall"),
        F.when(F.col("returned") == 0, 0.0).otherwise(F.col("precise") / F.col("returned")).alias("precision"),
        F.when(none, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def summary(metrics: DataFrame, names: tuple[str, ...] = ("recall", "precision", "ndcg", "mrr")) -> DataFrame:
    """Means of metrics, nulls left out, rounded to 4 places; 0 for an empty table."""
    return metrics.agg(*[F.coalesce(F.round(F.avg(n), 4), F.lit(0.0)).alias(n) for n in names])


def gate(current: DataFrame, baseline: DataFrame, drop: float = ALLOWED_DROP) -> DataFrame:
    """(metric, value, base, ok) of two tables (metric, value): a metric fails when it loses more than ``drop``."""
    rows = baseline.select("metric", F.col("value").alias("base")).join(current, "metric", "left")
    ok = F.coalesce(F.col("value") >= F.col("base") - drop, F.lit(False))
    return rows.select("metric", "value", "base", ok.alias("ok"))
