"""Further lanes of retrieval: the graph by steps or by PageRank, and answers from communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import graph
from docgrain.session import materialise

TYPED_SCORE, LOOSE_SCORE = 0.65, 0.50
BAND_LOW, BAND_WIDTH = 0.50, 0.20
FIRST_NODES = 6


def matched_nodes(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, place, node): the nodes that a question's words name, in the order of the words, each once."""
    words = questions.select("query_id", F.posexplode(T.content_tokens(F.col("question"))).alias("at", "term"))
    found = graph.find_nodes(nodes, words.select("term").distinct())
    rows = words.join(found, "term").groupBy("query_id", F.col("key").alias("node")).agg(F.min("at").alias("at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node"))).select("query_id", "place", "node")


def graph_lane(nodes: DataFrame, of_nodes: DataFrame, edges: DataFrame, questions: DataFrame, hops: int = 2) -> DataFrame:
    """Lane hits of chunks, by (key, chunk_id), near the first matched nodes: those along typed edges score 0.65, the others 0.50."""
    seeds = materialise(matched_nodes(nodes, questions).where(F.col("place") <= FIRST_NODES), "seeds")
    wanted = seeds.select(F.col("node").alias("seed")).distinct()
    near = lambda typed: graph.chunks_within(of_nodes, graph.within_hops(edges, wanted, hops, typed))
    scored = near(True).withColumn("score", F.lit(TYPED_SCORE)).unionByName(near(False).withColumn("score", F.lit(LOOSE_SCORE)))
    rows = scored.join(seeds.withColumnRenamed("node", "seed"), "seed").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return rows.select("query_id", "chunk_id", "score", F.lit("graph").alias("source"), F.lit(2).alias("lane"))


def pagerank_lane(nodes: DataFrame, of_nodes: DataFrame, edges: DataFrame, questions: DataFrame, k: int = 45) -> DataFrame:
    """Lane hits by personalised PageRank of all questions at once, scores from 0.50 to 0.70; those without a node on an edge have none.

    A chunk has the rank of its best node; of equal ranks the smaller id comes first.
    """
    seeds = materialise(matched_nodes(nodes, questions), "seeds")
    ranks = graph.personal_pagerank(materialise(graph.undirected(edges), "weights"), seeds.select("query_id", "node"))
    scored = ranks.join(of_nodes, ranks["node"] == of_nodes["key"]).groupBy("query_id", "chunk_id").agg(F.max("rank").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    top = F.max("score").over(Window.partitionBy("query_id"))
    return best.select("query_id", "chunk_id", (BAND_LOW + BAND_WIDTH * F.col("score") / top).alias("score"), F.lit("graph").alias("source"), F.lit(2).alias("lane"))


def evidence_paths(nodes: DataFrame, edges: DataFrame, questions: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, text): labelled shortest paths between matched nodes one or two places apart, at most eight a question."""
    found = materialise(matched_nodes(nodes, questions), "matched")
    a, b = found.select("query_id", F.col("place").alias("i"), F.col("node").alias("src")), found.select("query_id", F.col("place").alias("j"), F.col("node").alias("dst"))
    pairs = a.join(b, "query_id").where("j - i between 1 and 2")
    paths = materialise(graph.shortest_paths(edges, pairs.select("src", "dst").distinct()), "paths")
    named = graph.label_paths(paths, edges, nodes)
    rows = pairs.join(named, ["src", "dst"]).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("i", "j")))
    return rows.where(F.col("r") <= most).select("query_id", "text")


def global_answer(briefs: DataFrame, question: str, k: int = 8) -> DataFrame:
    """One row (answer, confidence, communities): the briefings of the most relevant communities; none if none is."""
    best = graph.relevant_communities(briefs, question, k)
    joined = F.array_sort(F.collect_list(F.struct(-F.col("shared"), "community", "summary")))
    out = best.agg(joined.alias("b"), F.count("*").alias("n")).where("n > 0")
    return out.select(F.array_join(F.transform("b", lambda x: x["summary"]), "\n").alias("answer"), F.least(F.lit(1.0), 0.4 + 0.1 * F.col("n")).alias("confidence"), F.transform("b", lambda x: x["community"]).alias("communities"))
