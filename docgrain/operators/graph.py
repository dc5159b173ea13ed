"""Entity graph: build, prune, walk, rank and cluster.

Nodes are (key, label, type, count, n_chunks, corpora, description), edges are directed rows (src, dst, rel, weight,
typed, n_chunks, description); walks see them undirected. Which chunks a node is in is a table of its own (key,
chunk_id), since a hub may be in a large part of them. Iterations join a frontier, which is small, with the edges, and
write what the next round reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.session import dealt, forget, materialise

#: Relations that say no more than that two names meet.
GENERIC_RELATIONS = ("co_occurs", "related_to", "")
TYPED_BOOST = 3.0
DAMPING = 0.85
#: What is left of the equations of ranks when these have settled: they are then right to nine places.
TOLERANCE = 5e-11


def is_typed(rel: Column) -> Column:
    return ~F.coalesce(rel, F.lit("")).isin(*GENERIC_RELATIONS)


def with_typed(edges: DataFrame) -> DataFrame:
    """Stored edges with ``typed``: where it is missing or null, it follows from the relation."""
    said = F.col("typed") if "typed" in edges.columns else F.lit(None).cast("boolean")
    return edges.withColumn("typed", F.coalesce(said, is_typed(F.col("rel"))))


def aggregate_nodes(mentions: DataFrame) -> DataFrame:
    """Nodes from mentions (name, type, chunk_id, corpus, description, seq; with ``n`` a row stands for so many mentions).

    The count is that of mentions; the label is the first, the type the last that is not ``entity``, the description
    the longest. Names that are no entities are left out.
    """
    rows = mentions.where(~T.is_junk_name(F.col("name"))).withColumn("key", T.node_key(F.col("name")))
    named = F.when(F.col("type") != "entity", F.col("seq"))
    return rows.groupBy("key").agg(
        F.min_by("name", "seq").alias("label"),
        F.coalesce(F.max_by("type", named), F.lit("entity")).alias("type"),
        (F.sum("n") if "n" in rows.columns else F.count("*")).alias("count"),
        F.count_distinct("chunk_id").alias("n_chunks"),
        F.array_sort(F.collect_set("corpus")).alias("corpora"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
    )


def node_chunks(mentions: DataFrame) -> DataFrame:
    """Distinct (key, chunk_id) of mentions whose names are entities."""
    rows = mentions.where(~T.is_junk_name(F.col("name")) & F.col("chunk_id").isNotNull())
    return rows.select(T.node_key(F.col("name")).alias("key"), "chunk_id").distinct()


def aggregate_edges(relations: DataFrame, keys: bool = False) -> DataFrame:
    """Edges from relations (src, dst, rel, chunk_id, weight, description, seq), names as written or, with ``keys``, keys already, which may be numbers.

    Weights add up. The first typed relation names the edge, else the first of all. Loops and empty ends go.
    """
    rows = relations if keys else relations.withColumns({"src": T.node_key(F.col("src")), "dst": T.node_key(F.col("dst"))})
    rows = rows.where("src <> dst").withColumn("typed", is_typed(F.col("rel")))
    if rows.schema["src"].dataType.simpleString() == "string":
        rows = rows.where("src <> '' and dst <> ''")
    return rows.groupBy("src", "dst").agg(
        F.min_by("rel", F.struct(~F.col("typed"), "seq")).alias("rel"),
        F.sum("weight").alias("weight"),
        F.max("typed").alias("typed"),
        F.count_distinct("chunk_id").alias("n_chunks"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
    )


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes (key); names that are no entities leave none behind."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("key").alias(end)), end, "left_semi")
    return edges


def cooccurrences(chunks: DataFrame, names_col: str = "names", typed: DataFrame | None = None) -> DataFrame:
    """Relations ``co_occurs`` of weight 1 between all names of a chunk, in their order: (src, dst, rel, chunk_id, weight).

    Pairs that ``typed`` (chunk_id, src, dst) relates, in either direction, are left out. The pairs are made inside
    the row; a chunk's names are bounded by its metadata.
    """
    names = F.col(names_col)
    later = F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
    pairs = chunks.where(F.size(names) > 1).select("chunk_id", F.explode(F.flatten(later)).alias("p"))
    pairs = pairs.select("chunk_id", "p.src", "p.dst").where("src <> dst")
    if typed is not None:
        ends = lambda: (F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        known = typed.select("chunk_id", *ends()).distinct()
        pairs = pairs.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(known, ["chunk_id", "a", "b"], "left_anti")
    return pairs.select("src", "dst", F.lit("co_occurs").alias("rel"), "chunk_id", F.lit(1).alias("weight"))


def neighbours(edges: DataFrame, typed_only: bool = False) -> DataFrame:
    """Distinct undirected (node, other)."""
    rows = edges.where("typed") if typed_only else edges
    return rows.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(rows.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours."""
    return neighbours(edges).groupBy("node").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame, boost: float = TYPED_BOOST) -> DataFrame:
    """(a, b, weight), a < b: both directions merged, typed edges weighing more."""
    w = F.col("weight") * F.when(F.col("typed"), boost).otherwise(1.0)
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("weight"))


def prune_edges(edges: DataFrame, min_weight: int = 2, min_degree: int = 2, keep_typed: bool = True) -> DataFrame:
    """Edges without those that are weak and lie between two obscure nodes; typed edges stay unless told otherwise."""
    deg = degrees(edges)
    rows = edges.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src")
    rows = rows.join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    weak = (F.col("weight") < min_weight) & (F.col("ds") < min_degree) & (F.col("dd") < min_degree)
    keep = ~weak | F.col("typed") if keep_typed else ~weak
    return rows.where(keep).select(*edges.columns)


def hub_nodes(edges: DataFrame, percentile: float, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree) at or above the degree that stands at ``percentile`` of all nodes, in order of degree.

    The threshold comes from counts by degree, of which there are few, not from a sort of the nodes. ``nodes`` (key)
    adds nodes without edges.
    """
    deg = degrees(edges)
    if nodes is not None:
        deg = nodes.select(F.col("key").alias("node")).join(deg, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    counts = deg.groupBy("degree").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy("degree"))
    at = F.least(F.floor(total * (percentile / 100.0)), total - 1)
    least = counts.withColumns({"upto": upto, "at": at}).where(F.col("upto") > F.col("at")).agg(F.min("degree").alias("least"))
    return deg.join(F.broadcast(least), F.col("degree") >= F.col("least")).where("degree > 0").select("node", "degree")


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int = 2, typed_only: bool = False) -> DataFrame:
    """(seed, node, hops) of all nodes within ``hops`` steps of each seed (column ``seed``); a seed is 0 from itself."""
    near = materialise(neighbours(edges, typed_only))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct()
    front = seen
    for step in range(1, hops + 1):
        reached = front.join(near, "node").select("seed", F.col("other").alias("node")).distinct()
        front = materialise(reached.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(step)))
        seen = seen.unionByName(front)
    return seen


def chunks_within(of_nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Distinct (seed, chunk_id) of the nodes reached, by (key, chunk_id)."""
    return reached.join(of_nodes, reached["node"] == of_nodes["key"]).select("seed", "chunk_id").distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """(src, dst, path) of pairs (src, dst) at most ``max_hops`` edges apart; of equally short paths the first by names.

    Steps are taken from both ends in turn until they meet: a pair's frontiers are what lies within half of the way.
    A round keeps, for each pair, one way to each node, and pairs that have met are left out of the next.
    """
    near = materialise(neighbours(edges))
    ends = pairs.select("src", "dst").distinct()
    done = ends.where("src = dst").select("src", "dst", F.array("src").alias("path"))
    apart = materialise(ends.where("src <> dst"))
    fronts = [apart.select("src", "dst", F.col(end).alias("node"), F.array(end).alias("path")) for end in ("src", "dst")]
    seen = [front.select("src", "dst", "node") for front in fronts]
    for hop in range(max_hops):
        side = hop % 2
        other = F.array("other")
        way = F.concat(other, "path") if side else F.concat("path", other)
        step = fronts[side].join(near, "node").select("src", "dst", F.col("other").alias("node"), way.alias("path"))
        step = step.join(seen[side], ["src", "dst", "node"], "left_anti").groupBy("src", "dst", "node").agg(F.min("path").alias("path"))
        fronts[side] = materialise(step)
        seen[side] = seen[side].unionByName(fronts[side].select("src", "dst", "node"))
        behind = fronts[1].select("src", "dst", "node", F.slice("path", 2, F.size("path")).alias("rest"))
        met = fronts[0].join(behind, ["src", "dst", "node"]).select("src", "dst", F.concat("path", "rest").alias("path"))
        met = materialise(met.groupBy("src", "dst").agg(F.min("path").alias("path")))
        done = done.unionByName(met)
        fronts = [front.join(met.select("src", "dst"), ["src", "dst"], "left_anti") for front in fronts]
    return done


def label_paths(paths: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, text): paths with the relation of every step, in whichever direction it is stored."""
    steps = paths.select("src", "dst", F.size("path").alias("n"), F.posexplode("path").alias("at", "node"))
    w = Window.partitionBy("src", "dst").orderBy("at")
    steps = steps.withColumn("next", F.lead("node").over(w))
    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("rel").alias("r1"))
    backward = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.col("rel").alias("r2"))
    steps = steps.join(forward, ["node", "next"], "left").join(backward, ["node", "next"], "left")
    if nodes is not None:
        steps = steps.join(nodes.select(F.col("key").alias("node"), "label"), "node", "left")
    name = F.coalesce("label", "node") if nodes is not None else F.col("node")
    rel = F.coalesce("r1", "r2", F.lit("related_to"))
    part = F.when(F.col("next").isNull(), name).otherwise(F.concat(name, F.lit(" --"), rel, F.lit("--> ")))
    parts = F.array_sort(F.collect_list(F.struct("at", part.alias("s"))))
    return steps.groupBy("src", "dst").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("text"))


def _settled(edges: DataFrame, seeds: DataFrame | None, tolerance: float, damping: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, ranks): nodes (node, size) of edges (a, b, weight), ranks (query_id, node, rank) by the seeds of each query.

    Ranks solve rank = damping * step(rank) + (1 - damping) * restart. Divided by the nodes' sizes, the roots of their
    weights, the equations are symmetric, so that conjugate gradients solve them: of a query ``x`` is the solution so far,
    ``r`` what it leaves of the equations, ``p`` the direction and ``s`` the equations' left side of it. A round shuffles
    ranks only: steps are kept dealt by node.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    weights = materialise(both.groupBy("node").agg(F.sum("weight").alias("out")), "weights")
    most = weights.agg(F.max("out")).first()[0] or 1.0
    nodes = weights.select("node", F.sqrt(F.col("out") / F.lit(most)).alias("size"))
    step = F.lit(damping / most) * F.col("weight") / F.col("size") / F.col("there")
    steps = both.join(nodes, "node").join(nodes.select(F.col("node").alias("other"), F.col("size").alias("there")), "other")
    steps = materialise(steps.select("node", "other", step.alias("step")), "steps")
    steps = dealt(steps, "node", n=steps.count()).persist(StorageLevel.DISK_ONLY)

    seeds = nodes.select(F.lit(0).alias("query_id"), "node") if seeds is None else seeds.select("query_id", "node").distinct()
    start = materialise(seeds.join(nodes, "node"), "seeds")
    shares = start.groupBy("query_id").agg(((1 - damping) / F.count("*")).alias("share"))
    none, share = F.lit(0.0), F.col("share") / F.col("size")
    last = start.join(shares, "query_id").select("query_id", "node", none.alias("x"), share.alias("r"), share.alias("p"))
    found, before = start.select("query_id", "node", none.alias("x")).limit(0), None
    for _ in count():
        flow = last.join(steps, "node").groupBy("query_id", F.col("other").alias("node")).agg(F.sum(F.col("p") * F.col("step")).alias("flow"))
        parts = last.withColumn("s", F.col("p")).unionByName(flow.select("query_id", "node", *(none.alias(c) for c in "xrp"), (-F.col("flow")).alias("s")))
        now = materialise(parts.groupBy("query_id", "node").agg(*(F.sum(c).alias(c) for c in "xrps")), "ranks")
        if before is not None:
            forget(before)
        r, p, s = map(F.col, "rps")
        sums = now.groupBy("query_id").agg(F.sum(r * r).alias("rr"), F.sum(p * s).alias("ps"), F.sum(r * s).alias("rs"), F.sum(s * s).alias("ss"))
        sums = sums.withColumn("along", F.col("rr") / F.col("ps"))
        sums = sums.withColumn("left", F.greatest(F.col("rr") - 2 * F.col("along") * F.col("rs") + F.col("along") ** 2 * F.col("ss"), none))
        sums = materialise(sums.select("query_id", "along", (F.col("left") / F.col("rr")).alias("turn"), (F.sqrt("left") <= tolerance).alias("done")), "sums")
        rest = r - F.col("along") * s
        rows = now.join(sums, "query_id").select("query_id", "node", (F.col("x") + F.col("along") * p).alias("x"), rest.alias("r"), (rest + F.col("turn") * p).alias("p"), "done")
        last = rows.where(~F.col("done")).drop("done")
        ends = sums.agg(F.count_if("done").alias("done"), F.count("*").alias("n")).first()
        if ends["done"]:
            found = found.unionByName(rows.where("done").select("query_id", "node", "x"))
        if ends["done"] == ends["n"]:
            break
        before = None if ends["done"] else now
    steps.unpersist()
    return nodes, found.join(nodes, "node").select("query_id", "node", (F.col("x") * F.col("size")).alias("rank"))


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, rounds: int | None = None, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(node, rank): PageRank over weighted undirected edges (a, b, weight), restarting at the seeds (column ``node``).

    Seeds that are no nodes are ignored; with none left the result is empty; without ``seeds`` all nodes restart.
    Every rank is within tolerance / (1 - damping) of where it settles, whatever the size of the graph; with ``rounds``
    ranks are those after so many steps from the seeds, settled or not.
    """
    if rounds is not None:
        return _walked(edges, seeds, rounds, damping)
    nodes, ranks = _settled(edges, seeds if seeds is None else seeds.select(F.lit(0).alias("query_id"), "node"), tolerance, damping)
    ranks = materialise(ranks.select("node", "rank"), "ranks")
    if ranks.isEmpty():
        return ranks
    return nodes.join(ranks, "node", "left").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def _walked(edges: DataFrame, seeds: DataFrame | None, rounds: int, damping: float) -> DataFrame:
    """(node, rank) after ``rounds`` steps."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    out = both.groupBy("node").agg(F.sum("weight").alias("out"))
    steps = materialise(both.join(out, "node").select("node", "other", (F.col("weight") / F.col("out")).alias("p")))
    nodes = out.select("node")
    start = nodes if seeds is None else nodes.join(seeds.select("node").distinct(), "node", "left_semi")
    n_start = start.count()
    if not n_start:
        return nodes.limit(0).withColumn("rank", F.lit(0.0))
    restart = materialise(start.withColumn("restart", F.lit(1.0 / n_start)))
    base = materialise(nodes.join(restart, "node", "left").select("node", F.coalesce("restart", F.lit(0.0)).alias("restart")))
    rank = base.withColumn("rank", F.col("restart"))
    for _ in range(rounds):
        flow = rank.join(steps, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        new = F.lit(damping) * F.coalesce("flow", F.lit(0.0)) + (1 - damping) * F.col("restart")
        rank = materialise(rank.join(flow, "node", "left").select("node", "restart", new.alias("rank")))
    return rank.select("node", "rank")


def personal_pagerank(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(query_id, node, rank): PageRank over (a, b, weight) from the seeds (query_id, node) of every query, in the same rounds.

    As :func:`pagerank` ranks them for each query alone, but for nodes that a query does not reach, which have no row.
    A query whose ranks have settled is set aside; seeds that are no nodes are ignored, and a query with none left has
    no rows.
    """
    return _settled(edges, seeds, tolerance, damping)[1]


def rank_chunks(ranks: DataFrame, of_nodes: DataFrame, k: int = 30) -> DataFrame:
    """Best ``k`` (chunk_id, score): a chunk has the rank of its best node, by (key, chunk_id)."""
    rows = ranks.join(of_nodes, ranks["node"] == of_nodes["key"])
    return rows.groupBy("chunk_id").agg(F.max("rank").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected edges (a, b); component is the smallest node.

    Rounds of taking the least label among neighbours, each followed by a jump to the label's own label.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = materialise(both)
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        least = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("m"))
        now = labels.join(least, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = now.select(F.col("node").alias("component"), F.col("component").alias("far"))
        now = materialise(now.join(jump, "component", "left").select("node", F.least("component", "far").alias("component"), "was"))
        labels = now.select("node", "component")
        if now.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Rounds in which a node may go to any community; after them only to one of a smaller name, so that moves must end.
FREE_ROUNDS = 24
#: Levels of merged communities, far more than there are: each has fewer nodes than the one before.
MERGE_LEVELS = 64


def _moves(edges: DataFrame, level: int) -> tuple[DataFrame, bool]:
    """Labels (node, community) after rounds of moves over (a, b, weight), a = b for what lies inside a merged node, and whether any moved.

    A node goes to the neighbours' community by which modularity gains most, ties to the smallest. In a round one half
    of the nodes, by a hash, may move, and a node alone in its community joins another such node only if that is
    smaller, so that neighbours do not swap places for ever.
    """
    links = edges.where("a <> b")
    both = materialise(links.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")), "links")
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    strength = materialise(ends.groupBy("node").agg(F.sum("weight").alias("k")), "strength")
    whole = strength.agg(F.sum("k")).first()[0] or 1.0
    labels = strength.select("node", "k", F.col("node").alias("community"))
    ever, quiet, last = False, 0, None
    for step in count():
        totals = labels.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
        near = both.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        near = near.unionByName(labels.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        rows = near.join(totals, "community").join(labels.select("node", "k", F.col("community").alias("own")), "node")
        mine = F.col("community") == F.col("own")
        gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(mine, F.col("k")).otherwise(0.0)) / whole, 9)
        single = F.col("n") == 1
        # The smallest loss; of equal ones the own community, then the smallest.
        best = rows.groupBy("node", "k", "own").agg(F.min(F.struct((-gain).alias("loss"), (~mine).alias("other"), "community", single.alias("alone"))).alias("b"), F.max(mine & single).alias("alone"))
        wants = (F.col("b.community") != F.col("own")) & ~(F.col("alone") & F.col("b.alone") & (F.col("b.community") > F.col("own")))
        if step >= FREE_ROUNDS:
            wants = wants & (F.col("b.community") < F.col("own"))
        turn = F.pmod(F.xxhash64("node", F.lit(level), F.lit(step // 2)), F.lit(2)) == step % 2
        now = materialise(best.select("node", "k", F.when(wants & turn, F.col("b.community")).otherwise(F.col("own")).alias("community"), (wants & turn).alias("moved")), "moves")
        labels = now.select("node", "k", "community")
        if last is not None:
            forget(last)
        last = now
        moved = not now.where("moved").isEmpty()
        ever, quiet = ever or moved, 0 if moved else quiet + 1
        if quiet == 2:  # each half had its turn
            forget(both)
            return labels.select("node", "community"), ever


def _connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after communities that fall apart are split into their connected parts, each named by its smallest node.

    No edge runs between such parts, so that modularity can only gain.
    """
    side = lambda x: labels.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    inside = materialise(edges.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b"), "inside")
    parts = components(inside)
    found = materialise(labels.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community")), "parts")
    forget(inside)
    return found


def hierarchy(edges: DataFrame) -> DataFrame:
    """(level, node, community) by greedy modularity over (a, b, weight): level 0 has the smallest communities.

    On each level nodes move between communities in rounds over the whole cluster; what a community's moves have torn
    apart is split, and the communities, each connected now, are the nodes of the next level, until nothing moves. A
    community of a level is a union of communities of the level before, named by its smallest part. The same at every
    size and however the edges are dealt; no step holds a component in one task.
    """
    level = materialise(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("weight")), "level")
    found, levels = None, None
    for step in range(MERGE_LEVELS):
        labels, moved = _moves(level, step)
        if not moved and found is not None:
            return levels
        labels = _connected(level, labels)
        found = labels if found is None else materialise(found.join(labels.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")), "found")
        mine = found.select(F.lit(step).alias("level"), "node", "community")
        levels = mine if levels is None else levels.unionByName(mine)
        if not moved:
            return levels
        side = lambda x: labels.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))  # noqa: B023, E731
        merged = level.join(side("a"), "a").join(side("b"), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))
        merged = materialise(merged, "level")
        forget(level)
        level = merged
    raise RuntimeError(f"communities did not settle in {MERGE_LEVELS} levels")


def communities(edges: DataFrame, min_size: int = 3) -> DataFrame:
    """(node, community): the largest communities of :func:`hierarchy`, each connected; small ones are left out.

    A community is named by its smallest node.
    """
    levels = hierarchy(edges)
    last = levels.groupBy("node").agg(F.max_by("community", "level").alias("community"))
    big = last.groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("first")).where(F.col("n") >= min_size)
    return last.join(big, "community").select("node", F.col("first").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of (node, community) over (a, b, weight)."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    rows = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    inside = rows.where("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    ends = rows.select(F.col("ca").alias("c"), "weight").unionByName(rows.select(F.col("cb").alias("c"), "weight"))
    square = ends.where("c is not null").groupBy("c").agg(F.sum("weight").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    return inside / total - square / (4 * total * total)


def community_briefs(members: DataFrame, nodes: DataFrame, edges: DataFrame, entities: int = 15, relations: int = 20) -> DataFrame:
    """(community, name, summary, n_members, n_chunks, members_hash, top, relations): what a community is about, in fixed words.

    ``members_hash`` changes with the members, whatever their order: a summary is made anew where it does. ``name`` joins its three most mentioned members; relations are those with both ends inside, typed and heavy first.
    """
    rows = members.join(nodes, members["node"] == nodes["key"]).select("community", "key", "label", "type", "count", "n_chunks")
    order = Window.partitionBy("community").orderBy(F.desc("count"), "key")
    ranked = rows.withColumn("r", F.row_number().over(order))
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= entities, F.struct("r", "label", "type", "count"))))
    info = ranked.groupBy("community").agg(
        top.alias("top"),
        F.count("*").alias("n_members"),
        F.hex(F.bit_xor(F.xxhash64("key"))).alias("members_hash"),
        F.sum("n_chunks").alias("n_chunks"),
    )
    ends = lambda x: members.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    inner = edges.join(ends("src"), "src").join(ends("dst"), "dst").where("csrc = cdst")
    heavy = Window.partitionBy("csrc").orderBy(F.desc("typed"), F.desc("weight"), "src", "dst")
    inner = inner.withColumn("r", F.row_number().over(heavy)).where(F.col("r") <= relations)
    inner = inner.groupBy(F.col("csrc").alias("community")).agg(F.array_sort(F.collect_list(F.struct("r", "src", "rel", "dst", "weight", "typed"))).alias("relations"))
    name = F.array_join(F.slice(F.transform("top", lambda x: x["label"]), 1, 3), ", ")
    out = info.join(inner, "community", "left").withColumn("name", name)
    said = F.concat(F.lit("Community of "), F.col("n_members").cast("string"), F.lit(" entities around "), F.col("name"), F.lit("."))
    return out.select("community", "name", said.alias("summary"), "n_members", "n_chunks", "members_hash", "top", "relations")


def relevant_communities(briefs: DataFrame, question: str, k: int = 6) -> DataFrame:
    """Best ``k`` communities by shared tokens of question and brief."""
    words = T.content_tokens(F.lit(question))
    mine = T.content_tokens(F.concat_ws(" ", "summary", F.array_join(F.transform("top", lambda x: x["label"]), " ")))
    shared = F.size(F.array_intersect(F.array_distinct(words), mine))
    return briefs.withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), "community").limit(k)


def community_stats(sizes: DataFrame, size_col: str = "n") -> DataFrame:
    """One row (n, mean, max, p90): the last is the size that a tenth of the communities exceed or equal, from the top."""
    order = Window.orderBy(F.desc(size_col))
    counts = sizes.groupBy(size_col).agg(F.count("*").alias("c"))  # few distinct sizes
    total = counts.agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col(size_col)) / F.sum("c")).alias("mean"), F.max(size_col).alias("max"))
    ranked = counts.withColumn("upto", F.sum("c").over(order)).crossJoin(F.broadcast(total.select(F.floor(F.col("n") * 0.1).alias("at"))))
    p90 = ranked.where("upto > at").agg(F.max(size_col).alias("p90"))
    return total.crossJoin(p90)


def _grams(text: Column) -> Column:
    """All runs of three characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def find_nodes(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key): the node of that key, else the first node, by name, of which one contains the other.

    Equal keys are joined. What contains the other has all its runs of three characters, so every other pair meets on
    the run of the shorter that fewest nodes have, and ``contains`` decides among those that meet. Keys and terms of
    one or two characters meet on all such runs of the other side's texts. Nothing is compared with everything.
    """
    wanted = materialise(terms.select("term", T.node_key(F.col("term")).alias("t")).distinct().where("term is not null"), "terms")
    keys = nodes.select("key").where("key is not null").distinct()
    equal = wanted.join(keys, F.col("key") == F.col("t")).select("term", "key")
    rest = wanted.join(equal, "term", "left_anti").withColumn("side", F.lit(0))
    long = lambda c: F.length(c) >= 3
    short = lambda c: F.flatten(F.array(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1))), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))))
    runs = lambda c: F.when(F.length(c) > 0, F.array_distinct(F.concat(F.when(long(c), _grams(c)).otherwise(F.array().cast("array<string>")), short(c)))).otherwise(F.array().cast("array<string>"))
    of_keys = keys.select("key", F.explode(runs(F.col("key"))).alias("run"))
    of_terms = rest.select("term", "t", F.explode(runs(F.col("t"))).alias("run"))
    asked = materialise(of_terms.select("run").distinct(), "runs")
    counts = materialise(of_keys.join(asked, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n")), "counts")
    # A text as the contained one: the rarest of its runs of its own kind stands for it; one that no node has finds none.
    kind = lambda c: F.least(F.length(c), F.lit(3)) == F.length("run")
    of_term = of_terms.where(kind(F.col("t"))).join(counts, "run", "left").groupBy("term", "t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("b")).where("b.n > 0").select("term", "t", F.col("b.run").alias("run"))
    inside = of_term.join(of_keys, "run").where(F.contains("key", "t")).select("term", "key")
    term_counts = of_terms.groupBy("run").agg(F.count("*").alias("n"))
    of_key = of_keys.where(kind(F.col("key"))).join(term_counts, "run").groupBy("key").agg(F.min(F.struct("n", "run")).alias("b")).select("key", F.col("b.run").alias("run"))
    around = of_key.join(of_terms, "run").where(F.contains("t", "key")).select("term", "key")
    # The empty key is in every term, and the empty term in every key.
    blank = keys.where("key = ''").select("key")
    none = rest.where("t = ''").select("term").join(F.broadcast(keys.agg(F.min("key").alias("key"))), F.col("key").isNotNull())
    every = rest.join(F.broadcast(blank.limit(1)), F.lit(True)).select("term", "key")
    first = inside.unionByName(around).unionByName(none).unionByName(every).groupBy("term").agg(F.min("key").alias("key"))
    return equal.unionByName(first)


def top_nodes(nodes: DataFrame, k: int = 10) -> DataFrame:
    """(key, label, type, count, rank) of the nodes with most mentions; ties by key. The limit is applied before the shuffle."""
    best = nodes.orderBy(F.desc("count"), "key").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "key"))).select("key", "label", "type", "count", "rank")


# Nodes of these types with two mentions need no further check; names that a service sees at once.
TRUSTED_TYPES, TRUSTED_COUNT, VERIFY_BATCH = ("manufacturer", "firearm", "person", "organization", "case"), 2, 40


def verify_nodes(nodes: DataFrame, edges: DataFrame, reject: Callable[[list[str]], set[str]] | None = None, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, verdicts) without names that are none: first by rule, then by a service.

    ``reject`` gets labels, VERIFY_BATCH at once, and returns those that are no entities; trusted types with support
    and names of earlier ``verdicts`` (key, verdict: keep or drop) are not asked again. Without a service only the
    rule and earlier verdicts count.
    """
    trusted = F.col("type").isin(*TRUSTED_TYPES) & (F.col("count") >= TRUSTED_COUNT)
    rows = nodes.select("key", "label", trusted.alias("trusted"), T.is_junk_name(F.col("label")).alias("junk"))
    none = rows.sparkSession.createDataFrame([], "key string, verdict string")
    known = verdicts if verdicts is not None else none
    asked = rows.where("not junk and not trusted").join(known, "key", "left_anti")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), VERIFY_BATCH):
                part = batch.iloc[at : at + VERIFY_BATCH]
                bad = reject(part["label"].tolist())
                yield pd.DataFrame({"key": part["key"], "verdict": ["drop" if x in bad else "keep" for x in part["label"]]})

    new = materialise(asked.select("key", "label").mapInPandas(judge, "key string, verdict string")) if reject else none
    every = known.unionByName(new)
    # A trusted name stays whatever an earlier verdict said.
    dropped = rows.join(every, "key", "left").where("junk or (verdict = 'drop' and not trusted)").select("key")
    return *remove_nodes(nodes, edges, materialise(dropped)), every


def remove_nodes(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``keys`` (key) and the edges at them."""
    left = edges.join(keys.select(F.col("key").alias("src")), "src", "left_anti").join(keys.select(F.col("key").alias("dst")), "dst", "left_anti")
    return nodes.join(keys, "key", "left_anti").select(*nodes.columns), left.select(*edges.columns)


def export_graph(nodes: DataFrame, edges: DataFrame, members: DataFrame, of_nodes: DataFrame, most: int = 2000, chunks: int = 25) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of highest degree with community (-1: none) and their first ``chunks`` chunks, and the edges between them."""
    deg = degrees(edges).withColumnRenamed("node", "key")
    rows = nodes.join(deg, "key", "left").join(members.withColumnRenamed("node", "key"), "key", "left")
    top = rows.select("key", "label", "type", "count", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("community", F.lit("-1")).alias("community"))
    top = materialise(top.orderBy(F.desc("degree"), "key").limit(most))
    order = Window.partitionBy("key").orderBy("chunk_id")
    first = of_nodes.join(top.select("key"), "key", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= chunks)
    first = first.groupBy("key").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
    inside = edges.join(top.select(F.col("key").alias("src")), "src", "left_semi").join(top.select(F.col("key").alias("dst")), "dst", "left_semi")
    return top.join(first, "key", "left"), inside
