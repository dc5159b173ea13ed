"""Hard negatives: ball trees over the vectors of a partition, searched by branch and bound for many anchors at once.

A ball of centre c and radius r bounds the inner products of an anchor q with all vectors in it from both sides, by
q.c - |q| r and q.c + |q| r. A node is left out for an anchor where these lie outside the window of scores that it looks
for, or strictly beneath the k-th score that it has found so far. Anchors walk the trees together, in blocks of
bounded size; every node hands on those that still need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.llm.shared import materialise, new_path

#: Vectors of a leaf.
LEAF = 256
#: Bytes of vectors in one tree, and of anchors with their results in one block.
TREE_BYTES, BLOCK_BYTES = 1 << 26, 1 << 25
#: Random directions whose signs order vectors, so that partitions hold vectors of like directions.
DIRECTIONS = 16
SEED = 23
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max
#: Inner products are exact in double precision below this.
_EXACT = 2.0**53


@dataclass
class Points:
    """Vectors of whole numbers, of one length, with their row numbers, ids (the largest long stands for null) and labels."""

    vectors: np.ndarray
    row: np.ndarray
    id: np.ndarray
    label: np.ndarray

    def take(self, which: np.ndarray | slice) -> Points:
        return Points(self.vectors[which], self.row[which], self.id[which], self.label[which])

    @classmethod
    def by_length(cls, frame: pd.DataFrame) -> Iterator[Points]:
        """Those of a frame of (row, id, label, vector), for each length of vectors."""
        lengths = frame["vector"].map(len).to_numpy()
        for n in np.unique(lengths).tolist():
            part = frame[lengths == n]
            vectors = np.stack(part["vector"].to_numpy()) if n else np.zeros((len(part), 0))
            yield cls(vectors, part["row"].to_numpy(np.int64), part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64))


@dataclass
class Node:
    """A ball over the points lo to hi of its tree, with their smallest and largest label."""

    lo: int
    hi: int
    centre: np.ndarray
    radius: float
    labels: tuple[int, int]
    children: tuple[Node, ...] = ()


class BallTree:
    """Labels with a leaf's worth of vectors have a tree of their own; the rest share one."""

    def __init__(self, points: Points, leaf: int = LEAF):
        kinds, number, count = np.unique(points.label, return_inverse=True, return_counts=True)
        group = np.where(count[number] >= leaf, number, len(kinds))
        order, at, self.roots, parts = np.argsort(group, kind="stable"), 0, [], []
        for size in np.unique(group, return_counts=True)[1].tolist():
            root, mine = self._build(points, order[at : at + size], at, leaf)
            self.roots.append(root)
            parts.append(mine)
            at += size
        self.points = points.take(np.concatenate(parts) if parts else order)

    def _build(self, points: Points, which: np.ndarray, at: int, leaf: int) -> tuple[Node, np.ndarray]:
        """(node, its points in order); two distant points give the direction of a split, in halves."""
        x = points.vectors[which]
        centre = x.mean(axis=0)
        away = np.sqrt(((x - centre) ** 2).sum(axis=1))
        labels = (int(points.label[which].min()), int(points.label[which].max()))
        node = Node(at, at + len(which), centre, float(away.max()) * (1 + 1e-9), labels)
        if len(which) <= leaf or node.radius == 0:
            return node, which[np.lexsort((points.row[which], points.id[which]))]
        first = x[away.argmax()]
        second = x[((x - first) ** 2).sum(axis=1).argmax()]
        half = len(which) // 2
        sides = np.argpartition(x @ (second - first), half)
        left, a = self._build(points, which[sides[:half]], at, leaf)
        right, b = self._build(points, which[sides[half:]], at + half, leaf)
        node.children = (left, right)
        return node, np.concatenate((a, b))


class Search:
    """The best ``k`` vectors for every anchor and window of scores, larger scores first, then smaller ids."""

    def __init__(self, anchors: Points, low: np.ndarray, high: np.ndarray, same_label: bool, k: int):
        self.anchors, self.low, self.high, self.same, self.k = anchors, low, high, same_label, k
        self.length = np.sqrt((anchors.vectors**2).sum(axis=1))
        self.score = np.full((*low.shape, k), _NONE)
        self.id = np.full((*low.shape, k), _LAST)
        self.compared = 0  # inner products computed, without those with centres

    def add(self, tree: BallTree) -> None:
        """Search one more tree."""
        most = np.abs(tree.points.vectors).max(initial=0) * np.abs(self.anchors.vectors).max(initial=0) * max(1, self.anchors.vectors.shape[1])
        if most >= _EXACT:
            raise OverflowError("inner products of 2**53 and more are not supported")
        everyone = np.flatnonzero((self.low <= self.high).any(axis=1))
        stack = [(root, everyone) for root in tree.roots]
        while stack:
            node, who = stack.pop()
            who, above = self._needed(node, who)
            if not len(who):
                continue
            if node.children:
                # The child with the higher bounds is searched first: it raises the k-th scores that prune the other.
                mid = [float((self.anchors.vectors[who] @ child.centre).mean()) + child.radius * float(self.length[who].mean()) for child in node.children]
                stack += [(node.children[i], who) for i in np.argsort(mid, kind="stable").tolist()]
            else:
                self._leaf(tree.points.take(slice(node.lo, node.hi)), who[np.argsort(-above, kind="stable")])

    def _needed(self, node: Node, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors that this node may hold something for, their upper bounds)."""
        label, (least, most) = self.anchors.label[who], node.labels
        who = who[(label >= least) & (label <= most)] if self.same else who[(label != least) | (label != most)]
        middle, reach = self.anchors.vectors[who] @ node.centre, self.length[who] * node.radius
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        below, above = middle - reach - slack, middle + reach + slack
        floor = np.maximum(self.low[who], self.score[who, :, -1])
        some = ((above[:, None] >= floor) & (below[:, None] <= self.high[who])).any(axis=1)
        return who[some], above[some]

    def _leaf(self, points: Points, who: np.ndarray) -> None:
        scores = (self.anchors.vectors[who] @ points.vectors.T).astype(np.int64)
        self.compared += scores.size
        agree = self.anchors.label[who][:, None] == points.label
        allowed = agree & (self.anchors.row[who][:, None] != points.row) if self.same else ~agree
        n, k = len(points.row), self.k
        place = n - 1 - np.arange(n)  # points of a leaf are in the order of ids
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[who, w], self.score[who, w, -1])
            fit = allowed & (scores >= floor[:, None]) & (scores <= self.high[who, w][:, None])
            some = np.flatnonzero(fit.any(axis=1))
            if not len(some):
                continue
            rank = np.where(fit[some], scores[some] * n + place, _NONE)
            best = np.argpartition(rank, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), (len(some), n))
            found = np.take_along_axis(rank, best, 1)
            score = np.where(found == _NONE, _NONE, np.take_along_axis(scores[some], best, 1))
            ids = np.where(found == _NONE, _LAST, points.id[best])
            me = who[some]
            score, ids = np.concatenate((self.score[me, w], score), 1), np.concatenate((self.id[me, w], ids), 1)
            order = np.lexsort((ids, -np.maximum(score, -_LAST)), axis=-1)[:, :k]
            self.score[me, w], self.id[me, w] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column, scale: int) -> DataFrame:
    """(row, id, label, vector, anchor) of the rows that take part, dealt by direction; written."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))

    def floored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for n in np.unique(frame["x"].map(len)).tolist():
                part = frame[frame["x"].map(len) == n]
                x = np.floor(scale * np.stack(part["x"].to_numpy())) if n else np.zeros((len(part), 0))
                signs = x @ np.random.default_rng(SEED).normal(size=(n, DIRECTIONS)) > 0
                yield pd.DataFrame({"id": part["id"].to_numpy(), "label": part["label"].to_numpy(), "vector": list(x), "anchor": part["anchor"].to_numpy(), "side": signs @ (1 << np.arange(DIRECTIONS))})

    dealt = rows.mapInPandas(floored, "id long, label long, vector array<double>, anchor boolean, side long").withColumn("row", F.monotonically_increasing_id())
    dealt = materialise(dealt, "whole")  # row numbers hold once they are written
    size = dealt.agg(F.count("*"), F.sum(F.size("vector"))).first()
    cores = dealt.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-8 * (size[1] or 0) // TREE_BYTES), min(cores, -(-size[0] // (16 * LEAF))), 1)
    return materialise(dealt.repartitionByRange(parts, "side", "row"), "vectors")


def _searched(points: DataFrame, anchors: Points, low: np.ndarray, high: np.ndarray, same_label: bool, k: int) -> DataFrame:
    """(anchor, window, score, id): the best k of all points for every anchor (by its index) and window."""
    shared = points.sparkSession.sparkContext.broadcast((anchors, low, high))  # at most BLOCK_BYTES

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, low, high = shared.value
        state = Search(anchors, low, high, same_label, k)
        width, held, n = anchors.vectors.shape[1], [], 0

        def close() -> None:
            for points in Points.by_length(pd.concat(held)) if held else ():
                if points.vectors.shape[1] == width:
                    state.add(BallTree(points))
            held.clear()

        for frame in batches:
            held.append(frame)
            n += len(frame)
            if 8 * width * n >= TREE_BYTES:
                close()
                n = 0
        close()
        a, w, r = np.nonzero(state.score != _NONE)
        yield pd.DataFrame({"anchor": a, "window": w, "score": state.score[a, w, r], "id": state.id[a, w, r]})

    found = points.select("row", "id", "label", "vector").mapInPandas(search, "anchor long, window long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _named(points: DataFrame, anchors: np.ndarray, positives: np.ndarray, scores: np.ndarray) -> Callable[..., Column]:
    """Ids and score for the indices of an anchor and its window."""
    shared = points.sparkSession.sparkContext.broadcast((anchors, positives, scores))  # at most BLOCK_BYTES

    @F.pandas_udf("anchor_id long, positive_id long, positive_score long")
    def named(a: pd.Series, w: pd.Series) -> pd.DataFrame:
        ids, who, score = shared.value
        return pd.DataFrame({"anchor_id": ids[a], "positive_id": who[a, w], "positive_score": score[a, w]})

    return named


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Components become ``floor(scale * x)``; a score is an inner product of such vectors, larger ones come first, ties by
    smaller id (a null id after all others). The positives of an anchor (a row where ``anchor`` holds) are the first
    rows of its label but itself; the negatives of a positive are the first rows of other labels whose score is
    between ``window`` percent of the positive's. Rows with a null label, a null vector, or null or non-finite
    components take no part; vectors of different lengths do not meet. Rows are their own, whatever their ids:
    repeated rows are each other's positives, and a repeated anchor has its results twice. Labels are whole numbers.
    Other columns are not read; an empty table gives an empty result. Scores of 2**53 and more raise. ``anchor`` is to
    hold for a small share of the rows: blocks of anchors (``BLOCK_BYTES`` with their results) are sent to all
    partitions, one block after the other.
    """
    spark = vectors.sparkSession
    points = _whole_vectors(vectors, id_col, vector_col, label_col, anchor, scale)
    asked = points.where("anchor").select("row", "id", "label", "vector", F.size("vector").alias("width"))
    path = new_path(spark, "negatives")
    kinds = asked.groupBy("width").count().orderBy("width").collect()  # as many as there are lengths of vectors
    blocks = 0
    for width, count in kinds:
        parts = -(-count * 8 * (width + 2 * positives * (negatives + 1)) // BLOCK_BYTES)
        for part in range(parts):
            mine = asked.where((F.col("width") == width) & (F.pmod(F.xxhash64("row"), F.lit(parts)) == part))
            anchors = next(Points.by_length(mine.toPandas()), None)
            if anchors is None:
                continue
            n = len(anchors.row)
            near = _searched(points, anchors, np.full((n, 1), _NONE + 1), np.full((n, 1), _LAST), True, positives).toPandas()
            score, who = np.full((n, positives), -1, np.int64), np.full((n, positives), _LAST)
            place = (near["anchor"].to_numpy(), near["rank"].to_numpy() - 1)
            score[place], who[place] = near["score"].to_numpy(), near["id"].to_numpy()
            # Percents of a negative score are an empty window: its lower end is the upper one.
            low, high = np.where(score < 0, 1, -(-window[0] * score // 100)), np.where(score < 0, 0, window[1] * score // 100)
            found = _searched(points, anchors, low, high, False, negatives).withColumn("of", _named(points, anchors.id, who, score)("anchor", "window"))
            real = lambda c: F.nullif(c, F.lit(_LAST))
            found = found.select(real(F.col("of.anchor_id")).alias("anchor_id"), real(F.col("of.positive_id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), real(F.col("id")).alias("negative_id"), F.col("of.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
            found.write.mode("append").parquet(path)
            blocks += 1
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
