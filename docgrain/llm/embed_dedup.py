"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash is the signed axis that a rotated unit vector is closest to; a rotation is three rounds of random signs and
a Walsh-Hadamard transform. A table joins a few hashes; a vector enters its own bucket and those that come next when
one hash moves to its second axis. Within a bucket all pairs are compared by cosine in double precision, tile by tile.
Buckets give sums of links and a spanning forest, never pairs. Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.shared import connected_components, materialise, merged, smallest_of_component, sorted_groups

TABLES = 6
HASHES = 2
PROBES = 3
SEED = 17
#: Cosines that are computed at once.
TILE = 1 << 21
#: A bucket with more classes than this is dealt out again, in pairs of parts, over many tasks.
LONG_BUCKET = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; very large and very small rows are scaled first."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Keys (rows x tables x probes) of unit vectors; keys of different tables or dimensions never agree."""
    n, dim = unit.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = unit
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, second, loss = [], [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), d)) / np.sqrt(d)
            size = np.abs(y)
            a = size.argmax(axis=1)
            top = size[rows, a].copy()
            size[rows, a] = -1
            b = size.argmax(axis=1)
            first.append(2 * a + (y[rows, a] < 0))
            second.append(2 * b + (y[rows, b] < 0))
            loss.append(top - size[rows, b])
        first, second = np.stack(first, 1), np.stack(second, 1)
        order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")
        for p in range(probes):
            pick = first.copy()
            if p:
                # The p-th probe moves the hash whose second axis is p-th nearest; beyond the last hash, the two nearest at once.
                moved = order[:, p - 1 : p] if p <= hashes else order[:, :2]
                np.put_along_axis(pick, moved, np.take_along_axis(second, moved, 1), 1)
            key = np.full(n, (dim * 1000 + t) * 31 + 7, np.int64)
            for h in range(hashes):
                key = key * (2 * d) + pick[:, h]
            out[:, t, p] = key
    return out


def links_of_bucket(key: int, part: np.ndarray, node: np.ndarray, size: np.ndarray, unit: np.ndarray, keys: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each class, root index of each class) by the pairs of one bucket.

    A pair that meets in several buckets counts in the one with the smallest key of the earliest table. With more
    than one part, only pairs from different parts count: those of one part meet in a bucket of their own.
    """
    m, t_all, probes = len(node), keys.shape[1], keys.shape[2]
    table = int(np.nonzero((keys[0] == key).any(axis=1))[0][0])
    links, root = np.zeros(m, np.int64), np.arange(m)
    across = part.min() != part.max()
    step = max(1, TILE // m)
    for at in range(0, m, step):
        cos = unit[at : at + step] @ unit[at:].T
        i, j = np.nonzero(cos >= least)
        i, j = i + at, j + at
        ahead = (j > i) & ((part[i] != part[j]) if across else True)
        i, j = i[ahead], j[ahead]
        for begin in range(0, len(i), TILE // 16):
            a, b = i[begin : begin + TILE // 16], j[begin : begin + TILE // 16]
            root = merged(root, a, b)
            earlier = np.zeros(len(a), bool)
            for t in range(table + 1):
                for p in range(probes):
                    mine = keys[a, t, p]
                    same = (mine[:, None] == keys[b, t]).any(axis=1)
                    earlier |= same & ((mine < key) if t == table else True)
            np.add.at(links, a[~earlier], size[b[~earlier]])
            np.add.at(links, b[~earlier], size[a[~earlier]])
    return links, root


def _bucketed(classes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(node, size, vector, keys) of the classes; vectors and keys as bytes."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["embedding"].map(len).to_numpy()
            for dim in np.unique(dims):
                part = batch[dims == dim]
                unit = unit_rows(np.stack(part["embedding"].to_numpy()))
                keys = bucket_keys(unit, tables, hashes, probes)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "size": part["size"].to_numpy(), "vector": [u.tobytes() for u in unit], "keys": list(keys.reshape(len(unit), -1))})

    return classes.select("node", "size", "embedding").mapInPandas(hashed, "node long, size long, vector binary, keys array<long>")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: near-duplicates by cosine, whatever their labels.

    Rows link where the cosine is at least ``least``, and every link counted is verified; hashing finds nearly all
    (see the tests for its recall). ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable, and ``kept`` tells whether that is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths. Every row is a vector
    of its own, whatever its id: repeated rows link with each other, an id that is given to different vectors joins
    nothing, and a row without an id links like any other but is nobody's component_id. Where no row of a component
    has an id, component_id is null; rows without an id are kept only there. Equal vectors are one class, told apart
    by two 64-bit hashes. Other columns are not read; an empty table gives an empty result. ``hashes`` of 2 suits up
    to some 10**8 vectors, 3 more.
    """
    x = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = rows.select("id", "embedding", valid.alias("valid"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    classes = rows.where("valid").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    # Classes have numbers of their own; they hold once they are written.
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sig = materialise(_bucketed(classes, tables, hashes, probes), "buckets")

    keyed = sig.select("*", F.explode(F.array_distinct("keys")).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > LONG_BUCKET).withColumn("parts", F.ceil(F.col("count") / (LONG_BUCKET // 2)).cast("int"))
    hot = materialise(hot.select("key", "parts"), "hot")
    plain = keyed.select("node", "size", "vector", "keys", "key", F.col("key").alias("bucket"), F.lit(0).alias("part"))
    if not hot.isEmpty():
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        wide = keyed.join(hot, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        wide = wide.select("node", "size", "vector", "keys", "key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "part")
        plain = plain.join(hot, "key", "left_anti").select(*wide.columns).unionByName(wide)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sorted_groups(batches, "bucket", rows=4096):
            bucket = frame["bucket"].to_numpy()
            node, size, part, key = (frame[c].to_numpy() for c in ("node", "size", "part", "key"))
            edges = np.nonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))[0]
            a, b, n = [], [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2:
                    continue
                unit = np.stack([np.frombuffer(v, np.float64) for v in frame["vector"].iloc[lo:hi]])
                keys = np.stack(frame["keys"].iloc[lo:hi].to_numpy()).reshape(hi - lo, tables, probes)
                mine = node[lo:hi]
                links, root = links_of_bucket(int(key[lo]), part[lo:hi], mine, size[lo:hi], unit, keys, least)
                some = np.nonzero((links > 0) | (root != np.arange(hi - lo)))[0]
                a.append(mine[some])
                b.append(mine[root[some]])
                n.append(links[some])
            none = np.empty(0, np.int64)
            yield pd.DataFrame({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b]), "n": np.concatenate([none, *n])})

    met = plain.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(compare, "a long, b long, n long")
    met = materialise(met.groupBy("a", "b").agg(F.sum("n").alias("n")), "links")
    sums = met.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    components = connected_components(met.select("a", "b"))
    ids = smallest_of_component(components, classes, "least").select("node", F.col("least").alias("smallest"))
    found = classes.select("h1", "h2", "node", "size", "least").join(sums, "node", "left").join(ids, "node", "left")
    links = F.col("size") - 1 + F.coalesce("links", F.lit(0))
    found = materialise(found.select("h1", "h2", links.alias("n_links"), F.coalesce("smallest", "least").alias("component_id")), "found")

    # Written first, so that both sides of the join are plain and a hot class can be split.
    out = rows.select("id", F.when(F.col("valid"), F.col("h1")).alias("h1"), "h2").join(found, ["h1", "h2"], "left")
    linked = F.col("n_links").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
