"""What several operators need: a shared folder, materialised tables, components, sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.session import forget, materialise, new_path, release, shared_dir

__all__ = ["connected_components", "forget", "materialise", "may_be_in", "merged", "new_path", "release", "shared_dir", "smallest_of_component", "sorted_groups"]


#: Words of 64 bits of a filter: 8 MB, whatever it is made of.
FILTER_WORDS = 1 << 20


def may_be_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes that holds for all in the only column of ``keys`` and, while they are few, for few others.

    It keeps rows that a join would drop out of its shuffle. Its size is fixed; with many keys it holds for nearly
    everything, and the join alone decides.
    """
    h = F.col(keys.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int"))
    found = keys.groupBy(h.bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # FILTER_WORDS rows at most
    words = np.zeros(FILTER_WORDS, np.int64)
    words[found["w"].to_numpy()] = found["bits"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        x = hashes.to_numpy().astype(np.int64)
        return pd.Series((shared.value[x & (FILTER_WORDS - 1)] >> (x >> 40 & 63) & 1).astype(bool))

    return test


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with edges (a, b): rows (node, component), component its smallest node.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds
    logarithmic in the longest path. Every step is a grouped minimum (combined before its shuffle) and an
    equi-join that Spark may split where a key is hot; no neighbourhood is ever collected. Loops, null ends
    and repeated edges are ignored; nodes without an edge to another node have no row.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = edges.where("a is not null and b is not null and a <> b").select(hi, lo).distinct()
    now, before = materialise(now, "edges"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialise(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        forget(now)
        now = after
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if print_of == before:
            break
        before = print_of
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the classes of a and b are joined; a label is the smallest index of its class."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def smallest_of_component(components: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(node, value): for every node of ``components`` the smallest value over its component, of (node, value); nulls do not count.

    Nodes are numbers of their own, so that a node whose value is null still joins its neighbours.
    """
    named = components.join(values.select("node", value), "node")
    least = named.groupBy("component").agg(F.min(value).alias(value))
    return named.select("node", "component").join(least, "component").select("node", value)


def sorted_groups(batches: Iterator[pd.DataFrame], key: str, rows: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """From batches sorted by ``key``: frames of about ``rows`` rows or more that never cut a run of equal keys."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= rows and batch[key].iloc[0] != batch[key].iloc[-1]:
            whole = pd.concat(held, ignore_index=True)
            last = int((whole[key].to_numpy() != whole[key].iloc[-1]).nonzero()[0][-1]) + 1
            yield whole.iloc[:last]
            held = [whole.iloc[last:]]
            n = len(held[0])
    if held:
        yield pd.concat(held, ignore_index=True)
