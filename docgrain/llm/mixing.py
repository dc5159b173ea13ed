"""Temperature mixing: source shares to a power, found by bisection, realised as budgeted permutations of blocks.

Source weights are ``share ** exponent``, normalised. The exponent (0: all sources alike, 1: as they are) is the
largest for which the weights' entropy reaches a target, or the smallest for which no source is repeated more often
than a limit. Each source then deals its documents into blocks, permutes the blocks anew for every epoch, and takes
blocks, and part of the last one, until its token budget is spent.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.llm.shared import materialise

#: Blocks into which every source is dealt. Their sums are what is ordered; single documents only where a budget ends.
BLOCKS = 2048
#: Copies of one row that one task numbers; more are numbered in parts, by several tasks, with the same result.
COPIES = 4096
#: Exponents tried in one pass over the source sums.
GRID = 33
PASSES = 7


def token_count(text: Column) -> Column:
    """Number of whitespace-separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _at(sums: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy in nats, largest number of epochs) over the sources' token sums."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("e")
    total = sums.agg(F.sum("tokens")).first()[0]
    rows = sums.where("tokens > 0").select("tokens", grid).withColumn("raw", F.pow(F.col("tokens") / float(total), F.col("e")))
    # entropy = ln Z - sum(raw ln raw) / Z
    out = rows.groupBy("e").agg(F.sum("raw").alias("z"), F.sum(F.col("raw") * F.log("raw")).alias("s"), F.max(F.col("raw") / F.col("tokens")).alias("most"))
    return sorted((r["e"], math.log(r["z"]) - r["s"] / r["z"], r["most"] / r["z"] * budget) for r in out.collect())


def find_exponent(sums: DataFrame, budget: float, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent in [0, 1] for a target entropy (nats) and, or, a limit of epochs; the larger of the two.

    Both fall as the exponent grows, so each is bisected, by a grid in each pass. A target out of reach gives the
    nearest end: 0 for too high an entropy, 1 for one below the natural one or a limit that even 1 exceeds.
    """
    if sums.where("tokens > 0").isEmpty():
        return 1.0

    def last(ok, lo: float = 0.0, hi: float = 1.0) -> tuple[float, float]:
        """Ends of the interval in which ``ok``, true up to some exponent, turns."""
        for _ in range(PASSES):
            seen = _at(sums, np.linspace(lo, hi, GRID).tolist(), budget)
            good = [x[0] for x in seen if ok(x)]
            if not good:
                return lo, lo
            if len(good) == len(seen):
                return hi, hi
            lo, hi = good[-1], seen[len(good)][0]
        return lo, hi

    by_entropy = last(lambda x: x[1] >= entropy)[0] if entropy is not None else 0.0 if repeats is not None else 1.0
    by_repeats = last(lambda x: x[2] > repeats)[1] if repeats is not None else 0.0
    return max(by_entropy, by_repeats)


def mixture(docs: DataFrame, source_col: str = "source", evenness: float | None = 0.95, repeats: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """(source, tokens, share, weight, budget, epochs) for every source, of (source, n_tokens) rows.

    ``evenness`` is the target entropy as a share of the largest possible one, that of equal weights. ``budget``
    defaults to all tokens of the table. A null source is a source of its own; a source without tokens
    has share, weight and budget 0. Budgets are whole tokens, rounded.
    """
    sums = materialise(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    live = sums.where("tokens > 0").count()
    e = find_exponent(sums, float(budget), None if evenness is None else evenness * math.log(max(live, 1)), repeats)
    share = F.when(F.lit(total) > 0, F.col("tokens") / F.lit(float(max(total, 1)))).otherwise(0.0)
    raw = F.when(F.col("tokens") > 0, F.pow("share", F.lit(e))).otherwise(0.0)
    out = sums.withColumn("share", share).withColumn("raw", raw)
    z = out.agg(F.sum("raw")).first()[0] or 1.0
    out = out.withColumn("weight", F.col("raw") / F.lit(z))
    out = out.withColumn("budget", F.round(F.col("weight") * float(budget)).cast("long"))
    epochs = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(0.0)
    return materialise(out.select("source", "tokens", "share", "weight", "budget", epochs.alias("epochs"), F.lit(e).alias("exponent")), "mixture")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", evenness: float | None = 0.95, repeats: float | None = 4.0, budget: int | None = None, seed: int = 7) -> DataFrame:
    """The mixed training set: (id, source, n_tokens, epoch, block, weight), one row for each use of a document.

    Epochs count from 0; ``block`` is the document's place, from 0, among its source's blocks in that epoch's
    permutation. Every epoch before the last takes all documents of the source; the last takes blocks in order and
    then, of one block, the documents that come first by hash while the sum of their tokens fits what is left of
    the budget. So a source uses at most its budget, and less by less than one document. Documents without tokens
    (null and empty texts) come with every full epoch. Null ids and sources are kept; repeated rows are documents
    of their own; equal hashes are ordered by id and size. An empty table gives an empty result. Other columns
    are not read. How the rows are dealt over partitions makes no difference. Either of ``evenness`` and ``repeats`` may be None; with both None nothing is tempered.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.col(text_col)).alias("print"))
    rows = materialise(rows.groupBy("id", "source", "n_tokens", "print").agg(F.count("*").alias("n")), "counted")
    # Each copy of a row has a number, and a block by it: copies fill all blocks alike, and other rows keep theirs.
    last = F.floor((F.col("n") - 1) / COPIES)
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if (rows.agg(F.max("n")).first()[0] or 0) > COPIES:
        parts = parts.repartition("id", "print", "part")
    first = F.col("part") * COPIES
    rows = parts.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id", "print", "copy", F.lit(seed)), F.lit(BLOCKS)).cast("int"))
    rows = materialise(rows.select("id", "source", "n_tokens", "print", "slot"), "tokens")
    shares = mixture(rows, "source", evenness, repeats, budget)

    # Everything that is ordered below is a sum over a block: at most BLOCKS rows for a source and epoch.
    blocks = rows.groupBy("source", "slot").agg(F.sum("n_tokens").alias("held"))
    sized = blocks.join(shares.select(F.col("source").alias("s"), "budget", "tokens", "weight"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")
    rest = F.when(F.col("tokens") > 0, F.col("budget") - full * F.col("tokens")).otherwise(0)
    epochs = sized.withColumn("full", full).withColumn("rest", rest).withColumn("epoch", F.explode(F.expr("sequence(0, full)")))
    epochs = epochs.withColumn("key", F.xxhash64("source", "slot", "epoch", F.lit(seed)))

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "slot"], kind="stable").reset_index(drop=True)
        before = frame["held"].cumsum() - frame["held"]
        last = frame["epoch"] == frame["full"]
        frame["left"] = np.where(last, np.maximum(frame["rest"] - before, 0), frame["held"])
        frame["block"] = np.arange(len(frame), dtype=np.int32)
        frame = frame[~last | (frame["left"] > 0)]
        return frame[["source", "slot", "epoch", "block", "left", "held", "weight"]]

    cuts = epochs.groupBy("source", "epoch").applyInPandas(order, "source string, slot int, epoch int, block int, left long, held long, weight double")
    cuts = materialise(cuts.withColumnRenamed("source", "s").withColumnRenamed("slot", "k"), "cuts")

    # Blocks of one source spread over all partitions: (source, slot) is the join key.
    used = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).drop("s", "k")
    whole = used.where("left >= held").select("id", "source", "n_tokens", "epoch", "block", "weight")
    part = used.where("left < held").withColumn("key", F.xxhash64("id", "print", "epoch", F.lit(seed)))

    ordered = Window.partitionBy("source", "epoch", "slot").orderBy("key", F.col("id").asc_nulls_first(), "n_tokens", "print").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("sum", F.sum("n_tokens").over(ordered)).where("sum <= left").select("id", "source", "n_tokens", "epoch", "block", "weight")
    out = whole.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "epoch", "block", "weight")
