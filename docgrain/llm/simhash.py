"""SimHash near-duplicates: fingerprints, pigeonhole block joins, verified Hamming distance, components.

Two fingerprints that differ in at most k bits agree on at least ``blocks - k`` of ``blocks`` blocks, so every
such pair meets under one key made of ``blocks - k`` blocks. Equal fingerprints are one class from the start;
only one row for each distinct fingerprint and key is shuffled, and a bucket emits the edges of a spanning
forest, never all its pairs.

For similarities that leave far more bits differing than 64-bit blocks can separate (a Jaccard similarity of 0.8
leaves one bit in seven), wide fingerprints of several words are compared. They are split into blocks in several
orders of their bits, and a row stands in each block's bucket as it is and with its least certain bit turned, so that
nearly all such pairs meet. The distance over all bits only names candidates: it gives groups, by spanning forests
again. Inside a group the exact similarity of the sets of shingles decides on each pair that is within the distance
and not joined yet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.llm.shared import connected_components, forget, materialise, may_be_in, merged, smallest_of_component, sorted_groups

SEED = 42
BITS = 64
#: Runs up to this length are compared by shifted columns, all runs of a frame at once.
SHORT_RUN = 48
#: Nodes of a search front that are compared with the rest at once; bounds the memory of a long run.
FRONT = 64
#: Bits of the blocks of wide fingerprints, at least, and the mean size of a bucket that lengthens them.
LEAST_WIDTH, MEAN_BUCKET = 16, 512
#: Chance that a pair at the threshold meets in no block, and how often, of two that differ in one bit of a block, this
#: is the least certain bit of either (the tests measure both).
MISSED, TURNED = 0.001, 0.6
#: Bytes of sets that one task compares at once; groups with more are dealt out in parts.
SET_BYTES = 1 << 25
#: Rows of a large group, those with most candidates, that meet all others before the parts meet each other.
HUBS = 32
#: A bucket with more fingerprints than this is dealt out again, in pairs of parts, over many tasks.
LONG_RUN = 100_000
#: One node in as many is counted to find such buckets.
SEEN = 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def bit_counts(text: str | None, shingle: int, words: int = 1) -> tuple[np.ndarray, int]:
    """How many shingles have each of ``64 * words`` bits set, and the number of shingles.

    Words are runs without space and \\t-\\r, A-Z lower-cased. Fewer than ``shingle``: the whole sequence is the only
    shingle. The first 64 bits are XXH64 itself; further words are mixed from it.
    """
    counts, n = np.zeros(BITS * words, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts, n = counts + _counted(hashes, words), n + len(hashes)
    return counts, n


def _counted(hashes: np.ndarray, words: int) -> np.ndarray:
    bits = [np.unpackbits(_mixed(hashes, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for k in range(words)]
    return np.concatenate([b.sum(axis=0, dtype=np.int64) for b in bits])


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles in order, a bounded number at once."""
    found = [w for w in text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACES).split(b" ") if w] if text else []
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, last = xxhash.xxh64_intdigest, max(1, len(found) - shingle + 1)
    for at in range(0, last, 1 << 15):  # bounds the memory of a very long text
        to = min(at + (1 << 15), last)
        spans = zip(starts[at:to].tolist(), ends[min(at + shingle, len(found)) - 1 :].tolist(), strict=False)
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of hashes; the 0-th is the hash itself."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: a bit is set where it is in over half the shingles' hashes. Null or no word: 0."""
    counts, n = bit_counts(text, shingle)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, shingle)]))


def wide_fingerprint(hashes: np.ndarray, words: int) -> tuple[bytes, bytes]:
    """SimHash of ``64 * words`` bits of distinct shingles, and for each bit how certain it is, from 0 to 15, two in a byte."""
    counts = sum((_counted(hashes[at : at + (1 << 15)], words) for at in range(0, len(hashes), 1 << 15)), np.zeros(BITS * words, np.int64))
    far = np.abs(2 * counts - len(hashes)) / math.sqrt(max(1, len(hashes)))
    sure = np.minimum(15, 8 * far).astype(np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), (sure[::2] | sure[1::2] << 4).tobytes()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets, as sorted arrays."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text, as the signed long with the same bits."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp"))


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all choices of ``blocks - distance`` of the blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    each = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - distance)]


def block_keys(fp: Column, masks: list[int]) -> Column:
    """Array of one key for each mask: a hash of the mask's number and the masked bits."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16) <= distance


def _forest(fp: np.ndarray, node: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """For one run: (smallest node, the others) of each component by Hamming distance, by searches from front to rest."""
    rest = np.arange(len(fp))
    while len(rest) > 1:
        members, front, rest = [rest[:1]], rest[:1], rest[1:]
        while len(front) and len(rest):
            part, front = front[:FRONT], front[FRONT:]
            near = _near(fp[part][:, None], fp[rest][None, :], distance).any(axis=0)
            found, rest = rest[near], rest[~near]
            front = np.concatenate((front, found))
            members.append(found)
        if len(members := np.unique(node[np.concatenate(members)])) > 1:
            yield int(members[0]), members[1:]


def links_of_frame(key: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b), and for every row how many others it is close to (in long runs by a sample), between nodes of equal keys, sorted by key, whose fingerprints (rows of words) differ in at most ``distance`` bits.

    They are a spanning forest of what the pairs within the distance connect.
    """
    first = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
    sizes = np.diff(np.append(first, len(key)))
    root, degree = np.arange(len(key)), np.zeros(len(key), np.int64)
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    for shift in range(1, min(SHORT_RUN, int(sizes.max(initial=1)))):
        same = np.nonzero((key[shift:] == key[:-shift]) & short[:-shift])[0]
        if not len(same):
            break
        near = same[_near(fp[same], fp[same + shift], distance)]
        degree[near] += 1
        degree[near + shift] += 1
        root = merged(root, near, near + shift)
    some = np.nonzero(root != np.arange(len(key)))[0]
    a, b = [node[root[some]]], [node[some]]
    for at, n in zip(first[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
        for k in np.linspace(at, at + n - 1, 32).astype(np.int64):
            degree[at : at + n] += _near(fp[at : at + n], fp[k], distance) * (n // 32)
        for start, others in _forest(fp[at : at + n], node[at : at + n], distance):
            a.append(np.full(len(others), start))
            b.append(others)
    return np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64), degree


def near_edges(keyed: DataFrame, distance: int, degrees: bool = False) -> DataFrame:
    """Edges (a, b) between nodes of (node, fp, key) that share a key and differ in at most ``distance`` bits.

    They are enough to give all components; ``fp`` is a long or, for wide fingerprints, bytes. Rows with the same
    node count as joined already. Buckets of more than LONG_RUN rows are dealt out in parts: every pair of parts is a
    bucket of its own. With ``degrees`` there are also rows (a, null, n): n rows were close to the node in some bucket.
    """
    # One node in SEEN is enough to see which buckets are unusually large; the parts do not change what is found.
    seen = keyed.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SEEN)) == 0).groupBy("key").agg((F.count("*") * SEEN).alias("count"))
    hot = seen.where(F.col("count") > LONG_RUN).withColumn("parts", F.ceil(F.col("count") / (LONG_RUN // 2)).cast("int"))
    hot = materialise(hot.select("key", "parts"), "hot")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sorted_groups(batches, "key"):
            fp = frame["fp"].to_numpy()
            fp = np.frombuffer(b"".join(fp), np.uint64) if fp.dtype == object else fp.view(np.uint64)
            node = frame["node"].to_numpy()
            a, b, degree = links_of_frame(frame["key"].to_numpy(), fp.reshape(len(frame), -1), node, distance)
            edges = pd.DataFrame({"a": a, "b": b}).query("a != b").drop_duplicates()
            if not degrees:
                yield edges
                continue
            yield edges.assign(n=0)
            own, at = np.unique(node[degree > 0], return_inverse=True)
            yield pd.DataFrame({"a": own, "b": pd.array([None] * len(own), "Int64"), "n": np.bincount(at, degree[degree > 0], len(own)).astype(np.int64)})

    dealt = keyed.select("node", "fp", "key")
    if not hot.isEmpty():
        # Part i of a hot bucket goes to every pair of parts (i, j); each pair is a bucket of its own.
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        wide = dealt.join(hot, "key").withColumn("i", part).withColumn("j", other)
        wide = wide.select("node", "fp", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
        dealt = dealt.join(hot, "key", "left_anti").select("node", "fp", "key").unionByName(wide)
    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(compare, "a long, b long" + ", n long" * degrees)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """Near-duplicate groups: (id, fp, component_id) for every row of ``docs``.

    Rows link where fingerprints differ in at most ``distance`` bits (exactly, none is missed), and
    ``component_id`` is the smallest id reachable by links, the row's own included. Null and empty texts have
    fingerprint 0 and link like any other; repeated rows are all returned. A row without an id links like any
    other and takes no part in the minimum; where all ids of a component are null, so is component_id. One id on
    different texts joins nothing. Other columns are not read. An empty table gives an empty result. Ids are whole
    numbers.
    """
    if not distance < blocks <= BITS:
        raise ValueError("there must be more blocks than differing bits")
    sig = materialise(fingerprints(docs, id_col, text_col, shingle), "sig")
    classes = materialise(sig.groupBy("fp").agg(F.min("id").cast("long").alias("least")), "classes")
    # A class is its fingerprint, so that ids play no part in what links.
    keys = F.explode(block_keys(F.col("fp"), block_masks(blocks, distance))).alias("key")
    components = connected_components(near_edges(classes.select(F.col("fp").alias("node"), "fp", keys), distance))
    ids = smallest_of_component(components, classes.withColumnRenamed("fp", "node"), "least").select(F.col("node").alias("fp"), F.col("least").alias("smallest"))
    found = classes.join(ids, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return sig.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def bits_apart(similarity: float, bits: int) -> int:
    """Differing bits, of ``bits``, to expect of texts with this Jaccard similarity of shingles."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def blocks_for(classes: int, similarity: float) -> tuple[int, int]:
    """(bits of a block, number of blocks): blocks lengthen with the logarithm of the classes, so that buckets stay small."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(classes, 1) / MEAN_BUCKET)))
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    meet = same**width + TURNED * width * (1 - same) * same ** (width - 1)
    return width, math.ceil(math.log(MISSED) / math.log(1 - meet))


def drawn_blocks(bits: int, width: int, blocks: int) -> np.ndarray:
    """The bits of each block: blocks split the bits, and again in another order where more blocks are wanted."""
    rng = np.random.default_rng(SEED)
    each = bits // width
    return np.concatenate([rng.permutation(bits)[: each * width].reshape(each, width) for _ in range(-(-blocks // each))])[:blocks]


def wide_keys(fps: list[bytes], sure: list[bytes], chosen: np.ndarray) -> np.ndarray:
    """Keys (rows x 2 blocks): of every block as it is, then with its least certain bit turned."""
    each = np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)
    half = np.frombuffer(b"".join(sure), np.uint8).reshape(len(fps), -1)
    certain = np.stack((half & 15, half >> 4), axis=2).reshape(len(fps), -1)[:, chosen]
    drawn = np.unpackbits(each, axis=1, bitorder="little")[:, chosen].astype(np.int64)  # rows x blocks x width
    own = (drawn << np.arange(chosen.shape[1])).sum(axis=2)
    turned = own ^ (1 << certain.argmin(axis=2))
    return np.concatenate((own * len(chosen) + np.arange(len(chosen)), turned * len(chosen) + np.arange(len(chosen))), axis=1)


def similar_links(fp: np.ndarray, sets: list[np.ndarray], name: np.ndarray, here: np.ndarray, distance: int, similarity: float) -> np.ndarray:
    """For each row the smallest index of its class, by names and by pairs within the distance whose sets are similar.

    Of a pair one row at least must be at home (``here``). A pair that is joined already is passed over; close pairs
    come first, so that few are left in a large class.
    """
    n, size = len(fp), np.array([len(x) for x in sets])
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    root = first[which]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for lo in range(0, n, FRONT):
        hi = min(lo + FRONT, n)
        apart = np.bitwise_count(fp[lo:hi, None] ^ fp[None, lo:]).sum(axis=-1, dtype=np.int16)
        i, j = np.nonzero((apart <= distance) & (np.minimum(size[lo:hi, None], size[lo:]) >= similarity * np.maximum(size[lo:hi, None], size[lo:])))
        apart, i, j = apart[i, j], i + lo, j + lo
        fine = (j > i) & (name[i] != name[j]) & (here[i] | here[j])
        order = np.argsort(apart[fine], kind="stable")
        for x, y in zip(i[fine][order].tolist(), j[fine][order].tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b and jaccard(sets[x], sets[y]) >= similarity:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _linked_names(rows: DataFrame, distance: int, similarity: float) -> DataFrame:
    """(node, component) of the names that similar sets join, of (bucket, component, node, name, fp, shingles, here)."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, group in frame.groupby("component"):
            group = group.sort_values("node")
            name = group["name"].to_numpy()
            wide = np.frombuffer(b"".join(group["fp"]), np.uint64).reshape(len(group), -1)
            root = similar_links(wide, [np.frombuffer(x, "<u4") for x in group["shingles"]], name, group["here"].to_numpy(), distance, similarity)
            a.append(name[root])
            b.append(name)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).query("a != b").drop_duplicates()

    return connected_components(rows.groupBy("bucket").applyInPandas(links, "a long, b long"))


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What is materialised meanwhile reaches Python in batches of few rows: sets of shingles can be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _similar_classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, words: int, slack: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, print, mark) of all texts, and (mark, component) of the classes of equal sets of shingles that have
    several rows or are joined with others; any other class is alone."""
    bits = BITS * words

    @F.pandas_udf("mark binary, sure binary")
    def simhash(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            x = shingle_set(text, shingle)
            fp, sure = wide_fingerprint(x, words)
            out.append((fp + hashlib.md5(x.tobytes()).digest(), sure))
        return pd.DataFrame(out, columns=["mark", "sure"])

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_set(t, shingle).astype("<u4")).tobytes() for t in texts], dtype=object)

    text = F.col(text_col)
    sig = docs.select(F.col(id_col).alias("id"), _print_of(text).alias("print"), simhash(text).alias("s"))
    sig = materialise(sig.select("id", "print", "s.*"), "sig")
    fp = F.substring("mark", 1, bits // 8).alias("fp")
    classes = sig.groupBy("mark").agg(F.min("print").alias("print"), F.count("*").alias("n"), F.first("sure").alias("sure"))
    # Classes have numbers of their own; they hold once they are written.
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    width, blocks = blocks_for(classes.count(), similarity)
    chosen = drawn_blocks(bits, width, blocks)
    near = bits_apart(similarity, bits) + slack

    @F.pandas_udf("array<long>")
    def keys(fps: pd.Series, sure: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(fps), 1000):  # bounds the memory of the drawn bits
            out += list(wide_keys(list(fps.iloc[k : k + 1000]), list(sure.iloc[k : k + 1000]), chosen))
        return pd.Series(out, dtype=object)

    keyed = classes.select("node", fp, F.explode(keys(fp, F.col("sure"))).alias("key"))
    met = materialise(near_edges(keyed, near, degrees=True), "met")
    candidates = connected_components(met.select("a", "b"))

    # One row, with its set, for each class that is a candidate: the sets are made from the texts that are known again.
    # Small groups share a task, large ones have parts.
    candidates = materialise(candidates, "candidates")
    some = classes.where(may_be_in(candidates.select(F.xxhash64("node")))(F.xxhash64("node"))).select("node", "print", fp)
    wanted = materialise(candidates.join(some, "node"), "wanted")
    known = docs.select(text.alias("text"), _print_of(text).alias("print"))
    known = known.where(may_be_in(wanted.select(F.xxhash64("print")))(F.xxhash64("print"))).select("print", set_of("text").alias("shingles"))
    groups = wanted.join(known.groupBy("print").agg(F.first("shingles").alias("shingles")), "print").select("component", "node", "fp", "shingles")
    with _small_batches(docs.sparkSession):
        groups = materialise(groups.withColumn("bytes", F.octet_length("shingles") + 64), "sets")
    sums = groups.groupBy("component").agg(F.sum("bytes").alias("whole"))
    total = sums.agg(F.sum("whole")).first()[0] or 0
    sums = materialise(sums.select("component", F.ceil(F.col("whole") / SET_BYTES).cast("int").alias("parts")), "parts")
    dealt = groups.drop("bytes").join(sums, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    alone = F.pmod(F.xxhash64("component"), F.lit(max(1, 2 * total // SET_BYTES)))
    columns = ["bucket", "component", "node", "name", "fp", "shingles", "here"]

    def in_parts(rows: DataFrame, part: str, here: Column) -> DataFrame:
        bucket = F.when(F.col("parts") == 1, alone).otherwise(F.xxhash64("component", part))
        return rows.withColumn("bucket", bucket).withColumn("here", here).select(*columns)

    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    plain = in_parts(dealt.withColumn("name", F.col("node")), "part", F.lit(True))
    large = not sums.where("parts > 1").isEmpty()
    if large:
        degrees = met.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")).join(candidates, "node")
        degrees = degrees.join(sums.where("parts > 1"), "component")
        hubs = degrees.groupBy("component", F.pmod(F.xxhash64("node"), F.lit(HUBS))).agg(F.max_by("node", F.struct("n", "node")).alias("node"))
        guests = dealt.join(hubs.select("node"), "node").withColumn("name", F.col("node")).withColumn("other", every).where("other <> part")
        plain = plain.unionByName(in_parts(guests, "other", F.lit(False)))
    true = _linked_names(plain, near, similarity)
    if large:
        # Rows of the name that most rows of a group have stay in their part; those of other names go to all parts.
        named = dealt.where("parts > 1").join(true, "node", "left").withColumn("name", F.coalesce(true["component"], "node")).drop(true["component"])
        named = materialise(named, "named")
        most = named.groupBy("component", "name").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("name", F.struct("n", "name")).alias("most"))
        both = named.join(most, "component")
        others = both.where("name <> most").withColumn("other", every)
        again = in_parts(both.where("name = most"), "part", F.lit(True)).unionByName(in_parts(others, "other", F.col("other") == F.col("part")))
        more = _linked_names(again, near, similarity).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        firsts = true.select("component").distinct().withColumn("node", F.col("component"))
        more = more.join(firsts, "component", "left")
        true = true.join(more.select("component", "whole"), "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(
            more.where("node is null").select(F.col("component").alias("node"), F.col("whole").alias("component"))
        )
    true = materialise(true, "joined")
    some = classes.where((F.col("n") > 1) | may_be_in(true.select(F.xxhash64("node")))(F.xxhash64("node"))).select("node", "mark", "n").join(true, "node", "left")
    found = some.where("n > 1 or component is not null").select("mark", F.coalesce("component", "node").alias("component"))
    found = materialise(found, "found")
    for table in (met, candidates, wanted, groups, sums, true, classes):
        forget(table)
    return sig.select("id", "print", "mark"), found


def _print_of(text: Column) -> Column:
    """128 bits by which a text is known again."""
    return F.concat(F.hex(F.xxhash64(text, F.lit(1))), F.lit("-"), F.hex(F.xxhash64(text, F.lit(2))))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 4, slack: int = 15) -> DataFrame:
    """Near-duplicate groups by similarity of shingles: (id, component_id) for every row of ``docs``.

    Rows link where the Jaccard similarity of their sets of shingles is ``similarity`` or more, computed from the sets.
    Candidates are those whose wide fingerprints differ in at most the bits that ``similarity`` leaves on average, and
    ``slack`` more, and meet in a block, as nearly all such pairs do (the tests measure it); all candidates that are
    not joined already are compared, by 32-bit hashes of their shingles. Equal sets are one class. Rows and ids are treated as in :func:`simhash_groups`.
    """
    sig, found = _similar_classes(docs, id_col, text_col, shingle, similarity, words, slack)
    least = _of_groups(sig, found).groupBy("component").agg(F.min("id").cast("long").alias("component_id"))
    found = materialise(found.join(least, "component").select("mark", F.lit(True).alias("grouped"), "component_id"), "ids")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id").cast("long"))
    return sig.join(found, "mark", "left").select(F.col("id").alias(id_col), component.alias("component_id"))


def _of_groups(sig: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``sig`` whose class is in ``found``, with its component."""
    return sig.where(may_be_in(found.select(F.xxhash64("mark")))(F.xxhash64("mark"))).join(found, "mark")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 4, slack: int = 15) -> DataFrame:
    """``docs`` without near-duplicates, with all columns: of each group the row with the smallest id.

    Where rows of a group repeat that id one of them stays, by a hash of its columns; where no row of a group has an
    id, one of them stays all the same. Texts without words are one group.
    """
    sig, found = _similar_classes(docs, id_col, text_col, shingle, similarity, words, slack)
    rows = _of_groups(sig, found).groupBy("component", "id", "print").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "print")).alias("first"))
    kept = materialise(first.select("first.id", "first.print").withColumn("kept", F.lit(True)), "kept")
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["id"]) & (rows["print"] == kept["print"]), "left").select(rows["id"], rows["print"], "n", F.coalesce("kept", F.lit(False)).alias("kept"))
    # What goes, and the kept rows that occur again: these few are grouped, all others only pass an anti-join.
    special = materialise(rows.where("not kept or n > 1").select(F.col("id").alias("__id"), F.col("print").alias("__print"), F.col("kept").alias("__kept")), "special")
    for table in (sig, found, kept):
        forget(table)
    marked = docs.withColumn("__key", _print_of(F.col(text_col)))
    marked = marked.withColumn("__maybe", may_be_in(special.select(F.xxhash64("__id", "__print")))(F.xxhash64(F.col(id_col).cast(sig.schema["id"].dataType), F.col("__key"))))
    same = marked[id_col].eqNullSafe(special["__id"]) & (marked["__key"] == special["__print"])
    sure = marked.where("not __maybe").select(*docs.columns)
    once = sure.unionByName(marked.where("__maybe").join(special, same, "left_anti").select(*docs.columns))
    again = marked.where("__maybe").join(special.where("__kept"), same).select(*docs.columns, "__id", "__print")
    columns = F.struct(*[F.col(c) for c in docs.columns])
    again = again.groupBy("__id", "__print").agg(F.min_by(columns, F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(again)
