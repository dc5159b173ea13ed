"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned over training windows, hits verified.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A window is ``n`` consecutive words of
a benchmark item; a shorter item is one window. Every word of a document inside an occurrence of a window is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.llm.shared import materialise

WINDOW = 13
#: Benchmark text, in bytes, of one broadcast set; a larger benchmark is scanned block by block.
BLOCK_BYTES = 4_000_000
#: Window starts that are hashed at once; bounds the memory of a very long text.
AT_ONCE = 1 << 16

_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCAN_TYPE = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class WindowSet:
    """Different windows of some items, hashed, with the items that have them. Windows of one length are sorted by hash."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # ids of all items' words, one item after the other
    items: list[str | None]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # hashes, starts in words, ends in owners, owners
    last: bool = True  # of its benchmark

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], n: int = WINDOW) -> WindowSet:
        vocabulary: dict[bytes, int] = {}
        parts, starts, owners, at = [], {}, {}, 0
        for k, (_, text) in enumerate(rows):
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.uint64)
            if not len(ids):
                continue
            size = min(n, len(ids))
            count = len(ids) - size + 1
            parts.append(ids)
            starts.setdefault(size, []).append(np.arange(at, at + count))
            owners.setdefault(size, []).append(np.full(count, k))
            at += len(ids)
        words = np.concatenate([np.empty(0, np.uint64), *parts])
        by_length = {size: _different(words, size, np.concatenate(starts[size]), np.concatenate(owners[size])) for size in starts}
        return cls(vocabulary, words, [x for x, _ in rows], by_length)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, hit words as merged (start, end) rows, numbers of the items found."""
        words = words_of(text)
        found: set[int] = set()
        edges = np.zeros(len(words) + 1, np.int32)
        if words and self.by_length:
            ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            for size, (hashes, starts, ends, owners) in self.by_length.items():
                if size > len(words):
                    continue
                met = np.zeros(len(hashes), bool)
                at = np.nonzero(unknown[size:] == unknown[:-size])[0]
                for part in (at[i : i + AT_ONCE] for i in range(0, len(at), AT_ONCE)):
                    keys = _hash(ids, part, size)
                    k, stop = np.searchsorted(hashes, keys, "left"), np.searchsorted(hashes, keys, "right")
                    while len(part := part[k < stop]):  # once, unless different windows share a hash
                        k, stop = k[k < stop], stop[k < stop]
                        same = _equal(self.words, starts[k], ids, part, size)
                        np.add.at(edges, part[same], 1)
                        np.add.at(edges, part[same] + size, -1)
                        met[k[same]] = True
                        k = k + 1
                for k in np.nonzero(met)[0].tolist():
                    found.update(owners[ends[k] : ends[k + 1]].tolist())
        inside = np.concatenate(([0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]))
        turn = np.diff(inside)
        return len(words), np.stack((np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]), axis=1), found


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows of ``size`` words at these places of a and b are the same."""
    same = np.ones(len(at), bool)
    for k in range(size):
        same &= a[at + k] == b[bt + k]
    return same


def _different(words: np.ndarray, size: int, starts: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows (starts and items) the different ones: hashes, starts, and for each the items that have it, once."""
    hashes = _hash(words, starts, size)
    order = np.argsort(hashes, kind="stable")
    hashes, starts, owners = hashes[order], starts[order], owners[order]
    opens = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    first = np.maximum.accumulate(np.where(opens, np.arange(len(starts)), 0))
    odd = np.nonzero(~_equal(words, starts, words, starts[first], size))[0]
    if len(odd):  # different windows share a hash: those that are not the first are told apart by their words
        window = [words[s : s + size].tobytes() for s in starts[odd].tolist()]
        group = np.unique(window, return_inverse=True)[1]
        opener = np.full(group.max() + 1, len(starts))
        np.minimum.at(opener, group, odd)
        first[odd] = opener[group]
    pairs = np.unique(np.stack((first, owners), axis=1), axis=0)
    kept, at = np.unique(pairs[:, 0], return_index=True)
    return hashes[kept], starts[kept], np.append(at, len(pairs)), pairs[:, 1]


def _hash(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of the windows of ``size`` ids at ``starts``."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(starts), np.uint64)
        for k in range(size):
            out = out * _BASE + ids[starts + k]
        out ^= out >> np.uint64(29)
        return out * _BASE


def _segments(rows: DataFrame, n: int, size: int) -> DataFrame:
    """(item, text): items cut into texts of at most about ``size`` bytes that share n - 1 words, so that no window is lost."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for item, text in zip(frame["item"], frame["text"], strict=True):
                if len(text) <= size // 4:
                    yield pd.DataFrame({"item": [item], "text": [text]})
                    continue
                words = words_of(text)
                begin = 0
                while True:
                    end, held = begin, 0
                    while end < len(words) and (held < size or end - begin < 2 * n):
                        held += len(words[end]) + 1
                        end += 1
                    yield pd.DataFrame({"item": [item], "text": [b" ".join(words[begin:end]).decode("utf-8", "surrogatepass")]})
                    if end == len(words):
                        break
                    begin = end - n + 1

    return rows.mapInPandas(cut, "item string, text string")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[WindowSet]:
    """The different rows of the benchmark as window sets of about BLOCK_BYTES of text each; long items are cut."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BLOCK_BYTES:
        yield WindowSet.of([(r["item"], r["text"]) for r in rows.collect()], n)
        return
    parts = -(-2 * size // BLOCK_BYTES)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), 0
        for frame in batches:
            sizes = held + frame["text"].map(lambda t: len(t.encode("utf-8", "surrogatepass"))).cumsum()
            held = int(sizes.iloc[-1]) if len(sizes) else held
            yield frame.assign(part=part, block=sizes // BLOCK_BYTES)

    dealt = _segments(rows.repartition(parts), n, BLOCK_BYTES // 16).repartition(parts).mapInPandas(numbered, "item string, text string, part int, block long")
    dealt = materialise(dealt, "benchmark")
    # Blocks of different parts are put together as long as they fit: at most a row for every half block of the benchmark.
    sizes = sorted((r["part"], r["block"], r["size"]) for r in dealt.groupBy("part", "block").agg(F.sum(F.octet_length("text")).alias("size")).collect())
    groups: list[list[tuple[int, int]]] = []
    held = BLOCK_BYTES + 1
    for part, block, size in sizes:
        if held + size > BLOCK_BYTES:
            groups.append([])
            held = 0
        groups[-1].append((part, block))
        held += size
    for k, group in enumerate(groups):
        mine = reduce(Column.__or__, [(F.col("part") == p) & (F.col("block") == b) for p, b in group])
        yield replace(WindowSet.of([(r["item"], r["text"]) for r in dealt.where(mine).collect()], n), last=k == len(groups) - 1)


def _scanner(docs: DataFrame, windows: WindowSet):
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    @F.pandas_udf(SCAN_TYPE)
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            n, spans, found = shared.value.scan(text)
            items = sorted({x for k in found if (x := shared.value.items[k]) is not None})
            out.append((n, int((spans[:, 1] - spans[:, 0]).sum()), items, [{"start": a, "end": b} for a, b in spans.tolist()]))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans"])

    return scan


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, into: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items (ids as sorted strings), spans (hit words, end exclusive).

    Null and empty texts have no words. An item without words has no window; an item without an id marks hits and
    is not listed; repeated items count once. An empty benchmark hits nothing. All rows and columns of ``docs`` stay.
    The benchmark is collected in blocks of a bounded size and each block is broadcast. With several blocks the
    documents are numbered and written once and scanned once for each block, from which only hits and numbers are kept.
    """
    row = "__row" + "_" * max(map(len, docs.columns))  # no column of docs
    found, numbered = [], None
    for windows in _blocks(benchmark, item_col, item_text_col, n):
        if windows.last and numbered is None:
            return docs.withColumn(into, _scanner(docs, windows)(F.col(text_col)))
        if numbered is None:
            numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        hits = numbered.select(row, _scanner(docs, windows)(F.col(text_col)).alias("h")).where("h.n_hit > 0")
        found.append(materialise(hits, "hits"))  # written, so that one worker never holds two blocks

    @F.pandas_udf("n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    def merge(several: pd.Series) -> pd.DataFrame:
        out = []
        for hits in several:
            spans: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for h in hits for s in h["spans"]):
                if spans and s[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s[1])
                else:
                    spans.append(list(s))
            out.append((sum(e - s for s, e in spans), sorted({x for h in hits for x in h["items"]}), [{"start": s, "end": e} for s, e in spans]))
        return pd.DataFrame(out, columns=["n_hit", "items", "spans"])

    # At most one row for each block and document.
    every = reduce(DataFrame.unionByName, found).groupBy(row).agg(F.collect_list("h").alias("several"))
    merged = every.select(row, merge("several").alias(row + "m"))
    size = _scanner(docs, WindowSet.of([]))(F.col(text_col))["n_words"]
    m, none = F.col(row + "m"), "array<string>"
    hits = F.struct(
        size.alias("n_words"),
        F.coalesce(m["n_hit"], F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(m["items"], F.array().cast(none)).alias("items"),
        F.coalesce(m["spans"], F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
    return numbered.join(merged, row, "left").select(*docs.columns, hits.alias(into))


def is_contaminated(hits: Column, share: int = 20) -> Column:
    """Whether at least one in ``share`` words of a document is hit."""
    return (hits["n_hit"] > 0) & (share * hits["n_hit"] >= hits["n_words"])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    out, at, k = [], 0, 0
    begin = 0
    for i, m in enumerate(_WORD.finditer(text)):
        if k == len(spans):
            break
        if i == spans[k][0]:
            begin = m.start()
        if i == spans[k][1] - 1:
            out.append(text[at:begin])
            at, k = m.end(), k + 1
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without contamination, with their own columns.

    ``documents``: contaminated rows (:func:`is_contaminated`) go, all others stay as they are.
    ``spans``: all rows stay, and hit passages are cut from their texts; null texts stay null.
    """
    hits = "__hits"
    found = with_hits(docs, benchmark, text_col=text_col, into=hits, **names)
    if mode == "documents":
        return found.where(~F.coalesce(is_contaminated(F.col(hits)), F.lit(False))).drop(hits)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [(s["start"], s["end"]) for s in x]) if t and len(x) else t for t, x in zip(texts, spans, strict=True)], dtype=object)

    return found.withColumn(text_col, cut(F.col(text_col), F.col(hits)["spans"])).drop(hits)
