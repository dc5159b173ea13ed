"""Packing tokenised documents into sequences: patterns of few lengths, fitted to the histogram of lengths.

Pieces are counted by length. All patterns of one, two or three lengths that fill a sequence exactly are enumerated;
non-negative least squares find how often each is to be used so that together they make up the histogram. The counts
are rounded, and what they leave over is packed by best fit, decreasing, on the histogram too. The plan therefore has
a size that depends on the capacity and not on the number of documents. Every piece then finds its place by itself,
from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrain.llm.shared import materialise

CAPACITY = 2048
#: Lengths that take part in patterns, the most frequent ones; the others are left to best fit.
LENGTHS = 2048
#: Rounds of the least-squares fit; each brings in one pattern for each length at most.
ROUNDS = 24
#: Ways to round repeat counts: what is added before they are cut to whole numbers. The one with the fewest sequences counts.
ROUND_UP = (0.5, 0.25, 0.0, -0.5, -1.0)
#: Words that a worker remembers the ids of, and the longest of them, in bytes.
REMEMBERED, LONGEST = 1 << 19, 64
#: Bytes of text that are encoded at once; a longer text by itself.
AT_ONCE = 1 << 23

#: How a tokenizer of lower-case words treats text before its merges: white space ends a token and is dropped.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters of Latin-1 and marks after them, but for the apostrophe: to such a tokenizer, a token of letters and one of marks.
_SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_LOWER = re.compile("[a-zß-öø-ÿ]+")


class Encoder(dict):
    """Ids of texts by a tokenizer, as little-endian unsigned 32-bit numbers.

    Where the tokenizer is one of ``WORDS``, what stands between ASCII white space is encoded by itself and remembered,
    and simple words go straight to its merges; the ids are those of the whole text. Other tokenizers get whole texts.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for every core already
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer, parts = Tokenizer.from_str(tokenizer), json.loads(tokenizer)
        self.model = self.tokenizer.model
        special = [t["content"] for t in parts["added_tokens"]]
        self.by_word = all(parts[k] == v for k, v in WORDS.items()) and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]) and not any(re.search(r"\s", t) or re.match(_SIMPLE, t) for t in special)
        if self.by_word:
            self.bytes_of = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text if text.isascii() else text.translate(self.bytes_of))]) if _LOWER.fullmatch(text) else self.whole(text)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)  # what is used again comes back from there
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        """Ids of a text by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's begin, and their end).

        Arrow numbers the words and splits each different one into lower-case letters and marks, or leaves it whole;
        each different part is looked up once.
        """
        if not self.by_word:
            each = [self.whole(t.as_buffer().to_pybytes().decode("utf-8", "replace")) for t in texts]
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *map(len, each)]) // 4
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        simple = pc.extract_regex(coded.dictionary, _SIMPLE)
        letters, marks = pc.struct_field(simple, "letters"), pc.struct_field(simple, "marks")
        parts = pa.concat_arrays([pc.coalesce(pc.utf8_lower(letters), coded.dictionary), pc.coalesce(marks, pa.scalar(""))]).dictionary_encode()
        known = [self[w] for w in parts.dictionary.cast(pa.binary()).to_pylist()]
        pool, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        code = parts.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()].ravel()  # two parts a word
        counts = size[code]
        ends = np.concatenate(([0], np.cumsum(counts)))
        begins = (np.cumsum(size) - size)[code] - ends[:-1]
        ids = pool[np.repeat(begins, counts) + np.arange(ends[-1])]
        return ids, ends[2 * (words.offsets.to_numpy() - words.offsets[0].as_py())]


_encoders: dict[str, Encoder] = {}


def _encoder(digest: str, tokenizer: Broadcast[str]) -> Encoder:
    """The one of this process, with the words that it remembers."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(tokenizer.value)
    return _encoders[digest]


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of documents: id, piece, start, length, ids_crc32, and where the row was made: part, and nth of its part and length.

    ``tokenizer`` is the text of a tokenizer's JSON file. A document is its ids and ``end_id``; only one that is longer
    than ``capacity`` is cut, into pieces of that length and a last one that may be shorter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a file of a few MB
    digest = sha256(tokenizer.encode()).hexdigest()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, end = _encoder(digest, shared), np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            edges = np.flatnonzero(np.diff(sizes // AT_ONCE, prepend=0, append=-1)) if len(sizes) else []
            for lo, hi in zip([0, *edges[:-1]], edges, strict=True):
                ids, bounds = encoder.encode(texts.slice(lo, hi - lo))
                owner, start, length, crc, nth = [], [], [], [], []
                for k, (b, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for at in range(b, e + 1, capacity):
                        piece = ids[at : min(at + capacity, e)].tobytes()
                        if at + capacity > e:
                            piece += end
                        n = len(piece) // 4
                        owner.append(lo + k)
                        start.append(at - b)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        nth.append(seen[n])
                        seen[n] += 1
                start = np.array(start, np.int64)
                numbers = (start // capacity, start, np.array(length, np.int64), np.array(crc, np.int64), np.full(len(start), part, np.int32), np.array(nth, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner, pa.int64())), *map(pa.array, numbers)], names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece long, start long, length long, ids_crc32 long, part int, nth long")


def patterns(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """All multisets of one, two or three of the lengths that sum to the capacity: rows of three, filled up with zeros."""
    lengths = np.unique(lengths[lengths > 0])
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    two = lengths[(2 * lengths >= capacity) & (lengths < capacity)]
    two = two[there[capacity - two]]
    found.append(np.stack([two, capacity - two, np.zeros_like(two)], 1))
    for long in lengths[(3 * lengths >= capacity) & (lengths < capacity - 1)]:
        middle = lengths[(lengths <= long) & (2 * lengths >= capacity - long) & (lengths < capacity - long)]
        middle = middle[there[capacity - long - middle]]
        found.append(np.stack([np.full_like(middle, long), middle, capacity - long - middle], 1))
    return np.concatenate(found).astype(np.int64)


def fit(wanted: np.ndarray, made_of: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts of patterns, not negative, whose lengths make up ``wanted`` (counts by length) in least squares.

    An active-set method: every round brings in the patterns that would lower the error most, one for each length at
    most, solves for all that are in (conjugate gradients), and steps towards that solution as far as no count gets
    negative; counts that reach zero leave. Errors are weighed by length, that is, counted in tokens.
    """
    size = len(wanted)
    weight = np.arange(size, dtype=float)
    weight[0] = 0

    def made(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(rows[:, k], x, size) for k in range(3))

    def gain(error: np.ndarray, rows: np.ndarray) -> np.ndarray:
        error = weight * error
        return error[rows].sum(axis=1)

    def solve(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        error = weight * wanted - made(x, rows)
        g = gain(error, rows)
        step, norm = g, g @ g
        enough = 1e-8 * norm
        for _ in range(100):
            if norm <= enough:
                break
            moved = made(step, rows)
            a = norm / max(moved @ moved, 1e-300)
            x, error = x + a * step, error - a * moved
            g = gain(error, rows)
            step, norm = g + (g @ g) / norm * step, g @ g
        return x

    x, inside = np.zeros(len(made_of)), np.zeros(len(made_of), bool)
    slope = gain(weight * wanted, made_of)
    least = 1e-6 * max(float(slope.max(initial=0)), 1e-300)
    for _ in range(rounds):
        ahead = np.flatnonzero((slope > least) & ~inside)
        if not len(ahead):
            break
        ahead = ahead[np.argsort(-slope[ahead], kind="stable")][: 16 * size]
        while len(ahead):  # those that are first at each of their lengths, then the first of what shares no length with them
            rank = np.full(size, len(ahead))
            for k in range(3):
                np.minimum.at(rank, made_of[ahead, k], np.arange(len(ahead)))
            rank[0] = -1
            lengths = made_of[ahead]
            chosen = ((rank[lengths] == np.arange(len(ahead))[:, None]) | (lengths == 0)).all(axis=1)
            inside[ahead[chosen]] = True
            taken = np.zeros(size, bool)
            taken[lengths[chosen]] = True
            taken[0] = False
            ahead = ahead[~taken[lengths].any(axis=1)]
        while inside.any():
            active = np.flatnonzero(inside)
            goal = solve(made_of[active], x[active])
            below = goal <= 1e-9
            if not below.any():
                x[active] = goal
                break
            now = x[active]
            share = np.where(below, now / np.maximum(now - goal, 1e-300), 1.0).min()
            x[active] = np.where(below & (now + share * (goal - now) <= 1e-9), 0, now + share * (goal - now))
            inside[active[below & (x[active] <= 1e-9)]] = False
            x[~inside] = 0
        slope = gain(weight * wanted - made(x, made_of), made_of)
    return x


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit, decreasing, of counts by length: (sequences, ((length, times), ...)) of equal sequences."""
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    free = 0  # bit r: there are sequences with r tokens left

    def put(left: int, n: int, content: tuple[tuple[int, int], ...]) -> None:
        nonlocal free
        room.setdefault(left, []).append((n, content))
        free |= 1 << left

    for length in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[length])
        while todo:
            above = free >> length
            if above:
                left = length + (above & -above).bit_length() - 1
                n, content = room[left].pop()
                if not room[left]:
                    free ^= 1 << left
            else:
                left, n, content = capacity, -(-todo // (capacity // length)), ()
            times = left // length
            whole = min(n, todo // times)
            if whole:
                put(left - whole and left - times * length, whole, (*content, (length, times)))
            todo -= whole * times
            n -= whole
            if n and todo:
                put(left - todo * length, 1, (*content, (length, todo)))
                todo, n = 0, n - 1
            if n and content:
                put(left, n, content)
    return [group for groups in room.values() for group in groups]


@dataclass
class Plan:
    """Places of pieces by length and rank: from ``key`` on, ``times`` to a sequence, the first of them ``sequence``, at ``offset``."""

    keys: np.ndarray
    times: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    n_sequences: int
    n_fitted: int  # of the sequences, those that the fitted patterns make

    @classmethod
    def of(cls, counts: np.ndarray, capacity: int = CAPACITY, lengths: int = LENGTHS) -> Plan:
        """A plan for counts by length (index 0 is not used)."""
        left = counts.astype(np.int64)
        common = np.sort(np.argsort(-left, kind="stable")[:lengths])
        made_of = patterns(common[left[common] > 0], capacity)
        some = np.zeros_like(left)
        some[common] = left[common]
        repeats = fit(some, made_of)
        order = np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]
        contents = [tuple((int(n), int(t)) for n, t in zip(*np.unique(row[row > 0], return_counts=True), strict=True)) for row in made_of[order]]
        best: tuple[list, int] | None = None
        for up in ROUND_UP:
            groups, rest = [], left.copy()
            for n, content in zip(np.floor(repeats[order] + up).astype(int).tolist(), contents, strict=True):
                n = min(n, *(int(rest[length]) // t for length, t in content))
                if n > 0:
                    groups.append((n, content))
                    for length, t in content:
                        rest[length] -= n * t
            fitted = sum(n for n, _ in groups)
            groups += best_fit(rest, capacity)
            if best is None or sum(n for n, _ in groups) < sum(n for n, _ in best[0]):
                best = groups, fitted
        groups, fitted = best
        rows, used, sequence = [], np.zeros_like(left), 0
        for n, content in groups:
            offset = 0
            for length, t in content:
                rows.append(((length << 40) + int(used[length]), t, sequence, offset))
                used[length] += n * t
                offset += length * t
            sequence += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*table.T, sequence, fitted)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        key = (length << 40) + rank
        k = np.searchsorted(self.keys, key, "right") - 1
        nth = key - self.keys[k]
        return self.sequences[k] + nth // self.times[k], self.offsets[k] + nth % self.times[k] * length


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Documents are cut into pieces of at most ``capacity`` tokens, and these packed into as few sequences of that size
    as patterns and best fit can; a sequence has no gap from its first token on. A null text is empty and has the end
    id alone. Rows are documents of their own, whatever their ids; other columns are not read; an empty table gives an
    empty result. What goes to the driver are counts by length. Which of several pieces of one length stands where
    depends on how the rows are dealt; the number of sequences and their lengths do not.
    """
    pieces = materialise(tokenised(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    by_part = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    totals = by_part.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # a row for each length: as many as the capacity
    counts = np.zeros(capacity + 1, np.int64)
    counts[totals["length"].to_numpy()] = totals["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(Plan.of(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = shared.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = pieces.join(offsets, ["part", "length"]).withColumn("place", place("length", F.col("before") + F.col("nth")))
    return placed.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
