"""Vectors: hashed text embeddings, norms, cosine."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import repeat
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions.text import STOP_WORDS

DIM = 384
#: Grams of a task whose slots are remembered; bounds the memory of a task.
KNOWN_GRAMS = 200_000
#: Texts whose slots are in memory at once.
SLICE = 256

#: Bytes of UTF-8 as tokens have them: lower-cased, a space for all that no token has.
_TOKENS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b == 95 else 32 for b in range(256))
_STOP = frozenset(w.encode() for w in STOP_WORDS)


def grams(words: Column) -> Column:
    """Words and pairs of neighbouring words, joined by an underscore; repeats are kept."""
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def _word(digest: Column, k: int) -> Column:
    """The k-th 32-bit word of an MD5 in hex, from the left."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def hash_slot(gram: Column, dim: int = DIM) -> tuple[Column, Column]:
    """(slot, sign) of a gram: its MD5 as a number, modulo ``dim``; the sign is plus where bit 8 is 0."""
    digest = F.md5(gram)
    slot = F.lit(0).cast("long")
    for k in range(4):
        slot = F.pmod(slot * ((1 << 32) % dim) + _word(digest, k), F.lit(dim))
    sign = F.when(F.shiftright(_word(digest, 3), 8).bitwiseAND(F.lit(1).cast("long")) == 0, 1).otherwise(-1)
    return slot.cast("int"), sign


def _content_bytes(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_TOKENS).split() if len(w) > 1 and w not in _STOP]


def content_words(text: str | None) -> list[str]:
    """What :func:`docgrain.functions.text.content_tokens` gives for one text."""
    return b" ".join(_content_bytes(text)).decode("ascii").split()


def text_vector(text: str | None, dim: int, known: dict[bytes, int]) -> np.ndarray:
    """The unit vector of a text, zero without content tokens; ``known`` remembers the slots of grams, twice each and one more for a minus."""
    words = _content_bytes(text)
    grams = [*words, *map(b"_".join, zip(words, words[1:], strict=False))]
    place = np.fromiter(map(known.get, grams, repeat(-1)), np.int64, len(grams))
    new = np.nonzero(place < 0)[0]
    names = [grams[i] for i in new.tolist()]
    digests = np.frombuffer(b"".join([md5(name).digest() for name in names]), ">u4").reshape(-1, 4).astype(np.int64)
    slot = np.zeros(len(new), np.int64)
    for k in range(4):
        slot = (slot * ((1 << 32) % dim) + digests[:, k]) % dim
    place[new] = 2 * slot + (digests[:, 3] >> 8 & 1)
    if room := max(KNOWN_GRAMS - len(known), 0):
        known.update(zip(names[:room], place[new[:room]].tolist(), strict=True))
    sums = np.bincount(place >> 1, weights=1.0 - 2.0 * (place & 1), minlength=dim)
    norm = sqrt((sums * sums).sum())
    return sums / norm if norm else sums


def sparse_embedding(text: str | None, dim: int, known: dict[bytes, int]) -> list[tuple[int, float]]:
    """(slot, weight) of a text, slots ascending."""
    vector = text_vector(text, dim, known)
    slots = np.nonzero(vector)[0]
    return list(zip(slots.tolist(), vector[slots].tolist(), strict=True))


def hash_embedding(docs: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """Sparse unit vectors of texts: (id, slot, weight). Texts without content tokens have no row.

    A text's vector is made where the text is, in Arrow batches of at most SLICE texts; nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                whole = np.stack([text_vector(text.as_py(), dim, known) for text in part.column(1)])
                rows, slots = np.nonzero(whole)
                ids = part.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(slots.astype(np.int32)), pa.array(whole[rows, slots])], names=[id_col, "slot", "weight"])

    return docs.select(id_col, text_col).mapInArrow(embed, f"`{id_col}` {kind}, slot int, weight double")


def embedding(text: Column, dim: int = DIM) -> Column:
    """The vector of :func:`hash_embedding` as an array of ``dim`` numbers; all zero without content tokens."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, int] = {}
        for texts in batches:
            values = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                values[i] = text_vector(text.as_py(), dim, known)
            yield pa.ListArray.from_arrays(np.arange(0, dim * len(texts) + 1, dim, dtype=np.int32), pa.array(values.ravel()))

    return embed(text)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_normalize(a: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))
