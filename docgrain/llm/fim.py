"""Fill-in-middle: a text is cut in two places and put together as prefix, suffix, middle or suffix, prefix, middle.

A unit is a run of ASCII letters or any other code point. While units are counted, every ``EVERY`` of them leave a
checkpoint of bytes and code points behind. A cut looks up the checkpoint before it by binary search and rescans the
few bytes from there, so that a text keeps no list of its units, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units from one checkpoint to the next.
EVERY = 256
#: Bytes that are scanned at once; bounds the memory beside the text itself.
BLOCK = 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")
#: In 100 texts: those that stay as they are, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _starts(data: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes of data[begin:end] begin a unit, which begin a code point)."""
    part = data[begin:end]
    letter, lead = _LETTER[part], _LEADS[part]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[:1] = begin > 0 and _LETTER[data[begin - 1]]
    return np.where(letter, ~before, lead), lead


@dataclass
class UnitIndex:
    """Checkpoints of a text in UTF-8: before unit ``units[i]`` there are ``at[i]`` bytes and ``points[i]`` code points."""

    data: np.ndarray
    n: int  # units of the text
    n_points: int
    units: np.ndarray
    at: np.ndarray
    points: np.ndarray

    @classmethod
    def of(cls, text: bytes, every: int = EVERY, block: int = BLOCK) -> UnitIndex:
        data = np.frombuffer(text, np.uint8)
        units, at, points, n, n_points = [], [], [], 0, 0
        for begin in range(0, len(data), block):
            starts, leads = _starts(data, begin, begin + block)
            place = np.flatnonzero(starts)
            kept = place[-n % every :: every]
            if len(kept):
                units.append(n + (-n % every) + every * np.arange(len(kept)))
                at.append(begin + kept)
                points.append(n_points + np.cumsum(leads)[kept] - 1)
            n += len(place)
            n_points += int(np.count_nonzero(leads))
        joined = (np.concatenate([np.zeros(1, np.int64), *x]) for x in (units, at, points))  # the first stands for the empty text
        return cls(data, n, n_points, *joined)

    def cut(self, unit: int, block: int = BLOCK) -> tuple[int, int]:
        """(bytes, code points) before this unit; those of the whole text where it has no more units."""
        if unit >= self.n:
            return len(self.data), self.n_points
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        missing, begin, points = unit - int(self.units[k]), int(self.at[k]), int(self.points[k])
        width = min(block, 4 * EVERY)
        while True:
            starts, leads = _starts(self.data, begin, begin + width)
            place = np.flatnonzero(starts)
            if missing < len(place):
                here = int(place[missing])
                return begin + here, points + int(np.count_nonzero(leads[:here]))
            missing -= len(place)
            points += int(np.count_nonzero(leads))
            begin += width
            width = block


def assemble(text: bytes, draws: Sequence[int], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text with its four draws."""
    index = UnitIndex.of(text, every)
    p, s, m = (x.encode() for x in sentinels)
    if not text or any(x in text for x in (p, s, m)) or draws[2] % 100 >= 100 - plain:
        return index.n, "plain", None, None, text
    a, b = sorted(d % (index.n + 1) for d in draws[:2])
    (i, before), (j, upto) = index.cut(a), index.cut(b)
    view = memoryview(text)
    if draws[3] % 100 < suffix_first:
        return index.n, "spm", before, upto - before, b"".join((s, view[j:], p, view[:i], m, view[i:j]))
    return index.n, "psm", before, upto - before, b"".join((p, view[:i], s, view[j:], m, view[i:j]))


_TYPES = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim", salt: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, every: int = EVERY) -> DataFrame:
    """``docs`` with a struct ``into``: n units, form, prefix_chars, middle_chars, output.

    Where a text is cut, and its form, follow from the SHA-256 of ``salt:id``: prefix and middle end at two of its
    n + 1 places between units. ``plain`` texts in 100 stay as they are, and so do empty ones and those in which a
    sentinel occurs, so that :func:`restored` always gives the text back; their prefix_chars and middle_chars are
    null. A null text counts as empty, a null id as an empty one; equal rows get equal results. All rows and other
    columns stay, whatever their names; a column named ``into`` is replaced. Nothing is shuffled.
    """
    if any(a != b and a in b for a in sentinels for b in sentinels) or len({x[:1] for x in sentinels} & {c for x in sentinels for c in x[1:]}):
        raise ValueError("the first character of a sentinel must not occur again in any of them")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        made = [assemble(t.as_py(), d.as_py(), plain, suffix_first, sentinels, every) for t, d in zip(texts, drawn, strict=True)]
        columns = zip(*made, strict=True) if made else [[]] * len(_TYPES)
        # The output's bytes are UTF-8 as the text's are: nothing is decoded.
        arrays = [pa.array(list(c), pa.binary() if k == "output" else t).cast(t) for c, (k, t) in zip(columns, _TYPES.items(), strict=True)]
        return pa.StructArray.from_arrays(arrays, names=list(_TYPES))

    return docs.withColumn(into, cut(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), draws))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    parts = F.array(F.split(output, "|".join(re.escape(x) for x in sentinels), -1))  # an array of one, so that each text is split once
    psm = F.transform(parts, lambda p: F.concat(p[1], p[3], p[2]))[0]
    spm = F.transform(parts, lambda p: F.concat(p[2], p[3], p[1]))[0]
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
