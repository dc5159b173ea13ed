"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are shares of hashed byte 1- to 3-grams of the words of the whole text, lower-cased. Families are learned,
too: languages whose mean features are closest are joined, so that any set of labels can be learned.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Largest number of different training texts of each language (a bound on what reaches the driver).
PER_LANGUAGE = 1500
#: Of all languages together.
ALL_LANGUAGES = 8000
DIMENSIONS = 1 << 12
UNKNOWN = "und"
#: Bytes whose grams are counted at once; bounds the memory of a very long text.
AT_ONCE = 1 << 18

_TO_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_ROWS = np.uint32(2654435761)


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed grams; zero for a text without letters."""
    out = np.zeros(DIMENSIONS, np.float32)
    if not has_letter(text):
        return out
    data = text.lower().encode("utf-8", "surrogatepass").translate(_TO_WORDS)
    data = b" " + b" ".join(data.split()) + b" "
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    for at in range(0, len(codes), AT_ONCE):
        part = codes[at : at + AT_ONCE + 2]
        two = part[:-1] << 8 | part[1:]
        three = two[:-1] << 8 | part[2:]
        for k, grams in enumerate((part, two, three)):
            grams = grams[: AT_ONCE]  # grams that begin in this part
            keys = ((grams + np.uint32(k << 24)) * _ROWS) >> np.uint32(20)
            out += np.bincount(keys, minlength=DIMENSIONS).astype(np.float32)
    return np.sqrt(out / out.sum())


def has_letter(text: str | None) -> bool:
    """Whether a text has any letter."""
    return bool(text) and any(map(str.isalpha, text))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, y in -1 and 1) by full-batch Adam; the classes weigh alike."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ w + b))
        pull = (-2 * weight * y * slack).astype(np.float32)
        g = np.append(pull @ x + decay * w, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b


def group_languages(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Families: the two closest groups of languages are joined until about the square root of their number is left."""
    groups = [[name] for name in sorted(means)]
    unit = {k: v / max(1e-12, float(np.linalg.norm(v))) for k, v in means.items()}
    while len(groups) > max(1, round(len(means) ** 0.5)):
        near = lambda p: np.mean([unit[a] @ unit[b] for a in groups[p[0]] for b in groups[p[1]]])
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: (near(p), -p[0], -p[1]))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


@dataclass
class LanguageModel:
    """Families, a linear SVM for each family against the others, one for each pair of languages of a family."""

    families: list[list[str]]
    family_w: np.ndarray
    family_b: np.ndarray
    pairs: list[list[tuple[int, int]]]  # for each family, indices of its languages
    pair_w: list[np.ndarray]
    pair_b: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        names = np.array(langs, dtype=object)
        families = group_languages({str(k): x[names == k].mean(axis=0) for k in sorted(set(langs))})
        of = {lang: i for i, f in enumerate(families) for lang in f}
        family = np.array([of[k] for k in langs])
        fw, fb, pairs, pw, pb = [], [], [], [], []
        for i, members in enumerate(families):
            w, b = fit_svm(x, np.where(family == i, 1.0, -1.0).astype(np.float32)) if len(families) > 1 else (np.zeros(x.shape[1], np.float32), 1.0)
            fw.append(w)
            fb.append(b)
            mine = list(combinations(range(len(members)), 2))
            models = []
            for p, q in mine:
                rows = (names == members[p]) | (names == members[q])
                models.append(fit_svm(x[rows], np.where(names[rows] == members[p], 1.0, -1.0).astype(np.float32)))
            pairs.append(mine)
            pw.append(np.stack([w for w, _ in models]) if models else np.empty((0, x.shape[1]), np.float32))
            pb.append(np.array([b for _, b in models]))
        return cls(families, np.stack(fw), np.array(fb), pairs, pw, pb)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); a text without letters, or a model without languages, gives (und, 0)."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        by_family = self.family_w @ x + self.family_b
        f = int(by_family.argmax())
        score = float(_logistic(3 * by_family[f]))
        members = self.families[f]
        if len(members) == 1:
            return members[0], score
        wins, margin = np.zeros(len(members)), np.zeros(len(members))
        for (p, q), z in zip(self.pairs[f], self.pair_w[f] @ x + self.pair_b[f], strict=True):
            wins[p if z >= 0 else q] += 1
            margin[p] += z
            margin[q] -= z
        best = max(range(len(members)), key=lambda k: (wins[k], margin[k], -k))
        mine = [z if p == best else -z for (p, q), z in zip(self.pairs[f], self.pair_w[f] @ x + self.pair_b[f], strict=True) if best in (p, q)]
        return members[best], score * float(_logistic(3 * min(mine)))


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language and a letter: at most ``per_language`` different texts of each, those with the smallest hashes.

    Only features, of DIMENSIONS numbers each, reach the driver. Without such rows the model knows no language.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    rows = docs.where(lang.isNotNull() & text.isNotNull()).select(text.alias("text"), lang.alias("lang"))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text", F.lit(3)))
    known = rows.select("lang").distinct().count()
    if not known:
        return LanguageModel([], np.empty((0, DIMENSIONS)), np.empty(0), [], [], [])
    per_language = max(1, min(per_language, ALL_LANGUAGES // known))
    # Copies count once; the limit on the row number is applied before the shuffle, too.
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = rows.select("lang", "h").distinct().withColumn("place", order).where(F.col("place") <= per_language).drop("place")
    drawn = rows.join(F.broadcast(least), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype(np.float16).tobytes() if has_letter(t) else None for t in texts], dtype=object)

    got = drawn.select("lang", packed("text").alias("x")).where("x is not null").collect()
    if not got:
        return LanguageModel([], np.empty((0, DIMENSIONS)), np.empty(0), [], [], [])
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the order of arrival must not matter
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return LanguageModel.fit(x, [r["lang"] for r in got])


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang and score, of the whole text alone.

    Null texts and texts without a letter get ``und`` and 0. All rows and columns stay; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats for each family and pair

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(into, predict(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    """The fold that is not learned from: CRC-32 of the id's text is 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; learned from the rows that are not held out."""
    model = fit_language_model(docs.where(~held_out(F.col(id_col))), text_col, lang_col, per_language)
    found = with_language(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "text", "language")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
