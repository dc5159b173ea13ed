"""Entity resolution: names to canonical forms, near-equal names of one type joined in the order they are first seen."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as T

THRESHOLD = 0.88


class Forms:
    """Canonical forms of one type and block, in the order in which they came; a new form joins the one it is most like."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.order: dict[str, int] = {}
        self.by_length: dict[int, list[str]] = {}  # a ratio of r needs lengths of which the shorter is at least r / (2 - r) of the longer

    def add(self, form: str) -> None:
        """A form that stands for itself."""
        if form not in self.order:
            self.order[form] = len(self.order)
            self.by_length.setdefault(len(form), []).append(form)

    def place(self, form: str) -> str:
        """The earlier form that this one joins, of equally like ones the earliest; else itself, which is then added."""
        if form in self.order:
            return form
        best, at, n, least = form, self.threshold, len(form), self.threshold / (2 - self.threshold)
        near = [f for k in range(int(n * least), int(n / least) + 2) for f in self.by_length.get(k, ())]
        matcher = SequenceMatcher(None)
        for other in sorted(near, key=self.order.__getitem__):
            matcher.set_seqs(form, other)
            if matcher.real_quick_ratio() >= at and matcher.quick_ratio() >= at:
                ratio = matcher.ratio()
                if ratio > at or (ratio == at and best == form):
                    best, at = other, ratio
        if best == form:
            self.add(form)
        return best


def resolve(names: DataFrame, threshold: float = THRESHOLD, aliases: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(name, type, canonical) of distinct (name, type); ``names`` has name, type, seq.

    Canonical forms that agree are one. Within a type and a block (the first two characters) a new form joins the
    earlier one that it is most like, from ``threshold`` on, else it stands for itself. Only distinct forms of a block
    meet in a task; empty forms stay empty. ``known`` (type, canonical) are the forms of earlier runs: they come first
    and stay as they are, so that a registry grows batch by batch (:func:`grow`).
    """
    forms = names.withColumn("form", T.entity_name(F.col("name"), aliases))
    distinct = forms.groupBy("type", "form").agg(F.min("seq").alias("first")).withColumn("old", F.lit(False))
    if known is not None:
        earlier = known.select("type", F.col("canonical").alias("form")).distinct()
        new = distinct.join(earlier, ["type", "form"], "left_anti")
        distinct = new.unionByName(earlier.select("type", "form", F.lit(None).cast(distinct.schema["first"].dataType).alias("first"), F.lit(True).alias("old")))
    blocks = distinct.where("form <> ''").withColumn("block", F.substring("form", 1, 2))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        known_forms, out = Forms(threshold), []
        frame = frame.assign(new=~frame["old"]).sort_values(["new", "first", "form"])
        for form, old in zip(frame["form"], frame["old"], strict=True):
            if old:
                known_forms.add(form)
            out.append((form, form if old else known_forms.place(form)))
        return pd.DataFrame({"type": frame["type"].iloc[0], "form": [x for x, _ in out], "canonical": [y for _, y in out]})

    mapped = blocks.groupBy("type", "block").applyInPandas(join, "type string, form string, canonical string")
    rows = forms.select("name", "type", "form").distinct().join(mapped, ["type", "form"], "left")
    return rows.select("name", "type", F.coalesce("canonical", F.lit("")).alias("canonical"))


def grow(known: DataFrame | None, mapping: DataFrame) -> DataFrame:
    """The registry (type, canonical) after a batch was resolved against it."""
    found = mapping.where("canonical <> ''").select("type", "canonical")
    return (found if known is None else known.select("type", "canonical").unionByName(found)).distinct()


def remap(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations (src, dst, ...) with canonical ends; those that become loops or have an empty end go."""
    one = mapping.groupBy("name").agg(F.min("canonical").alias("canonical"))
    out = relations
    for end in ("src", "dst"):
        out = out.join(one.select(F.col("name").alias(end), F.col("canonical").alias(f"__{end}")), end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    return out.where("src <> dst and src <> '' and dst <> ''").select(*relations.columns)
