"""Metadata of chunks: dates, places, cases, types, parties and entities, by native expressions.

Vocabularies are parameters; the defaults are those of the reports that the engine was first made for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as T

# Vocabularies.
ITEM_TYPES = ["pistol", "rifle", "shotgun", "revolver", "handgun", "ar-15", "ak-47", "machine gun", "carbine", "firearm", "glock", "suppressor", "silencer"]
INCIDENT_TYPES = ["shooting", "trafficking", "theft", "straw purchase", "smuggling", "illegal sale", "homicide", "robbery", "diversion", "recovery", "seizure", "arson", "explosion", "bombing", "fire"]
MAKERS = ["glock", "smith & wesson", "ruger", "sig sauer", "remington", "colt", "beretta", "winchester", "springfield", "taurus", "mossberg", "kel-tec", "fn herstal", "savage", "henry", "marlin", "kimber", "walther", "heckler & koch", "browning"]
REPORT_TYPES = [
    ("AFMER", ("afmer", "firearms manufacturing and export", "manufacturing and export")),
    ("NFCTA", ("nfcta", "national firearms commerce and trafficking")),
    ("Firearms-Commerce", ("firearms commerce", "commerce report")),
    ("Theft-Loss", ("theft", "theft_loss", "theft/loss", "stolen")),
    ("Explosives-EIR", ("explosives incident", "eir", "explosive incident")),
    ("Arson", ("arson", "incendiary")),
    ("Tracing", ("tracing center", "etrace", "trace data", "ntc")),
    ("FFL-Statistics", ("ffl statistics", "licensee statistics", "ffl inventory")),
]
STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi",
    "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
)
NOISE = (
    "The", "This", "That", "Atf", "Bureau", "United", "States", "Report", "Section", "Page", "Figure", "Table", "Across", "Multiple", "Overview",
    "Summary", "Notes", "Trends", "Origin", "Connections", "Distribution", "Investigators", "A", "An", "Document", "Date", "Case", "No", "Annual",
    "Statistical", "Update", "Key", "License", "Street", "City", "State", "Chief", "Branch", "Name", "Total", "Source", "Number", "Amount", "Value",
    "Code", "Type", "Year", "Month", "Count", "Rate", "Percent", "Average", "Column", "Row", "Data", "Reference", "Rank", "Ranking", "Index", "Item",
    "Class", "Category", "Sub", "Other", "All", "Each", "Per", "January", "February", "March", "April", "June", "July", "August", "September",
    "October", "November", "December", "However", "Therefore", "Furthermore", "Additionally", "Moreover", "Including", "Following", "During",
    "Within", "Between", "Through", "Under", "Over", "Into", "From", "About", "With", "Without", "Although", "Because", "Since", "While", "Where",
    "When", "Continued", "Appendix", "Exhibit", "Attachment", "Enclosure", "Foreword", "Preface", "Introduction", "Background", "Purpose", "Scope",
    "Authority", "Policy", "Regulation", "Compliance", "Commerce", "Industry", "Licensed", "Manufacturer", "Dealer", "Importer", "Exporter",
    "Federal", "National", "International",
)
COMPANY_WORDS = ("Inc", "LLC", "Corp", "Company", "Firearms", "Arms", "Guns")
PROPER = r"\b([A-Z][a-z]+(?:\s+(?:&\s+)?[A-Z][a-z]+){0,3})\b"
SELLER = r"\bsold (?:to|by)\s+([A-Z][a-z]+(?:\s+(?:&\s+)?[A-Z][a-z]+){0,3})"
BUYER = r"\b(?:purchased|bought) by\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"


@dataclass(frozen=True)
class Vocabulary:
    """Words that metadata are found by."""

    items: list[str] = field(default_factory=lambda: list(ITEM_TYPES))
    incidents: list[str] = field(default_factory=lambda: list(INCIDENT_TYPES))
    makers: list[str] = field(default_factory=lambda: list(MAKERS))
    reports: list[tuple[str, tuple[str, ...]]] = field(default_factory=lambda: list(REPORT_TYPES))
    states: list[str] = field(default_factory=lambda: list(STATES))
    noise: list[str] = field(default_factory=lambda: list(NOISE))


def _empty() -> Column:
    return F.array().cast("array<string>")


def state(text: Column, names: list[str]) -> Column:
    """The state that is named first; of those that begin at one place the longest; empty if none."""
    return F.initcap(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"\b(" + _any_of(names) + r")\b", 1))


def _any_of(names: Iterable[str]) -> str:
    """Pattern of any of the names, longer ones first, as a tree of their letters: where none begins, a letter or two tell."""
    tree: dict[str, list[str]] = {}
    for name in names:
        if name:
            tree.setdefault(name[0], []).append(name[1:])
    ways = [re.escape(letter) + _any_of(rests) for letter, rests in sorted(tree.items())]
    if not ways:
        return ""
    ends = "" in names
    return f"(?:{'|'.join(ways)}){'?' if ends else ''}" if ends or len(ways) > 1 else ways[0]


def makers(text: Column, names: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Sorted canonical makers that the canonical text names as whole words, acronyms included."""
    from docgrain.functions.text import ALIASES, CORPORATE_SUFFIXES

    canonical = lambda n: " ".join(w for w in n.lower().replace("&", " and ").replace(".", " ").replace(",", " ").replace("/", " ").split() if w not in CORPORATE_SUFFIXES)
    known = {canonical(n): canonical(n) for n in names} | ALIASES | (aliases or {})
    padded = F.concat(F.lit(" "), T.entity_name(text, aliases), F.lit(" "))
    hits = lambda s: F.array_compact(F.array(*[F.when(F.contains(s, F.lit(f" {key} ")), F.lit(name)) for key, name in known.items()]))
    return F.array_sort(F.array_distinct(T.once(padded, hits)))


def proper_names(text: Column, noise: list[str]) -> Column:
    """Valid title-cased spans in order, repeats included."""
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROPER), F.lit(1))
    return F.filter(spans, lambda s: T.is_valid_span(s, noise))


def enrich(chunks: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``chunks`` (text, content_type; optionally document_date, source_name) with their metadata columns.

    Dates that are there stay; tables and charts without one take a year from the text. Tables, charts and figures
    get no parties and no names beyond the vocabularies, so that headers do not become entities.
    """
    v = vocabulary or Vocabulary()
    text, structured = F.col("text"), F.col("content_type").isin("table", "chart", "figure")
    had = F.coalesce(F.col("document_date"), F.lit("")) if "document_date" in chunks.columns else F.lit("")
    source = F.coalesce(F.col("source_name"), F.lit("")) if "source_name" in chunks.columns else F.lit("")
    date = F.when(had != "", had).otherwise(T.first_date(text))
    out = chunks.withColumns({"document_date": date, "incident_date": date})
    year = F.when((F.col("document_date") == "") & F.col("content_type").isin("table", "chart"), T.first_year(text)).otherwise(F.col("document_date"))
    items, incidents = T.vocabulary_hits(text, v.items), T.vocabulary_hits(text, v.incidents)
    seller, buyer = F.regexp_extract(text, SELLER, 1), F.regexp_extract(text, BUYER, 1)
    party = lambda name: F.when(structured | (name == ""), _empty()).otherwise(F.array(name))
    out = out.withColumns(
        {
            "document_date": year,
            "location": T.location(text),
            "case_reference": T.strip(T.case_reference(text)),
            "report_type": T.first_label(F.concat_ws(" ", source, F.substring(text, 1, 200)), v.reports),
            "us_state": state(text, v.states),
            "item_type": F.coalesce(F.try_element_at(items, F.lit(1)), F.lit("")),
            "incident_type": F.coalesce(F.try_element_at(incidents, F.lit(1)), F.lit("")),
            "manufacturers": makers(text, v.makers),
            "sellers": party(seller),
            "buyers": party(buyer),
        }
    )
    title = lambda a: F.transform(a, F.initcap)
    place = F.when(F.col("location") == "", _empty()).otherwise(F.array("location"))
    names = F.when(structured, _empty()).otherwise(proper_names(text, v.noise))
    entities = F.array_sort(F.array_distinct(F.concat(names, title(F.col("manufacturers")), title(items), title(incidents), place)))
    out = out.withColumn("entities", F.when(structured, F.slice(entities, 1, 15)).otherwise(F.slice(entities, 1, 25)))
    company = lambda e: F.exists(F.array(*[F.lit(w) for w in COMPANY_WORDS]), lambda w: F.contains(e, w))
    return out.withColumn("organizations", F.filter("entities", company))
