"""Text expressions: tokens, names, dates, quality, redaction. All are native columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list of content tokens.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "at", "from", "as", "is", "are", "was", "were", "be", "been", "this",
    "that", "these", "those", "it", "its", "his", "her", "their", "our", "your", "they", "we", "you", "i",
)

# Corporate suffixes and the acronyms that stand for whole names.
CORPORATE_SUFFIXES = ("inc", "llc", "ltd", "corp", "co", "company", "gmbh", "plc", "lp", "llp", "incorporated", "corporation", "limited")
ALIASES = {
    "s and w": "smith and wesson",
    "sw": "smith and wesson",
    "h and k": "heckler and koch",
    "hk": "heckler and koch",
    "fn": "fn herstal",
    "sig": "sig sauer",
}

# Names that are no entities.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar",
    "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
WEEKDAYS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
GENERIC_NAMES = (
    "total", "report", "table", "figure", "exhibit", "data", "number", "year", "page", "section", "appendix", "note", "source", "other", "various",
    "unknown", "n/a", "none", "percent", "rate", "count", "type", "category", "overview",
)

# Patterns of dates, cases and places.
DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
YEAR = r"\b(?:19|20)\d{2}\b"
CITY_STATE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})\b"
CASE = r"\b(?:Case|Docket|Report|Record)\s*(?:No\.?)?\s*[:#]?\s*([A-Z]{2,5}-\d{2,4}-\d{2,}|[A-Z]{0,4}\d{3,}[-\dA-Z]*)\b"

# Patterns of low-quality chunks.
URL = r"https?://\S+"
STAMP = r"(?i)\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}\s*(?:AM|PM)?"
CONTENTS_LINE = r"(?mi)^\s*\d+[\.\)]\s+(?:Table|Chart|Figure|Appendix|Graph|Section)\b"
OUTLINE_LINE = r"(?m)^\s*\d+(?:\.\d+)*\s+\w.*\s{4,}\d+\s*$"
SUMMARY_MARK = "[DOC SUMMARY"

# Patterns that the guardrail redacts, in order. Letters, digits and boundaries are those of Unicode.
REDACTIONS = (
    ("SSN", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"(?U)\b(?:\d[ -]*?){13,16}\b"),
    ("EMAIL", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("PHONE", r"(?U)\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
)
WITHHELD = "[blocked by guardrail] This response was withheld because it violated a configured content policy."


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """``c`` without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` made once for a row, however often ``of`` names it, lazily or in a lambda."""
    return F.element_at(F.transform(F.array(value), of), 1)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(c: Column, shortest: int = 1) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, of ``shortest`` characters or more; null gives none."""
    return F.regexp_extract_all(F.translate(_text(c), UPPER, LOWER), F.lit(rf"[a-z0-9_]{{{shortest},}}"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """:func:`tokens` of two characters or more that are no stop words; repeats are kept."""
    return F.filter(tokens(c, 2), lambda t: ~t.isin(*STOP_WORDS))


def overlap(question: Column, other: Column) -> Column:
    """Share of the distinct tokens of ``question`` that ``other`` has; 0 for an empty question."""
    mine = F.array_distinct(question)
    return F.size(F.array_intersect(mine, other)) / F.greatest(F.size(mine), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where there are none."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def document_id(name: Column) -> Column:
    """Stable id of a document's name: 12 hex digits."""
    return F.substring(F.md5(name), 1, 12)


def chunk_id(*parts: Column) -> Column:
    """Stable id of a chunk from what places it: 16 hex digits."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def set_hash(members: Column) -> Column:
    """Hash of a set of names, whatever their order: 16 hex digits."""
    return F.substring(F.md5(F.array_join(F.array_sort(members), "|")), 1, 16)


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def year_of_name(name: Column) -> Column:
    """First year (1900 to 2099) that is not part of a longer number; empty if none."""
    return F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)


def first_date(c: Column) -> Column:
    """First date, as written; empty if none."""
    return F.regexp_extract(_text(c), DATE, 0)


def first_year(c: Column) -> Column:
    return F.regexp_extract(_text(c), YEAR, 0)


def location(c: Column) -> Column:
    """First ``City, ST``; empty if none."""
    city, state = F.regexp_extract(_text(c), CITY_STATE, 1), F.regexp_extract(_text(c), CITY_STATE, 2)
    return F.when(city == "", "").otherwise(F.concat(city, F.lit(", "), state))


def case_reference(c: Column) -> Column:
    return F.regexp_extract(_text(c), CASE, 1)


def first_label(c: Column, labels: list[tuple[str, tuple[str, ...]]]) -> Column:
    """First of the ordered labels with a keyword in the lower-cased text; empty if none."""
    low = F.lower(_text(c))
    fits = [(name, reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys])) for name, keys in labels]
    return F.coalesce(*[F.when(ok, name) for name, ok in fits], F.lit(""))


def vocabulary_hits(c: Column, words: list[str]) -> Column:
    """Sorted words of a vocabulary that the lower-cased text contains."""
    known = F.array(*[F.lit(w) for w in sorted(set(words))])
    return once(F.lower(_text(c)), lambda low: F.filter(known, lambda w: F.contains(low, w)))


def entity_name(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical form of a name: lower case, ``&`` spelled out, no corporate suffixes, known acronyms resolved."""
    s = F.replace(F.lower(strip(_text(c))), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, r"[.,/]", " ")
    s = F.regexp_replace(s, r"\b(?:" + "|".join(CORPORATE_SUFFIXES) + r")\b", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    known = ALIASES | (aliases or {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return once(s, lambda name: F.coalesce(F.try_element_at(table, name), name))


def node_key(c: Column) -> Column:
    """Key of a graph node: white space collapsed, lower case."""
    return F.lower(F.regexp_replace(strip(_text(c)), r"\s+", " "))


def is_junk_name(c: Column) -> Column:
    """Whether a name is no entity: too short or long, a time, a generic word, or mostly not letters."""
    s = strip(_text(c))
    key = node_key(c)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (
        (F.length(key) < 3)
        | s.rlike(r"[\n\t]")
        | key.isin(*MONTHS, *WEEKDAYS, *GENERIC_NAMES)
        | key.rlike(r"^(q[1-4]|fy\d{2,4}|[12]\d{3}|\d{1,4}(st|nd|rd|th)?)$")
        | (letters / F.greatest(F.length(s), F.lit(1)) < 0.4)
        | (F.length(s) > 80)
    )


def is_valid_span(c: Column, noise: list[str]) -> Column:
    """Whether a title-cased span may be an entity: no noise word or pattern, long enough, mostly letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    ok = (F.length(c) >= 3) & ~c.rlike(r"^\d|\d$|\n|\t|^\s|\s$|\|") & (letters / F.greatest(F.length(c), F.lit(1)) >= 0.5)
    words = F.split(c, r"\s+")
    ok = ok & ~((F.size(words) == 1) & (F.length(c) < 4))
    return ok & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in noise])) if noise else ok


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chunk_quality(c: Column) -> Column:
    """Multiplier for a chunk's score: low for fragments, bare links, time stamps, contents pages and outlines."""
    t = _text(c)
    bare = strip(F.regexp_replace(t, URL, ""))
    lines = F.greatest(F.size(F.filter(F.split(t, r"\n"), lambda x: F.length(strip(x)) > 0)), F.lit(1))
    contents, outline = count_matches(t, CONTENTS_LINE), count_matches(t, OUTLINE_LINE)
    return (
        F.when(F.length(strip(t)) < 60, 0.15)
        .when(F.startswith(t, F.lit(SUMMARY_MARK)), 0.20)
        .when(F.length(bare) < 50, 0.10)
        .when((count_matches(t, STAMP) >= 1) & (F.length(strip(F.replace(bare, F.lit("\n"), F.lit("")))) < 120), 0.15)
        .when((contents >= 2) & (contents / lines >= 0.25), 0.20)
        .when((outline >= 3) & (outline / lines >= 0.30), 0.20)
        .otherwise(1.0)
    )


def gate_allows(c: Column, content_type: Column, method: Column) -> Column:
    """Whether a chunk may be indexed: structure, vision and summaries always, short text unless it is a link, else by quality."""
    t = strip(_text(c))
    return (
        content_type.isin("table", "chart", "figure")
        | (method == "vision")
        | F.startswith(t, F.lit(SUMMARY_MARK))
        | F.when(F.length(t) < 60, ~F.contains(F.lower(t), F.lit("http"))).otherwise(chunk_quality(c) > 0.25)
    )


def redact(c: Column) -> Column:
    """Text with the guardrail's patterns replaced, in order; null stays null."""
    return reduce(lambda s, kind: F.regexp_replace(s, kind[1], f"[REDACTED-{kind[0]}]"), REDACTIONS, c)


def guardrail(c: Column, denied: list[str] | None = None) -> Column:
    """Struct (text, blocked, reasons) of the guardrail; a denied term withholds the whole text."""
    out, reasons = c, []
    for kind, pattern in REDACTIONS:
        reasons.append(F.when(out.rlike(pattern), F.lit(f"pii:{kind}")))
        out = F.regexp_replace(out, pattern, f"[REDACTED-{kind}]")
    low = F.lower(out)
    hit = F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(f"denied:{t.lower()}")) for t in denied or [] if t], F.lit(None).cast("string"))
    found = F.array_compact(F.array(*reasons, hit))
    return F.struct(F.when(hit.isNotNull(), WITHHELD).otherwise(out).alias("text"), hit.isNotNull().alias("blocked"), found.alias("reasons"))


def answer_numbers(c: Column) -> Column:
    """Numbers of an answer, apart from citations, pages and years; two characters or more."""
    s = F.regexp_replace(_text(c), r"\[\d+\]|\(?\bp(?:age|\.)?\s*\d+\)?", " ")
    found = F.regexp_extract_all(s, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    found = F.transform(found, lambda x: F.regexp_replace(x, r"[.,]+$", ""))
    return F.filter(found, lambda x: (F.length(x) >= 2) & ~x.rlike(r"^(?:19|20)\d{2}$"))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """Numbers of an answer that the context, without commas, does not contain."""
    plain = F.replace(_text(context), F.lit(","), F.lit(""))
    return F.filter(answer_numbers(answer), lambda x: ~F.contains(plain, F.replace(x, F.lit(","), F.lit(""))))


def claims(c: Column, most: int = 6) -> Column:
    """Statements of a text: split after full stops, semicolons and at line ends; over 8 characters."""
    parts = F.split(_text(c), r"(?<=[.;])\s+|\n+")
    return F.slice(F.filter(F.transform(parts, strip), lambda x: F.length(x) > 8), 1, most)


def domain_tier(url: Column, trusted: tuple[str, ...] = (), low: tuple[str, ...] = ("blogspot", "medium.com", "substack", "wordpress", "reddit", "quora", "facebook", "twitter", "pinterest")) -> Column:
    """Credibility of a URL's host: 1.0 for government and military, 0.9 trusted or academic, 0.4 for self-published, else 0.65."""
    host = F.lower(F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    has = lambda names: reduce(lambda a, b: a | b, [F.contains(host, F.lit(n)) for n in names], F.lit(False))
    return F.when(host.rlike(r"\.(gov|mil)$"), 1.0).when(host.rlike(r"\.edu$") | has(trusted), 0.9).when(has(low), 0.4).otherwise(0.65)


def mask(secret: Column) -> Column:
    """First and last four characters of a long secret; a short one is hidden."""
    n = F.length(secret)
    return F.when(n <= 8, F.lit("****")).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.substring(secret, n - 3, 4)))


def needs_ocr(c: Column) -> Column:
    """Whether a page has next to no text."""
    return F.length(F.regexp_replace(_text(c), r"\s", "")) < 25


def worth_extracting(c: Column) -> Column:
    """Whether a chunk is worth the cost of entity extraction: long and mostly letters."""
    return (F.length(_text(c)) >= 300) & (F.length(F.regexp_replace(_text(c), r"[^\p{L}]", "")) / F.greatest(F.length(_text(c)), F.lit(1)) >= 0.45)


def has_tabular_signal(c: Column, rows: int = 3) -> Column:
    """Whether enough lines have two numbers, or one and a wide gap."""
    number = r"\d[\d,.]*%?"
    ok = lambda x: (count_matches(x, number) >= 2) | ((count_matches(x, number) == 1) & x.rlike(r"\S {3,}\S"))
    return F.size(F.filter(F.split(_text(c), r"\n"), ok)) >= rows
