"""Question understanding: intent, domain, metadata switch, mode, corpora, comparison targets. Native expressions over a table of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain import services
from docgrain.functions import text as T
from docgrain.operators.extraction import first_json
from docgrain.operators.metadata import STATES

# Word lists of the intents, in the order in which they are applied; later ones win.
RELATION = ("connect", "related", "relationship", "link", "between", "tie", "associat", "network", "pattern", "common", "shared", "across", "repeat", "trend", "trafficking ring", "ring")
TIMELINE = ("timeline", "over time", "history", "chronolog", "trend", "since", "between 20", "sequence")
TABLE = ("table", "column", "row", "how many", "count", "total", "rate", "statistic", "number of", "how much", "statistics")
VISUAL = ("chart", "graph", "figure", "image", "photo", "diagram", "map")
ENTITY = ("who is", "what is", "tell me about", "profile of")
ALL = ("all sources", "everything", "every", "across all", "all data", "entire dataset", "all corpus", "all corpuses", "all corpora")
GLOBAL = ("across the", "across all", "across these", "across documents", "overall", "in general", "common themes", "recurring", "recur", "patterns", "cluster", "clusters", "most frequent", "most common", "which dealers", "who appears", "how are", "connected across", "themes", "trends across", "main categories", "summarize the")
MANUFACTURE = ("manufactur", "production volume", "produced by", "made in", "how many made", "total produced", "pistols made", "rifles made", "manufacturing output", "firearms produced")
# Domains; the last that fits wins.
DOMAINS = [
    ("manufacture", MANUFACTURE),
    ("export", ("export", "exported", "exports", "sold abroad", "shipped to", "foreign buyer", "breakdown of exported", "exported firearm")),
    ("import", ("import", "imported", "imports", "foreign manufacturer", "brought into", "imported from", "country of origin", "imported firearms", "firearm imports")),
    ("pmf", ("ghost gun", "privately made", "pmf", "unserialized", "3d printed", "unregistered", "home made firearm")),
    ("trace", ("trace", "traced", "tracing", "ntc", "etrace", "crime gun", "source state", "time to crime", "firearm trace")),
    ("theft", ("stolen", "theft", "lost", "missing", "ffl theft", "dealer theft", "burglary", "robbery of dealer")),
    ("arson", ("arson", "fire incident", "incendiary", "house of worship fire", "structure fire", "vehicle fire")),
    ("explosives", ("explosive", "bomb", "pipe bomb", "ied", "pyrotechnic", "detonator", "blast", "explosion incident")),
    ("selling", ("top selling", "best selling", "most sold", "caliber", "calibres", "selling distribution", "retail sales", "firearms sold")),
]
# Parts of source names that belong to a domain: those searched for it besides, and those that gain for it.
PREFETCH_SOURCES = {"manufacture": ("afmer",), "export": ("nfcta_export",), "selling": ("nfcta_selling",)}
BOOSTED_SOURCES = {"export": ("nfcta_export",), "pmf": ("pmf", "privately_made", "ghost"), "manufacture": ("afmer",), "selling": ("nfcta_selling",)}
INTENTS = ("fact", "entity", "relationship", "pattern", "timeline", "table", "visual", "multi")
COMPARE = r"(?i)(\bcompare\b|\bcomparison\b|\bversus\b|\bvs\.?\b|\bmore\b.{1,40}\bor\b|\bwhich (?:is|was|had|reported|state|year|manufacturer)\b.{0,40}(?:higher|greater|more|larger|highest|most|largest|fewer|lower|fewest))"
COMPARE_STOP = ("According", "Compare", "From", "In", "The", "Report", "United", "States", "Which", "What", "Federal", "National", "Final")


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def plan_questions(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """``questions`` with intent, use_graph, use_metadata, domain and mode.

    Later rules win over earlier ones. Questions over everything are global, those that also name a year or want a
    table are mixed, as are relationships and patterns; the rest is local.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    pattern = F.contains(low, F.lit("pattern")) | F.contains(low, F.lit("across"))
    intent = F.lit("fact")
    for words, name in ((RELATION, "relationship"), (TIMELINE, "timeline"), (TABLE, "table"), (VISUAL, "visual"), (ENTITY, "entity"), (ALL, "multi")):
        intent = F.when(has_any(low, words), name).otherwise(intent)
    out = questions.withColumn("__low", low).withColumn("intent", intent)
    low = F.col("__low")
    out = out.withColumn("intent", F.when(pattern & F.col("intent").isin("fact", "entity"), "pattern").otherwise(F.col("intent")))
    out = out.withColumn("intent", F.when(has_any(low, MANUFACTURE), "table").otherwise(F.col("intent")))
    domain = F.lit("")
    for name, words in DOMAINS:
        domain = F.when(has_any(low, words), name).otherwise(domain)
    year = low.rlike(T.YEAR)
    graph = has_any(low, RELATION) | has_any(low, TIMELINE) | has_any(low, ENTITY) | pattern
    metadata = has_any(low, TIMELINE) | year | F.contains(low, F.lit(" in 20"))
    everywhere = has_any(low, GLOBAL) | (F.col("intent") == "multi")
    specific = year | (F.col("intent") == "table")
    mode = F.when(everywhere & specific, "mixed").when(everywhere, "global").when(F.col("intent").isin("relationship", "pattern"), "mixed").otherwise("local")
    return out.withColumns({"use_graph": graph, "use_metadata": metadata, "domain": domain, "mode": mode}).drop("__low")


def source_domains(source: Column, named: dict[str, tuple[str, ...]]) -> Column:
    """The domains of which a source's name has a part, as an array in the order of ``named``; none for a null name."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.array_compact(F.array(*[F.when(has_any(low, parts), name) for name, parts in named.items()]))


def refine(planned: DataFrame, service: str, text_col: str = "question") -> DataFrame:
    """``planned`` with intent, use_graph and use_metadata as a chat service gives them, and its top_k (else null).

    Replies that are no JSON, and values that are none of the known, leave the plan as it is.
    """
    head = f'Classify the question for a retriever. Reply with JSON only: {{"intent": one of [{",".join(INTENTS)}], "use_graph": bool, "use_metadata": bool, "top_k": int}}.\n'
    reply = services.apply("chat", F.concat(F.lit(head), F.coalesce(F.col(text_col), F.lit(""))), service)
    rows = planned.withColumn("__r", F.from_json(first_json(reply), "intent string, use_graph boolean, use_metadata boolean, top_k int"))
    known = F.when(F.col("__r.intent").isin(*INTENTS), F.col("__r.intent"))
    top = F.when(F.col("__r.top_k") > 0, F.col("__r.top_k"))
    said = {"intent": F.coalesce(known, "intent"), "use_graph": F.coalesce("__r.use_graph", "use_graph"), "use_metadata": F.coalesce("__r.use_metadata", "use_metadata"), "top_k": top}
    return rows.withColumns(said).drop("__r")


def select_corpora(question: str, available: list[str], names: list[str], intent: str = "fact", explicit: list[str] | None = None) -> list[str]:
    """Corpora to search: those asked for, all for broad questions, those that the question names or is about, else all."""
    if explicit:
        return [c for c in explicit if c in available] or list(explicit)
    if intent == "multi" or not available:
        return available or list(names)
    q = question.lower()
    chosen = [n for n in names if f"{n} corpus" in q or f"{n} documents" in q]
    topics = [("web", any(w in q for w in ("website", "web ", "site", "online", "url"))), ("visual", intent == "visual" or any(w in q for w in VISUAL)), ("connected", "collection" in q or "across documents" in q)]
    chosen += [name for name, on in topics if on]
    return [c for c in dict.fromkeys(chosen) if c in available] or available


def is_comparison(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(COMPARE)


def comparison_targets(question: Column, most: int = 4) -> Column:
    """What a question compares: states in the order of the list, years, and, with fewer than two of these, proper names."""
    q = F.coalesce(question, F.lit(""))
    low = F.lower(q)
    states = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{s}\b"), F.initcap(F.lit(s))) for s in sorted(STATES)]))
    known = F.array_distinct(F.concat(states, F.regexp_extract_all(q, F.lit(T.YEAR), F.lit(0))))
    stop = F.array(*[F.lit(w) for w in COMPARE_STOP])
    names = F.regexp_extract_all(q, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"), F.lit(1))
    names = F.filter(names, lambda n: ~F.array_contains(stop, n) & (F.length(n) > 2))
    return F.slice(F.when(F.size(known) < 2, F.array_distinct(F.concat(known, names))).otherwise(known), 1, most)


def is_weak(best: Column, n_hits: Column) -> Column:
    """Whether retrieval should be tried again with the content words alone: no hit, a poor best one, or fewer than three."""
    return (F.coalesce(n_hits, F.lit(0)) < 3) | (F.coalesce(best, F.lit(0.0)) < 0.45)


def reformulate(question: Column) -> Column:
    """Distinct content words of a question."""
    return F.array_join(F.array_distinct(T.content_tokens(question)), " ")
