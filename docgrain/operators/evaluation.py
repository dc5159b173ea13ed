"""Checks of answers and questions for tests: refusals, expected points, structured signals, document pairs that share an entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain import services
from docgrain.functions import text as T
from docgrain.operators.extraction import first_json

# What a refusal says.
REFUSALS = ("does not contain", "not contain", "cannot provide", "no information", "insufficient", "does not provide", "not found", "not available", "unable to", "no relevant", "not specify", "not include")
SHORTEST_ANSWER = 25


def is_refusal(answer: Column) -> Column:
    """Whether an answer says that there is none."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in REFUSALS])


def is_insufficient(answer: Column) -> Column:
    """Whether an answer is a refusal or next to nothing."""
    return (F.length(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")) < SHORTEST_ANSWER) | is_refusal(answer)


def has_point(answer: Column, points: Column) -> Column:
    """Whether an answer names any of the expected points."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(points, lambda p: F.contains(low, F.lower(p)))


def score_answers(answers: DataFrame) -> DataFrame:
    """One row (n, hit_rate, refusal_accuracy, correct) of answers (answer, points, expect_refusal), rounded to 4 places.

    Hits count where an answer is expected, refusals where none is; a rate without any row is null.
    """
    refused, wanted = is_refusal(F.col("answer")), F.col("expect_refusal")
    hit = has_point(F.col("answer"), F.col("points")) & ~refused
    right = F.when(wanted, refused).otherwise(hit)
    share = lambda c, where: F.round(F.avg(F.when(where, c.cast("double"))), 4)
    return answers.agg(F.count("*").alias("n"), share(hit, ~wanted).alias("hit_rate"), share(refused, wanted).alias("refusal_accuracy"), share(right, F.lit(True)).alias("correct"))


def answer_signals(answer: Column) -> Column:
    """Struct (answered, evidence_quoted, has_number) of an answer to a structured question."""
    text = F.coalesce(answer, F.lit(""))
    return F.struct((~is_refusal(answer)).alias("answered"), F.contains(text, F.lit("EVIDENCE")).alias("evidence_quoted"), text.rlike(r"\d[\d,]{2,}").alias("has_number"))


def entity_pairs(mentions: DataFrame) -> DataFrame:
    """(entity, first_document, second_document, first_chunk, second_chunk) of entities that two documents share.

    mentions: entity, document_id, chunk_id. A document stands by its smallest chunk, an entity by its two smallest
    documents; entities are reduced to two documents before anything is joined.
    """
    once = mentions.groupBy("entity", "document_id").agg(F.min("chunk_id").alias("chunk_id"))
    order = Window.partitionBy("entity").orderBy("document_id")
    two = once.withColumn("r", F.row_number().over(order)).where("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    out = two.groupBy("entity").agg(pick(1, "document_id").alias("first_document"), pick(2, "document_id").alias("second_document"), pick(1, "chunk_id").alias("first_chunk"), pick(2, "chunk_id").alias("second_chunk"))
    return out.where("second_document is not null")


# How much of a context, a passage and the joined passages a judge reads.
CONTEXT_CHARS, PASSAGE_CHARS, JOINED_EACH, JOINED_CHARS = 6000, 600, 500, 5000


def judge_faithfulness(answers: DataFrame, service: str | None) -> DataFrame:
    """(query_id, supported, unsupported_claims, score, skipped) of answers (query_id, question, answer, context), as a chat service judges them.

    Without a service, and where the reply has neither verdict nor score, the row is skipped: averages leave it out.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    ask = F.concat(F.lit("Judge whether the context supports every claim of the answer. Reply with JSON only: supported, unsupported_claims, score from 0 to 1.\nQUESTION:\n"), blank("question"), F.lit("\n\nCONTEXT:\n"), F.substring(blank("context"), 1, CONTEXT_CHARS), F.lit("\n\nANSWER:\n"), blank("answer"))
    reply = services.apply("chat", ask, service) if service else F.lit(None).cast("string")
    text = answers.select("query_id", reply.alias("reply")).select("query_id", first_json(F.col("reply")).alias("text"))
    got = text.select("query_id", F.when(F.col("text") != "", F.from_json("text", "supported boolean, unsupported_claims array<string>, score double")).alias("g"))
    skipped = F.col("g.supported").isNull() & F.col("g.score").isNull()
    none = F.array().cast("array<string>")
    return got.select("query_id", F.when(~skipped, F.coalesce("g.supported", F.lit(False))).alias("supported"), F.coalesce("g.unsupported_claims", none).alias("unsupported_claims"), "g.score", skipped.alias("skipped"))


def _share_of_yes(rows: DataFrame, prompt: Column, service: str, name: str) -> DataFrame:
    """(query_id, name): the share of yes among the replies that say yes or no, to 4 places; null where none does."""
    said = F.lower(F.regexp_extract(F.coalesce(services.apply("chat", prompt, service), F.lit("")), r"(?i)^\W*(yes|no)\b", 1))
    judged = rows.select("query_id", said.alias("said"))
    return judged.groupBy("query_id").agg(F.round(F.avg(F.when(F.col("said") != "", (F.col("said") == "yes").cast("double"))), 4).alias(name))


def context_precision(contexts: DataFrame, service: str) -> DataFrame:
    """(query_id, context_precision): the share of passages (query_id, question, text) that a chat service finds relevant."""
    prompt = F.concat(F.lit("Is this passage relevant to the question? Reply with yes or no only.\nQUESTION: "), F.coalesce("question", F.lit("")), F.lit("\n\nPASSAGE: "), F.substring(F.coalesce("text", F.lit("")), 1, PASSAGE_CHARS))
    return _share_of_yes(contexts, prompt, service, "context_precision")


def context_recall(truths: DataFrame, contexts: DataFrame, service: str) -> DataFrame:
    """(query_id, context_recall): the share of claims that a chat service finds in the passages (query_id, rank, text).

    truths: query_id and points (expected points, each a claim) or truth (a text, of which the first claims are taken).
    """
    points = F.filter("points", lambda p: F.length(p) > 2) if "points" in truths.columns else T.claims(F.col("truth"))
    heads = F.array_sort(F.collect_list(F.struct("rank", F.substring(F.coalesce("text", F.lit("")), 1, JOINED_EACH).alias("head"))))
    # The passages of a question are its ranked hits: top_k at most.
    joined = contexts.groupBy("query_id").agg(F.substring(F.array_join(F.transform(heads, lambda x: x["head"]), "\n"), 1, JOINED_CHARS).alias("context"))
    rows = truths.select("query_id", F.explode(points).alias("claim")).join(joined, "query_id", "left")
    prompt = F.concat(F.lit("Does the context support the claim? Reply with yes or no only.\nCONTEXT:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nCLAIM: "), F.col("claim"))
    return _share_of_yes(rows, prompt, service, "context_recall")


# Chunks that questions are made from, and the step from one to the next.
SYNTHETIC_CHARS, STRIDE = 200, 7


def synthetic_sources(chunks: DataFrame, pairs: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(place, hops, texts, sources) of up to ``n`` questions to make: pairs of documents in turn with single chunks, which lie seven apart.

    chunks: chunk_id, text, doc_source; pairs: those of :func:`entity_pairs`. Only chunks of over 200 characters are
    used; they are numbered by id, and a number beyond the last goes on from the first.
    """
    rows = chunks.where(F.length("text") > SYNTHETIC_CHARS).select("chunk_id", "text", F.col("doc_source").alias("source"))
    total = rows.count()
    if not total:
        return chunks.sparkSession.createDataFrame([], "place int, hops int, texts array<string>, sources array<string>")
    multi = []
    if pairs is not None:
        for end in ("first_chunk", "second_chunk"):
            pairs = pairs.join(rows.select(F.col("chunk_id").alias(end)), end, "left_semi")
        multi = pairs.orderBy("entity").limit(n).collect()
    plan = []
    for step in range(n):
        if multi and step % 2 == 0:
            pair = multi.pop(0)
            plan += [(step, 2, 0, pair["first_chunk"], None), (step, 2, 1, pair["second_chunk"], None)]
        elif step < total:
            plan.append((step, 1, 0, None, step * STRIDE % total))
    # No number lies beyond n steps, so that of a long table only the first ids are numbered.
    first = rows.select("chunk_id").orderBy("chunk_id").limit(STRIDE * n)
    numbered = first.withColumn("number", F.row_number().over(Window.orderBy("chunk_id")) - 1)
    kind = rows.schema["chunk_id"].dataType.simpleString()
    wanted = chunks.sparkSession.createDataFrame(plan, f"place int, hops int, part int, id {kind}, number int")
    direct = wanted.where("id is not null").select("place", "hops", "part", F.col("id").alias("chunk_id"))
    counted = wanted.where("id is null").join(numbered, "number").select("place", "hops", "part", "chunk_id")
    parts = direct.unionByName(counted).join(rows, "chunk_id")
    both = F.array_sort(F.collect_list(F.struct("part", "text", "source")))
    out = parts.groupBy("place", "hops").agg(both.alias("p"))
    return out.select("place", "hops", F.transform("p", lambda x: x["text"]).alias("texts"), F.array_sort(F.array_distinct(F.transform("p", lambda x: x["source"]))).alias("sources"))


def synthetic_questions(sources: DataFrame, service: str, corpus: str = "pdf") -> DataFrame:
    """Golden records (id, question, intent, corpus, relevant_doc_files, expected_answer_points, synthetic, hops) that a
    chat service makes from :func:`synthetic_sources`; replies without a question are left out."""
    head = F.when(F.col("hops") > 1, "Ask one question that needs both passages.").otherwise("Ask one question that the passage answers.")
    prompt = F.concat(head, F.lit(" Reply with JSON only: question, answer, answer_points.\n"), F.array_join("texts", "\n\n"))
    replies = sources.select("place", "hops", "sources", first_json(services.apply("chat", prompt, service)).alias("reply"))
    got = replies.withColumn("g", F.from_json("reply", "question string, answer string, answer_points array<string>")).where("trim(g.question) <> ''")
    points = F.when(F.size("g.answer_points") > 0, F.col("g.answer_points")).otherwise(F.array_compact(F.array("g.answer")))
    files = F.filter("sources", lambda s: F.coalesce(s, F.lit("")) != "")
    return got.select(F.format_string("syn%03d", F.col("place") + 1).alias("id"), "g.question", F.lit("fact").alias("intent"), F.lit(corpus).alias("corpus"), files.alias("relevant_doc_files"), points.alias("expected_answer_points"), F.lit(True).alias("synthetic"), "hops")
