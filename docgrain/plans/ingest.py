"""Ingestion end to end, as one plan: documents to chunks, tables, vectors and graph, with a journal.

Nothing fails a batch: a document that is a copy, is known already or has nothing to index is a row of the journal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.functions.vectors import embedding
from docgrain.operators import audit, chunking, extraction, graph, metadata, tables
from docgrain.session import materialise

#: Names beyond the vocabularies that a chunk gives to the graph.
GENERIC_NAMES = 12


@dataclass
class Indexed:
    """What a batch of documents became."""

    journal: DataFrame
    chunks: DataFrame
    tables: DataFrame
    rows: DataFrame
    nodes: DataFrame
    edges: DataFrame


def journal(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(document_id, hash, status) of every document: duplicate of an earlier one, unchanged, updated or new.

    Of equal texts the smallest id is taken; ``known`` (document_id, hash) is what earlier batches left.
    """
    rows = docs.select("document_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    first = rows.groupBy("hash").agg(F.min("document_id").alias("first"))
    rows = rows.join(first, "hash").withColumn("copy", ~F.col("document_id").eqNullSafe(F.col("first")))
    if known is None:
        return rows.select("document_id", "hash", F.when(F.col("copy"), "duplicate").otherwise("new").alias("status"))
    before = known.select("document_id", F.col("hash").alias("old"))
    status = F.when(F.col("copy"), "duplicate").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "unchanged").otherwise("updated")
    return rows.join(before, "document_id", "left").select("document_id", "hash", status.alias("status"))


def chunk_mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, corpus, seq, name, type, place) of the names of enriched chunks, in their fixed order: makers, sellers,
    buyers, item, incident, place, case, then the first GENERIC_NAMES others, all in canonical form."""

    def as_names(names: Column, kind: str) -> Column:
        return F.transform(names, lambda n: F.struct(T.entity_name(n).alias("name"), F.lit(kind).alias("type")))

    def one(name: str, kind: str) -> Column:
        return as_names(F.filter(F.array(F.col(name)), lambda n: F.coalesce(n, F.lit("")) != ""), kind)

    typed = [as_names(F.col("manufacturers"), "manufacturer"), as_names(F.col("sellers"), "seller"), as_names(F.col("buyers"), "buyer")]
    typed += [one("item_type", "item_type"), one("incident_type", "incident_type"), one("location", "location"), one("case_reference", "case")]
    names = F.concat(*typed, as_names(F.slice("entities", 1, GENERIC_NAMES), "entity"))
    rows = chunks.select("chunk_id", "corpus", F.posexplode(names).alias("place", "n"))
    return rows.select("chunk_id", "corpus", F.xxhash64("chunk_id").alias("seq"), "n.name", "n.type", "place").where("name <> ''")


def build_graph(chunks: DataFrame, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of enriched chunks: typed names are nodes, typed relations win over co-occurrence.

    ``extracted`` is what a service found (:func:`extraction.enrich`). Ends of edges become nodes of their own; a
    typed relation counts once more for both of its ends.
    """
    mentions = materialise(chunk_mentions(chunks), "mentions")
    typed = extraction.as_relations(extracted).withColumns({"src": T.entity_name(F.col("src")), "dst": T.entity_name(F.col("dst"))}).where("src <> '' and dst <> '' and src <> dst") if extracted is not None else None
    # The names of a chunk are bounded by its text and by GENERIC_NAMES.
    names = mentions.groupBy("chunk_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])).alias("names"))
    meets = graph.cooccurrences(names, typed=typed).withColumn("description", F.lit(""))
    relations = meets if typed is None else meets.unionByName(typed.select(*meets.columns))
    relations = materialise(relations.withColumn("seq", F.xxhash64("chunk_id")), "relations")
    own = mentions.where("type <> 'entity'").select("name", "type", "chunk_id", "corpus", F.lit("").alias("description"), "seq")
    corpora = chunks.select("chunk_id", "corpus")
    ends = relations.select(F.explode(F.array("src", "dst")).alias("name"), F.lit("entity").alias("type"), "chunk_id", "description", "seq").join(corpora, "chunk_id").select(*own.columns)
    edges = graph.aggregate_edges(relations, keys=False)
    return graph.aggregate_nodes(own.unionByName(ends)), edges


# Characters of a first page that stand for a document, and pages up to which extraction is on by itself.
SUMMARY_CHARS, AUTO_PAGES = 1200, 40


def summary_anchors(pages: DataFrame) -> DataFrame:
    """(document_id, source_name, page, text): one line that stands for a document, its name, its year and the start of
    its first page that has a text, lines joined by bars.

    pages: document_id, source_name, page, text. Documents without text have none.
    """
    rows = pages.where(F.coalesce(T.strip(F.col("text")), F.lit("")) != "")
    first = rows.groupBy("document_id").agg(F.min_by(F.struct("source_name", F.substring("text", 1, SUMMARY_CHARS).alias("text")), F.struct("page", "text")).alias("p"))
    name, year = F.coalesce("p.source_name", F.lit("")), T.year_of_name(F.coalesce("p.source_name", F.lit("")))
    lines = F.filter(F.transform(F.split("p.text", r"\r\n|[\n\r]"), T.strip), lambda x: x != "")
    label = F.concat(F.lit("[DOC SUMMARY: "), name, F.when(F.coalesce(year, F.lit("")) != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""), F.lit("] "))
    return first.select("document_id", F.col("p.source_name").alias("source_name"), F.lit(1).alias("page"), F.concat(label, F.array_join(lines, " | ")).alias("text"))


def wants_extraction(pages: Column, mode: str = "auto") -> Column:
    """Whether a service extracts from a document of so many pages: never, always, or, by itself, from short ones."""
    if mode not in ("off", "auto", "on"):
        raise ValueError(f"not a mode: {mode}")
    return F.lit(mode == "on") if mode != "auto" else F.coalesce(pages, F.lit(0)) <= AUTO_PAGES


def close_fields(chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """Enriched ``chunks`` with what a service found (chunk_id, entities): makers and organisations join theirs, an empty
    place, item, incident and case take the first of its kind, all names join the entities, of which 30 stay.
    """
    rows = chunks.join(extracted.select("chunk_id", F.col("entities").alias("__e")), "chunk_id", "left")
    kind = lambda name: F.transform(F.filter("__e", lambda e: F.lower(e["type"]) == name), lambda e: e["name"])
    joined = lambda column, names: F.array_sort(F.array_distinct(F.concat(F.coalesce(column, F.array().cast("array<string>")), names)))
    blank = lambda column: F.coalesce(F.col(column), F.lit("")) == ""
    fields = {c: joined(F.col(c), kind(name)) for c, name in (("manufacturers", "manufacturer"), ("organizations", "organization"))}
    fields |= {c: F.when(blank(c), F.coalesce(F.try_element_at(kind(name), F.lit(1)), c)).otherwise(F.col(c)) for c, name in (("location", "location"), ("item_type", "firearm"), ("incident_type", "incident"), ("case_reference", "case"))}
    fields["entities"] = F.slice(joined(F.col("entities"), F.transform("__e", lambda e: e["name"])), 1, 30)
    fields = {c: F.when(F.col("__e").isNull(), F.col(c)).otherwise(v) for c, v in fields.items()}
    return rows.withColumns(fields).select(*chunks.columns)


def backfill(chunks: DataFrame, vocabulary: metadata.Vocabulary | None = None) -> DataFrame:
    """``chunks`` of an older index (text, content_type, source_name, heading, cells, table_title, report_type, us_state)
    with what is blank filled: labels of all chunks from their names, cells, titles and states of tables."""
    v = vocabulary or metadata.Vocabulary()
    table, blank = F.col("content_type") == "table", lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    label = T.first_label(F.coalesce("source_name", F.lit("")), v.reports)
    fields = {
        "cells": F.when(table & F.col("cells").isNull(), tables.table_cells("text")).otherwise(F.col("cells")),
        "table_title": F.when(table & blank("table_title"), tables.table_title(F.col("heading"), F.col("text"))).otherwise(F.col("table_title")),
        "report_type": F.when(blank("report_type"), label).otherwise(F.col("report_type")),
        "us_state": F.when(table & blank("us_state"), metadata.state(F.col("text"), v.states)).otherwise(F.col("us_state")),
    }
    return chunks.withColumns(fields).select(*chunks.columns)


def ingest(docs: DataFrame, known: DataFrame | None = None, corpus: str = "pdf", service: str | None = None, summaries: bool = False) -> Indexed:
    """Index documents (document_id, source_name, text): deduplicate, chunk, gate, enrich, parse tables, embed, build the graph.

    Documents that repeat an earlier one or are unchanged are only journalled. With ``service`` a chat service
    extracts relations, and what it finds joins the chunks' fields; with ``summaries`` each document has a line that
    stands for it. Every result is written once and read from there.
    """
    log = materialise(journal(docs, known), "journal")
    # Dealt by number: what follows is long work on few bytes, which tasks sized by bytes would do one after another.
    context = docs.sparkSession.sparkContext
    tasks = max(2 * context.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    todo = docs.repartition(tasks, "document_id").join(log.where("status in ('new', 'updated')").select("document_id"), "document_id", "left_semi")
    if summaries:
        lines = summary_anchors(todo.withColumn("page", F.lit(1)))
        todo = todo.select("document_id", "source_name", "text").unionByName(lines.select("document_id", "source_name", "text"))
    cut = chunking.reclassify(chunking.chunk(todo, "document_id", keep=("source_name",)))
    cut = cut.where(T.gate_allows(F.col("text"), F.col("content_type"), F.lit("text")))
    rich = metadata.enrich(cut.withColumn("corpus", F.lit(corpus)))
    cells = F.when(F.col("content_type") == "table", tables.table_cells("text"))
    chunks = materialise(rich.withColumns({"cells": cells, "embedding": embedding(F.col("text"))}), "chunks")
    store = chunks.select("chunk_id", F.col("source_name").alias("source"), F.lit(1).alias("page"), "document_date", F.col("heading").alias("title"), "cells")
    known_tables, rows = tables.build_store(store.where("cells is not null"))
    extracted = materialise(extraction.enrich(chunks, service=service), "extracted") if service else None
    chunks = chunks if extracted is None else materialise(close_fields(chunks, extracted), "chunks")
    nodes, edges = build_graph(chunks, extracted)
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    log = log.join(counts, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    status = F.when(F.col("status").isin("new", "updated") & (F.col("chunks") == 0), "empty").otherwise(F.col("status"))
    return Indexed(log.withColumn("status", status), chunks, known_tables, rows, nodes, edges)


def replace_documents(table: DataFrame, batch: Indexed, key: str = "document_id") -> DataFrame:
    """A table of chunks after a batch: chunks of updated documents go, the new ones come."""
    gone = batch.journal.where("status in ('updated', 'empty')").select(F.col("document_id").alias(key))
    return audit.delete_document(table, gone).unionByName(batch.chunks.select(*table.columns))
