"""Entities and relations from a service's JSON replies, checked against a fixed ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain import services
from docgrain.functions import text as T

# The ontology.
ENTITY_TYPES = ("manufacturer", "dealer", "person", "location", "firearm", "incident", "case")
RELATION_TYPES = ("SOLD_TO", "SOLD_BY", "PURCHASED_BY", "MANUFACTURED_BY", "LOCATED_IN", "INVOLVED_IN", "REFERENCES", "TRANSFERRED_TO")
SCHEMA = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<source:string,target:string,type:string,description:string>>>"


def first_json(reply: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)


def parse_reply(reply: Column) -> Column:
    """Struct (entities, relations) of a reply: unknown types, empty names and loops are left out; no JSON gives none."""
    got = F.from_json(first_json(reply), SCHEMA)
    known = lambda names, c: F.array_contains(F.array(*[F.lit(n) for n in names]), c)
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    entities = F.filter(got["entities"], lambda e: known(ENTITY_TYPES, F.lower(e["type"])) & ~blank(e["name"]))
    relations = F.filter(got["relations"], lambda r: known(RELATION_TYPES, F.upper(r["type"])) & ~blank(r["source"]) & ~blank(r["target"]) & (T.node_key(r["source"]) != T.node_key(r["target"])))
    empty = F.from_json(F.lit('{"entities":[],"relations":[]}'), SCHEMA)
    return F.struct(F.coalesce(entities, empty["entities"]).alias("entities"), F.coalesce(relations, empty["relations"]).alias("relations"))


def prompt(text: Column) -> Column:
    """What the service is asked."""
    head = f"Extract entities ({', '.join(ENTITY_TYPES)}) and relations ({', '.join(RELATION_TYPES)}) as JSON.\n"
    return F.concat(F.lit(head), text)


def enrich(chunks: DataFrame, done: DataFrame | None = None, service: str = "offline") -> DataFrame:
    """(chunk_id, entities, relations) of chunks worth the cost that are not in ``done`` (chunk_id) yet."""
    rows = chunks.where(T.worth_extracting(F.col("text")))
    if done is not None:
        rows = rows.join(done, "chunk_id", "left_anti")
    got = parse_reply(services.apply("chat", prompt(F.col("text")), service))
    return rows.select("chunk_id", got.alias("g")).select("chunk_id", "g.entities", "g.relations")


def as_relations(extracted: DataFrame, weight: int = 2) -> DataFrame:
    """Typed relations of extracted chunks, as the graph takes them."""
    rows = extracted.select("chunk_id", F.explode("relations").alias("r"))
    return rows.select(F.col("r.source").alias("src"), F.col("r.target").alias("dst"), F.upper("r.type").alias("rel"), "chunk_id", F.lit(weight).alias("weight"), F.coalesce("r.description", F.lit("")).alias("description"))
