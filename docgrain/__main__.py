"""Command line: chunk a folder of documents, answer a question over the chunks, or run a registered query."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from docgrain.operators.chunking import chunk
from docgrain.plans import answer, catalog
from docgrain.session import local_session
from docgrain.sources import files


def main() -> None:
    parser = argparse.ArgumentParser(prog="python -m docgrain", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="chunk the files below a folder into a table")
    ingest.add_argument("folder")
    ingest.add_argument("table")
    ask = commands.add_parser("query", help="answer a question over a table of chunks")
    ask.add_argument("table")
    ask.add_argument("question")
    run = commands.add_parser("run", help="run a registered query")
    run.add_argument("name", choices=sorted(catalog.queries()))
    run.add_argument("folder")
    args = parser.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "ingest":
        docs = files.read_documents(spark, args.folder)
        chunks = chunk(docs, "document_id", keep=("source_name", "page"))
        print("version", files.write_version(chunks, args.table))
    elif args.command == "query":
        rows = files.read_version(spark, args.table)
        chunks = rows.select("chunk_id", "text", F.col("source_name").alias("doc_source"), "content_type", F.lit("").alias("document_date"), F.lit(False).alias("has_metadata"), F.lit(1.0).alias("confidence"), F.lit(False).alias("has_cells"))
        asked = spark.createDataFrame([("q", args.question)], "query_id string, question string")
        for row in answer.answer(chunks, asked).collect():
            print(row["answer"], *(f"[{c['ref']}] {c['source']}" for c in row["citations"]), sep="\n")
    else:
        catalog.queries()[args.name](spark, args.folder).show(50, truncate=100)


if __name__ == "__main__":
    main()
