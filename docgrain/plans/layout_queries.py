"""Queries of the layout operators, and their SQL: pages, words and replies are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrain.operators import layout
from docgrain.session import table


def _tie() -> Column:
    """Tells lines of one order and number apart."""
    return F.col("l_partkey") % 1000 * 1000 + F.col("l_suppkey") % 1000


def page_order(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as elements of pages: each eighth order a page of its document, quantities and keys their places."""
    rows = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "picture").when(F.col("l_linenumber") % 5 == 0, "table").otherwise("text")
    left, top = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") * 7 % 60 * 12).cast("double")
    elements = rows.select(
        F.floor(F.col("l_orderkey") / 64).alias("document"), (F.floor(F.col("l_orderkey") / 8) % 8 + 1).alias("page"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + _tie()).alias("place"), kind.alias("kind"),
        left.alias("left"), F.when(F.col("l_quantity") < 49, top).alias("top"), (left + 60 + F.col("l_quantity")).alias("right"), (top - 70 - F.col("l_quantity")).alias("bottom"),
        F.when(F.col("l_quantity") == 1, " ").otherwise(F.concat(F.lit("item "), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).alias("text"),
    )
    return layout.page_texts(elements)


PAGE_ORDER_SQL = """
WITH e AS (
  SELECT CAST(floor(l_orderkey / 64) AS BIGINT) AS document, CAST(floor(l_orderkey / 8) AS BIGINT) % 8 + 1 AS page, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000 * 1000 + l_suppkey % 1000 AS place,
         CASE WHEN l_linenumber % 3 = 0 THEN 'picture' WHEN l_linenumber % 5 = 0 THEN 'table' ELSE 'text' END AS kind,
         l_partkey % 300 AS x, l_suppkey * 7 % 60 * 12 AS y, l_quantity AS q, 'item ' || l_orderkey || '-' || l_linenumber AS t
  FROM lineitem WHERE l_quantity <> 1
), k AS (
  SELECT *, row_number() OVER (PARTITION BY document, page, kind ORDER BY place) AS nth FROM e
  WHERE kind <> 'picture' OR (q >= 20 AND q < 49)
)
SELECT document, page, string_agg(CASE kind WHEN 'table' THEN '[EXTRACTED TABLE]' || chr(10) || t ELSE t END, chr(10) || chr(10)
         ORDER BY q >= 49, CASE WHEN q < 49 THEN -y END, CASE WHEN q < 49 THEN x END, place) AS text
FROM k WHERE kind <> 'picture' OR nth <= 4 GROUP BY document, page
"""


def _order_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders of each customer as a table of words, with a title above that is a caption for every other customer; boxes of the tables."""
    by_customer = Window.partitionBy("o_custkey")
    orders = table(spark, sf, "orders").select("*", F.min("o_orderkey").over(by_customer).alias("least"), F.row_number().over(by_customer.orderBy("o_orderkey")).alias("nth"))
    top = ((F.col("o_orderkey") - F.col("least")) * 4 + 100).cast("double")
    word = lambda left, right, text, above=top, height=3: F.struct(F.lit(left).alias("left"), above.alias("top"), F.lit(right).alias("right"), (above + height).alias("bottom"), text.alias("text"))
    line = F.array(word(50.0, 90.0, F.col("o_orderkey").cast("string")), word(120.0, 130.0, F.lit("is")), word(133.0, 150.0, F.col("o_orderstatus")), word(200.0, 260.0, F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))))
    title = F.array(word(60.0, 90.0, F.when(F.col("o_custkey") % 2 == 0, "Table").otherwise("Orders"), F.lit(80.0), 8), word(100.0, 130.0, F.col("o_custkey").cast("string"), F.lit(80.0), 8))
    words = orders.select(F.col("o_custkey").alias("document"), F.lit(1).alias("page"), F.inline(F.when(F.col("nth") == 1, F.concat(title, line)).otherwise(line))).where("text is not null")
    ends = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
    boxes = ends.select(F.col("o_custkey").alias("document"), F.lit(1).alias("page"), F.lit(40.0).alias("left"), F.lit(99.0).alias("top"), F.lit(270.0).alias("right"), ((F.col("most") - F.col("least")) * 4 + 103).cast("double").alias("bottom"))
    return boxes, words


def word_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables found in positioned words, under the captions above them."""
    return layout.marked_tables(*_order_words(spark, sf)).select("document", "page", "text")


WORD_TABLES_SQL = """
WITH o AS (
  SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS p,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders
), w AS (SELECT o_custkey, max(p IS NOT NULL) AS wide FROM o GROUP BY o_custkey)
SELECT o_custkey AS document, CAST(1 AS INTEGER) AS page,
       CASE WHEN o_custkey % 2 = 0 THEN '[EXTRACTED TABLE: Table ' || o_custkey || ']' ELSE '[EXTRACTED TABLE]' END || chr(10)
       || string_agg('| ' || o_orderkey || ' | is ' || o_orderstatus || CASE WHEN wide THEN ' | ' || coalesce(p, '') ELSE '' END || ' |'
            || CASE WHEN nth = 1 THEN chr(10) || CASE WHEN wide THEN '| --- | --- | --- |' ELSE '| --- | --- |' END ELSE '' END, chr(10) ORDER BY o_orderkey) AS text
FROM o JOIN w USING (o_custkey) GROUP BY o_custkey
"""


def block_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A reply in nested blocks for each customer's orders: a line that names the customer, a table of key and status."""
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r"))
    none = F.array().cast("array<struct<Type:string,Ids:array<string>>>")
    child = lambda ids: F.array(F.struct(F.lit("CHILD").alias("Type"), ids.alias("Ids")))
    one = lambda i, kind, text, row, column, below: F.struct(i.alias("Id"), F.lit(kind).alias("BlockType"), text.alias("Text"), row.cast("int").alias("RowIndex"), column.cast("int").alias("ColumnIndex"), F.lit(None).cast("string").alias("SelectionStatus"), below.alias("Relationships"))
    null = F.lit(None).cast("string")
    cells = lambda column, text: F.array(one(F.concat("k", F.lit(f"c{column}")), "CELL", null, F.col("r"), F.lit(column), child(F.array(F.concat("k", F.lit(f"w{column}"))))), one(F.concat("k", F.lit(f"w{column}")), "WORD", text, null, null, none))
    blocks = orders.select("o_custkey", "k", F.concat(cells(1, F.col("k")), cells(2, F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))).alias("b"))
    made = blocks.groupBy("o_custkey").agg(F.flatten(F.collect_list("b")).alias("cells"), F.collect_list("k").alias("ks"))
    ids = F.flatten(F.transform("ks", lambda k: F.array(F.concat(k, F.lit("c1")), F.concat(k, F.lit("c2")))))
    whole = F.concat(F.array(one(F.lit("t"), "TABLE", null, null, null, child(ids))), F.col("cells"), F.array(one(F.lit("l"), "LINE", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), null, null, none)))
    replies = made.select(F.col("o_custkey").alias("page_id"), F.to_json(F.struct(whole.alias("Blocks"))).alias("reply"))
    return layout.block_texts(replies).select("page_id", "text")


BLOCK_TABLES_SQL = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey AS page_id, 'Customer ' || o_custkey || chr(10) || chr(10)
       || string_agg('| ' || o_orderkey || ' | ' || CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END || ' |'
            || CASE WHEN nth = 1 AND n > 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY o_orderkey) AS text
FROM o GROUP BY o_custkey
"""


def document_probe(spark: SparkSession, sf: str) -> DataFrame:
    """How to parse each order, its lines taken as pages; and which of its pages hold charts."""
    pages = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document"), (F.col("l_linenumber") * 1_000_000 + _tie()).alias("page"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "see Figure 3 ").otherwise("plain "), F.repeat(F.lit("word "), (F.col("l_quantity") * 2).cast("int"))).alias("text"),
        F.array((F.col("l_partkey") % 700).cast("int"), (F.col("l_suppkey") % 500).cast("int")).alias("image_widths"), (F.col("l_partkey") % 40).alias("n_paths"),
    )
    documents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document"))
    charts = pages.where(layout.is_chart(F.col("text"), F.col("n_paths"))).groupBy("document").agg(F.count("*").alias("n_charts"))
    sparse = pages.where(layout.is_sparse(F.col("text"))).groupBy("document").agg(F.count("*").alias("n_sparse"))
    out = layout.probe(documents, pages).join(charts, "document", "left").join(sparse, "document", "left")
    return out.select("document", "route", "n_pages", F.coalesce("n_charts", F.lit(0)).alias("n_charts"), F.coalesce("n_sparse", F.lit(0)).alias("n_sparse"))


DOCUMENT_PROBE_SQL = """
WITH p AS (
  SELECT l_orderkey AS document, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 1000, l_suppkey % 1000) AS nth,
         length(replace(CASE WHEN l_linenumber % 2 = 0 THEN 'see Figure 3 ' ELSE 'plain ' END || repeat('word ', CAST(l_quantity * 2 AS BIGINT)), ' ', '')) < 120 AS sparse,
         greatest(l_partkey % 700, l_suppkey % 500) >= 600 AS wide, l_linenumber % 2 = 0 AND l_partkey % 40 >= 16 AS chart
  FROM lineitem
), g AS (
  SELECT document, count(*) FILTER (nth <= 5) AS n, count(*) FILTER (nth <= 5 AND sparse) AS s, count(*) FILTER (nth <= 5 AND wide) AS w,
         count(*) FILTER (chart) AS n_charts, count(*) FILTER (sparse) AS n_sparse FROM p GROUP BY document
)
SELECT o_orderkey AS document, CASE WHEN s >= greatest(1, n // 2) THEN 'pdf_scanned' WHEN w >= greatest(1, n // 2) THEN 'pdf_chart_heavy' ELSE 'pdf_text' END AS route,
       coalesce(n, 0) AS n_pages, coalesce(n_charts, 0) AS n_charts, coalesce(n_sparse, 0) AS n_sparse
FROM orders LEFT JOIN g ON document = o_orderkey
"""

QUERIES = {"page_order": page_order, "word_tables": word_tables, "block_tables": block_tables, "document_probe": document_probe}
SQL = {"page_order": PAGE_ORDER_SQL, "word_tables": WORD_TABLES_SQL, "block_tables": BLOCK_TABLES_SQL, "document_probe": DOCUMENT_PROBE_SQL}
