"""Layout of pages from what a parser has seen: boxes, positioned words, nested blocks and features of pages.

No parser is called here. Elements (document, page, place, kind, left, top, right, bottom, text) have their origin at the
bottom left, as layout models give them; words (document, page, left, top, right, bottom, text) at the top left, as text
extractors do. ``place`` is the order in which a parser has found things. Reading order and probes are windows and joins
over such tables; grids and captions are read in a row that holds a page's words, which are the largest group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docgrain.functions import text as T
from docgrain.operators import tables

# Sizes in points and pixels, counts, and the patterns of captions and charts.
PICTURES, PICTURE_SIDE = 4, 80
CAPTION_BAND, CAPTION_LENGTH = 40, 120
CAPTION = r"(?i)^\s*table\s*[\dA-Z\-.]+"
CHART = r"(?i)\b(?:figure|fig\.|chart|graph|exhibit|diagram|illustration)\s*[\dA-Z]"
PROBED, SPARSE, WIDE_IMAGE, CHART_PATHS = 5, 120, 600, 16
#: Replies, and pages of words, that are read at once.
SLICE = 256
TABLE_MARK = "[EXTRACTED TABLE]\n"

PAGE = ("document", "page")
EDGES = ("left", "top", "right", "bottom")
CELLS = ArrayType(ArrayType(StringType()))
BLOCKS = "struct<Blocks:array<struct<Id:string,BlockType:string,Text:string,RowIndex:int,ColumnIndex:int,SelectionStatus:string,Relationships:array<struct<Type:string,Ids:array<string>>>>>>"


def page_texts(elements: DataFrame, pictures: int | None = PICTURES, side: float = PICTURE_SIDE) -> DataFrame:
    """(document, page, text): the elements of each page from top to bottom, then from left to right, blank lines between.

    Elements without a box come last; equal places keep the parser's order. Empty texts are left out, tables are marked.
    Of the pictures with a description whose box is at least ``side`` both ways, the first ``pictures`` of a page in the
    parser's order are taken, all with None. Pages without anything are left out.
    """
    text = T.strip(F.col("text"))
    rows = elements.withColumn("text", F.coalesce(text, F.lit(""))).where("text <> ''")
    picture = F.coalesce(F.col("kind") == "picture", F.lit(False))
    large = (F.abs(F.col("right") - F.col("left")) >= side) & (F.abs(F.col("top") - F.col("bottom")) >= side)
    rows = rows.where(~picture | F.coalesce(large, F.lit(False)))
    if pictures is not None:
        nth = F.row_number().over(Window.partitionBy(*PAGE, picture).orderBy("place", "text"))
        rows = rows.withColumn("nth", nth).where(~picture | (F.col("nth") <= pictures))
    body = F.when(F.col("kind") == "table", F.concat(F.lit(TABLE_MARK), "text")).otherwise(F.col("text"))
    boxed = F.col("top").isNotNull() & F.col("left").isNotNull()
    key = F.struct((~boxed).alias("a"), F.when(boxed, -F.col("top")).alias("b"), F.when(boxed, F.col("left")).alias("c"), F.col("place"), body.alias("body"))
    ordered = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(key)).alias("e"))
    return ordered.select(*PAGE, F.array_join(F.transform("e", lambda e: e["body"]), "\n\n").alias("text"))


def islands(rows: DataFrame, keys: tuple[str, ...], low: str, high: str, gap: float, into: str) -> DataFrame:
    """``rows`` with the number, from 1, of the interval that low..high belongs to after all that overlap are joined.

    Intervals less than ``gap`` apart are joined too; with a negative gap they must overlap by more than that.
    """
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(low) - reach >= gap), 1).otherwise(0)
    found = rows.withColumn(f"__{into}", opens)
    return found.withColumn(into, F.sum(f"__{into}").over(order).cast("int")).drop(f"__{into}")


def reading_order(words: DataFrame, column_gap: float = 12.0, overlap: float = 2.0) -> DataFrame:
    """``words`` with their column, their line inside it, and their place in the reading order of the page, each from 1.

    Columns are what a gap that runs down the whole page parts; lines are words whose heights overlap by more than
    ``overlap`` points.
    """
    rows = islands(words, PAGE, "left", "right", column_gap, "column")
    rows = islands(rows, (*PAGE, "column"), "top", "bottom", -overlap, "line")
    order = Window.partitionBy(*PAGE).orderBy("column", "line", "left", "right", "text")
    return rows.withColumn("place", F.row_number().over(order).cast("int"))


def word_grids(words: DataFrame, keys: tuple[str, ...] = PAGE, column_gap: float = 6.0, overlap: float = 2.0) -> DataFrame:
    """(keys, cells): words put into the rows and columns that their edges show, as an array of rows of strings.

    Rows are words whose heights overlap, columns words whose widths do, over all of a table; words of a cell are joined
    from left to right. Cells without words are empty. A table's words are read in one row.
    """
    held = words.groupBy(*keys).agg(F.collect_list(_word()).alias("words"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            group, found = _words_of(part.column("words"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _grids(group, part.num_rows, found, column_gap, overlap)], [*keys, "cells"])

    return held.mapInArrow(read, StructType([*held.schema.fields[:-1], StructField("cells", CELLS)]))


def _word() -> Column:
    """A positioned word in a row that holds a page's or a table's words."""
    return F.struct(*[F.col(edge).cast("double").alias(edge) for edge in EDGES], F.col("text").cast("string").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))


def _owners(lists: pa.ListArray) -> np.ndarray:
    """The row that each element of ``lists`` belongs to."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _edges(boxes: pa.StructArray) -> dict[str, np.ndarray]:
    """Edges of boxes or words; null ones come before all others and are in no box."""
    return {edge: pc.fill_null(boxes.field(edge).cast(pa.float64()), -np.inf).to_numpy(zero_copy_only=False) for edge in EDGES}


def _words_of(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each word of ``lists``; edges, texts and the order of the texts."""
    flat = lists.flatten()
    text = flat.field("text")
    order = np.empty(len(flat), np.int64)
    order[pc.sort_indices(text).to_numpy()] = np.arange(len(flat))
    return _owners(lists), _edges(flat) | {"text": text.to_numpy(zero_copy_only=False), "order": order}


def _taken(words: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {name: values[which] for name, values in words.items()}


def _numbered(group: np.ndarray, low: np.ndarray, high: np.ndarray, gap: float) -> np.ndarray:
    """What :func:`islands` gives, of arrays: for each interval its number in its group, from 1."""
    order, n = np.lexsort((high, low, group)), len(group)
    g, lo, hi = group[order], low[order], high[order]
    first = np.append(True, g[1:] != g[:-1])[:n]
    # The furthest end so far, inside each group: by the places of the ends in their order, groups one above the other.
    ends = np.argsort(hi, kind="stable")
    place = np.empty(n, np.int64)
    place[ends] = np.arange(n)
    reach = hi[ends[np.maximum.accumulate(g * n + place) - g * n]]
    with np.errstate(invalid="ignore"):
        opens = first | np.append(True, ~(lo[1:] - reach[:-1] < gap))[:n]
    count = np.cumsum(opens)
    starts = np.nonzero(first)[0]
    out = np.empty(n, np.int64)
    out[order] = count - np.repeat(count[starts] - 1, np.diff(np.append(starts, n)))
    return out


def _runs(keys: tuple[np.ndarray, ...], words: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """For each run of equal ``keys``, the last most important: one of its words, and its texts from left to right, joined."""
    order = np.lexsort((words["order"], words["right"], words["left"], *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    starts, text = np.nonzero(new)[0], words["text"][order].tolist()
    ends = np.append(starts, len(order))[1:].tolist()
    return order[starts], [" ".join(t for t in text[i:j] if t is not None) for i, j in zip(starts.tolist(), ends, strict=True)]


def _grids(group: np.ndarray, n: int, words: dict[str, np.ndarray], column_gap: float = 6.0, overlap: float = 2.0) -> pa.ListArray:
    """The cells of the ``n`` groups of words."""
    row, column = _numbered(group, words["top"], words["bottom"], -overlap), _numbered(group, words["left"], words["right"], column_gap)
    high, wide = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(high, group, row)
    np.maximum.at(wide, group, column)
    base = np.cumsum(high * wide) - high * wide
    one, cells = _runs((column, row, group), words)
    flat = np.full((high * wide).sum(), "", object)
    flat[base[group[one]] + (row[one] - 1) * wide[group[one]] + column[one] - 1] = cells
    offsets = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    rows = pa.ListArray.from_arrays(offsets(np.repeat(wide, high)), pa.array(flat, pa.string()))
    return pa.ListArray.from_arrays(offsets(high), rows)


def _lines(group: np.ndarray, n: int, words: dict[str, np.ndarray]) -> list[str]:
    """The words of each of the ``n`` groups, line by line."""
    line = _numbered(group, words["top"], words["bottom"], -2.0)
    one, texts = _runs((line, group), words)
    out: list[list[str]] = [[] for _ in range(n)]
    for g, text in zip(group[one].tolist(), texts, strict=True):
        out[g].append(text)
    return ["\n".join(lines) for lines in out]


def _in_boxes(boxes: DataFrame, words: DataFrame, band: float) -> DataFrame:
    """``boxes`` with the lines of the ``band`` above each (``above``) and the grid of the words inside (``cells``).

    Words and boxes are shuffled once, by page; a page is read in its row, whose words are its memory.
    """
    columns = boxes.columns
    held = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct(*columns)).alias("boxes"))
    held = held.join(words.groupBy(*PAGE).agg(F.collect_list(_word()).alias("words")), list(PAGE), "left").select("boxes", "words")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found, (page, words) = part.column("boxes").flatten(), _words_of(part.column("words"))
            edge, mine = _edges(found), _owners(part.column("boxes"))
            x, y = (words["left"] + words["right"]) / 2, (words["top"] + words["bottom"]) / 2
            sizes = np.bincount(mine, minlength=part.num_rows)
            first, above, inside = np.cumsum(sizes) - sizes, [], []
            for k in range(sizes.max(initial=0)):  # the k-th box of each page that has one, with the page's words
                near = np.nonzero(sizes[page] > k)[0]
                box = first[page[near]] + k
                here = (x[near] >= edge["left"][box]) & (x[near] <= edge["right"][box])
                top, at = edge["top"][box], y[near]
                for ok, kept in ((here & (at >= np.maximum(top - band, 0)) & (at < top), above), (here & (at >= top) & (at <= edge["bottom"][box]), inside)):
                    kept.append((near[ok], box[ok]))
            (a, of_a), (i, of_i) = ([np.concatenate(x) for x in zip(*kept, strict=True)] for kept in (above, inside))
            lines, cells = _lines(of_a, len(found), _taken(words, a)), _grids(of_i, len(found), _taken(words, i))
            yield pa.RecordBatch.from_arrays([*found.flatten(), pa.array(lines, pa.string()), cells], [*columns, "above", "cells"])

    return held.mapInArrow(read, StructType([*boxes.schema.fields, StructField("above", StringType()), StructField("cells", CELLS)]))


def _caption() -> Column:
    """The text above a box if it begins like a caption, or ""."""
    text = T.strip(F.col("above"))
    return F.when(text.rlike(CAPTION), F.substring(text, 1, CAPTION_LENGTH)).otherwise("")


def captions(boxes: DataFrame, words: DataFrame, band: float = CAPTION_BAND) -> DataFrame:
    """``boxes`` of tables (document, page, left, top, right, ...) with the caption found in the ``band`` above each, or "".

    The words whose middle is in the band are read line by line; they are a caption if they begin like one.
    """
    whole = boxes if "bottom" in boxes.columns else boxes.withColumn("bottom", F.col("top"))
    return _in_boxes(whole, words, band).select(*boxes.columns, _caption().alias("caption"))


def marked_tables(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """(document, page, top, text): the tables in boxes as piped text under their captions, as chunks have them."""
    found = _in_boxes(boxes, words, CAPTION_BAND).select("document", "page", "top", _caption().alias("caption"), "cells")
    # A generator makes the text once; a filter on the text itself would make it twice.
    texts = found.select("document", "page", "top", "caption", F.explode_outer(F.array(tables.cells_markdown(F.col("cells")))).alias("markdown")).where("markdown <> ''")
    head = F.when(F.col("caption") == "", F.lit("[EXTRACTED TABLE]")).otherwise(F.concat(F.lit("[EXTRACTED TABLE: "), "caption", F.lit("]")))
    return texts.select("document", "page", "top", F.concat(head, F.lit("\n"), "markdown").alias("text"))


def _blocks_text(ids: list, kinds: list, texts: list, rows: list, columns: list, children: list) -> tuple[str, list[str]]:
    """The lines of one reply's blocks, joined, and its tables as piped text; of blocks with one id the last is meant."""
    last = {name: at for at, name in enumerate(ids) if name is not None}
    lines, tables = [text for kind, text in zip(kinds, texts, strict=True) if kind == "LINE"], []
    for table in (at for at, kind in enumerate(kinds) if kind == "TABLE"):
        cells = {}
        for cell in (last[name] for name in children[table] if name in last):
            if kinds[cell] == "CELL" and rows[cell] >= 1 and columns[cell] >= 1:
                words = (last[name] for name in children[cell] if name in last)
                cells[rows[cell], columns[cell]] = " ".join(texts[w] for w in words if kinds[w] == "WORD")
        if cells:
            n_rows, n_columns = (max(place) for place in zip(*cells, strict=True))
            body = ["| " + " | ".join(cells.get((r, c), "") for c in range(1, n_columns + 1)) + " |" for r in range(1, n_rows + 1)]
            tables.append("\n".join(body[:1] + ["| " + " | ".join(["---"] * n_columns) + " |"] * (n_rows > 1) + body[1:]))
    return "\n".join(lines), tables


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lines, tables) of replies whose blocks' fields are arrays: a reply is one row's work, without a shuffle."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            fields = [part.column(name).to_pylist() for name in part.schema.names[1:]]
            read = [_blocks_text(*reply) if reply[0] is not None else ("", []) for reply in zip(*fields, strict=True)]
            lines, tables = pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("id"), lines, tables], ["id", "lines", "tables"])


def block_texts(replies: DataFrame, id_col: str = "page_id", json_col: str = "reply") -> DataFrame:
    """(id, text, tables) of a managed parser's replies: lines in their order, then the tables as piped text.

    A reply is JSON with blocks that name their children: words of a line, cells of a table, words of a cell. A cell
    stands at its row and column, of several at one place the last; cells without words are empty. A reply that is no
    JSON has an empty text.
    """
    parsed = replies.select(F.col(id_col).alias("id"), F.from_json(F.col(json_col), BLOCKS)["Blocks"].alias("blocks"))
    children = lambda b: F.coalesce(F.flatten(F.transform(F.filter(b["Relationships"], lambda r: r["Type"] == "CHILD"), lambda r: r["Ids"])), F.array().cast("array<string>"))
    fields = {"ids": lambda b: b["Id"], "kinds": lambda b: b["BlockType"], "texts": lambda b: F.coalesce(b["Text"], F.lit("")), "rows": lambda b: F.coalesce(b["RowIndex"], F.lit(1)), "columns": lambda b: F.coalesce(b["ColumnIndex"], F.lit(1)), "children": children}
    flat = parsed.select("id", *[F.transform("blocks", get).alias(name) for name, get in fields.items()])
    whole = flat.mapInArrow(_read_blocks, f"id {parsed.schema['id'].dataType.simpleString()}, lines string, tables array<string>")
    texts = F.coalesce("tables", F.array().cast("array<string>"))
    joined = F.concat(F.coalesce("lines", F.lit("")), F.when(F.size(texts) > 0, F.concat(F.lit("\n\n"), F.array_join(texts, "\n\n"))).otherwise(""))
    return whole.select(F.col("id").alias(id_col), T.strip(joined).alias("text"), texts.alias("tables"))


def is_sparse(text: Column) -> Column:
    """Whether a page has so little text that it is read as a scan."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < SPARSE


def is_chart(text: Column, n_paths: Column) -> Column:
    """Whether a page speaks of a chart and has enough drawing to hold one."""
    return F.coalesce(text, F.lit("")).rlike(CHART) & (F.coalesce(n_paths, F.lit(0)) >= CHART_PATHS)


def probe(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(document, route, n_pages): how to parse each document, from features of its first pages alone.

    ``pages`` has document, page, text and image_widths. Of the first ``PROBED`` pages, half (rounded down, one at
    least) with next to no text make a scan, half with a wide image a document of charts; all others, and documents
    without pages, are text. Only the first pages of a document leave the scan of ``pages``.
    """
    first = F.row_number().over(Window.partitionBy("document").orderBy("page"))
    sparse = F.length(F.replace(T.strip(F.coalesce("text", F.lit(""))), F.lit(" "), F.lit(""))) < SPARSE
    wide = F.coalesce(F.exists("image_widths", lambda w: w >= WIDE_IMAGE), F.lit(False))
    seen = pages.select("document", "page", sparse.alias("sparse"), wide.alias("wide")).withColumn("nth", first).where(F.col("nth") <= PROBED)
    found = seen.groupBy("document").agg(F.count("*").alias("n"), F.sum(F.col("sparse").cast("int")).alias("sparse"), F.sum(F.col("wide").cast("int")).alias("wide"))
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    route = F.when(F.col("sparse") >= half, "pdf_scanned").when(F.col("wide") >= half, "pdf_chart_heavy").otherwise("pdf_text")
    return documents.select("document").join(found, "document", "left").select("document", route.alias("route"), F.coalesce("n", F.lit(0)).alias("n_pages"))
