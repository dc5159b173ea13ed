"""Reading order, grids and captions of positioned boxes, nested blocks and probes, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docgrain.operators import layout, tables

ELEMENTS = "document string, page int, place int, kind string, left double, top double, right double, bottom double, text string"
WORDS = "document string, page int, left double, top double, right double, bottom double, text string"


def test_pages_are_read_from_the_top(spark):
    rows = [
        ("d", 1, 1, "text", 50.0, 700.0, 90.0, 690.0, " first "),
        ("d", 1, 2, "text", 10.0, 100.0, 90.0, 90.0, "last"),
        ("d", 1, 3, "table", 10.0, 400.0, 90.0, 300.0, "| a |"),
        ("d", 1, 4, "text", 10.0, 400.0, 90.0, 300.0, "beside"),
        ("d", 1, 5, "text", None, None, None, None, "nowhere"),
        ("d", 1, 6, "text", 1.0, 1.0, 1.0, 1.0, "  "),
        ("d", 1, 7, "text", 1.0, 1.0, 1.0, 1.0, None),
        *[("d", 1, 10 + k, "picture", 10.0, 600.0 - k, 10.0 + 80, 500.0 - k, f"pic{k}") for k in range(6)],
        ("d", 1, 9, "picture", 10.0, 600.0, 89.0, 400.0, "too narrow"),
        ("d", 1, 8, "picture", None, 600.0, 89.0, 400.0, "no box"),
        ("d", 2, 1, None, 1.0, 1.0, 1.0, 1.0, "next"),
        ("d", 3, 1, "text", 1.0, 1.0, 1.0, 1.0, ""),
    ]
    frame = spark.createDataFrame(rows, ELEMENTS)
    got = {r["page"]: r["text"] for r in layout.page_texts(frame).collect()}
    assert got == {1: "first\n\npic0\n\npic1\n\npic2\n\npic3\n\n[EXTRACTED TABLE]\n| a |\n\nbeside\n\nlast\n\nnowhere", 2: "next"}
    assert {r["page"]: r["text"] for r in layout.page_texts(frame, pictures=None).collect()}[1].count("pic") == 6
    assert layout.page_texts(frame.limit(0)).count() == 0


def plain_islands(spans, gap):
    out, reach, n = [], None, 0
    for low, high in sorted(spans):
        n += reach is None or low - reach >= gap
        reach = high if reach is None else max(reach, high)
        out.append((low, high, n))
    return out


@pytest.mark.parametrize("gap", [-2.0, 0.0, 3.0])
def test_islands_equal_a_plain_scan(spark, gap):
    rng = random.Random(2)
    spans = [(k, low := float(rng.randint(0, 90)), low + rng.randint(1, 12)) for k in (1, 2) for _ in range(25)]
    got = layout.islands(spark.createDataFrame(spans, "k int, low double, high double"), ("k",), "low", "high", gap, "n").collect()
    for k in (1, 2):
        mine = sorted((r["low"], r["high"], r["n"]) for r in got if r["k"] == k)
        assert mine == plain_islands([(a, b) for i, a, b in spans if i == k], gap)


def test_columns_come_one_after_the_other(spark):
    left = [("d", 1, 10.0 + 30 * (i % 3), 10.0 + 12 * (i // 3), 35.0 + 30 * (i % 3), 20.0 + 12 * (i // 3), f"l{i}") for i in range(9)]
    right = [("d", 1, 200.0 + 40 * (i % 2), 11.0 + 12 * (i // 2), 235.0 + 40 * (i % 2), 21.0 + 12 * (i // 2), f"r{i}") for i in range(6)]
    rows = left + right
    random.Random(1).shuffle(rows)
    got = layout.reading_order(spark.createDataFrame(rows, WORDS)).orderBy("place").collect()
    assert [r["text"] for r in got] == [f"l{i}" for i in range(9)] + [f"r{i}" for i in range(6)]
    assert [(r["column"], r["line"]) for r in got][::3] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_grids_come_back_from_their_words(spark):
    """Grids with words of random widths, gaps and empty cells; what is empty all over cannot be seen."""
    rng = random.Random(4)
    words, want = [], {}
    for d in range(12):
        grid = [[" ".join(rng.choice("abcd") * rng.randint(1, 5) for _ in range(rng.choice((1, 1, 2)))) if r == 0 or c == 0 or rng.random() < 0.8 else "" for c in range(4)] for r in range(rng.randint(1, 5))]
        want[str(d)] = grid
        for r, row in enumerate(grid):
            for c, cell in enumerate(row):
                at = 10.0 + 120 * c + rng.randint(0, 5)
                for word in cell.split():
                    words.append((str(d), 1, at, 50.0 + 14 * r + rng.randint(0, 2), at + 6 * len(word), 60.0 + 14 * r, word))
                    at += 6 * len(word) + 3
    frame = spark.createDataFrame(words, WORDS)
    got = {r["document"]: r["cells"] for r in layout.word_grids(frame).collect()}
    assert got == want
    marked = {r["document"]: r["m"] for r in layout.word_grids(frame).select("document", tables.cells_markdown(F.col("cells")).alias("m")).collect()}
    assert marked["0"].splitlines()[0] == "| " + " | ".join(want["0"][0]) + " |"
    assert layout.word_grids(frame.limit(0)).count() == 0


def test_captions_are_in_the_band_above(spark):
    boxes = spark.createDataFrame([("d", 1, 10.0, 100.0, 200.0, 300.0), ("d", 1, 10.0, 400.0, 200.0, 500.0), ("d", 2, 10.0, 30.0, 200.0, 90.0), ("e", 1, 0.0, 50.0, 9.0, 60.0)], "document string, page int, left double, top double, right double, bottom double")
    say = lambda d, p, x, y, t: (d, p, x, y, x + 20, y + 8, t)
    words = [say("d", 1, 20.0, 70.0, "Table"), say("d", 1, 45.0, 70.0, "2.1"), say("d", 1, 20.0, 82.0, "of"), say("d", 1, 300.0, 70.0, "aside"), say("d", 1, 20.0, 40.0, "far"), say("d", 1, 20.0, 380.0, "no"), say("d", 1, 50.0, 380.0, "Table"), say("d", 2, 20.0, 5.0, "TABLE"), say("d", 2, 50.0, 5.0, "x" * 300)]
    got = {(r["document"], r["page"], r["top"]): r["caption"] for r in layout.captions(boxes, spark.createDataFrame(words, WORDS)).collect()}
    assert got == {("d", 1, 100.0): "Table 2.1\nof", ("d", 1, 400.0): "", ("d", 2, 30.0): "TABLE " + "x" * 114, ("e", 1, 50.0): ""}


def plain_reply(reply):
    """Text of a reply, block by block."""
    try:
        blocks = json.loads(reply)["Blocks"]
    except (TypeError, ValueError, KeyError):
        return ""
    known = {b["Id"]: b for b in blocks}
    below = lambda b, kind: [c for r in b.get("Relationships") or [] if r["Type"] == "CHILD" for i in r["Ids"] if (c := known.get(i, {})).get("BlockType") == kind]
    out = "\n".join(b.get("Text") or "" for b in blocks if b["BlockType"] == "LINE")
    marked = []
    for t in blocks:
        if t["BlockType"] == "TABLE" and (cells := below(t, "CELL")):
            width = max(c["ColumnIndex"] for c in cells)
            grid = {(c["RowIndex"], c["ColumnIndex"]): " ".join(w.get("Text") or "" for w in below(c, "WORD")) for c in cells}
            rows = ["| " + " | ".join(grid.get((r, c), "") for c in range(1, width + 1)) + " |" for r in range(1, max(c["RowIndex"] for c in cells) + 1)]
            if len(rows) > 1:
                rows.insert(1, "| " + " | ".join(["---"] * width) + " |")
            marked.append("\n".join(rows))
    return (out + ("\n\n" + "\n\n".join(marked) if marked else "")).strip()


def test_nested_blocks(spark):
    rng = random.Random(6)

    def reply():
        blocks = [{"Id": f"l{i}", "BlockType": "LINE", "Text": rng.choice(["one", "two words", None])} for i in range(rng.randint(0, 3))]
        for t in range(rng.randint(0, 3)):
            cells = []
            for i in range(rng.randint(0, 7)):
                words = [{"Id": f"t{t}c{i}w{k}", "BlockType": rng.choice(["WORD", "WORD", "SELECTION_ELEMENT"]), "Text": rng.choice("abc")} for k in range(rng.randint(0, 3))]
                cell = {"Id": f"t{t}c{i}", "BlockType": "CELL", "RowIndex": rng.randint(1, 3), "ColumnIndex": rng.randint(1, 3), "Relationships": [{"Type": "CHILD", "Ids": [w["Id"] for w in words]}, {"Type": "MERGED", "Ids": ["x"]}]}
                cells += [cell, *words]
            blocks += [{"Id": f"t{t}", "BlockType": "TABLE", "Relationships": [{"Type": "CHILD", "Ids": [c["Id"] for c in cells if c["BlockType"] == "CELL"] + ["gone"]}]}, *cells]
        rng.shuffle(blocks)
        return json.dumps({"Blocks": blocks})

    rows = [(i, reply()) for i in range(40)] + [(100, None), (101, "no json"), (102, "{}"), (103, '{"Blocks":[]}')]
    got = {r["page_id"]: r["text"] for r in layout.block_texts(spark.createDataFrame(rows, "page_id int, reply string")).collect()}
    assert got == {i: plain_reply(r) for i, r in rows}


def test_probe_edges(spark):
    long = "x" * 120
    rows = [("scan", 1, " a " * 90, None), ("text", 1, long, [599]), ("wide", 1, long, [10, 600]), ("five", 1, None, []), *[("five", p, long, []) for p in range(2, 9)], ("one", 1, long, [700]), ("one", 2, long, []), ("one", 3, long, [None])]
    docs = spark.createDataFrame([(d,) for d in ("scan", "text", "wide", "five", "one", "none")], "document string")
    got = {r["document"]: (r["route"], r["n_pages"]) for r in layout.probe(docs, spark.createDataFrame(rows, "document string, page int, text string, image_widths array<int>")).collect()}
    assert got == {"scan": ("pdf_scanned", 1), "text": ("pdf_text", 1), "wide": ("pdf_chart_heavy", 1), "five": ("pdf_text", 5), "one": ("pdf_chart_heavy", 3), "none": ("pdf_text", 0)}


def test_replies_are_read_in_their_row(spark):
    """Nothing is shuffled for a reply, so that replies of one id stay apart; of blocks with one id the last is meant."""
    import json

    block = lambda i, kind, text=None, row=None, column=None, ids=None: {"Id": i, "BlockType": kind, "Text": text, "RowIndex": row, "ColumnIndex": column, "Relationships": [{"Type": "CHILD", "Ids": ids}] if ids else None}
    reply = json.dumps({"Blocks": [block("l", "LINE", "Top"), block("t", "TABLE", ids=["c", "d", "none"]), block("c", "CELL", row=1, column=1, ids=["w"]), block("d", "CELL", row=3, column=2, ids=["w", "l", "w"]), block("w", "WORD", "old"), block("w", "WORD", "new")]})
    out = layout.block_texts(spark.createDataFrame([(1, reply), (1, reply), (2, "no json"), (3, None)], "page_id long, reply string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    whole = "Top\n\n| new |  |\n| --- | --- |\n|  |  |\n|  | new new |"
    assert sorted((r["page_id"], r["text"]) for r in out.collect()) == [(1, whole), (1, whole), (2, ""), (3, "")]


def test_equal_boxes_have_a_table_each(spark):
    """Boxes are told apart by their place in the page's row, not by their edges, so that words come once in each."""
    box = ("d", 1, 0.0, 50.0, 100.0, 90.0)
    words = [("d", 1, 10.0, 60.0, 20.0, 70.0, "a"), ("d", 1, 50.0, 60.0, 60.0, 70.0, "b"), ("d", 1, 10.0, 20.0, 40.0, 28.0, "Table"), ("d", 1, 45.0, 20.0, 60.0, 28.0, "7"), ("d", 1, 10.0, None, 20.0, 70.0, "nowhere"), ("d", 1, 80.0, 60.0, 90.0, 70.0, None), ("e", 1, 1.0, 60.0, 2.0, 70.0, "no box")]
    boxes = spark.createDataFrame([box, box, ("d", 1, 0.0, 900.0, 9.0, 910.0), ("f", 1, 0.0, 50.0, 9.0, 60.0)], "document string, page int, left double, top double, right double, bottom double")
    got = [tuple(r) for r in layout.marked_tables(boxes, spark.createDataFrame(words, WORDS)).collect()]
    assert got == 2 * [("d", 1, 50.0, "[EXTRACTED TABLE: Table 7]\n| a | b |  |\n| --- | --- | --- |")]


def test_words_are_shuffled_once(spark):
    """Words and boxes go to their page once, and the text of a grid is made once, not again for each of its rows."""
    boxes = spark.createDataFrame([("d", 1, 0.0, 50.0, 100.0, 90.0)], "document string, page int, left double, top double, right double, bottom double")
    plan = layout.marked_tables(boxes, spark.createDataFrame([], WORDS))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 2
    cells = spark.createDataFrame([], "cells array<array<string>>").select(tables.cells_markdown(F.col("cells")).alias("m"))
    assert cells._jdf.queryExecution().sparkPlan().toString().count("regexp_replace") == 1


def test_grids_of_many_tables_equal_islands(spark):
    """Rows and columns of grids are those of the windows, whatever else the task reads."""
    rng = random.Random(9)
    words = [(str(d), 1, left := float(rng.randint(0, 150)), top := float(rng.randint(0, 90)), left + rng.randint(1, 30), top + rng.randint(3, 9), rng.choice(["x", "yy", "z"])) for d in range(40) for _ in range(rng.randint(1, 14))]
    frame = spark.createDataFrame(words, WORDS)
    numbered = layout.islands(layout.islands(frame, layout.PAGE, "top", "bottom", -2.0, "row"), layout.PAGE, "left", "right", 6.0, "column").collect()
    want = {}
    for d in {w[0] for w in words}:
        mine = sorted((r for r in numbered if r["document"] == d), key=lambda r: (r["left"], r["right"], r["text"]))
        want[d] = [[" ".join(r["text"] for r in mine if (r["row"], r["column"]) == (i, j)) for j in range(1, max(r["column"] for r in mine) + 1)] for i in range(1, max(r["row"] for r in mine) + 1)]
    assert {r["document"]: r["cells"] for r in layout.word_grids(frame.repartition(3)).collect()} == want
