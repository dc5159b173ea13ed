import pytest
from pyspark.sql import functions as F

from docgrain.operators import tables

PIPES = "| State | Traces |\n| --- | --- |\n| California | {a} |\n| Texas | {b} |\n| TOTAL | {c} |"


def chunk(key, source, text, title="Firearm traces by state", date=""):
    return (key, source, 3, date, title, text)


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        chunk("t1", "traces_2025.pdf", PIPES.format(a=100, b=90, c=190)),
        chunk("t2", "traces_2026.pdf", PIPES.format(a=120, b=110, c=230)),
        chunk("t3", "traces_2024.pdf", PIPES.format(a=80, b=70, c=150)),
        chunk("t4", "incidents.pdf", "region   incidents   injuries\nNorth   12   3\nSouth   14   5", "Bombing incidents by region", "2025"),
        chunk("t5", "ffl.pdf", "| id | company | street | city | state | count |\n|---|---|---|---|---|---|\n| 57134751 | EMCO INC | 601 MAIN | GADSDEN | AL | 2187 |\n| 57134752 | OTHER CO | 1 ELM | MOBILE | AL | 12 |", "Licensees", "1998"),
        chunk("p1", "prose.pdf", "No table here, only words."),
    ]
    frame = spark.createDataFrame(rows, "chunk_id string, source string, page int, document_date string, title string, text string")
    known, cells = tables.build_store(frame.withColumn("cells", tables.table_cells("text")))
    return known.persist(), cells.persist()


def test_parsing():
    got = tables.parse_table(PIPES.format(a=1, b=2, c=3))
    assert got["columns"] == ["State", "Traces"] and got["rows"][0] == ["California", "1"] and got["format"] == "markdown"
    assert tables.parse_table("| 1 | 2 |\n| 3 | 4 |")["columns"] == ["col1", "col2"]
    got = tables.parse_table("Area   2022   2023\nNorth   1   2\nSouth   3")
    assert got["columns"] == ["Area", "2022", "2023"] or got["rows"][0] == ["Area", "2022", "2023"]
    for text in (None, "", "prose only", "| one | row |", "x" * 70_000):
        assert tables.parse_table(text) is None


def test_store(store):
    known, cells = store
    assert known.count() == 5 and cells.count() == 13
    years = {r["table_id"]: r["year"] for r in known.collect()}
    assert years == {"t1": "2025", "t2": "2026", "t3": "2024", "t4": "2025", "t5": "1998"}


def test_families(store):
    known, _ = store
    families = tables.table_families(known).persist()
    got = {r["table_id"]: r for r in families.collect()}
    assert got["t1"]["family"] == got["t2"]["family"] == got["t3"]["family"] != got["t4"]["family"]
    assert got["t1"]["confidence"] >= 0.55
    top = tables.family_catalog(known, families).first()
    assert top["n_tables"] == 3 and top["years"] == "2024,2025,2026"
    assert tables.find_tables(known, "traces by state in 2026").first()["table_id"] == "t2"
    found = {r["table_id"] for r in tables.find_tables(known, "traces by state in 2026", families, k=1).collect()}
    assert found == {"t1", "t2", "t3"}


def test_row_lookup(spark, store):
    known, cells = store
    keys = tables.row_keys("What city is EMCO INC located in, according to 'Other Co' and 57134751?")
    assert ["EMCO"] in keys and ["57134751"] in keys
    asked = spark.createDataFrame([("q", ["EMCO"], "1998"), ("r", ["EMCO"], "2005"), ("s", ["EMCO", "MOBILE"], "")], "query_id string, key array<string>, year string")
    got = {r["query_id"]: r for r in tables.find_rows(known, cells, asked).collect()}
    assert got["q"]["row_text"] == "57134751 | EMCO INC | 601 MAIN | GADSDEN | AL | 2187" and got["q"]["score"] >= 0.85
    assert got["q"]["score"] > got["r"]["score"] and "s" not in got


def test_guarded_sql(spark, store):
    known, cells = store
    sql = "SELECT year, c1, SUM(CAST(c2 AS INT)) AS n FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) WHERE c1 <> 'TOTAL' GROUP BY year, c1 ORDER BY n DESC"
    got = tables.run_select(spark, sql, known, cells, ["t1", "t2"]).collect()
    assert (got[0]["year"], got[0]["c1"], got[0]["n"]) == ("2026", "California", 120) and len(got) == 4
    for bad in ("DROP TABLE t1", "SELECT 1; DELETE FROM t1", "SELECT nothing FROM t1", "SELECT FROM WHERE", "SELECT 'drop' FROM t1"):
        assert tables.run_select(spark, bad, known, cells, ["t1"]) is None


def test_expansion_and_text(spark, store):
    chunks = spark.createDataFrame([(i, "pdf", "d", p, k) for i, p, k in ((1, 1, "table"), (2, 1, "table"), (3, 1, "text"), (4, 2, "table"), (5, None, "table"), (6, None, "table"))], "chunk_id int, corpus string, document_id string, page int, content_type string")
    hits = spark.createDataFrame([("q", 1, 0.6), ("q", 5, 0.4)], "query_id string, chunk_id int, eval_score double")
    assert {(r["chunk_id"], r["eval_score"]) for r in tables.expand_tables(hits, chunks).collect()} == {(2, 0.4), (6, 0.4)}
    row = spark.createDataFrame([("| a | b |\n|--|--|\n| 1 | 2 |\n| 3 | 4 |", "", "x\n[Table 4: Sales]\n")], "t string, h string, c string")
    got = row.select(tables.table_text(tables.table_cells("t"), 1), tables.table_title(F.col("h"), F.col("c"))).first()
    assert got[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| … (1 more rows) |" and got[1] == "Table 4: Sales"
