"""Extracted tables: parsing, a store of their rows, families over years, row lookup, guarded SQL."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrain import services
from docgrain.functions import text as T

CELLS = "struct<columns:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int,format:string>"

#: Sizes beyond which a text is not taken for a table, and the words that do not tell families apart.
MAX_CHARS, MAX_LINES = 60_000, 1_000
FAMILY_JACCARD = 0.55
SIGNATURE_STOP = ("the", "of", "and", "by", "in", "for", "to", "a", "table", "exhibit", "figure", "report", "annual", "pdf", "total")
ROW_STOP = ("THE", "AND", "FOR", "INC", "LLC", "CO", "CORP", "LTD", "OF", "IN", "ACCORDING", "WHAT", "HOW", "MANY", "WHICH", "REPORT", "DATA", "UNITED", "STATES", "TOTAL", "PER", "NEW", "NORTH", "SOUTH", "EAST", "WEST")
WRITE_WORDS = ("insert", "update", "delete", "drop", "alter", "create", "attach", "pragma")

_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$")
_NUMBER = re.compile(r"-?\$?\d[\d,]*\.?\d*%?")
_NUMBERS_ONLY = re.compile(r"[\d.,%$\s-]+")
_GAP = re.compile(r"\s{2,}|\t")


def _padded(rows: list[list[str]]) -> list[list[str]]:
    width = max(map(len, rows))
    return [r + [""] * (width - len(r)) for r in rows]


def _named(header: list[str], width: int) -> list[str]:
    return [header[i] if i < len(header) and header[i] else f"col{i + 1}" for i in range(width)]


def parse_pipes(text: str) -> dict | None:
    """A table of lines with pipes: rules are skipped, rows have two filled cells, a header of numbers is data."""
    rows = []
    for line in [x for x in text.splitlines()[:MAX_LINES] if "|" in x and x.strip() and not _RULE.match(x)]:
        body = line.strip()
        body = body[1:] if body.startswith("|") else body
        body = body[:-1] if body.endswith("|") else body
        cells = [c.strip() for c in body.split("|")]
        if sum(map(bool, cells)) >= 2:
            rows.append(cells)
    if len(rows) < 2:
        return None
    rows = _padded(rows)
    numeric = all(not c or _NUMBERS_ONLY.fullmatch(c) for c in rows[0])
    header, body = ([], rows) if numeric else (rows[0], rows[1:])
    return {"columns": _named(header, len(rows[0])), "rows": body, "n_rows": len(body), "n_cols": len(rows[0]), "format": "markdown"}


def parse_columns(text: str) -> dict | None:
    """A table of aligned columns: cells are two spaces or a tab apart, rows have a number, one line of words before them names the columns."""
    rows, header = [], []
    for line in map(str.strip, text.splitlines()[:MAX_LINES]):
        if not line or line.startswith("[") or "|" in line:
            continue
        cells = [c.strip() for c in _GAP.split(line) if c.strip()]
        numbers = sum(bool(_NUMBER.fullmatch(c)) for c in cells)
        if len(cells) >= 2 and numbers:
            rows.append(cells)
        elif len(cells) >= 2 and not rows and not header:
            header = cells
    if len(rows) < 2:
        return None
    rows = _padded(rows)
    width = len(rows[0])
    return {"columns": _named(header[:width], width), "rows": rows, "n_rows": len(rows), "n_cols": width, "format": "columnar"}


def parse_table(text: str | None) -> dict | None:
    """Cells of a table's text, by pipes or else by columns; None if it is no table."""
    if not text or len(text) > MAX_CHARS:
        return None
    return parse_pipes(text) or parse_columns(text)


def table_cells(text: Column | str) -> Column:
    """Parsed cells of each text, null where it is no table."""

    @F.pandas_udf(CELLS)
    def parse(texts: pd.Series) -> pd.DataFrame:
        none = {"columns": None, "rows": None, "n_rows": None, "n_cols": None, "format": None}
        return pd.DataFrame([parse_table(t) or none for t in texts], columns=list(none))

    cells = parse(text)
    return F.when(cells["rows"].isNotNull(), cells)


def table_text(cells: Column, most: int = 40) -> Column:
    """Cells as a markdown table of at most ``most`` rows, with a line that tells how many more there are."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    rows = F.coalesce(cells["rows"], F.array().cast("array<array<string>>"))
    rule = line(F.transform(cells["columns"], lambda _: F.lit("---")))
    more = F.size(rows) - most
    tail = F.when(more > 0, F.array(F.concat(F.lit("| … ("), more.cast("string"), F.lit(" more rows) |")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(line(cells["columns"]), rule), F.transform(F.slice(rows, 1, most), line), tail), "\n")


def cells_markdown(cells: Column) -> Column:
    """A grid (array of rows of strings) as a piped table: white space made single, empty rows left out, rows as wide as
    the first; empty for a grid without any text."""
    # Each step is made once: what a lambda names is a value, an expression there would be made again for every row.
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    wide = lambda row, n: F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(n - F.size(row), F.lit(0)))), F.lit(1), n)

    def piped(kept: Column, n: Column) -> Column:
        head = F.try_element_at(kept, F.lit(1))
        rule = line(F.array_repeat(F.lit("---"), n))
        body = F.transform(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), lambda row: line(wide(row, n)))
        return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise("")

    clean = F.transform(cells, lambda row: F.transform(row, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    full = F.filter(clean, lambda row: F.exists(row, lambda c: c != ""))
    return once(full, lambda kept: once(F.size(F.try_element_at(kept, F.lit(1))), lambda n: piped(kept, n)))


def table_title(heading: Column, text: Column) -> Column:
    """A caption among the first four lines, at most 160 characters, else the heading."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), r"\n"), 1, 4), lambda x: F.regexp_replace(T.strip(x), r"^\[+|\]+$", ""))
    captions = F.filter(lines, lambda x: x.rlike(r"(?i)^(exhibit|table|figure|appendix)\s*[\w.\-]*\s*[:.\-]?\s*.+"))
    return F.substring(F.coalesce(F.try_element_at(captions, F.lit(1)), T.strip(F.coalesce(heading, F.lit("")))), 1, 160)


def build_store(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, rows) of the chunks that have cells: chunk_id, source, page, document_date, title, cells.

    A table has its year (of the date, else of the source's name) and a blob of words to search; its id is the chunk's.
    """
    full = chunks.where("cells is not null and size(cells.rows) > 0")
    year = F.substring(F.coalesce("document_date", F.lit("")), 1, 4)
    sample = F.substring(F.array_join(F.flatten(F.slice("cells.rows", 1, 3)), " "), 1, 400)
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "source", F.array_join("cells.columns", " "), sample))
    tables = full.select(
        F.col("chunk_id").alias("table_id"),
        "source",
        "page",
        F.when(year == "", F.regexp_extract("source", r"((?:19|20)\d{2})", 1)).otherwise(year).alias("year"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.col("cells.columns").alias("columns"),
        F.size("cells.rows").alias("n_rows"),
        blob.alias("blob"),
    )
    rows = full.select(F.col("chunk_id").alias("table_id"), F.posexplode("cells.rows").alias("idx", "cells"))
    return tables, rows


def signature(title: Column, source: Column, columns: Column) -> Column:
    """What kind of table it is: words of title, file and real columns without years and numbers, and the width."""
    named = F.filter(columns, lambda c: ~F.startswith(c, F.lit("col")))
    base = F.lower(F.concat_ws(" ", title, T.basename(source), F.array_join(named, " ")))
    words = F.regexp_extract_all(base, F.lit(r"[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in SIGNATURE_STOP])
    words = F.filter(words, lambda w: ~w.rlike(r"^\d+$") & ~w.rlike(r"^(?:19|20)\d{2}") & ~F.array_contains(stop, w))
    return F.array_sort(F.array_distinct(F.concat(words, F.array(F.concat(F.lit("w"), F.size(columns).cast("string"))))))


def table_families(tables: DataFrame, least: float = FAMILY_JACCARD) -> DataFrame:
    """(table_id, family, confidence): tables of one kind over years and documents.

    In order of id, a table joins the family that its signature is most like, from ``least`` on; the family's
    signature then grows by it. Tables of different widths never meet, and equal signatures are taken once, so what
    one task clusters are the distinct signatures of one width.
    """
    rows = tables.select("table_id", signature(F.col("title"), F.col("source"), F.col("columns")).alias("sig"), F.size("columns").alias("width"))
    kinds = rows.groupBy("width", "sig").agg(F.min("table_id").alias("first"), F.count("*").alias("n"))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        families: list[dict] = []
        for first, sig, n in frame.sort_values("first")[["first", "sig", "n"]].itertuples(index=False):
            mine = set(sig)
            best, at = None, 0.0
            for f in families:
                j = len(mine & f["sig"]) / max(1, len(mine | f["sig"]))
                if j > at:
                    best, at = f, j
            if best is None or at < least:
                key = "_".join(sorted(w for w in mine if not re.fullmatch(r"w\d+", w)))[:60]
                best, at = {"key": f"family_{key}_w{frame['width'].iloc[0]}", "sig": set(), "members": [], "sum": 0.0, "n": 0}, 1.0
                families.append(best)
            best["sig"] |= mine
            best["members"].append((first, list(sig)))
            best["sum"] += at * n
            best["n"] += n
        out = [(s, f["key"], round(f["sum"] / f["n"], 3)) for f in families for _, s in f["members"]]
        return pd.DataFrame({"width": frame["width"].iloc[0], "sig": [x[0] for x in out], "family": [x[1] for x in out], "confidence": [x[2] for x in out]})

    named = kinds.groupBy("width").applyInPandas(cluster, "width int, sig array<string>, family string, confidence double")
    return rows.join(named, ["width", "sig"]).select("table_id", "family", "confidence")


def family_catalog(tables: DataFrame, families: DataFrame) -> DataFrame:
    """(family, n_tables, years, confidence), largest first."""
    rows = tables.join(families, "table_id")
    years = F.array_join(F.array_sort(F.collect_set(F.when(F.col("year") != "", F.col("year")))), ",")
    out = rows.groupBy("family").agg(F.count("*").alias("n_tables"), years.alias("years"), F.max("confidence").alias("confidence"))
    return out.orderBy(F.desc("n_tables"), "family")


def family_summary(tables: DataFrame, families: DataFrame) -> DataFrame:
    """(table_id, family, n_tables, years) of every table; one that no family has yet stands alone with n_tables null."""
    catalog = family_catalog(tables, families).select("family", "n_tables", "years")
    return tables.select("table_id").join(families.select("table_id", "family"), "table_id", "left").join(catalog, "family", "left").select("table_id", "family", "n_tables", "years")


def unnamed_families(tables: DataFrame, families: DataFrame, names: DataFrame) -> DataFrame:
    """(family, n_tables, years) of families that have no name yet in ``names`` (family, name), the largest first."""
    named = names.where(F.coalesce("name", F.lit("")) != "").select("family")
    return family_catalog(tables, families).join(named, "family", "left_anti").select("family", "n_tables", "years").orderBy(F.desc("n_tables"), "family")


def name_families(tables: DataFrame, families: DataFrame, names: DataFrame, service: str, most: int = 3, samples: int = 3) -> DataFrame:
    """(family, name, summary) of the largest unnamed families, as a chat service describes them from the titles of some
    of their tables; replies without a name are left out, so that they are asked for again."""
    wanted = unnamed_families(tables, families, names).limit(most)
    order = Window.partitionBy("family").orderBy("table_id")
    shown = tables.join(families, "table_id").join(wanted.select("family"), "family", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("title", F.lit("")).alias("title")))), lambda x: x["title"]), "\n")
    rows = shown.groupBy("family").agg(titles.alias("titles"))
    prompt = F.concat(F.lit("Describe this family of tables. Reply with JSON only: name, summary.\n"), F.col("titles"))
    reply = services.apply("chat", prompt, service)
    got = rows.select("family", reply.alias("reply")).select("family", F.from_json(F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)\{.*\}", 0), "name string, summary string").alias("g"))
    return got.select("family", "g.name", "g.summary").where("trim(name) <> ''")


def find_tables(tables: DataFrame, question: str, families: DataFrame | None = None, k: int = 4) -> DataFrame:
    """Best ``k`` tables of a question by shared words, plus 2 for its year and minus 1 for another; with families, up to 3 of other years."""
    words = F.array_distinct(T.content_tokens(F.lit(question)))
    year = re.search(r"(?:19|20)\d{2}", question)
    y = F.lit(year[0] if year else "")
    shared = F.size(F.array_intersect(words, F.regexp_extract_all("blob", F.lit(r"[a-z0-9]+"), F.lit(0))))
    score = shared + F.when((y != "") & (F.col("year") == y), 2).when((y != "") & (F.col("year") != ""), -1).otherwise(0)
    ranked = tables.withColumn("score", score).where(shared > 0)
    best = ranked.orderBy(F.desc("score"), "table_id").limit(k)
    if families is None:
        return best
    lead = best.orderBy(F.desc("score"), "table_id").limit(1).join(families, "table_id").select("family")
    kin = tables.join(families.join(lead, "family", "left_semi"), "table_id").join(best.select("table_id"), "table_id", "left_anti")
    kin = kin.where("year <> ''").join(best.select("year"), "year", "left_anti")
    one = Window.partitionBy("year").orderBy(F.desc("n_rows"), "table_id")
    kin = kin.withColumn("r", F.row_number().over(one)).where("r = 1").orderBy(F.desc("n_rows"), "table_id").limit(3)
    return best.unionByName(kin.withColumn("score", F.lit(0)).select(*best.columns))


def row_keys(question: str, most: int = 6) -> list[list[str]]:
    """Words that name a row: quoted phrases, runs of capitalised words, long numbers; the longest first."""
    phrases = re.findall(r"[\"']([^\"']{3,60})[\"']", question)
    phrases += re.findall(r"\b([A-Z][A-Za-z&'.\-]+(?:\s+[A-Z][A-Za-z&'.\-]+){0,5})\b", question)
    phrases += re.findall(r"\b\d{6,}\b", question)
    keys: list[list[str]] = []
    for phrase in phrases:
        words = [w for w in re.findall(r"[A-Z0-9]{2,}", phrase.upper()) if w not in ROW_STOP]
        if words and words not in keys and (len(words) > 1 or len(words[0]) >= 4):
            keys.append(words)
    return sorted(keys, key=len, reverse=True)[:most]


def find_rows(tables: DataFrame, rows: DataFrame, keys: DataFrame, common: int = 60) -> DataFrame:
    """(query_id, table_id, row_text, score): for each table and query the first row with all words of a key.

    ``keys`` are (query_id, key array, year or empty). Words of cells with a letter are matched by equality first,
    then the words must all be in the row. A key of one word counts only if at most ``common`` tables have it. The
    score grows with the key's length and with a year that fits the table's source or date.
    """
    wanted = keys.withColumn("key_id", F.xxhash64("query_id", "key", "year"))
    cells = rows.select("table_id", "idx", F.explode("cells").alias("cell")).where(F.col("cell").rlike(r"\p{L}"))
    words = cells.select("table_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("cell"), F.lit(r"[A-Z0-9]{2,}"), F.lit(0)))).alias("word")).distinct()
    asked = wanted.select("key_id", "query_id", F.size("key").alias("n"), F.explode("key").alias("word"))
    met = words.join(asked, "word").groupBy("key_id", "query_id", "table_id", "n").agg(F.count_distinct("word").alias("got")).where("got = n")
    spread = F.count("*").over(Window.partitionBy("key_id", "query_id"))
    met = met.withColumn("spread", spread).where(f"n > 1 or spread <= {common}")
    joined = F.array_join("cells", " | ")
    hit = met.join(wanted.select("key_id", "key", "year"), "key_id").join(rows, "table_id")
    hit = hit.withColumn("row_text", joined).where(F.forall("key", lambda w: F.contains(F.upper("row_text"), w)))
    first = Window.partitionBy("query_id", "table_id").orderBy(F.desc("n"), "key_id", "idx")
    hit = hit.withColumn("r", F.row_number().over(first)).where("r = 1").join(tables.select("table_id", F.concat_ws(" ", "source", "year").alias("where")), "table_id")
    score = 0.86 + 0.02 * F.least(F.col("n"), F.lit(4)) + F.when(F.col("year") == "", 0.0).when(F.contains("where", F.col("year")), 0.04).otherwise(-0.03)
    return hit.select("query_id", "table_id", "row_text", F.round(F.least(score, F.lit(0.98)), 3).alias("score"))


def expand_tables(hits: DataFrame, chunks: DataFrame, most: int = 12) -> DataFrame:
    """Other table chunks of the same document and page as a hit on a table: at most ``most`` for each query.

    hits: query_id, chunk_id, eval_score; chunks: chunk_id, corpus, document_id, page, content_type. The siblings'
    score is the smallest of the query's table hits.
    """
    tables = chunks.where("content_type = 'table'").select("chunk_id", "corpus", "document_id", F.coalesce("page", F.lit(-1)).alias("page"))
    mine = hits.join(tables, "chunk_id")
    low = mine.groupBy("query_id").agg(F.min("eval_score").alias("eval_score"))
    places = mine.select("query_id", "corpus", "document_id", "page").distinct()
    kin = places.join(tables, ["corpus", "document_id", "page"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("corpus", "document_id", "page", "chunk_id")
    kin = kin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return kin.join(low, "query_id").select("query_id", "chunk_id", "eval_score")


def is_safe_select(sql: str) -> bool:
    """Whether a statement is one SELECT without any word that writes, anywhere in it."""
    low = sql.strip().lower()
    return low.startswith("select") and ";" not in low.rstrip(";") and not any(re.search(rf"\b{w}\b", low) for w in WRITE_WORDS)


def run_select(spark: SparkSession, sql: str, tables: DataFrame, rows: DataFrame, ids: list, most: int = 30) -> DataFrame | None:
    """Result of a SELECT over candidate tables as t1, t2, ...: text columns c1.., source, page, year. None if it is not allowed or fails to analyse.

    ``ids`` are the candidates, a handful. Views live in a session of their own, whose other tables it cannot see.
    """
    if not is_safe_select(sql):
        return None
    own, made = spark.newSession(), []
    for i, table_id in enumerate(ids, 1):
        meta = tables.where(F.col("table_id") == table_id).select("source", "page", "year", F.size("columns").alias("w")).first()
        if meta is None:
            return None
        mine = rows.where(F.col("table_id") == table_id)
        mine = mine.select(*[F.coalesce(F.try_element_at("cells", F.lit(j + 1)), F.lit("")).alias(f"c{j + 1}") for j in range(meta["w"])], F.lit(meta["source"]).alias("source"), F.lit(meta["page"]).alias("page"), F.lit(meta["year"]).alias("year"))
        name = f"docgrain_{uuid.uuid4().hex}"
        mine.createOrReplaceGlobalTempView(name)
        made.append(name)
        own.sql(f"create temporary view t{i} as select * from global_temp.{name}")
    try:
        return own.sql(sql.rstrip().rstrip(";")).limit(most)
    except Exception as e:  # an analysis error is an answer: no result
        if "AnalysisException" in type(e).__name__ or "ParseException" in type(e).__name__:
            return None
        raise
    finally:  # the result's plan has taken them in
        for name in made:
            spark.catalog.dropGlobalTempView(name)
