"""A kept BM25 index: postings on storage, in buckets of terms, brought up to date from the documents that have changed.

An index is a folder of segments. Each holds postings (term, id, tf, dl) in folders by a hash of the term, sorted by
term, and a log of documents (id, print, dl; a null print is a deletion). A later segment overrules what earlier ones
say of the same document. A versioned table of its own lists the live segments with the corpus's size and version; a
segment counts from the moment that this list names it, so readers never see half an update and a writer that read an
older list is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.functions import vectors
from docgrain.operators import search
from docgrain.session import dealt, materialise
from docgrain.sources import files

#: Folders that the terms of a segment are dealt to.
BUCKETS = 32
#: Parts that a bucket is written in at least, by document, so that a frequent term is not one task's work.
SPREAD = 8
#: Postings that a task sorts and writes, about; bounds its memory.
POSTINGS = 1_000_000
#: Texts whose terms are in memory at once.
SLICE = 1024
#: Live segments after which :func:`refresh` puts them together.
SEGMENTS = 8


@dataclass(frozen=True)
class State:
    """What the newest list of segments says."""

    number: int  # of the list
    segments: list[int]
    n_docs: int
    total_dl: int
    corpus: str
    buckets: int
    id_type: str


def corpus_version(table: DataFrame) -> str:
    """A mark of a table of files that changes when a file comes, goes or is written again; no column is read."""
    m = F.col("_metadata")
    each = table.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct()
    row = each.agg(F.count("*").alias("n"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def state(spark: SparkSession, root: str) -> State | None:
    """The state of the index below ``root``, None where there is none."""
    number = files.latest_version(spark, f"{root}/lists")
    if not number:
        return None
    row = files.read_version(spark, f"{root}/lists", number).first()
    return State(number, list(row["segments"]), row["n_docs"], row["total_dl"], row["corpus"], row["buckets"], row["id_type"])


def is_stale(spark: SparkSession, root: str, version: str) -> bool:
    """Whether the index was made of another version of the corpus, or is not there."""
    now = state(spark, root)
    return now is None or now.corpus != version


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, now: State, kind: str, segments: list[int] | None = None) -> DataFrame:
    schema = {"postings": f"term string, id {now.id_type}, dl int, tf long, bucket int", "docs": f"id {now.id_type}, print long, dl int"}[kind]
    parts = [spark.read.schema(schema).parquet(f"{root}/segments/{n}/{kind}").withColumn("segment", F.lit(n)) for n in segments or now.segments]
    return reduce(DataFrame.unionByName, parts)


def _current(spark: SparkSession, root: str, now: State) -> DataFrame:
    """(id, print, dl) of the documents in the index."""
    log = _read(spark, root, now, "docs")
    last = log.groupBy("id").agg(F.max_by(F.struct("print", "dl"), "segment").alias("d"))
    return last.select("id", "d.print", "d.dl").where("print is not null")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, held, docs) of (id, print, text): a row for each term of SLICE texts with its postings, and one, without a term, for the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            words = [vectors.content_words(text) for text in part.column("text").to_pylist()]
            dl = np.array([len(w) for w in words], np.int32)
            number: dict[str, int] = {}
            terms = np.fromiter((number.setdefault(w, len(number)) for each in words for w in each), np.int64, dl.sum())
            key, tf = np.unique(terms * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
            term, row = np.divmod(key, len(dl))
            ends = np.searchsorted(term, np.arange(len(number) + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([part.column("id").take(pa.array(row)), pa.array(dl[row]), pa.array(tf.astype(np.int64))], ["id", "dl", "tf"]))
            docs = pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), pa.StructArray.from_arrays([part.column("id"), part.column("print"), pa.array(dl)], ["id", "print", "dl"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), held, pa.nulls(len(number), docs.type)], ["term", "held", "docs"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, held.type), docs], ["term", "held", "docs"])


def _parts(n: int, least: int, buckets: int) -> tuple[int, int]:
    """Tasks that write ``n`` postings, and parts of a bucket: enough that tasks are even."""
    tasks = max(least, -(-n // POSTINGS))
    return tasks, max(SPREAD, -(-4 * tasks // buckets))


def _write(spark: SparkSession, root: str, number: int, postings: DataFrame, docs: DataFrame, buckets: int, n: int) -> None:
    """A segment of ``n`` postings, (term, held); one that an interrupted update has left is overwritten.

    Arrays of postings are shuffled and sorted, not each posting. The writer sorts rows by bucket, which keeps the terms'
    order as far as its memory goes; results do not need it.
    """
    kept = postings.withColumn("bucket", _bucket(F.col("term"), buckets))
    tasks, spread = _parts(n, int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    kept = kept.repartition(tasks, "bucket", F.pmod(F.xxhash64(F.col("held")[0]["id"]), F.lit(spread))).sortWithinPartitions("bucket", "term", F.col("held")[0]["id"])
    kept.select("term", F.inline("held"), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/segments/{number}/postings")
    docs.write.mode("overwrite").parquet(f"{root}/segments/{number}/docs")


def _commit(spark: SparkSession, root: str, before: State | None, segments: list[int], *rest) -> State:
    row = spark.createDataFrame([(segments, *rest)], "segments array<int>, n_docs long, total_dl long, corpus string, buckets int, id_type string")
    number = files.write_version(row.coalesce(1), f"{root}/lists", before.number if before else 0)
    return State(number, segments, *rest)


def update(chunks: DataFrame, root: str, version: str, id_col: str = "chunk_id", text_col: str = "text", buckets: int = BUCKETS) -> State:
    """Bring the index below ``root`` to ``chunks``, the corpus of this ``version``; without an index, build it.

    Documents are known by id and compared by a 64-bit hash of their text, so that only hashes are joined; texts are
    read again, and tokenised, of new and changed documents alone. Documents that are gone are deleted. A null text is
    an empty document; rows without an id are left out; of rows with one id, that with the smallest hash counts. Texts
    are shuffled only where ids repeat or too many documents of a kept index have changed to be broadcast.
    """
    spark = chunks.sparkSession
    before = state(spark, root)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = chunks.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("print")).where("id is not null")
    number, buckets = (max(before.segments) + 1, before.buckets) if before else (1, buckets)
    new = rows.groupBy("id").agg(F.min("print").alias("print"), F.count("*").alias("rows"))
    if before is None:
        changed = new.select("id", "print", "rows", F.lit(None).cast("long").alias("was"), F.lit(None).cast("int").alias("was_dl"))
    else:
        old = _current(spark, root, before).select("id", F.col("print").alias("was"), F.col("dl").alias("was_dl"))
        changed = new.join(old, "id", "full_outer").where(~F.col("print").eqNullSafe(F.col("was")))
    changed = materialise(changed, "changed")
    fresh = changed.where("print is not null").select("id", "print")
    repeat = not changed.where("rows > 1").isEmpty()
    mine = rows.join(fresh, ["id", "print"], "left_semi") if before or repeat else rows
    if repeat:  # of rows with equal id and hash one is enough
        mine = mine.dropDuplicates(["id", "print"])
    kind = rows.schema["id"].dataType.simpleString()
    words = mine.select("id", "print", "text").mapInArrow(_counted, f"term string, held array<struct<id:{kind},dl:int,tf:bigint>>, docs array<struct<id:{kind},print:bigint,dl:int>>")
    words = materialise(words, "words")
    sized = words.where("term is null").select(F.inline("docs"))
    gone = changed.where("print is null").select("id", "print", F.lit(None).cast("int").alias("dl"))
    tf = words.where("term is not null").select("term", "held")
    n = tf.agg(F.coalesce(F.sum(F.size("held")), F.lit(0))).first()[0]
    _write(spark, root, number, tf, sized.unionByName(gone), buckets, n)
    sums = changed.agg(F.count("print").alias("now"), F.count("was").alias("was"), F.coalesce(F.sum("was_dl"), F.lit(0)).alias("dl")).first()
    added = sized.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    n_docs = (before.n_docs if before else 0) + sums["now"] - sums["was"]
    total = (before.total_dl if before else 0) + added - sums["dl"]
    return _commit(spark, root, before, [*(before.segments if before else []), number], n_docs, total, version, buckets, kind)


def _live(spark: SparkSession, root: str, now: State, postings: DataFrame) -> DataFrame:
    """Postings (with their segment) that no later segment overrules."""
    if len(now.segments) == 1:
        return postings
    later = _read(spark, root, now, "docs", now.segments[1:]).groupBy("id").agg(F.max("segment").alias("last"))
    return postings.join(later, "id", "left").where("last is null or segment >= last").drop("last")


def compact(spark: SparkSession, root: str) -> State:
    """Put all live segments together into one; the old ones stay for readers of older lists."""
    now = state(spark, root)
    number = max(now.segments) + 1
    postings = _live(spark, root, now, _read(spark, root, now, "postings")).select("term", F.array(F.struct("id", "dl", "tf")).alias("held"))
    n = _read(spark, root, now, "postings").count()
    _write(spark, root, number, postings, _current(spark, root, now), now.buckets, n)
    return _commit(spark, root, now, [number], now.n_docs, now.total_dl, now.corpus, now.buckets, now.id_type)


def refresh(chunks: DataFrame, root: str, version: str, **names) -> State:
    """The index of this version of the corpus: as it is if it is of that version, else brought up to date."""
    spark = chunks.sparkSession
    now = state(spark, root)
    if now is None or now.corpus != version:
        now = update(chunks, root, version, **names)
    return compact(spark, root) if len(now.segments) > SEGMENTS else now


def postings_of(spark: SparkSession, root: str, now: State, terms: DataFrame) -> DataFrame:
    """Live postings of the terms in the only column of ``terms``.

    Up to ``search.LITERAL_TERMS`` terms are part of the plan: only their buckets are listed and read, and of these
    only the row groups that may hold them.
    """
    rows = _read(spark, root, now, "postings")
    if terms.limit(search.LITERAL_TERMS + 1).count() <= search.LITERAL_TERMS:
        known = terms.select(F.col(terms.columns[0]).alias("term"), _bucket(F.col(terms.columns[0]), now.buckets).alias("bucket")).collect()
        rows = rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in known})) & F.col("term").isin([r["term"] for r in known]))
    else:
        rows = rows.join(terms.toDF("term"), "term", "left_semi")
    return _live(spark, root, now, rows.select("term", "id", "tf", "dl", "segment"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in the order of ``id``, cut anew where a document ends."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        ids = part.column("id").to_numpy(zero_copy_only=False)
        cut = int(np.argmax(ids == ids[-1]))
        if cut:
            yield part.slice(0, cut)
        rest = part.slice(cut)
    if rest is not None:
        yield rest


def _scored(tf: DataFrame, pairs: list, kind: pa.DataType, k: int, average: float, schema: str) -> DataFrame:
    """(q, id, raw): scores of postings for few ``pairs`` (q, term, idf, df), each task's best ``k`` of a query.

    Postings are dealt by document and sorted, so that a task sums a document's scores for all queries at once; what is
    shuffled are postings and then k rows a query and task, not a row for each query, term and document.
    """
    queries, terms = ({v: i for i, v in enumerate(dict.fromkeys(r[c] for r in pairs))} for c in ("q", "term"))
    order = sorted(pairs, key=lambda r: terms[r["term"]])
    starts = np.searchsorted([terms[r["term"]] for r in order], np.arange(len(terms) + 1))
    place, weight = np.array([queries[r["q"]] for r in order], np.int64), np.array([r["idf"] for r in order], np.float64)
    names, n = pa.array(list(queries), kind), len(queries)
    docs, limit = max(1, (1 << 19) // max(n, 1)), max(k * n, 1 << 17)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size, least = None, [], 0, np.full(n, -np.inf)
        for part in _whole(batches):
            ids, number, f, dl = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "number", "tf", "dl"))
            new = np.append(True, ids[1:] != ids[:-1])
            doc, mine = np.cumsum(new) - 1, ids[new]
            share = f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * dl / average))
            for at in range(0, len(mine), docs):
                low, high = np.searchsorted(doc, [at, at + docs])
                times = starts[number[low:high] + 1] - starts[number[low:high]]
                row = np.repeat(np.arange(low, high), times)
                pair = np.arange(len(row)) - np.repeat(np.cumsum(times) - times - starts[number[low:high]], times)
                sums = np.bincount((doc[row] - at) * n + place[pair], weight[pair] * share[row], min(docs, len(mine) - at) * n).reshape(-1, n)
                rounded = np.round(sums, search.PLACES)
                i, j = np.nonzero((sums > 0) & (rounded >= least))
                waiting.append((j, mine[at + i], rounded[i, j], sums[i, j]))
                size += len(i)
                if size >= limit:
                    held, waiting, size = search.kept(waiting + ([held] if held else []), k), [], 0
                    least = search.least_kept(held, k, n)
        if waiting:
            held = search.kept(waiting + ([held] if held else []), k)
        if held:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(held[0])), pa.array(held[1]), pa.array(held[3])], ["q", "id", "raw"])

    spark = tf.sparkSession
    numbers = spark.createDataFrame(list(terms.items()), "term string, number int")
    rows = tf.join(numbers, "term").select("id", "number", "tf", "dl")
    rows = dealt(rows, "id", n=sum({r["term"]: r["df"] for r in pairs}.values()), most=POSTINGS).sortWithinPartitions("id")
    return rows.mapInArrow(best, schema)


def topk(spark: SparkSession, root: str, queries: DataFrame, k: int = 30, id_col: str = "chunk_id", query_id: str = "query_id", query_text: str = "question") -> DataFrame:
    """What :func:`search.bm25_topk` gives for the corpus of the index, from the postings of the queries' terms."""
    now = state(spark, root)
    if now is None:
        raise FileNotFoundError(f"no index below {root}")
    words = queries.select(F.col(query_id).alias("q"), F.explode(T.content_tokens(F.col(query_text))).alias("term"))
    wanted = words.groupBy("q", "term").agg(F.count("*").alias("times"))
    terms = wanted.select("term").distinct()
    few_terms = terms.limit(search.LITERAL_TERMS + 1).count() <= search.LITERAL_TERMS
    tf = postings_of(spark, root, now, terms)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = wanted.join(df, "term").withColumn("idf", search.bm25_idf(F.col("df"), F.lit(now.n_docs)) * F.col("times"))
    average = now.total_dl / now.n_docs if now.n_docs else 1.0
    f, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * (f * (search.K1 + 1)) / (f + search.K1 * (1 - search.B + search.B * dl / F.lit(average)))
    if few_terms and weighted.limit(search.BROADCAST_TERMS + 1).count() <= search.BROADCAST_TERMS:
        pairs = weighted.select("q", "term", "idf", "df").collect()
        kind = wanted.select("q").limit(0).toArrow().schema.field("q").type
        scored = _scored(tf, pairs, kind, k, average, f"q {wanted.schema['q'].dataType.simpleString()}, id {now.id_type}, raw double")
    else:
        scored = tf.join(weighted, "term").groupBy("q", "id").agg(F.sum(part).alias("raw")).where("raw > 0")
    order = Window.partitionBy("q").orderBy(F.desc(F.round("raw", search.PLACES)), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = F.max("raw").over(Window.partitionBy("q"))
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), (F.col("raw") / top).alias("score"), "rank")
