"""Files and tables: reading documents by extension, routing, JSON lines, and the sinks."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.sources.html import html_text

TEXT = ("txt", "md", "markdown")
HTML = ("html", "htm")
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp")
#: Parsers of binary formats: bytes to page texts. None is installed here; callers register theirs.
PARSERS: dict[str, Callable[[bytes], list[str]]] = {}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_documents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(document_id, source_name, file_hash, page, text) of all supported files below ``root``, hidden ones left out.

    Texts and HTML are one page, numbered 1. Other formats need a parser in PARSERS; a file of another kind is an error
    when it is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rows = raw.where(~F.col("path").rlike(r"/\.[^/]*(/|$)")).select("path", F.md5("content").alias("file_hash"), extension(F.col("path")).alias("ext"), "content")
    name = F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    decoded = F.decode("content", "UTF-8")
    simple = rows.where(F.col("ext").isin(*TEXT, *HTML)).select("path", "file_hash", F.lit(1).alias("page"), F.when(F.col("ext").isin(*HTML), html_text(decoded)).otherwise(decoded).alias("text"))
    parsers = dict(PARSERS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, digest, ext, content in batch[["path", "file_hash", "ext", "content"]].itertuples(index=False):
                if ext not in parsers:
                    raise ValueError(f"no parser for .{ext}: {path}")
                pages = parsers[ext](content)
                yield pd.DataFrame({"path": path, "file_hash": digest, "page": range(1, len(pages) + 1), "text": pages})

    other = rows.where(~F.col("ext").isin(*TEXT, *HTML)).mapInPandas(parse, "path string, file_hash string, page int, text string")
    out = simple.unionByName(other).withColumn("source_name", name)
    return out.select(T.document_id(F.col("source_name")).alias("document_id"), "source_name", "file_hash", "page", "text")


def route(source: Column) -> Column:
    """Struct (kind, corpus) of a source: sitemap, url, pdf, image, html, text, dir or unknown."""
    ext = extension(F.regexp_replace(source, r"[?#].*$", ""))
    remote = source.rlike(r"^https?://")
    kind = (
        F.when(remote & F.lower(source).rlike(r"sitemap[^/]*\.xml"), "sitemap")
        .when(remote & (ext != "pdf"), "url")
        .when(ext == "pdf", "pdf")
        .when(ext.isin(*IMAGES), "image")
        .when(ext.isin(*HTML), "html")
        .when(ext.isin(*TEXT), "text")
        .when(source.endswith("/"), "dir")
        .otherwise("unknown")
    )
    corpus = F.when(kind.isin("sitemap", "url", "html"), "web").when(kind == "image", "visual").otherwise("pdf")
    return F.struct(kind.alias("kind"), corpus.alias("corpus"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; unknown fields are dropped and blank lines skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_version(df: DataFrame, root: str, expected: int | None = None) -> int:
    """Write ``df`` as the next version of a table below ``root`` and return its number.

    With ``expected``, the newest version must still be that one: a writer that read an older table is refused.
    A version counts once it is complete, so readers never see half of one.
    """
    spark = df.sparkSession
    newest = latest_version(spark, root)
    if expected is not None and newest != expected:
        raise RuntimeError(f"{root} is at version {newest}, not {expected}: read it again")
    df.write.parquet(f"{root}/v{newest + 1:08d}")
    return newest + 1


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the newest complete version; 0 if there is none."""
    return max(versions(spark, root), default=0)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table, the newest by default. Older ones stay readable: they are its backups."""
    version = version or latest_version(spark, root)
    if not version:
        raise FileNotFoundError(f"no version below {root}")
    return spark.read.parquet(f"{root}/v{version:08d}")


def restore_version(spark: SparkSession, root: str, version: int) -> int:
    """Write an older version of a table again as the newest, so that nothing is lost, and return its number."""
    return write_version(read_version(spark, root, version), root)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions of a table, newest first: its backups."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if blob_exists(spark, f"{root}/{s.getPath().getName()}/_SUCCESS")]
    return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n))), reverse=True)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put_blob(spark: SparkSession, path: str, content: bytes) -> str:
    """Write one small object whole, or not at all, in the place of what was there."""
    fs, target = _file_system(spark, path)
    _, half = _file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(half)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(half, target):
        raise OSError(f"cannot write {path}")
    return path


def get_blob(spark: SparkSession, path: str) -> bytes:
    """What :func:`put_blob` wrote."""
    fs, place = _file_system(spark, path)
    source = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def blob_exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def save_seed(spark: SparkSession, root: str, name: str, note: str = "") -> dict:
    """Give the newest version of a table a name, under which it can be restored; a name that is used already moves."""
    seed = {"name": _plain_name(name), "version": latest_version(spark, root), "note": note}
    if not seed["version"]:
        raise FileNotFoundError(f"no version below {root}")
    put_blob(spark, f"{root}/seeds/{seed['name']}.json", json.dumps(seed).encode())
    return seed


def seeds(spark: SparkSession, root: str) -> list[dict]:
    """The named versions of a table, by name."""
    fs, place = _file_system(spark, f"{root}/seeds")
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    return [json.loads(get_blob(spark, f"{root}/seeds/{n}")) for n in names if re.fullmatch(r"[^.].*\.json", n)]


def restore_seed(spark: SparkSession, root: str, name: str) -> int:
    """Write a named version again as the newest."""
    return restore_version(spark, root, json.loads(get_blob(spark, f"{root}/seeds/{_plain_name(name)}.json"))["version"])


def _plain_name(name: str) -> str:
    """A name without folders or leading dots."""
    plain = re.sub(r"[^A-Za-z0-9._-]+", "_", name.replace("\\", "/").rsplit("/", 1)[-1]).lstrip(".")
    if not plain:
        raise ValueError(f"not a name: {name!r}")
    return plain


def decode_uploads(uploads: DataFrame) -> DataFrame:
    """(name, content, error) of uploads (name, content in base64): names without folders; what cannot be read is an error, not a failure."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce("name", F.lit("")), r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]+", "_"), r"^\.+", "")
    content = F.try_to_binary(F.regexp_replace("content", r"\s+", ""), F.lit("base64"))
    error = F.when(plain == "", "no name").when(content.isNull(), "not base64")
    return uploads.select(plain.alias("name"), F.when(error.isNull(), content).alias("content"), error.alias("error"))


def stage_uploads(spark: SparkSession, uploads: DataFrame, folder: str) -> list[dict]:
    """Write the files of one upload request below ``folder``, one at a time, and return name, path and error of each."""
    out = []
    for row in decode_uploads(uploads).toLocalIterator():
        path = None if row["error"] else put_blob(spark, f"{folder}/{row['name']}", bytes(row["content"]))
        out.append({"name": row["name"], "path": path, "error": row["error"]})
    return out


def point_get(chunks: DataFrame, ids: list) -> DataFrame:
    """The chunks of some ids; the filter reaches the scan."""
    return chunks.where(F.col("chunk_id").isin(ids))


def resolve_sources(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(name, path) of wanted names: the file of that relative path, else the first by path with that base name, else null.

    known: relative_path, path.
    """
    exact = known.groupBy(F.col("relative_path").alias("name")).agg(F.min("path").alias("__exact"))
    loose = known.groupBy(T.basename(F.col("path")).alias("__base")).agg(F.min("path").alias("__loose"))
    rows = wanted.select("name").distinct().join(exact, "name", "left").withColumn("__base", T.basename(F.col("name"))).join(loose, "__base", "left")
    return rows.select("name", F.coalesce("__exact", "__loose").alias("path"))
