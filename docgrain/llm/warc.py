"""WARC archives, compressed record by record with a Zstandard dictionary that the archive carries.

An archive is a skippable frame (magic 0x184D2A5D) with a dictionary built from its own first records, then one
Zstandard frame for each WARC record, the first of which describes the archive. Where the first records are too few
to train on, the dictionary is their raw content. Records with equal payloads are written once; the others revisit that one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.llm.shared import materialise, new_path

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"

#: What an archive's dictionary is built from: records are held until there are so many, with so many bytes of which
#: each gives RECORD_SAMPLE at most, or until HELD_BYTES are held.
SAMPLE_RECORDS, SAMPLE_BYTES, RECORD_SAMPLE, HELD_BYTES = 16, 1 << 20, 1 << 17, 1 << 26
DICTIONARY_BYTES = 1 << 15
#: Size at which a task begins its next archive.
ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1, in capitals."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str) -> str:
    """A URL as a header's value: control characters, spaces and angle brackets are percent-encoded."""
    return re.sub(r"[\x00-\x20<>\x7f-\x9f\ud800-\udfff]", lambda m: urllib.parse.quote(m[0], safe="", errors="replace"), text)


def _record(kind: str, name: str, headers: dict[str, str], block: bytes, date: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers.items()]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str, date: str = DATE) -> bytes:
    """The record that begins an archive."""
    fields = b"format: WARC File Format 1.1\r\nsoftware: docgrain\r\n"
    return _record("warcinfo", f"{URN}{name}", {"Content-Type": "application/warc-fields"}, fields, date)


def page_record(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response record, or a revisit record, whose block is the HTTP header alone.

    ``name`` is unique among all records, as ids of pages need not be; pages are named by fields of their own.
    """
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if url is not None:
        headers["WARC-Target-URI"] = _uri(url)
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if not revisit:
        return _record("response", f"{URN}{name}", headers, http + payload, date)
    headers |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page": "" if refers_to is None else str(refers_to)}
    return _record("revisit", f"{URN}{name}", headers, http, date)


class ArchiveWriter:
    """Writes records to one archive; the file has its name only once it is complete."""

    def __init__(self, uri: str, attempt: str):
        self.fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.path, self.hidden = path, f"{path}.{attempt}.tmp"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.hidden, compression=None)
        self.held: list[bytes] | None = []
        self.sample_bytes = self.held_bytes = self.raw = self.records = self.written = 0
        self.compressor: zstandard.ZstdCompressor | None = None
        self.name = path.rpartition("/")[2].partition(".")[0]
        self.add(info_record(self.name))
        self.records = 0  # of pages

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw += len(record)
        if self.held is None:
            self._put(self.compressor.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        self.sample_bytes += min(len(record), RECORD_SAMPLE)
        if (len(self.held) >= SAMPLE_RECORDS and self.sample_bytes >= SAMPLE_BYTES) or self.held_bytes >= HELD_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        """Builds the dictionary from the records held and writes them."""
        samples = [r[:RECORD_SAMPLE] for r in self.held]
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=3)
        except zstandard.ZstdError:  # too few or too small
            dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = dictionary.as_bytes()
        self._put(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        held, self.held = self.held, None
        for record in held:
            self._put(self.compressor.compress(record))

    def close(self) -> tuple[str, int, int]:
        if self.held is not None:
            self._begin()
        self.out.close()
        if self.fs.get_file_info(self.path).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an earlier attempt of the same task, with the same records
        self.fs.move(self.hidden, self.path)
        return self.path, self.records, self.written


def read_frames(stream) -> Iterator[bytes]:
    """The records of an archive, read piece by piece."""
    data = stream.read(8)
    decompressor = zstandard.ZstdDecompressor()
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:])[0]
        dictionary = stream.read(size)
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # a compressed dictionary
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        data = b""
    while data or (data := stream.read(READ_BYTES)):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(READ_BYTES)):
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """Type, ids, URL, payload and its digest and size; the digest of a response is computed anew and compared."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    bare = lambda v: int(v) if v else None
    out = {"record_type": kind, "page_id": None, "url": fields.get("warc-target-uri"), "payload": None, "payload_digest": None, "payload_bytes": 0, "refers_to": None}
    if kind in ("response", "revisit"):
        out |= {"page_id": bare(fields.get("x-page-id")), "refers_to": bare(fields.get("x-refers-to-page")), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
        out["payload_bytes"] = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        if kind == "response":
            out["payload"] = payload
            if digest_of(payload) != out["payload_digest"] or len(payload) != out["payload_bytes"]:
                raise ValueError(f"the payload of {fields['warc-record-id']} does not fit its digest")
    return out


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, revisit, refers_to): which rows are responses and which revisit another row.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the largest id are responses and the
    others revisit it. Null payloads are empty. Rows that repeat the largest id are all responses; a null id never
    is the largest, and a group without any id has responses only.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1 and last is not null").select("digest", "last"), "payloads")
    joined = rows.join(groups, "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(records: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records below the URI ``out``; (path, records, bytes) of each archive, materialised.

    A task sorts its records, so that a repeated attempt writes the same bytes, and renames complete files only.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k, archive = TaskContext.get(), 0, None
        done = []
        for batch in batches:
            for page_id, url, html, revisit, ref in batch[["page_id", "url", "html", "revisit", "refers_to"]].itertuples(index=False):
                if archive is None:
                    archive = ArchiveWriter(f"{out}/part-{task.partitionId():05d}-{k:04d}.warc.zst", str(task.taskAttemptId()))
                archive.add(page_record(f"{archive.name}:{archive.records}", None if page_id is None else int(page_id), url, html.encode("utf-8", "surrogatepass"), None if ref is None else int(ref), bool(revisit)))
                if archive.written >= archive_bytes:
                    done.append(archive.close())
                    archive, k = None, k + 1
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    ordered = records.sortWithinPartitions("page_id", "url", F.sha2("html", 256), "revisit")
    # Ids as text: pandas has no whole numbers beside nulls.
    ordered = ordered.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(ordered.mapInPandas(write, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """The page records of the archives that ``archives`` lists by path: one row each, payload only on request."""
    types = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in types.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    size = 0
                    for record in read_frames(stream):
                        row = parse_record(record)
                        if row["record_type"] not in ("response", "revisit"):
                            continue
                        rows.append([row[n] for n in names])
                        size += len(record) * payloads
                        if len(rows) >= 5000 or size >= 1 << 24:
                            yield _frame(rows, names)
                            rows, size = [], 0
                yield _frame(rows, names)

    count = max(1, archives.count())
    return archives.select("path").repartitionByRange(count, "path").mapInPandas(read, types)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({n: "Int64" for n in names if n in ("page_id", "payload_bytes", "refers_to")})


def archive_pages(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Write all pages to archives below ``out`` (default: a fresh path in the shared folder) and read them back.

    An empty table writes no archive and gives no row. Extra columns are not archived.
    """
    spark = pages.sparkSession
    root = out or new_path(spark, "warc")
    root = root if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) else f"file://{root}"
    root = re.sub(r"^file:/+", "file:///", root)
    return read_archives(spark, write_archives(plan_records(pages, **options), root), root)
