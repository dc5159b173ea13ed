"""URL filters, decontamination and archives."""

import base64
import hashlib
import io
import math
import os
import random
import time

import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F

from docgrain.llm import decontam, queries, shared, urlfilter, warc
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", ["op3_decontamination", "op4_url_filter", "op8_warc"])
def test_query_equals_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf).toPandas(), connect(sf).execute(queries.oracle_sql()[name]).df())


URLS = [
    ("http://a.EXAMPLE.com/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"),
    ("http://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"),
    ("http://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"),
    ("https://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("https://x.net/de/", "x.net", "/de/", "net/de/", "allow"),
    ("https://x.net/de", "x.net", "/de", None, "allow"),
    ("ftp://org/es/a?://b", "org", "/es/a", "org/es/", "block"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("http://x.org?q/es/", "x.org", "", None, "allow"),
    ("http://a..org/es/é" + "y" * 70000, "a..org", "/es/é" + "y" * 70000, "org/es/", "block"),
]


@pytest.mark.parametrize("limit", [urlfilter.BROADCAST_RULES, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("com", "/en/", "block")], "host string, path string, action string")
    rows = [(i, u[0], "r", "v") for i, u in enumerate(URLS)] + [(3, URLS[3][0], "r", "v"), (None, URLS[0][0], "r", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules).collect()), key=str)
    want = [(i, *u[1:]) for i, u in enumerate(URLS)] + [(3, *URLS[3][1:]), (None, *URLS[0][1:])]
    assert got == sorted(want, key=str)
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_hosts_of_many_labels_take_linear_time(spark):
    """Hosts of 100,000 and 400,000 labels: four times the text, at most six times the time."""
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")

    def seconds(labels):
        pages = spark.createDataFrame([(1, "http://" + "a." * labels + "example.com/en/7")], "page_id long, url string")
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            assert [(r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules).collect()] == [("example.com/en/7", "allow")]
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(400_000) < 6 * seconds(100_000)


@pytest.mark.parametrize("limit", [urlfilter.BROADCAST_RULES, 0])
def test_urls_equal_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "", "c"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice("/xy") for _ in range(rng.randint(0, 3)))
    rules = {(host(), "/" + path()): rng.choice(["allow", "block"]) for _ in range(40)}
    urls = [(i, f"http://{host()}/{path()}") for i in range(400)] * 2
    want = []
    for i, url in urls:
        h, _, p = url[7:].partition("/")
        fits = [(len(a + b), len(b), a + b, x) for (a, b), x in rules.items() if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        best = max(fits, default=(0, 0, None, "allow"))
        want.append((i, h, "/" + p, *best[2:]))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    found = urlfilter.judge_urls(pages, spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, action string"))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()), key=str) == sorted(want, key=str)


def test_repeated_words_cost_no_more_than_others():
    """An item of equal words has one window: a hit is one comparison, whatever the item's length."""
    windows = decontam.WindowSet.of([("a", "spam " * 20_000), ("b", "spam " * 20_000), ("c", " ".join(f"w{i}" for i in range(30)))])
    assert sum(len(x[0]) for x in windows.by_length.values()) == 1 + 18
    began = time.perf_counter()
    n, spans, found = windows.scan("spam " * 200_000)
    assert time.perf_counter() - began < 5 and (n, spans.tolist(), found) == (200_000, [[0, 200_000]], {0, 1})


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam, "_hash", lambda ids, starts, size: (ids[starts] % 2).astype("uint64"))
    rng = random.Random(1)
    items = [(str(k), " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for k in range(30)]
    windows = decontam.WindowSet.of(items, 3)
    for _ in range(40):
        text = " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 14)))
        n, spans, found = windows.scan(text)
        assert (n, sum(b - a for a, b in spans.tolist()), sorted(items[k][0] for k in found)) == brute_hits(text, items, 3)


def brute_hits(text, items, n=13):
    words = [w.decode() for w in decontam.words_of(text)]
    hit, found = set(), set()
    for name, item in items:
        mine = [w.decode() for w in decontam.words_of(item)]
        size = min(n, len(mine))
        for s in range(len(mine) - size + 1) if mine else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == mine[s : s + size]:
                    hit.update(range(p, p + size))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    """With the low limit the benchmark is scanned in several blocks, which are merged."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(7)
    vocabulary = "alpha Beta gámma 12 delta".split()
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [("1", say(14)), ("2", say(5)), ("3", "delta"), ("10", say(40)), ("4", ""), ("5", None), ("6", "..."), ("1", say(13))]
    texts = [say(200), f"{say(9)}, {items[0][1].upper()}! {items[3][1].replace(' ', ' -- ')}", "alpha", "", None, "--", say(3), "x " * 60000 + items[3][1]]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, hits string").withColumnRenamed("hits", "n_words")
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id string, text string, doc_id string")
    got = {r["doc_id"]: (r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) for r in decontam.with_hits(docs, bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_removal(spark):
    rng = random.Random(8)
    item = " ".join(f"w{rng.randint(0, 999)}" for _ in range(20))
    texts = {1: f"Before it, {item.upper()}; after it.", 2: "clean text here", 3: f"{'filler ' * 600}{item}", 4: None, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()} == {2, 3, 4, 5}
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, "spans").collect()}
    assert cut == {1: "Before it, ; after it.", 2: texts[2], 3: "filler " * 600, 4: None, 5: ""}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 5 and decontam.decontaminate(docs.limit(0), bench).count() == 0
    row = decontam.with_hits(spark.createDataFrame([(item,)], "text string"), bench.withColumn("item_id", F.lit(None).cast("long"))).first()["hits"]
    assert row["n_hit"] == 20 and row["items"] == []


def pages_of(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://b", "<p>same</p>"), (2, "http://ü", None), (3, "http://c", ""), (None, "http://d", "<p>same</p>"), (5, "http://e", "é" * 200_000), ((1 << 60) + 1, "http://g", "<p>large</p>"), ((1 << 60) + 3, "http://g", "<p>large</p>"), (6, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n")]
    rows += [(100 + i, f"http://x/{i}", f"<html><head><title>Page number {i}</title></head><body>{'text ' * (i % 50)}</body></html>") for i in range(3000)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark, tmp_path):
    pages = pages_of(spark)
    root = f"file://{tmp_path}/w"
    records = warc.plan_records(pages.repartition(3))
    written = warc.write_archives(records, root, archive_bytes=100_000)
    back = warc.read_archives(spark, written, root, payloads=True).collect()
    assert written.agg(F.sum("records")).first()[0] == len(back) == pages.count() and written.count() >= 3
    want = {(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()}
    by_id = {r["page_id"]: r for r in back}
    for page_id, payload in want:
        r = by_id[page_id]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == payload
    same = {k: (by_id[k]["record_type"], by_id[k]["refers_to"]) for k in (1, 9, 4, None, 2, 3, 5, 6)}
    assert same == {1: ("revisit", 9), 9: ("response", None), 4: ("revisit", 9), None: ("revisit", 9), 2: ("revisit", 3), 3: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert by_id[(1 << 60) + 1]["refers_to"] == (1 << 60) + 3 and by_id[(1 << 60) + 3]["record_type"] == "response"
    assert "\n" not in by_id[1]["url"] and by_id[9]["url"] is None
    least = {r["page_id"]: r["record_type"] for r in warc.archive_pages(pages, f"{tmp_path}/v", min_bytes=100).collect()}
    assert set(least.values()) == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archive_begins_with_its_dictionary(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    path = warc.write_archives(warc.plan_records(pages_of(spark)).coalesce(1), root).first()["path"]
    fs, _ = pyarrow.fs.FileSystem.from_uri(root)
    data = fs.open_input_stream(path, compression=None).read()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert dictionary.dict_id() == zstandard.get_frame_parameters(data[8 + size :]).dict_id != 0
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_frames(io.BytesIO(data[:-5])))


@pytest.mark.parametrize("bodies", [["a"], ["a", "b", "<p>c</p>"], ["x" * 3_000_000, "y"], ["word " * i for i in range(40)]])
def test_every_archive_has_its_dictionary(spark, tmp_path, bodies):
    """Also with few, small or large records; names of records are unique although page ids repeat."""
    root = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(i // 2, "http://x", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(warc.plan_records(pages), root).first()["path"]
    fs, _ = pyarrow.fs.FileSystem.from_uri(root)
    data = fs.open_input_stream(path, compression=None).read()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(data[4:8], "little") >= 8
    records = list(warc.read_frames(io.BytesIO(data)))
    names = [line for r in records for line in r.split(b"\r\n\r\n")[0].split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(names)) == len(records) == len(bodies) + 1 and b"WARC-Type: warcinfo" in records[0]
    assert sorted(warc.parse_record(r)["payload"] or b"" for r in records[1:]) == sorted(b.encode() for b in bodies)


def test_archives_are_released(spark):
    found = warc.archive_pages(pages_of(spark).limit(5))
    assert found.count() == 5
    shared.release(spark)
    assert not [x for x in os.listdir(shared.shared_dir(spark).removeprefix("file:")) if "-warc-" in x]


def test_a_task_begins_new_archives(spark, tmp_path):
    rng = random.Random(9)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{rng.getrandbits(400_000):x}") for i in range(60)], "page_id long, url string, html string").coalesce(1)
    root = f"file://{tmp_path}/w"
    written = warc.write_archives(warc.plan_records(pages), root, archive_bytes=300_000)
    assert written.count() > 3 and sorted(r["page_id"] for r in warc.read_archives(spark, written, root).collect()) == list(range(60))
