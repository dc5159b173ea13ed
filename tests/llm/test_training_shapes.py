"""Hard negatives, fill-in-middle and packing."""

import hashlib
import re
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docgrain.llm import fim, hard_negatives, packing, queries
from tests.oracle import assert_same, connect

TOKENIZER = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_fill_in_middle"])
def test_query_equals_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf).toPandas(), connect(sf).execute(queries.oracle_sql()[name]).df())


def brute_negatives(rows, every=100, k=5):
    """(anchor, positive, rank, negative, scores) by all pairs; rows of (id, label, vector)."""
    whole = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (-r[1], r[0] is None, r[0])
    out = []
    for a, (i, label, v) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = [(j, sum(x * y for x, y in zip(v, w, strict=True)), other == label) for b, (j, other, w) in enumerate(whole) if b != a and len(w) == len(v)]
        for p, s, _ in sorted((r for r in scored if r[2]), key=order)[:k]:
            fit = [r for r in scored if not r[2] and 80 * s <= 100 * r[1] <= 100 * s]
            out += [(i, p, n + 1, j, s, t) for n, (j, t, _) in enumerate(sorted(fit, key=order)[:k])]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, rank int")
    return sorted(map(tuple, hard_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **more).collect()), key=str)


@pytest.mark.parametrize(("leaf", "block"), [(hard_negatives.LEAF, hard_negatives.BLOCK_BYTES), (8, 2000)])
def test_negatives_equal_brute_force(spark, monkeypatch, leaf, block):
    """Near groups, equal vectors, ties, a hot label and one that few have; with small trees and many blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i * 10, int(rng.integers(0, 4)) if i % 3 else 0, (centres[i % 6] + 0.3 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(100, 2, rows[7][2]), (7001, 2, rows[7][2]), (7002, 99, rows[7][2]), (7003, 2, rows[7][2])]
    want = brute_negatives(rows)
    assert len(want) > 300 and mined(spark, rows) == want


def test_negative_edges(spark):
    near = [1.0, 0.5]
    rows = [(0, 1, near), (1, 1, near), (2, 2, near), (3, 2, near), (None, 2, near), (4, None, near), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [1.0, float("nan")]), (8, 2, [float("inf"), 0.0]), (9, 2, [1.0]), (10, 2, []), (100, 3, [-1.0, 0.0]), (101, 3, [1.0, 0.0]), (200, 4, [0.0, 0.0]), (201, 4, [5.0, 5.0])]
    assert mined(spark, rows) == brute_negatives(rows)
    assert (0, 1, 3, None, 256 * 256 + 128 * 128, 256 * 256 + 128 * 128) in mined(spark, rows)
    assert mined(spark, []) == [] and mined(spark, [(100, None, near)]) == []
    with pytest.raises(Exception, match="2\\*\\*53"):
        mined(spark, [(0, 1, [1e30, 1.0]), (1, 1, [1e30, 1.0])])


def test_nodes_are_pruned():
    """Far groups are left out, from above, from below and by the k-th score."""
    rng = np.random.default_rng(2)
    n, groups = 20_000, 40
    centres = rng.normal(size=(groups, 16))
    vectors = np.floor(256 * (centres[np.arange(n) % groups] + 0.02 * rng.normal(size=(n, 16))))
    points = hard_negatives.Points(vectors, np.arange(n), np.arange(n), np.arange(n) % 3)
    anchors = points.take(np.arange(0, n, 400))
    search = hard_negatives.Search(anchors, np.full((50, 1), -(2**60)), np.full((50, 1), 2**60), False, 5)
    search.add(hard_negatives.BallTree(points))
    scores = (anchors.vectors @ vectors.T).astype(np.int64)
    allowed = anchors.label[:, None] != points.label
    best = -np.sort(-np.where(allowed, scores, -(2**60)), axis=1)[:, :5]
    assert (search.score[:, 0] == best).all() and search.compared < 0.3 * scores.size
    low = best[:, :1] // 3
    window = hard_negatives.Search(anchors, low, best[:, :1] // 2, False, 5)
    window.add(hard_negatives.BallTree(points))
    inside = np.where(allowed & (scores >= low) & (scores <= best[:, :1] // 2), scores, hard_negatives._NONE)
    assert (window.score[:, 0] == np.sort(inside, axis=1)[:, ::-1][:, :5]).all()
    assert window.compared < 0.7 * scores.size


def plain_middle(doc_id, text):
    """The contract, by lists of tokens."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_equal_plain_version(spark):
    texts = [None, "", "a", "é", "one two", "x<P>y", "<S", "a<", "日本 語x\n\t", "🙂" * 50, "a" * 300_000, "é" * 200_000, ("Wörd. " * 40_000), "<M>", "P>S>M>", "\x00b"]
    rows = [(i, t, "f", 1) for i in (*range(12), None, -5) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string, n int")
    made = fim.fill_in_middle(docs).select("doc_id", "text", "n", "fim.form", "fim.output", F.col("fim.n").alias("units"), "fim.prefix_chars", "fim.middle_chars", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back"))
    found = made.collect()
    got = [(r["doc_id"], r["units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found]
    assert sorted(got, key=str) == sorted((plain_middle(i, t) for i, t, *_ in rows), key=str)
    assert all(r["back"] == (r["text"] or "") for r in found) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=("<<", "<S>", "<M>"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ é日🙂.\n", max_size=80), st.integers(1, 9), st.integers(1, 12))
def test_checkpoints_find_every_place(text, every, block):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    index = fim.UnitIndex.of(text.encode(), every, block)
    assert index.n == len(tokens) and index.n_points == len(text)
    assert len(index.units) <= 1 + -(-len(tokens) // every)
    for k in range(len(tokens) + 2):
        before = "".join(tokens[:k])
        assert index.cut(k, block) == (len(before.encode()), len(before))


def test_patterns_are_all_there():
    lengths, capacity = np.array([3, 4, 5, 6, 8, 12, 16, 20]), 20
    want = {tuple(sorted(c, reverse=True)) for k in (1, 2, 3) for c in combinations_with_replacement(lengths.tolist(), k) if sum(c) == capacity}
    assert {tuple(x for x in row if x) for row in packing.patterns(lengths, capacity).tolist()} == want


def test_fit_is_least_squares():
    """What a pattern could still add to is used up, and what could be taken away is not there."""
    rng = np.random.default_rng(1)
    wanted = np.zeros(65)
    wanted[8:65] = rng.integers(0, 400, 57)
    made_of = packing.patterns(np.flatnonzero(wanted), 64)
    x = packing.fit(wanted, made_of, rounds=200)
    weight = np.arange(65.0)
    left = weight * (wanted - sum(np.bincount(made_of[:, k], x, 65) for k in range(3)))
    left[0] = 0
    slope = (weight * left)[made_of].sum(axis=1)
    assert x.min() >= 0 and slope.max() <= 1e-3 * (weight**2 * wanted).max() and np.abs(slope[x > 1e-6]).max() <= 1e-3 * (weight**2 * wanted).max()


def plain_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            i = min(fits, key=left.__getitem__)
            left[i] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_best_fit_equals_piece_by_piece():
    rng = np.random.default_rng(0)
    for capacity in (10, 37, 100):
        lengths = rng.integers(1, capacity + 1, 400)
        groups = packing.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert sorted(capacity - sum(n * t for n, t in c) for k, c in groups for _ in range(k)) == plain_best_fit(lengths.tolist(), capacity)


@pytest.mark.parametrize("kind", ["few", "mixed", "long", "equal", "short"])
def test_plans_are_tight(kind):
    rng = np.random.default_rng(3)
    lengths = {"few": rng.integers(600, 1400, 300), "mixed": rng.integers(300, 1400, 60_000), "long": rng.integers(600, 1400, 60_000), "equal": np.full(9000, 700), "short": rng.integers(1, 60, 20_000)}[kind]
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.Plan.of(counts)
    bfd = sum(n for n, _ in packing.best_fit(counts))
    assert plan.n_sequences <= (bfd * 1.03 if kind == "few" else bfd)
    if kind == "mixed":
        assert plan.n_fitted > 0.9 * plan.n_sequences and plan.n_sequences <= 1.001 * lengths.sum() / 2048
    rank = np.concatenate([np.arange(n) for n in counts])
    check_places(np.repeat(np.arange(2049), counts), *plan.place(np.repeat(np.arange(2049), counts), rank), 2048, plan.n_sequences)


def check_places(length, sequence, offset, capacity, n):
    order = np.lexsort((offset, sequence))
    length, sequence, offset = length[order], sequence[order], offset[order]
    first = np.concatenate(([True], sequence[1:] != sequence[:-1]))
    assert (offset[first] == 0).all() and (offset[1:][~first[1:]] == (offset + length)[:-1][~first[1:]]).all()
    assert (offset + length).max() <= capacity and first.sum() == n


WORDS = st.text(alphabet=st.sampled_from(list("abzABZé ÉßẞΣİ́日🙂 \t\n  .,!'<|>-_0123Ⅷ²")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=4))
def test_ids_are_the_tokenizers(texts):
    encoder = ENCODER
    texts = [*texts, "don't I'LL <|endoftext|>Foo, bar!!", "'s x's", "a" * 3000]
    ids, ends = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


PLAIN, ENCODER = Tokenizer.from_str(TOKENIZER), packing.Encoder(TOKENIZER)


def test_other_tokenizers_get_whole_texts():
    other = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder, plain = packing.Encoder(other), Tokenizer.from_str(other)
    ids, ends = encoder.encode(pa.array(["two  words\n", "", "x"]))
    assert not encoder.by_word and [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in ("two  words\n", "", "x")]


def pieces_of(text, capacity):
    ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]
    for k, at in enumerate(range(0, len(ids), capacity)):
        part = ids[at : at + capacity]
        yield k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


@pytest.mark.parametrize("at_once", [packing.AT_ONCE, 100])
def test_packed_pieces(spark, sf, monkeypatch, at_once):
    """Every piece of every document, null, empty, long and repeated ones too, stands in one place, without gaps."""
    monkeypatch.setattr(packing, "AT_ONCE", at_once)
    more = [(900, None), (901, ""), (902, "word " * 5000), (902, "word " * 5000), (None, "no id"), (903, " \n"), *[(904, "copies of one text")] * 50]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs = docs.withColumns({"length": F.lit("x"), "part": F.lit(3)}).repartition(5)
    found = packing.pack(docs, TOKENIZER, capacity=512).toPandas()
    rows = found[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(found[["doc_id"]].notna().all(axis=1), None)
    want = [(r["doc_id"], *p) for r in docs.collect() for p in pieces_of(r["text"], 512)]
    key = lambda r: tuple(-1 if x is None or x != x else int(x) for x in r)
    assert sorted(map(key, found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want)) and len(rows) == len(want)
    check_places(found["length"].to_numpy(), found["sequence_id"].to_numpy(), found["offset"].to_numpy(), 512, found["sequence_id"].nunique())
    assert found["sequence_id"].nunique() <= len(plain_best_fit(found["length"].tolist(), 512))
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_packing_query(spark, sf):
    found = queries.op13_packing(spark, sf).toPandas()
    assert found.groupby("sequence_id")["length"].sum().max() <= 2048
    assert found["sequence_id"].nunique() <= len(plain_best_fit(found["length"].tolist(), 2048))
