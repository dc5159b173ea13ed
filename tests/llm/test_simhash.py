import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docgrain import session
from docgrain.llm import queries, shared, simhash

SCHEMA = "doc_id long, text string, lang string, component_id string, fp string, node string"


def plain_fingerprint(text, shingle=4):
    """The contract, word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    """Smallest id reachable, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 99)) for _ in range(n))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "two words here", "exactly four words ok", "É À über STRASSE maß", words(rng, 500), "a b c d " * 40000, "x\x0by\x0cz\rw v"]
    for t in texts[:-2] + texts[-1:]:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t[:30]
    assert simhash.fingerprint(texts[-2]) == plain_fingerprint("a b c d " * 10)  # over several blocks of shingles
    assert simhash.fingerprint(None) == 0


def test_spark_hash_is_the_contract_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("some é text"))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64("some é text".encode(), 42).intdigest()


def test_query_equals_brute_force(spark, sf):
    got = queries.op6_simhash_dedup(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.itertuples()}
    want = plain_components(fps, 4)
    assert len(got) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("limit", [simhash.LONG_RUN, 40])
def test_every_pair_within_the_distance_links(spark, monkeypatch, limit):
    """Chains, clusters and hot buckets of random fingerprints; with the low limit buckets are dealt out in parts."""
    monkeypatch.setattr(simhash, "LONG_RUN", limit)
    rng = random.Random(2)
    fps = {}
    for _ in range(6):
        now = rng.getrandbits(64)
        for _ in range(60):
            fps[len(fps)] = now
            for bit in rng.sample(range(64), rng.choice((1, 2, 3, 4, 5, 9))):
                now ^= 1 << bit
    centre = rng.getrandbits(64)
    for _ in range(150):
        fps[len(fps)] = centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    unique = {f: i for i, f in reversed(fps.items())}
    rows = [(i, int(np.uint64(f).view(np.int64))) for f, i in unique.items()]
    classes = spark.createDataFrame(rows, "node long, fp long")
    keys = F.explode(simhash.block_keys(F.col("fp"), simhash.block_masks(6, 4))).alias("key")
    found = shared.connected_components(simhash.near_edges(classes.select("node", "fp", keys), 4))
    got = {r["node"]: r["component"] for r in found.collect()}
    want = plain_components({i: f for f, i in unique.items()}, 4)
    assert {i: got.get(i, i) for i in want} == want


def test_edges(spark):
    rows = [(5, None, "x", "a", "b", "c"), (3, "", None, "a", "b", "c"), (7, "Same text of five words", "x", None, "b", "c"), (7, "Same text of five words", "x", None, "b", "c"), (2, "same TEXT of five words", "x", "a", None, "c"), (None, "same text of five words", "x", "a", "b", None), (9, "long " * 50000, "x", "a", "b", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 2), (7, 2), (2, 2), (None, 2), (9, 9)], key=str)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 9]
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs.where("doc_id <> 2 or doc_id is null")).collect()) == [3, 7, 9]
    assert [r["doc_id"] for r in simhash.keep_one_of_each(docs.where("doc_id is null").union(docs.where("doc_id is null"))).collect()] == [None]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 and simhash.keep_one_of_each(docs.limit(0)).count() == 0
    assert [r["component_id"] for r in simhash.simhash_groups(docs.where("doc_id is null")).collect()] == [None]


def test_ids_play_no_part_in_what_links(spark, monkeypatch):
    """A chain of fingerprints holds through rows without an id; an id on two texts joins nothing."""
    monkeypatch.setattr(simhash, "fingerprint", lambda t, shingle=4: int(t, 16))
    rows = [(1, "0"), (None, "f"), (2, "ff"), (7, "ffff00000000"), (7, "ffff000000000000"), (5, "fffe000000000000")]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.sparkSession.createDataFrame([(i, int(np.uint64(int(t, 16)).view(np.int64))) for i, t in rows], "id long, fp long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (7, 7), (7, 5), (5, 5)], key=str)


def test_similar_links_are_those_of_all_pairs():
    """A base with many copies that are similar to it and not to each other, and others; pairs of guests do not count."""
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 31, 200))
    sets = [base, *(np.unique(np.concatenate((base[rng.random(len(base)) > 0.12], rng.integers(0, 1 << 31, 20)))) for _ in range(80))]
    sets += [np.unique(rng.integers(0, 1 << 31, 200)) for _ in range(40)]
    fp = np.stack([np.frombuffer(simhash.wide_fingerprint(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 4)[0], np.uint64) for x in sets])
    name, here = np.arange(len(sets)), rng.random(len(sets)) < 0.7
    name[100:103] = 100
    here[0] = True
    for home in (here, np.ones(len(sets), bool)):
        want = np.minimum(np.arange(len(sets)), name)
        for b in range(len(sets)):
            for a in range(b):
                if (home[a] or home[b]) and jaccard_of(sets[a], sets[b]) >= 0.8 and np.bitwise_count(fp[a] ^ fp[b]).sum() <= 54:
                    want = shared.merged(want, np.array([a]), np.array([b]))
        assert simhash.similar_links(fp, sets, name, home, 54, 0.8).tolist() == want.tolist() and (want == 0).sum() > 20


def jaccard_of(x, y):
    return len(np.intersect1d(x, y)) / len(np.union1d(x, y))


def test_large_groups_in_parts_give_the_same(spark, monkeypatch):
    """With little room a group is dealt out in parts: hubs first, then what is still apart."""
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = words(rng, 200).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(60):
            edited = list(base)
            for at in rng.sample(range(200), rng.choice((2, 3, 5))):
                edited[at] = "edited" + str(rng.random())
            rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows) + i, words(rng, 100)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda: {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    whole = groups()
    monkeypatch.setattr(simhash, "SET_BYTES", 12_000)
    monkeypatch.setattr(simhash, "HUBS", 2)
    assert groups() == whole and len(set(whole.values())) < 100
    pairs = similar_pairs(dict(rows), 0.8)
    assert np.mean([whole[a] == whole[b] for a, b in pairs]) >= 0.995


def jaccard(a, b, n=5):
    grams = lambda t: {tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_similar_texts_group_and_others_do_not(spark):
    """Copies with few edits (five-word similarity 0.85 and more) are found nearly always, those below 0.6 nearly never."""
    rng = random.Random(3)
    rows, pairs = [], []
    for k in range(120):
        base = words(rng, 300).split()
        edited = list(base)
        for at in rng.sample(range(300), 3 if k % 2 else 22):
            edited[at] = "edited" + str(rng.random())
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [got[2 * k + 1] == 2 * k for k, j in enumerate(pairs) if j >= 0.85]
    far = [got[2 * k + 1] == 2 * k for k, j in enumerate(pairs) if j <= 0.6]
    assert len(near) == 60 and sum(near) >= 57 and len(far) >= 50 and sum(far) <= 3
    assert all(got[i] in (i, i - 1) for i in got)


def test_pairs_at_the_threshold_are_found(spark):
    """Similarities from 0.80 to 0.83 link, those just below do not."""
    rng = random.Random(7)
    rows, pairs = [], []
    for k in range(200):
        base = words(rng, 300).split()
        edited = list(base)
        for at in rng.sample(range(5, 295), 6 if k % 4 else 8):
            edited[at] = "edited" + str(rng.random())
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [got[2 * k + 1] == 2 * k for k, j in enumerate(pairs) if 0.8 <= j <= 0.83]
    far = [got[2 * k + 1] == 2 * k for k, j in enumerate(pairs) if j < 0.8]
    print("found", sum(near), "of", len(near))
    assert len(near) >= 100 and sum(near) >= 0.96 * len(near) and far and not any(far)


@pytest.mark.parametrize("length", [60, 150, 400])
def test_pairs_at_the_threshold_meet(length):
    """Of fingerprints at a similarity of 0.80 to 0.81, nearly all meet in a block and are within the slack."""
    rng = np.random.default_rng(11)
    width, blocks = simhash.blocks_for(100_000, 0.8)
    chosen, found, limit = simhash.drawn_blocks(256, width, blocks), [], simhash.bits_apart(0.8, 256) + 15
    for _ in range(400):
        both = rng.integers(0, 1 << 63, length, dtype=np.int64).view(np.uint64)
        other = rng.integers(0, 1 << 63, 2 * (length // 8), dtype=np.int64).view(np.uint64)
        (a, x), (b, y) = (simhash.wide_fingerprint(np.concatenate((both, part)), 4) for part in np.split(other, 2))
        keys = simhash.wide_keys([a, b], [x, y], chosen)
        met = bool(set(keys[0].tolist()) & set(keys[1].tolist()))
        found.append(met and (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= limit)
    print("met", np.mean(found))
    assert np.mean(found) >= 0.985


def test_repeated_lines_do_not_make_copies(spark):
    """Different texts with the same line many times over have few shingles in common."""
    rng = random.Random(6)
    line = words(rng, 40)
    rows = [(i, " ".join([words(rng, 300), *[line] * 15])) for i in range(40)]
    assert jaccard(rows[0][1], rows[1][1]) < 0.2
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i == c for i, c in got.items())


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 64)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (None, 3), (1400, 1399)], "a long, b long")
    got = {r["node"]: r["component"] for r in shared.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(65)) and all(got[1000 + i] == 1000 for i in range(400)) and got[1400] == 1000
    assert shared.connected_components(edges.limit(0)).count() == 0


def test_release_deletes_what_was_written(spark):
    kept = shared.materialise(spark.range(3), "t")
    gone = shared.materialise(spark.range(4), "t")
    shared.forget(gone)
    assert kept.count() == 3
    shared.release(spark)
    assert not session._written
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        kept.count()


def similar_pairs(texts, least, n=5):
    """{(a, b): similarity} of all pairs of ids, a < b, by counting shared shingles."""
    sets = {i: set(simhash.shingle_set(t, n).tolist()) for i, t in texts.items()}
    where, shared_by = {}, {}
    for i in sorted(sets):
        for g in sets[i]:
            for j in where.setdefault(g, []):
                shared_by[j, i] = shared_by.get((j, i), 0) + 1
            where[g].append(i)
    both = {p: k / (len(sets[p[0]]) + len(sets[p[1]]) - k) for p, k in shared_by.items()}
    return {p: j for p, j in both.items() if j >= least}


def test_groups_of_documents_equal_all_pairs(spark):
    """Whole groups of sf0.01: what is linked is what pairs of 0.8 and more link."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pairs = similar_pairs(texts, 0.8)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(pairs):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    empty = sorted(i for i, t in texts.items() if not (t or "").split())
    want = {i: find(i) if i not in empty else empty[0] for i in texts}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    near = [p for p in pairs if texts[p[0]] != texts[p[1]]]
    assert len(near) >= 10 and all(got[a] == got[b] for a, b in near)
    assert np.mean([got[i] == want[i] for i in want]) >= 0.998
    assert all(want[i] == want[c] for i, c in got.items())  # nothing below 0.8 joins
