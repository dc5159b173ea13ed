import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgrain.llm import decontam, mixing, pii, quality, queries, shared, simhash
from tests.llm.test_simhash import jaccard


def plain_mix(rows, evenness, repeats):
    """Weights and budgets by plain bisection: rows are (source, tokens)."""
    sums = {}
    for source, n in rows:
        sums[source] = sums.get(source, 0) + n
    total = sum(sums.values())
    live = {s: n / total for s, n in sums.items() if n}

    def weights(e):
        raw = {s: p**e for s, p in live.items()}
        return {s: r / sum(raw.values()) for s, r in raw.items()}

    entropy = lambda e: -sum(w * math.log(w) for w in weights(e).values())
    epochs = lambda e: max(weights(e)[s] * total / sums[s] for s in live)

    def bisect(ok):
        lo, hi = 0.0, 1.0
        if not ok(0.0):
            return 0.0
        if ok(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    a = bisect(lambda e: entropy(e) >= evenness * math.log(len(live))) if evenness is not None else 0.0 if repeats is not None else 1.0
    b = bisect(lambda e: epochs(e) > repeats) if repeats is not None else 0.0
    return sums, weights(max(a, b)), total


def corpus(spark, skew=(900, 60, 25, 8)):
    rows = [(1000 * k + i, " ".join(["w"] * (1 + (7 * i) % 13)), f"s{k}") for k, n in enumerate(skew) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize(("evenness", "repeats"), [(0.95, 4.0), (0.6, None), (None, 2.0), (None, None), (1.0, 100.0), (0.9, 1.5)])
def test_weights_and_budgets(spark, evenness, repeats):
    docs = corpus(spark)
    tokens = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    sums, weights, total = plain_mix([(r["source"], tokens[r["doc_id"]]) for r in docs.collect()], evenness, repeats)
    out = mixing.mix(docs, evenness=evenness, repeats=repeats).toPandas()
    for source, n in sums.items():
        mine = out[out.source == source]
        assert mine.weight.iloc[0] == pytest.approx(weights[source], abs=2e-6)
        budget = weights[source] * total
        used = mine.n_tokens.sum()
        assert budget - 14 - 2e-5 * total <= used <= budget + 0.5 + 2e-5 * total
        epochs = mine.groupby("doc_id").epoch.apply(lambda e: sorted(e))
        assert all(e == list(range(len(e))) for e in epochs) and max(map(len, epochs)) <= math.ceil(budget / n + 1e-9)
        full = int(budget / n + 1e-9) if round(budget) >= int(budget / n + 1e-9) * n else int(budget / n)
        assert all(len(e) >= full for e in epochs) and len(mine) == len(mine[["doc_id", "epoch"]].drop_duplicates())
        if repeats is not None and evenness is None:
            assert used <= repeats * n + 1


def test_blocks_are_permuted_anew(spark):
    out = mixing.mix(corpus(spark), evenness=1.0, repeats=None).where("source = 's3' and epoch < 2").toPandas()
    orders = [out[out.epoch == e].sort_values("block").doc_id.tolist() for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_the_same_whatever_the_partitions(spark):
    docs = corpus(spark)
    rows = lambda d: sorted(map(tuple, mixing.mix(d).select("doc_id", "epoch", "block").collect()))
    assert rows(docs.repartition(9)) == rows(docs.coalesce(1))


def test_copies_of_a_row_are_dealt_over_blocks(spark, monkeypatch):
    """A third of all rows equal in id and text: no block holds them all, budgets stay, and partitions make no difference."""
    docs = corpus(spark).unionByName(spark.createDataFrame([(None, "same words here", "s1")] * 500, "doc_id long, text string, source string"))
    found = []
    for copies, parts in ((mixing.COPIES, 3), (mixing.COPIES, 11), (7, 5)):
        monkeypatch.setattr(mixing, "COPIES", copies)
        out = mixing.mix(docs.repartition(parts), evenness=0.9, repeats=2.0)
        found.append(sorted(map(tuple, out.collect()), key=str))
    assert found[0] == found[1] == found[2]
    out = mixing.mix(docs, evenness=None, repeats=None)
    assert out.where("doc_id is null").groupBy("block").count().agg(F.max("count")).first()[0] < 60
    assert out.count() == docs.count()


def plain_rows(spark, docs, **target):
    """The mixture's rows, one document at a time, from the shares that mixture() gives and the hashes of Spark."""
    rows = docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("print")).collect()
    shares = {r["source"]: r for r in mixing.mixture(spark.createDataFrame([(r["source"], r["n_tokens"]) for r in rows], "source string, n_tokens long"), **target).collect()}
    hashes = lambda kind, values: [r[0] for r in spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i long, " + kind).orderBy("i").selectExpr("xxhash64(a, b, c, 7)").collect()]
    seen = {}
    copy = []
    for r in rows:
        key = (r["doc_id"], r["source"], r["n_tokens"], r["print"])
        copy.append(seen.get(key, 0))
        seen[key] = copy[-1] + 1
    slots = [h % mixing.BLOCKS for h in hashes("a long, b long, c long", [(r["doc_id"], r["print"], k) for r, k in zip(rows, copy, strict=True)])]
    out = []
    for source, share in shares.items():
        mine = [(r, s) for r, s in zip(rows, slots, strict=True) if r["source"] == source]
        full = share["budget"] // share["tokens"] if share["tokens"] else 1
        rest = share["budget"] - full * share["tokens"] if share["tokens"] else 0
        for epoch in range(full + 1):
            used = sorted({s for _, s in mine})
            keys = dict(zip(used, hashes("a string, b int, c int", [(source, s, epoch) for s in used]), strict=True))
            left = rest
            for block, slot in enumerate(sorted(used, key=lambda s: (keys[s], s))):
                inside = [r for r, s in mine if s == slot]
                held = sum(r["n_tokens"] for r in inside)
                if epoch < full or left >= held and left > 0:
                    taken = inside
                elif left <= 0:
                    break
                else:
                    order = hashes("a long, b long, c int", [(r["doc_id"], r["print"], epoch) for r in inside])
                    taken, total = [], 0
                    for _, r in sorted(zip(order, inside, strict=True), key=lambda x: (x[0], x[1]["doc_id"], x[1]["n_tokens"], x[1]["print"])):
                        total += r["n_tokens"]
                        if total <= left:
                            taken.append(r)
                out += [(r["doc_id"], source, r["n_tokens"], epoch, block, share["weight"]) for r in taken]
                if epoch == full:
                    left -= held
    return out


@pytest.mark.parametrize("target", [{"evenness": 0.95, "repeats": 4.0}, {"evenness": None, "repeats": 1.5}])
def test_rows_equal_a_plain_version(spark, target):
    docs = corpus(spark)
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))
    short = lambda rows: sorted((r[0], r[1], r[2], r[3], r[4], round(r[5], 9)) for r in rows)
    assert short(mixing.mix(docs, **target).collect()) == short(plain_rows(spark, docs, **target))


def test_mixing_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (None, "three", "b"), (4, "\t \n", "c"), (5, "word " * 50000, "a")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, slot string, tokens int")
    out = mixing.mix(docs, evenness=None, repeats=None).collect()
    assert sorted(((r["doc_id"], r["source"], r["n_tokens"]) for r in out), key=str) == sorted([(1, "a", 0), (2, "a", 0), (3, None, 2), (3, None, 2), (None, "b", 1), (4, "c", 0), (5, "a", 50000)], key=str)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id in (1, 2, 4)")).count() == 3


def test_query(spark, sf):
    out = queries.op10_mixing(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = docs.agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
    used = out.agg(F.sum("n_tokens")).first()[0]
    assert 0.9 * total < used <= total and out.groupBy("source").agg(F.max("epoch")).agg(F.max("max(epoch)")).first()[0] <= 4


DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "decontamination", "pii", "mixing"] and corpus_pipeline.ORACLE_SQL is None
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == DOC_COLUMNS
            docs = shared.materialise(out, name)
        after = docs.collect() if name != "mixing" else out.collect()
        ids = {r["doc_id"] for r in after}
        kept.append(len(ids))
        assert ids <= set(before)
        if name == "quality":
            _, scorer = quality.fit_quality(spark.read.parquet(f"{sf}/documents.parquet"))
            assert ids == {i for i, r in before.items() if scorer.score(quality.shape_features(r["text"])) >= 0.5}
        elif name == "dedup":
            texts = {i: r["text"] for i, r in before.items()}
            exact = {}
            for i in sorted(texts):
                exact.setdefault(texts[i], i)
            assert not ids - set(exact.values())  # of equal texts the smallest id alone may stay
            gone = set(exact.values()) - ids
            assert all(any(jaccard(texts[i], t) >= 0.799 for j, t in texts.items() if j < i and t != texts[i]) for i in gone)
            left = sorted(ids)
            close = [(a, b) for k, a in enumerate(left) for b in left[k + 1 :] if 0.5 < len(texts[a]) / max(1, len(texts[b])) < 2 and jaccard(texts[a], texts[b]) >= 0.9]
            assert len(close) <= 1
        elif name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            windows = decontam.WindowSet.of([(str(i), t) for i, t in bench])
            dirty = set()
            for i, r in before.items():
                n, spans, _ = windows.scan(r["text"])
                hit = int((spans[:, 1] - spans[:, 0]).sum())
                if hit and 20 * hit >= n:
                    dirty.add(i)
            assert dirty and ids == set(before) - dirty
        elif name == "pii":
            assert ids == set(before)
            for r in after:
                assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
                if not pii.proposals(before[r["doc_id"]]["text"]) and not pii.base_spans(before[r["doc_id"]]["text"]):
                    assert r["text"] == before[r["doc_id"]]["text"]
    assert kept[0] > kept[1] > kept[2] == kept[3]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and "doc_id" in out.columns


def test_pipeline_edges(spark, sf):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "A plain sentence, that says a few things. " * 20, "en", "a", 860), (3, "A plain sentence, that says a few things. " * 20, "en", "a", 860), (None, "Another plain text, with other words in it. " * 20, None, None, 880)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, node string")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            if name != "mixing":
                assert out.columns == docs.columns
            out.count()


def test_fingerprint_estimate():
    assert simhash.bits_apart(1.0, 256) == 0 and 35 <= simhash.bits_apart(0.8, 256) <= 42
