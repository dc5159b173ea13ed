"""Personal data, quality, language and language-model scores."""

import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.llm import langid, lmscore, pii, quality, queries

EDGES = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "123 456", "de"), (5, "word " * 60000, "en"), (5, "word " * 60000, "en"), (None, "Some plain text here.", None)]
SCHEMA = "doc_id long, text string, lang string"


def edge_docs(spark):
    """Edge cases with extra columns whose names clash with those that operators use."""
    clash = {c: F.lit("x") for c in ("id", "quality", "language", "lm", "pii", "score", "kept", "t", "h", "code", "source")}
    return spark.createDataFrame(EDGES, SCHEMA).withColumns(clash)


# Personal data


def plain_base(text):
    """The contract's kinds, scanned from the left by hand for where matches begin."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        at, rx = 0, re.compile(pattern)
        while m := rx.search(text or "", at):
            at = m.end()
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


TEXTS = [
    "mail a.b+c@x-y.example.com. and @b.c and d@e f@g.h.i",
    "ip 1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.255 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111111 6011000990139424",
    "é+1 (499) 555-6503, +12 3, +49 (30) 901820-12 34 5678 90, ++1-202-555-0147.",
    "2020-01-02 4111 1111 1111 1111 5",
]


def test_base_spans_equal_the_contract():
    for text in [*TEXTS, *(x[1] for x in EDGES)]:
        assert pii.base_spans(text) == plain_base(text), text[:40] if text else text


def test_query_equals_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, sf).collect()}
    detector = pii.Detector.fit()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        row, want = got[doc["doc_id"]], plain_base(doc["text"])
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        assert set(joined.split(",")) - {""} <= set(spans)
        assert spans == [f"{k}:{s}:{e}" for k, s, e in detector.find(doc["text"])[1]]


def test_secrets_are_added_and_look_alikes_are_not():
    detector = pii.Detector.fit()
    found = lambda t: {(k, t[s:e]) for k, s, e in detector.find(t)[1]}
    assert found('then token = "1eb9c654e721b4f812088970e66a6345cee33dd6" and') == {("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6")}
    for clean in ("The total of 1234567890123456 items was counted.", "Section 4.0. 3. and 12.5 percent in 2020-2021", "a-long-hyphenated-name-of-things and another/path/of/words", "The key: whatever works, token: none"):
        assert found(clean) == set(), clean


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = pii.BoostedTrees.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_held_out_examples():
    """On generated examples with another seed: precision and recall of what is added."""
    detector, rng = pii.Detector.fit(), random.Random(99)
    right = wrong = missed = 0
    for _ in range(2000):
        text, at, good = pii.example(rng)
        base, spans = detector.find(text)
        hit = any(s <= at + 2 and e > at + 4 for _, s, e in spans)
        right, wrong, missed = right + (good and hit), wrong + (not good and len(spans) > len(base)), missed + (good and not hit)
    assert right / (right + wrong) > 0.95 and right / (right + missed) >= 0.9


def test_base_spans_of_random_texts():
    rng = random.Random(0)
    for _ in range(5000):
        text = "".join(rng.choice("a@b.c1 2.3-+()9 0.") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("part", ["1", "a", "1.", "a@", "1 ", "ab12", "f:", "0[.]"])
def test_long_texts_take_linear_time(part):
    """Four times the text takes at most six times the time, whatever the machine."""
    detector = pii.default_detector()

    def seconds(size):
        text, best = part * (size // len(part)), math.inf
        for _ in range(2):
            began = time.process_time()
            detector.find(text)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(1_000_000) < 6 * max(seconds(250_000), 0.02)


def test_long_secrets_are_whole():
    rng = random.Random(3)
    secret = "".join(rng.choice("abcdefghjkABCDEFGHJK0123456789") for _ in range(2000))
    for text in (f'the token = "{secret}" here', f"password: {secret}."):
        assert secret[-1500:] not in pii.redact_text(text, pii.default_detector().find(text)[1])


def test_planted_values_are_found_in_documents():
    """Generated values with a word that names them, inside texts of the tables: nine in ten are found, and little else."""
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) BETWEEN 200 AND 3000 ORDER BY doc_id").fetchall()]
    detector, rng, found, added, n = pii.default_detector(), random.Random(5), 0, 0, 0
    for text in texts * 5:
        planted, at, good = pii.example(rng)
        if not good:
            continue
        k = rng.randint(0, len(text))
        spans = detector.find(text[:k] + " " + planted + " " + text[k:])[1]
        hit = [s for s in spans if s[1] <= at + k + 3 and s[2] > at + k + 5]
        n, found = n + 1, found + bool(hit)
        added += len(spans) - len(hit) - len(detector.find(text)[1])
    assert n > 200 and found / n >= 0.88 and added < 0.05 * n


def test_redaction(spark):
    docs = edge_docs(spark).unionByName(spark.createDataFrame([(9, "é mail a@b.cc, ip 1.2.3.4", "en")], SCHEMA), allowMissingColumns=True)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[9] == "é mail [EMAIL], ip [IP]" and texts[1] is None and texts[2] == "" and texts[5] == "word " * 60000
    assert pii.redact(docs.limit(0)).count() == 0
    assert pii.redact_text("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"


# Quality


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    sees, cries = np.array([0.5, 0.3, 0.6, 0.4]), np.array([0.01, 0.02, 0.01, 0.03])
    votes = np.where(rng.random((20000, 4)) < np.where(good[:, None], cries, sees), quality.BAD, quality.GOOD)
    votes[rng.random(votes.shape) < 0.1] = quality.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.Accuracies.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.on_bad[:, quality.BAD] - sees).max() < 0.08


def test_quality_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality.with_quality(docs).join(labels, "doc_id").select("label", (F.col("quality") >= 0.5).cast("int").alias("kept")).toPandas()
    assert (rows.label == rows.kept).mean() > 0.97
    assert rows[rows.label == 1].kept.mean() > 0.98


def test_quality_edges(spark):
    docs = edge_docs(spark)
    rows = quality.with_quality(docs, into="q")
    got = {r["doc_id"]: r["q"] for r in rows.collect()}
    assert rows.count() == len(EDGES) and got[1] == got[2] == got[3] == 0.0 and all(0 <= v <= 1 for v in got.values())
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.with_quality(docs.where("text is null"), into="q").first()["q"] == 0.0


def test_copies_of_a_text_train_once(spark, monkeypatch):
    """Whatever the number of rows, the sample is of different texts and bounded."""
    seen, fit = [], quality.Scorer.fit
    monkeypatch.setattr(quality.Scorer, "fit", lambda rows, target: seen.append((len(rows), len({tuple(sorted(r.items())) for r in rows}))) or fit(rows, target))
    rows = [("x " * (i + 1),) if i else ("a text of which there are many copies.",) for i in range(60)]
    for copies in (1, 200):
        quality.fit_quality(spark.createDataFrame(rows + rows[:1] * copies, "text string"), sample=30)
        quality.fit_quality(spark.createDataFrame(rows + rows[:1] * copies, "text string"), sample=60)
    assert [n for n, _ in seen] == [30, 60, 30, 60]


def test_quality_query_equals_plain_version(spark, sf):
    """Votes counted, accuracies fitted and every text scored one by one, without Spark."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    codes, counts = np.unique(np.array([quality._code(quality.votes(r["text"])) for r in rows]), return_counts=True)
    accuracies = quality.Accuracies.fit(quality._decode(codes), counts.astype(float))
    texts = {r["text"] for r in rows if r["text"] is not None}
    assert len(texts) <= quality.SAMPLE
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t", F.lit(5)).alias("h")).collect()}
    ordered = sorted(texts, key=hashes.get)
    target = accuracies.posterior(quality._decode(np.array([quality._code(quality.votes(t)) for t in ordered])))
    scorer = quality.Scorer.fit([{k: float(np.float32(v)) for k, v in quality.shape_features(t).items()} for t in ordered], target)
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = scorer.score(quality.shape_features(r["text"]))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-4) and got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["score"] >= 0.5)


# Language


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert ((got.doc_id.astype(str).map(lambda s: zlib.crc32(s.encode()) % 4 == 2)) == got.held_out).all()
    tested = got[got.held_out]
    assert len(tested) > 200 and (tested.lang == tested.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_does_not_see_the_fold(spark):
    """Labels of held-out documents change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    rows = lambda d: sorted(map(tuple, langid.identify(d).collect()))
    assert rows(docs) == rows(spoiled)


def test_every_language_trains_on_different_texts(spark, monkeypatch):
    """Copies crowd no other text of their language out, and a language of few texts keeps them."""
    seen, fit = [], langid.LanguageModel.fit
    monkeypatch.setattr(langid.LanguageModel, "fit", lambda x, langs: seen.append(langs) or fit(x, langs))
    rows = [("many copies of this", "aa")] * 400 + [(f"word{i} " * 3 + chr(97 + i), "aa") for i in range(3)] + [(chr(97 + i) * 5, "bb") for i in range(20)] + [("12 34", "bb")] * 50
    langid.fit_language_model(spark.createDataFrame(rows, "text string, lang string"), per_language=6)
    assert sorted(seen[0]) == ["aa"] * 4 + ["bb"] * 6


def test_language_query_equals_plain_version(spark, sf):
    """The model of the rows that are not held out, fitted and applied text by text without Spark."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train = {(r["lang"], r["text"]) for r in rows if r["lang"] is not None and not held(r["doc_id"]) and langid.has_letter(r["text"])}
    assert max(sum(1 for lang, _ in train if lang == k) for k in {k for k, _ in train}) <= langid.PER_LANGUAGE
    x = [(lang, langid.features(t).astype(np.float16).tobytes()) for lang, t in train]
    x.sort()
    model = langid.LanguageModel.fit(np.stack([np.frombuffer(b, np.float16) for _, b in x]).astype(np.float32), [lang for lang, _ in x])
    got = {r["doc_id"]: r for r in queries.op7_language(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = model.predict(r["text"])
        mine = got[r["doc_id"]]
        assert mine["held_out"] == held(r["doc_id"]) and mine["lang_pred"] == lang and mine["score"] == pytest.approx(score, abs=1e-4)


def test_families_join_like_languages():
    v = lambda *x: np.array(x, float)
    assert langid.group_languages({"a": v(1, 0, 0), "b": v(0.9, 0.1, 0), "c": v(0, 0, 1), "d": v(0, 0.2, 1)}) == [["a", "b"], ["c", "d"]]
    assert langid.group_languages({"a": v(1, 0, 0)}) == [["a"]]


def test_long_texts_count_whole():
    text = "les mots de la langue " * 30000
    assert np.allclose(langid.features(text), langid.features("les mots de la langue " * 300), atol=2e-3)


def test_language_edges(spark):
    docs = edge_docs(spark)
    got = langid.identify(docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == len(EDGES)
    for r in rows:
        assert (r["lang_pred"], r["score"]) == ("und", 0.0) if r["doc_id"] in (1, 2, 3, 4) else r["lang_pred"] in ("en", "und")
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.has_letter("½ 5") is False and langid.has_letter("5 ж")


# Language model


def test_network_gradients():
    """Analytic gradients against differences."""
    net = lmscore.WindowNetwork.new(5)
    for name in ("embed", "bias", "class_w", "class_b", "word_w", "word_b"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(2)
    rows = rng.integers(0, lmscore.SIZE, (6, len(lmscore.OFFSETS) + 1)).astype(np.int32)
    loss = lambda: -net.log_probabilities(rows).mean()
    for p, g in zip((net.embed, net.bias, net.class_w, net.class_b, net.word_w, net.word_b), net.gradients(rows), strict=True):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        keep, eps = p[at], 1e-5
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=1e-4)


def test_probabilities_sum_to_one():
    net = lmscore.WindowNetwork.new(1)
    rows = np.tile([[3, 7, lmscore.PAD, 1, 0]], (lmscore.SIZE, 1)).astype(np.int32)
    rows[:, -1] = np.arange(lmscore.SIZE)
    assert np.exp(net.log_probabilities(rows)).sum() == pytest.approx(1, abs=1e-4)


def test_trained_network_beats_frequencies():
    """In a language where a word follows from its neighbours, knowing both sides helps."""
    rng = np.random.default_rng(3)
    tokens = np.concatenate([np.arange(k, k + 6) for k in rng.integers(0, 40, 6000) * 6]).astype(np.int32)
    rows = lmscore.windows_of(tokens, np.arange(len(tokens)))
    net = lmscore.WindowNetwork.fit(rows[:30000])
    counts = np.bincount(tokens[:30000], minlength=lmscore.SIZE) + 0.5
    assert net.log_probabilities(rows[30000:]).mean() > np.log(counts / counts.sum())[tokens[30000:]].mean() + 2


def test_scores_equal_one_text_at_a_time(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scorer = lmscore.fit_scorer(docs)
    rows = docs.limit(40).collect()
    together = scorer.score([r["text"] for r in rows])
    for r, (n, s) in zip(rows, together, strict=True):
        tokens = scorer.vocabulary.tokens(r["text"])
        alone = sum(float(scorer.network.log_probabilities(lmscore.windows_of(tokens, np.array([i])))[0]) for i in range(min(len(tokens), 60)))
        part = float(scorer.network.log_probabilities(lmscore.windows_of(tokens, np.arange(min(len(tokens), 60)))).sum()) if len(tokens) else 0.0
        assert n == len(tokens) and alone == pytest.approx(part, rel=1e-4)
        if n <= 60:
            assert s == pytest.approx(alone, rel=1e-4)
    got = {r["doc_id"]: (r["n_tokens"], r["log_prob"]) for r in queries.op9_lm_score(spark, sf).collect()}
    for r, (n, s) in zip(rows, together, strict=True):
        assert got[r["doc_id"]][0] == n and got[r["doc_id"]][1] == pytest.approx(s, rel=1e-3)


def test_word_counts_are_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HELD_WORDS", 3)
    docs = spark.createDataFrame([("a b, c A",), ("b d 12",), (None,)], "text string")
    assert {bytes(r["word"]): r["n"] for r in lmscore.word_counts(docs).collect()} == {b"a": 2, b"b": 2, b"c": 1, b"d": 1, b"00": 1}
    assert sum(r["n"] for r in lmscore.word_counts(docs).collect()) == 7


def test_gradient_rows_are_added_by_owner():
    """Owners that are met once, often, and more often than are added side by side."""
    rng = np.random.default_rng(1)
    owner = np.sort(np.concatenate((rng.integers(0, 50, 300), np.full(3 * lmscore.LEVELS, 7), np.full(lmscore.LEVELS, 60), [99])))
    value, rows = rng.normal(size=(40, lmscore.WIDTH)), rng.integers(0, 40, len(owner))
    found, sums = lmscore._rows_by(owner, value, rows)
    whole = np.zeros((100, lmscore.WIDTH))
    np.add.at(whole, owner, value[rows])
    assert sorted(found) == sorted(set(owner.tolist())) and np.allclose(sums, whole[found])


def test_large_scores_train_without_overflow():
    """Parameters whose scores pass the bound give finite steps."""
    net = lmscore.WindowNetwork.new(2)
    net.class_w *= 1e4
    net.word_w *= 1e4
    rows = np.random.default_rng(0).integers(0, lmscore.SIZE, (500, len(lmscore.OFFSETS) + 1)).astype(np.int32)
    net.train(rows, net.no_steps(), 2, 100)
    assert all(np.isfinite(p).all() for p in net.parts)


def test_different_texts_are_numbered_once(spark):
    """Copies share one row of numbers, from which the network trains and scores; they give what the text itself gives."""
    texts = ["a b c a", "b c zz, zz", "", "a b c a", None, "12 of A", "a b c a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scorer = lmscore.fit_scorer(docs)
    rows = scorer.corpus.collect()
    assert len(rows) == len({t for t in texts if t is not None})
    numbers = lmscore.Numbers(scorer.network.embed.shape[1])
    assert sorted(len(numbers.tokens(r["tokens"])) for r in rows) == [0, 3, 4, 4]
    got = {r["doc_id"]: r["lm"] for r in lmscore.with_scores(docs).collect()}
    for (i, text), (n, s) in zip(enumerate(texts), scorer.score(texts), strict=True):
        assert got[i]["n_tokens"] == n and got[i]["log_prob"] == pytest.approx(s, rel=1e-5)
    many = lmscore.Numbers(1 << 17)
    assert many.tokens(many.packed(np.array([0, 70000]))).tolist() == [0, 70000]


def test_lm_edges(spark):
    docs = edge_docs(spark)
    out = lmscore.with_scores(docs, into="scored")
    got = {r["doc_id"]: r["scored"] for r in out.collect()}
    assert out.count() == len(EDGES)
    assert all(got[i]["n_tokens"] == 0 and got[i]["log_prob"] == 0 and got[i]["mean_log_prob"] is None for i in (1, 2, 3))
    assert got[5]["n_tokens"] == 60000 and got[5]["mean_log_prob"] == pytest.approx(got[5]["log_prob"] / 60000)
    assert lmscore.with_scores(docs.limit(0), into="scored").count() == 0


def test_vocabulary_windows_and_rare_words_grow(spark, monkeypatch):
    """Gibberish of one bucket scores by its count; words and shards follow the corpus, not a constant."""
    monkeypatch.setattr(lmscore, "COMMON", 1200)
    monkeypatch.setattr(lmscore, "SHARE", 1.0)
    monkeypatch.setattr(lmscore, "OWN", 0.1)
    rng = random.Random(4)
    rows = [(i, " ".join(f"{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvwxyzabcd'[j // 100]}w" for j in rng.choices(range(1000), k=60))) for i in range(500)]
    rows += [(1000 + i, "pxyz") for i in range(6)] + [(2000, "qxyz"), (2001, "qxyz rxyz"), (2002, None), (2003, "rxyz")]
    rows += [(3000 + i, "u" + "".join(rng.choices("abcdefgh", k=8))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = lmscore.fit_scorer(docs, windows=3000)
    assert scorer.network.word_b.size > lmscore.SIZE and scorer.rare is not None
    got = {r["doc_id"]: r["lm"] for r in lmscore.with_scores(docs, windows=3000).collect()}
    assert len(got) == len(rows) and got[2002]["n_tokens"] == 0 and got[2002]["log_prob"] == 0
    assert got[1000]["log_prob"] - got[2000]["log_prob"] == pytest.approx(np.log(3), abs=1e-5)  # six to two
    assert got[2000]["log_prob"] == pytest.approx(got[2003]["log_prob"], abs=1e-6)
    plain = {i: (n, s) for (i, _), (n, s) in zip(rows, scorer.score([t for _, t in rows]), strict=True)}
    counts = {}
    for _, t in rows:
        for w in lmscore.words_of(t):
            counts[w] = counts.get(w, 0) + 1
    own = {w for w, i in scorer.vocabulary.items() if i < lmscore.SIZE - lmscore.BUCKETS or lmscore.SIZE < i < scorer.network.embed.shape[1]}
    rest = {}
    for w, n in counts.items():
        if w not in own:  # once more for each word seen once, and one, for what is unknown
            rest[lmscore.bucket(w)] = rest.get(lmscore.bucket(w), 1) + n + (n == 1)
    for i, t in rows:
        more = sum(np.log(counts[w] / rest[lmscore.bucket(w)]) - scorer.unseen(w) for w in lmscore.words_of(t) if lmscore.SIZE - lmscore.BUCKETS <= scorer.vocabulary[w] < lmscore.SIZE)
        assert got[i]["log_prob"] == pytest.approx(plain[i][1] + more, rel=1e-4)


def test_every_window_trains_the_network(spark, monkeypatch):
    """All tokens are dealt to the shards, copies too, each to one round; parts are bounded and follow no order of arrival."""
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + (i * k) % 23)}" for k in range(40))) for i in range(60)] + [(100 + i, "a b c") for i in range(30)] + [(900, None)], "doc_id long, text string")
    dealt, averaged = [], lmscore._averaged

    def watched(net, sums, rows, *rest):
        dealt.extend((r["t"], r["n"]) for r in rows.collect())
        return averaged(net, sums, rows, *rest)

    monkeypatch.setattr(lmscore, "_averaged", watched)
    lmscore.fit_scorer(docs, windows=200)
    assert sum(n * len(lmscore.words_of(t)) for t, n in dealt) == 60 * 40 + 30 * 3
    vocabulary, known_as = lmscore.Vocabulary([b"a", b"b"]), np.arange(lmscore.SIZE + 1, dtype=np.int32)
    monkeypatch.setattr(lmscore, "AT_ONCE", 4)
    parts = list(lmscore._training(["a b a b a b", "b"], [3, 2], vocabulary, known_as, 6))
    again = list(lmscore._training(["b", "a b a b a b"], [2, 3], vocabulary, known_as, 6))
    assert sum(len(p) for p in parts) == 20 and max(len(p) for p in parts) < 10
    assert (np.concatenate(parts) == np.concatenate(again)).all()


def test_all_words_sum_to_one_at_most(spark):
    """Known words and the unknown ones of a bucket, whose spellings are a distribution, share the bucket's probability."""
    docs = spark.createDataFrame([(1, "abc abc abc xbc ybc qq rr rr"), (2, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)) * 2)], "doc_id long, text string")
    scorer = lmscore.fit_scorer(docs)
    shares = np.exp(scorer.network.within)
    tokens = np.arange(len(shares))
    for b in range(lmscore.SIZE - lmscore.BUCKETS, lmscore.SIZE):
        known = shares[(scorer.network.known_as == b) & (tokens != b)].sum()
        assert known + np.exp(scorer.unknown_share[b]) == pytest.approx(1)
    spelling = lmscore.Spelling([b"ab", b"ba", b"a"] * 500)
    alphabet = [c for c in spelling.ALPHABET if c != 32]
    one = sum(np.exp(spelling.log_probability(bytes([a]))) for a in alphabet)
    two = sum(np.exp(spelling.log_probability(bytes([a, b]))) for a in alphabet for b in alphabet)
    assert np.exp(spelling.log_probability(b"")) + one + two < 1 and two > 0.1


def test_gibberish_and_shuffled_words_score_below_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    scorer = lmscore.fit_scorer(docs.where("doc_id % 4 <> 1"))
    rng = random.Random(5)
    held = [r["text"] for r in docs.where("doc_id % 4 = 1").collect()]
    shuffled = [" ".join(rng.sample(x, len(x))) for t in held for x in [t.split()]]
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60)) for _ in range(40)]

    def mean(texts):
        scored = scorer.score(texts)
        return sum(s for _, s in scored) / sum(n for n, _ in scored)

    assert mean(held) > mean(shuffled) and mean(held) > mean(letters) + 5


def test_a_batch_has_one_softmax_for_the_words_of_all_classes(monkeypatch):
    """The products alone go class by class; gradients are those of each window by itself."""
    calls, plain = [], lmscore._softmax
    monkeypatch.setattr(lmscore, "_softmax", lambda z, bounded: calls.append(z.shape) or plain(z, bounded))
    rng = np.random.default_rng(1)
    windows = rng.integers(0, lmscore.SIZE, (50, len(lmscore.OFFSETS) + 1)).astype(np.int32)
    net = lmscore.WindowNetwork.new()
    got = net.gradients(windows)
    assert calls == [(50, lmscore.CLASSES), (50, lmscore.PER_CLASS)]
    alone = [net.gradients(windows[i : i + 1]) for i in range(50)]
    for k, part in enumerate(got):
        np.testing.assert_allclose(part, np.mean([a[k] for a in alone], axis=0), atol=1e-6)
