import re

from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.functions import vectors as V
from docgrain.operators import metadata, resolution


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens, "The Über-Café, v2_x") == ["the", "ber", "caf", "v2_x"]
    assert one(spark, T.content_tokens, "The cat and a cat") == ["cat", "cat"]
    assert one(spark, T.content_tokens, None) == []


def test_entity_names(spark):
    for name in ("Smith & Wesson, Inc.", "SMITH AND WESSON", "S&W", "sw"):
        assert one(spark, T.entity_name, name) == "smith and wesson"
    assert one(spark, T.entity_name, None) == ""


def test_junk_names(spark):
    for name in ("March", "Sunday", "2015", "Q3", "FY24", "3rd", "x", "1234-5", "n/a", "a" * 81, "two\nlines"):
        assert one(spark, T.is_junk_name, name), name
    for name in ("Ruger", "Acme Arms", "Milwaukee, WI"):
        assert not one(spark, T.is_junk_name, name), name


def test_quality_steps(spark):
    prose = "A sentence about nothing in particular that goes on. " * 4
    contents = "\n".join(f"{i}. Table: something or other about it" for i in range(6))
    outline = "\n".join(f"{i}.1 A title of a section      {i}" for i in range(1, 8))
    cases = {"short": 0.15, "[DOC SUMMARY: x] " + prose: 0.20, "https://example.com/" + "a" * 90: 0.10, "6/7/26, 10:05 PM " + "word " * 10 + "and some more of it here now": 0.15, contents: 0.20, outline: 0.20, prose: 1.0}
    for text, expected in cases.items():
        assert one(spark, T.chunk_quality, text) == expected, text


def test_gate(spark):
    allowed = lambda t, kind="text", how="text": one(spark, lambda c: T.gate_allows(c, F.lit(kind), F.lit(how)), t)
    assert not allowed("see http://a.example and http://b.example")
    assert allowed("A short line of prose.")
    assert allowed("| 1 |", "table")
    assert allowed("x", how="vision")
    assert allowed("[DOC SUMMARY: a]")


def test_guardrail(spark):
    text = "SSN 123-45-6789, mail a.b@example.com, call (555) 123-4567, card 4111 1111 1111 1111."
    got = one(spark, T.guardrail, text)
    assert got["text"] == "SSN [REDACTED-SSN], mail [REDACTED-EMAIL], call ([REDACTED-PHONE], card [REDACTED-CREDIT_CARD]."
    assert not got["blocked"] and set(got["reasons"]) == {"pii:SSN", "pii:EMAIL", "pii:PHONE", "pii:CREDIT_CARD"}
    assert one(spark, lambda c: T.guardrail(c, ["Secret"]), "a secret thing")["blocked"]


def test_grounding(spark):
    rows = spark.createDataFrame([("It was 1,234 in 2023 [1], then 77.", "the count 1234 was given")], "a string, c string")
    assert rows.select(T.unsupported_numbers(F.col("a"), F.col("c"))).first()[0] == ["77"]
    assert one(spark, T.claims, "First thing said here. Second thing; no.\nThird thing said") == ["First thing said here.", "Second thing;", "Third thing said"]


def test_hash_embedding_is_the_number_modulo(spark):
    import hashlib

    for gram in ("abc", "cat_dog", "x1"):
        number = int(hashlib.md5(gram.encode()).hexdigest(), 16)
        slot, sign = spark.range(1).select(*V.hash_slot(F.lit(gram))).first()
        assert slot == number % 384 and sign == (1 if (number >> 8) & 1 == 0 else -1)


def test_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z"))).first()
    assert abs(got[0] - 1) < 1e-12 and got[1] == 0 and got[2] == [0.6, 0.8] and got[3] == [0.0, 0.0]


def test_metadata(spark):
    text = "Case No. AB-2022-001. On Mar 3, 2022 in Milwaukee, WI a Glock pistol was sold to Lake Shop and bought by John Miller of Texas."
    rows = spark.createDataFrame([(text, "text", ""), ("Total 2019 | 5", "table", "")], "text string, content_type string, document_date string")
    prose, grid = metadata.enrich(rows).orderBy(F.desc("content_type")).collect()[::-1][1], metadata.enrich(rows).where("content_type = 'table'").first()
    assert prose["document_date"] == "Mar 3, 2022" == prose["incident_date"]
    assert prose["location"] == "Milwaukee, WI" and prose["case_reference"] == "AB-2022-001"
    assert prose["us_state"] == "Texas" and prose["manufacturers"] == ["glock"] and prose["item_type"] == "glock"
    assert prose["sellers"] == ["Lake Shop"] and prose["buyers"] == ["John Miller"]
    assert grid["document_date"] == "2019" and grid["sellers"] == [] and grid["entities"] == []


def test_resolution(spark):
    names = ["Smith & Wesson", "Smith and Wesson Inc", "SMITH AND WESSON", "Smith and Weson", "Sturm Ruger", "Remington", "Remingten"]
    rows = spark.createDataFrame([(n, "maker", i) for i, n in enumerate(names)] + [("Remington", "buyer", 9)], "name string, type string, seq int")
    got = {(r["name"], r["type"]): r["canonical"] for r in resolution.resolve(rows).collect()}
    assert {got[n, "maker"] for n in names[:4]} == {"smith and wesson"}
    assert got["Remingten", "maker"] == "remington" and got["Sturm Ruger", "maker"] == "sturm ruger"
    relations = spark.createDataFrame([("Smith & Wesson", "Smith and Weson"), ("Remingten", "Sturm Ruger")], "src string, dst string")
    assert resolution.remap(relations, resolution.resolve(rows)).collect() == [("remington", "sturm ruger")]


def test_a_text_is_made_canonical_once_for_all_makers(spark):
    """The vocabulary's names look at one canonical text; each had made its own."""
    rows = spark.createDataFrame([("Sold by S&W, Inc. and Sig Sauer in West Virginia, not Virginia",)], "text string")
    found = rows.select(metadata.makers(F.col("text"), metadata.MAKERS).alias("m"), metadata.state(F.col("text"), metadata.STATES).alias("s"), T.vocabulary_hits(F.col("text"), metadata.ITEM_TYPES).alias("i"))
    assert found.first() == (["sig sauer", "smith and wesson"], "West Virginia", [])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|incorporated|") == 1


def test_states_are_found_as_by_a_list_longest_first(spark):
    names = ["ab", "abc", "abc d", "b", "new b", "new"]
    texts = ["abc d", "abc de", "x abcd ab", "new b", "new bb", "zab", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = re.compile(r"\b(" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + r")\b")
    expected = [(m.group(1) if (m := plain.search(t)) else "").title() for t in texts]
    assert [r[0] for r in rows.select(metadata.state(F.col("text"), names)).collect()] == expected


def test_embeddings_leave_a_task_in_small_batches(spark):
    """A batch of 10,000 texts had been held as lists of dictionaries, one for each slot."""
    texts = [(i, None if i % 50 == 7 else f"word{i} of the text number{i % 9}") for i in range(1000)]
    rows = V.hash_embedding(spark.createDataFrame(texts, "id long, t string").coalesce(1), "id", "t")
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    expected = {(i, k, w) for i, t in texts for k, w in V.sparse_embedding(t, V.DIM, {})}
    assert {tuple(r) for r in rows.collect()} == expected
    dense = spark.createDataFrame(texts, "id long, t string").select("id", V.embedding(F.col("t")).alias("v")).collect()
    assert {(r["id"], k, w) for r in dense for k, w in enumerate(r["v"]) if w} == expected


def test_vectors_of_texts_are_hashed_together(monkeypatch):
    """A text's grams are hashed in one go, whatever is remembered: the sums are those of the plain sum over grams."""
    from hashlib import md5

    monkeypatch.setattr(V, "KNOWN_GRAMS", 3)
    known = {}
    for text in ("Alpha beta alpha beta gamma", "gamma delta epsilon zeta", "", None, "the of", "naïve ÉTÉ x_1"):
        words, want = V.content_words(text), [0] * V.DIM
        for gram in [*words, *[f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]]:
            h = int(md5(gram.encode()).hexdigest(), 16)
            want[h % V.DIM] += -1 if h >> 8 & 1 else 1
        norm = sum(v * v for v in want) ** 0.5
        assert V.text_vector(text, V.DIM, known).tolist() == [v / norm if norm else 0 for v in want]
