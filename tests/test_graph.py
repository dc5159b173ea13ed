import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.operators import audit, graph


def relations(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, dst string, rel string, chunk_id string, weight int, description string, seq int")


def edges_of(spark, rows):
    return graph.aggregate_edges(relations(spark, [(a, b, rel, f"c{i}", w, "") for i, (a, b, rel, w) in enumerate(rows)])).persist()


def test_typed_relations_upgrade_and_weights_add(spark):
    got = graph.aggregate_edges(relations(spark, [("A b", "C", "co_occurs", "1", 1, "x"), ("a  B", "c", "SOLD_BY", "2", 2, "longer"), ("C", "C", "X", "3", 1, "")])).collect()
    assert [(r["src"], r["dst"], r["rel"], r["weight"], r["typed"], r["n_chunks"], r["description"]) for r in got] == [("a b", "c", "SOLD_BY", 3, True, 2, "longer")]


def test_nodes(spark):
    rows = [("Acme Arms", "entity", "1", "pdf", "", 0), ("acme arms", "maker", "2", "web", "makes things", 1), ("Sunday", "entity", "1", "pdf", "", 2)]
    mentions = spark.createDataFrame(rows, "name string, type string, chunk_id string, corpus string, description string, seq int")
    got = graph.aggregate_nodes(mentions).collect()
    assert sorted(map(tuple, graph.node_chunks(mentions.union(mentions)).collect())) == [("acme arms", "1"), ("acme arms", "2")]
    assert [(r["key"], r["label"], r["type"], r["count"], r["n_chunks"], r["corpora"], r["description"]) for r in got] == [("acme arms", "Acme Arms", "maker", 2, 2, ["pdf", "web"], "makes things")]


def test_cooccurrence_skips_typed_pairs(spark):
    chunks = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["a"]), ("3", [])], "chunk_id string, names array<string>")
    typed = spark.createDataFrame([("1", "b", "a")], "chunk_id string, src string, dst string")
    assert {(r["src"], r["dst"]) for r in graph.cooccurrences(chunks, typed=typed).collect()} == {("a", "c"), ("b", "c")}


def test_pruning_removes_only_the_obscure_weak_edge(spark):
    noisy = [("hub", x, "co_occurs", 2) for x in "xyz"] + [("hub", "t", "SOLD_BY", 1), ("lone1", "lone2", "co_occurs", 1)]
    edges = edges_of(spark, noisy)
    kept = {(r["src"], r["dst"]) for r in graph.prune_edges(edges).collect()}
    assert kept == {("hub", x) for x in "xyzt"}
    assert graph.prune_edges(edges, keep_typed=False).count() == 4  # the hub is not obscure
    assert [r["node"] for r in graph.hub_nodes(edges, 90).collect()] == ["hub"]


def test_walks(spark):
    edges = edges_of(spark, [("a", "b", "R1", 1), ("c", "b", "R2", 1), ("c", "d", "co_occurs", 1), ("d", "e", "R3", 1), ("e", "f", "R4", 1), ("x", "y", "R", 1)])
    seeds = spark.createDataFrame([("a",)], "seed string")
    hops = lambda **k: {(r["node"], r["hops"]) for r in graph.within_hops(edges, seeds, **k).collect()}
    assert hops(hops=2) == {("a", 0), ("b", 1), ("c", 2)}
    assert hops(hops=5, typed_only=True) == {("a", 0), ("b", 1), ("c", 2)}
    pairs = spark.createDataFrame([("a", "d"), ("a", "e"), ("a", "f"), ("a", "x"), ("a", "a")], "src string, dst string")
    paths = graph.shortest_paths(edges, pairs)
    assert {(r["dst"], tuple(r["path"])) for r in paths.collect()} == {("a", ("a",)), ("d", tuple("abcd")), ("e", tuple("abcde"))}
    text = {r["dst"]: r["text"] for r in graph.label_paths(paths, edges).collect()}
    assert text["d"] == "a --R1--> b --R2--> c --co_occurs--> d"


def test_pagerank_against_dense_iteration(spark):
    rng = np.random.default_rng(0)
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 12, (25, 2)).tolist() if p[0] != p[1]})
    weights = rng.integers(1, 5, len(pairs)).astype(float)
    edges = spark.createDataFrame([(str(a), str(b), float(w)) for (a, b), w in zip(pairs, weights, strict=True)], "a string, b string, weight double")
    seeds = spark.createDataFrame([(str(pairs[0][0]),), ("unknown",)], "node string")
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges, seeds, rounds=40, tolerance=0).collect()}
    names = sorted(got)
    m = np.zeros((len(names), len(names)))
    for (a, b), w in zip(pairs, weights, strict=True):
        i, j = names.index(str(a)), names.index(str(b))
        m[i, j] += w
        m[j, i] += w
    m /= m.sum(axis=1, keepdims=True)
    start = np.array([float(n == str(pairs[0][0])) for n in names])
    rank = start
    for _ in range(40):
        rank = 0.85 * rank @ m + 0.15 * start
    assert [got[n] for n in names] == pytest.approx(rank.tolist())
    assert graph.pagerank(edges, seeds.where("node = 'unknown'")).count() == 0


def test_pagerank_settles_whatever_the_size(spark):
    """Many pairs beside one path: what a round may leave does not grow with the nodes, and a path takes more than twenty plain rounds."""
    n = 200_000
    pairs = spark.range(n).select(F.concat(F.lit("p"), "id").alias("a"), F.concat(F.lit("q"), "id").alias("b"), F.lit(1.0).alias("weight"))
    path = spark.range(60).select(F.format_string("w%03d", "id").alias("a"), F.format_string("w%03d", F.col("id") + 1).alias("b"), (1.0 + F.col("id") % 3).alias("weight"))
    seeds = spark.createDataFrame([("w000",)], "node string")
    got = {r["node"]: r["rank"] for r in graph.pagerank(pairs.unionByName(path), seeds).where("rank <> 0").collect()}
    m = np.zeros((61, 61))
    for i in range(60):
        m[i, i + 1] = m[i + 1, i] = 1.0 + i % 3
    want = np.linalg.solve(np.eye(61) - 0.85 * (m / m.sum(axis=1, keepdims=True)).T, 0.15 * np.eye(61)[0])
    assert [got.get(f"w{i:03d}", 0.0) for i in range(61)] == pytest.approx(want.tolist(), rel=0, abs=5e-10) and all(k[0] == "w" for k in got)
    mine = graph.personal_pagerank(pairs.unionByName(path), seeds.withColumn("query_id", F.lit(7))).collect()
    assert {r["node"]: r["rank"] for r in mine if abs(r["rank"]) > 1e-9} == pytest.approx({k: v for k, v in got.items() if abs(v) > 1e-9}, rel=0, abs=5e-10)


def test_communities_of_two_cliques(spark):
    clique = lambda names: [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = clique([f"a{i}" for i in range(6)]) + clique([f"b{i}" for i in range(6)]) + [("a0", "b0", 1.0), ("z1", "z2", 1.0)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    found = graph.communities(edges)
    got = {}
    for r in found.collect():
        got.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(len, got.values())) == [6, 6] and set(got) == {"a0", "b0"}
    assert graph.modularity(edges, found) > graph.modularity(edges, graph.components(edges).withColumnRenamed("component", "community"))
    assert {r["component"] for r in graph.components(edges).collect()} == {"a0", "z1"}


def test_communities_of_a_planted_graph(spark):
    rng = random.Random(3)
    group = lambda i: i // 20
    rows = [(f"{i:03d}", f"{j:03d}", 1.0) for i in range(160) for j in range(i) if rng.random() < (0.5 if group(i) == group(j) else 0.01)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    found = graph.communities(edges)
    planted = spark.createDataFrame([(f"{i:03d}", str(group(i))) for i in range(160)], "node string, community string")
    assert graph.modularity(edges, found) >= graph.modularity(edges, planted) - 0.01
    kept = {tuple(r) for r in found.collect()}
    assert len({n for n, _ in kept}) == len(kept) == 160 and kept == {tuple(r) for r in graph.communities(edges.repartition(7)).collect()}
    triples = spark.createDataFrame([(f"{k}{x}", f"{k}{y}", 1.0) for k in "cdefgh" for x, y in ("12", "13", "23")], "a string, b string, weight double")
    assert {r["community"] for r in graph.communities(triples).collect()} == {f"{k}1" for k in "cdefgh"}


def test_briefs_and_stats(spark):
    edges = edges_of(spark, [("dealer", "incident", "LINKED", 2), ("dealer", "buyer", "SOLD_TO", 3)])
    nodes = spark.createDataFrame([(k, k.title(), "entity", c, 1) for k, c in (("dealer", 5), ("incident", 2), ("buyer", 1))], "key string, label string, type string, count int, n_chunks int")
    of_nodes = spark.createDataFrame([("dealer", f"c{i:02d}") for i in range(40)] + [("buyer", "x")], "key string, chunk_id string")
    members = spark.createDataFrame([(k, "buyer") for k in ("dealer", "incident", "buyer")], "node string, community string")
    brief = graph.community_briefs(members, nodes, edges)
    row = brief.first()
    assert row["name"] == "Dealer, Incident, Buyer" and row["n_members"] == 3 and len(row["relations"]) == 2 and row["n_chunks"] == 3
    assert graph.relevant_communities(brief, "what about the dealer").count() == 1 and graph.relevant_communities(brief, "zebra").count() == 0
    stats = graph.community_stats(spark.createDataFrame([(10,), (4,)], "n int")).first()
    assert (stats["n"], stats["max"], stats["mean"]) == (2, 10, 7.0)
    assert graph.find_nodes(nodes, spark.createDataFrame([("Deal",), ("buyer",)], "term string")).orderBy("term").collect() == [("Deal", "dealer"), ("buyer", "buyer")]
    assert graph.attached(edges, nodes).count() == 2 and graph.attached(edges, nodes.where("key <> 'buyer'")).count() == 1
    left, rest = graph.remove_nodes(nodes, edges, spark.createDataFrame([("buyer",)], "key string"))
    assert left.count() == 2 and rest.count() == 1
    top, inside = graph.export_graph(nodes, edges, members, of_nodes, 2)
    assert {r["key"]: len(r["chunks"]) for r in top.collect()} == {"dealer": 25, "buyer": 1} and inside.count() == 1
    assert audit.graph_quality(nodes, edges).first()["verdict"] == "ok"


def test_empty_graph(spark):
    none = edges_of(spark, [("a", "a", "R", 1)])
    assert none.count() == 0 and graph.degrees(none).count() == 0 and graph.prune_edges(none).count() == 0
    assert graph.components(none.select(F.col("src").alias("a"), F.col("dst").alias("b"))).count() == 0


def reach(start, links):
    seen, todo = {start}, [start]
    while todo:
        for other in links.get(todo.pop(), ()):
            if other not in seen:
                seen.add(other)
                todo.append(other)
    return seen


def test_every_community_of_every_level_is_connected(spark):
    """A chain of cliques and a random graph: levels nest, communities hold together, modularity is not below the parts'."""
    rng = random.Random(9)
    rows = [(f"{k:02d}{i}", f"{k:02d}{j}", 1.0) for k in range(12) for i in range(4) for j in range(i)] + [(f"{k:02d}0", f"{k + 1:02d}3", 1.0) for k in range(11)]
    rows += [(f"r{rng.randint(0, 40):02d}", f"r{rng.randint(0, 40):02d}", float(rng.randint(1, 3))) for _ in range(60)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    found = graph.hierarchy(edges).collect()
    levels = {}
    for r in found:
        levels.setdefault(r["level"], {})[r["node"]] = r["community"]
    assert sorted(levels) == list(range(len(levels))) and len(levels) >= 2
    for k, labels in levels.items():
        assert set(labels) == {x for a, b, _ in rows for x in (a, b)}
        links = {}
        for a, b, _ in rows:
            if labels[a] == labels[b]:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
        for name in set(labels.values()):
            members = {n for n, c in labels.items() if c == name}
            assert name in members and reach(name, links) == members
        if k:
            below = levels[k - 1]
            assert all(labels[n] == labels[below[n]] for n in labels)
    of = lambda labels: graph.modularity(edges, spark.createDataFrame(list(labels.items()), "node string, community string"))
    scores = [of(levels[k]) for k in sorted(levels)]
    parts = graph.modularity(edges, graph.components(edges).withColumnRenamed("component", "community"))
    assert scores == sorted(scores) and scores[-1] > parts


def test_torn_communities_are_split(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("b", "e", 1.0), ("f", "f", 1.0)], "a string, b string, weight double")
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "y"), ("f", "x")], "node string, community string")
    assert {tuple(r) for r in graph._connected(edges, labels).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "f")}


def test_nodes_are_found_without_a_nested_loop(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(0, 5))).strip()
    key = lambda t: " ".join(t.lower().split())
    for more in ([], [""]):
        keys, terms = sorted({key(word()) for _ in range(40)} - {""}) + more, sorted({word() + rng.choice(["", "A", " xyz"]) for _ in range(60)})
        found = graph.find_nodes(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(t,) for t in [*terms, None]], "term string"))
        want = {}
        for t in terms:
            fits = [k for k in keys if k in key(t) or key(t) in k]
            if fits:
                want[t] = key(t) if key(t) in fits else min(fits)
        assert {r["term"]: r["key"] for r in found.collect()} == want


def test_paths_are_sought_from_both_ends(spark, monkeypatch):
    """What is written for a pair lies within half of the way; from one end alone all leaves of the hub were reached."""
    links = [("s", "a"), ("a", "hub"), ("hub", "b"), ("b", "d"), ("s", "c"), ("c", "hub")] + [("hub", f"leaf {i}") for i in range(300)]
    edges = spark.createDataFrame(links, "src string, dst string")
    pairs = spark.createDataFrame([("s", "d"), ("d", "s"), ("a", "c"), ("s", "s"), ("s", "nowhere"), ("leaf 1", "d")], "src string, dst string")
    plain, sizes = graph.materialise, []

    def watched(df, label="step"):
        out = plain(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialise", watched)
    found = {(r["src"], r["dst"]): r["path"] for r in graph.shortest_paths(edges, pairs.where("src <> 'leaf 1'")).collect()}
    assert found == {("s", "d"): ["s", "a", "hub", "b", "d"], ("d", "s"): ["d", "b", "hub", "a", "s"], ("a", "c"): ["a", "hub", "c"], ("s", "s"): ["s"]}
    assert max(sizes[1:]) < 20
    assert graph.shortest_paths(edges, pairs.where("src = 'leaf 1'"), 3).first()["path"] == ["leaf 1", "hub", "b", "d"]
    assert graph.shortest_paths(edges, pairs.where("src = 'leaf 1'"), 2).isEmpty()


def test_relations_between_numbers_and_counted_mentions(spark):
    """Keys may be numbers, which are named after aggregation, and a row may stand for many mentions."""
    rows = [(1, 2, "co_occurs", 7, 1, "", 7), (1, 2, "co_occurs", 8, 1, "", 8), (3, 3, "co_occurs", 8, 1, "", 8)]
    relations = spark.createDataFrame(rows, "src long, dst long, rel string, chunk_id long, weight int, description string, seq long")
    assert [(r["src"], r["dst"], r["weight"], r["n_chunks"]) for r in graph.aggregate_edges(relations, keys=True).collect()] == [(1, 2, 2, 2)]
    mentions = spark.createDataFrame([("Acme Arms", "seller", 1, "c", "", 1, 3), ("acme arms", "seller", 2, "c", "", 2, 4)], "name string, type string, chunk_id long, corpus string, description string, seq long, n long")
    assert [(r["key"], r["count"], r["n_chunks"]) for r in graph.aggregate_nodes(mentions).collect()] == [("acme arms", 7, 2)]


def test_tasks_follow_the_rows(spark):
    from docgrain.session import dealt

    rows = spark.range(1000).coalesce(1)
    assert dealt(rows, "id", n=1000, most=50).rdd.getNumPartitions() == 20
    assert dealt(rows, "id", n=1000).rdd.getNumPartitions() == 4
