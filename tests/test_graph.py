import random
from collections import defaultdict, deque

import pytest

from codeloom.operators import graph as G

EDGES = "source string, target string, type string, weight double"


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], EDGES)


def brute(pairs, seeds, depth):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    seen, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        x = queue.popleft()
        if seen[x] < depth:
            for y in near[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_is_shortest_distance(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(70)] + [("v1", "v1")]
    seeds = spark.createDataFrame([("v1",), ("v2",), ("alone",), (None,)], "id string")
    got = {r["id"]: r["depth"] for r in G.bfs(G.directed(edges(spark, pairs)), seeds, 6).collect()}
    assert got == brute(pairs, ["v1", "v2", "alone"], 6)


def test_parent_is_least_of_level_above(spark):
    found = G.bfs(G.directed(edges(spark, [("s", "b"), ("s", "a"), ("a", "t"), ("b", "t")])), spark.createDataFrame([("s",)], "id string"), 5)
    assert {r["id"]: r["parent"] for r in found.collect()}["t"] == "a"


def test_shortest_path(spark):
    links = G.symmetrised(edges(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("a", "x"), ("x", "c"), ("far", "away")]))
    ids = lambda p: [r["id"] for r in p.orderBy("seq").collect()]
    assert ids(G.shortest_path(links, "a", "d")) == ["a", "b", "c", "d"]
    assert ids(G.shortest_path(links, "a", "a")) == ["a"]
    assert ids(G.shortest_path(links, "a", "far")) == []
    assert ids(G.shortest_path(links, "a", "d", max_depth=2)) == []


def test_type_spellings(spark):
    df = spark.createDataFrame([("a", "b", t, 1.0) for t in ("import", "imports", "calls", "extends", "odd", None)], EDGES)
    kinds = lambda *t: sorted(r["type"] or "" for r in G.of_types(df, t).collect())
    assert kinds("IMPORTS") == ["import", "imports"] and kinds("call") == ["calls"] and kinds("odd") == ["odd"] and len(kinds()) == 6


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("q2", "q1"), ("q3", "q1"), ("z", "z")] + [(f"r{rng.randrange(9)}", f"r{rng.randrange(9)}") for _ in range(12)] + [(None, "a")]
    got = {r["id"]: r["component"] for r in G.components(G.directed(edges(spark, pairs))).collect()}
    assert got["p40"] == "p0" and got["q3"] == "q1" and got["z"] == "z"
    for a, b in pairs:
        if a is not None:
            assert got[a] == got[b] <= min(a, b)


def test_dependency_tree_budget_and_unknown_nodes(spark):
    e = edges(spark, [("s", f"n{i}") for i in range(5)] + [("n0", "deep"), ("s", "ghost"), ("ghost", "behind")]).union(edges(spark, [("s", "part")], "contains"))
    known = spark.createDataFrame([(x,) for x in ["s", *[f"n{i}" for i in range(5)], "deep", "behind", "part"]], "id string")
    seeds = spark.createDataFrame([("s",)], "id string")
    ids = lambda n: [r["id"] for r in G.dependency_tree(e, seeds, known, 3, n).collect()]
    assert sorted(ids(99)) == ["deep", "n0", "n1", "n2", "n3", "n4"] and ids(2) == ["n0", "n1"]


def test_empty(spark):
    none = edges(spark, [("a", "b")]).limit(0)
    seeds = spark.createDataFrame([("s",)], "id string")
    assert [r["id"] for r in G.bfs(G.directed(none), seeds, 3).collect()] == ["s"]
    assert G.bfs(G.directed(none), seeds.limit(0), 3).count() == 0 and G.components(G.directed(none)).count() == 0


def test_walks_of_their_own_and_hot_frontiers(spark, monkeypatch):
    monkeypatch.setattr(G, "SMALL_FRONTIER", 0)
    links = G.directed(edges(spark, [("hub", f"x{i}") for i in range(30)] + [("a", "hub"), ("b", "c"), ("c", "hub")]))
    seeds = spark.createDataFrame([("r1", "a"), ("r2", "b")], "repo_hash string, id string")
    got = {(r["repo_hash"], r["id"]): r["depth"] for r in G.bfs(links, seeds, 9, within=["repo_hash"]).collect()}
    assert len(got) == 32 + 33 and got["r1", "x3"] == 2 and got["r2", "x3"] == 3
    few = {(r["repo_hash"], r["id"]) for r in G.bfs(links, seeds, 9, most_nodes=2, within=["repo_hash"]).collect()}
    assert few == {("r1", "a"), ("r1", "hub"), ("r2", "b"), ("r2", "c")}


def test_chain_and_flow_have_their_edges(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "ghost"), ("z", "a")]).union(edges(spark, [("a", "part")], "contains"))
    known = spark.createDataFrame([(x,) for x in "abcdez"], "id string")
    nodes, ways = G.call_chain(e, known.filter("id = 'a'"), known, 2)
    assert {tuple(r) for r in nodes.collect()} == {("z", 1, "caller"), ("b", 1, "callee"), ("c", 2, "callee")}
    assert {(r["source"], r["target"]) for r in ways.collect()} == {("z", "a"), ("a", "b"), ("b", "c"), ("b", "ghost")}
    entries = spark.createDataFrame([("r", "a")], "repo_hash string, id string")
    found, ways = G.execution_flow(e, entries, 3)
    assert {(r["id"], r["depth"]) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2), ("ghost", 2), ("d", 3)}
    assert {(r["source"], r["target"]) for r in ways.collect()} == {("a", "b"), ("b", "c"), ("b", "ghost"), ("c", "d")}
    found, ways = G.execution_flow(e, entries, 3, most_nodes=2)
    assert {r["id"] for r in found.collect()} == {"a", "b"} and {(r["source"], r["target"]) for r in ways.collect()} == {("a", "b")}


def test_tree_upwards_and_truncated(spark):
    e = edges(spark, [("a", "s"), ("b", "s"), ("c", "b")])
    known = spark.createDataFrame([(x,) for x in "abcs"], "id string")
    seeds = known.filter("id = 's'")
    got = {(r["id"], r["truncated"]) for r in G.dependency_tree(e, seeds, known, 3, 9, reverse=True).collect()}
    assert got == {("a", False), ("b", False), ("c", False)}
    assert {tuple(r)[3] for r in G.dependency_tree(e, seeds, known, 3, 3, reverse=True).collect()} == {True}
