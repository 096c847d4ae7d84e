import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import analytics as A

EDGES = "source string, target string, type string, weight double"


def test_degrees_and_tiers(spark):
    e = spark.createDataFrame([("hub", f"n{i}", "calls", 1.0) for i in range(19)] + [("n1", "n1", "calls", 1.0), (None, "n2", "calls", 1.0)], EDGES)
    d = {r["id"]: tuple(r)[1:] for r in A.degrees(e).select("id", "in_degree", "out_degree", "degree").collect()}
    assert d["hub"] == (0, 19, 19) and d["n1"] == (2, 1, 3) and d["n2"] == (2, 0, 2)
    t = {r["id"]: r["tier"] for r in A.tiers(A.degrees(e)).collect()}
    # 20 degrees: 17 ones, 2, 3, 19; nearest ranks: 95 % is the 19th (3), 80 % the 16th (1), 50 % the 10th (1)
    assert t["hub"] == "god" and t["n1"] == "high" and t["n2"] == "high" and t["n5"] == "low"
    assert A.tiers(A.degrees(e.limit(0))).count() == 0


@pytest.mark.parametrize("path,want", [("packages/ui/src/a.ts", "packages/ui"), ("x/packages/extensions/go/a.ts", "packages/extensions/go"), ("src/core/a.ts", "src/core"), ("tools/a.ts", "tools"), ("a.ts", "root"), ("apps/web/a/b.ts", "apps/web")])
def test_area(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(A.area(F.col("p"))).first()[0] == want


def test_domain(spark):
    df = spark.createDataFrame([("server/a/b.ts",), ("tools/x/y.ts",), ("tools/x.ts",), ("lib/q.ts",)], "p string")
    got = [r[0] for r in df.select(A.domain(F.col("p"), [("Server", "server/**"), ("T", "tools/*")])).collect()]
    assert got == ["Server", "Tools", "T", "Lib"]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight double")


def test_communities_split_two_cliques(spark):
    strong = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    p = pairs(spark, [(*e, 8.0) for e in strong] + [("c", "x", 0.1)])
    nodes = spark.createDataFrame([(i,) for i in ["a", "b", "c", "x", "y", "z", "isolated"]], "id string")
    got = {r["id"]: r["community"] for r in A.communities(p, nodes).collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"] and got["isolated"] == "isolated"
    again = {r["id"]: r["community"] for r in A.communities(p.orderBy(F.desc("a")), nodes.orderBy(F.desc("id"))).collect()}
    assert got == again


def test_communities_go_on_until_no_merge_gains(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(99)]
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(100)], "id string")
    got = {r["id"]: r["community"] for r in A.communities(pairs(spark, links), nodes).collect()}
    degree, between, m2 = {}, {}, 2.0 * len(links)
    for a, b, w in links:
        for x in (a, b):
            degree[got[x]] = degree.get(got[x], 0.0) + w
        if got[a] != got[b]:
            between[got[a], got[b]] = between.get((got[a], got[b]), 0.0) + w
    assert between and all(w <= degree[a] * degree[b] / m2 + 1e-6 for (a, b), w in between.items())
    assert all(got[c] == c and c <= i for i, c in got.items())


def test_communities_fall_into_connected_parts(spark):
    member = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "a"), ("x", "x")], "id string, community string")
    got = {r["id"]: r["community"] for r in A.connected_parts(member, pairs(spark, [("a", "b", 1.0), ("c", "d", 1.0), ("e", "x", 1.0)])).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "x": "x"}


def test_communities_of_nothing(spark):
    nodes = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in A.communities(pairs(spark, [("a", "a", 1.0)]).limit(0), nodes).collect()] == [("a", "a")]


def test_pair_weights(spark):
    e = spark.createDataFrame([("f1", "g1", "calls", 4.0), ("g1", "f1", "return-type", None), ("f1", "f2", "calls", 1.0), ("f1", "g1", "contains", 1.0)], EDGES)
    files = spark.createDataFrame([("f1", "f"), ("f2", "f"), ("g1", "g")], "id string, file_path string")
    areas = spark.createDataFrame([("f", "x"), ("g", "x"), ("h", "y")], "file_path string, area string")
    got = [tuple(r) for r in A.file_pair_weights(e, files, areas).collect()]
    assert got == [("f", "g", pytest.approx(3 * 3 + 1 + 0.35))]


def test_summary(spark):
    m = spark.createDataFrame([("a", "1", "low"), ("b", "1", "god"), ("c", "2", None)], "id string, community string, tier string")
    e = spark.createDataFrame([("a", "b", "calls", 1.0), ("b", "c", "calls", 1.0), ("c", "nobody", "calls", 1.0)], EDGES)
    got = {r["community"]: (r["size"], r["touching"], r["internal"], r["cohesion"], r["top_nodes"]) for r in A.community_summary(m, e).collect()}
    assert got == {"1": (2, 2, 1, 0.5, "b,a"), "2": (1, 1, 0, 0.0, "c")}


def test_entries_by_name_then_by_callers(spark):
    n = spark.createDataFrame(
        [("1", "r", "function_declaration", None, "low", "r/main.ts", 9), ("2", "r", "class_declaration", None, " God ", "r/main.ts", 20), ("3", "r", "function_declaration", None, "god", "r/x.ts", 1), ("4", "r", "module", None, "god", "r/main.ts", 1), ("5", "r", "function_declaration", "2", "god", "r/main.ts", 1),
         ("6", "q", "function_declaration", None, "high", "q/a.ts", 1), ("7", "q", "function_declaration", None, "god", "q/b.ts", 1), ("8", "q", "function_declaration", None, "god", "q/c.ts", 1), ("9", None, "function_declaration", None, "god", "q/c.ts", 1)],
        "id string, repo_hash string, kind string, parent_id string, hierarchy_level string, file_path string, line_start int",
    )
    calls = spark.createDataFrame([("8",), (None,)], "target string")
    assert sorted(map(tuple, A.entry_nodes(n, calls).collect())) == [("q", "6", "no-callers", 2), ("q", "7", "no-callers", 1), ("r", "1", "entry-file", 2), ("r", "2", "entry-file", 1)]
    assert A.entry_nodes(n, calls, 1).count() == 2 and A.entry_nodes(n.limit(0), calls).count() == 0


def sequential_modularity(weights, nodes):
    """Louvain's first level, one node after the other, and the modularity of what it gives."""
    near = {v: {} for v in nodes}
    for (a, b), w in weights.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    total = 2 * sum(weights.values())
    degree = {v: sum(near[v].values()) for v in nodes}
    own = {v: v for v in nodes}
    size = dict(degree)
    moved = True
    while moved:
        moved = False
        for v in sorted(nodes):
            size[own[v]] -= degree[v]
            links = {}
            for u, w in near[v].items():
                links[own[u]] = links.get(own[u], 0) + w
            best = max([own[v], *sorted(links)], key=lambda c: links.get(c, 0) - degree[v] * size[c] / total)
            if links.get(best, 0) - degree[v] * size[best] / total <= links.get(own[v], 0) - degree[v] * size[own[v]] / total + 1e-12:
                best = own[v]
            moved |= best != own[v]
            own[v] = best
            size[best] += degree[v]
    return modularity(weights, own)


def modularity(weights, own):
    total, inside, degree = sum(weights.values()), 0.0, {}
    for (a, b), w in weights.items():
        inside += w * (own[a] == own[b])
        for v in (a, b):
            degree[own[v]] = degree.get(own[v], 0) + w
    return inside / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def test_modularity_is_that_of_a_sequential_run(spark):
    rng = random.Random(5)
    names = [f"v{g}{i}" for g in range(6) for i in range(8)]
    weights = {}
    for a in names:
        for b in names:
            if a < b and rng.random() < (0.5 if a[1] == b[1] else 0.04):
                weights[a, b] = float(rng.randrange(1, 4))
    found = A.communities(pairs(spark, [(a, b, w) for (a, b), w in weights.items()]), spark.createDataFrame([(v,) for v in names], "id string"))
    own = {r["id"]: r["community"] for r in found.collect()}
    assert modularity(weights, own) >= sequential_modularity(weights, names) - 0.01
