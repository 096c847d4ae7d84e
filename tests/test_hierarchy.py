import random

import pytest

from pyspark.sql import functions as F

from codeloom.operators import hierarchy as H
from codeloom.operators.balance import LoadPlan
from codeloom.operators.hierarchy import descendants, hierarchy, rings

PLAN = LoadPlan(4, {})


def brute(links):
    parent = {}
    for i, p in links:
        if i is not None and (i not in parent or (p or "") > (parent[i] or "")):
            parent[i] = p
    out = {}
    for i in parent:
        path, seen, at = [i], {i}, parent[i]
        while at in parent and at not in seen:
            path.append(at)
            seen.add(at)
            at = parent[at]
        if at in seen:
            ring, x = [at], parent[at]
            while x != at:
                ring.append(x)
                x = parent[x]
            out[i] = ("ring", min(ring)) if i in ring else ("below_ring", None)
        else:
            out[i] = ("tree", path[::-1])
    return out


@pytest.mark.parametrize("seed,direct", [(1, 1_000), (2, 1_000), (3, 0)])
def test_against_brute_force(spark, monkeypatch, seed, direct):
    monkeypatch.setattr(H, "DIRECT", direct)
    monkeypatch.setattr(H, "PLANNED", 50 if seed == 2 else 1_000_000)
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(160)]
    links = []
    for k, i in enumerate(ids):
        links.append((i, rng.choice([None, "missing", ids[max(0, k - 1)], ids[max(0, k - 1)], ids[max(0, k - 2)], rng.choice(ids)])))
    links += [(f"c{i}", f"c{(i + 1) % 25}") for i in range(25)] + [("self", "self"), ("under", "self"), ("two", "owt"), ("owt", "two")]
    links += [("n5", "n4"), (None, "n1"), ("", None), ("child of empty", "")]
    df = spark.createDataFrame(links, "id string, parent_id string")
    want = brute(links)
    got = {r["id"]: r for r in hierarchy(df, PLAN).collect()}
    assert set(got) == set(want)
    for i, (state, path) in want.items():
        r = got[i]
        assert r["state"] == state, i
        if state == "tree":
            assert r["path"] == path and r["depth"] == len(path) - 1 and r["root"] == path[0]
        else:
            assert r["path"] is None and r["root"] is None and r["depth"] is None
    assert {(r["id"], r["cycle_id"]) for r in rings(df).collect()} == {(i, p) for i, (s, p) in want.items() if s == "ring"}
    pairs = {(r["id"], r["descendant"], r["distance"]) for r in descendants(hierarchy(df, PLAN)).collect()}
    assert pairs == {(a, i, len(p) - 1 - k) for i, (s, p) in want.items() if s == "tree" for k, a in enumerate(p[:-1])}


def test_long_chain_and_wide_root(spark):
    links = [("r", None)] + [(f"x{i}", f"x{i - 1}" if i else "r") for i in range(300)] + [(f"leaf{i}", "r") for i in range(400)]
    got = {r["id"]: r["depth"] for r in hierarchy(spark.createDataFrame(links, "id string, parent_id string"), PLAN).select("id", "depth").collect()}
    assert got["x299"] == 300 and got["leaf3"] == 1 and got["r"] == 0


def deep(spark, n):
    """A chain of ``n``, a circle of 500, and a hub with ``n`` children and grandchildren that hangs on the chain."""
    chain = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent_id"))
    circle = spark.range(500).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.concat(F.lit("r"), F.lpad(((F.col("id") + 1) % 500).cast("string"), 4, "0")).alias("parent_id"))
    hub = spark.range(n).select(F.concat(F.lit("h"), "id").alias("id"), F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("h"), F.col("id") - 1)).alias("parent_id"))
    return chain.unionByName(circle).unionByName(hub).unionByName(spark.createDataFrame([("hub", "c7")], "id string, parent_id string"))


def test_rings_beside_a_chain_of_100000_and_a_hub_of_half_the_nodes(spark):
    found = rings(deep(spark, 100_000)).agg(F.count("id").alias("n"), F.count_distinct("id").alias("d"), F.min("cycle_id").alias("a"), F.max("cycle_id").alias("b")).first()
    assert tuple(found) == (500, 500, "r0000", "r0000")


def test_depths_of_a_long_chain(spark):
    n = 10_000
    got = {r["k"]: (r["n"], r["low"], r["high"]) for r in hierarchy(deep(spark, n), PLAN, paths=False).groupBy(F.substring("id", 1, 1).alias("k")).agg(F.count("depth").alias("n"), F.min("depth").alias("low"), F.max("depth").alias("high")).collect()}
    assert got == {"c": (n, 0, n - 1), "r": (0, None, None), "h": (n + 1, 8, 10)}


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "id string, parent_id string, seg string, state int, at string")
    assert hierarchy(empty, PLAN).count() == 0 and rings(empty).count() == 0
    one = spark.createDataFrame([("a", "b", "s", 1, "t"), ("b", "a", "s", 1, "t")], empty.schema)
    assert {tuple(r) for r in rings(one).collect()} == {("a", "a"), ("b", "a")}
