import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import search as Q
from codeloom.operators.ranking import Cell


def shuffled_rows(spark):
    """Rows that all stages so far wrote to shuffles."""
    gateway = spark.sparkContext._gateway
    kept = spark.sparkContext._jsc.sc().statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(kept.apply(i).shuffleWriteRecords() for i in range(kept.size()))


def brute(docs, queries, limit):
    """``docs``: id and words; of each query the first nodes by rank and id, as the SQL has them."""
    found, mean = {}, sum(len(w) for _, w in docs) / max(1, len(docs))
    for term in {t for _, t in queries}:
        found[term] = {}
        for i, words in docs:
            if n := sum(w.startswith(term) for w in words):
                found[term][i, len(words)] = found[term].get((i, len(words)), 0) + n
    ranks = {}
    for query, term in queries:
        df = len(found[term])
        idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
        for (i, n), tf in found[term].items():
            own = ranks.setdefault(query, {})
            own[i] = own.get(i, 0) + idf * tf * (Q.K1 + 1) / (tf + Q.K1 * (1 - Q.B + Q.B * n / mean))
    return {(q, i, rank) for q, own in ranks.items() for rank, i in sorted((round(-s, 6), i) for i, s in own.items())[:limit]}


def test_pairs_of_queries_and_nodes_are_not_shuffled(spark):
    """bm25_documents: rows that meet grow with queries and with nodes, not with their product (300 queries x 2,000 nodes x 3 terms)."""
    index = Q.postings(spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("lattice cache route").alias("name")), ["name"])
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("lattice"), F.lit("cache"), F.lit("rou"))).alias("term"))
    before = shuffled_rows(spark)
    got = Q.bm25_many(index, queries, 5).collect()
    assert len(got) == 300 * 5 and {r["node_id"] for r in got} == {"0", "1", "10", "100", "1000"}
    assert shuffled_rows(spark) - before < 100_000


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_cells_and_blocks_give_the_result_of_all_pairs(spark, monkeypatch, limit):
    rng = random.Random(limit)
    vocabulary = ["la", "lattice", "lattices", "cache", "cachet", "on", "one", "ünder", "日本", "x1"]
    docs = [(f"n{i}", [rng.choice(vocabulary[: rng.choice([2, 5, 10])]) for _ in range(rng.randint(1, 9))]) for i in range(200)]
    docs += [(f"n{i}", words) for i, words in enumerate(words for _, words in docs[:30])]  # ids with equal documents and with others
    docs += [(f"n{i}", ["la"]) for i in range(5)]
    queries = sorted({(q, rng.choice(["la", "lat", "cache", "on", "ü", "日", "none", "x"])) for q in range(20) for _ in range(4)})
    nodes = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [("empty", ""), ("null", None)], "id string, name string")
    asked = spark.createDataFrame([*queries, (99, "none")], "query_id bigint, term string")
    want = brute(docs, queries, limit)
    monkeypatch.setattr(Q, "NODES_PER_CELL", 30)
    monkeypatch.setattr(Q, "TERMS_PER_BLOCK", 20)
    for rows in (None, 1):
        got = Q.bm25_many_texts(nodes, ["name"], asked, limit, rows).collect()
        assert len(got) == len(want) and {(r["query_id"], r["node_id"], round(r["rank"], 6)) for r in got} == want
    index = Q.postings(nodes.limit(200), ["name"])  # postings keep no repeats of a document
    got = Q.bm25_many(index, asked, limit).collect()
    want = brute(docs[:200], queries, limit)
    assert len(got) == len(want) and {(r["query_id"], r["node_id"], round(r["rank"], 6)) for r in got} == want


def test_no_nodes_and_no_queries(spark):
    nodes = spark.createDataFrame([("1", "lattice")], "id string, name string")
    asked = spark.createDataFrame([(1, "lattice"), (2, "")], "query_id bigint, term string")
    assert [r["query_id"] for r in Q.bm25_many_texts(nodes, ["name"], asked).collect()] == [1]
    assert Q.bm25_many_texts(nodes.limit(0), ["name"], asked).count() == 0 and Q.bm25_many_texts(nodes, ["name"], asked.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_of_a_cell_with_ties(seed):
    """Rare and frequent terms, scores on a coarse grid so that many nodes tie."""
    rng = np.random.default_rng(seed)
    n, own = 5000, {}
    for t in range(25):
        at = np.sort(rng.choice(n, int(rng.choice([40, 300, 2500])), replace=False))
        s = rng.choice([0.25, 0.5, 1.0], len(at)) * 40 / len(at) ** 0.5 + rng.choice([0, 4e-7], len(at))
        own[f"t{t}"] = (at, s)
    cell = object.__new__(Cell)
    cell.n, cell.stored, cell.scores, acc = n, {}, dict(own), np.zeros(n)
    for limit in (1, 10, 50, 6000):
        whole = np.zeros(n)
        for at, s in own.values():
            whole[at] += s
        rounded = np.floor(whole * 1e6 + 0.5) / 1e6
        want = [i for i in np.lexsort((np.arange(n), -rounded)) if whole[i] > 0][:limit]
        found, ranks = cell.best([*own, "none"], [1.0] * 26, limit, acc)
        assert not acc.any() and list(found) == want and list(ranks) == list(rounded[want])
