import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.operators import balance as B
from codeloom.operators.balance import PARTS, LoadPlan, balanced_join, balanced_totals, frequent_values, keyed_rows, load_plans, pack


@given(st.dictionaries(st.text(min_size=1, max_size=3), st.integers(1, 10_000), max_size=30), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_pack_places_every_shard_in_its_own_task(loads, tasks):
    total = sum(loads.values()) + 500
    slots = pack(loads, total, tasks)
    assert set(slots) == set(loads)
    for key, own in slots.items():
        assert len(own) == len(set(own)) <= tasks and all(0 <= t < tasks for t in own)
        assert loads[key] / len(own) <= max(1, total / tasks) / PARTS or len(own) == tasks


def test_pack_evens_out_load():
    loads = {"a": 400, "b": 300, "c": 100, "d": 100, "e": 100}
    at = Counter()
    for key, own in pack(loads, 1000, 5).items():
        for t in own:
            at[t] += loads[key] / len(own)
    assert max(at.values()) <= 200 * (1 + 1 / PARTS)


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(4)
    data = [("hot", 1.0)] * 500 + [(f"k{random.randrange(60)}", float(i)) for i in range(400)] + [(None, 2.0)] * 300 + [("", None)] * 5
    return data, spark.createDataFrame(data, "key string, w double").repartition(6)


def test_totals_equal_brute_force(spark, rows):
    data, df = rows
    plan = load_plans(df, ["key"])["key"]
    assert len(plan.slots["hot"]) > 1
    got = {r["key"]: (r["n_rows"], r["s"]) for r in balanced_totals(df, "key", {"s": F.col("w")}, plan).collect()}
    want = {}
    for k, w in data:
        n, s = want.get(k, (0, None))
        want[k] = (n + 1, s if w is None else (s or 0) + w)
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, rows, how):
    _, df = rows
    right = spark.createDataFrame([("hot", 1, "x"), ("k1", 2, "y"), ("k1", 3, "z"), ("absent", 4, "q"), (None, 5, "n")], "key string, v int, w string")
    plan = load_plans(df, ["key"])["key"]
    got = balanced_join(df, right, "key", plan, how)
    want = df.join(right.withColumnRenamed("w", "w_right"), "key", how)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_join_refuses_outer_sides(spark, rows):
    with pytest.raises(ValueError):
        balanced_join(rows[1], rows[1], "key", LoadPlan(2, {}), "full")


def test_clashing_internal_names(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "key string, n_rows int, share string")
    plan = load_plans(df, ["key"])["key"]
    assert [tuple(r) for r in balanced_totals(df, "key", {}, plan).collect()] == [("a", 2)]
    assert balanced_join(df, df.withColumn("extra", F.lit(1)), "key", plan).columns == ["key", "n_rows", "share", "n_rows_right", "share_right", "extra"]


def test_frequent_values_and_empty_tables(spark, rows):
    _, df = rows
    keyed = keyed_rows(df, ["key", "w"], "t")
    got = frequent_values(keyed, 0.2, load_plans(keyed, ["field_key"])["field_key"]).collect()
    assert sorted((r["field_name"], r["key_value"], r["n_rows"]) for r in got) == [("t.key", "hot", 500), ("t.w", "1.0", 501), ("t.w", "2.0", 301)]
    empty = df.limit(0)
    plan = load_plans(empty, ["key"])["key"]
    assert plan.slots == {}
    assert balanced_totals(empty, "key", {}, plan).count() == 0
    assert frequent_values(keyed_rows(empty, ["key"], "t"), 0.02, plan).count() == 0
    assert balanced_join(empty, df.select("key"), "key", plan).count() == 0


def test_tasks_follow_the_data_and_rows_go_by_number(spark, rows, monkeypatch):
    _, df = rows
    monkeypatch.setattr(B, "TASK_BYTES", 2000)
    plan = load_plans(df, ["key"])["key"]
    assert plan.tasks > 40 and plan.rows == df.count() and len(plan.slots["hot"]) > 4
    totals = balanced_totals(df, "key", {}, plan)
    assert "REPARTITION_BY_NUM" in totals._jdf.queryExecution().executedPlan().toString()
    spread = balanced_join(df.withColumn("n", F.monotonically_increasing_id()), spark.createDataFrame([("hot", 1)], "key string, v int"), "key", plan, "left").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert spread <= 3 * df.count() / plan.tasks


def test_sums_of_whole_numbers_and_kept_columns(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", None, None)], "key string, more string, v int")
    got = balanced_totals(df, "key", {"v": F.col("v")}, LoadPlan(3, {"a": [0, 2]}), ["more"])
    assert {tuple(r) for r in got.collect()} == {("x", "a", 2, 3), (None, "b", 1, None)} and dict(got.dtypes)["v"] == "bigint"
