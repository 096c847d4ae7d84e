from datetime import datetime

from codeloom.operators.balance import LoadPlan, load_plans
from codeloom.operators.orphans import judged_references, orphan_counts, orphan_references, validity

D = lambda d: datetime(2024, 1, d)
PARENTS = [
    ("ok", D(1), False), ("ok", D(1), False), ("gone", D(1), False), ("gone", D(5), True), ("back", D(1), False), ("back", D(3), True), ("back", D(6), None),
    ("late", D(20), False), ("late and gone", D(20), True), (None, D(1), False), ("", D(1), False), ("timeless", None, False), ("tie", D(2), True), ("tie", D(2), False),
]
REFS = [(f"r{i}", m, D(10)) for i, m in enumerate(["ok", "gone", "back", "late", "late and gone", "none", None, "", "timeless", "tie"])] + [("r0", "none", D(10)), ("early", "late", None)]
WANT = sorted([("r1", "gone", "deleted"), ("r3", "late", "late"), ("r4", "late and gone", "deleted"), ("r5", "none", "missing"), ("r9", "tie", "deleted"), ("r0", "none", "missing")])


def frames(spark):
    parents = spark.createDataFrame(PARENTS, "id string, indexed_at timestamp_ntz, is_deleted boolean")
    refs = spark.createDataFrame([(*r, "t", "x", 1, True) for r in REFS], "row_key string, missing_id string, referred_at timestamp_ntz, field_name string, reason string, known_since int, gone boolean")
    return parents, refs


def test_reasons_with_clashing_columns(spark):
    parents, refs = frames(spark)
    for plan in (LoadPlan(4, {}), load_plans(refs, ["missing_id"])["missing_id"]):
        got = orphan_references(refs, validity(parents), plan)
        assert sorted((r["row_key"], r["missing_id"], r["reason"]) for r in got.collect()) == WANT


def test_hot_missing_key_is_split_without_loss(spark):
    parents, _ = frames(spark)
    refs = spark.createDataFrame([(f"r{i}", "nobody" if i % 3 else "ok", D(9)) for i in range(900)], "row_key string, missing_id string, referred_at timestamp_ntz")
    plan = load_plans(refs, ["missing_id"])["missing_id"]
    assert len(plan.slots["nobody"]) > 1
    got = orphan_references(refs, validity(parents), plan).collect()
    assert len(got) == 600 and len({r["row_key"] for r in got}) == 600


def test_counts_and_empty(spark):
    parents, refs = frames(spark)
    found = judged_references(refs, validity(parents), LoadPlan(2, {}))
    rows = {r["month"]: r for r in orphan_counts(found).collect()}
    assert rows["2024-01"]["n_missing"] == 2 and rows["2024-01"]["n_deleted"] == 3 and rows["2024-01"]["n_late"] == 1 and rows["2024-01"]["n_references"] == 11
    assert rows[None]["n_references"] == 1 and rows[None]["n_late"] == 0
    assert orphan_references(refs.limit(0), validity(parents), LoadPlan(2, {})).count() == 0
    assert {r["reason"] for r in orphan_references(refs, validity(parents.limit(0)), LoadPlan(2, {})).collect()} == {"missing"}
