"""The registered queries of this subpackage on the smallest tables, if they are there."""

import os

import duckdb
import pytest

from codeloom.llm.encode import VOCABULARY
from codeloom.llm.queries import ORACLE, QUERIES
from tools.compare import same_rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.exists(VOCABULARY)), reason="no test tables or vocabulary")

COLUMNS = {
    "p2_found": ["file_path"], "p4_found": ["id"], "p5_found": ["file_path"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        keys = [tuple(str(v) for v in r) for r in rows]
        assert len(keys) == len(set(keys))


def test_every_document_is_encoded(spark):
    assert QUERIES["p7_ids"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_sql_has_queries():
    assert set(ORACLE) <= set(QUERIES)


# What SQL can say over the stored rows of another query.
OVER_STORED = {
    "p2_found": ("p2_states", "select file_path from stored where problem is not null"),
    "p2_rates": ("p2_states", "select repo_hash, language, count(*) as n_files, count(problem) as n_broken, count(*) filter (problem = 'truncated') as n_truncated, round(count(problem) / count(*), 6) as broken_rate from stored group by repo_hash, language"),
    "p5_found": ("p5_reasons", "select file_path from stored where reason is not null"),
    "p5_shared_rules": ("p5_reasons", "select file_path, repo_hash, n_passages, n_shared from stored where n_passages > 0"),
    "p7_counts": ("p7_ids", "select doc_id, len(ids) as n_tokens from stored"),
    "p8_shares": ("p8_mixture", """with s as (select source, sum(n_tokens) as pool_tokens, sum(copies * n_tokens) as mix_tokens, max(copies) as most_copies from stored group by source)
select w.source, target_share, max_repeats, coalesce(pool_tokens, 0) as pool_tokens, coalesce(mix_tokens, 0) as mix_tokens, coalesce(most_copies, 0) as most_copies,
round(coalesce(mix_tokens, 0) / (select sum(mix_tokens) from s), 6) as reached_share from weights w left join s on w.source = s.source"""),
    "p9_found": ("p9_documents", "select doc_id, unnest(langs) as lang from stored where not (len(langs) = 1 and coalesce(label = langs[1], false))"),
}


@pytest.mark.parametrize("name", sorted(OVER_STORED))
def test_query_equals_sql_over_stored_rows(spark, tmp_path, name):
    of, sql = OVER_STORED[name]
    QUERIES[of](spark, DATA).write.parquet(f"{tmp_path}/stored")
    con = duckdb.connect()
    con.execute(f"create view stored as select * from '{tmp_path}/stored/*.parquet'")
    con.execute(f"create view weights as select * from '{DATA}/mix_weights.parquet'")
    ok, why = same_rows(QUERIES[name](spark, DATA), con.execute(sql))
    assert ok, why


def test_shares_come_near_their_targets(spark):
    rows = [r for r in QUERIES["p8_shares"](spark, "/root/testdata/sf0.1").collect() if r["pool_tokens"]]
    whole = sum(r["target_share"] for r in rows)
    assert all(abs(r["reached_share"] - r["target_share"] / whole) <= 0.02 * r["target_share"] / whole and r["most_copies"] <= r["max_repeats"] for r in rows)
