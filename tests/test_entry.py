"""Every registered query against its SQL on the smallest tables, if they are there."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tools.compare import TABLES, same_rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = E.queries()[name](spark, DATA)
    ok, why = same_rows(df, con.execute(E.oracle_sql()[name]))
    assert ok, why


def test_every_core_query_has_sql_but_these():
    core = {n for n in E.queries() if not n[1].isdigit()}
    assert core - set(E.oracle_sql()) == {"file_communities", "shortest_path"}


def test_communities_cover_all_files_once(spark, con):
    rows = E.queries()["file_communities"](spark, DATA).collect()
    files = {r[0] for r in con.execute("select distinct file_path from nodes where file_path is not null").fetchall()}
    ids = [r["id"] for r in rows]
    assert len(ids) == len(set(ids)) and {r["community"] for r in rows} <= set(ids) and len(set(ids) & files) > 0.8 * len(files)


def test_shortest_path_is_shortest(spark):
    data = "/root/testdata/sf0.01"  # the smallest tables have no path between its ends
    path = [r["id"] for r in E.queries()["shortest_path"](spark, data).orderBy("seq").collect()]
    links = set(duckdb.sql(f"with e as (select * from '{data}/edges.parquet') select source, target from e union select target, source from e").fetchall())
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    depth, level = {path[0]: 0}, [path[0]]
    while level:
        level = [y for y in {y for x in level for y in near.get(x, ())} if y not in depth]
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    assert all(pair in links for pair in zip(path, path[1:])) and len(path) - 1 == depth[path[-1]] > 0


def test_entry_files_of_seeded_tables(spark, con, tmp_path):
    nodes = spark.read.parquet(f"{DATA}/nodes.parquet")
    named = F.when(F.xxhash64("id") % 5 == 0, F.concat(F.lit("r/src/"), F.element_at(F.array(*map(F.lit, ("main.ts", "Index.js", "web.server.py", "app.php", "mainly.ts"))), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))))
    nodes.withColumn("file_path", F.coalesce(named, "file_path")).withColumn("parent_id", F.when(F.xxhash64("name") % 3 == 0, F.col("parent_id"))).write.parquet(f"{tmp_path}/nodes.parquet")
    c = duckdb.connect()
    c.execute(f"create view nodes as select * from '{tmp_path}/nodes.parquet/*.parquet'")
    for t in ("shared_nodes", "edges"):
        os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name in ("entry_files", "entry_cascade"):
        df = E.queries()[name](spark, str(tmp_path))
        ok, why = same_rows(df, c.execute(E.oracle_sql()[name]))
        assert ok and df.count() > 10, why


def test_entry(spark):
    assert E.entry(spark).count() > 0
