"""Queries of the general problems: skewed keys, hierarchies, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.balance import balanced_join, balanced_totals, frequent_values, keyed_rows, load_plans
from codeloom.operators.hierarchy import descendants, hierarchy, rings
from codeloom.operators.orphans import judged_references, orphan_counts, validity
from codeloom.sources.tables import current_rows, table

LEAST_SHARE = 0.02


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored row of edges by target and by type, and of nodes by hierarchy level."""
    edges, nodes = (table(spark, sf_dir, t) for t in ("edges", "nodes"))
    of_edges = keyed_rows(edges, ["target", "type"], "edges", {"weight": F.col("weight")})
    return of_edges.unionByName(keyed_rows(nodes, ["hierarchy_level"], "nodes", {"weight": F.lit(None).cast("double")}))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir)
    return frequent_values(rows, LEAST_SHARE, load_plans(rows, ["field_key"])["field_key"]).select("field_name", "key_value")


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and weight of every target and every type, rows of every hierarchy level."""
    rows = _fields(spark, sf_dir)
    totals = balanced_totals(rows, "field_key", {"sum_weight": F.col("weight")}, load_plans(rows, ["field_key"])["field_key"], ["field_name", "key_value"])
    return totals.select("field_name", "key_value", "n_rows", F.round("sum_weight", 4).alias("sum_weight"))


def p1_target_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge rows by type and kind of target: the record-level join of a skewed key with its matching side."""
    edges = table(spark, sf_dir, "edges").select("target", "type")
    own = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "kind"]).select(F.col("id").alias("target"), "kind")
    shared = table(spark, sf_dir, "shared_nodes").select(F.col("id").alias("target"), "kind")
    plan = load_plans(edges, ["target"])["target"]
    joined = balanced_join(edges, own.unionByName(shared), "target", plan, "left")
    return joined.groupBy("type", F.coalesce("kind", F.lit("(none)")).alias("target_kind")).agg(F.count(F.lit(1)).alias("n_rows"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "parent_id"])
    return rows.filter(~F.coalesce("is_deleted", F.lit(False))).select("id", "parent_id")


def _parent_plan(spark: SparkSession, sf_dir: str):
    return load_plans(table(spark, sf_dir, "nodes").select("parent_id"), ["parent_id"], row_bytes=96)["parent_id"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings(_links(spark, sf_dir))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hierarchy(_links(spark, sf_dir), _parent_plan(spark, sf_dir))
    return placed.select("id", "root", "depth", F.array_join("path", " > ").alias("path"), "state", "parent_known")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(hierarchy(_links(spark, sf_dir), _parent_plan(spark, sf_dir)))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of a current row: ``field_name``, ``missing_id``, ``other``, ``type``, ``referred_at``.

    The id referred to is the key of the join and, for edges, half of the row's
    key, so it is moved once; `_with_row_keys` puts the key together.
    """
    edges = table(spark, sf_dir, "edges").groupBy("source", "target", "type").agg(F.max("indexed_at").alias("referred_at"))
    ends = F.explode(F.array(
        F.struct(F.lit("edges.source").alias("field_name"), F.col("source").alias("missing_id"), F.col("target").alias("other")),
        F.struct(F.lit("edges.target").alias("field_name"), F.col("target").alias("missing_id"), F.col("source").alias("other")),
    ))
    of_edges = edges.select("type", "referred_at", ends.alias("_r")).select("_r.field_name", "_r.missing_id", "_r.other", "type", "referred_at")
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "parent_id"]).filter(~F.coalesce("is_deleted", F.lit(False)))
    of_nodes = nodes.select(
        F.lit("nodes.parent_id").alias("field_name"), F.col("parent_id").alias("missing_id"), F.col("id").alias("other"), F.lit(None).cast("string").alias("type"), F.col("indexed_at").alias("referred_at")
    )
    return of_edges.unionByName(of_nodes).filter(F.col("missing_id").isNotNull())


def _with_row_keys(orphans: DataFrame) -> DataFrame:
    def key(*names: str):
        return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in names])

    row = F.when(F.col("field_name") == "edges.source", key("missing_id", "other", "type")).when(F.col("field_name") == "edges.target", key("other", "missing_id", "type")).otherwise(F.col("other"))
    return orphans.select("field_name", row.alias("row_key"), "missing_id", "reason")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference with its reason, null for a good one. The loads are those of all stored references, repeats counted."""
    columns = ["id", "indexed_at", "is_deleted"]
    parents = table(spark, sf_dir, "nodes").select(*columns).unionByName(table(spark, sf_dir, "shared_nodes").select(*columns))
    ends = table(spark, sf_dir, "edges").select(F.explode(F.array("target", "source")).alias("missing_id"))
    loads = ends.unionByName(table(spark, sf_dir, "nodes").select(F.col("parent_id").alias("missing_id")))
    return judged_references(_references(spark, sf_dir), validity(parents), load_plans(loads, ["missing_id"], row_bytes=96)["missing_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_row_keys(_judged(spark, sf_dir).filter("reason is not null"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_judged(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p1_target_kinds, p3_found, p3_hierarchy, p3_descendants, p6_found, p6_counts)}

_CURRENT = """cur as (select * from (select *, row_number() over (partition by id order by indexed_at desc nulls last, is_deleted desc) rn from nodes) where rn = 1),
live as (select * from cur where not coalesce(is_deleted, false))"""

_REFS = f"""{_CURRENT},
ed as (select source, target, type, max(indexed_at) as indexed_at from edges group by all),
refs as (
  select 'edges.source' as field_name, coalesce(source, '') || '|' || coalesce(target, '') || '|' || coalesce(type, '') as row_key, source as missing_id, indexed_at from ed
  union all select 'edges.target', coalesce(source, '') || '|' || coalesce(target, '') || '|' || coalesce(type, ''), target, indexed_at from ed
  union all select 'nodes.parent_id', id, parent_id, indexed_at from live),
known as (select id, min(indexed_at) as since, arg_max(coalesce(is_deleted, false), indexed_at) as gone
          from (select id, indexed_at, is_deleted from nodes union all select id, indexed_at, is_deleted from shared_nodes) group by id),
reasons as (select r.*, case when k.id is null then 'missing' when gone then 'deleted' when since > r.indexed_at then 'late' end as reason
            from refs r left join known k on r.missing_id = k.id where r.missing_id is not null)"""

_TREE = f"""with recursive {_CURRENT},
p as (select n.id, n.parent_id, m.id as above from live n left join live m on n.parent_id = m.id),
t as (select id, parent_id, id as root, 0 as depth, id as path, id as top from p where above is null
      union all select p.id, p.parent_id, t.root, t.depth + 1, t.path || ' > ' || p.id, t.top from p join t on p.above = t.id)"""

_RING = f"""with recursive {_CURRENT},
p as (select n.id, m.id as above from live n join live m on n.parent_id = m.id),
good as (select n.id from live n left join live m on n.parent_id = m.id where m.id is null
         union all select p.id from p join good on p.above = good.id),
q as (select * from p where id not in (select id from good)),
w as (select id as s, above as a from q union select w.s, q.above from w join q on w.a = q.id),
ring as (select s as id from w where s = a)"""

ORACLE = {
    "p1_found": f"""
select 'edges.target' as field_name, target as key_value from edges where target is not null group by target having count(*) >= {LEAST_SHARE} * (select count(*) from edges)
union all select 'edges.type', type from edges where type is not null group by type having count(*) >= {LEAST_SHARE} * (select count(*) from edges)
union all select 'nodes.hierarchy_level', hierarchy_level from nodes where hierarchy_level is not null group by hierarchy_level having count(*) >= {LEAST_SHARE} * (select count(*) from nodes)""",
    "p1_totals": """
select 'edges.target' as field_name, target as key_value, count(*) as n_rows, round(sum(weight), 4) as sum_weight from edges group by target
union all select 'edges.type', type, count(*), round(sum(weight), 4) from edges group by type
union all select 'nodes.hierarchy_level', hierarchy_level, count(*), null from nodes group by hierarchy_level""",
    "p1_target_kinds": f"""with {_CURRENT}, k as (select id, kind from cur union all select id, kind from shared_nodes)
select e.type, coalesce(k.kind, '(none)') as target_kind, count(*) as n_rows from edges e left join k on e.target = k.id group by all""",
    "p3_found": f"""{_RING}
select ring.id, min(w.a) as cycle_id from ring join w on w.s = ring.id group by ring.id""",
    "p3_hierarchy": f"""{_TREE},
q as (select * from p where id not in (select id from t)),
w as (select id as s, above as a from q union select w.s, q.above from w join q on w.a = q.id),
ring as (select s as id from w where s = a)
select t.id, root, depth, path, 'tree' as state, parent_id is null or depth > 0 as parent_known from t
union all select q.id, null, null, null, case when ring.id is not null then 'ring' else 'below_ring' end, true from q left join ring on q.id = ring.id""",
    "p3_descendants": f"""{_TREE},
d as (select above as id, id as descendant, 1 as distance from p where above is not null and id in (select id from t)
      union all select p.above, d.descendant, d.distance + 1 from d join p on d.id = p.id where p.above is not null)
select id, descendant, distance from d""",
    "p6_found": f"with {_REFS} select field_name, row_key, missing_id, reason from reasons where reason is not null",
    "p6_counts": f"""with {_REFS} select field_name, strftime(indexed_at, '%Y-%m') as month, count(*) as n_references,
count(*) filter (reason = 'missing') as n_missing, count(*) filter (reason = 'deleted') as n_deleted, count(*) filter (reason = 'late') as n_late
from reasons group by all""",
}
