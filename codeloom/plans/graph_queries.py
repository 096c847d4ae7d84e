"""Queries of the graph engine's own operators over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.extensions import Registry
from codeloom.functions.globs import glob_regex, in_scope
from codeloom.functions.kinds import CLASSES, kind_class
from codeloom.operators import analytics as A
from codeloom.operators import graph as G
from codeloom.operators import linking as L
from codeloom.operators import search as Q
from codeloom.operators.balance import balanced_join, load_plans
from codeloom.operators.hierarchy import hierarchy
from codeloom.sources import store as S
from codeloom.sources.tables import current_rows, graph_edges, graph_nodes, stored_links, table

PLANNED_ROWS = 1_000_000  # stored edges from which on joins by target are planned by load; results are the same
SEARCH = "the lattice cache of beacon-route"
SCOPES, EXCLUDES = ["*/src/**", "*/packages/*/src/**"], ["**/*.php"]
FILTER = ["Imports", "call"]
DOMAINS = [("Server", "server/**"), ("Tools", "tools/*")]

QUERIES, ORACLE = {}, {}

_N = """cur as (select * exclude (rn) from (select *, row_number() over (partition by id order by indexed_at desc nulls last, is_deleted desc) rn from nodes) where rn = 1),
live as (select * from cur where not coalesce(is_deleted, false)),
n as (select * from live union all by name select * from shared_nodes where not coalesce(is_deleted, false)),
e as (select * exclude (rn) from (select *, row_number() over (partition by source, target, type order by indexed_at desc nulls last, weight desc nulls last) rn from edges) where rn = 1),
sym as (select source as src, target as dst, type, true as outgoing from e union all select target, source, type, false from e)"""
_EXEC = "('calls', 'constructor', 'fires_hook', 'dispatches')"
_DEGREE = "deg as (select id, sum(1 - o) as in_degree, sum(o) as out_degree, count(*) as degree from (select source as id, 1 as o from e union all select target, 0 from e) where id is not null group by id)"
_TIER = """marks as (select quantile_disc(degree, 0.95) as god, quantile_disc(degree, 0.8) as high, quantile_disc(degree, 0.5) as mid from deg),
tier as (select id, degree, case when degree > god then 'god' when degree > high then 'high' when degree > mid then 'mid' else 'low' end as tier from deg, marks)"""
_REST = "regexp_replace(file_path, '^[^/]+/', '')"
_TAIL = f"regexp_replace({_REST}, '^.*/packages/', 'packages/')"
_PARTS = f"string_split({_TAIL}, '/')"
_AREA = f"""case when {_PARTS}[1] = 'packages' and {_PARTS}[2] = 'extensions' and len({_PARTS}) > 2 then array_to_string({_PARTS}[1:3], '/')
when {_PARTS}[1] in ('packages', 'apps', 'src', 'lib') and len({_PARTS}) > 1 then array_to_string({_PARTS}[1:2], '/')
when len({_PARTS}) > 1 then {_PARTS}[1] else 'root' end"""
_FILES = "cf as (select * exclude (rn) from (select *, row_number() over (partition by file_path order by loaded_at desc nulls last, source_text desc nulls last) rn from source_files) where rn = 1)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _events(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'event'")


# Analytics.


@query(f"with {_N}, {_DEGREE} select * from deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.degrees(graph_edges(spark, sf_dir, []))


@query(f"with {_N}, {_DEGREE}, {_TIER} select * from tier")
def hierarchy_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tiers(A.degrees(graph_edges(spark, sf_dir, [])))


@query(f"with {_N}, {_DEGREE}, {_TIER} select n.id, n.name, n.kind, n.repo_hash, tier.degree from tier join n using (id) where tier = 'god'")
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gods = A.tiers(A.degrees(graph_edges(spark, sf_dir, []))).filter("tier = 'god'").select("id", "degree")
    return graph_nodes(spark, sf_dir, ["name", "kind", "repo_hash"]).join(gods, "id")


@query(f"with {_N} select kind, count(*) as n_nodes from n group by kind")
def nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(spark, sf_dir, ["kind"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(
    f"with {_N}, k as (select *, lower(coalesce(kind, '')) as low from n) select case "
    + " ".join(f"when {' or '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words.split())} then '{name}'" for name, words in CLASSES)
    + " else 'other' end as class, count(*) as n_nodes from k group by class"
)
def kind_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(spark, sf_dir, ["kind"]).groupBy(kind_class(F.col("kind")).alias("class")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""with {_N}, c as (select repo_hash, count(*) as n_nodes, count(distinct file_path) as n_files from n group by repo_hash),
x as (select repo_hash, count(*) as n_edges from e join n on e.source = n.id group by repo_hash)
select c.*, coalesce(n_edges, 0) as n_edges from c left join x on c.repo_hash is not distinct from x.repo_hash""")
def repo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["file_path", "repo_hash"])
    counts = nodes.groupBy("repo_hash").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("file_path").alias("n_files"))
    out = graph_edges(spark, sf_dir, []).groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(nodes.select(F.col("id").alias("source"), F.col("repo_hash").alias("_r")), "source")
    edges = out.groupBy("_r").agg(F.sum("n").alias("n_edges"))
    return counts.join(edges, F.col("repo_hash").eqNullSafe(F.col("_r")), "left").select("repo_hash", "n_nodes", "n_files", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query(f"""with {_N} select case {' '.join(f"when regexp_matches({_REST}, '{glob_regex(g)}') then '{name}'" for name, g in DOMAINS)}
else upper(substr({_REST}, 1, 1)) || substr(string_split({_REST}, '/')[1], 2) end as domain, count(*) as n_nodes from live where file_path is not null group by all""")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "file_path"]).filter("not coalesce(is_deleted, false) and file_path is not null")
    return nodes.groupBy(A.domain(A.below_repo(F.col("file_path")), DOMAINS).alias("domain")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"with {_N} select repo_hash, {_AREA} as area, count(distinct file_path) as n_files from live where file_path is not null group by all")
def architecture_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).groupBy("repo_hash", "area").agg(F.count(F.lit(1)).alias("n_files"))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "file_path", "repo_hash"]).filter("not coalesce(is_deleted, false) and file_path is not null")
    return nodes.select("repo_hash", "file_path").distinct().withColumn("area", A.area(A.below_repo(F.col("file_path"))))


def _target_loads(spark: SparkSession, sf_dir: str):
    """The load of the stored edges' targets, one of which holds a tenth of them; none for a table that few tasks hold."""
    edges = table(spark, sf_dir, "edges")
    return load_plans(edges, ["target"])["target"] if edges.count() >= PLANNED_ROWS else None


def _file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = graph_nodes(spark, sf_dir, ["file_path"]).select("id", "file_path").filter("file_path is not null")
    areas = _areas(spark, sf_dir).select(F.concat_ws(":", F.coalesce("repo_hash", F.lit("")), "area").alias("area"), "file_path")
    return A.file_pair_weights(graph_edges(spark, sf_dir), files, areas, _target_loads(spark, sf_dir))


_WEIGHT = "case e.type " + " ".join(f"when '{k}' then {v}" for k, v in A.TYPE_WEIGHTS.items()) + " else 1.0 end"


@query(f"""with {_N}, ar as (select distinct repo_hash, file_path, {_AREA} as area from live where file_path is not null),
lagged as (select lag(file_path) over (partition by coalesce(repo_hash, ''), area order by file_path) as a, file_path as b from (select distinct repo_hash, area, file_path from ar)),
w as (select least(s.file_path, t.file_path) as a, greatest(s.file_path, t.file_path) as b, {_WEIGHT} * (1 + log2(greatest(1.0, coalesce(e.weight, 1.0)))) as w
      from e join n s on e.source = s.id join n t on e.target = t.id where e.type <> 'contains' and s.file_path <> t.file_path
      union all select a, b, {A.AREA_AFFINITY} from lagged where a is not null)
select a, b, round(sum(w), 4) as weight from w group by a, b""")
def community_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_pairs(spark, sf_dir).select("a", "b", F.round("weight", 4).alias("weight"))


@query()
def file_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of files; event nodes share one pseudo file, and so cluster as one."""
    files = graph_nodes(spark, sf_dir, ["file_path"]).filter("file_path is not null").select(F.col("file_path").alias("id")).distinct()
    return A.communities(_file_pairs(spark, sf_dir), files)


def _area_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["file_path", "repo_hash", "hierarchy_level"]).filter("file_path is not null")
    return nodes.select("id", F.concat_ws(":", F.coalesce("repo_hash", F.lit("")), A.area(A.below_repo(F.col("file_path")))).alias("community"), F.lower(F.trim("hierarchy_level")).alias("tier"))


_MEMBERS = f"m as (select id, coalesce(repo_hash, '') || ':' || {_AREA} as community, lower(trim(hierarchy_level)) as tier from n where file_path is not null)"


@query(f"""with {_N}, {_MEMBERS}, b as (select s.community as cs, t.community as ct from e join m s on e.source = s.id join m t on e.target = t.id where type <> 'contains'),
p as (select cs as community, 1 as t, case when cs = ct then 1 else 0 end as i from b union all select ct, 1, 0 from b where cs <> ct),
s as (select community, sum(t) as touching, sum(i) as internal from p group by community),
r as (select community, id, row_number() over (partition by community order by case tier when 'god' then 0 when 'high' then 1 when 'mid' then 2 when 'low' then 3 else 4 end, id) as k from m),
top as (select community, string_agg(id, ',' order by k) as top_nodes from r where k <= 5 group by community)
select c.community, c.size, coalesce(touching, 0) as touching, coalesce(internal, 0) as internal, round(case when touching > 0 then internal / touching else 0.0 end, 6) as cohesion, top_nodes
from (select community, count(*) as size from m group by community) c left join s using (community) left join top using (community)""")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.community_summary(_area_members(spark, sf_dir), graph_edges(spark, sf_dir, []))


@query(f"""with {_N}, {_MEMBERS} select least(s.community, t.community) as a, greatest(s.community, t.community) as b, count(*) as n_edges
from e join m s on e.source = s.id join m t on e.target = t.id where type <> 'contains' and s.community <> t.community group by all""")
def cross_community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _area_members(spark, sf_dir)
    s, t = m.select(F.col("id").alias("source"), F.col("community").alias("cs")), m.select(F.col("id").alias("target"), F.col("community").alias("ct"))
    both = A.community_pairs(graph_edges(spark, sf_dir, []), s, t).filter("cs <> ct")
    return both.groupBy(F.least("cs", "ct").alias("a"), F.greatest("cs", "ct").alias("b")).agg(F.sum("n").alias("n_edges"))


# Filters.


@query(f"with {_N} select source, target, type from e where type in ('calls', 'import', 'imports', 'call')")
def edge_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.of_types(graph_edges(spark, sf_dir, []), FILTER).select("source", "target", "type")


_SCOPE = f"(regexp_matches(file_path, '{'|'.join(glob_regex(g) for g in SCOPES)}') and not regexp_matches(file_path, '{'|'.join(glob_regex(g) for g in EXCLUDES)}'))"


@query(f"with {_N} select id, file_path from n where {_SCOPE}")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(spark, sf_dir, ["file_path"]).filter(in_scope(F.col("file_path"), SCOPES, EXCLUDES)).select("id", "file_path")


@query(f"with {_N}, a as (select id from n where {_SCOPE} or starts_with(file_path, '<')) select source, target, type from e where source in (select id from a) and target in (select id from a)")
def scoped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = graph_nodes(spark, sf_dir, ["file_path"]).filter(in_scope(F.col("file_path"), SCOPES, EXCLUDES, allow_virtual=True))
    return G.induced(graph_edges(spark, sf_dir, []), ids, _target_loads(spark, sf_dir)).select("source", "target", "type")


@query(f"with {_N} select source, target, count(*) as n_edges, round(sum(weight), 4) as sum_weight from e where type <> 'contains' group by source, target")
def parallel_edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph_edges(spark, sf_dir).filter("type <> 'contains'")
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("weight"), 4).alias("sum_weight"))


@query(f"with {_N} select n.repo_hash, e.source, e.target, e.type from e join n on e.source = n.id")
def repo_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["repo_hash"]).select(F.col("id").alias("source"), "repo_hash")
    return graph_edges(spark, sf_dir, []).join(nodes, "source").select("repo_hash", "source", "target", "type")


@query(f"with {_N} select src, dst, type, outgoing from sym where src in (select id from n where kind = 'event')")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(graph_nodes(spark, sf_dir, ["kind"])).select(F.col("id").alias("src"))
    return G.symmetrised(graph_edges(spark, sf_dir, [])).join(events, "src", "left_semi").select("src", "dst", "type", "outgoing")


# Traversals.


def _reach(links: str, depth: int, seeds: str = "select id from n where kind = 'event'") -> str:
    return f"""with recursive {_N}, links as ({links}),
r as (select id, 0 as depth from ({seeds}) union select links.dst, r.depth + 1 from r join links on links.src = r.id where r.depth < {depth} and links.dst is not null),
best as (select id, min(depth) as depth from r group by id)"""


@query(_reach("select distinct src, dst from sym", 2) + " select id, depth from best")
def bfs_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(G.symmetrised(stored_links(spark, sf_dir)), _events(graph_nodes(spark, sf_dir, ["kind"])), 2).select("id", "depth")


@query(_reach("select distinct src, dst from sym where type <> 'contains'", 2, "select id from n where kind = 'interface_declaration'") + " select id, depth from best")
def focus_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = G.symmetrised(stored_links(spark, sf_dir).filter("type <> 'contains'"))
    return G.bfs(links, graph_nodes(spark, sf_dir, ["kind"]).filter("kind = 'interface_declaration'"), 2).select("id", "depth")


@query(_reach("select distinct source as src, target as dst from e where type <> 'contains'", 4) + " select id, depth from best")
def directed_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(G.directed(stored_links(spark, sf_dir).filter("type <> 'contains'")), _events(graph_nodes(spark, sf_dir, ["kind"])), 4).select("id", "depth")


@query(_reach(f"select distinct target as src, source as dst from e where type in {_EXEC}", 3) + " select id, depth from best where depth > 0")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(G.directed(G.executable(stored_links(spark, sf_dir)), reverse=True), _events(graph_nodes(spark, sf_dir, ["kind"])), 3).filter("depth > 0").select("id", "depth")


@query(_reach(f"select distinct source as src, target as dst from e where type in {_EXEC}", 3) + " select id, depth from best where depth > 0")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(G.directed(G.executable(stored_links(spark, sf_dir))), _events(graph_nodes(spark, sf_dir, ["kind"])), 3).filter("depth > 0").select("id", "depth")


_ENTRY = f"""select id from n where kind not in ('module', 'export_statement', 'event') and parent_id is null and lower(trim(hierarchy_level)) in ('god', 'high')
and not exists (select 1 from e where e.target = n.id and e.type in {_EXEC})"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["kind", "parent_id", "hierarchy_level", "name", "file_path"])
    top = nodes.filter("kind not in ('module', 'export_statement', 'event') and parent_id is null").filter(F.lower(F.trim("hierarchy_level")).isin("god", "high"))
    called = G.executable(stored_links(spark, sf_dir)).select(F.col("target").alias("id")).distinct()
    return top.join(called, "id", "left_anti")


@query(f"with {_N} select id, name, file_path from n where id in ({_ENTRY})")
def entry_no_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("id", "name", "file_path")


_CALLS = f"calls as (select distinct source as src, target as dst, type from e where type in {_EXEC})"
_TOP = """top as (select *, coalesce(lower(trim(hierarchy_level)) = 'god', false) as god from n where kind <> 'module' and parent_id is null and repo_hash is not null),
named as (select * from top where regexp_matches(lower(file_path), '(main|index|server|app)\\.')),
rest as (select * from top where lower(trim(hierarchy_level)) in ('god', 'high') and repo_hash not in (select repo_hash from named) and id not in (select dst from calls where dst is not null)),
entries as (select repo_hash, id, 'entry-file' as reason, row_number() over (partition by repo_hash order by god desc, line_start nulls first, id) as rank from named
 union all select repo_hash, id, 'no-callers', row_number() over (partition by repo_hash order by god desc, file_path nulls first, id) from rest),
entry as (select * from entries where rank <= 20)"""
_FLOW = f"""with recursive {_N}, {_CALLS}, {_TOP},
r as (select repo_hash, id, 0 as depth from entry union select r.repo_hash, calls.dst, r.depth + 1 from r join calls on calls.src = r.id where r.depth < 5 and calls.dst is not null),
best as (select repo_hash, id, min(depth) as depth from r group by all),
sizes as (select repo_hash, depth, sum(c) over (partition by repo_hash order by depth) as upto from (select repo_hash, depth, count(*) as c from best group by all)),
flow as (select b.* from best b where b.depth = 0 or (select upto from sizes s where s.repo_hash = b.repo_hash and s.depth = b.depth - 1) < 2000),
left_by as (select f.* from flow f where f.depth < 5 and (select upto from sizes s where s.repo_hash = f.repo_hash and s.depth = f.depth) < 2000)"""
_ALLOWED = lambda id: f"{id} in (select id from n where {_SCOPE} or starts_with(file_path, '<'))"


def _entry_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["repo_hash", "kind", "parent_id", "hierarchy_level", "file_path", "line_start"])
    return A.entry_nodes(nodes, G.executable(stored_links(spark, sf_dir)))


@query(f"with {_N}, {_CALLS}, {_TOP} select repo_hash, id, reason, rank from entry")
def entry_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_nodes(spark, sf_dir)


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return G.execution_flow(stored_links(spark, sf_dir), _entry_nodes(spark, sf_dir).select("repo_hash", "id"))


@query(_FLOW + """ select f.repo_hash, f.id, f.depth, (select min(p.id) from calls join flow p on calls.src = p.id where calls.dst = f.id and p.repo_hash = f.repo_hash and p.depth = f.depth - 1) as parent
from flow f where f.id in (select id from n)""")
def execution_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs from the entries of each repository, by least depth; ids without a node are left out."""
    return _flow(spark, sf_dir)[0].join(graph_nodes(spark, sf_dir, []).select("id"), "id", "left_semi").select("repo_hash", "id", "depth", "parent")


@query(_FLOW + " select distinct l.repo_hash, c.src as source, c.dst as target, c.type from left_by l join calls c on c.src = l.id")
def execution_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir)[1]


@query(_FLOW + f""", kept as (select f.repo_hash, f.id from flow f where {_ALLOWED("f.id")})
select distinct l.repo_hash, c.src as source, c.dst as target, c.type from left_by l join calls c on c.src = l.id
where (l.repo_hash, c.src) in (select (repo_hash, id) from kept) and (l.repo_hash, c.dst) in (select (repo_hash, id) from kept)""")
def execution_flow_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow's edges between nodes of its own that are in scope."""
    nodes, edges = _flow(spark, sf_dir)
    ids = graph_nodes(spark, sf_dir, ["file_path"]).filter(in_scope(F.col("file_path"), SCOPES, EXCLUDES, allow_virtual=True)).select("id")
    kept = nodes.join(ids, "id", "left_semi").select("repo_hash", "id")
    for end in ("source", "target"):
        edges = edges.join(kept.withColumnRenamed("id", end), ["repo_hash", end], "left_semi")
    return edges.select("repo_hash", "source", "target", "type")


_CHAIN = f"""with recursive {_N}, {_CALLS}, roots as (select id from n where kind = 'event'),
up as (select id, 0 as depth from roots union select calls.src, up.depth + 1 from up join calls on calls.dst = up.id where up.depth < 3 and calls.src is not null),
down as (select id, 0 as depth from roots union select calls.dst, down.depth + 1 from down join calls on calls.src = down.id where down.depth < 3 and calls.dst is not null),
chain as (select id, min(depth) as depth, 'caller' as direction from up group by id union all select id, min(depth), 'callee' from down group by id),
ways as (select c.* from calls c join chain on c.dst = chain.id and direction = 'caller' and depth < 3 where c.src is not null
 union select c.* from calls c join chain on c.src = chain.id and direction = 'callee' and depth < 3 where c.dst is not null)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = graph_nodes(spark, sf_dir, ["kind"])
    links = stored_links(spark, sf_dir).filter("source is not null and target is not null")
    return G.call_chain(links, _events(nodes).select("id"), nodes)


@query(_CHAIN + " select id, depth, direction from chain where depth > 0 and id in (select id from n)")
def call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir)[0]


@query(_CHAIN + " select src as source, dst as target, type from ways")
def call_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir)[1].select("source", "target", "type")


@query(_CHAIN + f""", kept as (select id from chain where {_ALLOWED("id")})
select src as source, dst as target, type from ways where src in (select id from kept) and dst in (select id from kept)""")
def call_chain_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's edges between roots, callers and callees in scope."""
    nodes, edges = _chain(spark, sf_dir)
    all_nodes = graph_nodes(spark, sf_dir, ["kind", "file_path"])
    ids = all_nodes.filter(in_scope(F.col("file_path"), SCOPES, EXCLUDES, allow_virtual=True)).select("id", "kind")
    kept = ids.select("id").join(nodes.select("id").distinct(), "id", "left_semi").union(_events(ids).select("id")).distinct()
    return G.induced(edges, kept).select("source", "target", "type")


@query(f"""with {_N}, d as (select id, name, kind, file_path from n where name ilike '%cache%' and kind not in ('module', 'event'))
select d.id, d.name, d.file_path, e.source, e.type, e.weight, len(e.call_sites) as n_sites, e.call_sites[1].line as first_line from d join e on e.target = d.id where e.type in ('calls', 'constructor')""")
def call_sites_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the declarations whose name has a text in it, with their sites; not limited."""
    named = graph_nodes(spark, sf_dir, ["name", "kind", "file_path"]).filter(F.col("name").ilike("%cache%") & ~F.col("kind").isin("module", "event"))
    calls = table(spark, sf_dir, "edges").filter("type in ('calls', 'constructor')").join(named.select(F.col("id").alias("target")), "target", "left_semi")
    now = current_rows(calls, ["source", "target", "type"], ["weight", "call_sites"])
    return now.join(named.select(F.col("id").alias("target"), "name", "file_path"), "target").select(
        F.col("target").alias("id"), "name", "file_path", "source", "type", "weight", F.size("call_sites").cast("bigint").alias("n_sites"), F.col("call_sites")[0]["line"].alias("first_line")
    )


@query(
    _reach("select distinct source as src, target as dst from e where type <> 'contains' and target in (select id from n)", 3)
    + ", t as (select id, depth, (select min(p.id) from links join best p on links.src = p.id where links.dst = b.id and p.depth = b.depth - 1) as parent from best b where depth > 0 order by depth, id limit 200) select *, (select count(*) from t) >= 200 as truncated from t"
)
def dependency_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["kind"])
    return G.dependency_tree(stored_links(spark, sf_dir), _events(nodes), nodes)


@query(
    _reach("select distinct target as src, source as dst from e where type <> 'contains' and source in (select id from n)", 2)
    + ", t as (select id, depth, (select min(p.id) from links join best p on links.src = p.id where links.dst = b.id and p.depth = b.depth - 1) as parent from best b where depth > 0 order by depth, id limit 200) select *, (select count(*) from t) >= 200 as truncated from t"
)
def dependent_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["kind"])
    return G.dependency_tree(stored_links(spark, sf_dir), _events(nodes), nodes, max_depth=2, reverse=True)


@query()
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the least event to the greatest class, in any direction."""
    nodes = graph_nodes(spark, sf_dir, ["kind"])
    ends = nodes.agg(F.min(F.when(F.col("kind") == "event", F.col("id"))).alias("a"), F.max(F.when(F.col("kind") == "class_declaration", F.col("id"))).alias("b")).first()
    return G.shortest_path(G.symmetrised(stored_links(spark, sf_dir)), ends["a"] or "", ends["b"] or "")


@query(f"""with recursive {_N}, l as (select source as a, target as b from e where type in ('extends', 'implements') union select target, source from e where type in ('extends', 'implements')),
r as (select a as id, a as c from l union select l.b, r.c from r join l on l.a = r.id)
select id, min(c) as component from r group by id""")
def heritage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(G.directed(graph_edges(spark, sf_dir, []).filter("type in ('extends', 'implements')")))


@query(f"""with recursive {_N}, first as (select target, min(source) as s from e where type = 'contains' group by target),
l as (select live.id, coalesce(live.parent_id, first.s) as parent_id from live left join first on live.id = first.target),
p as (select l.id, m.id as above from l left join l m on l.parent_id = m.id),
t as (select id, 0 as depth from p where above is null union all select p.id, t.depth + 1 from p join t on p.above = t.id)
select l.id, t.depth, t.id is not null as in_tree from l left join t on l.id = t.id""")
def containment_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "parent_id"]).filter("not coalesce(is_deleted, false)")
    first = graph_edges(spark, sf_dir, []).filter("type = 'contains'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("_s"))
    links = nodes.join(first, "id", "left").select("id", F.coalesce("parent_id", "_s").alias("parent_id"))
    plan = load_plans(table(spark, sf_dir, "nodes").select("parent_id"), ["parent_id"])["parent_id"]
    return hierarchy(links, plan, paths=False).select("id", "depth", (F.col("state") == "tree").alias("in_tree"))


@query(f"""with {_N} select n.id, n.name, count(*) filter (sym.type = 'fires_hook') as n_fires, count(*) filter (sym.type = 'listens_hook') as n_listens, count(*) filter (sym.type = 'dispatches') as n_dispatches
from n join sym on n.id = sym.src where n.kind = 'event' and n.name ilike '%a%' group by all""")
def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(graph_nodes(spark, sf_dir, ["kind", "name"])).filter(F.col("name").ilike("%a%"))
    touching = G.symmetrised(graph_edges(spark, sf_dir, [])).join(events.select(F.col("id").alias("src"), "name"), "src")
    return touching.groupBy(F.col("src").alias("id"), "name").agg(
        *[F.count(F.when(F.col("type") == t, 1)).alias(n) for t, n in (("fires_hook", "n_fires"), ("listens_hook", "n_listens"), ("dispatches", "n_dispatches"))]
    )


@query(f"""with {_N}, a as (select id from n where {_SCOPE} or starts_with(file_path, '<'))
select n.id, n.name, sym.dst as other, sym.type, sym.outgoing from n join sym on n.id = sym.src where n.kind = 'event' and n.name ilike '%a%' and sym.dst in (select id from a)""")
def hook_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges at named events whose other end is in scope; an event without any has no row."""
    nodes = graph_nodes(spark, sf_dir, ["kind", "name", "file_path"])
    events = _events(nodes).filter(F.col("name").ilike("%a%")).select(F.col("id").alias("src"), "name")
    ids = nodes.filter(in_scope(F.col("file_path"), SCOPES, EXCLUDES, allow_virtual=True)).select(F.col("id").alias("dst"))
    return G.symmetrised(graph_edges(spark, sf_dir, [])).join(events, "src").join(ids, "dst", "left_semi").select(F.col("src").alias("id"), "name", F.col("dst").alias("other"), "type", "outgoing")


# Linking.


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call site of every stored edge row, exact repeats once."""
    edges = table(spark, sf_dir, "edges").select("source", "target", "type", F.explode("call_sites").alias("s"))
    return edges.select("source", "target", "type", "s.file", "s.line", "s.column", "s.receiver", "s.callback", "s.priority").distinct()


def _named_sites(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    """Call sites with the name of their target: ``file_path``, ``source``, ``receiver``, ``name``, each once; hot targets are split."""
    sites = _sites(spark, sf_dir).filter(F.col("type").isin(*types)).select("target", F.col("file").alias("file_path"), "source", "receiver").distinct()
    nodes = graph_nodes(spark, sf_dir, ["name"]).select(F.col("id").alias("target"), "name")
    loads = _target_loads(spark, sf_dir)
    named = balanced_join(sites, nodes, "target", loads) if loads else sites.join(nodes, "target")
    return named.select("file_path", "source", "receiver", "name", F.col("target").alias("meant")).distinct()


def _declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "name", "kind", "file_path", "parent_id"])
    return live.filter("not coalesce(is_deleted, false) and kind not in ('module', 'export_statement')")


_SITES = "sites as (select distinct source, target, type, s.file as file, s.line as line, s.\"column\" as col, s.receiver as receiver, s.callback as callback, s.priority as priority from (select source, target, type, unnest(call_sites) as s from edges))"


@query(f"with {_SITES}, m as (select source, target, type, count(*)::double as weight, min(line) as first_line, max(line) as last_line, count(distinct file) as n_files, (list(struct_pack(f := file, l := line, c := col) order by file nulls first, line nulls first, col nulls first))[1] as s1 from sites group by all) select * exclude (s1), s1.f as site_file, s1.l as site_line, s1.c as site_column from m")
def call_site_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merged_call_sites(_sites(spark, sf_dir))


@query(f"""with {_N}, {_SITES}, s as (select distinct file, line from sites where type in ('calls', 'constructor') and line is not null)
select file as file_path, line, arg_min(id, {{'span': line_end - line_start, 'id': id}}) as id from s join live on live.file_path = s.file and s.line between line_start and line_end where kind <> 'module' group by file, line""")
def innermost_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir).filter("type in ('calls', 'constructor')").select(F.col("file").alias("file_path"), "line")
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "kind", "file_path", "line_start", "line_end"]).filter("not coalesce(is_deleted, false) and kind <> 'module'")
    return L.innermost(sites, nodes)


@query(f"""with {_N}, {_SITES}, a as (select distinct s.file as file_path, n.name from sites s join n on n.id = s.target where s.type in ('calls', 'constructor') and n.name is not null),
d as (select id, name, file_path from live where kind not in ('module', 'export_statement') and name is not null),
l as (select file_path, name, min(id) as local from d group by all), u as (select name, min(id) as only_one from d group by name having count(*) = 1)
select a.file_path, a.name, coalesce(local, only_one) as id, case when local is not null then 'same file' when only_one is not null then 'unique name' else 'unresolved' end as how
from a left join l on a.file_path is not distinct from l.file_path and a.name = l.name left join u on a.name = u.name""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve_names(_named_sites(spark, sf_dir, ["calls", "constructor"]), _declarations(spark, sf_dir))


_DECL = "d as (select id, name, file_path, parent_id from live where kind not in ('module', 'export_statement') and name is not null)"
_ASKED = """asked as (select distinct s.file as file_path, s.source, s.receiver, n.name from sites s join n on n.id = s.target where s.type in ('calls', 'constructor') and n.name is not null)"""
_MEMBERS_SQL = r"""own as (select *, regexp_replace(coalesce(receiver, ''), '^(?:this\.|self\.|\$this->|\$)', '') as r from asked),
owner as (select own.source, own.receiver, own.name, case when r in ('this', 'self') then p.parent_id else f.id end as owner from own left join d p on p.id = own.source left join (select name, min(id) as id from d group by name) f on f.name = own.r where r <> ''),
member as (select distinct o.source, o.receiver, o.name, m.id from owner o join (select parent_id, name, min(id) as id from d where parent_id is not null group by all) m on m.parent_id = o.owner and m.name = o.name)"""


@query(f"with {_N}, {_SITES}, {_DECL}, {_ASKED}, {_MEMBERS_SQL} select * from member")
def receiver_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.receiver_members(_named_sites(spark, sf_dir, ["calls", "constructor"]), _declarations(spark, sf_dir))


@query(f"""with {_N}, {_SITES}, {_DECL}, {_ASKED}, {_MEMBERS_SQL},
brought as (select s.file as file_path, n.name, min(n.id) as id from sites s join n on n.id = s.target where s.type = 'import' and n.name is not null group by all),
l as (select file_path, name, min(id) as id from d group by all), u as (select name, min(id) as id from d group by name having count(*) = 1)
select a.file_path, a.source, a.receiver, a.name, coalesce(l.id, b.id, m.id, u.id) as id,
case when l.id is not null then 'same file' when b.id is not null then 'import' when m.id is not null then 'receiver' when u.id is not null then 'unique name' else 'unresolved' end as how
from asked a left join l on l.file_path = a.file_path and l.name = a.name left join brought b on b.file_path = a.file_path and b.name = a.name
left join member m on m.source = a.source and m.receiver = a.receiver and m.name = a.name left join u on u.name = a.name""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four steps of the link step: same file, imported name, member of the receiver's owner, only one of that name."""
    brought = _named_sites(spark, sf_dir, ["import"]).filter("name is not null").select("file_path", "name", F.col("meant").alias("id"))
    return L.resolve_references(_named_sites(spark, sf_dir, ["calls", "constructor"]), _declarations(spark, sf_dir), brought)


@query(f"""with {_N}, {_SITES}, {_DECL}, h as (select target as source, file, callback, priority from sites where type = 'listens_hook' and callback is not null),
l as (select file_path, name, min(id) as id from d group by all), f as (select name, min(id) as id from d group by name),
x as (select h.source, coalesce(l.id, f.id) as target, h.priority from h left join l on l.file_path = h.file and l.name = h.callback left join f on f.name = h.callback)
select source, target, count(*)::double as weight, min(priority) as priority from x where target is not null group by all""")
def event_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event calls: the callbacks that its listeners name."""
    sites = _sites(spark, sf_dir).filter("type = 'listens_hook'").withColumnRenamed("file", "file_path")
    return L.dispatches(sites, _declarations(spark, sf_dir))


@query(f"""with {_N}, k as (select *, kind in ('function_definition', 'method_declaration', 'method_definition', 'function_declaration') and name is not null as many from live)
select id from (select id, many, row_number() over (partition by many, file_path, name order by line_start desc nulls last, column_start desc nulls last, id desc) as r from k) where not coalesce(many, false) or r = 1""")
def overload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "name", "kind", "file_path", "line_start", "column_start"]).filter("not coalesce(is_deleted, false)")
    return L.overload_survivors(nodes).select("id")


@query(f"""with {_N} select t.file_path, count(*) as n_exports, min(t.line_start) as first_line, max(t.line_end) as last_line
from (select distinct target from e where type = 'export') x join n t on x.target = t.id group by t.file_path""")
def exports_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = graph_edges(spark, sf_dir, []).filter("type = 'export'").select(F.col("target").alias("id")).distinct()
    return graph_nodes(spark, sf_dir, ["file_path", "line_start", "line_end"]).join(targets, "id").groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_exports"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line")
    )


@query(f"""with {_N}, c as (select target as event, count(distinct source) filter (type = 'fires_hook') as n_firing, count(distinct source) filter (type = 'listens_hook') as n_listening from e where type in ('fires_hook', 'listens_hook') group by target)
select *, n_firing * n_listening as n_links from c""")
def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.event_links(stored_links(spark, sf_dir).filter("source is not null"))


@query(f"""with {_N}, d as (select distinct regexp_extract(file_path, '^([^/]+(?:/(?:packages/[^/]+|src|lib|app))?)/', 1) as dir from live where file_path is not null)
select f.file_path, arg_max(dir, length(dir)) as dir from (select distinct file_path from live where file_path is not null) f left join d on starts_with(f.file_path, d.dir || '/') group by f.file_path""")
def owning_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _areas(spark, sf_dir).select("file_path")
    dirs = files.select(F.regexp_extract("file_path", r"^([^/]+(?:/(?:packages/[^/]+|src|lib|app))?)/", 1).alias("dir")).filter("dir <> ''")
    return L.longest_prefix(files, dirs)


# Storage.


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_files").select("file_path", "loaded_at", "repo_hash", S.content_hash(F.col("source_text")).alias("content_hash"))
    return current_rows(rows, ["file_path"], ["repo_hash", "content_hash"], "loaded_at")


@query(f"with {_FILES} select file_path, repo_hash, sha256(source_text) as content_hash from cf")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(spark, sf_dir).select("file_path", "repo_hash", "content_hash")


@query(f"""with {_FILES} select coalesce(m.file_path, c.file_path) as file_path, coalesce(m.repo_hash, c.repo_hash) as repo_hash,
case when m.file_path is null then 'added' when c.file_path is null then 'deleted' when m.content_hash is not distinct from sha256(c.source_text) then 'same' else 'changed' end as change
from manifest m full join cf c on m.file_path = c.file_path and m.repo_hash = c.repo_hash""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.manifest_diff(table(spark, sf_dir, "manifest"), _hashes(spark, sf_dir))


@query(f"with {_N} select id, is_deleted, indexed_at from cur")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows applied in order of time: the newest state of each node."""
    return current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted"])


@query(f"with {_N} select parent_id as source, id as target, 'contains' as type, 1.0::double as weight from live where parent_id is not null")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contains_edges(current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "parent_id"]).filter("not coalesce(is_deleted, false)"))


@query(f"""with {_N}, {_FILES}, ch as (select c.file_path from cf c left join manifest m on m.file_path = c.file_path and m.repo_hash = c.repo_hash where m.file_path is null or m.content_hash is distinct from sha256(c.source_text)),
g as (select id from live where file_path in (select file_path from ch))
select source, target, type from e where source not in (select id from g) and target not in (select id from g) and source is not null and target is not null""")
def edges_after_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that stay when the changed files are cleared before they are indexed again."""
    diff = S.manifest_diff(table(spark, sf_dir, "manifest"), _hashes(spark, sf_dir)).filter("change in ('added', 'changed')")
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "file_path"]).filter("not coalesce(is_deleted, false)")
    edges = graph_edges(spark, sf_dir, []).filter("source is not null and target is not null")
    return S.clear_files(nodes, edges, diff)[1].select("source", "target", "type")


@query(f"""with {_N}, c as (select repo_hash, count(*) as node_count, count(distinct file_path) as file_count from live group by repo_hash)
select r.repo_hash, coalesce(c.node_count, r.node_count) as node_count, coalesce(c.file_count, r.file_count) as file_count, r.commit_hash,
c.node_count is distinct from r.node_count or c.file_count is distinct from r.file_count as stale from repos r left join c using (repo_hash)""")
def repo_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "repos")
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "file_path", "repo_hash"]).filter("not coalesce(is_deleted, false)")
    counts = nodes.groupBy("repo_hash").agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct("file_path").alias("file_count"))
    update = counts.withColumns({"commit_hash": F.lit(None).cast("string"), "schema_version": F.lit(None).cast("string")})
    new = S.snapshot(repos, update).select("repo_hash", "node_count", "file_count", "commit_hash")
    old = repos.select("repo_hash", F.col("node_count").alias("_n"), F.col("file_count").alias("_f"))
    known = counts.select("repo_hash", F.lit(True).alias("_k"))
    stale = ~(F.when(F.col("_k"), F.col("node_count")).eqNullSafe(F.col("_n")) & F.when(F.col("_k"), F.col("file_count")).eqNullSafe(F.col("_f")))
    return new.join(old, "repo_hash").join(known, "repo_hash", "left").select("repo_hash", "node_count", "file_count", "commit_hash", stale.alias("stale"))


@query("""select d.code, d.severity, count(*) as n_diagnostics, count(distinct d.filePath) as n_files, count(d.range) as n_placed
from (select unnest(diagnostics) as d from index_runs) group by all""")
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "index_runs").select(F.explode("diagnostics").alias("d"))
    return d.groupBy("d.code", "d.severity").agg(F.count(F.lit(1)).alias("n_diagnostics"), F.count_distinct("d.filePath").alias("n_files"), F.count("d.range").alias("n_placed"))


_SOURCE = """src as (select live.id, json_extract_string(case when json_valid(metadata_json) then metadata_json end, '$.source_code') as kept, offset_start as o, offset_end as p, line_start as a, line_end as b,
regexp_replace(cf.source_text, '([\\x{10000}-\\x{10FFFF}])', '\\1' || chr(65535), 'g') as u, regexp_split_to_array(cf.source_text, '\\r?\\n') as l from live left join cf on live.file_path = cf.file_path),
source as (select id, case when coalesce(kept, '') <> '' then kept when o >= 0 and p >= o then replace(substring(u, o + 1, p - o), chr(65535), '') when a >= 1 then array_to_string(list_slice(l, a, b), chr(10)) end as s from src)"""


@query(f"with {_N}, {_FILES}, {_SOURCE} select id, md5(s) as source_md5 from source")
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source_slice(_placed_nodes(spark, sf_dir), _texts(spark, sf_dir)).select("id", F.md5(F.col("source").cast("binary")).alias("source_md5"))


def _placed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["file_path", "line_start", "line_end", "offset_start", "offset_end", "metadata_json"]
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", *columns]).filter("not coalesce(is_deleted, false)")
    return nodes.select("id", *columns[:-1], F.try_variant_get(F.try_parse_json("metadata_json"), "$.source_code", "string").alias("inline"))


def _texts(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """The current texts, of ``files`` alone where given. The newest rows are found by their times, so older texts aren't moved."""
    rows = table(spark, sf_dir, "source_files").select("file_path", "loaded_at", "source_text")
    if files is not None:
        rows = rows.join(files.select("file_path").distinct(), "file_path", "left_semi")
    return current_rows(rows, ["file_path"], ["source_text"], "loaded_at")


REGISTRY = Registry()
_ES_IMPORT, _PY_IMPORT, _PHP_IMPORT = (REGISTRY.import_patterns()[x] for x in ("ts", "py", "php"))


@query(f"""with {_FILES}, m as (
select file_path, unnest(regexp_extract_all(source_text, '{_ES_IMPORT.replace(chr(39), chr(39) * 2)}', 1)) as module from cf where regexp_matches(file_path, '\\.(ts|mts|js|mjs)$')
union all select file_path, unnest(list_concat(regexp_extract_all(source_text, '{_PY_IMPORT}', 1), regexp_extract_all(source_text, '{_PY_IMPORT}', 2))) from cf where file_path like '%.py'
union all select file_path, unnest(regexp_extract_all(source_text, '{_PHP_IMPORT}', 1)) from cf where file_path like '%.php')
select file_path, module, count(*) as n_imports from m where module <> '' group by all""")
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that the current texts import, read where the texts lie."""
    rows = table(spark, sf_dir, "source_files")
    found = REGISTRY.imported_modules(F.col("file_path"), F.col("source_text"))
    newest = current_rows(rows.select("file_path", "loaded_at", found.alias("modules")), ["file_path"], ["modules"], "loaded_at")
    each = newest.select("file_path", F.explode("modules").alias("module"))
    return each.groupBy("file_path", "module").agg(F.count(F.lit(1)).alias("n_imports"))


_FIRE, _LISTEN = r"\bdo_action\s*\(\s*['\"]([^'\"]+)['\"]", r"\badd_action\s*\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"](?:\s*,\s*(\d+))?(?:\s*,\s*(\d+))?)?"
_q = lambda regex: regex.replace("'", "''")


@query(f"""with {_FILES}, f as (select file_path, 'fire' as direction, unnest(regexp_extract_all(source_text, '{_q(_FIRE)}', 1)) as event, '' as callback from cf where file_path like '%.php'),
l as (select file_path, 'listen' as direction, unnest(regexp_extract_all(source_text, '{_q(_LISTEN)}', 1)) as event, unnest(regexp_extract_all(source_text, '{_q(_LISTEN)}', 2)) as callback from cf where file_path like '%.php')
select file_path, direction, event, callback, count(*) as n_calls from (select * from f union all select * from l) group by all""")
def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in current PHP texts that fire or hear a named event."""
    rows = table(spark, sf_dir, "source_files").filter(F.col("file_path").endswith(".php"))
    newest = current_rows(rows.select("file_path", "loaded_at", REGISTRY.event_calls(F.col("source_text")).alias("calls")), ["file_path"], ["calls"], "loaded_at")
    return newest.select("file_path", F.inline("calls")).groupBy("file_path", "direction", "event", "callback").agg(F.count(F.lit(1)).alias("n_calls"))


# Search.

_FIELDS = ["name", "file_path", "domain", "summary", "doc"]
_DOCS = """d as (select id, name, kind, file_path, domain, case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.doc') end as doc,
case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.summary') end as summary from n)"""


def _documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir, ["name", "kind", "file_path", "domain", "metadata_json"])
    meta = F.try_parse_json("metadata_json")
    return nodes.withColumns({c: F.try_variant_get(meta, f"$.{c}", "string") for c in ("doc", "summary")}).drop("metadata_json")


_TERMS = Q.query_terms(SEARCH)


_WORDS = """t as (select id as node_id, regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''), coalesce(file_path, ''), coalesce(domain, ''), coalesce(summary, ''), coalesce(doc, ''))), '([\\p{L}\\p{N}]+)', 1) as w from d),
l as (select node_id, len(w) as doc_len, w from t where len(w) > 0), st as (select count(*) as n_docs, avg(doc_len) as av from l),
p as (select node_id, doc_len, unnest(w) as term from l)"""
_SCORE = f"greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * ({Q.K1} + 1) / (tf + {Q.K1} * (1 - {Q.B} + {Q.B} * doc_len / av))"
_BM25_CTE = f"""{_WORDS}, h as (select node_id, doc_len, q, count(*) as tf from p, (select unnest({_TERMS!r}) as q) where starts_with(term, q) group by all),
f as (select q, count(*) as df from h group by q), hits as (select node_id, round(-sum({_SCORE}), 6) as rank from h join f using (q), st group by node_id order by rank, node_id limit 50)"""


@query(f"with {_N}, {_DOCS}, {_BM25_CTE} select node_id, rank from hits")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Q.postings(_documented(spark, sf_dir), _FIELDS)
    stats = index.select("node_id", "doc_len").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("a")).first()
    return Q.bm25(index, stats["n"], stats["a"] or 1.0, _TERMS)


@query(f"""with {_N}, {_DOCS}, {_WORDS},
asked as (select doc_id as query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(coalesce(text, ''), '([^\\r\\n]*[\\p{{L}}\\p{{N}}][^\\r\\n]*)', 1)), '([\\p{{L}}\\p{{N}}]+)', 1), lambda w: length(w) > 1 and not list_contains({Q.STOP_WORDS!r}, w)))) as q from documents where doc_id % 100 = 0),
h as (select node_id, doc_len, q, count(*) as tf from p join (select distinct q from asked) on starts_with(term, q) group by all), f as (select q, count(*) as df from h group by q),
r as (select query_id, node_id, round(-sum({_SCORE}), 6) as rank from h join f using (q) join asked using (q), st group by query_id, node_id)
select query_id, node_id, rank from (select *, row_number() over (partition by query_id order by rank, node_id) as k from r) where k <= 50""")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 as a query, by its first line with a word, against all nodes."""
    line = F.regexp_extract(F.coalesce("text", F.lit("")), r"([^\r\n]*[\p{L}\p{N}][^\r\n]*)", 1)
    queries = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(Q.text_terms(line)).alias("term"))
    stored = table(spark, sf_dir, "nodes").count() + table(spark, sf_dir, "shared_nodes").count()
    return Q.bm25_many_texts(_documented(spark, sf_dir), _FIELDS, queries, rows=stored)


@query(f"with {_N}, {_DOCS} select id, 0.0::double as rank from n where coalesce(name ilike '%lattice%', false) or coalesce(file_path ilike '%lattice%', false) or coalesce(metadata_json ilike '%lattice%', false) order by id limit 50")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.like_search(graph_nodes(spark, sf_dir, ["name", "file_path", "metadata_json"]), "lattice", ["name", "file_path", "metadata_json"])


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(doc, '\r\n?', chr(10), 'g'), '^\s*/\*+|\*+/\s*$', '', 'g'), '(?m)^[ \t]*(?:\*+|#+)[ \t]?', '', 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"""with {_N}, {_DOCS}, c as (select id as path, name as title, trim({_CLEAN}) as doc from d where kind not in ('module', 'export_statement', 'event'))
select path, title, trim(string_split(doc, chr(10))[1]) as summary, '# ' || coalesce(title, '') || chr(10) || chr(10) || doc as content from c where doc <> ''""")
def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.wiki_pages(_documented(spark, sf_dir))


# Compositions.


@query(f"""with {_N} select id, name, file_path from n where kind <> 'module' and parent_id is null
and (lower(file_path) like '%main.%' or lower(file_path) like '%index.%' or lower(file_path) like '%server.%' or lower(file_path) like '%app.%')""")
def entry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level nodes of files that are named like a program's entry."""
    low, hit = F.lower("file_path"), F.lit(False)
    for word in ("main.", "index.", "server.", "app."):
        hit = hit | low.contains(word)
    return graph_nodes(spark, sf_dir, ["name", "kind", "file_path", "parent_id"]).filter("kind <> 'module' and parent_id is null").filter(hit).select("id", "name", "file_path")


@query(f"""with {_N}, g as (select coalesce(cast(community_id as varchar), 'area:' || case
when regexp_matches(file_path, '/packages/extensions/[^/]+') then regexp_extract(file_path, '/packages/(extensions/[^/]+)', 1)
when regexp_matches(file_path, '/packages/[^/]+') then regexp_extract(file_path, '/packages/([^/]+)', 1)
when coalesce(domain, '') <> '' then domain when regexp_matches(file_path, '/src/[^/]+') then regexp_extract(file_path, '/src/([^/]+)', 1) else 'project' end) as grp from n)
select grp, count(*) as n_nodes from g group by grp""")
def visual_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a drawing: the stored community, else an area guessed from path and domain."""
    path, first = F.col("file_path"), lambda r: F.regexp_extract("file_path", r, 1)
    area = (
        F.when(path.rlike("/packages/extensions/[^/]+"), first("/packages/(extensions/[^/]+)")).when(path.rlike("/packages/[^/]+"), first("/packages/([^/]+)"))
        .when(F.coalesce("domain", F.lit("")) != "", F.col("domain")).when(path.rlike("/src/[^/]+"), first("/src/([^/]+)")).otherwise("project")
    )
    nodes = graph_nodes(spark, sf_dir, ["file_path", "domain", "community_id"])
    return nodes.groupBy(F.coalesce(F.col("community_id").cast("string"), F.concat(F.lit("area:"), area)).alias("grp")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""with recursive {_N}, p as (select l.id, l.file_path, m.id as above from live l left join live m on l.parent_id = m.id),
ok as (select id from live where {_SCOPE}),
t as (select id, case when id in (select id from ok) then id end as last_ok, cast(null as varchar) as parent_id, 0 as depth from p where above is null
 union all select p.id, case when p.id in (select id from ok) then p.id else t.last_ok end, t.last_ok, t.depth + case when p.above in (select id from ok) then 1 else 0 end from p join t on p.above = t.id)
select id, parent_id, depth from t where id in (select id from ok)""")
def scoped_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containment forest of the nodes in scope, with children of dropped nodes moved up."""
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "parent_id", "file_path"]).filter("not coalesce(is_deleted, false)")
    plan = load_plans(table(spark, sf_dir, "nodes").select("parent_id"), ["parent_id"])["parent_id"]
    return L.promoted_parents(hierarchy(nodes.select("id", "parent_id"), plan), nodes.filter(in_scope(F.col("file_path"), SCOPES, EXCLUDES)))


def _import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(spark, sf_dir).select("file_path", "module")


@query(f"""with {_FILES}, m as (
select file_path, unnest(regexp_extract_all(source_text, '{_ES_IMPORT.replace(chr(39), chr(39) * 2)}', 1)) as module from cf where regexp_matches(file_path, '\\.(ts|mts|js|mjs)$')
union all select file_path, unnest(list_concat(regexp_extract_all(source_text, '{_PY_IMPORT}', 1), regexp_extract_all(source_text, '{_PY_IMPORT}', 2))) from cf where file_path like '%.py'
union all select file_path, unnest(regexp_extract_all(source_text, '{_PHP_IMPORT}', 1)) from cf where file_path like '%.php'),
a as (select distinct file_path, module, string_split(regexp_replace(file_path, '/[^/]*$', ''), '/') as f, length(regexp_extract(module, '^((?:\\.\\./)*)', 1)) // 3 as ups from m where module <> ''),
b as (select file_path, module, array_to_string(f[1:greatest(len(f) - ups, 0)], '/') || '/' || regexp_replace(module, '^(?:\\./|(?:\\.\\./)+)', '') as rel, f[1] as repo, replace(module, '.', '/') as dotted from a),
c as (select file_path, module, s.i as n, rel || s.x as path from b, (select unnest({list(L.SUFFIXES)!r}) as x, unnest(range({len(L.SUFFIXES)})) as i) s where regexp_matches(module, '^\\.\\.?/')
 union all select file_path, module, s.i, repo || s.a || dotted || s.z from b, (values (0, '/', '.py'), (1, '/', '/__init__.py'), (2, '/src/', '.py'), (3, '/src/', '/__init__.py')) s(i, a, z) where not regexp_matches(module, '^\\.\\.?/') and file_path like '%.py'),
r as (select file_path, module, arg_min(path, n) as resolved from c where path in (select file_path from cf) group by all)
select b.file_path, b.module, r.resolved from b left join r using (file_path, module)""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve_imports(_import_rows(spark, sf_dir), table(spark, sf_dir, "source_files").select("file_path"))


@query(f"""with {_N} select coalesce(try_cast(case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.depth') end as int), -1) as depth,
coalesce(length(case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.doc') end), 0) > 0 as has_doc, count(*) as n_nodes from n group by all""")
def metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemaless column as typed ones; null, empty and cut-off JSON has none."""
    meta = F.try_parse_json("metadata_json")
    depth, doc = F.try_variant_get(meta, "$.depth", "int"), F.try_variant_get(meta, "$.doc", "string")
    nodes = graph_nodes(spark, sf_dir, ["metadata_json"])
    return nodes.groupBy(F.coalesce(depth, F.lit(-1)).alias("depth"), (F.coalesce(F.length(doc), F.lit(0)) > 0).alias("has_doc")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"with {_N}, {_FILES}, {_SOURCE}, {_DOCS}, {_BM25_CTE}, best as (select node_id as id, rank from hits order by rank, node_id limit 8) select best.id, n.name, best.rank, substring(source.s, 1, 3000) as context from best join n using (id) join source using (id)")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best hits of a search, each with the first 3,000 characters of its source."""
    hits = bm25_search(spark, sf_dir).orderBy("rank", "node_id").limit(8).select(F.col("node_id").alias("id"), "rank")
    return _with_context(spark, sf_dir, hits)


def _with_context(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """Nodes of ``ids`` with their name and the first 3,000 characters of their source; only their files' texts are moved."""
    nodes = _placed_nodes(spark, sf_dir).join(ids.select("id"), "id", "left_semi")
    context = S.source_slice(nodes, _texts(spark, sf_dir, nodes)).select("id", F.substring("source", 1, 3000).alias("context"))
    return ids.join(graph_nodes(spark, sf_dir, ["name"]).select("id", "name"), "id").join(context, "id")


@query(f"with {_N}, {_FILES}, {_SOURCE}, g as (select n.id, n.name from n join live using (id) where n.kind = 'interface_declaration') select g.id, g.name, substring(source.s, 1, 3000) as context from g join source using (id)")
def node_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given nodes, here all interfaces, with the begin of their source."""
    return _with_context(spark, sf_dir, graph_nodes(spark, sf_dir, ["kind"]).filter("kind = 'interface_declaration'").select("id"))


_PAGES = r"""pages as (select regexp_extract(page_path, '([^/\\\\]*)$', 1) as path, coalesce(text, '') as content, updated_at from documents where page_path is not null)"""


@query(f"""with {_PAGES} select path, regexp_replace(path, '\\.md$', '') as title, length(arg_max(content, {{'t': updated_at, 'c': content}})) as n_chars, max(updated_at) as updated_at from pages group by path""")
def wiki_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents upserted as pages: the newest of each path."""
    pages = Q.newest_pages(Q.markdown_pages(table(spark, sf_dir, "documents")))
    return pages.select("path", "title", F.length("content").cast("bigint").alias("n_chars"), "updated_at")


@query(f"""with {_N}, {_DEGREE}, {_TIER}, {_MEMBERS} select (select count(*) from n) as n_nodes, (select count(*) from e) as n_edges, (select count(*) from tier join n using (id) where tier = 'god') as n_gods, (select count(distinct community) from m) as n_communities""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of a report, one row."""
    nodes, gods, members = graph_nodes(spark, sf_dir, []), god_nodes(spark, sf_dir), _area_members(spark, sf_dir)
    edges = graph_edges(spark, sf_dir, [])
    parts = [nodes.agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count(F.lit(1)).alias("n_edges")), gods.agg(F.count(F.lit(1)).alias("n_gods")), members.agg(F.count_distinct("community").alias("n_communities"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])  # one row each


@query(f"with {_N} select source, target, type from e where type = 'contains'")
def edges_before_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_links(graph_nodes(spark, sf_dir, ["kind"]), graph_edges(spark, sf_dir, []))[1].select("source", "target", "type")


@query(f"with {_N} select id, name, kind, file_path from n where id in (select source from e where type = 'implements')")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by id, here those that implement something; unknown ids give no row."""
    ids = stored_links(spark, sf_dir).filter("type = 'implements'").select(F.col("source").alias("id")).distinct()
    return graph_nodes(spark, sf_dir, ["name", "kind", "file_path"]).join(ids, "id", "left_semi")


@query(f"""with {_N}, g as (select id, count(*) as d from (select source as id from e where type <> 'contains' union all select target from e where type <> 'contains') group by id),
r as (select n.repo_hash, n.id, d, row_number() over (partition by n.repo_hash order by d desc, n.id) as k from n join g on n.id = g.id where n.repo_hash is not null and kind not in ('event', 'module'))
select repo_hash, id, d as degree from r where k = 1""")
def busiest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each repository the node with the most edges, ``contains`` aside."""
    d = A.degrees(graph_edges(spark, sf_dir, []).filter("type <> 'contains'")).select("id", "degree")
    nodes = graph_nodes(spark, sf_dir, ["repo_hash", "kind"]).filter("repo_hash is not null and kind not in ('event', 'module')").join(d, "id")
    best = nodes.groupBy("repo_hash").agg(F.max("degree").alias("degree"), F.min_by("id", F.struct(-F.col("degree"), "id")).alias("id"))
    return best.select("repo_hash", "id", "degree")
