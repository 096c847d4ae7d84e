"""Traversals over typed edges as frontier joins.

Each level joins the frontier with the edges, keeps what is new and cuts the
lineage on shared storage. A frontier of at most ``SMALL_FRONTIER`` ids, counted
before, is broadcast; a larger one is shuffled, with hot ids split. Edges that end at unknown ids are followed
like all others; payloads are joined only at the end, by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.balance import LoadPlan, balanced_join, load_plans
from codeloom.plans.lineage import cut, cut_round

SMALL_FRONTIER = 50_000
EXECUTABLE = ("calls", "constructor", "fires_hook", "dispatches")
# Other spellings that an edge-type filter accepts.
TYPE_SPELLINGS = {
    "import": ("import", "imports"), "export": ("export", "exports"), "calls": ("call", "calls"),
    "constructor": ("constructor", "constructors"), "extends": ("extend", "extends"), "implements": ("implement", "implements"),
}


def of_types(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """Edges whose type is meant by one of ``types``, in any accepted spelling and case; all edges for none."""
    if not types:
        return edges
    asked = {t.lower() for t in types}
    meant = asked | {kind for kind, ways in TYPE_SPELLINGS.items() if asked & set(ways)}
    return edges.filter(F.col("type").isin(*sorted(meant)))


def executable(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("type").isin(*EXECUTABLE))


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: ``src``, ``dst``, ``type``, ``outgoing``. An equi join on ``src`` replaces an OR of two."""
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "type", F.lit(True).alias("outgoing"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), "type", F.lit(False).alias("outgoing"))
    return out.unionByName(back)


def directed(edges: DataFrame, reverse: bool = False) -> DataFrame:
    a, b = ("target", "source") if reverse else ("source", "target")
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))


def bfs(links: DataFrame, seeds: DataFrame, max_depth: int, until: str | None = None, most_nodes: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Breadth-first search: ``within``, ``id``, ``depth`` (0 for seeds), ``parent`` (the least one of the level above).

    ``links`` has ``src`` and ``dst``, ``seeds`` has ``id`` and the columns of
    ``within``, each combination of which is a search of its own. Stops at
    ``max_depth``, when nothing is new, once ``until`` is reached; a search with
    ``most_nodes`` visited begins no other level. Null ids are no nodes; no
    seeds or no links give the seeds alone. A small frontier is broadcast
    against the links as they are read; a large one joins with its hot ids
    split over several tasks.
    """
    step = links.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    keys = [*within, "id"]
    frontier = cut_round(seeds.filter(F.col("id").isNotNull()).select(*keys).distinct())
    visited = frontier.select(*keys, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    n = total = frontier.count()
    for depth in range(1, max_depth + 1):
        if most_nodes is not None and total >= most_nodes:  # else none of the searches can have so many
            full = visited.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= most_nodes)
            frontier = frontier.join(full, list(within), "left_anti") if within else frontier.filter(F.lit(full.isEmpty()))
            n = frontier.count()
        if not n:
            break
        near = _join_frontier(step, frontier.withColumnRenamed("id", "src"), "src", n)
        found = near.groupBy(*within, F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = cut_round(found.join(visited.select(*keys), keys, "left_anti").select(*keys, F.lit(depth).alias("depth"), "parent"))
        visited = visited.unionByName(new)
        frontier = new.select(*keys)
        n = frontier.count()
        total += n
        if until is not None and not new.filter(F.col("id") == until).isEmpty():
            break
    return visited


def _join_frontier(links: DataFrame, frontier: DataFrame, key: str, rows: int) -> DataFrame:
    """Links that begin (``key``) in a frontier of ``rows`` rows: broadcast if that is small, else with hot ids split."""
    if rows <= SMALL_FRONTIER:
        return links.join(F.broadcast(frontier), key)
    return balanced_join(links, frontier, key, load_plans(links, [key])[key])


def walked_edges(edges: DataFrame, visited: DataFrame, max_depth: int, reverse: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """The edges that a search went along, also to ids that it had seen: ``within``, ``source``, ``target``, ``type``.

    ``visited`` comes from `bfs` over the same edges; every id above
    ``max_depth`` was left by all its edges.
    """
    end = "target" if reverse else "source"
    left = visited.filter(F.col("depth") < max_depth).select(*within, F.col("id").alias(end)).distinct()
    return _join_frontier(edges, left, end, left.count()).select(*within, "source", "target", "type")


def call_chain(edges: DataFrame, roots: DataFrame, known: DataFrame, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Callers and callees of the roots, and the edges between: nodes (``id``, ``depth``, ``direction``) and edges.

    Each node once a direction, at its least depth; ids that ``known`` (``id``)
    doesn't have are no nodes, but their edges stay.
    """
    calls, nodes, ways = executable(edges), [], []
    for direction, reverse in (("caller", True), ("callee", False)):
        found = bfs(directed(calls, reverse), roots, max_depth)
        ways.append(walked_edges(calls, found, max_depth, reverse))
        nodes.append(found.filter("depth > 0").select("id", "depth", F.lit(direction).alias("direction")))
    return nodes[0].unionByName(nodes[1]).join(known.select("id"), "id", "left_semi"), ways[0].unionByName(ways[1]).distinct()


def execution_flow(edges: DataFrame, entries: DataFrame, max_depth: int = 5, most_nodes: int = 2000) -> tuple[DataFrame, DataFrame]:
    """What runs from each repository's entries: nodes (``repo_hash``, ``id``, ``depth``, ``parent``) and edges.

    ``entries`` has ``repo_hash`` and ``id``. A repository's flow begins no
    other level once it has ``most_nodes`` nodes.
    """
    calls = executable(edges)
    found = bfs(directed(calls), entries, max_depth, most_nodes=most_nodes, within=["repo_hash"])
    deepest = found.groupBy("repo_hash").agg(F.max("depth").alias("_deepest"), F.count(F.lit(1)).alias("_n"))
    stopped = found.join(deepest, "repo_hash").filter((F.col("_n") < most_nodes) | (F.col("depth") < F.col("_deepest"))).select("repo_hash", "id", "depth")
    return found, walked_edges(calls, stopped, max_depth, within=["repo_hash"]).distinct()


def shortest_path(links: DataFrame, start: str, goal: str, max_depth: int = 20) -> DataFrame:
    """The nodes of one shortest path: ``seq``, ``id``. Empty if there is none, one row if both ends are one.

    Of several shortest paths the one whose parents, from the goal back, are the least.
    """
    spark = links.sparkSession
    found = bfs(links, spark.createDataFrame([(start,)], "id string"), max_depth, until=goal)
    found = cut(found)
    end = found.filter(F.col("id") == goal).select("depth", "parent").first()
    if end is None:
        return spark.createDataFrame([], "seq int, id string")
    path, parent = [goal], end["parent"]
    for depth in range(end["depth"] - 1, -1, -1):  # one row a level
        path.append(parent)
        parent = found.filter((F.col("id") == parent) & (F.col("depth") == depth)).select("parent").first()["parent"]
    return spark.createDataFrame(list(enumerate(reversed(path))), "seq int, id string")


def induced(edges: DataFrame, ids: DataFrame, loads: LoadPlan | None = None) -> DataFrame:
    """Edges whose both ends are among ``ids``; ``loads`` is the load of ``target``, by which hot targets are split."""
    s, t = ids.select(F.col("id").alias("source")), ids.select(F.col("id").alias("target"))
    started = edges.join(s, "source", "left_semi")
    return balanced_join(started, t, "target", loads, "left_semi") if loads else started.join(t, "target", "left_semi")


def dependency_tree(edges: DataFrame, seeds: DataFrame, known: DataFrame, max_depth: int = 3, budget: int = 200, reverse: bool = False) -> DataFrame:
    """What the seeds depend on, or with ``reverse`` what depends on them: ``id``, ``depth``, ``parent``, ``truncated``.

    All edges but ``contains`` count. Nodes count against the budget by depth
    and id; ids without a node are left out, and so is what only they lead to.
    ``truncated`` says on every row that the budget is used up.
    """
    real = known.select(F.col("id").alias("dst"))
    links = directed(edges.filter("type <> 'contains'"), reverse).join(real, "dst", "left_semi")
    tree = cut(bfs(links, seeds, max_depth).filter("depth > 0").orderBy("depth", "id").limit(budget))
    return tree.select("id", "depth", "parent", F.lit(tree.count() >= budget).alias("truncated"))


def components(links: DataFrame) -> DataFrame:
    """Connected components: ``id``, ``component`` (its least id), by alternating large-star and small-star steps.

    ``links`` has ``src`` and ``dst``. A star step hooks every neighbour onto
    the least one, so the rounds grow with the logarithm of a component's size.
    Self-loops make a component of one.
    """
    pairs = links.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
    nodes = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    edges = cut_round(pairs.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut_round(small.union(small_low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    return nodes.join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
