"""Graph analytics: degrees, tiers, domains, communities."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.balance import LoadPlan, balanced_join
from codeloom.operators.graph import components
from codeloom.plans.lineage import cut_round

# How strongly an edge type binds two files; any other type counts 1.
TYPE_WEIGHTS = {
    "extends": 9.0, "implements": 8.0, "import": 6.0, "fires_hook": 5.0, "listens_hook": 5.0, "dispatches": 5.0,
    "calls": 3.0, "constructor": 3.0, "return_type": 2.0, "return": 2.0, "type": 2.0, "export": 1.5,
}
AREA_AFFINITY = 0.35
TIERS = {"god": 0.95, "high": 0.80, "mid": 0.50}
TIER_RANK = {"god": 0, "high": 1, "mid": 2, "low": 3}


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``in_degree``, ``out_degree``, ``degree`` of every id that an edge names; a self-loop counts twice."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"))))
    flat = edges.select(ends.alias("e")).select("e.id", "e.o").filter(F.col("id").isNotNull())
    both = flat.groupBy("id").agg(F.sum(1 - F.col("o")).alias("in_degree"), F.sum("o").alias("out_degree"))
    return both.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def tiers(degree: DataFrame) -> DataFrame:
    """``id``, ``degree``, ``tier``: above the 95th, 80th, 50th nearest-rank percentile of the degrees, strictly."""
    # Nearest rank from the distribution of degrees, which has one row a degree: no sort of all nodes.
    spread = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    ladder = spread.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).crossJoin(F.broadcast(spread.agg(F.sum("n").alias("all"))))
    marks = ladder.agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), F.col("degree"))).alias(t) for t, q in TIERS.items()])
    tier = F.when(F.col("degree") > F.col("god"), "god").when(F.col("degree") > F.col("high"), "high").when(F.col("degree") > F.col("mid"), "mid").otherwise("low")
    return degree.crossJoin(F.broadcast(marks)).select("id", "degree", tier.alias("tier"))  # marks is one row


def area(path: Column) -> Column:
    """The part of a repository that a file belongs to, from its path below the repository's folder."""
    tail = F.regexp_replace(path, r"^.*/packages/", "packages/")
    parts = F.split(tail, "/")
    n, first = F.size(parts), parts[0]
    return (
        F.when((first == "packages") & (parts[1] == "extensions") & (n > 2), F.concat_ws("/", F.slice(parts, 1, 3)))
        .when(first.isin("packages", "apps", "src", "lib") & (n > 1), F.concat_ws("/", F.slice(parts, 1, 2)))
        .when(n > 1, first).otherwise("root")
    )


def below_repo(path: Column) -> Column:
    """A path without its first folder, the repository's."""
    return F.regexp_replace(path, "^[^/]+/", "")


def domain(path: Column, configured: list[tuple[str, str]] = ()) -> Column:
    """The first configured domain whose glob matches, else the first folder with a capital, ``Misc`` for none."""
    from codeloom.functions.globs import glob_regex

    first = F.split(path, "/")[0]
    plain = F.when(first == "", "Misc").otherwise(F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1_000_000)))
    out = None
    for name, glob in configured:
        match = path.rlike(glob_regex(glob))
        out = F.when(match, name) if out is None else out.when(match, name)
    return plain if out is None else out.otherwise(plain)


def type_weight(kind: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])
    return F.coalesce(pairs[kind], F.lit(1.0))


def file_pair_weights(edges: DataFrame, files: DataFrame, areas: DataFrame, loads: LoadPlan | None = None) -> DataFrame:
    """Affinity of file pairs: ``a`` < ``b``, ``weight``.

    ``files`` maps ``id`` to ``file_path``; edges inside a file and ``contains``
    are skipped. Consecutive files of an area (``areas``: ``file_path``,
    ``area``) get a weak affinity on top. Null weights count as 1.
    ``loads`` is the load of ``target``, by which the hot ones are split.
    """
    s = files.select(F.col("id").alias("source"), F.col("file_path").alias("f"))
    t = files.select(F.col("id").alias("target"), F.col("file_path").alias("g"))
    strength = type_weight(F.col("type")) * (1 + F.log2(F.greatest(F.lit(1.0), F.coalesce("weight", F.lit(1.0)))))
    started = edges.filter("type <> 'contains'").select("source", "target", strength.alias("w")).join(s, "source").select("f", "target", "w")
    linked = (balanced_join(started, t, "target", loads) if loads else started.join(t, "target")).filter("f <> g")
    strong = linked.select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b"), "w")
    order = Window.partitionBy("area").orderBy("file_path")
    weak = areas.select("area", "file_path").distinct().withColumn("a", F.lag("file_path").over(order)).filter("a is not null")
    near = weak.select("a", F.col("file_path").alias("b"), F.lit(AREA_AFFINITY).alias("w"))
    return strong.unionByName(near).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def communities(pairs: DataFrame, nodes: DataFrame, levels: int = 12, sweeps: int = 50, resolution: float = 1.0) -> DataFrame:
    """Communities of a weighted graph by Louvain's gain, moving nodes in bulk: ``id``, ``community``.

    ``pairs`` has ``a``, ``b``, ``weight``; ``nodes`` has ``id``. A sweep gives
    every node the gain of each neighbouring community from joins and sums, and
    moves those that gain: first the nodes of one half of a hash, then those of
    the other, so that two nodes don't swap for ever. Sweeps go on until none
    moves, then communities become nodes, until none merge; a level that still
    moves after ``sweeps``, or merges after ``levels``, is reported by a
    warning. At last a community falls into its connected parts. The result is
    deterministic; it isn't that of moving one node after another. The name of
    a community is its least id. A node without edges is alone.
    """
    both = pairs.filter("weight > 0 and a <> b").select("a", "b", "weight")
    first = graph = cut_round(both.union(both.select("b", "a", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    member = cut_round(nodes.select("id").distinct().select("id", F.col("id").alias("community")))
    total = graph.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return member
    for level in range(levels):
        own = cut_round(graph.groupBy("a").agg(F.sum("weight").alias("k")).withColumn("c", F.col("a")))
        for sweep in range(sweeps):
            changed = False
            for half in (0, 1):
                own, moved = _move_half(graph, own, F.pmod(F.xxhash64("a", F.lit(sweep)), F.lit(2)) == half, resolution / max(1.0, total))
                changed |= moved
            if not changed:
                break
        else:
            warnings.warn(f"communities: level {level} still moved nodes after {sweeps} sweeps", stacklevel=2)
        names = own.groupBy("c").agg(F.min("a").alias("name"))
        into = cut_round(own.join(names, "c").select("a", "name"))
        if into.filter("a <> name").isEmpty():  # as many communities as nodes
            break
        member = cut_round(member.join(into.withColumnRenamed("a", "community"), "community", "left").select("id", F.coalesce("name", "community").alias("community")))
        s, t = into.select("a", F.col("name").alias("x")), into.select(F.col("a").alias("b"), F.col("name").alias("y"))
        graph = cut_round(graph.join(s, "a").join(t, "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("weight").alias("weight")))
    else:
        warnings.warn(f"communities: still merging after {levels} levels", stacklevel=2)
    return connected_parts(member, first)


def _move_half(graph: DataFrame, own: DataFrame, turn: Column, per_degree: float) -> tuple[DataFrame, bool]:
    """Moves the nodes whose ``turn`` it is to the neighbouring community of the greatest gain, if above nothing and above staying."""
    state = own.join(own.groupBy("c").agg(F.sum("k").alias("tot")), "c")
    links = graph.filter("a <> b").filter(turn).join(state.select(F.col("a").alias("b"), "c", "tot"), "b").groupBy("a", "c").agg(F.sum("weight").alias("w"), F.max("tot").alias("tot"))
    here = F.col("c") == F.col("now")
    gain = F.round(F.col("w") - per_degree * F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)), 9)
    rated = links.join(own.select("a", "k", F.col("c").alias("now")), "a").select("a", "c", here.alias("here"), gain.alias("gain"))
    best = rated.groupBy("a").agg(
        F.max(F.when(F.col("here"), F.col("gain"))).alias("stay"), F.max(F.when(~F.col("here"), F.col("gain"))).alias("go"),
        F.min_by("c", F.when(~F.col("here"), F.struct(-F.col("gain"), F.col("c")))).alias("to"),
    )
    moves = best.filter(F.col("go") > F.greatest(F.lit(0.0), F.coalesce("stay", F.lit(0.0)))).select("a", "to")
    moved = cut_round(own.join(moves, "a", "left").select("a", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moves")))
    return moved.select("a", "k", "c"), not moved.filter("moves").isEmpty()


def connected_parts(member: DataFrame, links: DataFrame) -> DataFrame:
    """Splits communities (``id``, ``community``) into the parts that ``links`` (``a``, ``b``) connect inside them, named by their least id."""
    s, t = member.select(F.col("id").alias("a"), F.col("community").alias("x")), member.select(F.col("id").alias("b"), F.col("community").alias("y"))
    inner = links.join(s, "a").join(t, "b").filter("x = y").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return member.select("id").join(components(inner), "id", "left").select("id", F.coalesce("component", "id").alias("community"))


def community_pairs(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges between communities: ``cs``, ``ct``, ``n``; ``contains`` is left out.

    ``sources`` maps ``source`` to ``cs``, ``targets`` maps ``target`` to ``ct``.
    Edges are counted by the source's community and target before they go to
    the target, so a hot target comes with a row for each community.
    """
    started = edges.filter("type <> 'contains'").select("source", "target").join(sources, "source").groupBy("cs", "target").agg(F.count(F.lit(1)).alias("n"))
    return started.join(targets, "target").groupBy("cs", "ct").agg(F.sum("n").alias("n"))


def community_summary(members: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """``community``, ``size``, ``touching``, ``internal``, ``cohesion``, ``top_nodes`` (best tiers first, then by id).

    ``members`` has ``id``, ``community`` and ``tier``. Edges without both ends
    in a community and ``contains`` are left out. The best nodes are ranked
    within bounded parts first, so that no community meets in one task.
    """
    ids = members.select("id", "community").filter(F.col("community").isNotNull())
    s = ids.select(F.col("id").alias("source"), F.col("community").alias("cs"))
    t = ids.select(F.col("id").alias("target"), F.col("community").alias("ct"))
    both = community_pairs(edges, s, t)
    per = both.select(F.explode(F.when(F.col("cs") == F.col("ct"), F.array(F.struct(F.col("cs").alias("c"), F.col("n").alias("t"), F.col("n").alias("i")))).otherwise(
        F.array(F.struct(F.col("cs").alias("c"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("i")), F.struct(F.col("ct").alias("c"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("i"))))).alias("x"))
    sums = per.groupBy(F.col("x.c").alias("community")).agg(F.sum("x.t").alias("touching"), F.sum("x.i").alias("internal"))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv])[F.col("tier")], F.lit(4))
    ranked = members.filter(F.col("community").isNotNull()).select("community", "id", rank.alias("r"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    best = ranked.withColumn("n", F.row_number().over(Window.partitionBy("community", "part").orderBy("r", "id"))).filter(F.col("n") <= top)
    names = best.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("r", "id"))).filter(F.col("n") <= top).groupBy("community").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), ",").alias("top_nodes")
    )
    sizes = ids.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    zero = {"touching": 0, "internal": 0}
    out = sizes.join(sums, "community", "left").join(names, "community", "left").na.fill(zero)
    return out.select("community", "size", "touching", "internal", F.round(F.when(F.col("touching") > 0, F.col("internal") / F.col("touching")).otherwise(0.0), 6).alias("cohesion"), "top_nodes")


def top_in_groups(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with ``rank`` from 1: ranked within bounded parts first, so that no group meets in one task."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(64))
    first = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).filter(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= most).drop("_part")


def entry_nodes(nodes: DataFrame, calls: DataFrame, most: int = 20) -> DataFrame:
    """Where each repository's execution begins: ``repo_hash``, ``id``, ``reason``, ``rank``, at most ``most`` a repository.

    Top-level nodes of files that are named like an entry come first
    (``entry-file``: gods, then by line); a repository without any has its
    gods and highs that nothing calls (``no-callers``: gods, then by path).
    ``nodes`` has ``id``, ``repo_hash``, ``kind``, ``parent_id``,
    ``hierarchy_level``, ``file_path``, ``line_start``; ``calls`` the executable
    edges' ``target``. Ties go by id. Nodes without a repository have no entry.
    """
    level = F.lower(F.trim("hierarchy_level"))
    top = nodes.filter("kind <> 'module' and parent_id is null and repo_hash is not null").withColumn("_god", F.coalesce(level == "god", F.lit(False)))
    named = top.filter(F.lower("file_path").rlike(r"(?:main|index|server|app)\."))
    by_name = top_in_groups(named.select("repo_hash", "id", "_god", "line_start"), "repo_hash", [F.desc("_god"), F.asc_nulls_first("line_start"), F.asc("id")], most)
    rest = top.filter(level.isin("god", "high")).join(named.select("repo_hash").distinct(), "repo_hash", "left_anti").join(calls.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    by_calls = top_in_groups(rest.select("repo_hash", "id", "_god", "file_path"), "repo_hash", [F.desc("_god"), F.asc_nulls_first("file_path"), F.asc("id")], most)
    out = [x.select("repo_hash", "id", F.lit(reason).alias("reason"), "rank") for x, reason in ((by_name, "entry-file"), (by_calls, "no-callers"))]
    return out[0].unionByName(out[1])
