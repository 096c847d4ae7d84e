"""Parent-child links to full hierarchies.

Only nodes with children can lie between two others, so the leaves are set
aside first. Of the rest, splitters are chosen by a hash of the id, the same
ones in every run. Every node walks to its next splitter, the walks composing
with one another, so a walk of length n takes log2(n) joins of the nodes still
on their way. The splitters with their pointers form a reduced graph that is
solved in the same manner: with other splitters while it is large, so that a
walk has about ``SPLITTER_EVERY`` steps whatever the depth of the tree, and at
last without any.
Exact paths come from joining every node's own stretch with its splitter's
path. A circle without a splitter shows when a walk meets its own start; it is
closed there and needs no splitter. Leaves hang below their parents at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.balance import LoadPlan, balanced_join, load_plans
from codeloom.plans.lineage import cut_round as cut

SPLITTER_EVERY = 8
DIRECT = 1_000  # a reduced graph of at most so many pointers needs no splitters; the result is the same
PLANNED = 1_000_000  # open walks from which on a join of theirs is planned by load; the result is the same

Merge = Mapping[str, Callable[[Column, Column], Column]]


def _open() -> Column:
    return F.lit(None).cast("string").alias("state")


def _splitter(column: str, level: int | None) -> Column:
    if level is None:
        return F.lit(False)
    return F.pmod(F.xxhash64(F.col(column), F.lit(level)), F.lit(SPLITTER_EVERY)) == 0


def _join_at(walks: DataFrame, ahead: DataFrame, rows: int, key: str = "at") -> DataFrame:
    """Joins walks with what is known of the node where they stand; one node may hold most walks."""
    if rows < PLANNED:
        return walks.join(ahead, key, "left")
    return balanced_join(walks, ahead, key, load_plans(walks, [key])[key], "left")


def _hop(walks: DataFrame, ahead: DataFrame, rows: int, merge: Merge) -> DataFrame:
    """Lets the open walks go on by the walk of the node where they stand."""
    is_open = F.col("state") == "open"
    joined = _join_at(walks.withColumn("_stand", F.when(is_open, F.col("at"))), ahead, rows, "_stand")
    found, more = F.col("_at").isNotNull(), F.coalesce("_seg", F.array().cast("array<string>"))
    moved = joined.select(
        "id", F.coalesce("_at", "at").alias("at"), F.concat("seg", more).alias("seg"), *[F.when(found, f(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, f in merge.items()],
        F.when(~is_open, F.col("state")).when(~found, "end").when(F.col("_state").isin("ring", "below"), "below").otherwise(F.col("_state")).alias("state"), (is_open & found).alias("_new"),
    )
    met = F.col("_new") & (F.array_position("seg", F.col("id")) > 0)
    return moved.select(
        "id", F.when(met, F.col("id")).otherwise(F.col("at")).alias("at"), F.when(met, F.slice("seg", 1, F.array_position("seg", F.col("id")).cast("int"))).otherwise(F.col("seg")).alias("seg"),
        *merge, F.when(met, "ring").otherwise(F.col("state")).alias("state"),
    )


def _walks(pointers: DataFrame, level: int | None, merge: Merge) -> DataFrame:
    """Every node's walk to its next splitter, or as far as it goes: ``id``, ``at``, ``seg``, ``state`` and the columns of ``merge``.

    ``pointers``: ``id``, ``at``, the columns of ``merge`` for the way between
    them, and ``state`` of those that are done already, else null. ``seg`` has
    the ids of this level that the walk went over, ``at`` the last. ``state`` is ``split`` at a splitter, ``end`` at an id that
    has no pointer, ``ring`` for a walk that met its own start and ``below`` for
    one that led into a ring it isn't on. Walks that are done stay as they were
    written; only open ones are written again.
    """
    first = pointers.select("id", "at", F.array("at").alias("seg"), *merge, F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("at") == F.col("id"), "ring").when(_splitter("at", level), "split").otherwise("open").alias("state"))
    is_open = F.col("state") == "open"
    done, going = [first.filter(~is_open)], first.filter(is_open)
    rows = going.count()
    while rows:
        every = reduce(DataFrame.unionByName, [*done, going])
        ahead = every.select(F.col("id").alias("_stand"), *[F.col(c).alias(f"_{c}") for c in ("at", "seg", "state", *merge)])
        moved = cut(_hop(_hop(going, ahead, rows, merge), ahead, rows, merge))  # three times as far in one round
        done.append(moved.filter(~is_open))
        going = moved.filter(is_open)
        rows = going.count()
    return reduce(DataFrame.unionByName, done)


def _next(level: int, rows: int) -> int | None:
    """The level of a reduced graph's splitters, none where it is small."""
    return level + 1 if rows > DIRECT else None


def linked_nodes(links: DataFrame) -> DataFrame:
    """``id`` and ``parent_id``, each id once: null ids are left out, of several rows the greatest parent stays."""
    return links.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("parent_id").alias("parent_id"))


def with_children(nodes: DataFrame) -> DataFrame:
    """The nodes that others name as their parent."""
    parents = nodes.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    return nodes.join(parents, "id", "left_semi")


def rings(links: DataFrame) -> DataFrame:
    """The nodes on circles of parents: ``id`` and ``cycle_id``, the smallest id on the circle.

    ``links`` has ``id`` and ``parent_id``. A node that is its own parent is a
    circle; nodes that only hang below one are not on it. Ids compare by bytes.
    A walk carries the least id on its way and no path, so a long chain or
    circle makes no long rows. No links give no rows.
    """
    inner = cut(with_children(linked_nodes(links)))
    return _on_rings(inner.filter(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("at"), F.col("parent_id").alias("least"), _open()), 0)


def _on_rings(pointers: DataFrame, level: int | None) -> DataFrame:
    walks = _walks(pointers, level, {"least": F.least})
    # A ring without a splitter has a walk for each of its nodes; one with a single splitter is the whole walk of that one.
    own = F.when(_splitter("id", level), F.col("seg")).otherwise(F.array("id"))
    closed = walks.filter("state = 'ring'").select(F.explode(own).alias("id"), F.col("least").alias("cycle_id"))
    if level is None:
        return closed
    turning = walks.filter(_splitter("id", level) & (F.col("state") == "split"))
    reduced = cut(turning.select("id", "at", "least", _open()))
    rows = reduced.count()
    if not rows:
        return closed
    # Every node on a circle with splitters lies on the stretch of one of them.
    through = turning.select("id", "seg").join(_on_rings(reduced, _next(level, rows)), "id").select(F.explode("seg").alias("id"), "cycle_id")
    return closed.unionByName(through)


def _placed(pointers: DataFrame, level: int | None, merge: Merge) -> DataFrame:
    """Of every node with a pointer where it leads in the end: ``id``, ``top``, ``state`` (tree, ring, below_ring) and the columns of ``merge``."""
    walks = _walks(pointers, level, merge)
    if level is None:
        return walks.select("id", F.col("at").alias("top"), F.when(F.col("state") == "ring", "ring").when(F.col("state") == "below", "below_ring").otherwise("tree").alias("state"), *merge)
    turning = walks.filter(_splitter("id", level))
    plain = F.when(F.col("state") == "ring", "ring").when(F.col("state") == "below", "below_ring").otherwise("tree").alias("state")
    reduced = cut(turning.select("id", "at", *merge, F.when(F.col("state") != "split", F.col("state")).alias("state")))
    rows = reduced.filter("state is null").count()
    if not rows:
        on = turning.filter("state = 'ring'").select(F.explode("seg").alias("id"), F.lit(True).alias("_on"))
        solved = turning.select("id", F.col("at").alias("top"), plain, *merge)
    else:
        solved = cut(_placed(reduced, _next(level, rows), merge))
        on = turning.select("id", "seg").join(solved.filter("state = 'ring'").select("id"), "id").select(F.explode("seg").alias("id"), F.lit(True).alias("_on"))
    ahead = solved.select(F.col("id").alias("at"), F.col("top").alias("_top"), F.col("state").alias("_state"), *[F.col(c).alias(f"_{c}") for c in merge])
    short, long = walks.filter("state <> 'split'"), walks.filter("state = 'split'")
    joined = _join_at(long, ahead, long.count()).join(on.distinct(), "id", "left")
    found = F.col("_top").isNotNull()  # else the splitter is a root
    return short.select("id", F.col("at").alias("top"), plain, *merge).unionByName(joined.select(
        "id", F.coalesce("_top", "at").alias("top"),
        F.when(F.col("_on"), "ring").when(F.col("_state").isin("ring", "below_ring"), "below_ring").otherwise("tree").alias("state"),
        *[F.when(found, f(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, f in merge.items()],
    ))


def hierarchy(links: DataFrame, plan: LoadPlan, paths: bool = True) -> DataFrame:
    """Path, depth and root of every node, or the circle that keeps it from having them.

    ``links`` has ``id`` and ``parent_id``; ``plan`` is the load of
    ``parent_id``. Result: ``id``, ``parent_id``, ``root``, ``depth`` (0 for a
    root), ``path`` (ids from the root to the node, left out without
    ``paths``), ``state`` (``tree``, ``ring`` or ``below_ring``) and
    ``parent_known``. A parent id that no row has makes its child a root. Nodes
    on or below a circle have null root, depth and path. No links give no rows.
    """
    nodes = linked_nodes(links)
    inner = cut(with_children(nodes))
    there = inner.select(F.col("id").alias("parent_id"), F.col("id").alias("above"))
    known = inner.join(there, "parent_id", "left").select("id", "above")
    merge: dict[str, Callable[[Column, Column], Column]] = {"n": lambda a, b: a + b}
    if paths:
        merge["up"] = F.concat
    pointers = cut(known).filter(F.col("above").isNotNull()).select("id", F.col("above").alias("at"), F.lit(1).cast("bigint").alias("n"), *([F.array("above").alias("up")] if paths else []), _open())
    placed = cut(_placed(pointers, 0, merge))
    tops = inner.select("id").join(placed.select("id"), "id", "left_anti").select(
        "id", F.col("id").alias("top"), F.lit("tree").alias("state"), F.lit(0).cast("bigint").alias("n"), *([F.array().cast("array<string>").alias("up")] if paths else [])
    )
    above = placed.unionByName(tops).select(F.col("id").alias("parent_id"), F.col("top").alias("_top"), F.col("state").alias("_state"), F.col("n").alias("_n"), *([F.concat(F.reverse("up"), F.array("id")).alias("_path")] if paths else []))
    hung = balanced_join(nodes.select("id", "parent_id"), above, "parent_id", plan, "left")
    ring = placed.filter("state = 'ring'").select("id", F.lit(True).alias("_on"))
    whole = hung.join(ring, "id", "left")
    state = F.when(F.col("_on"), "ring").when(F.col("_state").isin("ring", "below_ring"), "below_ring").otherwise("tree")
    tree, child = state == "tree", F.col("_state").isNotNull()
    path = F.when(tree, F.when(child, F.concat("_path", F.array("id"))).otherwise(F.array("id"))).alias("path") if paths else None
    return whole.select(
        "id", "parent_id", F.when(tree, F.coalesce("_top", "id")).alias("root"), F.when(tree, F.coalesce(F.col("_n") + 1, F.lit(0))).cast("int").alias("depth"),
        *([path] if paths else []), state.alias("state"), (F.col("parent_id").isNull() | child).alias("parent_known"),
    )


def descendants(placed: DataFrame) -> DataFrame:
    """The descendants of every node of a tree: ``id``, ``descendant``, ``distance``, one row a pair.

    ``placed`` comes from `hierarchy`. Rows, not sets, so that a root with a
    third of all nodes below it needs no group in one task.
    """
    up = placed.filter("state = 'tree' and depth > 0").select(
        F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("_at", "id")
    )
    return up.select("id", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))
