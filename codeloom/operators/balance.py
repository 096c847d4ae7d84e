"""Per-key results where a few keys hold most of the rows.

Fragment and replicate by estimated load. One scan gives the rows and, by
frequent-items sketches, the heavy keys of each of ``SKETCHES`` hash buckets. A
heavy key is split into shards in proportion to its load, none larger than a
part of a task's even share; the shards are bin-packed onto the tasks on top of
what the other keys, which go by hash, put there, the largest first. Rows then
go to their task by number (``repartitionById``), and the matching side is
copied only to the tasks that hold shards of its key. The number of tasks
follows from the rows and their width.

The list of heavy keys is the only thing that reaches the driver or is
broadcast. It has at most ``HEAVY_PER_TASK`` keys a task, whatever the size of
the data, and shards number at most ``HEAVY_PER_TASK + PARTS`` a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAVY_PER_TASK = 8
PARTS = 4  # a shard is at most this part of a task's even share
SKETCHES = 32  # hash buckets of keys, each with a sketch of its own
MOST_TRACKED, MOST_RETURNED = 1_000_000, 10_000  # limits of one sketch; with all buckets 320,000 heavy keys, enough for 40,000 tasks
TASK_BYTES = 32 * 1024 * 1024
OVERHEAD = 24  # bytes of a row besides its key and what the caller says


@dataclass(frozen=True)
class LoadPlan:
    """Where the shards of the heavy keys go: for each key its tasks, one for each shard; and the rows counted, nulls included."""

    tasks: int
    slots: Mapping[str, list[int]]
    rows: int = 0

    def frame(self, spark: SparkSession, key_type: T.DataType) -> DataFrame:
        schema = T.StructType([T.StructField("__heavy", T.StringType()), T.StructField("__slots", T.ArrayType(T.IntegerType()))])
        rows = [(k, v) for k, v in self.slots.items()]
        return spark.createDataFrame(rows, schema).withColumn("__heavy", F.col("__heavy").cast(key_type))


def pack(loads: Mapping[str, float], total: float, tasks: int) -> dict[str, list[int]]:
    """Bin-packs the shards of the heavy keys onto tasks, on top of an even share of all other rows.

    A key gets as many shards as it takes for none to be more than the
    ``PARTS``-th part of a task's even share, at most one for each task.
    """
    share = max(1.0, total / tasks)
    heap = [(max(0.0, total - sum(loads.values())) / tasks, t) for t in range(tasks)]
    heapq.heapify(heap)
    out: dict[str, list[int]] = {}
    shards = []
    for key, load in loads.items():
        n = min(tasks, max(1, -int(-load * PARTS // share)))
        shards += [(load / n, key)] * n
    for load, key in sorted(shards, key=lambda s: (-s[0], s[1])):
        seen = []
        while True:
            at, task = heapq.heappop(heap)
            if task not in out.get(key, ()):  # two shards of a key in one task would be one shard
                break
            seen.append((at, task))
        out.setdefault(key, []).append(task)
        for item in (*seen, (at + load, task)):
            heapq.heappush(heap, item)
    return out


def load_plans(df: DataFrame, columns: Sequence[str], tasks: int | None = None, row_bytes: int = 64) -> dict[str, LoadPlan]:
    """A plan for each column, all from one scan. A key is heavy from ``1 / (HEAVY_PER_TASK * tasks)`` of all rows.

    Without ``tasks`` there are as many as it takes for about ``TASK_BYTES``
    each, by the rows, the mean length of the keys and ``row_bytes`` for what
    else is moved, and at least one for each core. Nulls count as rows and are
    never heavy. An empty table gives plans without heavy keys.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tracked = min(MOST_TRACKED, max(1024, 32 * (tasks or max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("k")) for i, c in enumerate(columns)])).alias("_x")
    buckets = max(1, SKETCHES // len(columns))  # so few groups that their sketches are kept by hash and not by sorting
    sketched = df.select(keys).select("_x.c", "_x.k").groupBy("c", F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("k")).alias("bytes"),
        F.expr(f"approx_top_k_estimate(approx_top_k_accumulate(k, {tracked}), {min(tracked, MOST_RETURNED)})").alias("top"),
    )
    whole = Window.partitionBy("c")  # over at most SKETCHES rows
    n_tasks = F.lit(tasks) if tasks else F.greatest(F.lit(cores), F.ceil((F.col("size") + F.lit(row_bytes + OVERHEAD) * F.col("rows")) / F.lit(TASK_BYTES)))
    told = sketched.withColumns({"rows": F.sum("n").over(whole), "size": F.coalesce(F.sum("bytes").over(whole), F.lit(0))}).withColumn("tasks", n_tasks)
    least = F.greatest(F.lit(2.0), F.col("rows") / (F.lit(HEAVY_PER_TASK) * F.col("tasks")))
    heavy = told.select("c", "rows", "tasks", F.filter("top", lambda x: x["item"].isNotNull() & (x["count"] >= least)).alias("top")).collect()  # SKETCHES rows
    plans = {}
    for i, column in enumerate(columns):
        own = [r for r in heavy if r["c"] == i]
        n, rows = (int(own[0]["tasks"]), own[0]["rows"]) if own else (tasks or cores, 0)
        plans[column] = LoadPlan(n, pack({x["item"]: x["count"] for r in own for x in r["top"] or []}, rows, n), rows)
    return plans


def _own_task(key: Column, tasks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")


def _pre_aggregated(batches: Iterator[pa.RecordBatch], keys: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows and sums for each distinct key of every few batches."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held)
            g = t.group_by(keys).aggregate([([], "count_all"), *[(s, "sum") for s in sums]])
            yield from g.select([*keys, "count_all", *[f"{s}_sum" for s in sums]]).rename_columns([*keys, "n_rows", *sums]).combine_chunks().to_batches()
            held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 200_000:
            yield from flush()
    yield from flush()


def balanced_totals(df: DataFrame, key: str, sums: Mapping[str, Column], plan: LoadPlan, within: Sequence[str] = ()) -> DataFrame:
    """Rows and sums for each value of ``key``: columns ``within``, ``key``, ``n_rows`` and those of ``sums`` (numbers).

    Rows are pre-aggregated by key and shard where they are read, sent to the
    packed task of their shard by number and merged there; only the shards of
    heavy keys meet again in a second, small aggregation. ``within`` names
    columns that ``key`` determines, to be kept. Null is a key of its own and is
    spread over all tasks. A sum over nulls alone is null. Sums of doubles may
    differ in the last digits from one run to the next, as in any parallel sum.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    mine = F.spark_partition_id()
    heavy = F.broadcast(plan.frame(spark, kind))  # at most HEAVY_PER_TASK keys a task
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    placed = df.select(*within, F.col(key).alias("__key"), *[c.alias(n) for n, c in values.items()]).join(heavy, F.col("__key") == F.col("__heavy"), "left").select(
        *within, "__key", *values,
        F.when(F.col("__key").isNull(), mine % plan.tasks)
        .when(F.col("__slots").isNotNull(), F.element_at("__slots", (mine % F.greatest(F.size("__slots"), F.lit(1)) + 1).cast("int")))
        .otherwise(_own_task(F.col("__key"), plan.tasks)).cast("int").alias("__slot"),
        (F.col("__key").isNull() | F.col("__slots").isNotNull()).alias("__split"),
    )
    keys = [*within, "__key", "__slot", "__split"]
    summed = [T.StructField(n, T.LongType() if isinstance(placed.schema[n].dataType, T.IntegralType) else T.DoubleType()) for n in values]
    schema = T.StructType([*[placed.schema[k] for k in keys], T.StructField("n_rows", T.LongType()), *summed])
    few = placed.select(*keys, *[F.col(f.name).cast(f.dataType) for f in summed]).mapInArrow(partial(_pre_aggregated, keys=keys, sums=list(values)), schema)
    # Whether a key is split is aggregated, not grouped by, so that both parts below read one and the same shuffle.
    merged = few.repartitionById(plan.tasks, F.col("__slot")).groupBy(*keys[:-1]).agg(F.max("__split").alias("__split"), F.sum("n_rows").alias("n_rows"), *[F.sum(n).alias(n) for n in values])
    whole = merged.filter(~F.col("__split"))
    again = merged.filter("__split").groupBy(*within, "__key").agg(F.sum("n_rows").alias("n_rows"), *[F.sum(n).alias(n) for n in values])
    names = [F.col(n).alias(name) for n, name in zip(values, sums)]
    return whole.select(*within, F.col("__key").alias(key), "n_rows", *names).unionByName(again.select(*within, F.col("__key").alias(key), "n_rows", *names))


def balanced_join(left: DataFrame, right: DataFrame, key: str, plan: LoadPlan, how: str = "inner") -> DataFrame:
    """Joins the skewed ``left`` with ``right`` on the column ``key`` that both have.

    Heavy keys' rows of ``left`` are spread over their shards, ``right`` is
    copied to just those shards, and both streams are sorted and merged where
    they lie. A heavy key's rows are told apart by their values and the partition
    they come from, so only exact repeats of one partition share a shard. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``,
    for which each row of ``left`` in exactly one shard is right. Null keys
    match nothing and are spread evenly. A column of ``right`` whose name
    ``left`` has too, the key aside, comes back with ``_right`` appended.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a fragmented left side allows no {how} join")
    spark = left.sparkSession
    right = right.select(*[F.col(c).alias(f"{c}_right") if c != key and c in left.columns else F.col(c) for c in right.columns])
    heavy = F.broadcast(plan.frame(spark, left.schema[key].dataType))
    # By the row's own values and its partition, so that a task that runs again sends each row where it went before.
    row = F.xxhash64(*[F.col(f.name) for f in left.schema.fields if not isinstance(f.dataType, T.MapType)], F.spark_partition_id())
    spread = F.pmod(row, F.greatest(F.size("__slots"), F.lit(1)).cast("bigint"))
    a = left.join(heavy, F.col(key) == F.col("__heavy"), "left").withColumn(
        "__slot",
        F.when(F.col(key).isNull(), F.pmod(row, F.lit(plan.tasks)))
        .when(F.col("__slots").isNotNull(), F.element_at("__slots", (spread + 1).cast("int")))
        .otherwise(_own_task(F.col(key), plan.tasks)).cast("int"),
    ).drop("__heavy", "__slots")
    b = right.filter(F.col(key).isNotNull()).join(heavy, F.col(key) == F.col("__heavy"), "left").withColumn(
        "__slot", F.explode(F.coalesce("__slots", F.array(_own_task(F.col(key), plan.tasks))))
    ).drop("__heavy", "__slots")
    a, b = (x.repartitionById(plan.tasks, F.col("__slot")) for x in (a, b))
    return a.join(b.hint("merge"), ["__slot", key], how).drop("__slot")


def keyed_rows(df: DataFrame, columns: Sequence[str], prefix: str, values: Mapping[str, Column] | None = None) -> DataFrame:
    """A row for each row and column: ``field_name`` (prefix and column), ``key_value``, ``field_key`` (both, null for null) and ``values``."""
    fields = [F.struct(F.lit(f"{prefix}.{c}").alias("field_name"), F.col(c).cast("string").alias("key_value")) for c in columns]
    each = df.select(F.explode(F.array(*fields)).alias("_f"), *[v.alias(n) for n, v in (values or {}).items()]).select("_f.field_name", "_f.key_value", *(values or {}))
    return each.withColumn("field_key", F.concat("field_name", F.lit("\u0001"), "key_value"))


def frequent_values(df: DataFrame, least_share: float, plan: LoadPlan) -> DataFrame:
    """Values that at least ``least_share`` of all rows of their field have, exactly: ``field_name``, ``key_value``, ``n_rows``, ``share``.

    ``df`` comes from `keyed_rows`, ``plan`` is the load of its ``field_key``.
    Null is never such a value, but its rows count for the field's total.
    """
    totals = balanced_totals(df, "field_key", {}, plan, ["field_name", "key_value"])
    # A field's total comes from its keys' totals, one row a field.
    fields = totals.groupBy("field_name").agg(F.sum("n_rows").alias("_all"))
    found = totals.filter(F.col("key_value").isNotNull()).join(F.broadcast(fields), "field_name")
    return found.filter(F.col("n_rows") >= F.lit(least_share) * F.col("_all")).select("field_name", "key_value", "n_rows", (F.col("n_rows") / F.col("_all")).alias("share"))
