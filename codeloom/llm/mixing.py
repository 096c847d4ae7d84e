"""Mixing sources to target weights.

Token weights are raked to source, language and topic marginals by iterative
proportional fitting over the cells of source, language and topic. A document's
expected number of copies is its cell's weight over its cell's tokens. Whole
copies are taken; for the rest documents are drawn by sequential Poisson
sampling: in the order of a hash over the calibrated probability, until the
source has its tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.lineage import cut

BINS = 4096
_CELL = ["source", "language", "topic"]


def rake(cells: np.ndarray, tokens: np.ndarray, caps: np.ndarray, targets: list[np.ndarray], rounds: int = 200) -> np.ndarray:
    """Weights of cells whose sums over each dimension come near ``targets``; those of the first dimension exactly.

    ``cells``: the code of each cell in each dimension; ``caps``: the most that
    a cell may weigh. Targets that can't be met, as caps or empty cells forbid
    it, are met as far as the rounds bring them, the first dimension's last.
    """
    weights = np.minimum(tokens.astype(float), caps)
    for _ in range(rounds):
        for d in (*range(1, len(targets)), 0):
            for _ in range(20 if d == 0 else 1):  # what a cap cuts off, the other cells of the source take over
                sums = np.bincount(cells[:, d], weights, len(targets[d]))
                factor = np.where(sums > 0, targets[d] / np.maximum(sums, 1e-12), 1.0)
                weights = np.minimum(weights * factor[cells[:, d]], caps)
                if np.allclose(np.bincount(cells[:, d], weights, len(targets[d])), targets[d], rtol=1e-9):
                    break
    return weights


def _weighted_pool(counted: DataFrame, weights: DataFrame) -> DataFrame:
    """The documents of listed sources that have tokens, with their source's share and cap."""
    listed = weights.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    return counted.select("doc_id", *_CELL, "n_tokens").filter("n_tokens > 0").join(listed, "source")


def mixture(counted: DataFrame, weights: DataFrame) -> DataFrame:
    """Copies of every document of a listed source: ``doc_id``, ``source``, ``n_tokens``, ``copies`` (0 included).

    ``counted`` has ``doc_id``, ``source``, ``language``, ``topic`` and
    ``n_tokens``. The total is the largest that all present sources can feed at
    their shares without using a document more than ``max_repeats`` times; the
    shares of listed sources that don't occur fall to the present ones in
    proportion. Languages and topics keep the shares that they have in the pool
    as far as the sources allow. Documents of sources that aren't listed, and
    those without tokens, take no part. A source's tokens differ from its target
    by less than one document. The cells come to the driver: at most the listed
    sources times the languages times the topics.
    """
    pool = cut(_weighted_pool(counted, weights).withColumns({c: F.coalesce(c, F.lit("(none)")) for c in ("language", "topic")}))
    spark = pool.sparkSession
    cells = pool.groupBy(*_CELL).agg(F.sum("n_tokens").alias("tokens"), F.first("target_share").alias("share"), F.first("max_repeats").alias("cap")).collect()
    result = ["doc_id", "source", "n_tokens"]
    if not cells:
        return pool.select(*result, F.lit(0).cast("bigint").alias("copies"))
    cells.sort(key=lambda r: (r["source"], r["language"], r["topic"]))
    names = [sorted({r[c] for r in cells}) for c in _CELL]
    codes = np.array([[names[d].index(r[c]) for d, c in enumerate(_CELL)] for r in cells])
    tokens = np.array([float(r["tokens"]) for r in cells])
    caps = tokens * np.array([r["cap"] for r in cells])
    shares = np.zeros(len(names[0]))
    shares[codes[:, 0]] = [r["share"] for r in cells]
    room = np.bincount(codes[:, 0], caps, len(shares))
    total = (room / shares).min()
    targets = [shares * total]
    goal = targets[0].sum()
    for d in (1, 2):
        own = np.bincount(codes[:, d], tokens, len(names[d]))
        targets.append(own / own.sum() * goal)
    fitted = rake(codes, tokens, caps, targets)
    rows = [(r["source"], r["language"], r["topic"], float(w / t), float(targets[0][c[0]])) for r, w, t, c in zip(cells, fitted, tokens, codes)]
    plan = spark.createDataFrame(rows, "source string, language string, topic string, expected double, goal double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    whole = F.floor(F.col("expected") + 1e-9)
    rest = F.greatest(F.col("expected") - whole, F.lit(0.0))
    drawn = pool.join(F.broadcast(plan), _CELL).select(  # as many rows as cells
        *result, "goal", "max_repeats", whole.alias("whole"),
        F.when((rest > 1e-9) & (whole < F.col("max_repeats")), u / rest).alias("xi"),
    )
    drawn = drawn.withColumn("bin", F.when(F.col("xi").isNotNull(), F.least(F.floor(F.col("xi") / (F.col("xi") + 1) * BINS), F.lit(BINS - 1))))
    drawn = cut(drawn)
    # The bin in which each source reaches its goal: from sums by bin, at most BINS rows a source.
    bins = drawn.groupBy("source", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("n_tokens")).otherwise(0)).alias("n"))
    taken = drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("taken"), F.first("goal").alias("goal"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.filter("bin is not null").withColumn("before", F.coalesce(F.sum("n").over(by_bin), F.lit(0))).join(taken, "source")
    last = before.filter(F.col("taken") + F.col("before") <= F.col("goal")).groupBy("source").agg(
        F.max(F.struct("bin", "before", (F.col("goal") - F.col("taken")).alias("need"))).alias("b")
    ).select("source", F.col("b.bin").alias("last_bin"), F.col("b.before").alias("before"), F.col("b.need").alias("need"))
    marked = drawn.join(last, "source", "left")
    inside = Window.partitionBy("source").orderBy("xi", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = marked.filter("bin = last_bin").withColumn("sum", F.col("before") + F.sum("n_tokens").over(inside))
    # The document that crosses the goal is taken if that ends nearer to it.
    edge = edge.withColumn("more", (F.col("sum") - F.col("n_tokens") / 2 <= F.col("need")).cast("bigint"))
    others = marked.filter("bin is null or last_bin is null or bin <> last_bin").withColumn("more", F.coalesce(F.col("bin") < F.col("last_bin"), F.lit(False)).cast("bigint"))
    columns = [*result, (F.col("whole") + F.col("more")).cast("bigint").alias("copies")]
    return edge.select(*columns).unionByName(others.select(*columns))


def reached_shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Target and reached share of every listed source: ``source``, ``target_share``, ``max_repeats``, ``pool_tokens``, ``mix_tokens``, ``reached_share``.

    A listed source without documents reaches 0.
    """
    sums = mixed.groupBy("source").agg(F.sum("n_tokens").alias("pool_tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    joined = weights.join(sums, "source", "left").na.fill(0, ["pool_tokens", "mix_tokens", "most_copies"])
    total = joined.agg(F.sum("mix_tokens").alias("_total"))  # one row
    return joined.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "pool_tokens", "mix_tokens", "most_copies",
        F.round(F.when(F.col("_total") > 0, F.col("mix_tokens") / F.col("_total")).otherwise(0.0), 6).alias("reached_share"),
    )
