"""Writing, upserting and comparing stored tables, and reading source trees."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.globs import ignored

# Folders that a scan leaves out, and the languages' file extensions.
EXCLUDED = ".git node_modules dist build coverage .next .cache".split()
EXTENSIONS = {"typescript": [".ts", ".tsx", ".mts"], "javascript": [".js", ".mjs", ".cjs", ".jsx"], "python": [".py"], "php": [".php", ".php5", ".php7"]}


def scan_tree(spark: SparkSession, root: str, extensions: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Source files below ``root``: ``file_path`` (relative), ``content_hash``, ``mtime`` (ms), ``source_text``.

    Executors list and read the files. Excluded folders and ignored paths stay
    out before any content is read.
    """
    base = os.path.abspath(root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace(".", r"\."), "")
    kept = files.withColumn("file_path", path).filter(F.col("file_path").rlike("(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    kept = kept.filter(~F.col("file_path").rlike("(?:^|/)(?:" + "|".join(e.replace(".", r"\.") for e in EXCLUDED) + ")/")).filter(~ignored(F.col("file_path"), list(ignore)))
    return kept.select("file_path", F.sha2("content", 256).alias("content_hash"), F.unix_millis("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("source_text"))


def ignore_patterns(root: str, names: Sequence[str] = (".gitignore",)) -> list[str]:
    out: list[str] = []
    for name in names:
        file = os.path.join(root, name)
        if os.path.isfile(file):
            with open(file, encoding="utf-8") as f:
                out += f.read().splitlines()
    return out


def project_config(root: str, name: str) -> dict:
    """A project's JSON settings; a missing or broken file gives none."""
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def content_hash(text: Column) -> Column:
    """Hex SHA-256 of a text's UTF-8 bytes; null for null."""
    return F.sha2(text.cast("binary"), 256)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces rows of ``stored`` with the same keys, null keys included; ``new`` must have each key once."""
    marks = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        same = one if same is None else same & one
    return stored.join(marks, same, "left_anti").unionByName(new)


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the rows of ``new`` whose keys ``stored`` doesn't have."""
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti"))


def manifest_diff(prior: DataFrame, current: DataFrame) -> DataFrame:
    """What became of each file: ``file_path``, ``repo_hash``, ``change`` (added, changed, deleted or same).

    Both sides have ``file_path``, ``repo_hash`` and ``content_hash``, each key once.
    """
    a = prior.select("file_path", "repo_hash", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    b = current.select("file_path", "repo_hash", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, ["file_path", "repo_hash"], "full").select("file_path", "repo_hash", change.alias("change"))


def clear_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of ``files`` (``file_path``): no node of them, no edge that touches one."""
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    kept = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_anti"), kept


def contains_edges(nodes: DataFrame) -> DataFrame:
    """``contains`` edges of weight 1 from each parent to its child."""
    return nodes.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))


def snapshot(repos: DataFrame, update: DataFrame) -> DataFrame:
    """Repositories with new counts; ``commit_hash`` and ``schema_version`` only where the update has them."""
    u = update.select("repo_hash", *[F.col(c).alias(f"_{c}") for c in ("commit_hash", "schema_version", "node_count", "file_count")])
    joined = repos.join(u, "repo_hash", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in repos.columns])


_SECOND_UNIT = "\uffff"  # no character; stands behind those that take two UTF-16 units, so that characters count as units do


def source_slice(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The source of every node: ``id``, ``source``; null without a text or a place in it.

    ``nodes`` has ``id``, ``file_path``, ``line_start``, ``line_end``,
    ``offset_start``, ``offset_end`` and ``inline``, ``files`` has ``file_path``
    and ``source_text``. Text kept with the node comes first, then the part of
    the file between the offsets, which count UTF-16 units, then its lines. The
    places of a file's nodes are brought to it, so that every text is moved and
    cut up once. Offsets that end before they start or are negative don't count.
    """
    kept = F.coalesce("inline", F.lit("")) != ""
    spans = nodes.filter(~kept & F.col("file_path").isNotNull()).groupBy("file_path").agg(F.collect_list(F.struct("id", "line_start", "line_end", "offset_start", "offset_end")).alias("_spans"))
    text = F.struct(F.regexp_replace("source_text", r"([\x{10000}-\x{10FFFF}])", "$1" + _SECOND_UNIT).alias("units"), F.split("source_text", r"\r?\n").alias("lines"))

    def part(t: Column, x: Column) -> Column:
        placed = (x["offset_start"] >= 0) & (x["offset_end"] >= x["offset_start"])
        units = F.replace(F.substring(t["units"], x["offset_start"] + 1, x["offset_end"] - x["offset_start"]), F.lit(_SECOND_UNIT), F.lit(""))
        lines = F.array_join(F.slice(t["lines"], x["line_start"], F.greatest(x["line_end"] - x["line_start"] + 1, F.lit(0))), "\n")
        return F.struct(x["id"].alias("id"), F.when(placed, units).when(x["line_start"] >= 1, lines).alias("source"))

    # The text is prepared and split once for a file: the outer transform binds both for all its nodes.
    cut = F.flatten(F.transform(F.array(text), lambda t: F.transform(F.col("_spans"), lambda x: part(t, x))))
    found = spans.join(files.filter("source_text is not null").select("file_path", "source_text"), "file_path").select(F.inline(cut))
    own = nodes.select("id", F.when(kept, F.col("inline")).alias("_inline"))
    return own.join(found, "id", "left").select("id", F.coalesce("_inline", "source").alias("source"))


def without_links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays before everything is linked again: nodes without events, and ``contains`` edges."""
    return nodes.filter("kind is null or kind <> 'event'"), edges.filter("type = 'contains'")


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON line, nulls included: ``value``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def as_tsv(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Writes a table as a new version and points to it; readers see the old one until the pointer moves."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.current")
    old = published_version(spark, folder, name)
    version = f"{name}.v{(int(old.rsplit('v', 1)[1]) if old else 0) + 1:06d}"
    df.write.mode("overwrite").parquet(f"{folder}/{version}")
    out = fs.create(pointer, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    return f"{folder}/{version}"


def published_version(spark: SparkSession, folder: str, name: str) -> str | None:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.current")
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return None
    rows = spark.read.text(f"{folder}/{name}.current").collect()  # one line
    return rows[0]["value"] if rows else None


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    version = published_version(spark, folder, name)
    if version is None:
        raise FileNotFoundError(f"{folder}/{name}.current")
    return spark.read.parquet(f"{folder}/{version}")
