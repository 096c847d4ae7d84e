"""Text search over nodes: postings, BM25, pattern fallback, wiki pages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.ranking import K1, LIST_COLUMNS, B, encoded, scored
from codeloom.plans.lineage import cut
from codeloom.sources.store import publish, published
from codeloom.sources.tables import current_rows

NODES_PER_CELL = 150_000  # of which a task holds the postings
TERMS_PER_BLOCK = 2_000_000  # of queries that a task scores
# Words that a search leaves out.
STOP_WORDS = "a an and are does for from how in is me of show the to what where which who".split()


def query_terms(query: str) -> list[str]:
    """The terms of a search: tokens cut at dots and hyphens, without single characters and stop words; else the whole text."""
    import re

    text = " ".join(query.replace('"', "").replace("'", "").split())
    tokens = [p for t in re.findall(r"[\w$.\-]+", text) for p in re.split(r"[.\-]", t)]
    terms = [t.lower() for t in tokens if len(t) > 1 and t.lower() not in STOP_WORDS]
    return list(dict.fromkeys(terms)) or [text.lower()]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _text(fields: list[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def postings(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """``node_id``, ``term``, ``tf``, ``doc_len`` over all fields; null fields are empty."""
    tokens = nodes.select(F.col("id").alias("node_id"), words(_text(fields)).alias("w"))
    each = tokens.select("node_id", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return each.groupBy("node_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, n_docs: int, average: float, terms: list[str], limit: int = 50) -> DataFrame:
    """The best nodes for a search in which every term is a prefix: ``node_id``, ``rank`` (lower is better), at most ``limit``.

    A term's frequency in a node is that of all words that begin with it.
    """
    hit = F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("term").startswith(t)))
    found = index.filter(F.lit(False) if not terms else F.col("term").rlike("^(?:" + "|".join(_quoted(t) for t in terms) + ")")).select("node_id", "doc_len", "tf", hit.alias("q"))
    per = found.groupBy("node_id", "doc_len", "q").agg(F.sum("tf").alias("tf"))
    df = per.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(average)))
    ranked = per.join(F.broadcast(df), "q").groupBy("node_id").agg(F.round(-F.sum(score), 6).alias("rank"))  # one row a term
    return ranked.orderBy("rank", "node_id").limit(limit)


def _quoted(term: str) -> str:
    import re

    return re.escape(term)


def text_terms(text: Column) -> Column:
    """The distinct words of a query's text, without single characters and stop words."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def bm25_many(index: DataFrame, queries: DataFrame, limit: int = 50, rows: int | None = None) -> DataFrame:
    """The best nodes for each of many searches: ``query_id``, ``node_id``, ``rank`` (lower is better), at most ``limit`` a query.

    ``index`` comes from `postings`, ``queries`` has ``query_id`` and ``term``,
    each pair once; a term stands for all words that begin with it. Queries
    without a hit have no row. ``rows`` is about the number of nodes, counted if it isn't given.
    """
    documents = index.groupBy("node_id", "doc_len").agg(F.collect_list(F.struct("term", "tf")).alias("_each"))
    return _ranked(documents, [F.col("doc_len").cast("bigint"), F.col("_each.term"), F.col("_each.tf").cast("array<bigint>")], queries, limit, rows)


def bm25_many_texts(nodes: DataFrame, fields: list[str], queries: DataFrame, limit: int = 50, rows: int | None = None) -> DataFrame:
    """`bm25_many` over nodes without postings: their texts are cut into words in the tasks that count them."""
    documents = nodes.select(F.col("id").alias("node_id"), _text(fields).alias("_text"))
    return _ranked(documents, [F.lit(None).cast("bigint"), words(F.col("_text")), F.lit(None).cast("array<bigint>")], queries, limit, rows)


def _ranked(documents: DataFrame, columns: list[Column], queries: DataFrame, limit: int, rows: int | None) -> DataFrame:
    """``documents`` has ``node_id`` and what ``columns`` are made of in the cells: length, words, counts of words.

    Cells follow from the number of nodes, blocks of queries from that of their
    terms; only a cell's best nodes for each query meet those of other cells.
    """
    spark = documents.sparkSession
    queries = cut(queries.filter("term <> ''").select("query_id", "term"))
    rows = documents.count() if rows is None else rows
    cells = max(spark.sparkContext.defaultParallelism, -(-rows // NODES_PER_CELL))
    blocks = max(1, -(-queries.count() // TERMS_PER_BLOCK))
    placed = documents.withColumn("cell", F.pmod(F.xxhash64("node_id"), F.lit(cells)).cast("int"))
    asked = queries.select(F.col("term").alias("asked")).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    met = placed.unionByName(asked, allowMissingColumns=True).repartitionById(cells, F.col("cell"))
    told = [c.alias(n) for c, n in zip(columns, ("doc_len", "words", "counts"))]
    kind = documents.schema["node_id"].dataType.simpleString()
    lists = cut(met.select("cell", "asked", "node_id", *told).mapInArrow(encoded, LIST_COLUMNS.format(kind)))
    total = lists.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    df = lists.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.greatest(F.log((F.lit(total["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    terms = queries.join(df.select("term", idf.alias("idf")), "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_each"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    terms = terms.select("query_id", F.col("_each.term").alias("terms"), F.col("_each.idf").alias("idfs"), F.explode(F.sequence(block, block + (cells - 1) * blocks, F.lit(blocks))).alias("task"))
    each = lists.withColumn("task", F.explode(F.sequence(F.col("cell") * blocks, F.col("cell") * blocks + blocks - 1)))
    met = each.unionByName(terms, allowMissingColumns=True).repartitionById(cells * blocks, F.col("task"))
    query = queries.schema["query_id"].dataType.simpleString()
    mean = total["words"] / total["docs"] if total["docs"] else 1.0
    best = met.mapInArrow(partial(scored, mean=mean, limit=limit), f"query_id {query}, node_id {kind}, rank double")
    order = Window.partitionBy("query_id").orderBy("rank", F.col("node_id").asc_nulls_last())
    return best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def store_index(index: DataFrame, folder: str, name: str = "postings") -> str:
    """Writes postings as a new version, ordered by term, so that a prefix reads few row groups; readers keep the old one till then."""
    return publish(index.repartitionByRange("term").sortWithinPartitions("term"), folder, name)


def stored_postings(spark: SparkSession, folder: str, terms: list[str], name: str = "postings") -> DataFrame:
    """The stored postings of words that begin with one of ``terms``: ranges of terms that the scan can skip by."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | ((F.col("term") >= t) & (F.col("term") < t + "\U0010ffff"))
    return published(spark, folder, name).filter(hit)


def like_search(nodes: DataFrame, pattern: str, fields: list[str], limit: int = 50) -> DataFrame:
    """Fallback: nodes with ``pattern`` in any field, case aside; ``%`` and ``_`` stay wild cards. The first by id."""
    hit = None
    for f in fields:
        one = F.coalesce(F.col(f).ilike(f"%{pattern}%"), F.lit(False))
        hit = one if hit is None else hit | one
    return nodes.filter(hit).select("id", F.lit(0.0).alias("rank")).orderBy("id").limit(limit)


def clean_doc(doc: Column) -> Column:
    """Documentation without comment marks and blank lines at its ends."""
    text = F.regexp_replace(doc, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"^\s*/\*+|\*+/\s*$", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:\*+|#+)[ \t]?", "")
    return F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))


def wiki_pages(nodes: DataFrame) -> DataFrame:
    """A page for each documented node: ``path``, ``title``, ``summary`` (the first line), ``content``.

    ``nodes`` has ``id``, ``name``, ``kind`` and ``doc``. Modules, exports and
    events get no page, nor do nodes whose documentation is null or empty.
    """
    doc = clean_doc(F.col("doc"))
    kept = nodes.filter(~F.col("kind").isin("module", "export_statement", "event")).select("id", "name", doc.alias("doc")).filter("doc <> ''")
    return kept.select(
        F.col("id").alias("path"), F.col("name").alias("title"), F.trim(F.split("doc", "\n")[0]).alias("summary"),
        F.concat(F.lit("# "), F.coalesce("name", F.lit("")), F.lit("\n\n"), F.col("doc")).alias("content"),
    )


def markdown_pages(files: DataFrame) -> DataFrame:
    """Markdown texts as wiki pages: ``path`` (the base name), ``title`` (without ``.md``), ``content``, ``updated_at``.

    ``files`` has ``page_path``, ``text`` and ``updated_at``. Rows without a
    path give no page; a null text is an empty one.
    """
    base = F.regexp_extract("page_path", r"([^/\\\\]*)$", 1)
    return files.filter("page_path is not null").select(base.alias("path"), F.regexp_replace(base, r"\.md$", "").alias("title"), F.coalesce("text", F.lit("")).alias("content"), "updated_at")


def newest_pages(pages: DataFrame) -> DataFrame:
    """Pages upserted in order of time, one for each ``path``: the newest, of equal times the greatest title and content."""
    return current_rows(pages, ["path"], ["title", "content"], "updated_at")


def without_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages whose ``path`` isn't among those of ``gone``."""
    return pages.join(gone.select("path").distinct(), "path", "left_anti")
