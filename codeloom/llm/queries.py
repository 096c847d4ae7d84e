"""Queries of the operators on source files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.broken import parse_rates, parse_states
from codeloom.llm.docs import documented_functions, paired_nodes, without_templates
from codeloom.llm.encode import token_counts, token_ids
from codeloom.llm.langid import document_languages, fitted, language_segments, mislabelled, normal_label
from codeloom.llm.mixing import mixture, reached_shares
from codeloom.llm.provenance import provenance, shared_rules
from codeloom.sources.tables import current_rows, table

TEMPLATE_REPEATS = 20  # a description that more functions share is a template,
TEMPLATE_SHARE = 0.002  # if they are also more than this share of all documented functions


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_states(table(spark, sf_dir, "source_files")).filter("problem is not null").select("file_path")


def p2_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_states(table(spark, sf_dir, "source_files"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rates(parse_states(table(spark, sf_dir, "source_files")))


def _pairs(spark: SparkSession, sf_dir: str, code: bool = False) -> DataFrame:
    nodes = current_rows(table(spark, sf_dir, "nodes"), ["id"], ["is_deleted", "name", "kind", "file_path", "line_start"])
    live = nodes.filter(~F.coalesce("is_deleted", F.lit(False)))
    return paired_nodes(live, documented_functions(table(spark, sf_dir, "source_files"), code))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions with their code, without those that share a template."""
    return without_templates(_pairs(spark, sf_dir, code=True), TEMPLATE_REPEATS, TEMPLATE_SHARE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provenance(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "upstream_files"))
    return found.filter("reason is not null").select("file_path")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "upstream_files"))


def p5_shared_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_rules(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "upstream_files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", normal_label(F.col("lang")).alias("language"), F.col("doc_kind").alias("topic"))
    return mixture(token_counts(docs, ["doc_id", "source", "language", "topic"]), table(spark, sf_dir, "mix_weights"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_weights"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_segments(documents, fitted(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(document_languages(_segments(spark, sf_dir)))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(_segments(spark, sf_dir))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_states, p2_rates, p4_found, p4_pairs, p5_found, p5_reasons, p5_shared_rules,
        p7_ids, p7_counts, p8_mixture, p8_shares, p9_found, p9_documents, p9_segments,
    )
}

ORACLE: dict[str, str] = {}
