"""Source files that do not parse: one row a file, and rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.sources import current_results, spread

_FOUND = "file_path string, repo_hash string, loaded_at timestamp_ntz, language string, problem string, at_offset bigint, at_line bigint"


def _examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from codeloom.llm.syntax import failure, language_of

    for batch in batches:
        out = []
        for path, repo, at, text in zip(batch.file_path, batch.repo_hash, batch.loaded_at, batch.source_text):
            path = None if pd.isna(path) else path
            lang, text = language_of(path), text if isinstance(text, str) else None
            found = failure(text, lang)
            line = None if found is None else len(text[: found[1]].replace("\r\n", "\n").replace("\r", "\n").split("\n"))
            out.append((path, repo, at, lang, *(found or (None, None)), line))
        frame = pd.DataFrame(out, columns=["file_path", "repo_hash", "loaded_at", "language", "problem", "at_offset", "at_line"])
        yield frame.astype({"at_offset": "Int64", "at_line": "Int64"})


def parse_states(source_files: DataFrame) -> DataFrame:
    """Whether the current text of each file parses in the language of its extension.

    Columns ``file_path``, ``repo_hash``, ``language``, ``problem`` (null if the
    text parses, ``token`` for a token that can't stand where it does,
    ``truncated`` for a text that ends too early), ``at_offset`` (in code
    points) and ``at_line``. Null texts and unknown extensions have no problem;
    the language of an unknown extension is null. Empty texts and comments
    alone parse.
    """
    rows = source_files.select("file_path", "repo_hash", "loaded_at", "source_text")
    examined = spread(rows, "file_path").mapInPandas(_examine, _FOUND)
    return current_results(examined, ["repo_hash", "language", "problem", "at_offset", "at_line"])


def parse_rates(states: DataFrame) -> DataFrame:
    """Files, broken files and their rate per repository and language, from `parse_states`."""
    return states.groupBy("repo_hash", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("problem").alias("n_broken"),
        F.count(F.when(F.col("problem") == "truncated", 1)).alias("n_truncated"),
    ).withColumn("broken_rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
