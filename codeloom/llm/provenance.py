"""Generated, minified or vendored source files, and data saved as code.

What a file is follows from Re-Pair grammars. Rules that one file uses over and
over tell a program's output and bundles; literals whose own grammar hardly
shrinks tell blobs; rules that files of other repositories or known third-party
files have too tell copies. Two kinds have bodies like hand-written ones: files
that only a note at their head or only their place gives away. There the
grammar of all heads and paths finds the rules that a file shares with known
notes and places, and an exact comparison of the wording follows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.repair import Grammars, mix, stretches
from codeloom.llm.sources import current_results, spread
from codeloom.llm.syntax import language_of
from codeloom.operators.balance import balanced_join, load_plans
from codeloom.plans.lineage import cut

# Thresholds, all on measures of one file that don't depend on its length or the corpus.
REUSED = 0.35  # grammar size for each token: below, rules are reused as only programs do
REUSED_DENSE = 0.65  # the same where lines are dense
DENSE_LINE = 40  # tokens for each line: above, no hand broke the lines
LITERAL = 0.9  # share of a file's characters that stand in literals: above, it is text or data
BLOB_BITS = 4.8  # bits of a literal's grammar for each character: above, it is no text
TABLE = 0.5  # grammar size for each separator of a literal: below, its rows repeat
TABLE_COLUMNS = 3  # separators for each line: from here on, lines are rows
PROSE = 0.6  # share of words among tokens: above, it is text and no program
REPEATED_WORDS = 0.8  # share of words among tokens: above, it is repeated words and no code
PLAIN_WORDS = 0.06  # share of words among tokens: below, there is nothing but data
COPIED = 0.8  # share of a file's passages that others have too: above, it is a copy

# Folders that by common convention hold third-party copies.
VENDOR_FOLDERS = "vendor vendored vendors third_party third-party thirdparty 3rdparty 3rd-party extern external externals node_modules bower_components _deps deps site-packages jspm_packages Godeps Pods Carthage"
# Notes that programs leave in their output.
NOTES = (
    "@generated by", "<auto-generated>", "code generated by a program, do not edit", "this file is autogenerated", "this file is generated", "this file was generated",
    "this file has been generated", "this module was generated", "source generated by", "auto generated file", "automatically generated by", "generated on", "generated at", "generated from",
    "generated with", "generated using", "machine made by", "machine generated", "machine written", "automatisch erzeugt aus", "automatisch generiert von",
    "généré automatiquement par", "genere par", "generado automáticamente por", "gerado automaticamente por", "generato automaticamente da", "автоматически сгенерирован", "файл сгенерирован", "自動生成",
    "do not edit, generated file", "do not modify, changes will be overwritten", "do not change by hand", "created by a program",
)
# How such a note begins, at the begin of a comment's line.
MARKERS = (
    r"@generated\b",
    r"<auto-?generated",
    r"(?:code|file|source) (?:is |was )?(?:auto(?:matically)?[- ]?)?generated\b",
    r"(?:this|the) (?:file|code|module|source)(?: \w+)? (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|created by a program)\b",
    r"auto(?:matically)?[- ]?generated\b",
    r"generated (?:on|at|by|from|with|using|automatically)\b",
    r"machine[- ](?:made|generated|written)\b",
    r"automatisch (?:erzeugt|generiert)\b",
    r"g[ée]n[ée]r[ée] (?:automatiquement|par)\b",
    r"(?:generado|gerado|generato) (?:autom[áa]tic|por|da)",
    r"(?:автоматически )?сгенерирован",
    r"自動生成",
    r"do not (?:edit|modify|change)\b.*\b(?:generated|overwritten|lost|by hand)\b",
)

_MARKED = re.compile(r"^[\s/*#!;\-=]*(?:" + "|".join(MARKERS) + ")", re.I | re.M)

_NUM = r"(?:0[xXbBoO][\da-fA-F_]+n?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[nj]?|\.\d[\d_]*(?:[eE][+-]?\d+)?)"
_STR1 = r"'(?:[^'\\\n\r]|\\[\s\S])*'|\"(?:[^\"\\\n\r]|\\[\s\S])*\""
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/|//[^\n\r]*"
_OPS = r"=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|->|::|\+\+|--|\*\*|<<|>>|[^\s\w]"
_LEX = {
    "es": re.compile(rf"[^\W\d][\w$]*|{_BLOCK}|{_STR1}|`(?:[^`\\]|\\[\s\S])*`|\$[\w$]*|{_NUM}|{_OPS}"),
    "php": re.compile(rf"[^\W\d]\w*|\$\w+|{_BLOCK}|#(?!\[)[^\n\r]*|{_STR1}|{_NUM}|{_OPS}"),
    "python": re.compile(rf"[^\W\d]\w*+(?!['\"])|#[^\n\r]*|[a-zA-Z]{{0,2}}(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|{_STR1})|[^\W\d]\w*|{_NUM}|{_OPS}"),
}
_FAMILY = {"javascript": "es", "typescript": "es", "php": "php", "python": "python"}
_DIGITS = re.compile(r"\d+")  # numbered names are one name: programs count, hands don't
_LINE = re.compile(r"\S[^\n\r]*")
_SEPARATORS = re.compile(r"[^,;:|\t\n\-]+")
_HEAD_WORD = re.compile(r"[^\W_]+|[/@\n]")
_PLACES = frozenset(VENDOR_FOLDERS.split())


class _Vocabulary(dict):
    """The distinct tokens of one language family, numbered on first sight."""

    def __init__(self, family: str, tokens: Tokens):
        super().__init__()
        self.marks = {"python": ("#",), "php": ("//", "/*", "#")}.get(family, ("//", "/*"))
        self.python, self.tokens = family == "python", tokens

    def __missing__(self, token: str) -> int:
        number = self[token] = self.tokens.count
        self.tokens.count += 1
        if token.startswith(self.marks) and (self.python or len(token) > 1):
            self.tokens.comments.add(number)
        if token[0].isdigit() or token[0] == "." and len(token) > 1:
            self.tokens.fresh.append((_NUMBER, len(token), True, False))
        elif token[-1] in "'\"`" and len(token) > 1:
            self.tokens.fresh.append((_STRING, len(token), True, False))
        else:
            shape = token if len(token) == 1 or token.isalpha() else _DIGITS.sub("#", token)
            self.tokens.fresh.append((_name(shape), len(token), False, shape[0].isalpha() or shape[0] in "_$"))
        return number


class Tokens:
    """Tokens met so far, with a name that is the same everywhere, their length and whether they are literals or words.

    It is kept from one batch to the next, as files share most of their tokens,
    and begun anew when it has ``MOST`` of them.
    """

    MOST = 200_000

    def __init__(self):
        self.begin()

    def begin(self) -> None:
        self.count, self.comments, self.fresh = 0, set(), []
        self.families = {f: _Vocabulary(f, self) for f in _LEX}
        self.columns = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, bool, bool))

    def properties(self) -> tuple[np.ndarray, ...]:
        if self.fresh:
            self.columns = tuple(np.concatenate((old, np.asarray(new, old.dtype))) for old, new in zip(self.columns, zip(*self.fresh)))
            self.fresh = []
        return self.columns


def _name(token: str) -> int:
    data = token.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) | zlib.adler32(data[::-1]) << 32


_NUMBER, _STRING = _name("\0N"), _name("\0S")


def head_comments(text: str) -> str:
    """The comments before the first code of a file, an opening tag and a first docstring aside."""
    m = re.match(r"(?:\s+|<\?php\b|#![^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/|//[^\n\r]*|#(?!\[)[^\n\r]*)+", text.lstrip("\ufeff"))
    return m[0] if m else ""


def measures(texts: list[str], families: list[str], passages: bool = False, known: Tokens | None = None) -> pd.DataFrame:
    """Of each text: tokens, lines, grammar size, start hash, share of literals and words, and the literals' own grammar.

    ``literal_bits`` are the bits of the grammar of the literals' characters for
    each character, ``literal_rows`` the size of the grammar of their separators
    for each separator (1 where lines are no rows); both are measured where
    almost all characters stand in literals. ``passages`` adds the hashes of
    long rules and of stretches that stand there once.
    """
    known = known or Tokens()
    if known.count > known.MOST:
        known.begin()
    flat: list[int] = []
    exact, owners, lines = [], [], []
    for text, family in zip(texts, families):
        tokens = _LEX[family].findall(text)
        numbers = list(map(known.families[family].__getitem__, tokens))
        if not known.comments.isdisjoint(numbers):
            tokens = [t for t, i in zip(tokens, numbers) if i not in known.comments]
            numbers = [i for i in numbers if i not in known.comments]
        flat += numbers
        owners.append(len(numbers))
        lines.append(len(_LINE.findall(text)))
        exact.append(hash_text(tokens))
    n, at, owned = len(texts), np.asarray(flat, np.int64), np.repeat(np.arange(len(texts)), owners)
    name, length, literal, word = (x[at] for x in known.properties())
    size, in_literals = np.bincount(owned, length, n), np.bincount(owned, length * literal, n)
    share, words = in_literals / np.maximum(1, size), np.bincount(owned, word, n) / np.maximum(1, owners)
    told = []
    for i in np.flatnonzero(share > LITERAL).tolist():
        own = known.families[families[i]]
        told.append((i, "".join(t for t in _LEX[families[i]].findall(texts[i]) if own[t] not in known.comments and known.columns[2][own[t]])))
    rows, named = list(zip(owners, lines, share, words)), name
    grammar = Grammars(named, owned, len(texts))
    out = pd.DataFrame(rows, columns=["n_tokens", "n_lines", "literal_share", "word_share"])
    out["grammar_size"], out["n_rules"] = grammar.size, grammar.rules
    out["start_hash"], out["text_hash"] = grammar.start.astype(np.int64), exact
    out["literal_bits"], out["literal_rows"] = 0.0, 1.0
    if told:
        at, literals = [x[0] for x in told], [x[1] for x in told]
        out.loc[at, "literal_bits"], out.loc[at, "literal_rows"] = literal_bits(literals), literal_rows(literals)
    if passages:
        shared: list[list[int]] = [[] for _ in texts]
        for owner, value in (grammar.used[:2], stretches(named, owned)):
            for o, v in zip(owner.tolist(), value.astype(np.int64).tolist()):
                shared[o].append(v)
        out["long_rules"] = shared
    return out


def _character_grammars(texts: list[str]) -> tuple[Grammars, np.ndarray, np.ndarray]:
    chars = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.asarray([len(c) for c in chars], np.int64)
    flat, owner = np.concatenate(chars).astype(np.uint64), np.repeat(np.arange(len(texts)), lengths)
    with np.errstate(over="ignore"):
        grammar = Grammars(mix(flat + np.uint64(1)), owner, len(texts))
    return grammar, lengths, np.asarray([len(np.unique(c)) for c in chars], np.int64)


def literal_bits(literals: list[str]) -> np.ndarray:
    """Bits for each character when every symbol of a text's Re-Pair grammar costs the logarithm of all its symbols."""
    grammar, lengths, distinct = _character_grammars(literals)
    return grammar.size * np.log2(np.maximum(2, distinct + grammar.rules)) / np.maximum(1, lengths)


def literal_rows(literals: list[str]) -> np.ndarray:
    """Size of the grammar of the separators alone, for each separator: little where a text is a table of equal rows."""
    marks = [_SEPARATORS.sub("", t.strip("'\"`\r\n")) for t in literals]
    grammar, lengths, _ = _character_grammars([m or "\n" for m in marks])
    columns = np.asarray([len(m) / max(1, m.count("\n")) - 1 if "\n" in m else 0.0 for m in marks])
    return np.where(columns >= TABLE_COLUMNS, grammar.size / np.maximum(1, lengths), 1.0)


def hash_text(tokens: list[str]) -> int:
    """A hash of the exact tokens, without comments and any white space, that in texts of several lines included."""
    import xxhash

    return xxhash.xxh3_64_intdigest("".join("".join(tokens).split()).encode("utf-8", "surrogatepass")) - (1 << 63)


def content_reason(row) -> tuple[str, str] | None:
    """What a file's own grammars say: ``data``, ``minified`` or ``generated`` and what told it, or nothing."""
    n = max(1, row.n_tokens)
    if row.literal_share > LITERAL and row.literal_bits > BLOB_BITS:
        return "data", "literals that hardly shrink"
    if row.literal_share > LITERAL and row.literal_rows < TABLE:
        return "data", "rows that repeat"
    if row.word_share < PLAIN_WORDS and row.literal_share > 0:
        return "data", "nothing but literals"
    if not row.n_rules:
        return None
    if n / max(1, row.n_lines) > DENSE_LINE and row.grammar_size / n < REUSED_DENSE and row.word_share < PROSE:
        return "minified", "rule reuse in dense lines"
    if row.grammar_size / n < REUSED and row.word_share < REPEATED_WORDS:
        return "generated", "rule reuse"
    return None


def head_reasons(paths: list[str], texts: list[str]) -> list[tuple[str, str] | None]:
    """Of each file what its place or the note at its head says, found by rules shared with known places and notes.

    One Re-Pair grammar is built over the folders and the first comments of all
    files together with the known ones. Files that share no repeated pair with
    a known one are out; of the others the wording decides.
    """
    known = [f"/{f}/" for f in VENDOR_FOLDERS.split()] + list(NOTES)
    heads = [head_comments(t) for t in texts]
    flat, owners = [], []
    for words in (_HEAD_WORD.findall(x) for x in (*known, *(f"/{p.rsplit('/', 1)[0]}/ \n {h.lower()}" for p, h in zip(paths, heads)))):
        flat += words
        owners.append(len(words))
    codes = {w: _name(w) for w in set(flat)}
    owner = np.repeat(np.arange(len(owners)), owners)
    grammar = Grammars(np.asarray([codes[w] for w in flat], np.uint64), owner, len(owners), pooled=True)
    out: list[tuple[str, str] | None] = [None] * len(paths)
    if not grammar.seen:
        return out
    owner, pair = (np.concatenate(x) for x in zip(*grammar.seen))
    from_known = owner < len(known)
    for i in np.unique(owner[~from_known & np.isin(pair, pair[from_known])]) - len(known):
        if any(p in _PLACES for p in paths[i].split("/")[:-1]):
            out[i] = "vendored", "place"
        elif _MARKED.search(heads[i]):
            out[i] = "generated", "note"
    return out


_MEASURED = "n_tokens bigint, grammar_size bigint, n_rules bigint, reason string, evidence string, start_hash bigint, text_hash bigint, long_rules array<bigint>"
_KEPT = ["n_tokens", "grammar_size", "n_rules", "reason", "evidence", "start_hash", "text_hash", "long_rules"]
_CHUNK, _CHUNK_CHARS = 250, 600_000  # texts, and about their characters, whose grammars are built together


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= _CHUNK or size + n > _CHUNK_CHARS):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Tokens()
    for batch in batches:
        for begin, end in _chunks([len(t) if isinstance(t, str) else 0 for t in batch.source_text]):
            part = batch.iloc[begin:end].reset_index(drop=True)
            texts = [t if isinstance(t, str) else "" for t in part.pop("source_text")]
            paths = [p if isinstance(p, str) else "" for p in part["file_path"]]
            langs = [language_of(p) or _lang(x) for p, x in zip(paths, part.pop("lang_id"))]
            m = measures(texts, [_FAMILY.get(x, "es") for x in langs], True, known)
            said = [content_reason(row) or head for row, head in zip(m.itertuples(), head_reasons(paths, texts))]
            m["reason"], m["evidence"] = [x and x[0] for x in said], [x and x[1] for x in said]
            yield pd.concat([part, m[_KEPT]], axis=1)


def _lang(x) -> str | None:
    return x if isinstance(x, str) else None


def measured_files(source_files: DataFrame) -> DataFrame:
    """Re-Pair measures, what they say and the hashes of long rules and passages, for the current text of each file.

    Null texts count as empty and have no tokens. Unknown languages are read
    by the rules of JavaScript.
    """
    rows = source_files.select("file_path", "repo_hash", "loaded_at", "lang_id", "source_text")
    found = spread(rows, "file_path").mapInPandas(_measure, f"file_path string, repo_hash string, loaded_at timestamp_ntz, {_MEASURED}")
    return current_results(found, ["repo_hash", *_KEPT])


def known_files(upstream_files: DataFrame) -> DataFrame:
    """The measures of known third-party files with any tokens, by package."""
    rows = upstream_files.select(F.col("file_name").alias("file_path"), F.col("pkg_name").alias("repo_hash"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"), "lang_id", "source_text")
    return rows.mapInPandas(_measure, f"file_path string, repo_hash string, loaded_at timestamp_ntz, {_MEASURED}").filter("n_tokens > 0")


def shared_passages(files: DataFrame, known: DataFrame) -> DataFrame:
    """How many of each file's long rules and passages others have too: ``file_path``, ``n_passages``, ``n_shared``.

    ``files`` and ``known`` have ``file_path``, ``repo_hash`` and
    ``long_rules``. A rule is shared if a known file or a file of another
    repository has it. They are counted by hash over all files; a rule that
    many files have is split over several tasks.
    """
    each = files.select("file_path", F.coalesce("repo_hash", F.lit("")).alias("repo_hash"), F.explode(F.array_distinct("long_rules")).alias("rule"))
    theirs = known.select(F.explode(F.array_distinct("long_rules")).alias("rule")).distinct().select("rule", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(True).alias("known"))
    repos = each.groupBy("rule").agg(F.min("repo_hash").alias("a"), F.max("repo_hash").alias("b")).withColumn("known", F.lit(False))
    shared = repos.unionByName(theirs).groupBy("rule").agg(F.max("known").alias("known"), F.min("a").alias("a"), F.max("b").alias("b"))
    shared = shared.filter(F.col("known") | (F.col("a") != F.col("b"))).select("rule", F.lit(1).alias("_hit"))
    found = balanced_join(each.select("file_path", "rule"), shared, "rule", load_plans(each, ["rule"])["rule"], "left")
    return found.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_passages"), F.count("_hit").alias("n_shared"))


def provenance(source_files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """Why a file isn't hand-written there, or null: ``file_path``, ``repo_hash``, ``reason``, ``evidence`` and the measures.

    A file whose grammar expands to the same tokens as a known third-party file
    is ``vendored`` after an exact comparison of the tokens, and so is one whose
    long rules and passages are nearly all found in known files or in other
    repositories. Its own grammars tell ``data``, ``minified`` and
    ``generated``, and rules shared with known places and notes, after a
    comparison of the wording, ``vendored`` and ``generated``.
    """
    files, known = cut(measured_files(source_files)), known_files(upstream_files)
    same = known.select(F.col("start_hash").alias("_start"), F.col("text_hash").alias("_text"), F.lit(True).alias("_known")).distinct()
    joined = files.join(same, (F.col("start_hash") == F.col("_start")) & (F.col("text_hash") == F.col("_text")), "left")
    joined = joined.join(shared_passages(files, known), "file_path", "left")
    copied = F.coalesce(F.col("n_shared") > F.lit(COPIED) * F.col("n_passages"), F.lit(False))
    reason = F.when(F.col("_known"), "vendored").when(F.col("reason").isNotNull(), F.col("reason")).when(copied, "vendored")
    evidence = F.when(F.col("_known"), "rules of a known file").when(F.col("reason").isNotNull(), F.col("evidence")).when(copied, "rules shared with others")
    return joined.select(
        "file_path", "repo_hash", reason.alias("reason"), evidence.alias("evidence"), "n_tokens", "grammar_size", "n_rules",
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    )


def shared_rules(source_files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """Files with long rules or passages: ``file_path``, ``repo_hash``, ``n_passages``, ``n_shared``, as `shared_passages` counts them.

    Passages are chosen by content, so any passage of 63 tokens counts that
    stands once in a file of each of two repositories.
    """
    files = cut(measured_files(source_files))
    return shared_passages(files, known_files(upstream_files)).join(files.select("file_path", "repo_hash"), "file_path").select("file_path", "repo_hash", "n_passages", "n_shared")
