"""Functions paired with their documentation.

The grammars are islands: a documented function's head, with everything inside
brackets as water. A parse begins at each documentation block, wherever it
stands, so what is broken elsewhere in a file loses no valid function; a parse
that fails is given up and the next block begins anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.gll import parse
from codeloom.llm.sources import current_results, spread
from codeloom.llm.syntax import language_of
from codeloom.operators.balance import balanced_join, load_plans
from codeloom.plans.lineage import cut

LEAST_WORDS = 5

_WATER = {
    "Any": [("Item", "Any"), ()],
    "Item": [("ANY",), ("(", "Any", ")"), ("[", "Any", "]"), ("{", "Any", "}")],
    "Params": [("(", "Any", ")")],
    "Args": [("Params",), ()],
    "Name": [("NAME",), ("MOD",), ("async",)],
}
ES_RULES = _WATER | {
    "Unit": [("DOC", "Annots", "Mods", "Fn")],
    "Annots": [("@", "Name", "Dots", "Args", "Annots"), ("@", "Params", "Annots"), ()],
    "Dots": [(".", "Name", "Dots"), ()],
    "Mods": [("MOD", "Mods"), ("async", "Mods"), ()],
    "Fn": [("function", "Star", "Name", "Head", "{"), ("Star", "Name", "Head", "{"), ("VAR", "Name", "Ret", "=", "Arrow")],
    "Star": [("*",), ()],
    "Head": [("Generic", "Params", "Ret")],
    "Generic": [("<", "Inner", ">"), ()],
    "Inner": [("Part", "Inner"), ()],
    "Part": [("ANGLELESS",), ("<", "Inner", ">"), ("(", "Any", ")"), ("[", "Any", "]"), ("{", "Any", "}")],
    "ANGLELESS": [(k,) for k in ("NAME", "MOD", "async", "function", "VAR", "=", "=>", ":", ".", "|", "*", "?", ",", "W", "STR")],
    "Ret": [(":", "Type"), ()],
    "Type": [("Prim",), ("Prim", "|", "Type"), ("|", "Type"), ("Params", "=>", "Type")],
    "Prim": [("Name", "Tail"), ("STR", "Tail"), ("W", "Prim"), ("{", "Any", "}", "Tail"), ("Params", "Tail"), ("[", "Any", "]", "Tail")],
    "Tail": [(".", "Name", "Tail"), ("<", "Inner", ">", "Tail"), ("[", "Any", "]", "Tail"), ("Name", "Tail"), ("STR", "Tail"), ()],
    "Arrow": [("Generic", "Params", "Ret", "=>"), ("async", "Generic", "Params", "Ret", "=>"), ("Name", "=>"), ("async", "Name", "=>")],
}
PHP_RULES = _WATER | {
    "Unit": [("DOC", "Annots", "Mods", "function", "Amp", "Name", "Params", "Ret", "Body")],
    "Annots": [("#[", "Any", "]", "Annots"), ()],
    "Mods": [("MOD", "Mods"), ()],
    "Amp": [("|",), ()],
    "Ret": [(":", "Type"), ()],
    "Type": [("TypeItem", "Type"), ("TypeItem",)],
    "TypeItem": [("NAME",), ("MOD",), ("|",), ("?",), ("W",), ("Params",)],
    "Body": [("{",), (";",)],
}
PY_RULES = _WATER | {
    "Unit": [("Hash", "Annots", "Async", "def", "Name", "Generic", "Params", "Ret", ":", "Body"), ("Hash", "Annots", "Async", "def", "Name", "Generic", "Params", "Ret", ":")],
    "Hash": [("HASH", "Hash"), ()],
    "Annots": [("@", "Deco", "NL", "Annots"), ()],
    "Deco": [("DecoItem", "Deco"), ("DecoItem",)],
    "DecoItem": [("NAME",), (".",), ("STR",), ("W",), ("=",), (":",), (",",), ("(", "Any", ")"), ("[", "Any", "]"), ("{", "Any", "}")],
    "Async": [("async",), ()],
    "Generic": [("[", "Any", "]"), ()],
    "Ret": [("->", "Type"), ()],
    "Type": [("TypeItem", "Type"), ("TypeItem",)],
    "TypeItem": [("NAME",), (".",), ("STR",), ("W",), ("|",), (",",), ("(", "Any", ")"), ("[", "Any", "]")],
    "Body": [("Gap", "Doc")],
    "Doc": [("STR", "Doc"), ("STR",)],
    "Gap": [("NL", "Gap"), ("HASH", "Gap"), ("BLANK", "Gap"), ()],
}

_ES_STR = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|`(?:[^`\\]|\\[\s\S])*`"
_ES_RE = r"(?<=[=(,:&|!?;{}\[])[ \t]*/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*"
_PHP_STR = r"'(?:[^'\\\n\r]|\\[^\n\r])*'|\"(?:[^\"\\\n\r]|\\[^\n\r])*\"|<<<[ \t]*[\"']?(?P<hn>[A-Za-z_]\w*)[\"']?(?:\r\n|\n|\r)(?:[\s\S]*?(?:\r\n|\n|\r))??[ \t]*(?P=hn)\b"
_PY_STR = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
_DOC = r"/\*\*(?![/*])(?:[^*]|\*(?!/))*\*/"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_ES_MODS = "export default static public private protected abstract override readonly declare get set".split()
_PHP_MODS = "public private protected static final abstract readonly".split()

# To find the documentation blocks: everything that may hide the marks is read as a whole.
_FIND = {
    "es": re.compile(rf"(?P<doc>{_DOC})|{_BLOCK}|//[^\n\r]*|{_ES_STR}|{_ES_RE}"),
    "php": re.compile(rf"(?P<doc>{_DOC})|{_BLOCK}|//[^\n\r]*|#(?!\[)[^\n\r]*|{_PHP_STR}"),
}
_TOKEN = {
    "es": re.compile(rf"\s*(?:(?P<DOC>{_DOC})|(?P<C>{_BLOCK}|//[^\n\r]*)|(?P<STR>{_ES_STR})|(?P<NAME>[\w$#]+)|(?P<P>=>|[(){{}}\[\]<>=:,.*?;@])|(?P<BAR>[|&])|(?P<W>\S)|(?P<END>\Z))"),
    "php": re.compile(rf"\s*(?:(?P<DOC>{_DOC})|(?P<A>#\[)|(?P<C>{_BLOCK}|//[^\n\r]*|#[^\n\r]*)|(?P<STR>{_PHP_STR})|(?P<NAME>\w+)|(?P<P>[(){{}}\[\]=:,?;])|(?P<BAR>[|&])|(?P<W>\S)|(?P<END>\Z))"),
}
_ES_KINDS = {"function": "function", "async": "async", "const": "VAR", "let": "VAR", "var": "VAR"} | {m: "MOD" for m in _ES_MODS}
_PHP_KINDS = {"function": "function"} | {m: "MOD" for m in _PHP_MODS}
_PY_TOKEN = re.compile(
    rf"(?P<BLANK>(?<![^\n\r])[ \t\f]*(?:\r\n|\n|\r))|(?P<HASH>(?<![^\n\r])[ \t\f]*#[^\n\r]*(?:\r\n|\n|\r|\Z))|[ \t\f]*(?:(?P<C>#[^\n\r]*)|(?P<NL>\r\n|\n|\r)|(?P<J>\\(?:\r\n|\n|\r))|(?P<STR>{_PY_STR})|(?P<NAME>\w+)|(?P<P>->|[(){{}}\[\]=:,.@])|(?P<BAR>\|)|(?P<W>\S)|(?P<END>\Z))"
)

Found = tuple[int, str, str, int, int]  # line of the function (from 1), its name, its documentation as written, where it begins and where its head ends

# To find a body's end: what may hide brackets is read as a whole.
_BODY = {
    "es": re.compile(rf"{_BLOCK}|//[^\n\r]*|{_ES_STR}|{_ES_RE}|(?<=return)[ \t]*/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/|(?P<open>[({{\[])|(?P<close>[)}}\]])|(?P<stop>[;,])|(?P<line>\n[ \t]*(?=[\w$@/}}]))"),
    "php": re.compile(rf"{_BLOCK}|//[^\n\r]*|#(?!\[)[^\n\r]*|{_PHP_STR}|(?P<open>[({{\[])|(?P<close>[)}}\]])|(?P<stop>;)"),
}


def _line_of(text: str, at: int) -> int:
    head = text[:at]
    return head.count("\n") + head.count("\r") - head.count("\r\n") + 1


def _adjacent(text: str, a: int, b: int) -> bool:
    """Whether no blank line lies between."""
    gap = text[a:b]
    return gap.count("\n") + gap.count("\r") - gap.count("\r\n") <= 1


def _block_documented(text: str, family: str) -> Iterator[Found]:
    """JavaScript, TypeScript and PHP: functions below a ``/** */`` block."""
    token, kinds = _TOKEN[family], _ES_KINDS if family == "es" else _PHP_KINDS
    rules = ES_RULES if family == "es" else PHP_RULES
    for m in _FIND[family].finditer(text):
        if m.lastgroup != "doc":
            continue
        tokens = [("DOC", *m.span("doc"))]

        def kind_at(i: int) -> str | None:
            while len(tokens) <= i:
                t = token.match(text, tokens[-1][2])
                group = t.lastgroup
                a, b = t.span(group)
                word = t.group(group)
                if group == "NAME":
                    kind = kinds.get(word.lower() if family == "php" else word, "NAME")
                else:
                    kind = {"P": word, "BAR": "|", "A": "#[", "C": "STOP", "DOC": "STOP", "END": "STOP"}.get(group, group)
                if len(tokens) == 1 and not _adjacent(text, tokens[0][2], a):
                    kind = "STOP"
                tokens.append((kind, a, b))
                if group == "END":
                    tokens.extend([("STOP", a, a)] * 3)
            return tokens[i][0]

        ends, spans = parse(rules, "Unit", kind_at, 0, ("Fn", "Mods"))
        if not ends:
            continue
        # The declaration begins behind the annotations; its name is the word before the parameters or the equals sign.
        begins = {s for s, _ in spans["Mods"]}
        first = min((s for s in begins if _declares(tokens, s)), default=max(begins))
        names = [i for i in range(first, max(ends)) if tokens[i][0] in ("NAME", "MOD", "async")]
        for i in names:
            after = tokens[i + 1][0]
            if tokens[i][0] == "NAME" or after in ("(", "<", "="):
                name = text[tokens[i][1]:tokens[i][2]]
                at = tokens[i][1]
                for j in range(i, first - 1, -1):  # where the declaration itself begins: behind `export`, at `function` or the first modifier
                    if tokens[j][0] == "VAR":
                        at = tokens[i][1]
                        break
                    if text[tokens[j][1]:tokens[j][2]] in ("export", "default"):
                        break
                    at = tokens[j][1]
                yield _line_of(text, at), name, m.group("doc"), at, tokens[max(ends) - 1][2]
                break


def _declares(tokens, i: int) -> bool:
    return i < len(tokens) and tokens[i][0] in ("MOD", "async", "function", "VAR", "NAME", "*")


def _python_documented(text: str) -> Iterator[Found]:
    """Python: functions with unbroken ``#`` lines above or a docstring."""
    tokens: list[tuple[str, int, int]] = []
    pos = 0
    while True:
        t = _PY_TOKEN.match(text, pos)
        group = t.lastgroup
        a, b = t.span(group)
        word = t.group(group)
        if group == "END":
            break
        pos = b
        if group in "CJ":
            continue
        kind = {"P": word, "BAR": "|"}.get(group, group)
        if group == "NAME" and word in ("def", "async"):
            kind = word
        if group == "STR" and re.match(r"[rRuU]*[bBfF]", word):
            kind = "W"
        tokens.append((kind, a, b))
    depth, closed = 0, [0] * len(tokens)
    for i, (kind, _, _) in enumerate(tokens):  # line ends inside brackets are water
        closed[i] = depth
        depth = depth + 1 if kind in ("(", "[", "{") else max(0, depth - 1) if kind in (")", "]", "}") else 0 if kind == "def" else depth

    def kind_at(i: int) -> str | None:
        return tokens[i][0] if i < len(tokens) else None

    for i, (kind, a, _) in enumerate(tokens):
        if kind != "def":
            continue
        begin = i - 1 if i and tokens[i - 1][0] == "async" else i
        top = begin
        while top:  # back over decorators and comment lines, to where the unit may begin
            if tokens[top - 1][0] == "HASH":
                top -= 1
                continue
            j = top - 1
            if tokens[j][0] != "NL":
                break
            while j and tokens[j - 1][0] not in ("NL", "HASH", "BLANK") or j and closed[j - 1]:
                j -= 1
            if tokens[j][0] != "@":
                break
            top = j
        ends, spans = set(), {}
        for at in range(top, begin + 1):
            if at in (top, begin) or tokens[at - 1][0] in ("NL", "HASH"):
                ends, spans = parse(PY_RULES, "Unit", kind_at, at, ("Hash", "Doc"))
                if i in range(at, max(ends, default=0)):
                    break
        if not ends or i + 1 >= len(tokens):
            continue
        name = text[tokens[i + 1][1]:tokens[i + 1][2]]
        parts = []
        hashes = max((e for s, e in spans["Hash"] if s == at), default=at)
        if hashes > at:
            parts.append(text[tokens[at][1]:tokens[hashes - 1][2]])
        if spans["Doc"]:
            s, e = max(spans["Doc"], key=lambda x: x[1])
            parts.append(text[tokens[s][1]:tokens[e - 1][2]])
        for part in parts:
            yield _line_of(text, tokens[begin][1]), name, part, tokens[begin][1], _block_end(text, tokens, closed, begin, max(ends))


def _column(text: str, at: int) -> int:
    return at - max(text.rfind("\n", 0, at), text.rfind("\r", 0, at))


def _block_end(text: str, tokens: list[tuple[str, int, int]], closed: list[int], begin: int, head_end: int) -> int:
    """Where a Python function ends: before the first line that is indented no deeper than it, outside all brackets."""
    for j in range(head_end, len(tokens)):
        kind, at, _ = tokens[j]
        if kind not in ("NL", "HASH", "BLANK") and not closed[j] and tokens[j - 1][0] in ("NL", "HASH", "BLANK") and _column(text, at) <= _column(text, tokens[begin][1]):
            last = j - 1
            while tokens[last][0] in ("HASH", "BLANK"):
                last -= 1
            return tokens[last][2]
    return len(text)


def _body_end(text: str, family: str, at: int) -> int:
    """Where a function whose head ends at ``at`` is closed: the matching brace, or the end of a bare arrow's expression."""
    if text[at - 1] == ";":
        return at
    depth = 1 if text[at - 1] == "{" else 0
    block = depth == 1
    for m in _BODY[family].finditer(text, at):
        kind = m.lastgroup
        if kind == "open":
            block = block or not text[at:m.start()].strip() and m[0] == "{"
            depth += 1
        elif kind == "close":
            depth -= 1
            if depth < 0:
                return m.start()
            if not depth and block:
                return m.end()
        elif not depth and not block and (kind == "stop" or kind == "line" and text[at:m.start()].strip()):
            return m.start()
    return len(text)


def documented(text: str | None, path: str | None) -> list[Found]:
    """All functions of a text that stand directly below or above documentation, trivial or not."""
    lang = language_of(path)
    if not text or lang is None:
        return []
    if lang == "python":
        return list(_python_documented(text))
    return list(_block_documented(text, "php" if lang == "php" else "es"))


def function_code(text: str, path: str | None, begin: int, end: int) -> str:
    """A documented function from its first line to its end; a text that stops before it gives what there is."""
    lang = language_of(path)
    if lang != "python":
        end = _body_end(text, "php" if lang == "php" else "es", end)
    return text[begin - _column(text, begin) + 1:end].rstrip()


def description(doc: str) -> str:
    """Documentation without comment marks, quotes and lines that begin with a tag."""
    if doc.startswith("/*"):
        lines = [re.sub(r"^\s*\*+", "", x) for x in re.split(r"\r\n|\n|\r", doc[3:-2])]
    elif doc.lstrip().startswith("#"):
        lines = [re.sub(r"^\s*#+", "", x) for x in re.split(r"\r\n|\n|\r", doc)]
    else:
        lines = re.split(r"\r\n|\n|\r", re.sub(r"^[rRuU]*('''|\"\"\"|'|\")|('''|\"\"\"|'|\")$", "", doc.strip()))
    return "\n".join(x.strip() for x in lines if x.strip() and not x.strip().startswith(("@", "{@", ":")))


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")


def own_words(text: str, name: str) -> int:
    """Words of a description that aren't words of the function's name."""
    parts = {p.lower() for p in _NAME_PART.findall(name)}
    return sum(w.lower() not in parts for w in _WORD.findall(text))


_FUNCTIONS = "array<struct<line: int, name: string, doc: string, code: string>>"


def _extract(batches: Iterator[pd.DataFrame], code: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, repo, at, text in zip(batch.file_path, batch.repo_hash, batch.loaded_at, batch.source_text):
            found = []
            for line, name, doc, begin, end in documented(text if isinstance(text, str) else None, path if isinstance(path, str) else None):
                plain = description(doc)
                if own_words(plain, name) >= LEAST_WORDS:
                    found.append({"line": line, "name": name, "doc": plain, "code": function_code(text, path, begin, end) if code else None})
            out.append((path, repo, at, found))
        yield pd.DataFrame(out, columns=["file_path", "repo_hash", "loaded_at", "functions"])


def documented_functions(source_files: DataFrame, code: bool = False) -> DataFrame:
    """Functions of the current texts with non-trivial documentation: ``file_path``, ``repo_hash``, ``line``, ``name``, ``doc``, ``code`` (null unless asked for).

    Documentation is trivial with fewer than five words that aren't words of
    the name, tags set aside. Null and empty texts have no functions. A Python
    function with comment lines and a docstring gives a row for each.
    """
    rows = source_files.select("file_path", "repo_hash", "loaded_at", "source_text")
    found = spread(rows, "file_path").mapInPandas(partial(_extract, code=code), f"file_path string, repo_hash string, loaded_at timestamp_ntz, functions {_FUNCTIONS}")
    return current_results(found, ["repo_hash", "functions"]).select("file_path", "repo_hash", F.inline("functions"))


FUNCTION_KINDS = ("function_declaration", "method_definition", "function_definition", "method_declaration", "variable_declarator")


def paired_nodes(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """Function nodes with their documentation and code: ``id``, ``name``, ``kind``, ``file_path``, ``doc``, ``code``.

    ``nodes`` has ``id``, ``name``, ``kind``, ``file_path`` and ``line_start``;
    a missing line is taken from the id. Node and function must agree in file,
    line and, where the node has one, in name. Several pieces of documentation
    of one function are joined in order.
    """
    line = F.coalesce("line_start", F.regexp_extract("id", r":(\d+):\d+$", 1).try_cast("int"))
    kept = nodes.filter(F.lower(F.trim("kind")).isin(*FUNCTION_KINDS)).select("id", "name", "kind", "file_path", line.alias("line"))
    other = functions.select(F.col("file_path").alias("_file"), F.col("line").alias("_line"), F.col("name").alias("_name"), "doc", "code")
    same = (F.col("file_path") == F.col("_file")) & (F.col("line") == F.col("_line"))
    joined = kept.join(other, same).filter(F.col("name").isNull() | (F.col("name") == F.col("_name")))
    return joined.groupBy("id", "kind", "file_path", F.coalesce("name", "_name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("doc")), "\n").alias("doc"), F.max("code").alias("code"))


def without_templates(pairs: DataFrame, most_repeats: int, most_share: float = 0.0) -> DataFrame:
    """Drops pairs whose description is repeated more than ``most_repeats`` times and in more than ``most_share`` of all pairs.

    The share alone decides once it is worth more than ``most_repeats`` pairs, so
    that ordinary descriptions stay however large the corpus is. The words of a function's name and all numbers count as blanks, so that a
    filled-in template meets its like. Counts cover all pairs. The pairs are cut
    off before, so that no text is parsed again for them.
    """
    parts = F.regexp_extract_all("name", F.lit(r"([A-Z]?[a-z]+|[A-Z]+)"), F.lit(1))
    words = F.regexp_extract_all(F.lower("doc"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    names = F.transform(parts, lambda x: F.lower(x))
    shape = F.transform(words, lambda w: F.when(F.array_contains(names, w) | w.rlike(r"^\d+$"), F.lit("_")).otherwise(w))
    hashed = cut(pairs.withColumn("_shape", F.xxhash64(F.array_join(shape, " "))))
    shapes = hashed.groupBy("_shape").agg(F.count(F.lit(1)).alias("_n"))
    limit = shapes.agg(F.greatest(F.lit(float(most_repeats)), F.lit(most_share) * F.sum("_n")).alias("_most"))
    counts = shapes.crossJoin(F.broadcast(limit)).filter(F.col("_n") > F.col("_most")).select("_shape")  # limit is one row
    return balanced_join(hashed, counts, "_shape", load_plans(hashed, ["_shape"])["_shape"], "left_anti").drop("_shape")
