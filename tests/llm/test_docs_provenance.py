import os
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm.broken import parse_rates, parse_states
from codeloom.llm.docs import description, documented, documented_functions, function_code, own_words, paired_nodes, without_templates
from codeloom.llm.gll import parse
from codeloom.llm.provenance import content_reason, head_comments, head_reasons, literal_bits, literal_rows, measured_files, measures, provenance, shared_rules
from codeloom.llm.repair import Grammars

FILES = "file_path string, repo_hash string, lang_id string, source_text string, n_bytes bigint, loaded_at timestamp_ntz, reason string, functions int"
AT = datetime(2024, 1, 1)


def files(spark, rows):
    return spark.createDataFrame([(p, r, None, t, 0, at, "clash", 1) for p, r, t, at in rows], FILES)


# GLL


def test_gll_ambiguous_and_left_recursive():
    rules = {"E": [("E", "+", "E"), ("n",)]}
    text = "n+n+n"
    ends, _ = parse(rules, "E", lambda i: text[i] if i < len(text) else None, 0)
    assert ends == {1, 3, 5}
    assert parse({"S": [("(", "S", ")"), ()]}, "S", lambda i: "(()"[i] if i < 3 else None, 0)[0] == {0}


# Functions and documentation

GOOD = "Reads all the rows from one table and sums them."
CASES = [
    ("a.ts", f"/** {GOOD} */\nexport async function foo<T>(a: Map<string, T[]> = new Map()): Promise<{{ x: T }}> {{\n}}", [(2, "foo")]),
    ("a.ts", f"class A {{\n  /**\n   * {GOOD}\n   * @param x one two three\n   */\n  @Dec({{ a: 1 }})\n  @Other\n  private static async bar(a: () => void): any {{", [(8, "bar")]),
    ("a.js", f"/** {GOOD} */\nconst f = async (a, {{ b }}) => a;\n/** {GOOD} */\nconst data = {{ a: (b) }};\n/** {GOOD} */\nlet g = x => x", [(2, "f"), (6, "g")]),
    ("a.js", f"/* {GOOD} */\nfunction no() {{}}\n// {GOOD}\nfunction nor() {{}}\n/** {GOOD} */\n\nfunction gap() {{}}\n/** {GOOD} */\nlet x = 1;\nfunction far() {{}}", []),
    ("a.js", f"const s = `/** {GOOD} */\nfunction fake() {{}}`; const t = '/** {GOOD} */'\nfunction fake2() {{}}", []),
    ("a.js", f"}} }} ((( broken\n/** {GOOD} */\nfunction ok(a = '(') {{\n  if (", [(3, "ok")]),
    ("a.php", f"<?php\nclass A {{\n  /** {GOOD} */\n  #[Pure(1)]\n  #[X]\n  final public static function &go(?int $a = [1]): int|string\n  {{ }}\n  /** {GOOD} */\n  abstract function b();\n}}", [(6, "go"), (9, "b")]),
    ("a.php", f"<?php $x = <<<T\n/** {GOOD} */\nfunction fake() {{}}\nT;\n/** {GOOD} */\nfunction real() {{}}", [(6, "real")]),
    ("a.py", f'def f(a: int = (1),\n      b=2) -> "x":\n    """{GOOD}"""\n', [(1, "f")]),
    ("a.py", f"# {GOOD}\n# More.\n@dec(\n  1)\n@other\nasync def g():\n    pass\n", [(6, "g")]),
    ("a.py", f"# {GOOD}\n\ndef no(): pass\nx = 1  # {GOOD}\ndef nor():\n    x = '''{GOOD}'''\n    f'''{GOOD}'''\n", []),
    ("a.py", f"class A:\n    def m(self):\n\n        # first a comment\n        r'''\n        {GOOD}\n        '''\n    def n(self): '{GOOD}'\n", [(2, "m"), (8, "n")]),
    ("a.py", f"def broken(:\n    pass\ndef fine():\n    '{GOOD}'\n", [(3, "fine")]),
    ("a.css", f"/** {GOOD} */\nfunction x() {{}}", []), ("a.py", "", []), ("a.py", None, []),
]


@pytest.mark.parametrize("path,text,want", CASES)
def test_documented(path, text, want):
    assert [(line, name) for line, name, *_ in documented(text, path)] == want
    assert all(own_words(description(doc), name) >= 5 for _, name, doc, *_ in documented(text, path))


CODE = [
    ("a.ts", "/** D */\nexport function f(a = '}') {\n  if (a) { return /[}]/.test(a); }\n  return `}`;\n}\nlet rest;", ["export function f(a = '}') {\n  if (a) { return /[}]/.test(a); }\n  return `}`;\n}"]),
    ("a.js", "/** D */\nconst f = (a) => a\nlet b = 1;\n/** D */\nconst g = (x) => ({ a: [x, 1] });\n/** D */\nconst h = async x => {\n  y();\n};", ["const f = (a) => a", "const g = (x) => ({ a: [x, 1] })", "const h = async x => {\n  y();\n}"]),
    ("a.js", "class A {\n  /** D */\n  static m(a) {\n    return { b: a };\n  }\n  n() {}\n}\n/** D */\nfunction cut(a) {\n  b(", ["  static m(a) {\n    return { b: a };\n  }", "function cut(a) {\n  b("]),
    ("a.php", "<?php\nclass A {\n  /** D */\n  abstract function a($x);\n  /** D */\n  public function b() { return '}' . \"}\"; // }\n  }\n}", ["  abstract function a($x);", "  public function b() { return '}' . \"}\"; // }\n  }"]),
    ("a.py", "class A:\n    def m(self, a=(1,\n2)):\n        'D'\n        if a:\n            b = '''\nx\n'''\n\n        return [\n1]\n\n    # next\n    def n(self): 'D'\nx = 1\n", ["    def m(self, a=(1,\n2)):\n        'D'\n        if a:\n            b = '''\nx\n'''\n\n        return [\n1]", "    # next", "    def n(self): 'D'"]),
]


@pytest.mark.parametrize("path,text,want", CODE)
def test_code_of_functions(path, text, want):
    got = [function_code(text, path, begin, end) for *_, begin, end in documented(text, path)]
    assert got == [w for w in want if w != "    # next"] or path == "a.py" and got[0] == want[0] and set(got[1:]) == {want[2]}


@pytest.mark.parametrize("doc,name,n", [("/** Splits the node beacon. */", "splitNodeBeacon", 2), ("/**\n * @returns one two three four five six\n * {@inheritdoc}\n */", "f", 0), ('"""fixme"""', "f", 1), ("# a b c\n# :param x: y", "a_b", 1), ("/** */", "f", 0), ("# -----", "f", 0)])
def test_triviality(doc, name, n):
    assert own_words(description(doc), name) == n


def test_pairs(spark):
    text = f"/** {GOOD} */\nfunction foo() {{}}\n/** TODO */\nfunction bar() {{}}\n"
    old = f"/** {GOOD} */\nfunction bar() {{}}\n"
    src = files(spark, [("r/a.js", "r", old, AT), ("r/a.js", "r", text, datetime(2024, 2, 1)), ("r/a.js", "r", text, datetime(2024, 2, 1)), ("r/b.js", "r", None, AT), (None, "r", text, AT)])
    found = documented_functions(src)
    assert [(r["file_path"], r["line"], r["name"]) for r in found.collect()] == [("r/a.js", 2, "foo")]
    nodes = spark.createDataFrame(
        [("r/a.js:2:0", "foo", "function_declaration", "r/a.js", None, "x"), ("r/a.js:4:0", "bar", "function_declaration", "r/a.js", 4, "x"), ("odd", None, " Function_Declaration", "r/a.js", 2, "x"), ("c", "foo", "class_declaration", "r/a.js", 2, "x"), ("w", "other", "function_declaration", "r/a.js", 2, "x")],
        "id string, name string, kind string, file_path string, line_start int, doc string",
    )
    pairs = paired_nodes(nodes, found)
    assert {(r["id"], r["name"], r["doc"]) for r in pairs.collect()} == {("r/a.js:2:0", "foo", GOOD), ("odd", "foo", GOOD)}
    assert paired_nodes(nodes.limit(0), found).count() == 0 and documented_functions(src.limit(0)).count() == 0
    many = spark.createDataFrame([(f"{i}", f"get{w}", "k", "f", f"Gives the {w} back to whom it may concern.") for i, w in enumerate(["Ab", "Cd", "Ef", "Gh"])] + [("9", "solo", "k", "f", "A text of its very own.")], "id string, name string, kind string, file_path string, doc string")
    assert {r["id"] for r in without_templates(many, 3).collect()} == {"9"} and without_templates(many, 4).count() == 5 and without_templates(many.limit(0), 1).count() == 0


def test_ten_times_the_pairs_keep_the_same_descriptions(spark):
    words = [w for i in range(290) for w in [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}"] * 3] + ["template"] * 130
    rows = spark.createDataFrame([(str(i), "f", "k", "p", f"About {w} and no more of it") for i, w in enumerate(words)], "id string, name string, kind string, file_path string, doc string")
    large = rows.crossJoin(spark.range(10).select(F.col("id").alias("copy"))).drop("copy")
    kept, more = ({r["doc"] for r in without_templates(x, 20, 0.03).collect()} for x in (rows, large))
    assert kept == more and len(kept) == 290 and "About template and no more of it" not in kept


# Parse states


def test_parse_states(spark):
    rows = [("r/a.js", "r", "let a = {", AT), ("r/a.js", "r", "let a = 1", datetime(2024, 2, 1)), ("r/b.py", "r", "x = (\r\ny", AT), ("r/c.php", "q", None, AT), ("r/d.xyz", "q", "(((", AT), ("r/e.ts", None, "", AT), (None, "r", "((", AT), ("r/long.js", "r", "f(1);\n" * 20_000 + "}", AT)]
    got = {r["file_path"]: r for r in parse_states(files(spark, rows)).collect()}
    assert set(got) == {"r/a.js", "r/b.py", "r/c.php", "r/d.xyz", "r/e.ts", "r/long.js"}
    assert {p for p, r in got.items() if r["problem"]} == {"r/b.py", "r/long.js"}
    assert got["r/b.py"]["problem"] == "truncated" and got["r/d.xyz"]["language"] is None and got["r/long.js"]["at_line"] == 20_001
    rates = {(r["repo_hash"], r["language"]): (r["n_files"], r["n_broken"], r["broken_rate"]) for r in parse_rates(parse_states(files(spark, rows))).collect()}
    assert rates[("r", "javascript")] == (2, 1, 0.5) and rates[(None, "typescript")] == (1, 0, 0.0)
    assert parse_states(files(spark, rows).limit(0)).count() == 0


# Re-Pair


def expand_hash(seq):
    h = 0
    from codeloom.llm.repair import _BASE, mix

    with np.errstate(over="ignore"):
        for v in mix(np.asarray(seq, np.uint64)):
            h = (h * int(_BASE) + int(v)) % (1 << 64)
    return h


def build(seqs, long_rule=4):
    tokens = np.array([x for s in seqs for x in s], np.uint64)
    return Grammars(tokens, np.repeat(np.arange(len(seqs)), [len(s) for s in seqs]), len(seqs), long_rule)


@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_repair_start_hash_is_that_of_the_sequence(seqs):
    g = build(seqs)
    assert [int(x) for x in g.start] == [expand_hash(s) if s else 0 for s in seqs]
    assert all(size <= n + 1 for size, n in zip(g.size, map(len, seqs)))


def test_repair_grammar_is_independent_of_neighbours():
    rng = random.Random(1)
    seqs = [[rng.randrange(3) for _ in range(50)], [1, 2, 3] * 40, list(range(90)), [7] * 64]
    alone = [(int(g.size[0]), int(g.rules[0])) for g in (build([s]) for s in seqs)]
    together = build(seqs)
    assert alone == list(zip(together.size.tolist(), together.rules.tolist()))
    assert together.size[1] < 25 and together.rules[2] == 0 and together.size[2] == 90 and together.size[3] <= 14
    assert build([[]]).size.tolist() == [0]


# Provenance

HAND = "import a from 'b';\n" + "\n".join(f"export function f{i}({'abcdefg'[i]}) {{ const {'klmnopq'[i]} = {'abcdefg'[i]}.{w}({i}); if (!{'klmnopq'[i]}.{w}) {{ return null; }} return g{i}({'klmnopq'[i]}, '{w}'); }}" for i, w in enumerate("red green blue cyan pink grey gold".split()))
TABLE = "\n".join(f"register({i * 7919}, 'key_{i}', [{i}, {i}]);" for i in range(40))
MINI = ";".join(f"var {c}{i}=function({c}){{return {c}.{c}?{c}({i}):{c}[{i}]||{i}}}" for i, c in enumerate("abcdefghijklm"))
RAND = random.Random(3)
BLOB = "const x = '" + "".join(RAND.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1500)) + "';\n"
DATA = "export default [\n" + "\n".join(f"  [{', '.join(str(RAND.randrange(9999)) for _ in range(10))}]," for _ in range(20)) + "\n];\n"


def reason(text, family="es"):
    found = content_reason(next(measures([text], [family]).itertuples()))
    return found and found[0]


def test_content_reasons():
    assert [reason(t) for t in (HAND, TABLE, MINI, BLOB, DATA, "", "let a = 1", "word " * 300)] == [None, "generated", "minified", "data", "data", None, None, None]
    long_text = "const s = '" + " ".join(RAND.choice("lorem ipsum dolor sit amet consetetur".split()) for _ in range(300)) + "';\n" + HAND
    assert reason(long_text) is None


def test_short_texts_are_judged_by_the_same_measures():
    short = "".join(f"k({i},{i});\n" for i in range(8))  # 56 tokens
    assert [reason(t) for t in (short, "x = ['a', 'b', 'c']\n", "[1, 2, 3, 4, 5, 6, 7, 8]", ";", "{}", "export * from './a';")] == ["generated", None, "data", None, None, None]
    key = "K = '" + "".join(RAND.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(120)) + "'"
    assert reason(key, "python") == "data" and reason("K = 'Reads the rows of one table and writes a short summary for each of them.'", "python") is None


def test_literal_grammars():
    words = " ".join(RAND.choice("lorem ipsum dolor sit amet consetetur".split()) for _ in range(300))
    table = "nr,label,state,amount\n" + "\n".join(f"{i},{RAND.choice('abc')},x,{RAND.randrange(999)}" for i in range(20))
    bits, rows = literal_bits([words, BLOB[11:-3], table, ""]), literal_rows([words, BLOB[11:-3], table, ""])
    assert bits[0] < 3 and bits[1] > 6 and bits[3] == 0 and rows[2] < 0.5 and list(rows[[0, 1, 3]]) == [1, 1, 1]


PLACES = [("r/vendor/x/a.js", ("vendored", "place")), ("r/src/vendor_portal/a.js", None), ("r/src/generated_reports/a.py", None), ("r/node_modules/a/b/c.js", ("vendored", "place")), ("vendor", None), ("", None)]


def test_places_and_notes_by_shared_rules():
    assert head_reasons([p for p, _ in PLACES], [HAND] * len(PLACES)) == [w for _, w in PLACES]
    assert head_reasons(["r/a.js"], ["// Code generated by x. DO NOT EDIT.\n" + HAND]) == [("generated", "note")]
    assert head_reasons([], []) == [] and head_reasons([""], [""]) == [None]


@pytest.mark.parametrize(
    "head,want",
    [
        ("// Code generated by x. DO NOT EDIT.", True), ("/**\n * @generated by x\n */", True), ("# AUTO-GENERATED FILE - edit y", True), ("<?php\n/* Generated on 2024-01-01 by x */", True), ("# Automatisch erzeugt aus x.", True), ("// <auto-generated> do not modify", True), ("# Machine made by x: edits are overwritten", True),
        ("// This file is written by hand; nothing here is autogenerated.", False), ("// Helpers for the code generator.", False), ("// Checks whether a file carries a do-not-edit note.", False), ("const a = '@generated ' + b", False), ("import a from 'b'\n// Code generated by x", False),
    ],
)
def test_markers(head, want):
    from codeloom.llm.provenance import _MARKED

    assert bool(_MARKED.search(head_comments(head + "\n" + HAND))) is want


def test_provenance(spark):
    copy = "// local copy\n" + HAND.replace("{ ", "{\n    ").replace("; ", ";\r\n")
    other = HAND.replace("red", "black").replace("const", "let").replace("!", "").replace("null", "undefined")
    rows = [("r/a.js", "r", other, AT), ("r/copy.js", "r", copy, AT), ("r/table.js", "r", TABLE, AT), ("r/e.js", "r", "", AT), ("r/n.js", "r", None, AT), ("r/vendor/v.js", "r", "let z = 1", AT), ("r/old.js", "r", TABLE, AT), ("r/old.js", "r", "let now = 1", datetime(2024, 3, 1))]
    up = spark.createDataFrame([("p", "1", "f.js", "javascript", HAND), ("p", "2", "empty.js", "javascript", ""), ("p", "3", "n.js", None, None)], "pkg_name string, pkg_version string, file_name string, lang_id string, source_text string")
    got = {r["file_path"]: (r["reason"], r["evidence"]) for r in provenance(files(spark, rows), up).collect()}
    none = (None, None)
    assert got == {"r/a.js": none, "r/copy.js": ("vendored", "rules of a known file"), "r/table.js": ("generated", "rule reuse"), "r/e.js": none, "r/n.js": none, "r/vendor/v.js": ("vendored", "place"), "r/old.js": none}
    assert provenance(files(spark, rows).limit(0), up).count() == 0 and provenance(files(spark, rows), up.limit(0)).filter("reason = 'vendored'").count() == 1
    # A copy that two repositories have, with lines of their own around it, is known from the rules alone.
    copies = [(f"{r}/x.js", r, HAND + f"export const {r}own = {i};\n", AT) for i, r in enumerate("ab")] + [("c/y.js", "c", other, AT)]
    got = {r["file_path"]: (r["reason"], r["evidence"]) for r in provenance(files(spark, copies), up.limit(0)).collect()}
    assert got == {"a/x.js": ("vendored", "rules shared with others"), "b/x.js": ("vendored", "rules shared with others"), "c/y.js": none}
    assert Counter(r["n_tokens"] for r in measured_files(files(spark, [("q", None, "a b", AT)])).collect()) == {2: 1}


def test_bodies_tell_without_paths_and_heads(spark):
    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    source, up = spark.read.parquet(f"{data}/source_files.parquet"), spark.read.parquet(f"{data}/upstream_files.parquet")
    want = {r["file_path"] for r in provenance(source, up).filter("reason is not null and evidence not in ('note', 'place')").collect()}
    blank = F.udf(lambda t, p: None if t is None else ("<?php\n" if p.endswith(".php") else "") + t[len(head_comments(t)):])
    number = F.concat(F.xxhash64("file_path").cast("string"), F.lit("."), F.element_at(F.split("file_path", r"\."), -1))
    bare = source.withColumn("source_text", blank("source_text", "file_path"))
    back = {str(r["n"]): r["file_path"] for r in source.select("file_path", number.alias("n")).distinct().collect()}
    got = {back[r["file_path"]] for r in provenance(bare.withColumn("file_path", number), up).filter("reason is not null").collect()}
    assert len(want - got) <= 0.1 * len(want) and len(got - want) <= 0.02 * len(want)


def test_passages_shared_once_each(spark):
    pasted = " ".join(f"call{chr(97 + i)}(x{chr(97 + i)} {'+-*/%'[i % 5]} y{chr(98 + i)});" for i in range(20))
    own = ["if (left < right) { return right; }", "while (going) { step(); }"]
    rows = [(f"{r}/x.js", r, f"{own[i]}\n{pasted}\n{own[1 - i]}", AT) for i, r in enumerate("ab")] + [("c/x.js", "c", f"{own[0]} {own[1]}" + " go(now) + stay(here) * turn(back) - walk(on) / run(off);", AT)]
    up = spark.createDataFrame([], "pkg_name string, pkg_version string, file_name string, lang_id string, source_text string")
    got = {r["file_path"]: r["n_shared"] > 0 for r in shared_rules(files(spark, rows), up).collect()}
    assert got == {"a/x.js": True, "b/x.js": True, "c/x.js": False}


def test_grammars_do_not_depend_on_neighbours():
    texts = [HAND, TABLE, "".join(f"f({'abc'[i * i % 3]}, {'xyz'[i * 7 % 5 % 3]}, {'pqr'[i // 2 % 3]});\n" for i in range(90))]
    alone = [measures([t], ["es"], True).iloc[0] for t in texts]
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0, 2, 2]):
        m = measures([texts[i] for i in order], ["es"] * len(order), True)
        for row, i in zip(m.itertuples(), order):
            assert (row.grammar_size, row.n_rules, row.start_hash) == (alone[i].grammar_size, alone[i].n_rules, alone[i].start_hash)
            assert sorted(row.long_rules) == sorted(alone[i].long_rules)


def test_chunks_hold_every_row_once(monkeypatch, spark):
    from codeloom.llm import provenance as P

    monkeypatch.setattr(P, "_CHUNK_CHARS", 10)
    assert list(P._chunks([4, 4, 4, 100, 0, 0])) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(P._chunks([])) == []
