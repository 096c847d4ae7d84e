import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.functions.globs import ignored, in_scope
from codeloom.functions.kinds import kind_class
from codeloom.operators import linking as L
from codeloom.operators import search as Q
from codeloom.sources import store as S
from codeloom.sources.tables import current_rows
from codeloom.streaming.incremental import upsert_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_innermost(spark):
    d = spark.createDataFrame([("out", "f", 1, 50), ("in", "f", 10, 20), ("in2", "f", 10, 20), ("other", "g", 1, 99)], "id string, file_path string, line_start int, line_end int")
    s = spark.createDataFrame([("f", 5), ("f", 12), ("f", 60), ("h", 1), ("f", None)], "file_path string, line int")
    assert rows(L.innermost(s, d)) == [("f", 12, "in"), ("f", 5, "out")]


def test_resolve_names(spark):
    d = spark.createDataFrame([("1", "f", "a"), ("2", "g", "a"), ("3", "g", "b"), ("4", "g", None)], "id string, file_path string, name string")
    r = spark.createDataFrame([("f", "a"), ("h", "a"), ("f", "b"), ("f", "zz"), ("f", None)], "file_path string, name string")
    assert rows(L.resolve_names(r, d)) == [("f", "a", "1", "same file"), ("f", "b", "3", "unique name"), ("f", "zz", None, "unresolved"), ("h", "a", None, "unresolved")]


def test_receivers_overloads_events_prefixes(spark):
    d = spark.createDataFrame([("m1", "run", "C"), ("m2", "stop", "C"), ("m3", "stop", "D")], "id string, name string, parent_id string")
    s = spark.createDataFrame([("m1", "this", "stop"), ("m1", "$this->x", "stop"), ("m1", None, "run")], "source string, receiver string, name string")
    assert rows(L.receiver_members(s, d)) == [("m1", "this", "stop", "m2")]
    o = spark.createDataFrame([("1", "function_definition", "f", "a", 1, 0), ("2", "function_definition", "f", "a", 9, 0), ("3", "class_definition", "f", "a", 1, 0), ("4", None, "f", None, 1, 0)], "id string, kind string, file_path string, name string, line_start int, column_start int")
    assert sorted(r["id"] for r in L.overload_survivors(o).collect()) == ["2", "3", "4"]
    e = spark.createDataFrame([("a", "ev", "fires_hook"), ("b", "ev", "listens_hook"), ("c", "ev2", "listens_hook")], "source string, target string, type string")
    assert rows(L.event_links(e)) == [("ev", 1, 1, 1), ("ev2", 0, 1, 0)]
    p = L.longest_prefix(spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("q.ts",)], "file_path string"), spark.createDataFrame([("a",), ("a/b",)], "dir string"))
    assert rows(p) == [("a/b/c.ts", "a/b"), ("a/x.ts", "a"), ("q.ts", None)]


def test_four_steps_of_resolution(spark):
    d = spark.createDataFrame(
        [("f1", "f", "local", None), ("g1", "g", "local", None), ("C", "g", "Store", None), ("c1", "g", "get", "C"), ("D", "h", "Other", None), ("d1", "h", "get", "D"), ("m", "f", "caller", "D"), ("u", "h", "only", None), ("x1", "g", "brought", None), ("x2", "h", "brought", None)],
        "id string, file_path string, name string, parent_id string",
    )
    r = spark.createDataFrame(
        [("f", "m", None, "local"), ("f", "m", "$this->Store", "get"), ("f", "m", "this", "get"), ("f", "m", "nobody", "get"), ("f", "m", None, "only"), ("f", "m", None, "brought"), ("z", "m", None, "brought"), ("f", "m", None, None), ("f", "m", None, "local")],
        "file_path string, source string, receiver string, name string",
    )
    i = spark.createDataFrame([("f", "brought", "x2"), ("f", "brought", "x9")], "file_path string, name string, id string")
    got = rows(L.resolve_references(r, d, i).select("file_path", "receiver", "name", "id", "how"))
    assert got == sorted([
        ("f", None, "local", "f1", "same file"), ("f", "$this->Store", "get", "c1", "receiver"), ("f", "this", "get", "d1", "receiver"), ("f", "nobody", "get", None, "unresolved"),
        ("f", None, "only", "u", "unique name"), ("f", None, "brought", "x2", "import"), ("z", None, "brought", None, "unresolved"),
    ], key=str)
    assert L.resolve_references(r.limit(0), d, i).count() == 0


def test_imports_bring_symbols_or_modules(spark):
    n = spark.createDataFrame([("m", "lib/a.ts", "a", "module"), ("s", "lib/a.ts", "Thing", "class_declaration"), ("b", "lib/b.ts", "b", "function_declaration")], "id string, file_path string, name string, kind string")
    i = spark.createDataFrame([("f", "Thing", "lib/a.ts"), ("f", "Gone", "lib/a.ts"), ("f", None, "lib/b.ts"), ("f", "x", None), ("f", "y", "lib/c.ts")], "file_path string, name string, resolved string")
    assert rows(L.imported_nodes(i, n)) == sorted([("f", "Thing", "lib/a.ts", "s", False), ("f", "Gone", "lib/a.ts", "m", True), ("f", "b", "lib/b.ts", "b", False), ("f", "y", "lib/c.ts", None, False)], key=str)


def test_dispatches_prefer_the_same_file(spark):
    d = spark.createDataFrame([("1", "f", "go"), ("2", "g", "go"), ("3", "g", "stop")], "id string, file_path string, name string")
    s = spark.createDataFrame([("ev", "g", "go", 20), ("ev", "g", "go", 10), ("ev", "z", "go", 5), ("ev", "z", "gone", 1), ("ev", "g", None, 1), ("ew", "f", "stop", None)], "target string, file_path string, callback string, priority int")
    assert rows(L.dispatches(s, d)) == [("ev", "1", 1.0, 5), ("ev", "2", 2.0, 10), ("ew", "3", 1.0, None)]


@pytest.mark.parametrize("text,want", [('"where is" the Foo.bar-baz?', ["foo", "bar", "baz"]), ("is a", ["is a"]), ("x", ["x"]), ("", [""])])
def test_query_terms(text, want):
    assert Q.query_terms(text) == want


def test_bm25_and_like_and_wiki(spark):
    n = spark.createDataFrame([("1", "cacheLattice", "function_declaration", "/** Reads the lattice. */"), ("2", "other", "function_declaration", None), ("3", "m", "module", "lattice"), ("4", "py", "function_definition", "# one\n# two")], "id string, name string, kind string, doc string")
    index = Q.postings(n, ["name", "doc"])
    got = [r["node_id"] for r in Q.bm25(index, 4, 3.0, ["lattice", "cachel"]).collect()]
    assert got[0] == "1" and set(got) == {"1", "3"}
    assert Q.bm25(index.limit(0), 0, 1.0, ["x"]).count() == 0 and Q.bm25(index, 4, 3.0, []).count() == 0
    assert [r["id"] for r in Q.like_search(n, "LATTICE", ["name", "doc"]).collect()] == ["1", "3"]
    pages = {r["path"]: r for r in Q.wiki_pages(n).collect()}
    assert set(pages) == {"1", "4"} and pages["1"]["summary"] == "Reads the lattice." and pages["4"]["content"] == "# py\n\none\ntwo"


def test_searches_for_many_queries_and_stored_postings(spark, tmp_path):
    n = spark.createDataFrame([(str(i), name, "d") for i, name in enumerate(["lattice cache", "lattices", "cache", "other thing", ""])], "id string, name string, d string")
    index = Q.postings(n, ["name"])
    queries = spark.createDataFrame([(1, "lattice"), (1, "cache"), (2, "lat"), (3, "none")], "query_id bigint, term string")
    got = {(r["query_id"], r["node_id"]): r["rank"] for r in Q.bm25_many(index, queries).collect()}
    assert set(got) == {(1, "0"), (1, "1"), (1, "2"), (2, "0"), (2, "1")}
    one = {r["node_id"]: r["rank"] for r in Q.bm25(index, 4, 1.5, ["lattice", "cache"]).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == one
    assert Q.bm25_many(index, queries, 1).filter("query_id = 1").count() == 1 and Q.bm25_many(index.limit(0), queries).count() == 0
    folder = str(tmp_path / "index")
    Q.store_index(index, folder)
    assert {r["term"] for r in Q.stored_postings(spark, folder, ["lat"]).collect()} == {"lattice", "lattices"}
    assert Q.stored_postings(spark, folder, []).count() == 0


def test_wiki_table(spark):
    d = lambda x: datetime(2024, 1, x)
    docs = spark.createDataFrame([("r/wiki/a.md", "old", d(1)), ("q/a.md", "new", d(2)), ("b.txt", None, d(1)), (None, "x", d(1))], "page_path string, text string, updated_at timestamp_ntz")
    pages = Q.newest_pages(Q.markdown_pages(docs))
    assert rows(pages.select("path", "title", "content")) == [("a.md", "a", "new"), ("b.txt", "b.txt", "")]
    assert rows(Q.without_pages(pages, pages.filter("path = 'a.md'")).select("path")) == [("b.txt",)]


def test_globs_and_kinds(spark):
    df = spark.createDataFrame([("r/src/a/b.ts",), ("r/src/a.php",), ("<events>",), ("lib/a.ts",)], "p string")
    assert [r[0] for r in df.select(in_scope(F.col("p"), ["*/src/**"], ["**/*.php"], True)).collect()] == [True, False, True, False]
    files = spark.createDataFrame([("a/log.txt",), ("keep/log.txt",), ("out/x",), ("about/x",), ("node/out",), ("x/keep/log.txt",), ("top/y",), ("x/top/y",)], "p string")
    got = [r[0] for r in files.select(ignored(F.col("p"), ["# c", "*.txt", "!keep/log.txt", "out/", "", "/top/"])).collect()]
    assert got == [True, False, True, False, False, False, True, False]
    k = spark.createDataFrame([("method_definition",), ("Interface_declaration",), (None,), ("type_alias_declaration",)], "k string")
    assert [r[0] for r in k.select(kind_class(F.col("k"))).collect()] == ["method", "interface", "other", "type"]


def test_current_rows(spark):
    d = lambda x: datetime(2024, 1, x)
    df = spark.createDataFrame([("a", 1, d(1)), ("a", 2, d(3)), ("a", 2, d(3)), ("a", 9, d(2)), ("b", 5, None), ("b", 4, None), (None, 1, d(1))], "id string, v int, indexed_at timestamp_ntz")
    assert rows(current_rows(df, ["id"], ["v"]).select("id", "v")) == [("a", 2), ("b", 5), (None, 1)]
    assert current_rows(df.limit(0), ["id"], ["v"]).count() == 0


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    new = spark.createDataFrame([("b", 20), (None, 30), ("c", 4)], "id string, v int")
    assert rows(S.upsert(old, new, ["id"])) == [("a", 1), ("b", 20), ("c", 4), (None, 30)]
    assert rows(S.insert_absent(old.filter("id is not null"), new.filter("id is not null"), ["id"])) == [("a", 1), ("b", 2), ("c", 4)]
    m = "file_path string, repo_hash string, content_hash string"
    diff = S.manifest_diff(spark.createDataFrame([("a", "r", "1"), ("b", "r", "2"), ("c", "r", None)], m), spark.createDataFrame([("a", "r", "1"), ("b", "r", "9"), ("d", "r", "4"), ("c", "r", None)], m))
    assert rows(diff) == [("a", "r", "same"), ("b", "r", "changed"), ("c", "r", "same"), ("d", "r", "added")]
    folder = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        S.published(spark, folder, "t")
    S.publish(old, folder, "t")
    S.publish(new, folder, "t")
    assert rows(S.published(spark, folder, "t")) == rows(new) and S.published_version(spark, folder, "t") == "t.v000002"
    assert [r["value"] for r in S.as_json(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == ['{"a":1,"b":null}']
    assert [r["value"] for r in S.as_tsv(spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"]).collect()] == ["1\t"]
    nodes = spark.createDataFrame([("1", "f"), ("2", "g")], "id string, file_path string")
    edges = spark.createDataFrame([("1", "2"), ("2", "2"), ("2", "1")], "source string, target string")
    kept = S.clear_files(nodes, edges, nodes.filter("id = '1'").select("file_path"))
    assert rows(kept[0].select("id")) == [("2",)] and rows(kept[1]) == [("2", "2")]


def test_source_slice(spark):
    nodes = spark.createDataFrame(
        [("1", "f", 2, 3, None, None, None), ("2", "f", None, 3, None, None, None), ("3", "none", 1, 1, 0, 2, None), ("4", "f", 3, 99, None, 4, ""), ("5", "none", 1, 1, 0, 1, "kept"), ("6", "g", 1, 1, 2, 5, None), ("7", "g", 1, 1, 5, 2, None), ("8", "g", 1, 1, 0, 1, None), ("9", None, 1, 1, 0, 1, None), ("10", "g", 1, 1, 3, 900, None)],
        "id string, file_path string, line_start int, line_end int, offset_start int, offset_end int, inline string",
    )
    files = spark.createDataFrame([("f", "a\r\nb\nc\rd"), ("g", "\U0001f600ab\U0001f600c"), ("h", None)], "file_path string, source_text string")
    got = dict(map(tuple, S.source_slice(nodes, files).collect()))
    # Offsets count UTF-16 units: the sign at the begin takes two of them.
    assert got == {"1": "b\nc\rd", "2": None, "3": None, "4": "c\rd", "5": "kept", "6": "ab\U0001f600", "7": "\U0001f600ab\U0001f600c", "8": "\U0001f600", "9": None, "10": "b\U0001f600c"}
    assert S.source_slice(nodes, files.limit(0)).filter("source is not null").count() == 1 and S.source_slice(nodes.limit(0), files).count() == 0


def test_scan_tree(spark, tmp_path):
    for p in ("src/a.py", "src/b.txt", "node_modules/x.py", "skip/c.py", "d.py"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"# {p}\n")
    (tmp_path / ".gitignore").write_text("skip/\n")
    got = S.scan_tree(spark, str(tmp_path), [".py"], S.ignore_patterns(str(tmp_path)))
    assert sorted((r["file_path"], r["source_text"]) for r in got.collect()) == [("d.py", "# d.py\n"), ("src/a.py", "# src/a.py\n")]
    assert S.project_config(str(tmp_path), "none.json") == {}


def test_stream_keeps_newest(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    os.makedirs(source)
    schema = "id string, v int, indexed_at timestamp_ntz"
    for day, part in ((1, [("a", 1), ("b", 1)]), (3, [("a", 3)]), (2, [("a", 2), ("c", 2)])):
        spark.createDataFrame([(i, v, datetime(2024, 1, day)) for i, v in part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert_stream(stream, folder, "nodes", ["id"], "indexed_at", str(tmp_path / "cp")).awaitTermination()
    assert rows(S.published(spark, folder, "nodes").select("id", "v")) == [("a", 3), ("b", 1), ("c", 2)]
