import pytest
from pyspark.sql import functions as F

from codeloom.functions.extensions import EventRule, Extension, Registry


def test_validation():
    Extension("team.go", "Go", "1", ("go",), r'import "([^"]+)"')
    for bad in (dict(id="plain"), dict(name=""), dict(suffixes=()), dict(imports="no group"), dict(imports=None)):
        with pytest.raises(ValueError):
            Extension(**{"id": "team.go", "name": "Go", "version": "1", "suffixes": ("go",), "imports": r'import "([^"]+)"', **bad})
    with pytest.raises(ValueError):
        EventRule("emit", "shout")


def test_imports_by_suffix_and_override(spark):
    r = Registry()
    df = spark.createDataFrame([("a.ts", "import a from 'x'\nimport 'y';"), ("a.py", "import os\nfrom a.b import c\n"), ("a.php", "<?php\nuse A\\B;\n"), ("a.go", 'import "fmt"'), ("a.ts", None)], "p string, t string")
    got = lambda: [x[0] for x in df.select(r.imported_modules(F.col("p"), F.col("t"))).collect()]
    assert got() == [["x", "y"], ["a.b", "os"], ["A\\B"], [], []]
    r.add(Extension("team.go", "Go", "1", ("go", "ts"), r'import "([^"]+)"'))
    assert got() == [[], ["a.b", "os"], ["A\\B"], ["fmt"], []]


def test_event_calls(spark):
    r = Registry()
    df = spark.createDataFrame([("<?php add_action('ready', 'listener', 20, 1); do_action('ready'); do_action( $x ); add_action(\"go\", fn() => 1); emit('e', 'cb');",), (None,)], "t string")
    rows = lambda: [[tuple(x) for x in row[0]] for row in df.select(r.event_calls(F.col("t"))).collect()]
    assert rows() == [[("fire", "ready", "", "", ""), ("listen", "ready", "listener", "20", "1"), ("listen", "go", "", "", "")], []]
    r.add(Extension("team.events", "Events", "1", events=(EventRule("emit", "listen"), EventRule("add_action", "fire"))))
    assert {x[:3] for x in rows()[0]} == {("fire", "ready", ""), ("fire", "go", ""), ("listen", "e", "cb")}
