"""Classes of node kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first class with a word that a kind contains.
CLASSES = (
    ("interface", "interface"), ("method", "constructor method"), ("class", "class"), ("function", "function"),
    ("event", "event hook"), ("variable", "variable property field declarator"), ("module", "module namespace"),
    ("type", "type enum struct trait"),
)


def kind_class(kind: Column) -> Column:
    """One of nine classes; ``other`` for unknown and null kinds."""
    low, out = F.lower(F.coalesce(kind, F.lit(""))), None
    for name, words in CLASSES:
        has = None
        for w in words.split():
            one = low.contains(w)
            has = one if has is None else has | one
        out = F.when(has, name) if out is None else out.when(has, name)
    return out.otherwise("other")
