"""Globs over paths as regular expressions that Spark evaluates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` don't."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        if part.startswith("**"):
            out += ".*" + part[2:]
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part).replace("/", "/"))
    return f"^{out}$"


def in_scope(path: Column, scopes: list[str] = (), excludes: list[str] = (), allow_virtual: bool = False) -> Column:
    """Whether a path matches any scope (all, if there is none) and no exclude; ``<…>`` paths may be let through."""
    ok = F.lit(True)
    if scopes:
        ok = path.rlike("|".join(glob_regex(g) for g in scopes))
    if excludes:
        ok = ok & ~path.rlike("|".join(glob_regex(g) for g in excludes))
    return (ok | path.startswith("<")) if allow_virtual else ok


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore-file semantics: the last matching pattern decides, ``!`` takes back, a trailing ``/`` means a folder, a leading one the root."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        front = "^" if body.startswith("/") else "(?:^|/)"
        folder = body.endswith("/")
        body = body.strip("/")
        inner = glob_regex(body)[1:-1]
        regex = f"{front}{inner}{'/' if folder else '(?:/|$)'}"
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out
