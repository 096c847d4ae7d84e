"""Language and event extensions: what a project adds to the built-in ones.

An extension says which file suffixes it covers, how imports look in such
files, and which calls fire or hear named events. The registry turns all of
them into Spark expressions, so that an extension costs no Python in the tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = re.compile(r"[a-z][\w-]*(?:[./][a-z][\w-]*)+")


@dataclass(frozen=True)
class EventRule:
    """Calls of ``function`` fire or hear the event named by their first argument, a plain string.

    A listening call's second argument, a plain string, is the callback; two
    whole numbers may follow, its priority and how many arguments it accepts.
    """

    function: str
    direction: str

    def __post_init__(self):
        if self.direction not in ("fire", "listen") or not re.fullmatch(r"\w+", self.function):
            raise ValueError(f"an event rule needs a function name and fire or listen: {self}")


@dataclass(frozen=True)
class Extension:
    id: str
    name: str
    version: str
    suffixes: tuple[str, ...] = ()
    imports: str | None = None  # a pattern whose groups capture the module
    events: tuple[EventRule, ...] = field(default=())

    def __post_init__(self):
        if not _ID.fullmatch(self.id):
            raise ValueError(f"an extension's id is namespaced, such as team.language: {self.id!r}")
        if not self.name or not self.version:
            raise ValueError("an extension needs a name and a version")
        if bool(self.suffixes) != bool(self.imports):
            raise ValueError("suffixes and an import pattern belong together")
        if self.imports and not 1 <= re.compile(self.imports).groups <= 2:
            raise ValueError("an import pattern has one or two groups")


BUILT_IN = (
    Extension("codeloom.ecmascript", "JavaScript and TypeScript", "1", ("ts", "mts", "js", "mjs"), r"(?m)^import\s+(?:[^'\";]*?\sfrom\s+)?['\"]([^'\"]+)['\"]"),
    Extension("codeloom.python", "Python", "1", ("py",), r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import\b|import[ \t]+([\w.]+))"),
    Extension("codeloom.php", "PHP", "1", ("php",), r"(?m)^use\s+(?:function\s+|const\s+)?([\w\\]+)", (EventRule("do_action", "fire"), EventRule("add_action", "listen"))),
)


class Registry:
    """Extensions in order; for a suffix or an event function the last one that names it counts."""

    def __init__(self, extensions: tuple[Extension, ...] = BUILT_IN):
        self.extensions: list[Extension] = list(extensions)

    def add(self, extension: Extension) -> None:
        self.extensions = [e for e in self.extensions if e.id != extension.id] + [extension]

    def import_patterns(self) -> dict[str, str]:
        return {s: e.imports for e in self.extensions for s in e.suffixes}

    def event_rules(self) -> dict[str, EventRule]:
        return {r.function: r for e in self.extensions for r in e.events}

    def imported_modules(self, path: Column, text: Column) -> Column:
        """The modules that a text imports, in the order of the pattern's groups; none for unknown suffixes."""
        suffix, text = F.regexp_extract(path, r"\.(\w+)$", 1), F.coalesce(text, F.lit(""))
        out = F.array().cast("array<string>")
        for s, pattern in self.import_patterns().items():
            groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)) for g in range(re.compile(pattern).groups)]
            out = F.when(suffix == s, F.filter(F.concat(*groups), lambda m: m != "")).otherwise(out)
        return out

    def event_calls(self, text: Column) -> Column:
        """Calls that fire or hear events: an array of ``direction``, ``event``, ``callback``, ``priority``, ``accepted``.

        Missing parts are empty. Calls are found by their text, also in comments.
        """
        text, parts = F.coalesce(text, F.lit("")), []
        for direction in ("fire", "listen"):
            names = sorted(f for f, r in self.event_rules().items() if r.direction == direction)
            if names:
                rest = r"(?:\s*,\s*['\"]([^'\"]+)['\"](?:\s*,\s*(\d+))?(?:\s*,\s*(\d+))?)?" if direction == "listen" else "()()()"
                pattern = F.lit(rf"\b(?:{'|'.join(names)})\s*\(\s*['\"]([^'\"]+)['\"]" + rest)
                groups = [F.regexp_extract_all(text, pattern, F.lit(g)) for g in range(1, 5)]
                zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("event", "callback", "priority", "accepted"))])
                parts.append(_with_direction(zipped, direction))
        return F.concat(*parts) if parts else F.array()


def _with_direction(calls: Column, direction: str) -> Column:
    names = ("event", "callback", "priority", "accepted")
    return F.transform(calls, lambda x: F.struct(F.lit(direction).alias("direction"), *[x[n].alias(n) for n in names]))
