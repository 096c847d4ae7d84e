"""From declarations and call sites to edges: the joins of the link step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLOADABLE = ("function_definition", "method_declaration", "method_definition", "function_declaration")


def innermost(sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """The innermost declaration around each site: ``file_path``, ``line``, ``id``.

    ``sites`` has ``file_path`` and ``line``, ``declarations`` has ``id``,
    ``file_path``, ``line_start`` and ``line_end``. An equi join on the file with
    the interval as a filter; of the declarations around a line the shortest
    wins, then the least id. Lines outside of all give no row.
    """
    lines = sites.filter(F.col("line").isNotNull()).select("file_path", "line").distinct()
    d = declarations.select("id", F.col("file_path").alias("_f"), "line_start", "line_end")
    around = lines.join(d, (F.col("file_path") == F.col("_f")) & F.col("line").between(F.col("line_start"), F.col("line_end")))
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "id"))
    return around.groupBy("file_path", "line").agg(best["id"].alias("id"))


def resolve_names(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """The declaration that a name means: ``file_path``, ``name``, ``id``, ``how``.

    First one of the same file (the least id), then the only one of that name in
    all files; else ``id`` is null and ``how`` is ``unresolved``.
    """
    asked = references.select("file_path", "name").filter(F.col("name").isNotNull()).distinct()
    named = declarations.filter(F.col("name").isNotNull())
    found = asked.join(_local(named), ["file_path", "name"], "left").join(_unique(named), "name", "left")
    how = F.when(F.col("local").isNotNull(), "same file").when(F.col("only").isNotNull(), "unique name").otherwise("unresolved")
    return found.select("file_path", "name", F.coalesce("local", "only").alias("id"), how.alias("how"))


def _local(named: DataFrame) -> DataFrame:
    return named.groupBy("file_path", "name").agg(F.min("id").alias("local"))


def _unique(named: DataFrame) -> DataFrame:
    return named.groupBy("name").agg(F.min("id").alias("only"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")


def plain_receiver(receiver: Column) -> Column:
    """A receiver without ``this.``, ``self.``, ``$this->`` or ``$`` in front; empty for null."""
    return F.regexp_replace(F.coalesce(receiver, F.lit("")), r"^(?:this\.|self\.|\$this->|\$)", "")


def receiver_members(sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """Calls on a receiver resolved to a member of its owner: ``source``, ``receiver``, ``name``, ``id``.

    ``sites`` has ``source`` (the calling declaration), ``receiver`` and
    ``name``, ``declarations`` has ``id``, ``name`` and ``parent_id``. The owner
    of ``this`` and ``self`` is the parent of the source, that of any other
    receiver the declaration of that name, the least id of several. The member
    is the child of that name, the least id of several. Sites without a
    receiver, an owner or a member give no row.
    """
    asked = sites.select("source", "receiver", "name", plain_receiver(F.col("receiver")).alias("_r")).filter("_r <> '' and name is not null").distinct()
    parents = declarations.select(F.col("id").alias("source"), F.col("parent_id").alias("_owner")).filter(F.col("_owner").isNotNull())
    first = declarations.filter(F.col("name").isNotNull()).groupBy(F.col("name").alias("_r")).agg(F.min("id").alias("_owner"))
    members = declarations.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("_owner"), "name").agg(F.min("id").alias("id"))
    own = F.col("_r").isin("this", "self")
    owned = asked.filter(own).join(parents, "source").unionByName(asked.filter(~own).join(first, "_r"))
    return owned.join(members, ["_owner", "name"]).select("source", "receiver", "name", "id")


def resolve_references(references: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """The declaration that each reference means: ``file_path``, ``source``, ``receiver``, ``name``, ``id``, ``how``.

    Four steps, the first that finds one counts: a declaration of that name in
    the same file, what the file imports under that name (``imports``:
    ``file_path``, ``name``, ``id``), the member of the receiver's owner, the
    only declaration of that name. Of several the least id. References without
    a name are left out; exact repeats give one row.
    """
    asked = references.select("file_path", "source", "receiver", "name").filter(F.col("name").isNotNull()).distinct()
    named = declarations.filter(F.col("name").isNotNull())
    brought = imports.groupBy("file_path", "name").agg(F.min("id").alias("brought"))
    # Names in files are few against the references; the steps by file and name are solved for them alone.
    names = asked.select("file_path", "name").distinct().join(_local(named), ["file_path", "name"], "left").join(brought, ["file_path", "name"], "left").join(_unique(named), "name", "left")
    members = receiver_members(asked, declarations).select(F.col("source").alias("_s"), F.col("receiver").alias("_v"), F.col("name").alias("_n"), F.col("id").alias("member"))
    mine = F.col("source").eqNullSafe(F.col("_s")) & (F.col("receiver") == F.col("_v")) & (F.col("name") == F.col("_n"))
    found = asked.join(names, ["file_path", "name"], "left").join(members, mine, "left")
    how = F.when(F.col("local").isNotNull(), "same file").when(F.col("brought").isNotNull(), "import").when(F.col("member").isNotNull(), "receiver").when(F.col("only").isNotNull(), "unique name").otherwise("unresolved")
    return found.select("file_path", "source", "receiver", "name", F.coalesce("local", "brought", "member", "only").alias("id"), how.alias("how"))


def imported_nodes(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node that an import brings: ``file_path``, ``name``, ``resolved``, ``id``, ``is_module``.

    ``imports`` has ``file_path``, ``name`` (what is imported, null for a whole
    module) and ``resolved`` (the file it comes from). A whole module's name is
    its file's stem. The node of that name in the file counts, else the file's
    module node; the least id of several, null for none.
    """
    stem = F.regexp_extract("resolved", r"([^/]*?)(?:\.[^./]*)?$", 1)
    asked = imports.filter(F.col("resolved").isNotNull()).select("file_path", F.coalesce("name", stem).alias("name"), "resolved").distinct()
    symbols = nodes.filter(F.col("name").isNotNull()).groupBy(F.col("file_path").alias("resolved"), "name").agg(F.min("id").alias("_symbol"))
    modules = nodes.filter("kind = 'module'").groupBy(F.col("file_path").alias("resolved")).agg(F.min("id").alias("_module"))
    found = asked.join(symbols, ["resolved", "name"], "left").join(modules, "resolved", "left")
    return found.select("file_path", "name", "resolved", F.coalesce("_symbol", "_module").alias("id"), (F.col("_symbol").isNull() & F.col("_module").isNotNull()).alias("is_module"))


def dispatches(sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges from an event to the callbacks that hear it: ``source``, ``target``, ``weight`` (number of sites), ``priority`` (the least).

    ``sites`` are those of ``listens_hook``: ``target`` (the event),
    ``file_path``, ``callback`` and ``priority``. A callback is the declaration
    of that name in the same file, else the least id of that name anywhere;
    callbacks that nobody declares give no edge.
    """
    asked = sites.filter(F.col("callback").isNotNull()).select(F.col("target").alias("source"), "file_path", F.col("callback").alias("name"), "priority")
    named = declarations.filter(F.col("name").isNotNull())
    first = named.groupBy("name").agg(F.min("id").alias("_any"))
    found = asked.join(_local(named), ["file_path", "name"], "left").join(first, "name", "left").withColumn("target", F.coalesce("local", "_any"))
    return found.filter(F.col("target").isNotNull()).groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("priority").alias("priority"))


def overload_survivors(declarations: DataFrame) -> DataFrame:
    """Of declarations with one name in one file, for kinds that can be overloaded, the last one stays.

    Last is the greatest start line, then column, then id.
    """
    order = F.max(F.struct("line_start", "column_start", "id"))
    kinds = F.col("kind").isin(*OVERLOADABLE)
    many = declarations.filter(kinds & F.col("name").isNotNull()).groupBy("file_path", "name").agg(order["id"].alias("id")).select("id")
    rest = declarations.filter(~kinds | F.col("kind").isNull() | F.col("name").isNull()).select("id")
    return declarations.join(many.unionByName(rest), "id", "left_semi")


def merged_call_sites(sites: DataFrame) -> DataFrame:
    """Edges from single call sites: ``source``, ``target``, ``type``, ``weight`` (number of sites), files and the first site.

    The first site is the least by file, line and column. Edges of one pair and
    type are merged by partial sums, so a pair with many sites needs no list in
    one task.
    """
    first = F.min(F.struct("file", "line", "column"))
    return sites.groupBy("source", "target", "type").agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count_distinct("file").alias("n_files"),
        first["file"].alias("site_file"), first["line"].alias("site_line"), first["column"].alias("site_column"),
    )


def event_links(sites: DataFrame) -> DataFrame:
    """How an event connects: ``event``, ``n_firing``, ``n_listening``, ``n_links`` (pairs of both).

    ``sites`` are edges ``fires_hook`` and ``listens_hook`` to event nodes. The
    pairs themselves would grow with the square of an event's edges; they are
    the edges on its two sides.
    """
    ends = sites.filter("type in ('fires_hook', 'listens_hook')").select("source", F.col("target").alias("event"), "type").distinct()
    per = ends.groupBy("event").agg(*[F.count(F.when(F.col("type") == t, 1)).alias(n) for t, n in (("fires_hook", "n_firing"), ("listens_hook", "n_listening"))])
    return per.withColumn("n_links", F.col("n_firing") * F.col("n_listening"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The longest folder in ``prefixes`` (``dir``) that holds each path: ``file_path``, ``dir``.

    Every path is cut at its slashes and the pieces are joined by equality, so
    that no path meets every prefix. No match gives a null.
    """
    parts = F.split("file_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    cut = paths.select("file_path").distinct().withColumn("dir", F.explode(ups))
    hits = cut.join(prefixes.select("dir").distinct(), "dir", "left_semi")
    best = hits.groupBy("file_path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return paths.select("file_path").distinct().join(best, "file_path", "left")


SUFFIXES = ("", ".ts", ".mts", ".js", ".mjs", "/index.ts", "/index.mts", "/index.js", "/index.mjs")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file that an import means: ``file_path``, ``module``, ``resolved`` (null if none is known).

    Relative imports (``./``, ``../``) of ``imports`` (``file_path``,
    ``module``) try the path itself and then each of ``SUFFIXES`` against
    ``files`` (``file_path``); dotted modules of Python files try
    ``a/b.py`` and ``a/b/__init__.py`` below the importer's repository and below
    its ``src``. The first known candidate wins.
    """
    asked = imports.select("file_path", "module").distinct()
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    ups = F.length(F.regexp_replace("module", r"^((?:\.\./)*).*$", "$1")) / 3
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - ups.cast("int"), F.lit(0))), "/")
    rest = F.regexp_replace("module", r"^(?:\./|(?:\.\./)+)", "")
    relative = F.array(*[F.concat(base, F.lit("/"), rest, F.lit(s)) for s in SUFFIXES])
    dotted = F.replace("module", F.lit("."), F.lit("/"))
    python = F.array(*[F.concat(parts[0], F.lit(mid), dotted, F.lit(end)) for mid in ("/", "/src/") for end in (".py", "/__init__.py")])
    candidates = F.when(F.col("module").rlike(r"^\.\.?/"), relative).when(F.col("file_path").endswith(".py"), python)
    each = asked.select("file_path", "module", F.posexplode(candidates).alias("n", "path"))
    known = each.join(files.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")
    best = known.groupBy("file_path", "module").agg(F.min_by("path", "n").alias("resolved"))
    return asked.join(best, ["file_path", "module"], "left")


def promoted_parents(placed: DataFrame, allowed: DataFrame) -> DataFrame:
    """A filtered forest in which the children of dropped nodes move up: ``id``, ``parent_id``, ``depth``.

    ``placed`` has ``id`` and ``path`` (ids from the root to the node), as
    hierarchies give them; ``allowed`` has ``id``. The new parent is the nearest
    allowed node above, the new depth the number of allowed ones.
    """
    kept = placed.filter("path is not null").join(allowed.select("id").distinct(), "id", "left_semi").select("id", F.posexplode("path").alias("n", "above"))
    up = kept.filter("above <> id").join(allowed.select(F.col("id").alias("above")).distinct(), "above", "left_semi")
    nearest = up.groupBy("id").agg(F.max_by("above", "n").alias("parent_id"), F.count(F.lit(1)).alias("depth"))
    return kept.select("id").distinct().join(nearest, "id", "left").select("id", "parent_id", F.coalesce("depth", F.lit(0)).alias("depth"))
