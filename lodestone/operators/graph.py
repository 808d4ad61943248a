"""The symbol, call and import graph of a corpus, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_path

MOST_TARGETS = 25
MOST_DIR_FILES = 10

#: Endings tried for a module path, in order.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".rs", ".py", ".go", "")
#: Files tried inside a directory of that name, in order.
INDEX_FILES = ("/index.ts", "/index.tsx", "/index.js", "/mod.rs", "/__init__.py")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """left with the value of the last right row at or before it, by key.

    Both sides are stacked and one window per key carries the value forward, so there is
    one shuffle and no range join; at equal positions right rows come first."""
    stacked = right.select(key, at, F.col(value).alias(out), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, at)])
    own = left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias(out), F.lit(1).alias("_side"), *[c for c in left.columns if c not in (key, at)])
    before = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.unionByName(own).withColumn(out, F.last(out, ignorenulls=True).over(before))
    return carried.filter("_side = 1").drop("_side")


def symbols(definitions: DataFrame, blocks: DataFrame) -> DataFrame:
    """sym_id, name, kind, file_id, line, block_id.

    sym_id is file_id and line (a line defines one symbol at most), which orders like a
    dense number over files and lines without numbering them in one task.  A definition
    before the first block belongs to that block."""
    placed = as_of(definitions, blocks.select("file_id", "line", "block_id"), "file_id", "line", "block_id", "block_id")
    first = blocks.groupBy("file_id").agg(F.min("block_id").alias("_first"))
    placed = placed.join(first, "file_id", "left").withColumn("block_id", F.coalesce("block_id", "_first"))
    sym_id = F.shiftleft(F.col("file_id"), 24) + F.col("line")
    return placed.select(sym_id.alias("sym_id"), "name", "kind", "file_id", "line", "block_id")


def call_edges(tokens: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Distinct (src, dst): the definition around a call, and those it may name.

    A name that only one definition has links; else definitions of the caller's file win;
    else up to MOST_TARGETS definitions all link, and more of them none.  Names above that
    bound are joined only with their own file's definitions, so a common name never
    multiplies."""
    sites = as_of(tokens, symbols_.select("file_id", "line", "sym_id"), "file_id", "line", "sym_id", "src").filter("src IS NOT NULL")
    sites = sites.select("src", "file_id", "name").distinct()
    defs = symbols_.select("name", "file_id", F.col("sym_id").alias("dst"))
    named = defs.groupBy("name").agg(F.count("*").alias("n"))
    sites = sites.join(named, "name")
    local = sites.join(defs, ["name", "file_id"]).select("src", "dst")
    owns = defs.select("name", "file_id").distinct()
    others = sites.filter(F.col("n") <= MOST_TARGETS).join(owns, ["name", "file_id"], "left_anti")
    few = named.filter(F.col("n") <= MOST_TARGETS).select("name")
    away = others.select("src", "name").join(defs.join(few, "name", "left_semi").select("name", "dst"), "name").select("src", "dst")
    return local.union(away).filter("src != dst").distinct()


def degrees(edges: DataFrame, by: str) -> DataFrame:
    """Neighbours of each node: by 'src' those it calls, by 'dst' those that call it."""
    other = "dst" if by == "src" else "src"
    return edges.groupBy(F.col(by).alias("node")).agg(F.count("*").alias("degree"), F.min(other).alias("first"), F.max(other).alias("last"))


def adjacency(edges: DataFrame, by: str = "src") -> DataFrame:
    other = "dst" if by == "src" else "src"
    return edges.groupBy(F.col(by).alias("node")).agg(F.sort_array(F.collect_list(other)).alias("neighbours"))


def _ranked(base: DataFrame, path: Column, tier: int) -> DataFrame:
    """All paths to try for a base path, with their rank."""
    tries = F.array(*[F.struct(F.lit(tier * 100 + k).alias("rank"), F.concat(path, F.lit(e)).alias("path")) for k, e in enumerate((*ENDINGS, *INDEX_FILES))])
    return base.select("from_id", "spec", F.inline(tries))


def resolve(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (from_id, spec, to_id) of import specs (file_id, rel, spec).

    Tiers in order: a relative path against the importing file; a module path with dots
    for slashes; its last two parts; a unique file stem; up to MOST_DIR_FILES files of a
    directory (the smallest paths).  The first tier that finds something wins, and a
    relative path has no other tier."""
    trimmed = F.trim("spec")
    dotted = F.when(trimmed.startswith(".") & ~trimmed.startswith("./") & ~trimmed.startswith("../"), F.concat(F.lit("./"), trimmed)).otherwise(trimmed)
    plain = F.regexp_replace(dotted, "^[@~]/", "")
    s = specs.select(F.col("file_id").alias("from_id"), "rel", "spec", plain.alias("p")).filter("p != ''").distinct()
    is_relative = F.col("p").startswith("./") | F.col("p").startswith("../")
    folder = F.regexp_extract("rel", r"(?s)^(.*)/[^/]*$", 1)
    near = s.filter(is_relative)
    far = s.filter(~is_relative).withColumn("parts", F.filter(F.split("p", "/", -1), lambda x: x != "")).filter(F.size("parts") > 0)
    last = F.element_at("parts", -1)
    tries = [
        _ranked(near, normalize_path(F.concat(folder, F.lit("/"), F.col("p"))), 0),
        _ranked(far, F.replace(F.col("p"), F.lit("."), F.lit("/")), 1),
        _ranked(far.filter(F.size("parts") >= 2), F.concat(F.element_at("parts", -2), F.lit("/"), last), 2),
    ]
    hits = reduce(DataFrame.union, tries).join(files.select(F.col("rel").alias("path"), F.col("file_id").alias("to_id")), "path").select("from_id", "spec", "rank", "to_id")
    base = F.element_at(F.split("rel", "/", -1), -1)
    stems = files.groupBy(F.element_at(F.split(base, r"\.", -1), 1).alias("stem")).agg(F.count("*").alias("n"), F.min("file_id").alias("to_id")).filter("n = 1")
    by_stem = far.withColumn("stem", last).join(stems, "stem").select("from_id", "spec", F.lit(300).alias("rank"), "to_id")
    within = Window.partitionBy("dir").orderBy("rel")
    dirs = files.withColumn("dir", F.regexp_extract("rel", r"(?s)^(.*)/[^/]*$", 1)).withColumn("k", F.row_number().over(within)).filter(F.col("k") <= MOST_DIR_FILES)
    by_dir = far.withColumn("dir", last).join(dirs.select("dir", F.col("file_id").alias("to_id")), "dir").select("from_id", "spec", F.lit(400).alias("rank"), "to_id")
    best = Window.partitionBy("from_id", "spec")
    every = hits.union(by_stem).union(by_dir).withColumn("_best", F.min("rank").over(best))
    return every.filter("rank = _best").select("from_id", "spec", "to_id").distinct()


def import_edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter("from_id != to_id").select("from_id", "to_id").distinct()


def find_symbol(symbols_: DataFrame, name: str) -> DataFrame:
    return symbols_.filter(F.col("name") == name)


def neighbours(symbols_: DataFrame, edges: DataFrame, name: str, calls: bool, most: int) -> DataFrame:
    """sym_id, other, other_name: what symbols of a name call (or are called by), the
    first `most` of each by id."""
    a, b = ("src", "dst") if calls else ("dst", "src")
    mine = find_symbol(symbols_, name).select("sym_id")
    near = edges.join(mine, F.col(a) == F.col("sym_id")).select("sym_id", F.col(b).alias("other"))
    place = Window.partitionBy("sym_id").orderBy("other")
    few = near.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= most).drop("k")
    return few.join(symbols_.select(F.col("sym_id").alias("other"), F.col("name").alias("other_name")), "other").select("sym_id", "other", "other_name")


def importers(symbols_: DataFrame, imports: DataFrame, name: str, most: int = 20) -> DataFrame:
    """sym_id and the files that import the file of a symbol."""
    mine = find_symbol(symbols_, name).select("sym_id", "file_id")
    near = imports.join(mine, F.col("to_id") == F.col("file_id")).select("sym_id", "from_id")
    place = Window.partitionBy("sym_id").orderBy("from_id")
    return near.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= most).drop("k")


def neighbourhood(symbols_: DataFrame, edges: DataFrame, imports: DataFrame, name: str, most: int = 50) -> DataFrame:
    """One row for each symbol of a name: its attributes, what it calls, what calls it and
    who imports its file, as comma-separated lists."""

    def listed(frame: DataFrame, column: str, out: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column))), lambda s: s[column].cast("string")), ",")
        return frame.groupBy("sym_id").agg(joined.alias(out))

    out = find_symbol(symbols_, name)
    for frame, column, to in (
        (neighbours(symbols_, edges, name, True, most), "other", "calls"),
        (neighbours(symbols_, edges, name, False, most), "other", "called_by"),
        (importers(symbols_, imports, name), "from_id", "imported_by"),
    ):
        out = out.join(listed(frame, column, to), "sym_id", "left").withColumn(to, F.coalesce(to, F.lit("")))
    return out


def suggest(symbols_: DataFrame, part: str, most: int = 6) -> DataFrame:
    """Names that hold a text in any letter case; the first by order."""
    return symbols_.filter(F.contains(F.lower("name"), F.lower(F.lit(part)))).select("name").distinct().orderBy("name").limit(most)


def clues(hits: DataFrame, symbols_: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """Search hits with the symbols of their blocks and names around these."""
    inside = hits.select("block_id", "occurrences").join(symbols_, "block_id", "left")
    names = symbols_.select(F.col("sym_id").alias("_n"), F.col("name").alias("_name"))

    def around(a: str, b: str, out: str) -> DataFrame:
        near = edges.join(inside.select("sym_id").distinct(), F.col(a) == F.col("sym_id")).select("sym_id", F.col(b).alias("_n"))
        few = near.withColumn("k", F.row_number().over(Window.partitionBy("sym_id").orderBy("_n"))).filter(F.col("k") <= most)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "_name"))), lambda s: s["_name"]), ",")
        return few.join(names, "_n").groupBy("sym_id").agg(joined.alias(out))

    out = inside.join(around("src", "dst", "calls"), "sym_id", "left").join(around("dst", "src", "called_by"), "sym_id", "left")
    return out.select("block_id", "occurrences", "sym_id", "name", "kind", F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("called_by", F.lit("")).alias("called_by"))
