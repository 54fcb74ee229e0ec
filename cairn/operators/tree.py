"""Directory trees from flat paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, is_ancestor_or_self, is_hidden


def roll_up(paths: DataFrame) -> DataFrame:
    """(dir, ext, files) for every directory above the files: each path counts in all its ancestors."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return paths.select(F.explode(up).alias("dir"), F.coalesce(extension(F.col("path")), F.lit("")).alias("ext")).groupBy("dir", "ext").agg(F.count("*").alias("files"))


def visible(paths: DataFrame, ignored: list[str]) -> DataFrame:
    """Paths without hidden segments and outside ignored directories: a bare name matches any segment, a path its prefix."""
    names, prefixes = [i.strip("/") for i in ignored if "/" not in i.strip("/")], [i.strip("/") for i in ignored if "/" in i.strip("/")]
    keep = ~is_hidden(F.col("path"))
    if names:
        keep &= ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, names)))
    for p in prefixes:
        keep &= ~((F.col("path") == p) | F.col("path").startswith(p + "/"))
    return paths.where(keep)


def ignored_directories(lines: DataFrame) -> DataFrame:
    """Directory patterns of an ignore file: blank, comment, negated and wild-card lines are skipped, outer slashes go."""
    x = F.trim("line")
    return lines.where((x != "") & ~x.rlike(r"^[#!]") & ~x.rlike(r"[*?\[]")).select(F.regexp_replace(x, "^/+|/+$", "").alias("pattern")).where("pattern <> ''").distinct()


def plan_tree(entries: DataFrame, depth: int | None, budget: int) -> DataFrame:
    """Entries (path, is_dir) shown: breadth first, directories first within a directory, up to `depth` levels below the root and `budget` entries."""
    level = F.size(F.split("path", "/"))
    shown = entries.withColumn("depth", level)
    if depth is not None:
        shown = shown.where(F.col("depth") <= depth + 1)
    return shown.orderBy("depth", F.regexp_replace("path", "[^/]+$", ""), F.desc("is_dir"), F.lower("path"), "path").limit(max(0, budget))


def collapse_chains(directories: DataFrame) -> DataFrame:
    """(top, bottom): maximal chains of directories with one child each, shown as one entry. directories: (path, children)."""
    from .graph import components_of

    only = directories.where("children = 1").select(F.col("path").alias("src"))
    child = directories.select(F.col("path").alias("dst"), F.regexp_replace("path", "/[^/]+$", "").alias("src"))
    links = child.join(only, "src").where("src <> dst")
    both = links.select("src", "dst").union(links.select(F.col("dst"), F.col("src")))
    of = components_of(both, directories.select(F.col("path").alias("node")))
    return of.groupBy("component").agg(F.min_by("node", F.length("node")).alias("top"), F.max_by("node", F.length("node")).alias("bottom")).select("top", "bottom")


#: Names of directories that are opened first, in this order.
OPEN_FIRST = ["src", "app", "lib", "migrations", "migration", "database", "db", "schema", "sql", "test", "tests", "spec", "bench", "examples", "scripts", "config"]


def related(path: Column, focus: list[str]) -> Column:
    """Whether a path lies on the way to, or below, one of the paths in focus."""
    out = F.lit(False)
    for f in focus:
        out = out | is_ancestor_or_self(path, F.lit(f)) | is_ancestor_or_self(F.lit(f), path)
    return out


def open_priority(entries: DataFrame, focus: list[str]) -> DataFrame:
    """Entries (path, is_dir) with the key that they are opened by: focus, known names, their order; files last."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rank = F.array_position(F.array(*map(F.lit, OPEN_FIRST)), name)
    focused = related(F.col("path"), [f for f in focus if f != "."])
    last = (1 << 31) - 1
    key = F.when(F.col("is_dir"), F.struct(F.when(focused, 0).otherwise(1).alias("focus"), F.when(rank > 0, 1).otherwise(2).alias("category"), F.when(rank > 0, rank - 1).otherwise(last).cast("long").alias("name")))
    return entries.withColumn("key", F.coalesce(key, F.struct(F.lit(4).alias("focus"), F.lit(4).alias("category"), F.lit(last).cast("long").alias("name"))))


def should_open(path: Column, ignored: Column, focus: list[str]) -> Column:
    """Whether a directory is opened: the root, what is in focus, else what is neither hidden nor ignored and, with a focus, related to it."""
    named = path.isin(*focus) if focus else F.lit(False)
    near = related(path, focus) if focus else F.lit(True)
    return (path == ".") | named | (~is_hidden(path) & ~ignored & near)


def omissions(entries: DataFrame, shown: DataFrame) -> DataFrame:
    """(dir, directories, files) left out of each directory. entries: (path, is_dir); shown: (path)."""
    left = entries.join(shown.select("path"), "path", "left_anti")
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]+$", "")).otherwise(".")
    return left.groupBy(parent.alias("dir")).agg(F.count_if("is_dir").alias("directories"), F.count_if(~F.col("is_dir")).alias("files"))
