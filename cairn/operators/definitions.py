"""Definitions: indexes over modules, dependencies, contexts of references, and the definitions shown for a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bfs
from .sets import page
from .spans import coalesce_ranges, contained

#: Definitions on a page, the depth of a recursive request, and the lines that a context may have to be shown whole.
PAGE, RECURSIVE_DEPTH, CONTEXT_LINES = 30, 2, 10


def index_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values) of keys for which the modules' indexes disagree."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def merge_indexes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the modules' indexes together; conflicting values are an error."""
    bad = index_conflicts(rows, key, value).limit(5).collect()
    if bad:
        raise ValueError(f"conflicting values of {key}: {[r[0] for r in bad]}")
    return rows.select(key, value).distinct()


def dependencies(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) of the targets (node) alone."""
    return edges.join(targets.select(F.col("node").alias("src")).distinct(), "src", "left_semi")


def resolve_names(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Names with the definitions of the project that they stand for; names from elsewhere are dropped. names: (..., name); catalog: (name, def_id)."""
    return names.join(catalog, "name")


def owner_dependencies(owned: DataFrame, instances: DataFrame, root_names: DataFrame) -> DataFrame:
    """(def_id, binder, target): what each owner uses, by occurrence or instance; a definition's root names have all that any of its owners has.

    owned, instances: (def_id, binder, target); root_names: (def_id, name).
    """
    used = owned.unionByName(instances).distinct()
    every = used.select("def_id", "target").distinct().join(root_names.select("def_id", F.col("name").alias("binder")), "def_id")
    return used.unionByName(every.select(used.columns)).distinct()


def occurrence_facts(occurrences: DataFrame, spans: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct (def_id, name, s, e) of occurrences within a declaration's or signature's span, without the names it defines. occurrences: (file, name, s, e); spans: (file, def_id, s, e); own: (def_id, name)."""
    inner = occurrences.select("file", F.struct("name", "s", "e").alias("i"), "s", "e")
    hit = contained(inner, spans.select("file", F.col("def_id").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe")))
    facts = hit.select(F.col("o").alias("def_id"), F.col("i.name").alias("name"), "s", "e").distinct()
    return facts.join(own, ["def_id", "name"], "left_anti")


def modules_to_search(names: DataFrame, module_index: DataFrame) -> DataFrame:
    """Modules in which a name occurs at all; only these are searched exactly. module_index: (name, module)."""
    return module_index.join(names.select("name").distinct(), "name", "left_semi").select("module").distinct()


def matches_by_definition(names: DataFrame, index: DataFrame) -> DataFrame:
    """(def_id, hits): each definition with where it mentions any of the names, in order. index: (name, def_id, s, e)."""
    hits = index.join(names.select("name").distinct(), "name", "left_semi")
    return hits.groupBy("def_id").agg(F.array_sort(F.collect_set(F.struct("s", "e", "name"))).alias("hits"))


def root_chain(chains: DataFrame, occ: str, aliases: DataFrame) -> DataFrame:
    """Names of a symbol's chain to its root that are called `occ`, then those with such an alias, each once. chains: (symbol, place, name, occ); aliases: (name, alias)."""
    known = aliases.where(F.col("alias") == occ).select("name").distinct().withColumn("alias", F.lit(True))
    hit = chains.join(known, "name", "left").withColumn("by", F.when(F.col("occ") == occ, 0).when(F.col("alias"), 1)).where("by is not null")
    return hit.groupBy("symbol", "name").agg(F.min(F.struct("by", "place")).alias("k")).select("symbol", "name", F.col("k.by").alias("by"), F.col("k.place").alias("place"))


def best_context(references: DataFrame, regions: DataFrame) -> DataFrame:
    """(ref, region): the region that shows a reference best. references: (file, ref, s, e); regions: (file, region, s, e, lines, kind).

    Of the regions around it, other than itself, calls and records of several lines come first, the larger ones before the
    smaller; of the others the smaller do.
    """
    inner = references.select("file", F.col("ref").alias("i"), "s", "e")
    around = contained(inner, regions.select("file", F.struct("region", "lines", "kind").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"))).where("os <> s or oe <> e")
    wide = (F.col("o.lines") > 1) & F.col("o.kind").isin("application", "record")
    size = F.col("oe") - F.col("os")
    key = F.struct(F.when(wide, 0).otherwise(1).alias("a"), F.when(wide, -size).otherwise(size).alias("b"), F.col("o.kind").alias("c"), F.col("o.region").alias("region"))
    return around.groupBy("i").agg(F.min(key)["region"].alias("region")).withColumnRenamed("i", "ref")


def snippet_ranges(references: DataFrame, sizes: DataFrame, verbosity: str = "low") -> DataFrame:
    """(def_id, s, e): the lines of each definition that are shown. references: (def_id, rs, re, cs, ce), lines of a reference and its context, or null; sizes: (def_id, lines).

    low: the context where it has at most `CONTEXT_LINES`, else the reference; medium adds the first two lines and the
    last; high the first three, the last, and both context and reference. Ranges at most two lines apart are one.
    """
    has = F.col("cs").isNotNull()
    compact = has & (F.col("ce") - F.col("cs") + 1 <= CONTEXT_LINES)
    pick = lambda s, e: references.select("def_id", s.cast("long").alias("s"), e.cast("long").alias("e")).where("s is not null")
    closest = pick(F.when(compact | F.col("rs").isNull(), F.col("cs")).otherwise(F.col("rs")), F.when(compact | F.col("rs").isNull(), F.col("ce")).otherwise(F.col("re")))
    edge = lambda n: sizes.join(references.select("def_id").distinct(), "def_id").select("def_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("s"), F.least(F.lit(n), "lines").cast("long").alias("e")), F.struct(F.col("lines").cast("long").alias("s"), F.col("lines").cast("long").alias("e")))).alias("x")).select("def_id", "x.s", "x.e")
    shown = {"low": lambda: closest, "medium": lambda: closest.union(edge(2)), "high": lambda: pick(F.col("cs"), F.col("ce")).union(pick(F.col("rs"), F.col("re"))).union(edge(3))}[verbosity]()
    return coalesce_ranges(shown, "def_id", 2)


def expand(roots: DataFrame, edges: DataFrame, mode: str = "none") -> DataFrame:
    """(node, depth) of requested definitions and of what they use: none, direct, recursive (two levels) or all."""
    return bfs(roots, edges, {"none": 0, "direct": 1, "recursive": RECURSIVE_DEPTH, "all": None}[mode])


def get_definitions(roots: DataFrame, edges: DataFrame, sources: DataFrame, mode: str = "none", skip: int = 0, limit: int | None = PAGE, most: int | None = None) -> tuple[DataFrame, dict | None]:
    """A page of the definitions requested and used, modules with the most of the near ones first, then in source order; `most` cuts a recursive request before that.

    roots: (node); edges: (src, dst); sources: (node, module, file, line, col).
    """
    shown = expand(roots, edges, mode).join(sources, "node")
    score = shown.groupBy("module").agg(F.sum(F.pow(F.lit(2.0), F.greatest(F.lit(0), 30 - 5 * F.col("depth"))).cast("long")).alias("module_score"))
    rows = shown.join(score, "module").select("node", "depth", "module", "module_score", "file", "line", "col")
    order = [F.desc("module_score"), "module", *(F.col(c).asc_nulls_last() for c in ("file", "line", "col")), "node"]
    if most is not None and mode in ("recursive", "all"):
        rows = rows.orderBy(*order).limit(most)
    return page(rows, order, skip, limit)


def merge_slices(slices: DataFrame) -> DataFrame:
    """(request, module, slices) of requests whose slices are all of one module; sorted, each span once. slices: (request, module, s, e)."""
    one = slices.groupBy("request").agg(F.countDistinct("module").alias("n"), F.min("module").alias("module"), F.array_sort(F.collect_set(F.struct("s", "e"))).alias("slices"))
    return one.where("n = 1").select("request", "module", "slices")
