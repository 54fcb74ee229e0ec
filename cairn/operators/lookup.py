"""Finding symbols by name: lookup keys, hints, roots, preferred modules, exports and component options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialise

#: What a module's role adds to its penalty among the modules that offer a symbol.
ROLE_PENALTY = {"home": -400, "prelude": -300, "defining": -200, "exported": -100, "internal": 100, "compiler": 50}
#: Kinds of components by preference when their options for a module conflict.
KIND_RANK = {"library": 0, "internal library": 0, "executable": 1, "benchmark": 1, "test": 2}


def lookup_keys(symbols: DataFrame) -> DataFrame:
    """One row per key of a symbol: its aliases, or its own name when it has none. symbols: (symbol, module, occ, exported_from, aliases)."""
    keys = F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.col("aliases")).otherwise(F.array("occ"))
    return symbols.withColumn("key", F.explode(F.array_distinct(keys)))


def matching(keys: DataFrame, occ: str, module: str | None = None, owner: str | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Symbols under a key; a module hint must define or export them, an owner hint name one of their ancestors. owners: (symbol, owner)."""
    found = keys.where(F.col("key") == occ)
    if module is not None:
        found = found.where((F.col("module") == module) | F.coalesce(F.array_contains("exported_from", module), F.lit(False)))
    if owner is not None:
        found = found.join(owners.where(F.col("owner") == owner), "symbol", "left_semi")
    return found


def completions(names: DataFrame, prefix: str) -> DataFrame:
    """Distinct names with a prefix, in order; a literal prefix reaches the scan."""
    return names.where(F.col("name").startswith(prefix)).select("name").distinct().orderBy("name")


def roots(nodes: DataFrame, parents: DataFrame, most: int = 64) -> DataFrame:
    """(node, root, steps): the last node of each parent chain. nodes: (node), parents: (node, parent), one parent at most.

    A round moves every unfinished chain up one step, so rounds number as the longest chain; a chain longer than
    `most` is a cycle and raises.
    """
    up = parents.select(F.col("node").alias("root"), "parent")
    at, done = nodes.select("node", F.col("node").alias("root")), None
    for steps in range(most):
        moved = materialise(at.join(up, "root", "left"))
        end = moved.where("parent is null").select("node", "root", F.lit(steps).alias("steps"))
        done = end if done is None else done.union(end)
        at = moved.where("parent is not null").select("node", F.col("parent").alias("root"))
        if at.isEmpty():
            return done
    raise ValueError(f"parent chains longer than {most}")


def module_penalty(module: Column, home: Column, prelude: Column, defining: Column, exported: Column) -> Column:
    roles = {"home": home, "prelude": prelude, "defining": defining & exported, "exported": exported, "internal": module.contains(".Internal"), "compiler": module.startswith("GHC.")}
    return sum((F.when(is_, ROLE_PENALTY[r]).otherwise(0) for r, is_ in roles.items()), F.lit(0))


def preferred_modules(candidates: DataFrame, prelude: str = "Prelude") -> DataFrame:
    """(root, module): the module of least penalty, then fewest name parts, then name. candidates: (root, module, home, defining, exported)."""
    m, exported = F.col("module"), F.col("exported")
    key = F.struct(module_penalty(m, F.col("home"), (m == prelude) & exported, F.col("defining"), exported).alias("penalty"), F.size(F.split(m, r"\.")).alias("depth"), m.alias("module"))
    return candidates.groupBy("root").agg(F.min(key)["module"].alias("module"))


def shortest_modules(candidates: DataFrame) -> DataFrame:
    """(root, module): the shortest name, then the first."""
    return candidates.groupBy("root").agg(F.min(F.struct(F.length("module"), F.col("module").alias("module")))["module"].alias("module"))


def nearest_per_root(matches: DataFrame) -> DataFrame:
    """(root, symbol, steps): of the matches that share a root, the one closest to it."""
    best = matches.groupBy("root").agg(F.min(F.struct("steps", "symbol")).alias("b"))
    return best.select("root", "b.symbol", "b.steps")


def exports(nodes: DataFrame, hinted: bool = False) -> DataFrame:
    """(module, root, children): what a module exports, children in order of name.

    nodes: (module, root, child, root_hit, child_hit), a null child for roots without any. With a type hint a root stays
    if it or a child mentions the type, and only children that do are listed.
    """
    child = F.when(F.col("child_hit"), F.col("child")) if hinted else F.col("child")
    listed = nodes.groupBy("module", "root").agg(F.array_sort(F.collect_set(child)).alias("children"), F.bool_or(F.coalesce("root_hit", F.lit(False))).alias("hit"))
    return (listed.where("hit or size(children) > 0") if hinted else listed).drop("hit")


def direct_instances(instances: DataFrame, kind: str, name: str) -> DataFrame:
    """Instances of a class, of a family, or with a type in their head, once each. instances: (instance, cls, family, heads)."""
    head = F.array_contains("heads", name)
    fits = {"class": F.col("cls") == name, "family": (F.col("family") == name) | head}.get(kind, head)
    return instances.where(fits).dropDuplicates(["instance"])


def merge_options(rows: DataFrame) -> DataFrame:
    """(module, component, kind, options, conflict): the component whose options a shared module gets.

    rows: (module, seq, component, kind, options). Components come in order of seq; equal options keep the earlier one;
    against a test the other wins; else the better kind does and the conflict is reported. The rows of one module are
    its components, so the fold is over a short array.
    """
    rank = F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv))
    held = rows.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("seq", "component", "kind", "options", rank[F.col("kind")].alias("rank"), F.lit(False).alias("conflict")))).alias("c"))

    def step(a: Column, b: Column) -> Column:
        test = (a["kind"] == "test") | (b["kind"] == "test")
        clash = ~a["options"].eqNullSafe(b["options"]) & ~test
        take = ~a["options"].eqNullSafe(b["options"]) & (b["rank"] < a["rank"])
        pick = lambda f: F.when(take, b[f]).otherwise(a[f]).alias(f)
        return F.struct(*(pick(f) for f in ("seq", "component", "kind", "options", "rank")), (a["conflict"] | clash).alias("conflict"))

    won = F.aggregate(F.slice("c", 2, F.size("c")), F.col("c")[0], step)
    return held.select("module", won.alias("w")).select("module", "w.component", "w.kind", "w.options", "w.conflict")


def associated_instances(mentions: DataFrame, name: str) -> DataFrame:
    """Instances that mention a name, once each by their own name. mentions: (instance, name)."""
    return mentions.where(F.col("name") == name).select("instance").distinct()


def index_modules(start: DataFrame, orphans: DataFrame) -> DataFrame:
    """Modules and the orphan modules that they need, to the end. start: (node); orphans: (src, dst)."""
    from .graph import bfs

    return bfs(start, orphans).select("node")


def symbol_info(matches: DataFrame, skip: int = 0, limit: int | None = None) -> tuple[DataFrame, dict | None]:
    """A page of exact matches, of those with one root the closest to it, by root. matches: (root, symbol, steps)."""
    from .sets import page

    return page(nearest_per_root(matches), ["root"], skip, limit)


def resolve_all(found: DataFrame, hints: int = 5) -> DataFrame:
    """(query, status, root, hints): all queries resolve, or none does: a query with no root is missing, with several ambiguous and gets their names as hints.

    found: (query, root), a null root for queries without any.
    """
    per = found.groupBy("query").agg(F.countDistinct("root").alias("n"), F.min("root").alias("root"), F.array_sort(F.collect_set("root")).alias("roots"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    bad = per.agg(F.bool_or(F.col("n") != 1).alias("bad"))  # a single row
    return per.join(F.broadcast(bad)).select("query", status.alias("status"), F.when(~F.col("bad"), F.col("root")).alias("root"), F.when(F.col("n") > 1, F.slice("roots", 1, hints)).otherwise(F.array().cast("array<string>")).alias("hints"))
