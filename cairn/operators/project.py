"""The shape of a project: package manifests, components, their modules and options, and package environments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import glob_regex


def package_entries(lines: DataFrame) -> DataFrame:
    """(file, entry) of the `packages:` section of project files: on its line or on indented lines after it, up to the next field. lines: (file, line, text); comments and commas go."""
    text = F.regexp_replace("text", r"--.*$", "")
    field = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9-]*)\s*:", 1)
    w = Window.partitionBy("file").orderBy("line")
    section = F.last(F.when(field != "", F.lower(field)).when(text.rlike(r"^\S"), ""), True).over(w)
    own = lines.withColumns({"_in": section, "_t": F.when(field != "", F.regexp_replace(text, r"^[^:]*:", "")).otherwise(text)}).where("_in = 'packages'")
    return own.select("file", F.explode(F.split("_t", r"[\s,]+")).alias("entry")).where("entry <> ''").distinct()


def package_roots(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """(entry, manifest): the manifests that entries name, directly, by directory, or by pattern. entries: (entry); manifests: (path).

    Entries are a project file's few lines, so each becomes a pattern.
    """
    found = []
    for (entry,) in entries.select("entry").distinct().collect():
        bare = entry.removeprefix("./").rstrip("/") or "."
        whole = bare if bare.endswith(".cabal") else "*.cabal" if bare == "." else f"{bare}/*.cabal"
        found.append(manifests.where(F.col("path").rlike(glob_regex(whole, path=True))).select(F.lit(entry).alias("entry"), F.col("path").alias("manifest")))
    out = found[0] if found else manifests.limit(0).select(F.lit("").alias("entry"), F.col("path").alias("manifest"))
    for f in found[1:]:
        out = out.union(f)
    return out


def component_plan(components: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Options that all components share, and (module, component, option) of the others that a module's components add.

    components: (component, option), null for a component without any; modules: (module, component).
    """
    n = components.agg(F.countDistinct("component").alias("n"))
    common = components.where("option is not null").groupBy("option").agg(F.countDistinct("component").alias("k")).join(F.broadcast(n)).where("k = n").select("option")  # n: a single row
    own = components.where("option is not null").join(common, "option", "left_anti")
    return common, modules.join(own, "component").select("module", "component", "option").distinct()


def loaded_modules(expected: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(module, kinds, entry) of modules that were loaded, and the (component, module) that were not. expected: (component, kind, module, main); loaded: (module)."""
    got = expected.join(loaded.distinct(), "module").groupBy("module").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.bool_or("main").alias("entry"))
    return got, expected.join(loaded, "module", "left_anti").select("component", "module")


def resolve_environment(dependencies: DataFrame, selected: DataFrame, index: DataFrame) -> DataFrame:
    """(package, status, units) of each dependency: the selected units, else the only unit of its name; missing or ambiguous otherwise. dependencies: (package); selected, index: (package, unit)."""
    units = lambda rows, name: rows.groupBy("package").agg(F.array_sort(F.collect_set("unit")).alias(name))
    j = dependencies.select("package").distinct().join(units(selected, "chosen"), "package", "left").join(units(index, "known"), "package", "left")
    status = F.when(F.col("chosen").isNotNull(), "resolved").when(F.col("known").isNull(), "missing").when(F.size("known") == 1, "resolved").otherwise("ambiguous")
    return j.select("package", status.alias("status"), F.coalesce("chosen", "known", F.array().cast("array<string>")).alias("units"))


def environment_key(resolved: DataFrame, databases: list[str]) -> DataFrame:
    """(key): one row that names a resolved environment, whatever the order of its parts."""
    parts = resolved.where("status = 'resolved'").select(F.explode("units").alias("u")).agg(F.array_sort(F.collect_set("u")).alias("units"))
    return parts.select(F.md5(F.concat_ws("\n", F.array_sort(F.array(*map(F.lit, databases)).cast("array<string>")), "units")).alias("key"))


def discover(packages: DataFrame, components: DataFrame) -> DataFrame:
    """(manifest, package, components) in order of manifest. packages: (manifest, package); components: (package, component)."""
    own = components.groupBy("package").agg(F.array_sort(F.collect_set("component")).alias("components"))
    return packages.join(own, "package", "left").select("manifest", "package", F.coalesce("components", F.array().cast("array<string>")).alias("components")).orderBy("manifest")
