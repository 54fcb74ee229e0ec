"""References: owners of occurrences, the reference index, pages of references and slices of source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sets import page
from .spans import contained

#: Fixed value: references on a page.
PAGE = 15


def catalog(names: DataFrame, declarations: DataFrame) -> DataFrame:
    """(name, def_id): the first declaration, by seq, around each name. names: (file, name, s, e); declarations: (file, def_id, seq, s, e)."""
    d = declarations.select("file", F.struct("seq", "def_id").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"))
    return contained(names.withColumnRenamed("name", "i"), d).groupBy("i").agg(F.min("o")["def_id"].alias("def_id")).withColumnRenamed("i", "name")


def occurrence_owners(occurrences: DataFrame, members: DataFrame, root_names: DataFrame) -> DataFrame:
    """(i, owners): whom an occurrence within a definition belongs to.

    occurrences: (def_id, i, s, e, parent); members: (def_id, name, s, e); root_names: (def_id, name). The narrowest
    members around it own it, of these only the parent if it is among them; without such members the parent if it is
    a root name, else all root names.
    """
    m = members.select("def_id", F.col("name").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"))
    around = contained(occurrences.select("def_id", "i", "s", "e"), m, by="def_id")
    near = around.groupBy("i", (F.col("oe") - F.col("os")).alias("size")).agg(F.collect_set("o").alias("near")).groupBy("i").agg(F.min_by("near", "size").alias("near"))
    r = root_names.groupBy("def_id").agg(F.collect_set("name").alias("roots"))
    j = occurrences.join(near, "i", "left").join(r, "def_id", "left")
    only = F.array("parent")
    owners = F.when(F.col("near").isNotNull(), F.when(F.array_contains("near", F.col("parent")), only).otherwise(F.col("near"))).when(F.array_contains("roots", F.col("parent")), only).otherwise(F.col("roots"))
    return j.select("i", F.array_sort(owners).alias("owners"))


def reference_index(occurrences: DataFrame) -> DataFrame:
    """Distinct (name, def_id, s, e) of followable occurrences: not the definition's own name, with a module, and not defined within the definition.

    occurrences: (def_id, own, name, module, s, e, defined), `defined` for names that the definition's span itself defines; it may be missing.
    """
    inside = F.coalesce(F.col("defined"), F.lit(False)) if "defined" in occurrences.columns else F.lit(False)
    return occurrences.where("module is not null and not (name <=> own)").where(~inside).select("name", "def_id", "s", "e").distinct()


def find_references(targets: DataFrame, index: DataFrame, order: list, skip: int = 0, limit: int | None = PAGE) -> tuple[DataFrame, dict | None]:
    """A page of the references to any target name, in a total order. targets: (name); index: (name, ...)."""
    return page(index.join(targets.select("name").distinct(), "name", "left_semi"), order, skip, limit)


def slices(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, text): the lines of merged ranges, `...` between ranges. lines: (file, line, text); ranges: (file, s, e), disjoint."""
    r = ranges.select("file", F.explode(F.sequence("s", "e")).alias("line"), "s")
    kept = lines.join(r, ["file", "line"])
    gap = F.lag("s").over(Window.partitionBy("file").orderBy("line")) != F.col("s")
    shown = kept.withColumn("text", F.when(gap, F.concat(F.lit("...\n"), "text")).otherwise(F.col("text")))
    return shown.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t")).select("file", F.array_join("t.text", "\n").alias("text"))
