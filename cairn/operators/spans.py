"""Source spans: containment, narrowest owners, nesting, and coalescing of line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def span_size(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    return (end_line - start_line) * 10_000 + (end_col - start_col)


#: Block sizes of containment joins, from `block` on, each so many times the last, and their number.
STEP, LEVELS = 16, 6


def contained(inner: DataFrame, outer: DataFrame, by: str = "file", block: int = 64) -> DataFrame:
    """inner (by, i, s, e) joined to the outer spans (by, o, os, oe) of its file that contain it.

    An outer span is listed under the blocks that it touches of the smallest size it does not outgrow `STEP` times, so
    under few whatever its length; an inner one under the block of its start at each size that outer spans have. The
    join is by (file, size, block), and a large file is spread.
    """
    sizes = F.array(*(F.lit(block * STEP**k).cast("long") for k in range(LEVELS)))
    fits = F.filter(sizes, lambda x: F.col("oe") - F.col("os") < x * STEP)
    o = outer.withColumn("size", F.coalesce(F.get(fits, F.lit(0)), F.lit(block * STEP ** (LEVELS - 1)).cast("long")))
    o = o.withColumn("block", F.explode(F.sequence(F.floor(F.col("os") / F.col("size")), F.floor(F.col("oe") / F.col("size")))))
    return inner.withColumn("size", F.explode(sizes)).withColumn("block", F.floor(F.col("s") / F.col("size"))).join(o, [by, "size", "block"]).where("os <= s and e <= oe").drop("block", "size")


def narrowest(pairs: DataFrame) -> DataFrame:
    """The smallest of the containing spans of each (by, i); ties by the outer's name."""
    return pairs.groupBy("i").agg(F.min(F.struct((F.col("oe") - F.col("os")).alias("size"), F.col("o").alias("o")))["o"].alias("o"))


def nest(regions: DataFrame) -> DataFrame:
    """(file, id, s, e) -> parent: the smallest region of the file that strictly contains it, or null."""
    inner = regions.select("file", F.struct("file", "id").alias("i"), "s", "e")
    pairs = contained(inner, regions.select("file", F.col("id").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"))).where("oe - os > e - s")
    return inner.join(narrowest(pairs), "i", "left").select("file", F.col("i.id").alias("id"), F.col("o").alias("parent"))


def coalesce_ranges(ranges: DataFrame, by: str, gap: int = 2, block: int = 1 << 16) -> DataFrame:
    """(by, s, e): ranges merged when the next begins at most `gap` after the last one's end.

    Ranges are merged within the block of their start first, so that a file with very many is dealt to many tasks; what
    those leave is merged in one.
    """

    def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("s", "e")
        reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach + gap), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
        return marked.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")

    own = merged(ranges.withColumn("_block", F.floor(F.col("s") / block)), [by, "_block"]).drop("_block")
    return merged(own, [by]).select(by, "s", "e")


def neighbours(lines: DataFrame) -> DataFrame:
    """(file, line, text) with the closest non-blank lines before and after."""
    w = Window.partitionBy("file").orderBy("line")
    some = F.when(F.trim("text") != "", F.col("line"))
    return lines.withColumns({"before": F.last(some, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first(some, True).over(w.rowsBetween(1, Window.unboundedFollowing))})


def definition_order(rows: DataFrame) -> DataFrame:
    """Definitions at their least depth, modules by the sum of 2 ** max(0, 30 - 5 * depth), then source order. rows: (def_id, module, line, depth)."""
    least = rows.groupBy("def_id", "module", "line").agg(F.min("depth").alias("depth"))
    score = F.sum(F.pow(F.lit(2.0), F.greatest(F.lit(0), 30 - 5 * F.col("depth"))).cast("long")).over(Window.partitionBy("module"))
    return least.withColumn("module_score", score).orderBy(F.desc("module_score"), "module", "line", "def_id")
