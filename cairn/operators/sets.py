"""Set algebra over keyed rows: division, common and inherited settings, first-occurrence distinct, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mention_all(mentions: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Keys that occur with every wanted value: relational division by a filtered distinct count."""
    return mentions.where(F.col(value).isin(wanted)).groupBy(key).agg(F.countDistinct(value).alias("_met")).where(F.col("_met") == len(set(wanted))).select(key)


def common_settings(settings: DataFrame, by: list[str], part: str, value: str) -> DataFrame:
    """Values that every part of a group has. settings: (by..., part, value)."""
    n = settings.groupBy(*by).agg(F.countDistinct(part).alias("_all")) if by else settings.agg(F.countDistinct(part).alias("_all"))
    k = settings.groupBy(*by, value).agg(F.countDistinct(part).alias("_met"))
    return (k.join(n, by) if by else k.join(F.broadcast(n))).where("_met = _all").select(*by, value)  # n is a single row without `by`


def own_settings(settings: DataFrame, inherited: DataFrame, keys: list[str]) -> DataFrame:
    """Settings that the level above does not already give."""
    return settings.join(inherited, keys, "left_anti")


def first_occurrence(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def page(rows: DataFrame, order: list, skip: int = 0, limit: int | None = None) -> tuple[DataFrame, dict | None]:
    """A page of ordered rows and its total, skipped, shown and consumed counts; no page at all for empty input."""
    total = rows.count()
    if not total:
        return rows.limit(0), None
    skip = min(max(0, skip), total)
    shown = total - skip if limit is None else min(max(0, limit), total - skip)
    return rows.orderBy(*order).offset(skip).limit(shown), {"total": total, "skipped": skip, "shown": shown, "consumed": skip + shown}


def page_summary(meta: dict | None) -> str:
    if meta is None:
        return "Nothing to show."
    if meta["shown"] == meta["total"]:
        return f"Showing all {meta['total']}."
    rest = meta["total"] - meta["consumed"]
    return f"Showing {meta['shown']} of {meta['total']}" + (f"; {rest} more from skip={meta['consumed']}." if rest else ".")


def adjacent_groups(rows: DataFrame, partition: Column | str, order: list, key: str) -> DataFrame:
    """Runs of neighbouring rows with one key: (partition, run, key, n)."""
    w = Window.partitionBy(partition).orderBy(*order)
    marked = rows.withColumn("_new", F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(partition, "run", key).agg(F.count("*").alias("n"))


def head_and_tail(rows: DataFrame, by: str, order: list, back: list, threshold: int = 20, keep: int = 3) -> DataFrame:
    """All rows of small groups; of groups with at least `threshold` rows the first and last `keep`."""
    up, down = (F.row_number().over(Window.partitionBy(by).orderBy(*o)) for o in (order, back))
    marked = rows.withColumns({"_a": up, "_z": down, "_n": F.count("*").over(Window.partitionBy(by))})
    return marked.where((F.col("_n") < threshold) | (F.col("_a") <= keep) | (F.col("_z") <= keep)).drop("_a", "_z", "_n")
