"""Delta delivery: what a client has seen is not sent again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*identity: Column, body: Column) -> Column:
    """128 bits of a definition's identity and text."""
    return F.md5(F.concat(F.concat_ws("|", *(F.coalesce(i.cast("string"), F.lit("")) for i in identity)), F.lit("\n"), F.coalesce(body, F.lit(""))))


def first_by_hash(rows: DataFrame, order: list) -> DataFrame:
    """The first row of each hash, by a total order; an aggregate, so that copies meet as one row per task."""
    first = rows.groupBy("hash").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return first.select(*(F.col("_r")[c].alias(c) for c in rows.columns))


def deliver(page: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fresh, omitted, known afterwards) of a page against a client's known hashes; only what is shown becomes known."""
    fresh = page.join(known, "hash", "left_anti")
    return fresh, page.join(known, "hash", "left_semi"), known.select("hash").union(fresh.select("hash")).distinct()


def omitted_by_module(omitted: DataFrame) -> DataFrame:
    return omitted.groupBy("module").agg(F.array_sort(F.collect_set("name")).alias("names"))
