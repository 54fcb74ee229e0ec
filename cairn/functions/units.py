"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quotient(value: Column, digits: int, unit: str) -> Column:
    """By the value itself with ties to the even digit, as printf in SQL (format_string sends them up); below 1e14, which no quotient of bytes reaches."""
    return F.concat(F.call_function("format_number", value.cast("double"), F.lit(f"0.{'0' * digits}")), F.lit(unit))


def _shown(value: Column, digits: int, unit: str) -> Column:
    """By the shortest digits of the value, so 2.675 is a tie, with ties to the even digit, as the reference does; plain for zeros and what no decimal holds."""
    value = value.cast("double")
    text = F.call_function("format_number", F.nullif(value, F.lit(0.0)).try_cast("decimal(38,18)"), F.lit(f"0.{'0' * digits}"))
    return F.concat(F.coalesce(text, F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))), F.lit(unit))


def mebibytes(n: Column) -> Column:
    return _quotient(n / 1048576.0, 2, " MiB")


def signed_mebibytes(n: Column) -> Column:
    return F.concat(F.when(n < 0, "-").otherwise("+"), mebibytes(F.abs(n)))


def bytes_text(n: Column) -> Column:
    """Bytes in the largest unit that they fill."""
    return F.when(n >= 1 << 30, _quotient(n / float(1 << 30), 2, "GiB")).when(n >= 1 << 20, _quotient(n / float(1 << 20), 2, "MiB")).when(n >= 1 << 10, _quotient(n / 1024.0, 2, "KiB")).otherwise(F.concat(n.cast("long").cast("string"), F.lit("B")))


def percent_text(share: Column) -> Column:
    return _shown(share * 100, 1, "%")


def seconds_text(seconds: Column) -> Column:
    return _shown(seconds, 2, "s")
