"""Lines and paths of compiler timing dumps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units in the order in which they are tried, and what they stand for.
SECONDS = {"milliseconds": 0.001, "millisecond": 0.001, "ms": 0.001, "seconds": 1.0, "second": 1.0, "s": 1.0}
TAGGED_SECONDS = {"ms": 0.001, "s": 1.0}
BYTES = {"bytes": 1.0, "byte": 1.0, "b": 1.0, "kilobytes": 1024.0, "kb": 1024.0, "megabytes": 1024.0**2, "mb": 1024.0**2, "gigabytes": 1024.0**3, "gb": 1024.0**3}
#: What surrounds a token, and a number that may hold commas.
EDGES = r"^[\s,();]+|[\s,();]+$"
NUMBER = r"^-?[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?$"


def _words(line: Column) -> Column:
    words = F.filter(F.split(F.lower(line), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(w, EDGES, ""))


def _number(text: Column) -> Column:
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def _tagged(words: Column, tag: str, units: dict[str, float], bare: float) -> Column:
    """The number of the first word that begins with a tag: before its unit, or as it is."""
    token = F.get(F.filter(words, lambda w: w.startswith(tag)), F.lit(0))
    token = F.regexp_replace(F.substring(token, len(tag) + 1, 1 << 20), EDGES, "")
    return F.coalesce(*(F.when(token.endswith(u), _number(F.left(token, F.length(token) - len(u))) * k) for u, k in units.items()), _number(token) * bare)


def _before_unit(words: Column, units: dict[str, float]) -> Column:
    """The first number that has a unit as the next word."""
    factor = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: _number(F.get(words, i - 1)) * F.try_element_at(factor, F.get(words, i)))
    return F.get(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0))


def line_seconds(line: Column) -> Column:
    """Seconds of a line: after `time=` or `elapsed=` (a bare number is milliseconds), else the number before a unit; null without any."""
    w = _words(line)
    return F.coalesce(_tagged(w, "time=", TAGGED_SECONDS, 0.001), _tagged(w, "elapsed=", TAGGED_SECONDS, 0.001), _before_unit(w, SECONDS))


def line_bytes(line: Column) -> Column:
    """Bytes of a line: after `alloc=` or `allocated=`, else the number before a unit; powers of 1024, floored."""
    w = _words(line)
    return F.floor(F.coalesce(_tagged(w, "alloc=", BYTES, 1.0), _tagged(w, "allocated=", BYTES, 1.0), _before_unit(w, BYTES)))


def bracket_module(line: Column) -> Column:
    """The text in the first bracket if it may be a module's name, else null."""
    inner = F.regexp_extract(line, r"^[^\[]*\[([^\]]*)", 1)
    return F.when(inner.rlike(r"^[\p{L}\p{N}_.']+$") & inner.rlike(r"[^0-9]"), inner)


def _stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"\.(dump-timings|timings)$"), F.regexp_replace(name, r"\.(dump-timings|timings)$", "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def path_module(path: Column) -> Column:
    return F.regexp_replace(_stem(path), r"\.(dyn|p)$", "")


def path_variant(path: Column) -> Column:
    return F.when(_stem(path).endswith(".dyn"), "dyn").when(_stem(path).endswith(".p"), "profiling").otherwise("normal")


def is_timing_dump(path: Column) -> Column:
    return path.rlike(r"\.(dump-timings|timings)$")
