"""Argument lists, shell words, quoting and configuration values."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One piece of an argument: a plain character, an escaped one, or a quoted run.
PIECE = r"""(?s)[^ \t\n"'\\]|\\.|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
_ARGUMENT = r"""(?s)(?:[^ \t\n"'\\]|\\.|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')+"""


def unclosed(text: Column) -> Column:
    """What is wrong with an argument list: trailing_escape, single_quote or double_quote; null if nothing is."""
    rest = F.regexp_replace(text, r"""(?s)^(?:[^"'\\]|\\.|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')*""", "")
    return F.when(rest == "", F.lit(None).cast("string")).when(rest.rlike(r"""(?s)^["']?(?:[^\\]|\\.)*\\$"""), "trailing_escape").when(rest.startswith("'"), "single_quote").otherwise("double_quote")


def arguments(text: Column) -> Column:
    """The words of an argument list, without their quotes and escapes; null if a quote or an escape stays open."""
    piece = lambda p: F.when(p.rlike("""^["'].*["']$""") & (F.length(p) > 1), F.substr(p, F.lit(2), F.length(p) - 2)).otherwise(p)
    bare = lambda p: F.regexp_replace(piece(p), r"(?s)\\(.)", "$1")
    words = F.transform(F.regexp_extract_all(text, F.lit(_ARGUMENT), F.lit(0)), lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(PIECE), F.lit(0)), bare), ""))
    return F.when(unclosed(text).isNull(), words)


class LineContext:
    """A command line up to the cursor: the finished words, the one being typed, whether a space ends the line, and the open quote."""

    def __init__(self, text: str):
        self.words: list[str] = []
        self.current, self.spaced, self.quote = "", True, ""
        started = escaped = False
        for c in text:
            if escaped:
                self.current, escaped = self.current + c, False
            elif c == "\\":
                escaped = started = True
            elif self.quote:
                if c == self.quote:
                    self.quote = ""
                else:
                    self.current += c
            elif c in " \t\n":
                if started:
                    self.words.append(self.current)
                self.current, started, self.spaced = "", False, True
                continue
            elif c in "\"'" and not started:
                self.quote, started = c, True
            else:
                self.current, started = self.current + c, True
            self.spaced = False


def shell_words(text: str) -> list[str]:
    """The words of a command line; an open quote ends with the line."""
    line = LineContext(text)
    return line.words + ([line.current] if line.current else [])


def single_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def double_quoted(text: Column) -> Column:
    """In double quotes, with what a shell would expand escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'([\\"$`])', r"\\$1"), F.lit('"'))


def substitute(command: Column, values: list[tuple[str, Column, str, bool]]) -> Column:
    """A command with each `@{name}` replaced by its value, null as empty. values: name, value, quotes (single, double or none), whether double quotes are escaped first."""
    for name, value, quotes, escape in values:
        value = F.coalesce(value, F.lit(""))
        value = F.replace(value, F.lit('"'), F.lit('\\"')) if escape else value
        command = F.replace(command, F.lit("@{" + name + "}"), {"single": single_quoted, "double": double_quoted, "none": lambda v: v}[quotes](value))
    return command


def snake_upper(name: Column) -> Column:
    """`maxItems2` as MAX_ITEMS_2: words part at case and digit boundaries, and at what is neither letter nor digit."""
    parted = F.regexp_replace(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])", "_"), r"[^\p{L}\p{N}]+", "_")
    return F.upper(F.regexp_replace(parted, "^_+", ""))


def truth(text: Column) -> Column:
    """true or false of the usual words, null of others."""
    word = F.lower(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False)


def stable_json(value: Any) -> str:
    """JSON with the keys of all objects in order."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _stable(text: str | None) -> str | None:
    try:
        return None if text is None else stable_json(json.loads(text))
    except ValueError:
        return None


def stable_stringify(text: Column) -> Column:
    """A JSON text with its keys in order, by an Arrow-batched function; null if it is no JSON."""
    return F.udf(_stable, "string", useArrow=True)(text)


def deep_merge(base: Any, over: Any) -> Any:
    """Objects merged key by key, all else replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: deep_merge(base[k], v) if k in base else v for k, v in over.items()}
    return over
