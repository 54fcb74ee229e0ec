"""Text operators as Column expressions: everything stays in the JVM and in codegen where Spark allows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Irregular plurals and their singulars.
IRREGULAR = {
    "analyses": "analysis", "appendices": "appendix", "children": "child", "criteria": "criterion", "diagnoses": "diagnosis", "feet": "foot",
    "geese": "goose", "indices": "index", "matrices": "matrix", "men": "man", "mice": "mouse", "people": "person", "phenomena": "phenomenon",
    "radii": "radius", "syntheses": "synthesis", "teeth": "tooth", "theses": "thesis", "vertices": "vertex", "women": "woman",
    "parentheses": "parenthesis", "nuclei": "nucleus", "hypotheses": "hypothesis", "ellipses": "ellipsis",
}
#: Boundaries of words inside an identifier.
CAMEL = r"(?<=\p{Ll})(?=[\p{Lu}\p{Lt}])|(?<=[0-9])(?=[\p{L}\p{N}&&[^0-9]])|(?<=[\p{L}\p{N}&&[^0-9]])(?=[0-9])|(?<=[\p{Lu}\p{Lt}])(?=[\p{Lu}\p{Lt}]\p{Ll})"
SEPARATORS = r"[\s_\-.']+"


def tokenize(text: Column) -> Column:
    """Lower-case search tokens: chunks between separators, cut at camel-case and digit boundaries.

    A chunk without letters or digits is one token; one-character alphanumeric tokens go; if nothing is left,
    the whole lower-cased text is the token, unless it is empty.
    """
    chunks = F.filter(F.split(text, SEPARATORS), lambda c: c != "")
    tokens = F.flatten(F.transform(chunks, lambda c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.split(c, CAMEL)).otherwise(F.array(c))))
    useful = F.filter(F.transform(tokens, lambda t: F.lower(t)), lambda t: (F.length(t) >= 2) | ~t.rlike(r"[\p{L}\p{N}]"))
    return F.when(F.size(useful) > 0, useful).when(F.length(text) > 0, F.array(F.lower(text))).otherwise(F.array().cast("array<string>"))


def canonical(token: Column) -> Column:
    """The singular of a lower-case token."""
    irregular = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    n = F.length(token)
    return (
        F.when(F.try_element_at(irregular, token).isNotNull(), F.try_element_at(irregular, token)).when(n <= 3, token)
        .when((n > 4) & token.endswith("ies") & ~token.endswith("eies"), F.concat(F.left(token, n - 3), F.lit("y")))
        .when((n > 4) & token.rlike("(ch|sh|ss|x|z)es$"), F.left(token, n - 2))
        .when((n > 4) & token.endswith("s") & ~token.rlike("(ss|us|is)$"), F.left(token, n - 1)).otherwise(token)
    )


def glob_regex(pattern: str, path: bool = False) -> str:
    """An anchored regular expression for a pattern with `*` (and `?` within a path's segment)."""
    if not pattern:
        raise ValueError("an empty pattern matches nothing and is an error")
    if path:
        if re.search(r"[\[\]]", pattern):
            raise ValueError("character classes are not supported")
        return "(?s)^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern) + "$"
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def matches_glob(text: Column, pattern: str, path: bool = False) -> Column:
    return text.rlike(glob_regex(pattern, path))


def max_distance(n: Column) -> Column:
    """Edits allowed for a query token of n characters."""
    return F.when(n <= 2, 0).when(n <= 4, 1).when(n <= 6, 2).when(n <= 12, 3).otherwise(4)


def match_quality(kind: Column, distance: Column) -> Column:
    return F.when(kind == "exact", 1.0).when(kind == "canonical", 0.95).when(kind == "synonym", 0.85).otherwise(1.0 / (1.0 + distance))


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions, and swaps of neighbours left alone afterwards."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def _distance(a: str | None, b: str | None) -> int | None:
    return None if a is None or b is None else osa(a, b)


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Restricted Damerau-Levenshtein distance by an Arrow-batched function; null if either is null."""
    return F.udf(_distance, "int", useArrow=True)(a, b)


def near(a: Column, b: Column, most: Column) -> Column:
    """Whether the built-in distance allows a restricted Damerau-Levenshtein distance of `most`: a swap costs it two edits, so at most twice as many."""
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most)


def capital_penalty(name: Column, query: Column) -> Column:
    """0.6 if the first letters differ in case, 0 where either has no letter."""
    upper = lambda c: F.regexp_extract(c, r"(\p{L})", 1).rlike(r"^\p{Lu}")
    some = name.rlike(r"\p{L}") & query.rlike(r"\p{L}")
    return F.when(some & (upper(name) != upper(query)), 0.6).otherwise(0.0)


def parse_name(query: Column) -> Column:
    """struct(module, occ, owner) of `Module.Path.name@Owner`; the longest module prefix wins, parentheses around operators go."""
    owned = query.rlike("^.+@[^@]+$")
    owner, rest = F.when(owned, F.regexp_extract(query, "@([^@]+)$", 1)), F.when(owned, F.regexp_extract(query, "^(.+)@[^@]+$", 1)).otherwise(query)
    qualified = r"^((?:[A-Z]\w*'*\.)+)(.+)$"
    module = F.when(rest.rlike(qualified), F.regexp_replace(F.regexp_extract(rest, qualified, 1), r"\.$", ""))
    occ = F.when(rest.rlike(qualified), F.regexp_extract(rest, qualified, 2)).otherwise(rest)
    return F.struct(module.alias("module"), F.regexp_replace(occ, r"^\((.+)\)$", "$1").alias("occ"), owner.alias("owner"))


def compact_diagnostic(message: Column) -> Column:
    """Lines joined by spaces: blank ones dropped, bullets stripped, nothing from a context line (`In the ...`) on."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda x: F.regexp_replace(F.trim(x), "^[•*] *", "")), lambda x: x != "")
    end = F.array_position(F.transform(lines, lambda x: x.rlike("^In (the|a|an) ")), True)
    return F.array_join(F.when(end > 0, F.slice(lines, 1, (end - 1).cast("int"))).otherwise(lines), " ")


def unify_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_top_level(text: Column) -> Column:
    """Parts between the commas outside parentheses; a closing one too many changes nothing."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("depth"))

    def step(s: Column, c: Column) -> Column:
        cut = (c == ",") & (s["depth"] == 0)
        depth = F.when(c == "(", s["depth"] + 1).when(c == ")", F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        return F.struct(F.when(cut, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), F.when(cut, "").otherwise(F.concat(s["now"], c)).alias("now"), depth.alias("depth"))

    return F.aggregate(F.split(text, ""), start, step, lambda s: F.array_append(s["done"], s["now"]))


def namespace(name: Column) -> Column:
    """struct(namespace, name) of `type T` and `pattern P`; other names have no namespace."""
    kind = F.when(name.startswith("type "), "type").when(name.startswith("pattern "), "pattern")
    return F.struct(kind.alias("namespace"), F.when(kind.isNotNull(), F.trim(F.regexp_replace(name, "^(type|pattern) ", ""))).otherwise(name).alias("name"))


def redundant_import(message: Column) -> Column:
    """struct(issue, names) of a message on a redundant import: `names` with the unused ones, or `whole`; null for other messages."""
    head = r"(?s)^The (?:qualified )?import of .*?(?:\u2018([^\u2019]*)\u2019|`([^']*)')"
    quoted = F.coalesce(F.nullif(F.regexp_extract(message, head, 1), F.lit("")), F.regexp_extract(message, head, 2))
    rest = F.regexp_replace(message, head, "")
    listed = rest.rlike(r"(?s)^\s*from module .*? is redundant")
    names = F.filter(F.transform(split_top_level(quoted), lambda x: namespace(F.trim(x))), lambda x: x["name"] != "")
    whole = ~rest.rlike(r"^\s*from module ") & (rest.rlike(r"^\s*is redundant") | rest.contains(" is redundant"))
    issue = F.when(listed & (F.size(names) > 0), "names").when(whole, "whole")
    known = message.contains(" is redundant") & message.rlike(head) & issue.isNotNull()
    return F.when(known, F.struct(issue.alias("issue"), F.when(issue == "names", names).alias("names")))


def utf16_length(text: Column) -> Column:
    """Characters as UTF-16 counts them: two for each beyond the first plane."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimate_tokens(text: Column) -> Column:
    """A token for every four UTF-16 units, rounded up."""
    return F.ceil(utf16_length(text) / 4.0)


def directory_depth(path: Column) -> Column:
    return F.when(path.isin("", "."), 0).otherwise(F.size(F.split(path, "/")))


def extension(path: Column) -> Column:
    """The extension of a path's last segment, or null."""
    return F.nullif(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1), F.lit(""))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))


def is_ancestor_or_self(a: Column, b: Column) -> Column:
    return (a == ".") | (a == b) | b.startswith(F.concat(a, F.lit("/")))
