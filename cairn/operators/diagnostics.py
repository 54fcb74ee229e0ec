"""Diagnostics, edits, timings and test outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import compact_diagnostic, redundant_import
from ..functions.timing import bracket_module, is_timing_dump, line_bytes, line_seconds, path_module, path_variant
from .sets import page
from .spans import contained

MESSAGE_LENGTH = 700


def grouped(diagnostics: DataFrame) -> DataFrame:
    """(seq, file, message) with the rank of its file's first appearance and the compacted, cut message."""
    first = diagnostics.groupBy("file").agg(F.min("seq").alias("first"))
    ranked = diagnostics.join(first, "file")
    return ranked.select("file", "first", "seq", F.left(compact_diagnostic(F.col("message")), F.lit(MESSAGE_LENGTH)).alias("message")).orderBy("first", "seq")


def latest_per_variant(samples: DataFrame, module: str = "module", variant: str = "variant") -> DataFrame:
    """Seconds and bytes per module: the newest sample of each variant (ties: more seconds), summed over variants."""
    last = samples.groupBy(module, variant).agg(F.max_by(F.struct("seconds", "bytes"), F.struct("modified", "seconds")).alias("s"))
    return last.groupBy(module).agg(F.sum("s.seconds").alias("seconds"), F.sum("s.bytes").alias("bytes"), F.count("*").alias("variants"))


def timing_samples(lines: DataFrame) -> DataFrame:
    """Timing-dump lines (path, modified, line_no, line) -> one sample per dump; those whose totals are both zero go. The first plausible bracket names the module, else the path does."""
    name = F.min(F.when(bracket_module(F.col("line")).isNotNull(), F.struct("line_no", bracket_module(F.col("line")).alias("name"))))["name"]
    total = lambda f, zero: F.sum(F.coalesce(f(F.col("line")), F.lit(zero)))
    per = lines.where(is_timing_dump(F.col("path"))).groupBy("path", "modified").agg(name.alias("named"), total(line_seconds, 0.0).alias("seconds"), total(line_bytes, 0).alias("bytes"))
    return per.where("seconds > 0 or bytes > 0").select(F.coalesce("named", path_module(F.col("path"))).alias("module"), path_variant(F.col("path")).alias("variant"), "modified", "seconds", "bytes", "path")


def compile_metrics(lines: DataFrame) -> DataFrame:
    """(module, seconds, bytes, variants, paths): the newest dump of each variant, summed over variants."""
    last = timing_samples(lines).groupBy("module", "variant").agg(F.max_by(F.struct("seconds", "bytes", "path"), F.struct("modified", "seconds", "path")).alias("s"))
    return last.groupBy("module").agg(F.sum("s.seconds").alias("seconds"), F.sum("s.bytes").alias("bytes"), F.count("*").alias("variants"), F.array_sort(F.collect_list("s.path")).alias("paths"))


def test_summary(outcomes: DataFrame) -> DataFrame:
    """One row from (status): totals and the overall verdict."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    t = outcomes.agg(F.count("*").alias("total"), is_("passed").alias("passed"), is_("setup_failed").alias("setup_failed"), is_("failed").alias("failed"))
    return t.withColumn("verdict", F.when(F.col("total") == 0, "no tests").when(F.col("passed") < F.col("total"), "failed").otherwise("passed"))


def redundant_imports(diagnostics: DataFrame) -> DataFrame:
    """Unused-import diagnostics with a real span: whole imports to delete, else the unused names."""
    d = diagnostics.where("flag = 'unused-imports' and sl is not null").withColumn("r", redundant_import(F.col("message"))).where("r is not null")
    return d.select("file", "sl", "el", F.col("r.issue").alias("issue"), F.transform("r.names", lambda x: x["name"]).alias("names"))


def conflicting_edits(edits: DataFrame) -> DataFrame:
    """Distinct edits (file, s, e, text) that neither overlap another nor share its span; every party of a conflict goes."""
    keys = ["file", "s", "e"]
    alone = edits.distinct().withColumn("_same", F.count("*").over(Window.partitionBy(*keys)))
    w = Window.partitionBy("file").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = alone.withColumns({"_r": reach, "_n": F.lead("s").over(w)})
    return marked.where("_same = 1 and (_r is null or _r <= s) and (_n is null or _n >= e)").drop("_r", "_n", "_same")


def reload_status(loaded: int, failed: int) -> str:
    return "empty" if not loaded + failed else "loaded" if not failed else "failed" if not loaded else "partial"


def retry_until_stable(attempt, most: int = 3):
    """Call attempt() until it reports success, repeats a signature, or has been retried `most` times; attempt returns (ok, signature)."""
    seen, tries = set(), 0
    while True:
        ok, signature = attempt()
        if ok or signature in seen or tries >= most:
            return ok, tries
        seen.add(signature)
        tries += 1


def resolve_imports(issues: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions per import and warnings per issue.

    issues: (issue_id, file, sl, el, issue, names) with issue whole or names; imports: (import_id, file, s, e, kind) with kind
    open, hiding or explicit. An issue must lie in exactly one import; a whole-import issue deletes it and beats removals,
    which are united; names can be removed from explicit lists alone.
    """
    i = issues.select("file", F.col("issue_id").alias("i"), F.col("sl").alias("s"), F.col("el").alias("e"))
    o = imports.select("file", F.struct("import_id", "kind").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"))
    one = contained(i, o).groupBy("i").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    j = issues.join(one, issues["issue_id"] == one["i"], "left")
    warning = F.when(F.col("n").isNull(), "no import").when(F.col("n") > 1, "several imports").when((F.col("issue") == "names") & (F.col("o.kind") != "explicit"), F.concat("o.kind", F.lit(" import")))
    j = j.withColumn("warning", warning)
    good = j.where("warning is null").groupBy("o.import_id").agg(F.bool_or(F.col("issue") == "whole").alias("whole"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    actions = good.select("import_id", F.when(F.col("whole"), "delete").otherwise("remove").alias("action"), F.when(~F.col("whole"), F.col("names")).alias("names"))
    return actions, j.where("warning is not null").select("issue_id", "warning")


def valid_edits(texts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits that can be made, and (file, s, e, warning) of the others: invalid, stale or conflict. An edit with `expected` is stale where the text differs from it."""
    expected = F.col("expected") if "expected" in edits.columns else F.lit(None).cast("string")
    j = edits.withColumn("expected", expected).dropDuplicates(["file", "s", "e", "text", "expected"]).join(texts.select("file", F.col("text").alias("_text")), "file", "left")
    fit = F.col("_text").isNotNull() & (F.col("s") >= 0) & (F.col("s") <= F.col("e")) & (F.col("e") <= F.length("_text"))
    now = F.substr("_text", F.col("s") + 1, F.col("e") - F.col("s"))
    j = j.withColumn("warning", F.when(~fit, "invalid").when(F.col("expected").isNotNull() & (now != F.col("expected")), "stale")).drop("_text")
    good = j.where("warning is null").drop("warning")
    kept = conflicting_edits(good).drop("expected")
    clash = good.join(kept.select("file", "s", "e"), ["file", "s", "e"], "left_anti").withColumn("warning", F.lit("conflict"))
    return kept, j.where("warning is not null").unionByName(clash).select("file", "s", "e", "warning")


def apply_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, text) after edits (file, s, e, text) of character offsets [s, e), last first; edits that clash, are stale or invalid are left out."""
    todo = valid_edits(texts, edits)[0].groupBy("file").agg(F.sort_array(F.collect_list(F.struct("s", "e", F.col("text").alias("put"))), asc=False).alias("edits"))
    put = lambda t, x: F.concat(F.substring(t, F.lit(1), x["s"]), x["put"], F.substring(t, x["e"] + 1, F.length(t)))
    none = F.array().cast("array<struct<s:int,e:int,put:string>>")
    return texts.join(todo, "file", "left").select("file", F.aggregate(F.coalesce(F.col("edits").cast("array<struct<s:int,e:int,put:string>>"), none), F.col("text"), put).alias("text"))


def diagnostics_page(diagnostics: DataFrame, skip: int = 0, limit: int = 5) -> tuple[DataFrame, dict | None]:
    """A page of the grouped diagnostics, with how many diagnostics and files are left after it."""
    ordered = grouped(diagnostics)
    rows, meta = page(ordered, ["first", "seq"], skip, limit)
    if meta is not None:
        left = ordered.orderBy("first", "seq").offset(meta["consumed"])
        meta |= {"remaining": meta["total"] - meta["consumed"], "remaining_files": left.select("file").distinct().count()}
    return rows, meta


#: Titles of severities, the label of any other, and the hints on failed expressions with the words that call for them.
SEVERITY = {"error": "Error", "warning": "Warning", "info": "Info"}
HINTS = [
    ("block", [["parse error"], [" where"]]),
    ("import", [["parse error on input `import'"]]),
    ("annotate", [["Ambiguous type variable"], ["Couldn't match expected type"], ["Couldn't match type"]]),
    ("monad", [["Ambiguous type variable", "Monad"], ["Ambiguous type variable", "IO"], ["Ambiguous type variable", "m0"], ["Could not deduce", "Monad"]]),
    ("show", [["No instance for (Show"]]),
    ("shadow", [["Multiple declarations of"], ["Conflicting definitions for"], ["already in scope"]]),
    ("rename", [["record field"], ["selector"], ["already in scope"]]),
]


def severity_title(severity: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(severity)), F.lit("Diagnostic"))


def execution_hints(messages: Column) -> Column:
    """Names of the hints, in order, that any message of an array calls for."""
    any_ = lambda calls: F.exists(messages, lambda m: F.reduce(F.array(*(F.reduce(F.array(*(m.contains(w) for w in words)), F.lit(True), lambda a, b: a & b) for words in calls)), F.lit(False), lambda a, b: a | b))
    return F.filter(F.array(*(F.when(any_(calls), F.lit(name)) for name, calls in HINTS)), lambda x: x.isNotNull())


def snippets(diagnostics: DataFrame, lines: DataFrame, before: int = 2) -> DataFrame:
    """Source lines of each diagnostic, from two before its start through its end, with carets under the span. diagnostics: (seq, file, sl, sc, el, ec); lines: (file, line, text)."""
    span = diagnostics.where("sl is not null").select("seq", "file", F.explode(F.sequence(F.greatest(F.lit(1), F.col("sl") - before), "el")).alias("line"), "sl", "sc", "el", "ec")
    j = span.join(lines, ["file", "line"])
    marked = F.col("line") >= F.col("sl")
    start = F.when(F.col("line") == F.col("sl"), F.col("sc")).otherwise(F.lit(1))
    end = F.when(F.col("line") == F.col("el"), F.col("ec")).otherwise(F.length("text") + 1)
    carets = F.when(marked, F.concat(F.repeat(F.lit(" "), start - 1), F.repeat(F.lit("^"), F.greatest(F.lit(1), end - start))))
    return j.select("seq", "file", "line", marked.alias("marked"), "text", carets.alias("carets"))


def load_summary(modules: DataFrame) -> DataFrame:
    """One row from (module, loaded): totals, status and whether results are partial."""
    t = modules.groupBy("module").agg(F.bool_or("loaded").alias("loaded")).agg(F.count_if("loaded").alias("loaded"), F.count_if(~F.col("loaded")).alias("failed"))
    status = F.when(F.col("loaded") + F.col("failed") == 0, "empty").when(F.col("failed") == 0, "loaded").when(F.col("loaded") == 0, "failed").otherwise("partial")
    return t.select("loaded", "failed", (F.col("loaded") + F.col("failed")).alias("total"), status.alias("status"), (F.col("failed") > 0).alias("partial"))
