"""Event-sourced sessions: folding, recovery ranges, snapshots and usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimate_tokens, utf16_length


def fold_sessions(events: DataFrame) -> DataFrame:
    """(session, epoch, snapshot, n_completed): the last snapshot since the last reset and the completions so far.

    events: (session, seq, kind, payload); kinds snapshot, reset, completed; a reset or a completion clears the
    snapshot. A session is folded by aggregates: the greatest clearing seq, then the last snapshot after it.
    """
    cleared = events.groupBy("session").agg(F.max(F.when(F.col("kind").isin("reset", "completed"), F.col("seq"))).alias("cleared"), F.count_if(F.col("kind") == "completed").alias("n_completed"), F.count_if(F.col("kind") == "reset").alias("epoch"))
    after = events.join(cleared, "session").where("kind = 'snapshot' and (cleared is null or seq > cleared)").groupBy("session").agg(F.max_by("payload", "seq").alias("snapshot"))
    return cleared.join(after, "session", "left").select("session", "epoch", "n_completed", "snapshot")


def plan_ranges(ranges: DataFrame) -> DataFrame:
    """Accepted recoveries: first of each id by completion, by start, dropping what overlaps the last accepted one. ranges: (session, id, s, e, completed)."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        once = pdf.sort_values(["completed", "id"]).drop_duplicates("id").sort_values(["s", "e", "id"])
        keep, reach = [], None
        for s, e in zip(once.s, once.e, strict=True):
            keep.append(reach is None or s > reach)
            reach = e if keep[-1] else reach
        return once[keep]

    return ranges.groupBy("session").applyInPandas(greedy, ranges.schema)


def mask(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """entries (session, seq, ...) with `masked`: whether a range [s, e] of its session covers it; ranges do not overlap."""
    marks = ranges.select("session", F.col("s").alias("seq"), F.col("e").alias("until"), F.lit(0).alias("_entry"))
    both = entries.withColumns({"until": F.lit(None).cast(marks.schema["until"].dataType), "_entry": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("session").orderBy("seq", "_entry").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_reach", F.last("until", True).over(w)).where("_entry = 1").withColumn("masked", F.coalesce(F.col("seq") <= F.col("_reach"), F.lit(False))).drop("until", "_entry", "_reach")


def usage(entries: DataFrame, calls: DataFrame, ranges: DataFrame) -> DataFrame:
    """Calls and tokens per tool, kept and summarised. entries: (session, seq, call_id, tool, text); calls: (call_id, name)."""
    named = entries.join(calls, "call_id", "left").withColumn("name", F.coalesce("tool", "name")).where("name is not null")
    m = mask(named, ranges).withColumn("t", estimate_tokens(F.col("text")))
    cell = lambda c, v: F.sum(F.when(F.col("masked") == c, v).otherwise(0))
    return m.groupBy("name").agg(cell(False, F.lit(1)).alias("calls"), cell(False, F.col("t")).alias("tokens"), cell(True, F.lit(1)).alias("summarised_calls"), cell(True, F.col("t")).alias("summarised_tokens")).orderBy(F.desc(F.col("tokens") + F.col("summarised_tokens")), "name")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, deleted or modified, by hash. Both sides: (path, hash)."""
    j = old.withColumnRenamed("hash", "h0").join(new.withColumnRenamed("hash", "h1"), "path", "full_outer")
    return j.where(~F.col("h0").eqNullSafe(F.col("h1"))).select("path", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").otherwise("modified").alias("change"))


def normalise_snapshot(values):
    return F.array_sort(F.array_distinct(values))


def entry_text(text: Column, content: Column) -> Column:
    """An entry's text, else its content: a JSON string as it is, the texts of a list's parts in lines, otherwise empty."""
    parts = F.from_json(content, "array<string>")
    piece = F.transform(parts, lambda p: F.when(p.startswith("{") & F.get_json_object(p, "$").isNotNull(), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
    listed = F.array_join(F.filter(piece, lambda p: p != ""), "\n")
    return F.coalesce(text, F.when(content.startswith("["), listed).when(content.startswith('"'), F.from_json(F.concat(F.lit('{"t":'), content, F.lit("}")), "t string")["t"]), F.lit(""))


def recovery_ranges(entries: DataFrame, completed: DataFrame) -> DataFrame:
    """(session, id, s, e, completed): what each completed recovery replaces, from its start to just before its final call.

    entries: (session, seq, entry_id, call_id, is_result); completed: (session, id, start_entry, start_call, final_call,
    completed). The start is the first entry with the starting call, else the starting entry; recoveries without a start,
    without the final result at or after it, or with nothing between are left out.
    """
    first = lambda key, name, kept: entries.where(kept).groupBy("session", F.col(key).alias(name)).agg(F.min("seq").alias("_" + name))
    j = completed.join(first("call_id", "start_call", "call_id is not null"), ["session", "start_call"], "left").join(first("entry_id", "start_entry", "entry_id is not null"), ["session", "start_entry"], "left")
    j = j.join(first("call_id", "final_call", "call_id is not null and not is_result"), ["session", "final_call"], "left")
    result = entries.where("is_result").groupBy("session", F.col("call_id").alias("final_call")).agg(F.min("seq").alias("_result"))
    j = j.join(result, ["session", "final_call"], "left").withColumn("s", F.coalesce("_start_call", "_start_entry"))
    stop = F.when(F.col("_final_call") <= F.col("_result"), F.col("_final_call")).otherwise(F.col("_result"))
    return j.withColumn("e", stop - 1).where("s is not null and _result >= s and e >= s").select("session", "id", "s", "e", "completed")


def recovery_totals(recoveries: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row: recoveries (session, id, original, replacement tokens), once per id, and how many have no range."""
    once = recoveries.dropDuplicates(["session", "id"]).join(ranges.select("session", "id", F.lit(1).alias("_found")), ["session", "id"], "left")
    return once.agg(F.count("*").alias("recoveries"), F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("replacement"), F.lit(0)).alias("replacement"), F.count_if(F.col("_found").isNull()).alias("missing"))


def recovery_tokens(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """(session, id, original, replacement): estimated tokens of what a recovery replaces, its entries parted by blank lines, and of what stands for it.

    entries: (session, seq, text); ranges: (session, id, s, e, replacement), which do not overlap. Lengths are summed, so no text is gathered.
    """
    size = utf16_length(F.coalesce(F.col("text"), F.lit("")))
    inside = entries.join(ranges.select("session", "id", "s", "e"), "session").where("seq between s and e")
    total = inside.groupBy("session", "id").agg(F.sum(size + 2).alias("n"))
    j = ranges.join(total, ["session", "id"], "left")
    return j.select("session", "id", F.ceil(F.greatest(F.coalesce("n", F.lit(0)) - 2, F.lit(0)) / 4.0).alias("original"), estimate_tokens(F.coalesce("replacement", F.lit(""))).alias("replacement"))


def obligations(outcomes: DataFrame, compilation: bool = True, tests: bool = True) -> DataFrame:
    """(session, compilation_pending, tests_pending) after all outcomes (session, seq, tool, success): a failed reload or test is pending till it succeeds, and a passed test settles both."""
    reload, test, ok = F.col("tool") == "reloadHomeModules", F.col("tool") == "runTestSuite", F.col("success")
    last = lambda on, value: F.max_by(F.when(on, value), F.when(on, F.col("seq")))
    per = outcomes.groupBy("session").agg(last(reload | (test & ok), ~ok & reload).alias("c"), last(test, ~ok).alias("t"))
    return per.select("session", (F.coalesce("c", F.lit(False)) & F.lit(compilation)).alias("compilation_pending"), (F.coalesce("t", F.lit(False)) & F.lit(tests)).alias("tests_pending"))


def recovery_state(outcomes: DataFrame) -> DataFrame:
    """(session, state): inactive without a failure, active while an obligation is pending, readyToFinalize once all are settled."""
    failed = outcomes.groupBy("session").agg(F.bool_or(~F.col("success")).alias("failed"))
    j = failed.join(obligations(outcomes), "session")
    return j.select("session", F.when(~F.col("failed"), "inactive").when(F.col("compilation_pending") | F.col("tests_pending"), "active").otherwise("readyToFinalize").alias("state"))


def line_changes(patch: Column) -> Column:
    """struct(additions, deletions) of a patch; headers of files are neither."""
    lines = F.filter(F.split(patch, "\n"), lambda x: ~x.startswith("+++") & ~x.startswith("---"))
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign)))
    return F.struct(count("+").alias("additions"), count("-").alias("deletions"))


def excerpt(patch: Column, most: int) -> Column:
    """A patch, or its first characters and a note."""
    return F.when(F.length(patch) <= max(0, most), patch).otherwise(F.concat(F.left(patch, F.lit(max(0, most))), F.lit("\n\n[Patch excerpt truncated. Full patch retained in recovery artifacts.]")))


def call_names(messages: DataFrame) -> DataFrame:
    """(call_id, name) of the tool calls in assistants' contents, however deep; the first of an id by seq. messages: (seq, role, content), JSON."""
    call = "array<struct<type:string,id:string,toolCallId:string,name:string,toolName:string,content:string>>"
    level = messages.where("role = 'assistant'").select("seq", F.col("content").alias("c"))
    found = None
    for _ in range(4):  # contents within contents
        parts = level.select("seq", F.explode(F.from_json("c", call)).alias("p"))
        own = parts.select("seq", F.coalesce("p.id", "p.toolCallId").alias("call_id"), F.coalesce("p.name", "p.toolName").alias("name")).where("call_id is not null and name is not null")
        found = own if found is None else found.union(own)
        level = parts.select("seq", F.col("p.content").alias("c")).where("startswith(c, '[')")
    return found.groupBy("call_id").agg(F.min_by("name", F.struct("seq", "name")).alias("name"))


def manifest_problems(assets: DataFrame) -> DataFrame:
    """(version, platform, arch, libc) that a manifest lists more than once, or with a part missing."""
    keys = ["version", "platform", "arch", "libc"]
    return assets.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*keys).union(assets.where(" or ".join(f"{k} is null or {k} = ''" for k in keys)).select(*keys)).distinct()


def find_asset(assets: DataFrame, version: str, platform: str, arch: str, libc: str) -> DataFrame:
    return assets.where((F.col("version") == version) & (F.col("platform") == platform) & (F.col("arch") == arch) & (F.col("libc") == libc)).limit(1)
