"""Risk-controlled quality rules, in DataFrame operations only.

A rule rejects a document when one of its statistics lies beyond a cutoff. Cutoffs are chosen per
stratum (language) from labelled holdouts: a cutoff is admissible when the exact binomial test rejects
"this cutoff wrongly rejects more than `alpha / rules` of the good documents" at level
`delta / (strata * candidates)` (Bonferroni over every test made). The strictest admissible cutoff of
each rule is used; a rule with none is idle in that stratum. By the union bound a stratum loses at most
`alpha` of its good documents, for all strata at once with confidence `1 - delta`. Good documents here are
those that pass the base rules, which are fixed and not part of the guarantee; copies of one text would not
be independent draws, so each distinct text counts once.

Nulls: a null text has no words and fails the base rules; a null language is a stratum of its own, apart from
the empty one; labels that are null or without a document are ignored. Repeated rows each get the same
verdict; labels that repeat a document count once (the highest quality stands). A value at a cutoff passes.
A very long text is worked on whole, in one row. An empty table gives no rows. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: rule -> (statistic, 1 if large values are bad else -1, candidate cutoffs from strict to lax)
RULES = {
    "symbols": ("r_symbols", 1, [0.01, 0.02, 0.05, 0.1, 0.2, 0.4]),
    "dup_lines": ("r_dup_lines", 1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "repeats": ("r_repeats", 1, [0.05, 0.1, 0.15, 0.2, 0.25]),
    "long_words": ("r_word_chars", 1, [8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "short_words": ("r_word_chars", -1, [4.0, 3.5, 3.0, 2.5, 2.0]),
}


def _covered(windows: Column, size: int) -> Column:
    """Words inside windows (by hash, in order) that occur at least twice: first the positions, then the union's length."""
    return F.aggregate(
        F.zip_with(windows, F.concat(F.slice(windows, 2, F.size(windows)), F.array(F.element_at(windows, -1) + size)), lambda a, b: F.least(F.lit(size), b - a)),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the word, symbol, line and repetition counts of every whole text; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.cast("string").alias("t"))
    d = d.select("doc_id", "lang", "t", F.xxhash64("t").alias("text_key"), F.array_remove(F.split("t", SPACE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", "lang", "text_key", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("t", SYMBOLS)) - 1).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    for half in (1, 2, 4):  # hashes of 2, 4, then 8 words from each position on
        d = d.withColumn("h", F.zip_with("h", F.slice("h", half + 1, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("win", F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))).drop("h")
    d = d.withColumn("pairs", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))))).drop("win")
    same = lambda i, j: F.get("pairs", i)["x"] == F.get("pairs", j)["x"]
    again = F.filter(F.transform(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get("pairs", i)["i"])), lambda x: x.isNotNull())
    d = d.withColumn("again", F.when(F.col("pairs").isNotNull(), F.sort_array(again))).drop("pairs")
    return d.select("doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("again").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("again"), WINDOW)).alias("n_repeat_words"))


def ratios(stats: DataFrame) -> DataFrame:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return stats.withColumns({
        "stratum": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "r_symbols": over("n_symbols", "word_chars"), "r_dup_lines": over("n_dup_lines", "n_lines"),
        "r_repeats": over("n_repeat_words", "n_words"), "r_word_chars": over("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed term by term in logarithms; 1 where k exceeds n * rate (no use to a test)."""
    import math

    odds = math.log(rate) - math.log1p(-rate)
    first = n * math.log1p(-rate)
    plus = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    step = lambda s, i: F.struct((s["t"] + F.log((n - i + 1) / i) + odds).alias("t"), plus(s["s"], s["t"] + F.log((n - i + 1) / i) + odds).alias("s"))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), step, lambda s: s["s"])))


def cutoffs(rated: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row per stratum with the chosen cutoff of each rule (null: the rule is idle there)."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    stats = sorted({stat for stat, _, _ in RULES.values()})
    held = rated.where(~F.col("base_failed")).join(good, "doc_id").groupBy("stratum", "text_key").agg(*(F.first(x).alias(x) for x in stats))
    tests = [(rule, stat, sign, cut) for rule, (stat, sign, cuts) in RULES.items() for cut in cuts]
    beyond = lambda stat, sign, cut: F.col(stat) > cut if sign > 0 else F.col(stat) < cut
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count(F.when(beyond(*t[1:]), 1)).alias(f"k{i}") for i, t in enumerate(tests)))
    strata = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    level = F.lit(delta) / (F.col("strata") * len(tests))
    passed = lambda i: binomial_tail(F.col("n"), F.col(f"k{i}"), alpha / len(RULES)) <= level
    chosen = [F.coalesce(*(F.when(passed(i), F.lit(t[3])) for i, t in enumerate(tests) if t[0] == rule)).alias(f"cut_{rule}") for rule in RULES]
    return counts.join(F.broadcast(strata)).select("stratum", "n", *chosen)  # strata: a single row


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the statistics that the rules use, for every document."""
    rated = ratios(materialise(statistics(docs)))
    # a table of its own, a row per stratum: its known size lets it be broadcast, so that a common stratum is not one task
    rules = materialise(cutoffs(rated, labels, alpha, delta))
    fails = F.lit(False)
    for rule, (stat, sign, _) in RULES.items():
        fails = fails | F.coalesce(F.col(stat) > F.col(f"cut_{rule}") if sign > 0 else F.col(stat) < F.col(f"cut_{rule}"), F.lit(False))
    return rated.join(rules.drop("n"), "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~fails).alias("kept")
    )
