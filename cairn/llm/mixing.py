"""Mixing sources to target weights by temperature.

A source's share p of all tokens is raised to an exponent and renormalised: w_s ~ p_s ** exponent. The
exponent is bisected in [0, 1]: the largest one at which the mixture's entropy reaches `entropy` (a share of
the largest possible, log of the number of sources), raised further if a source would be repeated more
than `repeats` times within the budget. The weights are realised as budgeted block permutations: a
source's documents are put in a pseudo-random order; its budget is spent on whole passes over that order,
then on the order's head until the budget is used up. Only sums over all sources reach the driver, however many
sources there are; order and budget are resolved with hash blocks, so no source is sorted in one task.

Defaults: the budget is the number of tokens there are; a document's tokens are its white-space words. A budget
that needs more than `repeats` passes over everything is an error.
Nulls: a null text has no tokens; a null source is a source of its own; documents without tokens cost
nothing and come along in every pass. Rows with equal doc_id are drawn together, and so are ties in the order.
A very long text is one draw like any other. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, finished, materialise

ENTROPY, REPEATS, BLOCKS = 0.97, 4.0, 1024
#: Exponents tried at once, and rounds of that.
STEPS, ROUNDS = 15, 10


def tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def solve(sizes: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> tuple[float, float, float]:
    """The exponent, the total of tokens and the sum of share ** exponent. sizes: n, the tokens of each source, all positive.

    Bisection by `STEPS` exponents at once: each round is one aggregate over the sources, which stay where they are.
    """
    total, count, least = sizes.agg(F.sum("n"), F.count("*"), F.min("n")).first()
    if not count:
        return 1.0, 0.0, 1.0
    budget = float(total) if budget is None else float(budget)
    if budget > repeats * total * (1 + 1e-12):
        raise ValueError(f"a budget of {budget} tokens repeats sources of {total} tokens more than {repeats} times")
    p, goal = F.col("n") / float(total), entropy * math.log(count)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """Sum of p ** e, and entropy of the weights, for each e."""
        got = sizes.agg(*(x for i, e in enumerate(exponents) for x in (F.sum(F.pow(p, F.lit(e))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(e)) * F.ln(p)).alias(f"y{i}")))).first()
        return [(got[f"z{i}"], math.log(got[f"z{i}"]) - e * got[f"y{i}"] / got[f"z{i}"]) for i, e in enumerate(exponents)]

    def between(low: float, high: float, holds: Callable[[float, float, float], bool]) -> tuple[float, float]:
        """Neighbouring exponents at the first of which a property holds, and at the second no more; it holds up to some exponent."""
        for _ in range(ROUNDS):
            tried = [low, *(low + (high - low) * (i + 1) / (STEPS + 1) for i in range(STEPS)), high]
            turn = next((i for i, (e, (z, h)) in enumerate(zip(tried[1:-1], sums(tried[1:-1]), strict=True), 1) if not holds(e, z, h)), STEPS + 1)
            low, high = tried[turn - 1], tried[turn]
        return low, high

    # a source of share p is repeated budget / total * p ** (e - 1) / z times, the smallest one most
    most = lambda e, z: budget / total * (least / total) ** (e - 1) / z
    (z, h) = sums([1.0])[0]
    exponent = 1.0 if h >= goal else between(0.0, 1.0, lambda e, z, h: h >= goal)[0]
    z = sums([exponent])[0][0]
    if most(exponent, z) > repeats * (1 + 1e-12):  # at 1 every source is repeated budget / total times
        exponent = between(exponent, 1.0, lambda e, z, h: most(e, z) > repeats * (1 + 1e-12))[1]
        z = sums([exponent])[0][0]
    return exponent, float(total), z


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """The documents with their source's name, their place in its order and their block of that."""
    order = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)))
    d = docs.withColumns({"_s": F.coalesce(F.col("source").cast("string"), F.lit("\u0000")), "_h": order})
    return d.withColumns({"_block": F.pmod(F.shiftrightunsigned("_h", 20), F.lit(BLOCKS)).cast("int"), "_n": tokens(F.col("text").cast("string"))})


def _plan(counted: DataFrame, budget: float | None, entropy: float, repeats: float) -> DataFrame:
    """A row per source: weight, whole passes, and the block in which its budget ends, with what comes before it. counted: (_s, _block, n)."""
    by_source = materialise(counted.groupBy("_s").agg(F.sum("n").alias("size")).where("size > 0"))
    exponent, total, z = solve(by_source.select(F.col("size").alias("n")), budget, entropy, repeats)
    budget = total if budget is None else float(budget)
    weight = F.pow(F.col("size") / F.lit(total), F.lit(exponent)) / F.lit(z)
    spent = by_source.withColumn("weight", weight).withColumn("_t", F.floor(F.col("weight") * F.lit(budget)).cast("long"))
    spent = spent.select("_s", "weight", F.expr("_t div size").alias("passes"), F.pmod("_t", "size").alias("rest"))
    before = Window.partitionBy("_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # at most BLOCKS rows a source
    blocks = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(spent, "_s")
    return finished(blocks.where("before <= rest and rest < before + n").select("_s", "weight", "passes", "rest", F.col("_block").alias("edge"), "before"), by_source)


def _drawn(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with the weight of their source and their `copies`; only those of the block where a source's budget ends are put in order."""
    j = keyed.join(plan, "_s", "left")
    own = [c for c in keyed.columns if not c.startswith("_")]
    out = [*own, F.col("_n").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight")]
    head = F.when(F.col("_block") < F.col("edge"), 1).otherwise(0)
    whole = j.where("edge is null or _block <> edge").select(*out, (F.coalesce("passes", F.lit(1)) + head).cast("long").alias("copies"))
    within = F.sum("_n").over(Window.partitionBy("_s", "_block").orderBy("_h", "doc_id")) - F.sum("_n").over(Window.partitionBy("_s", "_block", "_h", "doc_id"))
    edge = j.where("_block = edge").withColumn("_cum", within)
    return whole.unionByName(edge.select(*out, (F.col("passes") + (F.col("before") + F.col("_cum") < F.col("rest")).cast("long")).alias("copies")))


def mix_sources(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight (of its source) and copies (times it is drawn)."""
    d = materialise(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    plan = _plan(d.groupBy("_s", "_block").agg(F.sum("_n").alias("n")), budget, entropy, repeats)
    return finished(_drawn(d, plan), d, plan)


def draw(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 11) -> DataFrame:
    """The documents themselves, each as often as it is drawn. No text is shuffled but that of the blocks where budgets end."""
    columns = docs.columns
    keyed = _keyed(docs, seed)
    counted = materialise(keyed.groupBy("_s", "_block").agg(F.sum("_n").alias("n")))
    rows = _drawn(keyed, _plan(counted, budget, entropy, repeats))
    discard(counted)
    return rows.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(columns)
