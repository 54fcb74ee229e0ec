"""Fielded symbol search: postings, document frequencies, term matching, evidence and ranking.

A symbol is a document with up to four fields; every value of a field is a token sequence of its own. All
steps are joins and aggregates over (symbol, field, seq, pos, token); only the choice of evidence for one
symbol's name variant, a dynamic program with tie-breaks, runs as a grouped Python function.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical, capital_penalty, edit_distance, match_quality, matches_glob, max_distance, near, tokenize
from ..tables import materialise

#: Fixed values of the ranking.
WEIGHTS = {"name": 1.0, "result": 0.65, "argument": 0.65, "module": 0.45}
UNMATCHED, ORDERED, SPECIFIC = 0.75, 0.5, 0.6


def doc_tokens(values: DataFrame) -> DataFrame:
    """(symbol, field, value) -> (symbol, field, value, pos, token, canon)."""
    return values.select("symbol", "field", "value", F.posexplode(tokenize(F.col("value"))).alias("pos", "token")).withColumn("canon", canonical(F.col("token")))


def field_statistics(tokens: DataFrame) -> DataFrame:
    """(field, token, canon, df, n, idf): a symbol counts once however many of its values hold the token; n counts symbols with the field."""
    df = tokens.groupBy("field", "token", "canon").agg(F.countDistinct("symbol").alias("df"))
    n = tokens.groupBy("field").agg(F.countDistinct("symbol").alias("n"))
    return df.join(n, "field").withColumn("idf", F.log2((F.col("n") + 1) / (F.col("df") + 1)) + 1)


def query_tokens(spark: SparkSession, query: str) -> DataFrame:
    """(qpos, token, canon, first): the query's tokens; `first` marks the first of equal canonical tokens."""
    q = spark.range(1).select(F.posexplode(tokenize(F.lit(query))).alias("qpos", "token")).withColumn("canon", canonical(F.col("token")))
    return q.withColumn("first", F.row_number().over(Window.partitionBy("canon").orderBy("qpos")) == 1)


def match_terms(q: DataFrame, stats: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Query spans against the vocabulary: (qpos, qlen, field, tokens, kind, quality, idf).

    Exact, else canonical, else fuzzy matches per token; every contiguous span of the query is looked up among
    the synonyms (term, target: arrays of canonical tokens), which are not followed further.
    """
    vocab = stats.select(F.col("field"), F.col("token").alias("v"), F.col("canon").alias("vc"), "idf")
    own = stats.select("field", F.col("token").alias("qt"), F.col("idf").alias("qidf"))
    asked = q.select("qpos", "token", "canon", max_distance(F.length("token")).alias("most"))
    exact = asked.join(vocab, F.col("canon") == F.col("vc")).withColumn("kind", F.when(F.col("token") == F.col("v"), "exact").otherwise("canonical")).withColumn("d", F.lit(0))
    # a query is a few words, and the vocabulary a row per distinct token; the built-in distance leaves few for the other one
    fuzzy = vocab.join(F.broadcast(asked), (F.col("canon") != F.col("vc")) & near(F.col("token"), F.col("v"), F.col("most"))).withColumn("kind", F.lit(None).cast("string"))
    fuzzy = fuzzy.withColumn("d", edit_distance("token", "v")).where("d <= most")
    hit = exact.unionByName(fuzzy)
    single = hit.join(own.withColumnRenamed("field", "f2"), (F.col("qt") == F.col("token")) & (F.col("f2") == F.col("field")), "left").select(
        "qpos", F.lit(1).alias("qlen"), "field", F.array("vc").alias("canons"), F.array("v").alias("tokens"), F.coalesce("kind", F.lit("fuzzy")).alias("kind"),
        match_quality(F.coalesce("kind", F.lit("fuzzy")), F.coalesce("d", F.lit(0))).alias("quality"),
        F.when(F.col("kind").isNotNull(), F.col("idf")).otherwise(F.least("idf", F.coalesce("qidf", F.lit(1.0)))).alias("idf"),
    )
    if synonyms is None:
        return single
    whole = q.agg(F.transform(F.array_sort(F.collect_list(F.struct("qpos", "canon"))), lambda x: x["canon"]).alias("all"))
    spans = whole.select("all", F.explode(F.sequence(F.lit(1), F.size("all"))).alias("s")).select("all", "s", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("s") + 1)).alias("l"))
    spans = spans.select((F.col("s") - 1).alias("qpos"), F.col("l").alias("qlen"), F.slice("all", F.col("s"), F.col("l")).alias("term"))
    targets = spans.join(synonyms, "term").select("qpos", "qlen", "target")
    canon = stats.groupBy("field", "canon").agg(F.min("idf").alias("idf"))
    need = targets.withColumn("canon", F.explode("target")).join(canon, "canon").groupBy("qpos", "qlen", "target", "field").agg(F.countDistinct("canon").alias("k"), F.min("idf").alias("idf"))
    qidf = q.join(stats.select("field", "token", F.col("idf").alias("qidf")), "token").groupBy("qpos", "field").agg(F.min("qidf").alias("qidf")).withColumnRenamed("qpos", "at")
    phrase = need.where(F.col("k") == F.size(F.array_distinct("target"))).join(qidf.withColumnRenamed("field", "f2"), (F.col("at") >= F.col("qpos")) & (F.col("at") < F.col("qpos") + F.col("qlen")) & (F.col("f2") == F.col("field")), "left")
    phrase = phrase.groupBy("qpos", "qlen", "target", "field").agg(F.min("idf").alias("idf"), F.min("qidf").alias("qidf"))
    return single.unionByName(phrase.select("qpos", "qlen", "field", F.col("target").alias("canons"), F.lit(None).cast("array<string>").alias("tokens"), F.lit("synonym").alias("kind"), F.lit(0.85).alias("quality"), F.least("idf", F.coalesce("qidf", F.col("idf"))).alias("idf")))


def evidence(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Contiguous occurrences of matched terms in single values: (symbol, field, value, qpos, qlen, spos, slen, kind, contribution)."""
    seq = tokens.groupBy("symbol", "field", "value").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "canon"))).alias("seq"))
    head = tokens.select("symbol", "field", "value", "pos", "token", "canon")
    t = terms.withColumn("canon", F.element_at("canons", 1))
    hit = head.join(t, ["field", "canon"])
    hit = hit.where(F.col("tokens").isNull() | (F.element_at("tokens", 1) == F.col("token")))
    many = hit.where(F.size("canons") > 1).join(seq, ["symbol", "field", "value"])
    many = many.where(F.transform(F.slice("seq", F.col("pos") + 1, F.size("canons")), lambda x: x["canon"]) == F.col("canons")).drop("seq")
    weight = F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p))
    return hit.where(F.size("canons") == 1).unionByName(many).select(
        "symbol", "field", "value", "qpos", "qlen", F.col("pos").alias("spos"), F.size("canons").alias("slen"), "kind", (F.col("qlen") * weight[F.col("field")] * F.col("quality") * F.col("idf")).alias("contribution")
    )


class Selection:
    """Evidence chosen for a suffix of the query, with its rank (smaller is better)."""

    __slots__ = ("items", "rank", "score")

    def __init__(self, items: tuple, firsts: set[int], n_query: int, n_name: int):
        # item: (qpos, qlen, is_name, spos, slen, kind, contribution, source)
        covered = {p for i in items for p in range(i[0], i[0] + i[1])}
        names = sorted(i for i in items if i[2])
        consumed = sum(i[1] for i in names)
        straight = all(a[3] < b[3] and a[3] + a[4] <= b[3] for a, b in zip(names, names[1:], strict=False))
        bonus = ORDERED * consumed / n_query if n_query >= 2 and consumed >= 2 and straight else 0.0
        places = {p for i in names for p in range(i[3], i[3] + i[4])}
        self.items, self.score = items, sum(i[6] for i in items) - UNMATCHED * len(firsts - covered) + bonus + (SPECIFIC * len(places) / n_name if n_name else 0.0)
        self.rank = (-round(self.score, 12), -len(covered), -sum(i[5] in ("exact", "canonical") for i in items), -len(names), -max((i[1] for i in items), default=0), len(items), tuple(sorted(i[:6] for i in items)))


def select_evidence(items: list[tuple], firsts: set[int], n_query: int, n_name: int) -> Selection:
    """The best selection: items begin where the last one's query span ended, name items ever further on in the name."""
    memo: dict[tuple[int, int], Selection] = {}
    for p in range(n_query, -1, -1):
        for s in range(n_name, -1, -1):
            best = Selection((), firsts, n_query, n_name) if p == n_query else memo[p + 1, s]
            for i in items:
                if i[0] != p or (i[2] and i[3] < s):
                    continue
                rest = memo[p + i[1], min(i[3] + i[4], n_name) if i[2] else s]
                kept = tuple(x for x in rest.items if x[7] != i[7] or x[3] >= i[3] + i[4] or i[3] >= x[3] + x[4])
                other = Selection((i, *kept), firsts, n_query, n_name)
                if other.rank < best.rank:
                    best = other
            memo[p, s] = best
    return memo[0, 0]


def could_lead(per: DataFrame, firsts: int, n_query: int, limit: int, query: str) -> DataFrame:
    """Evidence of the variants that can still be among the `limit` best names; the others' best possible score is below what enough names surely reach.

    A score is at most the sum of each query position's best evidence and both bonuses, and at least what one name item
    or context item alone gives, less the penalties.
    """
    share = per.select("symbol", "variant", "qpos", "qlen", "contribution").groupBy("symbol", "variant", "qpos").agg(F.max("contribution").alias("c"), F.max(F.col("contribution") - UNMATCHED * (firsts - F.col("qlen"))).alias("one"))
    bound = share.groupBy("symbol", "variant").agg((F.sum("c") + ORDERED + SPECIFIC).alias("most"), (F.max("one") - 0.6).alias("least"))
    names = bound.groupBy(F.lower("variant").alias("name")).agg(F.max("least").alias("least"))
    reached = names.orderBy(F.desc("least")).limit(limit).agg(F.when(F.count("*") >= limit, F.min("least")).alias("reached"))  # a single row
    kept = bound.join(F.broadcast(reached)).where(F.col("reached").isNull() | (F.col("most") >= F.col("reached")) | (F.lower("variant") == query.lower())).select("symbol", "variant")
    return per.join(kept, ["symbol", "variant"], "left_semi")


def rank_symbols(tokens: DataFrame, found: DataFrame, q: DataFrame, query: str, names: DataFrame, limit: int | None = None) -> DataFrame:
    """(symbol, variant, score) of the best name variant of each symbol with evidence; of those that can be among the `limit` best names, if given. names: (symbol, variant)."""
    qs = q.collect()  # a query's few tokens
    firsts, n_query = {r["qpos"] for r in qs if r["first"]}, len(qs)
    size = tokens.where("field = 'name'").groupBy("symbol", F.col("value").alias("variant")).agg(F.count("*").alias("n_name"))
    per = found.join(names, "symbol").where((F.col("field") != "name") | (F.col("value") == F.col("variant"))).join(size, ["symbol", "variant"], "left")
    if limit is not None:
        per = could_lead(per, len(firsts), n_query, limit, query)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = []
            for items, n_name in zip(pdf["items"], pdf["n_name"], strict=True):
                rows = [(int(r["qpos"]), int(r["qlen"]), r["field"] == "name", int(r["spos"]), int(r["slen"]), r["kind"], float(r["contribution"]), (r["field"], r["value"])) for r in items]
                scores.append(select_evidence(rows, firsts, n_query, int(n_name)).score)
            yield pd.DataFrame({"symbol": pdf["symbol"], "variant": pdf["variant"], "score": scores})

    # a variant's evidence is a few items, bounded by the words of its symbol and of the query
    item = F.struct("qpos", "qlen", "field", "spos", "slen", "kind", "contribution", "value")
    whole = per.groupBy("symbol", "variant").agg(F.collect_list(item).alias("items"), F.coalesce(F.max("n_name"), F.lit(0)).alias("n_name"))
    scored = whole.mapInPandas(score, f"symbol {tokens.schema['symbol'].dataType.simpleString()}, variant string, score double")
    scored = scored.withColumn("score", F.col("score") - capital_penalty(F.col("variant"), F.lit(query)))
    return scored.groupBy("symbol").agg(F.max_by(F.struct("variant", "score"), F.struct("score", "variant")).alias("b")).select("symbol", "b.*")


def parse_query(query: str) -> tuple[str | None, str, str | None]:
    """(module, words, owner) of `Module.Path.words@Owner`: the longest module prefix wins, parentheses around an operator go."""
    owned = re.fullmatch(r"(.+)@([^@]+)", query, re.S)
    rest, owner = (owned[1], owned[2]) if owned else (query, None)
    qualified = re.fullmatch(r"((?:[A-Z]\w*'*\.)+)(.+)", rest, re.S)
    module, rest = (qualified[1][:-1], qualified[2]) if qualified else (None, rest)
    bare = re.fullmatch(r"\((.+)\)", rest, re.S)
    return module, bare[1] if bare else rest, owner


def documents(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbol, field, value), (symbol, variant) and (symbol, module) of symbols, each symbol once however many rows it has.

    symbols: (symbol, occ, module, aliases, exported_from, results, arguments), the last four arrays or null. A symbol is
    found under its aliases, or its own name where it has none; its own name's words are always searched, and its modules
    are those that define or export it.
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    variants = F.when(F.size(some("aliases")) > 0, some("aliases")).otherwise(F.array("occ"))
    each = lambda c: symbols.select("symbol", F.explode(c).alias("value")).where("value is not null").distinct()
    names, modules = each(variants), each(F.array_union(F.array("module"), some("exported_from")))
    field = lambda rows, f: rows.select("symbol", F.lit(f).alias("field"), "value")
    values = field(each(F.array_union(variants, F.array("occ"))), "name").union(field(modules, "module")).union(field(each(some("results")), "result")).union(field(each(some("arguments")), "argument"))
    return values, names.withColumnRenamed("value", "variant"), modules.withColumnRenamed("value", "module")


def in_scope(symbols: DataFrame, modules: DataFrame, module: str | None, patterns: list[str]) -> DataFrame:
    """Rows of symbols that a named module defines or exports, and of which a module matches any pattern, if there are any."""
    if module is not None:
        symbols = symbols.join(modules.where(F.col("module") == module), "symbol", "left_semi")
    if patterns:
        fits = functools.reduce(lambda a, b: a | b, (matches_glob(F.col("module"), p) for p in patterns))
        symbols = symbols.join(modules.where(fits), "symbol", "left_semi")
    return symbols


def group_suggestions(ranked: DataFrame, modules: DataFrame, limit: int = 10) -> DataFrame:
    """(place, name, score, modules): suggestions whose names differ in case alone are one, at the place of the first; their modules unite. ranked: (place, symbol, variant, score)."""
    first = ranked.groupBy(F.lower("variant").alias("key")).agg(F.min(F.struct("place", "variant", "score")).alias("b"))
    top = first.orderBy("b.place").limit(limit)
    united = ranked.withColumn("key", F.lower("variant")).join(top.select("key"), "key").join(modules, "symbol").groupBy("key").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    return top.join(united, "key", "left").select(F.col("b.place").alias("place"), F.col("b.variant").alias("name"), F.col("b.score").alias("score"), F.coalesce("modules", F.array().cast("array<string>")).alias("modules"))


def search_symbols(values: DataFrame, query: str, synonyms: DataFrame | None = None, limit: int = 10, names: DataFrame | None = None, modules: DataFrame | None = None, patterns: list[str] | None = None) -> DataFrame:
    """The `limit` best names, in order of place: (place, name, score, modules).

    values: (symbol, field, value); names: (symbol, variant), all name values if none are given; modules: (symbol, module),
    of its defining and exporting modules, the module values if none are given. A module before the query's words
    and the patterns limit the symbols; an owner behind them is left out.
    """
    spark = values.sparkSession
    module, words, _ = parse_query(query)
    names = values.where("field = 'name'").select("symbol", F.col("value").alias("variant")).distinct() if names is None else names
    modules = values.where("field = 'module'").select("symbol", F.col("value").alias("module")).distinct() if modules is None else modules
    tokens = doc_tokens(values)
    q = query_tokens(spark, words)
    found = materialise(in_scope(evidence(tokens, match_terms(q, field_statistics(tokens), synonyms)), modules, module, patterns or []))
    keyed = lambda x: x.withColumns({"exact": (F.lower("variant") == words.lower()).cast("int"), "score": F.round("score", 9), "key": F.lower("variant")})
    ranked = keyed(rank_symbols(tokens, found, q, words, names, limit))
    # names in order of what needs no distance; those beyond the last place that can be reached go
    each = materialise(ranked.groupBy("key").agg(F.max(F.struct("exact", "score")).alias("b")))
    last = each.orderBy(F.desc("b")).limit(limit).agg(F.min("b").alias("last"))  # a single row
    top = each.join(F.broadcast(last)).where(F.col("b") >= F.col("last")).select("key")
    # all symbols of these names, whatever their own scores
    symbols = names.withColumn("key", F.lower("variant")).join(top, "key", "left_semi").select("symbol").distinct()
    ranked = keyed(rank_symbols(tokens, found.join(symbols, "symbol", "left_semi"), q, words, names)).join(top, "key", "left_semi")
    order = Window.orderBy(F.desc("exact"), F.desc("score"), edit_distance("key", F.lit(words.lower())), "key", "variant", "symbol")
    return group_suggestions(ranked.select(F.row_number().over(order).alias("place"), "symbol", "variant", "score"), modules, limit).orderBy("place")


def synonym_pairs(groups: DataFrame) -> DataFrame:
    """(group_id, term) -> (term, target): both as canonical token arrays, all ordered pairs within a group, no further."""
    terms = groups.select("group_id", F.transform(tokenize(F.col("term")), canonical).alias("term")).where(F.size("term") > 0).distinct()
    return terms.join(terms.withColumnRenamed("term", "target"), "group_id").where("term <> target").select("term", "target").distinct()


def merge_lexicons(*lexicons: DataFrame) -> DataFrame:
    """(term, target) of several vocabularies together."""
    return functools.reduce(DataFrame.unionByName, lexicons).distinct()


def group_errors(groups: DataFrame) -> DataFrame:
    """(group_id, problem, term) of groups that cannot be used: too_few_terms, empty_term, or same_terms where fewer than two differ once normalised. All problems are listed."""
    t = groups.withColumn("canons", F.transform(tokenize(F.col("term")), canonical))
    each = t.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.size("canons") > 0, F.col("canons"))).alias("kinds"))
    none = F.lit(None).cast("string")
    few = each.where("n < 2").select("group_id", F.lit("too_few_terms").alias("problem"), none.alias("term"))
    empty = t.where(F.size("canons") == 0).select("group_id", F.lit("empty_term").alias("problem"), "term")
    return few.union(empty).union(each.where("n >= 2 and kinds < 2").select("group_id", F.lit("same_terms"), none))


def resolve_unique(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query) against (occ, root): missing, resolved or ambiguous by the number of roots."""
    n = queries.join(symbols, queries["query"] == symbols["occ"], "left").groupBy("query").agg(F.countDistinct("root").alias("n_roots"), F.min("root").alias("root"))
    return n.select("query", "n_roots", F.when(F.col("n_roots") == 0, "missing").when(F.col("n_roots") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("n_roots") == 1, F.col("root")).alias("root"))
