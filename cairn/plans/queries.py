"""Each operator over an adapter view of the test tables, beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical, compact_diagnostic, edit_distance, estimate_tokens, matches_glob, max_distance, near, tokenize
from ..operators import diagnostics, graph, knowledge, lookup, references, search, sessions, sets, spans, tree
from ..tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def part_values(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: name, brand as module, type as result type."""
    p = table(spark, d, "part")
    one = lambda field, c: p.select(F.col("p_partkey").alias("symbol"), F.lit(field).alias("field"), F.col(c).alias("value"))
    return one("name", "p_name").union(one("module", "p_brand")).union(one("result", "p_type"))


def _sql_tokens(text: str) -> str:
    """DuckDB: the tokens of ASCII text. No look-around there, so boundaries become spaces, twice for overlaps."""
    for rx in ("([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Za-z])([0-9])", "([A-Z])([A-Z][a-z])"):
        for _ in range(2):
            text = f"regexp_replace({text}, '{rx}', '\\1 \\2', 'g')"
    split = rf"list_transform(string_split_regex({text}, '[\s_.''-]+'), lambda x: lower(x))"
    return f"list_filter({split}, lambda x: x <> '' and (length(x) >= 2 or not regexp_matches(x, '[a-z0-9]')))"


def _sql_canonical(t: str) -> str:
    from ..functions.text import IRREGULAR

    fixed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    rules = (
        f"CASE WHEN length({t}) <= 3 THEN {t} WHEN length({t}) > 4 AND suffix({t}, 'ies') AND NOT suffix({t}, 'eies') THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 4 AND regexp_matches({t}, '(ch|sh|ss|x|z)es$') THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 4 AND suffix({t}, 's') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )
    return f"CASE {t} {fixed} ELSE {rules} END"


_VALUES = "(SELECT p_partkey symbol, 'name' field, p_name v FROM part UNION ALL SELECT p_partkey, 'module', p_brand FROM part UNION ALL SELECT p_partkey, 'result', p_type FROM part)"
_DOC = f"WITH vals AS {_VALUES}, tok AS (SELECT symbol, field, unnest({_sql_tokens('v')}) token FROM vals), tokens AS (SELECT *, {_sql_canonical('token')} canon FROM tok)"
_STATS = _DOC + (
    ", df AS (SELECT field, token, canon, count(DISTINCT symbol) df FROM tokens GROUP BY ALL), nf AS (SELECT field, count(DISTINCT symbol) n FROM tokens GROUP BY ALL)"
    ", stats AS (SELECT field, token, canon, df, n, log2((n + 1) / (df + 1)) + 1 idf FROM df JOIN nf USING (field))"
)


@query("SELECT p_partkey, array_to_string(" + _sql_tokens("replace(p_name, ' ', '') || upper(left(p_type, 1)) || substr(p_type, 2) || '_' || p_size || '.' || p_brand") + ", ' ') tokens FROM part")
def tokenize_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.upper(F.left("p_type", F.lit(1))), F.expr("substr(p_type, 2)"), F.lit("_"), F.col("p_size").cast("string"), F.lit("."), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(tokenize(t), " ").alias("tokens"))


@query(
    "WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) token FROM documents) "
    f"SELECT token, {_sql_canonical('token')} canon, count(*) n FROM w GROUP BY token"
)
def canonical_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).select(F.lower("token").alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n")).select("token", canonical(F.col("token")).alias("canon"), "n")


@query("SELECT page_id, url, regexp_full_match(url, 'https?://.*/.*') any_path, regexp_full_match(url, '.*\\.html') is_html, regexp_full_match(url, '.*[.]com/.*') in_com FROM pages")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    either = matches_glob(u, "http://*/*") | matches_glob(u, "https://*/*")
    return table(spark, d, "pages").select("page_id", "url", either.alias("any_path"), matches_glob(u, "*.html").alias("is_html"), matches_glob(u, "*.com/*").alias("in_com"))


@query(_STATS + " SELECT field, token, canon, df, n, round(idf, 6) idf FROM stats")
def postings_df_idf(spark: SparkSession, d: str) -> DataFrame:
    return search.field_statistics(search.doc_tokens(part_values(spark, d))).withColumn("idf", F.round("idf", 6))


@query(
    _STATS + ", o AS (SELECT symbol, field, token, CASE field WHEN 'name' THEN 1.0 WHEN 'module' THEN 0.45 ELSE 0.65 END * idf c FROM tokens JOIN stats USING (field, token) WHERE token IN ('large', 'widget')), "
    "x AS (SELECT symbol, max(CASE WHEN token = 'large' AND field = 'name' THEN c END) an, max(CASE WHEN token = 'large' AND field <> 'name' THEN c END) ac, max(CASE WHEN token = 'widget' AND field = 'name' THEN c END) bn, max(CASE WHEN token = 'widget' AND field <> 'name' THEN c END) bc FROM o GROUP BY symbol), "
    "ch AS (SELECT symbol, coalesce(a, 0) + coalesce(b, 0) - 0.75 * ((a IS NULL)::int + (b IS NULL)::int) + CASE WHEN ak AND bk THEN 0.5 ELSE 0 END + 0.6 * (ak::int + bk::int) / n s FROM (SELECT symbol, unnest([{'v': an, 'k': an IS NOT NULL}, {'v': ac, 'k': false}, {'v': NULL, 'k': false}]) o1, bn, bc FROM x) "
    "CROSS JOIN LATERAL (SELECT o1.v a, o1.k ak) CROSS JOIN LATERAL (SELECT unnest([bn, bc, NULL]) b, unnest([bn IS NOT NULL, false, false]) bk) JOIN (SELECT symbol, count(*) n FROM tokens WHERE field = 'name' GROUP BY ALL) USING (symbol)), "
    "best AS (SELECT symbol, p_name, p_brand, round(max(s), 9) s, (p_name = 'large widget')::int ex FROM ch JOIN part ON symbol = p_partkey GROUP BY ALL), "
    "nm AS (SELECT p_name, max({'ex': ex, 's': s}) b FROM best GROUP BY p_name), place AS (SELECT p_name, b.s score, row_number() OVER (ORDER BY b DESC, damerau_levenshtein(p_name, 'large widget'), p_name) place FROM nm) "
    "SELECT place, p_name AS name, round(score, 6) score, (SELECT string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FROM best WHERE best.p_name = place.p_name) modules FROM place WHERE place <= 10"
)
def search_full(spark: SparkSession, d: str) -> DataFrame:
    """Two words over all parts, by the ranking itself; its SQL tries every choice of evidence."""
    r = search.search_symbols(part_values(spark, d), "large widget")
    return r.select(F.row_number().over(Window.orderBy("place")).cast("long").alias("place"), "name", F.round("score", 6).alias("score"), F.array_join("modules", ",").alias("modules"))


@query()
def search_synonym_typo(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(1, "large"), (1, "big"), (2, "gear wheel"), (2, "cog")], "group_id int, term string")
    return search.search_symbols(part_values(spark, d), "big wdget", search.synonym_pairs(groups))


_TYPOS = [("wdget", 0), ("larg", 1), ("smlal", 2), ("gaer", 3), ("boltt", 4), ("metla", 5)]


@query(
    "WITH v AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) token FROM part), q AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w, _ in _TYPOS) + ") x(q)) "
    "SELECT q, token, damerau_levenshtein(q, token) distance FROM q, v WHERE damerau_levenshtein(q, token) <= CASE WHEN length(q) <= 2 THEN 0 WHEN length(q) <= 4 THEN 1 WHEN length(q) <= 6 THEN 2 WHEN length(q) <= 12 THEN 3 ELSE 4 END"
)
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(w,) for w, _ in _TYPOS], "q string")
    v = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()
    close = v.join(F.broadcast(q), near(F.col("q"), F.col("token"), max_distance(F.length("q"))))  # six literal rows
    return close.withColumn("distance", edit_distance("q", "token").cast("long")).where(F.col("distance") <= max_distance(F.length("q"))).select("q", "token", "distance")


@query(
    "WITH g AS (SELECT * FROM (VALUES (1, 'large'), (1, 'big'), (2, 'small'), (2, 'tiny'), (2, 'mini')) x(g, t)) SELECT a.t term, b.t target FROM g a JOIN g b ON a.g = b.g AND a.t <> b.t"
)
def search_synonyms(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(1, "large"), (1, "big"), (2, "small"), (2, "tiny"), (2, "mini")], "group_id int, term string")
    return search.synonym_pairs(groups).select(F.array_join("term", " ").alias("term"), F.array_join("target", " ").alias("target"))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = [
        table(spark, d, "lineitem").select(s("p", "l_partkey").alias("src"), s("s", "l_suppkey").alias("dst")), table(spark, d, "supplier").select(s("s", "s_suppkey"), s("n", "s_nationkey")),
        table(spark, d, "customer").select(s("c", "c_custkey"), s("n", "c_nationkey")), table(spark, d, "nation").select(s("n", "n_nationkey"), s("r", "n_regionkey")),
    ]
    return e[0].union(e[1]).union(e[2]).union(e[3]).distinct()


_SUPPLY = (
    "e AS (SELECT DISTINCT 'p' || l_partkey src, 's' || l_suppkey dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier "
    "UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
)


@query(f"WITH RECURSIVE {_SUPPLY}, w(node, depth) AS (SELECT 'p1', 0 UNION SELECT 'c1', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < 3) SELECT node, min(depth) depth FROM w GROUP BY node")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(spark.createDataFrame([("p1",), ("c1",)], "node string"), supply_edges(spark, d), 3)


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey src, 's' || l_suppkey dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem), "
    "w AS (SELECT 'p1' node UNION SELECT 's1' UNION SELECT dst FROM w JOIN e ON node = src) SELECT node FROM w"
)
def closure_cyclic(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s")).distinct()
    e = li.select(F.col("p").alias("src"), F.col("s").alias("dst")).union(li.select("s", "p"))
    return graph.bfs(spark.createDataFrame([("p1",), ("s1",)], "node string"), e).select("node")


_ORDER_PARTS = "o AS (SELECT o_orderstatus st, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 49)"


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_partkey", "l_suppkey")
    return li.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))


@query(
    f"WITH RECURSIVE {_ORDER_PARTS}, e AS (SELECT DISTINCT 'p' || l_partkey src, 's' || l_suppkey dst FROM o), live AS (SELECT DISTINCT 'p' || l_partkey node FROM o WHERE st = 'F' UNION SELECT dst FROM live JOIN e ON node = src), "
    "tested AS (SELECT DISTINCT 'p' || l_partkey node FROM o WHERE st = 'O' UNION SELECT dst FROM tested JOIN e ON node = src), "
    "defs AS (SELECT 'p' || p_partkey node FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier) "
    "SELECT node, CASE WHEN node IN (SELECT node FROM live) THEN 'alive' WHEN node IN (SELECT node FROM tested) THEN 'test_only' ELSE 'safe_delete' END status FROM defs"
)
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    o = _bulk(spark, d).select("o_orderstatus", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    defs = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")).union(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    roots = lambda s: o.where(F.col("o_orderstatus") == s).select("node")
    return graph.find_dead(defs.withColumn("test_module", F.lit(False)), roots("F"), roots("O"), o.select(F.col("node").alias("src"), "dst").distinct())


@query(
    "WITH alive AS (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 5), h AS (SELECT l_orderkey, bool_or(a.p_partkey IS NOT NULL) ok FROM lineitem LEFT JOIN alive a ON l_partkey = a.p_partkey GROUP BY ALL) "
    "SELECT o_orderkey node, coalesce(ok, true) alive FROM orders LEFT JOIN h ON o_orderkey = l_orderkey"
)
def instance_liveness(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("head"))
    return graph.instance_liveness(table(spark, d, "orders").select(F.col("o_orderkey").alias("node")), heads, table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("node")))


def _modules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("double")
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    nodes = r.select(s("r", "r_regionkey").alias("node"), none.alias("seconds")).union(n.select(s("n", "n_nationkey"), none)).union(c.select(s("c", "c_custkey"), none)).union(o.select(s("o", "o_orderkey"), F.col("o_totalprice") / 1e5))
    edges = n.select(s("n", "n_nationkey").alias("src"), s("r", "n_regionkey").alias("dst")).union(c.select(s("c", "c_custkey"), s("n", "c_nationkey"))).union(o.select(s("o", "o_orderkey"), s("c", "o_custkey")))
    return nodes, edges


_MODULES = (
    "n AS (SELECT 'r' || r_regionkey node, NULL::double sec FROM region UNION ALL SELECT 'n' || n_nationkey, NULL FROM nation UNION ALL SELECT 'c' || c_custkey, NULL FROM customer UNION ALL SELECT 'o' || o_orderkey, o_totalprice / 1e5 FROM orders), "
    "e AS (SELECT 'n' || n_nationkey src, 'r' || n_regionkey dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"
)


@query(
    f"WITH RECURSIVE {_MODULES}, p AS (SELECT src, dst, 1 len FROM e UNION ALL SELECT p.src, e.dst, len + 1 FROM p JOIN e ON p.dst = e.src), "
    "tr AS (SELECT dst node, count(DISTINCT src) transitive, max(len) downstream FROM p GROUP BY ALL), di AS (SELECT dst node, count(DISTINCT src) direct FROM e GROUP BY ALL), la AS (SELECT src node, max(len) layer FROM p GROUP BY ALL) "
    "SELECT node, coalesce(sec, 1) duration, coalesce(direct, 0) direct, coalesce(transitive, 0) transitive, coalesce(layer, 0)::int layer, coalesce(downstream, 0)::int downstream, "
    "coalesce(sec, 1) * (1 + coalesce(transitive, 0)) + coalesce(direct, 0) score FROM n LEFT JOIN di USING (node) LEFT JOIN tr USING (node) LEFT JOIN la USING (node)"
)
def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return graph.bottlenecks(*_modules(spark, d))


@query(
    f"WITH RECURSIVE {_MODULES}, w AS (SELECT node, coalesce(sec, 1) own, coalesce(sec, 1) cost FROM n WHERE node LIKE 'r%' UNION ALL SELECT n.node, coalesce(n.sec, 1), w.cost + coalesce(n.sec, 1) FROM w JOIN e ON w.node = e.dst JOIN n ON n.node = e.src), "
    "t AS (SELECT count(*) modules, sum(coalesce(sec, 1)) tw, (SELECT max(cost) FROM w) cp FROM n) "
    "SELECT modules, round(tw, 4) total_work, round(cp, 4) critical_path, round(tw / 32, 4) ideal, round(greatest(cp, tw / 32), 4) bound, round(tw / (32 * greatest(cp, tw / 32)), 6) efficiency FROM t"
)
def critical_path(spark: SparkSession, d: str) -> DataFrame:
    s = graph.build_summary(*_modules(spark, d), 32)
    return s.select("modules", *(F.round(c, 4).alias(c) for c in ("total_work", "critical_path", "ideal", "bound")), F.round("efficiency", 6).alias("efficiency"))


@query("SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#12') GROUP BY l_orderkey HAVING count(DISTINCT p_brand) = 2")
def division_all(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return sets.mention_all(m, "l_orderkey", "p_brand", ["Brand#11", "Brand#12"])


@query(
    "WITH s AS (SELECT DISTINCT n_regionkey, n_nationkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT n_regionkey, count(DISTINCT n_nationkey) n FROM s GROUP BY ALL) "
    "SELECT n_regionkey, c_mktsegment FROM s JOIN n USING (n_regionkey) GROUP BY n_regionkey, c_mktsegment, n HAVING count(DISTINCT n_nationkey) = n"
)
def shared_settings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).distinct()
    return sets.common_settings(s, ["n_regionkey"], "n_nationkey", "c_mktsegment")


@query(
    "WITH r AS (SELECT l_orderkey f, l_linenumber o, l_partkey os, l_partkey + l_suppkey * 20 oe FROM lineitem), i AS (SELECT l_orderkey f, l_orderkey * 10 + l_linenumber i, l_partkey + 5 s, l_partkey + 15 e FROM lineitem), "
    "p AS (SELECT i, o, oe - os size FROM i JOIN r USING (f) WHERE os <= s AND e <= oe) SELECT i, arg_min(o, (size, o)) o FROM p GROUP BY i"
)
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    outer = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("os"), (F.col("l_partkey") + F.col("l_suppkey") * 20).alias("oe"))
    inner = li.select(F.col("l_orderkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), (F.col("l_partkey") + 5).alias("s"), (F.col("l_partkey") + 15).alias("e"))
    return spans.narrowest(spans.contained(inner, outer, block=1024))


@query(
    "WITH r AS (SELECT l_partkey, date_diff('day', DATE '1992-01-01', l_shipdate::date) s FROM lineitem), m AS (SELECT *, max(s) OVER (PARTITION BY l_partkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM r), "
    "g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 32 THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY s RANGE UNBOUNDED PRECEDING) k FROM m) SELECT l_partkey, min(s) s, max(s) e FROM g GROUP BY l_partkey, k"
)
def interval_coalesce(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    return spans.coalesce_ranges(table(spark, d, "lineitem").select("l_partkey", day.alias("s"), day.alias("e")), "l_partkey", 32)


_PATH = "regexp_replace(url, '^https?://', '')"


@query(
    f"WITH p AS (SELECT string_split({_PATH}, '/') x, coalesce(nullif(regexp_extract({_PATH}, '[^/.][^/]*\\.([^./]+)$', 1), ''), '') ext FROM pages), "
    "u AS (SELECT unnest(range(0, len(x))) i, x, ext FROM p) SELECT CASE WHEN i = 0 THEN '.' ELSE array_to_string(x[1:i], '/') END dir, ext, count(*) files FROM u GROUP BY ALL"
)
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tree.roll_up(table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))


@query(
    "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) z, count(*) OVER (PARTITION BY c_nationkey) n FROM customer) "
    "SELECT c_custkey, c_nationkey FROM r WHERE n < 20 OR a <= 3 OR z <= 3"
)
def noisy_head_tail(spark: SparkSession, d: str) -> DataFrame:
    return sets.head_and_tail(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", [F.col("c_custkey")], [F.desc("c_custkey")])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 15 OFFSET 30")
def page_orders(spark: SparkSession, d: str) -> DataFrame:
    return sets.page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 30, 15)[0]


@query(
    "WITH m AS (SELECT o_custkey, o_orderstatus, o_orderkey, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END x FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), "
    "g AS (SELECT *, sum(x) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::bigint run FROM m) SELECT o_custkey, run, o_orderstatus, count(*) n FROM g GROUP BY ALL"
)
def adjacent_groups(spark: SparkSession, d: str) -> DataFrame:
    return sets.adjacent_groups(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"], "o_orderstatus")


@query(
    "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^[•*] *', '')), lambda x: x <> '') x FROM documents), "
    "c AS (SELECT doc_id, x, list_position(list_transform(x, lambda y: regexp_matches(y, '^In (the|a|an) ')), true) p FROM l) "
    "SELECT doc_id, md5(left(array_to_string(CASE WHEN p > 0 THEN x[1:p - 1] ELSE x END, ' '), 700)) digest FROM c"
)
def diag_compact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.left(compact_diagnostic(F.col("text")), F.lit(diagnostics.MESSAGE_LENGTH))).alias("digest"))


@query(
    "WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, value)) v FROM events GROUP BY ALL) SELECT user_id, round(sum(v), 6) AS seconds, count(*) AS variants FROM l GROUP BY user_id"
)
def latest_sample(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select("user_id", "event_type", F.col("ts").alias("modified"), F.col("value").alias("seconds"), F.lit(0).cast("long").alias("bytes"))
    return diagnostics.latest_per_variant(s, "user_id", "event_type").select("user_id", F.round("seconds", 6).alias("seconds"), "variants")


@query("WITH h AS (SELECT doc_id, md5(coalesce(text, '')) hash FROM documents) SELECT min(doc_id) doc_id, hash FROM h GROUP BY hash")
def fingerprint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.first_by_hash(table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash")), ["doc_id"])


@query(
    "WITH h AS (SELECT doc_id, source, md5(doc_id || '|' || coalesce(source, '') || chr(10) || coalesce(text, '')) hash FROM documents), "
    "a AS (SELECT * FROM h ORDER BY doc_id LIMIT 30), b AS (SELECT * FROM h ORDER BY doc_id LIMIT 30 OFFSET 15) SELECT b.doc_id, b.hash FROM b WHERE hash NOT IN (SELECT hash FROM a)"
)
def knowledge_delta(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", knowledge.fingerprint(F.col("doc_id"), F.col("source"), body=F.col("text")).alias("hash"))
    first, second = h.orderBy("doc_id").limit(30), h.orderBy("doc_id").offset(15).limit(30)
    return knowledge.deliver(second, first.select("hash"))[0].select("doc_id", "hash")


@query("SELECT conv_id, role, count(*) calls, sum(ceil(length(coalesce(text, '')) / 4.0))::bigint tokens FROM conversations GROUP BY ALL")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("calls"), F.sum(estimate_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


@query(
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) seq FROM events), r AS (SELECT user_id, seq s, min(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) e, event_type FROM n), "
    "x AS (SELECT user_id, min(s) s, e FROM r WHERE event_type = 'error' AND e IS NOT NULL GROUP BY user_id, e) "
    "SELECT n.event_id, EXISTS (SELECT 1 FROM x WHERE x.user_id = n.user_id AND n.seq BETWEEN x.s AND x.e) masked FROM n"
)
def mask_ranges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("seq")
    n = table(spark, d, "events").select(F.col("user_id").alias("session"), "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))
    end = F.first(F.when(F.col("event_type") == "purchase", F.col("seq")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    r = n.withColumn("e", end).where("event_type = 'error' and e is not null").groupBy("session", "e").agg(F.min("seq").alias("s"))
    return sessions.mask(n, r).select("event_id", "masked")


@query(
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) seq FROM events), c AS (SELECT user_id, max(CASE WHEN event_type IN ('signup', 'purchase') THEN seq END) cl, count(*) FILTER (event_type = 'signup') epoch, count(*) FILTER (event_type = 'purchase') n_completed FROM n GROUP BY ALL), "
    "s AS (SELECT n.user_id, arg_max(event_id, seq) snapshot FROM n JOIN c USING (user_id) WHERE event_type = 'view' AND (cl IS NULL OR seq > cl) GROUP BY ALL) SELECT user_id, epoch, n_completed, snapshot FROM c LEFT JOIN s USING (user_id)"
)
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "snapshot").when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "purchase", "completed").otherwise("other")
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), kind.alias("kind"), F.col("event_id").alias("payload"))
    return sessions.fold_sessions(e).withColumnRenamed("session", "user_id")


@query(
    "WITH a AS (SELECT doc_id, md5(text) h FROM documents WHERE source <> 'src1'), b AS (SELECT doc_id, md5(CASE WHEN source = 'src2' THEN text || '!' ELSE text END) h FROM documents WHERE source <> 'src3') "
    "SELECT doc_id AS path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' ELSE 'modified' END change FROM a FULL OUTER JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h"
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    old = t.where("source <> 'src1'").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    new = t.where("source <> 'src3'").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("source") == "src2", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return sessions.snapshot_diff(old, new)


@query(
    "SELECT count(*) total, count(*) FILTER (quality = 1 AND toxic = 0) passed, count(*) FILTER (quality = 0 AND toxic = 0) setup_failed, count(*) FILTER (toxic = 1) failed, "
    "CASE WHEN count(*) = 0 THEN 'no tests' WHEN count(*) FILTER (quality = 1 AND toxic = 0) < count(*) THEN 'failed' ELSE 'passed' END verdict FROM labels"
)
def test_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "setup_failed").otherwise("passed")
    return diagnostics.test_summary(table(spark, d, "labels").select(s.alias("status")))


@query(
    "WITH q AS (SELECT * FROM (VALUES ('large widget'), ('no such part'), ('small gear')) x(query)) SELECT query, count(DISTINCT p_brand) n_roots, CASE count(DISTINCT p_brand) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END status, "
    "CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END root FROM q LEFT JOIN part ON lower(p_name) = query GROUP BY query"
)
def resolve_symbols(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([("large widget",), ("no such part",), ("small gear",)], "query string")
    return search.resolve_unique(q, table(spark, d, "part").select(F.lower("p_name").alias("occ"), F.col("p_brand").alias("root")))


@query("SELECT DISTINCT p_name FROM part WHERE starts_with(p_name, 'b') ORDER BY 1")
def prefix_completion(spark: SparkSession, d: str) -> DataFrame:
    return lookup.completions(table(spark, d, "part").select(F.col("p_name").alias("name")), "b").withColumnRenamed("name", "p_name")


@query("SELECT p_brand module, list_sort(list(DISTINCT p_type))::varchar names FROM part GROUP BY p_brand")
def omitted_by_module(spark: SparkSession, d: str) -> DataFrame:
    o = knowledge.omitted_by_module(table(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("name")))
    return o.select("module", F.concat(F.lit("["), F.array_join("names", ", "), F.lit("]")).alias("names"))


@query(
    "WITH c AS (SELECT p_name root, replace(p_brand, 'Brand#', 'GHC.Internal') || '.' || p_type AS module, bool_or(p_size <= 3) home, bool_or(p_size <= 25) defining, bool_or(p_size > 10) exported FROM part GROUP BY ALL), "
    "k AS (SELECT root, module, CASE WHEN home THEN -400 ELSE 0 END - CASE WHEN module = 'Prelude' AND exported THEN 300 ELSE 0 END - CASE WHEN defining AND exported THEN 200 ELSE 0 END - CASE WHEN exported THEN 100 ELSE 0 END + "
    "CASE WHEN contains(module, '.Internal') THEN 100 ELSE 0 END + CASE WHEN starts_with(module, 'GHC.') THEN 50 ELSE 0 END pen FROM c) SELECT root, arg_min(module, (pen, len(string_split(module, '.')), module)) AS module FROM k GROUP BY root"
)
def preferred_modules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("root"), F.concat_ws(".", F.replace("p_brand", F.lit("Brand#"), F.lit("GHC.Internal")), "p_type").alias("module"), "p_size")
    c = p.groupBy("root", "module").agg(F.bool_or(F.col("p_size") <= 3).alias("home"), F.bool_or(F.col("p_size") <= 25).alias("defining"), F.bool_or(F.col("p_size") > 10).alias("exported"))
    return lookup.preferred_modules(c)


@query(
    "WITH x AS (SELECT p_brand module, p_type root, bool_or(p_size = 1) hit, list_sort(list_distinct(list(p_name) FILTER (contains(p_name, 'small')))) c FROM part GROUP BY ALL) "
    "SELECT module, root, coalesce(array_to_string(c, ','), '') children FROM x WHERE hit OR len(c) > 0"
)
def exported_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("root"), F.col("p_name").alias("child"), (F.col("p_size") == 1).alias("root_hit"), F.col("p_name").contains("small").alias("child_hit"))
    return lookup.exports(p, hinted=True).withColumn("children", F.array_join("children", ","))


@query("SELECT 'c' || c_custkey node, 'r' || n_regionkey root, 2 steps FROM customer JOIN nation ON c_nationkey = n_nationkey")
def root_chain(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    up = lambda t, kid, p, parent: t.select(F.concat(F.lit(kid), t[p]).alias("node"), F.concat(F.lit("n" if kid == "c" else "r"), t[parent]).alias("parent"))
    parents = up(c, "c", "c_custkey", "c_nationkey").union(up(n, "n", "n_nationkey", "n_regionkey"))
    return lookup.roots(c.select(F.concat(F.lit("c"), "c_custkey").alias("node")), parents)


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey AS name FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 15"
)
def find_references(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), "l_orderkey", "l_linenumber", "l_shipdate")
    targets = table(spark, d, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("name"))
    return references.find_references(targets, index, ["l_shipdate", "l_orderkey", "l_linenumber"])[0].drop("l_shipdate")


@query(
    "WITH o AS (SELECT l_orderkey d, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey i, l_suppkey s, l_suppkey + l_linenumber e, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 1 END parent FROM lineitem), "
    "m AS (SELECT l_orderkey d, l_linenumber AS name, l_suppkey % 20 s, l_suppkey % 20 + l_partkey e FROM lineitem), r AS (SELECT d, list_sort(list(DISTINCT name)) roots FROM m WHERE name <= 2 GROUP BY d), "
    "p AS (SELECT i, name, m.e - m.s AS size, min(m.e - m.s) OVER (PARTITION BY i) least FROM o JOIN m ON o.d = m.d AND m.s <= o.s AND o.e <= m.e), n AS (SELECT i, list_sort(list(DISTINCT name)) near FROM p WHERE size = least GROUP BY i) "
    "SELECT i, array_to_string(CASE WHEN near IS NOT NULL THEN CASE WHEN list_contains(near, parent) THEN [parent] ELSE near END WHEN list_contains(roots, parent) THEN [parent] ELSE roots END, ',') owners "
    "FROM o LEFT JOIN n USING (i) LEFT JOIN r ON o.d = r.d"
)
def occurrence_owners(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("def_id"), F.col("l_linenumber").alias("name"), "l_suppkey", "l_partkey")
    parent = F.when(F.col("name") % 2 == 0, F.col("name") - 1)
    o = li.select("def_id", F.concat_ws("-", "def_id", "name", "l_suppkey", "l_partkey").alias("i"), F.col("l_suppkey").alias("s"), (F.col("l_suppkey") + F.col("name")).alias("e"), parent.alias("parent"))
    m = li.select("def_id", "name", (F.col("l_suppkey") % 20).alias("s"), (F.col("l_suppkey") % 20 + F.col("l_partkey")).alias("e"))
    return references.occurrence_owners(o, m, m.where("name <= 2").select("def_id", "name")).withColumn("owners", F.array_join("owners", ","))


@query(
    "WITH m AS (SELECT doc_id, bool_or(toxic = 0) ok FROM labels GROUP BY doc_id), t AS (SELECT count(*) FILTER (ok) loaded, count(*) FILTER (NOT ok) failed FROM m) "
    "SELECT loaded, failed, loaded + failed total, CASE WHEN loaded + failed = 0 THEN 'empty' WHEN failed = 0 THEN 'loaded' WHEN loaded = 0 THEN 'failed' ELSE 'partial' END status, failed > 0 AS partial FROM t"
)
def load_summary(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.load_summary(table(spark, d, "labels").select(F.col("doc_id").alias("module"), (F.col("toxic") == 0).alias("loaded")))
