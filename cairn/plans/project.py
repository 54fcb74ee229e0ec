"""Definitions, references, projects, sessions and trees over the test tables, beside the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import definitions, lookup, project, sessions, tree
from ..tables import table
from .queries import query


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as definitions in the modules of their nations; each uses the customer at a third of its key."""
    c = table(spark, d, "customer")
    sources = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("module"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file"), (F.col("c_custkey") % 97).alias("line"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 5).alias("col"))
    return sources, c.where("c_custkey > 2").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 3").alias("dst"))


@query(
    "WITH RECURSIVE e AS (SELECT c_custkey src, c_custkey // 3 dst FROM customer WHERE c_custkey > 2), w AS (SELECT c_custkey node, 0 AS depth FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < 2), "
    "m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), s AS (SELECT node, depth, c_nationkey AS module, c_custkey % 97 AS line, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 5 END col FROM m JOIN customer ON node = c_custkey), "
    "x AS (SELECT *, (sum(2 ** greatest(0, 30 - 5 * depth)) OVER (PARTITION BY module))::bigint module_score FROM s), t AS (SELECT *, row_number() OVER (ORDER BY module_score DESC, module, line NULLS LAST, col NULLS LAST, node) k FROM x) "
    "SELECT node, depth, module, module_score FROM t WHERE k BETWEEN 6 AND 35"
)
def definitions_page(spark: SparkSession, d: str) -> DataFrame:
    sources, edges = _customers(spark, d)
    roots = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node"))
    return definitions.get_definitions(roots, edges, sources, "recursive", skip=5, most=400)[0].select("node", "depth", "module", "module_score")


@query("SELECT c_nationkey AS name, list_sort(list(DISTINCT c_mktsegment))::varchar AS vals FROM customer WHERE c_custkey % 37 = 0 OR c_nationkey < 3 GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def index_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_custkey % 37 = 0 or c_nationkey < 3").select(F.col("c_nationkey").alias("name"), F.col("c_mktsegment").alias("def_id"))
    return definitions.index_conflicts(c, "name", "def_id").select("name", F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("vals"))


@query(
    "WITH o AS (SELECT DISTINCT l_orderkey def_id, l_linenumber binder, l_partkey target FROM lineitem), i AS (SELECT o_orderkey def_id, 1 binder, o_custkey target FROM orders), r AS (SELECT DISTINCT l_orderkey def_id, l_linenumber AS name FROM lineitem WHERE l_linenumber <= 2), u AS (SELECT * FROM o UNION SELECT * FROM i) "
    "SELECT def_id, binder, target FROM u UNION SELECT u.def_id, r.name, u.target FROM u JOIN r ON u.def_id = r.def_id"
)
def owner_dependencies(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    owned = li.select(F.col("l_orderkey").alias("def_id"), F.col("l_linenumber").alias("binder"), F.col("l_partkey").alias("target"))
    used = table(spark, d, "orders").select(F.col("o_orderkey").alias("def_id"), F.lit(1).alias("binder"), F.col("o_custkey").alias("target"))
    return definitions.owner_dependencies(owned, used, li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("def_id"), F.col("l_linenumber").alias("name")).distinct())


@query(
    "WITH o AS (SELECT l_orderkey file, l_linenumber AS name, l_partkey s, l_partkey + 3 e FROM lineitem), p AS (SELECT l_orderkey file, l_linenumber def_id, l_suppkey s, l_suppkey * 25 e FROM lineitem) "
    "SELECT DISTINCT p.file * 10 + def_id def_id, name, o.s, o.e FROM o JOIN p ON o.file = p.file AND p.s <= o.s AND o.e <= p.e WHERE name <> def_id"
)
def occurrence_facts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    f, n = F.col("l_orderkey").alias("file"), F.col("l_linenumber")
    occurrences = li.select(f, n.alias("name"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + 3).alias("e"))
    own = li.select(f, (F.col("l_orderkey") * 10 + n).alias("def_id"), F.col("l_suppkey").alias("s"), (F.col("l_suppkey") * 25).alias("e"), n.alias("name"))
    return definitions.occurrence_facts(occurrences, own.drop("name"), own.select("def_id", "name").distinct())


@query(
    "WITH w AS (SELECT p_partkey AS name FROM part WHERE p_brand = 'Brand#3'), h AS (SELECT DISTINCT l_orderkey def_id, l_linenumber s, l_partkey FROM lineitem WHERE l_partkey IN (FROM w)) SELECT def_id, count(*) hits, sum(l_partkey * s)::bigint mix FROM h GROUP BY 1"
)
def hits_by_definition(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("def_id"), F.col("l_linenumber").alias("s"), F.col("l_linenumber").alias("e"))
    names = table(spark, d, "part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("name"))
    modules = definitions.modules_to_search(names, index.select("name", F.col("def_id").alias("module")))
    pruned = index.join(modules.withColumnRenamed("module", "def_id"), "def_id", "left_semi")
    m = definitions.matches_by_definition(names, pruned)
    return m.select("def_id", F.size("hits").cast("long").alias("hits"), F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["name"] * x["s"]).alias("mix"))


@query(
    "WITH c AS (SELECT o_custkey symbol, o_orderkey AS name, o_orderstatus occ, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) place, o_orderpriority al FROM orders) "
    "SELECT symbol, name, CASE WHEN occ = 'F' THEN 0 ELSE 1 END AS by, place FROM c WHERE occ = 'F' OR al = '1-URGENT'"
)
def root_chains(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    chains = o.select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("occ"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("place"))
    aliases = o.select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise("none").alias("alias"))
    return definitions.root_chain(chains, "F", aliases)


_CTX = "r AS (SELECT l_orderkey file, l_orderkey * 10 + l_linenumber ref, l_partkey + 5 s, l_partkey + 9 e FROM lineitem), g AS (SELECT l_orderkey file, l_linenumber region, l_partkey s, l_partkey + l_suppkey * 9 e, l_suppkey % 3 lines, CASE l_linenumber % 3 WHEN 0 THEN 'application' WHEN 1 THEN 'record' ELSE 'let' END kind FROM lineitem)"


@query(
    f"WITH {_CTX}, p AS (SELECT ref, region, kind, lines > 1 AND kind <> 'let' wide, g.e - g.s AS size FROM r JOIN g ON r.file = g.file AND g.s <= r.s AND r.e <= g.e AND (g.s <> r.s OR g.e <> r.e)) "
    "SELECT ref, arg_min(region, (CASE WHEN wide THEN 0 ELSE 1 END, CASE WHEN wide THEN -size ELSE size END, kind, region)) region FROM p GROUP BY ref"
)
def reference_contexts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    f, n, p = F.col("l_orderkey").alias("file"), F.col("l_linenumber"), F.col("l_partkey")
    refs = li.select(f, (F.col("l_orderkey") * 10 + n).alias("ref"), (p + 5).alias("s"), (p + 9).alias("e"))
    kind = F.when(n % 3 == 0, "application").when(n % 3 == 1, "record").otherwise("let")
    return definitions.best_context(refs, li.select(f, n.alias("region"), p.alias("s"), (p + F.col("l_suppkey") * 9).alias("e"), (F.col("l_suppkey") % 3).alias("lines"), kind.alias("kind")))


_SNIP = (
    "x AS (SELECT l_orderkey def_id, l_linenumber * 6 rs, l_linenumber * 6 + l_suppkey % 2 re, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber * 6 - 1 END cs, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber * 6 + l_suppkey % 14 END ce FROM lineitem), "
    "c AS (SELECT def_id, CASE WHEN ce - cs + 1 <= 10 THEN cs ELSE rs END s, CASE WHEN ce - cs + 1 <= 10 THEN ce ELSE re END e FROM x UNION SELECT def_id, 1, 2 FROM x UNION SELECT def_id, 60, 60 FROM x)"
)


@query(
    f"WITH {_SNIP}, m AS (SELECT *, max(e) OVER (PARTITION BY def_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM c), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY def_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM m) "
    "SELECT def_id, min(s)::bigint s, max(e)::bigint e FROM g GROUP BY def_id, k"
)
def snippet_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n, k = F.col("l_linenumber") * 6, F.col("l_suppkey")
    refs = li.select(F.col("l_orderkey").alias("def_id"), n.alias("rs"), (n + k % 2).alias("re"), F.when(k % 3 > 0, n - 1).alias("cs"), F.when(k % 3 > 0, n + k % 14).alias("ce"))
    return definitions.snippet_ranges(refs, refs.select("def_id").distinct().withColumn("lines", F.lit(60).cast("long")), "medium")


@query("SELECT o_custkey request, min(o_orderstatus) AS module, count(DISTINCT o_orderkey % 100) slices FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def merged_slices(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderstatus").alias("module"), (F.col("o_orderkey") % 100).alias("s"), (F.col("o_orderkey") % 100 + 1).alias("e"))
    return definitions.merge_slices(o).withColumn("slices", F.size("slices").cast("long"))


@query(
    "WITH m AS (SELECT o_custkey root, min({'d': o_orderkey % 7, 'k': o_orderkey}) b FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT root, b.k AS symbol, b.d::int steps FROM m ORDER BY root LIMIT 25 OFFSET 10"
)
def symbol_infos(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("symbol"), (F.col("o_orderkey") % 7).cast("int").alias("steps"))
    return lookup.symbol_info(m, 10, 25)[0]


@query(
    "WITH q AS (SELECT unnest(['large widget', 'no such part', 'small gear']) query), r AS (SELECT query, p_brand FROM q LEFT JOIN part ON p_name = query) "
    "SELECT query, CASE count(DISTINCT p_brand) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END status, NULL::varchar root, CASE WHEN count(DISTINCT p_brand) > 1 THEN array_to_string(list_sort(list(DISTINCT p_brand) FILTER (p_brand IS NOT NULL))[1:5], ',') ELSE '' END hints FROM r GROUP BY query"
)
def resolve_all_or_none(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([("large widget",), ("no such part",), ("small gear",)], "query string")
    found = q.join(table(spark, d, "part").select("p_name", F.col("p_brand").alias("root")), F.col("query") == F.col("p_name"), "left").select("query", "root")
    return lookup.resolve_all(found).withColumn("hints", F.array_join("hints", ","))


@query("SELECT DISTINCT l_orderkey instance FROM lineitem WHERE l_partkey = 7")
def associated_instances(spark: SparkSession, d: str) -> DataFrame:
    return lookup.associated_instances(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance"), F.col("l_partkey").alias("name")), 7)


@query(
    "WITH r AS (SELECT l_partkey AS module, l_orderkey * 10 + l_linenumber seq, l_suppkey component, l_suppkey % 4 IN (1, 2) test, l_suppkey % 2 = 0 o FROM lineitem WHERE l_linenumber = 1), f AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY seq) n FROM r), "
    "a AS (SELECT * FROM f WHERE n = 1), b AS (SELECT * FROM f WHERE n = 2), j AS (SELECT a.module, a.component ac, b.component bc, a.test ta, b.test tb, a.o oa, b.o ob FROM a LEFT JOIN b ON a.module = b.module) "
    "SELECT module, CASE WHEN oa <> ob AND ta AND NOT tb THEN bc ELSE ac END component, coalesce(oa <> ob AND NOT ta AND NOT tb, false) AS conflict FROM j"
)
def merged_options(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey") % 4
    li = table(spark, d, "lineitem").where("l_linenumber = 1").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    two = li.withColumn("n", F.row_number().over(Window.partitionBy("l_partkey").orderBy("seq"))).where("n <= 2")
    rows = two.select(F.col("l_partkey").alias("module"), "seq", F.col("l_suppkey").alias("component"), F.when(k.isin(1, 2), "test").otherwise("library").alias("kind"), (F.col("l_suppkey") % 2 == 0).cast("string").alias("options"))
    return lookup.merge_options(rows).select("module", "component", "conflict")


@query(
    "WITH p AS (SELECT DISTINCT n_nationkey package FROM nation), c AS (SELECT s_nationkey package, list_sort(list(DISTINCT 'u' || s_suppkey)) u FROM supplier WHERE s_suppkey % 9 = 0 GROUP BY 1), k AS (SELECT s_nationkey package, list_sort(list(DISTINCT 'u' || s_suppkey)) u FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1) "
    "SELECT package::varchar package, CASE WHEN c.u IS NOT NULL THEN 'resolved' WHEN k.u IS NULL THEN 'missing' WHEN len(k.u) = 1 THEN 'resolved' ELSE 'ambiguous' END status, array_to_string(coalesce(c.u, k.u, []), ',') units FROM p LEFT JOIN c USING (package) LEFT JOIN k USING (package)"
)
def package_environment(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("package"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("unit"), "s_suppkey")
    r = project.resolve_environment(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("package")), s.where("s_suppkey % 9 = 0"), s.where("s_suppkey % 4 = 0"))
    return r.withColumn("units", F.array_join("units", ","))


_PLAN = "c AS (SELECT DISTINCT c_nationkey component, c_mktsegment AS option FROM customer WHERE c_custkey % 12 < 7 OR c_mktsegment = 'HOUSEHOLD'), k AS (SELECT option FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT component) FROM c))"


@query(f"WITH {_PLAN} SELECT 'common' AS module, NULL::int component, option FROM k UNION ALL SELECT DISTINCT n_name, component, option FROM nation JOIN c ON n_nationkey = component WHERE option NOT IN (FROM k)")
def component_options(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_custkey % 12 < 7 or c_mktsegment = 'HOUSEHOLD'").select(F.col("c_nationkey").alias("component"), F.col("c_mktsegment").alias("option")).distinct()
    common, own = project.component_plan(c, table(spark, d, "nation").select(F.col("n_name").alias("module"), F.col("n_nationkey").alias("component")))
    return common.select(F.lit("common").alias("module"), F.lit(None).cast("int").alias("component"), "option").union(own)


@query("WITH l AS (SELECT p_name AS module FROM part WHERE p_size <= 3) SELECT p_name AS module, list_sort(list(DISTINCT p_type))::varchar kinds, bool_or(p_size = 1) entry FROM part WHERE p_name IN (FROM l) GROUP BY 1")
def loaded_modules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    got, _ = project.loaded_modules(p.select(F.col("p_brand").alias("component"), F.col("p_type").alias("kind"), F.col("p_name").alias("module"), (F.col("p_size") == 1).alias("main")), p.where("p_size <= 3").select(F.col("p_name").alias("module")))
    return got.withColumn("kinds", F.concat(F.lit("["), F.array_join("kinds", ", "), F.lit("]")))


@query("SELECT n_name manifest, n_nationkey package, list_sort(list(DISTINCT c_mktsegment))::varchar components, row_number() OVER (ORDER BY n_name) place FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2")
def project_packages(spark: SparkSession, d: str) -> DataFrame:
    r = project.discover(table(spark, d, "nation").select(F.col("n_name").alias("manifest"), F.col("n_nationkey").alias("package")), table(spark, d, "customer").select(F.col("c_nationkey").alias("package"), F.col("c_mktsegment").alias("component")))
    return r.select("manifest", "package", F.concat(F.lit("["), F.array_join("components", ", "), F.lit("]")).alias("components"), F.row_number().over(Window.orderBy("manifest")).cast("long").alias("place"))


@query(
    "WITH x AS (SELECT conv_id session, conv_id id, min(turn) + 1 s, max(turn) - 1 e FROM conversations GROUP BY 1), t AS (SELECT x.session, sum(length(coalesce(text, '')) + 2) n, any_value(session) z FROM x JOIN conversations ON conv_id = x.session AND turn BETWEEN s AND e GROUP BY 1) "
    "SELECT x.session, ceil(greatest(coalesce(n, 0) - 2, 0) / 4.0)::bigint original, ceil(x.session % 50 / 4.0)::bigint replacement FROM x LEFT JOIN t ON x.session = t.session"
)
def recovery_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    ranges = c.groupBy(F.col("conv_id").alias("session")).agg((F.min("turn") + 1).alias("s"), (F.max("turn") - 1).alias("e")).withColumns({"id": F.col("session"), "replacement": F.repeat(F.lit("x"), (F.col("session") % 50).cast("int"))})
    return sessions.recovery_tokens(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text"), ranges).drop("id")


@query(
    "WITH o AS (SELECT user_id session, event_id seq, event_type IN ('click', 'view') re, event_type IN ('purchase', 'signup') te, event_type IN ('view', 'signup') ok FROM events WHERE event_type <> 'error'), "
    "p AS (SELECT session, arg_max(NOT ok AND re, seq) FILTER (re OR (te AND ok)) c, arg_max(NOT ok, seq) FILTER (te) t, bool_or(NOT ok) f FROM o GROUP BY 1) "
    "SELECT session, CASE WHEN NOT f THEN 'inactive' WHEN coalesce(c, false) OR coalesce(t, false) THEN 'active' ELSE 'readyToFinalize' END state FROM p"
)
def recovery_states(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    o = table(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(t.isin("click", "view"), "reloadHomeModules").when(t.isin("purchase", "signup"), "runTestSuite").otherwise("other").alias("tool"), t.isin("view", "signup").alias("success"))
    return sessions.recovery_state(o)


@query("SELECT p_partkey, p_size additions, p_size % 3 deletions, left(p_name, 5) || CASE WHEN length(p_name) > 5 THEN chr(10) || chr(10) || '[Patch excerpt truncated. Full patch retained in recovery artifacts.]' ELSE '' END excerpt FROM part")
def patch_lines(spark: SparkSession, d: str) -> DataFrame:
    patch = F.concat(F.lit("--- a/x\n+++ b/x\n same\n"), F.repeat(F.concat(F.lit("+"), F.col("p_name"), F.lit("\n")), "p_size"), F.repeat(F.lit("-old\n"), (F.col("p_size") % 3).cast("int")))
    return table(spark, d, "part").select("p_partkey", sessions.line_changes(patch).alias("c"), sessions.excerpt(F.col("p_name"), 5).alias("excerpt")).select("p_partkey", "c.additions", "c.deletions", "excerpt")


@query("SELECT 'c' || event_id call_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'in-' || event_type END AS name FROM events")
def nested_calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    part = lambda name: F.to_json(F.array(F.struct(F.lit("toolCall").alias("type"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), name.alias("name"))))
    inner = F.to_json(F.array(F.struct(F.lit("group").alias("type"), part(F.concat(F.lit("in-"), "event_type")).alias("content"))))
    return sessions.call_names(e.select(F.col("event_id").alias("seq"), F.lit("assistant").alias("role"), F.when(F.col("event_id") % 2 == 0, part(F.col("event_type"))).otherwise(inner).alias("content")))


@query("SELECT p_brand AS version, p_type platform, p_name arch, p_size::varchar libc FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_assets(spark: SparkSession, d: str) -> DataFrame:
    return sessions.manifest_problems(table(spark, d, "part").select(F.col("p_brand").alias("version"), F.col("p_type").alias("platform"), F.col("p_name").alias("arch"), F.col("p_size").cast("string").alias("libc")))


_DIRS = "u AS (SELECT regexp_replace(url, '^https?://', '') p FROM pages), e AS (SELECT p path, false is_dir, regexp_replace(p, '/[^/]+$', '') dir FROM u)"


@query(f"WITH {_DIRS} SELECT CASE WHEN contains(path, '/') THEN dir ELSE '.' END dir, 0::bigint directories, count(*) files FROM (SELECT DISTINCT * FROM e) WHERE path NOT LIKE '%.html' GROUP BY 1")
def left_out(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), F.lit(False).alias("is_dir")).distinct()
    return tree.omissions(e, e.where("path like '%.html'").select("path"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 4 WHEN p_size % 5 = 1 THEN 0 ELSE 1 END focus, CASE WHEN p_size % 5 = 0 THEN 4 WHEN p_size % 5 IN (1, 2) THEN 1 ELSE 2 END category, p_size % 5 <> 0 AND (p_size % 5 = 1) open FROM part"
)
def directory_priorities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 5
    path = F.concat(F.when(k == 1, "focus/").otherwise("other/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(k.isin(1, 2), "/Src").when(k == 4, "/.git").otherwise("/x"))
    e = table(spark, d, "part").select("p_partkey", path.alias("path"), (k != 0).alias("is_dir"))
    o = tree.open_priority(e, ["focus"]).withColumn("open", F.col("is_dir") & tree.should_open(F.col("path"), F.lit(False), ["focus"]))
    return o.select("p_partkey", "key.focus", "key.category", "open")
