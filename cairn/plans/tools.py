"""Graph, span, session, project and definition operators over the test tables, beside the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, sessions, spans
from ..tables import table
from .queries import _MODULES, _modules, query


def _s(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query(
    "WITH r AS (SELECT 'r' || r_regionkey node, 0 AS depth, row_number() OVER (ORDER BY r_name DESC) place, r_regionkey k FROM region), "
    "n AS (SELECT 'n' || n_nationkey node, 1 AS depth, row_number() OVER (ORDER BY place, n_name) place, n_nationkey k FROM nation JOIN r ON n_regionkey = k), "
    "c AS (SELECT 'c' || c_custkey node, 2 AS depth, row_number() OVER (ORDER BY place, c_custkey DESC) place FROM customer JOIN n ON c_nationkey = k) SELECT node, depth, place FROM r UNION ALL SELECT node, depth, place FROM n UNION ALL SELECT node, depth, place FROM c"
)
def walk_order(spark: SparkSession, d: str) -> DataFrame:
    rank = lambda *order: F.row_number().over(Window.orderBy(*order))
    roots = table(spark, d, "region").select(_s("r", "r_regionkey").alias("node"), rank(F.desc("r_name")).alias("ord"))
    n = table(spark, d, "nation").select(_s("r", "n_regionkey").alias("src"), _s("n", "n_nationkey").alias("dst"), rank("n_name").alias("ord"))
    c = table(spark, d, "customer").select(_s("n", "c_nationkey").alias("src"), _s("c", "c_custkey").alias("dst"), (-F.col("c_custkey")).cast("int").alias("ord"))
    return graph.walk(roots, n.union(c), 2).withColumn("place", F.col("place").cast("long"))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT s_suppkey src, s_suppkey + 1 dst FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey, s_suppkey - 3 FROM supplier WHERE s_suppkey % 5 = 0) WHERE dst IN (SELECT s_suppkey FROM supplier)), "
    "w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src), m AS (SELECT a.src node, min(a.dst) m FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) "
    "SELECT s_suppkey node, least(s_suppkey, coalesce(m, s_suppkey)) component FROM supplier LEFT JOIN m ON node = s_suppkey"
)
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    k = F.col("node")
    e = s.where(k % 7 != 0).select(k.alias("src"), (k + 1).alias("dst")).union(s.where(k % 5 == 0).select(k, k - 3))
    return graph.components_of(e.join(s.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), s)


@query(
    f"WITH {_MODULES}, o AS (SELECT arg_max('o' || o_orderkey, (round(o_totalprice / 1e5, 9), -o_orderkey)) b, max(o_totalprice / 1e5) s FROM orders), x AS (SELECT o_custkey, c_nationkey, n_regionkey, b, s FROM o JOIN orders ON b = 'o' || o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT unnest([0, 1, 2, 3])::int place, unnest([b, 'c' || o_custkey, 'n' || c_nationkey, 'r' || n_regionkey]) component, round(unnest([s, 1, 1, 1]), 6) AS seconds, round(unnest([s + 3, 3, 2, 1]), 6) AS depth FROM x"
)
def critical_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.critical_path(*_modules(spark, d)).withColumns({"seconds": F.round("seconds", 6), "depth": F.round("depth", 6)})


@query(
    "WITH m AS (SELECT c_mktsegment c, abs(c_acctbal) / 1000 s FROM customer), e AS (SELECT c, count(*) + 30 modules, sum(s) + 30 tw, max(s) + 2 cp FROM m GROUP BY c), a AS (SELECT c, modules, tw, cp FROM e UNION ALL SELECT NULL, sum(modules), sum(tw), max(cp) FROM e) "
    "SELECT c component, modules::bigint modules, round(tw, 4) total_work, round(cp, 4) critical_path, round(tw / 8, 4) ideal, round(greatest(cp, tw / 8), 4) bound, round(tw / (8 * greatest(cp, tw / 8)), 6) efficiency FROM a"
)
def component_builds(spark: SparkSession, d: str) -> DataFrame:
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    none = F.lit(None).cast("double")
    nodes = r.select(_s("r", "r_regionkey").alias("node"), none.alias("seconds")).union(n.select(_s("n", "n_nationkey"), none)).union(c.select(_s("c", "c_custkey"), F.abs("c_acctbal") / 1000))
    edges = n.select(_s("n", "n_nationkey").alias("src"), _s("r", "n_regionkey").alias("dst")).union(c.select(_s("c", "c_custkey"), _s("n", "c_nationkey")))
    segments = c.select(F.col("c_mktsegment").alias("component")).distinct()
    shared = segments.crossJoin(F.broadcast(nodes.where("seconds is null").select("node")))  # 30 fixed rows beside each component
    s = graph.build_analysis(c.select(F.col("c_mktsegment").alias("component"), _s("c", "c_custkey").alias("node")).union(shared), nodes, edges, 8)
    return s.select("component", "modules", *(F.round(x, 4).alias(x) for x in ("total_work", "critical_path", "ideal", "bound")), F.round("efficiency", 6).alias("efficiency"))


_KIND = "CASE n_regionkey WHEN 0 THEN 'executable' WHEN 1 THEN 'test' WHEN 2 THEN 'benchmark' ELSE 'library' END"


def _project(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions as components, nations as modules (Region 1 is a test component, and every fifth module is in region 1 too), customers as definitions, each using one of about a third of its key."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    k = F.col("r_regionkey")
    components = table(spark, d, "region").select(k.alias("component"), F.when(k == 0, "executable").when(k == 1, "test").when(k == 2, "benchmark").otherwise("library").alias("kind")).crossJoin(F.broadcast(n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("main_module")))).where("component = n_regionkey").drop("n_regionkey")
    modules = n.select(F.col("n_regionkey").alias("component"), F.col("n_nationkey").alias("module")).union(n.where("n_nationkey % 5 = 0 and n_regionkey <> 1").select(F.lit(1), "n_nationkey"))
    definitions = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("module"), F.when(F.col("c_custkey") % 10 == 0, "main").otherwise("f").alias("name"))
    edges = c.select(F.col("c_custkey").alias("src"), F.expr("(c_custkey + CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 ELSE 7 END) div 3").alias("dst")).join(c.select(F.col("c_custkey").alias("dst")), "dst", "left_semi").select("src", "dst")
    return components, modules, definitions, edges


_PROJECT = (
    f"cm AS (SELECT n_regionkey component, any_value({_KIND}) kind, min(n_nationkey) main_module FROM nation GROUP BY 1), mo AS (SELECT n_regionkey component, n_nationkey AS module FROM nation UNION ALL SELECT 1, n_nationkey FROM nation WHERE n_nationkey % 5 = 0 AND n_regionkey <> 1), "
    "df AS (SELECT c_custkey node, c_nationkey AS module, c_custkey % 10 = 0 main FROM customer), e AS (SELECT * FROM (SELECT c_custkey src, (c_custkey + CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 ELSE 7 END) // 3 dst FROM customer) WHERE dst IN (SELECT c_custkey FROM customer)), "
    "tm AS (SELECT module FROM mo JOIN cm USING (component) GROUP BY module HAVING bool_and(kind = 'test')), rt AS (SELECT DISTINCT node, kind FROM df JOIN (SELECT kind, main_module FROM cm JOIN mo ON cm.component = mo.component AND main_module = mo.module) ON module = main_module WHERE main)"
)


@query(f"WITH {_PROJECT} SELECT node, 'main' AS root FROM rt WHERE kind IN ('executable', 'benchmark') UNION ALL SELECT node, 'test' FROM rt WHERE kind = 'test' UNION ALL SELECT module, 'test module' FROM tm")
def project_roots(spark: SparkSession, d: str) -> DataFrame:
    components, modules, definitions, _ = _project(spark, d)
    main, test = graph.main_roots(components, modules, definitions)
    only = graph.test_only_modules(components, modules).withColumnRenamed("module", "node")
    return main.withColumn("root", F.lit("main")).union(test.withColumn("root", F.lit("test"))).union(only.withColumn("root", F.lit("test module")).select("node", "root"))


_LIVE = (
    f"{_PROJECT}, live AS (SELECT node FROM rt WHERE kind IN ('executable', 'benchmark') UNION SELECT dst FROM live JOIN e ON node = src), tested AS (SELECT node FROM rt WHERE kind = 'test' UNION SELECT dst FROM tested JOIN e ON node = src), "
    "st AS (SELECT node, module, CASE WHEN CASE WHEN module IN (FROM tm) THEN node IN (FROM tested) ELSE node IN (FROM live) END THEN 'alive' WHEN node IN (FROM tested) AND node NOT IN (FROM live) THEN 'test_only' ELSE 'safe_delete' END status FROM df)"
)


def _statuses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    components, modules, definitions, edges = _project(spark, d)
    main, test = graph.main_roots(components, modules, definitions)
    marked = definitions.join(graph.test_only_modules(components, modules).withColumn("test_module", F.lit(True)), "module", "left").fillna(False, ["test_module"])
    return graph.find_dead(marked.select("node", "test_module"), main, test, edges).join(definitions, "node").select("node", "module", "status"), edges


@query(f"WITH RECURSIVE {_LIVE} SELECT node, status FROM st")
def dead_by_component(spark: SparkSession, d: str) -> DataFrame:
    return _statuses(spark, d)[0].select("node", "status")


@query(
    f"WITH RECURSIVE {_LIVE}, x AS (SELECT * FROM st WHERE status = 'test_only' AND module IN (1, 2, 3, 17, 24)) SELECT status, count(*) n, count(DISTINCT node) nodes, 0::bigint late FROM (SELECT * FROM st WHERE status = 'safe_delete' AND module IN (1, 2, 3, 17, 24) UNION ALL FROM x) GROUP BY status"
)
def deletion_order(spark: SparkSession, d: str) -> DataFrame:
    """How many definitions of some modules may go, and how many come after something in their module that they use, cycles of one aside: edges lead to smaller keys, but for the first few."""
    dead, edges = _statuses(spark, d)
    targets = dead.select("module").distinct().where(F.col("module").isin(1, 2, 3, 17, 24))
    r = graph.dead_report(dead.select("node", F.col("module").cast("string").alias("module"), F.col("node").alias("rank"), "status"), edges, targets.select(F.col("module").cast("string").alias("module")))
    used = r.select(F.col("node").alias("dst"), F.col("module").alias("m2"), F.col("position").alias("p2"), F.col("status").alias("s2"))
    late = edges.join(r.withColumnRenamed("node", "src"), "src").join(used, "dst").where("module = m2 and status = s2 and p2 < position and src > dst").groupBy("status").agg(F.count("*").alias("late"))
    return r.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes")).join(late, "status", "left").select("status", "n", "nodes", F.coalesce("late", F.lit(0)).alias("late"))


@query(
    "WITH n AS (SELECT o_custkey def_id, o_orderkey AS name FROM orders), p AS (SELECT o_orderkey AS name, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) parent FROM orders) "
    "SELECT def_id, name FROM n WHERE name NOT IN (SELECT name FROM p WHERE parent IS NOT NULL)"
)
def definition_root_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    parent = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    return graph.root_names(o.select(F.col("o_custkey").alias("def_id"), F.col("o_orderkey").alias("name")), o.select(F.col("o_orderkey").alias("name"), parent.alias("parent")).where("parent is not null"))


_REGIONS = "r AS (SELECT l_orderkey file, l_linenumber id, l_partkey s, l_partkey + l_suppkey * 30 e FROM lineitem)"


@query(f"WITH {_REGIONS}, p AS (SELECT a.file, a.id, arg_min(b.id, (b.e - b.s, b.id)) parent FROM r a JOIN r b ON a.file = b.file AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s GROUP BY ALL) SELECT r.file, r.id, parent FROM r LEFT JOIN p USING (file, id)")
def nested_regions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    regions = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_suppkey") * 30).alias("e"))
    return spans.nest(regions)


@query(
    "WITH l AS (SELECT o_custkey file, o_orderkey AS line, CASE o_orderstatus WHEN 'P' THEN '  ' ELSE o_orderstatus END t FROM orders) SELECT file, line, max(CASE WHEN trim(t) <> '' THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, "
    "min(CASE WHEN trim(t) <> '' THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM l"
)
def filled_neighbours(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")).alias("text"))
    return spans.neighbours(lines).drop("text")


@query(
    "WITH d AS (SELECT l_partkey def_id, l_partkey % 25 AS module, l_partkey % 7 AS line, min(l_linenumber) AS depth FROM lineitem GROUP BY 1), s AS (SELECT *, (sum(2 ** greatest(0, 30 - 5 * depth)) OVER (PARTITION BY module))::bigint ms FROM d) "
    "SELECT def_id, depth, ms module_score, row_number() OVER (ORDER BY ms DESC, module, line, def_id) place FROM s"
)
def ordered_definitions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_partkey")
    r = table(spark, d, "lineitem").select(p.alias("def_id"), (p % 25).alias("module"), (p % 7).alias("line"), F.col("l_linenumber").alias("depth"))
    o = spans.definition_order(r)
    return o.withColumn("place", F.row_number().over(Window.orderBy(F.desc("module_score"), "module", "line", "def_id")).cast("long")).select("def_id", "depth", "module_score", "place")


@query(
    "WITH RECURSIVE r AS (SELECT user_id session, event_id // 3 id, event_id s, event_id + (event_id * 7) % 400 e, ts FROM events WHERE event_type = 'purchase'), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session, id ORDER BY ts) = 1), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s, e, id) k FROM o), g AS (SELECT session, k, id, true kept, e reach FROM n WHERE k = 1 UNION ALL SELECT n.session, n.k, n.id, n.s > g.reach, CASE WHEN n.s > g.reach THEN n.e ELSE g.reach END FROM g JOIN n ON n.session = g.session AND n.k = g.k + 1) "
    "SELECT session, id FROM g WHERE kept"
)
def accepted_ranges(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    r = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("session"), F.expr("event_id div 3").alias("id"), i.alias("s"), (i + (i * 7) % 400).alias("e"), F.col("ts").alias("completed"))
    return sessions.plan_ranges(r).select("session", "id")


@query(
    "WITH m AS (SELECT *, turn BETWEEN 1 AND 2 AND conv_id % 2 = 0 masked FROM conversations), t AS (SELECT CASE WHEN role = 'user' THEN 'ask' ELSE 'tool' || conv_id % 3 END AS name, masked, ceil(length(text) / 4.0) t FROM m WHERE role = 'user' OR conv_id % 3 < 2) "
    "SELECT name, count(*) FILTER (NOT masked) calls, sum(CASE WHEN masked THEN 0 ELSE t END)::bigint tokens, count(*) FILTER (masked) summarised_calls, sum(CASE WHEN masked THEN t ELSE 0 END)::bigint summarised_tokens FROM t GROUP BY name"
)
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    entries = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.when(F.col("role") == "user", "ask").alias("tool"), "text")
    calls = c.where("conv_id % 3 < 2").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.concat(F.lit("tool"), (F.col("conv_id") % 3).cast("string")).alias("name"))
    ranges = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("session")).distinct().withColumns({"s": F.lit(1).cast("long"), "e": F.lit(2).cast("long")})
    u = sessions.usage(entries, calls, ranges)
    return u.select("name", *(F.col(x).cast("long").alias(x) for x in ("calls", "tokens", "summarised_calls", "summarised_tokens")))

