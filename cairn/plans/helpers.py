"""Scalar operators, diagnostics and edits over the test tables, beside the SQL that must agree with them.

Where a text is built from columns, its SQL computes the expected result from those columns, not by parsing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timing, units, words
from ..operators import diagnostics
from ..tables import table
from .queries import query


@query(
    "SELECT o_orderkey, printf('%.2f MiB', o_custkey * 1000003 / 1048576.0) mib, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END || printf('%.2f MiB', o_custkey * 1000003 / 1048576.0) signed, "
    "CASE WHEN b >= 1073741824 THEN printf('%.2fGiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.2fMiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2fKiB', b / 1024.0) ELSE b || 'B' END AS size, "
    "printf('%.1f%%', o_custkey / 70007.0 * 100) share, printf('%.2fs', o_custkey / 7.0) AS seconds FROM (SELECT *, o_custkey * o_custkey * (o_orderkey % 2003) + 1 b FROM orders WHERE o_custkey > 0)"
)
def units_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey > 0")
    n, c = F.col("o_custkey") * 1000003, F.col("o_custkey")
    return o.select("o_orderkey", units.mebibytes(n).alias("mib"), units.signed_mebibytes(F.when(c % 2 == 0, n).otherwise(-n)).alias("signed"), units.bytes_text(c * c * (F.col("o_orderkey") % 2003) + 1).alias("size"), units.percent_text(c / 70007.0).alias("share"), units.seconds_text(c / 7.0).alias("seconds"))


@query(
    "SELECT p_partkey, upper(replace(p_name, ' ', '_')) || '_' || p_size || '_' || upper(p_type) AS variable, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END flag, "
    "'''' || replace(p_name, ' ', '''\\''''') || '''' single, '\"' || p_type || '\\$' || p_size || '\\\"' || '\"' AS dbl, 'run ' || '''' || replace(p_name, ' ', '''\\''''') || '''' || ' ' || p_size || '@{other}' command FROM part"
)
def shell_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    quoted = F.replace("p_name", F.lit(" "), F.lit("'"))
    name = F.concat(F.lit("--"), F.replace("p_name", F.lit(" "), F.lit(".")), F.col("p_size").cast("string"), F.lower("p_type"))
    flag = F.element_at(F.array(F.lit(" Yes"), F.lit("off"), F.lit("1"), F.lit("maybe"), F.lit("2")), F.col("p_size") % 5 + 1)
    command = words.substitute(F.lit("run @{name} @{size}@{other}"), [("name", quoted, "single", False), ("size", F.col("p_size").cast("string"), "none", True)])
    return p.select("p_partkey", words.snake_upper(name).alias("variable"), words.truth(flag).alias("flag"), words.single_quoted(quoted).alias("single"), words.double_quoted(F.concat("p_type", F.lit("$"), "p_size", F.lit('"'))).alias("dbl"), command.alias("command"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'single_quote' WHEN p_size % 4 = 1 THEN 'trailing_escape' END problem, "
    "CASE WHEN p_size % 4 >= 2 THEN string_split(p_name, ' ')[1] || '|' || p_name || ' ' || p_type || '|' || p_type || ' ' || p_size || p_brand || '|' END words FROM part"
)
def argument_words(spark: SparkSession, d: str) -> DataFrame:
    first = F.element_at(F.split("p_name", " "), 1)
    end = F.when(F.col("p_size") % 4 == 0, " 'open").when(F.col("p_size") % 4 == 1, ' "x\\').otherwise(" ''")
    text = F.concat(first, F.lit("\t\""), "p_name", F.lit(" "), "p_type", F.lit("\" "), "p_type", F.lit("\\ "), "p_size", F.lit("'"), "p_brand", F.lit("'"), end)
    return table(spark, d, "part").select("p_partkey", words.unclosed(text).alias("problem"), F.array_join(words.arguments(text), "|").alias("words"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'whole' ELSE 'names' END issue, CASE WHEN p_size % 4 >= 2 THEN p_name || ':|' || p_type || '(' || p_brand || ', (b, c)):type|Pat:pattern' END names FROM part"
)
def import_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    listed = F.concat(F.lit("The import of ‘"), "p_name", F.lit(", type "), "p_type", F.lit("("), "p_brand", F.lit(", (b, c)), pattern Pat’\n   from module ‘M’ is redundant"))
    message = F.when(k == 0, F.concat(F.lit("Defined but not used: "), "p_name")).when(k == 1, F.concat(F.lit("The qualified import of ‘"), "p_brand", F.lit("’ is redundant"))).otherwise(listed)
    shown = F.array_join(F.transform("r.names", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["namespace"], F.lit("")))), "|")
    return table(spark, d, "part").select("p_partkey", T.redundant_import(message).alias("r")).select("p_partkey", F.col("r.issue").alias("issue"), shown.alias("names"))


_DUMPS = (
    "f AS (SELECT user_id, event_type, ts, count(*) n, sum(CASE event_id % 5 WHEN 0 THEN value / 1000 WHEN 1 THEN value WHEN 2 THEN event_id % 90 * 0.001 WHEN 3 THEN 0 ELSE value END) sec, "
    "sum(CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN 1500 + event_id % 1000 WHEN 3 THEN 2048 * (event_id % 9) ELSE 0 END)::bigint bytes FROM (SELECT * EXCLUDE (ts), date_trunc('month', ts) ts FROM events) GROUP BY ALL)"
)


@query(
    f"WITH {_DUMPS}, l AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'dyn' WHEN 'click' THEN 'profiling' ELSE event_type END v, arg_max({{'sec': sec, 'bytes': bytes}}, (ts, sec)) x FROM f WHERE event_type IN ('view', 'click') AND (sec > 0 OR bytes > 0) GROUP BY ALL) "
    "SELECT 'Mod.M' || user_id AS module, round(sum(x.sec), 6) AS seconds, sum(x.bytes)::bigint bytes, count(*) variants FROM l GROUP BY user_id"
)
def timing_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('view', 'click')").withColumn("modified", F.date_trunc("month", "ts"))
    value, i = F.col("value").cast("string"), F.col("event_id")
    line = F.element_at(F.array(
        F.concat(F.lit("pass Alpha time="), value, F.lit(", alloc="), i.cast("string")), F.concat(F.lit("took "), value, F.lit(" seconds and allocated=1,"), (500 + i % 1000).cast("string"), F.lit("bytes;")),
        F.concat(F.lit("("), (i % 90).cast("string"), F.lit(" milliseconds)")), F.concat(F.lit("heap "), (2 * (i % 9)).cast("string"), F.lit(" kb, 10s")), F.concat(F.lit("elapsed="), value, F.lit("s")),
    ), (i % 5 + 1).cast("int"))
    line = F.when(i % 5 == 1, F.concat(F.lit("took "), value, F.lit(" seconds and allocated="), F.format_string("%,d", 1500 + i % 1000), F.lit("bytes;"))).otherwise(line)
    path = F.concat(F.lit("out.dyn.d/"), F.date_format("modified", "yyyyMM"), F.lit("/Mod.M"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "view", ".dyn").otherwise(".p"), F.lit(".dump-timings"))
    m = diagnostics.compile_metrics(e.select(path.alias("path"), "modified", i.alias("line_no"), line.alias("line")))
    return m.select("module", F.round("seconds", 6).alias("seconds"), "bytes", "variants")


@query(
    "WITH k AS (SELECT user_id, bool_or(event_type = 'error') e, bool_or(event_type = 'click') c, bool_or(event_type = 'signup') s, bool_or(event_type = 'purchase') p FROM events GROUP BY ALL) "
    "SELECT user_id, concat_ws(',', CASE WHEN e THEN 'block' END, CASE WHEN e THEN 'import' END, CASE WHEN c THEN 'annotate' END, CASE WHEN c THEN 'monad' END, CASE WHEN s THEN 'show' END, CASE WHEN p THEN 'shadow' END, CASE WHEN p THEN 'rename' END) hints FROM k"
)
def hints(spark: SparkSession, d: str) -> DataFrame:
    said = F.create_map(*(F.lit(x) for kv in {"error": "parse error on input `import'", "click": "Ambiguous type variable m0", "signup": "No instance for (Show a)", "purchase": "x is already in scope", "view": "where are you"}.items() for x in kv))
    m = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.coalesce(said[F.col("event_type")], F.lit("other"))).alias("m"))
    return m.select("user_id", F.array_join(diagnostics.execution_hints(F.col("m")), ",").alias("hints"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Info' ELSE 'Diagnostic' END title FROM events")
def severity_titles(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "info").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", diagnostics.severity_title(name).alias("title"))


@query("SELECT conv_id, turn, ceil((length(coalesce(text, '')) + 2 * (turn % 4)) / 4.0)::bigint tokens FROM conversations")
def utf16_tokens(spark: SparkSession, d: str) -> DataFrame:
    more = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("\U0001f600"), (F.col("turn") % 4).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.estimate_tokens(more).alias("tokens"))


@query("SELECT event_id, '{\"a\":' || replace(props, ' ', '') || ',\"t\":[\"' || event_type || '\",1],\"z\":' || event_id || '}' AS doc FROM events")
def stable_documents(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"z": '), F.col("event_id").cast("string"), F.lit(', "a": '), "props", F.lit(', "t": ["'), "event_type", F.lit('", 1]}'))
    return table(spark, d, "events").select("event_id", words.stable_stringify(text).alias("doc"))


_EDITS = (
    "e AS (SELECT DISTINCT l_partkey file, l_linenumber * 2 + l_orderkey % 3 s, l_linenumber * 2 + l_orderkey % 3 + l_suppkey % 4 - 1 e, l_returnflag put, CASE WHEN l_suppkey % 3 = 0 THEN ' ' END expected FROM lineitem), "
    "j AS (SELECT e.*, p_name, CASE WHEN s > e OR e > length(p_name) THEN 'invalid' WHEN expected IS NOT NULL AND substr(p_name, s + 1, e - s) <> expected THEN 'stale' END warning FROM e JOIN part ON file = p_partkey), "
    "gg AS (SELECT row_number() OVER () k, file, s, e, put FROM j WHERE warning IS NULL), "
    "c AS (SELECT DISTINCT a.k FROM gg a JOIN gg b ON a.file = b.file AND a.k <> b.k AND ((a.s = b.s AND a.e = b.e) OR (a.s < b.e AND b.s < a.e)))"
)


@query(f"WITH {_EDITS} SELECT file, s, e, put AS text FROM gg WHERE k NOT IN (SELECT k FROM c)")
def edits_kept(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d)[0].withColumns({"s": F.col("s").cast("long"), "e": F.col("e").cast("long")})


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = (F.col("l_linenumber") * 2 + F.col("l_orderkey") % 3).cast("int")
    expected = F.when(F.col("l_suppkey") % 3 == 0, " ")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), s.alias("s"), (s + F.col("l_suppkey") % 4 - 1).cast("int").alias("e"), F.col("l_returnflag").alias("text"), expected.alias("expected"))
    return diagnostics.valid_edits(table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("text")), e)


@query(f"WITH {_EDITS} SELECT warning, count(*) n FROM (SELECT warning FROM j WHERE warning IS NOT NULL UNION ALL SELECT 'conflict' FROM c) GROUP BY warning")
def edit_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d)[1].groupBy("warning").agg(F.count("*").alias("n"))


@query(
    f"WITH {_EDITS}, k AS (SELECT * FROM gg WHERE k NOT IN (SELECT k FROM c)), p AS (SELECT file, put || substr(p_name, e + 1, coalesce(lead(s) OVER (PARTITION BY file ORDER BY s, e), 100000) - e) piece, s, e FROM k JOIN part ON file = p_partkey) "
    "SELECT p_partkey file, coalesce(left(p_name, min(s)::int) || string_agg(piece, '' ORDER BY s, e), p_name) AS text FROM part LEFT JOIN p ON file = p_partkey GROUP BY p_partkey, p_name"
)
def edits_applied(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("l_linenumber") * 2 + F.col("l_orderkey") % 3).cast("int")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), s.alias("s"), (s + F.col("l_suppkey") % 4 - 1).cast("int").alias("e"), F.col("l_returnflag").alias("text"), F.when(F.col("l_suppkey") % 3 == 0, " ").alias("expected"))
    return diagnostics.apply_edits(table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("text")), e)


@query(
    "SELECT l_orderkey seq, l_linenumber + i AS line, i >= 0 marked, CASE WHEN i >= 0 THEN repeat(' ', CASE WHEN i = 0 THEN l_suppkey % 5 ELSE 0 END::int) || repeat('^', greatest(1, CASE WHEN i = 1 THEN 3 ELSE l_linenumber + i + 2 END - CASE WHEN i = 0 THEN l_suppkey % 5 + 1 ELSE 1 END)::int) END carets "
    "FROM lineitem, (SELECT unnest([-2, -1, 0, 1]) i) WHERE l_linenumber + i BETWEEN 1 AND 8 AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)"
)
def snippet_carets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    one = li.join(li.groupBy("l_orderkey").count().where("count = 1"), "l_orderkey", "left_semi")
    diags = one.select(F.col("l_orderkey").alias("seq"), F.lit("f").alias("file"), F.col("l_linenumber").alias("sl"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("sc"), (F.col("l_linenumber") + 1).alias("el"), F.lit(3).alias("ec"))
    lines = spark.range(1, 9).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line"), F.repeat(F.lit("x"), (F.col("id") + 1).cast("int")).alias("text"))
    return diagnostics.snippets(diags, lines).select("seq", "line", "marked", "carets")
