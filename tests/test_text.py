import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import timing, units, words


def one(spark, frame, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(frame(F.col("x"))).collect()]


def test_tokens(spark):
    got = one(spark, T.tokenize, ["createHTTPServer2Go", ">>=", "foo_bar-baz.qux'x", "a", ""])
    assert got == [["create", "http", "server", "go"], [">>="], ["foo", "bar", "baz", "qux"], ["a"], []]


def test_canonical(spark):
    pairs = {"children": "child", "boxes": "box", "queries": "query", "class": "class", "status": "status", "keys": "keys", "users": "user", "analyses": "analysis"}
    assert one(spark, T.canonical, list(pairs)) == list(pairs.values())


def test_osa():
    assert T.osa("teh", "the") == 1 and T.osa("ca", "abc") == 3 and T.osa("", "ab") == 2


@pytest.mark.parametrize(("pattern", "text", "want"), [("Data.*", "Data.Map", True), ("*", "", True), ("A*C", "ABBC", True), ("A*C", "ACB", False), ("data.*", "Data.Map", False), ("A.B", "AxB", False)])
def test_glob(spark, pattern, text, want):
    assert one(spark, lambda c: T.matches_glob(c, pattern), [text]) == [want]


def test_glob_errors():
    for bad in ("",):
        with pytest.raises(ValueError):
            T.glob_regex(bad)
    with pytest.raises(ValueError):
        T.glob_regex("a[b]", path=True)


def test_timings(spark):
    assert one(spark, timing.line_seconds, ["x time=250", "elapsed=2s", "took 3 s", "nothing", "5 milliseconds", "10s", "time=x 4 ms"]) == [0.25, 2.0, 3.0, None, 0.005, None, 0.004]
    assert one(spark, timing.line_bytes, ["alloc 2 kb", "10 bytes", "x", "alloc=12345", "1,234 bytes", "2 kilobytes", "allocated=1.5kb,"]) == [2048, 10, None, 12345, 1234, 2048, 1536]
    assert one(spark, timing.bracket_module, ["a [Alpha] [Zed]", "[1]", "[x y]", "none"]) == ["Alpha", None, None, None]
    assert one(spark, timing.path_variant, ["a.dyn.b/M.timings", "a/M.dyn.dump-timings", "M.p.timings"]) == ["normal", "dyn", "profiling"]



def test_compact(spark):
    assert one(spark, T.compact_diagnostic, ["• bad\n\n  thing\nIn the expression: x\nmore"]) == ["bad thing"]


def test_names(spark):
    r = spark.range(1).select(T.parse_name(F.lit("Data.Map.(!)@Map")).alias("n")).first()["n"]
    assert (r.module, r.occ, r.owner) == ("Data.Map", "!", "Map")


def test_penalty(spark):
    d = spark.createDataFrame([("foo", "Foo"), ("foo", "bar"), ("+", "a")], "a string, b string").select(T.capital_penalty(F.col("a"), F.col("b")))
    assert [r[0] for r in d.collect()] == [0.6, 0.0, 0.0]


def test_osa_is_between_the_classics():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(2))
        assert abs(len(a) - len(b)) <= T.osa(a, b) <= max(len(a), len(b))


def test_units(spark):
    assert one(spark, lambda c: units.bytes_text(c.cast("long")), ["5", "2048", str(3 << 20), str(5 << 30)]) == ["5B", "2.00KiB", "3.00MiB", "5.00GiB"]
    assert one(spark, lambda c: units.signed_mebibytes(c.cast("long")), ["-1048576", "0"]) == ["-1.00 MiB", "+0.00 MiB"]
    assert one(spark, lambda c: units.percent_text(c.cast("double")), ["0.1807"]) == ["18.1%"] and one(spark, lambda c: units.seconds_text(c.cast("double")), ["2.0"]) == ["2.00s"]


def test_units_send_ties_to_the_even_digit(spark):
    assert one(spark, lambda c: units.bytes_text(c.cast("long")), ["693376", "693632", str(9 << 17), None]) == ["677.12KiB", "677.38KiB", "1.12MiB", None]
    assert one(spark, lambda c: units.signed_mebibytes(c.cast("long")), [str(-(1 << 17)), str(3 << 17)]) == ["-0.12 MiB", "+0.38 MiB"]
    assert one(spark, lambda c: units.seconds_text(c.cast("double")), ["0.125", "1.005", "2.675", "-0.001", "0", "1e20", None]) == ["0.12s", "1.00s", "2.68s", "-0.00s", "0.00s", "100000000000000000000.00s", None]
    assert one(spark, lambda c: units.percent_text(c.cast("double")), ["0.0025", "0.0075"]) == ["0.2%", "0.8%"]


def test_units_agree_with_sql_on_ties(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    rows = [(68117, 215), (3904809, 393216), (3904810, 131072), (7, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert sorted(map(tuple, e.queries()["units_text"](spark, str(tmp_path)).collect())) == sorted(db.execute(e.oracle_sql()["units_text"]).fetchall())


def test_arguments(spark):
    texts = ["a b", " x\t'y z' \"\" ", "a\\ b", "pre'mid'post", "'open", 'say "hi', "tail\\", "'tail\\", ""]
    assert one(spark, words.arguments, texts) == [["a", "b"], ["x", "y z", ""], ["a b"], ["premidpost"], None, None, None, None, []]
    assert one(spark, words.unclosed, texts) == [None] * 4 + ["single_quote", "double_quote", "trailing_escape", "trailing_escape", None]


def test_shell_words():
    assert words.shell_words("run 'a b' c\"d  e\\ f \"open q") == ["run", "a b", 'c"d', "e f", "open q"]
    line = words.LineContext("go ")
    assert (line.words, line.current, line.spaced, line.quote) == (["go"], "", True, "") and words.LineContext('"x').quote == '"'


def test_names_and_json(spark):
    assert one(spark, words.snake_upper, ["maxItems2Go", "--a.b c", "HTTPServer"]) == ["MAX_ITEMS_2_GO", "A_B_C", "HTTPSERVER"]
    assert one(spark, words.truth, [" Yes\n", "0", "maybe"]) == [True, False, None]
    assert one(spark, words.stable_stringify, ['{"b": [1, {"d": 2, "c": "é"}], "a": null}', "no"]) == ['{"a":null,"b":[1,{"c":"é","d":2}]}', None]
    assert words.deep_merge({"a": {"x": 1, "y": 2}, "b": [1]}, {"a": {"y": 3}, "b": [2]}) == {"a": {"x": 1, "y": 3}, "b": [2]}
    assert one(spark, lambda c: words.substitute(c, [("n", F.lit("it's"), "single", False), ("m", F.lit('a"$'), "double", False), ("o", F.lit(None).cast("string"), "none", True)]), ["run @{n} @{m}@{o}"]) == ["run 'it'\\''s' \"a\\\"\\$\""]


def test_import_messages(spark):
    messages = ["The import of ‘foo, type Bar(A, B), (,)’ from module ‘M’ is redundant", "The qualified import of ‘Data.X’ is redundant\n except", "The import of `y' from module M is redundant", "Unused x", "The import of ‘foo is redundant"]
    got = one(spark, T.redundant_import, messages)
    assert [(g.issue, [(n.namespace, n.name) for n in g.names or []]) if g else None for g in got] == [("names", [(None, "foo"), ("type", "Bar(A, B)"), (None, "(,)")]), ("whole", []), ("names", [(None, "y")]), None, None]
    assert one(spark, T.split_top_level, ["a,(b,(c,d)),e)", ""]) == [["a", "(b,(c,d))", "e)"], [""]]
    assert one(spark, T.estimate_tokens, ["\U0001f600" * 8, "abcde"]) == [4, 2]
