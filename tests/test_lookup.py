import pytest

from cairn.operators import diagnostics, lookup, references, sessions


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_keys_and_hints(spark):
    s = spark.createDataFrame([(1, "A", "f", ["B"], []), (2, "A", "g", [], ["h", "k"]), (3, "C", "f", [], None)], "symbol int, module string, occ string, exported_from array<string>, aliases array<string>")
    keys = lookup.lookup_keys(s)
    assert rows(keys.select("symbol", "key"), "symbol", "key") == [(1, "f"), (2, "h"), (2, "k"), (3, "f")]
    at = lambda *a, **k: [r[0] for r in rows(lookup.matching(keys, *a, **k).select("symbol"), "symbol")]
    owners = spark.createDataFrame([(3, "T")], "symbol int, owner string")
    assert at("f") == [1, 3] and at("f", "B") == [1] and at("f", "C") == [3] and at("g") == [] and at("f", owner="T", owners=owners) == [3]


def test_roots(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    p = spark.createDataFrame([("a", "b"), ("b", "c")], "node string, parent string")
    assert rows(lookup.roots(n, p), "node") == [("a", "c", 2), ("b", "c", 1), ("c", "c", 0)]
    with pytest.raises(ValueError):
        lookup.roots(n, spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), 3)


def test_modules_and_nearest(spark):
    c = spark.createDataFrame([("r", "X.Internal", False, True, True), ("r", "X", False, False, True), ("q", "GHC.Y", False, False, False), ("q", "Zed.Long", False, False, False)], "root string, module string, home boolean, defining boolean, exported boolean")
    assert rows(lookup.preferred_modules(c), "root") == [("q", "Zed.Long"), ("r", "X.Internal")]  # defining and exported, internal: -200 against -100
    assert rows(lookup.shortest_modules(c), "root") == [("q", "GHC.Y"), ("r", "X")]
    m = spark.createDataFrame([("r", 5, 2), ("r", 7, 1)], "root string, symbol int, steps int")
    assert rows(lookup.nearest_per_root(m), "root") == [("r", 7, 1)]


def test_exports_and_instances(spark):
    n = spark.createDataFrame([("M", "R", "b", False, True), ("M", "R", "a", False, False), ("M", "S", None, True, None), ("M", "T", "x", False, False)], "module string, root string, child string, root_hit boolean, child_hit boolean")
    assert rows(lookup.exports(n), "root") == [("M", "R", ["a", "b"]), ("M", "S", []), ("M", "T", ["x"])]
    assert rows(lookup.exports(n, hinted=True), "root") == [("M", "R", ["b"]), ("M", "S", [])]
    i = spark.createDataFrame([(1, "Eq", None, ["T"]), (2, None, "F", ["T"]), (2, None, "F", ["T"])], "instance int, cls string, family string, heads array<string>")
    got = lambda k, v: [r[0] for r in rows(lookup.direct_instances(i, k, v).select("instance"), "instance")]
    assert got("class", "Eq") == [1] and got("family", "F") == [2] and got("type", "T") == [1, 2]


def test_component_options(spark):
    r = spark.createDataFrame(
        [("A", 1, "t", "test", "x"), ("A", 2, "e", "executable", "y"), ("B", 1, "e", "executable", "x"), ("B", 2, "l", "library", "y"), ("C", 1, "l", "library", "x"), ("C", 2, "e", "executable", "x")],
        "module string, seq int, component string, kind string, options string",
    )
    assert rows(lookup.merge_options(r), "module") == [("A", "e", "executable", "y", False), ("B", "l", "library", "y", True), ("C", "l", "library", "x", False)]


def test_owners_and_index(spark):
    o = spark.createDataFrame([("d", 1, 5, 6, None), ("d", 2, 5, 6, "n"), ("d", 3, 50, 51, "r"), ("d", 4, 50, 51, "n"), ("e", 5, 1, 2, None)], "def_id string, i int, s int, e int, parent string")
    m = spark.createDataFrame([("d", "m", 4, 8), ("d", "n", 4, 8), ("d", "w", 0, 20)], "def_id string, name string, s int, e int")
    r = spark.createDataFrame([("d", "r"), ("d", "q")], "def_id string, name string")
    assert rows(references.occurrence_owners(o, m, r), "i") == [(1, ["m", "n"]), (2, ["n"]), (3, ["r"]), (4, ["q", "r"]), (5, None)]
    x = spark.createDataFrame([("d", "d", "f", "M", 1, 2), ("d", "d", "f", "M", 1, 2), ("d", "d", "d", "M", 3, 4), ("d", "d", "g", None, 5, 6)], "def_id string, own string, name string, module string, s int, e int")
    assert rows(references.reference_index(x), "s") == [("f", "d", 1, 2)]
    names = spark.createDataFrame([("f", "a", 5, 6), ("f", "z", 90, 91)], "file string, name string, s int, e int")
    decl = spark.createDataFrame([("f", "D2", 2, 0, 50), ("f", "D1", 1, 0, 90)], "file string, def_id string, seq int, s int, e int")
    assert rows(references.catalog(names, decl), "name") == [("a", "D1")]


def test_slices(spark):
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 10)], "file string, line int, text string")
    r = spark.createDataFrame([("f", 7, 8), ("f", 1, 2)], "file string, s int, e int")
    assert references.slices(lines, r).first().text == "l1\nl2\n...\nl7\nl8"


def test_imports(spark):
    issues = spark.createDataFrame([(1, "f", 1, 1, "names", ["b", "a"]), (2, "f", 1, 1, "names", ["a"]), (3, "f", 2, 2, "whole", None), (4, "f", 2, 2, "names", ["x"]), (5, "f", 3, 3, "names", ["x"]), (6, "f", 9, 9, "whole", None)], "issue_id int, file string, sl int, el int, issue string, names array<string>")
    imports = spark.createDataFrame([(10, "f", 1, 1, "explicit"), (20, "f", 2, 2, "explicit"), (30, "f", 3, 3, "open")], "import_id int, file string, s int, e int, kind string")
    actions, warnings = diagnostics.resolve_imports(issues, imports)
    assert rows(actions, "import_id") == [(10, "remove", ["a", "b"]), (20, "delete", None)]
    assert rows(warnings, "issue_id") == [(5, "open import"), (6, "no import")]


def test_edits(spark):
    t = spark.createDataFrame([("f", "hello world"), ("g", "same"), ("n", None)], "file string, text string")
    e = spark.createDataFrame([("f", 0, 5, "bye"), ("f", 6, 11, "moon"), ("f", 6, 11, "moon"), ("f", 5, 99, "stale"), ("g", 0, 3, "x"), ("g", 2, 4, "y")], "file string, s int, e int, text string")
    assert rows(diagnostics.apply_edits(t, e), "file") == [("f", "bye moon"), ("g", "same"), ("n", None)]
    inserts = spark.createDataFrame([("f", 5, 5, "a", None), ("f", 5, 5, "b", None), ("f", 0, 5, "hallo", "hello"), ("f", 6, 11, "x", "wrong")], "file string, s int, e int, text string, expected string")
    kept, warned = diagnostics.valid_edits(t, inserts)
    assert [tuple(r) for r in kept.collect()] == [("f", 0, 5, "hallo")] and sorted((r.s, r.warning) for r in warned.collect()) == [(5, "conflict"), (5, "conflict"), (6, "stale")]


def test_snippets_and_summary(spark):
    d = spark.createDataFrame([(1, "f", 3, 2, 4, 2), (2, "f", None, None, None, None)], "seq int, file string, sl int, sc int, el int, ec int")
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 6)], "file string, line int, text string")
    assert rows(diagnostics.snippets(d, lines), "line") == [(1, "f", 1, False, "l1", None), (1, "f", 2, False, "l2", None), (1, "f", 3, True, "l3", " ^"), (1, "f", 4, True, "l4", "^")]
    m = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "module string, loaded boolean")
    assert tuple(diagnostics.load_summary(m).first()) == (1, 1, 2, "partial", True)
    assert diagnostics.load_summary(m.limit(0)).first().status == "empty"


def test_entry_text(spark):
    d = spark.createDataFrame([(1, "t", '"c"'), (2, None, '"c"'), (3, None, '["a",{"text":"b"},{"type":"image"},"{x"]'), (4, None, '{"a":1}'), (5, None, None)], "k int, text string, content string")
    assert rows(d.select("k", sessions.entry_text(d["text"], d["content"]).alias("x")), "k") == [(1, "t"), (2, "c"), (3, "a\nb\n{x"), (4, ""), (5, "")]


def test_recovery_ranges(spark):
    e = spark.createDataFrame([("s", 1, "e1", "c1", False), ("s", 2, "e2", "c1", True), ("s", 3, "e3", None, False), ("s", 4, "e4", "c2", False), ("s", 5, "e5", "c2", True)], "session string, seq int, entry_id string, call_id string, is_result boolean")
    c = spark.createDataFrame([("s", "r1", None, "c1", "c2", 9), ("s", "r2", "e3", None, "c2", 9), ("s", "r3", "e5", None, "c2", 9), ("s", "r4", None, "zz", "c2", 9)], "session string, id string, start_entry string, start_call string, final_call string, completed int")
    got = sessions.recovery_ranges(e, c)
    assert rows(got, "id") == [("s", "r1", 1, 3, 9), ("s", "r2", 3, 3, 9)]
    t = spark.createDataFrame([("s", "r1", 100, 10), ("s", "r4", 50, 5)], "session string, id string, original int, replacement int")
    assert tuple(sessions.recovery_totals(t, got).first()) == (2, 150, 15, 1)
