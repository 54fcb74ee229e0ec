import pytest
from pyspark.sql import functions as F

from cairn.operators import diagnostics, graph, knowledge, search, sessions, sets, spans, tree


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_bfs(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"))
    assert as_dict(graph.bfs(nodes(spark, "a", "a"), e)) == {"a": 0, "b": 1, "c": 1}
    assert as_dict(graph.bfs(nodes(spark, "a"), e, 0)) == {"a": 0}


def test_components_and_depths(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"))
    assert as_dict(graph.components_of(e, nodes(spark, "a", "b", "c", "d"))) == {"a": "a", "b": "a", "c": "c", "d": "d"}
    n = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 4.0)], "node string, seconds double")
    s = graph.build_summary(n, e, 2).first()
    assert (s.modules, s.total_work, s.critical_path, s.ideal, s.bound) == (3, 7.0, 7.0, 3.5, 7.0)


def test_summary_example(spark):
    """133 units of work, a critical path of 23 and 32 workers: bound 23, utilisation 18.07 %."""
    n = spark.createDataFrame([(f"c{i}", 1.0) for i in range(23)] + [(f"x{i}", 1.0) for i in range(110)], "node string, seconds double")
    s = graph.build_summary(n, spark.createDataFrame([("c22", "c22")], "src string, dst string").where("src <> dst").union(spark.createDataFrame([(f"c{i + 1}", f"c{i}") for i in range(22)], "src string, dst string")), 32).first()
    assert (s.total_work, s.critical_path, s.ideal, s.bound) == (133.0, 23.0, 4.15625, 23.0) and round(s.efficiency, 4) == 0.1807


def test_dead(spark):
    d = spark.createDataFrame([("r", False), ("u", False), ("t", False), ("x", False), ("y", True)], "node string, test_module boolean")
    got = as_dict(graph.find_dead(d, nodes(spark, "r"), nodes(spark, "y"), edges(spark, ("r", "u"), ("y", "t"))))
    assert got == {"r": "alive", "u": "alive", "t": "test_only", "x": "safe_delete", "y": "alive"}
    dead = spark.createDataFrame([("M", "a", 1), ("M", "b", 2), ("M", "c", 3)], "module string, node string, rank int")
    order = lambda *e: [r.node for r in graph.delete_order(dead, edges(spark, *e)).orderBy("position").collect()]
    assert order(("c", "b"), ("b", "a")) == ["c", "b", "a"]  # dependents first
    assert order(("c", "b"), ("b", "c"), ("c", "a")) == ["a", "b", "c"]  # nothing is free: the lowest rank that is left


def test_instances(spark):
    heads = spark.createDataFrame([("i", "t"), ("i", "u"), ("j", "u")], "node string, head string")
    assert as_dict(graph.instance_liveness(nodes(spark, "i", "j", "k"), heads, nodes(spark, "t"))) == {"i": True, "j": False, "k": True}


def test_spans(spark):
    r = spark.createDataFrame([("f", 1, 2), ("f", 4, 5), ("f", 8, 9)], "file string, s int, e int")
    assert sorted((x.s, x.e) for x in spans.coalesce_ranges(r, "file").collect()) == [(1, 5), (8, 9)]
    n = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 10, 20), ("f", 3, 12, 15)], "file string, id int, s int, e int")
    assert {x.id: x.parent for x in spans.nest(n).collect()} == {1: None, 2: 1, 3: 2}


def test_pages(spark):
    d = spark.range(5)
    assert sets.page(d.where("id > 9"), ["id"])[1] is None
    assert sets.page(d, ["id"], -3, 2)[1] == {"total": 5, "skipped": 0, "shown": 2, "consumed": 2}
    rows, meta = sets.page(d, ["id"], 9, 2)
    assert rows.count() == 0 and meta["skipped"] == 5
    assert "skip=2" in sets.page_summary({"total": 5, "skipped": 0, "shown": 2, "consumed": 2})


def test_sets(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, v string")
    assert [r.k for r in sets.mention_all(m, "k", "v", ["a", "b"]).collect()] == [1]
    assert [r.v for r in sets.common_settings(m, [], "k", "v").collect()] == ["a"]


def search_values(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol int, field string, value string")


def test_search(spark):
    v = search_values(spark, (1, "name", "readFile"), (2, "name", "readFileLines"), (3, "name", "write"), (3, "module", "Read.File"), (4, "name", "fileRead"))
    got = [r.name for r in search.search_symbols(v, "readFile").collect()]
    assert got[0] == "readFile" and set(got) == {"readFile", "readFileLines", "write", "fileRead"} and got.index("readFileLines") < got.index("fileRead")
    scoped = lambda q, **k: [r.name for r in search.search_symbols(v, q, **k).collect()]
    assert scoped("Read.File.write") == ["write"] and scoped("readFile", patterns=["R*d.*"]) == ["write"] and scoped("readFile", limit=1) == ["readFile"]


def test_search_documents(spark):
    """Aliases, repeated rows and modules of one symbol are one document; names that differ in case are one suggestion."""
    rows = [(1, "readAll", "M.A", ["slurp"], ["M.B"], None, ["Handle"]), (1, "readAll", "M.A", ["gulp"], ["M.C"], None, None), (2, "Slurp", "N", None, None, ["Text"], None)]
    d = spark.createDataFrame(rows, "symbol int, occ string, module string, aliases array<string>, exported_from array<string>, results array<string>, arguments array<string>")
    values, names, modules = search.documents(d)
    assert sorted(r.variant for r in names.where("symbol = 1").collect()) == ["gulp", "slurp"] and values.where("symbol = 1 and field = 'name'").count() == 3
    got = search.search_symbols(values, "slurp", names=names, modules=modules).collect()
    assert [(r.name, r.modules) for r in got] == [("slurp", ["M.A", "M.B", "M.C", "N"])]
    assert search.parse_query("A.B'.f.g@T") == ("A.B'", "f.g", "T") and search.parse_query("(+++)") == (None, "+++", None)


def test_synonym_group_errors(spark):
    g = spark.createDataFrame([(1, "a1"), (2, "box"), (2, "boxes"), (3, "x1"), (3, ""), (4, "p1"), (4, "q1")], "group_id int, term string")
    assert {(r.group_id, r.problem) for r in search.group_errors(g).collect()} == {(1, "too_few_terms"), (2, "same_terms"), (3, "empty_term"), (3, "same_terms")}


def test_repeated_terms_do_not_multiply(spark):
    v = search_values(spark, (1, "name", "fooBar"), (2, "name", "baz"))
    a, b = (search.search_symbols(v, q).first().score for q in ("foo", "foo foo"))
    assert b <= a + 0.5


def test_synonyms_are_not_transitive(spark):
    g = spark.createDataFrame([(1, "a1"), (1, "b1"), (2, "b1"), (2, "c1")], "group_id int, term string")
    pairs = {("".join(r.term), "".join(r.target)) for r in search.synonym_pairs(g).collect()}
    assert ("a1", "c1") not in pairs and len(pairs) == 4


def test_evidence_moves_forward():
    items = [(0, 1, True, 0, 1, "exact", 1.0, ("name", "x")), (1, 1, True, 1, 1, "exact", 1.0, ("name", "x"))]
    best = search.select_evidence(items, {0, 1}, 2, 2)
    assert len(best.items) == 2 and best.score == pytest.approx(2 + 0.5 + 0.6)
    back = [(0, 1, True, 1, 1, "exact", 1.0, ("name", "x")), (1, 1, True, 0, 1, "exact", 1.0, ("name", "x"))]
    assert len(search.select_evidence(back, {0, 1}, 2, 2).items) == 1


def test_df_counts_symbols_once(spark):
    v = search_values(spark, (1, "name", "foo"), (1, "name", "fooBar"), (2, "name", "qux"))
    df = {r.token: (r.df, r.n) for r in search.field_statistics(search.doc_tokens(v)).collect()}
    assert df["foo"] == (1, 2)


def test_sessions(spark):
    e = spark.createDataFrame([("s", 1, "snapshot", "p"), ("s", 2, "completed", None), ("s", 3, "snapshot", "q"), ("t", 1, "snapshot", "z"), ("t", 2, "reset", None)], "session string, seq int, kind string, payload string")
    got = {r.session: (r.epoch, r.n_completed, r.snapshot) for r in sessions.fold_sessions(e).collect()}
    assert got == {"s": (0, 1, "q"), "t": (1, 0, None)}
    r = spark.createDataFrame([("s", "a", 1, 5, 1), ("s", "b", 4, 6, 2), ("s", "c", 7, 8, 3), ("s", "a", 9, 9, 4)], "session string, id string, s int, e int, completed int")
    assert sorted(x.id for x in sessions.plan_ranges(r).collect()) == ["a", "c"]


def test_usage(spark):
    e = spark.createDataFrame([("s", 1, None, "grep", "12345"), ("s", 2, "c1", None, "1234"), ("s", 9, None, "grep", "1")], "session string, seq int, call_id string, tool string, text string")
    c = spark.createDataFrame([("c1", "read")], "call_id string, name string")
    r = spark.createDataFrame([("s", 1, 2)], "session string, s int, e int")
    got = {x.name: tuple(x)[1:] for x in sessions.usage(e, c, r).collect()}
    assert got == {"grep": (1, 1, 1, 2), "read": (0, 0, 1, 1)}


def test_diff(spark):
    a, b = (spark.createDataFrame(x, "path string, hash string") for x in ([("p", "1"), ("q", "1")], [("q", "2"), ("r", "1")]))
    assert as_dict(sessions.snapshot_diff(a, b)) == {"p": "deleted", "q": "modified", "r": "added"}


def test_knowledge(spark):
    page, known = (spark.createDataFrame([(h,) for h in x], "hash string") for x in ("ab", "bc"))
    fresh, omitted, after = knowledge.deliver(page, known)
    assert [r.hash for r in fresh.collect()] == ["a"] and [r.hash for r in omitted.collect()] == ["b"] and after.count() == 3


def test_tree(spark):
    p = spark.createDataFrame([("a/b/x.hs",), ("a/y.hs",), (".git/z",)], "path string")
    got = {(r.dir, r.ext): r.files for r in tree.roll_up(p).collect()}
    assert got["a", "hs"] == 2 and got["a/b", "hs"] == 1 and got[".", "hs"] == 2
    assert {r.path for r in tree.visible(p, ["b"]).collect()} == {"a/y.hs"}


def test_diagnostics(spark):
    lines = spark.createDataFrame([("d/M.p.timings", 1, 1, "pass [1], [My.Mod]: time=500"), ("d/M.p.timings", 1, 2, "[Al.Pha] [Ze.D] alloc=1kb"), ("d/M.p.timings", 1, 3, "used 1,024 bytes"), ("d/N.dyn.x", 1, 1, "time=1")], "path string, modified int, line_no int, line string")
    s = diagnostics.timing_samples(lines).first()
    assert (s.module, s.variant, s.seconds, s.bytes) == ("Al.Pha", "profiling", 0.5, 2048) and diagnostics.timing_samples(lines).count() == 1
    assert diagnostics.test_summary(spark.createDataFrame([], "status string")).first().verdict == "no tests"
    e = spark.createDataFrame([("f", 0, 2, "a"), ("f", 1, 3, "b"), ("f", 5, 6, "c"), ("f", 5, 6, "c")], "file string, s int, e int, text string")
    assert [r.text for r in diagnostics.conflicting_edits(e).collect()] == ["c"]
    assert diagnostics.retry_until_stable(lambda: (False, "same")) == (False, 1)


def test_components_of_cycles(spark):
    """Against mutual reachability written out, on random graphs with cycles of cycles."""
    import random

    rng = random.Random(5)
    for n, m in ((12, 16), (30, 45), (8, 40)):
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {i: {i} for i in range(n)}
        for _ in range(n):
            for a, b in e:
                for s in reach.values():
                    if a in s:
                        s.add(b)
        want = {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}
        got = graph.components_of(spark.createDataFrame(sorted(e), "src long, dst long"), spark.range(n).withColumnRenamed("id", "node"))
        assert as_dict(got) == want


def test_walk_of_many_rounds(spark):
    e = spark.createDataFrame([(i, i + 1, 0) for i in range(25)] + [(25, 0, 0)], "src long, dst long, ord int")
    assert [tuple(r) for r in graph.walk(spark.createDataFrame([(0, 5), (0, 7)], "node long, ord int"), e).orderBy("depth").collect()] == [(i, i, 1) for i in range(26)]
    assert graph.bfs(spark.createDataFrame([(0,)], "node long"), e).agg({"depth": "max", "*": "count"}).first()[:2] in ((25, 26), (26, 25))


def test_order(spark):
    r = spark.createDataFrame([("d1", "A", 1, 0), ("d1", "A", 1, 2), ("d2", "B", 1, 1)], "def_id string, module string, line int, depth int")
    assert [x.def_id for x in spans.definition_order(r).collect()] == ["d1", "d2"]


def test_streaming(spark, tmp_path):
    from cairn.streaming.stateful import fresh_only

    src = str(tmp_path / "in")
    spark.createDataFrame([("c", 1, "h", False), ("c", 2, "h", False), ("c", 3, None, True), ("c", 4, "h", False)], "client string, seq long, hash string, reset boolean").coalesce(1).write.json(src)
    stream = spark.readStream.schema("client string, seq long, hash string, reset boolean").json(src)
    q = fresh_only(stream).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.table("fresh").collect()) == [1, 4]


def test_sources(spark, tmp_path):
    from cairn.sources import files

    (tmp_path / "pkg").write_text("name: base\nid: base-1\nexposed: True\n---\nname: x\nid: x-2\nexposed: False\n")
    assert {(r.package, r.unit_id, r.exposed) for r in files.package_records(spark, str(tmp_path / "pkg")).collect()} == {("base", "base-1", True), ("x", "x-2", False)}
    (tmp_path / "env").write_text("-- note\nclear-package-db\npackage-id base-1\n")
    assert [(r.directive, r.argument) for r in files.environment_lines(spark, str(tmp_path / "env")).collect()] == [("clear-package-db", ""), ("package-id", "base-1")]


def test_oracle_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
