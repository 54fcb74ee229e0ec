"""Projects, trees, definitions and sessions on small inputs."""

from cairn.operators import definitions, lookup, project, sessions, tree


def test_package_entries(spark):
    text = ["-- a comment", "packages: ./, lib/*", "          tools/x.cabal -- mine", "optional-packages: other", "  more", "packages:", "  last", "constraints: x"]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)], "file string, line int, text string")
    entries = project.package_entries(lines)
    assert sorted(r.entry for r in entries.collect()) == ["./", "last", "lib/*", "tools/x.cabal"]
    manifests = spark.createDataFrame([("a.cabal",), ("lib/b/b.cabal",), ("lib/c.cabal",), ("tools/x.cabal",), ("lib/d/e/f.cabal",)], "path string")
    assert sorted((r.entry, r.manifest) for r in project.package_roots(entries, manifests).collect()) == [("./", "a.cabal"), ("lib/*", "lib/b/b.cabal"), ("tools/x.cabal", "tools/x.cabal")]
    assert project.package_roots(entries.limit(0), manifests).count() == 0


def test_environment_key(spark):
    r = spark.createDataFrame([("a", "resolved", ["u2", "u1"]), ("b", "missing", [])], "package string, status string, units array<string>")
    other = spark.createDataFrame([("a", "resolved", ["u1"]), ("b", "resolved", ["u2"])], r.schema)
    key = lambda x, *db: project.environment_key(x, list(db)).first().key
    assert key(r, "g", "l") == key(other, "l", "g") != key(r, "g")


def test_definitions(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    src = spark.createDataFrame([(n, m, "f", i, None) for i, (n, m) in enumerate(zip("abcd", "XYYZ", strict=True))], "node string, module string, file string, line int, col int")
    got = lambda mode, **k: [r.node for r in definitions.get_definitions(roots, e, src, mode, **k)[0].collect()]
    assert (got("none"), got("direct"), got("recursive"), got("all"), got("recursive", most=2)) == (["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b"])
    assert definitions.get_definitions(roots.limit(0), e, src)[1] is None
    rows = spark.createDataFrame([("n", "d1"), ("n", "d1"), ("m", "d2")], "name string, def_id string")
    assert definitions.merge_indexes(rows, "name", "def_id").count() == 2
    try:
        definitions.merge_indexes(rows.union(spark.createDataFrame([("n", "d9")], rows.schema)), "name", "def_id")
        raise AssertionError("a conflict passed")
    except ValueError as e_:
        assert "n" in str(e_)
    assert [r.name for r in definitions.resolve_names(rows.select("name").distinct(), rows.where("name = 'm'").distinct()).collect()] == ["m"]
    assert [(r.src, r.dst) for r in definitions.dependencies(roots, e).collect()] == [("a", "b")]


def test_snippets_by_verbosity(spark):
    refs = spark.createDataFrame([("d", 20, 20, 18, 40)], "def_id string, rs int, re int, cs int, ce int")
    sizes = spark.createDataFrame([("d", 50)], "def_id string, lines long")
    got = {v: sorted((r.s, r.e) for r in definitions.snippet_ranges(refs, sizes, v).collect()) for v in ("low", "medium", "high")}
    assert got == {"low": [(20, 20)], "medium": [(1, 2), (20, 20), (50, 50)], "high": [(1, 3), (18, 40), (50, 50)]}


def test_sessions(spark):
    a = spark.createDataFrame([("1", "linux", "x64", "gnu"), ("1", "linux", "x64", None)], "version string, platform string, arch string, libc string")
    assert sessions.manifest_problems(a).count() == 1 and sessions.find_asset(a, "1", "linux", "x64", "gnu").count() == 1 and sessions.find_asset(a, "2", "linux", "x64", "gnu").count() == 0
    o = spark.createDataFrame([("s", 1, "reloadHomeModules", False), ("s", 2, "runTestSuite", True), ("t", 1, "runTestSuite", False), ("u", 1, "reloadHomeModules", True)], "session string, seq int, tool string, success boolean")
    assert {r.session: r.state for r in sessions.recovery_state(o).collect()} == {"s": "readyToFinalize", "t": "active", "u": "inactive"}


def test_trees(spark):
    d = spark.createDataFrame([("src/a", True), ("zoo", True), ("config", True), ("f.hs", False), ("focus/x", True)], "path string, is_dir boolean")
    assert [r.path for r in tree.open_priority(d, ["focus"]).orderBy("key", "path").collect()] == ["focus/x", "config", "src/a", "zoo", "f.hs"]
    orphans = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C")], "src string, dst string")
    assert sorted(r.node for r in lookup.index_modules(spark.createDataFrame([("A",)], "node string"), orphans).collect()) == ["A", "B", "C"]
