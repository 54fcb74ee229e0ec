"""Graph operators as fixpoint loops of joins; each round's rows are written out, so plans stay flat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import discard, materialise


#: Rounds of a loop whose results are kept apart before they are written as one table.
COMPACT = 8


def _gather(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _add(parts: list[DataFrame], new: DataFrame) -> None:
    """Keep a round's rows; every few rounds all of them become one table, so plans do not grow with the rounds."""
    parts.append(new)
    if len(parts) > COMPACT:
        one = materialise(_gather(parts))
        discard(*parts)
        parts[:] = [one]


def bfs(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): the least number of edges from any root; roots have depth 0; cycles end the walk."""
    front = materialise(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = [front], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(_gather(seen).select("node"), "node", "left_anti")
        front = materialise(step.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            discard(front)
            break
        _add(seen, front)
        front = front if len(seen) > 1 else seen[0].where(F.col("depth") == depth)
    return _gather(seen)


def walk(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, place): nodes in the order in which a breadth-first walk meets them. roots: (node, ord); edges: (src, dst, ord).

    Within a depth, nodes come in the order of their first parents, then of the edges.
    """
    first = materialise(roots.groupBy("node").agg(F.min("ord").alias("ord")).select("node", F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("ord", "node")).alias("place")))
    seen, front, depth = [first], first, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = edges.join(front.select(F.col("node").alias("src"), F.col("place").alias("from")), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("from", "ord")).alias("key"))
        new = met.join(_gather(seen).select("node"), "node", "left_anti")
        front = materialise(new.select("node", F.lit(depth).alias("depth"), F.row_number().over(Window.orderBy("key", "node")).alias("place")))
        if front.isEmpty():
            break
        _add(seen, front)
        front = front if len(seen) > 1 else seen[0].where(F.col("depth") == depth)
    return _gather(seen)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs with a path of at least one edge, each node's path to itself left out; semi-naive."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    new = materialise(e)
    known = [new]
    while True:
        step = new.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).where("src <> dst").distinct()
        new = materialise(step.join(_gather(known), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            discard(new)
            return _gather(known)
        known.append(new)
        if len(known) > COMPACT:
            one = materialise(_gather(known[:-1]))
            discard(*known[:-1])
            known = [one, new]


def components_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node.

    Nodes without an edge in or out of what is left are components of their own and go, over and over. The rest
    takes the least node that reaches it as its colour; of a colour, what reaches that node back is a component.
    No pairs are listed; rounds number as the longest path.
    """
    found: list[DataFrame] = []
    e = materialise(edges.select("src", "dst").where("src <> dst").distinct())
    while True:
        n = e.count()
        while n:
            inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            inner = materialise(inner.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            discard(e)
            e, before, n = inner, n, inner.count()
            if n == before:
                break
        if not n:
            break
        colour = materialise(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            low = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
            new = materialise(colour.join(low, "node", "left").select("node", F.least("colour", F.coalesce("low", "colour")).alias("colour"), (F.col("low") < F.col("colour")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            discard(colour)
            colour = new.drop("moved")
            colour._cairn_path = new._cairn_path
            if not moved:
                break
        a, b = (colour.select(F.col("node").alias(x), F.col("colour").alias(x + "_c")) for x in ("src", "dst"))
        same = materialise(e.join(a, "src").join(b, "dst").where("src_c = dst_c").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        heads = colour.where("node = colour").select("node")
        back = bfs(heads, same).select("node").join(colour, "node").select("node", F.col("colour").alias("component"))
        _add(found, materialise(back))
        gone = _gather(found).select("node")
        left = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = materialise(left.select("src", "dst"))
        discard(e, same, colour)
        e = left
    discard(e)
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.select("node").join(_gather(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def depths(nodes: DataFrame, edges: DataFrame, cost: str | None = None) -> DataFrame:
    """(node, depth) over an acyclic graph: 0 for nodes without targets, else 1 + the largest depth of a target.

    With `cost`, a column of nodes, depth is the node's cost plus the most expensive target's depth. A node is
    settled once, when its last target is; an edge is read until its target is settled.
    """
    own = F.col(cost) if cost else F.lit(0)
    n = materialise(nodes.select("node", own.alias("own")).distinct())
    left = materialise(edges.select("src", "dst").distinct())
    front = materialise(n.join(left.select(F.col("src").alias("node")), "node", "left_anti").select("node", F.col("own").alias("depth")))
    best, held, done = None, None, [front]
    while not front.isEmpty():
        at = front.select(F.col("node").alias("dst"), "depth")
        hit = left.join(at, "dst").select(F.col("src").alias("node"), "depth")
        best_now = (hit if best is None else best.unionByName(hit)).groupBy("node").agg(F.max("depth").alias("depth"))
        rest = materialise(left.join(at.select("dst"), "dst", "left_anti"))
        best_now = materialise(best_now)
        waits = rest.select(F.col("src").alias("node")).distinct()
        ready = best_now.join(waits, "node", "left_anti").join(n, "node")
        front = materialise(ready.select("node", ((F.col("own") if cost else F.lit(1)) + F.col("depth")).alias("depth")))
        discard(left, *([held] if held is not None else []))
        left, held, best = rest, best_now, best_now.join(waits, "node", "left_semi")
        done.append(front)
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return _gather(done) if len(done) <= 2 * COMPACT else materialise(_gather(done))


def condense(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership, component costs and component edges of a graph with cycles. nodes: (node, seconds)."""
    of = materialise(components_of(edges, nodes.select("node")))
    cost = nodes.join(of, "node").groupBy(F.col("component").alias("node")).agg(F.sum(F.coalesce("seconds", F.lit(1.0))).alias("seconds"))
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("s")), of.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    return of, cost, edges.join(a, "src").join(b, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def transitive_dependents(of: DataFrame, between: DataFrame) -> DataFrame:
    """(component, transitive): how many nodes other than the one asked reach a component's nodes. of: (node, component).

    Counts come from the condensed graph, whose pairs are fewer; a count of distinct nodes needs all of those.
    """
    size = of.groupBy("component").agg(F.count("*").alias("n"))
    above = closure(between).join(size.withColumnRenamed("component", "src"), "src").groupBy(F.col("dst").alias("component")).agg(F.sum("n").alias("above"))
    return size.join(above, "component", "left").select("component", (F.coalesce("above", F.lit(0)) + F.col("n") - 1).alias("transitive"))


def bottlenecks(nodes: DataFrame, imports: DataFrame, limit: int | None = None) -> DataFrame:
    """Per module: duration, direct and transitive dependents, layer, downstream length and score; the `limit` highest scores. nodes: (node, seconds); imports: (src, dst)."""
    n = nodes.select("node", F.coalesce("seconds", F.lit(1.0)).alias("duration"))
    direct = imports.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("direct"))
    of, cost, between = condense(nodes, imports)
    between = materialise(between)
    reach = transitive_dependents(of, between)
    layer = depths(cost.select("node"), between).select(F.col("node").alias("component"), F.col("depth").alias("layer"))
    down = depths(cost.select("node"), between.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("node").alias("component"), F.col("depth").alias("downstream"))
    out = n.join(direct, "node", "left").join(of, "node").join(reach, "component").join(layer, "component").join(down, "component")
    out = out.withColumn("direct", F.coalesce("direct", F.lit(0)))
    out = out.select("node", "duration", "direct", "transitive", "layer", "downstream", (F.col("duration") * (1 + F.col("transitive")) + F.col("direct")).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "node").limit(limit)


def critical_path(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(place, component, seconds, depth): a most expensive chain of components, from the last to build; of equal ones the least by name.

    A step a row: the chain is no longer than the graph has layers.
    """
    spark = nodes.sparkSession
    _, cost, between = condense(nodes, imports)
    cost, between = materialise(cost), materialise(between)
    depth = materialise(depths(cost, between, "seconds").join(cost, "node"))
    best = between.join(depth.select(F.col("node").alias("dst"), "depth"), "dst").groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col("dst").alias("next")))["next"].alias("next"))
    step = materialise(depth.join(best, "node", "left"))
    at, rows = step.orderBy(F.desc("depth"), "node").first(), []
    while at is not None:
        rows.append((len(rows), at["node"], at["seconds"], at["depth"]))
        at = step.where(F.col("node") == F.lit(at["next"])).first() if at["next"] is not None else None
    kind = nodes.schema["node"].dataType.simpleString()
    return spark.createDataFrame(rows, f"place int, component {kind}, seconds double, depth double")


def build_analysis(members: DataFrame, nodes: DataFrame, imports: DataFrame, jobs: int) -> DataFrame:
    """Per build component and for the project (null): modules, work, critical path, bound and utilisation.

    members: (component, node), a module may be in several. Imports count within a component. The project's critical
    path is the longest of its components'; all else is summed.
    """
    key = lambda c: F.struct("component", F.col(c).alias("node"))
    own = members.join(nodes, "node").select(key("node").alias("node"), "seconds")
    ends = imports.join(members.withColumnRenamed("node", "src"), "src").join(members.select("component", F.col("node").alias("dst")), ["component", "dst"])
    _, cost, between = condense(own, ends.select(key("src").alias("src"), key("dst").alias("dst")))
    path = depths(cost, between, "seconds").groupBy(F.col("node.component").alias("component")).agg(F.max("depth").alias("critical_path"))
    each = own.groupBy(F.col("node.component").alias("component")).agg(F.count("*").alias("modules"), F.sum(F.coalesce("seconds", F.lit(1.0))).alias("total_work")).join(path, "component")
    whole = each.agg(F.sum("modules").alias("modules"), F.sum("total_work").alias("total_work"), F.max("critical_path").alias("critical_path"))
    s = each.unionByName(whole.withColumn("component", F.lit(None).cast(each.schema["component"].dataType)))
    s = s.withColumn("ideal", F.col("total_work") / jobs).withColumn("bound", F.greatest("critical_path", "ideal"))
    return s.withColumn("efficiency", F.when(F.col("bound") > 0, F.col("total_work") / (jobs * F.col("bound"))).otherwise(1.0))


def build_summary(nodes: DataFrame, imports: DataFrame, jobs: int) -> DataFrame:
    """One row: modules, total work, critical path, the bound by workers, the estimated lower bound and utilisation."""
    _, cost, between = condense(nodes, imports)
    path = depths(cost, between, "seconds").agg(F.max("depth").alias("critical_path"))
    work = nodes.agg(F.count("*").alias("modules"), F.sum(F.coalesce("seconds", F.lit(1.0))).alias("total_work"))
    s = work.join(path).withColumn("ideal", F.col("total_work") / jobs).withColumn("bound", F.greatest("critical_path", "ideal"))
    return s.withColumn("efficiency", F.when(F.col("bound") > 0, F.col("total_work") / (jobs * F.col("bound"))).otherwise(1.0))


def find_dead(definitions: DataFrame, roots: DataFrame, test_roots: DataFrame, edges: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """(node, status): alive, test_only or safe_delete. Configured alive roots join both walks; definitions of test-only modules live by tests.

    definitions: (node, test_module).
    """
    extra = [] if alive is None else [alive]
    union = lambda r: r.select("node") if not extra else r.select("node").union(extra[0].select("node"))
    live = bfs(union(roots), edges).select("node", F.lit(True).alias("live"))
    tested = bfs(union(test_roots), edges).select("node", F.lit(True).alias("tested"))
    d = definitions.join(live, "node", "left").join(tested, "node", "left").fillna(False, ["live", "tested"])
    ok = F.when(F.col("test_module"), F.col("tested")).otherwise(F.col("live"))
    return d.select("node", F.when(ok, "alive").when(F.col("tested") & ~F.col("live"), "test_only").otherwise("safe_delete").alias("status"))


def instance_liveness(instances: DataFrame, heads: DataFrame, alive: DataFrame) -> DataFrame:
    """(node, alive): an instance lives if it has no project head type or any of its head types lives. heads: (node, head)."""
    h = heads.join(alive.select(F.col("node").alias("head"), F.lit(True).alias("ok")), "head", "left").groupBy("node").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("any"))
    return instances.join(h, "node", "left").select("node", F.coalesce("any", F.lit(True)).alias("alive"))


def main_roots(components: DataFrame, modules: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots and test roots: the `main` of executables and benchmarks, and of tests; libraries have none.

    components: (component, kind, main_module); modules: (component, module); definitions: (node, module, name).
    """
    main = components.join(modules, (components["component"] == modules["component"]) & (components["main_module"] == modules["module"])).select("kind", "module")
    own = definitions.where("name = 'main'").join(main, "module")
    return tuple(own.where(F.col("kind").isin(*kinds)).select("node").distinct() for kinds in (["executable", "benchmark"], ["test"]))


def test_only_modules(components: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that belong to test components alone."""
    return modules.join(components, "component").groupBy("module").agg(F.bool_and(F.col("kind") == "test").alias("t")).where("t").select("module")


def root_names(names: DataFrame, parents: DataFrame) -> DataFrame:
    """Names (def_id, name) without a parent in their definition; all names of a definition with one name. parents: (name, parent)."""
    inner = names.join(parents, "name").join(names.select("def_id", F.col("name").alias("parent")), ["def_id", "parent"], "left_semi").select("def_id", "name")
    several = names.groupBy("def_id").agg(F.countDistinct("name").alias("n")).where("n > 1").select("def_id")
    return names.join(inner.join(several, "def_id", "left_semi"), ["def_id", "name"], "left_anti").select("def_id", "name").distinct()


def dead_report(dead: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(status, module, node, position): what may go, before what only tests use; of the target modules, in an order safe for deletion.

    dead: (node, module, rank, status).
    """
    shown = dead.where("status <> 'alive'")
    if targets is not None:
        shown = shown.join(targets, "module", "left_semi")
    parts = [delete_order(shown.where(F.col("status") == s), edges).withColumn("status", F.lit(s)) for s in ("safe_delete", "test_only")]
    return parts[0].unionByName(parts[1]).select("status", "module", "node", "position")


def delete_order(dead: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, node, position): dependents before what they use, modules first and then within them; ties and cycles by source rank. dead: (module, node, rank).

    The order is one sequence over all that is dead, so the dead part of the graph, and no more, is one group.
    """
    import heapq

    import pandas as pd

    ends = edges.join(dead.select(F.col("node").alias("src")), "src", "left_semi").join(dead.select(F.col("node").alias("dst")), "dst", "left_semi").where("src <> dst")
    uses = ends.groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("uses"))

    def safe(items: list, uses: dict) -> list:
        """Items, in rank order, so that none comes after what it uses; where all left are used, the first of them."""
        rank = {x: i for i, x in enumerate(items)}
        users = dict.fromkeys(items, 0)
        for x in items:
            for y in uses.get(x, ()):
                users[y] += 1
        free, rest, out, gone = [rank[x] for x in items if not users[x]], 0, [], set()
        while len(out) < len(items):
            if free:
                x = items[heapq.heappop(free)]
            else:
                while items[rest] in gone:
                    rest += 1
                x = items[rest]
            if x in gone:
                continue
            gone.add(x)
            out.append(x)
            for y in uses.get(x, ()):
                users[y] -= 1
                if not users[y] and y not in gone:
                    heapq.heappush(free, rank[y])
        return out

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "module", "node"])
        of, nodes = dict(zip(pdf.node, pdf.module, strict=True)), list(pdf.node)
        uses = {n: set(u) if u is not None else set() for n, u in zip(pdf.node, pdf.uses, strict=True)}
        above: dict = {}
        for n in nodes:
            above.setdefault(of[n], set()).update(of[m] for m in uses[n] if of[m] != of[n])
        rows = []
        for module in safe(list(dict.fromkeys(of[n] for n in nodes)), above):
            own = [n for n in nodes if of[n] == module]
            rows += [(module, n) for n in safe(own, {n: {m for m in uses[n] if of[m] == module} for n in own})]
        return pd.DataFrame({"module": [r[0] for r in rows], "node": [r[1] for r in rows], "position": range(1, len(rows) + 1)})

    kind = dead.schema["node"].dataType.simpleString()
    return dead.join(uses, "node", "left").withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda pdf: order(pdf), f"module string, node {kind}, position long")
