"""Stores, files, catalogs and exporters."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.engine import LineageEngine
from tracewright.functions import exporters, reports
from tracewright.operators import ast, graph, matrix, quality
from tracewright.sources import catalog, files
from tracewright.sources.store import LineageStore, StoreError, library, locate
from tracewright.streaming.incremental import update, watch


def acts(df):
    return {r["source_file"].rsplit("/", 1)[-1]: r["action"] for r in df.collect()}


def test_incremental_scenarios(spark, tmp_path):
    folder = tmp_path / "sql"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.sql").write_text("INSERT INTO x (p) SELECT a FROM t")
    (folder / "sub" / "b.SQL").write_text("INSERT INTO y (q) SELECT p FROM x")
    store = LineageStore(spark, str(tmp_path / "store"))
    run = lambda: acts(update(store, files.read_scripts(spark, str(folder)), "ctx"))
    assert run() == {"a.sql": "add", "b.SQL": "add"}
    assert run() == {"a.sql": "reuse", "b.SQL": "reuse"}
    (folder / "a.sql").write_text("SELEC")
    assert run() == {"a.sql": "failed", "b.SQL": "reuse"} and store.count() == 2
    (folder / "a.sql").write_text("INSERT INTO x (p) SELECT b FROM t")
    assert run() == {"a.sql": "replace", "b.SQL": "reuse"}
    edges = LineageEngine.table(store.load(), "edge").where("kind = 'OUTPUT'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    assert sorted(r.id for r in graph.impact(edges, "t.b").collect()) == ["t.b", "x.p", "y.q"]
    (folder / "a.sql").unlink()
    assert run() == {"a.sql": "remove", "b.SQL": "reuse"} and store.count() == 1
    with pytest.raises(StoreError):
        store.replace(store.load().where("false").drop("fingerprint", "bucket"), store.fingerprints())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT a FROM t")
    store = LineageStore(spark, str(tmp_path / "store"))
    watch(store, str(tmp_path / "in"), "ctx", str(tmp_path / "state")).awaitTermination()
    assert store.count() == 1


def test_store_version(spark, tmp_path):
    (tmp_path / "s" / "info").mkdir(parents=True)
    (tmp_path / "s" / "info" / "part-0.json").write_text('{"key":"version","value":"9"}\n')
    with pytest.raises(StoreError):
        LineageStore(spark, str(tmp_path / "s"))


def test_cases(spark, tmp_path):
    case = {"id": "a", "dialect": "ansi", "sql": "SELECT 1"}
    (tmp_path / "1.json").write_text(json.dumps(case))
    (tmp_path / "2.json").write_text(json.dumps(case | {"kind": "DDL"}))
    (tmp_path / "3.json").write_text("{")
    cases, problems = files.read_cases(spark, str(tmp_path))
    assert [(r.id, r.kind) for r in cases.collect()] == [("a", "SELECT")]
    assert sorted(r.problem for r in problems.collect()) == ["duplicate id a", "unreadable case"]


def test_composed_catalog(spark):
    texts = spark.createDataFrame([("b", "CREATE TABLE t (x INT)"), ("a", "CREATE TABLE t (y INT)"), ("c", "nonsense")], "source_file string, sql string")
    ddl = catalog.from_ddl(texts)
    assert [r.column_name for r in ddl.collect()] == ["y"]
    both = catalog.compose(ddl, catalog.from_frames({"t": spark.range(1), "u": spark.range(1)}))
    assert sorted((r.table_id, r.column_name) for r in both.collect()) == [("t", "y"), ("u", "id")]
    assert catalog.compose(None) is None


def test_exports_repeat_and_escape(spark):
    e = spark.createDataFrame([('t.a"', "o.x", "OUTPUT", "DIRECT", 0), ("t", "o.x", "SOURCE", "SOURCE", 1), ('t.a"', "o.x", "PREDICATE", "FILTER_PREDICATE", 2)], "src string, dst string, kind string, transform string, seq int")
    outs = spark.createDataFrame([("o.x",)], "id string")
    text = [r.line for r in exporters.dot(e, outs).collect()]
    assert text == [r.line for r in exporters.dot(e, outs).collect()] and any('\\"' in x for x in text)
    assert [r.line for r in exporters.mermaid(e).collect()][1] == "  n_t_a_ -->|DIRECT, FILTER_PREDICATE| n_o_x"
    assert len(exporters.cypher(e).collect()) == 6
    event = json.loads(exporters.openlineage(e, outs).first().event)
    assert event["outputs"][0]["name"] == "o" and [i["name"] for i in event["inputs"]] == ["t"]
    two = spark.createDataFrame([("o.x",), ("p.x",)], "id string")
    assert json.loads(exporters.openlineage(e, two).first().event)["outputs"] == []
    with pytest.raises(KeyError):
        exporters.exporter("nosuch")


def test_quality_of_empty_expectation(spark):
    want = spark.createDataFrame([("c", None, None, None)], "case_id string, from_id string, to_id string, kind string")
    got = spark.createDataFrame([("c", "A", "b", "SOURCE")], "case_id string, from_id string, to_id string, kind string")
    r = quality.ratios(quality.compare(want, got)).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (0, 1, 0, 0.0, None)
    assert quality.pairs("a>b, c>d") == [("a", "b"), ("c", "d")]
    with pytest.raises(ValueError):
        quality.pairs("a>a")


def test_graph_edges(spark):
    e = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "z"), ("y", "w")], "src string, dst string")
    assert sorted((r.members, r.self_loop) for r in graph.cycles(e).collect()) == [("x,y", False), ("z", True)]
    assert graph.shortest_path(e, "w", "x").count() == 0
    assert [r.id for r in graph.shortest_path(e, "x", "w").orderBy("step").collect()] == ["x", "y", "w"]
    with pytest.raises(ValueError):
        graph.impact(e, "x", "SIDEWAYS")


def test_tree_difference():
    from tracewright.functions.parser import parse

    a, b = "SELECT a, b FROM t", "SELECT a FROM t"
    got = ast.diff_trees(ast.tree(parse(a), a), ast.tree(parse(b), b))
    assert [x[0] for x in got].count("removed") == 2 and got[0][0] == "changed"


def test_mermaid_names_outputs(spark):
    e = spark.createDataFrame([("t.a", "x", "OUTPUT", "DIRECT", 0)], "src string, dst string, kind string, transform string, seq int")
    lines = [r.line for r in exporters.mermaid(e, spark.createDataFrame([("x",)], "id string")).collect()]
    assert lines == ["flowchart LR", '  n_x["x (output)"]', "  n_t_a -->|DIRECT| n_x"]


def test_matrices(spark):
    cases = spark.createDataFrame([("a", "mysql", ["p", "p"], "SELECT a FROM t"), ("b", None, [], None), ("c", "MySQL", None, "SELEC " + "x" * 90)], "id string, dialect string, features array<string>, sql string")
    got = {r.case_id: r for r in matrix.compatibility(cases).collect()}
    assert got["a"].ok and got["a"].statements == 1 and not got["b"].ok and not got["c"].ok and len(got["c"].reason) <= 41
    assert sorted((r.case_id, r.pair, r.ok) for r in matrix.conversions(cases, "mysql>oracle,trino>mysql").collect()) == [("a", "mysql>oracle", True), ("c", "mysql>oracle", False)]
    verdicts = spark.createDataFrame([("a", "tp"), ("c", "fn")], "case_id string, verdict string")
    assert [(r.feature, r.tp, r.fn) for r in matrix.by_feature(verdicts, cases).collect()] == [("p", 1, 0)]
    cells = matrix.compatibility(cases)
    assert sorted(r.case_id for r in matrix.details(cells, cells.where("case_id = 'a'").select("case_id")).collect()) == ["a", "b", "c"]
    assert matrix.compatibility(cases.limit(0)).count() == 0 and matrix.shorten("abc", 2) == "ab…"


def test_reports_and_library(spark, tmp_path):
    facts = LineageEngine(spark).facts(spark.createDataFrame([("x", "SELECT a FROM t; SELEC"), ("y", None)], "source_file string, sql string"))
    report = {r.source_file: json.loads(r.report) for r in reports.parse_report(facts).collect()}
    assert [t["table_id"] for t in report["x"]["tables"]] == ["t"] and len(report["x"]["diagnostics"]) == 1 and report["y"]["tables"] == []
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    lines = [json.loads(r.line) for r in reports.impact_report(graph.impact(e, "a"), graph.nodes(e), "a").collect()]
    assert lines[0]["origin"] == "a" and [(x["id"], x["distance"]) for x in lines[1:]] == [("a", 0), ("b", 1)]
    LineageStore(spark, str(tmp_path / "g1"))
    (tmp_path / "other").mkdir()
    assert [(r.name, r.models) for r in library(spark, str(tmp_path)).collect()] == [("g1", 0)] and library(spark, str(tmp_path / "none")).count() == 0
    assert locate("/r", "g1") == "/r/g1"
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(StoreError):
            locate("/r", bad)


def test_visible_nodes_and_layout(spark):
    n = ast.nodes(spark.createDataFrame([("-", "SELECT a + 1 AS x FROM t")], "source_file string, sql string"))
    root = n.where("parent_id IS NULL")
    assert [r.node_id for r in ast.visible(n, root).collect()] == [r.node_id for r in root.collect()]
    assert ast.visible(n, root.where("false")).count() == n.count()
    e = spark.createDataFrame([("a", "c"), ("b", "c")], "src string, dst string")
    assert sorted((r.id, r.depth, r.row) for r in graph.layout(e).collect()) == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0)]


def _random_graph(seed, n, m):
    import random

    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)})


def _closure(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    reach = {}
    for a in after:
        seen, todo = set(), [a]
        while todo:
            for b in after[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return after, reach


@pytest.mark.parametrize("local", [500_000, 12])
def test_components_layers_and_reach(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    pairs = _random_graph(3, 40, 34) + [("z1", "z1"), ("y1", "y2"), ("y2", "y1"), ("y2", "y3")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    after, reach = _closure(pairs)
    want = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in after}
    assert {r.id: r.component for r in graph.components(edges).collect()} == want
    cyclic = {a for a in after if sum(want[b] == want[a] for b in after) > 1}
    depth = dict.fromkeys(after, 0)
    for _ in after:
        for a, b in pairs:
            if a != b and a not in cyclic and b not in cyclic:
                depth[b] = max(depth[b], depth[a] + 1)
    assert {r.id: r.depth for r in graph.layers(edges).collect()} == depth
    start = pairs[0][0]
    hops = {r.id: r.distance for r in graph.impact(edges, start).collect()}
    assert set(hops) == reach[start] | {start} and hops[start] == 0
    assert all(any(hops.get(a) == hops[b] - 1 for a, c in pairs if c == b) for b in hops if b != start)
    assert {r.id for r in graph.impact(edges, start, depth=1).collect()} == after[start] | {start}
    loops = sorted((r.first, r["size"], r.members) for r in graph.cycle_list(edges).collect())
    assert loops == sorted([(c, len(m), ",".join(sorted(m))) for c in set(want.values()) if len(m := [a for a in after if want[a] == c]) > 1] + [(a, 1, a) for a, b in pairs if a == b])


def test_a_long_chain_is_solved_in_one_task(spark):
    import time

    edges = spark.createDataFrame([(f"c{i:05d}", f"c{i + 1:05d}") for i in range(3000)], "src string, dst string")
    began = time.time()
    assert graph.components(edges).where("id <> component").count() == 0
    assert graph.layers(edges).agg({"depth": "max"}).first()[0] == 3000
    assert graph.impact(edges, "c00000").agg({"distance": "max"}).first()[0] == 3000
    assert time.time() - began < 60


def test_tables_declared_twice_are_refused(spark):
    from tracewright.sources import catalog

    one = catalog.from_frames({"t": spark.createDataFrame([], "a int, b int"), "u": spark.createDataFrame([], "a int")})
    assert catalog.checked(one).count() == 3
    with pytest.raises(ValueError, match="duplicate_table: u"):
        catalog.checked(one.union(one.where("table_id = 'u'")))


def test_store_buckets_versions_and_fingerprints(spark, tmp_path, monkeypatch):
    from tracewright.sources import store as stores

    monkeypatch.setattr(stores, "BUCKETS", 4)
    scripts = spark.createDataFrame([(f"f{i}.sql", f"SELECT c{i} FROM t") for i in range(20)] + [(None, "SELECT x FROM y")], "source_file string, sql string")
    facts = LineageEngine(spark).facts(scripts)
    prints = scripts.select("source_file", F.md5("sql").alias("fingerprint"))
    s = stores.LineageStore(spark, str(tmp_path / "one"))
    s.save(facts, prints)
    assert s.count() == 21 and len([x for x in (tmp_path / "one" / "facts").iterdir() if x.name.startswith("bucket=")]) <= 4
    new = spark.createDataFrame([("f3.sql", "SELECT a FROM t; SELECT b FROM t"), ("g.sql", "SELECT 1")], "source_file string, sql string")
    s.replace(LineageEngine(spark).facts(new), new.select("source_file", F.md5("sql").alias("fingerprint")))
    assert s.count() == 23 and s.fingerprints().count() == 22
    assert s.remove(["f3.sql", "nosuch"]) == 1 and s.remove(spark.createDataFrame([(f"f{i}.sql",) for i in range(20)] + [(None,)], "source_file string")) == 20
    assert [r.source_file for r in s.fingerprints().collect()] == ["g.sql"] and s.remove(["g.sql"]) == 1 and s.count() == 0
    with pytest.raises(stores.StoreError, match="several fingerprints"):
        s.save(facts, prints.union(prints.withColumn("fingerprint", F.lit("other"))))
    old = tmp_path / "two"
    facts.write.parquet(str(old / "facts"))
    spark.createDataFrame([("version", "1")], "key string, value string").write.json(str(old / "info"))
    two = stores.LineageStore(spark, str(old))
    assert two.count() == 21 and two.fingerprints().where("fingerprint is not null").count() == 0 and two._info() == "2"
    assert [tuple(r) for r in stores.library(spark, str(tmp_path)).collect()] == [("one", 0), ("two", 21)]


@pytest.mark.parametrize("turn", [False, True])
def test_wide_graphs_are_trimmed_before_rounds(spark, monkeypatch, turn):
    """Fans around a small core leave the rounds nothing: weak parts and colouring never run, and results are those of one task."""
    pairs = [(f"n{i % 7}", f"c{i}") for i in range(200)] + [(f"c{i % 40}", f"o{i}") for i in range(400)] + [("r", f"n{i}") for i in range(7)] + [("o1", "x"), ("x", "y"), ("y", "x"), ("y", "o2"), ("o3", "o3")]
    edges = spark.createDataFrame([p[::-1] for p in pairs] if turn else pairs, "src string, dst string")
    run = lambda: [sorted(map(tuple, f(edges).collect())) for f in (graph.layers, graph.layout, graph.components, graph.cycle_list, graph.cycles)]
    want = run()

    def never(*_):
        raise AssertionError("rounds over a graph that trimming solves")

    monkeypatch.setattr(graph, "LOCAL", 60)
    monkeypatch.setattr(graph, "_weak_parts", never)
    monkeypatch.setattr(graph, "_colouring", never)
    assert run() == want
    assert [r[2] for r in sorted(want[1], key=lambda r: (r[1], r[0])) if r[1] == 1] == list(range(sum(r[1] == 1 for r in want[0])))
