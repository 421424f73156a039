"""The library without its corpus subpackage: queries against DuckDB, frontends, scans, streams, reports."""

import gc
import hashlib
import json
import os
import subprocess
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltstone.functions import text
from siltstone.operators import code, contracts, diff, export, graph, impact, merkle
from siltstone.plans import queries as plans
from siltstone.session import Scratch, tidy
from siltstone.sources import files
from siltstone.streaming import watch

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    found = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_parallel_edges_are_one(spark):
    edges = spark.createDataFrame([(0, 1, 1), (0, 1, 4), (0, 1, 2)], "src int, dst int, flags int")
    assert [tuple(r) for r in graph.simple_graph(edges).collect()] == [(0, 1, 7)]


@pytest.mark.parametrize(
    "edges, want",
    [
        ([(0, 1), (1, 2)], {0: 0, 1: 1, 2: 2}),
        ([(0, 1), (1, 0)], {0: 0, 1: 0}),
        ([(0, 1), (1, 2), (2, 0), (2, 3)], {0: 0, 1: 0, 2: 0, 3: 3}),
        ([(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)], {0: 0, 1: 0, 2: 2, 3: 2}),
        ([(5, 5)], {5: 5}),
    ],
)
def test_components(spark, edges, want):
    frame = spark.createDataFrame([(*e, 1) for e in edges], "src int, dst int, flags int")
    assert {r.node: r.component for r in graph.strong_components(frame).collect()} == want


def test_cycles_have_no_order(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    assert graph.topological_levels(edges, edges.select(F.col("src").alias("node"))) is None


@pytest.mark.parametrize(
    "path, module, is_test",
    [
        ("auth/jwt.py", "auth.jwt", False),
        ("pkg/subpkg/__init__.py", "pkg.subpkg", False),
        ("app\\service\\worker.py", "app.service.worker", False),
        ("tests/test_auth.py", "tests.test_auth", True),
        ("web/button.test.ts", "web.button.test", True),
    ],
)
def test_paths(spark, path, module, is_test):
    row = spark.createDataFrame([(path,)], "path string").select(text.module_name(F.col("path")), text.is_test_file(F.col("path"))).first()
    assert tuple(row) == (module, is_test)


def test_severity_order(spark):
    rows = [("declaration", "interface"), ("type_contract", "interface"), ("dependency", "dependency"), ("control_flow", "internal_logic"), ("", "trivia")]
    frame = spark.createDataFrame(rows, "tier string, want string")
    got = frame.select("want", diff.severity(lambda t: F.col("tier") == t).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_scan_and_bundles(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = 1\r\n")
    (tmp_path / "pkg" / "b.txt").write_text("no")
    (tmp_path / "node_modules" / "c.js").write_text("no")
    found = files.source_files(spark, str(tmp_path))
    assert [(r.path, r.language) for r in found.collect()] == [("pkg/a.py", "python")]
    assert code.bundles(found).first().error is None


def test_git_revision(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    assert [(r.path, bytes(r.content)) for r in files.git_revision(spark, str(tmp_path), "HEAD").collect()] == [("a.py", b"x = 1\n")]


def test_flow_of_awkward_functions(spark):
    source = """
async def f(xs, *, k=1, **kw):
    async for x in xs:
        if x: continue
        try:
            y = await g(x)
        except ValueError as e:
            raise
        finally:
            k += 1
    while True:
        break
    else:
        k = 2
    match k:
        case 1: return y
        case _: pass
    with open(k) as h: del h
    def inner(): return k
    return lambda z: z + k
"""
    frame = spark.createDataFrame([("m.py", source), ("n.py", ""), ("o.py", None)], "path string, content string")
    assert code.bundles(frame).where("error IS NULL").count() == 3
    assert code.control_flow(frame).where("function = 'f'").count() > 8
    assert code.data_flow(frame).count() > 3
    assert code.calls(frame).where("callee = 'g' AND is_async").count() == 1


def test_path_changes_stream(spark, tmp_path):
    schema = "path string, ts timestamp, digest string"
    where = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 00:00:00", "1"), ("a", "2024-01-01 00:00:01", "1"), ("a", "2024-01-01 00:00:02", "2"), ("b", "2024-01-01 00:00:00", "1"), ("b", "2024-01-01 00:00:03", None)], "path string, ts string, digest string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(where)
    stream = watch.path_changes(spark.readStream.schema(schema).parquet(where))
    q = stream.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.path, r.action) for r in spark.table("changes").collect())
    assert got == [("a", "added"), ("a", "modified"), ("b", "added"), ("b", "deleted")]


def test_bursts(spark):
    rows = [("r", "p1", "2024-01-01 00:00:00"), ("r", "p2", "2024-01-01 00:00:01"), ("r", "p1", "2024-01-01 00:00:09")]
    frame = spark.createDataFrame(rows, "root string, path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.changes for r in watch.bursts(frame).collect()) == [1, 2]


def test_sarif(spark):
    findings = spark.createDataFrame([("a.py", "interface-break", 'say "x"'), ("b.py", "structural-mutation", "y")], "path string, rule string, message string")
    made = json.loads(export.sarif_document(findings).first().sarif)
    assert made["version"] == "2.1.0" and [r["level"] for r in made["runs"][0]["results"]] == ["error", "note"]


@pytest.mark.parametrize("language", ["javascript", "typescript", "go", "rust"])
def test_braced_source_of_any_tokens_has_tiers_or_an_error(language):
    import random

    from siltstone.sources import braced

    parts = "function func fn class interface struct trait impl mod type import use const let pub async if for return a b self mut ( ) [ ] { } () {} [] < > , ; : :: . => -> = / \" ' 'x' 1 \n // é".split(" ")
    rng = random.Random(language)
    for _ in range(1500):
        source = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        try:
            assert len(braced.tiers(braced.parse(source, language), source.encode())) == 9
        except ValueError:
            pass


def test_braced_files_of_nothing():
    from siltstone.sources import braced

    empty = braced.parse("", "go")
    assert braced.declarations(empty) == braced.imports(empty) == braced.calls(empty) == []


def test_command_line(spark, tmp_path, capsys):
    from siltstone.__main__ import main

    one, two, bad = tmp_path / "one.js", tmp_path / "two.js", tmp_path / "bad.js"
    one.write_text("function f(a) { return g(a); }\nfunction g(b) { return b; }\n")
    two.write_text("// moved\nfunction f(a) { return g(a); }\nfunction g(b) { return b + 1; }\n")
    bad.write_text("function (")
    assert main(["fp", str(one)], spark) == 0
    assert set(json.loads(capsys.readouterr().out)) >= {"path", "source", "structural", "composite"}
    assert main(["fp", str(bad)], spark) == 3
    assert main(["compare", str(one), str(bad)], spark) == 3
    assert main(["compare", str(one), str(one)], spark) == 0
    capsys.readouterr()
    assert main(["compare", str(one), str(two)], spark) == 1
    told = json.loads(capsys.readouterr().out)
    assert (told["structural"], told["declaration"]) == ("different", "identical")
    assert main(["repository", str(tmp_path)], spark) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 3
    assert main(["graph", str(tmp_path)], spark) == 0
    assert [json.loads(x)["calls"] for x in capsys.readouterr().out.splitlines()] == [1, 1]
    assert main(["graph", str(tmp_path), "--dot"], spark) == 0
    assert "->" in capsys.readouterr().out
    assert main(["slice", str(tmp_path), "g"], spark) == 0
    assert {json.loads(x)["side"] for x in capsys.readouterr().out.splitlines()} == {"self", "callers"}
    assert main(["slice", str(tmp_path), "nowhere"], spark) == 1
    assert main(["fp", str(tmp_path / "none.py")], spark) == 4


def test_flow_over_modules(spark):
    rows = [("calc.py", "def compute(x, y):\n    return x + y\n"), ("main.py", "import calc\n\n\ndef run_calc(val):\n    res = calc.compute(val, 10)\n    return res\n"), ("bad.py", "def ("), ("null.py", None)]
    tree = spark.createDataFrame(rows, "path string, content string")
    edges = code.flow_graph(tree)
    got = {tuple(r) for r in edges.collect()}
    run, compute = "main:run_calc", "calc:compute"
    assert got == {(run, compute, 0, "val", False), (run, compute, 1, "<const>", False), (compute, run, -1, "<return>", True)}
    nodes, numbered = code.flow_offsets(edges)
    ids = {r.symbol: r.node for r in nodes.collect()}
    assert {tuple(r) for r in numbered.collect()} == {(ids[run], ids[compute], graph.USES), (ids[compute], ids[run], graph.RETURNS)}
    assert code.graph_digest(edges).first() == code.graph_digest(edges.orderBy("variable")).first()
    assert code.graph_digest(edges).first() != code.graph_digest(edges.where("place <> 1")).first()
    after = tree.withColumn("content", F.replace("content", F.lit("val, 10"), F.lit("10, val")))
    updated = code.update_flow(edges, after, spark.createDataFrame([("main.py",)], "path string"))
    assert sorted(updated.collect()) == sorted(code.flow_graph(after).collect())


def test_diff_of_programs(spark):
    old = "import os\n\ndef f(a):\n    return os.path.join(a)\n\ndef g():\n    f(1)\n"
    new = "import os\nimport sys\n\ndef f(a, b=2):\n    if b:\n        return a\n    return os\n\ndef h():\n    f(1)\n"
    frame = lambda s: spark.createDataFrame([("m.py", s)], "path string, content string")
    got = {(r.part, r.action, r.target) for r in code.program_diff(frame(old), frame(new)).collect()}
    assert got == {
        ("declaration", "changed", "f"), ("declaration", "removed", "g"), ("declaration", "added", "h"),
        ("dependency", "usage_changed", "os as os"), ("dependency", "added", "sys as sys"),
        ("structure", "body_changed", "f"), ("control_flow", "changed", "f"), ("data_flow", "changed", "f"),
        ("call_graph", "removed", "f -> os.path.join"), ("call_graph", "removed", "g -> f"), ("call_graph", "added", "h -> f"),
    }
    assert code.program_diff(frame(old), frame(old.replace("(a)", "(z)").replace("# x", ""))).where("part = 'structure'").count() == 0


def test_manifest(spark, tmp_path, monkeypatch):
    from siltstone.sources import manifest

    tree, kept = tmp_path / "tree", str(tmp_path / "kept")
    tree.mkdir()
    for name in "abc":
        (tree / f"{name}.py").write_text(f"{name} = 1\n")
    held = manifest.Manifest(spark, kept)
    assert held.version() is None and held.read().count() == 0
    scan = lambda: files.source_files(spark, str(tree))
    held.write(manifest.bundles(scan(), held.read()))
    first = {r.path: r.composite for r in held.read().collect()}
    assert set(first) == {"a.py", "b.py", "c.py"}
    (tree / "a.py").write_text("a = 1234\n")
    (tree / "c.py").unlink()
    hits, misses = manifest.look_up(scan(), held.read())
    assert [r.path for r in hits.collect()] == ["b.py"] and [r.path for r in misses.collect()] == ["a.py"]
    made = manifest.bundles(scan(), held.read())
    assert {r.path: r.composite for r in made.collect()} == {r.path: r.composite for r in code.bundles(scan()).collect()}
    held.write(manifest.merge(held.read(), made))
    assert held.read().count() == 3
    held.write(manifest.prune(held.read(), scan()))
    assert sorted(r.path for r in held.read().collect()) == ["a.py", "b.py"]
    assert manifest.check(held.read()).first() == (2, 0, 0)
    twice = held.read().unionByName(held.read().withColumn("source", F.lit("x")))
    assert manifest.check(twice).first() == (4, 2, 2)
    assert manifest.check(held.read().limit(0)).first() == (0, 0, 0)
    held.clear()
    assert held.version() is None


def test_path_safety(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "out").symlink_to(tmp_path)
    root = str(tmp_path / "in")
    assert files.safe_path(root, "deep/../deep").endswith("in/deep")
    for bad in ("..", "/etc/passwd", "out", "a\0b"):
        with pytest.raises(ValueError):
            files.safe_path(root, bad)
    seen: set = set()
    assert [files.seen_before(seen, d) for d in (root, root + "/deep", root + "/out/in", root + "/none")] == [False, False, True, True]


def test_language_aliases(spark):
    frame = spark.createDataFrame([("PY",), ("Ts",), ("rust",), ("Cobol",), (None,)], "n string")
    assert [r[0] for r in frame.select(text.language_named(F.col("n"))).collect()] == ["python", "typescript", "rust", "cobol", None]


def test_command_line_of_caches(spark, tmp_path, capsys):
    from siltstone.__main__ import main

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.js").write_text("function f(a) { return g(a); }\nfunction g(b) { return b; }\n")
    (tmp_path / "t" / "b.js").write_text("function f(a) { return g(a, 1); }\nfunction g(b) { return b; }\n")
    root, kept = str(tmp_path / "t"), str(tmp_path / "kept")
    digests = []
    for extra in ([], ["--cache", kept], ["--cache", kept]):
        assert main(["repository", root, *extra], spark) == 0
        digests.append(capsys.readouterr().out)
    assert len(set(digests)) == 1
    assert main(["cache", "verify", kept], spark) == 0
    assert json.loads(capsys.readouterr().out)["entries"] == 2
    (tmp_path / "t" / "b.js").unlink()
    assert main(["cache", "prune", kept, root], spark) == 0
    assert json.loads(capsys.readouterr().out)["entries"] == 1
    assert main(["cache", "clean", kept], spark) == 0
    assert main(["flow", root], spark) == 0
    assert {json.loads(x)["place"] for x in capsys.readouterr().out.splitlines()} == {0, -1}
    (tmp_path / "c.js").write_text("function f(a) { return a; }\n")
    assert main(["diff", str(tmp_path / "c.js"), str(tmp_path / "t" / "a.js")], spark) == 1
    assert '"call_graph"' in capsys.readouterr().out
    assert main(["diff", str(tmp_path / "c.js"), str(tmp_path / "c.js")], spark) == 0


def test_path_hash(spark):
    from siltstone.functions.digest import path_hash

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    paths = ["", "a", "src/é/Ω😀.py", "x" * 300, None]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in frame.select(path_hash(F.col("path"))).collect()] == [None if p is None else fnv(p.encode()) for p in paths]


def test_reports(spark):
    files_ = spark.createDataFrame([("m.py", 'def f(a):\n    if a == "x":\n        return a\n    return f(a)\n')], "path string, content string")
    dot = export.function_dots(code.control_flow(files_), "src", "dst", "condition").first()
    assert dot["function"] == "f" and dot.dot.startswith('subgraph "cluster_m.py:f" {') and dot.dot.count(" -> ") == code.control_flow(files_).count()
    assert export.function_dots(code.data_flow(files_), "definition", "use", "variable").first().dot.count(" -> ") == code.data_flow(files_).count()
    slices = spark.createDataFrame([("a.py", "interface", 1, 2, 3), ("b.py", "trivia", 0, 0, 0)], "path string, severity string, callers int, files int, tests int")
    told = {r.path: (r.rule, r.message) for r in export.impact_findings(slices).collect()}
    assert told["a.py"] == ("interface-break", "interface change: 1 direct callers, 2 files and 3 tests affected")
    assert told["b.py"][0] == "structural-mutation"
    assert json.loads(export.json_lines(slices).first().line)["path"] == "a.py"


def test_long_ways(spark):
    """A chain longer than a job's hops and than the jobs between compactions, with a cycle at its end."""
    n = graph.HOPS * graph.ROUNDS + 5
    rows = [(i, i + 1) for i in range(n)] + [(n, n - 2)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    seeds = spark.createDataFrame([(0,), (3,)], "node long")
    want = {i: min(i, i - 3 if i >= 3 else i) for i in range(n + 1)}
    assert {r.node: r.hops for r in graph.reachable(edges, seeds).collect()} == want
    found = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert found == {i: min(i, n - 2) for i in range(n + 1)}
    odd = spark.createDataFrame([(1, 2), (2, None), (None, 3)], "src long, dst long")
    assert {tuple(r) for r in graph.reachable(odd, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (None, 2)}
    assert graph.reachable(edges.limit(0), seeds).count() == 2
    assert graph.strong_components(edges.limit(0)).count() == 0


def shuffled(spark):
    """Names of the shuffle files there are."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {found.apply(i).getName() for i in range(found.size())}
    return {n for n in names if n.startswith("shuffle_")}


def test_a_kept_step_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    made = Scratch(spark, "t").keep(spark.range(10_000).repartition(3, "id"))
    until = time.time() + 10
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert made.count() == 10_000


def test_tidying_drops_what_nothing_refers_to(spark):
    before = shuffled(spark)
    assert len(spark.range(1_000).repartition(3, "id").collect()) == 1_000
    assert shuffled(spark) - before
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        gc.collect()
        tidy(spark)
        time.sleep(0.2)
    assert not shuffled(spark) - before


def test_subtypes_compare_sets_and_not_pairs(spark):
    rows = [(1, "x", ["a", "b"]), (2, "x", ["b", "a", "b"]), (3, "x", ["a"]), (4, "x", []), (5, "x", [None]), (6, "y", ["a"]), (6, "y", ["a", "c"]), (7, "y", ["a"]), (8, None, ["a"]), (9, "x", None)]
    given = spark.createDataFrame(rows, "k int, g string, members array<string>")
    a, b = given.alias("a"), given.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.k") != F.col("b.k")))
    want = met.where(contracts.is_subtype(F.col("a.members"), F.col("b.members"))).select("a.k", "b.k")
    assert sorted(map(tuple, contracts.subtypes(given, "k", ["g"]).collect())) == sorted(map(tuple, want.collect()))
    # Rows are never compared with rows, only distinct sets with sets.
    plan = contracts.subtypes(given, "k", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except(sup_form" in plan and "array_except(members" not in plan


def test_has_edge_starts_from_the_edges(spark, tmp_path):
    where = str(tmp_path)
    spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, None)], "c_custkey long, c_nationkey int").write.parquet(f"{where}/customer.parquet")
    spark.createDataFrame([(7, 0), (8, 1), (9, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{where}/supplier.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{where}/orders.parquet")
    lines = [(1, 7, "N"), (1, 7, "R"), (2, 8, "N"), (3, 9, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(f"{where}/lineitem.parquet")
    got = plans.has_edge(spark, where)
    assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 7)]
    # Every row is met by its key: customers and suppliers of a nation are never multiplied.
    assert "c_nationkey" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x)
    assert "Join Inner, (c_nationkey" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("library", [True, False])
def test_a_digest_of_everything_goes_from_task_to_task(spark, monkeypatch, library):
    rows = [(f"p{i * 7919 % 3000:05d}é", f"{i:064d}") for i in range(3000)]
    files = spark.createDataFrame([*rows, ("q", None), (None, "0")], "path string, digest string").repartition(8)
    if not library:
        monkeypatch.setattr(merkle, "_hash_on", lambda rows, state: None)
    else:
        monkeypatch.setattr(merkle, "_hash_here", None)
    want = hashlib.sha256("".join(f"{p}:{d};" for p, d in sorted(rows)).encode()).hexdigest()
    assert [tuple(r) for r in merkle.repository_digest(files).collect()] == [(3002, want)]
    assert merkle.repository_digest(files.limit(0)).first().repository_digest == hashlib.sha256().hexdigest()


def test_tests_that_share_a_beginning_are_not_multiplied(spark):
    names = lambda n: spark.range(n).selectExpr("concat('p', id) AS path", "concat('commonhead_', id) AS base")
    tests, changed = names(1500).selectExpr("path", "concat('test_', base, 'x') AS base"), names(300)
    got = impact.matching_tests(tests, changed)
    assert got.count() == 1500
    most = max(_rows_out(got))
    assert most < 200_000, most  # all names begin alike: in pairs they would be 450,000

    odd = [("", ), ("a", ), ("aa", ), ("ba", ), ("é" * 9, ), ("xabcdefghij", ), (None, ), ("abcdefgh", ), ("abcdefghi", )]
    tests = spark.createDataFrame([(f"t{i}", b) for i, (b,) in enumerate(odd)], "path string, base string")
    for some in ([("", )], [("b", ), ("abcdefghij", )], [("yabcdefghiz", ), ("ééééééééééé", )], [], [(None, )]):
        changed = spark.createDataFrame([("c", b) for (b,) in some], "path string, base string")
        want = sorted((f"t{i}", b) for i, (b,) in enumerate(odd) if b and any(c and (c in b or b in c) for (c,) in some))
        assert sorted(map(tuple, impact.matching_tests(tests, changed).collect())) == want


def _rows_out(df) -> list[int]:
    """Rows that each operator of an executed plan put out."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if plan.metrics().contains("numOutputRows"):
            found.append(plan.metrics().apply("numOutputRows").value())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_graphs_of_either_way(spark, monkeypatch):
    # A ring of 9 with a tail, two cycles that meet in a path, a node by itself, and names in place of numbers.
    pairs = [(i, (i + 1) % 9) for i in range(9)] + [(8, 100), (100, 101), (200, 201), (201, 200), (201, 202), (202, 203), (203, 202), (5, 5), (300, 300)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, flags int")
    seeds = spark.createDataFrame([(3,), (200,), (900,)], "node long")
    found = []
    for at_once in (graph.AT_ONCE, 0):
        monkeypatch.setattr(graph, "AT_ONCE", at_once)
        parts = graph.strong_components(edges, seeds)
        found.append([sorted(map(tuple, x.collect()), key=repr) for x in (graph.reachable(edges, seeds), graph.reachable(edges, seeds, backward=True), parts, graph.condense(edges, parts))])
    assert found[0] == found[1]
    assert (8, 5) in found[0][0] and (2, 8) in found[0][0] and (900, 0) in found[0][0] and (900, 900) in found[0][2]
    monkeypatch.undo()
    named = edges.selectExpr("concat('n', src) AS src", "concat('n', dst) AS dst", "flags")
    assert ("n8", "n0") in set(map(tuple, graph.strong_components(named).collect()))
    odd = spark.createDataFrame([(1, 2), (2, None), (None, 3)], "src long, dst long")
    assert {tuple(r) for r in graph.reachable(odd, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (None, 2)}
    assert graph.reachable(edges.limit(0), seeds.limit(0)).isEmpty() and graph.strong_components(edges.limit(0)).isEmpty()


def test_long_ways_take_few_jobs(spark):
    edges = spark.range(400).selectExpr("id AS src", "(id + 1) % 400 AS dst", "1 AS flags")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("ways"))
    spark.sparkContext.setJobGroup("ways", "ways")
    try:
        assert graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).agg(F.max("hops")).first()[0] == 399
        assert graph.strong_components(edges).where("component <> 0").isEmpty()
        assert jobs() < 60, jobs()
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def _parses(spark, monkeypatch, made) -> int:
    """How many times files are parsed while `made()` is computed."""
    n, each = spark.sparkContext.accumulator(0), code._parse_each
    monkeypatch.setattr(code, "_parse_each", lambda files, schema, rows: each(files.select("path", "content"), schema, lambda *a: (n.add(1), rows(*a))[1]))
    made().collect()
    monkeypatch.undo()
    return n.value


def test_files_are_parsed_once(spark, monkeypatch):
    rows = [(f"m{i}.py", f"from m{i + 1} import f\n\ndef f(a):\n    return f(a)\n") for i in range(6)]
    old = spark.createDataFrame(rows, "path string, content string")
    new = old.withColumn("content", F.when(F.col("path") == "m3.py", F.replace("content", F.lit("f(a):"), F.lit("f(a, b):"))).otherwise(F.col("content")))
    assert _parses(spark, monkeypatch, lambda: code.call_graph(old)) == 6
    flow = Scratch(spark, "test").keep(code.flow_graph(old))
    assert _parses(spark, monkeypatch, lambda: code.flow_graph(old)) == 6
    assert _parses(spark, monkeypatch, lambda: code.update_flow(flow, new, new.where("path = 'm3.py'").select("path"))) == 6
    assert _parses(spark, monkeypatch, lambda: code.program_diff(old, new)) == 2
    assert [tuple(r) for r in code.program_diff(old, new).collect()] == [("m3.py", "declaration", "changed", "f")]


def test_diff_of_repeated_and_missing_paths(spark):
    one = "def f():\n    pass\n"
    old = spark.createDataFrame([("a.py", one), ("b.py", one), ("c.py", None), (None, one)], "path string, content string")
    new = spark.createDataFrame([("a.py", one), ("a.py", one), ("b.py", one), ("c.py", ""), (None, one)], "path string, content string")
    got = sorted(map(tuple, code.program_diff(old, new).where("part = 'declaration'").collect()), key=repr)
    assert got == [("a.py", "declaration", "changed", "f"), (None, "declaration", "added", "f"), (None, "declaration", "removed", "f")]
