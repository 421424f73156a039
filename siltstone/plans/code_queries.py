"""Queries over inline source files, with the verdicts that they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.digest import TIERS
from siltstone.operators import code, diff, graph
from siltstone.plans.queries import query
from siltstone.session import ship

_BASE = 'import os\n\n\ndef area(width, height):\n    """Doc."""\n    total = width * height\n    if total > 10:\n        return total\n    return os.path.join("a", str(total))\n'
#: What is done to the base file, and the tiers that must differ.
_PAIRS = {
    "comments": (_BASE.replace("    total =", "    # a comment\n    total ="), ""),
    "formatting": (_BASE.replace("width * height", "(width  *  height)"), ""),
    "whitespace": (_BASE.replace("\n\n\n", "\n\n\n\n\n"), ""),
    "locals": (_BASE.replace("total", "result"), ""),
    "operand_order": (_BASE.replace("width * height", "height * width"), ""),
    "dual_comparison": (_BASE.replace("total > 10", "10 < total"), ""),
    "docstring": (_BASE.replace("Doc.", "Another."), ""),
    "literal": (_BASE.replace("> 10", "> 11"), "structural"),
    "operator": (_BASE.replace("width * height", "width - height"), "structural"),
    "statement_removed": (_BASE.replace("    if total > 10:\n        return total\n", ""), "structural"),
    "parameter_added": (_BASE.replace("height):", "height, depth=1):"), "structural declaration"),
    "import_added": (_BASE.replace("import os", "import os\nimport sys"), "structural dependency"),
}


def _fixtures(spark):
    rows = [(name, side, text) for name, (after, _) in _PAIRS.items() for side, text in (("old", _BASE), ("new", after))]
    return spark.createDataFrame(rows, "fixture string, side string, content string")


_SHOWN = ("source", "structural", "declaration", "dependency", "composite")


def _verdicts_sql() -> str:
    rows = []
    for name, (_, changed) in _PAIRS.items():
        told = ["different"] + ["different" if t in changed.split() else "identical" for t in _SHOWN[1:4]] + ["different" if changed else "identical"]
        rows.append(f"('{name}', {', '.join(repr(x) for x in told)})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(path, {', '.join(_SHOWN)})"


@query(_verdicts_sql())
def fixture_verdicts(spark, d):
    files = _fixtures(spark)
    old, new = (code.bundles(files.where(F.col("side") == s).select(F.col("fixture").alias("path"), "content")) for s in ("old", "new"))
    return diff.compare_tiers(old, new, "path", _SHOWN)


_REPO = {
    "auth/jwt.py": "def verify_token(token):\n    return decode(token)\n\n\ndef decode(token):\n    return token\n\n\ndef unused_helper():\n    return 1\n",
    "app/service.py": "from auth.jwt import verify_token\n\n\ndef handle(request):\n    return verify_token(request.token)\n\n\ndef outer(x):\n    return inner(x)\n\n\ndef inner(x):\n    return outer(x) if x else handle(x)\n",
}


def _repo(spark):
    return spark.createDataFrame(list(_REPO.items()), "path string, content string")


@query("""SELECT * FROM (VALUES ('app.service:handle', 'auth.jwt:verify_token', 1, true), ('app.service:outer', 'app.service:inner', 1, false),
('app.service:inner', 'app.service:outer', 1, false), ('app.service:inner', 'app.service:handle', 1, false),
('auth.jwt:verify_token', 'auth.jwt:decode', 1, false)) AS t(src, dst, calls, is_cross)""")
def repo_call_graph(spark, d):
    return code.call_graph(_repo(spark))


@query("SELECT * FROM (VALUES ('auth.jwt:unused_helper')) AS t(node)")
def repo_dead_code(spark, d):
    from siltstone.functions.text import module_name

    nodes = code.declarations(_repo(spark)).select(F.concat(module_name(F.col("path")), F.lit(":"), "name").alias("node"))
    return graph.uncalled(nodes, code.call_graph(_repo(spark)))


@query("""SELECT * FROM (VALUES ('app.service:handle', 'app.service:handle'), ('app.service:inner', 'app.service:inner'),
('app.service:outer', 'app.service:inner'), ('auth.jwt:decode', 'auth.jwt:decode'), ('auth.jwt:verify_token', 'auth.jwt:verify_token')) AS t(node, component)""")
def repo_cycles(spark, d):
    return graph.strong_components(code.call_graph(_repo(spark)).select("src", "dst"))


@query("""SELECT * FROM (VALUES ('os', '', 'os', 'call'), ('typing', 'Any', 'Any', 'type_only'), ('abc', 'ABC', 'ABC', 'inheritance'),
('sys', '', 'sys', 'value_reference'), ('re', '', 're', 'unused')) AS t(module, symbol, bound, usage)""")
def import_usage(spark, d):
    source = "import os, sys, re\nfrom typing import Any\nfrom abc import ABC\n\n\nclass A(ABC):\n    x: Any = 1\n\n\ny = sys\nos.getcwd()\n"
    files = spark.createDataFrame([("m.py", source)], "path string, content string")
    return code.imports(files).select("module", "symbol", "bound", "usage")


@query("SELECT 'm.py' AS path, true AS has_error, true AS has_source, true AS no_tiers")
def parse_errors(spark, d):
    files = spark.createDataFrame([("m.py", "def f(:\n")], "path string, content string")
    found = code.bundles(files)
    return found.select("path", F.col("error").isNotNull().alias("has_error"), F.col("source").isNotNull().alias("has_source"), F.coalesce(*TIERS[1:]).isNull().alias("no_tiers"))


@query("SELECT 'f' AS function, 5 AS nodes, 5 AS edges")
def control_flow_size(spark, d):
    files = spark.createDataFrame([("m.py", "def f(x):\n    if x:\n        return 1\n    y = 2\n    return y\n")], "path string, content string")
    edges = code.control_flow(files)
    nodes = F.size(F.array_distinct(F.concat(F.collect_set("src"), F.collect_set("dst"))))
    return edges.groupBy("function").agg(nodes.alias("nodes"), F.count("*").alias("edges"))


@query("SELECT * FROM (VALUES ('divergent', 6, 6, 6), ('invariant', 4, 4, 4)) AS t(expects, trials, applied, held)")
def metamorphic_suite(spark, d):
    from siltstone.operators import verify

    source = "def f(a, b):\n    if a < b:\n        return a + 1\n    return b\n"
    return verify.summary(verify.suite(spark.createDataFrame([("m.py", source)], "path string, content string")))


@query("SELECT path, true AS agrees FROM (VALUES ('auth/jwt.py'), ('app/service.py')) AS t(path)")
def determinism(spark, d):
    from siltstone.operators import verify

    return verify.determinism(_repo(spark))


_TYPES = {
    "Optional[str]": "null|string",
    "str | None": "null|string",
    "Option<String>": "null|string",
    "List[int]": "Array<int>",
    "Vec<i32>": "Array<int>",
    "[]int": "Array<int>",
    "Dict[str, List[int]]": "Map<string,Array<int>>",
    "map[string]int": "Map<string,int>",
    "Promise<number[]>": "Array<float>",
    "(a: string, b: number) => void": "(string,float)=>null",
    "{ b: string; a: number }": "{a:float,b:string}",
    "Union[int, str, int]": "int|string",
    "Custom<T>": "Custom<T>",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _TYPES.items()) + ") AS t(source, form)")
def type_strings(spark, d):
    import pandas as pd

    from siltstone.sources.types import normal_type

    ship(spark)
    form = F.pandas_udf(lambda s: pd.Series([normal_type(x) for x in s]), "string")
    return spark.createDataFrame([(k,) for k in _TYPES], "source string").select("source", form("source").alias("form"))


_BRACED = {
    "web/load.ts": """import fs, {readFile as rf, type Stats} from 'fs';
import * as path from "path"; // where files are
export async function load(name: string, n = 1): Promise<string> { const t = await rf(name); return path.join(t, `x${n}`); }
interface Shape { area(): number; name: string }
export class Square extends Base implements Shape { area(): number { return this.s * helper(this.s) / 2; } }
type Id = string | number;
""",
    "srv/main.go": """package main
import ( "fmt"
 str "strings" )
type Shape interface { Area() float64 }
type Square struct { s float64 }
func (q *Square) Area() float64 { r := q.s * 2
 fmt.Println(str.ToUpper("a")); go run(r); return r }
func Map[T any](xs []T, f func(T) T) []T { for _, x := range xs { f(x) }
 return xs }
""",
    "core/lib.rs": """use std::{io, collections::{HashMap as M, self}};
struct P { x: i32 }
pub trait Shape { fn area(&self) -> f64; }
impl Shape for P { fn area(&self) -> f64 { let mut a = self.x; println!("{}", a); helper(a) as f64 } }
type T = Vec<i32>;
""",
    "web/broken.js": "function f( {",
}


def _braced(spark):
    return spark.createDataFrame(list(_BRACED.items()), "path string, content string")


@query("""SELECT * FROM (VALUES ('web/load.ts', 'function', '', 'load'), ('web/load.ts', 'interface', '', 'Shape'), ('web/load.ts', 'method', 'Shape', 'area'),
('web/load.ts', 'class', '', 'Square'), ('web/load.ts', 'method', 'Square', 'area'), ('web/load.ts', 'type', '', 'Id'),
('srv/main.go', 'interface', '', 'Shape'), ('srv/main.go', 'method', 'Shape', 'Area'), ('srv/main.go', 'struct', '', 'Square'),
('srv/main.go', 'method', 'Square', 'Area'), ('srv/main.go', 'function', '', 'Map'), ('core/lib.rs', 'struct', '', 'P'),
('core/lib.rs', 'trait', '', 'Shape'), ('core/lib.rs', 'method', 'Shape', 'area'), ('core/lib.rs', 'impl', '', 'P'),
('core/lib.rs', 'method', 'P', 'area'), ('core/lib.rs', 'type', '', 'T')) AS t(path, kind, owner, name)""")
def braced_declarations(spark, d):
    return code.declarations(_braced(spark)).select("path", "kind", "owner", "name")


@query("""SELECT * FROM (VALUES ('web/load.ts', 'fs', 'default', 'fs', 'unused'), ('web/load.ts', 'fs', 'readFile', 'rf', 'call'),
('web/load.ts', 'fs', 'Stats', 'Stats', 'unused'), ('web/load.ts', 'path', '*', 'path', 'call'), ('srv/main.go', 'fmt', '', 'fmt', 'call'),
('srv/main.go', 'strings', '', 'str', 'call'), ('core/lib.rs', 'std', 'io', 'io', 'unused'), ('core/lib.rs', 'std::collections', 'HashMap', 'M', 'unused'),
('core/lib.rs', 'std', 'collections', 'collections', 'unused')) AS t(path, module, symbol, bound, usage)""")
def braced_imports(spark, d):
    return code.imports(_braced(spark))


@query("""SELECT * FROM (VALUES ('web/load.ts', 'Square.area', 'helper', false, 1), ('web/load.ts', 'load', 'path.join', false, 1), ('web/load.ts', 'load', 'rf', true, 1),
('srv/main.go', 'Map', 'f', false, 1), ('srv/main.go', 'Square.Area', 'fmt.Println', false, 1), ('srv/main.go', 'Square.Area', 'run', true, 1),
('srv/main.go', 'Square.Area', 'str.ToUpper', false, 1), ('core/lib.rs', 'P.area', 'helper', false, 1), ('core/lib.rs', 'P.area', 'println!', false, 1)) AS t(path, caller, callee, is_async, times)""")
def braced_calls(spark, d):
    return code.calls(_braced(spark))


_JS = "import a from 'm';\nfunction f(x) { let y = x + 1; if (y > 2) { return a(y); } return y; }\n"
#: What is done to the file above, and the tiers that must differ.
_JS_PAIRS = {
    "comments": (_JS.replace("let y", "/* why */ let y"), ""),
    "layout": (_JS.replace("; ", ";\n  "), ""),
    "quotes": (_JS.replace("'m'", '"m"'), ""),
    "locals": (_JS.replace("y", "z"), ""),
    "literal": (_JS.replace("x + 1", "x + 3"), "structural composite"),
    "callee": (_JS.replace("return a(y)", "return b(y)"), "structural dependency call_graph composite"),
    "branch_removed": (_JS.replace("if (y > 2) { return a(y); } ", ""), "structural dependency call_graph control_flow data_flow composite"),
    "parameter_added": (_JS.replace("f(x)", "f(x, w)"), "structural declaration data_flow composite"),
}


@query("SELECT * FROM (VALUES " + ", ".join("('%s', '%s')" % (k, " ".join(sorted(v.split()))) for k, (_, v) in _JS_PAIRS.items()) + ") AS t(fixture, changed)")
def braced_verdicts(spark, d):
    rows = [(f"{name}.js", side) for name, (after, _) in _JS_PAIRS.items() for side in (_JS, after)]
    files = spark.createDataFrame(rows, "path string, content string")
    found = code.bundles(files).groupBy("path")
    differs = found.agg(*(F.when(F.min(t) != F.max(t), t).alias(t) for t in TIERS[1:]))
    changed = F.array_join(F.array_sort(F.array_compact(F.array(*TIERS[1:]))), " ")
    return differs.select(F.regexp_replace("path", r"\.js$", "").alias("fixture"), changed.alias("changed"))


@query("SELECT 'web/broken.js' AS path, true AS has_error")
def braced_errors(spark, d):
    return code.bundles(_braced(spark)).where("error IS NOT NULL").select("path", F.col("error").isNotNull().alias("has_error"))


_SCOPED = "import os\nk = 1\n\n\ndef f(a):\n    b = a\n    def g():\n        return b + k\n    return g\n\n\nclass C:\n    k = 2\n    def m(self):\n        return k\n"


def _scopes(spark):
    return code.scopes(spark.createDataFrame([("m.py", _SCOPED)], "path string, content string"))


@query("""SELECT * FROM (VALUES (0, NULL, 'module', 'top', 'C:definition f:definition k:variable os:import'), (1, 0, 'function', 'f', 'a:parameter b:variable g:definition'),
(2, 1, 'function', 'g', ''), (3, 0, 'class', 'C', 'k:variable m:definition'), (4, 3, 'function', 'm', 'self:parameter')) AS t(scope, parent, kind, name, bound)""")
def scope_tree(spark, d):
    bound = F.array_join(F.transform("bindings", lambda b: F.concat(b["name"], F.lit(":"), b["kind"])), " ")
    return _scopes(spark).select("scope", "parent", "kind", "name", bound.alias("bound"))


@query("SELECT * FROM (VALUES (2, 'b', 1, 'variable'), (2, 'k', 0, 'variable'), (4, 'k', 0, 'variable'), (3, 'k', 3, 'variable'), (4, 'missing', NULL, NULL)) AS t(scope, name, found, kind)")
def scope_lookup(spark, d):
    asked = spark.createDataFrame([("m.py", s, n) for s, n in ((2, "b"), (2, "k"), (4, "k"), (3, "k"), (4, "missing"))], "path string, scope long, name string")
    return code.find_bindings(asked, _scopes(spark)).drop("path")


@query("""SELECT * FROM (VALUES ('auth.jwt:verify_token', 'self'), ('app.service:handle', 'callers'), ('app.service:inner', 'callers'),
('app.service:outer', 'callers'), ('auth.jwt:decode', 'callees')) AS t(node, side)""")
def symbol_slice(spark, d):
    return code.symbol_slice(code.call_graph(_repo(spark)), "verify_token")
