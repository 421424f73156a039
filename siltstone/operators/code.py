"""Source files to tables: bundles, declarations, imports, calls, flow graphs, each in one Arrow pass.

A path's extension names the language, Python where it is unknown; the flow graphs are of Python only.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.functions.digest import TIERS
from siltstone.operators import diff, graph, intern, merkle, resolve
from siltstone.session import Scratch, ship
from siltstone.sources import braced
from siltstone.sources import python_source as py

Tree = ast.Module | braced.Source


def _parse(path: str, content: bytes) -> Tree:
    source = content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    language = text.EXTENSIONS.get("." + name.rsplit(".", 1)[-1].lower() if "." in name else "", "python")
    return ast.parse(source) if language == "python" else braced.parse(source, language)


def _of(tree: Tree):
    """The frontend that reads a tree."""
    return braced if isinstance(tree, braced.Source) else py


def _functions(tree: Tree | None):
    return py.functions(tree) if isinstance(tree, ast.Module) else ()


def _parse_each(files: DataFrame, schema: str, rows: Callable[[str, Tree | None, bytes, str | None], list[tuple]]) -> DataFrame:
    """`files` has path and content (binary or string); a file that does not parse comes with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(files.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = content or b""
                try:
                    tree, error = _parse(path or "", content), None
                except (SyntaxError, ValueError, LookupError, RecursionError) as e:
                    tree, error = None, f"{getattr(e, 'lineno', 0) or 0}: {getattr(e, 'msg', None) or e}"
                made += rows(path, tree, content, error)
            columns = zip(*made, strict=True) if made else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, schema)


def bundles(files: DataFrame) -> DataFrame:
    """One row per file: path, the nine digests, error; a file that does not parse has its source digest only."""

    def rows(path, tree, content, error):
        found = _of(tree).tiers(tree, content) if tree is not None else {"source": py.sha256(content).hexdigest()}
        return [(path, *(found.get(t) for t in TIERS), error)]

    return _parse_each(files, "path string, " + ", ".join(f"{t} string" for t in TIERS) + ", error string", rows)


def declarations(files: DataFrame) -> DataFrame:
    """(path, kind, owner, name, signature); private ones too."""
    make = lambda path, tree, *_: [(path, *r) for r in _of(tree).declarations(tree)] if tree else []
    return _parse_each(files, "path string, kind string, owner string, name string, signature string", make)


def imports(files: DataFrame) -> DataFrame:
    """(path, module, symbol, bound, usage)."""
    make = lambda path, tree, *_: [(path, *r) for r in _of(tree).imports(tree)] if tree else []
    return _parse_each(files, "path string, module string, symbol string, bound string, usage string", make)


def calls(files: DataFrame) -> DataFrame:
    """(path, caller, callee, is_async, times)."""
    make = lambda path, tree, *_: [(path, *r) for r in _of(tree).calls(tree)] if tree else []
    return _parse_each(files, "path string, caller string, callee string, is_async boolean, times long", make)


def arguments(files: DataFrame) -> DataFrame:
    """(path, caller, callee, place, variable): what calls pass and, at place -1, give back."""
    make = lambda path, tree, *_: [(path, *r) for r in _of(tree).arguments(tree)] if tree else []
    return _parse_each(files, "path string, caller string, callee string, place long, variable string", make)


def control_flow(files: DataFrame) -> DataFrame:
    """(path, function, src, dst, condition) of every function's blocks."""

    def rows(path, tree, *_):
        return [(path, n, *e) for n, f in _functions(tree) for e in py.control_flow(f)[1]]

    return _parse_each(files, "path string, function string, src long, dst long, condition string", rows)


def data_flow(files: DataFrame) -> DataFrame:
    """(path, function, variable, definition, use)."""

    def rows(path, tree, *_):
        return [(path, n, *e) for n, f in _functions(tree) for e in py.data_flow(f)]

    return _parse_each(files, "path string, function string, variable string, definition long, use long", rows)


def scopes(files: DataFrame) -> DataFrame:
    """(path, scope, parent, kind, name, seen, bindings) of every scope of Python files, as a tree of rows."""

    def rows(path, tree, content, _):
        return [(path, *s) for s in (py.scopes(content.decode("utf-8", "replace")) if isinstance(tree, ast.Module) else ())]

    schema = "path string, scope long, parent long, kind string, name string, seen array<long>, bindings array<struct<name: string, kind: string>>"
    return _parse_each(files, schema, rows)


def find_bindings(asked: DataFrame, scoped: DataFrame) -> DataFrame:
    """(path, scope, name, found, kind) of `asked` (path, scope, name): the nearest scope that binds the name, else null."""
    asked = asked.select("path", "scope", "name").distinct()
    seen = asked.join(scoped.select("path", "scope", "seen"), ["path", "scope"]).select("path", "scope", "name", F.posexplode("seen").alias("far", "found"))
    bound = scoped.select("path", F.col("scope").alias("found"), F.inline("bindings")).select("path", "found", "name", "kind")
    near = seen.join(bound, ["path", "found", "name"]).groupBy("path", "scope", "name").agg(F.min_by(F.struct("found", "kind"), "far").alias("one"))
    return asked.join(near, ["path", "scope", "name"], "left").select("path", "scope", "name", "one.found", "one.kind")


def symbol_slice(edges: DataFrame, name: str) -> DataFrame:
    """(node, side) of what a symbol calls and is called by, over any number of steps.

    The symbol is the one of that name or with that name after its module, else the first that contains it; side is
    self, callers or callees. No symbol, no rows.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    exact = (F.col("node") == name) | (F.substring_index("node", ":", -1) == name)
    fit = F.when(exact, 0).when(F.contains("node", F.lit(name)), 1)
    seed = nodes.where(fit.isNotNull()).orderBy(fit, "node").limit(1)
    sides = seed.select("node", F.lit("self").alias("side"))
    for side, backward in (("callers", True), ("callees", False)):
        reached = graph.reachable(edges, seed, backward=backward).select("node")
        sides = sides.unionByName(reached.join(seed, "node", "left_anti").select("node", F.lit(side).alias("side")))
    return sides


class Facts:
    """What resolving calls needs of files, each of which is parsed once: the rows are written, and read for each use.

    Of the files `silent` only the declarations are taken. `made` are calls or arguments.
    """

    _SCHEMA = "path string, part string, a string, b string, c string, d string, n long, flag boolean"

    def __init__(self, files: DataFrame, made: str, silent: DataFrame | None = None):
        def declared(path, tree, *_):
            return [(path, "declaration", *r[:3], None, None, None) for r in _of(tree).declarations(tree)] if tree else []

        def all_of(path, tree, *_):
            if not tree:
                return []
            front, out = _of(tree), declared(path, tree)
            out += [(path, "import", *r, None, None) for r in front.imports(tree)]
            if made == "calls":
                return out + [(path, made, caller, callee, None, None, n, waits) for caller, callee, waits, n in front.calls(tree)]
            return out + [(path, made, caller, callee, variable, None, n, None) for caller, callee, n, variable in front.arguments(tree)]

        rows = _parse_each(files, self._SCHEMA, all_of)
        if silent is not None:
            rows = rows.unionByName(_parse_each(silent, self._SCHEMA, declared))
        self.rows = Scratch(files.sparkSession, "facts").keep(rows)

    def of(self, part: str, **names: str) -> DataFrame:
        return self.rows.where(F.col("part") == part).select("path", *(F.col(c).alias(n) for n, c in names.items()))

    def declarations(self) -> DataFrame:
        return self.of("declaration", kind="a", owner="b", name="c")

    def imports(self) -> DataFrame:
        return self.of("import", module="a", symbol="b", bound="c", usage="d")

    def calls(self) -> DataFrame:
        return self.of("calls", caller="a", callee="b", is_async="flag", times="n")

    def arguments(self) -> DataFrame:
        return self.of("arguments", caller="a", callee="b", place="n", variable="c")


def symbols(files: DataFrame | Facts) -> DataFrame:
    """(symbol, module, path, name) of functions, methods and classes, symbols as module:name."""
    module = text.module_name(F.col("path"))
    declared = files.declarations() if isinstance(files, Facts) else declarations(files)
    defined = declared.where("kind IN ('function', 'method', 'class')")
    full = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    return defined.select(F.concat(module, F.lit(":"), full).alias("symbol"), module.alias("module"), "path", full.alias("name"))


def resolve_calls(made: DataFrame, files: DataFrame | Facts) -> DataFrame:
    """`made` (path, caller, callee, ...) as (src, dst, ...): callers and callees as symbols, those not found left out.

    A callee is meant by its import, else as a function of its own file, else as the only one of its name. A name that
    is imported more than once in a file means the smallest module and symbol.
    """
    module = text.module_name(F.col("path"))
    named = F.struct(F.regexp_replace("module", r"^\.+", "").alias("module"), F.nullif("symbol", F.lit("")).alias("name"))
    imported = files.imports() if isinstance(files, Facts) else imports(files)
    bound = imported.where("symbol <> '*' AND bound <> ''").groupBy(F.col("path").alias("i_path"), "bound").agg(F.min(named).alias("meant"))
    last, head = F.element_at(F.split("callee", r"\."), -1), F.substring_index("callee", ".", 1)
    met = made.withColumn("head", head).join(bound, (F.col("path") == F.col("i_path")) & (F.col("head") == F.col("bound")), "left")
    refs = met.select(
        F.concat(module, F.lit(":"), "caller").alias("src"),
        F.coalesce("meant.module", module).alias("module"),
        "path",
        F.coalesce("meant.name", last).alias("name"),
        *made.drop("path", "caller", "callee").columns,
    )
    found = resolve.resolve(refs, symbols(files)).where("symbol IS NOT NULL")
    return found.withColumnRenamed("symbol", "dst").drop("module", "path", "name", "how")


def _module(symbol) -> Column:
    return F.substring_index(symbol, ":", 1)


def call_graph(files: DataFrame) -> DataFrame:
    """(src, dst, calls, is_cross): calls between functions of all files."""
    facts = Facts(files, "calls")
    found = resolve_calls(facts.calls(), facts)
    return found.groupBy("src", "dst").agg(F.sum("times").alias("calls"), F.max(_module("src") != _module("dst")).alias("is_cross"))


def flow_graph(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(src, dst, place, variable, is_return): what flows between functions of all files.

    Arguments flow from the caller to the callee, at their place, -2 if by name; at place -1 a result flows back.
    Where `changed` (column path) is given, only the calls in these files are wanted.
    """
    if changed is None:
        facts = Facts(files, "arguments")
    else:
        facts = Facts(files.join(changed, "path", "left_semi"), "arguments", files.join(changed, "path", "left_anti"))
    found = resolve_calls(facts.arguments(), facts)
    back = F.col("place") == py.RESULT
    src, dst = F.when(back, F.col("dst")).otherwise(F.col("src")), F.when(back, F.col("src")).otherwise(F.col("dst"))
    return found.select(src.alias("src"), dst.alias("dst"), "place", "variable", back.alias("is_return")).distinct()


def update_flow(old: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """The flow graph `old` after files (column path of `changed`) took the contents they have in `files`.

    Edges that the changed modules' calls made, results included, are replaced by those they make now; only these files
    are read for arguments. An unchanged file whose names now mean something else keeps its edges until it is read.
    """
    gone = changed.select(text.module_name(F.col("path")).alias("gone")).distinct()
    caller = F.when(F.col("is_return"), F.col("dst")).otherwise(F.col("src"))
    kept = old.join(gone, _module(caller) == F.col("gone"), "left_anti")
    return kept.unionByName(flow_graph(files, changed)).distinct()


def graph_digest(edges: DataFrame) -> DataFrame:
    """One row (edges, digest): SHA-256 over all edges, as JSON, in their order; equal graphs have equal digests."""
    line = F.to_json(F.struct(*sorted(edges.columns)))
    made = merkle.repository_digest(edges.select(line.alias("path"), F.sha2(line, 256).alias("digest")))
    return made.select(F.col("files").alias("edges"), F.col("repository_digest").alias("digest"))


def flow_offsets(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A flow graph as ((node, symbol), (src, dst, flags)): flags use or return.

    Nodes are numbered from 0 in the order of their CRC-32 and symbol, which deals them evenly to the tasks.
    """
    names = edges.select(F.explode(F.array("src", "dst")).alias("symbol")).distinct().withColumn("position", F.crc32(F.col("symbol").cast("binary")))
    nodes = intern.intern(names).select(F.col("id").alias("node"), "symbol")
    a, b = (nodes.select(F.col("symbol").alias(end), F.col("node").alias(f"{end}_node")) for end in ("src", "dst"))
    flags = F.when(F.col("is_return"), graph.RETURNS).otherwise(graph.USES)
    numbered = edges.join(a, "src").join(b, "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), flags.alias("flags"))
    return nodes, graph.simple_graph(numbered)


def program_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, part, action, target) of what two versions of the same paths differ in.

    Parts are declaration (added, removed, changed: the signature), dependency (added, removed, usage_changed),
    structure (body_changed: a function whose signature may be the same), call_graph (added, removed), control_flow and
    data_flow (changed: the function has another number of blocks, edges or flows; Python only).
    """

    def rows(version: DataFrame) -> DataFrame:
        def each(path, tree, *_):
            return [(path, *r) for r in _parts(tree)] if tree else []

        return _parse_each(version, "path string, part string, target string, value string", each)

    key = ["path", "part", "target"]
    old, new = _differing(old, new)
    # A name may be declared or called more than once; its values then stand together.
    one = lambda df: rows(df).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    told = diff.keyed_diff(one(old), one(new), key, "value")
    only_common = F.col("part").isin("structure", "control_flow", "data_flow")
    action = (
        F.when((F.col("part") == "dependency") & (F.col("status") == "changed"), "usage_changed")
        .when((F.col("part") == "structure") & (F.col("status") == "changed"), "body_changed")
        .otherwise(F.col("status"))
    )
    return told.where(~only_common | (F.col("status") == "changed")).select("path", "part", action.alias("action"), "target")


def _differing(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both versions without the paths that hold the same contents, as often, in both: these need not be parsed.

    Rows without a path have no counterpart and stay.
    """
    digest = F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("digest")
    each = old.select("path", digest, F.lit(1).alias("n")).unionByName(new.select("path", digest, F.lit(-1).alias("n")))
    told = each.groupBy("path", "digest").agg(F.sum("n").alias("n")).where("n <> 0 OR path IS NULL")
    paths = Scratch(old.sparkSession, "diff").keep(told.select(F.col("path").alias("differing")).distinct())
    one, other = (df.join(paths, df["path"].eqNullSafe(F.col("differing")), "left_semi") for df in (old, new))
    return one, other


def _parts(tree: Tree) -> Iterator[tuple[str, str, str]]:
    """(part, target, value) of all that program_diff compares."""
    front = _of(tree)
    for kind, owner, name, signature in front.declarations(tree):
        yield "declaration", f"{owner}.{name}" if owner else name, f"{kind} {signature}"
    for module, symbol, bound, usage in front.imports(tree):
        yield "dependency", " ".join(x for x in (module, symbol, f"as {bound}") if x), usage
    for caller, callee, *_ in front.calls(tree):
        yield "call_graph", f"{caller} -> {callee}", ""
    for name, body in front.bodies(tree):
        yield "structure", name, body
    for name, f in _functions(tree):
        blocks, edges = py.control_flow(f)
        yield "control_flow", name, f"{len(blocks)} {len(edges)}"
        yield "data_flow", name, str(len(py.data_flow(f)))
