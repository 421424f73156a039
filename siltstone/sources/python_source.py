"""Python source as facts and digests: one parse per file, in Arrow batches.

A file's tiers are the digests of what it says at each level: its bytes, its normalised structure, declarations,
dependencies, calls, control flow, data flow, type contracts, and a composite of all but the bytes. The structure is
taken after comments, docstrings and formatting are gone, locals are numbered by where they are bound, pure
declarations are ordered by name, and operands of commutative operators by their own text.
"""

from __future__ import annotations

import ast
import symtable
from collections import Counter
from hashlib import sha256

from siltstone.functions.digest import TIERS

_COMMUTES = (ast.Add, ast.Mult, ast.BitAnd, ast.BitOr, ast.BitXor)
_FLIP = {ast.Gt: ast.Lt, ast.GtE: ast.LtE}
_TEXTUAL = (ast.JoinedStr, ast.List, ast.Tuple, ast.ListComp)
_EFFECTS = (ast.Call, ast.Await, ast.Yield, ast.YieldFrom, ast.NamedExpr, ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_ENDS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
_KEEP = (":preserve:", "@preserve", ":doc:")


def _digest(value) -> str:
    return sha256(repr(value).encode("utf-8", "surrogatepass")).hexdigest()


def _is_string(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def _suite(body: list[ast.stmt]) -> list[ast.stmt]:
    """Without bare strings that are not kept, idle `pass`, and what stands after a statement that ends the suite."""
    kept = [s for s in body if not _is_string(s) or any(k in s.value.value for k in _KEEP)]
    kept = [s for s in kept if not isinstance(s, ast.Pass)]
    for i, s in enumerate(kept):
        if isinstance(s, _ENDS):
            kept = kept[: i + 1]
            break
    return kept or [ast.Pass()]


def _pure(node: ast.AST) -> bool:
    return not any(isinstance(n, _EFFECTS) for n in ast.walk(node))


def _may_join(node: ast.expr) -> bool:
    """Whether + may join rather than add, so that its order matters."""
    return isinstance(node, _TEXTUAL) or isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes))


class _Namer:
    """Numbers for the locals of one function, in the order in which they are bound."""

    def __init__(self, function: ast.AST | None, outer: _Namer | None = None):
        self.names: dict[str, str] = dict(outer.names) if outer else {}
        self.depth = outer.depth + 1 if outer else 0
        if function is None:
            return
        free = {n for s in ast.walk(function) if isinstance(s, (ast.Global, ast.Nonlocal)) for n in s.names}
        a = function.args
        bound = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
        bound += [n.id for n in _own(function) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))]
        bound += [n.name for n in _own(function) if isinstance(n, ast.ExceptHandler) and n.name]
        order = 0
        seen: set[str] = set()
        for name in bound:
            if name not in seen and name not in free:
                seen.add(name)
                self.names[name] = f"@v{self.depth}.{order}"
                order += 1

    def __call__(self, name: str) -> str:
        return self.names.get(name, name)


def _own(function: ast.AST):
    """Nodes of a function in source order, without those of functions and classes inside it."""
    stack = list(reversed(function.body if isinstance(function.body, list) else [function.body]))
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            stack.extend(reversed(list(ast.iter_child_nodes(node))))


def normal(node, names: _Namer):
    """A nested tuple that stands for a subtree up to everything that the structure ignores."""
    if isinstance(node, list):
        return tuple(normal(n, names) for n in node)
    if not isinstance(node, ast.AST):
        return (type(node).__name__, repr(node)) if node is not None else None
    if isinstance(node, ast.Name):
        return ("name", names(node.id))
    if isinstance(node, ast.arg):
        return ("arg", names(node.arg), normal(node.annotation, names))
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        inner = _Namer(node, names)
        head = (type(node).__name__, node.name, tuple(sorted(map(ast.unparse, node.decorator_list))), normal(node.returns, names))
        return (*head, normal(node.args, inner), normal(_suite(node.body), inner))
    if isinstance(node, ast.Lambda):
        inner = _Namer(node, names)
        return ("lambda", normal(node.args, inner), normal(node.body, inner))
    if isinstance(node, ast.ClassDef):
        return ("class", node.name, tuple(sorted(map(ast.unparse, node.decorator_list))), normal(node.bases, names), normal(node.keywords, names), normal(_suite(node.body), names))
    if isinstance(node, ast.ExceptHandler):
        return ("except", normal(node.type, names), names(node.name) if node.name else None, normal(_suite(node.body), names))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not) and isinstance(node.operand, ast.UnaryOp) and isinstance(node.operand.op, ast.Not):
        return normal(node.operand.operand, names)
    if isinstance(node, ast.BinOp) and isinstance(node.op, _COMMUTES):
        parts, todo = [], [node]
        while todo:
            x = todo.pop()
            if isinstance(x, ast.BinOp) and type(x.op) is type(node.op):
                todo += [x.right, x.left]
            else:
                parts.append(x)
        forms = [normal(x, names) for x in parts]
        free = all(map(_pure, parts)) and not (isinstance(node.op, ast.Add) and any(map(_may_join, parts)))
        return ("fold", type(node.op).__name__, tuple(sorted(forms, key=repr) if free else forms))
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        op, left, right = type(node.ops[0]), node.left, node.comparators[0]
        if op in _FLIP:
            op, left, right = _FLIP[op], right, left
        sides = (normal(left, names), normal(right, names))
        if op in (ast.Eq, ast.NotEq) and _pure(left) and _pure(right):
            sides = tuple(sorted(sides, key=repr))
        return ("compare", op.__name__, *sides)
    if isinstance(node, ast.Call):
        words = tuple(sorted((repr(k.arg), normal(k.value, names)) for k in node.keywords))
        return ("call", normal(node.func, names), normal(node.args, names), words)
    if isinstance(node, ast.If) and isinstance(node.test, ast.UnaryOp) and isinstance(node.test.op, ast.Not) and node.orelse:
        return ("If", normal(node.test.operand, names), normal(_suite(node.orelse), names), normal(_suite(node.body), names))
    out = [type(node).__name__]
    for field, value in ast.iter_fields(node):
        if field in ("ctx", "type_comment", "lineno", "kind"):
            continue
        if field in ("body", "orelse", "finalbody") and isinstance(value, list) and value and isinstance(value[0], ast.stmt):
            value = _suite(value)
        out.append(normal(value, names))
    return tuple(out)


def structure(tree: ast.Module):
    """Imports and pure declarations in order of their text, then the rest as it stands."""
    names = _Namer(None)
    pure, rest = [], []
    for s in _suite(tree.body):
        is_pure = isinstance(s, (ast.Import, ast.ImportFrom)) or isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) and not s.decorator_list
        (pure if is_pure else rest).append(normal(s, names))
    return (tuple(sorted(pure, key=repr)), tuple(rest))


def _parameters(a: ast.arguments):
    given = [(x, "positional_only") for x in a.posonlyargs] + [(x, "plain") for x in a.args]
    defaults = [None] * (len(given) - len(a.defaults)) + list(a.defaults)
    rows = [(x, kind, d) for (x, kind), d in zip(given, defaults, strict=True)]
    rows += [(a.vararg, "rest", None)] if a.vararg else []
    rows += [(x, "keyword_only", d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    rows += [(a.kwarg, "keywords", None)] if a.kwarg else []
    text = lambda x: ast.unparse(x) if x is not None else None
    return tuple((x.arg, kind, text(x.annotation), text(d)) for x, kind, d in rows)


def declarations(tree: ast.Module) -> list[tuple]:
    """(kind, owner, name, signature) of functions, classes, methods and module variables."""
    out = []

    def visit(body, owner):
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                sign = (isinstance(s, ast.AsyncFunctionDef), _parameters(s.args), ast.unparse(s.returns) if s.returns else None, tuple(sorted(map(ast.unparse, s.decorator_list))))
                out.append(("method" if owner else "function", owner, s.name, repr(sign)))
            elif isinstance(s, ast.ClassDef):
                out.append(("class", owner, s.name, repr((tuple(map(ast.unparse, s.bases)), tuple(sorted(map(ast.unparse, s.decorator_list)))))))
                visit(s.body, f"{owner}.{s.name}" if owner else s.name)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Name):
                        out.append(("variable", owner, t.id, ast.unparse(s.annotation) if isinstance(s, ast.AnnAssign) else ""))

    visit(tree.body, "")
    return out


def imports(tree: ast.Module) -> list[tuple]:
    """(module, symbol, bound, usage) of every import; usage is the strongest use of the bound name."""
    rows = []
    for s in ast.walk(tree):
        if isinstance(s, ast.Import):
            rows += [(a.name, "", a.asname or a.name.split(".")[0]) for a in s.names]
        elif isinstance(s, ast.ImportFrom):
            rows += [("." * s.level + (s.module or ""), a.name, a.asname or a.name) for a in s.names]
    root = lambda n: root(n.value) if isinstance(n, (ast.Attribute, ast.Subscript)) else n.id if isinstance(n, ast.Name) else None
    nodes = list(ast.walk(tree))
    bases = {root(b) for n in nodes if isinstance(n, ast.ClassDef) for b in n.bases}
    called = {root(n.func) for n in nodes if isinstance(n, ast.Call)}
    typed_nodes = [x for n in nodes for x in (getattr(n, "annotation", None), getattr(n, "returns", None)) if isinstance(x, ast.AST)]
    in_types = {id(m) for x in typed_nodes for m in ast.walk(x)}
    typed = {m.id for x in typed_nodes for m in ast.walk(x) if isinstance(m, ast.Name)}
    read = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and id(n) not in in_types}

    def usage(name):
        return "inheritance" if name in bases else "call" if name in called else "value_reference" if name in read else "type_only" if name in typed else "unused"

    return [(*r, usage(r[2])) for r in rows]


def calls(tree: ast.Module) -> list[tuple]:
    """(caller, callee, is_async, times); callee as it is written, calls in nested functions by the outer one."""
    out: Counter = Counter()

    def visit(node, caller, waiting):
        for child in ast.iter_child_nodes(node):
            inner = caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = child.name if caller == "<top-level>" else f"{caller}.{child.name}"
            if isinstance(child, ast.Call):
                f = child.func
                name = ast.unparse(f) if isinstance(f, (ast.Name, ast.Attribute)) else "<dynamic>"
                out[caller, name, waiting or isinstance(node, ast.Await)] += 1
            visit(child, inner, isinstance(child, ast.Await))

    visit(tree, "<top-level>", False)
    return [(*k, n) for k, n in sorted(out.items())]


#: The place of an argument by name, and of a result, beside the places 0, 1, ... of the others.
BY_NAME, RESULT = -2, -1


def arguments(tree: ast.Module) -> list[tuple]:
    """(caller, callee, place, variable) of what calls pass: each variable in an argument, <const> where it has none.

    Arguments by name have one place for all, and their name before an equals sign (** for unpacked ones). Each call
    has a row for its result.
    """
    out: set = set()

    def read(expression):
        names = {n.id for n in ast.walk(expression) if isinstance(n, ast.Name)}
        return names or {"<const>"}

    def visit(node, caller):
        for child in ast.iter_child_nodes(node):
            inner = caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = child.name if caller == "<top-level>" else f"{caller}.{child.name}"
            if isinstance(child, ast.Call):
                f = child.func
                name = ast.unparse(f) if isinstance(f, (ast.Name, ast.Attribute)) else "<dynamic>"
                out.update((caller, name, i, v) for i, a in enumerate(child.args) for v in read(a))
                out.update((caller, name, BY_NAME, f"{k.arg or '**'}={v}") for k in child.keywords for v in read(k.value))
                out.add((caller, name, RESULT, "<return>"))
            visit(child, inner)

    visit(tree, "<top-level>")
    return sorted(out)


def functions(tree: ast.Module):
    """(qualified name, node) of every function, nested ones too."""

    def visit(node, prefix):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{child.name}"
                if not isinstance(child, ast.ClassDef):
                    yield name, child
                yield from visit(child, f"{name}.")
            else:
                yield from visit(child, prefix)

    return visit(tree, "")


def bodies(tree: ast.Module) -> list[tuple[str, str]]:
    """(qualified name, digest) of every function's body, whatever its parameters and locals are called."""
    return [(name, _digest(normal(_suite(f.body), _Namer(f)))) for name, f in functions(tree)]


def control_flow(function: ast.AST) -> tuple[list[tuple], list[tuple]]:
    """(block, statements) and (src, dst, condition) of a function; blocks in depth-first order from the entry.

    Both arms of a branch meet behind it, loops go back to their head, and jumps leave to where they lead; blocks that
    nothing reaches are gone.
    """
    blocks: list[list[str]] = [[]]
    edges: list[tuple[int, int, str]] = []
    names = _Namer(function)

    def new() -> int:
        blocks.append([])
        return len(blocks) - 1

    def link(src, dst, why="always"):
        if src is not None:
            edges.append((src, dst, why))

    def walk(body, at, stop, again, leave):
        """The block at which control goes on, None if it does not."""
        for s in _suite(body):
            if at is None:
                return None
            test = getattr(s, "test", None) or getattr(s, "iter", None) or getattr(s, "subject", None)
            if isinstance(s, ast.If):
                blocks[at].append(repr(normal(test, names)))
                yes, no, after = new(), new(), new()
                link(at, yes, "true")
                link(at, no, "false")
                ends = [walk(s.body, yes, stop, again, leave), walk(s.orelse, no, stop, again, leave) if s.orelse else no]
                for e in ends:
                    link(e, after)
                at = after if any(e is not None for e in ends) else None
            elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
                head, inside, after = new(), new(), new()
                link(at, head)
                blocks[head].append(repr((type(s).__name__, normal(test, names))))
                link(head, inside, "true")
                done = walk(s.orelse, new(), stop, again, leave) if s.orelse else after
                if s.orelse:
                    link(head, len(blocks) - 1 if done is None else done, "false")
                    link(done, after)
                else:
                    link(head, after, "false")
                link(walk(s.body, inside, after, head, leave), head)
                at = after
            elif isinstance(s, (ast.Try, ast.TryStar)):
                after, start = new(), new()
                link(at, start)
                ends = [walk([*s.body, *s.orelse], start, stop, again, leave)]
                for h in s.handlers:
                    caught = new()
                    link(start, caught, "exception")
                    ends.append(walk(h.body, caught, stop, again, leave))
                for e in ends:
                    link(e, after)
                at = walk(s.finalbody, after, stop, again, leave) if s.finalbody else after
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                blocks[at].append(repr(normal(s.items, names)))
                at = walk(s.body, at, stop, again, leave)
            elif isinstance(s, ast.Match):
                blocks[at].append(repr(normal(test, names)))
                after = new()
                for case in s.cases:
                    arm = new()
                    link(at, arm, "case")
                    blocks[arm].append(repr(normal(case.pattern, names)))
                    link(walk(case.body, arm, stop, again, leave), after)
                link(at, after, "no_case")
                at = after
            else:
                blocks[at].append(repr(normal(s, names)))
                if isinstance(s, (ast.Return, ast.Raise)):
                    link(at, leave, "return" if isinstance(s, ast.Return) else "raise")
                    return None
                if isinstance(s, (ast.Break, ast.Continue)):
                    link(at, stop if isinstance(s, ast.Break) else again, "jump")
                    return None
        return at

    leave = new()
    link(walk(function.body, 0, leave, leave, leave), leave)
    out: dict[int, list] = {}
    for src, dst, why in edges:
        out.setdefault(src, []).append((dst, why))
    order: dict[int, int] = {}
    stack = [0]
    while stack:
        b = stack.pop()
        if b not in order:
            order[b] = len(order)
            stack += [dst for dst, _ in reversed(out.get(b, []))]
    return (
        [(order[b], tuple(blocks[b])) for b in sorted(order, key=order.get)],
        sorted((order[s], order[d], why) for s, d, why in edges if s in order),
    )


def data_flow(function: ast.AST) -> list[tuple]:
    """(variable, definition, use) by position in the function, as each use sees the definitions that may reach it."""
    names = _Namer(function)
    at = 0
    out: list[tuple] = []

    def uses(node, live):
        # One position for all that a statement reads, so that the order of operands does not matter.
        nonlocal at
        at += 1
        read = {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} if node is not None else ()
        out.extend(sorted((names(name), d, at) for name in read for d in live.get(name, ())))

    def define(node, live):
        nonlocal at
        for n in ast.walk(node) if node is not None else ():
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                at += 1
                live[n.id] = {at}

    def merge(*arms):
        return {k: set().union(*(a.get(k, ()) for a in arms)) for k in {k for a in arms for k in a}}

    def walk(body, live):
        for s in _suite(body):
            if isinstance(s, ast.If):
                uses(s.test, live)
                live = merge(walk(s.body, dict(live)), walk(s.orelse, dict(live)) if s.orelse else live)
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                uses(s.iter if not isinstance(s, ast.While) else s.test, live)
                inner = dict(live)
                if not isinstance(s, ast.While):
                    define(s.target, inner)
                live = merge(live, walk(s.body, inner))
                live = merge(live, walk(s.orelse, dict(live))) if s.orelse else live
            elif isinstance(s, (ast.Try, ast.TryStar)):
                after = walk(s.body, dict(live))
                live = merge(after, *(walk(h.body, merge(live, after)) for h in s.handlers))
                live = walk(s.finalbody, live) if s.finalbody else live
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for i in s.items:
                    uses(i.context_expr, live)
                    define(i.optional_vars, live)
                live = walk(s.body, live)
            elif not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                    uses(ast.Name(s.target.id, ast.Load()), live)
                uses(s, live)
                define(s, live)
        return live

    start = {}
    for i, (name, *_) in enumerate(_parameters(function.args)):
        start[name] = {-1 - i}
    walk(function.body, start)
    return out


def contracts(tree: ast.Module) -> list[tuple]:
    """Methods of each class by name, parameters' kinds and types, and result, without the class's own name."""
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef):
            methods = [(m.name, tuple((k, t) for _, k, t, _ in _parameters(m.args)), ast.unparse(m.returns) if m.returns else None) for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            fields = [(f.target.id, ast.unparse(f.annotation)) for f in n.body if isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name)]
            out.append((tuple(sorted(fields)), tuple(sorted(methods, key=repr))))
    return sorted(out, key=repr)


def tiers(tree: ast.Module, content: bytes) -> dict[str, str]:
    found = {"source": sha256(content).hexdigest()}
    made = list(functions(tree))
    facts = {
        "structural": structure(tree),
        "declaration": sorted(declarations(tree)),
        "dependency": sorted(imports(tree)),
        "call_graph": calls(tree),
        "control_flow": [(n, control_flow(f)) for n, f in made],
        "data_flow": [(n, data_flow(f)) for n, f in made],
        "type_contract": contracts(tree),
    }
    found |= {k: _digest(v) for k, v in facts.items()}
    found["composite"] = sha256(":".join(f'"{found[t]}"' for t in TIERS[1:8]).encode()).hexdigest()
    return found


def scopes(source: str) -> list[tuple]:
    """(scope, parent, kind, name, seen, bindings) in the order of the text; the module is scope 0 and has no parent.

    seen are the scopes in which a name of this one is looked up, nearest first; classes around it are passed over.
    bindings are (name, kind), kind being parameter, import, definition or variable, of what is bound in the scope.
    """
    out: list[tuple] = []

    def kind_of(s: symtable.Symbol) -> str:
        return "parameter" if s.is_parameter() else "import" if s.is_imported() else "definition" if s.is_namespace() else "variable"

    def visit(table: symtable.SymbolTable, parent: int | None, outer: list[int]):
        at, kind = len(out), str(table.get_type())
        bound = sorted((s.get_name(), kind_of(s)) for s in table.get_symbols() if s.is_local() and (s.is_assigned() or s.is_parameter() or s.is_imported() or s.is_namespace()))
        out.append((at, parent, kind, table.get_name(), [at, *outer], bound))
        for child in table.get_children():
            visit(child, at, outer if kind == "class" else [at, *outer])

    visit(symtable.symtable(source, "file", "exec"), None, [])
    return out
