"""JavaScript, TypeScript, Go and Rust source as facts and digests, from tokens and matched brackets.

The four languages share their shape: keywords open declarations, brackets hold parameters, members and bodies. One
lexer and one walk serve them all; what differs is in the tables below.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from hashlib import sha256

from siltstone.functions.digest import TIERS

_ANY = r"//[^\n]*|/\*.*?\*/"
_NUMBER = r"\d[\w.]*"
_OPERATOR = r"\.\.\.|===|!==|<<=|>>=|&&|\|\||\?\?|\?\.|=>|->|<-|::|:=|\+\+|--|[-+*/%&|^!=<>]=|\S"
#: Literals of each language; an apostrophe in Rust is a lifetime unless it closes after one character.
_LITERAL = {
    "javascript": r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|' + r"'(?:\\.|[^'\\\n])+'",
    "rust": r'b?r(?P<hashes>#*)".*?"(?P=hashes)|b?"(?:\\.|[^"\\])*"|' + r"b?'(?:\\[^']+|[^'\\])'",
}
_LITERAL["typescript"] = _LITERAL["javascript"]
_NAME = {"rust": r"'[^\W\d]\w*|(?:r#)?[^\W\d]\w*"}
_LEXER = {
    k: re.compile(f"(?s)(?P<gap>\\s+|{_ANY})|(?P<literal>{v})|(?P<number>{_NUMBER})|(?P<name>{_NAME.get(k, r'[^\W\d]\w*|[$#][\w$]*')}[$]*)|(?P<operator>{_OPERATOR})")
    for k, v in _LITERAL.items()
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_FUNCTION = {"javascript": "function", "typescript": "function", "go": "func", "rust": "fn"}
_HOLDERS = {
    "javascript": {"class": "class"},
    "typescript": {"class": "class", "interface": "interface"},
    "go": {},
    "rust": {"struct": "struct", "trait": "trait", "impl": "impl", "mod": "module"},
}
_BINDERS = {"javascript": ("const", "let", "var", "using"), "typescript": ("const", "let", "var", "using"), "go": ("var", "const"), "rust": ("let", "const", "static")}
_FLOW = ("if", "else", "for", "while", "do", "loop", "switch", "match", "select", "case", "default", "try", "catch", "finally", "return", "throw", "break", "continue", "go", "defer", "await", "yield")
_CONSTANT = {*_FLOW, "true", "false", "null", "undefined", "nil", "new", "function", "func", "fn", "mut", "typeof", "as"}
_NO_CALL = {*_FLOW, "function", "func", "fn", "super", "typeof", "in", "of", "new", "as", "where", "with", "type", "interface", "struct", "import", "map", "chan"} - {"map"}


class Source:
    """Tokens of one file, where each bracket closes, and whether a line began before a token."""

    def __init__(self, text: str, language: str):
        self.language = language
        self.kinds: list[str] = []
        self.tokens: list[str] = []
        self.fresh: list[bool] = []
        self.pairs: dict[int, int] = {}
        lexer, at, line = _LEXER[language], 0, True
        script = language in ("javascript", "typescript")
        stack: list[int] = []
        while at < len(text):
            found = lexer.match(text, at)
            kind, token = found.lastgroup if found.lastgroup != "hashes" else "literal", found.group()
            if script and token[0] == "/" and kind == "operator" and self._may_begin():
                found = _REGEX.match(text, at) or found
                kind, token = ("literal" if len(found.group()) > 2 else kind), found.group()
            at = found.end()
            if kind == "gap":
                line = line or "\n" in token
                continue
            if token in ('"', "`") or token == "'" and language != "rust":
                raise ValueError("a literal without its end")
            if script and kind == "literal" and token[0] == "'" and '"' not in token:
                token = f'"{token[1:-1]}"'
            self.kinds.append(kind)
            self.tokens.append(token.removeprefix("r#") if kind == "name" else token)
            self.fresh.append(line)
            line = False
            if kind == "operator" and token in _OPEN:
                stack.append(len(self.tokens) - 1)
            elif kind == "operator" and token in _OPEN.values():
                if not stack or _OPEN[self.tokens[stack[-1]]] != token:
                    raise ValueError(f"{token} closes nothing")
                self.pairs[stack.pop()] = len(self.tokens) - 1
        if stack:
            raise ValueError(f"{self.tokens[stack[-1]]} is never closed")
        self.found: list[tuple] = []  # (kind, owner, name, head start, head end, body start, body end)
        self._declare(0, len(self.tokens), "", False)

    def _may_begin(self) -> bool:
        """Whether an operand may stand here, so that a slash begins a regular expression."""
        return not self.tokens or self.kinds[-1] == "operator" and self.tokens[-1] not in (")", "]", "}") or self.tokens[-1] in ("return", "typeof", "case", "in", "of")

    def at(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def text(self, i: int, j: int) -> str:
        return " ".join(self.tokens[i:j])

    def _angles(self, i: int) -> int:
        """Behind the type parameters that may begin at i."""
        if self.at(i) == "[" and self.language == "go":
            return self.pairs[i] + 1
        depth = 0
        while self.at(i) and (depth or self.at(i) == "<"):
            depth += (self.at(i) == "<") - (self.at(i) == ">") - 2 * (self.at(i) == ">>")
            i += 1
        return i

    def _body(self, i: int, end: int) -> tuple[int, int]:
        """(end of the head, end of the body) of what stands from i on; without a body both are the same."""
        while i < end:
            token, before = self.tokens[i], self.at(i - 1)
            if token == "{" and before not in (":", "|", "&", "interface", "struct"):
                return i, self.pairs[i] + 1
            if token in (";", "}", ",") or self.fresh[i] and before not in ("where", ",", "->", ":", ">", ")") and token not in ("{", "where", "->"):
                return i, i
            i = self.pairs[i] + 1 if i in self.pairs else i + 1
        return end, end

    def _function(self, kind: str, owner: str, name: str, i: int, end: int, start: int) -> int:
        """A function whose type parameters or parameters begin at i."""
        opened = self._angles(i)
        if self.at(opened) != "(":
            return i
        head, last = self._body(self.pairs[opened] + 1, end)
        self.found.append((kind, owner, name, i, head, head, last))
        self._declare(head + 1, last - 1, f"{owner}.{name}" if owner else name, True)
        return max(last, start + 1)

    def _declare(self, i: int, end: int, owner: str, inside: bool, members: bool = False) -> None:
        """Declarations from i to end; in a function only nested functions and classes count."""
        while i < end:
            token, following, start = self.tokens[i], self.at(i + 1), i
            if self.kinds[i] == "name" and self.at(i - 1) != ".":
                if token == "import" and self.language in ("javascript", "typescript") and following not in ("(", "."):
                    while i < end and self.kinds[i] != "literal" and self.tokens[i] != ";":
                        i += 1
                    continue
                if token == _FUNCTION[self.language]:
                    to = owner
                    i += 1 + (following == "*")
                    if self.language == "go" and not inside and self.at(i) == "(":
                        named = [t for t, k in zip(self.tokens[i : self.pairs[i]], self.kinds[i : self.pairs[i]], strict=True) if k == "name"]
                        to, i = (named[1] if len(named) > 1 else named[0] if named else ""), self.pairs[i] + 1
                    if i < end and self.kinds[i] == "name":
                        i = self._function("method" if to and not inside else "function", to, self.tokens[i], i + 1, end, start)
                    continue
                if token in _HOLDERS[self.language] and i + 1 < end and (self.kinds[i + 1] == "name" or following == "<"):
                    kind = _HOLDERS[self.language][token]
                    name_at = self._angles(i + 1)
                    head, last = self._body(name_at + 1, end)
                    implemented = [j for j in range(name_at, head) if self.tokens[j] == "for"] if kind == "impl" else []
                    name = self.at(implemented[0] + 1) if implemented else self.at(name_at)
                    self.found.append((kind, owner, name, name_at + 1 if kind != "impl" else name_at, head, head, last))
                    within = owner if kind == "module" and not owner else name
                    self._declare(head + 1, last - 1, within if kind != "module" else "", inside, kind not in ("struct", "module"))
                    i = max(last, i + 2)
                    continue
                if token == "type" and not inside and i + 1 < end and self.kinds[i + 1] == "name":
                    behind = self._angles(i + 2) if self.language != "go" or self.at(i + 3) not in ("]",) and self.at(i + 2) == "[" and self.at(i + 4) else i + 2
                    shape = self.at(behind)
                    if self.language == "go" and shape in ("struct", "interface") and self.at(behind + 1) == "{":
                        last = self.pairs[behind + 1] + 1
                        self.found.append((shape, owner, following, i + 2, behind, behind + 1, last))
                        if shape == "interface":
                            self._declare(behind + 2, last - 1, following, False, True)
                    else:
                        last = behind + 1
                        while last < end and self.tokens[last] != ";" and not (self.fresh[last] and self.at(last - 1) not in ("=", "|", "&") and self.tokens[last] not in ("|", "&")):
                            last = self.pairs[last] + 1 if last in self.pairs else last + 1
                        self.found.append(("type", owner, following, i + 2, last, last, last))
                    i = last
                    continue
                if token in _BINDERS[self.language] and not inside and i + 1 < end and self.kinds[i + 1] == "name" and following != "fn":
                    bound = i + 1 + (following == "mut")
                    behind = bound + 1
                    while behind < end and self.tokens[behind] not in ("=", ";", "in", "of") and not self.fresh[behind]:
                        behind = self.pairs[behind] + 1 if behind in self.pairs else behind + 1
                    self.found.append(("variable", owner, self.at(bound), bound + 1, behind, behind, behind))
                    i = behind
                    continue
                if members and following in ("(", "<") and self.language != "rust" and token not in _NO_CALL:
                    i = max(self._function("method", owner, token, i + 1, end, start), i + 1)
                    continue
            # Inside brackets and bodies of other statements there may be nested functions.
            if members and i in self.pairs:
                i = self.pairs[i]
            i += 1


def parse(text: str, language: str) -> Source:
    return Source(text, language)


def declarations(source: Source) -> list[tuple]:
    """(kind, owner, name, signature), the signature as its tokens."""
    return [(kind, owner, name, source.text(i, j)) for kind, owner, name, i, j, *_ in source.found]


def _uses(text: str, prefix: str = "") -> list[tuple[str, str, str]]:
    """(module, symbol, bound) of a Rust path with groups and new names."""
    text = text.strip()
    if "{" in text:
        head, inner = text.split("{", 1)
        inner, depth, part, parts = inner.rsplit("}", 1)[0], 0, "", []
        for c in inner + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        return [u for p in parts if p.strip() for u in _uses(p, prefix + head.strip())]
    path, _, alias = text.partition(" as ")
    module, _, symbol = (prefix + path.strip()).rpartition("::")
    if symbol == "self":
        module, _, symbol = module.rpartition("::")
    return [(module, symbol, alias.strip() or symbol)]


def imports(source: Source) -> list[tuple]:
    """(module, symbol, bound, usage); a default import is of the symbol `default`, a namespace of `*`."""
    rows: list[tuple[str, str, str]] = []
    spent: set[int] = set()
    t, kinds, n = source.tokens, source.kinds, len(source.tokens)
    for i, token in enumerate(t):
        if kinds[i] != "name" or source.at(i - 1) == ".":
            continue
        if source.language == "rust" and token == "use":
            j = t.index(";", i) if ";" in t[i:] else n
            rows += _uses(re.sub(r" ?(::|[{},]) ?", r"\1", source.text(i + 1, j)))
        elif source.language == "go" and token == "import":
            j = source.pairs[i + 1] if source.at(i + 1) == "(" else i + 2 + (i + 1 < n and kinds[i + 1] != "literal")
            for k in range(i + 1, min(j, n)):
                if kinds[k] == "literal":
                    path = t[k][1:-1]
                    rows.append((path, "", t[k - 1] if t[k - 1] not in ("import", "(") and kinds[k - 1] != "literal" else path.rsplit("/", 1)[-1]))
        elif source.language in ("javascript", "typescript") and token == "import" and source.at(i + 1) not in ("(", "."):
            j = i + 1
            while j < n and kinds[j] != "literal" and t[j] != ";":
                j += 1
            module = t[j][1:-1] if j < n else ""
            names = re.sub(r"\btype (?=[\w$*{])", "", source.text(i + 1, j).removesuffix(" from"))
            outer, _, group = names.partition("{")
            one = [p.strip() for p in outer.split(",") if p.strip()]
            rows += [(module, "*", p.removeprefix("* as ")) if p.startswith("*") else (module, "default", p) for p in one]
            for p in (p.strip() for p in group.rstrip("} ").split(",")):
                if p:
                    symbol, _, alias = p.partition(" as ")
                    rows.append((module, symbol, alias or symbol))
            if not one and not group:
                rows.append((module, "", ""))
        else:
            continue
        spent.update(range(i, j))
    heads = {callee.split(".")[0].split("::")[0].rstrip("!") for _, callee, *_ in calls(source)}
    bases = {x for kind, *_, i, j, _, _ in source.found if kind in ("class", "interface", "trait", "impl", "struct") for x in t[i:j]}
    read = {x for i, x in enumerate(t) if i not in spent and kinds[i] == "name" and source.at(i - 1) != "."}
    usage = lambda x: "inheritance" if x in bases else "call" if x in heads else "value_reference" if x in read else "unused"
    return [(*r, usage(r[2])) for r in rows]


def _call_sites(source: Source):
    """(caller, callee, is_async, opening bracket) of every call; callee as it is written, a Rust macro with its mark."""
    t, kinds = source.tokens, source.kinds
    # Bodies nest, so the last one that begins before a call and holds it is the innermost.
    bodies = sorted((b, e, f"{o}.{n}" if o else n) for k, o, n, _, _, b, e in source.found if k in ("function", "method") and e > b)
    starts = [b for b, *_ in bodies]
    heads = {i - 1 for k, _, _, i, *_ in source.found if k in ("function", "method")}
    for i, token in enumerate(t):
        macro = source.language == "rust" and source.at(i + 1) == "!" and source.at(i + 2) in _OPEN
        if kinds[i] != "name" or token in _NO_CALL or i in heads or not (macro or source.at(i + 1) == "("):
            continue
        first = i
        while source.at(first - 1) in (".", "::", "?.") and first >= 2 and kinds[first - 2] == "name":
            first -= 2
        dynamic = source.at(first - 1) in (".", "?.")
        k = bisect_left(starts, i) - 1
        while k >= 0 and bodies[k][1] <= i:
            k -= 1
        waits = source.at(first - 1) in ("await", "go") or source.language == "rust" and (p := source.pairs.get(i + 1)) is not None and source.at(p + 1) == "." and source.at(p + 2) == "await"
        callee = "<dynamic>" if dynamic else "".join(t[first : i + 1]) + "!" * macro
        yield bodies[k][2] if k >= 0 else "<top-level>", callee, bool(waits), i + 1 + macro


def calls(source: Source) -> list[tuple]:
    """(caller, callee, is_async, times)."""
    out = Counter((caller, callee, waits) for caller, callee, waits, _ in _call_sites(source))
    return [(*k, n) for k, n in sorted(out.items())]


def arguments(source: Source) -> list[tuple]:
    """(caller, callee, place, variable) of what calls pass, as of Python; these languages have no arguments by name."""
    t, kinds = source.tokens, source.kinds
    out: set = set()
    for caller, callee, _, opened in _call_sites(source):
        place, read, k, end = 0, set(), opened + 1, source.pairs[opened]
        inner = 0  # where the brackets end inside which commas are another's
        while k <= end:
            if k == end or t[k] == "," and k > inner:
                if k < end or k > opened + 1 and t[k - 1] != ",":
                    out.update((caller, callee, place, v) for v in read or {"<const>"})
                place, read = place + 1, set()
            elif k in source.pairs:
                inner = max(inner, source.pairs[k])
            elif kinds[k] == "name" and source.at(k - 1) not in (".", "?.", "::") and source.at(k + 1) not in ("::", "!") and t[k] not in _CONSTANT:
                if not (source.at(k - 1) in ("{", ",") and source.at(k + 1) == ":"):  # the key of a literal
                    read.add(t[k])
            k += 1
        out.add((caller, callee, -1, "<return>"))
    return sorted(out)


def _bound(source: Source, i: int, body: int, end: int) -> list[str]:
    """Names that a function binds, in order: its parameters, then its locals."""
    t, kinds = source.tokens, source.kinds
    opened = source._angles(i)
    names, k = [], opened + 1
    while k < source.pairs[opened]:
        if kinds[k] == "name" and source.at(k - 1) in ("(", ",", "...", "mut") and t[k] not in ("mut", "self"):
            names.append(t[k])
        k = source.pairs[k] + 1 if k in source.pairs else k + 1
    for k in range(body, end):
        if kinds[k] == "name" and (source.at(k + 1) == ":=" or source.at(k - 1) in _BINDERS[source.language] and t[k] != "mut" or source.at(k - 1) == "mut" and source.at(k - 2) == "let"):
            names.append(t[k])
    return list(dict.fromkeys(names))


def _numbered(source: Source) -> list[str]:
    """Tokens, with a function's locals as its place and their number in it."""
    t = list(source.tokens)
    for kind, _, _, head, _, body, last in source.found:
        if kind in ("function", "method") and last > body:
            numbered = {name: f"@{head}.{n}" for n, name in enumerate(_bound(source, head, body, last))}
            for k in range(head, last):
                key = k > body and source.at(k - 1) in ("{", ",") and source.at(k + 1) == ":"
                if source.kinds[k] == "name" and source.at(k - 1) not in (".", "?.", "::") and not key and source.tokens[k] in numbered:
                    t[k] = numbered[source.tokens[k]]
    return t


def structure(source: Source) -> tuple[str, ...]:
    """Tokens without comments, layout and idle separators, locals numbered by where they are bound."""
    return _told(source, _numbered(source), 0, len(source.tokens))


def bodies(source: Source) -> list[tuple[str, str]]:
    """(qualified name, digest) of every function's body, wherever it stands and whatever its locals are called."""
    t = _numbered(source)
    made = [(f"{o}.{n}" if o else n, b, e) for k, o, n, _, _, b, e in source.found if k in ("function", "method") and e > b]
    plain = lambda b, e: [re.sub(r"^@\d+\.", "@", x) for x in _told(source, t, b, e)]
    return [(name, sha256(repr(plain(b, e)).encode("utf-8", "surrogatepass")).hexdigest()) for name, b, e in made]


def _told(source: Source, t: list[str], i: int, end: int) -> tuple[str, ...]:
    """Tokens from i to end that say something; a line's end ends a statement as a semicolon does."""
    idle = lambda k: t[k] == ";" or t[k] == "," and source.at(k + 1) in (")", "]", "}")
    return tuple(t[k] for k in range(i, end) if source.kinds[k] != "operator" or not idle(k))


def flow(source: Source) -> list[tuple]:
    """Of each function the words that steer it, with the braces that nest them."""
    made = [(f"{o}.{n}" if o else n, b, e) for k, o, n, _, _, b, e in source.found if k in ("function", "method") and e > b]
    return sorted((n, tuple(x for x in source.tokens[b:e] if x in _FLOW or x in ("{", "}"))) for n, b, e in made)


def locals_used(source: Source) -> list[tuple]:
    """Of each function (number of the local, places where it stands, by token) without the names themselves."""
    out = []
    for kind, owner, name, head, _, body, last in source.found:
        if kind in ("function", "method") and last > body:
            inside = [k for k in range(body, last) if source.kinds[k] != "operator" or source.tokens[k] not in (";", ",")]
            for n, local in enumerate(_bound(source, head, body, last)):
                at = tuple(p for p, k in enumerate(inside) if source.tokens[k] == local and source.at(k - 1) != ".")
                out.append((owner, name, n, at))
    return sorted(out)


def contracts(source: Source) -> list[tuple]:
    """Of each type the names and signatures of its methods, without the type's own name."""
    held: dict[str, list] = {}
    for kind, owner, name, i, j, *_ in source.found:
        if kind == "method":
            held.setdefault(owner, []).append((name, source.text(i, j)))
    return sorted(tuple(sorted(v)) for v in held.values())


def tiers(source: Source, content: bytes) -> dict[str, str]:
    facts = {
        "structural": structure(source),
        "declaration": sorted(declarations(source)),
        "dependency": sorted(imports(source)),
        "call_graph": calls(source),
        "control_flow": flow(source),
        "data_flow": locals_used(source),
        "type_contract": contracts(source),
    }
    found = {"source": sha256(content).hexdigest()}
    found |= {k: sha256(repr(v).encode("utf-8", "surrogatepass")).hexdigest() for k, v in facts.items()}
    found["composite"] = sha256(":".join(f'"{found[t]}"' for t in TIERS[1:8]).encode()).hexdigest()
    return found
