"""Type expressions of several languages as one normal form.

A form is a string: unions a|b in order without repeats, Array<T>, Map<K,V>, Optional<T>, records {a:T}, functions
(A,B)=>R. Optional is a union with null; promises and futures stand for what they give.
"""

from __future__ import annotations

from siltstone.operators.contracts import CONTAINERS

#: Names of one primitive in several languages, and wrappers that are looked through.
PRIMITIVES = {
    "str": "string", "String": "string", "&str": "string", "string": "string", "int": "int", "i32": "int", "i64": "int", "int64": "int",
    "u32": "int", "u64": "int", "float": "float", "f32": "float", "f64": "float", "float64": "float", "number": "float", "bool": "bool",
    "boolean": "bool", "None": "null", "null": "null", "undefined": "null", "nil": "null", "void": "null", "()": "null", "any": "any", "Any": "any",
}
TRANSPARENT = ("Promise", "Awaitable", "Future", "Box", "Rc", "Arc")
_OPEN, _CLOSE = "<[({", ">])}"


def split_top(text: str, sep: str) -> list[str]:
    """Parts between separators that stand in no bracket; the > of an arrow closes nothing."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE and not (c == ">" and text[i - 1 : i] in ("=", "-")):
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _union(parts: list[str]) -> str:
    flat = sorted({m for p in parts for m in split_top(p, "|") if m})
    return "|".join(flat) if flat else "never"


def normal_type(text: str | None) -> str:
    s = (text or "").strip()
    while s.startswith("(") and s.endswith(")") and "=>" not in s and len(split_top(s[1:-1], ",")) == 1 and split_top(s[1:-1], ",") != [""]:
        s = s[1:-1].strip()
    if not s:
        return "any"
    if len(union := split_top(s, "|")) > 1:
        return _union([normal_type(p) for p in union if p])
    if len(both := split_top(s, "&")) > 1 and both[0]:
        return "&".join(sorted({normal_type(p) for p in both if p}))
    if s in PRIMITIVES:
        return PRIMITIVES[s]
    if s.startswith("(") and "=>" in s:
        head, _, result = s.rpartition("=>")
        inside = head.strip()[1:-1]
        given = [p.split(":", 1)[-1] for p in split_top(inside, ",") if p]
        return f"({','.join(normal_type(p) for p in given)})=>{normal_type(result)}"
    if s.startswith("{") and s.endswith("}"):
        fields = [p.split(":", 1) for q in split_top(s[1:-1], ";") for p in split_top(q, ",") if ":" in p]
        return "{" + ",".join(sorted({f"{k.strip()}:{normal_type(v)}" for k, v in fields})) + "}"
    if s.endswith("[]"):
        return f"Array<{normal_type(s[:-2])}>"
    if s.endswith("?"):
        return _union([normal_type(s[:-1]), "null"])
    if s.startswith("[]"):
        return f"Array<{normal_type(s[2:])}>"
    if s.startswith("map[") and "]" in s:
        key, _, value = s[4:].partition("]")
        return f"Map<{normal_type(key)},{normal_type(value)}>"
    if s[0] in "*&":
        return normal_type(s[1:].removeprefix("mut "))
    for a, b in ("<>", "[]"):
        at = s.find(a)
        if at > 0 and s.endswith(b):
            name, parts = s[:at].strip().rpartition(".")[2], [normal_type(p) for p in split_top(s[at + 1 : -1], ",") if p]
            if name in TRANSPARENT and len(parts) == 1:
                return parts[0]
            if name == "Union":
                return _union(parts)
            if CONTAINERS.get(name) == "Optional" and len(parts) == 1:
                return _union([*parts, "null"])
            return f"{CONTAINERS.get(name, name)}<{','.join(parts)}>"
    return s
