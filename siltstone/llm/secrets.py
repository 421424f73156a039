"""Secret scans with corpus-wide ownership frequency.

Base hits and candidates beyond them are hashed and counted over the distinct owners and repositories that hold them.
What many owners hold is a copied example; what one or few hold looks live. Of candidates only live ones are reported;
base hits are always reported, and counted as live or example all the same.
"""

from __future__ import annotations

import re
from hashlib import sha256
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Taken, map_rows
from siltstone.session import Scratch

#: The kinds of the base, in their order, and of the method.
BASE = ("assign", "access", "hex")
MORE = ("private_key", "jwt", "github", "slack", "google", "stripe", "url_password", "entropy")
#: A value held by more owners than this is an example, and so is one of several owners in more repositories than this.
#: What one owner alone holds is that owner's, in however many repositories.
MOST_OWNERS, MOST_REPOSITORIES = 2, 3
#: Bits per character from which a long mixed token is a candidate, and its least length.
ENTROPY, LENGTH = 4.0, 24

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MORE = {
    "private_key": re.compile(
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*+(?:[A-Za-z-]+: [^\n]*\n\s*+)*+[A-Za-z0-9+/=\s]{32,}+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    ),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "github": re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,})"),
    "slack": re.compile(r"(?<![A-Za-z0-9_])xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"(?<![A-Za-z0-9_])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "stripe": re.compile(r"(?<![A-Za-z0-9_])[rs]k_live_[A-Za-z0-9]{16,}"),
    "url_password": re.compile(r"(?<=://)[A-Za-z0-9._%-]+:[^\s:@/\"'<>]{6,}(?=@[A-Za-z0-9])"),
}
_HINTS = {"private_key": "PRIVATE KEY", "jwt": "eyJ", "github": "gh", "slack": "xox", "google": "AIza", "stripe": "k_live_", "url_password": "://"}
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, leftmost and not overlapping within a kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # Runs of 16 and more are the same spans as all runs less the short ones.
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def base_value(text: str, kind: str, start: int, end: int) -> str:
    """What a base hit is counted by: of an assignment the value alone."""
    return _ASSIGN.match(text, start, end)[2] if kind == "assign" else text[start:end]


def _bits(s: str) -> float:
    return -sum(p * log2(p) for p in (s.count(c) / len(s) for c in set(s)))


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The method's spans that overlap no base span and no earlier kind's."""
    taken = Taken((s, e) for _, s, e in base)
    found = [(k, *m.span()) for k, p in _MORE.items() if _HINTS[k] in text for m in p.finditer(text)]
    found += [("entropy", *m.span()) for m in _LONG.finditer(text) if _mixed(m.group()) and _bits(m.group()) >= ENTROPY]
    return [(kind, s, e) for kind, s, e in found if taken.take(s, e)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(BASE + MORE)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


_ONE = "struct<kind:string,start:int,end:int,hash:string>"


def candidate_rows(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """A row per row of `docs`: doc_id, owner, repository, counts and hash of the base, spans, more (the candidates)."""
    named = docs.select("doc_id", "text", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))

    def make():
        def each(cols):
            out = {k: [] for k in (*(f"n_{k}" for k in BASE), "base_sha256", "base", "more")}
            for text in cols["text"]:
                text = text or ""
                base = base_spans(text)
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                told = joined(base)
                out["base_sha256"].append(sha256(told.encode()).hexdigest())
                out["base"].append([f"{k}:{s}:{e}" for k, s, e in base])
                held = [(k, s, e, base_value(text, k, s, e)) for k, s, e in base]
                held += [(k, s, e, text[s:e]) for k, s, e in candidates(text, base)]
                out["more"].append([{"kind": k, "start": s, "end": e, "hash": sha256(v.encode("utf-8", "replace")).hexdigest()} for k, s, e, v in held])
            return out | {k: cols[k] for k in ("doc_id", "owner", "repository")}

        return each

    schema = f"doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>, more array<{_ONE}>"
    return map_rows(named, schema, make)


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, owners, repositories): how many distinct ones hold each value; null counts as one."""
    held = rows.select(F.explode("more.hash").alias("hash"), "owner", "repository").distinct()
    # Two steps, so that a value held everywhere is counted from partial sums.
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def report(
    docs: DataFrame,
    owner: Column | None = None,
    repository: Column | None = None,
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    By default a document's source is its owner, and source and language together its repository. spans has the base
    spans and the candidates that few hold; n_live and n_example count base hits and candidates by how many hold them. A
    null or empty text has none; texts of any length are read whole, and their secrets may have any length. Repeated
    rows give equal rows, as rows that agree in everything stand together while candidates are looked up. A null owner
    or repository is one of its own. Other columns are ignored; an empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.keep(candidate_rows(docs, owner, repository))
    counts = ["n_assign", "n_access", "n_hex"]
    plain = rows.where("size(more) = 0").select("doc_id", *counts, "base_sha256", _spans(F.col("base")), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    alike = rows.where("size(more) > 0").groupBy("doc_id", *counts, "base_sha256", "base", "more").agg(F.count("*").alias("copies"))
    each = alike.select("*", F.explode("more").alias("one"))
    widely = (F.col("owners") > most_owners) | ((F.col("owners") > 1) & (F.col("repositories") > most_repositories))
    common = ownership(rows).where(widely)
    looked = each.join(common.select(F.col("hash").alias("known")), F.col("one.hash") == F.col("known"), "left")
    told = F.when(F.col("known").isNull(), F.concat_ws(":", "one.kind", "one.start", "one.end"))
    live = looked.groupBy("doc_id", *counts, "base_sha256", "base", "more", "copies").agg(F.collect_list(told).alias("live"))
    # Base spans are there whoever holds them.
    spans = _spans(F.array_union("base", "live"))
    n_live = F.size("live").cast("long")
    out = live.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    out = out.select("doc_id", *counts, "base_sha256", spans, n_live.alias("n_live"), (F.size("more") - n_live).alias("n_example"))
    return plain.unionByName(out)


def _spans(listed: Column) -> Column:
    """kind:start:end strings in the order of start, then kind as listed, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in BASE + MORE))
    part = lambda x, i: F.element_at(F.split(x, ":"), i)
    keyed = F.transform(listed, lambda x: F.struct(part(x, 2).cast("int").alias("s"), F.array_position(kinds, part(x, 1)).alias("k"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda y: y["x"]), ",").alias("spans")
