"""License scans: Aho-Corasick over words finds notices and identifier tags; a shunting-yard parser reads expressions."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from siltstone.llm.common import alnum_words, map_rows

#: Phrases of the base and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, as words, with the label and how sure they make it.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "gnu library general public license": ("lgpl", 0.95),
    "gnu free documentation license": ("gfdl", 0.95),
    "mozilla public license": ("mpl", 0.95),
    "eclipse public license": ("epl", 0.95),
    "european union public licence": ("eupl", 0.95),
    "boost software license": ("bsl", 0.95),
    "bsd license": ("bsd", 0.9),
    "bsd 2 clause": ("bsd", 0.9),
    "bsd 3 clause": ("bsd", 0.9),
    "isc license": ("isc", 0.9),
    "artistic license": ("artistic", 0.9),
    "zlib license": ("zlib", 0.9),
    "the unlicense": ("unlicense", 0.9),
    "creative commons attribution": ("cc-by", 0.9),
    "creative commons zero": ("cc0", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 0.95),
    "this program is free software you can redistribute it and or modify it": ("gpl", 0.8),
    "all rights reserved": ("proprietary", 0.3),
}
#: First parts of SPDX identifiers and their labels.
FAMILIES = {"gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "eupl": "eupl", "bsl": "bsl", "isc": "isc", "artistic": "artistic", "zlib": "zlib", "unlicense": "unlicense", "cc0": "cc0", "cc": "cc", "0bsd": "bsd"}
BASE_SURE, TAG_SURE, CHOICE_SURE = 0.9, 1.0, 0.95

_TAG = re.compile(r"(?<![A-Za-z0-9])SPDX-License-Identifier:[ \t]*([^\r\n]+)", re.I | re.A)
_PART = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))", re.A)
_RANK = {"or": 1, "and": 2, "with": 3}


def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces, as they stand in a text's words joined by one space."""
    out = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        out.add_word(f" {phrase} ", ("base", label, BASE_SURE, len(phrase) + 2))
    for phrase, (label, sure) in NOTICES.items():
        out.add_word(f" {phrase} ", ("notice", label, sure, len(phrase) + 2))
    out.add_word(" spdx license identifier ", ("tag", "", TAG_SURE, 25))
    out.make_automaton()
    return out


def to_postfix(expression: str) -> list[str]:
    """An SPDX expression in postfix order, by shunting-yard: or binds weakest, then and, then with.

    Reading stops where the text stops being an expression, as in a comment that goes on after it. Empty if there is
    no whole expression.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand, depth = False, 0  # whether one stands just before; open brackets
    good: tuple[int, list[str]] = (0, [])
    at = 0
    while m := _PART.match(expression, at):
        at = m.end()
        word = (m[1] or m[2]).lower()
        if word == "(" and not operand:
            waiting.append(word)
            depth += 1
        elif word == ")" and operand and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif word in _RANK and operand:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = False
        elif word not in _RANK and word not in "()" and not operand:
            out.append(word)
            operand = True
        else:
            break
        if operand and not depth:
            good = len(out), waiting[::-1]  # one of each rank at most
    return out[: good[0]] + good[1]


def evaluate(postfix: list[str]) -> tuple[set[str], set[str]]:
    """The licences that an expression names, and those of them that it needs whatever is chosen.

    A licence with an exception is one of its own, named after both. The smaller set always joins the larger.
    """
    stack: list[tuple[set[str], set[str]]] = []
    for word in postfix:
        if word not in _RANK:
            stack.append(({word}, {word}))
            continue
        (named, needed), (other, wanted) = stack.pop(), stack.pop()
        if word == "with":
            named, needed = ({f"{x} with {y}" for x in left for y in right} for left, right in ((other, named), (wanted, needed)))
        else:
            named = _union(named, other)
            needed = _union(needed, wanted) if word == "and" else needed & wanted
        stack.append((named, needed))
    return stack[0] if stack else (set(), set())


def _union(a: set[str], b: set[str]) -> set[str]:
    if len(a) < len(b):
        a, b = b, a
    a |= b
    return a


def family(identifier: str) -> str | None:
    name = identifier.split(" ")[0]
    if name.startswith("cc-by"):
        return "cc-by"
    return FAMILIES.get(re.split(r"[-+.]", name)[0])


def scan(text: str | None, phrases: ahocorasick.Automaton) -> dict:
    words = alnum_words(text)
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places: list[int] = []
    base: set[str] = set()
    sure: dict[str, float] = {}
    tagged, expressions = False, []
    last = count = 0
    for end, (kind, label, how_sure, length) in phrases.iter(joined):
        if kind == "tag":
            tagged = True
            continue
        if kind == "base":
            start = end - length + 1
            # Hits come in the order of their ends, so starts may step back a little.
            count = count + joined.count(" ", last, start) if start >= last else count - joined.count(" ", start, last)
            last = start
            places.append(count)
            base.add(label)
        sure[label] = max(sure.get(label, 0.0), how_sure)
    if tagged:
        for m in _TAG.finditer(text):
            postfix = to_postfix(m[1])
            names, needed = evaluate(postfix)
            if postfix:
                expressions.append({"postfix": postfix, "needed": sorted(needed)})
            for name in names:
                label = family(name)
                if label:
                    sure[label] = max(sure.get(label, 0.0), TAG_SURE if name in needed else CHOICE_SURE)
    miss = 1.0
    for s in sure.values():
        miss *= 1.0 - s
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | set(sure))),
        "score": 1.0 - miss,
        "expressions": expressions,
    }


_FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<struct<postfix:array<string>,needed:array<string>>>"


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    expressions.

    expressions has each SPDX tag's expression, read to the end of its line, in postfix order, and the licences that it
    needs whatever is chosen; a malformed tag has none. Every licence that an expression offers is a label; one that is
    a choice among others is a little less sure. score is the chance that any finding is right, as if findings were
    independent; 0 without findings. A null or empty text has no words and null places. Texts of any length are read
    whole in one pass. Repeated rows give equal rows; other columns are ignored; an empty table gives no rows.
    """

    def make():
        phrases = automaton()

        def each(cols):
            found = [scan(t, phrases) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {k: [f[k] for f in found] for k in found[0]}

        return each

    return map_rows(docs.select("doc_id", "text"), _FIELDS, make)
