"""Personal data: exact base patterns, and candidates that boosted trees select.

High-recall generators propose spans that may overlap; boosted trees see their format and the words before them; a
calibrated threshold for each kind selects what is redacted. Spans of the base patterns always stay. The trees are
trained here on labelled candidates written by `labelled_candidates`, which need no data.
"""

from __future__ import annotations

import re
from functools import cache
from hashlib import sha256
from random import Random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.boosting import Boosted
from siltstone.llm.common import Taken, map_rows

#: The kinds of the base, in their order, and of the method.
BASE = ("email", "ip", "card", "phone")
MORE = ("email_spelled", "phone_national", "ssn", "iban", "card_spaced")
#: Labelled candidates to train on, the share of a kind's selected candidates that must be right on unseen ones, and the
#: least calibrated probability of any: written candidates are easier to tell apart than those of real texts.
TRAIN_ROWS, PRECISION, LEAST = 6000, 0.97, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match starts inside a run of digits unless one starts at its first digit, so the look-behind changes nothing.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.I | re.A)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]+| ?\. ?[A-Za-z0-9-]+)+", re.I | re.A)
#: Numbers have 7 to 19 digits and IBANs up to 34 characters by their formats; a longer run is neither.
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+#/-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WORDS_BEFORE = re.compile(r"[a-z]+")
_CONTEXT = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "sms", "reach", "dial"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tin"),
    "bank": ("iban", "account", "bank", "transfer", "bic", "swift"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "cc"),
    "mail": ("email", "mail", "contact", "write", "reach", "address"),
    "other": ("order", "invoice", "isbn", "issn", "version", "ticket", "part", "serial", "ref", "page", "id", "no", "pp", "doi"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind and start; leftmost and not overlapping within a kind."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _iban_checks(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals of the method's kinds; several kinds may propose one span."""
    out = []
    if ("[" in text or "(" in text or "{" in text):
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            found = _SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
            if found:
                out.append(("email_spelled", start, found.end()))
                end = found.end()
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        if n == 9:
            out.append(("ssn", *m.span()))
        if 7 <= n <= 12:
            out.append(("phone_national", *m.span()))
        if 13 <= n <= 19:
            out.append(("card_spaced", *m.span()))
    return out + [("iban", *m.span()) for m in _IBAN.finditer(text)]


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = _digits(s)
    shape = re.sub(r"[0-9]+", lambda m: chr(64 + min(len(m.group()), 26)), s)
    groups = re.findall(r"[0-9]+", s)
    before = _WORDS_BEFORE.findall(text[max(0, start - 48) : start].lower())[-4:]
    seps = {c for c in s if c in " ().-/"}
    return [
        *(float(kind == k) for k in MORE),
        len(s),
        len(digits),
        len(groups),
        float(luhn(digits)) if digits else 0.0,
        float(len(set(digits)) <= 2),
        float(len(seps)),
        *(float(c in seps) for c in " ()-."),
        float([len(g) for g in groups] == [3, 2, 4]),
        float([len(g) for g in groups] == [3, 3, 4]),
        float(shape.startswith("(")),
        float(bool(re.fullmatch(r"(19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}.*|[0-9]{1,2}[-./][0-9]{1,2}[-./](19|20)[0-9]{2}.*", s))),
        float(kind == "iban" and _iban_checks(s)),
        float(kind == "ssn" and (digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:] == "0000")),
        *(float(any(w in words for w in before)) for words in _CONTEXT.values()),
        float(text[start - 1 : start] in ("$", "€", "£", "=", "_")) if start else 0.0,
        float(text[end : end + 1] in ("%", "€", "_", "=")),
    ]


def labelled_candidates(n: int, seed: int = 7) -> tuple[list[list[float]], list[int]]:
    """Features and labels of candidates in written sentences: real formats and look-alikes, with and without words
    that announce them."""
    rnd = Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9)))
    pick = lambda k: rnd.choice(_CONTEXT[k])

    def card(good: bool) -> str:
        body = rnd.choice("3456") + d(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        whole = body + (last if good else str((int(last) + rnd.randint(1, 9)) % 10))
        return whole

    def iban(good: bool) -> str:
        body = rnd.choice(["DE", "FR", "ES", "GB", "NL"])
        rest = d(18)
        check = next(c for c in range(2, 99) if _iban_checks(f"{body}{c:02d}{rest}"))
        return f"{body}{(check if good else (check + 5) % 97):02d}{rest}"

    makers = [
        (1, lambda: (pick("phone"), f"({d(3)}) {d(3)}-{d(4)}")),
        (1, lambda: (pick("phone"), f"{d(3)}-{d(3)}-{d(4)}")),
        (1, lambda: (pick("phone"), f"0{d(2)} {d(3)} {d(2)} {d(2)}")),
        (1, lambda: (word(), f"({d(3)}) {d(3)}-{d(4)}")),
        (1, lambda: (pick("ssn"), f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}")),
        (1, lambda: (word(), f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}")),
        (1, lambda: (pick("bank"), iban(True))),
        (1, lambda: (word(), iban(True))),
        (1, lambda: (pick("card"), "  ".join(re.findall("....", card(True))))),
        (1, lambda: (pick("mail"), f"{word()} [at] {word()} [dot] com")),
        (1, lambda: (word(), f"{word()}(at){word()}.org")),
        (0, lambda: (pick("other"), d(rnd.randint(7, 18)))),
        (0, lambda: (word(), d(rnd.randint(7, 19)))),
        (0, lambda: (word(), d(16))),
        (0, lambda: (word(), d(9))),
        (0, lambda: (word(), card(False))),
        (0, lambda: (word(), f"20{d(2)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}")),
        (0, lambda: (word(), f"{rnd.randint(1, 28):02d}.{rnd.randint(1, 12):02d}.20{d(2)}")),
        (0, lambda: (pick("other"), f"{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}")),
        (0, lambda: (pick("other"), f"{d(2)} {d(3)} {d(3)}")),
        (0, lambda: (word(), f"{rnd.randint(1, 9)}.{d(2)}.{d(3)}.{d(2)}")),
        (0, lambda: (word(), " ".join(d(rnd.randint(1, 5)) for _ in range(4)))),
        (0, lambda: (word(), iban(False))),
        (0, lambda: (word(), f"{word()} (at {word()}. {word()})")),
        (0, lambda: (pick("other"), f"{d(3)}-{d(4)}-{d(3)}")),
    ]
    x, y = [], []
    while len(y) < n:
        label, make = makers[len(y) % len(makers)] if rnd.random() < 0.5 else rnd.choice(makers)
        lead, value = make()
        text = " ".join([*(word() for _ in range(rnd.randint(0, 5))), lead + rnd.choice([" ", ": "])]) + value + rnd.choice([" ", ". ", ", "]) + word()
        if not lead:
            continue
        found = candidates(text)
        for kind, s, e in found:
            right = label and text[s:e] == value and not (kind == "ssn" and "(" in value)
            if label and right and kind == "phone_national" and re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value):
                right = False
            x.append(features(kind, text, s, e))
            y.append(int(bool(right)))
    return x, y


@cache
def train(rows: int = TRAIN_ROWS, seed: int = 7) -> Boosted:
    """The trees, trained once a process."""
    return Boosted().fit(*map(np.array, labelled_candidates(rows, seed)))


@cache
def thresholds(precision: float = PRECISION, rows: int = TRAIN_ROWS, seed: int = 7) -> dict[str, float]:
    """For each kind the least probability, LEAST or more, from which unseen candidates are this often right."""
    x, y = map(np.array, labelled_candidates(rows, seed + 1))
    p = train(rows, seed).probability(x)
    out = {}
    for k, kind in enumerate(MORE):
        own = x[:, k] == 1
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        out[kind] = max(LEAST, float(p[own][order][good[-1]])) if len(good) else 1.1  # nothing
    return out


def all_spans(text: str | None, model: Boosted, least: dict[str, float]) -> tuple[list, list]:
    """Base spans, and the method's spans that overlap neither them nor a likelier span of the method."""
    if not text:
        return [], []
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, []
    p = model.probability([features(k, text, s, e) for k, s, e in proposed])
    taken = Taken((s, e) for _, s, e in base)
    likely = (proposed[i] for i in np.argsort(-p, kind="stable") if p[i] >= least[proposed[i][0]])
    return base, [(kind, s, e) for kind, s, e in likely if taken.take(s, e)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(BASE + MORE)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1])))


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row per row of `docs`: doc_id, text, spans (kind, start, end in code points, is_base)."""
    shared = docs.sparkSession.sparkContext.broadcast((train(), thresholds(precision)))

    def make():
        model, least = shared.value

        def each(cols):
            spans = []
            for text in cols["text"]:
                base, more = all_spans(text, model, least)
                spans.append([{"kind": k, "start": s, "end": e, "base": b} for part, b in ((base, True), (more, False)) for k, s, e in part])
            return {"doc_id": cols["doc_id"], "text": cols["text"], "spans": spans}

        return each

    schema = "doc_id long, text string, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def report(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row per row of `docs`: doc_id, counts of the base kinds, base_sha256, spans.

    A null or empty text has no spans: counts 0, the hash of the empty string and an empty list. Texts of any length are
    read whole. Repeated rows give equal rows; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((train(), thresholds(precision)))

    def make():
        model, least = shared.value

        def each(cols):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for text in cols["text"]:
                base, more = all_spans(text, model, least)
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
            return out | {"doc_id": cols["doc_id"]}

        return each

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(doc_id, text, n_redacted): every span replaced by its kind in angle brackets; of overlapping spans the first."""
    found = find(docs, precision)

    def make():
        def each(cols):
            texts, n = [], []
            for text, spans in zip(cols["text"], cols["spans"], strict=True):
                at, parts, count = 0, [], 0
                for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                    if x["start"] >= at:
                        parts += [text[at : x["start"]], f"<{x['kind']}>"]
                        at, count = x["end"], count + 1
                texts.append(text if text is None else "".join(parts) + text[at:])
                n.append(count)
            return {"doc_id": cols["doc_id"], "text": texts, "n_redacted": n}

        return each

    return map_rows(found.select("doc_id", "text", F.col("spans")), "doc_id long, text string, n_redacted long", make)
