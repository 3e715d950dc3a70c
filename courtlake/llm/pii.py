"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, schemes, plus signs, digits and identifier cues.
Each anchor is expanded to its boundaries by a small deterministic parser of its kind and then validated.
Within a kind the spans are leftmost and do not overlap; a span that fails its validation is dropped and the
search goes on behind it.

Defined cases: a null or empty text has no spans; rows that repeat a document id give one row each; ids are
passed through, null or not; further columns are ignored. Offsets count code points, the end is exclusive.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn", "account", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([^\s/@:\"'<>]{1,128}:[^\s/@\"'<>]{1,128})@")
_VALUE = re.compile(r"(?:[ _-]?(?:number|num|no\.?|id|key|code))?[ \t]*(?:is|[:=#])?[ \t]*[\"']?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_SECRET = re.compile(r"[A-Za-z0-9_+/=-]{16,256}")

# fixed values: the words that announce an identifier, by the kind they announce
CUES = {
    "iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct", "routing", "passport"),
    "secret": ("token", "api_key", "apikey", "api key", "secret", "password"),
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key in ("@", "+", "://", *"0123456789"):
        found.add_word(key, ("digit" if key.isdigit() else key, 1 if key.isdigit() else len(key)))
    for kind, words in CUES.items():
        for w in words:
            for form in {w, w.title(), w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _valid_ip(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _valid_iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _announced(text: str, kind: str, at: int):
    """The identifier that stands right behind a cue that ends at ``at``, or nothing."""
    at = _VALUE.match(text, at).end()
    if kind == "iban":
        m = _IBAN.match(text, at)
        return m.span() if m and _valid_iban(m[0]) else None
    if kind == "ssn":
        m = _SSN.match(text, at)
        return m.span() if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000" else None
    if kind == "account":
        m = _ACCOUNT.match(text, at)
        return m.span() if m else None
    m = _SECRET.match(text, at)
    return m.span() if m and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) else None


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in order."""
    base, more = [], []
    email = ip = card = phone = 0                                # where each kind may start next
    for last, (what, length) in automaton.iter(text):
        at = last - length + 1
        if what == "digit":
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(map(_valid_ip, m[0].split("."))):
                        base.append((at, 1, ip))
                else:
                    ip = _DIGITS.match(text, at).end()           # a later start in the same run fails alike
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                if 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                    base.append((at, 2, card))
        elif what == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                base.append((start, 0, email))
        elif what == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    base.append((at, 3, phone))
        elif what == "://":
            if m := _LOGIN.match(text, at):
                more.append((m.start(1), 4, m.end(1)))
        elif (not at or not text[at - 1].isalpha()) and (got := _announced(text, what, last + 1)):
            more.append((got[0], KINDS.index(what), got[1]))
    base.sort()
    if more:
        starts, reach, ends = [b[0] for b in base], 0, []
        for b in base:
            ends.append(reach := max(reach, b[2]))
        own = 0
        for s, k, e in sorted(set(more)):
            i = bisect_left(starts, e)                           # base spans that start before this one ends
            if (not i or ends[i - 1] <= s) and s >= own:
                base.append((s, k, e))
                own = e
        base.sort()
    return base


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and its spans ``array<struct<kind, start, end>>``, by start, then by kind as listed in KINDS."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, automaton)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def only(kinds) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))
