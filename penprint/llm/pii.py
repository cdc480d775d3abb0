"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Every proposed span has a score: the pattern's own, plus a bonus if its
checksum holds (Luhn for cards, mod 97 for bank accounts) and a bonus if one of
the kind's words stands within ``CONTEXT`` characters. Spans of at least
``ACCEPT`` count. The four base kinds (email, ip, card, phone) reach it by
their own rules, and context only raises their score; ssn, local_phone and
account need context, and so does an iban whose checksum holds but whose
country or length is not a known one. A span of these that overlaps a base span
is dropped. Candidates of a kind and the spans found before them are passed
through side by side in order, so the time is linear in a text's length.

Defined cases: a null or empty text has no spans (``redact`` leaves null as
null); a null id is passed through; repeated rows are judged each; a text of
any length is searched whole, in time linear in its length; an empty table
gives an empty result; ``find`` ignores other columns, ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import merge
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.words import release

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "account")
CONTEXT = 40
ACCEPT = 0.6


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs are matched whole (possessive), which keeps long digit runs linear; it changes no match but that of _IBAN.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The longest run an account number can take; `_ibans` finds where in it the number ends.
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")
_GROUP_END = re.compile(r"(?<=\w)\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"(?<![0-9.-])[0-9]{8,12}(?![0-9]|[.-][0-9])")
# Characters of an account number by country.
_IBAN_CHARS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
    "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 "
    "YE30").split()}
_WORDS = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|client|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|amex|karte|carte|tarjeta|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|telefon|mobile|call|fax|móvil|téléphone|whatsapp)\b", re.I),
    "iban": re.compile(r"\b(?:iban|konto|account|bank|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|tax id)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|tel|telephone|telefon|mobile|call|fax|móvil|téléphone)\b", re.I),
    "account": re.compile(r"\b(?:account|konto|kontonummer|compte|cuenta|customer number|passport)\b", re.I),
}
# (own score, bonus for a context word, bonus for a checksum that holds)
_SCORES = {"email": (0.8, 0.1, 0.0), "ip": (0.65, 0.2, 0.0), "card": (0.3, 0.2, 0.4), "phone": (0.65, 0.2, 0.0),
           "iban": (0.3, 0.2, 0.4), "ssn": (0.4, 0.4, 0.0), "local_phone": (0.4, 0.4, 0.0), "account": (0.2, 0.4, 0.0)}
# The checksum's bonus where one in 97 numbers would pass and nothing else speaks for an account number.
_WEAK_SOUND = 0.2


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, known country and length) of account numbers whose checksum holds: every start, ended after a
    whole group of letters and digits.

    The end that gives the country's length is tried first, then every other one, longest first.
    """
    match = _IBAN.search(text)
    while match:
        start, done, sound = match.start(), 0, []
        # Remainder of what follows the first four characters, and of those four moved behind it.
        head = "".join(str(int(c, 36)) for c in match[0][:4])
        moved, head, rest, n = 10 ** len(head), int(head), 0, 4
        for at in range(start + 4, match.end()):
            if text[at] == " ":
                continue
            value = int(text[at], 36)
            rest, n = (rest * (100 if value > 9 else 10) + value) % 97, n + 1
            if n >= 15 and (rest * moved + head) % 97 == 1 and _GROUP_END.match(text, at + 1):
                sound.append((n == _IBAN_CHARS.get(match[0][:2]), n, at + 1))
        if sound:
            known, _, done = max(sound)
            yield start, done, known
        match = _IBAN.search(text, done or start + 4)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", at + 1)


def _near(text: str, kind: str, start: int, end: int) -> bool:
    around = text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]
    return _WORDS[kind].search(around) is not None


def _scored(text: str, k: int, start: int, end: int, sound: float = 0.0) -> Span:
    own, near, _ = _SCORES[(BASE + ADDED)[k]]
    return Span(start, k, end, round(own + sound + near * _near(text, (BASE + ADDED)[k], start, end), 2))


def base_spans(text: str) -> Iterator[Span]:
    for start, end in _emails(text):
        yield _scored(text, 0, start, end)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield _scored(text, 1, m.start(), m.end())
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = re.sub(r"[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield _scored(text, 2, m.start(), m.end(), _SCORES["card"][2])
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield _scored(text, 3, m.start(), m.end())


def _candidates(text: str, kind: str, pattern: re.Pattern) -> Iterator[tuple[int, int, float]]:
    """(start, end, checksum bonus) in order of start."""
    if kind == "iban":
        for start, end, known in _ibans(text):
            yield start, end, _SCORES[kind][2] if known else _WEAK_SOUND
    else:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), 0.0


def added_spans(text: str, taken: list[Span]) -> Iterator[Span]:
    """Spans beyond the base kinds that reach ACCEPT and overlap no span found before."""
    busy: list[tuple[int, int]] = []
    for start, end in sorted((s.start, s.end) for s in taken):
        if busy and start < busy[-1][1]:
            busy[-1] = busy[-1][0], max(busy[-1][1], end)
        else:
            busy.append((start, end))
    for k, (kind, pattern) in enumerate((("iban", _IBAN), ("ssn", _SSN), ("local_phone", _LOCAL_PHONE),
                                         ("account", _ACCOUNT)), len(BASE)):
        at, found = 0, []
        for start, end, sound in _candidates(text, kind, pattern):
            while at < len(busy) and busy[at][1] <= start:
                at += 1
            if (at < len(busy) and busy[at][0] < end) or (found and start < found[-1][1]):
                continue
            span = _scored(text, k, start, end, sound)
            if span.score + 1e-9 >= ACCEPT:
                found.append((start, end))
                yield span
        busy = list(merge(busy, found))


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each in order of start, then kind."""
    if not text or not re.search(r"[0-9@]", text):
        return [], []
    base = sorted(base_spans(text))
    return base, sorted(base + list(added_spans(text, base)))


def written(spans: list[Span]) -> str:
    return ",".join(f"{(BASE + ADDED)[s.kind]}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every row; positions in code points."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 *(pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64()) for k in range(4)),
                 pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([written(every) for _, every in found], pa.string()),
                 pa.array([[s.score for s in every] for _, every in found], pa.list_(pa.float64()))],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(search, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                                   "base_sha256 string, spans string, scores array<double>")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    _, spans = spans_of(text)
    if not spans:
        return text
    out, done = [], 0
    merged: list[list] = []
    for s in spans:
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, (BASE + ADDED)[s.kind]])
    for start, end, kind in merged:
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in its texts replaced; all other columns as they were."""
    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        out = [pa.array([redacted(t) for t in texts.slice(at, 1000).to_pylist()], pa.string())
               for at in range(0, len(texts), 1000)]
        release()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return docs.withColumn(text_col, replaced(F.col(text_col)))
