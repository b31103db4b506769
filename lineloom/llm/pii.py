"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order used among spans that start together. The first four are always kept once confirmed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

#: What a span of a kind is worth by its pattern, and with a checksum or range test passed.
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
#: Words within REACH characters that raise or lower a score by STEP each, twice at most either way.
NEAR = {
    "email": {"email", "mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "address", "host", "server", "login", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
AGAINST = {"version", "isbn", "release", "serial", "order", "invoice", "sku", "example", "test"}
REACH, STEP = 48, 0.1


def luhn(digits: str) -> bool:
    """True if the digits pass the Luhn test."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """True if an account number leaves 1 modulo 97 after its first four signs move to the end."""
    return int("".join(str(int(ch, 36)) for ch in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(short) <= 3 and int(short or "0") <= 255 for short in (p.lstrip("0") for p in four)):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(ch in "0123456789" for ch in m.group()) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest prefix of a proposed run that passes mod-97 and ends with a word."""
    for m in _IBAN.finditer(text):
        run = m.group()
        for end in range(len(run), 14, -1):
            if (end == len(run) or run[end] == " ") and run[end - 1] != " " and 15 <= len(plain := run[:end].replace(" ", "")) <= 34 and mod97(plain):
                yield m.start(), m.start() + end
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior and checksum of the kind, moved by context words on either side; 0 to 1."""
    around = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * min(2, len(around & NEAR[kind])) - STEP * min(2, len(around & AGAINST)))), 3)


def spans(text: str | None, least: float = 0.5) -> list[dict]:
    """All spans of one text by start, then by the order of KINDS. Base kinds stay whatever their score;
    the others need a score of ``least`` and may not overlap a base span."""
    if not text:
        return []
    number = any(ch in text for ch in "0123456789")
    wanted = [k for k in KINDS if (number or k == "email") and (k != "email" or "@" in text) and (k != "phone" or "+" in text)]
    found = [(s, i, k, e) for i, k in enumerate(KINDS) if k in wanted for s, e in _FIND[k](text)]
    base = [x for x in found if x[2] in BASE]
    out = []
    for s, i, k, e in sorted(found):
        sure = score(text, k, s, e)
        if k in BASE or sure >= least and not any(s < b[3] and b[0] < e for b in base):
            out.append({"kind": k, "start": s, "end": e, "score": sure})
    return out


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(id, pii): the spans of every row's whole text, in code points with exclusive ends.

    A null or empty text has no spans. Repeated rows are kept, a null id stays null, other columns are
    ignored, an empty table gives no rows. No shuffle: each Arrow batch is worked on where it is read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            found = [spans(t.as_py(), least) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[id, "pii"])

    rows = docs.select(id, text)
    return rows.mapInArrow(run, f"`{id}` {rows.schema[0].dataType.simpleString()}, pii {SPAN}")


def joined(found: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(id, text) with every span replaced by its kind in angle brackets; a null text stays null."""
    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1):
                t = t.as_py()
                pieces, at = [], 0
                for x in spans(t, least):
                    if x["start"] >= at:
                        pieces += [t[at : x["start"]], f"<{x['kind']}>"]
                    at = max(at, x["end"])
                out.append(None if t is None else "".join([*pieces, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id, text])

    rows = docs.select(id, text)
    return rows.mapInArrow(run, f"`{id}` {rows.schema[0].dataType.simpleString()}, `{text}` string")
