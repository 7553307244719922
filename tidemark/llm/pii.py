"""Personal data: patterns propose spans, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import ship_package

# The kinds in the order of the result, base kinds first.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "card_short")
# Words that make a kind likelier when they stand within CONTEXT characters before or after.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "server", "ip"),
    "card": ("amex", "card", "credit", "debit", "mastercard", "payment", "visa"),
    "phone": ("call", "fax", "mobile", "phone", "tel"),
    "iban": ("account", "bank", "iban", "konto", "transfer"),
    "card_short": ("amex", "card", "credit", "debit", "diners", "payment"),
}
# The score of a span by its kind, before its context is looked at.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "card_short": 0.5}
NEAR = {kind: re.compile(rf"\b(?:{'|'.join(words)})", re.ASCII) for kind, words in CONTEXT_WORDS.items()}
CONTEXT, CONTEXT_GAIN, THRESHOLD = 40, 0.2, 0.7
IBAN_LENGTHS = range(15, 35)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", re.ASCII)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 7064: the first four characters go last, letters count from 10, the rest is 1."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; looking from each @ to the left keeps long words linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def propose(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed by a checksum) of every span that passes its validator."""
    if "@" in text:
        yield from (("email", a, b, False) for a, b in emails(text))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end(), False
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            yield "card" if len(d) >= 16 else "card_short", m.start(), m.end(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(only_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end(), False
    for m in IBAN.finditer(text):
        if len(t := m[0].replace(" ", "")) in IBAN_LENGTHS and mod97(t):
            yield "iban", m.start(), m.end(), True


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans (kind, start, end, score, confirmed) in code points, by kind and start.

    Base kinds always stay, with their score; an added span needs a score of
    THRESHOLD.  A short card overlapping an earlier span of another kind is dropped.
    """
    found = sorted(propose(text), key=lambda x: ((*BASE_KINDS, *ADDED_KINDS).index(x[0]), x[1]))
    out: list[tuple[str, int, int, float, bool]] = []
    for kind, start, end, confirmed in found:
        near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(NEAR[kind].search(near)))
        if kind in BASE_KINDS or score >= THRESHOLD and not any(a < end and start < b for _, a, b, *_ in out):
            out.append((kind, start, end, round(score, 2), confirmed))
    return out


def redact(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earliest and longest counts."""
    parts, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("confirmed", pa.bool_())])


def _each_text(work: Callable[[str], tuple], schema: pa.Schema, keep: list[str], text: str):
    """A mapInArrow function: the columns ``keep`` and what ``work`` makes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [work(x or "") for x in batch.column(text).to_pylist()]
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(schema)[len(keep) :])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], schema=schema)

    return run


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, score, confirmed), one row per row of ``docs``.

    A null text counts as empty and has no spans; repeated rows are treated alike;
    other columns are ignored; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])
    work = lambda t: ([dict(zip(("kind", "start", "end", "score", "confirmed"), s, strict=True)) for s in find_spans(t)],)
    chosen = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return chosen.mapInArrow(_each_text(work, schema, ["doc_id"], "text"), "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,confirmed:boolean>>")


def digest(docs: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans of every document."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def work(text: str) -> tuple:
        spans = find_spans(text)
        base = [s for s in spans if s[0] in BASE_KINDS]
        joined = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in some)
        counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(_each_text(work, schema, ["doc_id"], "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind; a null text stays null, n_chars follows where it exists."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else redact(x, find_spans(x)) for x in batch.column(text).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[text] = pa.array(texts, batch.schema.field(text).type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if x is None else len(x) for x in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)
