"""Fill-in-the-middle training texts, cut with bit-parallel operations on big integers.

A class mask is an integer with bit i set where byte i of the UTF-8 text belongs to the
class: ``bytes.translate`` writes the bits as digits and ``int`` reads them.  Shifted
masks combined with and, or, not mark where units begin, ``int.bit_count`` counts them,
and a ranked unit's byte offset is found by halving the mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import raw_texts
from .workspace import ship_package

#: Fixed values of the output form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CONTINUATION = bytes(range(0x80, 0xC0))
SPACE = b" \t\n\v\f\r"
BATCH_BYTES = 8 << 20


@cache
def _digits(members: bytes) -> bytes:
    return bytes(0x31 if b in members else 0x30 for b in range(256))


def class_mask(data: bytes, members: bytes) -> int:
    """Bit i is set where byte i is one of ``members``."""
    return int(data.translate(_digits(members))[::-1], 2) if data else 0


def code_points(data: bytes) -> int:
    """Where a code point begins: every byte but the continuation bytes."""
    return ~class_mask(data, CONTINUATION) & ((1 << len(data)) - 1)


def words(data: bytes) -> int:
    """Where a word begins after white space or the text itself; the space after a word is the word's."""
    letters = ~class_mask(data, SPACE) & ((1 << len(data)) - 1)
    return letters & ~(letters << 1) | bool(data)


def lines(data: bytes) -> int:
    """Where a line begins: at the text's begin and after each newline but a last one."""
    return (class_mask(data, b"\n") << 1 | bool(data)) & ((1 << len(data)) - 1)


UNITS: dict[str, Callable[[bytes], int]] = {"code_points": code_points, "words": words, "lines": lines}


def select(bits: int, width: int, ranks: list[int], at: int = 0) -> list[int]:
    """Position of each ranked set bit (rank 0 is the lowest) in a mask of ``width`` bits, ranks ascending.

    The lower half's bit count says which ranks lie in it; the others are looked for in the upper half.
    """
    if not ranks or width == 1:
        return [at] * len(ranks)
    half = width // 2
    low = bits & ((1 << half) - 1)
    below = low.bit_count()
    left = [r for r in ranks if r < below]
    right = [r - below for r in ranks if r >= below]
    return select(low, half, left, at) + (select(bits >> half, width - half, right, at + half) if right else [])


@dataclass(frozen=True)
class Middle:
    """Shares in hundredths: how many texts are transformed, and of these how many begin with the suffix."""

    seed: int = 1
    transformed: int = 90
    suffix_first: int = 20
    unit: str = "code_points"


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def rearranged(data: bytes, key: object, settings: Middle = Middle()) -> Cut:
    """One text in its form; the key's hash chooses the form and the two places to cut at."""
    starts = UNITS[settings.unit](data)
    n, width = starts.bit_count(), len(data)
    digest = hashlib.sha256(f"{settings.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= settings.transformed:
        return Cut(n, "plain", None, None, data)
    ranks = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    places = select(starts, width, [r for r in ranks if r < n])
    a, b = places + [width] * (2 - len(places))
    whole = starts if settings.unit == "code_points" else code_points(data)
    before = [(whole & ((1 << x) - 1)).bit_count() for x in (a, b)]
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < settings.suffix_first:
        return Cut(n, "spm", before[0], before[1] - before[0], b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Cut(n, "psm", before[0], before[1] - before[0], b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def restored(output: bytes, form: str) -> bytes:
    """The text again.  No part holds a marker and no marker overlaps itself or another, so the first of each is the one written."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


KINDS = [("doc_id", pa.int64(), "long"), ("n", pa.int64(), "long"), ("form", pa.string(), "string"), ("prefix_chars", pa.int64(), "long"), ("middle_chars", pa.int64(), "long")]


def _mapped(docs: DataFrame, settings: Middle, key: str, text: str, more: dict[str, Callable[[Cut], object]]) -> DataFrame:
    names = [k for k, _, _ in KINDS] + list(more)
    types = [t for _, t, _ in KINDS] + [pa.string()] * len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc, data in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                cut = rearranged(data, doc, settings)
                out.append((doc, cut.n, cut.form, cut.prefix_chars, cut.middle_chars, *(f(cut) for f in more.values())))
                size += len(data)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    ship_package(docs.sparkSession)
    schema = ", ".join([f"{k} {t}" for k, _, t in KINDS] + [f"{k} string" for k in more])
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, settings: Middle = Middle(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts the text's units; output is the text in its form (plain, psm, spm).  A null
    text is empty and stays plain, as does a text that spells a marker.  Rows with equal
    keys are cut at the same hashes, a null key hashes as the empty text; repeated rows
    give repeated rows.  Texts of any length are cut in time linear in their bytes.  Other
    columns are ignored; an empty table gives an empty result.
    """
    return _mapped(docs, settings, key, text, {"output": lambda c: c.output.decode("utf-8", "replace")})


def digest(docs: DataFrame, settings: Middle = Middle(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``fill_in_middle``, with sha256 of the output and of the text rebuilt from it instead of the output."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return _mapped(docs, settings, key, text, {"output_sha256": lambda c: sha(c.output), "restored_sha256": lambda c: sha(restored(c.output, c.form))})


def texts_again(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``text`` rebuilt from output and form, in column functions."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda mark: F.expr(f"substring(output, locate('{mark}', output) + 3)")
    between = lambda left, right: F.substring_index(after(left), right, 1)
    text = (
        F.when(F.col("form") == "psm", F.concat(between(p, s), after(m), between(s, m)))
        .when(F.col("form") == "spm", F.concat(between(p, m), after(m), between(s, p)))
        .otherwise(F.col("output"))
    )
    return made.withColumn("text", text)
