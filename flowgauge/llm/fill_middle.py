"""Fill-in-the-middle transformation by bit-parallel arithmetic on big integers.

A text is one integer for each class of its bytes: bit k of a mask is set where byte k is of the class. bytes.translate
builds the masks, shifted boolean operations turn them into the ends of units, bit_count gives their number, and the end
of the r-th unit is found by halving: the count of the lower half says which half holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from flowgauge.llm.common import texts

#: The marks before prefix, suffix and middle; a text that has one of them stays as it is.
MARKS = ("<P>", "<S>", "<M>")
#: Hundredths of texts that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20


def _class(members: bytes) -> bytes:
    """A table for bytes.translate: "1" for the members, "0" for all other bytes."""
    return bytes(b"01"[b in members] for b in range(256))


LEADS, LINE_ENDS, BLANKS = _class(bytes([*range(0x80), *range(0xC0, 256)])), _class(b"\n"), _class(b"\x20\x09\x0a\x0b\x0c\x0d")


def mask(data: bytes, table: bytes) -> int:
    """Bit k: whether byte k is of the table's class."""
    return int(data[::-1].translate(table) or b"0", 2)


def ends(data: bytes, unit: str = "point") -> int:
    """The units' last bytes: code points; lines, each with its end; or words, each with the blanks before it (blanks at the
    text's end are the last word's, and a text of blanks alone is one word)."""
    if not data:
        return 0
    last = 1 << len(data) - 1
    if unit == "point":
        return mask(data, LEADS) >> 1 | last
    if unit == "line":
        return mask(data, LINE_ENDS) | last
    if unit == "word":
        blank = mask(data, BLANKS)
        word = ~blank & (last << 1) - 1
        stops = word & ~(word >> 1)
        final = 1 << stops.bit_length() >> 1
        return stops ^ final | last
    raise ValueError(f"no unit {unit}")


def select(bits: int, rank: int) -> int:
    """The place of the set bit with rank set bits below it."""
    if not 0 <= rank < bits.bit_count():
        raise IndexError(rank)
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        if rank < (below := low.bit_count()):
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def cut(data: bytes, first: int, second: int, unit: str = "point") -> tuple[int, int, int, int, int]:
    """Number of units; first and second taken modulo that number and one, in order; and the bytes before each."""
    stops = ends(data, unit)
    n = stops.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, a, b, select(stops, a - 1) + 1 if a else 0, select(stops, b - 1) + 1 if b else 0


def numbers(key: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits that depend on seed and key alone (a null key: the seed alone)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(data: bytes, key: int | None, seed: int = 1, unit: str = "point") -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form (plain, psm or spm), units of prefix and middle (None if plain) and the output."""
    first, second, keep, order = numbers(key, seed)
    n, a, b, start, stop = cut(data, first, second, unit)
    if not data or any(m.encode() in data for m in MARKS) or keep % 100 >= 100 - PLAIN:
        return n, "plain", None, None, data
    p, s, m = (mark.encode() for mark in MARKS)
    prefix, middle, suffix = data[:start], data[start:stop], data[stop:]
    if order % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text of an output. No part has a mark, and no end of a mark is the start of one, so that each mark's first place is
    the true one."""
    if form == "plain":
        return output
    one, two, three = (m.encode() for m in (MARKS if form == "psm" else (MARKS[1], MARKS[0], MARKS[2])))
    at = output.index(two, len(one))
    then = output.index(three, at + len(two))
    left, right, middle = output[len(one) : at], output[at + len(two) : then], output[then + len(three) :]
    return left + middle + right if form == "psm" else right + middle + left


def _mapped(docs: DataFrame, seed: int, unit: str, schema: str, row) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id").to_pylist()
            data = b.column("text").cast(pa.binary())
            rows = [row(k, d, transform(d, k, seed, unit)) for k, d in zip(keys, (v.as_py() for v in data))]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            types = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, types[part.split()[1]]) for c, part in zip(columns, schema.split(", "))], names)

    return texts(docs).mapInArrow(run, schema)


def rewrite(docs: DataFrame, seed: int = 1, unit: str = "point") -> DataFrame:
    """doc_id, form, units of prefix and middle, and the transformed text of each row of docs (doc_id, text).

    A null text is empty; empty texts, and texts that hold a mark, stay as they are (plain, nulls for the parts). A null
    doc_id draws by the seed alone; repeated rows are transformed alike; no rows: no rows; other columns are ignored.
    """
    return _mapped(docs, seed, unit, "doc_id long, form string, prefix_units long, middle_units long, output string", lambda key, data, t: (key, t[1], t[2], t[3], t[4].decode()))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each row of docs by code points; the
    last is of the text rebuilt from output and form. Awkward rows as in rewrite()."""

    def row(key: int | None, data: bytes, t: tuple) -> tuple:
        return key, t[0], t[1], t[2], t[3], hashlib.sha256(t[4]).hexdigest(), hashlib.sha256(restore(t[4], t[1])).hexdigest()

    return _mapped(docs, 1, "point", "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", row)


ORACLE_SQL = """
with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
h as (select doc_id, text, n, ('0x' || substr(d, 1, 8))::bigint % (n + 1) as x, ('0x' || substr(d, 9, 8))::bigint % (n + 1) as y, ('0x' || substr(d, 17, 8))::bigint % 100 as keep, ('0x' || substr(d, 25, 8))::bigint % 100 as ord from t),
c as (select *, least(x, y) as a, greatest(x, y) as b, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or keep >= 90 then 'plain' when ord < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256 from p
"""
