"""Positions of many offsets at once: bytes, code points and UTF-16 units, and lines and columns in each.

A text's line starts are made once and may be stored; an offset then costs one
binary search inside its row.  Everything here works on Arrow batches, a row at
a time, and moves no rows.

Lines are zero-based and end at a newline.  Offsets beyond a text count as its
end, those inside a character (a byte of it, or its second UTF-16 unit) as the
character's beginning, negative ones as 0; a null offset has a null position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

UNITS = ("bytes", "points", "utf16")
STARTS = ArrayType(LongType())
LINES = ArrayType(StructType().add("line", IntegerType()).add("start_byte", LongType()).add("end_byte", LongType()).add("text", StringType()))
#: Where an offset lies: its line, the offset in each unit, and the column in each.
PLACES = {"line": IntegerType(), "byte": LongType(), "point": LongType(), "utf16": LongType(), "byte_column": IntegerType(), "point_column": IntegerType(), "utf16_column": IntegerType()}
POSITIONS = ArrayType(StructType())
for _name, _kind in PLACES.items():
    POSITIONS.elementType.add(_name, _kind)
_NEWLINE, _RETURN = 10, 13


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def starts_of(raw: np.ndarray) -> np.ndarray:
    """Where each line of some bytes begins."""
    return np.concatenate((np.zeros(1, np.int64), np.flatnonzero(raw == _NEWLINE) + 1))


@F.arrow_udf(STARTS)
def _line_starts(texts: pa.Array) -> pa.Array:
    return pa.array([starts_of(_bytes_of(t)).tolist() if t else [] for t in texts.to_pylist()], pa.list_(pa.int64()))


def line_starts(text: Column) -> Column:
    """The byte at which each line begins; none for an empty or null text."""
    return _line_starts(text)


@F.arrow_udf(LINES)
def _lines(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        at, own = 0, []
        for i, line in enumerate(text.split("\n") if text else []):
            bare = line[:-1] if line.endswith("\r") else line
            own.append({"line": i, "start_byte": at, "end_byte": at + len(bare.encode()), "text": bare})
            at += len(line.encode()) + 1
        out.append(own)
    return pa.array(out, to_arrow_type(LINES))


def lines(text: Column) -> Column:
    """Each line's number, bytes (without its CR LF) and text."""
    return _lines(text)


def positions_of(text: str, starts: np.ndarray, offsets: list[int | None], unit: str) -> list[dict | None]:
    """The positions of some offsets, given in ``unit``, in one text whose lines begin at ``starts``."""
    raw = _bytes_of(text)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
    wide = np.concatenate((np.zeros(1, np.int64), np.cumsum(raw[lead] >= 0xF0)))  # two units from U+10000 on
    given = np.array([0 if o is None else max(o, 0) for o in offsets], np.int64)
    if unit == "points":
        point = np.minimum(given, len(lead))
    elif unit == "utf16":
        begins = np.arange(len(lead) + 1) + wide
        point = np.searchsorted(begins, given, "right") - 1
    else:
        point = np.where(given >= len(raw), len(lead), np.searchsorted(lead, given, "right") - 1)
    byte = np.append(lead, len(raw))[point]
    begins_at = starts if len(starts) else np.zeros(1, np.int64)
    line = np.searchsorted(begins_at, byte, "right") - 1
    first = np.searchsorted(lead, begins_at[line])  # code points before the line
    utf16, utf16_first = point + wide[point], first + wide[first]
    columns = np.stack((line, byte, point, utf16, byte - begins_at[line], point - first, utf16 - utf16_first), 1).tolist()
    return [None if o is None else dict(zip(PLACES, c, strict=True)) for o, c in zip(offsets, columns, strict=True)]


def positions(text: Column, offsets: Column, unit: str = "bytes", starts: Column | None = None) -> Column:
    """The positions of an array of offsets in a text; ``starts`` may hold its stored line starts. Null where either is null."""
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {', '.join(UNITS)}")

    @F.arrow_udf(POSITIONS)
    def convert(texts: pa.Array, wanted: pa.Array, begins: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), wanted.to_pylist(), begins.to_pylist(), strict=True)
        return pa.array([None if t is None or o is None else positions_of(t, np.array(s if s else starts_of(_bytes_of(t)), np.int64), o, unit) for t, o, s in rows], to_arrow_type(POSITIONS))

    return convert(text, offsets.cast("array<bigint>"), line_starts(text) if starts is None else starts)
