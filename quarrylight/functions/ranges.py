"""Positions in text: lines, bytes, columns.  Offsets are UTF-8 bytes, lines are zero-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import coordinates


def line_spans(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """One row per line: (keys, line, start_byte, end_byte, text) without the line's CR LF.

    A final newline gives one more, empty line; an empty or null text has none.
    A text's lines are made where it is read: no shuffle, no window.
    """
    return df.select(*keys, F.inline(coordinates.lines(F.col(text_col))))


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, both within the text's lines after clamping, joined by newlines."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    n = F.size(lines)
    lo = F.least(F.greatest(first, F.lit(0)), n)
    hi = F.least(F.greatest(last, lo - 1), n - 1)
    return F.when(text == "", F.lit("")).otherwise(F.array_join(F.slice(lines, lo + 1, F.greatest(hi - lo + 1, F.lit(0))), "\n"))


def slice_bytes(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end (exclusive), clamped to the text."""
    raw = F.encode(text, "UTF-8")
    lo = F.least(F.greatest(start, F.lit(0)), F.octet_length(text))
    hi = F.least(F.greatest(end, lo), F.octet_length(text))
    return F.decode(F.substring(raw, lo + 1, hi - lo), "UTF-8")


def content_slice(text: Column, first_line: Column, last_line: Column, start_byte: Column, end_byte: Column) -> Column:
    """A byte range wins over a line range; without either, the whole text."""
    return (
        F.when(start_byte.isNotNull() & end_byte.isNotNull(), slice_bytes(text, start_byte, end_byte))
        .when(first_line.isNotNull() | last_line.isNotNull(), slice_lines(text, F.coalesce(first_line, F.lit(0)), F.coalesce(last_line, F.size(F.split(text, "\n", -1)))))
        .otherwise(text)
    )


def column_units(line: Column, byte_column: Column) -> Column:
    """A byte column of a line in code points and UTF-16 units."""
    head = F.decode(F.substring(F.encode(line, "UTF-8"), F.lit(1), byte_column), "UTF-8")
    return F.struct(F.char_length(head).alias("code_points"), (F.octet_length(F.encode(head, "UTF-16BE")) / 2).cast("int").alias("utf16"))
