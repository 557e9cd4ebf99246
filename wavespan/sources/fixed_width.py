"""Fixed-width wave text, read and written with a layout table.

Files carry no note of their encoding, and old ones hold one byte per character. Spark's text reader
hands on the bytes of a line as they are; lines or fields are decoded here with the charset the
caller names. Columns count characters, or bytes if a multi-byte file was laid out by bytes.
"""

from __future__ import annotations

import codecs
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.functions.na import to_number


@dataclass(frozen=True)
class Field:
    """One variable: 1-based start column, width, type and implied decimal places."""

    name: str
    start: int
    width: int
    kind: str = "long"
    decimals: int = 0


def _beyond_latin(charset: str) -> tuple[str, str]:
    """Characters of a one-byte charset that differ from those of the same bytes in ISO 8859-1."""
    raw = bytes(range(256))
    own = raw.decode(charset, errors="replace")
    if len(own) != len(raw):
        raise ValueError(f"{charset} is no charset of single bytes")
    pairs = [(a, b) for a, b in zip(raw.decode("latin-1"), own) if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _is_utf8(charset: str) -> bool:
    return codecs.lookup(charset).name in ("utf-8", "ascii")


def decoded(raw: Column, charset: str) -> Column:
    """Text from bytes. Bytes that are no UTF-8 raise; in one-byte charsets an undefined byte becomes
    the replacement character."""
    if _is_utf8(charset):
        return F.validate_utf8(raw.cast("string"))
    latin, own = _beyond_latin(charset)
    text = F.decode(raw, "ISO-8859-1")
    return F.translate(text, latin, own) if latin else text


def encoded(text: Column, charset: str) -> Column:
    """Bytes of a text; a character that the charset lacks raises."""
    if _is_utf8(charset):
        return text.cast("binary")
    latin, own = _beyond_latin(charset)
    known = [chr(b) for b in range(256) if chr(b) not in latin] + list(own.replace("�", ""))
    strange = F.translate(text, "".join(known), "")
    checked = F.when(strange != "", F.raise_error(F.concat(
        F.lit(f"not in {charset}: "), strange))).otherwise(text)
    return F.encode(F.translate(checked, own, latin) if latin else checked, "ISO-8859-1")


def _by_bytes(unit: str) -> bool:
    if unit not in ("char", "byte"):
        raise ValueError("unit must be 'char' or 'byte'")
    return unit == "byte"


def parse_fixed_width(lines: DataFrame, layout: Sequence[Field], text: str = "value",
                      charset: str = "UTF-8", unit: str = "char") -> DataFrame:
    """Cut lines (text as read, or binary) into typed columns; blank or non-numeric fields become
    NULL, also those beyond the end of a short line.

    ``unit="char"`` decodes the line and counts characters. ``unit="byte"`` cuts its bytes and then
    decodes the text fields, so that a character of several bytes in one field does not shift the
    next; numbers are plain digits in every charset.
    """
    raw = F.col(text).cast("binary")
    by_bytes = _by_bytes(unit)
    line = raw if by_bytes else decoded(raw, charset)
    columns = []
    for f in layout:
        part = F.substring(line, f.start, f.width)
        if by_bytes:
            part = decoded(part, charset if f.kind == "string" else "ISO-8859-1")
        part = F.trim(part)
        if f.kind == "string":
            value = F.nullif(part, F.lit(""))
        elif f.decimals:
            value = to_number(part, "double") / F.lit(float(10 ** f.decimals))
        else:
            value = to_number(part, f.kind)
        columns.append(value.alias(f.name))
    return lines.select(*columns)


def format_fixed_width(df: DataFrame, layout: Sequence[Field], text: str = "value",
                       charset: str = "UTF-8", unit: str = "char") -> DataFrame:
    """Inverse of :func:`parse_fixed_width`: lines whose bytes are in ``charset``. A value wider than
    its field raises."""
    by_bytes = _by_bytes(unit)
    parts, position = [], 1

    def shape(shown: Column) -> Column:
        return encoded(shown, charset) if by_bytes else shown

    space = F.lit(b" ") if by_bytes else F.lit(" ")
    for f in sorted(layout, key=lambda f: f.start):
        if f.start > position:
            parts.append(shape(F.lit(" " * (f.start - position))))
        value = F.col(f.name)
        if f.decimals:
            value = F.rint(value * F.lit(float(10 ** f.decimals))).cast("long")
        shown = shape(F.coalesce(value.cast("string"), F.lit("")))
        fits = F.when(F.length(shown) <= f.width, shown).otherwise(
            F.raise_error(F.concat(F.lit(f"too wide for {f.name}: "), value.cast("string")))
            .cast("binary" if by_bytes else "string"))
        pad = F.lpad if f.kind != "string" else F.rpad
        parts.append(pad(fits, F.lit(f.width), space))
        position = f.start + f.width
    line = F.concat(*parts)
    return df.select((line if by_bytes else encoded(line, charset)).cast("string").alias(text))


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[Field],
                     charset: str = "UTF-8", unit: str = "char") -> DataFrame:
    return parse_fixed_width(spark.read.text(path), layout, charset=charset, unit=unit)


def write_fixed_width(df: DataFrame, path: str, layout: Sequence[Field], charset: str = "UTF-8",
                      unit: str = "char") -> None:
    format_fixed_width(df, layout, charset=charset, unit=unit).write.text(path)
