"""Column expressions for words and stable hashes that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def hex_long(digest: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of a digest as a non-negative long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def null_key(col: Column) -> Column:
    """A string key that tells null from every value, for grouping and joining."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def set_aside(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns, and the whole row as ``_row``, so that no other column can clash with new ones."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
