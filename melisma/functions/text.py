"""Text normalisers and classifiers as column expressions. Each layer has its own rules; they aren't interchangeable."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from melisma.functions import constants as K


def alnum_words(x: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces: for titles and artists in retrieval."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def canonical_title(x: Column) -> Column:
    """A title without bracketed or dashed version notes, as :func:`alnum_words`."""
    x = F.coalesce(x, F.lit(""))
    bare = F.regexp_replace(x, r"(?i)[\[(](?=[^\])]*" + K.VERSION_MARKER + r")[^\])]+[\])]", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?)\s+-\s+(.*)$", 1)
    tail = F.regexp_extract(bare, r"(?s)^(.*?)\s+-\s+(.*)$", 2)
    return alnum_words(F.when(F.rlike(tail, F.lit("(?i)" + K.VERSION_MARKER)), head).otherwise(bare))


def label(x: Column) -> Column:
    """Lower case, trimmed, single spaces; punctuation stays: for labels in ranking and feedback."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def session_text(x: Column) -> Column:
    """As :func:`label`, and underscores are spaces: for session filters."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s_]+", " ")))


def compact(x: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(session_text(x), r"[^\p{L}\p{N}]", "")


def tag_name(x: Column) -> Column:
    """Lower case, underscores and slashes as spaces, single spaces: for tag names that are in NFKC already."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(x)), "[_/]+", " "), r"\s+", " ")


@F.pandas_udf(StringType())
def nfkc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, which Spark has no expression for."""
    for v in values:
        yield v.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def unaccented(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks."""
    for v in values:
        yield v.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def identity(x: Column, accents: bool = True) -> Column:
    """The key under which records of different sources are the same work; accents=False skips the Python step."""
    x = F.coalesce(x, F.lit(""))
    x = F.lower(unaccented(x) if accents else x)
    x = F.replace(F.replace(x, F.lit("&"), F.lit(" and ")), F.lit("?"), F.lit(" questionmark "))
    x = F.regexp_replace(x, r"\bpt\.?\s*(\d+)\b", "part $1")
    kinds = r"(?:\d{4}\s+)?re-?master(?:ed)?(?:\s+version)?|live(?:\s+at[^)\]]*)?|concert|unplugged|session|cover|tribute|karaoke|original(?:\s+version)?"
    x = F.regexp_replace(x, r"(?i)\s*[-–—(\[]\s*(?:" + kinds + r")[^)\]]*[)\]]?\s*$", "")
    return F.regexp_replace(x, "[^a-z0-9]+", "")


def version_class(*parts: Column) -> Column:
    """remastered, live, cover, original or unknown, from title, album and version."""
    text = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    found = lambda pattern: F.rlike(text, F.lit("(?i)" + pattern))
    return (
        F.when(found(K.REMASTERED), "remastered").when(found(K.LIVE), "live").when(found(K.COVER), "cover")
        .when(F.trim(text) != "", "original").otherwise("unknown")
    )


def version_priority(kind: Column) -> Column:
    out = F.lit(0)
    for name, value in K.VERSION_PRIORITY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def external_version(title: Column, album: Column) -> Column:
    """live_or_session, remastered, deluxe or album_cut, by what stands after a dash or bracket, and the album."""
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(album, F.lit("")))
    after = lambda mark: F.when(F.contains(t, F.lit(mark)), F.substring(t, F.instr(t, mark) + len(mark), F.length(t))).otherwise("")
    labels = F.concat_ws(" ", after(" - "), after("("), a)
    has = lambda *words: F.rlike(labels, F.lit("|".join(words)))
    return F.when(has("live", "session", "acoustic", "mtv unplugged"), "live_or_session").when(has("remaster"), "remastered").when(has("deluxe", "bonus"), "deluxe").otherwise("album_cut")


def version_penalty(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, value in K.VERSION_PENALTIES.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def track_signature(title: Column, artist: Column) -> Column:
    """artist::title with the title cut at the first version marker; empty if either is empty."""
    whole = compact(title)
    cut = whole
    for marker in K.SIGNATURE_MARKERS:
        cut = F.substring_index(cut, marker, 1)
    a = session_text(artist)
    named = F.concat(a, F.lit("::"), F.when(cut == "", whole).otherwise(cut))
    return F.when((a == "") | (session_text(title) == ""), "").otherwise(named)


def family_key(artist: Column) -> Column:
    """A shared surname that makes artists one family, else empty."""
    a = F.lower(F.coalesce(artist, F.lit("")))
    found = F.lit("")
    for name in ("albarn", "ashcroft", "gallagher"):
        found = F.when(F.rlike(a, F.lit(rf"\b[a-z]+ {name}\b")), name).otherwise(found)
    return F.when((found == "") & F.contains(a, F.lit("gallagher")), "gallagher").otherwise(found)


def slug(*parts: Column) -> Column:
    """Lower-case ASCII words of all parts, joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-"), "^-|-$", "")


def first_year(date: Column) -> Column:
    """The year that a date text starts with."""
    return F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int")
