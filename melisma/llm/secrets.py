"""Secret scan with corpus-wide ownership frequency.

Base spans come from three fixed patterns. The method looks at every long mixed string (a candidate), hashes it,
and counts over the corpus the distinct texts, repositories and owners that hold it. A live-looking candidate (high
entropy) is owner-specific, and becomes a further span of kind ``owned``, unless it is widely copied: held by at
least ``WIDE_TEXTS`` different texts that come from at least ``WIDE_OWNERS`` owners or ``WIDE_REPOSITORIES``
repositories. Copies of one whole text are one text, so a copied document doesn't make its own secret an example, and
a string in many texts of one owner stays that owner's.

Texts are scanned once, each on its own. Only candidates move: distinct (candidate, text, owner, repository) rows are
formed first, with partial aggregation, so that a string found in a third of all rows is no single task. The
narrow scan result is a written table, so nothing is scanned again if an executor is lost.

Defined results: a null text is empty; a null owner or repository counts as one of its own; repeated rows get equal
results, and so do rows of equal text; base spans stay whatever the method finds; texts are scanned whole, whatever
their length; of the input only the columns ``keep`` are handed on, and these mustn't be named base, candidates,
text_hash, owned or those of the counts; an empty input gives an empty output.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.llm.text import null_key
from melisma.session import ship_package, written

KINDS = ("assign", "access", "hex")
#: The base patterns and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20
KEYWORDS = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}", re.ASCII)
#: Bits for each character that a live-looking candidate has at least.
MIN_ENTROPY = 3.0
#: A candidate in so many different texts, from so many owners or repositories, is a widely copied example.
WIDE_TEXTS, WIDE_OWNERS, WIDE_REPOSITORIES = 3, 2, 3

SCHEMA = "base array<struct<kind:string,start:long,end:long>>, candidates array<struct<hash:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def looks_live(value: str) -> bool:
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= MIN_ENTROPY


def candidate_spans(text: str) -> list[tuple[str, int, int]]:
    return [(hashlib.md5(m[0].encode()).hexdigest(), *m.span()) for m in CANDIDATE.finditer(text) if looks_live(m[0])]


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with text_hash, base and candidates (SCHEMA)."""
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash"), F.coalesce("text", F.lit("")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    span = lambda first: pa.list_(pa.struct([(first, pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                base.append([dict(zip(("kind", "start", "end"), x)) for x in base_spans(text)])
                more.append([dict(zip(("hash", "start", "end"), x)) for x in candidate_spans(text)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, span("kind")), pa.array(more, span("hash"))], names=[*batch.schema.names[:-1], "base", "candidates"])

    return rows.mapInArrow(find, f"{fields}, {SCHEMA}")


def ownership(found: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """hash, texts, owners, repositories: how many distinct ones hold each candidate.

    Distinct triples first; then each count is a distinct one over pairs that are far fewer than the rows.
    """
    held = found.select(F.explode("candidates.hash").alias("hash"), "text_hash", null_key(owner).alias("o"), null_key(repository).alias("r")).distinct()
    counted = lambda c, name: held.select("hash", c).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(name))
    return counted("text_hash", "texts").join(counted("o", "owners"), "hash").join(counted("r", "repositories"), "hash")


def widely_copied(texts: Column, owners: Column, repositories: Column) -> Column:
    return (texts >= WIDE_TEXTS) & ((owners >= WIDE_OWNERS) | (repositories >= WIDE_REPOSITORIES))


def find_secrets(docs: DataFrame, keep: list[str], owner: Column, repository: Column) -> DataFrame:
    """The columns ``keep`` of ``docs`` (at least those of owner, repository) with base and owned spans.

    base and owned: array<struct<kind, start, end>> by start; n_shared: candidates that are widely copied; owners and
    repositories: the most that hold a candidate of the row (null without candidates).
    """
    found = written(scan(docs, keep), "secret-scan")
    counts = written(ownership(found, owner, repository), "ownership")
    # Spans depend on the text alone, so each distinct text with candidates joins once.
    texts = found.where(F.size("candidates") > 0).groupBy("text_hash").agg(F.first("candidates").alias("c"))
    spans = texts.select("text_hash", F.inline("c")).join(counts, "hash", "left")
    wide = widely_copied(F.col("texts"), F.col("owners"), F.col("repositories"))
    marked = spans.groupBy("text_hash").agg(
        F.sort_array(F.collect_list(F.when(~wide, F.struct("start", "end")))).alias("o"), F.sum(wide.cast("long")).alias("n_shared"),
        F.max("owners").alias("owners"), F.max("repositories").alias("repositories"),
    )
    owned = F.transform(F.coalesce("o", F.array().cast("array<struct<start:long,end:long>>")), lambda s: F.struct(F.lit("owned").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = found.join(written(marked, "owned-spans"), "text_hash", "left")
    return joined.select(*[found[c] for c in keep], "base", owned.alias("owned"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "owners", "repositories")
