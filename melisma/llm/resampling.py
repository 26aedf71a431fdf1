"""Importance resampling towards a target: hashed n-gram gains and a seeded Gumbel draw.

Bytes of whole Arrow buffers pass a vectorised automaton (``features``): a lookup table makes every byte a letter of a
word or a break, word borders are differences of neighbours, and the CRCs of all words' features advance together, one
byte a step, through the CRC's own table; a feature's state is read where its word ends and goes on through a space
into the next word. Starts whose features have ended leave; when few are left, ``zlib`` finishes them from their state.

Counts of a feature's bucket over all documents and over the target give the bucket's gain; a document's weight is the
sum over its features, and its score adds noise that depends on its id alone. The texts are read twice (counts, then
weights); only rows of a few numbers are ranked, by range partitions of (eligible, score, doc_id) whose sizes give each
its first rank, so nothing passes through one task. The driver sees a count for each bucket and for each partition.

Defined results: a null text has no words, weight 0 and no rank; A-Z are lower-cased, every byte that isn't a digit, a
letter or part of a non-ASCII character ends a word; repeated rows are documents of their own, count again, and rank in
any order among themselves; a null doc_id is hashed as ``null`` and loses ties; an empty target or corpus has counts of 0;
further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.llm.arrays import blocks, runs, text_bytes
from melisma.session import ship_package, written

BUCKETS = 10_000
#: Bytes taken at once, and active starts below which a library call for each is cheaper than array steps.
BLOCK = 1 << 18
FEW = 64
SCALE = 4_294_967_296.0


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial that zlib's CRC uses."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
#: A byte's letter in words; 0 for bytes outside words.
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 256)
for _first, _last, _shift in (("0", "9", 0), ("a", "z", 0), ("A", "Z", 32)):
    _LETTER[ord(_first) : ord(_last) + 1] = np.arange(ord(_first), ord(_last) + 1) + _shift
_SPACE = 0x20


def _in_word(units: np.ndarray) -> np.ndarray:
    return _LETTER[units] != 0


def crcs(stream: np.ndarray, first: np.ndarray, stop: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each word a row of CRCs of the bytes from its start to its own end and to the end of each further word up to ``last``.

    ``stream``: words with one space behind each; word i is ``first[i]:stop[i]``. ``last[i]``: the word at which the
    features of word i stop. Entries of words beyond it are 0. Longest features come first, so those that are still
    open after any number of steps stand at the front.
    """
    n = len(first)
    width = int((last - np.arange(n)).max()) + 1
    word = np.arange(n)[:, None] + np.arange(width)[None, :]
    there = word <= last[:, None]
    length = stop[last] - first
    order = np.argsort(-length, kind="stable")
    length = length[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    steps = (stop[np.minimum(word, n - 1)] - first[:, None])[there]  # after how many bytes each feature ends
    slots = np.broadcast_to(place[:, None], there.shape)[there]
    by_step = np.argsort(steps, kind="stable")
    until = np.searchsorted(steps[by_step], np.arange(int(length[0]) + 1), "right")
    found = np.zeros(len(steps), np.uint32)
    state, at, step = np.full(n, 0xFFFFFFFF, np.uint32), first[order], 0
    active = n
    while active > FEW:
        now = state[:active]
        state[:active] = _CRC[now.astype(np.uint8) ^ stream[at[:active]]] ^ (now >> np.uint32(8))
        at[:active] += 1
        step += 1
        ended = by_step[until[step - 1] : until[step]]
        if len(ended):
            found[ended] = state[slots[ended]] ^ np.uint32(0xFFFFFFFF)
            active = int(np.searchsorted(-length, -step, "left"))  # those longer than the steps taken
    if active:
        raw, left = memoryview(stream), by_step[until[step] :]
        left = left[np.argsort(slots[left], kind="stable")]
        crc, before, slot = 0, 0, -1
        for e in left.tolist():  # a slot's ends follow each other
            if slots[e] != slot:
                slot, crc, before = int(slots[e]), int(state[slots[e]]) ^ 0xFFFFFFFF, step
            origin = int(at[slot]) - step
            crc = zlib.crc32(raw[origin + before : origin + int(steps[e])], crc)
            before = int(steps[e])
            found[e] = crc
    out = np.zeros((n, width), np.uint32)
    out[there] = found
    return out


def _stream(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters with one space behind each word, and where each word ends."""
    to = np.cumsum(ends - starts + 1)
    stream = np.full(int(to[-1]) if len(to) else 0, _SPACE, np.uint8)
    inside = np.ones(len(stream), bool)
    inside[to - 1] = False
    letters = _LETTER[units]
    stream[inside] = letters[letters != 0]
    return stream, to - 1


def _features(pieces: list[tuple[np.ndarray, np.ndarray]], buckets: int, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each feature's text (its number in the block) and bucket, and each word's text; a long text's pieces follow one another."""
    held = np.zeros(0, np.uint8)  # the last words of a long text's earlier pieces
    for units, offsets in pieces:
        starts, ends = runs(_in_word(units), offsets)
        stream, stop = _stream(units, starts, ends)
        owner = np.searchsorted(offsets, starts, "right") - 1
        old = np.flatnonzero(held == _SPACE)
        if len(old):
            stream, stop, owner = np.concatenate([held, stream]), np.concatenate([old, stop + len(held)]), np.concatenate([np.zeros(len(old), np.int64), owner])
        n = len(stop)
        if not n:
            continue
        first = np.concatenate([[0], stop[:-1] + 1])
        last = np.minimum(np.arange(n) + max_n - 1, np.searchsorted(owner, owner, "right") - 1)
        rows = crcs(stream, first, stop, last)
        word = np.arange(n)[:, None] + np.arange(rows.shape[1])[None, :]
        there = (word <= last[:, None]) & (word >= len(old))  # a feature that ends in a held word has been given already
        yield np.repeat(owner, there.sum(1)), (rows[there] % np.uint32(buckets)).astype(np.int64), owner[len(old) :]
        if len(pieces) > 1 and max_n > 1:
            held = stream[first[max(0, n - max_n + 1)] :]


def features(texts: pa.Array, buckets: int = BUCKETS, max_n: int = 3, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block: the first text, the text after the last, then of ``_features``; a long text alone in several blocks."""
    units, offsets = text_bytes(texts)
    for lo, hi, pieces in blocks(units, offsets, _in_word, size):
        for found in _features(pieces, buckets, max_n):
            yield lo, hi, *found


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks count before anything is shuffled."""
    ship_package(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket, _ in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = rows.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share of a bucket over the corpus's)."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(map(float, corpus), map(float, target))], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    ship_package(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, owner, bucket, word in features(batch.column(1), len(table.value)):
                each = np.bincount(owner, minlength=hi - lo)
                n[lo:hi] += each
                words[lo:hi] += np.bincount(word, minlength=hi - lo)
                ends = np.cumsum(each)
                sums = np.concatenate([[0], np.cumsum(table.value[bucket])])
                weight[lo:hi] += sums[ends] - sums[ends - each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel draw for an id, times 1000, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / SCALE)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: floor(percent * N / 100) of the N documents with enough words get a rank."""
    gain = gains(bucket_counts(docs, "text", buckets), bucket_counts(target, "text", buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= least_words)
    scored = written(scored, "importance")
    drawn = percent * scored.where("fit").count() // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = written(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "importance-parts")
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    before, first = 0, []
    for part in sorted(sizes):
        first.append((part, before))
        before += sizes[part]
    starts = docs.sparkSession.createDataFrame(first, "part int, before long")
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = parts.join(F.broadcast(starts), "part").withColumn("rank", at)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
