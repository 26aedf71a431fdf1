"""Benchmark decontamination by template canonicalisation.

Words are canonicalised to templates: numbers, units and names (capitalised words) become typed placeholders, other
words their lower-cased letters. Windows of ``WINDOW`` template words of documents and benchmark items are joined by
their 64-bit hash. For each match the slots, that is the original words behind the placeholders, are compared: along
one alignment of a document with an item, equal slot words of the item must stand for equal words in the document
and different ones for different words. Verbatim copies pass with the identity; re-parameterised questions pass with
a consistent renaming; texts that only share the template's shape fail.

Beside the templates stand folded windows: the words themselves with their case folded. Equal folded windows always
match, so that copies in upper, lower or title case and passages full of names and numbers are found.

Items with fewer words than a window are one window of all their words. A template window needs at least
``MIN_LITERAL`` of its words to be literal, so that placeholders alone match nothing; a folded one needs none.

Documents are scanned in blocks, as arrays. If the benchmark has at most ``MAX_BROADCAST`` distinct windows, their hashes are
sent to the tasks, and only matching windows leave a document; beyond that, all windows do and the join is an
ordinary shuffled one. Matches are aggregated by (text, item, alignment), whose size an item's length bounds.

Defined results: null texts and texts without words match nothing; null and repeated ids are kept apart by their texts; repeated
rows get equal results; an empty benchmark or input gives no matches; other columns pass through unchanged.
"""

from __future__ import annotations

import functools
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.llm import arrays
from melisma.session import ship_package, written

WINDOW = 13
MIN_LITERAL = 5
#: Benchmark window hashes that may be sent to every task: 8 bytes each.
MAX_BROADCAST = 2_000_000
#: Matching texts whose keys may be broadcast: about 50 bytes each; beyond that, documents are shuffled.
MAX_KEYS = 500_000
#: Distinct words whose forms a task remembers; longer words are worked out anew.
CACHE, LONG_WORD = 200_000, 64
BATCH_ROWS = 20_000
#: Words for units of measure.
UNITS = frozenset("mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons s sec second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents mph kmh kph hz khz mhz ghz w kw watt watts volt volts degree degrees".split())
SCHEMA = "key string, width long, hash long, pos long, slots array<string>"
_POINTS = sys.maxunicode + 1
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: 2 a decimal digit, 1 another letter or numeral, 0 no part of a word; and a number for it."""
    kinds = np.fromiter((2 if c.isdecimal() else c.isalnum() for c in map(chr, range(_POINTS))), np.uint8, _POINTS)
    return kinds, arrays.mixed(np.arange(1, _POINTS + 1, dtype=np.uint64))


def _forms(word: str) -> bytes:
    """Hashes of a word's template form, whose lowest bit says whether the word is literal, and of its folded form."""
    if word[0].isdecimal():
        form, literal = "<number>", 0
    elif word[0].isupper():
        form, literal = "<name>", 0
    else:
        form, literal = word.lower(), 1
        if form in UNITS:
            form, literal = "<unit>", 0
    template = xxhash.xxh64_intdigest(form.encode()) & (2**64 - 2) | literal
    return template.to_bytes(8, "little") + xxhash.xxh64_intdigest(word.casefold().encode(), seed=1).to_bytes(8, "little")


class Words:
    """The words of a block of texts: maximal runs of letters, or of digits with single points and commas inside.

    first: the number of each text's first word (and of the last one's end); template, folded: hashes of the forms.
    """

    known: dict[int, bytes] = {}

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]]):
        found = [self._words(*self._points(*p)) for p in pieces]
        self.points = np.concatenate([f[0] for f in found]) if len(found) > 1 else found[0][0]
        base = np.cumsum([0, *[len(f[0]) for f in found]])
        self.starts = np.concatenate([f[1] + b for f, b in zip(found, base)])
        self.ends = np.concatenate([f[2] + b for f, b in zip(found, base)])
        self.first = found[0][3] if len(found) == 1 else np.array([0, len(self.starts)])
        self.template, self.folded = self._codes(np.concatenate([f[4] for f in found]))

    @staticmethod
    def _points(units: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes to code points; bytes of ASCII texts stay."""
        if not len(units) or units.max() < 128:
            return units, offsets
        before = np.concatenate([[0], np.cumsum((units & 0xC0) != 0x80)])
        return np.frombuffer(units.tobytes().decode().encode("utf-32-le"), "<u4"), before[offsets]

    @staticmethod
    def _words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kinds, number = _kinds()
        kind = kinds[points]
        # Runs of one kind: borders are where the kind changes and where texts begin.
        border = np.ones(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=border[1:-1])
        border[offsets] = True
        at = np.flatnonzero(border)
        starts, ends = at[:-1], at[1:]
        inside = kind[starts] > 0
        starts, ends = starts[inside], ends[inside]
        text = np.searchsorted(offsets, starts, "right")
        digits = kind[starts] == 2
        joins = digits[:-1] & digits[1:] & (text[:-1] == text[1:]) & (starts[1:] - ends[:-1] == 1)
        near = np.flatnonzero(joins)
        joins[near] = np.isin(points[ends[near]], [ord("."), ord(",")])
        starts, ends = starts[np.concatenate([[True], ~joins])[: len(starts)]], ends[np.concatenate([~joins, [True]])[: len(ends)]]
        return points, starts, ends, np.searchsorted(starts, offsets), arrays.spans(arrays.prefix_sums(number[points]), starts, ends)

    def _codes(self, hashes: np.ndarray) -> np.ndarray:
        """Both forms' hashes of every word; words are told apart by their 64-bit hash, and each one is formed once."""
        place, distinct = pd.factorize(hashes)
        sample = np.empty(len(distinct), np.int64)
        sample[place[::-1]] = np.arange(len(hashes))[::-1]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        codes = list(map(known.get, distinct.tolist()))
        for i, code in enumerate(codes):
            if code is None:
                word = self.word(int(sample[i]))
                codes[i] = _forms(word)
                if len(word) <= LONG_WORD:
                    known[int(distinct[i])] = codes[i]
        return np.frombuffer(b"".join(codes), "<u8").reshape(-1, 2)[place].T

    def word(self, i: int) -> str:
        return self.points[self.starts[i] : self.ends[i]].tobytes().decode("ascii" if self.points.itemsize == 1 else "utf-32-le")

    def slots(self, i: int, width: int) -> list[str]:
        """The original words behind the placeholders of a window; literal words are left out."""
        return [self.word(j) for j in range(i, i + width) if not self.template[j] & 1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "width", "hash", "pos", "slots"])


def template_windows(df: DataFrame, key: Column, text: Column, wanted: np.ndarray | None = None, whole: bool = False, widths: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """(key, width, hash, pos, slots) for the windows of each text, slots null for folded ones; with ``wanted`` (sorted) only those with these hashes.

    whole: texts that are shorter than a window are one window; else such texts have none.
    widths: the windows' widths in words.
    """
    ship_package(df.sparkSession)
    few = None if wanted is None else np.zeros(1 << 20, bool)
    if few is not None:
        few[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def chosen(hashed: np.ndarray) -> np.ndarray:
        """Which hashes are asked for."""
        if few is None:
            return np.arange(len(hashed))
        at = np.flatnonzero(few[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return at[np.isin(hashed[at], wanted)]

    def of_block(keys: list[str], words: Words) -> Iterator[tuple]:
        if not len(words.starts):
            return
        first, n_words = words.first, np.diff(words.first)
        text = np.repeat(np.arange(len(keys)), n_words)
        literal = np.concatenate([[0], np.cumsum((words.template & np.uint64(1)).astype(np.int64))])
        sums = [(arrays.prefix_sums(words.template), True), (arrays.prefix_sums(words.folded), False)]
        windows = []
        for width in widths:
            starts = np.arange(len(text) - width + 1)
            starts = starts[text[starts] == text[starts + width - 1]] if len(starts) else starts
            windows.append((width, starts))
        if whole:
            windows += [(width, first[:-1][n_words == width]) for width in range(1, max(widths)) if width not in widths]
        for width, starts in windows:
            for s, typed in sums if len(starts) else ():
                hashed = arrays.spans(s, starts, starts + width)
                at = chosen(hashed)
                if typed:
                    at = at[literal[starts[at] + width] - literal[starts[at]] >= MIN_LITERAL]
                for i, h in zip(starts[at].tolist(), hashed[at].astype(np.int64).tolist()):
                    yield keys[text[i]], width, h, i - int(first[text[i]]), words.slots(i, width) if typed else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, offsets = arrays.text_bytes(batch.column(1))
            for a, b, pieces in arrays.blocks(units, offsets, lambda u: ~_SPACE[u]):
                rows = of_block(batch.column(0).slice(a, b - a).to_pylist(), Words(pieces))
                while held := list(itertools.islice(rows, BATCH_ROWS)):
                    yield _batch(held)

    return df.select(key.alias("key"), text.alias("text")).mapInArrow(find, SCHEMA)


def text_key(text: Column) -> Column:
    """A key that a text's content decides, so that null and repeated ids do no harm."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def find_matches(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """key (of the text), item_id, n_windows: consistent template matches of docs(text) with benchmark(item_id, text)."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text", text_key(F.col("text")).alias("key"))
    of_items = written(template_windows(items, F.col("key"), F.col("text"), whole=True), "benchmark-windows")
    distinct = of_items.select("hash").distinct()
    wanted = None
    if distinct.limit(max_broadcast + 1).count() <= max_broadcast:
        wanted = np.sort(distinct.toArrow().column(0).to_numpy().astype(np.uint64))
    # Item widths lie between 1 and WINDOW: a few numbers, whatever the benchmark's size.
    widths = tuple(sorted(r[0] for r in of_items.select("width").distinct().collect()))
    hits = template_windows(docs, text_key(F.col("text")), F.col("text"), wanted, widths=widths)
    item = of_items.join(items.select("key", "item_id"), "key").select("item_id", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    folded = F.col("slots").isNull()
    same = F.when(folded, F.col("item_slots").isNull()).otherwise(F.size("slots") == F.size("item_slots"))
    pairs = hits.join(item, "hash").where(same).withColumn("folded", folded)
    slot_map = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    pairs = pairs.withColumn("map", F.coalesce(slot_map, F.array().cast("array<struct<item:string,doc:string>>")))
    # One alignment: the document's window lies as far behind the item's as the others of the alignment do.
    # Folded windows are counted apart, so that no other window of the alignment can take back their match.
    lined = pairs.groupBy("key", "item_id", "folded", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.countDistinct("item_pos").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("map"))).alias("map")
    )
    consistent = (F.size("map") == F.size(F.array_distinct("map.item"))) & (F.size("map") == F.size(F.array_distinct("map.doc")))
    return lined.where(consistent).groupBy("key", "item_id").agg(F.max("n_windows").alias("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows: one row for each document and item that match."""
    matches = written(find_matches(docs, benchmark), "contamination")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return keyed.join(matches, "key").select("doc_id", "item_id", "n_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns."""
    matches = written(find_matches(docs, benchmark).select("key").distinct(), "contaminated-texts")
    few = matches.limit(MAX_KEYS + 1).count() <= MAX_KEYS
    return docs.join(F.broadcast(matches) if few else matches, text_key(docs["text"]) == matches["key"], "left_anti")
