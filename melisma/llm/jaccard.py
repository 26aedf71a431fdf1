"""Similarity join on word n-grams by Jaccard index, with prefixes under several global token orders.

A document's set is its distinct word n-grams (64-bit hashes). Sets of equal content form one class (96-bit
digest), so exact copies never meet in pairs. Two classes link if their Jaccard index reaches ``percent``.

Global orders: the corpus's most frequent n-grams come last, by rising frequency; all others are ordered by a hash
that differs for each order. If two sets of sizes a <= b link, they share at least o = ceil(t / (1 + t) (a + b))
n-grams, so under every order the first shared n-gram stands among the first a - o + 1 and b - o + 1 of them.
Candidates are the pairs for which this holds under every one of ``ORDERS`` orders. The orders are indexed one after
the other, and a later one only for classes that have a possible partner in all earlier ones, so that its index is
small; then the indexes' pairs are intersected before the sets themselves are compared.

The frequency table is bounded (``FREQUENT`` rows) and decides the order only: any order gives the same result. It
holds n-grams that are found repeatedly within ``CHUNK`` of a task; where the first index still has a bucket of more
than ``HEAVY`` classes, which it counts over the whole corpus, those n-grams join the table and the index is made
again. An index bucket of a frequent n-gram is dealt over several tasks; its classes then all stay.

Groups of thousands of near copies are not paired among themselves. A first round compares every member of an index
bucket with one leader of it (the set with the least share of rare n-grams) and forms components of the links found. A second
round generates the remaining candidates, which are pairs of the same bucket in different components; pairs within
one component can't change the components, which are thus exact. Dropping similar rows needs no more than that.

The numbers of links are exact too. Every link lies within a component, so all pairs of a component's sets are compared
there: in one block, or, for a component beyond ``BLOCK_SETS`` or ``BLOCK_GRAMS``, in all pairs of blocks whose sizes
allow a link. A pair of blocks is one small matrix product; only counts leave it, never the pairs.

Classes, indexes, pairs and links are written tables. Texts are never shuffled: later passes find theirs by a Bloom
filter of bounded size over the document ids, and what it lets through too much is dropped by the joins that follow.

Defined results: null and blank texts have an empty set, link with nothing and are components of their own; texts
with fewer words than n have their whole word sequence as one n-gram, whatever a text's length; rows of equal sets
share a class, also if their ids repeat; class_id is the smallest id of the class (that of a row with an empty set its
own), class_links counts the other classes that it links with, doc_links the other rows that a row links with, those
of its class included; component_id is the smallest id of the component (null if it has none);
other columns are not read by the join, and ``drop_similar`` hands all of them on; an empty input gives an empty
output.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from melisma.llm import arrays
from melisma.llm.arrays import mixed
from melisma.llm.bloom import Bloom, probes
from melisma.llm.rows import row_id, row_tag, with_keys, without_keys
from melisma.session import discard, ship_package, written

ORDERS = 2
#: N-grams in the frequency table: 28 bytes each, in every Python worker.
FREQUENT = 500_000
#: N-grams whose repetition is counted together, and how often one must be found there to be reported.
CHUNK, LEAST = 2_000_000, 2
#: Classes of a bucket from which its n-gram joins the frequency table, and about how many one task takes.
HEAVY, SPLIT = 10_000, 1_000
#: Classes that a task remembers, to emit the prefixes of copies once.
SEEN = 200_000
#: Entries in a record batch.
ROWS = 100_000
#: Sets, and n-grams in them, of about one block when links are counted; numbers in a matrix there.
BLOCK_SETS, BLOCK_GRAMS, CELLS = 512, 500_000, 2_000_000
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.arange(256)
#: A number for each byte, the same for both cases of A to Z.
LETTER = mixed(np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1))
_PLACE = [np.uint64(pow(arrays.STEP, i + 1, 2**64)) for i in range(64)]
_ORDER = [np.uint64((arrays.STEP * (2 * i + 1)) % 2**64) for i in range(ORDERS)]
NO_GRAMS = np.zeros(0, np.uint64)


def _not_space(units: np.ndarray) -> np.ndarray:
    return ~SPACE[units]


def _hashed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and the first one of each text (and the last one's end)."""
    found = []
    for units, offsets in pieces:
        starts, ends = arrays.runs(_not_space(units), offsets)
        found.append((arrays.spans(arrays.prefix_sums(LETTER[units]), starts, ends), np.searchsorted(starts, offsets)))
    if len(found) == 1:
        return found[0]
    words = np.concatenate([h for h, _ in found])
    return words, np.array([0, len(words)])


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):  # a polynomial in an odd number, so that order counts, before it is scattered
        out += words[i : len(words) - n + 1 + i] * _PLACE[i % 64]
    return mixed(out)


def _distinct(grams: np.ndarray) -> np.ndarray:
    grams = np.sort(grams)
    new = np.ones(len(grams), bool)
    np.not_equal(grams[1:], grams[:-1], out=new[1:])
    return grams[new]


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams, ASCII letters lower-cased."""
    units, offsets = arrays.text_bytes(texts)
    for _, _, pieces in arrays.blocks(units, offsets, _not_space):
        words, at = _hashed(pieces)
        grams = _grams(words, n) if len(words) >= n else NO_GRAMS
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                yield _distinct(grams[a : b - n + 1])
            else:
                yield _grams(words[a:b], b - a) if b > a else NO_GRAMS


def digest(values: np.ndarray) -> tuple[int, int]:
    """96 bits that stand for a set, as a signed long and a signed number of 32 bits."""
    d = xxhash.xxh128_intdigest(values)
    high, low = (d >> 64) & (2**64 - 1), d & (2**32 - 1)
    return high - 2**64 if high >= 2**63 else high, low - 2**32 if low >= 2**31 else low


def classes(docs: DataFrame, n: int) -> DataFrame:
    """Written rows of two kinds: (doc_id, tag, size, s1, s2) by document; (token, found) for n-grams found repeatedly."""
    ship_package(docs.sparkSession)
    types = {"doc_id": pa.int64(), "tag": pa.int64(), "size": pa.int32(), "s1": pa.int64(), "s2": pa.int32(), "token": pa.int64(), "found": pa.int64()}
    schema = pa.schema(types.items())

    def batch(rows: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in types.items()], schema=schema)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        # Sorted in place, and counted only where repeats stand side by side, so that a chunk is held twice at most.
        grams = np.concatenate(sets)
        sets.clear()
        grams.sort()
        repeated = _distinct(grams[LEAST - 1 :][grams[LEAST - 1 :] == grams[: len(grams) - LEAST + 1]]) if len(grams) >= LEAST else NO_GRAMS
        found = np.searchsorted(grams, repeated, "right") - np.searchsorted(grams, repeated)
        return batch(len(repeated), {"token": repeated.astype(np.int64), "found": found})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, held = [], set(), 0
        for b in batches:
            keys, sizes = [], []
            for grams in ngram_sets(b.column(2), n):
                sizes.append(len(grams))
                keys.append(digest(grams) if len(grams) else (0, 0))
                if len(grams) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    sets.append(grams)
                    held += len(grams) + 20
                if held >= CHUNK:
                    yield counted(sets)
                    sets, seen, held = [], set(), 0
            yield batch(b.num_rows, {"doc_id": b.column(0), "tag": b.column(1), "size": sizes, "s1": [k[0] for k in keys], "s2": [k[1] for k in keys]})
        if sets:
            yield counted(sets)

    rows = docs.select(row_id(docs).alias("doc_id"), row_tag(docs, "text").alias("tag"), docs["text"])
    return written(rows.mapInArrow(read, "doc_id long, tag long, size int, s1 long, s2 int, token long, found long"), "ngram-classes")


def frequent_tokens(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most repeated n-grams, sorted, and their counts."""
    top = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("found").alias("found"))
    rows = top.orderBy(F.desc("found"), "token").limit(FREQUENT).toArrow()
    token, count = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy().astype(np.int64)
    order = np.argsort(token)
    return token[order], count[order]


class Orders:
    """The global orders as sort keys: rare n-grams by hash first, then the frequent ones by count and hash."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray]):
        self.token, count = frequent
        self.maybe = np.zeros(1 << 23, bool)
        self.maybe[self._low(self.token)] = True
        self.salts = np.minimum(count // SPLIT, MOST_SALTS).astype(np.int32)
        self.place = []
        for order in range(ORDERS):
            place = np.empty(len(self.token), np.uint64)
            place[np.lexsort((mixed(self.token + _ORDER[order]), count))] = np.arange(len(self.token), dtype=np.uint64)
            self.place.append(place)

    @staticmethod
    def _low(values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << 23) - 1)).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are in the table, and where there."""
        at = np.flatnonzero(self.maybe[self._low(values)])
        found = np.searchsorted(self.token, values[at])
        found[found == len(self.token)] = 0
        hit = self.token[found] == values[at] if len(at) else np.zeros(0, bool)
        return at[hit], found[hit]

    def prefixes(self, sets: list[np.ndarray], lengths: list[int], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first n-grams of each set under an order, all in a row, their salts (0: not split), and the rare ones of each set."""
        values = np.concatenate(sets)
        key = mixed(values + _ORDER[order]) >> np.uint64(1)
        salt, often = np.zeros(len(values), np.int64), np.zeros(len(values) + 1, np.int64)
        at, found = self.find(values)
        key[at] = self.place[order][found] | np.uint64(1 << 63)
        salt[at] = self.salts[found]
        often[at + 1] = 1
        ends = np.cumsum([len(s) for s in sets])
        starts = ends - [len(s) for s in sets]
        often = np.cumsum(often)
        near = []
        for a, b, p in zip(starts.tolist(), ends.tolist(), lengths):
            k = key[a:b]
            first = np.argpartition(k, p - 1)[:p] if p < b - a else np.arange(b - a)
            near.append(first[np.argsort(k[first])] + a)
        chosen = np.concatenate(near)
        return values[chosen], salt[chosen], (ends - starts) - (often[ends] - often[starts])


def prefix_length(size: int, percent: int) -> int:
    """Among so many first n-grams stands one that is shared with any linked set."""
    return size + (-percent * size) // 100 + 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", *probes(F.col("doc_id").cast("long")))


def _wanted(batch: pa.RecordBatch, wanted: Bloom | None) -> pa.Array:
    """The texts of a batch, with ``wanted`` those whose ids may have been added."""
    if wanted is None:
        return batch.column(0)
    return batch.column(0).filter(pa.array(wanted.hit(batch.column(1).to_numpy(), batch.column(2).to_numpy())))


#: Salts are told apart in a bucket's number by this odd factor; at most MOST_SALTS tasks share an n-gram.
SALT, MOST_SALTS = 0x9E3779B97F5, 1 << 16


def prefixes(docs: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], order: int, wanted: Bloom | None = None) -> DataFrame:
    """bucket, s1, place (size and position), rest: prefix n-grams under an order; with ``wanted`` of those documents.

    bucket: the n-gram, changed by a salt if it is split. rest: from high to low the salt (0: not split), how rare
    the set is in 255ths, and s2. Few narrow columns, since all of this is shuffled. Copies of a class that a task
    remembers are dropped there, the others by the index.
    """
    schema, limit = pa.schema([(c, pa.int64()) for c in ("bucket", "s1", "place", "rest")]), ROWS
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def made(held: list[tuple[np.ndarray, tuple[int, int]]], orders: Orders) -> pa.RecordBatch:
        sets = [s for s, _ in held]
        lengths = [prefix_length(len(s), percent) for s in sets]
        token, salt, rare = orders.prefixes(sets, lengths, order)
        s1 = np.repeat(np.array([k[0] for _, k in held], np.int64), lengths)
        s2 = np.repeat(np.array([k[1] for _, k in held], np.int32), lengths)
        ends = np.cumsum(lengths)
        pos = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        place = np.repeat(np.array([len(s) for s in sets], np.int64) << 32, lengths) | pos
        salt = np.where(salt > 0, 1 + (s1 & 0x7FFFFFFF) % np.maximum(salt, 1), 0)
        share = np.repeat(rare * 255 // [len(s) for s in sets], lengths)
        columns = (token.astype(np.int64) ^ (salt * SALT), s1, place, salt << 40 | share << 32 | s2.astype(np.int64) & 0xFFFFFFFF)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, seen, orders = [], 0, set(), Orders(sent.value)
        for batch in batches:
            for grams in ngram_sets(_wanted(batch, wanted), n):
                if not len(grams) or (key := digest(grams)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                held.append((grams, key))
                rows += len(grams)
                if rows >= limit:
                    yield made(held, orders)
                    held, rows = [], 0
        if held:
            yield made(held, orders)

    return _texts(docs).mapInArrow(read, "bucket long, s1 long, place long, rest long")



def _overlap(a: Column, b: Column, percent: int) -> Column:
    """How many n-grams sets of sizes a and b share at least if they link."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def _size(place: Column) -> Column:
    return F.shiftright(place, 32)


def _pos(place: Column) -> Column:
    return place.bitwiseAND(F.lit(0xFFFFFFFF))


def _near(x: Column, y: Column, percent: int) -> Column:
    """Sets of these places can link as their sizes are."""
    a, b = _size(x), _size(y)
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _possible(x: Column, y: Column, percent: int) -> Column:
    """Sizes and positions allow a link whose first shared n-gram is this one."""
    o = _overlap(_size(x), _size(y), percent)
    return _near(x, y, percent) & (_pos(x) + o <= _size(x)) & (_pos(y) + o <= _size(y))


def _index(entries: DataFrame, percent: int) -> DataFrame:
    """The entries that can have a partner in their bucket, without repeats of a class, with the bucket's leader (l_...).

    Entries are shuffled once, by n-gram, and sorted once there, by size: repeats of a class stand side by side, and
    if any other set of the bucket is near enough by size, a neighbour is. A bucket that is dealt over tasks by salt
    isn't searched: all its entries stay.
    """
    line = W.partitionBy("bucket").orderBy("place", "s1", "rest")
    once = entries.withColumn("before", F.lag(F.struct("s1", "rest")).over(line))
    once = once.where(F.col("before").isNull() | (F.col("before") != F.struct("s1", "rest"))).drop("before")
    held = once.withColumns({"before": F.lag("place").over(line), "after": F.lead("place").over(line), "second": F.lag("place", 2).over(line), "third": F.lead("place", 2).over(line)})
    # In a bucket of two the pair itself is possible or not.
    two = (F.col("before").isNull() & F.col("third").isNull()) | (F.col("after").isNull() & F.col("second").isNull())
    meets = lambda y: F.coalesce(F.when(two, _possible(F.col("place"), F.col(y), percent)).otherwise(_near(F.col("place"), F.col(y), percent)), F.lit(False))
    salt = F.shiftright("rest", 40)
    kept = held.where((salt > 0) | meets("before") | meets("after"))
    # ``rest`` compares by share and s2 within a bucket.
    led = kept.withColumn("l", F.min(F.struct("rest", "s1", "place")).over(W.partitionBy("bucket")))
    s2 = lambda rest: F.when((low := rest.bitwiseAND(F.lit(0xFFFFFFFF))) >= 2**31, low - 2**32).otherwise(low).cast("int")
    return led.select(
        F.col("bucket").bitwiseXOR(salt * SALT).alias("token"), (salt > 0).alias("split"), "s1", s2(F.col("rest")).alias("s2"), "place",
        F.col("l.s1").alias("l_s1"), s2(F.col("l.rest")).alias("l_s2"), F.col("l.place").alias("l_place"),
    )


def first_index(docs: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], heavy: int = HEAVY) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The written index under the first order, and the frequency table, which then holds every n-gram of a heavy bucket."""
    while True:
        index = written(_index(prefixes(docs, n, percent, frequent, 0), percent), "ngram-index-0")
        big = index.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy)
        rows = big.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
        token, count = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy().astype(np.int64)
        new = ~np.isin(token, frequent[0])
        if not new.any() or len(frequent[0]) >= 2 * FREQUENT:
            return index, frequent
        discard(index)
        token, count = np.concatenate([frequent[0], token[new]]), np.concatenate([frequent[1], count[new]])
        order = np.argsort(token)
        frequent = token[order], count[order]


def indexed(docs: DataFrame, by_class: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], heavy: int = HEAVY) -> DataFrame:
    """Written ord and index columns of the classes that have a possible partner under every order.

    Classes that dropped out under a later order are found by a Bloom filter, so that no index is shuffled for it; those
    that it lets through are harmless.
    """
    index, frequent = first_index(docs, n, percent, frequent, heavy)
    found, partnered = [index], Bloom(classes_of(index), "s1", "s2")
    for order in range(1, ORDERS):
        left = classes_of(found[-1])
        ids = written(by_class.join(left, ["s1", "s2"], "left_semi").select("rep"), "partnered-ids")
        index = written(_index(prefixes(docs, n, percent, frequent, order, Bloom(ids, "rep")), percent), f"ngram-index-{order}")
        discard(ids, left)
        found.append(index)
    filters = [partnered, *[Bloom(classes_of(index), "s1", "s2") for index in found[1:]]]
    whole = None
    for order, part in enumerate(found):
        for other, partnered in enumerate(filters):
            if other != order:
                part = part.where(partnered.may_hold(F.col("s1"), F.col("s2")))
        part = part.select(F.lit(order).alias("ord"), "*")
        whole = part if whole is None else whole.unionByName(part)
    out = written(whole, "ngram-index")
    discard(*found)
    return out


def classes_of(index: DataFrame) -> DataFrame:
    return written(index.select("s1", "s2").distinct(), "partnered")


def _under_all_orders(pairs: DataFrame) -> DataFrame:
    """(ord, a1, a2, b1, b2) rows to the distinct pairs that every order has."""
    bits = pairs.groupBy("a1", "a2", "b1", "b2").agg(F.bit_or(F.expr("shiftleft(1, ord)")).alias("bits"))
    return bits.where(F.col("bits") == (1 << ORDERS) - 1).drop("bits")


def _ordered(x: tuple[Column, Column], y: tuple[Column, Column]) -> list[Column]:
    """The pair with its smaller class first, as a1, a2, b1, b2."""
    low, high = F.struct(x[0].alias("p"), x[1].alias("q")), F.struct(y[0].alias("p"), y[1].alias("q"))
    first, second = F.least(low, high), F.greatest(low, high)
    return [first["p"].alias("a1"), first["q"].alias("a2"), second["p"].alias("b1"), second["q"].alias("b2")]


def _made(docs: DataFrame, wanted: DataFrame, by_class: DataFrame, n: int, name: str, kind: str, value: Callable[[np.ndarray], object]) -> DataFrame:
    """Written s1, s2, value of the wanted classes (a written table), from the text of one document of each.

    Repeated ids and the filter bring a few other classes, or one twice; the joins that follow drop them.
    """
    ids = written(by_class.join(wanted, ["s1", "s2"], "left_semi").select("rep"), "candidate-ids")
    bloom = Bloom(ids, "rep")
    discard(ids)
    type_ = pa.binary() if kind == "binary" else pa.list_(pa.int64())
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int32()), (name, type_)])

    def batch(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()), pa.array(list(held.values()), type_)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            held, rows = {}, 0
            for grams in ngram_sets(_wanted(b, bloom), n):
                if len(grams) and (key := digest(grams)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    held[key] = value(grams)
                    rows += len(grams)
                    if rows >= ROWS:
                        yield batch(held)
                        held, rows = {}, 0
            if held:
                yield batch(held)

    # Few rows come from many tasks: dealt by class they are written as few files.
    return written(_texts(docs).mapInArrow(read, f"s1 long, s2 int, {name} {kind}").repartition("s1", "s2"), f"candidate-{name}")


def bitmap(grams: np.ndarray) -> bytes:
    """The set's size, and a bit for each n-gram's place among eight times as many, rounded up to a power of two."""
    bits = 1 << max(6, (8 * len(grams) - 1).bit_length())
    held = np.zeros(bits, np.uint8)
    held[(grams & np.uint64(bits - 1)).astype(np.int64)] = 1
    return len(grams).to_bytes(8, "little") + np.packbits(held).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of the n-grams that sets of these bitmaps share: a bit of one alone stands for an n-gram of it alone."""
    sizes = [int.from_bytes(x[:8], "little") for x in (a, b)]
    x, y = (np.frombuffer(v, np.uint8, offset=8) for v in (a, b))
    n = min(len(x), len(y))  # places are the low bits of a hash, so a longer bitmap folds onto a shorter one
    x, y = (np.bitwise_or.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return min(sizes[0] - int(np.bitwise_count(x & ~y).sum()), sizes[1] - int(np.bitwise_count(y & ~x).sum()))


def _candidates(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a1").alias("s1"), F.col("a2").alias("s2")).union(pairs.select("b1", "b2")).distinct(), "candidate-classes")


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    left = table.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col(value).alias("a"))
    right = table.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col(value).alias("b"))
    return pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"])


def _linked(pairs: DataFrame, docs: DataFrame, by_class: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs (a1, a2, b1, b2; a written table) whose sets reach the Jaccard index, and s1, s2, sets of their classes; written.

    Bitmaps rule out the pairs that can't link, so that few whole sets are shuffled.
    """
    if pairs.isEmpty():
        return pairs, None
    names = ["a1", "a2", "b1", "b2"]

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            shared = most_shared(x, y)
            return 100 * shared >= percent * (int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little") - shared)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    wanted = _candidates(pairs)
    bitmaps = _made(docs, wanted, by_class, n, "bitmaps", "binary", bitmap)
    left = written(_with_both(pairs, bitmaps, "bitmaps").where(may("a", "b")).select(*names).distinct(), "bounded-pairs")
    discard(wanted, bitmaps)
    if left.isEmpty():
        return left, None
    wanted = _candidates(left)
    sets = _made(docs, wanted, by_class, n, "sets", "array<bigint>", lambda g: g.astype(np.int64))
    shared = F.size(F.array_intersect("a", "b"))
    links = _with_both(left, sets, "sets").where(100 * shared >= percent * (F.size("a") + F.size("b") - shared))
    out = written(links.select(*names).distinct(), "links")
    discard(wanted, left)
    return out, sets


def components(links: DataFrame) -> DataFrame:
    """s1, s2, c1, c2 for every class in a link: its component's smallest class, by repeated contraction.

    Each round takes every class to the smallest label that it or a neighbour has, and whole labels to the smallest
    that any of their classes has met; labels and links are written tables, and rounds end when no label changes.
    Minima are pre-aggregated, and joins are left on the side of many rows and unique on the other, so that adaptive
    execution can split a class with many neighbours or a label of many classes.
    """
    if links.isEmpty():
        return links.select(F.col("a1").alias("s1"), F.col("a2").alias("s2"), F.col("b1").alias("c1"), F.col("b2").alias("c2"))
    struct = lambda a, b: F.struct(F.col(a).alias("p"), F.col(b).alias("q"))
    both = links.select(struct("a1", "a2").alias("u"), struct("b1", "b2").alias("v"))
    edges = written(both.union(both.select("v", "u")).distinct(), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    while True:
        met = edges.join(labels.select(F.col("u").alias("v"), "c"), "v").select("u", "c").union(labels)
        # The smallest label met, and the own one, which is the label of the row that came from ``labels``.
        near = written(met.groupBy("u").agg(F.min("c").alias("n")).join(labels, "u"), "labels-met")
        # Where labels go: only those that have met a smaller one. A label that goes to a label goes on with it.
        goes = written(near.where("n < c").groupBy("c").agg(F.min("n").alias("to")), "labels-moved")
        if goes.isEmpty():
            discard(edges, near, goes)
            return labels.select(F.col("u.p").alias("s1"), F.col("u.q").alias("s2"), F.col("c.p").alias("c1"), F.col("c.q").alias("c2"))
        onward = goes.select(F.col("c").alias("to"), F.col("to").alias("then"))
        goes2 = written(goes.join(onward, "to", "left").select("c", F.coalesce("then", "to").alias("to")), "labels-moved")
        step = written(labels.join(goes2, "c", "left").select("u", F.coalesce("to", "c").alias("c")), "labels")
        discard(near, goes, goes2, labels)
        labels = step


def _labelled(index: DataFrame, group: DataFrame) -> DataFrame:
    """The index with the component (c1, c2) of each class. Only classes that may be in a link are shuffled."""
    own = {"c1": F.col("s1"), "c2": F.col("s2")}
    may = index.withColumn("_may", Bloom(group, "s1", "s2").may_hold(F.col("s1"), F.col("s2")))
    near = may.where("_may").join(group, ["s1", "s2"], "left").withColumns({c: F.coalesce(c, v) for c, v in own.items()})
    return may.where("NOT _may").withColumns(own).drop("_may").unionByName(near.drop("_may"))


def _open(at: DataFrame, large: bool) -> DataFrame:
    """The rows of buckets that hold several components.

    A bucket that isn't split holds at most ``HEAVY`` classes, or few, so one task takes it whole; in large ones the
    least and the greatest component are pre-aggregated, and the join can be split.
    """
    c = F.struct("c1", "c2")
    if large:
        several = at.groupBy("ord", "token").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo != hi").select("ord", "token")
        return at.join(several, ["ord", "token"], "left_semi")
    whole = W.partitionBy("ord", "token")
    return at.withColumn("lo", F.min(c).over(whole)).withColumn("hi", F.max(c).over(whole)).where("lo != hi").drop("lo", "hi")


def _apart(held: DataFrame, percent: int) -> DataFrame:
    """(ord, a1, a2, b1, b2): the possible pairs of one bucket that are in different components."""
    x = held.select("ord", "token", *[F.col(k).alias(f"x_{k}") for k in ("s1", "s2", "place", "c1", "c2")])
    y = held.select("ord", "token", *[F.col(k).alias(f"y_{k}") for k in ("s1", "s2", "place", "c1", "c2")])
    apart = F.expr("struct(x_s1, x_s2) < struct(y_s1, y_s2) AND (x_c1 != y_c1 OR x_c2 != y_c2)") & _possible(F.col("x_place"), F.col("y_place"), percent)
    met = x.join(y, (x["ord"] == y["ord"]) & (x["token"] == y["token"]) & apart)
    return met.select(x["ord"], F.col("x_s1").alias("a1"), F.col("x_s2").alias("a2"), F.col("y_s1").alias("b1"), F.col("y_s2").alias("b2"))


def links_of(sets: list[np.ndarray], copies: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set, how many others it links with, and the sum of their ``copies``; pairs are those of a low and a high set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, place, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    again = found > 1
    held = again[place]
    owner, place = owner[held], (np.cumsum(again) - 1)[place[held]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    x, y = np.flatnonzero(low), np.flatnonzero(high)
    shared = np.zeros((len(x), len(y)), np.int64)
    width, used = max(1, CELLS // len(sets)), int(again.sum())
    for at in range(0, used, width):
        a, b = np.searchsorted(place, [at, at + width])
        matrix = np.zeros((len(sets), min(width, used - at)), np.float32)
        matrix[owner[a:b], place[a:b] - at] = 1
        shared += (matrix[x] @ matrix[y].T).astype(np.int64)
    linked = (100 * shared >= percent * (sizes[x][:, None] + sizes[y] - shared)) & (x[:, None] != y)
    count, others = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    count[x], others[x] = linked.sum(axis=1), linked @ copies[y]
    only = high & ~low  # in one block with itself both sides are the same sets
    count[only], others[only] = linked.sum(axis=0)[only[y]], (linked.T @ copies[x])[only[y]]
    return count, others


def _blocked(members: DataFrame, percent: int) -> DataFrame:
    """(s1, s2, copies, c1, c2, low, high, side): the pairs of blocks (low, high) of its component that each class is compared in.

    side: 0 for a class of the low block, 1 of the high one, 2 of both. Blocks are bands of sizes, of which only a band
    and the next can hold links, dealt further by hash.
    """

    def blocks() -> Column:
        return F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(BLOCK_SETS)), F.sum("size") / F.lit(float(BLOCK_GRAMS)))).cast("int")

    whole = members.groupBy("c1", "c2").agg(blocks().alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = written(members.join(whole, ["c1", "c2"]), "component-members")
    small = held.where("blocks = 1").select("s1", "s2", "copies", "c1", "c2", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(2).alias("side"))
    # Slightly wide, so that rounding never puts sets that can link two bands apart.
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(max(math.log(100 / percent), 1e-6) * (1 + 1e-6))).cast("int")
    large = held.where("blocks > 1").drop("blocks").withColumn("band", band)
    bands = written(large.groupBy("c1", "c2", "band").agg(blocks().alias("blocks")), "component-bands")
    own = large.join(bands, ["c1", "c2", "band"]).withColumn("block", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")).drop("blocks")
    near = own.withColumn("off", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    other = bands.select("c1", "c2", F.col("band").alias("other"), "blocks")
    met = near.withColumn("other", F.col("band") + F.col("off")).join(other, ["c1", "c2", "other"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = lambda b, k: F.shiftleft(F.col(b).cast("long"), 32) + F.col(k)
    x, y = place("band", "block"), place("other", "j")
    side = F.when(x < y, 0).when(x > y, 1).otherwise(2)
    return small.union(met.select("s1", "s2", "copies", "c1", "c2", F.least(x, y).alias("low"), F.greatest(x, y).alias("high"), side.alias("side")))


def counted_links(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written s1, s2, class_links, other_docs of every class that links with others. For named (written) and sets see ``grouped``."""
    cells = written(_blocked(named.select("s1", "s2", "size", "copies", "c1", "c2"), percent), "component-blocks")
    keys, names = ["c1", "c2", "low", "high"], ["s1", "s2", "copies", "side", "sets"]
    rows = cells.join(sets, ["s1", "s2"]).select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys)
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int32()), ("class_links", pa.int64()), ("other_docs", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, out = None, {}, []

        def close() -> None:
            # A class of several rows (its set was made by several tasks, or in both rounds) is held once.
            if len(held) > 1:
                copies, side, values = zip(*held.values())
                side = np.array(side)
                count, others = links_of(list(values), np.array(copies, np.int64), side != 1, side != 0, percent)
                out.extend((*k, c, o) for k, c, o in zip(held, count.tolist(), others.tolist()) if c)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [c.to_pylist() for c in part.columns[:-1]]
                ends, grams = part.column(8).offsets.to_pylist(), part.column(8).values.to_numpy()
                for c1, c2, low, high, s1, s2, copies, side, a, b in zip(*columns, ends, ends[1:]):
                    if cell != (c1, c2, low, high):
                        close()
                        cell = c1, c2, low, high
                    held[s1, s2] = copies, side, grams[a:b].copy()
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = rows.mapInArrow(read, "s1 long, s2 int, class_links long, other_docs long")
    table = written(found.groupBy("s1", "s2").agg(F.sum("class_links").alias("class_links"), F.sum("other_docs").alias("other_docs")), "link-counts")
    discard(cells)
    return table


def grouped(docs: DataFrame, n: int, percent: int, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(doc_id, tag, size, s1, s2) of every row; (s1, s2, rep, size, copies, c1, c2) of every class, (c1, c2) its component.

    The third are written s1, s2, sets rows: the n-grams of every class that links with another, others and repeats.

    Components are exact, though not every link within them is looked at; ``counted_links`` counts all of them.
    """
    found = classes(docs, n)
    by_doc = found.where("token IS NULL").select("doc_id", "tag", "size", "s1", "s2")
    by_class = by_doc.where("size > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    index = indexed(docs, by_class, n, percent, frequent_tokens(found), heavy)

    led = index.where("s1 != l_s1 OR s2 != l_s2").where(_possible(F.col("place"), F.col("l_place"), percent))
    first = led.select("ord", *_ordered((F.col("s1"), F.col("s2")), (F.col("l_s1"), F.col("l_s2"))))
    first = written(_under_all_orders(first), "leader-pairs")
    links, sets = _linked(first, docs, by_class, n, percent)
    group = written(components(links), "groups")

    # What is left: pairs of one bucket in different components, each under every order.
    at = written(_labelled(index.select("ord", "token", "split", "s1", "s2", "place"), group), "labelled-index")
    rest = _apart(_open(at.where("NOT split"), False), percent).union(_apart(written(_open(at.where("split"), True), "open-buckets"), percent))
    rest = written(_under_all_orders(rest).join(first, ["a1", "a2", "b1", "b2"], "left_anti"), "other-pairs")
    more, others = _linked(rest, docs, by_class, n, percent)
    if not more.isEmpty():
        links = written(links.union(more), "all-links")
        group = written(components(links), "groups")
    discard(index, at, first, rest)
    named = by_class.join(group, ["s1", "s2"], "left").withColumn("c1", F.coalesce("c1", "s1")).withColumn("c2", F.coalesce("c2", "s2"))
    return by_doc, named, [t for t in (sets, others) if t is not None]


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id, class_links, class_id and doc_links for each row of docs (doc_id, text)."""
    by_doc, named, sets = grouped(docs, n, percent, heavy)
    named = written(named, "class-components")
    none = named.select("s1", "s2", F.array().cast("array<bigint>").alias("sets")).where("false")
    counts = counted_links(named, reduce(DataFrame.union, sets, none), percent)
    discard(*sets)
    # A table of its own, so that the join with a component of many classes can be split.
    smallest = written(named.groupBy("c1", "c2").agg(F.min("rep").alias("component_id")), "component-ids")
    others = F.coalesce("other_docs", F.lit(0)) + F.col("copies") - 1
    table = written(named.join(smallest, ["c1", "c2"]).join(counts, ["s1", "s2"], "left").select("s1", "s2", "component_id", "class_links", F.col("rep").alias("class_id"), others.alias("doc_links")), "class-ids")
    out = by_doc.join(table, ["s1", "s2"], "left")
    own = lambda c: F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), own("component_id"), number("class_links"), own("class_id"), number("doc_links"))


def drop_similar(docs: DataFrame, n: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that of the smallest id, null last.

    Rows are told apart by id and text; of rows equal in both, in a component or not, one stays. Rows with an empty
    set stay as they are.
    """
    by_doc, named, sets = grouped(docs, n, percent, heavy)
    discard(*sets)
    rows = by_doc.where("size > 0").join(named.select("s1", "s2", "c1", "c2"), ["s1", "s2"])
    rows = written(rows.select("c1", "c2", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag").alias("row")), "component-rows")
    # A table of its own, so that the join with a component of many rows can be split.
    kept = written(rows.groupBy("c1", "c2").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "kept-rows")
    marked = rows.join(kept, ["c1", "c2"]).groupBy(F.col("row.doc_id").alias("_id"), F.col("row.tag").alias("_tag")).agg(F.max(F.col("row") == F.col("kept")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = written(marked.where("NOT stays OR n > 1"), "similar-rows")
    discard(rows, kept)
    if marked.isEmpty():
        return docs
    out = without_keys(docs, marked.select("_id", "_tag"), "text")
    repeated = marked.where("stays").select("_id", "_tag")
    if repeated.isEmpty():
        return out
    once = with_keys(docs, repeated, "text").groupBy("_id", "_tag").agg(F.first("_row").alias("_row"))
    return out.union(once.select("_row.*"))
