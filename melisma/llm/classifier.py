"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle; each step fits a shallow tree to one feature's binned gradients and adds it
to that feature's lookup table, so that no feature hides another. Then the pairs of features that still explain most are
chosen and boosted in the same way on two-way tables. A text's score is the logistic of an intercept and one addition
for each feature and pair: bins are found by ``searchsorted`` and tables are read for whole batches (``Model.scores``).

Statistics come from the text alone (``statistics``), as arrays over the bytes of whole record batches. Learning takes
at most ``MAX_ROWS`` labelled rows, those of the least hash of their id, so the same rows whatever the partitions are;
they and the tables (some 50 KB) are all that the driver sees. Scoring is one pass without a shuffle.

Defined results: a null text is empty; every text has a score between 0 and 1, the empty one too; an id with several
labels takes the least one; null labels and null ids aren't learned from (a null id hashes as the empty text, so it is
held out); repeated rows have equal scores; without labels every score is 0.5, with labels of one kind their smoothed
share; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.llm.arrays import STEP, blocks, mixed, prefix_sums, runs, spans, text_bytes
from melisma.session import ship_package

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 20_000
FOLDS, THRESHOLD = 5, 0.3
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, RATE, RIDGE, LEAST_LEAF = 80, 0.15, 1.0, 8

NAMES = ("log_words", "word_chars", "upper", "digits", "symbols", "exclamations", "marks", "other", "distinct", "top_word", "repeats", "lines", "short", "long", "unlettered")
_SPACE, _LINE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _EXCLAIM, _MARK, _LEAD, _TAIL = range(10)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[0x0A] = _LINE
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[*b"#*$%&|<>"]] = _SYMBOL
_KIND[ord("!")] = _EXCLAIM
_KIND[0x80:0xC0] = _TAIL
_KIND[0xC0:] = _LEAD


def _in_word(units: np.ndarray) -> np.ndarray:
    return _KIND[units] > _LINE


class _Counts:
    """Sums for the texts of a block; a long text's pieces are added one after the other."""

    def __init__(self, n: int):
        self.kinds = np.zeros((n, 10), np.int64)
        self.words, self.short, self.long, self.unlettered = (np.zeros(n, np.int64) for _ in range(4))
        self.hashes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, units: np.ndarray, offsets: np.ndarray) -> None:
        n, kind = len(self.words), _KIND[units]
        self.kinds += np.bincount(np.repeat(np.arange(n) * 10, np.diff(offsets)) + kind, minlength=n * 10).reshape(n, 10)
        starts, ends = runs(kind > _LINE, offsets)
        owner = np.searchsorted(offsets, starts, "right") - 1
        tails = np.concatenate([[0], np.cumsum(kind == _TAIL)])
        letters = np.concatenate([[0], np.cumsum((kind == _UPPER) | (kind == _LOWER) | (kind == _LEAD))])
        size = ends - starts - (tails[ends] - tails[starts])
        count = lambda some: np.bincount(owner[some], minlength=n)
        self.words += np.bincount(owner, minlength=n)
        self.short += count(size <= 2)
        self.long += count(size >= 12)
        self.unlettered += count(letters[ends] == letters[starts])
        self.hashes.append(spans(prefix_sums(units.astype(np.uint64) + np.uint64(1)), starts, ends))
        self.owners.append(owner)

    def _repeats(self, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: distinct keys, the most frequent one's count, keys that occur more than once."""
        n = len(self.words)
        _, at, times = np.unique(mixed(keys + owner.astype(np.uint64) * np.uint64(STEP)), return_index=True, return_counts=True)
        who, most = owner[at], np.zeros(n, np.int64)
        np.maximum.at(most, who, times)
        return np.bincount(who, minlength=n), most, np.bincount(who, weights=np.where(times > 1, times, 0), minlength=n)

    def statistics(self) -> np.ndarray:
        k, hashes, owner = self.kinds, np.concatenate(self.hashes), np.concatenate(self.owners)
        words = np.maximum(self.words, 1)
        chars = np.maximum(k[:, _UPPER:_TAIL].sum(1), 1)
        letters = np.maximum(k[:, _UPPER] + k[:, _LOWER] + k[:, _LEAD], 1)
        distinct, most, _ = self._repeats(hashes, owner)
        three = mixed(mixed(hashes[:-2] * np.uint64(STEP) + hashes[1:-1]) * np.uint64(STEP) + hashes[2:]) if len(hashes) > 2 else hashes[:0]
        same = owner[2:] == owner[:-2] if len(hashes) > 2 else np.zeros(0, bool)
        _, _, repeated = self._repeats(three[same], owner[:-2][same] if len(hashes) > 2 else owner[:0])
        columns = (
            np.log2(1 + self.words), chars / words, k[:, _UPPER] / letters, k[:, _DIGIT] / chars, k[:, _SYMBOL] / words, k[:, _EXCLAIM] / words, k[:, _MARK] / words, k[:, _LEAD] / letters,
            distinct / words, most / words, repeated / np.maximum(self.words - 2, 1), k[:, _LINE] / words, self.short / words, self.long / words, self.unlettered / words,
        )
        return np.stack(columns, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    units, offsets = text_bytes(texts)
    out = np.zeros((len(texts), len(NAMES)))
    for lo, hi, pieces in blocks(units, offsets, _in_word):
        counts = _Counts(hi - lo)
        for piece in pieces:
            counts.add(*piece)
        out[lo:hi] = counts.statistics()
    return out


@dataclass
class Model:
    """Lookup tables. ``edges``: of each feature's bins; ``pairs``: (first, second, their edges, table)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins of about equal counts, half way between neighbouring values."""
    known, times = np.unique(values, return_counts=True)
    share = np.cumsum(times)[:-1] / len(values)
    cut = np.unique(np.minimum(np.searchsorted(share, np.arange(1, bins) / bins), max(len(share) - 1, 0))) if len(share) else np.zeros(0, int)
    return (known[cut] + known[cut + 1]) / 2 if len(cut) else np.zeros(0)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Gain and place of the best cut of the bins lo ... hi - 1."""
    if hi - lo < 2:
        return 0.0, lo
    gs, hs, ns = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(n[lo:hi])
    left, right = gs[:-1] ** 2 / (hs[:-1] + RIDGE), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE)
    gain = left + right - gs[-1] ** 2 / (hs[-1] + RIDGE)
    gain[(ns[:-1] < LEAST_LEAF) | (ns[-1] - ns[:-1] < LEAST_LEAF)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), lo + at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves over bins, as one value for each bin."""
    leaves = [(0, len(g))]
    for _ in range(2):
        cuts = []
        for lo, hi in leaves:
            gain, at = _cut(g, h, n, lo, hi)
            cuts += [(lo, at), (at, hi)] if gain > 0 else [(lo, hi)]
        leaves = cuts
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = RATE * g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut on each side of a two-way table: its gain, and a value for each cell."""
    corner = lambda x: np.cumsum(np.cumsum(x, 0), 1)
    sums = []
    for x in (g, h, n):
        c = corner(x)
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        sums.append((a, b, d, c[-1, -1] - a - b - d))
    if not sums[0][0].size:
        return 0.0, np.zeros(g.shape)
    gain = sum(q**2 / (p + RIDGE) for q, p in zip(sums[0], sums[1]))
    gain[np.minimum.reduce(sums[2]) < LEAST_LEAF] = 0
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[at] <= 0:
        return 0.0, np.zeros(g.shape)
    values = [RATE * q[at] / (p[at] + RIDGE) for q, p in zip(sums[0], sums[1])]
    up, left = np.arange(g.shape[0])[:, None] <= at[0], np.arange(g.shape[1])[None, :] <= at[1]
    return float(gain[at]), np.where(up, np.where(left, values[0], values[1]), np.where(left, values[2], values[3]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Statistics and labels 0 or 1; a pure function of the rows in their order."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))))
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), [_edges(v, BINS) for v in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, v, "right") for e, v in zip(model.edges, x.T)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[j])
            step = _tree(np.bincount(b, g, size), np.bincount(b, h, size), np.bincount(b, minlength=size))
            model.tables[j] += step
            total += step[b]
    coarse = [_edges(v, PAIR_BINS) for v in x.T]
    cells = [np.searchsorted(e, v, "right") for e, v in zip(coarse, x.T)]

    def table(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shape, (g, h) = (len(coarse[i]) + 1, len(coarse[j]) + 1), slopes()
        at = cells[i] * shape[1] + cells[j]
        return at, *(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(len(y))))

    gains = [(-_quarters(*table(i, j)[1:])[0], i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in sorted(gains)[:PAIRS] if gain < 0]
    for _ in range(ROUNDS // 2):
        for i, j, _, _, values in model.pairs:
            at, *sums = table(i, j)
            step = _quarters(*sums)[1]
            values += step
            total += step.ravel()[at]
    return model


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), *[pa.array(v) for v in x.T]], ["h", "label", *NAMES])

    measured = rows.select("h", "label", "text").mapInArrow(measure, "h long, label int, " + ", ".join(f"{n} double" for n in NAMES))
    found = measured.orderBy("h", *NAMES).limit(max_rows).toArrow()
    return fit(np.stack([found.column(n).to_numpy() for n in NAMES], 1) if found.num_rows else np.zeros((0, len(NAMES))), found.column("label").to_numpy().astype(float))


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    ship_package(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(statistics(batch.column(2))))], ["doc_id", "held_out", "score"])

    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (fold(F.col(f"`{doc_id}`")) == 0).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    return plain.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
