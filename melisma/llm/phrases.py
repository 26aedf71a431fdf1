"""Phrase collocations: suffixes sorted in reverse order, all prefixes counted with one stack, parts joined afterwards.

Texts are lower-cased (A-Z), split at punctuation into pieces and those into words. Every word starts a suffix of its
piece, cut to ``max_n`` words; tasks count equal suffixes of a block of text before anything is shuffled. Suffixes
are dealt by language and first word and sorted downwards, so that all suffixes with a common prefix follow each
other: a stack of one open prefix for each length, carried from batch to batch, counts every prefix of 1 to ``max_n``
words in one pass (``_count_prefixes``). Spark's sort spills; no group is held in memory.

A first word, or longer prefix, with many different suffixes would be one task. Prefixes that hold over 1 / ``HEAVY``
of the suffixes of a bounded sample are dealt by one word more; their own counts are then partial and are summed
once more. The sample decides only where rows go: counts are exact whatever it says.

Counts below ``min_count`` leave with the pass (the parts of a frequent phrase are as frequent), so candidates, the
joins of their parts and the containment rule see frequent phrases only.

Defined results: a null text is empty; a null language is ``und``; repeated rows count again; control characters
other than separators are parts of words; texts of any length are read in blocks of about ``BLOCK`` bytes that
overlap by ``max_n`` - 1 words; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.llm.arrays import STEP, mixed, prefix_sums, runs, spans, text_bytes
from melisma.session import ship_package, written

BLOCK = 1 << 21
#: Documents whose suffixes are sampled to find heavy prefixes, and the share of suffixes that makes a prefix heavy.
SAMPLE_DOCS = 2000
HEAVY = 256
#: A first pass over salted parts keeps the best of each, so that no language is ranked in one task as a whole.
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
WORD, SPACE, BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that stand side by side in ``data``, by where each one ends."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _suffixes(units: np.ndarray, offsets: np.ndarray, codes: np.ndarray, seeds: np.ndarray, max_n: int, final: bool) -> tuple[tuple | None, int]:
    """The suffix at every word as ``w1 w2 w3`` (each word and a space), its language's code, and hashes of its prefixes
    of 1 ... max_n words with its language's seed; and where to go on.

    If the text goes on behind the units (not ``final``), its last ``max_n`` - 1 words and a word that may be cut are
    left for the next block, which begins at the returned unit; 0 if the units hold too few words to go on.
    """
    kind = _KIND[units]
    inside = kind == WORD
    starts, ends = runs(inside, offsets)
    n = len(starts)
    left = n if final else max(0, n - max_n)
    if not left:
        return None, len(units) if final else 0
    owner = np.searchsorted(offsets, starts, "right")
    pieces = np.cumsum(kind == BREAK, dtype=np.int64)[starts] + owner
    lower = _LOWER[units]
    words = _strings(lower[inside], np.cumsum(ends - starts))
    hashes = spans(prefix_sums(lower.astype(np.uint64) + np.uint64(1)), starts, ends)
    code = codes[owner[:left] - 1]
    prefix = [mixed(hashes[:left] + seeds[code] * np.uint64(STEP))]
    parts, follows = [words.slice(0, left)], np.ones(left, bool)
    for k in range(1, max_n):
        at = np.minimum(np.arange(left) + k, n - 1)
        follows = follows & (pieces[at] == pieces[:left]) & (np.arange(left) + k < n)
        parts.append(pc.take(words, pa.array(at, mask=~follows)))
        prefix.append(np.where(follows, mixed(prefix[-1] * np.uint64(STEP) + hashes[at]), prefix[-1]))
    joined = pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()), null_handling="skip")
    return (joined, code, prefix), len(units) if final else int(starts[left])


def _counted(joined: pa.Array, code: np.ndarray, prefix: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """Equal suffixes as one row with a count. Only suffixes of equal keys are compared, as strings.

    Rows of one first word stand together, which compresses them: the key is half of that word's hash and half of the whole one's.
    """
    key = (prefix[0] & np.uint64(0xFFFFFFFF00000000)) | (prefix[-1] >> np.uint64(32))
    order = np.argsort(key)
    whole = key[order]
    twin = np.zeros(len(whole), bool)
    twin[1:] = whole[1:] == whole[:-1]
    twin[:-1] |= twin[1:].copy()
    alone, shared = order[~twin], order[twin]
    if not len(shared):
        return joined, code, prefix, np.ones(len(code), np.int64)
    groups = pa.table({"s": joined.take(pa.array(shared)), "c": code[shared], "at": shared}).group_by(["c", "s"]).aggregate([("at", "min"), ("at", "count")])
    rows = np.concatenate([alone, groups["at_min"].to_numpy()])
    n = np.concatenate([np.ones(len(alone), np.int64), groups["at_count"].to_numpy()])
    return joined.take(pa.array(rows)), code[rows], [p[rows] for p in prefix], n


def _blocks(units: np.ndarray, offsets: np.ndarray, codes: np.ndarray, seeds: np.ndarray, max_n: int, size: int) -> Iterator[tuple]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        lo, hi, step = int(offsets[at]), int(offsets[end]), size
        if hi - lo <= size:
            rows, _ = _suffixes(units[lo:hi], offsets[at : end + 1] - lo, codes[at:end], seeds, max_n, True)
            if rows is not None:
                yield rows
        while hi - lo > size or end == at + 1 and lo > offsets[at] and lo < hi:  # a longer text alone
            cut = min(lo + step, hi)
            rows, to = _suffixes(units[lo:cut], np.array([0, cut - lo]), codes[at:end], seeds, max_n, cut == hi)
            if not to:
                step *= 2
                continue
            lo, step = lo + to, size
            if rows is not None:
                yield rows
        at = end


def suffixes(docs: DataFrame, text: Column, lang: Column, max_n: int, heavy: list[np.ndarray] | None, block: int = BLOCK) -> DataFrame:
    """lang, suffix (words, a space behind each), n, split: the suffixes of blocks of text with their counts.

    ``split`` tells how many of the suffix's prefixes, from one word on, are ``heavy`` (hashes for each length).
    Without ``heavy`` the rows are p1, p2 ...: the hashes of each suffix's prefixes, the whole one left out.
    """
    ship_package(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, offsets = text_bytes(batch.column("text"))
            langs = batch.column("lang").cast(pa.string()).dictionary_encode()
            seeds = np.array([zlib.crc32(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64)
            codes = langs.indices.to_numpy()
            for rows in _blocks(units, offsets, codes, seeds, max_n, block):
                joined, code, prefix, n = _counted(*rows)
                if heavy is None:
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)) for p in prefix[:-1]], [f"p{k}" for k in range(1, max_n)])
                    continue
                split, still = np.zeros(len(n), np.int32), np.ones(len(n), bool)
                for p, h in zip(prefix, heavy):
                    still &= np.isin(p, h)
                    split += still
                table = pa.table({"lang": pc.take(langs.dictionary, pa.array(code)), "suffix": joined.cast(pa.string()), "n": n, "split": split})
                yield from table.to_batches(max_chunksize=1 << 16)

    plain = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), text.cast("string").alias("text"))
    return plain.mapInArrow(read, "lang string, suffix string, n long, split int" if heavy is not None else ", ".join(f"p{k} long" for k in range(1, max_n)))


def heavy_prefixes(docs: DataFrame, text: Column, lang: Column, max_n: int) -> list[np.ndarray]:
    """For 1 ... max_n - 1 words, hashes of at most ``HEAVY`` prefixes with a large share of a sample's suffixes."""
    total = docs.count()
    some = docs.sample(SAMPLE_DOCS / total, 7) if total > SAMPLE_DOCS else docs
    rows = written(suffixes(some, text, lang, max_n, None), "suffix-sample")
    least = rows.count() / HEAVY
    found = lambda k: rows.groupBy(f"p{k}").count().where(F.col("count") > least).select(f"p{k}")
    return [np.array(sorted(r[0] for r in found(k).collect()), np.int64).view(np.uint64) for k in range(1, max_n)]


def _common(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each string but the first, how many bytes it shares with the one before from the start."""
    size = np.minimum(offsets[2:] - offsets[1:-1], offsets[1:-1] - offsets[:-2])
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    differ = data[np.repeat(offsets[1:-1], size) + place] != data[np.repeat(offsets[:-2], size) + place]
    place[~differ] = np.iinfo(np.int64).max
    shared = size.copy()
    some = np.flatnonzero(size)
    if len(some):
        shared[some] = np.minimum(size[some], np.minimum.reduceat(place, at[some]))
    return shared


def _count_prefixes(max_n: int, min_count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted downwards by (lang, suffix): lang, k, phrase, f of prefixes.

    Prefixes whose count is whole leave if it reaches ``min_count``, partial ones (k <= split) always. k = 0: all words.
    """

    def out(lang: list, k: int, phrase: list, f: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([k] * len(f), pa.int32()), pa.array(phrase, pa.string()), pa.array(f, pa.int64())], ["lang", "k", "phrase", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list | None] = [None] * (max_n + 1)  # for each length the open [lang, prefix, split, count]
        totals: dict[str, int] = {}
        before: tuple[str, bytes] = ("", b"")

        def closed(entries: list[list], k: int) -> pa.RecordBatch | None:
            kept = [e for e in entries if e[3] >= min_count or e[2] >= k]
            return out([e[0] for e in kept], k, [e[1][:-1].decode() for e in kept], [e[3] for e in kept]) if kept else None

        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang").cast(pa.string()).dictionary_encode()
            codes, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            n, split = batch.column("n").to_numpy(), batch.column("split").to_numpy()
            for c, name in enumerate(names):
                totals[name] = totals.get(name, 0) + int(n[codes == c].sum())
            # The last row before stands in front of the batch, without a count, to be compared with the first one.
            own, _ = text_bytes(batch.column("suffix"))
            sizes = pc.binary_length(batch.column("suffix")).to_numpy().astype(np.int64)
            data = np.concatenate([np.frombuffer(before[1], np.uint8), own])
            offsets = np.concatenate([[0, len(before[1])], len(before[1]) + np.cumsum(sizes)]).astype(np.int64)
            same = np.concatenate([[names[codes[0]] == before[0]], codes[1:] == codes[:-1]])
            shared = np.where(same, _common(data, offsets), 0)
            begins = offsets[1:-1]
            spaces = np.flatnonzero(data == 0x20)
            first = np.searchsorted(spaces, begins)
            words = np.searchsorted(spaces, offsets[2:]) - first
            raw = data.tobytes()
            for k in range(1, max_n + 1):
                has = words >= k
                ends = spaces[np.minimum(first + k - 1, len(spaces) - 1)] + 1  # behind the k-th word's space
                opens = has & (shared < ends - begins)
                at = np.flatnonzero(opens)
                counted = np.where(has, n, 0)
                lead = int(counted[: at[0]].sum()) if len(at) else int(counted.sum())
                if stack[k]:
                    stack[k][3] += lead
                if len(at):
                    sums = np.add.reduceat(counted, at)
                    keep = (sums >= min_count) | (split[at] >= k)
                    keep[-1] = False
                    done = [stack[k]] if stack[k] else []
                    stack[k] = [names[codes[at[-1]]], raw[begins[at[-1]] : ends[at[-1]]], int(split[at[-1]]), int(sums[-1])]
                    rows = at[keep]
                    done += [[names[c], raw[b:e], s, f] for c, b, e, s, f in zip(codes[rows].tolist(), begins[rows].tolist(), ends[rows].tolist(), split[rows].tolist(), sums[keep].tolist())]
                    if (found := closed(done, k)) is not None:
                        yield found
            before = (names[codes[-1]], raw[int(offsets[-2]) :])
        for k in range(1, max_n + 1):
            if stack[k] and (found := closed([stack[k]], k)) is not None:
                yield found
        if totals:
            yield out(list(totals), 0, [""] * len(totals), list(totals.values()))

    return count


def phrase_counts(docs: DataFrame, text: Column, lang: Column, max_n: int = 3, min_count: int = 10, heavy: list[np.ndarray] | None = None, block: int = BLOCK) -> DataFrame:
    """lang, k, phrase, f: all phrases of 1 ... max_n words that occur ``min_count`` times or more; k = 0 counts a language's words."""
    heavy = heavy_prefixes(docs, text, lang, max_n) if heavy is None else heavy
    prefix = F.expr("substring_index(suffix, ' ', split + 1)")  # what rows are dealt by: a heavy prefix is dealt by one word more
    dealt = suffixes(docs, text, lang, max_n, heavy, block).repartition(F.xxhash64("lang", prefix))
    ordered = dealt.sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    counted = ordered.mapInArrow(_count_prefixes(max_n, min_count), "lang string, k int, phrase string, f long")
    whole = counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return whole.where((F.col("k") == 0) | (F.col("f") >= min_count))


def _words(phrase: str, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", sizes: tuple[int, int] = (2, 3), min_count: int = 10, covered_percent: int = 50, top: int = 2000, heavy: list[np.ndarray] | None = None, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A phrase of count a that is cut into two parts of counts l and r scores floor(1000000 * a * a / (l * r)), in exact
    decimals (counts below 10**14); the cut of lowest score counts, ties to the first. A phrase inside a longer
    candidate that has at least ``covered_percent`` of its count is dropped. Ranked by score, a and phrase.
    """
    least, most = sizes
    counts = written(phrase_counts(docs, F.col(f"`{text}`"), F.col(f"`{lang}`"), most, min_count, heavy, block), "phrase-counts")
    candidates = counts.where(F.col("k") >= least).select("lang", "k", "phrase", F.col("f").alias("a"))
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("left", _words("phrase", 1, F.col("cut"))).withColumn("right", _words("phrase", F.col("cut") + 1, F.col("k")))
    part = lambda side, name: counts.where("k > 0").select(F.col("lang"), F.col("phrase").alias(side), F.col("f").alias(name))
    scored = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = lambda c: f"CAST({c} AS DECIMAL(14, 0))"
    score = F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')} div ({exact('l')} * {exact('r')})")
    best = scored.groupBy("lang", "k", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r")).alias("b"))
    best = best.select("lang", "k", "phrase", "b.score", "b.a", "b.l", "b.r")
    inner = F.flatten(F.transform(F.sequence(F.lit(least), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(F.split("phrase", " "), at, size), " "))))
    longer = candidates.where(F.col("k") > least).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
