"""Phrase mining against a plain count, with blocks and heavy prefixes so small that every path is taken."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.llm import phrases

SCHEMA = "doc_id long, text string, lang string, suffix string, n string, split string, rank string"


def brute(rows, sizes=(2, 3), min_count=10, percent=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, sizes[1] + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    n = {k: v for k, v in n.items() if v}
    candidates = {k: a for k, a in f.items() if a >= min_count and len(k[1]) >= sizes[0]}
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if any(m == lang and len(w) > len(words) and inside(w) and 100 * b >= percent * a for (m, w), b in candidates.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def generated(seed, docs=60):
    rnd = random.Random(seed)
    words = ["the", "The", "a", "ab", "a-b", "a\x01", "\x00", "é", "x" * 40, "漢字", "b", "c#"]
    joints = [" ", "  ", "\t", ". ", ",", "\n", " \x0b", "!?"]
    text = lambda: "".join(rnd.choice(words) + rnd.choices(joints, [20, 3, 2, 2, 1, 1, 1, 1])[0] for _ in range(rnd.randrange(120)))
    return [(i, text(), rnd.choice(["en", "en", "fr", "f r", None])) for i in range(docs)]


@pytest.mark.parametrize("seed,block", [(1, 1 << 21), (2, 300), (3, 20)])
def test_equals_plain_counts(spark, seed, block):
    rows = generated(seed) + [(1, None, "en"), (2, "", None), (3, " \t", "de"), (3, "word", "de")]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    plain = brute([r[1:] for r in rows])
    assert len(plain) > 20
    assert rows_of(phrases.collocations(docs, block=block)) == plain
    # All words and pairs split, and none: the same rows.
    for heavy in ([np.zeros(0, np.uint64)] * 2, everything(docs)):
        assert rows_of(phrases.collocations(docs, heavy=heavy, block=block)) == plain


def everything(docs):
    rows = phrases.suffixes(docs, F.col("text"), F.col("lang"), 3, None).collect()
    return [np.array(sorted({r[k] for r in rows}), np.int64).view(np.uint64) for k in range(2)]


def test_sizes_thresholds_and_top(spark):
    rows = generated(9, 40)
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    plain = brute([r[1:] for r in rows], (2, 4), 5, 80, 7)
    assert rows_of(phrases.collocations(docs, sizes=(2, 4), min_count=5, covered_percent=80, top=7)) == plain


def test_counts_join_over_batches(spark):
    rows = generated(4, 30)
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(phrases.collocations(docs)) == brute([r[1:] for r in rows])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_group_and_long_texts(spark):
    hot = " ".join(f"hot pair w{i % 997}" for i in range(30000))
    rows = [(hot, "en"), ("z" * 1_000_000, "en"), ("漢" * 400_000 + " end", None), ("one two " * 50_000, "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(phrases.collocations(docs, block=1 << 16)) == brute(rows)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "x", "x", "x", "x")], SCHEMA)).isEmpty()
