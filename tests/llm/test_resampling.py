"""The byte automaton against zlib on plain features, and the draw against a plain one."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from melisma.llm import resampling

SCHEMA = "doc_id long, text string, part string, before string, rank string, fit string, weight string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text, buckets=10_000):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def generated(seed, n):
    rnd = random.Random(seed)
    words = ["a", "Bb", "c3", "9", "é", "漢字", "Ünï", "long" * 30, "x_y", "it's", "\x7f", "_", "😀"]
    joints = [" ", "  ", "\n", "-", ". ", "\x00"]
    return ["".join(rnd.choice(words) + rnd.choice(joints) for _ in range(rnd.randrange(60))) for _ in range(n)]


EDGES = [None, "", " ", "_", "a", "a b", "A-b c", "z" * 100_000, "漢" * 30_000 + " b c d", "one two three " * 4000, " " * 50_000 + "x", "x" + " -" * 5000 + "y"]


@pytest.mark.parametrize("size", [1 << 18, 2000, 40, 1])
def test_features_equal_zlib(size):
    texts = generated(size, 150 if size > 1 else 5) + (EDGES if size > 40 else EDGES[:7])
    got, words = [[] for _ in texts], [0] * len(texts)
    for lo, _, owner, bucket, word in resampling.features(pa.array(texts, pa.string()), size=size):
        for o, b in zip(owner.tolist(), bucket.tolist()):
            got[lo + o].append(b)
        for o in word.tolist():
            words[lo + o] += 1
    assert [sorted(x) for x in got] == [sorted(buckets_of(t)) for t in texts]
    assert words == [len(words_of(t)) for t in texts]


def plain(rows, target, percent=5, least=20):
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000))))
    out = []
    for doc_id, text in rows:
        found = buckets_of(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i for i, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


def got_rows(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_draw_equals_plain(spark):
    texts = generated(5, 300)
    rows = list(enumerate(texts)) + [(5, None), (None, texts[0]), (None, None), (-3, ""), (10**15, EDGES[8])]
    rows += [(i, t) for i, t in rows[:40]]  # repeated rows
    target = generated(6, 20) + [None, ""]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    got = got_rows(resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=20))
    assert got == plain(rows, target, percent=20)
    assert sum(r[4] is not None for r in got) > 20


def test_empty_sides(spark):
    docs, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(docs, target).isEmpty()
    rows = [(i, t) for i, t in enumerate(generated(8, 30))]
    some = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    assert got_rows(resampling.resample(some, target, 50)) == plain(rows, [], 50)


def test_counts_are_summed_over_tasks(spark):
    texts = generated(11, 100)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    expected = np.bincount([b for t in texts for b in buckets_of(t)], minlength=10_000)
    assert (resampling.bucket_counts(rows) == expected).all()
