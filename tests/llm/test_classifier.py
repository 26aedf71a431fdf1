"""Statistics against plain ones, scores against plain table look-ups, and accuracy on rows that were held out."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from melisma.llm import classifier, queries
from tests.oracle import SF

SCHEMA = "doc_id long, text string, score string, held_out string, label string, h string"
TEXTS = [None, "", " \n\t", "a", "One two THREE 4 5!", "x " * 40 + "y\nz", "### $$$ word*** A|B", "é漢 Ü😀 a b a b a b a b", "z" * 70_000, "漢" * 30_000 + " a b", "the cat sat on the mat. the cat sat\n" * 3000]


def plain(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    n, kinds = max(len(words), 1), collections.Counter()
    is_letter = lambda c: "a" <= c <= "z" or "A" <= c <= "Z" or ord(c) > 127
    for c in text:
        kinds["upper"] += "A" <= c <= "Z"
        kinds["digit"] += "0" <= c <= "9"
        kinds["symbol"] += c in "#*$%&|<>"
        kinds["exclaim"] += c == "!"
        kinds["other"] += ord(c) > 127
        kinds["letter"] += is_letter(c)
        kinds["line"] += c == "\n"
        kinds["mark"] += not (is_letter(c) or "0" <= c <= "9" or c in "#*$%&|<>! \t\n\x0b\x0c\r")
    chars, letters = max(sum(map(len, words)), 1), max(kinds["letter"], 1)
    seen, three = collections.Counter(words), collections.Counter(zip(words, words[1:], words[2:]))
    return [
        np.log2(1 + len(words)), chars / n, kinds["upper"] / letters, kinds["digit"] / chars, kinds["symbol"] / n, kinds["exclaim"] / n, kinds["mark"] / n, kinds["other"] / letters,
        len(seen) / n, max(seen.values(), default=0) / n, sum(v for v in three.values() if v > 1) / max(len(words) - 2, 1), kinds["line"] / n,
        sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 12 for w in words) / n, sum(not any(map(is_letter, w)) for w in words) / n,
    ]


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_statistics_equal_plain_ones(monkeypatch, block):
    monkeypatch.setattr(classifier.blocks, "__defaults__", (block,))
    assert np.allclose(classifier.statistics(pa.array(TEXTS, pa.string())), [plain(t) for t in TEXTS])


def test_pairs_and_tables_learn():
    rnd = np.random.default_rng(3)
    x = rnd.random((6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction alone
    x[:, 2] = np.where(rnd.random(6000) < 0.8, y, x[:, 2])
    model = classifier.fit(x[:4000], y[:4000])
    assert (1, 0) in [(i, j) for i, j, *_ in model.pairs]
    assert ((model.scores(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.95
    by_hand = []
    for row in x[4000:4100]:
        total = model.intercept + sum(t[sum(row[j] >= e)] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
        total += sum(t[sum(row[i] >= a), sum(row[j] >= b)] for i, j, a, b, t in model.pairs)
        by_hand.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.scores(x[4000:4100]), by_hand)


def test_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op12_quality_classifier(spark, sf).collect()}
    known = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [r for r in known if got[r.doc_id].held_out]
    assert len(held) > 50
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95
    assert np.mean([got[r.doc_id].predicted for r in held if r.quality]) > 0.98
    good = [got[r.doc_id].score for r in held if r.quality]
    assert np.mean([s < g for r in held if not r.quality for s in [got[r.doc_id].score] for g in good]) > 0.98


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality AS label")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - label ELSE label END AS label")
    scores = lambda m: [tuple(r) for r in classifier.classify(docs, m).orderBy("doc_id").collect()]
    assert scores(classifier.train(docs, labels)) == scores(classifier.train(docs.repartition(5), turned.repartition(3)))


def test_edges(spark):
    rows = [(i, t, *"xxxx") for i, t in enumerate(TEXTS)] + [(None, "a null id", *"xxxx"), (3, "a", *"xxxx"), (3, "a", *"xxxx")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(3, 0), (4, None), (None, 1)], "doc_id long, label int")
    got = classifier.classify(docs, classifier.train(docs, labels))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL OR predicted IS NULL").isEmpty()
    assert len({r.score for r in got.where("doc_id = 3").collect()}) == 1
    none = classifier.train(docs, labels.where("false"))
    assert {r.score for r in classifier.classify(docs, none).collect()} == {0.5}
    assert classifier.classify(docs.where("false"), none).isEmpty()
