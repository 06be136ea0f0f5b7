import random
import zlib

import numpy as np

from weft.llm import quality


def corpus(n):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    good = lambda: " ".join(word() + r.choice(["", "", ".", ","]) for _ in range(r.randint(60, 200)))
    bad = lambda: " ".join(word() + r.choice(["%%%", "$$$", "###"]) for _ in range(r.randint(60, 200)))
    return [(i, good() if i % 4 else bad(), 1 if i % 4 else 0) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus(400)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1 for x in got.values())


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    turned = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    a, b = (quality.train(docs, spark.createDataFrame(l, "doc_id long, quality int")) for l in ([(r[0], r[2]) for r in rows], turned))
    assert np.array_equal(a.means, b.means) and np.array_equal(a.factors, b.factors)


def test_odd_rows(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (900, ""), (900, ""), (901, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (900, 0), (900, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 64 and all(0 <= x.score <= 1 for x in out)
    none = quality.train(docs, labels.filter("false"))
    assert none is None and {x.score for x in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs, labels)).collect() == []


def test_keep_good(spark):
    rows = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    kept = quality.keep_good(docs, quality.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")))
    assert kept.columns == docs.columns
    assert np.mean([r["score"] for r in kept.collect()]) > 0.98


def test_gathered_rows_are_bounded(spark, monkeypatch):
    rows = corpus(100)
    docs = spark.createDataFrame([(r[0] % 7, f"{r[1]} {i}") for i in range(6) for r in rows], "doc_id long, text string")
    labels, held = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int"), []
    monkeypatch.setattr(quality, "fit", lambda x, y: held.append(len(x)))
    quality.train(docs, labels, 5)
    quality.train(docs, labels, 60)
    assert held == [5, 60]


def test_scores_against_the_densities(spark):
    """The score by determinants and inverses of the covariances, without factors."""
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 300)
    x = r.normal(size=(300, quality.FEATURES)) * 1.5 + y[:, None] * 0.4
    x[:, 1] = np.log1p(r.integers(0, 300, 300))
    model = quality.fit(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = ((y == 0).sum() * own[0] + (y == 1).sum() * own[1]) / 300
    logs = []
    for k in (0, 1):
        n = (y == k).sum()
        w = quality.POOLED + (1 - quality.POOLED) * quality.FEATURES / (quality.FEATURES + n)
        c = (1 - w) * own[k] + w * pooled
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        d = z - z[y == k].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    words = np.expm1(x[:, 1])
    odds = np.log((y == 1).sum() / (y == 0).sum()) + (logs[1] - logs[0]) * quality.TEMPER * words / (words + quality.SHORT)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
