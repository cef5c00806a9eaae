"""Toxicity: neighbours and scores against a plain version over all terms of all examples, and held-out labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacksift.llm import toxicity
from stacksift.llm.common import fold_of


def labelled(seed, n, words=300):
    """Invented texts of which a third hold one of many insults, each rare."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randint(5, 60))]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), f"bad{rng.randrange(30)}{rng.choice('abc')}")
        out.append((i, int(toxic), toxicity.terms_of(" ".join(w))))
    return out


@pytest.fixture(scope="module")
def data():
    return labelled(1, 500)


def plain_index(examples):
    """The weights of all terms and the unit vectors, term by term."""
    n, n1 = len(examples), sum(t for _, t, _ in examples)
    weight = {}
    for w in {w for _, _, c in examples for w in c}:
        a, df = sum(w in c for _, t, c in examples if t), sum(w in c for _, _, c in examples)
        b = df - a
        z = abs(math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n - n1 + 1))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        weight[w] = (math.log((1 + n) / (1 + df)) + 1) * (1 + 4 * max(0, z - 3))
    return weight, [(i, t, unit(c, weight)) for i, t, c in examples]


def unit(counts, weight):
    v = {w: (1 + math.log(n)) * weight[w] for w, n in counts.items() if w in weight}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / size for w, x in v.items()}


def plain_nearest(q, vectors, k, but=None):
    got = sorted((-round(sum(x * q[w] for w, x in v.items() if w in q), 10), i, t) for i, t, v in vectors if i != but)
    return [(-s, i, t) for s, i, t in got[:k] if s < 0]


def test_nearest_and_scores(data):
    index = toxicity.Index(data)
    weight, vectors = plain_index(data)
    assert len(index.terms) == len(weight) and 0 < index.frequent < len(weight) and index.blocks > 3
    rate = sum(t for _, t, _ in data) / len(data)

    def vote(near):
        w = [s**3 for s, _, _ in near]
        return (sum(x * t for x, (_, _, t) in zip(w, near, strict=True)) + 1e-3 * rate) / (sum(w) + 1e-3)

    for _, _, terms in labelled(2, 60) + data[:40]:
        want = plain_nearest(unit(terms, weight), vectors, 20)
        got = index.nearest(*index.numbers(terms), 20)
        assert [int(index.ids[i]) for _, i in got] == [i for _, i, _ in want]
        assert np.allclose([s for s, _ in got], [s for s, _, _ in want]) and abs(index.vote(got) - vote(want)) < 1e-6
    # the curve: votes of examples without themselves
    votes = np.array([vote(plain_nearest(v, vectors, 20, i)) for i, _, v in vectors])
    y, w = np.array([t for _, t, _ in vectors]), np.zeros(2)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(w[0] * votes + w[1])))
        w = w + 0.05 * np.array([((y - p) * votes).sum() - 0.01 * w[0], (y - p).sum() - 0.001 * w[1]]) / 5
    assert np.allclose(index.curve, w, rtol=0.02)


def test_calibration(data):
    """Of held-out texts with varied insults most are found, and the mean score is near their share."""
    index = toxicity.Index(data)
    held = labelled(3, 300)
    s = np.array([1 / (1 + math.exp(-(index.curve[0] * index.vote(index.nearest(*index.numbers(c), 20)) + index.curve[1]))) for _, _, c in held])
    y = np.array([t for _, t, _ in held])
    assert (s >= 0.3)[y == 1].mean() >= 0.9 and (s >= 0.3)[y == 0].mean() <= 0.1 and abs(s.mean() - y.mean()) < 0.08


def test_held_out(spark):
    """On the larger table: nine in ten toxic labels of the held-out fold, few others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{k}.parquet") for k in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi").filter(fold_of("doc_id", 4) == 2), index).join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in got}
    assert share[1] >= 0.9 and share[0] <= 0.06


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "good words", "x"), (4, "bad idiot", "x"), (4, "bad idiot", "x"), (5, "idiot " * 5000, "x"), (None, "idiot", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 1), (4, 0, 1), (1, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, toxic int, quality int")
    index = toxicity.fit(docs, labels)
    assert index.n <= 2 and set(index.ids.tolist()) <= {3, 4}
    got = toxicity.score(docs, index)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "evidence"] and got.count() == 7 and all(0 <= r["score"] <= 1 for r in got.collect())
    none = toxicity.fit(docs, labels.limit(0))
    assert {(r["score"], r["predicted"], tuple(r["evidence"])) for r in toxicity.score(docs, none).collect()} == {(0.0, 0, ())}
    assert toxicity.score(docs.limit(0), index).count() == 0
