"""The join's later steps: each is shown to run, and gives what brute force gives; components on both ways."""

import itertools

import numpy as np
import pytest

from stacksift.llm import graph, jaccard

from test_llm import components


def plain_roots(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + i, 501 + i) for i in range(12)] + [(900, 900 + i) for i in range(1, 30)] + [(7, 7), (1, 2), (2, 1)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_roots([e for e in edges if e[0] != e[1]])
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_smallest_sizes(spark):
    """All texts of 1 to 8 words that begin or end alike: sets of 1 to 4 elements."""
    words = "a b c d e f g h".split()
    texts = {" ".join(words[i:j]) for i, j in itertools.combinations(range(9), 2)} | {" ".join(words[:k] + ["x"]) for k in range(8)}
    table = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table).collect()}
    assert got == components(table.collect())


def grouped(spark):
    """Two groups of near copies that no key of which stays cold, a chain between them, and texts with a shared passage."""
    rng = np.random.default_rng(9)
    out = []
    for g in range(2):
        body = [f"g{g}w{i}" for i in range(70)]
        for i in range(70):
            w = list(body)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(70))] = f"x{int(rng.integers(4))}"
            out.append(" ".join(w))
    a, b = [f"g0w{i}" for i in range(70)], [f"g1w{i}" for i in range(70)]
    out += [" ".join(a[:70 - k] + b[:k]) for k in range(0, 70, 4)]
    out += [" ".join(a[:30] + [f"u{i}_{k}" for k in range(20)]) for i in range(40)]
    return spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")


@pytest.mark.parametrize("turns, hot", [(4, 3), (0, 3), (0, 1)])
def test_later_steps(spark, monkeypatch, turns, hot):
    """With turns, stars settle most sets; without, all short ones go through deletions and first elements."""
    ran = []

    def spy(name):
        real = getattr(jaccard, name)

        def call(*args):
            ran.append(name)
            return real(*args)

        monkeypatch.setattr(jaccard, name, call)

    for name in ("_stars", "_unsettled", "_mixed", "_meeting"):
        spy(name)
    monkeypatch.setattr(jaccard, "TURNS", turns)
    monkeypatch.setattr(jaccard, "FEW_PAIRS", 0 if turns == 0 else 8)
    table = grouped(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table, hot).collect()}
    assert got == components(table.collect())
    assert "_unsettled" in ran and ("_stars" in ran) == (turns > 0) and (turns > 0 or "_mixed" in ran)


def test_bits():
    places = np.array([0, 5, 8, 1000, 1023])
    b = jaccard.Bits(10, places)
    assert (np.flatnonzero(b[np.arange(1024)]) == places).all()
