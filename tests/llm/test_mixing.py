"""Budgets and prefixes against a plain recursion with fractions, over trees with ties, nulls and zero weights."""

import collections
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stacksift.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n long"


def plain_fill(given, children):
    """children: {name: (weight, cap)}; what each gets of given."""
    got, todo = {k: Fraction(0) for k in children}, {k for k, (w, _) in children.items() if w > 0}
    while todo:
        left = given - sum(got.values())
        per = left / sum(children[k][0] for k in todo)
        full = {k for k in todo if children[k][1] <= per * children[k][0]}
        if not full:
            return got | {k: per * children[k][0] for k in todo}
        got |= {k: children[k][1] for k in full}
        todo -= full
    return got


def plain_budgets(rows, total, share, epochs, weights):
    """{leaf: budget}; rows: (domain, lang, source, n)."""
    supply = collections.Counter()
    for *leaf, n in rows:
        supply[tuple(leaf)] += n
    weight = lambda path: Fraction(max(0, weights.get(mixing.TREE[len(path) - 1], {}).get(path, 1)))

    def cap(path):
        if len(path) == 3:
            return Fraction(supply[path] * epochs)
        below = {leaf[: len(path) + 1] for leaf in supply if leaf[: len(path)] == path}
        return sum((cap(b) for b in below if weight(b) > 0), Fraction(0))

    out = {}

    def give(path, given):
        if len(path) == 3:
            out[path] = math.floor(given)
            return
        below = {leaf[: len(path) + 1] for leaf in supply if leaf[: len(path)] == path}
        for k, x in plain_fill(given, {b: (weight(b), cap(b)) for b in below}).items():
            give(k, x)

    want = Fraction(total) if total is not None else Fraction(share) * sum(supply.values())
    give((), min(want, cap(())))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets(spark, seed):
    rng = random.Random(seed)
    names = [None, "en", "fr", "de"]
    leaves = [(d, lang, s) for d in ("even", "odd") for lang in rng.sample(names, 3) for s in rng.sample([None, "s0", "s1", "s2", "s3"], 4)]
    rows = [(*leaf, rng.choice([1, 5, 5, 20])) for leaf in leaves for _ in range(rng.choice([1, 2, 4, 4]))]
    weights = {"domain": {("odd",): rng.choice([1, 2])}, "lang": {leaf[:2]: rng.choice([0, 1, 3]) for leaf in leaves[::5]}, "source": {leaf: rng.choice([-1, 0, 1, 1, 4]) for leaf in leaves[::2]}}
    docs = spark.createDataFrame(rows, "domain string, lang string, source string, n_tokens long")
    supply = sum(r[3] for r in rows)
    for total, share, epochs in ((supply // 3, 0.5, 1), (None, 0.5, 2), (10 * supply, 0.5, 2)):
        got = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(docs, total, share, epochs, weights).collect()}
        assert got == plain_budgets(rows, total, share, epochs, weights)


def test_even_sources(spark):
    """Siblings that tie in everything divide the budget evenly, down to the documents taken."""
    docs = spark.createDataFrame([(i, "w " * 10, "en", f"s{2 * (i % 4)}", 1) for i in range(400)], COLUMNS)
    for more in ({"share": 0.5}, {"total": 2000}):
        got = collections.Counter(r["source"] for r in mixing.mix(docs, **more).collect())
        assert got == {f"s{2 * k}": 50 for k in range(4)}


def test_zero_weight_leaves_its_budget_to_others(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i < 100 else "fr", "s0" if i % 2 else "s2", 1) for i in range(200)], COLUMNS)
    got = mixing.mix(docs, total=1000, max_epochs=1, weights={"source": {("even", "en", "s0"): 0.0, ("even", "en", "s2"): 0.0}})
    assert got.count() == 100 and {r["lang"] for r in got.collect()} == {"fr"}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("broadcast", [True, False])
def test_prefix(spark, monkeypatch, broadcast):
    """Each leaf gives the prefix of its last epoch's order that its budget holds, copies counted one by one."""
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 1, 3, 7]), rng.choice(["en", None]), f"s{i % 3}", i) for i in range(120)]
    rows += [(500, "x " * 4, "en", "s0", k % 2) for k in range(30)] + [(None, "null id", "en", "s1", 3), (501, None, "en", "s1", 4)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for total, epochs in ((35, 1), (200, 1), (600, 2), (700, 3)):
        got = mixing.mix(docs, total=total, max_epochs=epochs, seed=3)
        assert got.columns == ["doc_id", "text", "lang", "source", "n", "domain", "n_tokens", "epoch"]
        order = docs.select("*", mixing.default_domain(F.col("source")).alias("domain"), F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))).alias("own"))
        order = order.withColumn("keys", F.array(*(F.xxhash64(F.lit(3), F.lit(e), F.col("own")) for e in range(epochs)))).collect()
        plan = plain_budgets([(r["domain"], r["lang"], r["source"], len((r["text"] or "").split())) for r in order if (r["text"] or "").split()], total, 0.5, epochs, {})
        want = collections.Counter()
        for leaf, budget in plan.items():
            mine = [(r, len((r["text"] or "").split())) for r in order if (r["domain"], r["lang"], r["source"]) == leaf and (r["text"] or "").split()]
            whole, rest = divmod(budget, sum(n for _, n in mine))
            for r, n in mine:
                for e in range(whole):
                    want[r["doc_id"], n, e] += 1
            for r, n in sorted(mine, key=lambda x: x[0]["keys"][whole] % (1 << 64) if whole < epochs else 0):
                if n > rest:
                    break
                want[r["doc_id"], n, whole] += 1
                rest -= n
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["epoch"]) for r in got.collect()) == want


def test_clashing_columns(spark):
    """Columns of any name are kept, those of ours too, and map columns among them."""
    names = ("rest", "whole", "cut_part", "_key", "_part", "_copies", "_mix_n", "_MIX_key", "supply", "budget", "weight", "cap", "given")
    docs = spark.createDataFrame([(i, "a b c", "en", f"s{i % 2}", 1) for i in range(20)], COLUMNS)
    docs = docs.select("*", *(F.lit(f"v{k}").alias(k) for k in names), F.create_map(F.lit("k"), F.lit(1)).alias("m"), F.lit("gone").alias("Domain"))
    got = mixing.mix(docs, share=0.5)
    assert got.columns == [*docs.columns[:-1], "domain", "n_tokens", "epoch"] and got.count() == 10
    assert all(r[k] == f"v{k}" for r in got.collect() for k in names)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "en", "s0", k % 2) for k in range(10)], COLUMNS)
    assert mixing.mix(docs, total=35).count() == 3 and mixing.mix(docs, total=135, max_epochs=2).count() == 13
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, total=0).count() == 0
