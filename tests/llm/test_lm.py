"""The language model against a plain version that counts token by token, with dictionaries and loops."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacksift.llm import lm
from stacksift.llm.common import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(words[int(k) % 40] if int(k) % 3 else words[(int(k) + j) % 40] for j, k in enumerate(rng.zipf(1.3, 30)))) for i in range(60)]
    data += [(100, None), (101, ""), (102, "W1 w1 unseen"), (102, "W1 w1 unseen"), (None, "w1 w2"), (103, "once " * 50)]
    return spark.createDataFrame(data, "doc_id long, text string")


def plain_scores(rows, own_words):
    """{(doc_id, text): log10 score}; own_words: how many words have a leaf of their own."""
    texts = [(r["doc_id"], WORD.findall((r["text"] or "").translate(LOWER))) for r in rows]
    learn = [w for k, w in texts if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    count = collections.Counter(w for ws in learn for w in ws)
    number = {w: int(word_hashes([w])[0][0]) for _, ws in texts for w in ws}
    ranked = sorted(count, key=lambda w: (-count[w], number[w]))[:own_words]
    leaf_of = {w: (1 + i) % lm.CLASSES * lm.MEMBERS + (1 + i) // lm.CLASSES for i, w in enumerate(ranked)}

    def leaf(w):
        return 0 if w is None else leaf_of[w] if w in leaf_of else int(lm.shared_leaf(np.array([number[w]], np.uint64))[0])

    in_leaf, kinds = collections.Counter({0: len(learn)}), collections.Counter()
    for w, c in count.items():
        in_leaf[leaf(w)] += c
        kinds[leaf(w)] += 1
    bits = lm.table_bits(sum(in_leaf.values()))
    per = bits - int(math.log2(lm.CLASSES))

    def events(ws):
        """(leaf, rows of the first table, rows of the second) of every token."""
        h = np.array([number[w] for w in ws] + [0], np.uint64)
        f = lm.features(h, np.array([len(h)]))
        for i, w in enumerate([*ws, None]):
            x = leaf(w)
            yield x, [int(g[i]) >> (64 - bits) for g in f], [(x // lm.MEMBERS << per) + (int(g[i]) >> (64 - per)) for g in f]

    n = np.array([in_leaf[i] for i in range(lm.CLASSES * lm.MEMBERS)], float).reshape(lm.CLASSES, lm.MEMBERS) + 0.5
    bias = [math.log(x) for x in n.sum(axis=1) / n.sum()]
    member_bias = [[math.log(x / sum(r)) for x in r] for r in n]
    seen = [collections.defaultdict(lambda: [0.0] * 32) for _ in range(2)]
    for ws in learn:
        for x, one, two in events(ws):
            for table, rows_, at in zip(seen, (one, two), divmod(x, lm.MEMBERS), strict=True):
                for r in rows_:
                    table[r][at] += 1

    def base(k, r):
        return bias if k == 0 else member_bias[r >> per]

    weights = [{}, {}]
    for k, table in enumerate(seen):
        for r, c in table.items():
            total = sum(c)
            weights[k][r] = [0.5 * (math.log((c[j] + 10 * math.exp(base(k, r)[j])) / (total + 10)) - base(k, r)[j]) for j in range(32)]

    def shares(k, rows_, b):
        x = [b[j] + sum(weights[k][r][j] if r in weights[k] else 0.0 for r in rows_) for j in range(32)]
        top = max(x)
        e = [math.exp(v - top) for v in x]
        return [v / sum(e) for v in e]

    expected = [collections.defaultdict(lambda: [0.0] * 32) for _ in range(2)]
    for ws in learn:
        for x, one, two in events(ws):
            for k, rows_, b in ((0, one, bias), (1, two, member_bias[x // lm.MEMBERS])):
                p = [round(v * lm.ONE) / lm.ONE for v in shares(k, rows_, b)]
                for r in rows_:
                    expected[k][r] = [a + v for a, v in zip(expected[k][r], p, strict=True)]
    for k in (0, 1):
        for r, e in expected[k].items():
            weights[k][r] = [w + 0.2 * min(1, max(-1, (s - x) / (x + 2))) for w, s, x in zip(weights[k][r], seen[k][r], e, strict=True)]
    out = {}
    for (_, ws), row in zip(texts, rows, strict=True):
        total = 0.0
        for w, (x, one, two) in zip([*ws, None], events(ws), strict=True):
            total += math.log10(shares(0, one, bias)[x // lm.MEMBERS]) + math.log10(shares(1, two, member_bias[x // lm.MEMBERS])[x % lm.MEMBERS])
            if w is not None and w not in leaf_of:
                total += math.log10((count[w] + 0.5) / (in_leaf[x] + 0.5 * (kinds[x] + 1)))
        out[row["doc_id"], row["text"]] = total
    return out


def test_scores(docs, monkeypatch):
    """The registered model with 20 words that have a leaf of their own; equal rows get equal scores."""
    monkeypatch.setattr(lm, "KNOWN", 20)
    rows = docs.collect()
    want = plain_scores(rows, 20)
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    text = collections.defaultdict(list)
    for r in rows:
        text[r["doc_id"]].append(r["text"])
    for r in got:
        assert abs(r["score"] - want[r["doc_id"], text[r["doc_id"]][0]]) < 2e-3 * max(1, abs(r["score"]))


def test_scores_do_not_depend_on_partitions(docs):
    a, b = (sorted((r["doc_id"] or -1, r["n_tokens"], r["score"], r["base_score"]) for r in lm.score(d).collect()) for d in (docs.repartition(1), docs.repartition(5, F.xxhash64("text"))))
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-9 * abs(x[2]) and abs(x[3] - y[3]) < 1e-9 * abs(x[3]) for x, y in zip(a, b, strict=True))


def test_model_sums_to_one():
    """Over all classes and members, for any history; within a shared leaf over its words and an unseen one."""
    rng = np.random.default_rng(2)
    h = rng.integers(1, 9, 400).astype(np.uint64)
    f, leaf = lm.features(h, np.array([250, 150])), rng.integers(0, lm.CLASSES * lm.MEMBERS, 400)
    tables = np.zeros((lm.CLASSES, 1 << 12)), np.zeros((lm.MEMBERS, 1 << 12))
    lm.observe(f, leaf, 12, *tables)
    model = lm.initial(12, np.bincount(leaf, minlength=lm.CLASSES * lm.MEMBERS), *(t.T for t in tables))
    every = np.arange(lm.CLASSES * lm.MEMBERS)
    for at in (0, 3, 260):
        one = [np.repeat(x[at : at + 1], len(every)) for x in f]
        assert abs(np.exp(model.log_score(one, every)).sum() - 1) < 1e-4
    # context tells the model more than its biases do
    plain = lm.Model(12, np.zeros_like(model.first), np.zeros_like(model.second), model.bias, model.member_bias)
    assert model.log_score(f, leaf).sum() > plain.log_score(f, leaf).sum()


def test_without_training(spark):
    """Only rows of the held-out fold: counts are 0, and a token's base is 0."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(True, 3, 0, 0, 0.0)] and got[0]["score"] < 0


def test_lookup_is_exact():
    h = np.random.default_rng(1).integers(1, 1 << 63, 5000).astype(np.uint64)
    look = lm.Lookup(h[:895], True)
    assert (look(h)[:895] == np.arange(895)).all() and (look(h)[895:] == -1).all()
    assert (lm.Lookup(h[:0], True)(h) == -1).all()


def test_more_updates_learn_more_and_weights_lie_row_by_row(spark, docs, monkeypatch):
    """Columns in a row's place would have every look-up copy its whole table. The query makes ROUNDS updates."""
    texts = [r["text"] for r in docs.filter("doc_id < 60").collect()]
    h, end, n = lm.tokens_of(texts)
    use, c = np.unique(h[~end], return_counts=True)
    leaves = lm.Leaves(use[lm.most_frequent(use, c)])
    leaf = np.where(end, 0, leaves(h)[0])
    of_leaf = np.bincount(leaf, minlength=lm.CLASSES * lm.MEMBERS)
    models = [lm.train(docs.filter("doc_id < 60"), leaves, of_leaf, k) for k in (0, 1, lm.ROUNDS)]
    for m in models:
        assert m.first.flags.c_contiguous and m.second.flags.c_contiguous
    likely = [m.log_score(lm.features(h, n), leaf).sum() for m in models]
    assert lm.ROUNDS > 1 and likely[0] < likely[1] < likely[2]
    asked = []
    monkeypatch.setattr(lm, "train", lambda docs, leaves, of_leaf, rounds: asked.append(rounds) or models[0])
    from stacksift.llm.queries import op10_lm_scores

    op10_lm_scores(spark, "/root/testdata/sf0.001")
    assert asked == [lm.ROUNDS]


def test_shares_that_meet_in_one_row(monkeypatch):
    """All tokens have one history, so a row takes every share; the sums are whole and exact, and additions serve two."""
    import numpy as np

    n, bits = lm.SUMMED + 5, lm.MIN_BITS
    rng = np.random.default_rng(1)
    model = lm.Model(bits, *rng.normal(size=(2, 1 << bits, 32)).astype(np.float32), np.zeros(32, np.float32), np.zeros((32, 32), np.float32))
    model.first[:, 0] += 9  # nearly all of every share is one class's
    f, leaf = [np.zeros(n, np.uint64)] * 4, np.full(n, 3 * lm.MEMBERS)
    calls = []
    monkeypatch.setattr(lm.np, "bincount", lambda *a, **b: calls.append(a))  # a pass for each class and feature
    tables = [np.zeros((32, 1 << bits)) for _ in range(2)]
    model.expect(f, leaf, *tables)
    assert not calls
    for table, weights, row in ((tables[0], model.first, 0), (tables[1], model.second, 3 << (bits - 5))):
        x = 4 * weights[row].astype(float)
        share = np.rint(lm.ONE * np.exp(x - x.max()) / np.exp(x - x.max()).sum())
        assert np.abs(table[:, row] / n - 4 * share).max() <= 4 and table[:, row].max() > 0
        assert np.count_nonzero(table) == np.count_nonzero(table[:, row]) and (table[:, row] % n == 0).all()


def test_a_slice_is_summed_at_once():
    """Texts of a slice (1 << 20 characters, words of four and a space) add to the tables once; no sum needs 33 bits."""
    assert (1 << 20) // 5 <= lm.SUMMED and 4 * lm.SUMMED * lm.ONE < 1 << 32
