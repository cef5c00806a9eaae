"""What the join sends: packed blocks and elements, and pairs of the last step."""

import numpy as np

from stacksift.llm import jaccard


def test_blocks_hold_no_sizes():
    """A key of a set that has no other in its bucket takes 13 bytes; sizes are read from the sets' names."""
    rng = np.random.default_rng(2)
    n = rng.integers(3, 3_000, 500)
    at, h = np.repeat(np.arange(500), n), rng.integers(0, 1 << 48, int(n.sum())).astype(np.uint64)
    fp = jaccard.fingerprints(at, h, n)
    size = (fp & ((1 << jaccard.CLASS_BITS) - 1)).astype(int)
    assert (jaccard.SIZES[size] <= n).all() and (n < jaccard.SIZES[size + 1]).all() and len(set(fp.tolist())) == 500
    packer = jaccard._Packer(1 << 20, 24)
    key, who = rng.integers(0, 1 << 64, 5_000, np.uint64), np.repeat(np.arange(500), 10)
    rows = [r for b in [*packer.add(key, who, fp), *packer.flush()] for r in b.to_pylist()]
    assert sum(len(r["keys"]) + len(r["counts"]) + len(r["fps"]) for r in rows) <= 13 * 5_000
    bucket, low = jaccard._place(key, 1 << 20)
    got = sorted((r["bucket"], k, f) for r in rows for k, f in zip(np.frombuffer(r["keys"], np.uint32).tolist(), np.repeat(np.frombuffer(r["fps"], np.int64), np.frombuffer(r["counts"], np.uint8)).tolist(), strict=True))
    assert got == sorted(zip(bucket.tolist(), low.tolist(), fp[who].tolist(), strict=True))
    x = np.unique(h[:100])
    assert len(jaccard._pack(x)) == 6 * len(x) and (jaccard._unpack(jaccard._pack(x)) == x).all()


def test_pairs_of_a_cell():
    """All pairs of different components that sizes, places and bitmaps allow, and no others, in one part and across two."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 47, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base[:k], int(k * 0.93), replace=False), rng.integers(0, 1 << 47, 5).astype(np.uint64)])) for k in rng.integers(20, 400, 120)]
    n, bits = np.array([len(x) for x in sets]), [jaccard._bitmap_of(x) for x in sets]
    root, before = rng.integers(0, 60, 120), rng.integers(0, 5, 120)
    for part in (np.zeros(120, int), rng.integers(0, 2, 120)):
        a, b = jaccard._cell_pairs(np.arange(120), n, before, root, bits, part)
        may = [(i, j) for i in range(120) for j in range(i + 1, 120) if root[i] != root[j] and (part.max() == 0 or part[i] != part[j]) and 7 * min(n[i] - before[i], n[j] - before[j]) >= 3 * (n[i] + n[j])]
        want = [(i, j) for i, j in may if jaccard._may_link(bits[i], bits[j], n[i], n[j])]
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == want and 0 < len(want) < len(may)


def test_cells_give_links_not_pairs():
    """A group whose sets pass each other's bitmaps but aren't linked makes no rows; of linked sets a forest is left."""
    rng = np.random.default_rng(4)
    body = rng.integers(0, 1 << 47, 300).astype(np.uint64)
    # two sets of 300 differ in about 107 elements, but are linked with 85 at most
    apart = [np.unique(np.concatenate([body[rng.permutation(300)[:272]], rng.integers(0, 1 << 47, 28).astype(np.uint64)])) for _ in range(60)]
    near = [np.unique(np.concatenate([body, rng.integers(0, 1 << 47, 20).astype(np.uint64)])) for _ in range(40)]
    for sets, links in ((apart, 0), (near, 39)):
        fp, zero, n = np.arange(len(sets)) + 7, np.zeros(len(sets), np.int64), np.array([len(x) for x in sets])
        assert len(jaccard._cell_pairs(fp, n, zero, fp, [jaccard._bitmap_of(x) for x in sets], zero)[0]) > 500
        for part, across in ((zero, False), (np.arange(len(sets)) // 16, False), (np.arange(len(sets)) % 2, True)):
            got = jaccard._cell_links(fp, zero, fp, sets, part, across)
            assert got.num_rows == links
            assert all(jaccard._linked(sets[a - 7], sets[b - 7]) for a, b in zip(*(got.column(k).to_pylist() for k in range(2)), strict=True))


def test_candidates_share_enough_keys(spark):
    """Of pairs that share keys those stay that share as many as their sizes ask for; all linked ones do."""
    rng = np.random.default_rng(5)
    body = [rng.integers(0, 1 << 48, 400).astype(np.uint64) for _ in range(2)]
    sets = []
    for k in range(80):
        own = rng.integers(0, 1 << 48, 400).astype(np.uint64)
        share = int(rng.integers(1, 60)) if k % 2 else int(rng.integers(200, 400))
        n = int(rng.integers(share, 400))
        sets.append(np.unique(np.concatenate([body[k % 2][:share], own[: n - share]])))
    n = np.array([len(x) for x in sets])
    at, h = np.repeat(np.arange(80), n), np.concatenate(sets)
    key, who, _, _ = jaccard.keys(at, h, n, False)
    where = {}
    for k, w in zip(key.tolist(), who.tolist(), strict=True):
        where.setdefault(k, set()).add(w)
    met = [(a, b, 1) for w in where.values() for a in w for b in w if a < b]
    cold = [np.where(takes, np.bincount(jaccard.keys(at, h, n, False, (step,))[1], minlength=80), -1) for step, takes, _ in jaccard._layouts(n)]
    rows = list(zip(range(80), n.tolist(), (np.searchsorted(jaccard.BANDS, n, "right") - 1).tolist(), *(c.tolist() for c in cold), strict=True))
    got = jaccard._enough(spark.createDataFrame(met, "a long, b long, many long"), spark.createDataFrame(rows, "fp long, n long, band int, cold0 int, cold1 int"))
    got = {(r["a"], r["b"]) for r in got.collect()}
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if jaccard._linked(sets[a], sets[b])}
    assert want and want <= got and len(got) < len({(a, b) for a, b, _ in met}) // 2
