"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are all words (runs of word characters in lower case) of the labelled examples, and each word's first PREFIX
characters after a `^`, so that inflections that no example has still meet. A term weighs (1 + ln tf) * idf *
emphasis, with idf = ln((1 + n) / (1 + df)) + 1; the emphasis is 1, and 1 + EMPHASIS * (z - SURE) for terms whose log
odds between toxic and other examples are z > SURE standard errors from 0 (to either side). Vectors have unit length;
every term counts. Copies of one text count as one example.

Examples that are alike stand in one block. Lists of frequent terms are kept as dense parts of each block with their
maxima, lists of rare ones as postings. A query sums its rare terms' postings, adds the maxima of its frequent ones,
and visits blocks from the largest bound down until none can hold one of the k nearest; what is near the k-th is
summed again in double precision, so nothing is lost by blocks that are passed over.

The vote is the share of toxic ones among the k nearest, weighted by similarity ** POWER (near examples count more),
with a little of the base rate. Votes of the examples themselves, each left out of its own, fit the logistic curve
that turns a vote into the probability that is returned. Evidence is the doc_ids of the nearest examples.

The examples are a bounded sample: at most about `max_rows` labelled documents, those with the smallest hashes of
doc_id; model and index are bounded by their texts. Every whole text is scored.

Defined cases: null and empty texts have no terms, so the vote is the base rate; rows that repeat a doc_id in labels
count as toxic if any does; labels without a document, text or value are ignored; without any example the score is 0;
ties in similarity go to the smaller doc_id; columns named score, predicted or evidence in the input are not carried.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

TERM = re.compile(r"\w+")
PREFIX = 4
BLOCK = 128
#: A term in more than one of so many examples is kept as dense parts.
FREQUENT = 24
EMPHASIS, SURE = 4.0, 3.0
POWER, K = 3, 20
PRIOR = 1e-3


def terms_of(text: str | None) -> dict[str, int]:
    """The terms of a text with their counts."""
    words = Counter(TERM.findall(text.lower())) if text else {}
    starts: dict[str, int] = {}
    get = starts.get
    for word, n in words.items():
        word = "^" + word[:PREFIX]
        starts[word] = get(word, 0) + n
    return words | starts


def emphasis(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """What terms weigh more that a of n1 toxic and b of n0 other examples have."""
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return 1 + EMPHASIS * np.maximum(0, z - SURE)


class Index:
    """Built from (doc_id, toxic, terms with counts) of examples; terms are numbered with the frequent ones first."""

    def __init__(self, examples: list[tuple[int, int, dict[str, int]]]):
        examples = sorted((x for x in examples), key=lambda x: x[0])
        df, toxic_df = Counter(), Counter()
        for _, toxic, terms in examples:
            df.update(terms.keys())
            if toxic:
                toxic_df.update(terms.keys())
        n, n1 = len(examples), sum(toxic for _, toxic, _ in examples)
        self.rate, self.curve = n1 / n if n else 0.0, (0.0, 0.0)
        names = sorted(df, key=lambda w: (-df[w], w))
        self.terms = {w: i for i, w in enumerate(names)}
        count, a = np.array([df[w] for w in names], float), np.array([toxic_df[w] for w in names], float)
        self.weight = (np.log((1 + n) / (1 + count)) + 1) * emphasis(a, count - a, n1, n - n1)
        self.frequent = int((count * FREQUENT > n).sum())
        numbers = [self.numbers(terms) for _, _, terms in examples]
        vectors = [self._unit(*x) for x in numbers]
        order = self._grouped(vectors)
        self.n, self.blocks = n, -(-n // BLOCK)
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.toxic = np.array([examples[i][1] for i in order], float)
        vectors = [vectors[i] for i in order]
        # forward lists, by example
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        self.value = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        self.scratch = np.zeros(len(names))
        who = np.repeat(np.arange(n), sizes)
        # dense parts of frequent terms, and their maxima
        self.dense = np.zeros((self.blocks, self.frequent, BLOCK), np.float32)
        often = self.term < self.frequent
        self.dense[who[often] // BLOCK, self.term[often], who[often] % BLOCK] = self.value[often]
        self.most = self.dense.max(axis=2).T.astype(float) if n else np.zeros((0, 0))
        # postings of rare ones
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.post_who, self.post_value = who[rare], self.value[rare]
        self.post_begin = np.searchsorted(self.term[rare], np.arange(self.frequent, len(names) + 1))
        self._fit_curve([numbers[i] for i in order])

    def numbers(self, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of known terms and their counts."""
        get = self.terms.get
        at = np.fromiter((get(w, -1) for w in terms), np.int64, len(terms))
        n = np.fromiter(terms.values(), np.int64, len(terms))
        use = np.flatnonzero(at >= 0)
        use = use[np.argsort(at[use])]
        return at[use], n[use]

    def _unit(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[term]
        return term, w / np.sqrt((w * w).sum()) if len(w) else w

    def _grouped(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
        """The examples' order: each beside the seed that it is nearest to; a seed is what is farthest from those before."""
        n = len(vectors)
        if n <= BLOCK:
            return list(range(n))
        term = np.concatenate([t for t, _ in vectors])
        value = np.concatenate([w for _, w in vectors])
        who = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        near, of, seed = np.full(n, -1.0), np.zeros(n, np.int64), 0
        for k in range(-(-n // BLOCK)):
            q = np.zeros(len(self.weight))
            q[vectors[seed][0]] = vectors[seed][1]
            s = np.bincount(who, value * q[term], n)
            of[s > near], near = k, np.maximum(near, s)
            seed = int(np.argmin(near))
        return np.lexsort((-near, of)).tolist()

    def nearest(self, term: np.ndarray, n: np.ndarray, k: int, but: int | None = None) -> list[tuple[float, int]]:
        """The k largest (similarity, example) above 0, ties to the smaller doc_id; `but` is left out."""
        if not len(term) or not self.n:
            return []
        term, q = self._unit(term, n)
        cut = int(np.searchsorted(term, self.frequent))
        often, strong = term[:cut], q[:cut]
        begin, end = self.post_begin[term[cut:] - self.frequent], self.post_begin[term[cut:] - self.frequent + 1]
        sizes = end - begin
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        sims = np.zeros(self.blocks * BLOCK)
        sims[: self.n] = np.bincount(self.post_who[at], self.post_value[at] * np.repeat(q[cut:], sizes), self.n)
        by_block = sims.reshape(self.blocks, BLOCK)
        bound = by_block.max(axis=1) + strong @ self.most[often]
        strong = strong.astype(np.float32)
        least, met = 0.0, []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] < least - 1e-4:
                break
            by_block[b] += strong @ self.dense[b].take(often, axis=0)
            if but is not None and b == but // BLOCK:
                by_block[b, but % BLOCK] = -1.0
            met.append(b)
            # the k-th best so far; any k of them would do for a bound
            here = by_block[met].ravel()
            least = max(least, float(np.partition(here, len(here) - k)[len(here) - k])) if len(here) >= k else least
        at = (np.array(met)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        left = at[(sims[at] > 0) & (sims[at] >= least - 2e-4)]
        full = self.scratch
        full[term] = q
        exact = []
        for i in left.tolist():
            part = slice(self.begin[i], self.begin[i + 1])
            exact.append((-round(float(full[self.term[part]] @ self.value[part]), 12), int(self.ids[i]), i))
        full[term] = 0.0
        return [(-s, i) for s, _, i in sorted(exact)[:k] if s < 0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = np.array([s for s, _ in near]) ** POWER
        return (float(w @ self.toxic[[i for _, i in near]]) if near else 0.0) / (w.sum() + PRIOR) + PRIOR * self.rate / (w.sum() + PRIOR)

    def _fit_curve(self, numbers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Logistic regression of the examples' labels on their votes without themselves, by Newton's steps."""
        if not self.n:
            return
        votes = np.array([self.vote(self.nearest(*x, K, i)) for i, x in enumerate(numbers)])
        x, w, ridge = np.stack([votes, np.ones(self.n)], axis=1), np.zeros(2), np.array([0.01, 0.001])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (self.toxic - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(w[0]), float(w[1]))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        if not self.n:
            return 0.0, []
        near = self.nearest(*self.numbers(terms_of(text)), K)
        return float(1 / (1 + np.exp(-(self.curve[0] * self.vote(near) + self.curve[1])))), [int(self.ids[i]) for _, i in near]


def examples(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text, toxic of the sampled training examples; only the bounded sample of ids is broadcast."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", 4) != 2))
    n = ids.count()
    if n > max_rows:
        ids = ids.filter(F.xxhash64("doc_id") < int(-(2**63) + 2**64 * max_rows / n))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_rows)
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2_000) -> Index:
    """The index of the examples; their terms are counted on the executors and come packed."""

    @F.pandas_udf("binary")
    def counted(text: pd.Series) -> pd.Series:
        return pd.Series([pickle.dumps(terms_of(x), protocol=5) for x in text])

    rows = examples(docs, labels, max_rows).select("doc_id", "toxic", counted("text").alias("v")).collect()
    return Index([(int(r["doc_id"]), int(r["toxic"] > 0), {sys.intern(w): n for w, n in pickle.loads(r["v"]).items()}) for r in rows])


def score(docs: DataFrame, index: Index, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence array<long>")
    def run(text: pd.Series) -> pd.DataFrame:
        known: dict[str | None, tuple[float, list[int]]] = {}
        got = []
        for x in text:  # copies in a batch are looked up once
            if x not in known:
                known[x] = sent.value.score(x)
            got.append(known[x])
        return pd.DataFrame({"score": [s for s, _ in got], "evidence": [e for _, e in got]})

    out = docs.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), run("text").alias("r"))
    return out.select("doc_id", "held_out", "r.score", (F.col("r.score") >= threshold).cast("int").alias("predicted"), "r.evidence")
