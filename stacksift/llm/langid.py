"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word backs off to its character n-grams,
from the longest down: the longest length at which any n-gram of the word is known scores it, by the mean log
frequency of its known n-grams. A text's language is the one with the largest sum over its words.

The classifier is fitted on a bounded sample: at most `max_rows` labelled rows (those with the smallest hash of
doc_id and text), whatever the input's size; word and n-gram tables keep the `max_words` and `max_grams` most
frequent entries, so what is sent to executors is bounded by those parameters times the number of languages.
Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any learned language every
text is `und`; ties between languages go to the smaller name; repeated rows get equal answers; a null doc_id
counts as the text '' in the folds; columns of the same names as ours in the input are replaced in the output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, fold_of

LETTER = re.compile(r"[^\W\d_]")
SIZES = (4, 3, 2, 1)
PART = 1 << 22


@dataclass
class LanguageModel:
    """Log frequencies: a row of a matrix for each known word or n-gram, a column for each language."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logp: np.ndarray
    grams: list[dict[str, int]]
    gram_logp: list[np.ndarray]

    def of_unseen(self, words: list[str]) -> np.ndarray:
        """A row for each word, from the longest n-grams of which the model knows any."""
        out = np.zeros((len(words), len(self.langs)))
        rest = [(k, f"^{w}$") for k, w in enumerate(words)]
        for n, known, logp in zip(SIZES, self.grams, self.gram_logp, strict=True):
            at, sizes, rows, later = [], [], [], []
            get = known.get
            for k, w in rest:
                got = [r for i in range(len(w) - n + 1) if (r := get(w[i : i + n])) is not None]
                if got:
                    at.append(k)
                    sizes.append(len(got))
                    rows += got
                else:
                    later.append((k, w))
            if at:
                size = np.asarray(sizes)
                out[at] = np.add.reduceat(logp[rows], np.cumsum(size) - size, axis=0) / size[:, None]
            rest = later
        return out

    def predict(self, texts: pd.Series) -> tuple[list[str], list[float]]:
        """Languages and scores; texts are taken in parts of PART characters, but for one longer text."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, scores, part, held = [], [], [], 0
        for text in texts:
            size = len(text) if text is not None else 0
            if part and held + size > PART:
                for out, got in zip((langs, scores), self._predict(part), strict=True):
                    out += got
                part, held = [], 0
            part.append(text)
            held += size
        for out, got in zip((langs, scores), self._predict(part), strict=True):
            out += got
        return langs, scores

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Unseen words are looked up once for each part."""
        if not texts:
            return [], []
        known, seen = self.words, {}
        base = len(known)
        rows, counts, blank = [], [], []
        for text in texts:
            if text is None or not LETTER.search(text):
                blank.append(True)
                counts.append(0)
                continue
            blank.append(False)
            words = WORD.findall(text.lower())
            at = [known.get(w, -1) for w in words]
            if -1 in at:
                for i, w in enumerate(words):
                    if at[i] < 0:
                        at[i] = seen.setdefault(w, base + len(seen))
            rows += at
            counts.append(len(at))
        table = np.vstack([self.word_logp, self.of_unseen(list(seen))])
        total = np.tile(self.prior, (len(counts), 1))
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            # the sums of a document are taken in its own order, so equal texts get equal scores
            total[full] += np.add.reduceat(table[np.asarray(rows)], starts, axis=0)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return (
            ["und" if b else self.langs[i] for b, i in zip(blank, best, strict=True)],
            [0.0 if b else float(p[k, i]) for k, (b, i) in enumerate(zip(blank, best, strict=True))],
        )


def fit(docs: DataFrame, max_rows: int = 4_000, max_words: int = 100_000, max_grams: int = 60_000) -> LanguageModel:
    """Learn from the rows of docs that have a text and a lang; counting runs on the executors."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    n = rows.count()
    if n > max_rows:
        # hashes are even over 64 bits: this threshold leaves about the bound
        edge = int(-(2**63) + 2**64 * min(1.0, max_rows / n))
        rows = rows.filter(F.col("h") < edge)
    words = rows.select("lang", F.explode(F.split(F.lower("text"), f"[{SPACE}]+")).alias("w")).filter("w <> ''")
    counts = words.groupBy("w", "lang").agg(F.count("*").alias("c")).cache()
    try:
        per_lang = {r["lang"]: r["c"] for r in counts.groupBy("lang").agg(F.sum("c").alias("c")).collect()}
        langs = sorted(per_lang)
        if not langs:
            return LanguageModel([], np.zeros(0), {}, np.zeros((0, 0)), [{} for _ in SIZES], [np.zeros((0, 0)) for _ in SIZES])

        def matrix(by: DataFrame, most: int) -> tuple[dict[str, int], np.ndarray]:
            wide = by.groupBy("w").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
            got = wide.filter(F.col("n") > 1).orderBy(F.desc("n"), "w").limit(most).collect()
            c = np.zeros((len(got), len(langs)))
            for i, r in enumerate(got):
                for lang, k in r["by"].items():
                    c[i, langs.index(lang)] = k
            total = c.sum(axis=0)
            return {r["w"]: i for i, r in enumerate(got)}, np.log((c + 0.1) / (total + 0.1 * (len(got) + 1)))

        known, logp = matrix(counts, max_words)
        grams = []
        padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
        for n in SIZES:
            parts = counts.select("lang", "c", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, n))).alias("w"))
            grams.append(matrix(parts.filter(F.length("w") == n).groupBy("w", "lang").agg(F.sum("c").alias("c")), max_grams))
        seen = sum(per_lang.values())
        return LanguageModel(langs, np.log([per_lang[x] / seen for x in langs]), known, logp, [g[0] for g in grams], [g[1] for g in grams])
    finally:
        counts.unpersist()


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score; columns of those names in docs are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        lang, score = sent.value.predict(text)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    base = docs.drop("lang_pred", "score", "_language")
    out = base.withColumn("_language", run("text"))
    return out.select(*base.columns, "_language.lang_pred", "_language.score")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(fold_of("doc_id", 4) != 2)


def detect(docs: DataFrame, max_rows: int = 4_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, with a model fitted on its training folds."""
    model = fit(training_rows(docs), max_rows)
    return predict(docs.select("doc_id", "text", (fold_of("doc_id", 4) == 2).alias("held_out")), model).drop("text")


def known_language(docs: DataFrame, min_score: float = 0.5, max_rows: int = 4_000) -> DataFrame:
    """The rows of docs whose language is recognised with at least min_score, with the columns of docs."""
    model = fit(training_rows(docs), max_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        lang, score = sent.value.predict(text)
        return pd.Series([x != "und" and s >= min_score for x, s in zip(lang, score, strict=True)], dtype=bool)

    return docs.filter(keep("text"))
