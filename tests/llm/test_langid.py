"""Language identification against a plain version that counts words and n-grams with dictionaries."""

import collections
import math
import re
import zlib

from pyspark.sql import functions as F

from stacksift.llm import langid

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\W\d_]")


def held(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 4 == 2


def plain_predictions(rows):
    """{(doc_id, text): (language, score)}, learned from the rows outside the held-out fold."""
    count = collections.defaultdict(collections.Counter)
    for r in rows:
        if not held(r["doc_id"]) and r["text"] is not None and r["lang"] is not None:
            for w in WORD.findall(r["text"].lower()):
                count[w][r["lang"]] += 1
    size = collections.Counter()
    for c in count.values():
        size.update(c)
    langs = sorted(size)

    def table(by):
        kept = {w: c for w, c in by.items() if sum(c.values()) > 1}
        total = {x: sum(c[x] for c in kept.values()) for x in langs}
        return {w: [math.log((c[x] + 0.1) / (total[x] + 0.1 * (len(kept) + 1))) for x in langs] for w, c in kept.items()}

    words, grams = table(count), []
    for n in (4, 3, 2, 1):
        by = collections.defaultdict(collections.Counter)
        for w, c in count.items():
            p = f"^{w}$"
            for i in range(len(p) - n + 1):
                by[p[i : i + n]].update(c)
        grams.append((n, table(by)))

    def of(w):
        if w in words:
            return words[w]
        for n, known in grams:
            got = [known[g] for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in known]
            if got:
                return [sum(x) / len(got) for x in zip(*got, strict=True)]
        return [0.0] * len(langs)

    out = {}
    for r in rows:
        if r["text"] is None or not LETTER.search(r["text"]):
            out[r["doc_id"], r["text"]] = ("und", 0.0)
            continue
        total = [math.log(size[x] / sum(size.values())) for x in langs]
        for w in WORD.findall(r["text"].lower()):
            total = [a + b for a, b in zip(total, of(w), strict=True)]
        e = [math.exp(x - max(total)) for x in total]
        best = max(range(len(langs)), key=lambda i: (e[i], -i))
        out[r["doc_id"], r["text"]] = (langs[best], e[best] / sum(e))
    return out


def test_predictions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(7001, "mixed blank words", None), (7002, "xyzzy qwerty", "en"), (7003, "12 34 !!", "fr"), (7004, "", "fr"), (7005, None, None), (None, "der die das", "de"), (7006, "a " * 30_000, "en"), (7006, "a " * 30_000, "en")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    rows = docs.collect()
    want = plain_predictions(rows)
    text = {r["doc_id"]: r["text"] for r in rows}
    got = langid.detect(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[r["doc_id"], text[r["doc_id"]]]
        assert (r["lang_pred"], r["held_out"]) == (lang, held(r["doc_id"])) and abs(r["score"] - score) < 1e-6


def test_parts_of_a_batch(spark, monkeypatch):
    """The same answers when a batch is taken in small parts; inputs that the contract bars aren't read."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    texts = [r["text"] for r in docs.select("text").collect()]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "PART", 3_000)
    assert model.predict(texts) == whole
    a, b = ({r["doc_id"]: r["lang_pred"] for r in langid.predict(d, model).select("doc_id", "lang_pred").collect()} for d in (docs, docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))))
    assert a == b
