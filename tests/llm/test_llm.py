"""Each operator against a plain version on small tables, with the edge cases that its docstring defines."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacksift.llm import jaccard, langid, licenses, lm, mixing, pieces, quality, tokens, topk
from stacksift.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, score double, n long"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table, and the odd ones: null, empty, blank, long, repeated, clashing columns."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60)
    odd = [(9001, None, None, None), (9002, "", "en", "a"), (9003, " \n\t ", "en", "a"), (9004, "one two", None, "a"), (9005, "a b c d e f " * 4000, "en", "b"), (9006, "one two", "en", "a"), (9006, "one two", "en", "a"), (9007, "naïve ▁mark 日本語", "fr", "b")]
    return base.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")).withColumn("score", F.lit(1.0)).withColumn("n", F.lit(1).cast("long")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    got = tokens.token_files(docs, path).orderBy("doc_id", "start").collect()
    start = 0
    for r, g in zip(sorted(rows(docs), key=lambda r: r["doc_id"]), got, strict=True):
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.token_files(empty, path).count() == 0
    samples = [np.arange(i, i + 300, dtype="<u2").tobytes() for i in range(50)]
    block = tokens.pack(samples, 2, b"")
    assert bytes(tokens.Block(block, b"")[7].tobytes()) == samples[7]
    with pytest.raises(ValueError):
        tokens.Block(block, b"other")


def test_language(spark, docs, empty):
    model = langid.fit(docs)
    assert all(len(g) == n for n, grams in zip(langid.SIZES, model.grams, strict=True) for g in grams)
    got = {r["doc_id"]: r for r in langid.detect(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert held and sum(got[k]["lang_pred"] == lang[k] for k in held) >= 0.9 * len(held)
    odd = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [odd[k]["lang_pred"] for k in (9001, 9002, 9003)] == ["und"] * 3 and odd[9001]["score"] == 0
    assert langid.detect(empty).count() == 0 and set(langid.known_language(docs).columns) == set(docs.columns)


def components(data):
    sets = {}
    for r in data:
        w = WORD.findall((r["text"] or "").translate(LOWER))
        sets[r["doc_id"]] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {k: (len(sets[k]), root[k]) for k in sets}


def near_copies(spark):
    """A group of near copies, and texts that share a long passage, so that keys get hot."""
    rng = np.random.default_rng(5)
    body = [f"w{i}" for i in range(60)]
    out = []
    for i in range(60):
        w = list(body)
        w[int(rng.integers(60))] = f"x{i}"
        out.append((i, " ".join(w)))
    for i in range(60, 120):
        out.append((i, " ".join(body[:25] + [f"u{i}_{k}" for k in range(30)])))
    return spark.createDataFrame(out, "doc_id long, text string")


@pytest.mark.parametrize("hot", [24, 2])
def test_jaccard(spark, docs, hot):
    for table in (docs, near_copies(spark)):
        want = components(table.collect())
        got = jaccard.jaccard_components(table.select("doc_id", "text"), hot).collect()
        assert len(got) == table.count()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(k, *v) for k, v in want.items()}


def test_jaccard_smallest(spark):
    """A text of 7 words has 3 shingles, and 4 with one word more at either end."""
    words = [f"{c}{k}" for c in "abc" for k in range(7)]
    texts = [" ".join(words[i : i + 7]) for i in (0, 7, 14)]
    table = spark.createDataFrame([(1, texts[0]), (2, texts[0] + " end"), (3, "start " + texts[1]), (4, texts[1]), (5, texts[2]), (6, " ".join(words[15:21]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table).collect()}
    assert got == components(table.collect()) and [got[k][1] for k in (2, 4, 6)] == [1, 3, 6]


@pytest.mark.parametrize("hot", [24, 2])
def test_jaccard_across_bands(spark, hot):
    """Near copies of which the larger ones share only hot keys, and one with cold keys among those of its own size."""
    body = [f"w{i}" for i in range(38)]
    data = [(i, " ".join([*body, f"x{i}"])) for i in range(40)] + [(90, " ".join(body[:34])), (91, " ".join([*body[1:34], "y"])), (92, " ".join(body[:24]))]
    # and within one band: 21 of the 28 shingles of one copy, each segment that differs with cold keys
    data += [(200 + i, " ".join([f"v{k}" for k in range(31)] + [f"z{i}"])) for i in range(40)] + [(300 + i, " ".join([f"v{k}" for k in range(i, i + 26)])) for i in range(6)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table, hot).collect()}
    want = components(table.collect())
    assert got == want and want[90] == (30, 0)


def test_jaccard_empty(empty):
    assert jaccard.jaccard_components(empty).count() == 0


def test_mixing(spark, empty):
    data = [(i, "w " * (i % 7 + 1), "en" if i % 3 else "fr", f"src{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    total = sum(i % 7 + 1 for i in range(400))
    got = mixing.mix(docs, share=0.5, max_epochs=2, weights={"source": {("even", "en", "src0"): 3.0}}, seed=1)
    per = got.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("n")).collect()
    plan = {tuple(r)[:3]: r for r in mixing.budgets(docs.select(mixing.default_domain(F.col("source")).alias("domain"), "lang", "source", mixing.n_tokens(F.col("text")).alias("n_tokens")), None, 0.5, 2, {"source": {("even", "en", "src0"): 3.0}}).collect()}
    assert abs(sum(r["budget"] for r in plan.values()) - total / 2) <= len(plan)
    for r in per:
        budget = plan[(r["domain"], r["lang"], r["source"])]["budget"]
        assert budget - 7 < r["n"] <= budget and budget <= 2 * plan[(r["domain"], r["lang"], r["source"])]["supply"]
    everything = mixing.mix(docs, share=9.0, max_epochs=2)
    assert everything.count() == 800 and mixing.mix(empty).count() == 0 and mixing.mix(docs, total=0).count() == 0
    assert sorted(map(tuple, got.select("doc_id", "epoch").collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7), share=0.5, max_epochs=2, weights={"source": {("even", "en", "src0"): 3.0}}, seed=1).select("doc_id", "epoch").collect()))


def test_pieces(spark, docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    s = pieces.PieceSampler(path)
    for text in ("hello  world", "\n\t tabs ", "▁x ▁", "日本語😀é", "x" * 400, "<s> <0x0A>"):
        ids = s.encode([text, text], [1, 1])
        assert s.decode(ids[0]) == text and (ids[0] == ids[1]).all()
    one, many = s.encode(["sampling"], [5])[0], pieces.PieceSampler(path).encode(["other words", "sampling"], [1, 5])[1]
    assert (one == many).all()
    # the share of each segmentation is its weight's
    n = 20_000
    got = collections.Counter(tuple(x) for x in s.encode(["ab"] * n, list(range(n))))
    logw = dict(zip(s.piece.tolist(), s.logw.tolist(), strict=True))
    weight = {seg: np.exp(sum(logw[i] for i in seg)) for seg in got}
    for seg, c in got.items():
        assert abs(c / n - weight[seg] / sum(weight.values())) < 0.02
    enc = pieces.encode(docs, path)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(enc, path).collect()}
    assert all(back[r["doc_id"]] == r["text"] for r in rows(docs)) and pieces.digest(empty, path).count() == 0


def test_quality(spark, docs, empty):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for r in rows(docs):
        text = r["text"] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[r["doc_id"]][k] for k in quality._STATS) == want
    assert quality.quality_rules(docs).count() == docs.count() and quality.quality_rules(empty).count() == 0
    words = lambda i: " ".join(f"w{i}_{k}" for k in range(60))
    shared = " ".join(f"s{k}" for k in range(200))
    t = spark.createDataFrame([(i, f"{shared}\n{words(i)}" if i < 40 else words(i), "h") for i in range(60)], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.quality_rules(t).filter("kept").collect()}
    assert kept == {0, *range(40, 60)} == {r["doc_id"] for r in quality.kept_documents(t).collect()}


def test_quality_limit(spark):
    """The limit doesn't grow with the host, and documents count, not different texts."""
    words = lambda i: " ".join(f"w{i}_{k}" for k in range(60))
    data = [(i, f"Shared line\n{words(i)}" if i < 30 else words(i), "large") for i in range(1000)] + [(2000 + i, "same " * 3 + words(0), "copies") for i in range(25)]
    data += [(3000 + i, f"Few\n{words(i)}", "small") for i in range(20)]
    got = {r["doc_id"]: r["n_removed"] for r in quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert {k for k, n in got.items() if n == 2} == set(range(1, 30)) and {k for k, n in got.items() if n == 63} == set(range(2001, 2025))
    assert sum(n > 0 for n in got.values()) == 29 + 24


def test_quality_without_ids(spark):
    """Texts without a doc_id count each; one of them keeps the line, copies of it too."""
    words = lambda i: " ".join(f"w{i}_{k}" for k in range(60))
    data = [(None, f"Line\n{words(i % 25)}", None) for i in range(50)] + [(1, "Other\n" + words(90), None)]
    got = [r["n_removed"] for r in quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()]
    assert sorted(got) == [0] * 3 + [1] * 48


def test_quality_cleaned(spark):
    """Removed lines are gone from the texts, wherever they stand, and all else stays as it was."""
    words = lambda i: " ".join(f"w{i}_{k}" for k in range(60))
    text = lambda i: ["Top\n\n{}\n  end", "{}\n \nTOP \nend\n", "top\nend\n{}", "{}\r\nend"][i % 4].format(words(i))
    want = lambda i: ["\n{}", "{}\n \n", "{}", "{}\r"][i % 4].format(words(i)) if i else text(0)
    data = [(i, text(i), "h", "en", i) for i in range(40)] + [(39, text(39), "h", "en", 39), (50, None, "h", None, 1), (51, "top\nend", "h", None, 1), (52, text(1), "other", "fr", 1)]
    t = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n long")
    got = quality.kept_documents(t)
    assert got.columns == t.columns and sorted(map(tuple, got.collect())) == sorted([(i, want(i), "h", "en", i) for i in [*range(40), 39]] + [(52, text(1), "other", "fr", 1)])
    every = {r["doc_id"]: (r["text"], r["n_removed"], r["kept"]) for r in quality.quality_rules(t).collect()}
    assert every[39] == (want(39), 1, True) and every[50] == (None, 0, False) and every[51] == ("", 2, False) and every[1] == (want(1), 2, True)


def test_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) / 3
    x[50] = x[100]
    data = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (950, [1.0, 2.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = topk.search(topk.build_index(v, 64), v.filter("vec_id % 50 = 0"), 5, 2).orderBy("query_id", "rank").collect()
    z = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    want = [(q, k + 1, int(i), int((z @ z[q])[i])) for q in range(0, 300, 50) for k, i in enumerate([i for i in np.lexsort((np.arange(300), -(z @ z[q]))) if i != q][:5])]
    assert [tuple(r) for r in got] == want


def test_licenses(docs, empty):
    s = licenses.Scanner(licenses.TEMPLATES, 0.8, 3)
    assert s.scan("words before. Licensed under the Apache license, version 2.0. After")[0] == "Apache-2.0"
    assert s.scan("This work was licensed under the GNU General Public License, version 3.")[0] == "GPL-3.0"
    assert s.scan("Released under the MIT License. " * 3)[:2] == ("MIT", 1.0) and s.scan("a license for the work under version") is None
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_licenses_filter():
    """As many words as the coverage allows may be missing, whichever they are; the filter passes over none."""
    s, full = licenses.Scanner(licenses.TEMPLATES, 0.8, 3), licenses.Scanner(licenses.TEMPLATES, 0.8, 3)
    full.needed = {k: set(v) for k, v in full.templates.items()}
    full.any = set().union(*full.needed.values())
    for name, words in s.templates.items():
        for gone in range(len(words)):
            for more in (0, 1):
                rest = [w for i, w in enumerate(words) if i != gone and i >= more]
                text = "before this " + " ".join(rest) + " after it"
                a, b = s.scan(text), full.scan(text)
                assert (a and a[:2]) == (b and b[:2]), (name, text)
    assert s.scan("This project is licensed under the MIT License")[:2] == ("MIT", 0.8)
    assert s.scan("Distributed under CC BY-NC 4.0")[:2] == ("CC-BY-NC-4.0", 0.8)


def test_language_model(docs, empty):
    got = lm.score(docs).collect()
    text = [(r["doc_id"], WORD.findall((r["text"] or "").translate(LOWER)) + [None]) for r in rows(docs)]
    c = collections.Counter(w for k, ws in text if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    total, kinds = sum(c.values()), len(c)
    want = {k: (len(ws), sum(c[w] > 0 for w in ws), sum(np.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)) for k, ws in text}
    assert len(got) == len(text)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[r["doc_id"]][:2], total)
        assert abs(r["base_score"] - want[r["doc_id"]][2]) < 1e-6 * abs(want[r["doc_id"]][2]) and r["score"] < 0
    assert lm.score(empty).count() == 0
