"""Every stage of the pipeline against a plain version, on what the stage before kept; odd rows and empty tables."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stacksift.llm import mixing, pieces, queries
from stacksift.llm.common import tokenizer_path, written
from test_langid import plain_predictions
from test_llm import components
from test_mixing import plain_budgets

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(spark):
    long = "the word and the other word are here for you to read again " * 400
    filled = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([
        (9001, None, "en", "s", 0), (9002, "", None, None, 0), (None, filled + " der", "de", "s", 1), (9003, long, "en", "s", 2), (9004, filled, None, None, 3), (9004, filled, None, None, 3), (9005, "12 34 " * 60, "fr", "s1", 4),
    ], COLUMNS)


@pytest.fixture(scope="module")
def kept(spark):
    """The input of every stage and the last one's output."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd_rows(spark))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language id", "near duplicates", "mixture", "token ids"]


def test_columns(kept):
    assert all(d.columns == kept[0].columns for d in kept[:5]) and kept[5].columns == ["doc_id", "ids"]


def test_quality(kept):
    """What the operator's SQL keeps, with its texts (it takes ids for unique); rows without a doc_id are judged by their own counts."""
    con = duckdb.connect()
    con.register("documents", kept[0].filter("doc_id is not null").distinct().toPandas())
    want = {(r[0], r[1]) for r in con.execute(f"SELECT doc_id, text FROM ({queries._OP7}) WHERE kept").fetchall()}
    assert {(r["doc_id"], r["text"]) for r in kept[1].filter("doc_id is not null").collect()} == want
    assert kept[1].filter("doc_id is null").count() == 1


def test_language(kept):
    rows = kept[1].collect()
    want = plain_predictions(rows)
    good = collections.Counter(tuple(r) for r in rows if want[r["doc_id"], r["text"]][0] != "und" and want[r["doc_id"], r["text"]][1] >= 0.5)
    assert bag(kept[2]) == good


def test_near_duplicates(kept):
    rows = kept[2].collect()
    root = components([r for r in rows if r["doc_id"] is not None])
    assert bag(kept[3]) == collections.Counter(tuple(r) for r in rows if r["doc_id"] is None or root[r["doc_id"]][1] == r["doc_id"])


def test_mixture(kept):
    docs = kept[3].select("*", mixing.default_domain(F.col("source")).alias("domain"), F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))).alias("own"))
    rows = docs.withColumn("keys", F.array(*(F.xxhash64(F.lit(7), F.lit(e), F.col("own")) for e in range(2)))).collect()
    size = lambda r: len((r["text"] or "").split())
    weights = {"domain": {("even",): 2}, "lang": {("even", "en"): 2, ("odd", "en"): 2}, "source": {("even", "en", "src0"): 0.5}}
    plan = plain_budgets([(r["domain"], r["lang"], r["source"], size(r)) for r in rows if size(r)], None, 0.5, 2, {k: {p: __import__("fractions").Fraction(w) for p, w in v.items()} for k, v in weights.items()})
    want = collections.Counter()
    for leaf, budget in plan.items():
        mine = [r for r in rows if (r["domain"], r["lang"], r["source"]) == leaf and size(r)]
        whole, rest = divmod(budget, sum(map(size, mine)))
        for r in mine:
            want[tuple(r)[:5]] += whole
        for r in sorted(mine, key=lambda r: r["keys"][min(whole, 1)] % (1 << 64)):
            if size(r) > rest:
                break
            want[tuple(r)[:5]] += 1
            rest -= size(r)
    assert bag(kept[4]) == +want


def test_token_ids(kept):
    texts = collections.Counter((r["doc_id"], r["text"]) for r in kept[4].collect())
    back = pieces.decode(kept[5], tokenizer_path("piece_bpe_32k.model"))
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == texts and texts


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, SF).count() > 0
