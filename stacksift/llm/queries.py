"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, langid, licenses, lm, mixing, pieces, quality, tokens, topk, toxicity
from .common import table, tokenizer_path


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


#: Weights of the registered mixture: even sources and English up, one source down.
MIXTURE = {"domain": {("even",): 2.0}, "lang": {("even", "en"): 2.0, ("odd", "en"): 2.0}, "source": {("even", "en", "src0"): 0.5}}


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), share=0.5, max_epochs=2, weights=MIXTURE, seed=7)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(topk.build_index(vectors), vectors.filter("vec_id % 50 = 0"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), lm.ROUNDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Words, and what counts as white space at a line's ends, in DuckDB's terms.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1))) WHEN len(w) > 0 THEN ['#' || len(w) || chr(1) || array_to_string(w, chr(1))] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc, min(root) AS component_id FROM r GROUP BY 1) c ON c.doc = d.doc_id"""

_OP7 = f"""WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, string_split(text, chr(10)) AS parts FROM documents),
tri AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT t.doc_id, unnest([t.i, t.i + 1, t.i + 2]) AS pos FROM tri t JOIN (SELECT doc_id, g FROM tri GROUP BY 1, 2 HAVING count(*) > 1) m ON m.doc_id = t.doc_id AND m.g = t.g) GROUP BY 1),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
coalesce(len(list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))), 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
ln AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d WHERE text IS NOT NULL),
nm AS (SELECT *, lower(trim(line, {_BLANKS})) AS norm, len({_WORDS.format('line')}) AS n FROM ln),
many AS (SELECT source, norm, min(doc_id) AS first FROM nm WHERE n > 0 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
jd AS (SELECT nm.*, (many.norm IS NOT NULL AND nm.doc_id <> many.first) AS gone FROM nm LEFT JOIN many ON many.norm = nm.norm AND many.source IS NOT DISTINCT FROM nm.source AND nm.n > 0),
cl AS (SELECT doc_id, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM jd GROUP BY 1),
f AS (SELECT b.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce(cl.n_removed, 0)::BIGINT AS n_removed, cl.text FROM b LEFT JOIN cl ON cl.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND n_removed <= 0.7 * n_words) AS kept, n_removed, text FROM f"""

_OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)::INT AS rank
FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express whole; the others are tested against plain versions."""
    return {"op3_jaccard_join": _OP3, "op7_quality_rules": _OP7, "op8_exact_topk": _OP8}
