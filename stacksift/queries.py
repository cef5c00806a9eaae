"""The library's operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identifiers, records, text
from .functions.fold import contains_any, fold, variants
from .operators import dedupe, hierarchy, maintenance, reports, vectors
from .plans.conditions import Condition, compile_all, date, multi, scalar, tag_language, where

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: What fold() does to the letters of these tables, for the SQL side: fixed values.
_FROM, _TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
_FOLD = f"translate(replace(lower({{}}), 'ß', 'ss'), '{_FROM}', '{_TO}')"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_fields() -> dict:
    one = lambda c: (lambda op, v: scalar(F.col(c), op, v))
    return {c: one(c) for c in ("lang", "source", "text", "n_chars")}


@query(f"""SELECT doc_id, lang, source, n_chars FROM documents
WHERE {_FOLD.format('lang')} = 'de' AND contains({_FOLD.format('text')}, 'fur') AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 50""")
def search_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Condition("lang", "is", "DE"), Condition("text", "contains", "für"), Condition("n_chars", "isGreaterThan", "500")]
    rows = _t(spark, sf_dir, "documents").filter(compile_all(wanted, "all", _doc_fields()))
    return rows.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


_GRID = [("lang", "is", "en"), ("lang", "isNot", "en"), ("text", "contains", "ándy"), ("text", "doesNotContain", "the"), ("source", "beginsWith", "SRC1"), ("source", "endsWith", "7"), ("n_chars", "isGreaterThan", "2400"), ("n_chars", "isLessThan", "900"), ("source", "isAfter", "src5"), ("source", "isBefore", "src13")]
_GRID_SQL = {
    "is": "{f} = '{v}'", "isNot": "{f} <> '{v}'", "contains": "contains({f}, '{v}')", "doesNotContain": "NOT contains({f}, '{v}')", "beginsWith": "starts_with({f}, '{v}')", "endsWith": "ends_with({f}, '{v}')",
    "isGreaterThan": "{c} > {v}", "isLessThan": "{c} < {v}", "isAfter": "{c} > '{v}'", "isBefore": "{c} < '{v}'",
}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS field, '{op}' AS operation, count(*) FILTER (WHERE " + _GRID_SQL[op].format(f=_FOLD.format(c), c=c, v=v.lower().replace("á", "a")) + ") AS n FROM documents" for c, op, v in _GRID
))
def condition_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _doc_fields()
    counts = [F.count_if(compile_all([Condition(c, op, v)], "all", fields)).alias(f"c{i}") for i, (c, op, v) in enumerate(_GRID)]
    one = _t(spark, sf_dir, "documents").agg(*counts)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(op).alias("operation"), F.col(f"c{i}").alias("n")) for i, (c, op, _) in enumerate(_GRID)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _order_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(items, "o_orderkey", "left")


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE f.n > 0 AND f.r = 0) AS is_not_r, count(*) FILTER (WHERE f.r > 0) AS is_r, count(*) FILTER (WHERE coalesce(f.r, 0) = 0) AS without_r
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) f ON o_orderkey = l_orderkey GROUP BY 1""")
def multi_value_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isNot over several values needs a value; the tag language's exclusion doesn't."""
    rows = _order_flags(spark, sf_dir)
    flags = F.col("flags")
    return rows.groupBy("o_orderstatus").agg(F.count_if(multi(flags, "isNot", "r")).alias("is_not_r"), F.count_if(multi(flags, "is", "r")).alias("is_r"), F.count_if(tag_language(["-R"], flags)).alias("without_r"))


@query("""SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE (coalesce(l.quality, 0) = 1 OR coalesce(l.toxic, 0) = 1) AND NOT coalesce(l.toxic, 0) = 1""")
def tag_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "Toxic")))
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.filter(tag_language(["good OR toxic", "-toxic"], names)).select("doc_id", "lang")


_FORMS = variants("für-die")


@query("SELECT doc_id, n_chars FROM documents WHERE " + " OR ".join(f"contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{v}')" for v in _FORMS))
def keyword_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").filter(contains_any(F.col("text"), _FORMS)).select("doc_id", "n_chars")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY 1")
def live_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _t(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return _t(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT n_name, coalesce(c.n, 0)::BIGINT AS customers, coalesce(s.n, 0)::BIGINT AS suppliers FROM nation
LEFT JOIN (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each scope, 0 where there is none: sides are aggregated before they are joined."""
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    rows = _t(spark, sf_dir, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return rows.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT conv_id, count(*) AS n, string_agg(role, '; ' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def children_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "; ")
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), roles.alias("roles"), F.sum(F.length("text")).cast("long").alias("chars"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return r.unionByName(n)


@query("SELECT 'r' || r_regionkey AS key, r_name AS path, 1 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(_tree(spark, sf_dir), "key", "parent", "name").select("key", F.array_join("path", "/").alias("path"), "depth")


@query("SELECT 'r2' AS root, 'r2' AS node UNION ALL SELECT 'r2', 'n' || n_nationkey FROM nation WHERE n_regionkey = 2")
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.subtree(_tree(spark, sf_dir), ["r2"])


@query("""SELECT o_orderkey, c_name, o_totalprice, o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 100) o JOIN customer ON o_custkey = c_custkey""")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page is ranked on a slim scan and only then joined."""
    page = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).limit(100)
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return customers.join(F.broadcast(page), "o_custkey").select("o_orderkey", "c_name", "o_totalprice", "o_orderdate")


@query("SELECT letter, count(*) AS n, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT DISTINCT p_type AS name, upper(substr(p_type, 1, 1)) AS letter FROM part) GROUP BY 1")
def tags_by_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    return names.groupBy(F.upper(F.substring("name", 1, 1)).alias("letter")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


@query("SELECT '10.5555/' || md5(lower(trim(text))) AS value, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) >= 2")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts, as items that share a DOI."""
    items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("https://doi.org/10.5555/"), F.md5(F.lower(F.trim("text")))).alias("DOI"))
    return dedupe.groups(items, ("doi",)).select("value", "n", F.array_min("keys").alias("first_id"), F.array_max("keys").alias("last_id"))


@query("""SELECT value, doc_id AS keeper FROM (SELECT md5(d.text) AS value, d.doc_id, count(*) OVER (PARTITION BY md5(d.text)) AS n,
row_number() OVER (PARTITION BY md5(d.text) ORDER BY (l.doc_id IS NOT NULL) DESC, d.source, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE n >= 2 AND rn = 1""")
def keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that ranks first: a minimum of structs folds in every task, so a large group doesn't meet in one."""
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    rows = _t(spark, sf_dir, "documents").select(F.md5("text").alias("value"), "source", "doc_id").join(labels, "doc_id", "left")
    rank = F.struct(-F.coalesce("has", F.lit(0)), F.col("source"), F.col("doc_id").alias("keeper"))
    return rows.groupBy("value").agg(F.min(rank).alias("r"), F.count("*").alias("n")).filter("n >= 2").select("value", "r.keeper")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_pos FROM documents")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_of_each(_t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k")), F.col("k"), "doc_id").select("doc_id", "first_pos")


@query("""WITH k AS (SELECT p_partkey AS key, p_brand || p_size AS value, CASE WHEN p_retailprice >= 1500 THEN 2 WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END AS s FROM part)
SELECT key FROM k WHERE NOT (s = 1 AND EXISTS (SELECT 1 FROM k b WHERE b.value = k.value AND b.s = 2))""")
def without_preprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the middle kind go if one of the best kind shares their key."""
    price = F.col("p_retailprice")
    kind = F.when(price >= 1500, "journalArticle").when(price >= 1000, "preprint").otherwise("other")
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat("p_brand", "p_size").alias("title"), kind.alias("itemType"))
    return dedupe.without_covered_preprints(rows).select("key")


_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


@query(f"""SELECT e.vec_id AS id, {_COS.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = index.filter("id = 0").first()["embedding"]
    return vectors.nearest(index, asked, 10).select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, rank, id, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS.format(a='e.embedding', b='q.embedding')} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank
FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0) WHERE rank <= 5""")
def nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    got = vectors.nearest_many(index, index.filter("id % 100 = 0"), 5, buckets=8)
    return got.select("query_id", "rank", "id", F.round(1 - F.col("distance"), 6).alias("score"))


@query("""SELECT label AS item_key, vec_id AS id, round(score, 6) AS score FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM
(SELECT e.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label <> 3 OR e.label IS NULL)) WHERE rn = 1 ORDER BY score DESC, id LIMIT 5""")
def best_passage_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered by metadata, grouped to the parent by its best passage, then cut."""
    index = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("item_key"), "embedding")
    asked = index.filter("id = 7").first()["embedding"]
    d = index.filter(where({"item_key": {"$ne": 3}})).withColumn("distance", vectors.distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in asked))))
    return vectors.group_to_parent(d, 5).select("item_key", "id", F.round(1 - F.col("distance"), 6).alias("score"))


@query("""SELECT count(*) AS scanned, count(l.doc_id) AS with_pdf, count(*) - count(l.doc_id) AS missing, round(100.0 * count(l.doc_id) / count(*), 6)::DOUBLE AS percent_covered
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("itemID"))
    files = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("parentItemID"), F.lit("application/pdf").alias("contentType"))
    return reports.coverage(items, files).withColumn("percent_covered", F.round("percent_covered", 6))


@query("SELECT lang AS item_type, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS with_fulltext FROM documents GROUP BY 1")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(F.col("lang").alias("item_type"), F.when(F.col("n_chars") > 2000, "true").alias("has_fulltext"), F.col("source").alias("fulltext_source"), F.col("source").alias("title"))
    return reports.index_stats(rows)["fulltext_by_type"]


@query("SELECT p_partkey, '10.1234/part(' || p_partkey || ')x' AS doi FROM part")
def doi_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's DOI in one of five spellings comes back as one."""
    bare = F.concat(F.lit("10.1234/Part("), "p_partkey", F.lit(")X"))
    form = F.col("p_partkey") % 5
    coded = F.replace(F.replace(bare, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    raw = F.when(form == 0, bare).when(form == 1, F.concat(F.lit(" doi: "), bare)).when(form == 2, F.concat(F.lit("https://doi.org/"), coded)).when(form == 3, F.concat(bare, F.lit(".,)"))).otherwise(F.concat(F.lit("http://dx.doi.org/"), bare, F.lit("?a=b")))
    return _t(spark, sf_dir, "part").select("p_partkey", identifiers.doi_key(raw).alias("doi"))


@query("""WITH c AS (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS s FROM part) SELECT p_partkey, s ||
((10 - (substr(s,1,1)::INT + 3*substr(s,2,1)::INT + substr(s,3,1)::INT + 3*substr(s,4,1)::INT + substr(s,5,1)::INT + 3*substr(s,6,1)::INT + substr(s,7,1)::INT + 3*substr(s,8,1)::INT + substr(s,9,1)::INT + 3*substr(s,10,1)::INT + substr(s,11,1)::INT + 3*substr(s,12,1)::INT) % 10) % 10)::VARCHAR AS isbn FROM c""")
def isbn_from_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISBN-10s with their check digits, hyphenated, come back as valid ISBN-13s."""
    s = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    check = (11 - sum((F.substring(s, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0)) % 11) % 11
    raw = F.concat(F.lit("ISBN: "), F.substring(s, 1, 3), F.lit("-"), F.substring(s, 4, 6), F.lit("-"), F.when(check == 10, "X").otherwise(check.cast("string")))
    return _t(spark, sf_dir, "part").select("p_partkey", identifiers.isbn13(raw).alias("isbn"))


@query("SELECT page_id, md5(regexp_replace(html, '<.*?>', '', 'g')) AS digest, length(regexp_replace(html, '<.*?>', '', 'g'))::INT AS n FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = text.clean_html(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(bare).alias("digest"), F.length(bare).alias("n"))


@query("""SELECT strftime(o_orderdate, '%Y') AS year, count(*) FILTER (WHERE strftime(o_orderdate, '%Y-%m-00') > '1995-03-15') AS after, count(*) FILTER (WHERE contains(lower(strftime(o_orderdate, '%m/%Y')), '03/')) AS in_march FROM orders GROUP BY 1""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of months: ranges compare the padded half, text operators see the display half."""
    rows = _t(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-'00'"), F.lit(" "), F.date_format("o_orderdate", "MM/yyyy")).alias("d"))
    d = F.col("d")
    return rows.groupBy(records.date_year(d).alias("year")).agg(F.count_if(date(d, "isAfter", "1995-03-15")).alias("after"), F.count_if(date(d, "contains", "03/")).alias("in_march"))


@query("""SELECT decision, count(*) AS n FROM (SELECT CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN i.doc_id IS NULL THEN 'add' WHEN i.n_chars <> s.n_chars THEN 'update' ELSE 'skip' END AS decision
FROM (SELECT doc_id, n_chars + (doc_id % 7 = 0)::INT AS n_chars FROM documents WHERE doc_id % 3 <> 0) i FULL JOIN (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 <> 0) s ON i.doc_id = s.doc_id) GROUP BY 1""")
def index_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "doc_id", "n_chars")
    nothing = F.lit(None).cast("string")
    index = docs.filter("doc_id % 3 <> 0").select(F.col("key").alias("item_key"), (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("string").alias("date_modified"), nothing.alias("attachment_keys"), nothing.alias("attachment_priority"), F.lit("true").alias("has_fulltext"), F.lit(0).alias("group_id"))
    items = docs.filter("doc_id % 5 <> 0").select("key", F.col("n_chars").cast("string").alias("dateModified"), nothing.alias("attachment_keys"))
    return maintenance.change_counts(maintenance.decisions(index, items))


@query("""SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT source, n_chars FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT source, n_chars + 1 FROM documents WHERE doc_id % 4 = 1) GROUP BY 1""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), "source", "n_chars")
    new = docs.filter("item_key % 4 = 1").withColumn("n_chars", F.col("n_chars") + 1)
    return maintenance.upsert(docs, new).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT d.source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def deletion_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index has and the listing hasn't, in one library."""
    index = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), "source", F.lit(0).alias("group_id"))
    listed = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    gone = maintenance.deletions(index, listed, 0, allow=True).keys
    return index.join(gone, "item_key", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, (c.c_custkey IS NOT NULL) AS in_library FROM events e LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey")
def in_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("DOI:10.1234/U"), "user_id").alias("doi"))
    own = _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("https://doi.org/10.1234/u"), "c_custkey").alias("DOI"), F.lit(None).cast("string").alias("extra"))
    return reports.in_library(outside, own).select("event_id", "in_library")


@query("""SELECT conv_id, turn, substr(text, greatest(strpos(lower(text), 'tion') - 20, 1), 64) AS context FROM conversations WHERE contains(lower(text), 'tion')""")
def search_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.search import context

    rows = _t(spark, sf_dir, "conversations").filter(F.lower("text").contains("tion"))
    return rows.select("conv_id", "turn", context(F.col("text"), "tion", 20, 40).alias("context"))


@query("SELECT lang, sum(greatest(1, ceil(n_chars / 3.0)))::BIGINT AS tokens, max(greatest(1, ceil(n_chars / 3.0)))::BIGINT AS most FROM documents GROUP BY 1")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.token_estimate(F.col("text"))
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("tokens"), F.max(n).alias("most"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").distinct()
    listed = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return stored.join(listed, "o_orderkey", "left_anti")


@query("""SELECT o_custkey, o_orderkey AS newest FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def newest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("""SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("day"), "n", "total")


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


@query()
def passage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in passages with their places; tests hold the query against a plain splitter."""
    p = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.passages(F.col("text"), 1500, 200, 1 << 30)).alias("chunk_index", "p"))
    return p.select("doc_id", "chunk_index", "p.char_start", "p.char_end", F.md5("p.passage").alias("digest"))


@query()
def best_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.snippet("the tion stupid", F.col("text"), 320)
    return _t(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.snippet", "s.start")


@query("""SELECT c.conv_id, c.turn, count(p.turn) AS before FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn GROUP BY 1, 2""")
def place_in_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.rank().over(order) - 1).cast("long").alias("before")).distinct()
