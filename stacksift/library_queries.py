"""The library's searches, listings and reports over a snapshot that is laid out from the driver's tables.

Documents are the parent items, customers their creators, sources and labels their tags, regions and nations the
collections; turns of conversations are notes, pages attachments, passages of the benchmark annotations of those. The
SQL of each query starts from the same layout, written over the plain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.records import format_creators
from .model import Library
from .operators import dedupe, hierarchy, maintenance, reports, search
from .plans.conditions import Condition
from .queries import _FOLD, _t, query

#: Where the ids of each kind of child begin; parents and kinds stay apart however many rows there are.
NOTE, FILE, MARK = 1 << 60, 1 << 61, 3 << 60
#: A note's number is conv_id * 1000 + turn, as in SQL; long conversations share numbers, so ids leave room behind them.
ROOM = 1 << 16
TYPES = {1: "journalArticle", 2: "book", 3: "attachment", 4: "note", 5: "annotation", 6: "case", 7: "preprint"}
FIELDS = {1: "title", 2: "date", 3: "abstractNote", 4: "DOI", 5: "caseName", 6: "extra"}


def snapshot(spark: SparkSession, sf_dir: str, group_id: int | None = None) -> Library:
    make, e = spark.createDataFrame, F.expr
    docs = _t(spark, sf_dir, "documents")
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    pages = _t(spark, sf_dir, "pages")
    marks = _t(spark, sf_dir, "benchmark")
    labels = _t(spark, sf_dir, "labels")
    number = F.col("conv_id") * 1000 + F.col("turn")
    notes = turns.select((F.lit(NOTE) + number * ROOM + F.floor(F.col("turn") / 1000)).alias("itemID"), number.alias("number"), F.col("conv_id").alias("parentItemID"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("note"))
    files = pages.select((F.lit(FILE) + F.col("page_id")).alias("itemID"), F.col("page_id").alias("number"), F.col("page_id").alias("parentItemID"), F.lit(0).alias("linkMode"), e("case page_id % 3 when 0 then 'application/pdf' when 1 then 'text/html' end").alias("contentType"), F.concat(F.lit("storage:p"), "page_id").alias("path"))
    remarks = marks.select(
        (F.lit(MARK) + F.col("item_id")).alias("itemID"), F.col("item_id").alias("number"), (F.lit(FILE) + F.col("item_id")).alias("parentItemID"), F.lit(1).alias("type"), "text", F.lit("").alias("comment"), F.lit("#ffd400").alias("color"),
        F.lit("1").alias("pageLabel"), F.lit("00001").alias("sortIndex"), F.lit('{"pageIndex": 0}').alias("position"),
    )
    child = lambda rows, letter, kind: rows.select("itemID", F.concat(F.lit(letter), F.lpad(F.col("number").cast("string"), 7, "0")).alias("key"), F.lit(kind).alias("itemTypeID"), F.lit(1).cast("long").alias("libraryID"), F.lit("2023-01-01").alias("dateAdded"), F.lit("2023-01-01").alias("dateModified"))
    items = docs.select(
        F.col("doc_id").alias("itemID"), F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("key"), e("case lang when 'en' then 1 when 'fr' then 2 when 'de' then 7 else 6 end").alias("itemTypeID"),
        e("cast(case doc_id % 10 when 0 then 2 when 5 then 3 else 1 end as long)").alias("libraryID"),
        e("concat('2024-', lpad(cast(n_chars % 12 + 1 as string), 2, '0'), '-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'))").alias("dateAdded"),
        e("concat('2025-', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '-', lpad(cast(n_chars % 28 + 1 as string), 2, '0'))").alias("dateModified"),
    )
    month = "lpad(cast(doc_id % 12 + 1 as string), 2, '0')"
    values = docs.select(F.col("doc_id").alias("itemID"), e(f"""explode(map_entries(map(case when lang = 'es' then 5 else 1 end, substring(text, 1, 60), 2, concat(1990 + doc_id % 30, '-', {month}, '-00 ', {month}, '/', 1990 + doc_id % 30),
        3, substring(text, 61, 200), 4, case when doc_id % 2 = 0 then concat('https://doi.org/10.5555/', substring(md5(text), 1, 12)) end, 6, case when doc_id % 3 = 0 then concat('note: x\\nCitation Key: c', doc_id) end)))""").alias("f"))  # fmt: skip
    values = values.filter("f.value is not null").select("itemID", F.col("f.key").alias("fieldID"), (F.col("itemID") * 10 + F.col("f.key")).alias("valueID"), "f.value")
    one = docs.select(F.col("doc_id").alias("itemID"), (F.col("doc_id") % 100 + 1).alias("creatorID"), F.lit(1).alias("creatorTypeID"), F.lit(0).alias("orderIndex"))
    two = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("itemID"), (F.col("doc_id") % 37 + 2).alias("creatorID"), F.lit(1).alias("creatorTypeID"), F.lit(1).alias("orderIndex"))
    said = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    source_tag = docs.filter("source is not null").select(F.col("doc_id").alias("itemID"), F.xxhash64("source").alias("tagID"), F.lit(1).alias("type"), F.col("source").alias("name"))
    label_tag = said.select(F.col("doc_id").alias("itemID"), e("explode(array_compact(array(case when toxic = 1 then 'Toxic' end, case when quality = 1 then 'good one' end)))").alias("name")).select("itemID", F.xxhash64("name").alias("tagID"), F.lit(0).alias("type"), "name")
    tagged = source_tag.unionByName(label_tag)
    regions, nations = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    tables = {
        "libraries": make([(1, "user"), (2, "group"), (3, "feed")], "libraryID long, type string"), "groups": make([(77, 2, "Our group", "", 1)], "groupID long, libraryID long, name string, description string, version long"),
        "itemTypes": make(list(TYPES.items()), "itemTypeID int, typeName string"), "fields": make(list(FIELDS.items()), "fieldID int, fieldName string"), "creatorTypes": make([(1, "author")], "creatorTypeID int, creatorType string"),
        "baseFieldMappingsCombined": make([(6, 1, 5)], "itemTypeID int, baseFieldID int, fieldID int"), "relationPredicates": make([(1, "dc:relation")], "predicateID long, predicate string"),
        "items": items.unionByName(child(notes, "N", 4)).unionByName(child(files, "F", 3)).unionByName(child(remarks, "A", 5)),
        "itemData": values.select("itemID", "fieldID", "valueID"), "itemDataValues": values.select("valueID", "value"),
        "creators": _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("creatorID"), e("case when c_custkey % 5 <> 0 then concat('Ann', c_custkey % 7) end").alias("firstName"), F.col("c_name").alias("lastName")),
        "itemCreators": one.unionByName(two), "tags": tagged.select("tagID", "name").distinct(), "itemTags": tagged.select("itemID", "tagID", "type"),
        "collections": regions.select((F.lit(1000) + F.col("r_regionkey")).cast("long").alias("collectionID"), F.col("r_name").alias("collectionName"), F.lit(None).cast("long").alias("parentCollectionID"), F.lit(1).cast("long").alias("libraryID"), F.concat(F.lit("REGION0"), "r_regionkey").alias("key")).unionByName(
            nations.select((F.lit(2000) + F.col("n_nationkey")).cast("long").alias("collectionID"), F.col("n_name").alias("collectionName"), (F.lit(1000) + F.col("n_regionkey")).cast("long").alias("parentCollectionID"), F.lit(1).cast("long").alias("libraryID"), F.concat(F.lit("NATION"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("key"))
        ),
        "collectionItems": docs.filter("doc_id % 4 <> 3").select((F.lit(2000) + F.col("doc_id") % 25).alias("collectionID"), F.col("doc_id").alias("itemID")).unionByName(docs.filter("doc_id % 4 = 0").select((F.lit(1000) + F.col("doc_id") % 5).alias("collectionID"), F.col("doc_id").alias("itemID"))),
        "itemNotes": notes.drop("number"), "itemAttachments": files.drop("number"), "itemAnnotations": remarks.drop("number"), "deletedItems": said.filter("toxic = 1").select(F.col("doc_id").alias("itemID")),
        "itemRelations": docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("itemID"), F.lit(1).cast("long").alias("predicateID"), e("concat('x/users/0/items/D', lpad(cast(doc_id + 1 as string), 7, '0'))").alias("object")),
        "feeds": make([(3, "News", "", "")], "libraryID long, name string, url string, lastCheck string"), "feedItems": docs.filter("doc_id % 10 = 5").select(F.col("doc_id").alias("itemID"), F.lit(None).cast("string").alias("readTime"), F.lit(None).cast("string").alias("translatedTime")),
    }
    return Library(spark, tables, group_id)


#: The same layout for SQL: parent items (it), with creators, tags and collections as lists.
_IT = """WITH sd AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1),
it AS (SELECT d.doc_id AS itemID, 'D' || lpad(d.doc_id::VARCHAR, 7, '0') AS key, CASE lang WHEN 'en' THEN 'journalArticle' WHEN 'fr' THEN 'book' WHEN 'de' THEN 'preprint' ELSE 'case' END AS itemType,
CASE d.doc_id % 10 WHEN 0 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS lib, '2024-' || lpad((n_chars % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((d.doc_id % 28 + 1)::VARCHAR, 2, '0') AS dateAdded,
'2025-' || lpad((d.doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((n_chars % 28 + 1)::VARCHAR, 2, '0') AS dateModified, substr(text, 1, 60) AS title, substr(text, 61, 200) AS abstract,
lpad((d.doc_id % 12 + 1)::VARCHAR, 2, '0') AS mm, (1990 + d.doc_id % 30)::VARCHAR AS yy, CASE WHEN d.doc_id % 2 = 0 THEN '10.5555/' || substr(md5(text), 1, 12) END AS doi, d.doc_id % 3 = 0 AS has_key,
list_filter([CASE WHEN c1.c_custkey IS NOT NULL THEN trim(CASE WHEN c1.c_custkey % 5 <> 0 THEN 'Ann' || c1.c_custkey % 7 ELSE '' END || ' ' || c1.c_name) END, CASE WHEN c2.c_custkey IS NOT NULL THEN trim(CASE WHEN c2.c_custkey % 5 <> 0 THEN 'Ann' || c2.c_custkey % 7 ELSE '' END || ' ' || c2.c_name) END], lambda x: x IS NOT NULL) AS creators,
list_sort(list_filter([source, CASE WHEN sd.toxic = 1 THEN 'Toxic' END, CASE WHEN sd.quality = 1 THEN 'good one' END], lambda x: x IS NOT NULL)) AS tags, coalesce(sd.toxic, 0) <> 1 AS live,
CASE WHEN d.doc_id % 4 <> 3 THEN d.doc_id % 25 END AS nation, CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id % 5 END AS region, md5(text) AS digest
FROM documents d LEFT JOIN sd ON sd.doc_id = d.doc_id LEFT JOIN customer c1 ON c1.c_custkey = d.doc_id % 100 + 1 LEFT JOIN customer c2 ON d.doc_id % 2 = 0 AND c2.c_custkey = d.doc_id % 37 + 2),
s AS (SELECT * FROM it WHERE live AND lib < 3),
nt AS (SELECT 10000000 + conv_id * 1000 + turn AS itemID, conv_id AS parent, min(text) AS text FROM conversations GROUP BY conv_id, turn)
"""
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _has(col: str, *forms: str) -> str:
    return "(" + " OR ".join(f"contains({_LOW.format(col)}, '{f}')" for f in forms) + ")"


@query(_IT + "SELECT key, itemType, CASE lib WHEN 1 THEN 0 ELSE 77 END::BIGINT AS group_id, title, yy || '-' || mm || '-00 ' || mm || '/' || yy AS date, doi, array_to_string(creators, '; ') AS creators, array_to_string(tags, '|') AS tags FROM s")
def library_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live parent items of users and groups with their resolved fields, creators and tags."""
    from .functions.identifiers import doi
    from .functions.records import creator_name

    i = search._scope(snapshot(spark, sf_dir), None, None, None, False)
    return i.select("key", "itemType", "group_id", "title", "date", doi(F.col("DOI")).alias("doi"), F.array_join(F.transform("creators", creator_name), "; ").alias("creators"), F.array_join(F.transform("tags", lambda t: t["tag"]), "|").alias("tags"))


@query(_IT + f"SELECT key, dateModified FROM s WHERE {_has('title', 'th')} OR {_has('yy', 'th')} OR len(list_filter(creators, lambda c: {_has('c', 'th')})) > 0 ORDER BY dateModified DESC, itemID DESC LIMIT 100")
def library_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword(snapshot(spark, sf_dir), "TH").select("key", "dateModified")


@query(_IT + f"SELECT key FROM s WHERE {_has('title', 'tion')} OR len(list_filter(creators, lambda c: {_has('c', 'tion')})) > 0 OR {_has('abstract', 'tion')} OR len(list_filter(tags, lambda c: {_has('c', 'tion')})) > 0 OR itemID IN (SELECT parent FROM nt WHERE {_has('text', 'tion')}) ORDER BY dateModified DESC, itemID DESC LIMIT 60")
def library_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword(snapshot(spark, sf_dir), "tion", "everything", limit=60).select("key")


@query(_IT + f"""SELECT key FROM s WHERE {_has('title', 'a-e', 'a e')} AND itemType <> 'book' AND (list_contains(tags, 'good one') OR list_contains(tags, 'src1') OR list_contains(tags, 'src2')) AND NOT list_contains(tags, 'src3')
AND (region = 1 OR nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) ORDER BY dateModified DESC, itemID DESC LIMIT 100""")
def library_keyword_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the query, a type that is left out, the tag language and a collection with all below it."""
    return search.keyword(snapshot(spark, sf_dir), "a-e", item_type="-book", tag=["GOOD ONE OR src1||src2", "-SRC3"], collection="REGION01", recursive=True).select("key")


@query(_IT + f"""SELECT key, title FROM s WHERE len(list_filter(creators, lambda c: contains({_FOLD.format('c')}, 'customer#00000001'))) > 0 AND yy::INT > 2000 AND NOT contains({_FOLD.format('title')}, 'the')
AND len(tags) > 0 AND NOT list_contains(tags, 'src5') ORDER BY itemID LIMIT 200""")
def library_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of four conditions: several values, a year, a missing scalar's negation and one over tags."""
    wanted = [Condition("author", "contains", "Customer#00000001"), Condition("year", "isGreaterThan", "2000"), Condition("title", "doesNotContain", "THE"), Condition("tag", "isNot", "src5")]
    return search.advanced(snapshot(spark, sf_dir), wanted, limit=200).select("key", "title")


@query(_IT + f"""SELECT key FROM s WHERE coalesce(nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) OR region = 2, false) OR contains(mm || '/' || yy, '03/') OR starts_with({_FOLD.format('title')}, 'de')
ORDER BY yy || '-' || mm || '-00' DESC, itemID LIMIT 100""")
def library_advanced_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Condition("collection", "is", "REGION02"), Condition("date", "contains", "03/"), Condition("title", "beginsWith", "DE")]
    return search.advanced(snapshot(spark, sf_dir), wanted, "any", "date", "desc", limit=100, recursive=True).select("key")


@query(_IT + "SELECT key, dateAdded, title FROM s ORDER BY dateAdded DESC, itemID DESC LIMIT 50")
def library_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent(snapshot(spark, sf_dir), 50).select("key", "dateAdded", "title")


@query(_IT + "SELECT key, title FROM s WHERE coalesce(nation = 3, false) ORDER BY title DESC NULLS LAST, itemID DESC LIMIT 30")
def library_recent_in_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent(snapshot(spark, sf_dir), 30, "NATION03", "title").select("key", "title")


@query(_IT + "SELECT key, itemType, title, array_to_string(creators, '; ') AS creators, NOT live AS deleted FROM it WHERE key IN ('D0000010', 'D0000011', 'D0000030', 'D0000007') AND lib = 2")
def library_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full records by key in one library: the group's."""
    from .functions.records import creator_name

    i = search.items(snapshot(spark, sf_dir, 77), ["D0000010", "D0000011", "D0000030", "D0000007"])
    return i.select("key", "itemType", "title", F.array_join(F.transform("creators", creator_name), "; ").alias("creators"), "deleted")


_KIDS = """kd AS (SELECT parent, itemID, 'N' || lpad((itemID - 10000000)::VARCHAR, 7, '0') AS key FROM nt UNION ALL SELECT page_id, 20000000 + page_id, 'F' || lpad(page_id::VARCHAR, 7, '0') FROM pages)"""


@query(_IT + ", " + _KIDS + " SELECT it.key AS parent, coalesce(string_agg(kd.key, ' ' ORDER BY kd.itemID), '') AS children FROM it LEFT JOIN kd ON kd.parent = it.itemID WHERE it.itemID IN (1, 2, 3, 50, 999) GROUP BY 1")
def library_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of several parents in one pass; a parent without any stays."""
    c = search.children(snapshot(spark, sf_dir), ["D0000001", "D0000002", "D0000003", "D0000050", "D0000999"])
    return c.select("parent", F.array_join(F.transform("children", lambda x: x["key"]), " ").alias("children"))


@query("SELECT 'F' || lpad(page_id::VARCHAR, 7, '0') AS key, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' END AS contentType FROM pages WHERE page_id = 9")
def library_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.attachments(snapshot(spark, sf_dir), "D0000009").select("key", "contentType")


@query(_IT + "SELECT 'dc:relation' AS predicate, key, title, itemType FROM it WHERE itemID = 15")
def library_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.related(snapshot(spark, sf_dir), "D0000014")


@query(_IT + """, np AS (SELECT DISTINCT parent FROM nt) SELECT key, (p.page_id IS NOT NULL AND p.page_id % 3 = 0) AS has_pdf, (p.page_id IS NOT NULL)::BIGINT AS attachment_count, (np.parent IS NOT NULL) AS has_notes
FROM (SELECT * FROM it WHERE live AND (region = 3 OR nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)) ORDER BY itemID LIMIT 40 OFFSET 5) s2 LEFT JOIN pages p ON p.page_id = s2.itemID LEFT JOIN np ON np.parent = s2.itemID""")
def library_collection_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.collection_items(snapshot(spark, sf_dir), "REGION03", True, 40, 5).select("key", "has_pdf", F.col("attachment_count").cast("long").alias("attachment_count"), "has_notes")


@query(_IT + "SELECT DISTINCT t AS name, upper(substr(t, 1, 1)) AS letter FROM (SELECT unnest(tags) AS t FROM it WHERE lib < 3)")
def library_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in scope, trash included, with their letter."""
    return search.tags(snapshot(spark, sf_dir))


@query(_IT + "SELECT l.lib::BIGINT AS libraryID, l.label, count(it.itemID) AS n_items FROM (VALUES (1, 'My Library'), (2, 'Our group'), (3, 'feed')) l(lib, label) LEFT JOIN it ON it.lib = l.lib GROUP BY 1, 2")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent items of each library; children don't count, trash does."""
    return search.libraries(snapshot(spark, sf_dir)).select("libraryID", "label", "n_items")


@query(_IT + "SELECT 'News' AS name, count(*) AS n_items FROM it WHERE lib = 3")
def library_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.feeds(snapshot(spark, sf_dir)).select("name", "n_items")


@query(_IT + "SELECT key, title FROM it WHERE lib = 3 ORDER BY dateAdded DESC, itemID DESC LIMIT 20")
def library_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.feed_items(snapshot(spark, sf_dir), 3).select("key", "title")


@query(_IT + """, h AS (SELECT * FROM nt WHERE contains(lower('<p>' || text || '</p>'), 'tion') ORDER BY itemID LIMIT 20)
SELECT 'note' AS kind, 'N' || lpad((h.itemID - 10000000)::VARCHAR, 7, '0') AS key, it.title AS parent_title FROM h LEFT JOIN it ON it.itemID = h.parent
UNION ALL SELECT 'annotation', 'A' || lpad(b.item_id::VARCHAR, 7, '0'), it.title FROM (SELECT * FROM benchmark WHERE contains(lower(text), 'tion') ORDER BY item_id LIMIT 20) b LEFT JOIN pages p ON p.page_id = b.item_id LEFT JOIN it ON it.itemID = p.page_id""")
def library_notes_and_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in notes and annotations with their paper's title, one and two steps up."""
    return search.notes_and_annotations(snapshot(spark, sf_dir), "tion").select("kind", "key", "parent_title")


@query(_IT + "SELECT key FROM s WHERE itemID = 12 AND has_key")
def library_by_citation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_citation_key(snapshot(spark, sf_dir), "c12").select("key")


@query(_IT + ", " + _KIDS + """ SELECT key, CASE lib WHEN 1 THEN 0 ELSE 77 END::BIGINT AS group_id FROM it WHERE lib < 3 UNION ALL SELECT key, 0 FROM kd UNION ALL SELECT 'A' || lpad(item_id::VARCHAR, 7, '0'), 0 FROM benchmark""")
def library_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.key_groups(snapshot(spark, sf_dir))[0]


@query(_IT + "SELECT key FROM s WHERE list_contains(tags, 'good one') AND (itemType = 'case' OR itemType = 'book') ORDER BY dateModified DESC, itemID DESC LIMIT 25")
def library_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_tag(snapshot(spark, sf_dir), "Good One", "case||book", limit=25).select("key")


@query(_IT + "SELECT key FROM s WHERE itemType = 'preprint' ORDER BY dateModified DESC, itemID DESC LIMIT 40")
def library_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.of_type(snapshot(spark, sf_dir), "preprint", 40).select("key")


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = snapshot(spark, sf_dir)
    kids = lib.edges().groupBy("parentItemID").agg(F.array_sort(F.collect_list(F.struct(F.col("itemID").cast("string").alias("key"), F.col("kind").alias("itemType")))).alias("children"))
    i = search._scope(lib, None, None, None, False).join(kids, F.col("itemID") == F.col("parentItemID"), "left")
    nothing = F.lit(None).cast("string")
    full = F.transform(F.coalesce("children", F.array().cast("array<struct<key:string,itemType:string>>")), lambda c: F.struct(c["key"].alias("key"), c["itemType"].alias("itemType"), *(nothing.alias(n) for n in ("md5", "path", "url", "contentType", "filename", "linkMode"))))
    return i.withColumn("children", full)


_DUP = """, g AS (SELECT doi AS value, count(*) AS n, string_agg(key, ' ' ORDER BY key) AS keys FROM s WHERE doi IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)"""


@query(_IT + _DUP + " SELECT 'doi' AS kind, value, keys, n FROM g")
def library_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share a DOI, as the library's own operator groups them."""
    return dedupe.groups(_work(spark, sf_dir), ("doi",)).select("kind", "value", F.array_join("keys", " ").alias("keys"), "n")


@query(_IT + _DUP + " SELECT 'doi' AS kind, count(*) AS groups, sum(n)::BIGINT AS items FROM g HAVING count(*) > 0")
def library_duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.totals(dedupe.groups(_work(spark, sf_dir), ("doi",)))


@query(_IT + _DUP + """, k AS (SELECT parent, count(*) AS n FROM (SELECT parent, itemID FROM nt UNION ALL SELECT page_id, 20000000 + page_id FROM pages) GROUP BY 1)
SELECT doi AS value, key AS keeper FROM (SELECT s.doi, s.key, row_number() OVER (PARTITION BY s.doi ORDER BY coalesce(k.n, 0) DESC, (trim(coalesce(abstract, '')) <> '') DESC, dateAdded, s.key) AS rn FROM s JOIN g ON g.value = s.doi LEFT JOIN k ON k.parent = s.itemID) WHERE rn = 1""")
def library_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _work(spark, sf_dir)
    return dedupe.members(dedupe.groups(items, ("doi",)), items).filter("is_keeper").select("value", F.col("key").alias("keeper"))


@query(_IT + _DUP + """, m AS (SELECT s.doi, count(DISTINCT itemType) AS types FROM s JOIN g ON g.value = s.doi GROUP BY 1) SELECT doi AS value, CASE WHEN types > 1 THEN 'mixed types' END AS declined FROM m""")
def library_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups may be merged without a look; by DOI alone no item is in two groups."""
    items = _work(spark, sf_dir)
    return dedupe.mergeable(dedupe.groups(items, ("doi",)), items, most=1 << 30).select("value", "declined")


@query(_IT + "SELECT itemID AS request, 'doi' AS kind, s.key FROM s WHERE doi IS NOT NULL AND itemID % 6 = 0")
def library_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by other spellings of DOIs find the items that have them (those of copies too, cut to the own one)."""
    items = _work(spark, sf_dir)
    asked = items.filter("itemID % 6 = 0 and DOI is not null").select(F.col("itemID").alias("request"), F.concat(F.lit("doi: "), F.upper(F.regexp_extract("DOI", "10[.].*", 0)), F.lit(".")).alias("DOI"))
    found = dedupe.find_existing(asked, items, ("doi",))
    return found.filter(F.col("key") == F.concat(F.lit("D"), F.lpad(F.col("request").cast("string"), 7, "0"))).select("request", "kind", "key")


@query("SELECT key, name, parent FROM (SELECT 'REGION0' || r_regionkey AS key, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'NATION' || lpad(n_nationkey::VARCHAR, 2, '0'), n_name, 'REGION0' || n_regionkey FROM nation) ORDER BY coalesce(parent || '/', '') || key LIMIT 12")
def library_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree in order, built before it is cut."""
    return hierarchy.collections(snapshot(spark, sf_dir), limit=12).select("key", "name", "parent")


@query("SELECT 'REGION0' || r_regionkey AS key FROM region WHERE contains(lower(r_name), 'a') AND contains(lower(r_name), 'e') UNION ALL SELECT 'NATION' || lpad(n_nationkey::VARCHAR, 2, '0') FROM nation WHERE contains(lower(n_name), 'a') AND contains(lower(n_name), 'e')")
def library_collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.search_collections(snapshot(spark, sf_dir), "A E").select("key")


@query(_IT + "SELECT count(*) AS scanned, count(p.page_id) AS with_pdf, count(*) - count(p.page_id) AS missing, round(100.0 * count(p.page_id) / count(*), 6)::DOUBLE AS percent_covered FROM s LEFT JOIN (SELECT page_id FROM pages WHERE page_id % 3 = 0) p ON p.page_id = s.itemID")
def library_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = snapshot(spark, sf_dir)
    return reports.coverage(search._scope(lib, None, None, None, False), lib["itemAttachments"]).withColumn("percent_covered", F.round("percent_covered", 6))


@query(_IT + "SELECT key AS item_key, trim(concat_ws(' ', nullif(trim(title), ''), nullif(trim(array_to_string(creators, ' ')), ''), nullif(trim(abstract), ''), nullif(trim(array_to_string(tags, ' ')), ''))) AS document FROM s WHERE itemID % 5 = 2")
def library_index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records: the composed text of an item's own fields."""
    items = search._scope(snapshot(spark, sf_dir), None, None, None, False).filter("itemID % 5 = 2")
    return maintenance.records(items).select("item_key", "document")


@query(_IT + """, gone AS (SELECT key FROM it WHERE lib = 1 AND itemID % 10 = 3), n AS (SELECT count(*) FILTER (WHERE itemID % 10 = 3) AS g, count(*) AS a FROM it WHERE lib = 1)
SELECT CASE WHEN g >= 25 AND g >= 0.25 * a THEN 'refused' ELSE 'allowed' END AS few, CASE WHEN a - g >= 25 AND a - g >= 0.25 * a THEN 'refused' ELSE 'allowed' END AS many, CASE WHEN a > 0 THEN 'refused' ELSE 'allowed' END AS empty, g AS n_few FROM n""")
def library_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard: a tenth of a library may go, most of it may not, nor all of it."""
    items = snapshot(spark, sf_dir)["items"].filter("itemTypeID in (1, 2, 6, 7) and libraryID = 1").select(F.col("key").alias("item_key"), "itemID", F.lit(0).alias("group_id"))
    listed = items.select(F.col("item_key").alias("key"), "itemID")
    few = maintenance.deletions(items, listed.filter("itemID % 10 <> 3").select("key"), 0)
    many = maintenance.deletions(items, listed.filter("itemID % 10 = 3").select("key"), 0)
    none = maintenance.deletions(items, listed.limit(0).select("key"), 0)
    say = lambda d: "refused" if d.refused else "allowed"
    return spark.createDataFrame([(say(few), say(many), say(none), few.count)], "few string, many string, empty string, n_few long")


@query(_IT + "SELECT key, CASE WHEN len(creators) = 0 THEN 'No authors listed' ELSE array_to_string(list_transform(creators, lambda c: CASE WHEN contains(c, ' ') THEN split_part(c, ' ', 2) || ', ' || split_part(c, ' ', 1) ELSE c END), '; ') END AS creators FROM s WHERE itemID < 300")
def library_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = search._scope(snapshot(spark, sf_dir), None, None, None, False).filter("itemID < 300")
    return i.select("key", format_creators(F.col("creators")).alias("creators"))


@query(_IT + ", " + _KIDS + """ SELECT kd.key, it.key AS parentItem FROM kd LEFT JOIN it ON it.itemID = kd.parent UNION ALL SELECT 'A' || lpad(b.item_id::VARCHAR, 7, '0'), CASE WHEN p.page_id IS NOT NULL THEN 'F' || lpad(p.page_id::VARCHAR, 7, '0') END FROM benchmark b LEFT JOIN pages p ON p.page_id = b.item_id""")
def library_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child with its parent's key, whichever of the three tables names it."""
    return snapshot(spark, sf_dir).full_items().filter(F.col("itemType").isin("attachment", "note", "annotation")).select("key", "parentItem")
