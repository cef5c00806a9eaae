import pytest
from library_fixture import key, library
from pyspark.sql import functions as F

from stacksift.operators import changes, dedupe, hierarchy, maintenance, reports, search, vectors
from stacksift.plans.conditions import Condition, UnknownCollection


def ids(df):
    return sorted(r["itemID"] for r in df.select("itemID").collect())


@pytest.fixture(scope="module")
def lib(spark):
    return library(spark)


@pytest.mark.parametrize(
    "field, op, value, want",
    [
        ("creator", "contains", "muller", [1, 5]), ("creator", "is", "JÖRG MÜLLER", [1]), ("creator", "isNot", "Jorg Muller", [2, 3, 5]), ("creator", "doesNotContain", "muller", [2, 3]),
        ("title", "contains", "100%", [2]), ("title", "contains", "_", [2]), ("title", "is", "roe v. doe", [5]), ("title", "contains", "uber muller -", [1]),
        ("tag", "is", "DRAFT", [1, 2]), ("tag", "isNot", "draft", [4]), ("DOI", "isNot", "zzz", [1, 2, 3, 4, 5]), ("date", "isAfter", "2016-10-05", [1]),
        ("date", "contains", "october", [2]), ("year", "is", "1973", [5]), ("year", "isLessThan", "2000", [3, 5]), ("date", "isNot", "1999", [1, 2, 4, 5]), ("itemType", "is", "book", [3, 4]),
    ],
)
def test_conditions(lib, field, op, value, want):
    assert ids(search.advanced(lib, [Condition(field, op, value)])) == want


def test_all_and_any(lib):
    both = [Condition("itemType", "is", "book"), Condition("tag", "is", "ai")]
    assert ids(search.advanced(lib, both)) == [4]
    assert ids(search.advanced(lib, both, "any")) == [1, 3, 4]


def test_collections(lib):
    direct = [Condition("collection", "is", "COLLTOP1")]
    assert ids(search.advanced(lib, direct)) == [1]
    assert ids(search.advanced(lib, direct, recursive=True)) == [1, 2]
    with pytest.raises(UnknownCollection):
        search.advanced(lib, [Condition("collection", "is", "NOPE")])
    assert ids(search.keyword(lib, "study", collection="NOPE")) == []
    assert hierarchy.subtree_keys(lib, "COLLLPA1") == ["COLLLPA1", "COLLLPB1"]
    paths = {r["key"]: r["path"] for r in hierarchy.paths(hierarchy.collection_nodes(lib), "key", "parent", "name").collect()}
    assert paths["COLLSUB1"] == ["Top", "Sub"] and set(paths) == {"COLLTOP1", "COLLSUB1", "COLLLPA1", "COLLLPB1"}
    assert hierarchy.resolve(lib, ["top/sub", "COLLTOP1"]) == ["COLLSUB1", "COLLTOP1"]


def test_tags_and_keywords(lib):
    assert ids(search.by_tag(lib, ["ai OR draft", "-draft"])) == [4]
    assert ids(search.by_tag(lib, ["-draft"])) == [3, 4, 5]
    assert ids(search.keyword(lib, "Cladder Micus")) == [2] and ids(search.keyword(lib, "cladder-micus")) == [2]
    assert ids(search.keyword(lib, "2016-10")) == [2]
    assert ids(search.keyword(lib, "needle", "everything")) == [2]
    assert ids(search.keyword(lib.scoped(None), "group")) == [10]
    assert [r["itemID"] for r in search.by_citation_key(lib.scoped(77), "grp99").collect()] == [10]
    assert search.cascade(lib, "Müller 1973")[0] == "author and year"


def test_listings(lib):
    assert [r["itemID"] for r in search.recent(lib, 2).collect()] == [5, 4]
    assert [(r["libraryID"], r["n_items"]) for r in search.libraries(lib).collect()] == [(1, 6), (2, 1), (3, 1)]
    assert {r["parent"]: len(r["children"]) for r in search.children(lib, [key(1), key(3)]).collect()} == {key(1): 1, key(3): 0}
    assert [r["kind"] for r in search.notes_and_annotations(lib, "needle").orderBy("kind").collect()] == ["annotation", "note"]
    assert search.annotations(lib).first()["parent_title"].startswith("Über")
    assert [r["key"] for r in search.related(lib, key(1)).collect()] == [key(2)]
    assert "gone" in [r["name"] for r in search.tags(lib).collect()]
    assert reports.digest(lib).first()["n"] == 1
    assert reports.bibtex(lib.searchable().filter("itemID = 1")).first()["bibtex"].startswith("@article{müller2021_")
    page = search.collection_items(lib, "COLLTOP1").first()
    assert (page["attachment_count"], page["has_pdf"], page["has_notes"]) == (1, True, False)


def test_duplicates(spark):
    items = spark.createDataFrame(
        [("A", "journalArticle", "T one", "10.1/X".replace("10.1", "10.1234"), "", "2020", "", ["x"], [("k1", "attachment", "0", "pdf", "f", "m1", "", "")]), ("B", "journalArticle", "The T One", "doi:10.1234/x", "abs", "2019", "", ["y"], [("k2", "attachment", "0", "pdf", "f", "m1", "", ""), ("k3", "note", "", "", "", "", "", "")]), ("C", "book", "Other", None, "", "2018", "", [], [])],
        "key string, itemType string, title string, DOI string, abstractNote string, dateAdded string, extra string, t array<string>, children array<struct<key:string,itemType:string,linkMode:string,contentType:string,filename:string,md5:string,path:string,url:string>>",
    ).withColumn("tags", F.transform("t", lambda x: F.struct(x.alias("tag"), F.lit(1).alias("type")))).withColumn("collections", F.array(F.lit("c").cast("string"))).drop("t")
    g = dedupe.groups(items)
    assert sorted((r["kind"], r["keys"]) for r in g.collect()) == [("doi", ["A", "B"]), ("title", ["A", "B"])]
    plan = dedupe.plans(g.filter("kind = 'doi'"), items)
    p = plan.first()
    assert (p["keeper"], p["duplicates"], [t["tag"] for t in p["new_tags"]], p["children_to_move"], p["children_skipped"]) == ("B", ["A"], ["x"], [], ["k1"])
    assert [r["declined"] for r in dedupe.mergeable(g, items).orderBy("kind").collect()] == [None, "overlap"]
    assert [r["key"] for r in dedupe.apply(plan, dedupe.plan_token(plan))["trash"].collect()] == ["A"]
    with pytest.raises(ValueError):
        dedupe.apply(plan, "0" * 12)


def test_index_guards(spark):
    index = spark.range(100).select(F.concat(F.lit("k"), "id").alias("item_key"), F.lit(0).alias("group_id"))
    listed = lambda n: spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"))
    assert maintenance.deletions(index, None, 0).refused == "unknown listing"
    assert maintenance.deletions(index, listed(0), 0).refused == "empty listing"
    assert maintenance.deletions(index, listed(75), 0).refused and maintenance.deletions(index, listed(76), 0).keys.count() == 24
    assert maintenance.deletions(index, listed(75), 5).count == 0
    assert maintenance.sync_path(5, 4) == "full" and maintenance.sync_path(4, 4) == "none"
    assert maintenance.promoted(3, 9, True, False, 0, False, False) == 9 and maintenance.promoted(3, 9, True, True, 0, False, False) == 3


def test_upsert_shrinks(spark, tmp_path):
    old = spark.createDataFrame([("a#0", "a", 1), ("a#1", "a", 1), ("b", "b", 1)], "id string, item_key string, v int")
    new = spark.createDataFrame([("a#0", "a", 2)], "id string, item_key string, v int")
    maintenance.committed(maintenance.upsert(old, new), str(tmp_path))
    assert sorted((r["id"], r["v"]) for r in maintenance.opened(spark, str(tmp_path)).collect()) == [("a#0", 2), ("b", 1)]


def test_changes(spark):
    items = spark.createDataFrame([("A", "book", "x: 1\nother", [("t", 1)])], "key string, itemType string, extra string, tags array<struct<tag:string,type:int>>")
    e = changes.batch(items, ["n", "t"], None, {"x": "2", "y": "3"})
    assert e["extra"].first()["extra"] == "x: 2\nother\ny: 3"
    assert [(t["tag"], t["type"]) for t in e["tags"].first()["tags"]] == [("t", 1), ("n", 0)]


def test_vectors(spark):
    index = spark.createDataFrame([("a#0", "a", [1.0, 0.0], "alpha text", 0), ("a#1", "a", [0.9, 0.1], "beta", 0), ("b", "b", [0.0, 1.0], None, 0), ("c", "c", [0.5, 0.5], "gamma", None)], "id string, item_key string, embedding array<double>, document string, group_id int").withColumn("char_start", F.lit(None).cast("int"))
    assert [r["item_key"] for r in vectors.semantic(index, [1.0, 0.0], "alpha", 5).collect()] == ["a", "c"]
    assert [r["item_key"] for r in vectors.semantic(index, [1.0, 0.0], "alpha", 5, group_id=0).collect()] == ["a"]
    got = vectors.nearest_many(index, index.filter("id = 'b'"), 2, buckets=2).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "c"]
