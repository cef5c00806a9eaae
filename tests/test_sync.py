"""Inputs in many shapes, full texts, places of passages, merge rules and one run of an index update."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from library_fixture import key, library
from stacksift.functions import inputs, records
from stacksift.operators import dedupe, fulltext, hierarchy, maintenance, search, sync


def test_inputs():
    assert inputs.strings(None) == inputs.strings(" ") == [] and inputs.strings(["x ", "", 3]) == ["x", "3"] and inputs.strings('["p", "q"]') == ["p", "q"] and inputs.strings("p; q", ";") == ["p", "q"]
    assert inputs.numbers("[1, 2.5]", 2) == [1.0, 2.5] and inputs.numbers([1, True], 2) is None and inputs.numbers("[1", 1) is None and inputs.numbers([1], 2) is None
    assert inputs.tag_names('[{"name": "u"}, {"tag": " v "}, {"x": 1}]') == ["u", "v"] and inputs.tag_names("one") == ["one"] and inputs.tag_names(None) == []
    assert inputs.tags(["u", {"tag": "v", "type": 1}, {"tag": ""}]) == [{"tag": "u"}, {"tag": "v", "type": 1}]
    assert inputs.values_by("12, 34 x;12", str.isdigit) == (["12", "34"], ["x"]) and inputs.values_by("a, b", lambda s: s == "a, b") == (["a, b"], [])
    assert [inputs.library_id(x) for x in (None, "", "0", "User", 77, "77")] == [None, None, 0, 0, 77, 77]
    with pytest.raises(ValueError):
        inputs.library_id("feeds")
    assert inputs.item_type("JOURNALarticle", ["journalArticle", "book"]) == "journalArticle" and inputs.item_type("book", ["book"]) == "book" and inputs.item_type("novel", ["book"]) is None


@pytest.mark.parametrize("rule, last, due", [("manual", None, False), ("startup", "2026-01-02T00:00:00", True), ("daily", "2026-01-01T01:00:00", False), ("daily", None, True), ("every_3", "2025-12-29T00:00:00", True), ("every_3", "2025-12-31T00:00:00", False), ("every_x", None, False)])
def test_update_due(rule, last, due):
    now = datetime(2026, 1, 2)
    assert inputs.update_due({"auto_update": True, "update_frequency": rule, "last_update": last}, now) is due
    assert inputs.update_due({"update_frequency": rule, "last_update": last}, now) is False


def test_full_texts(spark):
    lib = library(spark)
    local = spark.createDataFrame([(key(7), "from the file"), (key(2), " ")], "key string, text string")
    served = spark.createDataFrame([(key(1), "x" * 50), (key(2), "y" * 9)], "key string, text string")
    got = {r["key"]: tuple(r)[1:] for r in fulltext.of_items(lib, [key(i) for i in (1, 2, 3, 8)], local, served, 6).collect()}
    assert got == {key(1): ("local", "from t", True, 13), key(2): ("server", "yyyyyy", True, 9), key(8): ("note", "First ", True, 21)} or got[key(8)][0] == "note"
    assert [r["key"] for r in fulltext.notes_of(lib, key(2)).collect()] == [r["key"] for r in fulltext.notes_of(lib, key(8), 3).collect()] == [key(8)]
    index = spark.createDataFrame([("K#0",), ("K#1",), ("L",)], "id string")
    assert [fulltext.index_metadata(index, k).count() for k in ("K", "L", "M")] == [1, 1, 0]


def test_find_on_pages(spark):
    body = ["alpha beta gamma delta " * 6, "The quick brown fox jumps over the lazy dog near the river bank. " + "filler " * 20, "omega " * 30, "Long opening words of the passage stand here exactly as they should " + "zz " * 60 + "and these are the closing words of that passage"]
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(body)], "doc long, page int, text string")
    long = "Long opening words of the passage stand here exactly as they should " + "but the middle was changed beyond all knowing by someone else entirely, " * 3 + "and these are the closing words of that passage"
    asked = [(1, 1, 2, "quick brown fox jumps"), (2, 1, 1, "the quack brown fax jumps over the lazy dog near the river"), (3, 1, 4, long), (4, 1, 4, "nothing like it here"), (5, 1, 5, "alpha beta gamma")]
    got = {r["request"]: (r["page"], r["how"]) for r in fulltext.find_on_pages(pages, spark.createDataFrame(asked, "request long, doc long, page int, passage string")).collect()}
    assert got[1] == (2, "exact") and got[2] == (2, "fuzzy") and got[3] == (4, "anchor") and got[4][1] == "none" and got[5][1] != "exact"


def test_merge_rule(spark):
    """Groups in order: a later one that shares an item with a merged one waits; one that shares with a declined one doesn't."""
    items = spark.createDataFrame([(k, "book", None) for k in "ABCDEFGH"] + [("X", "film", None)], "key string, itemType string, DOI string")
    groups = [("t", "1", ["A", "B"]), ("t", "2", ["B", "C"]), ("t", "3", ["C", "D"]), ("t", "4", ["A", "X"]), ("t", "5", ["E", "F"]), ("t", "6", ["G", "H"]), ("t", "7", ["F", "G"])]
    found = spark.createDataFrame(groups, "kind string, value string, keys array<string>")
    got = {r["value"]: r["declined"] for r in dedupe.mergeable(found, items).collect()}
    assert got == {"1": None, "2": "overlap", "3": None, "4": "mixed types", "5": None, "6": None, "7": "overlap"}
    few = {r["value"]: r["declined"] for r in dedupe.mergeable(found, items, 2).collect()}
    assert few == {"1": None, "2": "overlap", "3": None, "4": "mixed types", "5": "too many", "6": "too many", "7": "too many"}
    a, b = dedupe.plan_token(found), dedupe.plan_token(found.orderBy(F.desc("value")))
    assert a == b and len(a) == 12 and a != dedupe.plan_token(found.filter("value <> '1'"))


def test_update_run(spark):
    lib = library(spark)
    items = search._scope(lib, None, None, None, False).withColumn("attachment_keys", F.lit(None).cast("string"))
    prepare = lambda rows: maintenance.records(rows).select("item_key", "group_id", "document", "date_modified", F.lit(None).cast("string").alias("attachment_keys"), F.lit(None).cast("string").alias("attachment_priority"), F.lit("true").alias("has_fulltext"))
    empty = spark.createDataFrame([], "item_key string, group_id long, document string, date_modified string, attachment_keys string, attachment_priority string, has_fulltext string")
    listed = items.select("key")
    first = sync.update(empty, items, 0, prepare, source=5, listed=listed)
    n = items.count()
    assert first.path == "full" and first.counts == {"add": n} and first.watermark == 5 and first.index.count() == n
    again = sync.update(first.index, items, 0, prepare, source=6, watermark=5, listed=listed)
    assert again.path == "incremental" and again.counts == {} and again.watermark == 6
    assert sync.update(first.index, items, 0, prepare, source=5, watermark=5, listed=listed).path == "none"
    changed = items.withColumn("dateModified", F.when(F.col("key") == key(1), "2030").otherwise(F.col("dateModified"))).filter(F.col("key") != key(3))
    third = sync.update(first.index, changed, 0, prepare, source=7, watermark=5, listed=changed.select("key"))
    assert third.counts == {"update": 1, "delete": 1} and third.index.count() == n - 1 and third.index.filter("date_modified = '2030'").count() == 1
    unknown = sync.update(first.index, items, 0, prepare, source=7, watermark=5, listed=None)
    assert unknown.refused and unknown.watermark == 5 and unknown.index.count() == n
    limited = sync.update(empty, items, 0, prepare, source=5, listed=listed, limit=1)
    assert limited.index.count() == 1 and limited.watermark is None
    with pytest.raises(ValueError):
        sync.update(first.index.withColumn("group_id", F.lit(9).cast("long")), items, 0, prepare, force=True)
    marks = sync.save_watermarks(spark, {0: 5, 77: 2})
    assert sync.load_watermarks(spark, marks) == {0: 5, 77: 2} and sync.load_watermarks(spark, None, 3) == {0: 3} and sync.load_watermarks(spark, marks, 3) == {0: 5, 77: 2}


def test_records_of_cases_and_pages(spark):
    row = spark.createDataFrame([("A v. B", "", "High Court", {"issueDate": "2020", "date": ""}, "https://x.org/W12", "<i>On</i> A/B: tests &amp; more", [("Ann", "Léa")], [("", "Lea"), ("", "Roe")], " ", "2021")],
                                "t string, r string, c string, f map<string,string>, u string, q string, m array<struct<firstName:string,lastName:string>>, p array<struct<firstName:string,lastName:string>>, d string, pd string")
    c = {k: F.col(k) for k in row.columns}
    got = records.filled({"date": c["d"], "creators": c["m"]}, {"date": c["pd"], "creators": c["p"]})
    r = row.select(records.case_title(c["t"], c["r"], c["c"]).alias("case"), records.display_date(c["f"], F.lit("issueDate")).alias("date"), records.short_id(c["u"]).alias("id"), records.title_query(c["q"]).alias("query"),
                   records.names_all_of(c["p"], c["m"]).alias("all"), records.names_all_of(c["m"], c["p"]).alias("not_all"), got["date"].alias("filled"), F.size(got["creators"]).alias("n")).first()
    assert tuple(r) == ("A v. B (High Court)", "2020", "W12", "On A B tests more", True, False, "2021", 2)


def test_names_and_pages(spark):
    lib = library(spark)
    assert sorted(map(tuple, hierarchy.keys_of_names(lib, ["top", "SUB ", "none"]).collect())) == [("SUB ", "COLLSUB1"), ("top", "COLLTOP1")]
    make = lambda rows: spark.createDataFrame(rows, "key string, x int")
    assert sorted(map(tuple, search.merged([make([("a", 1), ("b", 1)]), make([("b", 2), ("c", 2), ("c", 2)])]).collect())) == [("a", 1), ("b", 1), ("c", 2)]
