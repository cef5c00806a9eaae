"""Full texts of items: the best source of each, cut with a note of what was cut, and places of a passage on pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_html, dynamic_threshold, fuzzy_window, matching_form
from ..model import Library

#: Characters of an anchor, and of what it may be moved to end on a word.
ANCHOR, MOVE = 40, 15


def cut(text: Column, most: int) -> Column:
    """struct(text, truncated, total): the first `most` characters, and how many there are."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"), F.length(text).alias("total"))


def of_items(library: Library, keys: list[str], extracted: DataFrame, served: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """key, source, text, truncated, total for each key that has any text.

    A note is its own text. Otherwise the local extraction (key, text) of the item or of its attachments comes first,
    then what a server had (key, text); blank texts don't count. Of several attachments the longest text is taken.
    """
    wanted = library.own(library["items"]).filter(F.col("key").isin(*keys)).select("itemID", "key")
    note = library["itemNotes"].join(wanted, "itemID").select("key", F.lit(0).alias("rank"), F.lit("note").alias("source"), clean_html(F.col("note"), True).alias("text"))
    files = library["itemAttachments"].join(wanted.withColumnRenamed("itemID", "parentItemID"), "parentItemID").select("key", "itemID")
    files = files.join(library["items"].select("itemID", F.col("key").alias("file")), "itemID").select("key", "file").unionByName(wanted.select("key", F.col("key").alias("file")))

    def texts(rows: DataFrame, rank: int, name: str) -> DataFrame:
        return files.join(rows.select(F.col("key").alias("file"), "text"), "file").select("key", F.lit(rank).alias("rank"), F.lit(name).alias("source"), "text")

    every = note.unionByName(texts(extracted, 1, "local"))
    if served is not None:
        every = every.unionByName(texts(served, 2, "server"))
    best = every.filter(F.trim("text") != "").groupBy("key").agg(F.min_by(F.struct("source", "text"), F.struct("rank", -F.length("text"), "text")).alias("b"))
    return best.select("key", "b.source", cut(F.col("b.text"), most).alias("c")).select("key", "source", "c.text", "c.truncated", "c.total")


def notes_of(library: Library, key: str, most: int = 500) -> DataFrame:
    """Notes below an item, or the note itself, by itemID: key, text (cut), truncated."""
    one = library.own(library["items"]).filter(F.col("key") == key).select(F.col("itemID").alias("_i"))
    rows = library.live(library["itemNotes"]).join(one, (F.col("parentItemID") == F.col("_i")) | (F.col("itemID") == F.col("_i")), "left_semi")
    text = clean_html(F.col("note"), True)
    return rows.join(library["items"].select("itemID", "key"), "itemID").select("itemID", "key", cut(text, most).alias("c")).select("itemID", "key", "c.text", "c.truncated").orderBy("itemID")


def index_metadata(index: DataFrame, key: str) -> DataFrame:
    """The record of an item, whole or its first passage."""
    return index.filter(F.col("id").isin(key, f"{key}#0")).orderBy("id").limit(1)


def anchors(passage: Column) -> Column:
    """struct(start, end): the first and the last ANCHOR characters or so, ending on a word within MOVE characters."""
    n = F.length(passage)
    head, tail = F.substring(passage, 1, ANCHOR + MOVE), F.when(n > ANCHOR + MOVE, F.substring(passage, -(ANCHOR + MOVE), ANCHOR + MOVE)).otherwise(passage)
    whole_head = F.regexp_extract(head, rf"^(.{{{ANCHOR - MOVE},}})\s", 1)
    whole_tail = F.regexp_extract(tail, rf"\s(.{{{ANCHOR - MOVE},}})$", 1)
    either = lambda whole, plain: F.when((whole != "") & (n > ANCHOR), F.trim(whole)).otherwise(F.trim(plain))
    return F.struct(either(whole_head, F.substring(head, 1, ANCHOR)).alias("start"), either(whole_tail, F.substring(tail, -ANCHOR, ANCHOR)).alias("end"))


def find_on_pages(pages: DataFrame, asked: DataFrame, near: int = 2) -> DataFrame:
    """request, page, how (exact, fuzzy, anchor or none), score: where a passage stands.

    pages: doc, page, text; asked: request, doc, page (where it is thought to be), passage. The page itself and `near`
    pages to either side are looked at. An exact place in the matching form wins; then the best window whose ratio
    reaches the threshold of its length; then, for passages of more than 100 characters, the first page that has both
    anchors, or one of them. Ties go to the nearer page, then to the smaller one. Without any, the best ratio is a
    suggestion (`none`).
    """
    p = pages.select("doc", F.col("page").alias("at"), matching_form(F.col("text")).alias("body"))
    a = asked.select("request", "doc", F.col("page").alias("said"), matching_form(F.col("passage")).alias("want"), anchors(F.col("passage")).alias("ends"))
    a = a.select("request", "doc", "said", "want", matching_form(F.col("ends.start")).alias("head"), matching_form(F.col("ends.end")).alias("tail"), dynamic_threshold(F.length("want")).alias("least"))
    both = a.join(p, "doc").filter(F.abs(F.col("at") - F.col("said")) <= near)

    @F.pandas_udf("double")
    def ratio(body: pd.Series, want: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([1.0 if e else fuzzy_window(b or "", w or "")[0] for b, w, e in zip(body, want, exact, strict=True)])

    exact = F.col("body").contains(F.col("want")) & (F.col("want") != "")
    has = lambda c: (F.col("body").contains(F.col(c)) & (F.col(c) != "")).cast("int")
    scored = both.withColumn("exact", exact).withColumn("score", ratio("body", "want", "exact")).withColumn("ends", F.when(F.length("want") > 100, has("head") + has("tail")).otherwise(0))
    how = F.when(F.col("exact"), "exact").when(F.col("score") >= F.col("least"), "fuzzy").when(F.col("ends") > 0, "anchor").otherwise("none")
    rank = F.when(how == "exact", 0).when(how == "fuzzy", 1).when(how == "anchor", 2).otherwise(3)
    best = Window.partitionBy("request").orderBy("rank", F.when(F.col("rank") == 2, -F.col("ends")).otherwise(-F.col("score")), F.abs(F.col("at") - F.col("said")), "at")
    ranked = scored.withColumn("how", how).withColumn("rank", rank).withColumn("n", F.row_number().over(best)).filter("n = 1")
    return ranked.select("request", F.col("at").alias("page"), "how", F.round("score", 6).alias("score"))
