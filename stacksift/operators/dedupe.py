"""Duplicates: groups by equal match keys, keepers, reviewable merge plans and their application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import match_keys
from ..model import CHILD_TYPES

FIELDS = ("DOI", "ISBN", "title", "url", "archiveID", "extra")


def exploded_keys(items: DataFrame, kinds: tuple[str, ...], key: str = "key") -> DataFrame:
    named = {f: F.col(f) for f in FIELDS if f in items.columns}
    return items.select(key, F.explode(match_keys(named, kinds)).alias("k")).select(key, "k.kind", "k.value")


def groups(items: DataFrame, kinds: tuple[str, ...] = ("doi", "title"), key: str = "key") -> DataFrame:
    """kind, value, keys (sorted), n of every key that two items or more share. Not transitive: an item can be in
    several groups."""
    rows = items.filter(~F.col("itemType").isin(*CHILD_TYPES)) if "itemType" in items.columns else items
    g = exploded_keys(rows, kinds, key).groupBy("kind", "value").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))
    return g.filter("n >= 2").select("kind", "value", "keys", "n")


def totals(found: DataFrame) -> DataFrame:
    """kind, groups, items of the groups, by kind."""
    return found.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("n").alias("items"))


def page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return found.orderBy("kind", "value").offset(max(0, offset)).limit(limit)


def attachment_signature(a: Column) -> Column:
    """What identifies a file's content; null if nothing does."""
    some = F.coalesce(F.nullif(a["md5"], F.lit("")), F.nullif(a["path"], F.lit("")), F.nullif(a["url"], F.lit("")))
    parts = [F.coalesce(a[n].cast("string"), F.lit("")) for n in ("linkMode", "contentType", "filename", "md5", "path", "url")]
    return F.when(some.isNotNull(), F.concat_ws("\u0001", *parts))


def keeper_order() -> list[Column]:
    """Most children, an abstract, the oldest, the smallest key."""
    has = F.coalesce(F.trim("abstractNote"), F.lit("")) != ""
    return [F.desc(F.size("children")), has.desc(), F.coalesce(F.nullif("dateAdded", F.lit("")), F.lit("9999-99-99")).asc(), F.col("key").asc()]


def members(found: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of group members with `is_keeper`."""
    m = found.select("kind", "value", F.explode("keys").alias("key")).join(items, "key")
    order = Window.partitionBy("kind", "value").orderBy(*keeper_order())
    return m.withColumn("is_keeper", F.row_number().over(order) == 1)


def plans(found: DataFrame, items: DataFrame) -> DataFrame:
    """For each group: keeper, duplicates, tags and collections that the keeper gains, children that move, and
    attachments that the keeper has already. A tag that is manual on any duplicate is manual."""
    m = members(found, items)
    k = m.filter("is_keeper").select("kind", "value", F.col("key").alias("keeper"), F.col("tags").alias("kt"), F.col("collections").alias("kc"), F.filter(F.transform("children", attachment_signature), lambda s: s.isNotNull()).alias("have"))
    d = m.filter("not is_keeper").groupBy("kind", "value").agg(
        F.array_sort(F.collect_list("key")).alias("duplicates"), F.flatten(F.collect_list("tags")).alias("dt"), F.flatten(F.collect_list("collections")).alias("dc"), F.flatten(F.collect_list("children")).alias("ch")
    )
    j = k.join(d, ["kind", "value"])
    names = F.array_sort(F.array_except(F.array_distinct(F.transform("dt", lambda t: t["tag"])), F.concat(F.transform("kt", lambda t: t["tag"]), F.array(F.lit("")))))
    typed = F.transform(names, lambda n: F.struct(n.alias("tag"), F.when(F.exists("dt", lambda t: (t["tag"] == n) & (F.coalesce(t["type"], F.lit(0)) == 0)), 0).otherwise(1).alias("type")))
    known = lambda c: (c["itemType"] == "attachment") & F.coalesce(F.array_contains(F.col("have"), attachment_signature(c)), F.lit(False))
    return j.select(
        "kind", "value", "keeper", "duplicates", typed.alias("new_tags"), F.array_sort(F.array_except(F.array_distinct("dc"), "kc")).alias("new_collections"),
        F.transform(F.filter("ch", lambda c: ~known(c)), lambda c: c["key"]).alias("children_to_move"), F.transform(F.filter("ch", known), lambda c: c["key"]).alias("children_skipped"),
    )


def mergeable(found: DataFrame, items: DataFrame, most: int = 200) -> DataFrame:
    """groups with `declined`: mixed types, several DOIs, an item of an earlier group that is merged, or beyond the most.

    Groups count in the order of kind and value. A group that comes first for all of its items is merged; those that
    share an item with it aren't; the rest is looked at again. Each round is distributed, and settles the first group
    of every chain at least; groups without a shared item are settled in the first.
    """
    from ..functions.identifiers import doi_key

    m = found.select("kind", "value", F.explode("keys").alias("key")).join(items.select("key", "itemType", doi_key(F.col("DOI")).alias("doi")), "key")
    f = m.groupBy("kind", "value").agg(F.countDistinct("itemType").alias("types"), F.countDistinct("doi").alias("dois"), F.array_sort(F.collect_list("key")).alias("keys"))
    f = f.withColumn("why", F.when(F.col("types") > 1, "mixed types").when(F.col("dois") > 1, "different DOIs")).select("kind", "value", "keys", "why")
    place = F.struct("kind", "value").alias("place")
    left = f.filter("why is null").select(place, F.explode("keys").alias("key")).cache()
    rounds = [left.limit(0)]
    while not left.isEmpty():  # every round reads what the one before kept
        first = left.groupBy("key").agg(F.min("place").alias("first"))
        state = left.join(first, "key").groupBy("place").agg(F.min(F.col("place") == F.col("first")).alias("leads"))
        rounds.append(left.join(state.filter("leads"), "place", "left_semi").select("place", "key").cache())
        met = left.join(rounds[-1].select("key"), "key", "left_semi").select("place").distinct()
        left = left.join(met, "place", "left_anti").cache()
    merged = reduce(DataFrame.unionByName, rounds)
    kept = merged.select("place").distinct().orderBy("place").limit(most)
    taken = merged.join(kept, "place", "left_semi").groupBy("key").agg(F.min("place").alias("by"))
    shares = f.filter("why is null").select(place, F.explode("keys").alias("key")).join(taken, "key").filter(F.col("by") < F.col("place")).select("place").distinct().withColumn("shares", F.lit(True))
    out = f.withColumn("place", place).join(kept.withColumn("kept", F.lit(True)), "place", "left").join(shares, "place", "left")
    why = F.coalesce("why", F.when(F.col("kept"), F.lit(None).cast("string")).when(F.col("shares"), "overlap").otherwise("too many"))
    return out.select("kind", "value", "keys", F.when(F.col("why").isNotNull() | F.col("kept").isNull(), why).alias("declined"))


def plan_token(plan: DataFrame) -> str:
    """12 hexadecimal digits that change with the plan: rows are hashed where they are, their hashes in order once more."""
    row = F.sha2(F.to_json(F.struct(*sorted(plan.columns)), {"ignoreNullFields": "false"}), 256)
    return plan.select(row.alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h")).first()["h"][:12]


def apply(plan: DataFrame, token: str) -> dict[str, DataFrame]:
    """The change sets of a confirmed plan; raises if the plan isn't the one that was reviewed."""
    if plan_token(plan) != token:
        raise ValueError("the plan has changed since it was reviewed")
    return {
        "add_tags": plan.select(F.col("keeper").alias("key"), F.explode("new_tags").alias("t")).select("key", "t.tag", "t.type"),
        "add_collections": plan.select(F.col("keeper").alias("key"), F.explode("new_collections").alias("collection")),
        "move_children": plan.select(F.explode("children_to_move").alias("key"), F.col("keeper").alias("parent")),
        "trash": plan.select(F.explode("duplicates").alias("key")),
    }


def without_covered_preprints(items: DataFrame, key: str = "key") -> DataFrame:
    """Preprints go if a journal article shares their DOI or title."""
    k = exploded_keys(items.select(key, "itemType", *(f for f in FIELDS if f in items.columns)), ("doi", "title"), key).join(items.select(key, "itemType"), key)
    best = k.groupBy("kind", "value").agg(F.max(F.col("itemType") == "journalArticle").alias("published"))
    gone = k.filter("itemType = 'preprint'").join(best.filter("published"), ["kind", "value"]).select(key).distinct()
    return items.join(gone, key, "left_anti")


def find_existing(wanted: DataFrame, items: DataFrame, kinds: tuple[str, ...] = ("doi", "arxiv", "isbn")) -> DataFrame:
    """request and key of library items that share an identifier with a request."""
    w = wanted.select("request", F.explode(match_keys({f: F.col(f) for f in FIELDS if f in wanted.columns}, kinds)).alias("k")).select("request", "k.kind", "k.value")
    return w.join(exploded_keys(items, kinds), ["kind", "value"]).select("request", "kind", "value", "key").distinct()


def first_of_each(rows: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """rows with `first_pos`, the position of the first row with the same key; null keys stand alone."""
    same = Window.partitionBy("_k")
    marked = rows.withColumn("_k", F.coalesce(key, F.concat(F.lit("\u0000"), F.col(pos).cast("string"))))
    return marked.withColumn("first_pos", F.min(pos).over(same)).drop("_k")
