"""Edits as change sets: DataFrames of rows to write, applied by anti-join and union into a new table version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import edit_extra, edit_tags, relation_uri
from ..model import CHILD_TYPES, Library
from .hierarchy import collection_nodes, subtree

FIELD_NAMES = {"abstract": "abstractNote", "doi": "DOI", "isbn": "ISBN", "issn": "ISSN", "publication": "publicationTitle", "journal": "publicationTitle"}


def put(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those with equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), keys, "left_anti")


def parse_fields(given: str | dict, known: list[str]) -> dict[str, str]:
    """Field values by canonical name; an unknown name is an error."""
    rows = json.loads(given) if isinstance(given, str) else dict(given)
    names = {k.lower(): k for k in known} | FIELD_NAMES
    out = {}
    for k, v in rows.items():
        name = k if k in known else names.get(k.lower())
        if name is None or name not in known:
            raise ValueError(f"unknown field: {k}")
        out[name] = v
    return out


def update_fields(items: DataFrame, values: dict[str, str], valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, field, value to write, and key, field that the item's type doesn't have. valid: itemType, field."""
    spark = items.sparkSession
    v = spark.createDataFrame([(k, str(x)) for k, x in values.items()], "field string, value string")
    wanted = items.select("key", "itemType", F.explode(F.array(*map(F.lit, values))).alias("field")).join(F.broadcast(v), "field")
    ok = wanted.join(F.broadcast(valid), ["itemType", "field"], "left_semi")
    return ok.select("key", "field", "value"), wanted.join(F.broadcast(valid), ["itemType", "field"], "left_anti").select("key", "field")


def migrate_type(fields: DataFrame, new_type: str, valid: DataFrame, base: DataFrame) -> DataFrame:
    """key, field, value under a new type: fields of the same name stay, others go through their shared base field
    unless the target is filled, the rest goes. fields: key, itemType, field, value; base: itemType, base, field."""
    target = valid.filter(F.col("itemType") == new_type).select("field")
    same = fields.join(target, "field", "left_semi").select("key", "field", "value")
    left = fields.join(target, "field", "left_anti")
    to_base = left.join(base.select("itemType", "field", "base"), ["itemType", "field"])
    of_new = base.filter(F.col("itemType") == new_type).select("base", F.col("field").alias("new")).unionByName(target.select(F.col("field").alias("base"), F.col("field").alias("new")))
    moved = to_base.join(of_new, "base").groupBy("key", F.col("new").alias("field")).agg(F.min("value").alias("value"))
    return same.unionByName(moved.join(same.select("key", "field"), ["key", "field"], "left_anti"))


def batch_tags(items: DataFrame, add: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """key, tags, n_added, n_removed of the items that change."""
    new = items.select("key", "tags", edit_tags(F.col("tags"), add, drop).alias("new"))
    names = lambda c: F.transform(c, lambda t: t["tag"])
    out = new.select("key", F.col("new").alias("tags"), F.size(F.array_except(names("new"), names("tags"))).alias("n_added"), F.size(F.array_except(names("tags"), names("new"))).alias("n_removed"))
    return out.filter("n_added > 0 or n_removed > 0")


def batch_extra(items: DataFrame, values: dict[str, str] | None = None, drop: list[str] | None = None, replace: str | None = None) -> DataFrame:
    """key, extra, changed; child items are left out. A replacement excludes keys to drop."""
    if replace is not None and drop:
        raise ValueError("replace or remove, not both")
    new = F.lit(replace) if replace is not None else edit_extra(F.col("extra"), values, drop)
    return items.filter(~F.col("itemType").isin(*CHILD_TYPES)).select("key", new.alias("extra"), (new != F.coalesce("extra", F.lit(""))).alias("changed"))


def batch(items: DataFrame, add=None, drop=None, values=None, drop_keys=None) -> dict[str, DataFrame]:
    """Tag edits and Extra edits of one selection."""
    if not (add or drop or values or drop_keys):
        raise ValueError("nothing to change")
    out = {}
    if add or drop:
        out["tags"] = batch_tags(items, add, drop)
    if values or drop_keys:
        out["extra"] = batch_extra(items, values, drop_keys).filter("changed")
    return out


def summary(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count("*").alias("n")).orderBy(status)


def trash(items: DataFrame, allow_note: bool = False) -> DataFrame:
    """itemIDs for the trash; notes are refused unless allowed."""
    return (items if allow_note else items.filter("itemType <> 'note'")).select("itemID").distinct()


def move_collection(library: Library, key: str, parent: str | None) -> DataFrame:
    """key, parent; moving under itself or what is below it is refused."""
    nodes = collection_nodes(library)
    if parent is not None and not subtree(nodes, [key]).filter(F.col("node") == parent).isEmpty():
        raise ValueError("a collection can't move below itself")
    return library.spark.createDataFrame([(key, parent)], "key string, parent string")


def set_collections(bridge: DataFrame, items: DataFrame, add: list[int] | None = None, drop: list[int] | None = None) -> DataFrame:
    """The bridge (collectionID, itemID) after all adds and then all removals."""
    ids = items.select("itemID").distinct()
    for c in add or []:
        bridge = put(bridge, ids.select(F.lit(c).cast("long").alias("collectionID"), "itemID"), ["collectionID", "itemID"])
    for c in drop or []:
        bridge = remove(bridge, ids.select(F.lit(c).cast("long").alias("collectionID"), "itemID"), ["collectionID", "itemID"])
    return bridge


def missing_memberships(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present, ["collectionID", "itemID"], "left_anti")


def relate(pairs: DataFrame, predicate: str, root: str, user_id: int = 0) -> DataFrame:
    """itemID, predicate, object in both directions of pairs (itemID, key, group_id, itemID2, key2, group_id2); an
    item isn't related to itself."""
    j = pairs.filter("itemID <> itemID2")
    one = lambda i, g, k: j.select(F.col(i).alias("itemID"), F.lit(predicate).alias("predicate"), relation_uri(root, F.col(g), F.lit(user_id), F.col(k)).alias("object"))
    return one("itemID", "group_id2", "key2").unionByName(one("itemID2", "group_id", "key")).distinct()


def unrelate(relations: DataFrame, gone: DataFrame) -> DataFrame:
    return remove(relations, gone, ["itemID", "predicate", "object"])


def set_parent(edges: DataFrame, child: int, parent: int | None) -> DataFrame:
    """The edge table with a child's parent set, or cleared."""
    new = F.when(F.col("itemID") == child, F.lit(parent).cast("long")).otherwise(F.col("parentItemID"))
    return edges.withColumn("parentItemID", new)


def note_rows(table: DataFrame, action: str, rows: DataFrame) -> DataFrame:
    """create, update or delete of rows (itemID, parentItemID, note); append keeps the old text before the new."""
    if action == "create":
        return put(table, rows, ["itemID"])
    if action == "update":
        new = rows.select("itemID", F.col("note").alias("_n"))
        return table.join(new, "itemID", "left").withColumn("note", F.coalesce("_n", "note")).drop("_n")
    if action == "append":
        new = rows.select("itemID", F.col("note").alias("_n"))
        return table.join(new, "itemID", "left").withColumn("note", F.concat(F.coalesce("note", F.lit("")), F.coalesce("_n", F.lit("")))).drop("_n")
    if action == "delete":
        return remove(table, rows, ["itemID"])
    raise ValueError(f"unknown action: {action}")


annotation_rows = note_rows


def converge(wanted: DataFrame, found: DataFrame, policy: str = "skip") -> dict[str, DataFrame]:
    """What to create and what to add to existing items. wanted: request, tags, collections; found: request, key.

    duplicate creates all; skip creates what isn't there; file also adds tags and collections to what is.
    """
    if policy not in ("duplicate", "skip", "file"):
        raise ValueError(f"unknown policy: {policy}")
    if policy == "duplicate":
        return {"create": wanted, "file": wanted.limit(0)}
    best = found.groupBy("request").agg(F.min("key").alias("key"))
    hit = wanted.join(best, "request")
    return {"create": wanted.join(best, "request", "left_anti"), "file": hit if policy == "file" else hit.limit(0)}


def current(table_version: int, read_version: int) -> None:
    """Optimistic: what was planned on another version isn't written."""
    if table_version != read_version:
        raise RuntimeError("the table has changed since it was read")
