"""Collection trees. A tree's adjacency is a dimension; levels are joined until nothing is added, cycles end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.conditions import UnknownCollection


def paths(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """key, path (array of names, root first), depth. A missing parent or a cycle makes the path shorter.

    Pointers double in each round, so the rounds are the logarithm of the depth.
    """
    n = nodes.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(name).alias("n"))
    known = n.select(F.col("k").alias("_k"))
    state = n.join(known, F.col("p") == F.col("_k"), "left").select("k", F.col("_k").alias("up"), F.array(F.struct(F.col("k").cast("string").alias("k"), F.col("n").alias("n"))).alias("path"))
    while True:
        above = state.select(F.col("k").alias("uk"), F.col("up").alias("uup"), F.col("path").alias("upath"))
        seen = F.transform("path", lambda x: x["k"])
        ring = F.exists("upath", lambda x: F.array_contains(seen, x["k"]))
        j = state.join(above, F.col("up") == F.col("uk"), "left")
        longer = F.when(F.col("upath").isNull() | ring, F.col("path")).otherwise(F.concat("upath", "path"))
        held, state = state, j.select("k", F.when(~ring, F.col("uup")).alias("up"), longer.alias("path")).cache()
        done = state.filter("up is not null").isEmpty()
        held.unpersist()  # of the rounds, only the last one's rows stay
        if done:
            return state.select(F.col("k").alias(key), F.transform("path", lambda x: x["n"]).alias("path"), F.size("path").alias("depth"))


def subtree(nodes: DataFrame, roots: list, key: str = "key", parent: str = "parent") -> DataFrame:
    """The roots and all that hangs below, once each, with `root`; works through cycles."""
    found = nodes.filter(F.col(key).isin(*roots)).select(F.col(key).alias("root"), F.col(key).alias("node"))
    edges = nodes.select(F.col(parent).alias("_p"), F.col(key).alias("_c"))
    front = found
    while True:
        step = front.join(edges, F.col("node") == F.col("_p")).select("root", F.col("_c").alias("node")).distinct()
        front = step.join(found, ["root", "node"], "left_anti").cache()
        if front.isEmpty():
            front.unpersist()
            return found
        found = found.unionByName(front)


def collection_nodes(library) -> DataFrame:
    """key, name, parent (key), libraryID, deleted of every collection."""
    c = library["collections"]
    up = c.select(F.col("collectionID").alias("parentCollectionID"), F.col("key").alias("parent"))
    gone = library["deletedCollections"].select("collectionID", F.lit(True).alias("deleted")).distinct()
    return c.join(up, "parentCollectionID", "left").join(gone, "collectionID", "left").select("collectionID", "key", F.col("collectionName").alias("name"), "parent", "libraryID", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def collections(library, trashed: bool = False, limit: int | None = None) -> DataFrame:
    """The tree in order: siblings by key; built before it is cut."""
    nodes = collection_nodes(library)
    nodes = nodes if trashed else nodes.filter("not deleted")
    order = paths(nodes, "key", "parent", "key").withColumnRenamed("path", "place")
    out = nodes.join(order, "key").orderBy(F.array_join("place", "/"))
    return out if limit is None else out.limit(limit)


def subtree_keys(library, key: str, recursive: bool = True) -> list[str]:
    """The keys that count as a collection; a tree is a dimension, so they come to the driver."""
    nodes = collection_nodes(library)
    if nodes.filter(F.col("key") == key).isEmpty():
        raise UnknownCollection(key)
    return sorted(r["node"] for r in subtree(nodes, [key]).select("node").collect()) if recursive else [key]


def resolve(library, specs: list[str]) -> list[str]:
    """Live keys, or paths: the trailing names must match without regard to case, and one collection only."""
    nodes = collection_nodes(library).filter("not deleted")
    rows = nodes.join(paths(nodes, "key", "parent", "name"), "key").select("key", "path").collect()
    by_key, out = {r["key"] for r in rows}, []
    for spec in specs:
        if spec in by_key:
            out.append(spec)
            continue
        parts = [p.strip().lower() for p in spec.split("/") if p.strip()]
        hits = [r["key"] for r in rows if parts and [p.lower() for p in r["path"][-len(parts) :]] == parts]
        if len(hits) != 1:
            near = sorted("/".join(r["path"]) for r in rows if parts and parts[-1] in r["path"][-1].lower())
            raise UnknownCollection(f"{spec}: {'several match: ' + ', '.join(sorted(hits)) if hits else 'none; like it: ' + ', '.join(near[:5])}")
        out.append(hits[0])
    return list(dict.fromkeys(out))


def search_collections(library, query: str, trashed: bool = False) -> DataFrame:
    """Every word of the query is in the name."""
    nodes = collection_nodes(library)
    nodes = nodes if trashed else nodes.filter("not deleted")
    test: Column = F.lit(True)
    for word in query.lower().split():
        test = test & F.lower("name").contains(word)
    return nodes.filter(test).orderBy("name", "key")


def keys_of_names(library, names: list[str]) -> DataFrame:
    """name (as it was asked for) and the key of every live collection of that name, whatever the case."""
    asked = library.spark.createDataFrame([(n, n.strip().lower()) for n in dict.fromkeys(names)], "name string, _low string")
    nodes = collection_nodes(library).filter("not deleted").select("key", F.lower(F.trim("name")).alias("_low"))
    return asked.join(nodes, "_low").select("name", "key")
