"""Exact vector search over an index table, with metadata filters, rerank and grouping to the parent item."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..plans.conditions import where as compile_where


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "l2sq":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"unknown metric: {metric}")


def nearest(index: DataFrame, vector: Sequence[float], k: int, where: dict | str | None = None, where_document: str | None = None, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows with `distance` and `score` (1 - distance), ties by id; a top-k over one scan."""
    rows = index.filter(compile_where(where))
    if where_document:
        rows = rows.filter(F.col("document").contains(where_document))
    d = rows.withColumn("distance", distance(F.col(vector_col), F.array(*(F.lit(float(x)) for x in vector)), metric))
    return d.orderBy("distance", id_col).limit(k).withColumn("score", 1 - F.col("distance"))


def nearest_many(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", buckets: int = 64) -> DataFrame:
    """query_id, rank, id, distance for a table of queries.

    Queries are packed in arrays by bucket and meet the index by an equi-join, so neither side is broadcast; each
    query's best are kept by a window with a group limit.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv"))
    blocks = q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(buckets)).alias("block")).agg(F.collect_list(F.struct("query_id", "qv")).alias("qs"))
    spread = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    pairs = spread.join(blocks, "block").select("id", "v", F.explode("qs").alias("q"))
    d = pairs.select("q.query_id", "id", distance(F.col("v"), F.col("q.qv"), metric).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_score(query: str) -> Callable[[Column], Column]:
    """A scorer that needs no model: the share of the query's words that a document has."""
    words = sorted({w for w in query.lower().split() if w})

    def score(document: Column) -> Column:
        hits = sum((F.lower(document).contains(w).cast("double") for w in words), F.lit(0.0))
        return hits / max(1, len(words))

    return score


def rerank(hits: DataFrame, scorer: Callable[[Column], Column], k: int) -> DataFrame:
    """The k best by the scorer; equal scores keep their order of distance."""
    return hits.withColumn("rerank_score", scorer(F.col("document"))).orderBy(F.desc("rerank_score"), "distance", "id").limit(k)


def group_to_parent(hits: DataFrame, limit: int, order: list[Column] | None = None) -> DataFrame:
    """The best-ranked passage of each item, then the best items."""
    order = order or [F.col("distance").asc(), F.col("id").asc()]
    best = Window.partitionBy("item_key").orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n").orderBy(*order).limit(limit)


def semantic(index: DataFrame, vector: Sequence[float], query: str = "", limit: int = 10, where: dict | str | None = None, group_id: int | None = None, chunked: bool = True, scorer: Callable[[Column], Column] | None = None, multiplier: int = 3) -> DataFrame:
    """Over-fetch, drop rows without a document, rerank, group to items, add a snippet and its place."""
    spec = compile_where(where) if group_id is None else compile_where(where) & F.coalesce(F.col("group_id") == group_id, F.lit(False))
    fetch = max(limit, 4 * limit if chunked else 0, multiplier * limit if scorer else 0)
    hits = nearest(index.filter(spec), vector, fetch).filter("document is not null")
    order = None
    if scorer is not None:
        hits, order = rerank(hits, scorer, fetch), [F.desc("rerank_score"), F.col("distance").asc(), F.col("id").asc()]
    out = group_to_parent(hits, limit, order)
    return out.withColumn("_s", snippet(query, F.col("document"))).select("*", F.col("_s.snippet").alias("snippet"), (F.coalesce("char_start", F.lit(0)) + F.col("_s.start")).alias("snippet_start")).drop("_s")


def with_items(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Items by key and library; a hit without a library takes the item with the smallest one."""
    i = items.select("key", "group_id", F.struct(*items.columns).alias("item"))
    exact = hits.join(i.withColumnRenamed("key", "item_key"), ["item_key", "group_id"], "left")
    loose = i.groupBy("key").agg(F.min_by("item", F.coalesce("group_id", F.lit(-1))).alias("_any")).withColumnRenamed("key", "item_key")
    return exact.join(loose, "item_key", "left").withColumn("item", F.coalesce("item", F.when(F.col("group_id").isNull(), F.col("_any")))).drop("_any")


def embedded(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "document") -> DataFrame:
    """docs with `embedding` from an injected model; batches keep their order."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(embed(s.fillna("").tolist()))

    return docs.withColumn("embedding", run(column))
