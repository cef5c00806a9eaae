"""One run that brings an index up to date: what changed, what may go, upserts, and watermarks that move only after them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maintenance

WATERMARKS = "group_id long, version long"


def load_watermarks(spark: SparkSession, table: DataFrame | None, legacy: int | None = None) -> dict[int, int]:
    """Versions by library. A single version from before there were several is the personal library's."""
    known = {} if table is None else {r["group_id"]: r["version"] for r in table.groupBy("group_id").agg(F.max("version").alias("version")).collect()}
    return ({0: legacy} if legacy is not None and 0 not in known else {}) | known


def save_watermarks(spark: SparkSession, known: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(known.items()), WATERMARKS)


@dataclass
class Outcome:
    """The new index, counts by decision, the new watermark, and why nothing was deleted (if so)."""

    index: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    watermark: int | None = None
    refused: str | None = None
    path: str = "full"


def update(index: DataFrame, items: DataFrame, group_id: int, prepare: Callable[[DataFrame], DataFrame], source: int | None = None, watermark: int | None = None, listed: DataFrame | None = None, force: bool = False, limit: int | None = None, allow: bool = False) -> Outcome:
    """Update one library's part of an index.

    items: the library's items as an item view; prepare: from items to index records (with vectors, if the index has
    them). source, watermark: versions of the library now and at the last run; equal ones mean that nothing changed, a
    watermark ahead of the source that it can't be trusted, so all is looked at. listed: keys of the library now; None
    if the listing failed, and then nothing is deleted. A forced rebuild is refused where the index holds records of
    others; a limited run never deletes and never moves the watermark.
    """
    path = "full" if force else maintenance.sync_path(watermark, source)
    if force and (why := maintenance.rebuild_refused(index, group_id, limit)):
        raise ValueError(why)
    if path == "none":
        return Outcome(index, {}, watermark, None, path)
    own = index.filter(F.col("group_id") == group_id)
    rows = items if limit is None else items.orderBy("key").limit(limit)
    if force:
        chosen = rows.select(F.col("key").alias("item_key"), F.lit("add").alias("decision"))
    else:
        chosen = maintenance.decisions(own, rows).filter(F.col("decision").isin("add", "update", "retry", "reprioritise"))
    records = prepare(rows.join(chosen.select(F.col("item_key").alias("key")), "key", "left_semi"))
    new = maintenance.upsert(maintenance.delete_items(index, own, group_id) if force else index, records)
    counts = {r["decision"]: r["n"] for r in chosen.groupBy("decision").agg(F.count("*").alias("n")).collect()}
    gone = maintenance.Deletions(None, None)
    if limit is None and not force:
        gone = maintenance.deletions(own, listed, group_id, allow)
    if gone.keys is not None and gone.count:
        new = maintenance.delete_items(new, gone.keys, group_id)
        counts["delete"] = gone.count
    moved = maintenance.promoted(watermark, source, listed is not None, bool(gone.refused), 0, limit is not None, force)
    return Outcome(new, counts, moved, gone.refused, path)
