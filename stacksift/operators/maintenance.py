"""Keeping an index current: what changed, what may be deleted, upserts that shrink, watermarks.

Unknown is never empty: a listing that failed is None, and then nothing is deleted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import creator_name, format_creators
from ..functions.text import clean_html, page_of, passages

GUARD_ROWS, GUARD_SHARE = 25, 0.25
CHUNK = ("chunk_index", "n_chunks", "char_start", "char_end", "page")


def document_text() -> Column:
    """Title, creators, abstract, publication, tags and note of an item; blanks are dropped."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    creators = F.array_join(F.transform("creators", creator_name), " ")
    return F.concat_ws(" ", blank(F.col("title")), blank(creators), blank(F.col("abstractNote")), blank(F.col("publicationTitle")), blank(F.array_join(F.transform("tags", lambda t: t["tag"]), " ")), blank(clean_html(F.col("note"), True)))


def records(items: DataFrame, chunk_size: int | None = None, overlap: int = 200, most: int = 20) -> DataFrame:
    """Index records of items: one a document, or one a passage with id key#n.

    items: an item view with `note` and, if there is one, `fulltext`.
    """
    i = items if "note" in items.columns else items.withColumn("note", F.lit(None).cast("string"))
    body = F.concat_ws("\n\n", document_text(), F.nullif(F.col("fulltext"), F.lit(""))) if "fulltext" in i.columns else document_text()
    meta = i.select(
        F.col("key").alias("item_key"), "group_id", F.col("itemType").alias("item_type"), "title", "date", F.col("dateAdded").alias("date_added"), F.col("dateModified").alias("date_modified"),
        format_creators(F.col("creators")).alias("creators"), F.col("publicationTitle").alias("publication"), "url", F.col("DOI").alias("doi"), F.array_join(F.transform("tags", lambda t: t["tag"]), " ").alias("tags"), F.trim(body).alias("document"),
    ).filter("document <> ''")
    if chunk_size is None:
        return meta.withColumn("id", F.col("item_key"))
    p = meta.withColumn("_p", passages(F.col("document"), chunk_size, overlap, most)).withColumn("n_chunks", F.size("_p"))
    e = p.select("*", F.posexplode("_p").alias("chunk_index", "_c")).withColumn("page", page_of(F.trim("document"), F.col("_c.char_start")))
    e = e.withColumn("document", F.col("_c.passage")).withColumn("char_start", F.col("_c.char_start")).withColumn("char_end", F.col("_c.char_end"))
    return e.withColumn("id", F.concat_ws("#", "item_key", "chunk_index")).drop("_p", "_c")


@dataclass
class Deletions:
    """keys to delete, or why nothing may be."""

    keys: DataFrame | None
    refused: str | None
    count: int = 0


def deletions(index: DataFrame, current: DataFrame | None, group_id: int, allow: bool = False) -> Deletions:
    """Indexed items of one library that its listing no longer has.

    Refused: an unknown listing; an empty one against a non-empty index; 25 items and 25 % of the library or more,
    unless allowed. Records without a library are never touched.
    """
    if current is None:
        return Deletions(None, "unknown listing")
    own = index.filter(F.col("group_id") == group_id).select("item_key").distinct()
    gone = own.join(current.select(F.col("key").alias("item_key")).distinct(), "item_key", "left_anti")
    n, total = gone.count(), own.count()
    if total and current.isEmpty():
        return Deletions(None, "empty listing", n)
    if not allow and n >= GUARD_ROWS and n >= GUARD_SHARE * total:
        return Deletions(None, f"{n} of {total} would go", n)
    return Deletions(gone, None, n)


def rebuild_refused(index: DataFrame, group_id: int, limit: int | None = None) -> str | None:
    """A forced rebuild would lose other libraries' records, or all beyond a limit."""
    if limit is not None:
        return "a rebuild with a limit"
    foreign = index.filter(F.col("group_id").isNull() | (F.col("group_id") != group_id))
    return None if foreign.isEmpty() else "records of other libraries"


def delete_items(index: DataFrame, keys: DataFrame, group_id: int | None = None) -> DataFrame:
    k = keys.select("item_key").distinct()
    if group_id is None:
        return index.join(k, "item_key", "left_anti")
    return index.join(k.withColumn("group_id", F.lit(group_id).cast("long")), ["item_key", "group_id"], "left_anti")


def upsert(index: DataFrame, new: DataFrame, by_item: bool = True) -> DataFrame:
    """The index with the new records. By item, all old records of an item go, so passages beyond a shrunken
    document's last, and its bare record, don't stay. One rewrite, so no reader sees an item half done."""
    key = "item_key" if by_item else "id"
    rest = index.join(new.select(key).distinct(), key, "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)


def prune(index: DataFrame, kept: DataFrame) -> DataFrame:
    """kept: item_key, keep. Passages from the keep-th on go, and the bare record of a chunked item."""
    k = kept.select(F.col("item_key").alias("_k"), "keep")
    old = (F.col("chunk_index") >= F.col("keep")) | (F.col("chunk_index").isNull() & (F.col("keep") > 0))
    return index.join(k, F.col("item_key") == F.col("_k"), "left").filter(~F.coalesce(old, F.lit(False))).drop("_k", "keep")


def update_metadata(index: DataFrame, meta: DataFrame) -> DataFrame:
    """Columns of meta (by item_key) replace the index's; vectors stay."""
    cols = [c for c in meta.columns if c != "item_key"]
    m = meta.select("item_key", *(F.col(c).alias(f"_m_{c}") for c in cols), F.lit(True).alias("_hit"))
    j = index.join(m, "item_key", "left")
    return j.select(*(F.when(F.col("_hit"), F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in index.columns))


def backfill_groups(index: DataFrame, key_groups: DataFrame) -> DataFrame:
    """group_id from evidence where it is missing; without evidence it stays missing."""
    g = key_groups.groupBy("key").agg(F.min("group_id").alias("_g"), F.count_distinct("group_id").alias("_n")).filter("_n = 1").select(F.col("key").alias("_k"), "_g")
    return index.join(g, F.col("item_key") == F.col("_k"), "left").withColumn("group_id", F.coalesce("group_id", "_g")).drop("_k", "_g")


def decisions(index: DataFrame, items: DataFrame, priority: str | None = None, retry_failed: bool = False) -> DataFrame:
    """item_key and what to do with it: skip, add, update, delete, retry, reprioritise, attribute.

    items: key, group_id, dateModified, attachment_keys (joined text); index: one record an item.
    """
    d = index.select("item_key", "date_modified", F.col("attachment_keys").alias("had"), "attachment_priority", "has_fulltext", F.col("group_id").alias("of"), F.lit(True).alias("indexed")).dropDuplicates(["item_key"])
    s = items.select(F.col("key").alias("item_key"), F.col("dateModified").alias("now"), F.col("attachment_keys").alias("has"), F.lit(True).alias("present"))
    j = d.join(s, "item_key", "full")
    changed_priority = F.col("attachment_priority").isNotNull() & (F.col("attachment_priority") != F.lit(priority)) if priority else F.lit(False)
    what = (
        F.when(F.col("present").isNull() & F.col("of").isNull(), "skip")
        .when(F.col("present").isNull(), "delete")
        .when(F.col("indexed").isNull(), "add")
        .when(~F.col("had").eqNullSafe(F.col("has")), "update")
        .when(F.col("has_fulltext") == "failed", F.lit("retry" if retry_failed else "skip"))
        .when(F.coalesce(changed_priority, F.lit(False)), "reprioritise")
        .when(~F.col("date_modified").eqNullSafe(F.col("now")), "update")
        .when(F.col("of").isNull(), "attribute")
        .otherwise("skip")
    )
    return j.select("item_key", what.alias("decision"))


def sync_path(watermark: int | None, source: int | None) -> str:
    """full without a watermark or with one ahead of the source; none if they are equal; else incremental."""
    if watermark is None or source is None or watermark > source:
        return "full"
    return "none" if watermark == source else "incremental"


def changed_since(items: DataFrame, watermark: int) -> DataFrame:
    return items.filter(F.col("version") > watermark)


def promoted(watermark: int | None, source: int | None, complete: bool, deletion_skipped: bool, failed: int, limited: bool, forced: bool) -> int | None:
    """The new watermark: only a complete run whose deletions were done and that left no failures moves it."""
    if limited:
        return 0 if forced else watermark
    return source if complete and not deletion_skipped and not failed and source is not None else watermark


def snapshot_complete(snapshot_keys: DataFrame, listed: DataFrame | None) -> bool:
    return listed is not None and listed.select("key").join(snapshot_keys.select("key"), "key", "left_anti").isEmpty()


def packed(rows: DataFrame, run: str, most_rows: int, most_tokens: int, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """rows with `batch`: requests of a run in the order of ids, each within both limits.

    Greedy packing is sequential, so it runs in one task for each run; runs are what a caller submits at once.
    """
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        out, n, t, b = [], 0, 0, 0
        for tokens in pdf[tokens_col]:
            if n and (n + 1 > most_rows or t + tokens > most_tokens):
                n, t, b = 0, 0, b + 1
            n, t = n + 1, t + tokens
            out.append(b)
        return pdf.assign(batch=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(run).applyInPandas(pack, f"{fields}, batch int")


def current_runs(manifests: DataFrame) -> DataFrame:
    """The newest run of each library; older ones are superseded."""
    from pyspark.sql import Window

    order = Window.partitionBy("group_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return manifests.withColumn("superseded", F.row_number().over(order) > 1)


def imported(requests: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Batch results by id: vectors to commit, errors, ids that were never asked for, ids without a result."""
    r = results.select("id", "embedding", "error")
    return {
        "vectors": requests.join(r.filter("error is null"), "id"),
        "errors": r.filter("error is not null").join(requests.select("id"), "id", "left_semi"),
        "unknown": r.join(requests.select("id"), "id", "left_anti"),
        "missing": requests.join(r.select("id"), "id", "left_anti"),
    }


def committed(df: DataFrame, root: str) -> str:
    """Write a new version below root and then move the pointer to it; a reader sees one version or the other."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return version


def opened(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/current").first()["version"]
    return spark.read.parquet(f"{root}/{version}")


def status(index: DataFrame) -> DataFrame:
    """Counts over metadata alone: records, items, with and without full text, unattributed."""
    return index.agg(
        F.count("*").alias("records"), F.count_distinct("item_key").alias("items"), F.count_if(F.col("has_fulltext") == "true").alias("with_fulltext"),
        F.count_if(F.col("has_fulltext") == "failed").alias("failed"), F.count_if(F.col("group_id").isNull()).alias("unattributed"),
    )


def change_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("n")).orderBy("decision")
