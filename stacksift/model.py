"""The library as tables: base views of items, and the scopes over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHILD_TYPES = ("attachment", "note", "annotation")
TABLES = (
    "libraries", "groups", "items", "itemTypes", "fields", "itemData", "itemDataValues", "itemCreators", "creators", "creatorTypes", "itemTags", "tags",
    "itemNotes", "itemAttachments", "itemAnnotations", "itemRelations", "relationPredicates", "deletedItems", "deletedCollections", "collections",
    "collectionItems", "baseFieldMappingsCombined", "feeds", "feedItems",
)
#: Columns of the tables that are optional in a snapshot.
EMPTY = {
    "itemNotes": "itemID long, parentItemID long, note string", "itemAttachments": "itemID long, parentItemID long, linkMode int, contentType string, path string",
    "itemAnnotations": "itemID long, parentItemID long, type int, text string, comment string, color string, pageLabel string, sortIndex string, position string",
    "itemRelations": "itemID long, predicateID long, object string", "relationPredicates": "predicateID long, predicate string", "deletedItems": "itemID long",
    "deletedCollections": "collectionID long", "collectionItems": "collectionID long, itemID long", "itemTags": "itemID long, tagID long, type int", "tags": "tagID long, name string",
    "collections": "collectionID long, collectionName string, parentCollectionID long, libraryID long, key string",
    "groups": "groupID long, libraryID long, name string, description string, version long", "feeds": "libraryID long, name string, url string, lastCheck string",
    "feedItems": "itemID long, readTime string, translatedTime string", "baseFieldMappingsCombined": "itemTypeID int, baseFieldID int, fieldID int",
    "itemCreators": "itemID long, creatorID long, creatorTypeID int, orderIndex int", "creators": "creatorID long, firstName string, lastName string", "creatorTypes": "creatorTypeID int, creatorType string",
}


@dataclass
class Library:
    """A snapshot of tables, read once; every method gives a lazy DataFrame."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    group_id: int | None = None
    _views: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name in EMPTY:
            return self.spark.createDataFrame([], EMPTY[name])
        raise KeyError(name)

    def _view(self, name: str, make) -> DataFrame:
        if name not in self._views:
            self._views[name] = make()
        return self._views[name]

    def scoped(self, group_id: int | None) -> Library:
        """The same snapshot seen from one library: 0 is the personal one, None all users' and groups'."""
        return Library(self.spark, self.tables, group_id)

    def library_groups(self) -> DataFrame:
        """libraryID, type, group_id (0 personal, null for feeds and the like), label."""
        def make() -> DataFrame:
            g = self["groups"].select(F.col("libraryID").alias("_l"), "groupID", "name")
            j = self["libraries"].join(g, F.col("libraryID") == F.col("_l"), "left")
            gid = F.when(F.col("type") == "user", F.lit(0)).when(F.col("type") == "group", F.col("groupID")).cast("long")
            return j.select("libraryID", "type", gid.alias("group_id"), F.when(F.col("type") == "user", "My Library").otherwise(F.coalesce("name", F.col("type"))).alias("label"))

        return self._view("library_groups", make)

    def scope(self) -> DataFrame:
        """libraryIDs that searches see."""
        rows = self.library_groups().filter("group_id is not null")
        return rows if self.group_id is None else rows.filter(F.col("group_id") == self.group_id)

    def own(self, rows: DataFrame) -> DataFrame:
        """The rows (with libraryID) of the one library that is looked at; all, if it is none in particular."""
        return rows if self.group_id is None else rows.join(F.broadcast(self.scope().select("libraryID")), "libraryID", "left_semi")

    @staticmethod
    def _of(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
        """The side table's rows of the wanted items: filtered before they are grouped."""
        return rows if ids is None else rows.join(ids.select("itemID"), "itemID", "left_semi")

    def creators_of_items(self, ids: DataFrame | None = None) -> DataFrame:
        def make() -> DataFrame:
            j = self._of(self["itemCreators"], ids).join(self["creators"], "creatorID").join(self["creatorTypes"], "creatorTypeID", "left")
            one = F.struct("orderIndex", "creatorType", F.coalesce("firstName", F.lit("")).alias("firstName"), F.coalesce("lastName", F.lit("")).alias("lastName"))
            got = j.groupBy("itemID").agg(F.array_sort(F.collect_list(one)).alias("c"))
            return got.select("itemID", F.transform("c", lambda c: F.struct(c["creatorType"].alias("creatorType"), c["firstName"].alias("firstName"), c["lastName"].alias("lastName"))).alias("creators"))

        return self._view("creators", make) if ids is None else make()

    def tags_of_items(self, ids: DataFrame | None = None) -> DataFrame:
        def make() -> DataFrame:
            j = self._of(self["itemTags"], ids).join(self["tags"], "tagID")
            return j.groupBy("itemID").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("tag"), F.coalesce("type", F.lit(0)).alias("type")))).alias("tags"))

        return self._view("tags", make) if ids is None else make()

    def collections_of_items(self, ids: DataFrame | None = None) -> DataFrame:
        j = self._of(self["collectionItems"], ids).join(self["collections"].select("collectionID", "key"), "collectionID")
        return j.groupBy("itemID").agg(F.array_sort(F.collect_set("key")).alias("collections"))

    def relations_of_items(self, ids: DataFrame | None = None) -> DataFrame:
        j = self._of(self["itemRelations"], ids).join(self["relationPredicates"], "predicateID")
        one = j.groupBy("itemID", "predicate").agg(F.array_sort(F.collect_list("object")).alias("objects"))
        return one.groupBy("itemID").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "objects"))).alias("relations"))

    def fields_of_items(self, ids: DataFrame | None = None) -> DataFrame:
        """itemID and a map of field values under their base names: a type's own title field counts as title."""
        def make() -> DataFrame:
            base = self["baseFieldMappingsCombined"].join(self["fields"].select(F.col("fieldID").alias("baseFieldID"), F.col("fieldName").alias("baseName")), "baseFieldID")
            base = base.select(F.col("itemTypeID").alias("_t"), F.col("fieldID").alias("_f"), "baseName")
            j = self._of(self["itemData"], ids).join(self["itemDataValues"], "valueID").join(self["fields"], "fieldID").join(self["items"].select("itemID", "itemTypeID"), "itemID")
            j = j.join(F.broadcast(base), (F.col("itemTypeID") == F.col("_t")) & (F.col("fieldID") == F.col("_f")), "left")
            names = F.array_distinct(F.array_compact(F.array("fieldName", "baseName")))
            flat = j.select("itemID", F.explode(names).alias("name"), "value", (F.col("baseName").isNotNull()).alias("mapped"))
            # a mapped field wins over one that has the base name itself
            best = flat.groupBy("itemID", "name").agg(F.max_by("value", F.struct("mapped", "value")).alias("value"))
            return best.groupBy("itemID").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))

        return self._view("fields", make) if ids is None else make()

    def live(self, df: DataFrame, key: str = "itemID") -> DataFrame:
        gone = self["deletedItems"].select(F.col("itemID").alias("_gone")).distinct()
        return df.join(gone, df[key] == gone["_gone"], "left_anti")

    def items_view(self, trashed: bool = True, ids: DataFrame | None = None) -> DataFrame:
        """One row an item: key, type, dates, fields, creators, tags, collections, library; arrays are on the row.

        ids: the items that are wanted (itemID); all side tables are cut to them before they are grouped.
        """
        def make() -> DataFrame:
            i = self._of(self["items"], ids).join(F.broadcast(self["itemTypes"]), "itemTypeID").join(F.broadcast(self.library_groups()), "libraryID", "left")
            for part in (self.fields_of_items(ids), self.creators_of_items(ids), self.tags_of_items(ids), self.collections_of_items(ids)):
                i = i.join(part, "itemID", "left")
            for name, kind in (("creators", "array<struct<creatorType:string,firstName:string,lastName:string>>"), ("tags", "array<struct<tag:string,type:int>>"), ("collections", "array<string>")):
                i = i.withColumn(name, F.coalesce(name, F.array().cast(kind)))
            value = lambda name: F.col("fields")[name]
            named = ("title", "abstractNote", "DOI", "publicationTitle", "url", "ISBN", "date", "extra", "language", "archiveID")
            return i.select("itemID", "key", F.col("typeName").alias("itemType"), "libraryID", "group_id", "label", "dateAdded", "dateModified", "fields", *(value(n).alias(n) for n in named), "creators", "tags", "collections")

        view = self._view("items", make) if ids is None else make()
        return view if trashed else self.live(view)

    def searchable(self) -> DataFrame:
        """Live parent items of the libraries in scope."""
        i = self.items_view(trashed=False).filter(~F.col("itemType").isin(*CHILD_TYPES))
        return i.join(F.broadcast(self.scope().select("libraryID")), "libraryID", "left_semi")

    def edges(self) -> DataFrame:
        """child itemID, parentItemID, kind; one table for attachments, notes and annotations."""
        parts = [self[t].select("itemID", "parentItemID", F.lit(k).alias("kind")) for t, k in (("itemAttachments", "attachment"), ("itemNotes", "note"), ("itemAnnotations", "annotation"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def full_items(self, ids: DataFrame | None = None) -> DataFrame:
        """items_view with the columns of attachments, notes and annotations, and the parent's key."""
        i = self.items_view(ids=ids).join(self["itemAttachments"].select("itemID", "linkMode", "contentType", "path"), "itemID", "left")
        i = i.join(self["itemNotes"].select("itemID", "note"), "itemID", "left")
        a = self["itemAnnotations"].select("itemID", F.col("type").alias("annotationType"), F.col("text").alias("annotationText"), F.col("comment").alias("annotationComment"), F.col("color").alias("annotationColor"), F.col("pageLabel").alias("annotationPageLabel"), F.col("sortIndex").alias("annotationSortIndex"), F.col("position").alias("annotationPosition"))
        i = i.join(a, "itemID", "left").join(self.edges().select("itemID", "parentItemID"), "itemID", "left")
        p = self["items"].select(F.col("itemID").alias("parentItemID"), F.col("key").alias("parentItem"))
        d = self["deletedItems"].select("itemID", F.lit(True).alias("deleted")).distinct()
        return i.join(p, "parentItemID", "left").join(self.relations_of_items(ids), "itemID", "left").join(d, "itemID", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def project(items: DataFrame, detail: str = "summary") -> DataFrame:
    """keys_only, summary or full."""
    from .functions.records import format_creators

    if detail == "keys_only":
        return items.select("key")
    if detail == "summary":
        return items.select("key", "itemType", "title", format_creators(F.col("creators")).alias("creators"), "date", F.transform("tags", lambda t: t["tag"]).alias("tags"))
    if detail == "full":
        return items
    raise ValueError(f"unknown detail: {detail}")


def envelope(df: DataFrame, command: str) -> DataFrame:
    """The rows as JSON texts {ok, command, data}."""
    return df.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(command).alias("command"), F.struct(*df.columns).alias("data"))).alias("value"))


def newest_first(col: str, tie: str, ascending: bool = False) -> list[Column]:
    return [F.col(col).asc_nulls_first(), F.col(tie).asc()] if ascending else [F.col(col).desc_nulls_last(), F.col(tie).desc()]
