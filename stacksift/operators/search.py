"""Searches over a library: keywords, conditions, tags, notes and annotations, citation keys, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import ascii_lower, ascii_lower_text, contains_any, fold, fold_text, variants
from ..functions.records import citation_key_of_extra, creator_name, doi_of_extra, format_creators
from ..functions.text import clean_html
from ..model import CHILD_TYPES, Library, newest_first
from ..plans.conditions import Condition, UnknownCollection, compile_all, item_type_filter, registry, tag_language
from .hierarchy import subtree_keys


def clamp(value, default: int, most: int) -> int:
    """Blank, unreadable or non-positive limits are the default; none is above the most."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return min(n, most) if n > 0 else default


def _tag_names() -> Column:
    return F.transform("tags", lambda t: t["tag"])


def _scope(library: Library, item_type: str | None, tag, collection: str | None, recursive: bool) -> DataFrame:
    items = library.searchable()
    if item_type:
        items = items.filter(item_type_filter(item_type, F.col("itemType")))
    rule = tag_language(tag, _tag_names()) if tag else None
    if rule is not None:
        items = items.filter(rule)
    if collection:
        items = items.filter(F.arrays_overlap("collections", F.array(*map(F.lit, subtree_keys(library, collection, recursive)))))
    return items


def keyword(library: Library, query: str, qmode: str = "titleCreatorYear", item_type: str | None = None, tag=None, collection: str | None = None, recursive: bool = False, limit: int = 100) -> DataFrame:
    """Items with a spelling of the query in title, date or a creator; in `everything` also abstract, tags, notes.

    The stored side isn't folded but for ASCII case. Newest change first. An unknown collection gives no rows.
    """
    try:
        items = _scope(library, item_type, tag, collection, recursive)
    except UnknownCollection:
        return library.searchable().limit(0)
    forms = [ascii_lower_text(v) for v in variants(query)]

    def has(col: Column) -> Column:
        return contains_any(col, forms)

    hit = has(F.col("title")) | has(F.col("date")) | F.exists("creators", lambda c: has(creator_name(c)) | has(c["lastName"]))
    if qmode == "everything":
        noted = library["itemNotes"].filter(has(F.col("note"))).select(F.coalesce("parentItemID", "itemID").alias("_n")).distinct()
        items = items.join(noted, F.col("itemID") == F.col("_n"), "left")
        hit = hit | has(F.col("abstractNote")) | F.exists(_tag_names(), has) | F.col("_n").isNotNull()
        return items.filter(hit).drop("_n").orderBy(*newest_first("dateModified", "itemID")).limit(limit)
    return items.filter(hit).orderBy(*newest_first("dateModified", "itemID")).limit(limit)


def advanced(library: Library, conditions: list[Condition], join_mode: str = "all", sort_by: str | None = None, direction: str = "asc", limit: int = 50, recursive: bool = False) -> DataFrame:
    """Items that meet all or any of the conditions; collections count directly, or with all below them."""
    subtrees = {c.value: subtree_keys(library, c.value, recursive) for c in conditions if c.field.lower() in ("collection", "collections")}
    rows = library.searchable().filter(compile_all(conditions, join_mode, registry(), subtrees))
    key = None
    if sort_by:
        key = {"creator": format_creators(F.col("creators")), "date": F.coalesce(F.nullif(F.substring("date", 1, 10), F.lit("")), F.lit(""))}.get(sort_by, F.coalesce(F.col(sort_by).cast("string"), F.lit("")) if sort_by in rows.columns else None)
        if key is None:
            raise ValueError(f"can't sort by {sort_by}")
        key = key.desc() if direction == "desc" else key.asc()
    return rows.orderBy(*([key] if key is not None else []), F.col("itemID").asc()).limit(clamp(limit, 50, 500))


def by_tag(library: Library, tag, item_type: str | None = None, collection: str | None = None, recursive: bool = False, limit: int = 10) -> DataFrame:
    return _scope(library, item_type, tag, collection, recursive).orderBy(*newest_first("dateModified", "itemID")).limit(limit)


def by_citation_key(library: Library, key: str) -> DataFrame:
    """The item whose field is the key; else the one that says so in a line of Extra."""
    items = library.searchable()
    own = F.col("fields")["citationKey"] == key
    line = citation_key_of_extra(F.col("extra")) == key
    rank = F.when(own, 0).when(line, 1)
    return items.filter(F.coalesce(own, F.lit(False)) | F.coalesce(line, F.lit(False))).orderBy(rank, "itemID").limit(1)


def by_text(library: Library, query: str, limit: int = 50) -> DataFrame:
    """Folded query in the item's composed text."""
    text = F.concat_ws("\n\n", "title", format_creators(F.col("creators")), "abstractNote", "extra", F.array_join(_tag_names(), " "))
    return library.searchable().filter(fold(text).contains(fold_text(query))).orderBy("itemID").limit(limit)


def cascade(library: Library, query: str, limit: int = 10, semantic=None) -> tuple[str, DataFrame]:
    """As typed; author and year; author; everything; then by vectors: the first that finds anything, and its name."""
    words = query.split()
    years = [w for w in words if w.isdigit() and len(w) == 4]
    names = [w for w in words if w not in years]
    tries = [("as typed", lambda: keyword(library, query, limit=limit))]
    if years and names:
        both = [Condition("creator", "contains", names[0]), Condition("year", "is", years[0])]
        tries.append(("author and year", lambda: advanced(library, both, limit=limit)))
    if names:
        tries.append(("author", lambda: advanced(library, [Condition("creator", "contains", names[0])], limit=limit)))
    tries.append(("everything", lambda: keyword(library, query, "everything", limit=limit)))
    if semantic is not None:
        tries.append(("semantic", lambda: semantic(query, limit)))
    for name, make in tries:
        found = make()
        if not found.isEmpty():
            return name, found
    return "none", found


def context(text: Column, query: str, before: int = 100, after: int = 200) -> Column:
    at = F.locate(query.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(before + len(query) + after)))


def notes(library: Library, query: str, limit: int = 20, complete: bool = False) -> DataFrame:
    """Notes with the query in their HTML and their clean text.

    The limit counts hits in the HTML, so those inside a tag take places; with `complete`, it counts clean hits.
    Searches of notes and annotations see all libraries.
    """
    text = clean_html(F.col("note"), True)
    clean = F.lower(text).contains(query.lower())
    hit = library.live(library["itemNotes"]).filter(ascii_lower(F.col("note")).contains(ascii_lower_text(query)))
    hit = (hit.filter(clean) if complete else hit).orderBy("itemID").limit(limit)
    named = _with_titles(library, hit.filter(clean), "parentItemID")
    return named.select(F.lit("note").alias("kind"), "itemID", "key", "parent_title", context(text, query).alias("context"))


def _with_titles(library: Library, rows: DataFrame, parent: str) -> DataFrame:
    keys = library["items"].select("itemID", "key")
    up = rows.select(F.col(parent).alias("itemID")).filter("itemID is not null").distinct()
    titles = library.items_view(ids=up).select(F.col("itemID").alias("_p"), F.coalesce("title", F.lit("Untitled")).alias("parent_title"))
    return rows.join(keys, "itemID").join(titles, F.col(parent) == F.col("_p"), "left").drop("_p")


def annotations(library: Library, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Annotations with the title of the paper two steps up; with a query, those with it in text or comment."""
    a = library.live(library["itemAnnotations"])
    if query:
        low = ascii_lower_text(query)
        a = a.filter(ascii_lower(F.coalesce("text", F.lit(""))).contains(low) | ascii_lower(F.coalesce("comment", F.lit(""))).contains(low))
    up = library["itemAttachments"].select(F.col("itemID").alias("parentItemID"), F.col("parentItemID").alias("paperID"))
    out = _with_titles(library, a.join(up, "parentItemID", "left"), "paperID").orderBy("itemID")
    return out if limit is None else out.limit(limit)


def notes_and_annotations(library: Library, query: str, limit: int = 20) -> DataFrame:
    a = annotations(library, query, limit)
    body = F.concat_ws(" ", "text", "comment")
    a = a.select(F.lit("annotation").alias("kind"), "itemID", "key", "parent_title", context(body, query).alias("context"))
    return notes(library, query, limit).unionByName(a)


def recent(library: Library, limit: int = 10, collection: str | None = None, sort: str = "dateAdded", direction: str = "desc") -> DataFrame:
    """Ids are ranked first, and only the page's rows are joined to the wide view."""
    if sort not in ("dateAdded", "dateModified", "title"):
        raise ValueError(f"can't sort by {sort}")
    n = clamp(limit, 10, 1000)
    if sort == "title" or collection:
        return _scope(library, None, None, collection, False).orderBy(*newest_first(sort, "itemID", direction == "asc")).limit(n)
    child = library["itemTypes"].filter(F.col("typeName").isin(*CHILD_TYPES)).select("itemTypeID")
    slim = library.live(library["items"]).join(F.broadcast(child), "itemTypeID", "left_anti").join(F.broadcast(library.scope().select("libraryID")), "libraryID", "left_semi")
    page = slim.orderBy(*newest_first(sort, "itemID", direction == "asc")).limit(n).select("itemID")
    return library.items_view(ids=F.broadcast(page)).orderBy(*newest_first(sort, "itemID", direction == "asc"))


def items(library: Library, keys: DataFrame | list[str], trashed: bool = True, full: bool = True) -> DataFrame:
    """Full records by key, of the one library that is looked at: a short list is a filter, a table a semi-join.

    The ids are found first, and side tables are read for those alone.
    """
    own = library.own(library["items"])
    own = own.filter(F.col("key").isin(*keys)) if isinstance(keys, list) else own.join(keys.select("key"), "key", "left_semi")
    ids = (own if trashed else library.live(own)).select("itemID")
    return library.full_items(ids) if full else library.items_view(ids=ids)


def of_type(library: Library, item_type: str, limit: int = 100, tag=None) -> DataFrame:
    rows = library.items_view(trashed=False).join(F.broadcast(library.scope().select("libraryID")), "libraryID", "left_semi").filter(item_type_filter(item_type, F.col("itemType")))
    rule = tag_language(tag, _tag_names()) if tag else None
    return (rows if rule is None else rows.filter(rule)).orderBy(*newest_first("dateModified", "itemID")).limit(limit)


def children(library: Library, keys: list[str]) -> DataFrame:
    """parent key and its live children in order; a parent without any has an empty array. One pass for all parents."""
    parents = library.own(library["items"]).filter(F.col("key").isin(*keys)).select(F.col("key").alias("parent"), F.col("itemID").alias("parentItemID"))
    kids = library.live(library.edges()).join(library["items"].select("itemID", "key"), "itemID").select("parentItemID", F.struct("itemID", "key", "kind").alias("child"))
    return parents.join(kids, "parentItemID", "left").groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children"))


def attachments(library: Library, key: str) -> DataFrame:
    """PDFs first, then by itemID; trashed ones out."""
    p = library.own(library["items"]).filter(F.col("key") == key).select(F.col("itemID").alias("parentItemID"))
    rows = library.live(library["itemAttachments"]).join(p, "parentItemID", "left_semi").join(library["items"].select("itemID", "key"), "itemID")
    return rows.orderBy((F.col("contentType") == "application/pdf").desc_nulls_last(), "itemID")


def pick_attachment(rows: DataFrame, priority: list[str], parent: str = "parentItemID") -> DataFrame:
    """One attachment a parent: the first category of the priority list, `other` for the rest, the largest in it."""
    from pyspark.sql import Window

    place = reduce(lambda c, kv: F.when(F.col("category") == kv[1], kv[0]).otherwise(c), enumerate(p for p in priority if p != "other"), F.lit(priority.index("other") if "other" in priority else None).cast("int"))
    order = Window.partitionBy(parent).orderBy("_place", F.desc_nulls_last("size"), "itemID")
    return rows.withColumn("_place", place).filter("_place is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_place", "_n")


def related(library: Library, key: str) -> DataFrame:
    """predicate, key of related items, once each."""
    from ..functions.records import related_key

    own = library.own(library["items"]).filter(F.col("key") == key).select("itemID")
    r = library["itemRelations"].join(own, "itemID", "left_semi").join(library["relationPredicates"], "predicateID").select("predicate", related_key(F.col("object")).alias("key"))
    r = r.filter("key is not null").distinct()
    ids = library.own(library["items"]).join(r.select("key"), "key", "left_semi").select("itemID")
    return r.join(library.items_view(ids=ids).select("key", "title", "itemType"), "key").select("predicate", "key", "title", "itemType")


def collection_items(library: Library, key: str, recursive: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """Live top-level items of a collection with what hangs below them: has_pdf, attachment_count, has_notes."""
    keys = subtree_keys(library, key, recursive)
    inside = library["collectionItems"].join(library["collections"].filter(F.col("key").isin(*keys)).select("collectionID"), "collectionID", "left_semi")
    top = library.own(library.items_view(trashed=False, ids=inside)).filter(~F.col("itemType").isin("annotation", "note"))
    a = library.live(library["itemAttachments"]).groupBy("parentItemID").agg(F.count("*").alias("attachment_count"), F.max(F.col("contentType") == "application/pdf").alias("has_pdf"))
    n = library.live(library["itemNotes"]).filter("parentItemID is not null").groupBy("parentItemID").agg(F.lit(True).alias("has_notes"))
    page = top.orderBy("itemID").offset(max(0, offset)).limit(limit)
    out = page.join(a.withColumnRenamed("parentItemID", "itemID"), "itemID", "left").join(n.withColumnRenamed("parentItemID", "itemID"), "itemID", "left")
    return out.fillna({"attachment_count": 0, "has_pdf": False, "has_notes": False}).orderBy("itemID")


def tags(library: Library, limit: int | None = None) -> DataFrame:
    """Distinct names in scope, trash included, with the letter that they are listed under."""
    i = library["items"].join(F.broadcast(library.scope().select("libraryID")), "libraryID", "left_semi").select("itemID")
    out = library["itemTags"].join(i, "itemID", "left_semi").join(library["tags"], "tagID").select("name").distinct()
    out = out.select("name", F.upper(F.substring("name", 1, 1)).alias("letter")).orderBy("name")
    return out if limit is None else out.limit(limit)


def libraries(library: Library) -> DataFrame:
    """Every library with its number of parent items; trash counts."""
    child = library["itemTypes"].filter(F.col("typeName").isin(*CHILD_TYPES)).select("itemTypeID")
    n = library["items"].join(F.broadcast(child), "itemTypeID", "left_anti").groupBy("libraryID").agg(F.count("*").alias("n_items"))
    return library.library_groups().join(n, "libraryID", "left").fillna({"n_items": 0}).orderBy("libraryID")


def feeds(library: Library) -> DataFrame:
    n = library["feedItems"].join(library["items"], "itemID").groupBy("libraryID").agg(F.count("*").alias("n_items"))
    return library["feeds"].join(n, "libraryID", "left").fillna({"n_items": 0}).orderBy("libraryID")


def feed_items(library: Library, library_id: int, limit: int = 20) -> DataFrame:
    i = library.items_view().filter(F.col("libraryID") == library_id).join(library["feedItems"], "itemID")
    return i.select("itemID", "key", "title", format_creators(F.col("creators")).alias("creators"), "dateAdded", "readTime").orderBy(*newest_first("dateAdded", "itemID")).limit(limit)


def key_groups(library: Library) -> tuple[DataFrame, DataFrame]:
    """key to group_id for users' and groups' items, and the keys that no library of those holds."""
    j = library["items"].join(F.broadcast(library.library_groups()), "libraryID", "left").select("key", "group_id")
    return j.filter("group_id is not null"), j.filter("group_id is null").select("key")


def item_doi() -> Column:
    return F.coalesce(F.nullif(F.trim("DOI"), F.lit("")), doi_of_extra(F.col("extra")))


def connector(library: Library, query: str, semantic=None, limit: int = 10) -> DataFrame:
    """id, title, url of the hits by vectors, or of `everything` without them."""
    found = semantic(query, limit) if semantic is not None else None
    if found is None or found.isEmpty():
        found = keyword(library, query, "everything", limit=limit)
    return found.select(F.col("key").alias("id"), "title", "url").limit(limit)


def merged(pages: list[DataFrame], key: str = "key") -> DataFrame:
    """Rows of several pages, once a key: the first page that has it wins."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_page", F.lit(i)) for i, p in enumerate(pages)])
    best = every.groupBy(key).agg(F.min("_page").alias("_first")).withColumnRenamed(key, "_key")
    return every.join(best, (F.col(key) == F.col("_key")) & (F.col("_page") == F.col("_first"))).drop("_key", "_first", "_page").dropDuplicates([key])
