"""Reports over a library: coverage, digests, index statistics, bibliographies, joins with outside records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import doi_key
from ..functions.records import annotation_title, citation_key_of_extra, color_category, format_creators, page_index
from ..model import Library
from .search import annotations, item_doi


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def coverage(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """scanned, with_pdf, missing, percent_covered of parent items; attachments: parentItemID, contentType."""
    pdf = attachments.filter("contentType = 'application/pdf'").select(F.col("parentItemID").alias("itemID")).distinct().withColumn("pdf", F.lit(1))
    a = items.select("itemID").join(pdf, "itemID", "left").agg(F.count("*").alias("scanned"), F.count("pdf").alias("with_pdf"))
    return a.select("scanned", "with_pdf", (F.col("scanned") - F.col("with_pdf")).alias("missing"), percent(F.col("with_pdf"), F.col("scanned")).alias("percent_covered"))


def uncovered(items: DataFrame, attachments: DataFrame, limit: int = 50) -> DataFrame:
    pdf = attachments.filter("contentType = 'application/pdf'").select(F.col("parentItemID").alias("itemID"))
    return items.join(pdf, "itemID", "left_anti").orderBy("itemID").limit(limit)


def annotation_records(library: Library) -> DataFrame:
    """The flat contract of an annotation: keys, titles, type, page, text, comment, colour and its name."""
    a = annotations(library)
    return a.select(
        F.col("key").alias("annotation_key"), "paperID", "parent_title", F.col("type"), F.col("pageLabel").alias("page"), page_index(F.col("position")).alias("page_index"),
        "text", "comment", "color", color_category(F.col("color")).alias("color_category"), annotation_title(F.col("type"), F.col("text"), F.col("comment")).alias("title"), "sortIndex",
    )


def digest(library: Library) -> DataFrame:
    """One row a paper: its annotations in reading order and how many; papers by title. Titles that several papers
    share are marked, so that headings can tell them apart."""
    a = annotation_records(library).filter("paperID is not null")
    g = a.groupBy("paperID", "parent_title").agg(F.array_sort(F.collect_list(F.struct("sortIndex", "annotation_key", "text", "comment", "color_category"))).alias("annotations"), F.count("*").alias("n"))
    same = Window.partitionBy("parent_title")
    return g.withColumn("shared_title", F.count("*").over(same) > 1).orderBy("parent_title", "paperID")


def index_stats(index: DataFrame) -> dict[str, DataFrame]:
    """Counts by type, full text by type and by source, the titles with most passages."""
    full = F.count_if(F.col("has_fulltext") == "true")
    return {
        "by_type": index.groupBy("item_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_type").limit(20),
        "fulltext_by_type": index.groupBy("item_type").agg(F.count("*").alias("n"), full.alias("with_fulltext")).orderBy("item_type"),
        "by_source": index.groupBy("fulltext_source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fulltext_source"),
        "titles": index.groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(10),
    }


def in_library(outside: DataFrame, items: DataFrame, doi: str = "doi") -> DataFrame:
    """outside with `in_library`, by case-folded DOI; all library items that share a DOI count."""
    own = items.select(doi_key(item_doi()).alias("_d")).filter("_d is not null").distinct().withColumn("_hit", F.lit(True))
    return outside.withColumn("_k", doi_key(F.col(doi))).join(own, F.col("_k") == F.col("_d"), "left").withColumn("in_library", F.coalesce("_hit", F.lit(False))).drop("_k", "_d", "_hit")


def most_cited(outside: DataFrame, limit: int = 10) -> DataFrame:
    return outside.orderBy(F.desc_nulls_last("cited_by"), "doi").limit(limit)


def enriched(items: DataFrame, tallies: DataFrame, doi: str = "doi") -> DataFrame:
    """items with outside columns, by case-folded DOI."""
    t = tallies.withColumn("_k", F.lower(doi)).drop(doi)
    return items.withColumn("_k", doi_key(item_doi())).join(t, "_k", "left").drop("_k")


def retracted(items: DataFrame, notices: DataFrame) -> DataFrame:
    """All items whose DOI has a notice; several that share a DOI are all reported."""
    n = notices.withColumn("_k", F.lower("doi")).drop("doi")
    return items.withColumn("_k", doi_key(item_doi())).join(n, "_k").drop("_k")


def in_order_of(items: DataFrame, keys: list[str]) -> DataFrame:
    """items by key, in the caller's order."""
    order = items.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(keys))], "key string, pos int")
    return items.join(F.broadcast(order), "key").orderBy("pos")


def _entry_type(item_type: Column) -> Column:
    return (
        F.when(item_type.isin("journalArticle", "magazineArticle", "newspaperArticle"), "article")
        .when(item_type == "book", "book").when(item_type == "bookSection", "incollection").when(item_type == "conferencePaper", "inproceedings")
        .when(item_type == "thesis", "phdthesis").when(item_type == "report", "techreport").otherwise("misc")
    )


def bibtex(items: DataFrame) -> DataFrame:
    """key and a BibTeX entry of every item of an item view; fields without a value are left out."""
    names = F.array_join(F.transform(F.filter("creators", lambda c: c["creatorType"] == "author"), lambda c: F.when(c["firstName"] == "", c["lastName"]).otherwise(F.concat(c["lastName"], F.lit(", "), c["firstName"]))), " and ")
    escape = lambda c: F.regexp_replace(c, r"([&%$#_])", r"\\$1")
    year = F.nullif(F.substring("date", 1, 4), F.lit(""))
    lead = F.lower(F.regexp_replace(F.coalesce(F.get("creators", F.lit(0))["lastName"], F.lit("anon")), r"[^\p{L}]", ""))
    cite = F.coalesce(F.col("fields")["citationKey"], citation_key_of_extra(F.col("extra")), F.concat(lead, F.coalesce(year, F.lit("nd")), F.lit("_"), F.col("key")))
    place = F.when(_entry_type(F.col("itemType")).isin("incollection", "inproceedings"), "booktitle").otherwise("journal")
    line = lambda name, value: F.concat(F.lit("  "), name if isinstance(name, Column) else F.lit(name), F.lit(" = {"), F.nullif(value, F.lit("")), F.lit("}"))
    body = F.concat_ws(",\n", line("title", escape(F.col("title"))), line("author", names), line(place, escape(F.col("publicationTitle"))), line("year", year), line("doi", F.col("DOI")), line("url", F.col("url")), line("isbn", F.col("ISBN")))
    return items.select("key", F.concat(F.lit("@"), _entry_type(F.col("itemType")), F.lit("{"), cite, F.lit(",\n"), body, F.lit("\n}")).alias("bibtex"))


def rendered(items: DataFrame) -> DataFrame:
    """key and a few lines of text of every item."""
    line = lambda label, value: F.concat(F.lit(f"**{label}:** "), F.nullif(value, F.lit("")))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`"), t["tag"], F.lit("`"))), " ")
    return items.select("key", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))), line("Type", F.col("itemType")), line("Key", F.col("key")), line("Date", F.col("date")), line("Authors", format_creators(F.col("creators"))), line("Publication", F.col("publicationTitle")), line("DOI", F.col("DOI")), line("Tags", tags), F.col("abstractNote")).alias("text"))


def merge_regions(regions: DataFrame, page: str = "page", gap: float = 0.02) -> DataFrame:
    """Boxes of a page merged until none is within the gap of another: page, x, y, w, h, n.

    The fixpoint is sequential within a page, whose boxes are few.
    """
    import pandas as pd

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = [[r.x, r.y, r.x + r.w, r.y + r.h, 1] for r in pdf.sort_values(["y", "x"]).itertuples()]
        moved = True
        while moved:
            moved, out = False, []
            for b in boxes:
                for o in out:
                    if b[0] <= o[2] + gap and o[0] <= b[2] + gap and b[1] <= o[3] + gap and o[1] <= b[3] + gap:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]), o[4] + b[4]]
                        moved = True
                        break
                else:
                    out.append(b)
            boxes = out
        return pd.DataFrame([(pdf[page].iloc[0], b[0], b[1], b[2] - b[0], b[3] - b[1], b[4]) for b in boxes], columns=["page", "x", "y", "w", "h", "n"])

    return regions.groupBy(page).applyInPandas(merge, "page int, x double, y double, w double, h double, n int")


def captions(lines: DataFrame, regions: DataFrame, margin: float = 0.15) -> DataFrame:
    """Captions to regions of their page, one to one: the nearest below or above that overlaps, best pairs first; a
    pair is sure if it beats its next competitor by the margin."""
    import pandas as pd

    c = lines.filter(F.col("text").rlike(r"(?i)^\s*(fig(?:ure)?|table|scheme)\.?\s*\d+"))
    j = c.alias("c").join(regions.alias("r"), F.col("c.page") == F.col("r.page"))
    wide = F.greatest(F.lit(0.0), F.least(F.col("c.x") + F.col("c.w"), F.col("r.x") + F.col("r.w")) - F.greatest("c.x", "r.x")) / F.least("c.w", "r.w")
    far = F.greatest(F.lit(0.0), F.greatest(F.col("c.y") - (F.col("r.y") + F.col("r.h")), F.col("r.y") - (F.col("c.y") + F.col("c.h"))))
    scored = j.select(F.col("c.page").alias("page"), F.col("c.id").alias("caption"), F.col("r.id").alias("region"), (wide - far).alias("score")).filter("score > 0")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used_c, used_r, out = set(), set(), []
        for r in pdf.sort_values(["score", "caption", "region"], ascending=[False, True, True]).itertuples():
            if r.caption not in used_c and r.region not in used_r:
                rest = pdf[(pdf.caption == r.caption) & (pdf.region != r.region) & ~pdf.region.isin(used_r)].score
                out.append((r.page, r.caption, r.region, r.score, bool(rest.empty or r.score - rest.max() >= margin)))
                used_c.add(r.caption)
                used_r.add(r.region)
        return pd.DataFrame(out, columns=["page", "caption", "region", "score", "sure"])

    return scored.groupBy("page").applyInPandas(greedy, "page int, caption long, region long, score double, sure boolean")
