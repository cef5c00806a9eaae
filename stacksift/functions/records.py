"""Names, dates, titles, tags and the Extra field: expressions over the columns of items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Annotation kinds and link modes by number: fixed values.
ANNOTATION_TYPES = {1: "highlight", 2: "note", 3: "image", 4: "ink", 5: "underline", 6: "text"}
LINK_MODES = {0: "imported_file", 1: "imported_url", 2: "linked_file", 3: "linked_url", 4: "embedded_image"}
#: Highlight colours: fixed values.
COLORS = {"#ffd400": "yellow", "#ff6666": "red", "#5fb236": "green", "#2ea8e5": "blue", "#a28ae5": "purple", "#e56eee": "magenta", "#f19837": "orange", "#aaaaaa": "gray"}


def lookup(col: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[col]


def color_category(col: Column) -> Column:
    return F.coalesce(lookup(F.lower(col), COLORS), F.lit("other"))


def creator_name(c: Column) -> Column:
    """first and last name with one blank; an organisation's single name."""
    return F.trim(F.concat_ws(" ", F.nullif(c["firstName"], F.lit("")), c["lastName"]))


def format_creators(creators: Column) -> Column:
    """'Last, First; ...' in order."""
    one = lambda c: F.when(F.coalesce(c["firstName"], F.lit("")) == "", c["lastName"]).otherwise(F.concat(c["lastName"], F.lit(", "), c["firstName"]))
    return F.when(F.size(F.coalesce(creators, F.array())) > 0, F.array_join(F.transform(creators, one), "; ")).otherwise("No authors listed")


def parse_creators(col: Column) -> Column:
    """Back from 'Last, First; ...'."""
    part = lambda x: F.struct(F.trim(F.substring_index(x, ",", 1)).alias("lastName"), F.when(F.instr(x, ",") > 0, F.trim(F.substring(x, F.instr(x, ",") + 1, F.length(x)))).otherwise("").alias("firstName"))
    return F.transform(F.filter(F.split(col, ";"), lambda x: F.trim(x) != ""), part)


def split_name(col: Column) -> Column:
    """A comma puts the last name first; else the last word is it."""
    s = F.trim(F.regexp_replace(col, r"\s+", " "))
    comma = F.instr(s, ",") > 0
    words = F.split(s, " ")
    last = F.when(comma, F.trim(F.substring_index(s, ",", 1))).otherwise(F.element_at(words, -1))
    first = F.when(comma, F.trim(F.substring(s, F.instr(s, ",") + 1, F.length(s)))).otherwise(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    return F.struct(first.alias("firstName"), last.alias("lastName"))


def date_display(col: Column) -> Column:
    """The display half of '<ISO, 00 for what is missing> <display>'."""
    return F.substring(col, F.instr(col, " ") + 1, F.length(col))


def date_range(col: Column) -> Column:
    return F.substring(col, 1, 10)


def date_year(col: Column) -> Column:
    return F.when(F.length(col) >= 4, F.substring(col, 1, 4))


def date_key(parsed: Column, display: Column) -> Column:
    """YYYY-MM-DD with 00 for what is missing; the first year of the display text without a parsed date; null
    without any date."""
    p, d = F.trim(F.coalesce(parsed, F.lit(""))), F.trim(F.coalesce(display, F.lit("")))
    year = F.regexp_extract(d, r"\b(\d{4})\b", 1)
    use = F.when(p != "", p).when(d == "", F.lit(None)).when(year != "", year).otherwise("0000")
    part = lambda i, n: F.lpad(F.coalesce(F.get(F.split(use, "-"), F.lit(i)), F.lit("00")), n, "0")
    return F.when(use.rlike(r"^\d+(-|$)"), F.concat_ws("-", part(0, 4), part(1, 2), part(2, 2)))


def iso_time(col: Column) -> Column:
    return F.concat(F.replace(col, F.lit(" "), F.lit("T")), F.lit("Z"))


def bibtex_date(year: Column, month: Column, day: Column) -> Column:
    """Year, and month by number or name, and day."""
    short = F.lower(F.substring(F.trim(month), 1, 3))
    number = F.coalesce(F.when(F.trim(month).rlike(r"^\d{1,2}$"), F.lpad(F.trim(month), 2, "0")), lookup(short, {m: f"{i + 1:02d}" for i, m in enumerate(_MONTHS)}))
    return F.concat_ws("-", F.trim(year), number, F.when(number.isNotNull() & F.trim(day).rlike(r"^\d{1,2}$"), F.lpad(F.trim(day), 2, "0")))


def csl_date(parts: Column) -> Column:
    """date-parts to a string; the first element alone is a year."""
    return F.array_join(F.transform(F.get(parts, F.lit(0)), lambda x, i: F.when(i > 0, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))), "-")


def display_title(item_type: Column, title: Column, note_title: Column, filename: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(item_type == "note", note_title).when(~blank(title), title).when(~blank(filename), filename).otherwise("Untitled")


def annotation_title(kind: Column, text: Column, comment: Column, most: int = 50) -> Column:
    """The quoted text and the comment, each cut; the kind of annotation without both."""
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)
    t, c = F.nullif(F.trim(text), F.lit("")), F.nullif(F.trim(comment), F.lit(""))
    both = F.concat_ws(" — ", F.concat(F.lit('"'), cut(t), F.lit('"')), cut(c))
    return F.when(both != "", both).otherwise(F.initcap(lookup(kind, ANNOTATION_TYPES)))


def citation_key_of_extra(extra: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(extra, r"(?im)^citation ?key:(.*)$", 1)), F.lit(""))


def doi_of_extra(extra: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(extra, r"(?im)^doi:(.*)$", 1)), F.lit(""))


def edit_extra(extra: Column, put: dict[str, str] | None = None, drop: list[str] | None = None) -> Column:
    """Lines 'Key: value': given keys are replaced in place or appended, dropped keys go, other lines stay."""
    key_of = lambda x: F.lower(F.when(F.instr(x, ":") > 0, F.substring_index(x, ":", 1)))
    lines = F.filter(F.split(F.coalesce(extra, F.lit("")), "\n"), lambda x: x != "")
    if drop:
        lines = F.filter(lines, lambda x: ~F.coalesce(key_of(x).isin(*(k.lower() for k in drop)), F.lit(False)))
    if put:
        new = F.create_map(*(F.lit(x) for k, v in put.items() for x in (k.lower(), f"{k}: {v}")))
        there = F.transform(lines, key_of)
        more = F.array(*(F.when(~F.coalesce(F.array_contains(there, k.lower()), F.lit(False)), F.lit(f"{k}: {v}")) for k, v in put.items()))
        lines = F.concat(F.transform(lines, lambda x: F.coalesce(new[key_of(x)], x)), F.array_compact(more))
    return F.array_join(lines, "\n")


def edit_tags(tags: Column, add: list[str] | None = None, remove: list[str] | None = None) -> Column:
    """array<struct<tag,type>>: removed names go first, then new names come as manual tags; kept tags keep their type."""
    kept = F.filter(tags, lambda t: ~t["tag"].isin(*remove)) if remove else tags
    if not add:
        return kept
    names = F.array_except(F.array(*map(F.lit, dict.fromkeys(add))), F.transform(kept, lambda t: t["tag"]))
    return F.concat(kept, F.transform(names, lambda n: F.struct(n.alias("tag"), F.lit(0).alias("type"))))


def page_index(position: Column) -> Column:
    return F.get_json_object(position, "$.pageIndex").try_cast("int")


def sort_index(page: Column, offset: Column, top: Column) -> Column:
    return F.format_string("%05d|%06d|%05d", page.cast("int"), offset.cast("int"), top.cast("int"))


def related_key(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"/items/([A-Z0-9]{8})$", 1), F.lit(""))


def relation_uri(root: str, group_id: Column, user_id: Column, key: Column) -> Column:
    base = F.when(F.coalesce(group_id, F.lit(0)) == 0, F.concat(F.lit("users/"), user_id.cast("string"))).otherwise(F.concat(F.lit("groups/"), group_id.cast("string")))
    return F.concat(F.lit(root), base, F.lit("/items/"), key)


def attachment_category(path: Column, content_type: Column) -> Column:
    p, t = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when((t == "application/pdf") | p.endswith(".pdf"), "pdf")
        .when(t.isin("text/html", "application/xhtml+xml") | p.rlike(r"\.x?html?$"), "html")
        .when((t == "text/markdown") | p.rlike(r"\.(md|markdown)$"), "markdown")
        .when(t.startswith("text/") | p.endswith(".txt"), "text")
    )


def attachment_path(key: Column, path: Column, storage: str, base: str | None = None) -> Column:
    """Where an attachment's file is: in the storage folder, below the linked base, or where it says."""
    stored = F.concat_ws("/", F.lit(storage), key, F.substring(path, 9, 1 << 20))
    linked = F.concat_ws("/", F.lit(base), F.substring(path, 13, 1 << 20)) if base else F.lit(None).cast("string")
    return F.when(path.startswith("storage:"), stored).when(path.startswith("attachments:"), linked).otherwise(path)


# Boxes are structs of x, y, w, h in shares of the page.


def _right(b: Column) -> Column:
    return b["x"] + b["w"]


def _bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(_right(a), _right(b)) - F.greatest(a["x"], b["x"]))
    return w * F.greatest(F.lit(0.0), F.least(_bottom(a), _bottom(b)) - F.greatest(a["y"], b["y"]))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    either = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(either > 0, both / either).otherwise(0.0)


def share_inside(a: Column, b: Column) -> Column:
    return F.when(a["w"] * a["h"] > 0, intersection(a, b) / (a["w"] * a["h"])).otherwise(0.0)


def union_box(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(_right(a), _right(b)) - x).alias("w"), (F.greatest(_bottom(a), _bottom(b)) - y).alias("h"))


def case_title(title: Column, reporter: Column, court: Column) -> Column:
    """A case's name with its reporter, else its court, in brackets; Untitled without a name."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    where = F.coalesce(given(reporter), given(court))
    return F.when(given(title).isNull(), "Untitled").when(where.isNull(), title).otherwise(F.concat(title, F.lit(" ("), where, F.lit(")")))


def display_date(fields: Column, own: Column) -> Column:
    """The value of the type's own date field (its name in `own`), else that of `date`, else ''."""
    return F.coalesce(F.nullif(fields[own], F.lit("")), F.nullif(fields["date"], F.lit("")), F.lit(""))


def short_id(uri: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(uri, "/", -1)


def title_query(title: Column) -> Column:
    """A title as words to search for: markup and punctuation go, white space is one blank."""
    from .identifiers import unescape

    bare = unescape(F.regexp_replace(F.coalesce(title, F.lit("")), r"<(/|\p{Alpha})[^<>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"[\p{P}\p{S}\s]+", " "))


def surnames(creators: Column) -> Column:
    """Folded last names, each once."""
    from .fold import fold

    return F.array_distinct(F.filter(F.transform(creators, lambda c: F.trim(fold(c["lastName"]))), lambda n: n != ""))


def names_all_of(creators: Column, others: Column) -> Column:
    """Whether the first list names everyone that the second names, and the second names someone."""
    theirs = surnames(others)
    return (F.size(theirs) > 0) & (F.size(F.array_except(theirs, surnames(creators))) == 0)


def filled(record: dict[str, Column], page: dict[str, Column]) -> dict[str, Column]:
    """The record's fields, blank ones from the page; the page's creators if the record has none, or if the page names
    all of the record's and more."""
    out = {k: F.coalesce(F.nullif(F.trim(c), F.lit("")), page[k]) if k in page else c for k, c in record.items() if k != "creators"}
    if "creators" in record:
        mine, theirs = record["creators"], page.get("creators", record["creators"])
        more = names_all_of(theirs, mine) & (F.size(theirs) > F.size(mine))
        out["creators"] = F.when((F.size(F.coalesce(mine, F.array())) == 0) | more, theirs).otherwise(mine)
    return out
