"""Conditions over items as Columns: ten operators, three rules of negation, the tag language, metadata filters."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fold import fold, fold_text
from ..functions.records import creator_name, date_display, date_range, date_year

NEGATED = {"isNot": "is", "doesNotContain": "contains"}
RANGES = {"isGreaterThan": ">", "isAfter": ">", "isLessThan": "<", "isBefore": "<"}
OPERATORS = ("is", "isNot", "contains", "doesNotContain", "beginsWith", "endsWith", *RANGES)
ALIASES = {
    "author": "creator", "authors": "creator", "creators": "creator", "tags": "tag", "collections": "collection",
    "itemtype": "itemType", "dateadded": "dateAdded", "datemodified": "dateModified", "doi": "DOI",
}
_NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


class UnknownField(ValueError):
    pass


class UnknownCollection(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    field: str
    operation: str
    value: str

    def __post_init__(self):
        if self.operation not in OPERATORS:
            raise ValueError(f"unknown operation: {self.operation}")


def canonical_field(field: str) -> str:
    return ALIASES.get(field.lower(), field)


def _in_order(col: Column, value: str, sign: str) -> Column:
    """Range operators don't fold; they compare numbers if both sides are, else text."""
    text = col > value if sign == ">" else col < value
    if not re.match(_NUMBER, value):
        return text
    number = col.try_cast("double") > float(value) if sign == ">" else col.try_cast("double") < float(value)
    return F.when(col.rlike(_NUMBER), number).otherwise(text)


def compare(col: Column, operation: str, value: str) -> Column:
    """One value against one expectation; both sides are folded but for ranges. Patterns are literal."""
    if operation in NEGATED:
        return ~compare(col, NEGATED[operation], value)
    if operation in RANGES:
        return _in_order(col, value, RANGES[operation])
    left, right = fold(col), fold_text(value)
    return {"is": lambda: left == right, "contains": lambda: left.contains(right), "beginsWith": lambda: left.startswith(right), "endsWith": lambda: left.endswith(right)}[operation]()


def scalar(col: Column, operation: str, value: str) -> Column:
    """A missing single value counts as '', so negated operators hold for it; ranges don't."""
    if operation in RANGES:
        return F.coalesce(compare(col, operation, value), F.lit(False))
    return compare(F.coalesce(col.cast("string"), F.lit("")), operation, value)


def multi(values: Column, operation: str, value: str) -> Column:
    """Several values: none satisfies nothing; negated operators must hold for all, others for one."""
    test = lambda v: compare(v, operation, value)
    some = F.coalesce(F.size(values) > 0, F.lit(False))
    return some & (F.forall(values, test) if operation in NEGATED else F.exists(values, test))


def date(col: Column, operation: str, value: str) -> Column:
    """Text operators see the display half of a date, ranges its first ten characters."""
    return scalar(date_range(col), operation, value) if operation in RANGES else scalar(date_display(col), operation, value)


def registry(item: Callable[[str], Column] = F.col) -> dict[str, Callable[[str, str], Column]]:
    """Field name to condition, over the columns of an item view."""
    one = lambda name: (lambda op, v: scalar(item(name), op, v))
    simple = ("title", "abstractNote", "DOI", "publicationTitle", "dateAdded", "dateModified", "itemType", "url", "ISBN", "language", "extra")
    return {name: one(name) for name in simple} | {
        "date": lambda op, v: date(item("date"), op, v),
        "year": lambda op, v: scalar(date_year(item("date")), op, v),
        "creator": lambda op, v: multi(F.transform(item("creators"), creator_name), op, v),
        "tag": lambda op, v: multi(F.transform(item("tags"), lambda t: t["tag"]), op, v),
        "collection": lambda op, v: in_collections(item("collections"), op, [v]),
    }


def in_collections(keys: Column, operation: str, wanted: list[str]) -> Column:
    """Membership of any of the wanted collections; items in none satisfy isNot."""
    if operation not in ("is", "isNot"):
        raise ValueError("collections can be compared with is and isNot only")
    hit = F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False)
    return ~hit if operation == "isNot" else hit


def compile_all(conditions: list[Condition], join_mode: str = "all", fields: dict[str, Callable[[str, str], Column]] | None = None, subtrees: dict[str, list[str]] | None = None) -> Column:
    """All or any of the conditions. subtrees: collection key to the keys that count as it."""
    if join_mode not in ("all", "any"):
        raise ValueError("join_mode is all or any")
    if not conditions:
        raise ValueError("no condition")
    fields, parts = fields or registry(), []
    for c in conditions:
        name = canonical_field(c.field)
        if name not in fields:
            raise UnknownField(c.field)
        if name == "collection" and subtrees is not None:
            if c.value not in subtrees:
                raise UnknownCollection(c.value)
            parts.append(in_collections(F.col("collections"), c.operation, subtrees[c.value]))
        else:
            parts.append(fields[name](c.operation, c.value.strip()))
    return reduce(Column.__and__ if join_mode == "all" else Column.__or__, parts)


def parse_conditions(given: str | list[dict]) -> list[Condition]:
    rows = json.loads(given) if isinstance(given, str) else given
    return [Condition(str(r["field"]).strip(), str(r["operation"]).strip(), str(r["value"]).strip()) for r in rows]


def tag_language(entries: str | list[str], names: Column) -> Column | None:
    """Entries are ANDed; ' OR ' or '||' inside one ORs; a leading '-' excludes, and holds without any tag.

    None without a term; wildcards are refused, as names are compared whole.
    """
    both = []
    for entry in [entries] if isinstance(entries, str) else entries:
        either = []
        for term in re.split(r"\s+OR\s+|\|\|", entry):
            term = term.strip()
            exclude, name = term.startswith("-"), term.removeprefix("-").strip()
            if not name:
                continue
            if "%" in name or "*" in name:
                raise ValueError(f"a tag with a wildcard: {name}")
            wanted = fold_text(name)
            has = F.coalesce(F.exists(names, lambda t: fold(t) == wanted), F.lit(False))  # noqa: B023  called at once
            either.append(~has if exclude else has)
        if either:
            both.append(reduce(Column.__or__, either))
    return reduce(Column.__and__, both) if both else None


def item_type_filter(value: str, col: Column) -> Column:
    """A name, '-name', or names with '||' between."""
    names = [v.strip() for v in value.split("||")]
    if len(names) == 1 and names[0].startswith("-"):
        return F.lower(col) != names[0][1:].strip().lower()
    return F.lower(col).isin(*(n.lower() for n in names))


def where(spec: dict | str | None) -> Column:
    """A metadata filter: equality, $and, $or, $ne, $gt, $gte, $lt, $lte, $in, $nin.

    A missing value never equals; it differs from everything, so $ne and $nin hold.
    """
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not spec:
        return F.lit(True)

    def one(name: str, rule) -> Column:
        if name in ("$and", "$or"):
            return reduce(Column.__and__ if name == "$and" else Column.__or__, [where(r) for r in rule])
        col = F.col({"itemType": "item_type"}.get(name, name))
        if not isinstance(rule, dict):
            return F.coalesce(col == rule, F.lit(False))
        signs = {
            "$eq": lambda v: F.coalesce(col == v, F.lit(False)), "$ne": lambda v: F.coalesce(col != v, F.lit(True)),
            "$gt": lambda v: F.coalesce(col > v, F.lit(False)), "$gte": lambda v: F.coalesce(col >= v, F.lit(False)),
            "$lt": lambda v: F.coalesce(col < v, F.lit(False)), "$lte": lambda v: F.coalesce(col <= v, F.lit(False)),
            "$in": lambda v: F.coalesce(col.isin(*v), F.lit(False)), "$nin": lambda v: F.coalesce(~col.isin(*v), F.lit(True)),
        }
        return reduce(Column.__and__, [signs[s](v) for s, v in rule.items()])

    return reduce(Column.__and__, [one(k, v) for k, v in spec.items()])
