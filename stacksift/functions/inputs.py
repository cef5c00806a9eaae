"""What callers pass in many shapes, as one: driver-side values, never columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from typing import Any

#: Under which names a tag may come: fixed values.
TAG_NAMES = ("tag", "name", "value")
#: How often an index is refreshed, in days: fixed values.
EVERY = {"startup": 0, "daily": 1}


def parsed(value: Any) -> Any:
    """The value of a JSON array or object in a text; anything else as it is."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def rows(value: Any) -> list:
    """None and blanks give nothing, a list or tuple its elements, anything else itself."""
    value = parsed(value)
    if value is None or (isinstance(value, str) and not value.strip()):
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


def strings(value: Any, separator: str | None = None) -> list[str]:
    """Stripped texts that aren't blank; a text with the separator holds several."""
    parts = (p for v in rows(value) for p in (str(v).split(separator) if separator and isinstance(v, str) else [str(v)]))
    return [p for p in map(str.strip, parts) if p]


def numbers(value: Any, size: int) -> list[float] | None:
    """Exactly so many numbers, or None: truth values aren't numbers."""
    got = rows(value)
    ok = len(got) == size and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in got)
    return [float(x) for x in got] if ok else None


def _tag_name(value: Any) -> str:
    if isinstance(value, dict):
        return next((text for k in TAG_NAMES if (text := str(value.get(k) or "").strip())), "")
    return str(value).strip()


def tag_names(value: Any) -> list[str]:
    """Names of a tag filter: a text, a list, objects, or JSON of those."""
    return [name for name in map(_tag_name, rows(value)) if name]


def tags(value: Any) -> list[dict]:
    """Tags of an item as {tag, type}; a type stays if there is one."""
    return [{"tag": _tag_name(v)} | ({"type": v["type"]} if isinstance(v, dict) and v.get("type") is not None else {}) for v in rows(value) if _tag_name(v)]


def values_by(value: Any, valid: Callable[[str], bool]) -> tuple[list[str], list[str]]:
    """Valid values, each once, and what isn't: a text that is valid as a whole isn't split at commas, semicolons and
    white space."""
    good, bad = {}, []
    for text in strings(value):
        parts = [text] if valid(text) else [p for p in re.split(r"[,;\s]+", text) if p]
        for p in parts:
            if valid(p):
                good.setdefault(p)
            else:
                bad.append(p)
    return list(good), bad


def library_id(value: Any) -> int | None:
    """0 for the personal library (0 or `user`), a group's number, None for all; anything else is an error."""
    text = "" if value is None else str(value).strip().lower()
    if not text:
        return None
    if text == "user":
        return 0
    if not text.isdecimal():
        raise ValueError(f"not a library: {value}")
    return int(text)


def item_type(value: str | None, known: Iterable[str]) -> str | None:
    """The known type that is spelled like this but for case; None if there is none, which means no filter."""
    spelled = {k.lower(): k for k in sorted(known, reverse=True)} | {}
    names = set(spelled.values())
    return value if value in names else spelled.get((value or "").strip().lower())


def update_due(config: dict, now: datetime) -> bool:
    """Whether an index is to be refreshed: never unless it is asked for; at every start; after whole days."""
    rule = str(config.get("update_frequency", "manual"))
    days = EVERY.get(rule)
    if days is None and (m := re.fullmatch(r"every_(\d+)(_.*)?", rule)):
        days = int(m.group(1))
    if not config.get("auto_update") or days is None:
        return False
    last = config.get("last_update")
    return not days or not last or now - datetime.fromisoformat(last) >= timedelta(days=days)
