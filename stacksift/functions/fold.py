"""Folding for comparison: transliterate Latin, Greek and Cyrillic letters, unify dashes, lower case. Native expressions only."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dash-like characters that compare as a hyphen: fixed values.
DASHES = "‐‑‒–—―−﹘﹣－"
#: Letters that become two: fixed values.
PAIRS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
#: Letters that don't decompose: fixed values.
SINGLES = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H"}
#: German letters as they are spelled without umlauts: fixed values.
UMLAUTS = {"ü": "ue", "ö": "oe", "ä": "ae", "ß": "ss", "Ü": "Ue", "Ö": "Oe", "Ä": "Ae"}
#: Small letters of other scripts in the Latin alphabet, one letter each: fixed values.
GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυφω", "abgdeziiklmnxoprsstyfo", strict=True))
CYRILLIC = dict(zip("абвгдезийклмнопрстуфыэіў", "abvgdeziiklmnoprstufyeiu", strict=True))
#: And those that become more letters, or none: fixed values.
LONGER = {"θ": "th", "χ": "ch", "ψ": "ps", "ё": "io", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "є": "ie", "ї": "yi", "ъ": "", "ь": ""}
#: No variant is lost by this: there are six at most.
MAX_VARIANTS = 15


def _table() -> dict[str, str]:
    """Every marked letter of the three scripts, from its decomposition; combining marks themselves go."""
    other = GREEK | CYRILLIC
    out = dict(SINGLES) | dict.fromkeys(DASHES, "-") | other | {a.upper(): b.upper() for a, b in other.items()}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] not in LONGER and base[0].lower() not in LONGER and chr(code).lower() not in LONGER:
            plain = out.get(base[0], base[0])
            if plain.isascii() and plain.isalpha():
                out.setdefault(chr(code), plain)
    return out


TABLE = _table()
FROM, TO = "".join(TABLE), "".join(TABLE.values())
#: Dropped: characters past the end of TO have no counterpart in translate().
MARKS = "".join(chr(c) for c in range(0x300, 0x370))


#: Letters that one letter can't stand for.
WIDE = PAIRS | LONGER | {a.upper(): b.capitalize() for a, b in LONGER.items()}
_OTHER_SCRIPTS = "[\u0370-\u045F\u1F00-\u1FFF]"


def _expand(col: Column) -> Column:
    latin, rest = col, [x for x in WIDE if x not in PAIRS]
    for a in PAIRS:
        latin = F.replace(latin, F.lit(a), F.lit(PAIRS[a]))
    other = latin
    for a in rest:
        other = F.replace(other, F.lit(a), F.lit(WIDE[a]))
    return F.when(col.rlike(_OTHER_SCRIPTS), other).otherwise(latin)


def transliterate(col: Column) -> Column:
    """ASCII letters for marked Latin ones, hyphens for dashes; ASCII rows pass at once."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(_expand(col), FROM + MARKS, TO)).otherwise(col)


def _bare_letters() -> dict[str, str]:
    """Marked letters of the three scripts and what is left of them without their marks."""
    out = {"ς": "σ"}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isalpha():
            out.setdefault(chr(code), base[0])
    return out


_BARE = _bare_letters()


def without_marks(col: Column) -> Column:
    """Lower case without marks, each letter in its own script; ß is ss."""
    bare = F.translate(col, "".join(_BARE) + MARKS, "".join(_BARE.values()))
    return F.lower(F.when(col.rlike(r"[^\x00-\x7F]"), F.replace(bare, F.lit("ß"), F.lit("ss"))).otherwise(col))


def fold(col: Column) -> Column:
    """What text operators compare; null folds to ''."""
    return F.lower(transliterate(F.coalesce(col.cast("string"), F.lit(""))))


def ascii_text(value: str) -> str:
    """transliterate() of a literal, on the driver."""
    for a, b in WIDE.items():
        value = value.replace(a, b)
    return "".join(TABLE.get(c, c) for c in value if c not in MARKS)


def fold_text(value: str | None) -> str:
    """fold() of a literal, on the driver."""
    return ascii_text(value or "").lower()


def ascii_lower(col: Column) -> Column:
    """Lower case of A-Z alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, upper, upper.lower())).otherwise(F.lower(col))


def contains_any(col: Column, forms: list[str]) -> Column:
    """Whether the text in ASCII lower case, which is made once, holds any of the forms (in ASCII lower case)."""
    low = F.array(ascii_lower(F.coalesce(col, F.lit(""))))
    return F.exists(low, lambda x: reduce(Column.__or__, [x.contains(f) for f in forms]))


def ascii_lower_text(value: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)


def variants(query: str) -> list[str]:
    """Spellings of a search term, sorted: given and ASCII letters, each with dashes and with blanks for them; umlauts
    spelled out; dashes for blanks, where it has no dash."""
    letters = {query, ascii_text(query)}
    out = {x.replace("-", dash) for x in letters for dash in "- "} | {query.translate(str.maketrans(UMLAUTS))}
    dashed = set() if "-" in query else {query.replace(" ", "-")}
    return sorted(out | dashed)[:MAX_VARIANTS] if query.strip() else [query][: len(query)]
