"""License scans by patience alignment of texts with templates.

For every template, places of its least common words in the text say where to look; around each, a window of twice the
template's length to either side is aligned: words that are unique to both sides anchor, the longest increasing
subsequence of anchors is kept, equal words beside anchors extend them, and the gaps between are aligned the same way.
The matched words of a window, cut where more than `max_gap` other words stand between, give the coverage: matched
template words over all of them. All matches of a text are found; of those that overlap, the one with the most matched
words stays.

Nothing is lost by what is passed over: a template of L words can reach the coverage c only if one of any
L - ceil(c * L) + 1 different words of it (counted exactly, c as the decimal it is written as) is in the text, if text
and template share ceil(c * L) words, counted as often as in both, and if a window holds that many of its words.

Defined cases: null and empty texts match nothing; of overlapping matches with equally many words the larger coverage
and then the smaller name stays; places are those of the text as it is, whatever lower case does to its length; repeated rows
get equal answers; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .license_texts import templates

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
TEMPLATES = templates()


def folded(text: str) -> str:
    """Lower case, but for characters that would become longer."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) with rising seconds."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tails, y)
        back[k] = at[p - 1] if p else -1
        tails[p : p + 1], at[p : p + 1] = [y], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(words: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(lo, hi):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def align(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Matched positions of a[a0:a1] and b[b0:b1], rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(a0, a1, b0, b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        of_b = _once(b, b0, b1)
        anchors = increasing([(i, of_b[w]) for w, i in sorted(_once(a, a0, a1).items(), key=lambda x: x[1]) if w in of_b])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, max_gap: int):
        self.templates = {k: WORD.findall(v.lower()) for k, v in sorted(templates.items())}
        self.coverage, self.max_gap = coverage, max_gap
        self.least = {k: ceil(Fraction(str(coverage)) * len(v)) for k, v in self.templates.items()}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        often: dict[str, int] = {}
        for words in self.templates.values():
            for w in set(words):
                often[w] = often.get(w, 0) + 1
        self.needed = {k: set(sorted(set(v), key=lambda w: (-len(w), often[w], w))[: len(v) - self.least[k] + 1]) for k, v in self.templates.items()}
        self.any = set().union(*self.needed.values()) if self.needed else set()

    def _of_template(self, name: str, words: list[str], places: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
        """(matched words, first place, last place) of the matches of one template."""
        template, least, counts = self.templates[name], self.least[name], self.counts[name]
        size = len(template)
        looked = sorted({i for w in self.needed[name] for i in places.get(w, ())})
        if not looked or sum(min(n, len(places[w])) for w, n in counts.items() if w in places) < least:
            return
        held = list(accumulate((w in counts for w in words), initial=0))
        done = -1
        for at in looked:
            lo, hi = max(0, at - 2 * size), min(len(words), at + 2 * size)
            if at <= done or held[hi] - held[lo] < least:
                continue
            run: list[tuple[int, int]] = []
            for p in [*align(template, words, 0, size, lo, hi), (0, 1 << 60)]:
                if run and p[1] - run[-1][1] > self.max_gap + 1:
                    if len(run) >= least:
                        yield len(run), run[0][1], run[-1][1]
                        if run[0][1] <= at <= run[-1][1]:
                            done = run[-1][1]
                    run = []
                run.append(p)

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first character, character after the last), in the order of the text."""
        low = folded(text or "")
        if not any(w in low for w in self.any):
            return []
        found = list(WORD.finditer(low))
        words = [m.group() for m in found]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        got = {(-n, -n / len(template), name, a, b) for name, template in self.templates.items() if template for n, a, b in self._of_template(name, words, places)}
        kept: list[tuple[int, int, str, float]] = []
        for _, share, name, a, b in sorted(got):
            k = bisect_left(kept, (a,))
            if (k == 0 or kept[k - 1][1] < a) and (k == len(kept) or kept[k][0] > b):
                kept.insert(k, (a, b, name, -share))
        return [(name.split("#")[0], share, found[a].start(), found[b].end()) for a, b, name, share in kept]

    def scan(self, text: str | None) -> tuple[str, float, int, int] | None:
        """The match that covers the most characters, the first of them."""
        return best(self.matches(text))


def best(matches: list[tuple[str, float, int, int]]) -> tuple[str, float, int, int] | None:
    return max(matches, key=lambda m: (m[3] - m[2], -m[2]), default=None)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.8, max_gap: int = 3) -> DataFrame:
    """For every row of docs: doc_id; license (null if none), coverage, begin and end (characters) of the longest match;
    matches, all of them in the order of the text."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, coverage, max_gap)
        for t in batches:
            for b in slices(t):
                every = [s.matches(x) for x in b.column("text").to_pylist()]
                got = [best(m) or (None, 0.0, None, None) for m in every]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id"), "license": pa.array([g[0] for g in got], pa.string()), "coverage": pa.array([g[1] for g in got], pa.float64()),
                    "begin": pa.array([g[2] for g in got], pa.int64()), "end": pa.array([g[3] for g in got], pa.int64()),
                    "matches": pa.array([[dict(zip(("license", "coverage", "begin", "end"), m, strict=True)) for m in x] for x in every], kind),
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, begin long, end long, matches array<struct<license: string, coverage: double, begin: long, end: long>>")
