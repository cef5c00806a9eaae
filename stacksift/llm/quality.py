"""Quality rules: counts inside a text, then lines that too many documents of a host share.

DataFrame functions only. A line is normalised (outer white space goes, lower case) and hashed; for every host (`source`) the documents that hold it are counted, copies of one
text too. A line in more than `min_docs` of them, however large the host is, is removed everywhere but in the document with the
smallest doc_id that has it: both functions give the texts without these lines. A document that loses most of its words that way is rejected as depleted.

Defined cases: a null text has no words and fails the base rule; a null source is a host of its own; rows that
repeat a doc_id are judged one by one, but count as one document of a line; without a doc_id, each different text
counts, and a line that no document with a doc_id has stays in the text with the smallest hash; columns beyond those named are ignored by `quality_rules` and kept by
`kept_documents`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

MIN_WORDS = 50
MAX_REPEAT = 0.5
SYMBOLS = "[#*$%&|<>]"
#: Bits, in parts of 2**15, of the map of rows that have a removed line; only rows it marks are shuffled.
MAP_BITS, PART_BITS = 23, 15
_BLANKS = " \t\n\x0b\x0c\r"
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def base_stats(docs: DataFrame) -> DataFrame:
    """row (all of docs), doc_id, source, cid (of the text) and the counts of one scan; nothing is shuffled.

    Words of repeated windows: the hashes of all 3-word windows are compared within the row; only rows with an
    equal pair sort them, find the hashes that occur twice and then the positions that those windows cover.
    Rows with many such hashes sort (hash, position) instead of looking each window up.
    """
    text = F.coalesce("text", F.lit(""))
    a = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text", F.length("text")).alias("cid"), text.alias("t"))
    b = a.select("*", _words(F.col("t")).alias("w"), _lines(F.col("t")).alias("ln"))
    window = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    c = b.select(
        "row",
        "doc_id",
        "source",
        "cid",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > 3, F.slice(window, F.lit(1), F.size("w") - 2)).alias("tri"),
    )
    sets = F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.sort_array("tri"))
    d = c.withColumn("ordered", sets).withColumn("twice", F.array_distinct(F.filter("ordered", lambda h, j: h == F.get("ordered", j + 1))))
    few = F.filter(F.sequence(F.lit(0), F.size("tri") - 1), lambda i: F.array_contains("twice", F.get("tri", i)))
    e = d.withColumn("pairs", F.when(F.size("twice") > 16, F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    many = F.filter("pairs", lambda x, j: F.coalesce(x["h"] == F.get("pairs", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("pairs", j + 1)["h"], F.lit(False)))
    at = F.when(F.size("twice") > 16, F.sort_array(F.transform(many, lambda x: x["i"]))).when(F.size("twice") > 0, few)
    f = e.withColumn("at", at)
    covered = F.aggregate(F.transform("at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - i, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    return f.select("row", "doc_id", "source", "cid", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeat) * F.col("n_words"))


def shared_lines(docs: DataFrame, min_docs: int = 20) -> DataFrame:
    """Per (doc_id, source, cid): `gone`, the places (from 0) of lines that more than min_docs documents of the host
    have, and `removed`, the words in them.

    Counting first folds equal (host, line, document) rows in every task, so a hot host or line is spread by document
    before it is summed.
    """
    norm = F.lower(F.btrim("line", F.lit(_BLANKS)))
    row = docs.select("doc_id", "source", F.xxhash64("text", F.length("text")).alias("cid"), F.col("text"))
    lines = row.select("doc_id", "source", "cid", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.col("line").rlike(f"[^{SPACE}]")).select(
        "doc_id", "source", "cid", "at", F.xxhash64(norm, F.length(norm)).alias("h"), F.regexp_count("line", F.lit(f"[^{SPACE}]+")).alias("n")
    )
    lines = written(lines)  # slim, and read twice
    nameless = F.when(F.col("doc_id").isNull(), F.col("cid"))
    per_doc = lines.groupBy("source", "h", "doc_id", nameless.alias("nameless")).agg(F.count("*"))
    over = per_doc.groupBy("source", "h").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.min("nameless").alias("first_text")).filter(F.col("docs") > min_docs)
    over = over.select(F.col("source").alias("o_source"), F.col("h").alias("o_h"), "first", "first_text")
    hit = lines.join(over, lines.source.eqNullSafe(over.o_source) & (lines.h == over.o_h))
    hit = hit.filter(~F.col("doc_id").eqNullSafe(F.col("first")) | (F.col("doc_id").isNull() & (F.col("cid") != F.col("first_text"))))
    # a set, as rows may be repeated whole
    got = hit.groupBy("doc_id", "source", "cid").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("x"))
    return got.select("doc_id", "source", "cid", F.transform("x", lambda x: x["at"]).alias("gone"), F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("removed"))


def _marked(docs: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that may have a row in lost, and those that have none, by a map of fixed size."""
    slot = lambda cid: F.shiftrightunsigned(F.xxhash64("doc_id", "source", cid), 64 - MAP_BITS)
    part, bit = F.shiftright("slot", PART_BITS), F.col("slot").bitwiseAND((1 << PART_BITS) - 1)
    marks = lost.select(slot(F.col("cid")).alias("slot")).groupBy(part.alias("m_part")).agg(F.bitmap_construct_agg(bit).alias("m_bits"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), slot(F.xxhash64("text", F.length("text"))).alias("slot"))
    both = rows.join(F.broadcast(marks), part == F.col("m_part"), "left")
    byte = F.conv(F.hex(F.substring("m_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")), F.lit(0).cast("tinyint")) == 1
    return both.filter(on).select("row.*"), both.filter(~on).select("row.*")


def _judged(docs: DataFrame, min_words: int, max_repeat: float, min_docs: int, depleted: float) -> DataFrame:
    """row, the counts, base_failed, kept, n_removed and cleaned (the text without removed lines) for each row of docs.

    What stands between two removed lines is taken as one slice, so a text costs its lines once.
    """
    lost = written(shared_lines(docs, min_docs))
    touched, rest = _marked(docs, lost)
    stats, rest = base_stats(touched), base_stats(rest)
    on = [stats[k].eqNullSafe(lost[k]) for k in ("doc_id", "source", "cid")]
    both = stats.join(lost.hint("merge"), on[0] & on[1] & on[2], "left").select("row", stats["doc_id"], *_STATS, "gone", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"))
    text, failed = F.col("row")["text"], base_failed(min_words, max_repeat)
    cut = both.withColumn("parts", F.when(F.col("gone").isNotNull(), F.split(text, "\n"))).withColumn("ends", F.array_append("gone", F.size("parts")))
    before = lambda i: F.coalesce(F.get("gone", i - 1), F.lit(-1))
    between = F.transform("ends", lambda x, i: F.slice("parts", before(i) + 2, x - before(i) - 1))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(between), "\n"))
    kept = ~failed & (F.col("n_removed") <= depleted * F.col("n_words"))
    cut = cut.select("row", "doc_id", *_STATS, failed.alias("base_failed"), kept.alias("kept"), "n_removed", cleaned.alias("cleaned"))
    return cut.unionByName(rest.select("row", "doc_id", *_STATS, failed.alias("base_failed"), (~failed).alias("kept"), F.lit(0).cast("long").alias("n_removed"), text.alias("cleaned")))


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT, min_docs: int = 20, depleted: float = 0.7) -> DataFrame:
    """doc_id, the counts, base_failed, kept, n_removed (words in removed lines), text (without them); one row for each row of docs.

    A document is depleted when removed lines hold more than the share `depleted` of its words. Counts are of the whole text.
    """
    out = _judged(docs.select("doc_id", "source", "text"), min_words, max_repeat, min_docs, depleted)
    return out.select("doc_id", *_STATS, "base_failed", "kept", "n_removed", F.col("cleaned").alias("text"))


def kept_documents(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT, min_docs: int = 20, depleted: float = 0.7) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns and their texts without removed lines."""
    # written first: a filter that is pushed down would repeat the counts' expressions many times over; one text a row
    out = _judged(docs, min_words, max_repeat, min_docs, depleted)
    row = F.struct(*(F.col("cleaned").alias(k) if k == "text" else F.col("row")[k].alias(k) for k in docs.columns))
    return written(out.select("kept", row.alias("row"))).filter("kept").select("row.*")
