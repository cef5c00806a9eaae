"""Sources: snapshots of tables, SQLite files, citations, pages and extracted texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import bibtex_date, csl_date
from ..functions.text import html_to_text, meta_tags, page_metadata
from ..model import TABLES, Library


def snapshot(spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> Library:
    """A library from parquet tables below a folder; tables that aren't there are empty where that is defined."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))}
    return Library(spark, {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names or TABLES if n in there})


def sqlite_to_parquet(spark: SparkSession, database: str, path: str) -> Library:
    """Copy the tables of a database file on the driver's disk to parquet, read-only and in batches; a one-time
    import, after which every scan is distributed."""
    import sqlite3

    con = sqlite3.connect(f"file:{database}?mode=ro&immutable=1", uri=True)
    try:
        have = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
        for name in (t for t in TABLES if t in have):
            cur = con.execute(f'select * from "{name}"')  # names are from our own list
            cols, mode = [c[0] for c in cur.description], "overwrite"
            while rows := cur.fetchmany(100_000):
                spark.createDataFrame(pa.Table.from_pylist([dict(zip(cols, r, strict=True)) for r in rows])).write.mode(mode).parquet(f"{path}/{name}.parquet")
                mode = "append"
    finally:
        con.close()
    return snapshot(spark, path)


def parse_bibtex(text: str | None) -> list[dict]:
    """Entries of a BibTeX text: type, cite key and fields; braces and quotes may nest."""
    out, pos, text = [], 0, text or ""
    while m := re.compile(r"@\s*([A-Za-z]+)\s*\{\s*([^,\s}]*)\s*,").search(text, pos):
        pos, fields = m.end(), {}
        while f := re.compile(r"\s*,?\s*([A-Za-z][\w\-]*)\s*=\s*").match(text, pos):
            i, depth, quoted = f.end(), 0, False
            begin = i
            while i < len(text):
                c = text[i]
                if c == "{" and text[i - 1] != "\\":
                    depth += 1
                elif c == "}" and text[i - 1] != "\\":
                    if depth == 0:
                        break
                    depth -= 1
                elif c == '"' and depth == 0:
                    quoted = not quoted
                elif c == "," and depth == 0 and not quoted:
                    break
                i += 1
            value = text[begin:i].strip()
            if value[:1] in '{"' and value[-1:] in '}"':
                value = value[1:-1]
            name = f.group(1).lower()
            # braces hold the parts of a name together, so names keep theirs
            bare = value if name in ("author", "editor") else value.replace("{", "").replace("}", "")
            fields[name] = re.sub(r"\s+", " ", bare).strip()
            pos = i
        if m.group(1).lower() not in ("comment", "string", "preamble"):
            out.append({"type": m.group(1).lower(), "cite_key": m.group(2), "fields": fields})
    return out


def bibtex_authors(raw: str | None) -> list[dict]:
    """Names between ' and ' outside braces; a name in braces is an organisation."""
    out, depth, part, parts = [], 0, "", []
    for token in re.split(r"(\{|\}|\s+and\s+)", raw or ""):
        depth += (token == "{") - (token == "}")
        if depth == 0 and re.fullmatch(r"\s+and\s+", token):
            parts.append(part)
            part = ""
        else:
            part += token
    for p in (x.strip() for x in [*parts, part] if x.strip()):
        whole = p.startswith("{") and p.endswith("}")
        p = p.replace("{", "").replace("}", "").strip()
        if not p:
            continue
        if whole:
            out.append({"firstName": "", "lastName": p})
        elif "," in p:
            last, first = p.split(",", 1)
            out.append({"firstName": first.strip(), "lastName": last.strip()})
        else:
            *first, last = p.split()
            out.append({"firstName": " ".join(first), "lastName": last})
    return out


ENTRY_TYPES = {
    "article": "journalArticle", "book": "book", "incollection": "bookSection", "inbook": "bookSection", "inproceedings": "conferencePaper", "conference": "conferencePaper",
    "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report", "unpublished": "manuscript",
}


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Items from whole BibTeX files: key, itemType, fields, creators, date, tags."""
    return bibtex_items(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def bibtex_items(texts: DataFrame) -> DataFrame:
    """Items from a column `text` of BibTeX."""
    kind = "type string, cite_key string, fields map<string,string>, creators array<struct<firstName:string,lastName:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [e | {"creators": bibtex_authors(e["fields"].get("author"))} for t in b.column("text").to_pylist() for e in parse_bibtex(t)]
            yield pa.RecordBatch.from_pydict({
                "type": pa.array([r["type"] for r in rows], pa.string()), "cite_key": pa.array([r["cite_key"] for r in rows], pa.string()),
                "fields": pa.array([list(r["fields"].items()) for r in rows], pa.map_(pa.string(), pa.string())),
                "creators": pa.array([r["creators"] for r in rows], pa.list_(pa.struct([("firstName", pa.string()), ("lastName", pa.string())]))),
            })

    e = texts.select("text").mapInArrow(run, kind)
    f = lambda n: F.col("fields")[n]
    item_type = F.coalesce(F.create_map(*(F.lit(x) for kv in ENTRY_TYPES.items() for x in kv))[F.col("type")], F.lit("document"))
    tags = F.filter(F.transform(F.split(F.coalesce(f("keywords"), F.lit("")), "[;,]"), lambda t: F.trim(t)), lambda t: t != "")
    return e.select("cite_key", item_type.alias("itemType"), f("title").alias("title"), F.coalesce(f("journal"), f("booktitle")).alias("publicationTitle"), F.coalesce(f("date"), bibtex_date(f("year"), f("month"), f("day"))).alias("date"), f("doi").alias("DOI"), f("isbn").alias("ISBN"), f("url").alias("url"), f("abstract").alias("abstractNote"), "creators", tags.alias("tags"))


CSL = (
    "type string, title string, author array<struct<given:string,family:string,literal:string>>, issued struct<`date-parts`:array<array<int>>>, `container-title` string, "
    "volume string, issue string, page string, DOI string, ISSN string, ISBN string, publisher string, language string, abstract string, URL string"
)
CSL_TYPES = {"article-journal": "journalArticle", "journal-article": "journalArticle", "book": "book", "chapter": "bookSection", "book-chapter": "bookSection", "paper-conference": "conferencePaper", "proceedings-article": "conferencePaper", "thesis": "thesis", "report": "report", "posted-content": "preprint"}


def csl_items(texts: DataFrame) -> DataFrame:
    """Items from a column `json` with one CSL record or an array of them; a field may be a text or an array."""
    s = F.trim("json")
    many = F.from_json(F.when(s.startswith("["), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))), f"array<struct<{re.sub(r'(`?[A-Za-z-]+`?) (string|array|struct)', r'\1:\2', CSL)}>>")
    r = texts.select(F.explode(many).alias("r")).select("r.*")

    def text(name: str):
        c = F.col(f"`{name}`")
        return F.when(c.startswith("["), F.get(F.from_json(c, "array<string>"), F.lit(0))).otherwise(c)

    creators = F.transform(F.coalesce("author", F.array()), lambda a: F.struct(F.coalesce(a["given"], F.lit("")).alias("firstName"), F.coalesce(a["family"], a["literal"]).alias("lastName")))
    item_type = F.coalesce(F.create_map(*(F.lit(x) for kv in CSL_TYPES.items() for x in kv))[F.col("type")], F.lit("document"))
    return r.select(item_type.alias("itemType"), text("title").alias("title"), text("container-title").alias("publicationTitle"), csl_date(F.col("issued")["date-parts"]).alias("date"), "DOI", text("ISBN").alias("ISBN"), text("ISSN").alias("ISSN"), F.col("URL").alias("url"), F.col("abstract").alias("abstractNote"), "volume", "issue", F.col("page").alias("pages"), "publisher", "language", creators.alias("creators"))


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, embedded metadata and text of HTML pages."""
    return pages.select("page_id", page_metadata(meta_tags(F.col("html"))).alias("m"), html_to_text(F.col("html")).alias("text")).select("page_id", "m.*", "text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files, line ends unified."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select("path", F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def largest_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """folder, path, size: the largest file of each folder; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return f.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.max_by("path", F.struct("length", "path")).alias("path"), F.max("length").alias("size"))


def with_cached_text(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with `text` from the cache, where attachment, time, size and profile are the same."""
    return files.join(cache, ["attachment_key", "mtime", "size", "profile"], "left")


def evicted(cache: DataFrame, keys: DataFrame, before: str | None = None) -> DataFrame:
    """The cache without items' texts, and without those that were stored before a time."""
    rest = cache.join(keys, "attachment_key", "left_anti")
    return rest if before is None else rest.filter(F.col("stored_at") >= F.lit(before))


def page_range(extracted: DataFrame, first: int, last: int, most: int = 50) -> DataFrame:
    """Pages first to last of a column `pages`, cut to its end and to the most."""
    n = F.greatest(F.lit(0), F.least(F.lit(last), F.size("pages"), F.lit(first + most - 1)) - first + 1)
    return extracted.withColumn("pages", F.slice("pages", F.lit(max(1, first)), n))
