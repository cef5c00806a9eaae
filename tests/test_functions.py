import pytest
from pyspark.sql import functions as F

from stacksift.functions import identifiers, records, text
from stacksift.functions.fold import fold_text, variants
from stacksift.sources import files


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return row.select(f(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("10.5555/k7-2", "10.5555/k7-2"), ("doi: 10.5555/k7-2.", "10.5555/k7-2"), ("DOI:10.5555/k7-2,;", "10.5555/k7-2"), ("https://doi.org/10.5555/q%28r%29", "10.5555/q(r)"), ("[10.5555/k7-2]", None),
    ("10.5555/S0(83)7:1(AB)", "10.5555/S0(83)7:1(AB)"), ("10.5555/m(n))].", "10.5555/m(n)"), ("10.5555/k7)", "10.5555/k7"), ("https://dx.doi.org/10.5555/u+v?x=1", "10.5555/u+v"), ("http://example.org/10.5555/k7", None),
    ("none", None), ("", None), (None, None),
])
def test_doi(spark, raw, want):
    assert one(spark, identifiers.doi, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("0-393-04002-X", "9780393040029"), ("978-0-13-110362-7", "9780131103627"), ("9780131103628", None), ("isbn: 0131103628", "9780131103627"), ("https://books.example/isbn/9780131103627/view", "9780131103627"), ("none", None),
])
def test_isbn(spark, raw, want):
    assert one(spark, identifiers.isbn13, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("arXiv:1907.04321v3", "1907.04321"), ("https://arxiv.org/abs/1907.04321", "1907.04321"), ("https://www.arxiv.org/pdf/1907.04321v1.pdf", "1907.04321"), ("10.48550/arXiv.1907.04321", "1907.04321"),
    ("https://doi.org/10.48550/arXiv.1907.04321", "1907.04321"), ("math.GT/0309136v2", "math.GT/0309136"), ("1907", None), (None, None),
])
def test_arxiv(spark, raw, want):
    assert one(spark, identifiers.arxiv_key, raw) == want


def test_arxiv_of_extra(spark):
    assert one(spark, identifiers.arxiv_key_of_extra, "Note: x\n arXiv: 1907.04321v2 [math]\nb") == "1907.04321" and one(spark, identifiers.arxiv_key_of_extra, "arXiv") is None


@pytest.mark.parametrize("raw, want", [("An <b>Über</b>blick &amp; more", "uber blick more"), ("Ώρα über Straße", "ωρα uber strasse"), ("Either/or, again", "either or again"), ("  the   Plan:  nine ", "plan nine"), ("!?", ""), (None, "")])
def test_title(spark, raw, want):
    assert one(spark, identifiers.title_key, raw) == want


def test_fold_and_variants():
    assert fold_text("Straße–Ø") == "strasse-o" and fold_text("Щука и Ёж") == "shchuka i iozh" and fold_text("Θεός Ψυχή") == "theos psychi"
    assert variants("naive set") == ["naive set", "naive-set"] and variants("") == [] and variants("  ") == ["  "]
    assert variants("Müller-Lüdenscheid") == sorted({"Müller-Lüdenscheid", "Muller-Ludenscheid", "Müller Lüdenscheid", "Muller Ludenscheid", "Mueller-Luedenscheid"})


def test_passages_and_snippets(spark):
    assert text.split_passages("  ") == [] and text.split_passages("short") == [("short", 0, 5)]
    body = "One sentence here. " * 40
    got = text.split_passages(body, 100, 20, 5)
    assert len(got) == 5 and all(body[a:b].strip() == p for p, a, b in got) and got[1][1] < got[0][2]
    assert [a for _, a, _ in text.split_passages("x" * 30, 10, 50, 99)] == [0, 8, 16, 24]
    assert text.snippet_of("needle", "hay " * 200 + "needle " * 3 + "hay " * 200, 60)[0].count("needle") == 3
    assert one(spark, lambda t: text.page_of(t, F.lit(3)), "a\fb\fc") == 2 and one(spark, lambda t: text.page_of(t, F.lit(3)), "abc") is None
    assert text.fuzzy_window("some text with a nedle in it", "needle")[0] > 0.75


def test_html(spark):
    assert one(spark, text.html_to_text, "<p>Title</p><p>Body<br>x</p><ul><li>a</li><li>b</li></ul>") == "Title\n\nBody\nx\n\na\nb"
    assert one(spark, text.note_title, "<p> </p><p>First</p><p>B</p>") == "First"
    assert one(spark, text.strip_markup, '<mml:math>x</mml:math> <I class="q">y</I><![CDATA[z]]>') == "x <i>y</i>z"
    page = '<html><head><meta name="citation_title" content="T"><meta name="citation_author" content="A"><meta name="citation_author" content="B"><meta name="dc.date" content="2020/07/07"></head><body><meta name="citation_title" content="no"></body>'
    m = one(spark, lambda h: text.page_metadata(text.meta_tags(h)), page)
    assert (m["title"], m["authors"], m["date"]) == ("T", ["A", "B"], "2020-07-07")


def test_records(spark):
    assert one(spark, records.date_key, "2021-03", "03/2021") == "2021-03-00" and one(spark, records.date_key, None, "Nov 1990") == "1990-00-00"
    assert one(spark, records.date_key, None, "n.d.") == "0000-00-00" and one(spark, records.date_key, None, None) is None
    assert tuple(one(spark, records.split_name, "Ada King Lovelace")) == ("Ada King", "Lovelace")
    assert one(spark, records.bibtex_date, "2020", "mar", "5") == "2020-03-05" and one(spark, records.citation_key_of_extra, "a\nCitation Key: k1") == "k1"


def test_citations(spark):
    t = spark.createDataFrame([('@article{k1, title = {A {B} c}, author = "Lovelace, Ada and {The Org} and Jo Doe", year = 2020, month = mar, keywords={x; y}}\n@book{k2, title={T2}}',)], "text string")
    a, b = files.bibtex_items(t).orderBy("cite_key").collect()
    assert (a["itemType"], a["title"], a["date"], a["tags"]) == ("journalArticle", "A B c", "2020-03", ["x", "y"])
    assert [c["lastName"] for c in a["creators"]] == ["Lovelace", "The Org", "Doe"] and b["itemType"] == "book"
    c = spark.createDataFrame([('[{"type": "journal-article", "title": ["X"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2020, 3]]}, "container-title": "J"}]',)], "json string")
    r = files.csl_items(c).first()
    assert (r["itemType"], r["title"], r["date"], r["publicationTitle"], r["creators"][0]["lastName"]) == ("journalArticle", "X", "2020-03", "J", "B")
