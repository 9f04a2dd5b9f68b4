"""Answers of search services: fields of six formats, odd answers, pages up to the first quiet one."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import strings
from tessera.sources import answers

OPENALEX = json.dumps({"meta": {"count": 7}, "results": [
    {"id": "W1", "doi": "https://doi.org/10.1/a", "title": "[On] things", "publication_year": 2019, "authorships": [{"author": {"display_name": f"N{i % 7}"}} for i in range(9)], "abstract_inverted_index": {"b": [1, 3], "a": [0], "z": [3], "c": [5]}, "best_oa_location": {"pdf_url": None, "landing_page_url": "https://doi.org/10.1/a"}, "open_access": {"oa_url": "http://x.org/a.pdf"}},
    {"id": "W9", "doi": "https://doi.org/10.1/a", "title": "a repeat"},
    {"id": "W2", "title": "Next", "publication_year": "in 12345 or 1999", "authorships": "none"},
    {"id": "W3"}]})
CROSSREF = json.dumps({"message": {"total-results": 3, "items": [{"DOI": "10.1/x", "title": ["A <i>b</i>  c"], "author": [{"given": "Ada", "family": "L"}, {"family": "Bob"}], "issued": {"date-parts": [[2021, 5]]}, "abstract": "<jats:p>Text</jats:p>", "open-access": {"is_oa": True}, "link": [{"content-type": "text/html", "URL": "https://x/1"}, {"content-type": "application/pdf", "URL": "https://x/2"}]}]}})
SEMANTIC = json.dumps({"total": 1, "data": [{"paperId": "p", "externalIds": {"ArXiv": "1.2"}, "title": "T", "year": 2020, "authors": [{"name": "A"}, {"name": "A"}], "abstract": None, "openAccessPdf": {"url": "ftp://x"}}]})
EUROPE = json.dumps({"hitCount": 2, "resultList": {"result": [{"pmid": "5", "title": "T", "pubYear": "2001", "authorList": {"author": [{"firstName": "A", "lastName": "B"}]}, "isOpenAccess": "Y", "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "xml", "url": "https://e/x"}, {"documentStyle": "pdf", "url": "https://e/p"}]}}]}})
CORE = json.dumps({"resultsSize": 4, "results": [{"id": 12, "title": "T", "yearPublished": 2010, "authors": [{"name": "A"}], "links": [{"type": "PDF", "uri": "https://c/1"}]}]})
ARXIV = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:os="http://a9.com/"><os:totalResults>2</os:totalResults><entry><id>http://arxiv.org/abs/2208.07815v1</id><title>On\n  things</title><summary>S</summary><published>2022-08-16T00:00:00Z</published><author><name>Ada</name></author><author><name>Bob</name></author><link href="http://arxiv.org/abs/x"/><link title="pdf" href="http://arxiv.org/pdf/x"/></entry></feed>'


def found(spark, engine, body, limit=10):
    frame = spark.createDataFrame([(1, body)], "q int, body string")
    total = frame.select(answers.declared(F.col("body"), engine)).first()[0]
    return total, answers.candidates(frame, "body", engine, limit).orderBy("place").collect()


def test_openalex(spark):
    total, rows = found(spark, "openalex", OPENALEX)
    assert total == 7 and [r.title for r in rows] == ["[On] things", "Next"]
    assert rows[0].authors == "N0, N1, N2, N3, N4, N5 et al." and rows[0].abstract == "a b b c" and rows[0].full_text_url == "http://x.org/a.pdf"
    assert (rows[0].year, rows[1].year, rows[1].authors, rows[1].locator) == ("2019", "1999", "", "W2")
    assert len(found(spark, "openalex", OPENALEX, 1)[1]) == 1 and not found(spark, "openalex", OPENALEX, 0)[1]


@pytest.mark.parametrize("engine, body, total, want", [
    ("crossref", CROSSREF, 3, ("10.1/x", "A b c", "Ada L, Bob", "2021", "10.1/x", "Text", "https://x/2")),
    ("semantic-scholar", SEMANTIC, 1, ("p", "T", "A", "2020", "arXiv:1.2", "", "")),
    ("europepmc", EUROPE, 2, ("5", "T", "A B", "2001", "PMID:5", "", "https://e/p")),
    ("core", CORE, 4, ("12", "T", "A", "2010", "CORE:12", "", "https://c/1")),
    ("arxiv", ARXIV, 2, ("2208.07815v1", "On things", "Ada, Bob", "2022", "http://arxiv.org/abs/2208.07815v1", "S", "https://arxiv.org/pdf/2208.07815v1.pdf")),
])
def test_services(spark, engine, body, total, want):
    got, rows = found(spark, engine, body)
    assert got == total and [tuple(r)[3:] for r in rows] == [want]


@pytest.mark.parametrize("engine", sorted(answers.ENGINES))
def test_odd_answers(spark, engine):
    frame = spark.createDataFrame([(None,), ("",), ("{",), ("[]",), ("<feed>",), ('{"results": 3, "data": {}, "message": []}',)], "body string")
    assert answers.candidates(frame, "body", engine, 5).count() == 0
    assert {r[0] for r in frame.select(answers.declared(F.col("body"), engine)).collect()} == {-1}


def test_inverted(spark):
    rows = spark.createDataFrame([({"x": [2, -1], "y": [0]},), (None,), ({},), ({"far": [20000]},), ({"n": None},)], "m map<string,array<int>>")
    assert [r[0] for r in rows.select(strings.from_inverted(F.col("m"))).collect()] == ["y x", "", "", "", ""]


def test_pages(spark):
    rows = [("q", p, i, k) for p, keys in ((1, "ab"), (2, "bc"), (3, "ac"), (4, "d")) for i, k in enumerate(keys)] + [("r", 1, 0, "a")]
    frame = spark.createDataFrame([(q, p, i, k, "t") for q, p, i, k in rows], "q string, page int, place int, locator string, title string")
    got = lambda n: sorted((r.q, r.locator) for r in answers.paged(frame, ["q"], "page", n).collect())
    assert got(9) == [("q", "a"), ("q", "b"), ("q", "c"), ("r", "a")] and got(2) == [("q", "a"), ("q", "b"), ("r", "a")]
