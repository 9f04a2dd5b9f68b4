"""Answers of paper search services, one parse each: candidates as rows, declared totals, pages up to the first quiet one.

A candidate is struct<engine, id, title, authors, year, locator, abstract, full_text_url>, all strings and never null. Answers that
cannot be parsed, empty and null ones hold no candidate; a field of an unexpected type counts as absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import strings

MOST_TEXT, MOST_AUTHORS = 64 * 1024, 6

#: The part of each service's answer that is read.
SCHEMAS = {
    "openalex": "meta struct<count:bigint>, results array<struct<id:string, doi:string, title:string, publication_year:string, authorships:array<struct<author:struct<display_name:string>>>, abstract_inverted_index:map<string,array<int>>, best_oa_location:struct<pdf_url:string, landing_page_url:string>, open_access:struct<oa_url:string>>>",
    "crossref": "message struct<`total-results`:bigint, items:array<struct<DOI:string, ID:string, title:array<string>, `original-title`:array<string>, author:array<struct<given:string, family:string>>, issued:struct<`date-parts`:array<array<string>>, `date-time`:string>, created:struct<`date-time`:string>, abstract:string, `open-access`:struct<is_oa:string, status:string>, link:array<struct<`content-type`:string, URL:string>>, resource:struct<primary:struct<URL:string>>>>>",
    "semantic-scholar": "total bigint, data array<struct<paperId:string, externalIds:struct<DOI:string, ArXiv:string>, title:string, authors:array<struct<name:string>>, year:string, abstract:string, openAccessPdf:struct<url:string>>>",
    "europepmc": "hitCount bigint, resultList struct<result:array<struct<id:string, pmid:string, pmcid:string, doi:string, title:string, authorList:struct<author:array<struct<firstName:string, lastName:string>>>, pubYear:string, bookOrReportDetails:struct<pubYear:string>, abstractText:string, isOpenAccess:string, fullTextUrlList:struct<fullTextUrl:array<struct<documentStyle:string, url:string>>>>>>",
    "core": "resultsSize bigint, total bigint, results array<struct<coreId:string, id:string, identifiers:struct<doi:string>, doi:string, title:string, authors:array<struct<name:string>>, yearPublished:string, publishedDate:string, year:string, abstract:string, links:array<struct<type:string, uri:string, url:string>>, fullTextUrl:string, landingPageUri:string>>",
    "arxiv": "totalResults string, entry array<struct<id:string, title:string, summary:string, published:string, updated:string, author:array<struct<name:string>>, link:array<struct<_href:string, _title:string>>>>",
}


def _first(*values: Column) -> Column:
    """The first that is not blank, trimmed; else empty."""
    return F.coalesce(*(F.when(F.trim(x) != "", F.trim(x)) for x in values), F.lit(""))


def _plain(text: Column) -> Column:
    """Without markup, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def _year(text: Column) -> Column:
    """The first number of exactly four digits from 1500 to 2200."""
    return F.regexp_extract(text, r"(?<![0-9])(1[5-9][0-9]{2}|2[01][0-9]{2}|2200)(?![0-9])", 1)


def _names(people: Column, name: Callable[[Column], Column], more: str = "") -> Column:
    """Distinct names in order, six at most, `more` behind a full list."""
    named = F.coalesce(F.array_distinct(F.filter(F.transform(people, name), lambda x: x != "")), F.array().cast("array<string>"))
    return F.concat(F.array_join(F.slice(named, 1, MOST_AUTHORS), ", "), F.when(F.size(named) >= MOST_AUTHORS, more).otherwise(""))


def _web(*urls: Column) -> Column:
    return _first(*(F.when(F.trim(x).rlike("^https?://"), x) for x in urls))


def _typed(links: Column, kind: str, want: str, url: str) -> Column:
    """The first web address of links whose kind holds a word."""
    fit = F.filter(links, lambda x: F.contains(F.lower(x[kind]), F.lit(want)) & F.trim(x[url]).rlike("^https?://"))
    return F.trim(F.get(fit, F.lit(0))[url])


def _best(*urls: Column) -> Column:
    """The address likeliest to be a file, the earlier one of equals: https, http, resolvers of DOIs, pages."""
    ranked = [F.when(x.rlike(r"(?i)^https?://([^/]*\.)?doi\.org(/|$)"), 3).when(x.rlike(r"(?i)\.(html?|xhtml)([?#]|$)"), 4).when(x.rlike("(?i)^https://"), 1).otherwise(2) for x in urls]
    pairs = F.array(*(F.when(F.trim(x) != "", F.struct(r.alias("rank"), F.lit(i).alias("place"), F.trim(x).alias("url"))) for i, (x, r) in enumerate(zip(urls, ranked, strict=True))))
    return F.coalesce(F.array_min(F.filter(pairs, lambda p: p.isNotNull()))["url"], F.lit(""))


def _row(engine: str, **fields: Column) -> Column:
    cut = F.substring(fields["abstract"], 1, MOST_TEXT)
    return F.struct(F.lit(engine).alias("engine"), *(F.coalesce(cut if k == "abstract" else fields[k], F.lit("")).alias(k) for k in ("id", "title", "authors", "year", "locator", "abstract", "full_text_url")))


def _prefixed(prefix: str, value: Column) -> Column:
    return F.when(F.trim(value) != "", F.concat(F.lit(prefix), F.trim(value)))


def _openalex(x: Column) -> Column:
    place = x["best_oa_location"]
    return _row("openalex", id=_first(x["id"]), title=_first(x["title"]), authors=_names(x["authorships"], lambda a: _first(a["author"]["display_name"]), " et al."), year=_year(x["publication_year"]), locator=_first(x["doi"], x["id"]), abstract=strings.from_inverted(x["abstract_inverted_index"]), full_text_url=_best(_web(place["pdf_url"]), _web(place["landing_page_url"]), _web(x["open_access"]["oa_url"])))


def _crossref(x: Column) -> Column:
    doi = _first(x["DOI"], x["ID"])
    part = F.get(F.get(x["issued"]["date-parts"], F.lit(0)), F.lit(0))
    free = (F.lower(x["open-access"]["is_oa"]) == "true") | F.lower(x["open-access"]["status"]).isin("open", "accepted", "submitted")
    return _row("crossref", id=doi, title=_plain(_first(F.get(x["title"], F.lit(0)), F.get(x["original-title"], F.lit(0)), x["DOI"])), authors=_names(x["author"], lambda a: F.trim(F.concat_ws(" ", F.trim(a["given"]), F.trim(a["family"])))), year=_year(_first(part, x["issued"]["date-time"], x["created"]["date-time"])), locator=doi, abstract=_plain(x["abstract"]), full_text_url=F.when(free, _first(_typed(x["link"], "content-type", "application/pdf", "URL"), _web(x["resource"]["primary"]["URL"]))))


def _semantic(x: Column) -> Column:
    ids = x["externalIds"]
    return _row("semantic-scholar", id=_first(x["paperId"]), title=_first(x["title"]), authors=_names(x["authors"], lambda a: _first(a["name"]), " et al."), year=_year(x["year"]), locator=_first(ids["DOI"], _prefixed("arXiv:", ids["ArXiv"]), x["paperId"]), abstract=_plain(x["abstract"]), full_text_url=_web(x["openAccessPdf"]["url"]))


def _europepmc(x: Column) -> Column:
    links = x["fullTextUrlList"]["fullTextUrl"]
    return _row("europepmc", id=_first(x["pmid"], x["id"]), title=_first(x["title"]), authors=_names(x["authorList"]["author"], lambda a: F.trim(F.concat_ws(" ", F.trim(a["firstName"]), F.trim(a["lastName"])))), year=_year(_first(x["pubYear"], x["bookOrReportDetails"]["pubYear"])), locator=_first(x["doi"], _prefixed("PMID:", x["pmid"]), x["pmcid"]), abstract=_plain(x["abstractText"]), full_text_url=F.when(F.lower(F.trim(x["isOpenAccess"])) == "y", _first(_typed(links, "documentStyle", "pdf", "url"), _typed(links, "documentStyle", "xml", "url"))))


def _core(x: Column) -> Column:
    link = F.get(x["links"], F.lit(0))
    number = _first(x["coreId"], x["id"])
    return _row("core", id=number, title=_first(x["title"]), authors=_names(x["authors"], lambda a: _first(a["name"]), " et al."), year=_year(_first(x["yearPublished"], x["publishedDate"], x["year"])), locator=_first(x["identifiers"]["doi"], x["doi"], _prefixed("CORE:", number)), abstract=_plain(x["abstract"]), full_text_url=_first(_typed(x["links"], "type", "pdf", "uri"), _web(x["fullTextUrl"], x["landingPageUri"], link["uri"], link["url"])))


def _arxiv(x: Column) -> Column:
    address = _first(x["id"])
    number = F.regexp_replace(F.regexp_replace(address, r"^.*?://[^/]*/(abs/|pdf/)?", ""), r"(?i)(\.pdf)?(\?.*)?$", "")
    given = F.get(F.filter(x["link"], lambda k: F.lower(k["_title"]) == "pdf"), F.lit(0))["_href"]
    return _row("arxiv", id=F.regexp_extract(address, "([^/]*)$", 1), title=_plain(x["title"]), authors=_names(x["author"], lambda a: _plain(a["name"])), year=_year(_first(x["published"], x["updated"])), locator=address, abstract=_plain(x["summary"]), full_text_url=_first(F.when(number != "", F.concat(F.lit("https://arxiv.org/pdf/"), number, F.lit(".pdf"))), given))


#: Where the entries and the declared total of an answer stand, and how an entry is read.
ENGINES: dict[str, tuple[Callable, Callable, Callable]] = {
    "openalex": (lambda a: a["results"], lambda a: a["meta"]["count"], _openalex),
    "crossref": (lambda a: a["message"]["items"], lambda a: a["message"]["total-results"], _crossref),
    "semantic-scholar": (lambda a: a["data"], lambda a: a["total"], _semantic),
    "europepmc": (lambda a: a["resultList"]["result"], lambda a: a["hitCount"], _europepmc),
    "core": (lambda a: a["results"], lambda a: F.coalesce(a["resultsSize"], a["total"]), _core),
    "arxiv": (lambda a: a["entry"], lambda a: F.regexp_extract(a["totalResults"], "([0-9]+)", 1).try_cast("bigint"), _arxiv),
}


def _answer(body: Column, engine: str) -> Column:
    if engine == "arxiv":
        return F.from_xml(F.when(F.contains(body, F.lit("<")), body), SCHEMAS[engine], {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return F.from_json(body, SCHEMAS[engine], {"mode": "PERMISSIVE"})


def declared(body: Column, engine: str) -> Column:
    """How many entries the service says it has; -1 where it does not say."""
    return F.coalesce(ENGINES[engine][1](_answer(body, engine)), F.lit(-1).cast("bigint"))


def _key(x: Column) -> Column:
    return F.when(x["locator"] != "", x["locator"]).otherwise(x["title"])


def candidates(answers: DataFrame, body: str, engine: str, limit: int) -> DataFrame:
    """The answers' columns, the place of each candidate in its answer and its fields. Entries without title and abstract, and repeats
    of an earlier locator (or title, where there is no locator) of the same answer, are left out; at most `limit` of an answer."""
    if limit < 0:
        raise ValueError("limit is negative")
    items, _, read = ENGINES[engine]
    rows = F.filter(F.transform(items(_answer(F.col(body), engine)), read), lambda x: (x["title"] != "") | (x["abstract"] != ""))
    known = answers.withColumn("_rows", rows).withColumn("_keys", F.transform("_rows", _key))
    new = F.filter("_rows", lambda x, i: (_key(x) == "") | (F.array_position(F.col("_keys"), _key(x)) == i + 1))
    kept = known.withColumn("_rows", F.slice(new, 1, limit) if limit else F.slice(new, 1, 0))
    return kept.select(*(F.col(c) for c in answers.columns if c != body), F.posexplode("_rows").alias("place", "_row")).select("*", "_row.*").drop("_row")


def paged(found: DataFrame, by: list[str], page: str, limit: int) -> DataFrame:
    """Candidates over the pages of each search: each locator (or title) at its first page and place, pages from the first quiet one on
    left out (a page is quiet if it brings nothing new; pages start with the search's least number), `limit` rows of a search."""
    row = F.struct(*(F.col(c) for c in found.columns if c not in by))
    key = F.when(F.col("locator") != "", F.col("locator")).otherwise(F.col("title"))
    first = found.groupBy(*by, key.alias("_key")).agg(F.min_by(row, F.struct(page, "place")).alias("_row")).select(*by, "_row.*")
    fresh = first.groupBy(*by, page).count()
    gap = F.col(page) - F.row_number().over(Window.partitionBy(*by).orderBy(page))
    # pages that bring something new stand in one run from the first; a gap in their numbers is a quiet page
    run = fresh.withColumn("_gap", gap).withColumn("_least", F.min("_gap").over(Window.partitionBy(*by))).where("_gap = _least").select(*by, page)
    order = Window.partitionBy(*by).orderBy(page, "place")
    return first.join(run, [*by, page], "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
