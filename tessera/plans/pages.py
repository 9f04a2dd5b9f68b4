"""Queries on web pages and other semi-structured rows."""

from pyspark.sql import functions as F

from tessera.sources import answers, web

from .register import query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _readable_sql() -> str:
    text = "coalesce(html, '')"
    for pattern, by in web.STEPS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    for entity, by in web.ENTITIES:
        text = f"replace({text}, {_quoted(entity)}, {_quoted(by)})"
    return rf"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '{web.EDGES}', '', 'g'), '{web.BLANKS}', ' ', 'g')), lambda x: x <> ''), chr(10))"


_TRIMMED = f"regexp_replace(lower(coalesce(html, '')), '{web.EDGES}', '', 'g')"


@query("q_page_text", f"select page_id, length(t) readable_chars, sha256(t) text_hash from (select page_id, {_readable_sql()} t from pages)", "pages")
def _text(pages):
    return pages.select("page_id", web.readable(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("readable_chars"), F.sha2("t", 256).alias("text_hash"))


@query("q_page_shape", rf"""select shape, count(*) n from (select case when {_TRIMMED} = '' then 'empty-body' when regexp_matches(lower(html), '{'|'.join(web.BLOCKED)}') then 'blocked' when regexp_matches(lower(html), '<html|<!doctype|<script') then 'markup'
when regexp_matches({_TRIMMED}, '^[{{\[]') then 'json' else 'unknown' end shape from pages) group by 1""", "pages")
def _shapes(pages):
    return pages.groupBy(web.shape(F.col("html")).alias("shape")).agg(F.count("*").alias("n"))


@query("q_title_dedup", f"select title_key, count(*) n, min(page_id) first_page from (select page_id, regexp_replace(lower(regexp_extract(html, '{web.TITLE}', 1)), '[^a-z0-9à-öø-ÿ]', '', 'g') title_key from pages) where length(title_key) >= 6 group by 1 having count(*) > 1", "pages")
def _titles(pages):
    rows = pages.select("page_id", web.title_key(F.col("html")).alias("title_key")).filter("title_key is not null")
    return rows.groupBy("title_key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


@query("q_url_parts", r"select page_id, regexp_extract(url, '^([a-z]+)://', 1) scheme, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) path, contains(url, '?') has_query from pages", "pages")
def _urls(pages):
    return pages.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"), F.col("url").contains("?").alias("has_query"))


@query("q_event_status", "select user_id, count(*) n, count(*) filter (event_type = 'error') errors, count(distinct event_type) kinds from events group by 1", "events")
def _status(events):
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("event_type").alias("kinds"))


@query("q_answer_candidates", "select doc_id, 12 declared, sha256(trim(left(text, 80))) title_hash, 'W' || doc_id locator, case when 1400 + doc_id % 1000 between 1500 and 2200 then cast(1400 + doc_id % 1000 as varchar) else '' end paper_year from documents where trim(left(text, 80)) <> ''", "documents")
def _candidates(documents):
    entry = F.struct(F.concat(F.lit("W"), F.col("doc_id")).alias("id"), F.substring("text", 1, 80).alias("title"), (F.lit(1400) + F.col("doc_id") % 1000).alias("publication_year"))
    body = F.to_json(F.struct(F.struct(F.lit(12).alias("count")).alias("meta"), F.array(entry, entry).alias("results")))
    found = answers.candidates(documents.select("doc_id", body.alias("body"), answers.declared(body, "openalex").alias("declared")), "body", "openalex", 5)
    return found.select("doc_id", "declared", F.sha2("title", 256).alias("title_hash"), "locator", F.col("year").alias("paper_year"))
