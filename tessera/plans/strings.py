"""Queries on scalar functions, import and retention."""

from pyspark.sql import functions as F

from tessera.functions import strings
from tessera.operators import library

from .register import COMPACT, SEEN, query


@query("q_html_escape", "select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) escaped from documents", "documents")
def _escaped(docs):
    return docs.select("doc_id", F.md5(strings.html_escaped(F.col("text"))).alias("escaped"))


@query("q_url_rank", "select page_id, case when not regexp_matches(lower(url), '^https?://[^/]+') then 3 when regexp_matches(lower(url), '[.]pdf($|[?#])') then 0 when regexp_matches(lower(url), '/(pdf|download|fulltext)(/|$|[?#])') then 1 else 2 end url_rank from pages", "pages")
def _ranked(pages):
    return pages.select("page_id", strings.url_rank(F.col("url")).alias("url_rank"))


@query("q_file_name", r"""select page_id, case when n = '' then 'untitled' else n end file_name from (select page_id, regexp_replace(substr(regexp_replace(regexp_replace(url, '[\x00-\x1F\x7F<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 120), '[ .]+$', '') n from pages)""", "pages")
def _named(pages):
    return pages.select("page_id", strings.file_name(F.col("url")).alias("file_name"))


@query("q_cut", "select doc_id, case when length(text) > 80 then substr(text, 1, 79) || '…' else text end cut from documents", "documents")
def _cut(docs):
    return docs.select("doc_id", strings.cut(F.col("text"), 80).alias("cut"))


@query("q_import_receipt", f"""with d as (select doc_id, sha256({COMPACT}) h, {SEEN} n from documents), k as (select distinct h from d where doc_id % 7 = 0),
j as (select doc_id, n, case when n < 200 then 'thin' when h in (select h from k) or doc_id > min(case when n >= 200 then doc_id end) over (partition by h) then 'duplicate' else 'imported' end status from d where doc_id % 7 <> 0)
select status, count(*) n, sum(n)::bigint chars, min(doc_id) as "first" from j group by 1""", "documents")
def _import(docs):
    known = docs.filter("doc_id % 7 = 0").select(library.body_hash(F.col("text")).alias("body_hash"))
    batch = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("pos"), F.lit(None).cast("string").alias("title"), "text")
    return library.receipt(library.judged(batch, known))


@query("q_retained_turns", "select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 3", "conversations")
def _retained(rows):
    reports = rows.select("conv_id", F.col("turn").alias("created"), F.col("turn").alias("id"))
    return library.retained(reports, "conv_id", 3).select("conv_id", F.col("id").alias("turn"))


@query("q_changed_turns", """with p as (select conv_id, turn, coalesce(lag(text) over (partition by conv_id order by turn), '') a, text b from conversations)
select conv_id, turn, (select coalesce(max(k), 0) from range(1, least(length(a), length(b)) + 1) t(k) where a[1:k::bigint] = b[1:k::bigint])::bigint head from p""", "conversations")
def _changed(rows):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("before", before).select("conv_id", "turn", strings.changed(F.col("before"), F.col("text"))["start"].cast("long").alias("head"))
