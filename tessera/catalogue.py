"""Every query of the library with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import similarity, spans, style
from tessera.plans import calibration, ledgers, matching, measures, pages, ranking, rhythm, strings  # noqa: F401  they register queries
from tessera.plans.register import BLANKS, COMPACT, LINES, QUERIES, SEEN, SENTENCES, SQL, WORDS, Query, fragments_sql, query

FLAGSHIP = "q_contam_verbatim"


@query("q_valid_chars", f"select doc_id, {SEEN} valid_chars, sha256({COMPACT}) compact_hash from documents", "documents")
def _valid(docs):
    return docs.select("doc_id", T.valid_chars(F.col("text")).alias("valid_chars"), F.sha2(T.compact(F.col("text")), 256).alias("compact_hash"))


@query("q_exact_dup_groups", f"select sha256({COMPACT}) compact_hash, count(*) n, min(doc_id) first_id from documents group by 1 having count(*) > 1", "documents")
def _dups(docs):
    return docs.groupBy(F.sha2(T.compact(F.col("text")), 256).alias("compact_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("q_sentences", f"select doc_id, len({SENTENCES}) n_sentences from documents", "documents")
def _sentences(docs):
    return docs.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("q_dup_lines", f"select line, count(*) n, count(distinct doc_id) n_docs from (select doc_id, unnest({LINES}) line from documents) group by 1 having count(*) > 1", "documents")
def _dup_lines(docs):
    rows = docs.select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    return rows.groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).filter("n > 1")


@query("q_contam_verbatim", f"""with known as (select distinct fragment from ({fragments_sql('item_id', 'benchmark')})),
copied as (select doc_id, sum(size) copied from ({fragments_sql('doc_id', 'documents')}) where fragment in (select fragment from known) group by 1)
select doc_id, {SEEN} valid_chars, coalesce(copied, 0)::bigint copied_chars, round(100.0::double * coalesce(copied, 0) / nullif({SEEN}, 0), 6) rate from documents left join copied using (doc_id)""", "documents", "benchmark")
def _contaminated(docs, benchmark):
    return similarity.verbatim_share(docs, benchmark)


def _shingle_sql(key: str, table: str) -> str:
    return f"select distinct {key}, array_to_string(w[i:i+7], ' ') gram from (select {key}, w, unnest(range(1, len(w) - 6)) i from (select {key}, {WORDS} w from {table}))"


@query("q_containment", f"""with items as ({_shingle_sql('item_id', 'benchmark')}), grams as ({_shingle_sql('doc_id', 'documents')}),
size as (select item_id, count(*) of_item from items group by 1)
select item_id, doc_id, count(*) shared, any_value(of_item) of_item, round(count(*) / any_value(of_item), 6) containment from grams join items using (gram) join size using (item_id) group by 1, 2""", "documents", "benchmark")
def _containment(docs, benchmark):
    return similarity.containment(docs, benchmark)


@query("q_char_entropy", f"""select doc_id, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) + 0.0::double char_entropy from
(select doc_id, c, count(*) n from (select doc_id, unnest(string_split(regexp_replace(text, '{BLANKS}', '', 'g'), '')) c from documents) where c <> '' group by 1, 2) group by 1""", "documents")
def _char_entropy(docs):
    return style.char_entropy(docs)


@query("q_bigram_entropy", f"""select doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0::double bigram_entropy from
(select doc_id, g, count(*) n from (select doc_id, array_to_string(w[i:i+1], ' ') g from (select doc_id, w, unnest(range(1, len(w))) i from (select doc_id, {WORDS} w from documents))) group by 1, 2) group by 1""", "documents")
def _bigram_entropy(docs):
    return style.bigram_entropy(docs)


@query("q_vocabulary", f"""select doc_id, sum(n)::bigint words, count(*) types, count(*) filter (n = 1) hapaxes, round(count(*) / sum(n), 6) type_ratio from
(select doc_id, w, count(*) n from (select doc_id, unnest({WORDS}) w from documents) group by 1, 2) group by 1""", "documents")
def _vocabulary(docs):
    return style.vocabulary(docs)


@query("q_sentence_rhythm", f"""select doc_id, count(*) sentences, round(avg(n), 6) mean_length, round(stddev_pop(n) / avg(n), 6) length_cv from
(select doc_id, {SEEN} n from (select doc_id, unnest({SENTENCES}) as text from documents)) where n > 0 group by 1""", "documents")
def _rhythm(docs):
    return style.sentence_rhythm(docs)


@query("q_opening", f"""select doc_id, sum(n)::bigint sentences, max(n) most from (select doc_id, w, count(*) n from (select doc_id, {WORDS}[1] w from (select doc_id, unnest({SENTENCES}) as text from documents)) where w is not null group by 1, 2) group by 1""", "documents")
def _opening(docs):
    return style.opening(docs)


@query("q_span_merge", """with s as (select l_orderkey k, l_linenumber * 10 a, l_linenumber * 10 + l_quantity::int b from lineitem),
n as (select *, case when a <= max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end new from s where b > a),
i as (select *, sum(new) over (partition by k order by a, b rows unbounded preceding) island from n)
select k, min(a) as "start", max(b) as "end" from i group by k, island""", "lineitem")
def _merge(items):
    return spans.merge(items.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end")), "k")


@query("q_per_source_cap", "select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) r from documents) where r <= 5", "documents")
def _cap(docs):
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.select("source", "doc_id", "n_chars", r.alias("r")).filter("r <= 5").drop("r")


@query("q_inventory_rollup", "select source, lang, count(*) n, sum(n_chars)::bigint chars from documents group by rollup (source, lang)", "documents")
def _rollup(docs):
    return docs.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("q_page_host", r"select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) host, count(*) n, sum(strlen(html))::bigint bytes from pages group by 1", "pages")
def _hosts(pages):
    return pages.groupBy(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query("q_conv_merge", "select conv_id, count(*) turns, string_agg(text, chr(10) order by turn) merged from conversations group by 1", "conversations")
def _conversations(rows):
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("merged"))


@query("q_events_json", "select event_type, count(*) n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint k_sum from events group by 1", "events")
def _events(events):
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@query("q_fold_split", "select doc_id, ('0x' || substr(md5(text), 1, 8))::bigint % 5 fold from documents", "documents")
def _folds(docs):
    return docs.select("doc_id", (F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % 5).alias("fold"))


@query("q_quality_by_source", "select source, count(*) n, avg(quality) quality, avg(toxic) toxic from documents join labels using (doc_id) group by 1", "documents", "labels")
def _quality(docs, labels):
    return docs.join(labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
