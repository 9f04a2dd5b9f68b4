"""Queries that judge scores against labels, mine words and sample by stratum."""

from pyspark.sql import functions as F

from tessera.operators import calibration

from .register import COMPACT, WORDS, query

_SCORED = "select n_chars score, quality as label from documents join labels using (doc_id)"


def _scored(docs, labels):
    return docs.join(labels, "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))


@query("q_auc_quality", f"""with c as (select score, count(*) filter (label = 1) pos, count(*) filter (label = 0) neg from ({_SCORED}) group by 1), r as (select pos, neg, sum(neg) over (order by score) - neg below from c)
select sum(pos)::bigint n_pos, sum(neg)::bigint n_neg, round(sum(pos * (below + neg / 2.0::double)) / (sum(pos)::double * sum(neg)), 6) auc from r""", "documents", "labels")
def _auc(docs, labels):
    return calibration.auc(_scored(docs, labels))


@query("q_fp_operating_point", f"""with s as ({_SCORED}), t as (select quantile_cont(score, 0.99) threshold from s where label = 0)
select threshold::double threshold, round(count(*) filter (score > threshold and label = 0) / count(*) filter (label = 0), 6) false_share, round(count(*) filter (score > threshold and label = 1) / count(*) filter (label = 1), 6) hit_share from s, t group by 1""", "documents", "labels")
def _operating(docs, labels):
    return calibration.operating_point(_scored(docs, labels))


@query("q_percentiles", "select source, round(quantile_cont(n_chars, 0.5)::double, 6) p50, round(quantile_cont(n_chars, 0.9)::double, 6) p90, round(quantile_cont(n_chars, 0.99)::double, 6) p99 from documents group by 1", "documents")
def _percentiles(docs):
    return docs.groupBy("source").agg(*(F.round(F.percentile("n_chars", p / 100), 6).alias(f"p{p}") for p in (50, 90, 99)))


@query("q_logodds_lexicon", f"""with w as (select w, count(*) filter (quality = 1) n1, count(*) filter (quality = 0) n0 from (select quality, unnest({WORDS}) w from documents join labels using (doc_id)) group by 1), a as (select sum(n1) all1, sum(n0) all0, count(*) kinds from w)
select w, n1, n0, round(ln((n1 + 1.0::double) / (all1 + kinds)) - ln((n0 + 1.0::double) / (all0 + kinds)), 6) + 0.0::double log_odds from w, a""", "documents", "labels")
def _lexicon(docs, labels):
    return calibration.log_odds(docs.join(labels, "doc_id").select("text", F.col("quality").alias("label")))


@query("q_quality_reject", f"""select doc_id, case when n < 60 then 'short' when n > 50000 then 'long' when regexp_matches(lower(text), 'https?:|doi[.]org') then 'link' when 10 * digits > 3 * n then 'digits' when 10 * letters < 6 * n then 'letters' else 'kept' end reason from
(select doc_id, text, length(regexp_replace(text, '[\\x09-\\x0D\\x20]', '', 'g')) n, length({COMPACT}) letters, length(regexp_replace(text, '[^0-9]', '', 'g')) digits from (select doc_id, coalesce(text, '') as text from documents))""", "documents")
def _reject(docs):
    return calibration.reject_reason(docs)


@query("q_stratified_quota", "select doc_id, source, band from (select *, row_number() over (partition by source, band order by md5(doc_id::varchar), doc_id) r from (select doc_id, source, case when n_chars < 500 then 0 when n_chars < 2000 then 1 when n_chars < 8000 then 2 else 3 end band from documents)) where r <= 3", "documents")
def _quota(docs):
    return calibration.quota(docs)


@query("q_domain_balance", "select source, quality, count(*) n, round(1.0::double / count(*), 9) weight from documents join labels using (doc_id) group by 1, 2", "documents", "labels")
def _balance(docs, labels):
    return docs.join(labels, "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n")).withColumn("weight", F.round(1.0 / F.col("n"), 9))
