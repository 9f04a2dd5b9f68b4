"""Queries on spans: subtraction, intersection, bridging, exclusive ledgers, first-claim attribution. Rows of lineitem serve as spans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import spans

from .register import query

_SPANS = "select l_orderkey k, l_linenumber * 10 a, l_linenumber * 10 + l_quantity::int b, l_returnflag f, l_linenumber id from lineitem"
_POINTS = f"select k, f, a, b, id, unnest(range(a, b)) p from ({_SPANS})"
_ISLANDS = 'select k, min(p) as "start", (max(p) + 1) as "end" from (select k, p, p - row_number() over (partition by k order by p) g from {0}) group by k, g'


def _spans(items: DataFrame) -> DataFrame:
    start = (F.col("l_linenumber") * 10).cast("long")
    return items.select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("id"))


def _sides(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _spans(items)
    return rows.filter("f = 'N'"), rows.filter("f <> 'N'")


@query("q_span_subtract", f"with p as ({_POINTS}), d as (select distinct k, p from p where f = 'N' and (k, p) not in (select (k, p) from p where f <> 'N')) {_ISLANDS.format('d')}", "lineitem")
def _subtract(items):
    return spans.subtract(*_sides(items), "k")


@query("q_span_intersect", f"with p as ({_POINTS}), d as (select distinct k, p from p where f = 'N' and (k, p) in (select (k, p) from p where f <> 'N')) {_ISLANDS.format('d')}", "lineitem")
def _intersect(items):
    return spans.merge(spans.intersect(*_sides(items), "k"), "k")


@query("q_span_bridge", f"""with s as (select * from ({_SPANS}) where b > a), n as (select *, case when a <= 2 + max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end new from s),
i as (select *, sum(new) over (partition by k order by a, b rows unbounded preceding) island from n) select k, min(a) as "start", max(b) as "end" from i group by k, island""", "lineitem")
def _bridge(items):
    return spans.merge_near(_spans(items), "k", 2)


@query("q_char_ledger", f"""with q as (select k, p, bool_or(f = 'A') e, bool_or(f = 'R') d, bool_or(f = 'N') c from ({_POINTS}) group by 1, 2)
select k, (max(p) + 1)::bigint total, count(*) filter (e) excluded, count(*) filter (not e and d) duplicate, count(*) filter (not e and d and c) cited, (max(p) + 1 - count(*) filter (e) - count(*) filter (not e and d))::bigint own from q group by 1""", "lineitem")
def _ledger(items):
    kind = F.create_map(*(F.lit(x) for x in ("A", "excluded", "R", "duplicate", "N", "cited")))[F.col("f")]
    return spans.ledger(_spans(items).withColumn("kind", kind), "k")


@query("q_char_attribution", f"select k, id, count(*) places from (select k, id, row_number() over (partition by k, p order by a, b, id) r from ({_POINTS})) where r = 1 group by 1, 2", "lineitem")
def _attributed(items):
    return spans.attributed(_spans(items), "k", "id")
