"""Every query against its SQL on the smallest tables, and defined cases of the text functions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import spans as S
from tessera.functions import text as T
from tessera.operators import fuzzy, spans

DIR = "/root/testdata/sf0.001"
TABLES = ("benchmark", "conversations", "documents", "events", "labels", "lineitem", "pages")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_percentile_places_round_as_the_sql_does(spark, tmp_path):
    sizes = [(f"s{n}" if n else None, n or 4) for n in range(30)]
    rows = [(s, None if k % 11 == 10 or s == "s1" else k * k % 37) for s, n in sizes for k in range(n)]
    spark.createDataFrame(rows, "source string, n_chars long").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = own.sql(catalogue.oracle_sql()["q_floor_percentile"]).fetchall()
    assert set(map(tuple, catalogue.queries()["q_floor_percentile"](spark, str(tmp_path)).select("source", "p90").collect())) == set(want) and len(want) == 30


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0


def of(spark, expression, *texts):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(expression(F.col("text"))).collect()]


def test_sentences(spark):
    cases = {
        "One 0. 1 two! …?\n 22 ": ["One 0.", "1 two!", "…?", "22"],
        "pi is 3.14 now. and e.g. this": ["pi is 3.14 now.", "and e.g.", "this"],
        "A.B is x.y": ["A.", "B is x.y"],
        "他说：“好。”然后走了。第二句！？结束": ["他说：“好。”", "然后走了。", "第二句！？", "结束"],
        "wait... what": ["wait... what"],
        "": [],
    }
    assert of(spark, T.sentences, *cases) == list(cases.values())


def test_folding_keeps_places_and_scripts(spark):
    texts = ["ＡＢＣ１，。「體國」 İSTANBUL ΣΑΣ—“x”", "\u200bzero\u00a0width\ue000", "Привет ΑΒΓ 學習"]
    got = of(spark, T.folded, *texts)
    assert [len(x) for x in got] == [len(x) for x in texts] and got[0] == "abc1,.[体国] istanbul σασ-\"x\"" and got[2] == "привет αβγ 学习"
    assert of(spark, T.compact, *texts)[1] == "zerowidth" and of(spark, T.valid_chars, *texts)[2] == 11
    assert of(spark, T.sentence_key, "(1) 2. Some text here", "iv) first. x", "3.14 is pi", "- [2] dash") == ["sometexthere", "first.x", "3.14ispi", "dash"]
    assert of(spark, T.han_count, "學習 abc")[0] == 2


def test_texts_of_other_scripts_are_not_copies(spark):
    docs = spark.createDataFrame(enumerate(["学习机器", "语言模型", "Привет", "Γεια", "", "Hello", "ＨＥＬＬＯ"]), "doc_id long, text string")
    keys = [r[0] for r in docs.select(F.sha2(T.compact(F.col("text")), 256)).collect()]
    assert len(set(keys)) == 6


def test_merge_joins_touching_and_drops_inverted(spark):
    rows = spark.createDataFrame([("a", 0, 2), ("a", 2, 4), ("a", 9, 5), ("a", 6, 7), ("a", 1, 3)], "k string, start int, end int")
    assert sorted(map(tuple, spans.merge(rows, "k").collect())) == [("a", 0, 4), ("a", 6, 7)]


def test_span_arrays(spark):
    r = random.Random(1)
    cases = [([(a, a + r.randint(-1, 6)) for a in (r.randint(-2, 30) for _ in range(r.randint(0, 6)))], [(a, a + r.randint(1, 5)) for a in (r.randint(0, 30) for _ in range(r.randint(0, 4)))], r.randint(0, 30)) for _ in range(150)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, a {S.SPANS}, b {S.SPANS}, p int").repartition(4)
    m, n, at = S.merged(F.col("a")), S.merged(F.col("b")), F.col("p")
    got = df.select("k", m.alias("m"), S.merged(F.col("a"), 1, F.lit(20)).alias("m1"), S.minus(m, n).alias("minus"), S.meet(m, n).alias("meet"), S.inside(m, at).alias("inside"), S.covers(m, at, at + 2).alias("covers"), S.overlaps(m, at, at + 2).alias("overlaps"), S.holder(m, at).alias("holder"), S.size(m).alias("size"), S.same_context(m, at, at + 1).alias("same"), S.longest_run(F.array_sort(F.array_distinct(F.transform("a", lambda x: x["start"])))).alias("run"), S.nearest(m, at)["start"].alias("near")).collect()

    def islands(places):
        out = []
        for x in sorted(places):
            if out and out[-1][1] == x:
                out[-1][1] = x + 1
            else:
                out.append([x, x + 1])
        return [tuple(x) for x in out]

    places = lambda spans: {x for a, b in spans for x in range(max(a, 0), b)}
    plain = lambda spans: [(x.start, x.end) for x in spans]
    for x in got:
        a, b, p = cases[x.k]
        left, right = places(a), places(b)
        spans = islands(left)
        assert plain(x.m) == spans and plain(x.minus) == islands(left - right) and places(plain(x.meet)) == left & right
        assert x.inside == (p in left) and x.covers == ({p, p + 1} <= left) and x.overlaps == bool({p, p + 1} & left) and x.size == len(left)
        home = lambda q, spans=spans: next((k for k, (s, e) in enumerate(spans) if s <= q < e), -1)
        assert x.holder == home(p) and x.same == (home(p - 1) == home(p + 1))
        joined = {q for q in left if q < 20}
        assert plain(x.m1) == islands(joined | {q for q in range(20) if q - 1 in joined and q + 1 in joined})
        starts = {s for s, _ in a}
        assert x.run == max((e - s for s, e in islands({s + 2 for s in starts})), default=0)
        assert x.near == min(((max(s - p, p - e + 1, 0), k, s) for k, (s, e) in enumerate(spans)), default=(0, 0, None))[2]


def test_edits_shift_spans(spark):
    row = spark.range(1).select(S.shifted(F.array(S.span(F.lit(0), F.lit(4)), S.span(F.lit(5), F.lit(9))), F.lit(2), F.lit(3)).alias("s")).first()
    assert [(x.start, x.end) for x in row.s] == [(0, 7), (8, 12)]


def test_fuzzy_channels(spark):
    base = "机器学习模型在许多任务中表现出色并且稳定"
    texts = [base, base[::-1], base + "。" + "unrelated words in latin letters follow here", "完全不同的句子谈论天气与饮食和旅行的计划", "表现出色并且稳定机器学习模型在许多任务中"]
    entries = spark.createDataFrame([(1, base)], "e long, e_key string")
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "q long, q_key string")
    got = {r.q: r.score for r in fuzzy.rescued(entries, queries).collect()}
    assert got[0] == 1.0 and got[1] == 1.0 and 3 not in got and 4 in got
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sources = spark.createDataFrame([(7, base + "。")], "item_id long, text string")
    best = {r.q_key: r.score for r in fuzzy.best(docs, sources).collect()}
    assert best[base] > 0.9 and texts[4] in best and base[::-1] not in best and texts[3] not in best


def test_pairs_below_the_floors_are_never_rows(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choices("abcdef", k=r.randint(2, 6))) for _ in range(60)] + ["机器学习", "模型", "语言任务", "表现出色"]
    texts = ["".join(r.choices(words, k=r.randint(4, 14))) for _ in range(120)]
    texts += [t[: len(t) // 2 + k % 9] for k, t in enumerate(texts[:40])] + [t[::-1] for t in texts[:10]] + ["学习机器模型任务语言出色表现", "机器学习模型语言任务表现出色", "x" * 20]
    entries = spark.createDataFrame(list(enumerate(texts[::3])), "e long, e_key string")
    queries = spark.createDataFrame(list(enumerate(texts)), "q long, q_key string")
    monkeypatch.setattr(fuzzy, "STOP", 12)
    got = sorted(map(tuple, fuzzy._counted(entries, queries).collect()), key=repr)
    monkeypatch.setattr(fuzzy, "ROWS", 0)
    want = sorted(map(tuple, fuzzy._counted(entries, queries).collect()), key=repr)
    pairs = fuzzy.candidates(entries, queries).count()
    bag = [x for x in got if x[3] is None]
    keys = {x[0] for x in bag}
    assert [x for x in got if x[3] is not None] == [x for x in want if x[3] is not None] and len(got) < pairs
    assert set(bag) <= set(want) and all(_not_latin(texts[q]) for q in keys) and all(x in bag for x in want if x[3] is None and _not_latin(texts[::3][x[1]]))


def _not_latin(text):
    return 2 * sum("a" <= c <= "z" for c in text) < len(text)


def test_signatures_and_bags(spark):
    df = spark.createDataFrame([("abcabc", "bcab")], "a string, b string").select(T.grams(F.col("a")).alias("x"), T.grams(F.col("b")).alias("y"), T.bag(F.col("a")).alias("bag"))
    row = df.select("*", T.dice(F.col("x"), F.col("y")).alias("d"), T.agreement(T.signature(F.col("x")), T.signature(F.col("x"))).alias("same"), T.agreement(T.signature(F.col("x")), T.signature(F.col("y"))).alias("some")).first()
    assert row.x == ["abc", "bca", "cab"] and row.bag == ["a", "b", "c"] and row.d == pytest.approx(0.8) and row.same == 16 and 4 <= row.some <= 16
