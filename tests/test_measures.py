"""Measures, structure, entities and training helpers on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import measures as M
from tessera.functions import structure
from tessera.functions import text as T
from tessera.operators import entities, measures, training

SAMPLES = ["One 0. 1 two! …?\n 22 ", "pi is 3.14 now. and e.g. this", "他说：“好。”然后走了。第二句！？结束", "A.B is x.y", "", " \n​\n", "wait... what。」) x"]


def test_sentences_alike_in_both_forms(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "k int, text string").select("k", T.sentences(F.col("text")).alias("s"), T.folded(F.col("text")).alias("f"), T.compact(F.col("text")).alias("c"))
    for r in df.collect():
        t = SAMPLES[r.k]
        assert [t[a:b] for a, b in M.sentence_spans(t)] == r.s and M.folded(t) == r.f and M.compact(t) == r.c


def test_rhythm_of_known_paragraphs():
    got = M.rhythm("一二三四。一二三四。一二三四五六。一二三四，五六、七八。")
    v = dict(zip([c.name for c in M.CRITERIA], got.values, strict=True))
    assert got.sentences == 4 and v["R04"] == 1.0 and v["R09"] == 0.0 and v["R03"] == 0.5 and v["R15"] == 4.0
    assert v["R01"] == pytest.approx(math.sqrt(sum((x - 6) ** 2 for x in (4, 4, 6, 10)) / 4) / 6)
    assert v["R10"] == pytest.approx(((-2) * (-2) + 0 + 0) / 24) and v["R11"] == 0.0
    assert M.rhythm("").values == [0.0] * 19 and M.rhythm("文[12]和[3]。", ()).score == 0.0
    assert dict(zip([c.name for c in M.CRITERIA], M.rhythm("文[12]和[3]2。").values, strict=True))["R12"] == pytest.approx(2000 / 6)


def test_features():
    text = "First, we go; second, we stop; third, we rest, and sleep. " * 6 + "End."
    stats, spans = M.document(text)
    norm = M.folded(text)
    one = M.features(norm[slice(*spans[0])], stats)
    assert stats.sentences == 19 and one["PUNCT_SEMICOLON"] == 0.6 and "PARALLEL" not in one and one["SHAPE_REPEAT"] == 1.0 and one["REPEAT_SPAN"] == 1.0
    whole = M.features("first, second, third, go; stop", stats)
    assert whole["NUMBER_CHAIN"] == 1.0 and whole["PARALLEL"] == 1.0
    assert M.longest_repeat(["abcdefghij", "xxabcdefghijyy"]) == 10 and M.longest_repeat(["abcdefg", "abcdefg"]) == 0
    assert M.triples([5, 6, 7, 30, 5]) == 1 and M.clauses("ab, c d; e.") == [2, 2, 1]
    assert M.group_score({"A": 1.0, "B": 0.5, "C": 1.0}, {"A": ("g", 0.3), "B": ("g", 0.8), "C": ("h", 0.1)}) == pytest.approx(0.5)
    assert M.segments([0.4, 0.5, 0.1, 0.4, 0.4], [0, 0, 0, 0, 1], [10] * 5) == [(0, 2), (3, 4), (4, 5)]
    assert M.tier(100, 1, 1) == "insufficient" and M.tier(500, 0.6, 0.8) == "strong" and M.tier(500, 0, 0.1) == "none"


def test_measures_of_documents(spark):
    docs = spark.createDataFrame([(1, "一二三四。一二三四。\n\n第二段，有话。"), (2, None), (3, "A b; c. " * 9)], "doc_id long, text string")
    rows = measures.rhythm_scores(docs).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.place) for r in rows] == [(1, 0), (1, 1), (3, 0)] and all(len(r.values) == 19 for r in rows)
    got = {r.doc_id: r for r in measures.features(docs).collect()}
    assert got[2].sentences == 0 and got[3].of_sentences[0].features["PUNCT_SEMICOLON"] == 0.6 and got[1].sentences == 3


def test_structure(spark):
    refs = "[1] Ada A. On things[J]. Journal of X, 2019, 3(2): 1-9.\n[2] Bob B. More[M]. Press, 2001.\n"
    text = f"Intro line with prose.\nReferences\n{refs}2 Next chapter\nprose\n致谢\n感谢大家\n"
    got = [(text[a:b].split("\n")[0], k) for a, b, k in structure.structure(text)]
    assert got == [("References", "references"), ("致谢", "other")]
    assert structure.structure("References\nonly prose that is long enough to close the section here, indeed it is\n") == []
    run = refs + "[3] Cee C. Thing[D]. 2010.\n"
    assert [k for *_, k in structure.structure("prose\n" + run + "prose")] == ["references"]
    lines = [x for x in (refs + "（2）热压连接采用的参数\nprose only\n").split("\n") if x]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select(structure.citation_like(F.col("line"))).collect()
    assert [r[0] for r in df] == [structure.is_citation(x) for x in lines] == [True, True, False, False]
    quoted = "他说“这是一个很长的引用句子”，又说“短”。"
    assert [quoted[a:b] for a, b in structure.quotations(quoted)] == ["“这是一个很长的引用句子”"]


def test_keys(spark):
    rows = [("https://doi.org/10.1000/AB-1.", "基于深度学习的图像分割研究"), ("see (10.5/x) and 10.6", "Short"), ("", "Deep Learning for Images: A Review"), (None, None)]
    got = spark.createDataFrame(rows, "d string, t string").select(entities.doi_key(F.col("d")), entities.title_key(F.col("t")), entities.paper_key(F.col("d"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("10.1000/ab-1", "基于深度学习的图像分割", "10.1000/ab-1"), ("10.5/x", "short", "10.5/x"), ("", "deeplearningforimages", "t:deeplearningforimages"), ("", "", "")]


def test_entities(spark):
    r = random.Random(2)
    titles, dois = [f"a long title number {k}" for k in range(6)] + ["x"], ["", "", "10.1/a", "10.1/b", "10.2/c"]
    pool = [(k, r.choice(["e1", "e2", None]), r.choice([None, "1", "2"]), r.choice(titles), r.choice(dois), r.choice([None, "", "some abstract", "a longer abstract"])) for k in range(60)]
    got = sorted(tuple(x) for x in entities.resolved(spark.createDataFrame(pool, entities.POOL).repartition(3)).collect())
    # brute force: one fold over the whole pool, in order
    keyed = [{"pos": p, "engine": e, "id": i, "title": t, "doi": d, "abstract": a, "doi_key": d, "title_key": "" if t == "x" else t.replace(" ", "")} for p, e, i, t, d, a in pool]
    assert got == sorted(entities.fold(keyed)) and len({k for _, k, _ in got}) < 40
    same = [dict(pos=k, engine="e", id=str(k), title="same title", doi="", abstract="", doi_key="", title_key="sametitle") for k in range(2)]
    assert [k for _, k, _ in entities.fold(same)] == [0, 1]


def test_training_helpers(spark):
    assert training.sign_test(9, 1) == pytest.approx(22 / 1024) and training.sign_test(0, 0) == 1.0
    assert training.chunks("一二三。四五六。七八九。", 6, 9) == ["一二三。四五六。", "七八九。"]
    assert training.perturbed("一二。三四。", "merge") == "一二，三四。" and training.perturbed("一二三。四。", "equal") == "一二。三四。"
    scored = spark.createDataFrame([(float(k), 0) for k in range(1000)], "score double, label int")
    assert training.bias_within(scored) == 997.0
    docs = spark.createDataFrame([(1, "abab"), (2, "abcc")], "doc_id long, text string")
    grams = training.gram_counts(docs, 2)
    x = {(r.doc_id, r.gram): r.x for r in training.vectors(docs, grams.select("gram").distinct()).collect()}
    assert x[1, "ab"] == pytest.approx((1 + math.log(2)) / math.hypot(1 + math.log(2), 1)) and x[2, "cc"] == pytest.approx(1 / math.sqrt(3))
    weights = spark.createDataFrame([("ab", 2.0)], "gram string, weight double")
    s = {r.doc_id: r.score for r in training.linear_score(training.vectors(docs, grams.select("gram").distinct()), weights).collect()}
    assert s[2] == pytest.approx(1 / (1 + math.exp(-2 / math.sqrt(3))))
    bits = {r.doc_id: r.bits for r in training.backoff_bits(docs, training.backoff_counts(docs, (1, 1, 1))).collect()}
    assert all(0 < b < 3 for b in bits.values())
    groups = spark.createDataFrame([("d", g) for g in "aaabbc"], "domain string, group string")
    assert {r.n for r in training.capped_groups(groups, 3).collect()} <= {1, 2, 3}
    rows = spark.createDataFrame([(k % 5, k % 2, float(k % 2 + k / 100)) for k in range(40)], "domain int, label int, v double")
    assert tuple(training.sign_agreement(rows, "v").first()) == (5, 5)
    c = training.criterion(rows, "v").first()
    assert c.sign == 1 and c.auc == 1.0 and c.weight == 1.0
    coefficients, _ = training.fit_logistic(rows, ["v"], 0.01)
    assert coefficients[0] > 0
    diff = training.pair_differences(rows.withColumn("group", F.col("domain")).withColumn("id", F.monotonically_increasing_id()), ["v"], 4)
    assert diff.filter("label = 1 and v <= 0").count() == 0 and diff.groupBy("group").count().filter("count > 8").count() == 0
    audit = training.rule_audit(spark.createDataFrame([(1, 1, "Moreover x"), (1, 0, "y"), (2, 1, "moreover"), (2, 0, "z")], "group int, label int, text string"), {"m": "moreover"})
    assert audit == [("m", 1.0, 0.0, 0.5)]
    z = training.outliers(spark.createDataFrame([(1, k, 100.0 if k == 9 else 1.0) for k in range(10)], "doc_id int, place int, score double")).collect()
    assert [r.place for r in z] == [9]
    values = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2, 3)] + [("b", 7)], "k string, v int")
    assert sorted(map(tuple, training.floor_percentile(values, "k", "v", 0.5).collect())) == [("a", 3), ("b", 7)]
