"""Rewriting under masks, tells, the language model, reports and page walls on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import language, rewriting, tells
from tessera.sources import documents, reports, web

RULES = (rewriting.Rule("shows", r"\bshows\b", "tells"), rewriting.Rule("moreover", r"moreover", "also", True), rewriting.Rule("all", r".*", ""))


def test_masks():
    text = "See [3,4] at 20 ℃ and http://a.b/c of Term X, again Term X."
    hidden, held = rewriting.masked(text, ["Term X"])
    assert held == ["[3,4]", "20 ℃", "http://a.b/c", "Term X", "Term X"] and rewriting.restored(hidden, held) == text
    assert rewriting.restored(hidden[:-2], held) is None and rewriting.restored(hidden + hidden[4], held) is None
    with pytest.raises(ValueError):
        rewriting.masked("")


def test_rules_and_loop():
    assert rewriting.applied("moreover, xmoreover; moreover", RULES[1], 2) == "also, xmoreover; also"
    text = "It shows this [1], and moreover it is a long enough clause here. Nothing else."
    got = rewriting.options(text, RULES)
    assert got and all("[1]" in x and x != text for x in got) and any("tells" in x for x in got)
    made, score, checks = rewriting.improved(text, RULES[:2], lambda t: t.count("shows") + t.count("moreover"))
    assert score <= 1 and "[1]" in made and checks < 60
    assert rewriting.splits("a clause that is long, and another one as long.") == ["a clause that is long; and another one as long."] and rewriting.splits("short, one") == []
    r = random.Random(1)
    for _ in range(80):
        a, b = ("".join(r.choices("abc ", k=r.randint(0, 30))) for _ in range(2))
        done, shift = a, 0
        for s, e, new in rewriting.edits(a, b):
            done, shift = done[: s + shift] + new + done[e + shift :], shift + len(new) - (e - s)
        assert done == b


def test_tells():
    rules = [tells.Tell("delve", "sent", "regex", "delve", 1, 2.0), tells.Tell("labels", "para", "struct", "labels", 3, 5.0), tells.Tell("long", "doc", "regex", "^.{200,}", 1)]
    text = "We delve. We DELVE again.\nAim:one; Plan:two, go.\n"
    hits = tells.scan(text, rules)
    assert [(h.name, text[h.start : h.end]) for h in hits] == [("delve", "delve"), ("labels", "Aim:one; Plan:two, go.")]
    assert [h.name for h in tells.work_order(hits, rules)] == ["labels", "delve"]
    assert tells.fanned(hits, [(0, 9), (10, 25), (26, 34), (35, 48)]) == [["delve"], [], ["labels"], ["labels"]]


def test_language_model():
    m = language.Model(["abab", "abac"], 3)
    for context in ("", "a", "b", "ba", "zz"):
        assert sum(m.probability(context, c) for c in m.kinds) <= 1 + 1e-9
    assert m.probability("", "z") > 0 and m.probability("a", "b") > m.probability("a", "c") > m.probability("a", "z")
    s = m.signals("ab")
    assert s.bits == pytest.approx(-(math.log2(m.probability("", "a")) + math.log2(m.probability("a", "b"))) / 2) and s.mean_rank == 1.0 and s.log_rank == 0.0
    assert m.signals("").bits == 0.0 and m.best_window("abab" * 20) < m.best_window("zzzz" * 20)


def test_reports():
    text = "One\ttwo <x>\n学 & \x00y"
    assert documents.docx_text(reports.docx(text)) == "One\ttwo <x>\n学 & y" and reports.docx(text) == reports.docx(text)
    got = reports.page("T<", "ab<cd", [(1, 3, "dup")], {"rate": 12.345})
    assert "a<mark class=\"dup\">b&lt;</mark>cd" in got and "T&lt;" in got and "12.3" in got


def test_walls(spark):
    cases = {"<p>Please log in</p>": "login", "<p>x</p>": "thin", f"<p>{'word ' * 200} sign in</p>": None, "<b>404 not found</b>": "missing"}
    df = spark.createDataFrame(list(cases.items()), "html string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", web.wall(F.col("html"))).collect())
    frames = spark.createDataFrame([(bytearray(b),) for b in (b"\x00\x00\x00\x00\x01x", b"\x80\x00\x00\x00\x00", b"<html>", b"{'a':1}", b"ab")], "b binary").select(web.frame(F.col("b")).alias("f")).collect()
    assert [r.f for r in frames] == ["message", "trailer", "markup", "json", "unknown"]
    row = spark.createDataFrame([("Top\nAbstract\nThe text\nmore\nKeywords:\nx",)], "t string").select(web.section(F.col("t"), "abstract")).first()
    assert row[0].strip() == "The text\nmore"
