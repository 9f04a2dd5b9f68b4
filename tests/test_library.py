"""Strings, blocks, wire formats, the library and streams on small cases."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import blocks, strings
from tessera.operators import library
from tessera.sources import wire
from tessera.streaming import ingest


def one(spark, *columns, schema="a string, b string", row=("x", "y")):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_strings(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, strings.html_escaped(a), strings.json_quoted(a), strings.json_quoted(b), row=('<a "b"> & \n', None)) == ("&lt;a &quot;b&quot;&gt; &amp; \n", '"<a \\"b\\"> & \\n"', "null")
    assert one(spark, strings.file_name(a), strings.file_name(b), strings.cut(a, 4), row=(' a/b:c?. ', ". ")) == ("a_b_c_", "untitled", " a/…")
    assert one(spark, strings.percent(F.lit(float("nan"))), strings.percent(F.lit(120.0)), strings.percent(F.lit(12.25))) == ("0.00%", "100.00%", "12.25%")
    assert one(spark, *[strings.url_rank(F.lit(u)) for u in ("http://x/a.pdf?b", "https://x/download/1", "http://x/y", "ftp:z")]) == (0, 1, 2, 3)
    assert one(spark, strings.from_inverted(F.from_json(a, "map<string,array<int>>")), row=('{"b":[1,3],"a":[0],"c":[2]}', "")) == ("a b c b",)
    assert one(spark, strings.filled('{"t":{{t}}}', {"t": a}), strings.mapped(b, {"x": "$.p[0].q", "y": "$.z"}), row=('q"', '{"p":[{"q":"v"}]}')) == ('{"t":"q\\""}', ("v", None))
    assert one(spark, strings.top_tally(F.split(a, ",")), strings.alias(b, {"cn": "china"}), row=("x,y,x,z,y,x,w", " CN ")) == ("x 3, y 2, w 1", "china")
    assert one(spark, *[strings.defect(F.lit("some text here."), F.lit(t)) for t in ("some text here!", "", ",x text here ok", "some text,", "some,, text here", "so", "x" * 40)]) == (None, "empty", "head", "tail", "doubled", "shorter", "longer")
    assert strings.ranges([0, 10, 20], [9, 9, 9], 5, 22) == [(0, 5, 9), (1, 0, 9), (2, 0, 2)]


def test_changed(spark):
    r = random.Random(5)
    cases = [("".join(r.choices("ab", k=r.randint(0, 9))), "".join(r.choices("ab", k=r.randint(0, 9)))) for _ in range(150)] + [("", ""), ("same", "same")]
    got = spark.createDataFrame(cases, "a string, b string").select("a", "b", strings.changed(F.col("a"), F.col("b")).alias("c")).collect()
    for x in got:
        head = next((k for k, (p, q) in enumerate(zip(x.a, x.b)) if p != q), min(len(x.a), len(x.b)))
        tail = 0
        while tail < min(len(x.a), len(x.b)) - head and x.a[-1 - tail] == x.b[-1 - tail]:
            tail += 1
        assert tuple(x.c) == (head, len(x.a) - tail, len(x.b) - tail)


def test_blocks():
    r = random.Random(3)
    for _ in range(60):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 40))) for _ in range(2))
        i, j, n = blocks.longest_common(a, b)
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert n == m.size and a[i : i + n] == b[j : j + n]
        for i, j, n in blocks.shared_blocks(a, b, 3):
            assert a[i : i + n] == b[j : j + n] and n >= 3
        got = blocks.tiles(a, b, blocks.anchors(a, b, 2), 3)
        covered = [k for i, _, n in got for k in range(i, i + n)]
        assert len(covered) == len(set(covered)) and all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
    x = "the cat sat on the mat, and the dog ran away"
    assert blocks.tiles(x, x, blocks.anchors(x, x, 7), 13) == [(0, 0, len(x))]
    assert blocks.trimmed_bands([(10, 20)], [(0, 40), (0, 12)]) == [(0, 10), (20, 40)]
    assert blocks.key_phrase("A study of deep learning for 图像分割的研究 in 2020", 20) and len(blocks.key_phrase("word " * 50 + "different others", 30)) <= 30
    assert blocks.narrowed("one two three four", 3, 9) == "one two" and blocks.quiet([3, 0, 1, 0, 0, 5]) == 5
    plan = blocks.allocated([5, 9], ["x", "y"], 1, 3)
    assert plan == [(1, "x"), (0, "y")] and len(blocks.allocated([1, 1, 1], ["x", "y"], 9, 4)) == 4


def test_wire():
    message = b"\x08\x96\x01\x12\x03abc\x1d\x01\x00\x00\x00"
    assert list(wire.fields(message)) == [(1, 0, 150), (2, 2, b"abc"), (3, 5, 1)]
    for bad in (b"\x08", b"\x12\x05ab", b"\x00\x01", b"\x0b"):
        with pytest.raises(ValueError):
            list(wire.fields(bad))
    assert list(wire.framed(b"\x00\x00\x00\x00\x02hi\x80\x00\x00\x00\x01t")) == [(False, b"hi"), (True, b"t")]
    assert wire.looked_up(wire.parsed('{"a":[{"b":1}]}'), "a.0.b") == 1 and wire.looked_up({}, "x", 5) == 5
    for bad in ("[" * 80 + "]" * 80, '{"a":1} x', "{"):
        with pytest.raises(ValueError):
            wire.parsed(bad)
    assert wire.state("<script>window.S = {\"a\": [1]};</script>", "window.S") == {"a": [1]} and wire.state("x", "y") is None
    assert wire.elements('<f xmlns="u"><e i="1">a<b>c</b></e><e/></f>', "e") == [({"i": "1"}, "ac"), ({}, "")]


def test_library(spark, tmp_path):
    store = library.Library(spark, f"file://{tmp_path}/lib")
    batch = [(0, "a", "First text here"), (1, "b", "ＦＩＲＳＴ text  here"), (2, "c", None), (3, "d", "x"), (4, "e", "Second text here")]
    made = {r.status: r.n for r in store.add(spark.createDataFrame(batch, "pos long, title string, text string"), 5).collect()}
    assert made == {"imported": 2, "duplicate": 1, "failed": 1, "thin": 1}
    again = {r.status: r.n for r in store.add(spark.createDataFrame(batch[:1] + [(9, "z", "Third text here")], "pos long, title string, text string"), 5).collect()}
    assert again == {"imported": 1, "duplicate": 1} and store.read().count() == 3 and store.read(1).count() == 2
    reports = spark.createDataFrame([(1, 5, "k", list(range(60))), (2, 6, "k", None), (3, 4, "k", [1])], "id int, created int, k string, hits array<int>")
    assert [(r.id, len(r.hits), r.hits_total) for r in library.bounded(reports).orderBy("id").collect()] == [(1, 40, 60), (2, 0, 0), (3, 1, 1)]
    assert [len(r.hits) for r in library.shrunk(reports.filter("id = 1"), "hits", 120).collect()] == [30]
    assert [r.id for r in library.retained(reports, "k", 2).orderBy("id").collect()] == [1, 2]


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k}:00", t, k % 2, 1.0) for k, t in enumerate(["One text", "one  TEXT", "Two", "Two."])]
    df = spark.createDataFrame(rows, "ts string, text string, user_id int, value double").selectExpr("cast(ts as timestamp) ts", "text", "user_id", "value", "'e' event_type")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def run(made, name, mode="append"):
        made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.text for r in run(ingest.first_seen(stream), "firsts")) in (["One text", "Two", "Two."], ["Two", "Two.", "one  TEXT"])
    assert [(r.n, r.total) for r in run(ingest.windowed(stream), "windows", "complete")] == [(4, 4.0)]
    batch = ingest.sessions(df, "3 minutes").collect()
    assert sorted((r.user_id, r.n) for r in batch) == [(0, 2), (1, 2)]
