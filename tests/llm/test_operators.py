"""Each operator against brute force on a small table with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import media, mixing, neardup, packing, pii, repeats, sharding, toxicity, vectors, warc, webp

SCHEMA = "doc_id long, text string, source string, key string, bucket long, run string, size long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    out = [(k, " ".join(r.choices(words, k=r.randint(1, 150)))) for k in range(60)]
    shared = " ".join(r.choices(words, k=80))
    out += [(100 + k, f"{' '.join(r.choices(words, k=30))} {shared} {' '.join(r.choices(words, k=30))}") for k in range(5)]
    out += [(200, out[7][1]), (201, shared), (202, shared.replace(shared.split()[40], "zzz", 1)), (300, ""), (301, None), (302, None), (None, "no id at all"), (5, out[5][1]), (303, "ab" * 700)]
    out += [(400, "mail a@b.c.d_e@f.g x 1.2.3.4 and 01.256.3.4 9.9.9.9.9 +1 (555) 123-4567 card 4111 1111 1111 1111 é 4111-1111-1111-1112"), (401, "é x@y +12 ..@a.b 0.0.0.0.")]
    return [(i, t, f"s{k % 4}" if k % 9 else None, "k", 1, "r", 2) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_meets_targets(docs, none, rows):
    got = mixing.mix(docs, fan=4).collect()
    assert len(got) == len(rows) and mixing.mix(none).count() == 0
    by = {}
    for r in got:
        assert r.size == len(re.findall(mixing.WORD, r_text)) if (r_text := next((t for i, t, *_ in rows if i == r.doc_id and t), None)) else r.size in (0, 4)
        assert 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    assert sum(o[0].target for o in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    again = mixing.mix(docs.repartition(5), fan=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mixed(docs, fan=4).count() == sum(r.copies for r in got)


def _base(text):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(d))) % 10 == 0
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in plain.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255 or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_pii_base_spans(spark, docs, none, rows):
    r = random.Random(1)
    more = [(1000 + k, "".join(r.choices("a@.-_ +1234567890()x%", k=60))) for k in range(400)] + [(2000, "1" * 30_000), (2001, "a" * 30_000), (2002, "1 " * 8000 + "a@" + "b." * 6000)]
    every = spark.createDataFrame([(i, t) for i, t, *_ in rows] + more, "doc_id long, text string")
    got = pii.spans(every).select("doc_id", pii.listed(pii.F.col("base")).alias("s")).collect()
    assert Counter((x.doc_id, x.s) for x in got) == Counter((i, ",".join(_base(t or ""))) for i, t in [(i, t) for i, t, *_ in rows] + more)
    assert pii.spans(none).count() == 0
    texts = {x.doc_id: x.text for x in pii.cleaned(docs).collect()}
    assert "[EMAIL]" in texts[400] and "4111 1111 1111 1111" not in texts[400] and texts[301] is None and len(texts) > 60


def test_pii_terms_that_disclose(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    told = [(k, f"{word()} {word()} {word()} agent Quorl boss@x.y {word()} {word()} {word()} {word()}") for k in range(6)]
    other = [(100 + k, f"{word()} agent {word()} boss {word()}") for k in range(80)]
    got = {x.doc_id: [t.found for t in x.terms] for x in pii.spans(spark.createDataFrame(told + other, "doc_id long, text string")).collect()}
    assert all("quorl" in got[k] and "agent" not in got[k] for k in range(6)) and not any(got[k] for k in range(100, 180))


def test_pii_terms_are_marked_at_all_their_places(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    some = lambda n: " ".join(word() for _ in range(n))
    told = [(k, f"é agent Quorl boss@x.y {some(9)} QUORL said {some(30)} quorl") for k in range(6)]
    other = [(50, f"+1 555 123 4567 {some(4)}, Quorl, {some(3)}"), (51, f"{some(5)} Quorl"), (52, "quorl@z.y")] + [(100 + k, f"é {word()} agent {word()} boss said {word()}") for k in range(200)]
    docs = spark.createDataFrame(told + other, "doc_id long, text string")
    want = {i: [(m.start(), m.end()) for m in re.finditer("quorl(?!@)", t.lower())] for i, t in told + other}
    assert {x.doc_id: [(t.start, t.end) for t in x.terms] for x in pii.spans(docs).collect()} == want
    texts = {x.doc_id: x.text for x in pii.cleaned(docs).collect()}
    assert not any("quorl" in t.lower() for t in texts.values()) and texts[52] == "[EMAIL]" and all(texts[i] == t for i, t in other[3:])


def test_pii_terms_far_from_their_entity(spark):
    r = random.Random(7)
    some = lambda n: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))
    told = [(k, f"Verrin letter {some(60)} boss@x.y {some(5)} {' ' * 200} Tolm") for k in range(5)]
    told += [(10 + k, f"letter Ombra {some(7)} {'+1 555 123 4567' if k else ''} {some(3)}") for k in range(5)]
    other = [(100 + k, f"{some(3)} letter {some(3)}") for k in range(200)]
    texts = told + other + told[:2] + [(None, None), (300, "")]
    got = [(x.doc_id, [t.found for t in x.terms]) for x in pii.spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()]

    n, held, near = len({t or "" for _, t in texts}), {}, {}
    for text in {t or "" for _, t in texts}:
        entities = re.findall(r"\S+@\S+|\+1 555 123 4567", text)
        words = set(re.findall("[a-z]+", re.sub(r"\S+@\S+", " ", text.lower())))
        for x in {*entities, *words}:
            held[x] = held.get(x, 0) + 1
        for p in {(e, w) for e in entities for w in words}:
            near[p] = near.get(p, 0) + 1
    want = {w for (e, w), k in near.items() if k >= 3 and math.log(n * k / held[w] / held[e]) >= 0.9 * math.log(n / held[e])}
    assert {"verrin", "tolm", "ombra"} <= want and "letter" not in want
    assert Counter((i, tuple(f)) for i, f in got) == Counter((i, tuple(w for w in re.findall("[a-z]+", re.sub(r"\S+@\S+", " ", (t or "").lower())) if w in want)) for i, t in texts)


def test_segments_are_maximal():
    r = random.Random(2)
    for _ in range(200):
        x = np.array([r.choice([-2, -1, -0.5, 1, 2.5]) for _ in range(r.randint(1, 14))])
        got = toxicity.maximal_segments(x)
        assert all(sum(x[a:k]) > 0 and sum(x[k:b]) > 0 for a, b, _ in got for k in range(a + 1, b))
        best = max(sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1))
        assert best <= 0 and not got or math.isclose(max(s for *_, s in got), best)


def test_toxicity_finds_planted_words(spark, none):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    made = [(k, " ".join([*r.choices(words, k=60), *(["vilewort", "grubling"] * 2 if k % 5 == 0 else [])])) for k in range(600)]
    docs = spark.createDataFrame([*made, (None, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)] + [(7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 602 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert held and all(x.predicted == (x.doc_id % 5 == 0) for x in held)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in held)
    assert toxicity.toxicity(none.select("doc_id", "text"), labels).count() == 0
    assert {x.score for x in toxicity.toxicity(docs, labels.filter("toxic > 5")).collect()} == {0.0}


def test_near_duplicates(docs, none, rows):
    got = {x.doc_id: x for x in neardup.classes(docs).collect()}
    text = {i: t for i, t, *_ in rows}
    grams = lambda t: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := (t or "").lower().split()) > 4 else {tuple(w)} if w else set()
    for a in text:
        for b in text:
            x, y = grams(text[a]), grams(text[b])
            if a is not None and b is not None and a < b and x and y and len(x) > 20:
                j = len(x & y) / len(x | y)
                assert (got[a].class_id == got[b].class_id) or j < 0.85
                assert j > 0.7 or got[a].class_id != got[b].class_id
    assert got[300].kept and got[200].class_id == 7 and neardup.classes(none).count() == 0
    assert neardup.deduplicated(docs).columns == docs.columns


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 24))
    x = np.concatenate([base, base[:20] + 0.12 * r.standard_normal((20, 24)), base[:3]])
    table = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [])]
    got = {g.vec_id: g for g in vectors.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [got[k].n_links for k in range(len(x))] == links.tolist() and links.sum() > 20
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (900, 901, 902, 903))
    assert got[60].component_id == 0


def test_repeated_passages(docs, none, rows):
    n = repeats.LENGTH
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + n] for _, b in texts for k in range(len(b) - n + 1))
    want = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.repeats(docs).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    assert repeats.repeats(none).count() == 0


def test_matches_do_not_run_into_the_next_string():
    n = repeats.LENGTH
    for seed in range(4, 30, 5):
        r = random.Random(seed)
        draw = lambda k, r=r: bytes(r.choices(b"abcdefgh", k=k))
        head, tail, strings = draw(330), draw(330), []
        for _ in range(r.randint(3, 8)):
            strings += [draw(r.randint(1, 5)) + tail[r.randint(0, 60) :], head[: r.randint(230, 330)] + draw(r.randint(1, 5))]
        strings += [b"\xff" * 300, b"\xff" * 250 + b"\0"]
        seen = Counter(s[k : k + n] for s in strings for k in range(len(s) - n + 1))
        want = [{p for k in range(len(s) - n + 1) if seen[s[k : k + n]] > 1 for p in range(k, k + n)} for s in strings]
        assert [{p for a, b in spans for p in range(a, b)} for spans in repeats._repeated(strings)] == want, seed


def test_packing(docs, none, rows):
    got = packing.packed(packing.pieces(docs)).collect()
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in by.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= packing.CAPACITY
    assert len({x.doc_id for x in got}) == len({i for i, *_ in rows}) and len(by) == -(-sum(x.length for x in got) // packing.CAPACITY)
    assert packing.packed(packing.pieces(none)).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4])
    bins = packing.LocalSearch(lengths, [[0, 2], [1, 3], [4], [5]], 15).run()
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 2


def test_local_search_leaves_no_exchange():
    r = np.random.default_rng(8)
    for lengths, capacity in [(r.integers(550, 1000, 1500), 2048), (r.integers(300, 900, 900), 2048), (r.integers(1, 40, 400), 50), (r.integers(1, 7, 50), 13), (np.full(9, 5), 14)]:
        first = packing.best_fit(lengths, capacity)
        bins = packing.pack(lengths, capacity)
        fills = [int(lengths[b].sum()) for b in bins]
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(fills) <= capacity and len(bins) <= len(first)
        given = [{int(lengths[i]) for i in b} | {int(lengths[i] + lengths[j]) for i in b for j in b if i < j} for b in bins]
        back = [{0, *lengths[b].tolist()} for b in bins]
        under = [k for k, f in enumerate(fills) if f < capacity]
        assert not [1 for d in under for t in under if d != t and fills[t] >= fills[d] for a in given[d] for b in back[t] if 0 < a - b <= capacity - fills[t]]


def test_webp_round_trips():
    r = np.random.default_rng(1)
    for image in (r.integers(0, 256, (5, 9, 4), dtype=np.uint8), r.integers(0, 3, (9, 20, 4), dtype=np.uint8), np.full((4, 7, 4), 9, np.uint8)):
        options = [{}, {"subtract_green": True}, {"cross_colour": (3, -20, 100)}, {"cache_bits": 4}, {"matches": True, "cache_bits": 8, "predictor": list(range(14)), "block": 2}, *({"predictor": m} for m in range(14))]
        if len(np.unique(image.reshape(-1, 4), axis=0)) <= 256:
            options.append({"palette": True, "matches": True})
        for o in options:
            assert np.array_equal(webp.decode(webp.encode(image, **o)), image), o
        assert all(np.array_equal(x, image) for x in webp.decode_many(webp.encode_many([image, image])))


def test_media(docs, none, rows):
    got = media.read(media.write(docs)).collect()
    want = Counter((i, len(b), hashlib.sha256(media.payload(b)).hexdigest()) for i, b in ((i, (t or "").encode()) for i, t, *_ in rows))
    assert Counter((x.doc_id, x.n_bytes, x.payload_sha256) for x in got) == want and all(x.payload_bytes % 576 == 0 for x in got)
    assert media.read(media.write(none)).count() == 0


def test_images_take_the_transform_that_is_cheapest():
    r = random.Random(6)
    draw = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    line = draw(576)
    near = "".join(line[:k] + draw(20) + line[k + 20 :] for k in (r.randint(0, 550) for _ in range(20)))
    grey = "".join(c * 4 for c in draw(2000))
    drift = "".join(chr(33 + g) + chr(33 + g // 2) + chr(120 - g // 2) + "x" for g in (r.randint(0, 90) for _ in range(2000)))
    side = "".join(c * 4 * r.randint(5, 40) for c in draw(200))
    texts = [near, grey, drift, side, draw(5000)]
    payloads = [media.payload(t.encode()) for t in texts]
    forms = [media._form(media.images(p)[0]) or {} for p in payloads]
    assert forms[0] == {"predictor": 2} and "cross_colour" in forms[2] and {"subtract_green", "cross_colour"} & set(forms[1]) and forms[3] == {"predictor": 1} and forms[4] == {}
    stored = media.stored_forms(payloads)
    assert media.read_back(stored) == payloads
    for p, m in zip(payloads[:4], stored, strict=False):
        assert len(m) < sum(map(len, webp.encode_many(media.images(p))))
    for p in payloads:
        image = media.images(p)[0]
        e = np.broadcast_to(np.array([37, -20, 0]) & 255, (9, 36, 3))
        assert np.array_equal(media._residual(image, {"cross_colour": (37, -20, 0)}), webp._cross(image, e, 4, False))


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "WARC/1.1\r\n\r\nx\r\n\r\n", "", None, "é" * 500, "<p>a</p>", "\r\n\r\n"]
    pages = spark.createDataFrame([(k, f"http://www.H{k % 2}.org:80/p?b&a#x", h, "c") for k, h in enumerate(html)] + [(None, None, "lone", "c")], "page_id long, url string, html string, run string")
    warc.write(pages, f"file://{tmp_path}/a")
    rows = warc.histories(warc.runs(spark, f"file://{tmp_path}/a")).collect()
    keys = [(x.urlkey, x.timestamp) for x in rows]
    assert keys == sorted(keys) and len(rows) == 8
    got = {x.page_id: x for x in warc.resolved(warc.histories(warc.runs(spark, f"file://{tmp_path}/a"))).collect()}
    assert [got[k].refers_to for k in range(7)] == [5, None, 3, None, None, None, None]
    assert [got[k].payload_bytes for k in range(7)] == [len((h or "").encode()) for h in html]
    assert list(warc.LoserTree([[1, 4, 9], [], [2, 2], [0, 10]])) == [0, 1, 2, 2, 4, 9, 10] and list(warc.LoserTree([])) == []


def test_shards(spark, docs, none, tmp_path, rows):
    store = sharding.Store(spark, f"file://{tmp_path}/s", docs.schema, target=1 << 20, fanout=3)
    store.append(docs)
    store.append(docs.limit(3))
    assert store.manifest().count() >= 4
    version = store.compact()
    assert version == 3 and store.manifest().count() == 1 and store.manifest(1).count() == 3
    assert store.read().count() == len(rows) + 3 and store.read(1).count() == len(rows)
    empty = sharding.Store(spark, f"file://{tmp_path}/e", none.schema)
    empty.append(none)
    assert empty.compact() == 1 and empty.read().count() == 0


def test_near_duplicates_of_different_groups_against_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(20):
        k = int(r.integers(2, 70))
        base = r.integers(0, 1 << 60, 60, dtype=np.uint64)
        keys = [np.unique(np.concatenate([r.choice(base, 50, replace=False), r.integers(0, 1 << 60, int(r.integers(0, 9)), dtype=np.uint64)])) for _ in range(k)]
        weights = [(1 + a % np.uint64(3)).astype(np.float32) for a in keys]
        group = r.integers(0, max(2, k // 2), k)

        def merged(pairs, group=group):
            label = group.copy()
            for i, j in pairs:
                label[label == label[j]] = label[i]
            return {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label.tolist())}

        found = neardup.joining_pairs(np.zeros((k, neardup.SAMPLES), dtype=np.uint8), group, np.full((k, neardup.BANDS), 7), 7, keys, weights, 0.8)
        every = [(i, j) for i in range(k) for j in range(i) if neardup.similarity((keys[i], weights[i]), (keys[j], weights[j])) >= 0.8]
        assert merged([(i, j) for i, j, _ in found]) == merged(every)
        marks = r.integers(0, 3, (k, neardup.SAMPLES)).astype(np.uint8) // 2
        near = [any(group[i] != group[j] and (marks[i] == marks[j]).sum() >= neardup.NEED for j in range(k)) for i in range(k)]
        assert neardup.open_rows(marks, group).tolist() == near


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id long, _key string, _doc long, id long, key string, node long, row string"


def test_every_pipeline_stage_and_the_whole(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(r.choices(words, k=n))
    made = [(k, f"{text(40)} {'vilewort grubling vilewort grubling' if k % 5 == 0 else ''}") for k in range(400)]
    long = text(4000)
    made += [(1000, made[3][1]), (1001, made[3][1]), (1002, f"{made[4][1]} {made[4][1]}"), (1003, long), (1004, long + " zzz"), (1005, None), (1006, ""), (1007, f"{text(20)} mail me@some.org"), (None, text(30)), (None, text(25)), (7, text(35))]
    rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, 0 if t is None else len(t), 7, "k", 8, 9, "k", k, "r") for k, (i, t) in enumerate(made)]
    rows.append(rows[8])
    folder = str(tmp_path)
    spark.createDataFrame(rows, ODD).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    safe = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert safe.schema == docs.schema
    kept = {(x.doc_id, x.text) for x in safe.collect()}
    assert not any(t and "vilewort" in t for _, t in kept) and sum(i is not None and i < 400 for i, _ in kept) >= 310 and sum(i is None for i, _ in kept) == 2
    one = corpus_pipeline.drop_near_duplicates(spark, safe, folder)
    assert one.schema == docs.schema
    got = [x.asDict() for x in one.collect()]
    assert len({x["text"] or "" for x in got}) == len(got) and {x["_id"] for x in got} == {7} and {x["_key"] for x in got} == {"k"}
    ids = [x["doc_id"] for x in got]
    assert ids.count(None) == 2 and ids.count(7) == 2 and 3 in ids and 1003 in ids and not {1000, 1001, 1004} & set(ids)
    mixed = mixing.mixed(one)
    assert mixed.schema == docs.schema and {x["_key"] for x in mixed.collect()} == {"k"}
    taken = sum(x.copies for x in mixing.mix(one).collect())
    assert mixed.count() == taken

    whole = corpus_pipeline.run(spark, folder).collect()
    fill = Counter()
    for x in sorted(whole, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == fill[x.sequence_id]
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 2048 and {x.piece for x in whole if x.doc_id == 1003} > {0, 1}
    spark.createDataFrame([], ODD).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_rows_that_differ_in_other_columns_alone_are_mixed_alike(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", k % 3) for k in range(9)] + [(2, "d e", "y", 0), (None, "f", None, 1)], "doc_id long, text string, source string, extra int")
    want = sorted(map(repr, mixing.mixed(docs).collect()))
    assert all(sorted(map(repr, mixing.mixed(docs.repartition(n)).collect())) == want for n in (1, 3, 7))


def test_words_map_to_places_of_the_text():
    text = "İİ vile İx grub"
    found = {text[a:b] for a, b in toxicity.spans_of_words(text, text.lower())}
    assert {"vile", "grub"} <= found


def test_links_at_the_threshold_are_judged_on_given_doubles(spark):
    r = np.random.default_rng(4)
    x = np.zeros(64)
    x[0] = 1.0
    y = np.zeros(64)
    y[0], y[1] = 0.9, math.sqrt(1 - 0.81)
    base, made = len(x), []
    for k in range(40):
        p = r.permutation(base)
        made += [(2 * k, x[p].tolist()), (2 * k + 1, y[p].tolist())]
    made += [(None, x.tolist()), (500, [1.0] * 3), (500, [1.0, -1.0, 1.0]), (501, [2.0] * 3)]
    got = vectors.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>")).collect()

    def cosine(a, b):
        (a, b), (m, n) = (np.array(a), np.array(b)), (np.sqrt((np.array(v) ** 2).sum()) for v in (a, b))
        return (a * b).sum() / (m * n)

    want = Counter((i, sum(len(v) == len(w) and cosine(v, w) >= 0.9 for q, (_, w) in enumerate(made) if q != p)) for p, (i, v) in enumerate(made))
    assert Counter((g.vec_id, g.n_links) for g in got) == want
    assert all(g.component_id is not None for g in got if g.vec_id is not None) and min(g.component_id for g in got) >= 0


def test_archives_of_pages_with_any_number(spark, tmp_path):
    ids = [0, 2**62, -5, 300_000_000_000, None, 9, 9]
    pages = spark.createDataFrame([(i, f"http://a.b/{k % 2}", "same" if k % 2 else f"own {k}") for k, i in enumerate(ids)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    got = warc.resolved(warc.histories(warc.runs(spark, str(tmp_path / "w")))).collect()
    assert Counter(g.page_id for g in got) == Counter(ids) and all(len(g.timestamp) == 14 for g in got)
    same = [g for g in got if g.payload_bytes == 4]
    assert {(g.page_id, g.record_type, g.refers_to) for g in same} == {(2**62, "response", None), (300_000_000_000, "revisit", 2**62), (9, "revisit", 2**62)}


def test_pieces_hold_the_ids_of_the_tokenizer(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(12)
    words = ["".join(r.choices("abcdefghijkéß", k=r.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=n)) for n in (0, 1, 5, 50, 3000)] + ["x" * 5000, "Word, word; 12.5% (it's) 学 <x>", None, " \n ", "a" * 70 + " " + "a" * 70]
    monkeypatch.setattr(packing, "SLICE", 700)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for k, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(k, p, at, len(own), zlib.crc32(own.tobytes())) for p, at in enumerate(range(0, len(ids), 2048)) for own in [ids[at : at + 2048]]}
    rows = packing.packed(packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))).collect()
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows} == want and max(x.piece for x in rows) > 0


def test_words_are_forgotten_by_bytes(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED", 200)
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(20):
        own = [f"{'abcdefghij'[k % 10] * n} longer{'z' * 80}" for n in range(1, 6)]
        flat, starts = words.ids(pa.array(own))
        assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [words.whole(t).tolist() for t in own]
        words._forget()
        assert words.bytes <= 200 and not any(len(w) > packing.LONGEST for w in words.of)
