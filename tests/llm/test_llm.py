"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import chat, common, counts, decontam, gif, html, idfiles, jaccard, language, packing, quality, queries

SMALL = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " ", "It's <|endoftext|> DON'T", "x▁y  z", "ab cd " * 30_000, "ab cd " * 30_000, "日本語 12kg é", "</s> <unk>"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, odd, very long and repeated texts, a null id, and columns of clashing names."""
    rows = [(i, t, "x", "src", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id at all", None, None, None, None), (5, TEXTS[5], "x", "src", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, token long")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SMALL, "documents")


def encodings(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_token_counts(spark, awkward):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(awkward, PIECE).collect() if r.doc_id is not None}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(TEXTS)}
    assert counts.count_tokens(awkward.limit(0), PIECE).count() == 0


def test_token_files(spark, awkward):
    to = common.scratch(spark, "t")
    idfiles.write_token_files(awkward, WORD, 2, to)
    files = idfiles.TokenFiles(to)
    rows = idfiles.read_token_files(spark, to, with_ids=True).orderBy("start").collect()
    expected = [x + [2] for x in encodings(WORD)]
    order = [None, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert [r.doc_id for r in rows] == order
    assert [r.ids for r in rows[1:]] == [expected[i] for i in order[1:]]
    assert [list(files[k]) for k in range(1, len(files))] == [expected[i] for i in order[1:]]
    assert [r.start for r in rows] == np.cumsum([0] + [len(r.ids) for r in rows])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    idfiles.write_token_files(awkward.limit(0), WORD, 2, empty := common.scratch(spark, "t"))
    assert idfiles.read_token_files(spark, empty).count() == 0 and len(idfiles.TokenFiles(empty)) == 0


def test_packing(spark, awkward):
    rows = packing.pack_documents(awkward.where("doc_id is not null").dropDuplicates(), BYTE, 0, with_ids=True).collect()
    expected = [x + [0] for x in encodings(BYTE)]
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == len(found.setdefault(r.doc_id, [])) and len(part) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        found[r.doc_id] += part
    assert found == dict(enumerate(expected))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(awkward.limit(0), BYTE, 0).count() == 0


def test_best_fit_is_the_fullest_that_fits_and_bounded():
    b, r = packing.BestFit(100, 5), random.Random(1)
    free = {}
    for _ in range(2000):
        n = r.randint(1, 100)
        fits = {k: v for k, v in free.items() if v >= n}
        at, offset = b.place(n)
        if fits:
            assert free[at] == min(fits.values()) and offset == 100 - free[at]
        else:
            assert offset == 0
            if len(free) == 5:
                (gone,) = set(free) - {x for v in b.bins.values() for x in v}
                assert free[gone] == min(free.values())
                del free[gone]
            free[at] = 100
        free[at] -= n
        if not free[at]:
            del free[at]
        assert b.open == len(free) <= 5


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b & <| x"), (1, 2, "assistant", "&lt;| <|im_sep|>"), (1, 2, "assistant", None), (1, None, None, "|z"), (1, 700, "assistant", "end<"), (2, None, None, None), (None, 3, "ro\nle<|", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for k in (1, 2, None):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == k))
        assert [(t.role, t.text) for t in got[k].turns] == [x[1:] for x in mine]
        assert got[k].loss == "".join(x for _, r, x in mine if r == "assistant")
        assert "".join(s.text for s in got[k].segments) == got[k].formatted
    assert chat.format_chats(df.limit(0)).count() == 0


def test_gif_round_trip_and_rules(spark, awkward):
    r = random.Random(2)
    for n in (192, 192 * 300):
        for kind in (lambda: r.randrange(256), lambda: 97, lambda: r.choice(b"ab")):
            data = bytes(kind() for _ in range(n))
            assert b"".join(f.samples.tobytes() for f in gif.decode(gif.encode(data))) == data
    # Two frames of 2 x 2 with a palette of four; the second is transparent at 0 and is undone (disposal 3).
    stream = lambda codes: np.packbits(np.concatenate([[c >> i & 1 for i in range(3)] for c in codes]).astype(np.uint8), bitorder="little").tobytes()
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    frame = lambda disposal, codes: b"\x21\xf9\x04" + bytes([disposal << 2 | 1]) + b"\x05\0\0\0\x2c\0\0\0\0\x02\0\x02\0\0\x02" + bytes([len(stream(codes))]) + stream(codes) + b"\0"
    data = b"GIF89a\x02\0\x02\0\xf1\0\0" + palette + frame(1, [4, 1, 1, 4, 2, 2, 5]) + frame(3, [4, 0, 3, 4, 0, 3, 5]) + frame(2, [4, 0, 0, 4, 0, 0, 5]) + b"\x3b"
    frames = list(gif.decode(data))
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert [f.canvas.reshape(-1, 4).tolist() for f in frames] == [[red, red, green, green], [red, blue, green, blue], [red, red, green, green]]
    assert [f.delay_ms for f in frames] == [50] * 3 and frames[0].histogram()[48] == 2
    media = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no")), (3, None)], "doc_id long, media binary")
    rows = gif.with_frames(media).collect()
    assert [(r.doc_id, r.frame, r.start_ms) for r in rows if r.doc_id == 1] == [(1, 0, 0), (1, 1, 50), (1, 2, 100)]
    assert [r.error for r in rows if r.doc_id == 2] == ["not a GIF file"]
    found = {r.doc_id: r for r in awkward.where("doc_id is not null").select("doc_id", gif.media_digest(gif.text_media(F.col("text"))).alias("d")).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        data = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert (found[i].d.payload_bytes, found[i].d.payload_sha256, found[i].d.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))


def test_html(spark):
    field = html.trained_field()
    pages = html.labelled_pages(100, seed=9)
    right = sum(a == b for p, y in pages for a, b in zip(field.decode(html.features(p)), y, strict=True))
    assert right / sum(len(y) for _, y in pages) > 0.98
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Fish &amp; chips</h1><p>One\n two&nbsp;three <b>four</b>.<p>The last words are here.</article><div class=comments><p>I don't agree at all.</div><script>x('</p>')</script><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert {r.page_id: r.text for r in html.extract_pages(df).collect()} == {1: "Fish & chips\nOne two three four.\nThe last words are here.", 2: "", 3: ""}


def test_blocks_around_foreign_elements_and_of_open_heads():
    texts = lambda page: [b.text for b in html.leaf_blocks(page)]
    assert texts('<p>One</p><svg width="1"/><p>Two</p>') == ["One", "Two"]
    assert texts('<p>One <svg/>and <svg><use/><svg><text>x</text></svg><style>a{}</style><text>y</text></svg>two</p>') == ["One and two"]
    assert texts("<p>One <svg><title>x</title><foreignObject><p>y</p></foreignObject><g></svg>two") == ["One two"]
    assert texts("<div><svg><path d=x><p>Two</p></div><p>Three") == ["Two", "Three"]
    assert texts('<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="tex">x=2</annotation></math> and <math/>more') == ["So x=2 and more"]
    assert texts("<template><p>x<template>y</template></p></template><p>One<object data=x><object>y</object>z</object>") == ["One"]
    assert texts("<object data=x><p>One") == ["One"]
    for start in ("<html><head><title>t</title><meta x>", "<head><link y><script>1<2</script>", "<head>"):
        assert texts(f"{start}<p>One<p>Two") == ["One", "Two"] and texts(f"{start}One<p>Two") == ["One", "Two"]
    assert texts("<head><title>t</title><style>s</style>\n</head><body>One") == ["One"]


def test_crf_decodes_the_best_path():
    r = random.Random(3)
    field = html.Field({f: (r.uniform(-1, 1), r.uniform(-1, 1)) for f in "abcde"}, np.array([[r.uniform(-1, 1) for _ in "01"] for _ in "01"]))
    for _ in range(50):
        rows = [(html.Path(html.Path(None, (x[0],)), ()), x[1:]) for x in (r.sample("abcde", 2) for _ in range(6))]
        score = lambda y: sum(field.weights[f][c] for (p, fs), c in zip(rows, y, strict=True) for f in p.features() + fs) + sum(field.trans[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert score(field.decode(rows)) == pytest.approx(max(score([i >> k & 1 for k in range(6)]) for i in range(64)))


def test_language_and_quality(spark, docs, awkward):
    rows = queries.op4_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    model = language.train(docs)
    found = {r.doc_id: r.l for r in awkward.select("doc_id", language.language(F.col("text"), model).alias("l")).collect()}
    assert [found[i].lang_pred == "und" for i in (0, 1, 2, 5)] == [True, True, True, False]
    assert language.train(docs.limit(0)) is None
    labels = common.table(spark, SMALL, "labels")
    scored = queries.op3_quality(spark, SMALL).join(labels, "doc_id").where("quality is not null").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert quality.train(docs.limit(0), labels) is None
    assert all(0 <= r.s <= 1 for r in awkward.select(quality.quality(F.col("text"), quality.train(docs, labels)).alias("s")).collect())


def test_every_language_is_learned(spark):
    r = random.Random(5)
    words = {f"x{k:02}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for k in range(70)}
    rows = [(i, l, " ".join(r.choices(w, k=40))) for l, w in words.items() for i in range(3 if l > "x64" else 4)]
    df = spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(rows)] + [(999, None, "none")], "doc_id long, lang string, text string")
    model = language.train(df)
    assert model.languages == sorted(words)
    found = df.where("lang is not null").select("lang", language.language(F.col("text"), model)["lang_pred"].alias("p")).collect()
    assert np.mean([x.lang == x.p for x in found if x.lang > "x64"]) > 0.9


def test_sparse_blocks_fit_like_one():
    r = np.random.default_rng(6)
    rows = [language.frequencies(r.integers(97 + 5 * (k % 3), 110 + 5 * (k % 3), 300).astype(np.uint8)) for k in range(30)]
    models = []
    for size in (7, 2048):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(language, "BLOCK_ROWS", size)
            models.append(language.fit(language.Sample([language.sparse(f) for f in rows]), [str(k % 3) for k in range(30)], steps=20))
    assert np.allclose(models[0].weights, models[1].weights, rtol=1e-3, atol=1e-3 * np.abs(models[1].weights).max())


def test_decontamination(spark):
    rows = [(1, "Intro. John Smith bought 5 apples and Mary gave 3 more apples to the old shop keeper today at noon. End"), (2, "Hm. Alice Jones bought 7 apples and Zoe gave 9 more apples to the old shop keeper today at noon."), (3, "Hm. Alice Alice bought 7 apples and Alice gave 7 more apples to the old shop keeper today at noon"), (4, None), (5, "words that have nothing to do with any of that at all, and more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, rows[0][1][7:-4]), (10, None), (11, "a b")], "item_id long, text string")
    found = {r.doc_id: [(x.item_id, x.exact) for x in r.leaks] for r in decontam.with_leaks(df, bench).collect()}
    assert found == {1: [(9, True)], 2: [(9, False)], 3: [], 4: [], 5: []}
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()} == {3, 4, 5}
    assert decontam.drop_contaminated(df, bench.limit(0)).count() == 5
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SMALL).collect()}
    plain = lambda t: " ".join(t.lower().split())
    items = common.table(spark, SMALL, "benchmark").collect()
    assert got == {(d.doc_id, i.item_id) for d in common.table(spark, SMALL, "documents").collect() for i in items if plain(i.text) in plain(d.text)}


def test_decontamination_of_names_at_starts_and_of_dense_slots():
    def found(item, doc):
        bench = decontam.build_table([(1, item)])
        raw = np.frombuffer(doc.encode(), np.uint8)
        return decontam.leaks(decontam.tokens(raw, np.array([0, len(raw)])), bench)

    item = "Tom has 5 apples. Sam has 3 pears. Kim has 9 plums. How many fruits do they have?"
    assert found(item, "Well. Ann has 2 apples. Bob has 7 pears. Eve has 4 plums. How many fruits do they have?") == {0: [(1, 18, 6, False)]}
    assert found(item, "Ann has 2 apples. Bob has 2 pears. Eve has 2 plums. How many fruits do they have?") == {0: [(1, 18, 6, False)]}
    assert not found(item, "Ann has 2 apples. Ann has 7 pears. Ann has 4 plums. How many fruits do they have?")
    assert not found(item, "Ann has 2 apples. Bob has 7 pears. Eve has 4 nuts. How much did they pay for them?")
    assert found("Tom sold 5 of the red boxes.", "Eve sold 8 of the red boxes.") == {0: [(1, 7, 2, False)]}
    dense = "add 1 2 3 4 5 6 7 8 9 10 11 to get the sum of it"
    assert found(dense, "so add 21 22 23 24 25 26 27 28 29 30 31 to get the sum of it") == {0: [(1, 18, 11, False)]}
    assert not found(dense, "so add 21 22 23 24 25 26 27 28 29 30 to get the sum of it")
    long = "in May 5 men met 7 cats by the old mill and then all of them ran home while the sun went down over the green hills near the wide lake with 5 more men"
    assert found(long, long.replace("5 men", "6 men").replace("5 more", "8 more"))[0][0][1] >= decontam.LONG


def test_consistent_parts_are_maximal():
    r = random.Random(4)
    ok = lambda x, y, n: all(y[i] == y[j] for i in range(len(x)) for j in range(i) if x[i] == x[j]) and all(x[i] == x[j] for i in range(len(x)) for j in range(i) if n[i] and n[j] and y[i] == y[j])
    for _ in range(200):
        x, y = ([r.randrange(4) for _ in range(8)] for _ in "xy")
        n = [v % 2 == 0 for v in x]
        fits = [(a, b) for a in range(9) for b in range(a, 9) if ok(x[a:b], y[a:b], n[a:b])]
        assert max(b - a for a, b in decontam._consistent(x, y, n)) == max(b - a for a, b in fits)
        assert set(decontam._consistent(x, y, n)) <= set(fits)


def brute(texts):
    """Component of each id by comparing all pairs of shingle sets."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("limits", [{}, {"CELL": 4, "CELL_SHINGLES": 400}, {"CELL": 4, "CELL_SHINGLES": 400, "MAX_PARTS": 1}])
def test_jaccard(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    r = random.Random(5)
    texts = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "one two three")]
    for _ in range(8):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.choice((8, 40, 90)))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randrange(100)}"
            texts.append((len(texts), " ".join(w)))
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t, 1) for i, t in texts] + [(None, "a b c d e f", 2)], "doc_id long, text string, token long")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_groups(df).collect()}
    assert got.pop(None) == (2, None)
    assert got == brute(texts)
    kept = sorted(x.doc_id for x in jaccard.keep_one(df.unionByName(df)).where("doc_id is not null").collect())
    assert kept == sorted({c for _, c in brute(texts).values()})


@pytest.mark.parametrize("limits", [{}, {"CELL": 8, "CELL_SHINGLES": 900, "MAX_PARTS": 1}])
def test_jaccard_of_a_hot_group(spark, monkeypatch, limits):
    """A third of all documents are near copies: their postings are dealt to several tasks."""
    for k, v in ({"HOT": 4} | limits).items():
        monkeypatch.setattr(jaccard, k, v)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(5000)}"
    base, texts = [word() for _ in range(120)], []
    for i in range(120):
        w = list(base) if i % 3 == 0 else [word() for _ in range(r.choice((3, 30, 110)))]
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = word()
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame([*texts, *((1000 + i, t) for i, t in texts[:9])], "doc_id long, text string").repartition(7)
    _, hot = jaccard.crowded_buckets(df)
    assert len(hot) > 50 and max(hot.values()) > 5
    parts = jaccard.shared(jaccard.prefix_sets(df, bytes(1 << jaccard.BUCKET_BITS - 3), hot).selectExpr("posexplode(tokens) as (at, token)", "parts", "doc_id", "fa as label", "n").selectExpr("token", "coalesce(get(parts, at), 0) as part", "doc_id", "label", "n"))
    assert parts.where("part > 1").count() > 0
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_groups(df).collect()}
    assert got == brute([*texts, *((1000 + i, t) for i, t in texts[:9])])


def test_jaccard_of_nothing(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "near_duplicates", "decontamination", "packing"]
    one = stages["language_id"](spark, docs, SMALL)
    assert one.columns == docs.columns and one.count() >= 0.97 * docs.count()
    kept = stages["near_duplicates"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()]).values()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and len({r.doc_id for r in rows}) > 0.5 * docs.count()


def test_token_files_of_the_least_id_and_of_one_id(spark):
    rows = [(None, "a"), (-(2**63), "b c"), (7, None)] + [(7, f"word {k}") for k in range(60)] + [(2**63 - 1, "d")]
    to = common.scratch(spark, "t")
    m = idfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORD, 2, to)
    got = idfiles.read_token_files(spark, to, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(2**63), *[7] * 61, 2**63 - 1] and sum(s["n_nulls"] for s in m["shards"]) == 1
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    assert sorted(r.ids for r in got) == sorted(t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in rows)
