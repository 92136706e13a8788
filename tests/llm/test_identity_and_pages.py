"""Texts made to collide, pages without marked containers, and scanners in linear time."""

import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from causeway.llm import decontam, gif, html, tokens, words


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t[:n])


A = thue_morse(2048)
B = A.translate(str.maketrans("ab", "ba"))


def buffer(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("stub", [False, True])
def test_colliding_segments_have_their_own_ids(monkeypatch, name, stub):
    if stub:
        monkeypatch.setattr(tokens, "slice_hashes", lambda data, starts, ends: (starts * 7919 % 3).astype(np.uint64))
    path, text = public_tokenizers.path(name), f" {A} {B} x {A} yy zz {B} yy"
    assert tokens.IdCoder(path).encode(*buffer(text))[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_colliding_words_are_different_shingles():
    (a,), (b,) = words.shingle_sets(*buffer(A)), words.shingle_sets(*buffer(B))
    assert a.tolist() != b.tolist()


def test_a_long_segment_behind_short_ones():
    text = "a b " + "c" * 3_000_000
    starts, ends, _ = words.word_bounds(*buffer(text))
    at, inverse = tokens.distinct(buffer(text)[0], starts, ends)
    assert len(at) == 3 and sorted(inverse.tolist()) == [0, 1, 2]


@pytest.mark.parametrize("page", ["<a " * 333_000, "<div>" * 100_000 + "x", "<object>" * 20_000 + "x", "<x y='" * 100_000])
def test_pages_without_end_take_time_in_proportion(page):
    began = time.time()
    html.features(html.leaf_blocks(page))
    assert time.time() - began < 5


def test_articles_without_marked_containers():
    field = html.trained_field()
    one, two = "A first long paragraph of words that go on, and goes on.", "And a second one that is as long as it."
    for page in (f"<nav><a href=/>Home</a></nav><div class=col-8><h1>Title</h1><p>{one}<p>{two}</div><footer>(c) Us</footer>", f'<div id="content"><p>{one}<p>{two}', f"<html><body><div><p>{one}</p><p>{two}</p></div></body></html>"):
        assert html.extract(page, field).endswith(f"{one}\n{two}")


def test_slash_at_the_end_of_an_open_tag():
    assert [(b.text, "in:article" in b.path.features()) for b in html.leaf_blocks("<div id=/main/>One<article/>Two</article>Three</div>")] == [("One", False), ("Two", True), ("Three", False)]


def test_formulas_names_and_short_items():
    def found(item, doc):
        return decontam.leaks(decontam.tokens(*buffer(doc)), decontam.build_table([(1, item)]))

    assert found("Compute 12 + 5 * 3 - 4 = ?", "So, compute 7 + 9 * 2 - 1 = ? Well.")
    assert found("Alice walked to the market and bought 12 oranges for 5 dollars each.", "Carla walked to the market and bought 30 oranges for 2 dollars each.")
    assert found("two plain words", "these are two plain words indeed") and not found("two plain words", "these are two odd words indeed")


def test_gif_strings_of_two_samples():
    r = np.random.default_rng(3)
    for n in (1, 2, 191, 193, 5000, 36_864):
        for high in (1, 2, 30, 256):
            data = r.integers(0, high, n).astype(np.uint8).tobytes()
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n).tobytes() == data


def test_repeated_windows_cost_little():
    """An item and a document of two words in turn: alignments, not pairs of windows."""
    import time
    import tracemalloc

    raw = np.frombuffer(b"ab cd " * 30_000, np.uint8)
    bench = decontam.build_table([(1, "ab cd " * 200)])
    t = decontam.tokens(raw, np.array([0, len(raw)]))
    began = time.process_time()
    assert decontam.leaks(t, bench) == {0: [(1, 400, 0, True)]}
    assert time.process_time() - began < 8
    tracemalloc.start()
    decontam.leaks(t, bench)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("old, new", [("MIT", "NYU"), ("McDonald", "O'Brien"), ("Ann", "ETH"), ("O'Neil", "Tom")])
def test_names_of_any_shape(old, new):
    item = "In the town {0} has 12 students who each own 3 bikes, and {0} shares one large garage near the river with 4 others"
    texts = [item.format(new).replace("12", "23").encode(), item.format(old).encode(), item.format(new).replace("garage", "palace").replace("river", "forest").replace("bikes", "cars").encode()]
    t = decontam.tokens(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    found = decontam.leaks(t, decontam.build_table([(7, item.format(old))]))
    assert sorted(found) == [0, 1] and not found[0][0][3] and found[1][0][3]


def _ordinary_lzw_bytes(data):
    """The length of the code stream that the textbook's encoder, with strings as keys, gives."""
    table, bits, since, codes, w = {bytes([k]): k for k in range(256)}, 9, 0, 0, b""
    wide = lambda: min(12, max(9, (258 + max(0, since - 1)).bit_length()))
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        bits, since = bits + wide(), since + 1
        if len(table) + 2 < 4096:
            table[w + bytes([c])] = len(table)
        else:
            bits, since, table = bits + wide(), 0, {bytes([k]): k for k in range(256)}
        w = bytes([c])
    bits, since = bits + wide(), since + 1
    return -(-(bits + wide()) // 8)


def test_gif_matches_are_the_longest(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts = [t[: 192 * 192] for t in texts if t] + [b"ab" * 18_000, bytes(range(256)) * 144, bytes(np.random.default_rng(1).integers(0, 256, 36_864, dtype=np.uint8))]
    for t in texts[-3:]:
        assert gif.lzw_decode(gif.lzw_encode(t), 8, len(t)).tobytes() == t
    ours, ordinary = (sum(f(t) for t in texts) for f in (lambda t: len(gif.lzw_encode(t)), _ordinary_lzw_bytes))
    assert abs(ours - ordinary) <= 0.02 * ordinary


@pytest.mark.parametrize("deep", [0, 5, 40, 400])
def test_comments_and_footers_at_any_depth(deep):
    inside = lambda t: "<div>" * deep + t + "</div>" * deep
    page = f"""<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Fish and chips for all</h1><p>One two three four five six, seven eight nine. The end of it.</p>
<p>The next words follow here, and there are many of them.</p><section class="comments">{inside("<p>I do not agree with any of this at all.</p>")}</section></article><footer>{inside("All of this is ours to keep.")}</footer></body></html>"""
    assert html.extract(page, html.trained_field()).split("\n") == ["Fish and chips for all", "One two three four five six, seven eight nine. The end of it.", "The next words follow here, and there are many of them."]


def test_pages_with_and_without_marks(spark):
    """All pages of the middle tables as they are; most without the element, classes, ids and roles that say what is what."""
    import re

    field = html.trained_field()
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    main = ["\n".join(b.text for b in html.leaf_blocks(p) if "in:article" in b.path.features()) for p in pages]
    bare = [re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", re.sub(r"<(/?)article", r"<\1div", p)) for p in pages]
    assert [html.extract(p, field) for p in pages] == main
    assert sum(html.extract(p, field) == m for p, m in zip(bare, main, strict=True)) >= 0.94 * len(pages)


def test_depth_costs_in_proportion():
    page = "".join(f"<div class=a{'abcdefghij'[k % 10]}{'x' * (k // 10 % 900)}>t{k}" for k in range(20_000))
    began = time.process_time()
    html.extract(page, html.trained_field())
    assert time.process_time() - began < 30
