"""Operator 5, benchmark decontamination by templates.

Texts become sequences of canonical tokens: words in lower case without punctuation at
their ends, numbers, units after numbers and names (capitalised words inside a sentence) as
typed placeholders (acronyms and names like O'Brien too).  Names are uncertain, so every window is hashed with them and without,
and once more with the capitalised words that begin a sentence as names too.
Windows of WINDOW tokens (an item of fewer is one window) of the benchmark form a hash
table; the windows of all documents look themselves up in it as they are read, so nothing
of the documents is shuffled.  A window in which placeholders outnumber the plain words
grows until it has as many of these as others must have; where the text ends before, it
counts only if it is the same word for word.

Matches on one alignment of a document and an item are a run.  A run is a leak if it, or a
part of at least LONG tokens with a whole window in it, is re-parameterised consistently
(each slot value of the item stands for one value of the document; two names never for the
same one, but new numbers may be equal), or if some window of it is an exact copy.

An item of more than WINDOW tokens leaks by any of its windows, an item of fewer than LEAST
only by an exact copy.

The benchmark's side of the join goes to the executors in blocks of at most BLOCK_BYTES of
text; each block is a pass of its own, which gathers no other block, and a benchmark of
several has its results written between the passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.caches import register, use
from causeway.llm.common import discard, free_names, table, written
from causeway.llm.tokens import byte_chunks, distinct
from causeway.llm.words import mix, strong_hash, window_hashes, word_bounds

WINDOW = 13
#: Items of fewer tokens are too short to tell a new parameter from chance: only exact copies of them leak.
LEAST = 5
#: Tokens that a consistent part of a run needs if the rest of the run contradicts it.
LONG = 2 * WINDOW
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
#: Distinct words that a Python worker keeps.
CACHE_WORDS = 150_000

_WORD, _NUMBER, _GLUED, _UNIT, _NOTHING = range(5)
_NAME = 5
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: What stands between the letters of a name.
_JOINED = re.compile(r"['\u2019-]")
#: Digits with separators, a power of ten, an ordinal's ending; or one character that is a number.
_NUM = re.compile(r"[+-]?\d[\d.,:/]*(?:e[+-]?\d+|st|nd|rd|th)?|[\u00bc-\u00be\u2150-\u215e]")
#: Signs of formulas, which count as words.
_SYMBOLS = frozenset("+ - * / = < > ^ % \u00d7 \u00f7 \u2264 \u2265 \u2212".split())
_UNITS = frozenset("kg g mg km m cm mm nm l ml lb lbs oz ft in mi yd mph kmh s ms min h hr hrs hz kw mw v w j n pa percent degrees celsius fahrenheit meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur gbp".split())
_SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
#: Words that begin sentences without being names.
_COMMON = frozenset("a about after again all also although an and any are as at because before both but by can could did do does during each either even every few find first for from given had has have he hence her here his how however i if in into is it its last later let many may might more most much must my next no nor not now of on once one only or other our over perhaps she should since so some soon such that the their them then there therefore these they this those though through thus to under until up was we were what when where whether which while who whom whose why will with would yes yet you your das dem den der die ein eine er es ich ihr im ist mit nach sie und von was wenn wer wie wir zu au ce ces cette dans de des du elle en et il ils je la le les mais nous on ou pour quand que qui sur un une vous al como con cuando del el ella ellos en es esta este la las los muchos no para pero por que si su un una y".split())
_GLUE = re.compile(rf"\d[\d.,]*({'|'.join(sorted(_UNITS, key=len, reverse=True))})")
#: Stands for no window in the benchmark's hashes by place; 0 does in a document's.
_NONE = np.uint64(1)
_PLACE = {k: np.uint64(0xA5A5A5A500000000 + k) for k in (_NUMBER, _GLUED, _UNIT, _NAME)}


def _canonical(word: str) -> tuple[bytes, int, bool, bool, bool]:
    """Canonical bytes, kind, whether written as a name, whether a sentence ends here, and whether it may begin one as a name."""
    if word.isalpha():
        core, ends = word, False
    else:
        ends = word.rstrip("\"'”’)]}»")[-1:] in tuple(".!?:…")
        core = word if word in _SYMBOLS else word[:-1] if word[:-1].isalpha() else _EDGE.sub("", word)
        if not core:
            return b"", _NOTHING, False, ends, False
    low = core.lower()
    title = len(core) > 1 and core[0].isupper() and (core[1:].islower() or _JOINED.sub("", core).isalpha())
    if low in _SPELLED or "-" in low and all(x in _SPELLED for x in low.split("-")):
        kind = _NUMBER
    elif low[0].isdigit() or low[0].isnumeric():
        kind = _NUMBER if _NUM.fullmatch(low) else _GLUED if _GLUE.fullmatch(low) else _WORD
    else:
        kind = _UNIT if low in _UNITS else _WORD
    return low.encode(), kind, title, ends, title and low not in _COMMON


_known: dict[bytes, tuple[int, int, bool, bool, bool]] = {}
register("decontamination", _known.clear)


@dataclass
class Tokens:
    """Canonical tokens of the texts of a buffer: value hashes, codes with and without names, slots, names that begin sentences."""

    begin: np.ndarray
    value: np.ndarray
    plain: np.ndarray
    named: np.ndarray
    slot: np.ndarray  # kinds with names, _WORD where the token is a plain word
    opener: np.ndarray  # plain words at the start of a sentence that may be names


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, begin = word_bounds(data, offsets)
    at, inverse = distinct(data, starts, ends)
    if len(_known) > CACHE_WORDS:
        _known.clear()
    whole = data.tobytes()
    keys = [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    for w in keys:
        if w not in _known:
            core, *rest = _canonical(w.decode(errors="replace"))
            _known[w] = (strong_hash(core), *rest)
    rows = [_known[w] for w in keys]
    value = np.array([r[0] for r in rows], dtype=np.uint64)[inverse]
    kind = np.array([r[1] for r in rows], dtype=np.int8)[inverse]
    title = np.array([r[2] for r in rows], dtype=bool)[inverse]
    stop = np.array([r[3] for r in rows], dtype=bool)[inverse]
    opener = np.array([r[4] for r in rows], dtype=bool)[inverse]
    real = kind != _NOTHING
    # Punctuation on its own ends a sentence for the token before it.
    fresh = np.ones(len(stop), dtype=bool)
    fresh[1:] = stop[:-1]
    fresh[begin[:-1][begin[:-1] < len(fresh)]] = True
    new_begin = np.concatenate(([0], np.cumsum(real)))[begin]
    value, kind, title, fresh, opener = value[real], kind[real], title[real], fresh[real], opener[real]
    first = np.zeros(len(kind), dtype=bool)
    first[new_begin[:-1][new_begin[:-1] < len(kind)]] = True
    after_number = np.concatenate(([False], (kind[:-1] == _NUMBER))) & ~first if len(kind) else first
    slot = np.where((kind == _UNIT) & ~after_number, _WORD, kind)
    plain = value.copy()
    for k in (_NUMBER, _GLUED, _UNIT):
        plain[slot == k] = _PLACE[k]
    opener = opener & (slot == _WORD) & (fresh | first)
    slot = np.where((slot == _WORD) & title & ~fresh & ~first, _NAME, slot).astype(np.int8)
    named = np.where(slot == _NAME, _PLACE[_NAME], plain)
    return Tokens(new_begin, value, plain, named, slot, opener)


def _views(t: Tokens) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Codes, which tokens are plain words, and the tokens without which the codes are the first ones: with names as placeholders, as words, and with names at starts of sentences."""
    word, name = t.slot == _WORD, t.slot == _NAME
    opened = np.where(t.opener, _PLACE[_NAME], t.named)
    return [(t.named, word, None), (t.plain, word | name, name), (opened, word & ~t.opener, t.opener)]


def _exact_codes(t: Tokens, size: int) -> np.ndarray:
    return mix(window_hashes(t.value, size) ^ np.uint64(0x1234567))


def _window_codes(t: Tokens, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, hashes and lengths of all windows of a size, for each view of the names."""
    n = len(t.value) - size + 1
    if n <= 0:
        return []
    exact = _exact_codes(t, size)
    if size < LEAST:
        return [(np.arange(n), exact, np.full(n, size))]
    out = []
    for code, words, differs in _views(t):
        have = np.concatenate(([0], np.cumsum(words)))
        enough = 2 * (have[size:] - have[:-size]) >= size
        h = np.where(enough, window_hashes(code, size), exact)
        at = np.arange(n)
        if differs is not None:
            have = np.concatenate(([0], np.cumsum(differs)))
            at = np.flatnonzero(have[size:] > have[:-size])
        out.append((at, h[at], np.full(len(at), size)))
    return out


_STEP = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _grown_codes(t: Tokens, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As _window_codes, of the windows that have too few plain words and grow until they have enough."""
    n = len(t.value) - size + 1
    if n <= 0:
        return []
    out = []
    need = -(-size // 2)
    for code, words, differs in _views(t):
        have = np.concatenate(([0], np.cumsum(words)))
        place = np.flatnonzero(words)
        at = np.flatnonzero(2 * (have[size:] - have[:-size]) < size)
        at = at[have[at] + need <= len(place)]
        end = place[have[at] + need - 1] + 1
        if differs is not None:
            have = np.concatenate(([0], np.cumsum(differs)))
            keep = have[end] > have[at]
            at, end = at[keep], end[keep]
        if not len(at):
            continue
        # Sums over code * step^-place, moved to a common place: equal for equal codes.
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code) * _powers(pow(_STEP, -1, 1 << 64), len(code)), dtype=np.uint64)))
        h = (sums[end] - sums[at]) * _powers(_STEP, len(code))[at]
        out.append((at, mix(h + (end - at).astype(np.uint64)), end - at))
    return out


@dataclass
class Table:
    """The benchmark's windows: sorted hashes with item and place, for each window size; 0 has the grown ones."""

    items: list[int]
    values: list[np.ndarray]
    slots: list[np.ndarray]
    openers: list[np.ndarray]
    window: int
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    filters: dict[int, np.ndarray]
    by_place: dict[int, dict[int, np.ndarray]]  # for each window size and item, the views' hashes by place, _NONE where there is none


def build_table(rows: list[tuple[int, str]], window: int = WINDOW) -> Table:
    """Items of equal text are one, that of the smallest id."""
    texts: dict[str, int] = {}
    for item, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        texts.setdefault(text, item)
    out = Table([], [], [], [], window, {}, {}, {})
    found: dict[int, list] = {}
    for text, item in texts.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        t = tokens(raw, np.array([0, len(raw)]))
        n = len(t.value)
        if not n:
            continue
        size, k = min(window, n), len(out.items)
        out.items.append(item)
        out.values.append(t.value)
        out.slots.append(t.slot)
        out.openers.append(t.opener)
        for of, codes in ((size, _window_codes(t, size)), (0, _grown_codes(t, window))):
            for at, h, _ in codes:
                found.setdefault(of, []).append((h, np.full(len(h), k), at))
                row = np.full((1, n), _NONE, dtype=np.uint64)
                row[0, at] = h
                rows = out.by_place.setdefault(of, {})
                rows[k] = np.concatenate([rows[k], row]) if k in rows else row
    for size, parts in found.items():
        h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1])
        out.windows[size] = h[new], item[new], place[new]
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(h >> np.uint64(44)).astype(np.int64)] = True
        out.filters[size] = bits
    return out


def _consistent(item: list[int], doc: list[int], name: list[bool]) -> list[tuple[int, int]]:
    """The maximal parts [a, b) of two rows of slot values in which each value of the item stands for one of the document, and two names never for one."""
    forth: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    out, a, n = [], 0, len(item)

    def fits(k: int) -> bool:
        return forth.get(item[k], [doc[k]])[0] == doc[k] and (not name[k] or back.get(doc[k], [item[k]])[0] == item[k])

    for b in range(n):
        if not fits(b):
            out.append((a, b))
            while not fits(b):
                for at, key in ((forth, item[a]), (back, doc[a])) if name[a] else ((forth, item[a]),):
                    at[key][1] -= 1
                    if not at[key][1]:
                        del at[key]
                a += 1
        forth.setdefault(item[b], [doc[b], 0])[1] += 1
        if name[b]:
            back.setdefault(doc[b], [item[b], 0])[1] += 1
    return [*out, (a, n)]


def _runs(t: Tokens, bench: Table) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """Runs of windows that follow one another in a text and in an item: text, item, shift, first and last window, lengths of the windows.

    A run is found where it begins: of the places of a window in the benchmark, those behind which the window before
    doesn't stand.  That is looked up once for each pair of neighbouring windows, so a text that repeats itself, as an item may too,
    gives a run for each alignment and not a hit for each pair of equal windows.
    """
    for size, (hashes, item, place) in bench.windows.items():
        key = item.astype(np.int64) << 32 | place
        for at, h, length in _window_codes(t, size) if size else _grown_codes(t, bench.window):
            may = np.flatnonzero(bench.filters[size][(h >> np.uint64(44)).astype(np.int64)])
            at, h, length = at[may], h[may], length[may]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            text = np.searchsorted(t.begin, at, "right") - 1
            ok = np.flatnonzero((high > low) & (at + length <= t.begin[text + 1]))
            if not len(ok):
                continue
            at, h, low, high, text = at[ok], h[ok], low[ok], high[ok], text[ok]
            here, lengths = np.zeros(len(t.value), dtype=np.uint64), np.zeros(len(t.value), dtype=np.int64)
            here[at], lengths[at] = h, length[ok]
            before = np.where(at > t.begin[text], here[at - 1], 0).tolist()
            begins: dict[tuple[int, int], list[tuple[int, int]]] = {}
            ends = t.begin[text + 1].tolist()
            for p, g, x, a, b, d, end in zip(at.tolist(), before, h.tolist(), low.tolist(), high.tolist(), text.tolist(), ends, strict=True):
                if (new := begins.get((g, x))) is None:
                    mine = slice(a, b)
                    fresh = np.ones(b - a, dtype=bool)
                    if g:
                        of = slice(np.searchsorted(hashes, np.uint64(g), "left"), np.searchsorted(hashes, np.uint64(g), "right"))
                        fresh = ~np.isin(key[mine] - 1, key[of])
                    new = begins[g, x] = list(zip(item[mine][fresh].tolist(), place[mine][fresh].tolist(), strict=True))
                for i, q in new:
                    rows = bench.by_place[size][i][:, q : q + end - p]
                    same = (rows == here[p : p + rows.shape[1]]).any(axis=0)
                    n = int(same.argmin())
                    yield d, i, p - q, p, p + (n if n or not same[0] else len(same)) - 1, lengths


def leaks(t: Tokens, bench: Table) -> dict[int, list[tuple[int, int, int, bool]]]:
    """Of each text of a buffer with leaks: (item_id, tokens matched, slots changed, word for word)."""
    runs = sorted(_runs(t, bench), key=lambda r: r[:5])
    found: dict[int, dict[int, tuple[int, int, int, bool]]] = {}
    if not runs:
        return found
    # Sums that know a piece of a text by its tokens: equal pieces on one place of an item are judged once.
    code = mix(t.value ^ (t.slot.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ t.opener.astype(np.uint64) << np.uint64(40))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * _powers(pow(_STEP, -1, 1 << 64), len(code)), dtype=np.uint64)))
    back = _powers(_STEP, len(code))
    judged: dict[tuple, tuple[int, int, int, bool] | None] = {}
    k = 0
    with np.errstate(over="ignore"):
        while k < len(runs):
            d, item, shift, begin, last, lengths = runs[k]
            end, j = last + int(lengths[last]), k + 1
            parts = [(begin, last, lengths)]
            while j < len(runs) and runs[j][:3] == (d, item, shift) and runs[j][3] <= end:
                parts.append(runs[j][3:])
                end = max(end, runs[j][4] + int(runs[j][5][runs[j][4]]))
                j += 1
            k = j
            about = (item, begin - shift, end - begin, int((sums[end] - sums[begin]) * back[begin]), tuple((a - begin, b - begin) for a, b, _ in parts))
            if about not in judged:
                judged[about] = _judged(t, bench, item, shift, begin, end, parts)
            row = judged[about]
            if row is not None:
                old = found.setdefault(d, {}).get(item)
                if old is None or row[1] > old[1]:
                    found[d][item] = row
    return {d: sorted(x.values()) for d, x in found.items()}


def _judged(t: Tokens, bench: Table, item: int, shift: int, begin: int, end: int, parts: list[tuple[int, int, np.ndarray]]) -> tuple[int, int, int, bool] | None:
    """What a run of an item in a text comes to, if it is a leak."""
    place = slice(begin - shift, end - shift)
    mine, theirs = t.value[begin:end], bench.values[item][place]
    same = mine == theirs
    wrong = np.concatenate(([0], np.cumsum(~same)))
    exact = any((wrong[np.arange(a, b + 1) + n[a : b + 1] - begin] == wrong[a - begin : b + 1 - begin]).any() for a, b, n in parts)
    opened = (t.opener[begin:end] | bench.openers[item][place]) & ~same
    name = (t.slot[begin:end] == _NAME) | (bench.slots[item][place] == _NAME) | opened
    slot = (t.slot[begin:end] != _WORD) | (bench.slots[item][place] != _WORD) | opened
    low, high = 0, end - begin
    if not exact:
        at = np.flatnonzero(slot)
        runs = _consistent(theirs[at].tolist(), mine[at].tolist(), name[at].tolist())
        if len(runs) > 1:
            # From after the slot before the part to the slot after it.
            edges = [-1, *at.tolist(), end - begin]
            spans = [(edges[a] + 1, edges[b + 1]) for a, b in runs]
            # Windows' ends grow with their places, so the first one in the span is the first to end.
            first = lambda s, a, b, n: max(s[0] + begin, a) <= b and max(s[0] + begin, a) + n[max(s[0] + begin, a)] <= s[1] + begin
            spans = [s for s in spans if s[1] - s[0] >= LONG and any(first(s, *x) for x in parts)]
            if not spans:
                return None
            low, high = max(spans, key=lambda x: x[1] - x[0])
    return bench.items[item], high - low, int((~same & slot)[low:high].sum()), bool(exact)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Table]:
    """Tables of BLOCK_BYTES of text at most each, one at a time; equal texts are in one block."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t"))
    rows = rows.where("i is not null").groupBy("t").agg(F.min("i").alias("i"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * int(size) // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k) if n > 1 else rows
        yield build_table([(r.i, r.t) for r in part.collect()])


def leak_column(text: Column, bench: Table) -> Column:
    """Array of (item_id, n_tokens, n_changed, exact): the leaks of each text, none for null or empty."""
    kind = "array<struct<item_id long, n_tokens long, n_changed long, exact boolean>>"
    fields = pa.struct([("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_changed", pa.int64()), ("exact", pa.bool_())])

    def find(texts: pa.Array) -> pa.Array:
        use("decontamination")
        out: list[list] = [[] for _ in range(len(texts))]
        for at, _, data, offsets in byte_chunks(texts, CHUNK_BYTES):
            for d, rows in leaks(tokens(data, offsets), bench).items():
                out[at + d] = [dict(zip(("item_id", "n_tokens", "n_changed", "exact"), r, strict=True)) for r in rows]
        return pa.array(out, pa.list_(fields))

    return F.arrow_udf(find, kind)(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the leaks of every whole text in column ``out``; a column of that name is replaced.

    Null and empty items aren't looked for, nor those of a null id; an empty benchmark finds
    none; null and empty texts have none; very long texts are read whole; repeated rows of
    either table have their results each, items of equal text under the smallest id.
    """
    blocks = iter(_blocks(benchmark, item, item_text))
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return docs.withColumn(out, leak_column(F.col(text), block))
    (name,) = free_names(docs, "__found")
    found = written(docs.withColumn(name, leak_column(F.col(text), block)), "leaks")
    while more is not None:
        old, found = found, written(found.withColumn(name, F.concat(name, leak_column(F.col(text), more))), "leaks")
        discard(old)
        more = next(blocks, None)
    return found.withColumn(name, F.array_sort(name)).drop(out).withColumnRenamed(name, out)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each benchmark item that leaks into it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.n_tokens", "l.n_changed", "l.exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows share a fate; an empty benchmark drops none.
    """
    (name,) = free_names(docs, "__leaks")
    return with_leaks(docs, benchmark, out=name).where(F.size(name) == 0).drop(name)
