"""Exact batch tokenisation that encodes every distinct text segment once.

Each public vocabulary splits a text at white space before any merge, so the ids of a text
are the ids of its segments in order.  A batch of texts is one byte buffer: numpy finds the
segments, groups them by hash and compares each with the first of its group byte by byte;
only the distinct ones are looked up or given to the library, and a ragged gather puts the
ids back in text order.  Texts in which a boundary could be unsafe
(rare white-space characters) go to the library whole.
"""

from __future__ import annotations

import re
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from causeway.llm.caches import register, use

#: Estimated bytes of cached segments in one Python worker; beyond it the cache starts anew.
CACHE_BYTES = 96 << 20
#: Bytes of text handled at a time.
BATCH_BYTES = 2 << 20
#: Bytes that are hashed at a time.
HASH_BYTES = 256 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space that Python or the libraries know besides space, \t, \n, \v, \f and \r.
_ODD = [*"\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = (_LOWER >= 97) & (_LOWER <= 122)
#: Second bytes of Latin letters behind 0xC3: all but the signs of multiplication and division.
_LETTER_C3 = (_LOWER >= 0x80) & (_LOWER < 0xC0)
_LETTER_C3[[0x97, 0xB7]] = False
#: ASCII punctuation but for the bar.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        power = np.full(HASH_BYTES + 1, base)
        power[0] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices [start, end) of a buffer, in order and apart, from prefix sums.

    They group slices quickly; texts can be made to collide, so ``distinct`` compares the bytes.
    """
    power, inverse = _power_tables()
    out, i = np.zeros(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + HASH_BYTES, "right"))
        if j <= i:  # a slice longer than a block
            out[i] = int.from_bytes(blake2b(data[a : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = data[a : ends[j - 1]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * inverse[starts[i:j] - a]
        i = j
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out += (ends - starts).astype(np.uint64)
    out ^= out >> np.uint64(29)
    return out


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def first_eight(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first bytes, up to eight, of slices as numbers."""
    return _eights(data)[starts] & _MASKS[np.minimum(8, length)]


def holding(data: np.ndarray, offsets: np.ndarray, signs: list[str]) -> list[int]:
    """The texts of a buffer that hold one of the characters."""
    codes = [c.encode() for c in signs]
    lead = np.zeros(256, dtype=bool)
    lead[[c[0] for c in codes]] = True
    at = np.flatnonzero(lead[data])
    if not len(at):
        return []
    eight, hit = _eights(data)[at], np.zeros(len(at), dtype=bool)
    for n in {len(c) for c in codes}:
        hit |= np.isin(eight & _MASKS[n], np.array([int.from_bytes(c, "little") for c in codes if len(c) == n], dtype=np.uint64))
    return np.unique(np.searchsorted(offsets, at[hit], "right") - 1).tolist()


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the slices of ``length`` bytes at ``a`` and ``b`` differ."""
    out = np.zeros(len(a), dtype=bool)
    for k in np.flatnonzero((length > 128) & (a != b)).tolist():
        out[k] = not np.array_equal(data[a[k] : a[k] + length[k]], data[b[k] : b[k] + length[k]])
    eight = _eights(data)
    left = np.flatnonzero((length <= 128) & (a != b))
    done = 0
    while len(left):
        mask = _MASKS[np.minimum(8, length[left] - done)]
        out[left] |= (eight[a[left] + done] ^ eight[b[left] + done]) & mask != 0
        done += 8
        left = left[length[left] > done]
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one slice of each distinct content, and for each slice the index of its content in them."""
    hashes = slice_hashes(data, starts, ends)
    order = np.argsort(hashes)
    hashes, new = hashes[order], np.ones(len(order), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    at, inverse = order[new], np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    length, first = ends - starts, at[inverse]
    wrong = length != length[first]
    same = np.flatnonzero(~wrong)
    wrong[same] = _differ(data, starts[same], starts[first[same]], length[same])
    others: dict[bytes, int] = {}  # of equal hash, but not equal
    more = []
    for k in np.flatnonzero(wrong).tolist():
        content = data[starts[k] : ends[k]].tobytes()
        if content not in others:
            others[content] = len(at) + len(more)
            more.append(k)
        inverse[k] = others[content]
    return np.concatenate((at, np.array(more, dtype=at.dtype))), inverse


def byte_chunks(texts: pa.Array, size: int = BATCH_BYTES):
    """Slices of a string array of about ``size`` bytes each, as (first, count, buffer, offsets).

    Nulls count as empty.  One text is never divided.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        wide = texts
    else:
        wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(wide):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class _Coder:
    """Cached codes of segments; a subclass says how to cut texts and how to encode."""

    unsafe = _ODD

    def __init__(self):
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the cache before it began anew
        self.size = 0

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of segments; each lies within one text, and they cover what counts."""
        space = _SPACE[data]
        first = np.zeros(len(data), dtype=bool)
        if len(data):
            first[1:] = space[1:] & ~space[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], len(data))

    def code(self, segment: bytes) -> bytes:
        raise NotImplementedError

    def codes(self, segments: list[bytes]) -> list[bytes]:
        """The codes of distinct segments."""
        if self.size > CACHE_BYTES // 2:
            self.cache, self.older = {}, self.cache
            self.size = 0
        out = list(map(self.cache.get, segments))
        away = [k for k, c in enumerate(out) if c is None]
        asked = [segments[k] for k in away]
        found = list(map(self.older.get, asked))
        new = [k for k, c in enumerate(found) if c is None]
        for k in new:
            found[k] = self.code(asked[k])
        for k, c in zip(away, found, strict=True):
            out[k] = c
        self.cache.update(zip(asked, found, strict=True))
        self.size += 110 * len(asked) + sum(map(len, asked)) + sum(map(len, found))
        return out

    def batch(self, data: np.ndarray, offsets: np.ndarray):
        """(segment codes of the distinct segments, index of each segment in them, its text)."""
        whole = data.tobytes()
        odd = {k: self.code(whole[offsets[k] : offsets[k + 1]]) for k in holding(data, offsets, self.unsafe)}
        starts, ends = self.cut(data, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        if odd:
            keep = ~np.isin(owner, np.fromiter(odd, dtype=np.int64))
            starts, ends, owner = starts[keep], ends[keep], owner[keep]
        at, inverse = distinct(data, starts, ends)
        codes = self.codes([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        if odd:
            order = np.argsort(np.concatenate([owner, np.fromiter(odd, dtype=np.int64)]), kind="stable")
            inverse = np.concatenate([inverse, len(codes) + np.arange(len(odd))])[order]
            owner = np.concatenate([owner, np.fromiter(odd, dtype=np.int64)])[order]
            codes = codes + list(odd.values())
        return codes, inverse, owner


class IdCoder(_Coder):
    """Ids of a ``tokenizers`` vocabulary whose pre-tokeniser splits at white space.

    Both public patterns begin a new match at a punctuation mark behind a letter, and behind a single white-space
    character other than a space, whatever follows: there segments end too, so that words are known with
    any mark or line end beside them.  A bar is no such mark, for special tokens hold a letter before one.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size_of_vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.lower = self.tokenizer.normalizer is not None  # then white space has no tokens
        self.word = re.compile((b"" if self.lower else b" ?") + rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
        self.packed = [i.to_bytes(4, "little") for i in range(self.size_of_vocabulary)]

    def batch(self, data, offsets):
        if self.lower and b"<|" not in data.tobytes():  # a special token is known by its case
            plain = np.append(data[1:], 0) < 128  # composition with a mark behind a letter comes first, and may depend on case
            data = np.where(plain, _LOWER[data], data)
        return super().batch(data, offsets)

    def cut(self, data, offsets):
        if not len(data):
            return super().cut(data, offsets)
        space = _SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        marks = np.flatnonzero(_MARK[data[1:]])
        before = data[marks]
        first[marks + 1] = _LETTER[before] | (data[marks - 1] == 0xC3) & _LETTER_C3[before]
        first[offsets] = True
        if self.lower:
            begins = ~space
            begins[1:] &= space[:-1] | first[1:-1]
            ends = ~space
            ends[:-1] &= space[1:] | first[1:-1]
            return np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first[1:-1] |= space[1:] & ~space[:-1]
        breaks = np.flatnonzero(space[:-1] & (data[:-1] != 32))
        first[breaks + 1] |= first[breaks] & ~space[breaks + 1]
        starts = np.flatnonzero(first[:-1])
        return starts, np.append(starts[1:], len(data))

    def code(self, segment: bytes) -> bytes:
        if not self.word.fullmatch(segment):
            return np.array(self.tokenizer.encode(segment.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.lower:  # one pre-token, known in advance
            segment = segment.decode().lower().encode()
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(segment.decode("latin-1").translate(self.alphabet))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a buffer in order, and where each text's begin (n + 1 values)."""
        codes, inverse, owner = self.batch(data, offsets)
        lengths = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        flat = np.frombuffer(b"".join(codes), dtype="<u4")
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        n = lengths[inverse]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[inverse] - (ends - n), n) + np.arange(total)] if total else flat[:0]
        per_text = np.bincount(owner, weights=n, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer."""
        codes, inverse, owner = self.batch(data, offsets)
        lengths = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        return np.bincount(owner, weights=lengths[inverse], minlength=len(offsets) - 1).astype(np.int64)


def encode_ended(c: IdCoder, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``IdCoder.encode``, with the end id after each text."""
    ids, bounds = c.encode(data, offsets)
    n = np.arange(len(bounds))
    out = np.full(len(ids) + len(bounds) - 1, end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(n[:-1], np.diff(bounds))] = ids
    return out, bounds + n


class PieceCounter(_Coder):
    """Token counts of a ``sentencepiece`` model without pieces that hold an inner space mark.

    Its segments end before a single space between two other characters: no piece crosses
    that place, and the mark that the library puts before each text stands for the space.
    """

    unsafe = ["\u2581"]

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def cut(self, data, offsets):
        edge = data == 32
        inner = np.zeros(len(data), dtype=bool)
        if len(data) > 2:
            inner[1:-1] = edge[1:-1] & ~edge[:-2] & ~edge[2:]
        bounds = offsets[1:-1]
        inner[bounds[bounds < len(data)]] = False  # the first and last characters of a text
        inner[bounds[bounds > 0] - 1] = False
        cuts = np.flatnonzero(inner)
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts = np.sort(np.concatenate([begin, cuts + 1]))
        close = np.sort(np.concatenate([cuts, offsets[1:][offsets[:-1] < offsets[1:]]]))
        return starts, close

    def code(self, segment: bytes) -> bytes:
        return len(self.model.encode(segment.decode())).to_bytes(8, "little")

    def codes(self, segments):
        if self.size > CACHE_BYTES:
            self.cache.clear()
            self.size = 0
        new = [s for s in segments if s not in self.cache]
        at = 0
        while at < len(new):  # calls of about 256 KB
            to, size = at, 0
            while to < len(new) and size < 1 << 18:
                size += len(new[to])
                to += 1
            for s, ids in zip(new[at:to], self.model.encode([s.decode() for s in new[at:to]], num_threads=1), strict=True):
                self.cache[s] = len(ids).to_bytes(8, "little")
                self.size += 140 + len(s)
            at = to
        return [self.cache[s] for s in segments]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer."""
        codes, inverse, owner = self.batch(data, offsets)
        n = np.frombuffer(b"".join(codes), dtype="<i8")[inverse]
        return np.bincount(owner, weights=n, minlength=len(offsets) - 1).astype(np.int64)


_loaded: dict[tuple[type, str], _Coder] = {}


def coder(kind: type, path: str):
    """The worker's coder of a vocabulary file, loaded once while its stage runs."""
    use(path)
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
        register(path, lambda: [_loaded.pop(k) for k in list(_loaded) if k[1] == path])
    return _loaded[kind, path]
