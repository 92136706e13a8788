"""Segments of the id coder: the ids are the library's, and each word is encoded once, whatever stands beside it."""

import random

import pyarrow as pa
import public_tokenizers
import pytest

from causeway.llm import tokens

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "It", "don", "É", "é", "ß", "×", "÷", "ñ", "ª", "Ω", "İ", "K", ";", "`", "日", "́", "̱", "̸", "H", "h", "=", "<", "|", "'", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>"]
PARTS += ["endoftext", ".", ",%%%", "!", "_", "-", "(", "]", "`", "\\", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "🙂", "ﬁ", "\x00"]


def encoded(c, texts, size=tokens.BATCH_BYTES):
    out = []
    for _, n, data, offsets in tokens.byte_chunks(pa.array(texts), size):
        ids, bounds = c.encode(data, offsets)
        out += [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(n)]
    return out


def watched(path, monkeypatch):
    """A coder and the list of the segments that it encodes."""
    c, seen = tokens.IdCoder(path), []
    code = c.code
    monkeypatch.setattr(c, "code", lambda segment: seen.append(segment) or code(segment))
    return c, seen


def library(c, texts):
    return [x.ids for x in c.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("special", [False, True])
def test_ids_of_joined_parts(path, special):
    r, c = random.Random(int(special)), tokens.IdCoder(path)
    texts = ["".join(r.choice(PARTS if r.random() < 0.5 else PARTS[:6] + [" ", "."]) for _ in range(r.randrange(14))) for _ in range(3000)]
    if not special:
        texts = [t.replace("<|", "") for t in texts]
    assert encoded(c, texts) == encoded(c, texts, 100) == library(c, texts)


WORDS = [a + b + c for a in "bdfgk" for b in ("é", "oa", "u") for c in ("lm", "nt", "ß")]


def test_words_are_encoded_once_whatever_marks_follow(monkeypatch):
    c, seen = watched(BYTE, monkeypatch)
    texts = [" ".join(["so"] + [w + mark for w in WORDS]) + "\n" + "\n".join(WORDS) for mark in ("", ".", ",", "!!", ",%%%", "'")]
    assert encoded(c, texts) == library(c, texts)
    assert len(seen) <= 2 * len(WORDS) + 10  # with a space before and without, and the marks


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_in_use_stay_known_when_the_cache_begins_anew(monkeypatch, path):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    c, seen = watched(path, monkeypatch)
    for k in range(40):
        texts = [" so " + " ".join(WORDS), " so " + " ".join(f"x{i}q" for i in range(60 * k, 60 * k + 60))]
        assert encoded(c, texts) == library(c, texts)
        assert len(c.cache) + len(c.older) < 400
    assert sum(s.strip() == WORDS[0].encode() for s in seen) == 1


def test_words_are_encoded_once_whatever_their_case_and_the_white_space_before_them(monkeypatch):
    c, seen = watched(WORD, monkeypatch)
    words = [w for w in WORDS if w[1] != "é"]  # a capital before a letter beyond ASCII is lowered segment by segment
    texts = [space + space.join(f(w) for w in words) for space in (" ", "\n", "\t ", "\n\n") for f in (str, lambda w: w[0].upper() + w[1:])]
    assert encoded(c, texts) == library(c, texts)
    assert len(seen) == len(words)


def test_case_that_matters_under_the_word_vocabulary():
    c, texts = tokens.IdCoder(WORD), ["H̱ ẖ É é", "A<|endoftext|>B", "A<|ENDOFTEXT|>B"]
    for t in texts:  # in a buffer of its own, and beside others
        assert encoded(c, [t]) == library(c, [t])
    assert encoded(c, texts) == library(c, texts)
