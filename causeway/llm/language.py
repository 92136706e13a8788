"""Operator 4, language ID by error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit reads hashed byte
n-grams and predicts it.  Up to seven languages use the exhaustive code (2^(k-1) - 1 bits),
more a random code with wide distances.  Loss-weighted decoding adds the logistic losses of
the bits against each codeword, weighted by how well the bit's classifier does on that
language in training, and takes the nearest codeword; a small margin over the second one
flags the text as ambiguous.

The model is fitted on a bounded sample of labelled rows: about ``per_language`` whole texts
of every language, chosen by a hash of the id, of which the driver holds the sparse features.
Prediction reads every whole text: n-gram weights are summed over all of its bytes, in
chunks, with a letter's case folded and everything that isn't a letter taken as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.caches import use
from causeway.llm.common import free_names, table
from causeway.llm.tokens import byte_chunks

#: n-gram orders and hashed features of a text.
ORDERS, FEATURES = (2, 3, 4), 1 << 13
CHUNK_BYTES = 1 << 20
#: Sample rows that are dense at once in training.
BLOCK_ROWS = 2048
UND = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case letters (ASCII and Latin-1); other ASCII bytes become spaces."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[1:][upper] += 0x20
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed n-grams of all texts, and where each text's begin (n + 1 values)."""
    text = fold(data).astype(np.uint32)
    length = np.diff(offsets)
    code = text.copy()
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] + text[n - 1 :] * np.uint32(1 << 8 * (n - 1)) if len(code) > 1 else code[:0]
        if n not in ORDERS:
            continue
        ok = np.ones(len(code), dtype=bool)
        for back in range(1, n):  # not across the end of a text
            at = offsets[1:-1] - back
            ok[at[(at >= 0) & (at < len(ok))]] = False
        h = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - 13)
        yield h[ok], np.concatenate(([0], np.cumsum(np.maximum(0, length - n + 1))))


def frequencies(data: np.ndarray) -> np.ndarray:
    """Relative frequencies of the hashed n-grams of one text."""
    total, n = np.zeros(FEATURES), 0
    for a in range(0, max(1, len(data)), CHUNK_BYTES):
        part = data[a : a + CHUNK_BYTES + max(ORDERS) - 1]
        for h, _ in grams(part, np.array([0, len(part)])):
            total += np.bincount(h, minlength=FEATURES)
            n += len(h)
    return (total / max(1, n)).astype(np.float32)


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """A row of +1 and -1 for each of ``k`` languages."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        return np.array([[1 if (c >> i) & 1 or i == k - 1 else -1 for c in range(2 ** (k - 1) - 1)] for i in range(k)])
    bits, rng = int(np.ceil(12 * np.log2(k))), np.random.default_rng(seed)
    tries = [rng.choice([-1, 1], size=(k, bits)) for _ in range(50)]
    return max(tries, key=lambda m: min((m[i] != m[j]).sum() for i in range(k) for j in range(i)) if k <= 200 else 0)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # FEATURES x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits; each row sums to 1

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the bits' margins: best language, its probability and that of the second."""
        loss = np.zeros((len(f), len(self.languages)))
        for i in range(len(self.languages)):
            loss[:, i] = (np.logaddexp(0, -f * self.code[i]) * self.trust[i]).sum(axis=1)
        p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, p.max(axis=1)


def sparse(f: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of what isn't zero."""
    at = np.flatnonzero(f)
    return at.astype(np.uint16).tobytes(), f[at].tobytes()


class Sample:
    """Rows of sparse features, made dense in blocks; a single block is kept."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        self.rows = rows
        self.kept: np.ndarray | None = None

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(self.rows), BLOCK_ROWS):
            x = self.kept
            if x is None:
                part = self.rows[a : a + BLOCK_ROWS]
                x = np.zeros((len(part), FEATURES), np.float32)
                for r, (at, values) in zip(x, part, strict=True):
                    r[np.frombuffer(at, np.uint16)] = np.frombuffer(values, np.float32)
                if len(self.rows) <= BLOCK_ROWS:
                    self.kept = x
            yield a, x


def fit(x: Sample, y: list[str], steps: int = 150, decay: float = 1e-5) -> Model:
    """Logistic classifiers of all bits at once, by accelerated gradient steps over the sample."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    at = {v: i for i, v in enumerate(languages)}
    rows = np.array([at[v] for v in y], dtype=np.int64)
    z = code[rows].astype(np.float32)
    squares = np.array([(np.frombuffer(v, np.float32) ** 2).sum() for _, v in x.rows])
    scale = np.float32(1 / np.sqrt(squares.mean() + 1e-12))
    balance = (1 / np.bincount(rows, minlength=len(languages)))[rows].astype(np.float32) / len(languages)
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate = w.copy(), b.copy(), np.float32(4.0)
    for t in range(steps):
        gw, gb = decay * vw, np.zeros_like(vb)
        for a, part in x.blocks():
            at = slice(a, a + len(part))
            g = (1 / (1 + np.exp(-(part @ (vw * scale) + vb))) - (z[at] > 0)) * balance[at, None]
            gw += part.T @ (g * scale)
            gb += g.sum(axis=0)
        w2, b2 = vw - rate * gw, vb - rate * gb
        m = np.float32(t / (t + 3))
        vw, vb, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    right = np.concatenate([np.sign(part @ (w * scale) + b) for _, part in x.blocks()]) == z
    trust = np.array([right[rows == i].mean(axis=0) for i in range(len(languages))]) + 1e-3
    return Model(languages, code, (w * scale).astype(np.float32), b, trust / trust.sum(axis=1, keepdims=True))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400) -> Model | None:
    """A model of the labelled rows of ``docs`` (null labels and texts don't count); None without any.

    The sample has at most ``per_language`` rows of each language, and nearly as many where there are so many: those of the least
    hash of id and text, of rows equal in both one.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text), F.lit(4)).alias("h"))
    # One row for each language.
    shares = F.broadcast(rows.groupBy("l").agg((F.lit(1.5 * per_language) / F.approx_count_distinct("h")).alias("share")))
    # What a language gives too much of is left out where it is read, the rest in the order of the hash.
    few = rows.join(shares, "l").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("share")).dropDuplicates(["l", "h"])
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    drawn = few.withColumn("place", place).where(F.col("place") <= per_language).select("l", "t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in byte_chunks(batch.column(1)):
                out += [sparse(frequencies(data[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], pa.binary()) for i in (0, 1))], ["l", "at", "x"])

    sample = [(r.l, bytes(r.at), bytes(r.x)) for r in drawn.mapInArrow(features, "l string, at binary, x binary").collect()]
    sample.sort()
    if not sample:
        return None
    return fit(Sample([r[1:] for r in sample]), [r[0] for r in sample])


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate(([0], np.cumsum((_FOLD[data] != 32) & (data < 128))))
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for k in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode()))
    return out


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits' classifier outputs for each text of a buffer, over all its n-grams."""
    total, n = np.zeros((len(offsets) - 1, model.weights.shape[1])), np.zeros(len(offsets) - 1)
    for h, begin in grams(data, offsets):
        full = np.flatnonzero(begin[1:] > begin[:-1])
        if len(full):
            total[full] += np.add.reduceat(model.weights[h], begin[full], axis=0)
            n += np.diff(begin)
    return total / np.maximum(1, n)[:, None] + model.bias


def language(text: Column, model: Model | None, margin: float = 0.1) -> Column:
    """Struct of lang_pred, score, ambiguous, second_score.

    ``und`` with score 0 and not ambiguous: null, empty and letterless texts, or no model.
    Very long texts are read chunk by chunk; repeated texts have equal results.
    ``ambiguous``: the second language's probability is within ``margin`` of the first's.
    """

    @F.arrow_udf("lang_pred string, score double, second_score double, ambiguous boolean")
    def predict(texts: pa.Array) -> pa.Array:
        use("language")
        n = len(texts)
        names, score, second = np.full(n, UND, dtype=object), np.zeros(n), np.zeros(n)
        for at, k, data, offsets in byte_chunks(texts, CHUNK_BYTES):
            if model is None or not len(data):
                continue
            ok = _has_letter(data, offsets)
            parts = [margins(model, data, offsets)] if len(data) <= 4 * CHUNK_BYTES else [_long(model, data)]
            best, p, q = model.decode(np.concatenate(parts))
            names[at : at + k] = np.where(ok, np.array(model.languages, dtype=object)[best], UND)
            score[at : at + k], second[at : at + k] = np.where(ok, p, 0), np.where(ok, q, 0)
        und = names == UND
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(second), pa.array(~und & (score - second < margin))], ["lang_pred", "score", "second_score", "ambiguous"])

    return predict(text)


def _long(model: Model, data: np.ndarray) -> np.ndarray:
    """Margins of one very long text, chunk by chunk."""
    return (frequencies(data) @ model.weights)[None] + model.bias


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from those of the three other folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language(F.col("text"), model).alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score", "l.second_score", "l.ambiguous")


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with a language: those of no letter, and the ambiguous of low score, go.

    All columns are kept, whatever their names; null and empty texts go; repeated rows share a
    fate; an empty table, or one without labels, gives no rows.
    """
    (name,) = free_names(docs, "__l")
    found = docs.withColumn(name, language(F.col("text"), train(docs, **settings)))
    kept = (F.col(f"{name}.lang_pred") != UND) & ~(F.col(f"{name}.ambiguous") & (F.col(f"{name}.score") < 0.4))
    return found.where(kept).drop(name)
