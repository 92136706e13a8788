"""Operator 3, quality by compression.

Two zstandard dictionaries are built, of good and of bad labelled text.  Every chunk of a
text is compressed with both; the difference of the sizes, over the text's bytes and over
its compressed size, says which dictionary knows it better, and a logistic curve, fitted on
labelled rows that went into neither dictionary, turns that into a probability.  How far
the text compresses at all is the curve's third input: a text of endless repetition hardly
differs between the dictionaries.

Fitting uses a bounded sample of labelled rows: at most ``per_class`` of each label, in the order of
a hash of the id and then of id and text (the smallest label counts where an id has several; rows
equal in id and text count once), and of each text at most MOST_CHUNKS chunks, spaced evenly, for
the dictionaries.  Scoring reads whole texts.

Texts are cut and compressed where they lie; the driver gets the chunks that the dictionaries are
made of, and three numbers of each of the other texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import free_names, table, written
from causeway.llm.tokens import byte_chunks

CHUNK, LEVEL = 2048, 3
DICTIONARY_BYTES = 112 << 10
THRESHOLD = 0.3
#: Chunks of one text that go into a dictionary's sample.
MOST_CHUNKS = 32


def chunks(data: bytes) -> list[bytes]:
    return [data[a : a + CHUNK] for a in range(0, len(data), CHUNK)]


def sampled_chunks(data: bytes) -> list[bytes]:
    """All chunks of a text that are long enough, or MOST_CHUNKS of them from its begin to its end."""
    out = [c for c in chunks(data) if len(c) >= 8]
    return out if len(out) <= MOST_CHUNKS else [out[k * (len(out) - 1) // (MOST_CHUNKS - 1)] for k in range(MOST_CHUNKS)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained zstandard dictionary; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slopes: tuple[float, ...] = (20.0, 0.0, 0.0)
    bias: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out


def measures(compressors: list[zstandard.ZstdCompressor], data: bytes) -> list[float]:
    """Size difference (bad - good) by bytes and by compressed size, and the log of the compressed share.

    An empty text has the measures 0, 0, 0.
    """
    if not data:
        return [0.0, 0.0, 0.0]
    good, bad = (sum(len(c.compress(x)) for x in chunks(data)) for c in compressors)
    return [(bad - good) / len(data), 2 * (bad - good) / (bad + good), float(np.log((bad + good) / (2 * len(data))))]


def _measures(text: Column, model: Model) -> Column:
    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        c, out = model.compressors(), []
        for _, _, data, offsets in byte_chunks(texts):
            whole = data.tobytes()
            out += [measures(c, whole[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        return pa.array(out, pa.list_(pa.float64()))

    return measure(text)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[list[float], float]:
    """Slopes and bias of a logistic curve by Newton steps with a weak prior."""
    scale = np.maximum(1e-6, np.abs(x).mean(axis=0))
    a, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    prior = np.array([1e-1] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(prior)
        w -= np.linalg.solve(h, a.T @ (p - y) + prior * w)
    return (w[:-1] / scale).tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", per_class: int = 1200) -> Model | None:
    """A model of the labelled rows; None where either label has no text at all."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    order = (F.xxhash64("k", F.lit(3)), F.col("k"))
    sample = marks.where("y = 0").orderBy(*order).limit(per_class).unionByName(marks.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    # At most 2 * per_class rows of a few numbers, here and below: an id may have any number of rows.
    hashed = texts.join(F.broadcast(sample), "k").withColumn("h", F.xxhash64("k", "t", F.lit(33)))
    chosen = [hashed.where(F.col("y") == y).select("k", "y", "h").distinct().orderBy("h", "k").limit(per_class) for y in (0, 1)]
    rows = written(hashed.join(F.broadcast(chosen[0].unionByName(chosen[1])), ["k", "y", "h"]).dropDuplicates(["k", "h"]), "labelled")
    head = F.pmod(F.xxhash64("k", F.lit(33)), F.lit(5)) < 3

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, y, h, t in zip(*(batch.column(i) for i in range(4)), strict=True):
                parts = sampled_chunks(t.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * len(parts), x.type) for x in (k, y, h)] + [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["k", "y", "h", "n", "c"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("k", "y")}
    given = rows.where(head).select("k", "y", "h", "t").mapInArrow(cut, f"k {kinds['k']}, y {kinds['y']}, h long, n int, c binary").collect()
    given.sort(key=lambda r: (r.k, r.h, r.n))
    model = Model(*(build_dictionary([bytes(r.c) for r in given if r.y == y]) for y in (1, 0)))
    if not model.good or not model.bad:
        return None
    held = rows.where(~head).select("y", _measures(F.col("t"), model).alias("x")).collect()
    held.sort(key=lambda r: (r.x, r.y))
    if {r.y for r in held} != {0, 1}:
        return model
    # The classes were sampled alike; the curve is moved back to their shares among the labels.
    share = marks.agg(F.avg("y")).first()[0]
    taken = np.mean([r.y for r in held])
    slopes, bias = calibrate(np.array([r.x for r in held]), np.array([r.y for r in held], dtype=float))
    return Model(model.good, model.bad, tuple(slopes), bias + float(np.log(share / (1 - share)) - np.log(taken / (1 - taken))))


def quality(text: Column, model: Model | None) -> Column:
    """Score from 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the score of no evidence, the curve at 0; very long texts are
    compressed chunk by chunk; repeated texts have equal scores; without a model every score
    is 0.5.
    """
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        c, out = model.compressors(), []
        for _, _, data, offsets in byte_chunks(texts):
            whole = data.tobytes()
            out += [measures(c, whole[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        z = np.array(out).reshape(-1, len(model.slopes)) @ np.array(model.slopes) + model.bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score(text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of ``documents``, learned from the labels of four folds of five."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold != 0))
    scored = docs.select("doc_id", (fold == 0).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns, whatever their names.

    Null and empty texts have the score of no evidence; repeated rows share a fate; an empty
    table, or labels of one kind only, drop nothing.
    """
    (name,) = free_names(docs, "__q")
    model = train(docs, labels, **settings)
    return docs.withColumn(name, quality(F.col("text"), model)).where(F.col(name) >= THRESHOLD).drop(name)
