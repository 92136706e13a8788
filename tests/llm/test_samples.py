"""Samples that models are fitted on: bounded by rows, whatever the ids; and how well the fitted models do."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.llm import language, quality, queries
from causeway.llm.common import table

MIDDLE = "/root/testdata/sf0.01"


def auc(good, bad):
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_rows(spark):
    labels = table(spark, MIDDLE, "labels").where("quality is not null").select("doc_id", "quality")
    rows = queries.QUERIES["op3_quality"](spark, MIDDLE).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) + len(bad) > 50 and auc(good, bad) > 0.85
    assert sum((r.predicted == 1) == (r.quality == 1) for r in rows) / len(rows) > 0.9


def test_language_on_held_out_rows(spark):
    docs = table(spark, MIDDLE, "documents").where("lang is not null").select("doc_id", "lang")
    rows = queries.QUERIES["op4_language_id"](spark, MIDDLE).where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def _words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))


def test_quality_of_one_id_of_many_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(7, "good", _words(rng, "abcde", 30)) for _ in range(2500)] + [(7, "good", "the same row again and again")] * 2500
    rows += [(k, "bad", _words(rng, "vwxyz", 30)) for k in range(100, 160)] + [(k, "good", _words(rng, "abcde", 30)) for k in range(200, 260)] + [(900, "good", _words(rng, "abcde", 60_000))]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    labels = docs.select("doc_id").distinct().withColumn("quality", F.when(F.col("doc_id").between(100, 159), 0).otherwise(1))
    sent, real = [], quality.build_dictionary
    monkeypatch.setattr(quality, "build_dictionary", lambda samples: sent.append(samples) or real(samples))
    model = quality.train(docs, labels, per_class=40)
    assert len(sent) == 2 and max(map(len, sent)) <= 40 + quality.MOST_CHUNKS and all(len(c) <= quality.CHUNK for s in sent for c in s)
    got = {r.y: r.s for r in docs.join(labels, "doc_id").groupBy(F.col("quality").alias("y")).agg(F.avg(quality.quality(F.col("text"), model)).alias("s")).collect()}
    assert got[1] > got[0]


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 5, lambda k: k])
def test_every_language_is_drawn_whatever_its_ids(spark, monkeypatch, ids):
    rng = random.Random(3)
    rows = [(ids(k), "de", _words(rng, "abcde", 8)) for k in range(3000)] + [(ids(0), "de", "immer das gleiche")] * 3000 + [(k, "en", _words(rng, "vwxyz", 8)) for k in range(300)] + [(1, "xx", "qqq rrr sss")]
    sizes, real = {}, language.fit
    monkeypatch.setattr(language, "fit", lambda x, y, **k: sizes.update({v: y.count(v) for v in set(y)}) or real(x, y, **k))
    model = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), per_language=100)
    assert model.languages == ["de", "en", "xx"] and sizes == {"de": 100, "en": 100, "xx": 1}
