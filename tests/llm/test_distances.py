"""Hard-negative mining against plain loops, and its searches against whole scans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import distances
from causeway.llm.vectors import exact_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row long, query string"


def brute(rows):
    fine = []
    for i, x, label, *_ in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            fine.append((i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a, (i, label, v) in enumerate(fine):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), j is None, j or 0, m) for b, (j, m, w) in enumerate(fine) if a != b)
        for p, null, j, _ in [s for s in scored if s[3] == label][:5]:
            found = [s for s in scored if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, None if null else j, r + 1, None if s[1] else s[2], -p, -s[0]) for r, s in enumerate(found)]
    return sorted(out, key=repr)


def made(seed, n, centres, spread):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.5) for _ in range(5)] for _ in range(centres)]
    rows = []
    for k in range(n):
        v = [c + rng.gauss(0, spread) for c in rng.choice(middle)]
        if k % 3 == 0:
            v = middle[0]  # a third of all rows
        if k % 29 == 0:
            v = rng.choice([None, [], [None] * 5, [float("nan")] * 5, v[:2] + [float("-inf")], v[:3], v + [0.25]])
        rows.append((None if k % 31 == 5 else k * 20, v, None if k % 37 == 1 else rng.choice([0, 0, 0, 1, 2, -3]), k, "x"))
    return rows + rows[10:11] * (n // 100)


@pytest.mark.parametrize("n, centres, spread, block", [(400, 12, 0.02, 16), (300, 1, 0.5, 4096), (4, 2, 0.1, 16)])
def test_query_is_the_brute_force(spark, tmp_path, monkeypatch, n, centres, spread, block):
    monkeypatch.setattr(distances, "BLOCK", block)
    monkeypatch.setattr(distances, "TILE", 8)
    rows = made(n, n, centres, spread)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = distances.op11_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_search_leaves_out_far_blocks(spark, monkeypatch):
    """On clustered rows a query's certified search reads a part of the blocks only."""
    monkeypatch.setattr(distances, "BLOCK", 32)
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 4, (16, 8))
    rows = [(k, (middle[k % 16] + rng.normal(0, 0.05, 8)).tolist(), 1, k, "x") for k in range(1600)]
    vectors = exact_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 256, F.col("label"))
    space = distances.fitted(vectors, 8)
    blocks = distances.index(vectors, space, 8)
    q = distances.matrix(vectors.where("id % 100 = 0").select("v").toArrow()["v"].combine_chunks(), 8)
    v = distances.matrix(vectors.select("v").toArrow()["v"].combine_chunks(), 8)
    kth = np.sort(q @ v.T, axis=1)[:, -6]
    d, r, slack = space.of_query(q), space.radius(q, kth.astype(float)), 1e-6
    read = np.mean([distances._wanted(d[:, b.pivot], r, b.lo, b.hi, slack).mean() for b in blocks.select("pivot", "lo", "hi").collect()])
    assert blocks.count() >= 50 and read < 0.5
    # Every row is stored under its nearest pivot with its distance as key.
    assert sum(len(b.parts[0]) // 8 for b in blocks.select("parts").collect()) == 1600


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert distances.op11_hard_negatives(spark, str(tmp_path)).collect() == []
