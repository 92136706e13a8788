"""The bit-sliced search against plain integer sums."""

import math
import random

import numpy as np
import pytest

from causeway.llm import bitslices
from causeway.llm.bitslices import added, plan, selected, sliced

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score string"


@pytest.mark.parametrize("low, high, n, d", [(-31, 30, 200, 16), (0, 0, 70, 3), (-(1 << 40), 1 << 40, 65, 2), (5, 9, 1, 7)])
def test_sums_of_slices(low, high, n, d):
    rng = np.random.default_rng(n)
    values, weights = rng.integers(low, high + 1, (n, d)), rng.integers(-90, 91, (9, d))
    least, widths, slices = sliced(values)
    powers, constant = plan(weights, least, widths)
    sums = added(powers, np.concatenate([slices, ~slices, np.zeros((1, slices.shape[1]), "<u8")]))
    got = [[c + sum(int(s[q, r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << p for p, s in enumerate(sums)) for r in range(n)] for q, c in enumerate(constant)]
    assert got == [[sum(int(a) * int(b) for a, b in zip(w, v, strict=True)) for v in values] for w in weights]


def test_selection_resolves_the_boundary_by_place():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, (8, 130))
    pack = lambda bits: np.packbits(np.pad(bits.astype(np.uint8), ((0, 0), (0, 62))), axis=1, bitorder="little").view("<u8")
    slices = [pack(scores >> b & 1) for b in range(3)]
    rows = pack(rng.random((8, 130)) < 0.8)
    may = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
    for k in (1, 7, 20, 200):
        got = np.unpackbits(selected(slices, rows, k).view(np.uint8), axis=1, bitorder="little")
        for q in range(8):
            expected = sorted(np.flatnonzero(may[q]), key=lambda r: (-scores[q, r], r))[:k]
            assert np.flatnonzero(got[q]).tolist() == sorted(expected)


def brute(rows, k=20):
    fine = [(i, x) for i, x, *_ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    v = [[math.floor(64 * float(np.float32(c))) for c in x] for _, x in fine]
    out = []
    for a, (i, _) in enumerate(fine):
        if i is None or i % 20:
            continue
        found = sorted((-sum(p * q for p, q in zip(v[a], v[b], strict=False)), j is None, j or 0) for b, (j, _) in enumerate(fine) if a != b)
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def made(seed, n, repeated):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.gauss(0, 0.3) for _ in range(6)]
        if k % 3 == 0:
            v = [0.5, -0.25, 0.125, 0.0, 1.0, -1.0]  # a third of all rows
        if k % 17 == 0:
            v = rng.choice([None, [], [None] * 6, [float("nan")] * 6, v[:5] + [float("inf")], v[:3], v + [0.25]])
        rows.append((None if k % 23 == 0 else k, v, k % 4, k, "x"))
    return rows + rows[20:21] * repeated


@pytest.mark.parametrize("block, n", [(16, 300), (8192, 300), (8192, 5)])
def test_search_is_the_brute_force(spark, tmp_path, monkeypatch, block, n):
    monkeypatch.setattr(bitslices, "BLOCK", block)
    monkeypatch.setattr(bitslices, "TILE", 4)
    rows = made(n, n, 2 if n > 20 else 0)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = bitslices.op12_exact_search(spark, str(tmp_path)).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=repr) == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert bitslices.op12_exact_search(spark, str(tmp_path)).collect() == []
