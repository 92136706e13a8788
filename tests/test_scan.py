"""Segmented scans against loops; one key holds most rows, which lie in several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import audit, events, scan, scenario


def _made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", None, "b"]), k, rng.choice([None, 1.0, -2.5, 0.25, float(k % 7)])) for k in range(n)]


@pytest.fixture()
def tasks(spark):
    """Many small tasks, which would be put together otherwise."""
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_running_values(spark, tasks):
    rows = _made(300, 1)
    seg = scan.segments(spark.createDataFrame(rows, "k string, o long, v double").repartition(7), ["k"], [F.col("o")])
    assert seg.where("k = 'hot'").select(scan.PART).distinct().count() > 1  # the hot key is spread
    v = F.col("v")
    got = {r.o: r for r in scan.running(seg, ["k"], total=("sum", v), top=("max", v), n=("count", v), was=("last", v), prev=("lag", v), less=("before", v)).collect()}
    state = {}
    for k, o, x in sorted(rows, key=lambda r: r[1]):
        total, top, n, was, prev, less = state.get(k, (None, None, 0, None, None, None))
        less = total
        if x is not None:
            total, top, n, was = (total or 0) + x, x if top is None else max(top, x), n + 1, x
        assert (got[o].total, got[o].top, got[o].n, got[o].was, got[o].prev, got[o].less) == (pytest.approx(total), top, n, was, prev, pytest.approx(less)), o
        state[k] = total, top, n, was, x, less
    assert len(got) == 300


def test_numbers_and_averages(spark, tasks):
    rows = _made(200, 2)
    df = spark.createDataFrame(rows, "k string, o long, v double").repartition(5)
    assert {r.o: r.number for r in scan.numbered(df, [F.col("o").desc()]).collect()} == {o: 199 - o for _, o, _ in rows}
    expected = {}
    for k, _, x in rows:
        if x is not None:
            expected[k] = 0.8 * expected.get(k, 0.0) + 0.2 * x
    assert {r.k: r.ewma for r in events.ewma(df, "k", "o", "v").collect()} == {k: pytest.approx(e) for k, e in expected.items()}


def test_chains_across_tasks(spark, tasks):
    import hashlib

    rows, heads = [], {}
    for k in range(240):
        key = "hot" if k % 4 else f"k{k % 12}"
        before = heads.get(key, events.GENESIS)
        own = hashlib.sha256(f"p{k}|{k}|{before}".encode()).hexdigest()
        if key == "k4" and k == 100:
            before = "forged"  # the row's own hash stays that of the true one
        rows.append((key, k, f"p{k}", str(k), before, own))
        heads[key] = own
    df = spark.createDataFrame(rows, "u string, i long, p string, c string, prev_hash string, event_hash string").repartition(6)
    got = {r.u: (r.intact, r.n_events) for r in audit.verify_chain(df, "u", "i", "p", "c").collect()}
    assert got == {"hot": (True, 180), "k0": (True, 20), "k4": (False, 20), "k8": (True, 20)}


def test_running_regime_across_tasks(spark, tasks):
    rng = random.Random(5)
    rows = [("s" if k % 10 else "t", k, rng.choice(["geopolitical_risk", "oil", "rates"]), rng.choice([None, 0.01, -0.02, 0.05])) for k in range(200)]
    df = spark.createDataFrame(rows, "s string, pos long, node string, delta double")
    got = {r.pos: r for r in scenario.running_regime(df, "s", "pos", "node", "delta").collect()}
    states = {}
    for s, pos, node, x in rows:
        st = states.setdefault(s, {"running": {}, "largest": 0.0, "severity": 0})
        run = st["running"]
        run[node] = run.get(node, 0.0) + (x or 0.0)
        total, hits = sum(map(abs, run.values())), sum(abs(y) >= 0.1 for y in run.values())
        st["largest"] = max(st["largest"], abs(run[node]))
        risk = abs(run.get("geopolitical_risk", 0.0))
        level = 2 if st["largest"] >= 0.6 or total >= 1.5 or hits >= 6 else 1 if st["largest"] >= 0.3 or hits >= 4 or risk >= 0.25 else 0
        st["severity"] = max(st["severity"], level)
        r = got[pos]
        assert (r.running, r.largest, r.total, r.hits, r.severity) == (pytest.approx(run[node]), pytest.approx(st["largest"]), pytest.approx(total), hits, st["severity"])
