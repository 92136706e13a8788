"""What-if scenarios against a queue, and documents' bytes and facts on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import facts as X
from causeway.operators import scenario as C
from causeway.sources import dims

DECAY = {"year": 0.9, "quarter": 0.85, "month": 0.78, "day": 0.7}
LINK = "seq long, head string, tail string, strength double, polarity double, granularity string"


def severity(impacts):
    v = [abs(x) for x in impacts.values()]
    if max(v) >= 0.6 or sum(v) >= 1.5 or sum(x >= 0.1 for x in v) >= 6:
        return 2
    return int(max(v) >= 0.3 or sum(x >= 0.1 for x in v) >= 4 or abs(impacts.get("geopolitical_risk", 0)) >= 0.25)


def by_queue(seed, delta, links, horizon, f=0.0):
    """Impact, level and largest impact of each node, and the last regime: one arrival after another."""
    queue, impacts, depths, peaks, seen, worst = [(seed, delta, 0)], {}, {}, {}, {seed: 0}, 0
    if seed == "fed_dot_plot":
        size = (1 - math.exp(-2.4 * abs(delta))) * (1 if delta >= 0 else -1)
        queue += [("tech_valuation", -0.45 * size, 1), ("debt_service_ratio", 0.3 * size, 1)]
    largest = 0.0
    while queue:
        node, d, depth = queue.pop(0)
        impacts[node] = impacts.get(node, 0) + d
        depths[node] = min(depth, depths.get(node, depth))
        peaks[node] = max(abs(impacts[node]), peaks.get(node, 0))
        largest = max(largest, abs(impacts[node]))
        worst = max(worst, severity(impacts), 2 if largest >= 0.6 else int(largest >= 0.3))
        for _, head, tail, strength, polarity, grain in links:
            if head != node or depth >= horizon:
                continue
            s = min(0.98, max(0.05, strength * (1.5 if worst else 1) * (1 + 0.35 * min(f, 5) / 5)))
            v = DECAY[grain] * (1, 1.15, 1.35)[worst] * (1 + min(0.4, 0.4 * abs(d))) * (1 + 0.15 * min(f, 5) / 5)
            p = d * s * min(1, max(0.05, v)) * polarity
            if abs(p) >= 1e-9 and seen.get(tail, depth + 1) >= depth + 1:
                seen[tail] = depth + 1
                queue.append((tail, p, depth + 1))
    return impacts, depths, peaks, worst


@pytest.mark.parametrize("f", [0.0, 1.5])
def test_scenarios_like_a_queue(spark, f):
    r = random.Random(7)
    nodes = ["a", "b", "c", "d", "geopolitical_risk", "policy_rate", "tech_valuation", "debt_service_ratio", "fed_dot_plot"]
    links = [(k, r.choice(nodes), r.choice(nodes), r.choice([0.05, 0.2, 0.4, 0.6]), r.choice([1.0, -1.0, 0.5]), r.choice(list(DECAY))) for k in range(24)]
    shocks = [(f"{n}{d}", n, d) for n in nodes for d in (0.02, 0.15, -0.25, 0.4, 2.0)]
    state = C.arrivals(spark.createDataFrame(shocks, "scenario string, node string, delta double"), spark.createDataFrame(links, LINK), connectivity=f).cache()
    rows, regimes = C.impacts(state), {x.scenario: x.regime for x in C.regimes(state).collect()}
    found, acts = {}, set()
    for x in rows.collect():
        found.setdefault(x.scenario, {})[x.node] = x
    want_acts, seen = set(), set()
    for name, node, delta in shocks:
        impacts, depths, peaks, worst = by_queue(node, delta, links, 3, f)
        assert {k: (x.impact, x.depth, x.peak) for k, x in found[name].items()} == {k: (pytest.approx(v, abs=1e-12), depths[k], pytest.approx(peaks[k], abs=1e-12)) for k, v in impacts.items()}
        assert regimes[name] == ("none", "High Volatility", "Crisis")[worst]
        seen.add(worst)
        ranked = sorted(found[name].values(), key=lambda x: x.rank)
        assert [abs(x.impact) for x in ranked] == sorted((abs(x.impact) for x in ranked), reverse=True) and [x.rank for x in ranked] == list(range(1, len(ranked) + 1))
        want_acts |= {(name, a) for n, a, _ in dims.ACTIONS if peaks.get(n, 0) > 0.05}
    acts = {(x.scenario, x.action) for x in C.actions(rows).collect()}
    assert seen == {0, 1, 2} and acts == want_acts and acts


def test_scenarios_without_links_or_shocks(spark):
    links = spark.createDataFrame([(0, "A b", "", 0.5, 1.0, "day"), (1, None, "c", 0.5, 1.0, "day")], LINK)
    shocks = spark.createDataFrame([("s", " A B ", 0.1), ("null", None, 1.0), ("void", "x", None), ("nan", "x", float("nan"))], "scenario string, node string, delta double")
    (only,) = C.impacts(C.arrivals(shocks, links)).collect()
    assert (only.scenario, only.node, only.impact, only.effect, only.via) == ("s", "a_b", 0.1, "Seed Shock", None)
    assert C.impacts(C.arrivals(shocks.limit(0), links)).count() == 0


def test_bytes_and_facts(spark):
    rows = [(bytearray(b"x"), "eQ==", "z"), (None, "eQ==", "z"), (None, "", "z"), (None, None, ""), (None, None, None)]
    df = spark.createDataFrame(rows, "f binary, b string, c string")
    raw = [r.x for r in df.select(X.document_bytes(F.col("f"), F.col("b"), F.col("c")).alias("x")).collect()]
    assert [x and bytes(x) for x in raw] == [b"x", b"y", b"z", None, None]
    assert [r.x for r in df.select(X.offline_text(F.col("c")).alias("x")).collect()][2:] == ["[Offline Distill]\nz", "[Offline Distill]\n", "[Offline Distill]\n"]
    df = spark.createDataFrame([(" up ", "text"), ("5", "other"), ("f", "fact")], "r string, k string")
    got = [tuple(x) for x in df.select(*X.coerced(F.col("r"), F.col("k")).values()).collect()]
    assert got == [("up", " up ", "coerced_from_str"), (None, "5", "coerced_from_unknown"), (None, "f", "")]
