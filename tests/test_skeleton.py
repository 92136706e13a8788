"""The causal skeleton: states, links, tags, sources and the acyclic choice, against loops over edges."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from causeway.operators import acyclic as Y
from causeway.operators import consensus as K
from causeway.operators import graph as G

SCHEMA = "seq long, case_id string, head_node string, relation string, tail_node string, confidence string, granularity string, event_time timestamp_ntz, reflection_quality double, temporal_quality double"
NOW = lambda: F.lit("2000-06-15 00:00:00").cast("timestamp_ntz")


def _edges(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        head = rng.choice(["Inflation", " inflation", "Oil Price", "oil price", "Nothing Much", "", None])
        out.append((k, f"case_{k % 3}", head, rng.choice(["drives", "reduces", "rare", " "]), rng.choice(["Policy Rate", "Bond Yield", "Inflation"]), rng.choice(["high", "low", None]), rng.choice(["", None, "year"]),
                    datetime(2000, 1, 1) - timedelta(days=rng.choice([0, 800])), rng.choice([0.1, 0.5, 1.0, 2.0]), rng.random()))
    out += [(n + k, "case_9", f"Lonely {k}", "drives", "Bond Yield", "medium", "day", datetime(1990, 1, 1), 0.3, 0.4) for k in range(3)]
    return out


def _brute(spark, rows):
    """The running rule edge by edge, on strengths scored one by one."""
    df = spark.createDataFrame(rows, SCHEMA)
    scored = {r.seq: r for r in G.score_edges(df.where("trim(coalesce(head_node, '')) != ''")).collect()}
    node = lambda x: x.strip().lower().replace(" ", "_")
    pairs = {}
    for r in scored.values():
        pairs.setdefault((node(r.head_node), node(r.tail_node)), []).append(r.event_time)
    weight = {p: (1.15 if any(t > datetime(2000, 6, 15) - timedelta(days=365) for t in ts) else 1.0) + min(0.05 * len(ts), 0.2) for p, ts in pairs.items()}
    out = {}
    for seq in sorted(scored):
        r = scored[seq]
        key = (node(r.head_node), r.relation, node(r.tail_node))
        w = weight[key[0], key[2]]
        s = max(0.05, min(r.strength * w, 0.98))
        tags = [t for t in r.reasoning.split(",") if t] + (["dynamic_learning_boost"] if w > 1.05 else [])
        if key not in out:
            out[key] = {"s": s, "p": r.polarity, "n": 1, "g": r.granularity or "day", "tags": tags, "first": seq}
        else:
            o = out[key]
            o["n"] += 1
            o["s"] = min(0.98, max(o["s"], s) * 1.05)
            o["p"] = (o["p"] * (o["n"] - 1) + r.polarity) / o["n"]
            o["tags"] = sorted(set(o["tags"]) | set(tags) | {"source_consensus"})
    return out


def _links(df):
    return {(r["head"], r.relation, r["tail"]): r for r in df.collect()}


@pytest.mark.parametrize("n, seed", [(60, 1), (700, 2)])
def test_links_are_the_running_rule(spark, n, seed):
    rows = _edges(n, seed)
    df, expected = spark.createDataFrame(rows, SCHEMA).repartition(3), _brute(spark, rows)
    got = _links(K.skeleton(df, NOW()))
    assert set(got) == set(expected) and len({o["n"] for o in expected.values()}) > 2
    for k, o in expected.items():
        g = got[k]
        assert (g.strength, g.polarity, g.support_count, g.granularity, g.tags, g.first_seq) == (pytest.approx(o["s"]), pytest.approx(o["p"]), o["n"], o["g"], o["tags"], o["first"]), k
    # In batches, in any order.
    parts = [K.states(df.where(F.col("seq") % 3 == k)) for k in (2, 0, 1)]
    state = parts[0]
    for p in parts[1:]:
        state = K.merged(state.unionByName(p))
    assert {k: (pytest.approx(r.strength), r.support_count, r.tags) for k, r in _links(K.links(state, NOW())).items()} == {k: (r.strength, r.support_count, r.tags) for k, r in got.items()}


def test_sources_are_first_wins(spark):
    rows = _edges(200, 3)
    got = K.sources(spark.createDataFrame(rows, SCHEMA), ["case_id", "event_time", "confidence"])
    seen = {}
    for r in sorted(rows):
        if r[2] and r[2].strip() and r[3].strip():
            key = (r[2].strip().lower().replace(" ", "_"), r[3], r[4].strip().lower().replace(" ", "_"))
            seen.setdefault(key, {}).setdefault((r[1], str(r[7]), r[5] or ""), r[0])
    expected = sorted((*k, *sig, seq, place + 1) for k, sigs in seen.items() for place, (sig, seq) in enumerate(sorted(sigs.items(), key=lambda x: x[1])))
    assert sorted((r["head"], r.relation, r["tail"], r.case_id, r.event_time, r.confidence, r.seq, r.place) for r in got.collect()) == expected


def _greedy(rows):
    kept, after = [], {}

    def reaches(a, b):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return False

    for h, r, t, s, o in sorted(rows, key=lambda x: (-x[3], x[4])):
        if h and t and h != t and not reaches(t, h):
            after.setdefault(h, set()).add(t)
            kept.append((h, r, t, s, o))
    return kept


def test_order_is_the_greedy_choice():
    for seed in range(1000):
        rng = random.Random(seed)
        n = rng.choice([3, 6, 12])
        rows = [(str(rng.randrange(n)), rng.choice("xy"), str(rng.randrange(n)), rng.choice([0.2, 0.5, rng.random()]), k) for k in range(rng.choice([5, 20, 60]))]
        order = Y.Order()
        best, kept = {}, []
        for h, _, t, _, _ in sorted(rows, key=lambda x: (-x[3], x[4])):
            best.setdefault((h, t), len(best))
        chosen = {p for p in best if order.add(*p)}
        kept = [x for x in sorted(rows, key=lambda x: (-x[3], x[4])) if (x[0], x[2]) in chosen]
        assert kept == _greedy(rows), seed


@pytest.mark.parametrize("seed, n, m", [(1, 12, 40), (2, 30, 45)])
def test_acyclic_over_components(spark, seed, n, m):
    rng = random.Random(seed)
    # A long path, a ring and chance links: several components, and nodes on none.
    rows = [(f"n{rng.randrange(n)}", rng.choice("xy"), f"n{rng.randrange(n)}", rng.choice([0.3, rng.random()])) for _ in range(m)]
    rows += [(f"r{k}", "x", f"r{(k + 1) % 4}", 0.5) for k in range(4)] + [(f"p{k}", "x", f"p{k + 1}", 0.4) for k in range(5)] + [("r0", "x", "n0", 0.9), ("", "x", "n1", 0.9)]
    rows = [(*r, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "head string, relation string, tail string, strength double, first_seq long")
    got = sorted(tuple(r) for r in Y.acyclic(df).select("head", "relation", "tail", "strength", "first_seq").collect())
    assert got == sorted(_greedy(rows))
    assert [r.first_seq for r in Y.forecast(df, 4).collect()] == [x[4] for x in _greedy(rows)[:4]]
    components = {}
    for r in Y.strong_components(df).collect():
        components.setdefault(r.component, set()).add(r.node)
    edges = {}
    for h, _, t, _, _ in rows:
        edges.setdefault(h, set()).add(t)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for y in edges.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    to = {x: reach(x) for x in {h for h, *_ in rows} | {r[2] for r in rows}}
    expected = {frozenset(y for y in to if y == x or (y in to[x] and x in to[y])) for x in to}
    assert {frozenset(c) for c in components.values()} == {c for c in expected if len(c) > 1}
