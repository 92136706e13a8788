"""Dates, paths, graphs, proofs and streams on small cases with known results."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import audit as A
from causeway.operators import consensus as K
from causeway.operators import edges as D
from causeway.operators import events as E
from causeway.operators import facts as X
from causeway.operators import graph as G
from causeway.sources import dims
from causeway.streaming import state


def day(*x):
    return dt.datetime(*x)


def test_dates_and_periods(spark):
    dates = {"2024-06": day(2024, 6, 1), "20240615": day(2024, 6, 15), "2024-W10": day(2024, 3, 4), "2024-1-5": day(2024, 1, 5), "2024/06": day(2024, 6, 1), "June 2024": None, "2024-13": None, "2024": None, "2024-03-05T10:30:00Z": day(2024, 3, 5, 10, 30), "": None}
    df = spark.createDataFrame([(k,) for k in dates], "t string")
    assert {r.t: r.v for r in df.select("t", S.parse_date(F.col("t")).alias("v")).collect()} == dates
    periods = {"2024": day(2024, 1, 1), "2024-Q2": day(2024, 4, 1), "2024Q4": day(2024, 10, 1), "Q2 2024": day(2202, 4, 1), "2Q24": None, "FY2024": None, "2024-06-15": day(2024, 6, 15)}
    df = spark.createDataFrame([(k,) for k in periods], "t string")
    assert {r.t: r.v for r in df.select("t", S.parse_period(F.col("t")).alias("v")).collect()} == periods


def test_temporal_edges_and_gate(spark):
    rows = [("ACME", "reported_revenue", "1000", "2024-Q2", None, None), ("ACME", "reported_revenue", "900", None, "2020-01-01", "2020-12-31"), ("", "", "", None, None, None)]
    df = spark.createDataFrame(rows, "entity string, metric string, value string, period string, valid_from string, valid_to string")
    edges = D.facts_to_edges(df, rounds=2, repair_ratio=1.0)
    found = {r.tail_node: r for r in edges.collect()}
    assert set(found) == {"1000", "900"} and found["1000"].time_granularity == "quarter" and found["1000"].event_time == day(2024, 4, 1)
    assert [found[k].temporal_quality for k in ("1000", "900")] == [pytest.approx(0.9), pytest.approx(0.65)]
    assert [found[k].reflection_quality for k in ("1000", "900")] == [pytest.approx(0.62)] * 2
    assert found["900"].time_source == "valid_from"
    seen = G.as_of(edges, F.lit("2024-06-15").cast("timestamp_ntz")).collect()
    assert [r.tail_node for r in seen] == ["1000"]


def test_precision_loses_a_fifth_without_an_anchor(spark):
    one = lambda anchored: spark.range(1).select(S.edge_weight(F.lit(""), F.lit(""), F.lit(anchored), F.lit(0.5), F.lit(0.5)).alias("w")).first().w
    assert one(True) == pytest.approx(0.55) and one(False) == pytest.approx(0.44)


def test_root_cause(spark):
    links = [("inflation", "interest_rate", 0.98, 1.0, "month", 0.16), ("interest_rate", "tech_valuation", 0.98, -1.0, "month", 0.22), ("tech_valuation", "inflation", 0.1, 1.0, "day", None)]
    df = spark.createDataFrame(links, "head string, tail string, strength double, polarity double, granularity string, noise_sigma double")
    (r,) = G.root_causes(df, "tech_valuation").collect()
    assert r.path == ["inflation", "interest_rate", "tech_valuation"]
    assert (r.influence, r.direction, r.lower, r.upper) == (pytest.approx(0.584307, abs=1e-6), pytest.approx(-0.584307, abs=1e-6), pytest.approx(0.330262, abs=1e-6), pytest.approx(0.838352, abs=1e-6))
    (alone,) = G.root_causes(df, "nowhere").collect()
    assert (alone.path, alone.influence, alone.lower, alone.upper) == (["nowhere"], 1.0, 0.0, 1.0)


def test_acyclic_and_connectivity(spark):
    rows = [("c", "a", "b", 0.9), ("c", "b", "c", 0.8), ("c", "c", "a", 0.7), ("c", "a", "a", 0.99), ("d", "x", "y", 0.5), ("d", "z", "w", 0.5)]
    df = spark.createDataFrame(rows, "case_id string, head_node string, tail_node string, strength double")
    assert {(r["head"], r["tail"]) for r in G.acyclic(df, "case_id").where("case_id = 'c'").collect()} == {("a", "b"), ("b", "c")}
    assert {r.case_id: r.fiedler for r in G.fiedler(df, "case_id").collect()} == {"c": pytest.approx(3.0), "d": 0.0}
    assert {r.case_id: (r.n_nodes, r.n_edges) for r in G.graph_counts(df, "case_id").collect()} == {"c": (3, 4), "d": (4, 2)}


def test_markets_and_global_shock(spark):
    found = {r.node: r.impact for r in G.what_if(G.market_links(spark), "market_us", 0.5, 3, severity=1, connectivity=0.829914).collect()}
    assert found["market_us"] == 0.5 and "market_cn" not in found and found["market_eu"] > found["market_jp"] > found["market_kr"] > 0


def test_common_drivers_hold_the_broad_terms():
    pairs = set(dims.common_drivers())
    assert {("oil_price", "geopolitical_stability"), ("geopolitical_stability", "oil_price"), ("oil_price", "oil_price")} <= pairs


def test_weights_add_up_spellings(spark):
    rows = [(0, "Oil Price", "B", day(2023, 6, 1)), (1, "oil price ", "b", day(2020, 1, 1))]
    df = spark.createDataFrame(rows, "seq long, head_node string, tail_node string, event_time timestamp_ntz")
    at = lambda d: G.dynamic_weights(df, F.lit(d).cast("timestamp_ntz")).collect()
    assert [(r["head"], r.n_edges, round(r.weight, 6)) for r in at("2024-05-30")] == [("oil_price", 2, 1.25)]
    assert [round(r.weight, 6) for r in at("2024-05-31")] == [1.1]


def test_consensus_like_the_running_rule(spark):
    r = np.random.default_rng(1)
    rows = [(i, "A" if i % 3 else "C", "drives", "B", str(r.choice(["high", "low", "medium"])), None, float(r.random()), float(r.random())) for i in range(100)]
    df = spark.createDataFrame(rows, "seq long, head_node string, relation string, tail_node string, confidence string, event_time timestamp_ntz, reflection_quality double, temporal_quality double")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    scored = {x.seq: x.strength for x in G.score_edges(df).collect()}
    expected = {}
    for seq, head, *_ in rows:
        s = min(0.98, max(0.05, scored[seq] * 1.2))
        old = expected.get(head.lower())
        expected[head.lower()] = s if old is None else min(0.98, max(old, s) * 1.05)
    assert {x["head"]: x.strength for x in K.skeleton(df, now).collect()} == {k: pytest.approx(v) for k, v in expected.items()}


def test_chain_verification(spark):
    rows, head = [], E.GENESIS
    for i in range(5):
        new = hashlib.sha256(f"p{i}|{i}|{head}".encode()).hexdigest()
        rows.append((1, i, f"p{i}", str(i), head, new))
        head = new
    bad = [(2, *r[1:]) for r in rows[:3]] + [(2, 3, "changed", *rows[3][3:])]
    df = spark.createDataFrame(rows + bad, "u long, i long, p string, c string, prev_hash string, event_hash string")
    assert {r.u: r.intact for r in A.verify_chain(df, "u", "i", "p", "c").collect()} == {1: True, 2: False}


def test_proofs(spark):
    good = ("groth16", {"pi_a": "1", "pi_b": "1", "pi_c": "1", "relation_hash": "h", "revenue": "1000", "expenses": "150"}, ["850"], {"relation_hash": "h"})
    rows = [(0, *good), (1, "groth16", {"pi_a": "1"}, [], {}), (2, good[0], good[1], ["851"], good[3])]
    df = spark.createDataFrame(rows, "i int, scheme string, proof map<string,string>, signals array<string>, key map<string,string>")
    found = {r.i: r for r in A.check_proofs(df).collect()}
    assert [found[i].valid for i in range(3)] == [True, False, False] and found[2].failed == "arithmetic_match"
    assert found[1].errors == "public_signals_empty;proof_missing_fields:pi_b,pi_c;net_income_missing"


def test_mix_in_a_crisis(spark):
    df = spark.createDataFrame([(1, r, 1.0, c) for r, c in (("Analyst", "a"), ("critic ", "b"), ("strategist", "c"), ("idle", ""))], "k int, role string, weight double, content string")
    (r,) = A.mix_tracks(df, "k", F.lit(True)).collect()
    assert r.rationale == "CRITIC[0.38]: b | STRATEGIST[0.38]: c | ANALYST[0.25]: a" and r.share == 0.375


def test_streams_end_where_batches_do(spark, tmp_path):
    rows = [(u, i, float((i * 7 + u) % 5) - 2, f"p{i}", str(i)) for i in range(40) for u in (1, 2)]
    schema = "u long, i long, v double, p string, c string"
    for k in range(4):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.createDataFrame(rows, schema)

    def last(f, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    batch = {r.u: r.ewma for r in E.ewma(df, "u", "i", "v").collect()}
    assert dict(last(lambda s: state.ewma(s, "u", "i", "v"), "ewmas")) == {k: pytest.approx(v) for k, v in batch.items()}
    heads = {r.u: (r.n_events, r.head_hash) for r in E.chain(df, "u", "i", "p", "c").collect()}
    assert {u: (n, h) for u, n, h in last(lambda s: state.chain(s, "u", "i", "p", "c"), "chains")} == heads
    assert dict(last(lambda s: state.latest(s, "u", "i", "v"), "latests")) == {u: v for u, i, v, *_ in rows if i == 39}
    assert {r[-1] for r in last(lambda s: state.sticky_regime(s, "u", "i", "v"), "regimes")} == {2}


def test_reflection_until_stable(spark):
    rows = [
        (1, "ACME", "revenue", "1,000", "2024", None, None),
        (2, "ACME", "revenue decrease", "12", "2024-Q2", None, None),
        (3, "ACME", "revenue", "1,000", "2024", None, None),
        (4, None, None, None, None, "Operating margin improved", None),
    ]
    df = spark.createDataFrame(rows, "seq long, entity string, metric string, value string, period string, statement string, confidence string")
    facts, rounds = X.reflect(df)
    found = {r.seq: r for r in facts.collect()}
    assert set(found) == {1, 2, 4}
    assert (found[2].value, found[2].direction, found[2].reflection_error_types) == ("-12", "down", "relation_inversion")
    assert (found[1].value, found[1].confidence, found[1].validation_status) == ("1,000", "medium", "reflected")
    assert found[4].reflection_issues == "missing_required_component" and found[4].reflection_error_types == "omission"
    got = [tuple(r) for r in rounds.orderBy("round").collect()]
    assert got == [(1, 4, 4, 0, 1, 1, 3), (2, 3, 1, 0, 1, 0, 3)]


def test_reflection_merges_what_repair_makes_equal_and_stops(spark):
    schema = "seq long, entity string, metric string, value string, period string, confidence string"
    df = spark.createDataFrame([(1, "A", "sales drop", "7.50", "2024", "high"), (2, "A", "sales drop", "-7.5", "2024", "low"), (3, "A", "sales drop", "-7", "2024", "low"), (4, "A", "sales drop", "7", "2024", "")], schema)
    facts, rounds = X.reflect(df, max_rounds=5)
    assert sorted((r.seq, r.value, r.confidence) for r in facts.collect()) == [(1, "-7.5", "high"), (3, "-7", "low")]
    assert [(r.round, r.input_count, r.output_count) for r in rounds.collect()] == [(1, 4, 2), (2, 2, 2)]
    assert X.reflect(df.where("seq > 9"))[1].count() == 1
