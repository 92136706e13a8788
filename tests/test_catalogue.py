"""Every query of the catalogue against DuckDB, and fixtures with known values."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import consensus as K
from causeway.operators import events as E
from causeway.operators import facts as X
from causeway.operators import graph as G
from causeway.plans import catalogue, extended  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) else v
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_matches_duckdb(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.SQL[name]).df())


def test_parse_number(spark):
    cases = {"1,000": 1000, "12%": 12, "$1.2B": 1.28, "100.5 Billion": 100.5811, "(500)": 500, "USD 5": 55, "Sales": 51, "N/A": None, "2024-05": None, "-": None, "1.2.3": None}
    df = spark.createDataFrame([(k, v if v is None else float(v)) for k, v in cases.items()], "t string, v double")
    assert df.where(~S.parse_number(F.col("t")).eqNullSafe(F.col("v"))).count() == 0


def test_granularity(spark):
    cases = {"": "day", "2024": "year", "2024-Q2": "quarter", "2024-06": "month", "2024-06-15": "month", "FY2024": "day"}
    df = spark.createDataFrame(list(cases.items()), "t string, v string")
    assert df.where(S.granularity(F.col("t")) != F.col("v")).count() == 0


def test_concepts(spark):
    nodes = ["Interest Rate", "Tech Valuation", "shipping cost", "Turmoil", "transport_cost"]
    df = spark.createDataFrame([(n, n) for n in nodes], "head_node string, tail_node string")
    found = {r.node: r.concepts for r in G.node_concepts(df).collect()}
    assert found == {"Interest Rate": ["policy_rate"], "Tech Valuation": ["equity_valuation", "tech_valuation"], "shipping cost": ["inflation", "transport_cost"], "Turmoil": ["energy_price"], "transport_cost": []}


def edge(spark, *edges):
    full = [(i, *e, None, 0.0, 0.0) for i, e in enumerate(edges)]
    return spark.createDataFrame(full, "seq long, head_node string, relation string, tail_node string, confidence string, event_time timestamp_ntz, reflection_quality double, temporal_quality double")


def test_scores_of_known_edges(spark):
    df = edge(spark, ("Inflation", "drives", "Bond Yield", None), ("Product Demand", "drives", "Revenue", None))
    found = {r.seq: r for r in G.score_edges(df).collect()}
    assert found[0].strength == pytest.approx(0.3332) and "dml_bias_corrected" in found[0].reasoning
    assert found[1].strength == pytest.approx(0.392) and "dml_bias_corrected" not in found[1].reasoning


def test_consensus_of_two(spark):
    df = edge(spark, ("A", "drives", "B", "medium"), ("A", "drives", "B", "medium"))
    (link,) = K.skeleton(df, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert link.strength == pytest.approx(0.6468) and link.support_count == 2


def test_what_if_on_a_chain(spark):
    links = spark.createDataFrame([("revenue", "margin", 0.8, 1.0, "quarter"), ("margin", "valuation", 0.6, 1.0, "quarter")], "head string, tail string, strength double, polarity double, granularity string")
    found = {r.node: r.impact for r in G.what_if(links, "revenue", 1.0, 2, severity=2, connectivity=1.0).collect()}
    assert found["revenue"] == 1.0 and found["margin"] == pytest.approx(0.98) and found["valuation"] == pytest.approx(0.94374, abs=1e-5)


def test_what_if_like_a_queue(spark):
    links = [("a", "b", 0.9, 1.0, "year", 1.18, "eq", 3), ("a", "c", 0.4, 1.0, "day", 1.0, "", 2), ("b", "d", 0.8, 1.0, "quarter", 1.0, "", 1), ("c", "d", 0.7, -1.0, "month", 1.6, "", 1), ("a", "d2", 0.5, 1.0, "day", 1.0, "", 1)]
    links += [("b", "e", 0.5, 1.0, "day", 1.0, "", 1), ("c", "e", 0.5, 1.0, "day", 1.0, "", 5), ("d", "f", 0.9, 1.0, "year", 1.0, "", 1), ("e", "f", 0.9, -0.5, "month", 1.1, "eq", 1), ("e", "a", 0.9, 1.0, "day", 1.0, "", 1), ("d", "d2", 0.9, 1.0, "day", 1.0, "", 1)]
    decay = {"year": 0.9, "quarter": 0.85, "month": 0.78, "day": 0.7}
    impacts, seen, queue = {}, {"a": 0}, [("a", 2.0, 0)]
    while queue:
        node, delta, depth = queue.pop(0)
        impacts[node] = impacts.get(node, 0) + delta
        for head, tail, strength, polarity, grain, direct, equation, support in links:
            if head != node or depth == 3 or seen.get(tail, depth + 1) < depth + 1:
                continue
            trust = (1.08 * 1.03 if support >= 3 else 1.04 * 1.03 if support == 2 else 1.0) * (1.02 if equation else 1.0)
            velocity = min(1.0, decay[grain] * (1 + min(0.4, 0.4 * abs(delta))))
            seen[tail] = depth + 1
            queue.append((tail, delta * strength * polarity * velocity * min(1.4, direct) * min(1.15, trust), depth + 1))
    df = spark.createDataFrame(links, "head string, tail string, strength double, polarity double, granularity string, direct_effect double, equation string, support_count long")
    found = {r.node: (r.impact, r.depth) for r in G.what_if(df, "a", 2.0, 3).collect()}
    assert found == {k: (pytest.approx(v), seen[k]) for k, v in impacts.items()}


def test_consensus_keeps_the_first_edge(spark):
    df = edge(spark, ("Inflation", "drives", "Interest Rate", None), ("Inflation", "drives", "Interest Rate", None)).withColumn("granularity", F.when(F.col("seq") == 0, "year").otherwise("day"))
    (link,) = K.skeleton(df, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert (link.granularity, link.direct_effect, link.equation[:13]) == ("year", 1.18, "policy_rate_t")


def test_identity_and_inversion(spark):
    df = spark.createDataFrame([(0, "d", "ACME", "revenue", "1200"), (1, "d", "ACME", "expenses", "100"), (2, "d", "ACME", "net income", "1000")], "seq long, doc_id string, entity string, metric string, value string")
    assert [(r.rule, r.stated, r.computed) for r in X.identity_mismatches(df).collect()] == [(0, 1000.0, 1100.0)]
    down = spark.createDataFrame([("ACME", "revenue decrease", "12", "2024-Q2", None)], "entity string, metric string, value string, period string, confidence string")
    (r,) = X.repair(down).collect()
    assert (r.repaired, r.direction, r.confidence) == (-12.0, "down", "medium")


def test_dedupe_by_whole_signatures(spark):
    rows = [(0, "c", "d", "A", "r", "B", "2024", None), (1, "c", "d", " A", "r", "B", "2024", ""), (2, "c", "d", "A", "r", "B", "2024", "2025"), (3, "c", "d", "A", "r", "B", None, None), (4, "c", None, "A", "r", "B", "2024", None)]
    edges = spark.createDataFrame(rows, "seq long, case_id string, doc_id string, head_node string, relation string, tail_node string, valid_from string, valid_to string")
    assert {r.seq for r in G.dedupe_edges(edges).collect()} == {0, 2, 3, 4}
    assert {r.seq for r in G.dedupe_edges(edges.drop("doc_id")).collect()} == {0, 2, 3}
    rows = [(0, None, None, None, None, "x"), (1, "", None, None, None, "x"), (2, None, None, None, None, "y"), (3, "e", "m", "1", "p", None)]
    facts = spark.createDataFrame(rows, "seq long, entity string, metric string, value string, period string, statement string")
    assert {r.seq for r in X.dedupe_facts(facts).collect()} == {0, 2, 3}
    assert {r.seq for r in X.dedupe_facts(facts.drop("statement")).collect()} == {0, 3}


def test_chain_holds_no_group(spark):
    rows = [(u, i, f"p{i % 7}", None if (u, i) == (2, 4) else str(i)) for u in (1, 2, None) for i in range(30)]
    df = spark.createDataFrame(rows, "u long, i long, p string, c string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        out = E.chain(df, "u", "i", "p", "c")
        found = {r.u: (r.n_events, r.head_hash) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    head = E.GENESIS
    for i in range(30):
        head = hashlib.sha256(f"p{i % 7}|{i}|{head}".encode()).hexdigest()
    assert found == {1: (30, head), 2: (30, None), None: (30, head)}


def test_critique_and_healing_by_all_rules(spark):
    rows = [(0, None, "", None, None, "high"), (1, "", None, "", "a statement", "high"), (2, "e", "m", "1", None, None), (3, "e", "Revenue from sales", "1", None, "low"), (4, "e", "sales is owned by", "p", None, "low"), (5, "e", "revenue of sales owned by", "p", None, "low")]
    df = spark.createDataFrame(rows, "seq long, entity string, metric string, value string, statement string, confidence string")
    found = {r.seq: (r.issues, r.error_types) for r in X.critique(df).collect()}
    assert found[0] == ("missing_required_component,missing_semantic_content", "omission")
    assert found[1] == ("missing_required_component", "omission") and found[2] == ("missing_confidence", "")
    assert {r.error_type: r.n for r in X.error_type_counts(df).collect()} == {"omission": 2}
    healed = {r.seq: (r.head, r.relation, r.tail) for r in X.heal_ownership(df).collect()}
    assert [healed[i] for i in (3, 4, 5)] == [("e", "revenue", "1"), ("p", "owns", "e"), ("p", "revenue", "e")]


def test_regimes(spark):
    df = spark.createDataFrame([("none", 0.05), ("none", -0.05), ("high", 0.4), ("high", 0.05), ("crisis", 0.7), ("crisis", 0.5)], "k string, v double")
    assert {r.k: r.regime for r in E.regime(df, "k", F.col("v")).collect()} == {"none": "none", "high": "High Volatility", "crisis": "Crisis"}


def test_regime_of_geopolitical_risk(spark):
    df = spark.createDataFrame([("risk", "geopolitical_risk", -0.27), ("low", "geopolitical_risk", 0.24), ("other", "inflation", 0.27), ("none", None, 0.27)], "k string, n string, v double")
    assert {r.k: r.regime for r in E.regime(df, "k", F.col("v"), F.col("n")).collect()} == {"risk": "High Volatility", "low": "none", "other": "none", "none": "none"}
