"""What-if scenarios in the order of their arrivals: the regime may worsen while a shock travels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import feeds, graph, scan
from causeway.sources import dims
from causeway.sources.scratch import written

#: Arrivals of one level of a scenario have the positions from its depth times this on.
LEVEL = 1 << 40


def running_regime(rows: DataFrame, key: str, order: str, node: str, impact: str) -> DataFrame:
    """``rows`` with their scenario's state after each: ``running`` impact of the node, ``largest`` and
    ``total`` impact, ``hits``, and ``severity`` (0, 1 for High Volatility, 2 for Crisis), which never falls.

    Columns of these names are replaced.  ``order`` is unique within ``key``; a null impact counts as 0.
    A scenario of any number of rows is spread over tasks by segmented scans.
    """
    taken = ("running", "largest", "total", "hits", "severity")
    rows = rows.drop(*[c for c in taken if c in rows.columns])
    value = F.coalesce(F.col(impact), F.lit(0.0))
    hit = lambda c: (c >= 0.1).cast("int")
    out = scan.running(scan.segments(rows, [key, node], [F.col(order)]), [key, node], running=("sum", value), __before=("before", value)).drop(scan.PART, scan.AT)
    now, before = F.abs("running"), F.abs(F.coalesce("__before", F.lit(0.0)))
    risk = F.when(F.col(node) == "geopolitical_risk", now)
    values = {"largest": ("max", now), "total": ("sum", now - before), "hits": ("sum", hit(now) - hit(before)), "__risk": ("last", risk)}
    out = scan.running(scan.segments(out, [key], [F.col(order)]), [key], **values)
    crisis = (F.col("largest") >= 0.6) | (F.col("total") >= 1.5) | (F.col("hits") >= 6)
    tense = (F.col("largest") >= 0.3) | (F.col("hits") >= 4) | (F.coalesce("__risk", F.lit(0.0)) >= 0.25)
    out = scan.running(out, [key], severity=("max", F.when(crisis, 2).when(tense, 1).otherwise(0)))
    return out.drop(scan.PART, scan.AT, "__before", "__risk")


def regime_name(severity: Column) -> Column:
    return F.when(severity == 2, "Crisis").when(severity == 1, "High Volatility").otherwise("none")


def arrivals(shocks: DataFrame, links: DataFrame, horizon: int = 3, connectivity: float = 0.0, volatility: float = 0.0, liquidity: float = 0.0) -> DataFrame:
    """Every arrival of the shocks (scenario, node, delta) over the links, with the scenario's state after it.

    Links have head, tail, strength, polarity, granularity and their order ``seq``; direct_effect,
    support_count, equation and relation may be absent.  A shock of the dot plot also moves tech
    valuation and debt service.  Arrivals go on in order of their position, at the regime of that
    moment; a node takes all arrivals of its first level and none later.  Null or empty nodes and
    null shocks are left out; a scenario has one shock.  Each level is a written table: its
    arrivals grow with the paths of that length.
    """
    has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in links.columns else F.lit(default)
    factor = S.clamp(has("direct_effect", 1.0), 0.7, 1.4) * S.edge_confidence(has("support_count", 1), has("equation", ""))
    links = links.select(S.node_id(F.col("head")).alias("node"), S.node_id(F.col("tail")).alias("to"), "seq", "strength", "polarity", "granularity", factor.alias("factor"), has("relation", "influence").alias("relation"))
    links = links.where("node != '' and to != ''")
    at = lambda pos, depth, fed, via: [F.lit(pos).cast("long").alias("pos"), F.lit(depth).alias("depth"), F.lit(fed).alias("fed"), F.lit(via).cast("string").alias("via")]
    seeds = shocks.select("scenario", S.node_id(F.col("node")).alias("node"), F.col("delta").cast("double").alias("delta")).where("node != '' and delta is not null and not isnan(delta)")
    so_far = seeds.select("*", *at(0, 0, False, None))
    moved = feeds.fed_shock(F.col("delta"))
    dot_plot = seeds.where(F.array_contains(graph.concepts(F.col("node")), "fed_dot_plot") | (F.col("node") == "fed_dot_plot"))
    for k, (node, delta) in enumerate(moved.items()):
        so_far = so_far.unionByName(dot_plot.select("scenario", F.lit(node).alias("node"), delta.alias("delta"), *at(LEVEL - len(moved) + k, 1, True, "dot plot repricing")).where(F.abs("delta") >= 1e-9))
    so_far = written(so_far, "arrivals")
    fluid = 1 + 0.35 * min(connectivity, 5.0) / 5 if connectivity > 0 else 1.0
    for depth in range(horizon):
        state = running_regime(so_far, "scenario", "pos", "node", "delta").where(F.col("depth") == depth)
        strength = S.clamp(F.col("strength") * F.when(F.col("severity") > 0, 1.5).otherwise(1.0) * fluid, 0.05, 0.98)
        velocity = S.contagion_velocity(F.col("granularity"), F.col("severity"), F.col("delta"), F.lit(volatility), F.lit(connectivity), F.lit(liquidity))
        passed = F.col("delta") * strength * velocity * F.col("polarity") * F.col("factor")
        on = state.join(links, "node").select("scenario", F.col("to").alias("node"), passed.alias("delta"), F.concat("node", F.lit(" "), "relation").alias("via"), F.struct("pos", "seq").alias("from"))
        known = so_far.where("not fed").select("scenario", "node").distinct()
        on = on.where(F.abs("delta") >= 1e-9).join(known, ["scenario", "node"], "left_anti")
        pos = F.row_number().over(Window.partitionBy("scenario").orderBy("from")) + F.lit((depth + 1) * LEVEL)
        so_far = written(so_far.unionByName(on.select("scenario", "node", "delta", pos.alias("pos"), F.lit(depth + 1).alias("depth"), F.lit(False).alias("fed"), "via")), "arrivals")
    return running_regime(so_far, "scenario", "pos", "node", "delta")


def impacts(state: DataFrame) -> DataFrame:
    """Of each node of each scenario: its impact, level, effect, first way of arrival, largest impact at any time, and rank by impact."""
    per = state.groupBy("scenario", "node").agg(F.max_by("running", "pos").alias("impact"), F.min("depth").alias("depth"), F.min_by("via", "pos").alias("via"), F.max(F.abs("running")).alias("peak"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc(F.abs("impact")), "first"))
    return per.select("scenario", "node", "impact", "depth", graph.effect_label(F.col("depth")).alias("effect"), "via", "peak", rank.alias("rank"))


def regimes(state: DataFrame) -> DataFrame:
    """The regime that each scenario ends in."""
    return state.groupBy("scenario").agg(regime_name(F.max("severity")).alias("regime"), F.count("*").alias("n_arrivals"))


def actions(found: DataFrame) -> DataFrame:
    """The catalogue's actions on nodes of ``impacts`` whose impact was over 0.05 at any time, once each."""
    catalogue = F.broadcast(dims.frame(found.sparkSession, dims.ACTIONS, "node string, action string, effect double"))
    return found.where("peak > 0.05").join(catalogue.withColumnRenamed("effect", "mitigation"), "node").select("scenario", "node", "action", "mitigation", "impact")
