"""Edges of the temporal graph: validity, concepts, causal scores, consensus and what-if propagation."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.sources import dims
from causeway.sources.scratch import written


def as_of(edges: DataFrame, at: Column) -> DataFrame:
    """Edges valid at an instant, both bounds included; a missing bound is open."""
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))


def first_of(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key in the order; rows of one key combine before they travel."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("__first")).select("__first.*")


def first_by(rows: DataFrame, parts: dict[str, Column], order: str = "seq", trim: bool = True) -> DataFrame:
    """The first row of each signature, whose parts are compared as (trimmed) text, null as empty.

    Rows of one signature combine before they travel, so a repeated one isn't a group of its own.
    """
    texts = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in parts.items()}
    text = [(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")) if trim else c).alias(f"__{n}") for n, c in texts.items()]
    first = rows.groupBy(*text).agg(F.min_by(F.struct(*rows.columns), order).alias("__first"))
    return first.select("__first.*")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each case, document, head, relation, tail and validity; absent columns count as empty."""
    names = ("case_id", "doc_id", "head_node", "relation", "tail_node", "valid_from", "valid_to")
    return first_by(edges, {n: F.col(n) if n in edges.columns else F.lit("") for n in names})


def concepts(node: Column) -> Column:
    """The sorted concepts of which a name is inside the node's normal text."""
    return concepts_of(S.normal_text(node))


def concepts_of(text: Column) -> Column:
    """The same of a text that is normal already."""
    return F.array_compact(F.array(*[F.when(S.has_any(text, (*dims.ALIASES[c], c)), c) for c in sorted(dims.ALIASES)]))


def node_concepts(edges: DataFrame) -> DataFrame:
    """(node, concepts) of the distinct nodes."""
    nodes = edges.select(F.explode(F.array("head_node", "tail_node")).alias("node")).distinct()
    # The text is a column of its own: the terms would each normalise the name again.
    texts = nodes.select("node", F.explode(F.array(S.normal_text(F.col("node")))).alias("text"))
    return texts.select("node", concepts_of(F.col("text")).alias("concepts"))


def _best(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """Of the table's rows (head, tail, size, ...) that fit the concepts hc and tc, that of the largest size above 1; ties by concepts."""
    fits = [
        F.when(F.array_contains("hc", r[0]) & F.array_contains("tc", r[1]), F.struct(F.lit(r[2]).alias("size"), F.lit(-k).alias("tie"), *[F.lit(v).alias(n) for n, v in zip(names, r[3:], strict=True)]))
        for k, r in enumerate(sorted(rows))
        if r[2] > 1
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def pair_modifiers(edges: DataFrame) -> DataFrame:
    """A row per distinct (head, tail): matrix and structural boosts, polarity, label, equation, bias correction.

    Concepts are found once for each node and modifiers once for each pair of sets of concepts, however many edges have them.
    """
    both = lambda rows: [F.array_contains("hc", h) & F.array_contains("tc", t) for h, t in rows]
    pairs = written(edges.select("head_node", "tail_node").distinct(), "pairs")
    found = written(node_concepts(pairs), "concepts")
    side = lambda of, name: found.select(F.col("node").alias(of), F.col("concepts").alias(name))
    pairs = pairs.join(side("head_node", "hc"), "head_node").join(side("tail_node", "tc"), "tail_node")
    # What follows depends on the concepts alone, of which there are few combinations.
    kinds = pairs.select("hc", "tc").distinct()
    broad = F.when(F.arrays_overlap("hc", F.array(*map(F.lit, dims.BROAD_CONCEPTS))), 0.85).otherwise(1.0)
    driver = F.when(reduce(or_, both(dims.common_drivers())), 0.7).otherwise(1.0)
    kinds = kinds.withColumns({"m": _best(dims.MATRIX, ("sign", "label")), "s": _best(dims.SCM, ("sigma", "domain", "equation")), "bias": broad * driver})
    kinds = kinds.select(
        "hc",
        "tc",
        F.coalesce("m.size", F.lit(1.0)).alias("matrix_boost"),
        F.coalesce("m.sign", F.lit(1.0)).alias("matrix_sign"),
        F.coalesce("m.label", F.lit("")).alias("label"),
        F.coalesce("s.size", F.lit(1.0)).alias("scm_boost"),
        F.coalesce("s.sigma", F.lit(0.2)).alias("noise_sigma"),
        F.coalesce("s.equation", F.lit("")).alias("equation"),
        "bias",
    )
    return pairs.join(kinds, ["hc", "tc"]).drop("hc", "tc")


def score_edges(edges: DataFrame) -> DataFrame:
    """Strength and polarity of every edge with a relation."""
    kept = edges.where(F.trim("relation") != "")
    modifiers = pair_modifiers(kept)
    relation = F.lower("relation")
    boost = F.when(S.has_any(relation, dims.CAUSAL_TERMS), 1.12).when(S.has_any(relation, dims.WEAK_TERMS), 0.9).otherwise(1.0)
    sign = F.when(S.has_any(relation, dims.INVERSE_TERMS), -1.0).otherwise(1.0)
    base = S.base_strength(F.col("confidence"), F.col("reflection_quality"), F.col("temporal_quality"))
    return kept.join(modifiers, ["head_node", "tail_node"]).withColumns(
        {
            "strength": S.clamp(base * boost * F.col("matrix_boost") * F.col("scm_boost") * F.col("bias"), 0.05, 0.98),
            "polarity": S.clamp(F.col("matrix_sign") * sign, -1.0, 1.0),
            "reasoning": F.concat_ws(
                ",", F.lit("base_signal"), F.when(boost > 1, "relation_weighted"), F.when(F.col("label") != "", F.col("label")),
                F.when(F.col("equation") != "", "scm_direct"), F.when(F.col("bias") != 1, "dml_bias_corrected"),
            ),
        }
    )


def dynamic_weights(edges: DataFrame, now: Column) -> DataFrame:
    """A weight for each pair of node ids: evidence of the last 365 days counts 1.15, and repeated evidence up to 0.2 more."""
    recent = F.max(F.when(F.col("event_time") > now - F.expr("interval 365 days"), 1).otherwise(0))
    pairs = edges.groupBy(S.node_id(F.col("head_node")).alias("head"), S.node_id(F.col("tail_node")).alias("tail"))
    return pairs.agg((F.when(recent == 1, 1.15).otherwise(1.0) + F.least(0.05 * F.count("*"), F.lit(0.2))).alias("weight"), F.count("*").alias("n_edges"))


def what_if(links: DataFrame, seed: str, delta: float, horizon: int, severity: int = 0, connectivity: float = 0.0) -> DataFrame:
    """Impacts (node, impact, depth) of a shock that travels the links level by level, at a fixed regime.

    A node takes all arrivals of its first level and none later.  Every arrival travels on by
    itself, as the velocity depends on its size; equal ones of a node travel together with
    their count.  Absent columns of the links have no effect.
    """
    spark: SparkSession = links.sparkSession
    frontier = spark.createDataFrame([(seed, float(delta), 1, 0)], "node string, delta double, n long, depth int")
    reached = frontier
    column = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in links.columns else F.lit(default)
    factor = S.clamp(column("direct_effect", 1.0), 0.7, 1.4) * S.edge_confidence(column("support_count", 1), column("equation", ""))
    links = links.withColumn("factor", factor)
    fluid = 1 + 0.35 * min(connectivity, 5.0) / 5 if connectivity > 0 else 1.0
    for depth in range(1, horizon + 1):
        pass_on = S.clamp(F.col("strength") * (1.5 if severity else 1.0) * fluid, 0.05, 0.98)
        velocity = S.contagion_velocity(F.col("granularity"), F.lit(severity), F.col("delta"), F.lit(0.0), F.lit(connectivity), F.lit(0.0))
        arrived = frontier.join(links, F.col("node") == F.col("head")).select(F.col("tail").alias("node"), (F.col("delta") * pass_on * velocity * F.col("polarity") * F.col("factor")).alias("delta"), "n")
        arrived = arrived.where(F.abs("delta") >= 1e-9).join(reached.select("node").distinct(), "node", "left_anti")
        frontier = arrived.groupBy("node", "delta").agg(F.sum("n").alias("n")).withColumn("depth", F.lit(depth))
        reached = reached.unionByName(frontier)
    return reached.groupBy("node").agg(F.sum(F.col("delta") * F.col("n")).alias("impact"), F.min("depth").alias("depth"))


def graph_counts(links: DataFrame, key: str) -> DataFrame:
    """Distinct nodes and edges of each graph, by node id; parallel edges are one."""
    e = links.select(key, S.node_id(F.col("head_node")).alias("h"), S.node_id(F.col("tail_node")).alias("t")).where("h != '' and t != ''").distinct()
    nodes = e.select(key, F.explode(F.array("h", "t")).alias("n")).distinct().groupBy(key).agg(F.count("*").alias("n_nodes"))
    return nodes.join(e.groupBy(key).agg(F.count("*").alias("n_edges")), key)


def per_graph(links: DataFrame, key: str, work, schema: str) -> DataFrame:
    """A function of the links of each graph, after they have become few: distinct (head, tail) with their best strength."""
    few = links.groupBy(key, S.node_id(F.col("head_node")).alias("head"), S.node_id(F.col("tail_node")).alias("tail")).agg(F.max("strength").alias("strength"))
    return few.groupBy(key).applyInPandas(work, schema)


def acyclic(links: DataFrame, key: str) -> DataFrame:
    """The links of each graph that a greedy choice by falling strength keeps without a cycle."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["strength", "head", "tail"], ascending=[False, True, True])
        after: dict[str, set[str]] = {}

        def reaches(a: str, b: str) -> bool:
            seen, todo = {a}, [a]
            while todo:
                n = todo.pop()
                if n == b:
                    return True
                new = after.get(n, set()) - seen
                seen |= new
                todo += new
            return False

        chosen = []
        for h, t in zip(rows["head"], rows["tail"], strict=True):
            ok = h != t and not reaches(t, h)
            if ok:
                after.setdefault(h, set()).add(t)
            chosen.append(ok)
        return rows[chosen]

    return per_graph(links, key, keep, f"{key} string, head string, tail string, strength double")


def fiedler(links: DataFrame, key: str) -> DataFrame:
    """The second smallest eigenvalue of each graph's Laplacian (undirected, simple): 0 where it falls apart."""

    def value(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(rows["head"]) | set(rows["tail"]))
        at = {n: i for i, n in enumerate(nodes)}
        m = np.zeros((len(nodes), len(nodes)))
        for h, t in zip(rows["head"], rows["tail"], strict=True):
            if h != t:
                m[at[h], at[t]] = m[at[t], at[h]] = -1
        np.fill_diagonal(m, -m.sum(axis=1))
        second = float(np.linalg.eigvalsh(m)[1]) if len(nodes) > 1 else 0.0
        return pd.DataFrame({key: [rows[key].iloc[0]], "fiedler": [max(0.0, second) if second > 1e-9 else 0.0]})

    return per_graph(links, key, value, f"{key} string, fiedler double")


def root_causes(links: DataFrame, target: str, depth: int = 6) -> DataFrame:
    """All maximal paths back from a node: path (root first), influence, direction, and a 95 % interval.

    A path ends where no link leads further back without a node it has already, or at ``depth``.
    The links are an aggregate by node pairs; each level is one join with them.
    """
    spark = links.sparkSession
    factor = F.col("strength") * S.temporal_decay(F.col("granularity")) * F.col("polarity")
    noise = (1 - S.clamp(F.col("strength"), 0.05, 0.98) + F.coalesce("noise_sigma", F.lit(0.2))) * 0.04
    back = links.select("head", "tail", factor.alias("f"), noise.alias("v")).where((F.abs("f") >= 1e-12) & (F.col("head") != ""))
    open_ = spark.createDataFrame([([target], 1.0, 1.0, 0.0)], "path array<string>, influence double, direction double, variance double")
    done = open_.limit(0)
    for _ in range(depth):
        grown = open_.join(back, (F.get("path", F.lit(0)) == F.col("tail")) & ~F.array_contains("path", F.col("head")), "left")
        done = done.unionByName(grown.where("f is null").select(*open_.columns))
        open_ = grown.where("f is not null").select(
            F.concat(F.array("head"), "path").alias("path"), (F.col("influence") * F.abs("f")).alias("influence"), (F.col("direction") * F.col("f")).alias("direction"), (F.col("variance") + F.col("v")).alias("variance")
        )
    margin = 1.96 * F.sqrt("variance")
    alone = F.size("path") == 1
    return done.unionByName(open_).select(
        "path", "influence", "direction", F.when(alone, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("influence") - margin)).alias("lower"), F.when(alone, F.col("influence")).otherwise(F.col("influence") + margin).alias("upper")
    )


def triggered_actions(impacts: DataFrame) -> DataFrame:
    """The catalogue's actions on nodes with an impact over 0.05, in order of the impacts' size."""
    actions = F.broadcast(dims.frame(impacts.sparkSession, dims.ACTIONS, "node string, action string, effect double"))
    return impacts.where(F.abs("impact") > 0.05).join(actions, "node").select("node", "action", "effect", "impact")


def recommendations(impacts: DataFrame, seed: str) -> DataFrame:
    """Nodes besides the seed with an impact over 0.5, what to do, and how sure that is."""
    rows = impacts.where((F.abs("impact") > 0.5) & (F.col("node") != seed))
    return rows.select(F.col("node").alias("asset"), F.when(F.col("impact") > 0, "BUY/OVERWEIGHT").otherwise("SELL/UNDERWEIGHT").alias("action"), (0.85 + 0.1 * F.abs("impact")).alias("confidence"))


def effect_label(depth: Column) -> Column:
    return F.when(depth == 0, "Seed Shock").when(depth == 1, "First-Order Effect").otherwise("Second-Order Effect")


def market_links(spark: SparkSession) -> DataFrame:
    """The structural links between markets, as links of the graph."""
    rows = dims.frame(spark, dims.MARKET_LINKS, "a string, b string, strength double, channel string")
    return rows.select(F.concat(F.lit("market_"), "a").alias("head"), F.concat(F.lit("contagion_"), "channel").alias("relation"), F.concat(F.lit("market_"), "b").alias("tail"), "strength", F.lit(1.0).alias("polarity"), F.lit("day").alias("granularity"))
