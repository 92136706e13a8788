"""The causal skeleton from mergeable states: batches and streams add to them, links are read from them.

A state is a row for each spelling of a link (head_node, relation, tail_node): how many edges it has, when the latest was, its first
CAPPED - 1 edges' base strengths in order of arrival, and what the first edge says.  All that depends on the names alone
(modifiers, polarity, tags) is looked up once for each state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import graph, scan
from causeway.sources import dims
from causeway.sources.scratch import written

KEY = ["head_node", "relation", "tail_node"]
LINK = ["head", "relation", "tail"]
SCHEMA = "head_node string, relation string, tail_node string, n long, latest timestamp_ntz, first_seq long, grain string, firsts array<struct<seq: bigint, base: double>>"
#: From so many edges on, the running rule has reached its cap: 0.05 * 1.05 ** 61 > 0.98.
CAPPED = 62


def _whole(edges: DataFrame) -> DataFrame:
    named = [F.coalesce(S.node_id(F.col(c)), F.lit("")) != "" for c in ("head_node", "tail_node")]
    return edges.where((F.trim("relation") != "") & named[0] & named[1])


def states(edges: DataFrame) -> DataFrame:
    """The states of some edges; an edge lacks neither ends nor relation.  Edges are read once, into a narrow table."""
    grain = F.nullif(F.col("granularity"), F.lit("")) if "granularity" in edges.columns else F.lit(None)
    base = S.base_strength(F.col("confidence"), F.col("reflection_quality"), F.col("temporal_quality"))
    narrow = _whole(edges).select(*KEY, F.col("seq").cast("long").alias("seq"), base.alias("base"), F.col("event_time").cast("timestamp_ntz").alias("event_time"), F.coalesce(grain, F.lit("day")).alias("grain"))
    narrow = written(narrow, "edges")
    about = narrow.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("event_time").alias("latest"), F.min("seq").alias("first_seq"), F.min_by("grain", "seq").alias("grain"))
    # The limit on the rank is applied before rows travel, so a link of any number of edges sends few.
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq", "base"))
    few = narrow.withColumn("rank", rank).where(F.col("rank") < CAPPED)
    few = few.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "base"))).alias("firsts"))
    return about.join(few, KEY)


def merged(both: DataFrame) -> DataFrame:
    """One state for each key of several; the order of arrival is that of ``seq``, whichever batch came first."""
    firsts = F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, CAPPED - 1)
    return both.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("latest").alias("latest"), F.min("first_seq").alias("first_seq"), F.min_by("grain", "first_seq").alias("grain"), firsts.alias("firsts"))


def links(state: DataFrame, now: Column) -> DataFrame:
    """One link for each (head, relation, tail) of node ids: strength, polarity, support_count, first_seq, granularity, equation, noise_sigma,
    direct_effect and tags.

    Strengths reinforce one another in order of arrival: ``s = min(0.98, 1.05 max(s, next))``.  A pair's recent and repeated
    evidence weighs more.  A link of one edge has that edge's tags in order, one of several the sorted union.
    """
    relation = F.lower("relation")
    boost = F.when(S.has_any(relation, dims.CAUSAL_TERMS), 1.12).when(S.has_any(relation, dims.WEAK_TERMS), 0.9).otherwise(1.0)
    sign = F.when(S.has_any(relation, dims.INVERSE_TERMS), -1.0).otherwise(1.0)
    ends = {"head": S.node_id(F.col("head_node")), "tail": S.node_id(F.col("tail_node"))}
    rows = state.join(graph.pair_modifiers(state), ["head_node", "tail_node"]).withColumns(ends | {"boost": boost, "sign": S.clamp(F.col("matrix_sign") * sign, -1.0, 1.0)})
    fresh = F.when(F.max("latest") > now.cast("timestamp_ntz") - F.expr("interval 365 days"), 1.15).otherwise(1.0)
    weights = state.withColumns(ends).groupBy("head", "tail").agg((fresh + F.least(0.05 * F.sum("n"), F.lit(0.2))).alias("weight"))
    rows = written(rows.join(weights, ["head", "tail"]), "states")
    tags = F.array_compact(
        F.array(
            F.lit("base_signal"), F.when(F.col("boost") > 1, F.lit("relation_weighted")), F.when(F.col("label") != "", F.col("label")),
            F.when(F.col("equation") != "", F.lit("scm_direct")), F.when(F.col("bias") != 1, F.lit("dml_bias_corrected")), F.when(F.col("weight") > 1.05, F.lit("dynamic_learning_boost")),
        )
    )
    own = F.struct(F.col("grain").alias("granularity"), "equation", "noise_sigma", F.col("scm_boost").alias("direct_effect"), tags.alias("first_tags"))
    about = rows.groupBy(*LINK).agg(
        F.sum("n").alias("support_count"), (F.sum(F.col("n") * F.col("sign")) / F.sum("n")).alias("polarity"), F.min("first_seq").alias("first_seq"),
        F.min_by(own, "first_seq").alias("own"), F.flatten(F.collect_set(tags)).alias("all_tags"),
    )
    strength = S.clamp(F.col("e.base") * F.col("boost") * F.col("matrix_boost") * F.col("scm_boost") * F.col("bias"), 0.05, 0.98)
    each = rows.select(*LINK, "boost", "matrix_boost", "scm_boost", "bias", "weight", F.explode("firsts").alias("e")).select(*LINK, "e.seq", S.clamp(strength * F.col("weight"), 0.05, 0.98).alias("s"))
    few = each.withColumn("rank", F.row_number().over(Window.partitionBy(*LINK).orderBy("seq", "s"))).where(F.col("rank") < CAPPED)
    few = few.groupBy(*LINK).agg(F.array_sort(F.collect_list(F.struct("seq", "s"))).alias("in_order"))
    fold = F.aggregate(F.slice("in_order", 2, CAPPED), F.get("in_order", F.lit(0))["s"], lambda s, x: F.least(F.lit(0.98), 1.05 * F.greatest(s, x["s"])))
    many = F.array_sort(F.array_distinct(F.concat("all_tags", F.array(F.lit("source_consensus")))))
    return about.join(few, LINK).select(
        *LINK, F.when(F.col("support_count") >= CAPPED, 0.98).otherwise(fold).alias("strength"), S.clamp(F.col("polarity"), -1.0, 1.0).alias("polarity"), "support_count", "first_seq",
        "own.granularity", "own.equation", "own.noise_sigma", "own.direct_effect", F.when(F.col("support_count") == 1, F.col("own.first_tags")).otherwise(many).alias("tags"),
    )


def sources(edges: DataFrame, parts: list[str]) -> DataFrame:
    """The distinct sources of each link: a row for each signature of ``parts`` (null as empty), from its first edge, with its place from 1.

    A link may have any number of sources: signatures combine before they travel, and places are counted in segments.
    """
    keys = {"head": S.node_id(F.col("head_node")), "relation": F.col("relation"), "tail": S.node_id(F.col("tail_node"))}
    text = {c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" \t\n\r\x0b\x0c")) for c in parts}
    rows = _whole(edges).select(*[c.alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in text.items()], "seq")
    first = rows.groupBy(*LINK, *parts).agg(F.min("seq").alias("seq"))
    placed = scan.running(scan.segments(first, LINK, [F.col("seq"), *map(F.col, parts)]), LINK, place=("count", F.lit(1)))
    return placed.drop(scan.PART, scan.AT)


def skeleton(edges: DataFrame, now: Column) -> DataFrame:
    """All links of the edges."""
    return links(states(edges), now)
