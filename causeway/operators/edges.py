"""Facts as edges of the temporal graph: synonyms, times, quality and weight; and the objects that edges name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import scores as S


def _named(facts: DataFrame, *names: str) -> Column:
    """The first of the columns that are there which isn't empty."""
    found = [F.col(n) for n in names if n in facts.columns]
    return S.first_text(*found) if found else F.lit(None).cast("string")


def temporal_fields(facts: DataFrame) -> DataFrame:
    """event_time, valid_from, valid_to, time_source and time_granularity of each fact (absent columns: empty).

    The event's time is that of the fact, else of its period; validity begins with the event
    unless the fact says when, and stays open without an end.
    """
    event, start = _named(facts, "event_time", "date", "as_of", "timestamp", "observed_at"), _named(facts, "valid_from", "start_date", "period_start")
    period = _named(facts, "period")
    out = facts.withColumns(
        {
            "__event": F.coalesce(S.parse_date(event), S.parse_period(period)),
            "__start": S.parse_date(start),
            "__end": S.parse_date(_named(facts, "valid_to", "end_date", "period_end")),
            "__source": F.when(event.isNotNull(), "event_time").when(start.isNotNull(), "valid_from").otherwise("period"),
        }
    )
    return out.withColumns(
        {"event_time": F.col("__event"), "valid_from": F.coalesce("__start", "__event"), "valid_to": F.col("__end"), "time_source": F.col("__source"), "time_granularity": S.granularity(period)}
    ).drop("__event", "__start", "__end", "__source")


def facts_to_edges(facts: DataFrame, rounds: int = 0, repair_ratio: float = 0.0) -> DataFrame:
    """An edge of each fact that has head, relation and tail, or at least a statement.

    What a fact lacks, its statement stands in for.  ``n_issues``, ``validation_status`` and
    ``anchored`` go into the weight where they are columns of the facts.
    """
    has = lambda n, default: F.col(n) if n in facts.columns else F.lit(default)
    head, relation, tail = _named(facts, "head_node", "entity", "subject"), _named(facts, "relation", "metric", "predicate"), _named(facts, "tail_node", "value", "object")
    statement = _named(facts, "statement")
    e = facts.withColumns({"head_node": F.coalesce(head, F.lit("unknown_entity")), "relation": F.coalesce(relation, F.lit("states")), "tail_node": F.coalesce(tail, statement), "__whole": head.isNotNull() & relation.isNotNull() & tail.isNotNull(), "__said": statement})
    e = temporal_fields(e.where(F.col("__whole") | F.col("__said").isNotNull()))
    e = e.withColumn("temporal_quality", S.temporal_quality(F.col("event_time"), F.col("valid_from"), F.col("valid_to"), F.col("time_granularity")))
    e = e.withColumn("reflection_quality", S.reflection_quality(has("confidence", None), has("n_issues", 0), F.lit(rounds), F.lit(float(repair_ratio))))
    weight = S.edge_weight(F.col("__said"), has("validation_status", ""), has("anchored", False), F.col("temporal_quality"), F.col("reflection_quality"))
    return e.withColumn("edge_weight", weight).drop("__whole", "__said")


def ontology(edges: DataFrame) -> DataFrame:
    """The business objects of both ends of each edge, and the relation's predicate."""
    out = {"predicate": S.predicate(F.col("relation"))}
    for role, node in (("head", "head_node"), ("tail", "tail_node")):
        label = S.normal_text(F.col(node))
        kind = S.object_type(label, role, F.col("relation"))
        out[f"{role}_object"] = F.concat(kind, F.lit(":"), F.replace(F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("unknown "), kind)), F.lit(" "), F.lit("_")))
    return edges.withColumns(out)


def lineage(edges: DataFrame, parts: list[str], by: list[str]) -> DataFrame:
    """Distinct sources of each link, by the first row of each signature; signatures combine before they travel."""
    first = edges.groupBy(*by, *parts).agg(F.min("seq").alias("seq"))
    return first.groupBy(*by).agg(F.count("*").alias("n_sources"), F.min("seq").alias("first_seq"))
