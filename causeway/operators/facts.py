"""Facts: critique, repair, ontology healing and accounting identities."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import graph as G
from causeway.sources import dims
from causeway.sources.scratch import written


def critique(facts: DataFrame, unsure: str = "") -> DataFrame:
    """Issues and error types of each fact, as comma-separated sorted names.

    ``unsure``: the error type of a missing confidence, by itself none.
    """
    number = S.parse_number(F.col("value"))
    empty = lambda *names: reduce(and_, (F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in names if c in facts.columns))
    relation = F.lower("metric")
    inverted = F.coalesce((S.has_any(relation, dims.DOWN_TERMS) & (number > 0)) | (S.has_any(relation, dims.UP_TERMS) & (number < 0)), F.lit(False))
    bad_number = number.isNull() & F.coalesce(F.col("value").rlike("[0-9]"), F.lit(False))
    missing = empty("entity", "head_node") | empty("metric", "relation") | empty("value", "tail_node")
    nothing = empty("statement", "metric", "value", "entity", "relation", "head_node")
    omission = missing | nothing | (empty("confidence") if unsure == "omission" else F.lit(False))
    return facts.withColumns(
        {
            "number": number,
            "inverted": inverted,
            "issues": F.concat_ws(",", F.when(bad_number, "invalid_numeric_value"), F.when(empty("confidence"), "missing_confidence"), F.when(missing, "missing_required_component"), F.when(nothing, "missing_semantic_content")),
            "error_types": F.concat_ws(",", F.when(bad_number, "numeric_typo"), F.when(omission, "omission"), F.when(inverted, "relation_inversion")),
        }
    )


def repair(facts: DataFrame) -> DataFrame:
    """Default confidence, a statement, and the sign that the metric's words ask for."""
    f = critique(facts)
    down = S.has_any(F.lower("metric"), dims.DOWN_TERMS)
    return f.withColumns(
        {
            "confidence": F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.lit("medium")),
            "statement": F.concat("entity", F.lit(" "), "metric", F.lit(" "), "value", F.lit(" ("), "period", F.lit(")")),
            "direction": F.when(F.col("inverted"), F.when(down, "down").otherwise("up")),
            "repaired": F.when(F.col("inverted"), F.when(down, -F.abs("number")).otherwise(F.abs("number"))).otherwise(F.col("number")),
        }
    )


def error_type_counts(facts: DataFrame, unsure: str = "") -> DataFrame:
    return critique(facts, unsure).select(F.explode(F.split("error_types", ",")).alias("error_type")).where("error_type != ''").groupBy("error_type").agg(F.count("*").alias("n"))


def signature(facts: DataFrame) -> dict[str, Column]:
    """A fact's entity, metric, value, period and statement, of which all but the last have a second name.

    Absent columns and nulls count as empty.
    """
    names = {"entity": "head_node", "metric": "relation", "value": "tail_node", "period": "date", "statement": ""}
    has = lambda n: F.nullif(F.col(n).cast("string"), F.lit("")) if n in facts.columns else F.lit(None)
    return {n: F.coalesce(has(n), has(other), F.lit("")) for n, other in names.items()}


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """The first fact of each signature."""
    return G.first_by(facts, signature(facts), trim=False)


def _mended(f: DataFrame) -> Column:
    """The value of a critiqued fact, as text, with the sign that its relation's words ask for."""
    size = F.abs("number")
    signed = F.when(S.has_any(F.lower("metric"), dims.DOWN_TERMS), -size).otherwise(size)
    whole = ~F.contains(F.col("value"), F.lit("."))
    return F.when(F.col("inverted"), F.when(whole, signed.cast("decimal(38,0)").cast("string")).otherwise(signed.cast("string"))).otherwise(F.col("value"))


def reflect_once(facts: DataFrame) -> DataFrame:
    """All facts critiqued and repaired: sign and confidence mended, issues and error types noted, not yet distinct.

    A note of an earlier round stays where a later one finds nothing.
    """
    f = critique(facts)
    old = lambda n: F.col(n) if n in facts.columns else F.lit(None).cast("string")
    note = lambda n: F.coalesce(F.nullif(F.col(n), F.lit("")), old("reflection_" + n))
    down = S.has_any(F.lower("metric"), dims.DOWN_TERMS)
    return f.withColumns(
        {
            "value": _mended(f),
            "direction": F.when(F.col("inverted"), F.when(down, "down").otherwise("up")).otherwise(old("direction")),
            "confidence": F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.lit("medium")),
            "validation_status": F.coalesce(F.nullif(old("validation_status"), F.lit("")), F.lit("reflected")),
            "reflection_issues": note("issues"),
            "reflection_error_types": note("error_types"),
        }
    )


def _state(facts: DataFrame) -> tuple:
    """Number of facts and sum of their signatures' hashes: equal for equal multisets of signatures."""
    hashed = F.xxhash64(*signature(facts).values()).cast("decimal(38,0)")
    return tuple(facts.agg(F.count("*"), F.sum(hashed)).first())


def reflect(facts: DataFrame, max_rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Facts critiqued, repaired and made distinct until a round leaves their signatures as they are, or ``max_rounds``.

    Gives the facts and a row per round: its input, its facts with issues, their error types and what it leaves.
    Each round is a written table, so the next one neither repeats it nor depends on its executors.
    """
    spark, rounds = facts.sparkSession, []
    work, before = facts, _state(facts)
    for k in range(1, max_rounds + 1):
        seen = written(reflect_once(work), "reflected")
        names = ("numeric_typo", "omission", "relation_inversion")
        row = seen.agg(F.count("*"), F.count_if(F.col("issues") != ""), *[F.count_if(F.array_contains(F.split("error_types", ","), n)) for n in names]).first()
        work = written(dedupe_facts(seen.drop("number", "inverted", "issues", "error_types")), "facts")
        now = _state(work)
        rounds.append((k, *row, now[0]))
        if now == before:
            break
        before = now
    return work, spark.createDataFrame(rounds, "round int, input_count long, issues_found long, numeric_typo long, omission long, relation_inversion long, output_count long")


def heal_ownership(facts: DataFrame) -> DataFrame:
    """``a is owned by b`` becomes ``b owns a``, and a metric of both revenue and sales ``revenue``."""
    sales = F.contains(F.lower("metric"), F.lit("revenue")) & F.contains(F.lower("metric"), F.lit("sales"))
    owned = F.contains(F.lower("metric"), F.lit("owned by"))
    return facts.select(
        "seq",
        F.when(owned, F.col("value")).otherwise(F.col("entity")).alias("head"),
        F.when(sales, F.lit("revenue")).when(owned, F.lit("owns")).otherwise(F.col("metric")).alias("relation"),
        F.when(owned, F.col("entity")).otherwise(F.col("value")).alias("tail"),
        owned.alias("healed"),
    )


def identity_mismatches(facts: DataFrame) -> DataFrame:
    """Documents whose last values break an accounting identity by more than one per cent of the target."""
    last = facts.select("doc_id", F.lower(F.trim("metric")).alias("m"), S.parse_number(F.col("value")).alias("v"), "seq").where("v is not null")
    names = sorted({x for target, parts, _ in dims.IDENTITIES for x in (target, *parts)})
    at = {m: f"v{i}" for i, m in enumerate(names)}
    wide = last.groupBy("doc_id").agg(*[F.expr(f"max_by(v, seq) filter (where m = '{m}')").alias(at[m]) for m in names])
    out = None
    for k, (target, parts, op) in enumerate(dims.IDENTITIES):
        first, *others = (F.col(at[p]) for p in parts)
        want = first + sum(others) if op == "sum" else first - sum(others)
        t = F.col(at[target])
        rows = wide.where((t != 0) & (F.abs(want - t) / F.abs(t) > 0.01)).select("doc_id", F.lit(k).alias("rule"), t.alias("stated"), want.alias("computed"))
        out = rows if out is None else out.unionByName(rows)
    return out


def document_bytes(file_bytes: Column, content_base64: Column, content: Column) -> Column:
    """The first of the given bytes, the decoded base64 text and the content; empty texts count as absent."""
    return F.coalesce(file_bytes, F.unbase64(F.nullif(content_base64, F.lit(""))), F.encode(F.nullif(content, F.lit("")), "UTF-8"))


def offline_text(content: Column) -> Column:
    """What stands for a document's reasoning where no service is asked; a null content is empty."""
    return F.concat(F.lit("[Offline Distill]\n"), F.coalesce(content, F.lit("")))


def coerced(raw: Column, kind: Column) -> dict[str, Column]:
    """A fact from a text or from anything else, as its text; ``kind`` is text, fact or other."""
    return {
        "statement": F.when(kind == "text", F.trim(raw)),
        "raw_fact": raw,
        "validation_status": F.when(kind == "text", "coerced_from_str").when(kind == "fact", "").otherwise("coerced_from_unknown"),
    }
