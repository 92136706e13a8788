"""Audit: chain verification, compliance reports, proof checks and the mix of agents' tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators import scan
from causeway.operators.events import GENESIS
from causeway.sources import dims


def verify_chain(chained: DataFrame, key: str, order: str, payload: str, created: str) -> DataFrame:
    """Whether each key's stored hashes are a chain: every row is checked by itself and against the row before."""
    chained = scan.running(scan.segments(chained, [key], [F.col(order)]), [key], __before=("lag", F.col("event_hash")), __at=("count", F.lit(1)))
    before = F.when(F.col("__at") == 1, GENESIS).otherwise(F.col("__before"))
    own = F.sha2(F.concat_ws("|", payload, created, "prev_hash").cast("binary"), 256)
    rows = chained.withColumn("__ok", F.coalesce((F.col("prev_hash") == before) & (F.col("event_hash") == own), F.lit(False)))
    return rows.groupBy(key).agg(F.bool_and("__ok").alias("intact"), F.count("*").alias("n_events"))


def compliance(events: DataFrame, by: list[str], order: str, last: int) -> DataFrame:
    """Counts of the last events by each of some columns; null is 'unknown'."""
    recent = events.orderBy(F.desc(order)).limit(last)
    long = recent.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in by])).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def fact_hash(parts: dict[str, Column]) -> Column:
    """sha256 of the JSON text of string fields in the order of their names; null is null."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), quoted(parts[n])) for n in sorted(parts)])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")).cast("binary"), 256)


def check_proofs(proofs: DataFrame) -> DataFrame:
    """Of (scheme, proof map, signals array, key map): errors, failed checks, and whether the proof is valid.

    The form and the hashes and sums that the key or the proof state are checked; the
    cryptography behind them isn't.
    """
    scheme = F.lower(F.btrim(F.coalesce(F.nullif("scheme", F.lit("")), F.lit("groth16"))))
    get = lambda m, k: F.element_at(F.col(m), F.lit(k))
    present = F.transform(F.map_keys("proof"), F.lower)
    required = F.when(scheme == "plonk", F.array(*map(F.lit, dims.PROOF_FIELDS["plonk"]))).otherwise(F.array(*map(F.lit, dims.PROOF_FIELDS["groth16"])))
    missing = F.array_except(required, present)
    protocol = F.lower(F.btrim(F.coalesce(get("key", "protocol"), F.lit(""))))
    net, wanted = F.get("signals", F.lit(0)), F.coalesce(get("key", "expected_relation_hash"), get("key", "relation_hash"))
    errors = F.concat_ws(
        ";",
        F.when(~scheme.isin(*dims.PROOF_FIELDS), F.concat(F.lit("unsupported_scheme:"), scheme)),
        F.when(F.size("signals") <= 0, "public_signals_empty"),
        F.when(F.size(missing) > 0, F.concat(F.lit("proof_missing_fields:"), F.array_join(missing, ","))),
        F.when((protocol != "") & (protocol != scheme), "verification_key_protocol_mismatch"),
        F.when(net.isNull(), "net_income_missing"),
        F.when(wanted.isNotNull() & get("proof", "relation_hash").isNull(), "relation_hash_missing"),
    )
    sums = get("proof", "revenue").try_cast("double") - get("proof", "expenses").try_cast("double")
    failed = F.concat_ws(
        ";",
        F.when(wanted.isNotNull() & ~F.coalesce(get("proof", "relation_hash") == wanted, F.lit(False)), "relation_hash_match"),
        F.when(sums.isNotNull() & net.isNotNull() & ~F.coalesce(net.try_cast("double") == sums, F.lit(False)), "arithmetic_match"),
    )
    return proofs.withColumns({"errors": errors, "failed": failed}).withColumn("valid", (F.col("errors") == "") & (F.col("failed") == ""))


def mix_tracks(tracks: DataFrame, key: str, crisis: Column) -> DataFrame:
    """Of (role, weight, content) rows: each key's rationale, by falling share, and its leading role.

    In a crisis critic and strategist weigh half as much again; roles without content don't count.
    """
    role = F.lower(F.btrim("role"))
    rows = tracks.select(key, role.alias("role"), "content", (F.col("weight") * F.when(crisis & role.isin("critic", "strategist"), 1.5).otherwise(1.0)).alias("w")).where((F.col("w") > 0) & (F.coalesce("content", F.lit("")) != ""))
    by = rows.groupBy(key).agg(F.sum("w").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("minus"), "role", "content"))).alias("t"))
    segment = lambda x: F.concat(F.upper(x["role"]), F.lit("["), F.format_number(-x["minus"] / F.col("total"), 2), F.lit("]: "), x["content"])
    return by.select(key, F.array_join(F.transform("t", segment), " | ").alias("rationale"), F.get("t", F.lit(0))["role"].alias("dominant"), F.round(-F.get("t", F.lit(0))["minus"] / F.col("total"), 6).alias("share"))
