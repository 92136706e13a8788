"""Market feeds: recognised values, staleness, surprise blending, liquidity stress and regional states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.sources import dims


def recognised(payload: Column) -> dict[str, Column]:
    """The value of each known key in a payload map: of its names' values, the first that is a number."""

    def number(name: str) -> Column:
        v = F.element_at(payload, F.lit(name)).try_cast("double")
        return F.when(~F.isnan(v), v)

    return {key: F.coalesce(*map(number, names)) for key, names in dims.FEED_KEYS.items()}


def snapshots(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """The feed with a column for each known key; rows without any known value don't count."""
    values = recognised(F.col(payload))
    rows = feed.withColumns(values)
    return rows.where(F.coalesce(*values).isNotNull())


def latest(feed: DataFrame, key: str, order: str) -> DataFrame:
    """The last snapshot of each key in order of arrival, whole."""
    return feed.groupBy(key).agg(F.max_by(F.struct(*feed.columns), order).alias("__last")).select("__last.*")


def stale(observed: Column, now: Column, after_seconds: int = 3600) -> Column:
    return F.greatest(F.lit(0), F.timestamp_diff("SECOND", observed, now)) > max(60, after_seconds)


def effective_delta(fallback: Column, is_stale: Column) -> Column:
    """A shock blended with the snapshot's surprise; without a fresh surprise as it was."""
    surprise = F.when(~is_stale, F.coalesce("dot_plot_change", "rate_expectation_change", "policy_rate_change"))
    return F.when(surprise.isNull(), fallback).when(F.abs(fallback) < 1e-6, surprise).otherwise(0.6 * fallback + 0.4 * surprise)


def liquidity_stress(is_stale: Column) -> Column:
    share = lambda c, scale, cap: F.coalesce(F.least(F.abs(F.col(c)) / scale, F.lit(cap)), F.lit(0.0))
    total = F.when(F.col("liquidity_index").isNotNull(), F.col("liquidity_index")).otherwise(share("qt_pace", 100.0, 0.6) + share("rrp_balance", 1500.0, 0.5) + share("policy_rate", 6.0, 0.4))
    return F.when(is_stale, 0.0).otherwise(S.clamp(total, 0.0, 1.0))


def fed_shock(delta: Column) -> dict[str, Column]:
    """What a repricing of the dot plot does to tech valuation and debt service."""
    sign = F.when(delta >= 0, 1.0).otherwise(-1.0)
    return {"tech_valuation": -sign * S.fed_decay(delta) * 0.45, "debt_service_ratio": sign * S.fed_decay(delta) * 0.30}


def patched_state(patches: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Of each region the last value of each field that isn't null."""
    return patches.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])
