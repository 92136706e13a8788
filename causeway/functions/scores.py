"""Column builders: text normalisation, numeric parsing and the scores of facts and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether the text holds one of the terms anywhere, also inside words."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def node_id(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_"))


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-_/,.():", "        "), "\\s+", " "))


def parse_number(text: Column) -> Column:
    """Digits, points and minus signs of a messy number, after common misreadings are mended; null if none parses."""
    token = F.regexp_replace(F.translate(F.replace(text, F.lit(","), F.lit("")), "OolISB", "001158"), "[^0-9.\\-]", "")
    return token.try_cast("double")


def granularity(period: Column) -> Column:
    low = F.lower(period)
    return (
        F.when(F.coalesce(period, F.lit("")) == "", "day")
        .when(F.contains(low, F.lit("q")) & low.rlike("[0-9]"), "quarter")
        .when(period.rlike("^[0-9]{4}$"), "year")
        .when((F.length(period) >= 7) & F.substring(period, 5, 1).isin("-", "/"), "month")
        .otherwise("day")
    )


def confidence_bonus(confidence: Column) -> Column:
    low = F.lower(F.coalesce(confidence, F.lit("")))
    return F.when(low == "high", 0.25).when(low == "medium", 0.15).when(low == "low", 0.05).otherwise(0.0)


def temporal_quality(event_time: Column, valid_from: Column, valid_to: Column, grain: Column) -> Column:
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return clamp(0.2 + part(event_time.isNotNull(), 0.35) + part(valid_from.isNotNull(), 0.25) + part(valid_to.isNotNull(), 0.1) + part(grain.isin("quarter", "month", "day"), 0.1), 0.0, 1.0)


def base_strength(confidence: Column, reflection: Column, temporal: Column) -> Column:
    return clamp(0.35 + confidence_bonus(confidence) + 0.2 * clamp(reflection, 0.0, 1.0) + 0.2 * clamp(temporal, 0.0, 1.0), 0.05, 0.98)


def temporal_decay(grain: Column) -> Column:
    return F.when(grain == "year", 0.9).when(grain == "quarter", 0.85).when(grain == "month", 0.78).otherwise(0.7)


def contagion_velocity(grain: Column, severity: Column, shock: Column, volatility: Column, connectivity: Column, liquidity: Column) -> Column:
    regime = F.when(severity == 2, 1.35).when(severity == 1, 1.15).otherwise(1.0)
    return clamp(
        temporal_decay(grain) * regime * (1 + F.least(F.lit(0.4), 0.4 * F.abs(shock))) * (1 + F.least(F.lit(0.5), 6 * volatility))
        * F.when(connectivity > 0, 1 + 0.15 * F.least(connectivity, F.lit(5.0)) / 5).otherwise(1.0) * (1 + 0.3 * clamp(liquidity, 0.0, 1.0)),
        0.05, 1.0,
    )


def edge_confidence(support: Column, equation: Column) -> Column:
    """Trust in a link: repeated evidence, which is also a consensus of sources, and a structural equation."""
    repeated = F.when(support >= 3, 1.08 * 1.03).when(support == 2, 1.04 * 1.03).otherwise(1.0)
    return clamp(repeated * F.when(equation != "", 1.02).otherwise(1.0), 0.9, 1.15)


def market_weight(risk: Column, fx: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + 0.4 * risk + 0.6 * fx)


def first_text(*columns: Column) -> Column:
    """The first column, as trimmed text, that isn't null or empty; null without any."""
    return F.coalesce(*(F.nullif(F.btrim(c.cast("string"), F.lit(" \t\n\r\x0b\x0c")), F.lit("")) for c in columns))


def parse_date(text: Column) -> Column:
    """A date in one of the usual spellings as an instant without zone (UTC); null for others."""
    t = F.btrim(text)
    same = F.when(t.rlike("^[0-9]{4}(/[0-9]{1,2}){1,2}$"), F.replace(t, F.lit("/"), F.lit("-"))).otherwise(t)
    part = lambda k: F.lpad(F.get(F.split(same, "-"), F.lit(k)), 2, "0")
    monday = F.date_trunc("week", F.concat(F.substring(t, 1, 4), F.lit("-01-04")).cast("timestamp_ntz"))
    return (
        F.when(same.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.concat_ws("-", F.substring(same, 1, 4), part(1), part(2)).try_cast("timestamp_ntz"))
        .when(same.rlike("^[0-9]{4}-[0-9]{1,2}$"), F.concat_ws("-", F.substring(same, 1, 4), part(1), F.lit("01")).try_cast("timestamp_ntz"))
        .when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("timestamp_ntz"))
        .when(t.rlike("^[0-9]{4}-W(0[1-9]|[1-4][0-9]|5[0-3])$"), (monday.cast("date") + 7 * (F.substring(t, 7, 2).try_cast("int") - 1)).cast("timestamp_ntz"))
        .when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?Z?$"), F.rtrim(F.translate(t, "TZ", " ")).try_cast("timestamp_ntz"))
    )


def parse_period(period: Column) -> Column:
    """The first instant of a year, of a quarter (its year is the first four digits of the text), or of a date."""
    t = F.btrim(period)
    year = F.substring(F.regexp_replace(t, "[^0-9]", ""), 1, 4)
    out = F.when(t.rlike("^[0-9]{4}$"), F.concat(t, F.lit("-01-01")).try_cast("timestamp_ntz"))
    for k in (1, 2, 3, 4):
        out = out.when(F.contains(F.upper(t), F.lit(f"Q{k}")) & (F.length(year) == 4), F.concat(year, F.lit(f"-{3 * k - 2:02}-01")).try_cast("timestamp_ntz"))
    return out.otherwise(parse_date(t))


def reflection_quality(confidence: Column, issues: Column, rounds: Column, repair_ratio: Column) -> Column:
    """Trust in a fact after reflection: its confidence, the number of its issues, the rounds and the share that was kept."""
    return clamp(
        0.5 + confidence_bonus(confidence) - F.least(F.coalesce(issues, F.lit(0)) * 0.08, F.lit(0.24))
        + F.least(F.greatest(rounds, F.lit(0)) * 0.03, F.lit(0.09)) + 0.06 * clamp(repair_ratio, 0.0, 1.0),
        0.0, 1.0,
    )


def edge_weight(statement: Column, status: Column, anchored: Column, temporal: Column, reflection: Column) -> Column:
    """Weight of a fact's edge; a fact without a source anchor loses a fifth."""
    bonus = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    total = 0.25 + bonus(statement != "", 0.1) + bonus(status == "reflected", 0.05) + 0.3 * temporal + 0.3 * reflection
    return F.round(clamp(total * F.when(F.coalesce(anchored, F.lit(False)), 1.0).otherwise(0.8), 0.05, 0.98), 4)


def fed_decay(delta: Column) -> Column:
    return 1 - F.exp(-2.4 * F.abs(delta))


def stability(connectivity: Column) -> Column:
    return clamp(100 / (1 + 2 * connectivity), 0.0, 100.0)


def rescaled(value: Column) -> Column:
    """Billions from raw units; what is still over 1000 or under 0.0001 moves by thousands."""
    v = value / 1e9
    for _ in range(3):
        v = F.when(F.abs(v) > 1000, v / 1000).otherwise(v)
    return F.when((v != 0) & (F.abs(v) < 1e-4), v * 1000).otherwise(v)


def disposition(score: Column) -> Column:
    return F.when(score >= 80, "Approve").when(score >= 65, "Conditional").otherwise("Escalate")


def object_type(label: Column, role: str, relation: Column) -> Column:
    """The kind of business object that a normal label names."""
    low = F.lower(relation)
    kind = F.when(label == "", "metric" if role == "tail" else "entity")
    kind = kind.when(has_any(label, ("inc", "corp", "ltd", "plc", "company", "holdings")), "company")
    kind = kind.when(has_any(label, ("event", "meeting", "filing", "guidance", "announcement")), "event")
    if role == "tail":
        kind = kind.when(has_any(low, ("reported", "states", "mentions")), "observation").when(label.rlike("[0-9]"), "measurement")
    kind = kind.when(has_any(label, ("rate", "yield", "spread", "growth", "valuation", "inflation")), "metric")
    return kind.otherwise("entity" if role == "head" else "metric")


def predicate(relation: Column) -> Column:
    rel = normal_text(relation)
    return (
        F.when(rel == "", "related_to").when(has_any(rel, ("drives", "causes")), "causally_influences")
        .when(has_any(rel, ("reported", "states")), "observes").when(F.contains(rel, F.lit("correlates")), "correlates_with").otherwise(F.replace(rel, F.lit(" "), F.lit("_")))
    )
