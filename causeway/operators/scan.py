"""Running values over ordered keys of any size: segments of a key are reduced, their states scanned, and applied.

Rows are ranged by (key, order), so one key's rows lie in as many tasks as their number asks for.
A segment is what one task holds of a key.  Windows run within segments; what a segment takes over from those before it
is a window over one row for each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.sources.scratch import written

PART, AT = "__part", "__at"


def segments(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` written once in the order of (keys, order), with the task and place of each; equal rows are told apart by arrival."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("__tie")]
    sorted_ = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    out = sorted_.withColumn(AT, F.monotonically_increasing_id())
    return written(out.withColumn(PART, F.shiftright(AT, 33)), "segments")


def _same(keys: list[str]) -> tuple[list[Column], Column]:
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    return names, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]


def running(rows: DataFrame, keys: list[str], **values: tuple[str, Column]) -> DataFrame:
    """Of ``segments``, the running value after each row by kind: sum, max, count, before (the sum without the row), last (not
    null) or lag (the value of the row before)."""
    inside = Window.partitionBy(PART, *keys).orderBy(AT)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = {"sum": F.sum, "max": F.max, "count": F.count}
    own, state = {}, []
    for name, (kind, c) in values.items():
        if kind in whole:
            own[f"__o_{name}"] = whole[kind](c).over(upto)
            state.append(whole[kind](c).alias(name))
        elif kind == "before":
            own[f"__o_{name}"] = F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1))
            state.append(F.sum(c).alias(name))
        elif kind == "last":
            own[f"__o_{name}"] = F.last(c, ignorenulls=True).over(upto)
            state.append(F.max_by(F.when(c.isNotNull(), F.struct(c.alias("v"))), F.when(c.isNotNull(), F.col(AT))).alias(name))
        else:
            own[f"__o_{name}"] = F.lag(F.struct(c.alias("v"))).over(inside)
            state.append(F.max_by(F.struct(c.alias("v")), AT).alias(name))
    names, same = _same(keys)
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"sum": F.sum, "before": F.sum, "count": F.sum, "max": F.max}
    parts = rows.groupBy(F.col(PART).alias("__p"), *names).agg(*state)
    parts = parts.select("__p", *[f"__k{i}" for i in range(len(keys))], *[(carried[kind](n) if kind in carried else F.last(n, ignorenulls=True)).over(before).alias(f"__c_{n}") for n, (kind, _) in values.items()])
    on = F.col(PART) == F.col("__p")
    for c in same:
        on = on & c
    out = rows.withColumns(own).join(parts, on)
    merged = {}
    for name, (kind, _) in values.items():
        o, c = F.col(f"__o_{name}"), F.col(f"__c_{name}")
        if kind in ("sum", "count", "before"):
            merged[name] = F.when(c.isNull(), o).otherwise(c + F.coalesce(o, F.lit(0)))
        elif kind == "max":
            merged[name] = F.greatest(o, c)
        elif kind == "last":
            merged[name] = F.coalesce(o, c["v"])
        else:
            merged[name] = F.coalesce(o, c)["v"]
    return out.withColumns(merged).drop("__p", *[f"__k{i}" for i in range(len(keys))], *[f"__{x}_{n}" for n in values for x in "oc"])


def exponential(rows: DataFrame, keys: list[str], order: list[Column], value: Column, alpha: float) -> DataFrame:
    """The exponential average of each key from 0, in order: a segment is an affine map of the average before it.

    Null and NaN values are left out.
    """
    kept = segments(rows.withColumn("__x", value.cast("double")).where(F.col("__x").isNotNull() & ~F.isnan("__x")), keys, order)
    back = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(F.desc(AT))) - 1
    keep = F.lit(1.0 - alpha)
    parts = kept.withColumn("__n", back.cast("double")).groupBy(PART, *keys).agg(F.pow(keep, F.count("*").cast("double")).alias("a"), F.sum(F.col("__x") * alpha * F.pow(keep, F.col("__n"))).alias("b"))
    # One row for each segment of a key: as many as there are tasks, at most.
    maps = F.array_sort(F.collect_list(F.struct(PART, "a", "b")))
    return parts.groupBy(*keys).agg(F.aggregate(maps, F.lit(0.0), lambda e, m: m["a"] * e + m["b"]).alias("ewma"))


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their place from 0 in the whole order; no task sorts more than its range."""
    placed = segments(rows, [], order)
    counts = placed.groupBy(F.col(PART).alias("__p")).agg(F.count("*").alias("__n"), F.min(AT).alias("__first"))
    # One row for each task.
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__p", "__first", before.alias("__before"))
    return placed.join(counts, F.col(PART) == F.col("__p")).withColumn(name, F.col("__before") + F.col(AT) - F.col("__first")).drop(PART, AT, "__p", "__first", "__before")
