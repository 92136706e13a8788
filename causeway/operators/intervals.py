"""Many points in time against many validity intervals, by an equi join.

An interval is cut into dyadic blocks of days (each of a power of two of days, at a multiple of it): at most two for each
power.  A point lies in one block of each power.  So a point and an interval that holds it share exactly one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block's intervals are dealt to so many parts, as all open intervals may share a few blocks.
SALTS = 8


def as_of_many(edges: DataFrame, points: DataFrame, at: str = "at", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each point with each edge valid at it, both bounds included; a missing bound is open, a null point has none.

    Intervals are cut to the range of the points (two numbers), so an open one makes no more blocks than any other.
    """
    low, high = points.agg(F.min(F.unix_date(F.to_date(at))), F.max(F.unix_date(F.to_date(at)))).first()
    if low is None:
        return edges.join(points, F.lit(False))
    powers = (high - low + 1).bit_length()
    day = lambda c: F.unix_date(F.to_date(c)) - low
    first = F.greatest(F.coalesce(day(F.col(start)), F.lit(0)), F.lit(0))
    after = F.least(F.coalesce(day(F.col(end)), F.lit(high - low)), F.lit(high - low)) + 1
    blocks = []
    for k in range(powers + 1):
        left, right = F.shiftright(F.col("__a") + (1 << k) - 1, k), F.shiftright(F.col("__b"), k)
        blocks.append(F.when((left < right) & (left % 2 == 1), F.struct(F.lit(k).alias("k"), left.alias("i"))))
        blocks.append(F.when((left < right) & (right % 2 == 1), F.struct(F.lit(k).alias("k"), (right - 1).alias("i"))))
    cut = edges.withColumns({"__a": first, "__b": after}).where("__a < __b")
    cut = cut.withColumn("__block", F.explode(F.array_compact(F.array(*blocks)))).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).drop("__a", "__b")
    of_point = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(day(F.col(at)), k).alias("i")) for k in range(powers + 1)])
    asked = points.where(F.col(at).isNotNull()).withColumn("__block", F.explode(of_point)).withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    # The days agree; the bounds themselves may be hours apart.
    held = (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(end) >= F.col(at)))
    return cut.join(asked, ["__block", "__salt"]).where(held).drop("__block", "__salt")
