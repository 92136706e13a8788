"""The k strongest root-cause paths by branch and bound: levels of paths are tables, and what can't reach the k-th is cut.

A path's influence is the product of its links' factors, none above 1, so it bounds whatever the path grows into.  A node
with so many links back that no path can use them all is never an end before the last level, so there the
best factors of the levels to come bound it further.  A first pass that keeps only the strongest
paths of each level gives k whole paths, whose influence is the bound of the second, which is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.sources.scratch import written

BEAM = 256


def _back(links: DataFrame) -> DataFrame:
    factor = F.col("strength") * S.temporal_decay(F.col("granularity")) * F.col("polarity")
    noise = ((1 - S.clamp(F.col("strength"), 0.05, 0.98)) + F.coalesce("noise_sigma", F.lit(0.2))) * 0.04 / F.greatest(F.coalesce("support_count", F.lit(1)), F.lit(1))
    return links.select("head", "tail", factor.alias("f"), noise.alias("v")).where((F.abs("f") >= 1e-12) & (F.col("head") != ""))


def _ahead(back: DataFrame, depth: int) -> list[DataFrame]:
    """For 0 to ``depth`` links more: (node, h), the best product that a path which stands at the node may still take on."""
    into = back.groupBy("tail").agg(F.count_distinct("head").alias("n"))
    hub = into.where(F.col("n") > depth).select("tail")
    out = [hub.select(F.col("tail").alias("node"), F.lit(1.0).alias("h"))]
    steps = written(back.join(hub, "tail", "left_semi").groupBy("head", "tail").agg(F.max(F.abs("f")).alias("f")), "steps")
    for _ in range(depth):
        best = steps.join(out[-1].withColumnRenamed("node", "head"), "head", "left")
        out.append(written(best.groupBy(F.col("tail").alias("node")).agg(F.max(F.col("f") * F.coalesce("h", F.lit(1.0))).alias("h")), "ahead"))
    return out


def best_paths(links: DataFrame, target: str, k: int = 3, depth: int = 6, beam: int = BEAM) -> DataFrame:
    """The k maximal paths back from a node with the most influence (ties by path): path (root first), influence, direction, and a 95 % interval.

    A path ends where no link leads further back without a node it has already, or at ``depth``.  Links have head, tail, strength,
    polarity, granularity, noise_sigma and support_count.  A level holds the paths whose bound reaches the k-th best known.
    """
    back = written(_back(links), "back")
    ahead = _ahead(back, depth)
    spark = links.sparkSession

    def search(least: float, keep: int | None) -> DataFrame:
        open_ = spark.createDataFrame([([target], 1.0, 1.0, 0.0)], "path array<string>, influence double, direction double, variance double")
        names, done = open_.columns, open_.limit(0)
        for level in range(depth):
            grown = open_.join(back, (F.get("path", F.lit(0)) == F.col("tail")) & ~F.array_contains("path", F.col("head")), "left")
            grown = written(grown, "grown")
            done = done.unionByName(grown.where("f is null").select(*names))
            next_ = grown.where("f is not null").select(F.concat(F.array("head"), "path").alias("path"), (F.col("influence") * F.abs("f")).alias("influence"), (F.col("direction") * F.col("f")).alias("direction"), (F.col("variance") + F.col("v")).alias("variance"))
            bound = next_.join(ahead[depth - level - 1].withColumnRenamed("node", "__n"), F.get("path", F.lit(0)) == F.col("__n"), "left").withColumn("__b", F.col("influence") * F.coalesce("h", F.lit(1.0)))
            # Rounded products may differ in their last digits by the order of their factors.
            open_ = bound.where(F.col("__b") >= least * (1 - 1e-9))
            if keep:
                open_ = open_.orderBy(F.desc("__b"), "path").limit(keep)
            open_ = open_.select(*names)
        return done.unionByName(open_)

    order = [F.desc("influence"), F.array_join("path", ">")]
    # k influences at most reach the driver.
    known = [r[0] for r in search(0.0, beam).orderBy(*order).limit(k).select("influence").collect()]
    found = search(known[-1] if len(known) == k else 0.0, None).orderBy(*order).limit(k)
    margin, alone = 1.96 * F.sqrt("variance"), (F.size("path") == 1) | (F.col("influence") <= 0)
    return found.select(
        "path", "influence", "direction", F.when(alone, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("influence") - margin)).alias("lower"),
        F.when(alone, F.greatest(F.col("influence"), F.lit(0.0))).otherwise(F.col("influence") + margin).alias("upper"),
    )
