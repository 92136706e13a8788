"""Sums over a hierarchy of unknown depth, and values reported in the wrong unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.sources.scratch import written

#: A child's value is as far off as the unit it was reported in: thousands and millions, either way.
FACTORS = (1e3, 1e-3, 1e6, 1e-6)
TOLERANCE = 0.01
HEAL = "struct<node: string, f: double, total: double>"


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (node, parent, any more) by height: leaves first, each level a written table.

    The number of levels is that of the deepest branch; a node on a ring of parents, or whose children are, is on none.  A node without a
    name is no one's parent, so it is a leaf.
    """
    left, out = nodes, []
    while True:
        parents = left.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
        level = written(left.join(parents, "node", "left_anti"), "level")
        if level.isEmpty():
            return out
        out.append(level)
        done = level.select(F.col("node").alias("__node"))
        left = written(left.join(done, F.col("node").eqNullSafe(F.col("__node")), "left_anti"), "left")


def reconciled(nodes: DataFrame, heal_children: bool = True) -> DataFrame:
    """Of (node, parent, value): node, parent, value, total, factor and status.

    ``total`` is the healed value: a leaf's own; a node's own where its children's totals add up to it, and their sum otherwise or where it
    has none.  Bottom up, a node whose value differs from that sum by one of FACTORS is healed by it (``factor``, status
    ``scaled``).  Where one child alone, times a factor, makes the sum fit, the child is healed (``scaled`` too); of several such
    children the one that fits best, then the first by name.  Else a node is ``ok``, ``leaf``, ``filled`` or ``broken``; above the leaves
    one without a value is ``filled``, also where none of its children has a total.  Children's sums are added up before they
    travel, so a parent may have any number of children.

    Among hundreds of children some one fits within TOLERANCE by chance, so without ``heal_children`` only parents are healed.
    """
    fits = lambda a, b: F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b))
    factor_of = lambda a, b: F.coalesce(*[F.when(fits(a, b * f), F.lit(f)) for f in FACTORS])
    done, sums = None, None
    children = None
    for level in levels(nodes.select("node", "parent", F.col("value").cast("double").alias("value"))):
        if sums is None:
            now = level.withColumns({"total": F.col("value"), "factor": F.lit(1.0), "status": F.lit("leaf")})
        else:
            own = level.join(sums.withColumnRenamed("parent", "node"), "node", "left")
            value, total = F.col("value"), F.col("child_sum")
            if heal_children:
                # A child that was off by a factor: the rest and the child healed make up the value.
                one = children.join(own.select(F.col("node").alias("parent"), F.col("value").alias("want"), "child_sum"), "parent").where(F.col("want").isNotNull() & ~fits(F.col("want"), F.col("child_sum")))
                one = one.withColumn("f", F.explode(F.array(*map(F.lit, FACTORS)))).withColumn("off", F.abs(F.col("want") - (F.col("child_sum") + F.col("total") * (F.col("f") - 1))))
                one = one.where((F.col("off") <= TOLERANCE * F.abs("want")) & (F.col("total") != 0))
                healed = one.groupBy("parent").agg(F.min_by(F.struct("node", "f", "total"), F.struct("off", "node", "f")).alias("heal"))
                own = own.join(healed.withColumnRenamed("parent", "node"), "node", "left")
            else:
                own = own.withColumn("heal", F.lit(None).cast(HEAL))
            scale = F.when(value.isNotNull() & total.isNotNull() & ~fits(value, total), factor_of(total, value))
            fixed = total + F.col("heal.total") * (F.col("heal.f") - 1)
            now = own.select(
                "node", "parent", "value",
                F.when(total.isNull(), value).when(value.isNull(), total).when(fits(value, total), value).when(scale.isNotNull(), value * scale).when(F.col("heal").isNotNull(), fixed).otherwise(total).alias("total"),
                F.coalesce(F.when(total.isNotNull() & value.isNotNull(), scale), F.lit(1.0)).alias("factor"),
                F.when(value.isNull(), "filled").when(total.isNull(), "leaf").when(fits(value, total), "ok").when(scale.isNotNull(), "scaled").when(F.col("heal").isNotNull(), "ok").otherwise("broken").alias("status"),
                F.when(scale.isNull(), F.col("heal")).alias("heal"),
            )
            now = written(now, "totals")
            if heal_children:
                heals = now.where(F.col("heal").isNotNull()).select(F.col("heal.node").alias("node"), F.col("heal.f").alias("__f"))
                done = written(
                    done.join(heals, "node", "left").select("node", "parent", "value", F.when(F.col("__f").isNull(), F.col("total")).otherwise(F.col("total") * F.col("__f")).alias("total"), (F.col("factor") * F.coalesce("__f", F.lit(1.0))).alias("factor"), F.when(F.col("__f").isNull(), F.col("status")).otherwise("scaled").alias("status")),
                    "healed",
                )
            now = now.drop("heal")
        done = written(now if done is None else done.unionByName(now), "done")
        children = done.where(F.col("parent").isNotNull() & F.col("total").isNotNull())
        sums = children.groupBy("parent").agg(F.sum("total").alias("child_sum"))
    return done if done is not None else nodes.select("node", "parent", F.col("value").cast("double").alias("value")).limit(0).withColumns({"total": F.col("value"), "factor": F.lit(1.0), "status": F.lit("leaf")})
