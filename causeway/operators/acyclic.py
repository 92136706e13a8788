"""The acyclic choice over a graph of any size: components in Spark, the greedy choice within each.

A link between two strongly connected components lies on no cycle, so it is kept at once.  Only the links within a component
go to a task together, where an order of the nodes is kept up to date as links are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.sources.scratch import written


def _live(e: DataFrame) -> DataFrame:
    """Without links from nodes that none leads to, or to nodes that none leaves."""
    for _ in range(2):
        e = e.join(e.select(F.col("t").alias("h")).distinct(), "h", "left_semi")
        e = e.join(e.select(F.col("h").alias("t")).distinct(), "t", "left_semi")
    return e.select("h", "t")


def _same(a: DataFrame, b: DataFrame) -> bool:
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))).first())
    return state(a) == state(b)


def strong_components(links: DataFrame, head: str = "head", tail: str = "tail") -> DataFrame:
    """(node, component) of the nodes on cycles; a component has the name of its least node that leads to all of it.

    Each round, names spread forward (a node takes the least of those that lead to it) and membership backward within a name;
    the components found leave, and so do links between names.  Rounds are written tables; they grow with the
    depth of the component structure and the longest shortest path.
    """
    live = written(_live(links.select(F.col(head).alias("h"), F.col(tail).alias("t")).where("h != t").distinct()), "live")
    found = None
    while not live.isEmpty():
        names = written(live.select(F.explode(F.array("h", "t")).alias("node")).distinct().withColumn("name", F.col("node")), "names")
        while True:
            come = live.join(names, F.col("h") == F.col("node")).select(F.col("t").alias("node"), "name")
            spread = names.unionByName(come).groupBy("node").agg(F.min("name").alias("name"))
            new = written(spread, "names")
            if _same(new, names):
                break
            names = new
        inside = live.join(names.select(F.col("node").alias("h"), F.col("name").alias("nh")), "h").join(names.select(F.col("node").alias("t"), F.col("name").alias("nt")), "t")
        inside = written(inside.where("nh = nt").select("h", "t", F.col("nh").alias("name")), "inside")
        reached = frontier = written(names.where("node = name"), "reached")
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("node").alias("t"), "name"), ["t", "name"]).select(F.col("h").alias("node"), "name").distinct()
            frontier = written(back.join(reached, ["node", "name"], "left_anti"), "frontier")
            reached = reached.unionByName(frontier)
        reached = written(reached, "components")
        found = reached if found is None else found.unionByName(reached)
        rest = inside.join(reached.select(F.col("node").alias("h")), "h", "left_anti").join(reached.select(F.col("node").alias("t")), "t", "left_anti")
        live = written(_live(rest.select("h", "t")), "live")
    if found is None:
        return links.sparkSession.createDataFrame([], "node string, component string")
    of = found.groupBy("name").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(of, "name", "left_semi").select("node", F.col("name").alias("component"))


class Order:
    """An order of the nodes of an acyclic graph that links are added to one by one (Pearce and Kelly, 2006)."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.after: dict[str, set[str]] = {}
        self.before: dict[str, set[str]] = {}

    def add(self, h: str, t: str) -> bool:
        """Adds a link, unless it closes a cycle; only nodes placed between the two ends are looked at."""
        for x in (h, t):
            if x not in self.place:
                self.place[x], self.after[x], self.before[x] = len(self.place), set(), set()
        if h == t:
            return False
        if t in self.after[h]:
            return True
        low, high = self.place[t], self.place[h]
        if low < high:
            ahead, todo = {t}, [t]
            while todo:
                for y in self.after[todo.pop()]:
                    if y == h:
                        return False
                    if self.place[y] < high and y not in ahead:
                        ahead.add(y)
                        todo.append(y)
            behind, todo = {h}, [h]
            while todo:
                for y in self.before[todo.pop()]:
                    if self.place[y] > low and y not in behind:
                        behind.add(y)
                        todo.append(y)
            moved = sorted(behind, key=self.place.__getitem__) + sorted(ahead, key=self.place.__getitem__)
            for x, p in zip(moved, sorted(self.place[x] for x in moved), strict=True):
                self.place[x] = p
        self.after[h].add(t)
        self.before[t].add(h)
        return True


def acyclic(links: DataFrame, order: str = "first_seq") -> DataFrame:
    """The links (head, tail, strength, ``order``, any more) that a greedy choice by falling strength, then arrival, keeps without a cycle.

    Parallel links of other relations are kept with the first; a link of a node to itself isn't.
    """
    links = written(links.where("head != '' and tail != '' and head != tail"), "links")
    of = written(strong_components(links), "components")
    placed = links.join(of.select(F.col("node").alias("head"), F.col("component").alias("__h")), "head", "left").join(of.select(F.col("node").alias("tail"), F.col("component").alias("__t")), "tail", "left")
    placed = written(placed.withColumn("__in", F.coalesce(F.col("__h") == F.col("__t"), F.lit(False))), "placed")
    names = links.columns
    # Within a component the choice needs each pair's best link alone: parallel ones share its fate.
    pairs = placed.where("__in").groupBy(F.col("__h").alias("component"), "head", "tail").agg(F.min(F.struct((-F.col("strength")).alias("s"), F.col(order).alias("o"))).alias("best")).select("component", "head", "tail", "best.s", "best.o")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Order()
        for batch in batches:
            kept = []
            for c, h, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != now:
                    now, state = c, Order()
                if state.add(h, t):
                    kept.append((h, t))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.string()) for i in (0, 1)], ["head", "tail"])

    chosen = pairs.repartition("component").sortWithinPartitions("component", "s", "o", "head", "tail").mapInArrow(choose, "head string, tail string")
    return placed.where("not __in").select(*names).unionByName(placed.where("__in").join(chosen, ["head", "tail"], "left_semi").select(*names))


def forecast(links: DataFrame, n: int = 10) -> DataFrame:
    """The strongest links of the acyclic graph, ties by arrival."""
    return acyclic(links).orderBy(F.desc("strength"), "first_seq").limit(n)
