"""Event streams in batch form: hash chains, tails, running averages, latest states and regimes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from causeway.operators import scan

GENESIS = "0" * 64


def chain(events: DataFrame, key: str, order: str, payload: str, created: str) -> DataFrame:
    """The hash chain of each key: sha256 of payload | time | previous hash, in order.

    A chain is sequential within a key; keys are spread and sorted by Spark, and only the
    running hash of one key is held, so a key may have any number of events.  A null payload
    or time makes the rest of its chain null.
    """
    text = lambda c: F.col(c).cast("string")
    rows = events.select(F.col(key), F.col(order).alias("__o"), text(payload).alias("__p"), text(created).alias("__c"))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(F.col(key), *[F.col(c).asc_nulls_last() for c in ("__o", "__p", "__c")])
    out = StructType([StructField(key, events.schema[key].dataType), StructField("n_events", LongType()), StructField("head_hash", StringType())])
    kind = to_arrow_schema(out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, head = None, 0, GENESIS
        for batch in batches:
            done = []
            for k, p, c in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if n and k != now and (k == k or now == now):  # NaN is one key
                    done.append((now, n, head))
                    n, head = 0, GENESIS
                now, n = k, n + 1
                head = None if p is None or c is None or head is None else hashlib.sha256(f"{p}|{c}|{head}".encode()).hexdigest()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, n, head), kind, strict=True)], schema=kind)

    return rows.select(key, "__p", "__c").mapInArrow(fold, out)


def chained(events: DataFrame, key: str, order: str, payload: str, created: str) -> DataFrame:
    """Every event with the hash before it and its own, as ``chain`` folds them; orders and times as they are given."""
    text = lambda c: F.col(c).cast("string")
    rows = events.select(F.col(key), F.col(order), text(payload).alias(payload), text(created).alias(created))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(F.col(key), *[F.col(c).asc_nulls_last() for c in (order, payload, created)])
    out = StructType([*rows.schema, StructField("prev_hash", StringType()), StructField("event_hash", StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, started = None, GENESIS, False
        for batch in batches:
            before, own = [], []
            for k, p, c in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not started or (k != now and (k == k or now == now)):
                    now, head, started = k, GENESIS, True
                before.append(head)
                head = None if p is None or c is None or head is None else hashlib.sha256(f"{p}|{c}|{head}".encode()).hexdigest()
                own.append(head)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=out.names)

    return rows.mapInArrow(fold, out)


def tail(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` events of each key."""
    return events.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def ewma(events: DataFrame, key: str, order: str, value: str, alpha: float = 0.2) -> DataFrame:
    """Exponential average of each key from 0, in order; a key of any number of events is spread over tasks."""
    return scan.exponential(events.select(key, order, value), [key], [F.col(order)], F.col(value), alpha)


def regime(rows: DataFrame, key: str, impact: Column, node: Column | None = None) -> DataFrame:
    """Regime of each key from its impacts: the largest, their sum, how many are significant, and that on the node ``geopolitical_risk``."""
    a = F.abs(impact)
    risk = F.lit(False) if node is None else node == "geopolitical_risk"
    stats = rows.groupBy(key).agg(F.max(a).alias("m"), F.sum(a).alias("s"), F.count_if(a >= 0.1).alias("hits"), F.max(F.when(risk, a)).alias("g"))
    return stats.select(key, F.when((F.col("m") >= 0.6) | (F.col("s") >= 1.5) | (F.col("hits") >= 6), "Crisis").when((F.col("m") >= 0.3) | (F.col("hits") >= 4) | (F.col("g") >= 0.25), "High Volatility").otherwise("none").alias("regime"), "hits")
