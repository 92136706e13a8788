"""What the vector searches share: exact integer vectors, and tiles of queries that meet blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import written

#: Queries of a tile, and tiles that meet a block in one cell.
TILE, CELL = 256, 4
_CELL = "block long, group long, kind int, tile long, parts array<binary>"


def exact_vectors(rows: DataFrame, key: str, vector: str, scale: int, label: Column | None = None) -> DataFrame:
    """Written once: row (a number of its own), id, label, v (floor(scale * x) for each component x).

    Left out: vectors that are null or hold a null or non-finite component, and, if ``label`` is given, null labels.
    """
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.lit(0).cast("long") if label is None else label.cast("long")
    kept = rows.where(fine & label.isNotNull())
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return written(kept.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), label.alias("label"), v.alias("v")), "vectors")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers; shorter lists end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), dtype=values.dtype)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers (0 for null), and which aren't null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def packed(sorted_rows: DataFrame, unit: str, most: int, pack: Callable[[pa.Table], list[bytes]], more: dict[str, tuple[str, Callable[[pa.Table], object]]] | None = None) -> DataFrame:
    """Runs of equal ``unit`` within partitions, in pieces of ``most`` rows at most, as rows: unit, parts and ``more``."""
    more = more or {}

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        columns = [pa.array([t[unit][0].as_py()], pa.int64()), pa.array([pack(t)], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns + [pa.array([f(t)]) for _, f in more.values()], ["unit", "parts", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, None
        for batch in batches:
            units = batch.column(batch.schema.get_field_index(unit)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(units[1:] != units[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)], strict=True):
                if n and units[a] != now:
                    yield emit(held)
                    held, n = [], 0
                now = units[a] if b > a else now
                while a < b:
                    part = batch.slice(a, min(b - a, most - n))
                    held.append(part)
                    n, a = n + part.num_rows, a + part.num_rows
                    if n == most:
                        yield emit(held)
                        held, n = [], 0
        if n:
            yield emit(held)

    return sorted_rows.mapInArrow(run, ", ".join(["unit long, parts array<binary>", *(f"{c} {kind}" for c, (kind, _) in more.items())]))


def meetings(blocks: DataFrame, tiles: DataFrame, cells: int, meet: Callable[[list[bytes], list[bytes]], tuple[np.ndarray, ...] | None]) -> DataFrame:
    """(query, id, row, score) from ``meet`` of every tile with the block of its cell.

    ``blocks`` has block, group, parts; ``tiles`` block, group, tile, parts.  A task holds a block and a tile at a time.
    """
    both = blocks.select("block", "group", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("tile"), "parts").unionByName(tiles.select("block", "group", F.lit(1).alias("kind"), "tile", "parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            kinds, parts = batch.column(2).to_pylist(), batch.column(4)
            for k, kind in enumerate(kinds):
                mine = [np.frombuffer(x.as_buffer(), np.uint8) for x in parts[k].values]
                if not kind:
                    block = [x.copy() for x in mine]
                elif (found := meet(block, mine)) is not None:
                    query, ids, known, rows, score = found
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64(), mask=~known), pa.array(rows, pa.int64()), pa.array(score, pa.int64())], ["query", "id", "row", "score"])

    # The number of partitions is given: rows are few and their work is large, so they aren't coalesced by bytes.
    dealt = both.repartition(max(1, min(cells, 20_000)), "block", "group").sortWithinPartitions("block", "group", "kind", "tile")
    return dealt.mapInArrow(run, "query long, id long, row long, score long")


def best(found: DataFrame, k: Column | int) -> DataFrame:
    """Each query's first k rows: highest scores, then smallest ids (null ones last); with their rank."""
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
