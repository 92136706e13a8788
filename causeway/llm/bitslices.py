"""Operator 12, exact top-k search on a bit-sliced index.

Rows are dealt to blocks of about BLOCK rows, sorted by id.  A block holds, for each attribute, the
slices of its values over the block's least one: slice b is the bitmap of the rows whose value has bit b.

A query's score is a sum of attributes times whole weights, so it is a sum of slices, each at the power of two of
its own bit and of a bit of the weight (complements of slices where the weight is negative; what that adds is one number for the
query).  Bitmaps of one power are added with full adders: three bitmaps become a sum at this power and a carry
at the next, for all rows of a block and several queries at a time.  The sum's slices are read
from the most significant one down: rows that have the bit are kept while at least k have it, else they are certain and the
rest go on.  Rows that are equal in all slices at the boundary are resolved by id.
A block gives each query at most k rows, and the first k of all blocks' are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import table, written
from causeway.llm.vectors import CELL, TILE, best, exact_vectors, longs, matrix, meetings, packed

BLOCK = 8192
#: Queries whose bitmaps are added together.
STEP = 32


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and number of slices of each attribute, and the slices as words of 64 rows."""
    n, d = values.shape
    low = values.min(axis=0) if d else np.zeros(0, np.int64)
    over = values.astype(np.uint64) - low.astype(np.uint64)
    widths = np.array([int(x).bit_length() for x in over.max(axis=0)] if d else [], dtype=np.uint8)
    out = np.zeros((int(widths.sum()), -(-n // 64) * 8), dtype=np.uint8)
    at = 0
    for j, w in enumerate(widths.tolist()):
        for b in range(w):
            bits = np.packbits((over[:, j] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
            out[at, : len(bits)] = bits
            at += 1
    return low, widths, out.view("<u8")


def plan(weights: np.ndarray, low: np.ndarray, widths: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """For each power of two, the bitmaps each query adds (a row of ``[slices, complements, zeros]``), and each query's constant."""
    first = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
    total = int(first[-1])
    size = np.abs(weights).astype(np.uint64)
    parts: dict[int, list[np.ndarray]] = {}
    for b in range(int(size.max(initial=0)).bit_length()):
        has = (size >> np.uint64(b) & np.uint64(1)).astype(bool)
        for i in range(int(widths.max(initial=0))):
            at = np.flatnonzero(widths > i)
            which = np.where(weights[:, at] > 0, first[at] + i, first[at] + i + total)
            parts.setdefault(b + i, []).append(np.where(has[:, at], which, 2 * total))
    out = []
    for power in range(max(parts, default=-1) + 1):
        which = np.concatenate(parts[power], axis=1)
        which = np.sort(which, axis=1)  # the zeros come last
        out.append(which[:, : int((which < 2 * total).sum(axis=1).max(initial=0))])
    low, most = [int(x) for x in low], [(1 << int(w)) - 1 for w in widths]
    return out, [sum(w * (a if w > 0 else a + m) for w, a, m in zip(map(int, ws), low, most, strict=True)) for ws in weights]


def added(powers: list[np.ndarray], bitmaps: np.ndarray) -> list[np.ndarray]:
    """The slices of each query's sum, by full adders from the least power up."""
    out, carried = [], []
    power = 0
    while power < len(powers) or carried:
        x = bitmaps[powers[power]] if power < len(powers) else carried[0][:, :0]
        x = np.concatenate([x, *carried], axis=1)
        carried = []
        while x.shape[1] > 2:
            t = x.shape[1] // 3
            a, b, c, rest = x[:, :t], x[:, t : 2 * t], x[:, 2 * t : 3 * t], x[:, 3 * t :]
            either = a ^ b
            carried.append(a & b | either & c)
            x = np.concatenate([either ^ c, rest], axis=1)
        if x.shape[1] == 2:
            carried.append(x[:, :1] & x[:, 1:])
            x = x[:, :1] ^ x[:, 1:]
        out.append(x[:, 0] if x.shape[1] else np.zeros((len(x), bitmaps.shape[1]), bitmaps.dtype))
        power += 1
    return out


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def selected(slices: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps of each query's k highest rows among ``rows``; equal ones at the boundary by their place."""
    open_, certain = rows.copy(), np.zeros_like(rows)
    need = np.full(len(rows), k, dtype=np.int64)
    for s in reversed(slices):
        on = open_ & s
        n = _count(on)
        narrow = (n >= need)[:, None]
        certain |= np.where(narrow, 0, on)
        need = np.where(narrow[:, 0], need, need - n)
        open_ = np.where(narrow, on, open_ & ~s)
    bits = np.unpackbits(open_.view(np.uint8), axis=1, bitorder="little")
    bits &= np.cumsum(bits, axis=1, dtype=np.int32) <= need[:, None]
    return certain | np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _meet(k: int, dims: int):
    def meet(block: list[np.ndarray], tile: list[np.ndarray]):
        ids, known, rows, low, widths, slices = (x.view(t) for x, t in zip(block, ("<i8", bool, "<i8", "<i8", np.uint8, "<u8"), strict=True))
        queries, weights = tile[0].view("<i8"), tile[1].view("<i8").reshape(-1, dims)
        n, words = len(ids), -(-len(ids) // 64)
        slices = slices.reshape(-1, words)
        bitmaps = np.concatenate([slices, ~slices, np.zeros((1, words), "<u8")])
        valid = np.zeros(words * 64, dtype=np.uint8)
        valid[:n] = 1
        valid = np.packbits(valid, bitorder="little").view("<u8")
        place = {int(r): i for i, r in enumerate(rows)}
        out = []
        for a in range(0, len(queries), STEP):
            mine = queries[a : a + STEP]
            powers, constant = plan(weights[a : a + STEP], low, widths)
            sums = added(powers, bitmaps)
            may = np.repeat(valid[None], len(mine), axis=0)
            for i, q in enumerate(mine.tolist()):
                if (p := place.get(q)) is not None:
                    may[i, p >> 6] &= ~np.uint64(1 << (p & 63))
            query, row = np.nonzero(np.unpackbits(selected(sums, may, k).view(np.uint8), axis=1, bitorder="little"))
            score = np.array([constant[i] for i in query], dtype=object)
            for power, s in enumerate(sums):
                score += (s[query, row >> 6] >> (row & 63).astype(np.uint64) & np.uint64(1)).astype(object) << power
            out.append((mine[query], ids[row], known[row], rows[row], score.astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None

    return meet


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of each query (row, v) the k rows of ``vectors`` (row, id, v) with the highest inner products, except itself.

    Returns query (its row number), id, row, score, rank (from 1; ties by smaller id, null ids last).  Both have
    been made by ``exact_vectors``.  Shorter vectors end in zeros; rows that share an id are rows of their own;
    scores must fit 64 bits.  Every query meets every row, in blocks.
    """
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m = queries.count()
    n_blocks, n_tiles = max(1, -(-n // BLOCK)), max(1, -(-m // TILE))
    groups = -(-n_tiles // CELL)

    def block(t: pa.Table) -> list[bytes]:
        ids, known = longs(t["id"].combine_chunks())
        return [x.tobytes() for x in (ids, known, longs(t["row"].combine_chunks())[0], *sliced(matrix(t["v"].combine_chunks(), dims).astype(np.int64)))]

    def tile(t: pa.Table) -> list[bytes]:
        return [x.tobytes() for x in (longs(t["row"].combine_chunks())[0], matrix(t["v"].combine_chunks(), dims).astype(np.int64))]

    _long = lambda x: F.lit(x).cast("long")
    number = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).alias("unit")
    dealt = vectors.select(number(n_blocks), "id", "row", "v").repartition(min(n_blocks, 20_000), "unit").sortWithinPartitions("unit", F.col("id").asc_nulls_last(), "row")
    index = written(packed(dealt, "unit", 1 << 40, block), "slices")
    asked = packed(queries.select(number(n_tiles), "row", "v").repartition("unit").sortWithinPartitions("unit", "row"), "unit", TILE, tile)
    asked = written(asked.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    blocks = index.withColumnRenamed("unit", "block").withColumn("group", F.explode(F.sequence(_long(0), _long(groups - 1))))
    tiles = asked.withColumn("group", F.col("unit") % groups).withColumn("block", F.explode(F.sequence(_long(0), _long(n_blocks - 1))))
    return best(meetings(blocks, tiles, n_blocks * groups, _meet(k, dims)), k)


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20, over the whole ``embeddings``.

    Vectors that are null or hold a null or non-finite component take no part, and null ids don't ask; an empty
    table gives no rows; other columns aren't read.
    """
    vectors = exact_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    queries = vectors.where(F.col("id") % 20 == 0)
    found = top_k(vectors, queries, 20)
    names = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return found.join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


_VECTORS = """select vec_id as id, {label} as label, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as v, row_number() over () as r
 from embeddings where {labelled} embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""
OP12_SQL = f"""
with vectors as ({_VECTORS.format(label="0", scale=64, labelled="")}),
scored as (
 select q.id as query_id, q.r, c.id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
 from vectors q join vectors c on q.r != c.r where q.id % 20 = 0
)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify rank <= 20
"""
