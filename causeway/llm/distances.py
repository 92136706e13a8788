"""Operator 11, hard-negative mining over one-dimensional distance keys.

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared length, and queries a zero: then the
distance to a query orders rows as their inner product with it does, the nearest first.  Each row belongs to its nearest
pivot, and its key is the distance to it.  Rows are stored sorted by (pivot, key), in blocks.

A row at distance r from the query has a key within r of the query's distance to the pivot.  So a search reads the
intervals of all pivots around the query's distances, annuli that grow from round to round, until the
radius reaches the distance of the k-th row found: what is left is farther.  Where a floor on the score is
given the radius ends there, and where a ceiling is, blocks that lie wholly within its distance are left out.  Each
round reads the blocks that the query hasn't read, and the scores of what it reads are whole numbers.

Positives are a search among rows of the anchor's label, negatives one for each positive among the others, with
the positive's score as ceiling and four fifths of it as floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import discard, table, written
from causeway.llm.vectors import CELL, TILE, best, exact_vectors, longs, matrix, meetings, packed

#: Pivots, the rows of the sample they are fitted on (by k-means), and its rounds.
PIVOTS, SAMPLE, ROUNDS = 16, 2048, 8
BLOCK = 4096
#: Blocks are dealt to so many salts where tiles look for them.
SALTS = 16
#: First radius as a share of the largest distance from a pivot to a row of the sample.
FIRST = 0.1
#: Keys and distances are rounded sums: compared with this slack, relative to the scale of the data.
SLACK = 1e-9
_QUERY = "query long, id long, row long, label long, v array<long>, same boolean, low long, high long, k int"


class Space:
    """The augmented space: the largest squared length, the pivots, and distances in it."""

    def __init__(self, most: float, pivots: np.ndarray, reach: float):
        self.most, self.pivots, self.reach = most, pivots, reach

    def augmented(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.concatenate([v, np.sqrt(np.maximum(self.most - (v * v).sum(axis=1, keepdims=True), 0))], axis=1)

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None, :] - self.pivots[None]) ** 2).sum(axis=2))

    def of_query(self, v: np.ndarray) -> np.ndarray:
        return self.to_pivots(np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1))

    def radius(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which rows have this inner product with the query."""
        square = (v.astype(np.float64) ** 2).sum(axis=1) + self.most
        return np.sqrt(np.maximum(square - 2.0 * score, 0)) + SLACK * np.sqrt(square)


def fitted(vectors: DataFrame, dims: int) -> Space:
    """Pivots by k-means on SAMPLE rows, those of the least hash; the index holds every row."""
    most = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0] or 0.0
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    x = Space(most, np.zeros((1, dims + 1)), 0.0).augmented(matrix(sample["v"].combine_chunks(), dims))
    pivots = x[np.unique(x, axis=0, return_index=True)[1][:: max(1, len(x) // PIVOTS)][:PIVOTS]] if len(x) else np.zeros((1, dims + 1))
    space = Space(most, pivots, 0.0)
    for _ in range(ROUNDS if len(x) else 0):
        near = space.to_pivots(x).argmin(axis=1)
        space.pivots = np.array([x[near == p].mean(axis=0) if (near == p).any() else space.pivots[p] for p in range(len(space.pivots))])
    space.reach = float(space.to_pivots(x).max()) if len(x) else 0.0
    return space


def index(vectors: DataFrame, space: Space, dims: int) -> DataFrame:
    """Blocks of rows sorted by (pivot, key): block, pivot, lo, hi (keys), parts."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.to_pivots(space.augmented(matrix(batch.column(3), dims)))
            pivot = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int64()), pa.array(d[np.arange(len(d)), pivot])], ["row", "id", "label", "v", "pivot", "key"])

    def pack(t: pa.Table) -> list[bytes]:
        ids, known = longs(t["id"].combine_chunks())
        return [x.tobytes() for x in (ids, known, longs(t["row"].combine_chunks())[0], longs(t["label"].combine_chunks())[0], matrix(t["v"].combine_chunks(), dims).astype(np.int64), np.array([t["pivot"][0].as_py()], np.int64), np.array([t["key"][0].as_py(), t["key"][-1].as_py()]))]

    rows = vectors.select("row", "id", "label", "v").mapInArrow(keyed, "row long, id long, label long, v array<long>, pivot long, key double")
    rows = rows.repartitionByRange("pivot", "key", "row").sortWithinPartitions("pivot", "key", "row")
    blocks = packed(rows, "pivot", BLOCK, pack, {"lo": ("double", lambda t: t["key"][0].as_py()), "hi": ("double", lambda t: t["key"][-1].as_py())})
    return written(blocks.select(F.monotonically_increasing_id().alias("block"), F.col("unit").alias("pivot"), "lo", "hi", "parts"), "index")


def _wanted(d: np.ndarray, radius: np.ndarray, lo: float, hi: float, slack: float) -> np.ndarray:
    """Whether the annulus of ``radius`` around each query meets the keys of a block; d: distances to its pivot."""
    return (d - radius <= hi + slack) & (d + radius >= lo - slack)


def _meet(space: Space, dims: int):
    def meet(block: list[np.ndarray], tile: list[np.ndarray]):
        ids, known, rows, labels, v, pivot, keys = (x.view(t) for x, t in zip(block, ("<i8", bool, "<i8", "<i8", "<i8", "<i8", "<f8"), strict=True))
        query, own, of, q, same, low, high, k, before, now = (x.view(t) for x, t in zip(tile, ("<i8", "<i8", "<i8", "<i8", bool, "<i8", "<i8", "<i4", "<f8", "<f8"), strict=True))
        v, q = v.reshape(-1, dims), q.reshape(-1, dims)
        d, slack = space.of_query(q)[:, pivot[0]], SLACK * (1 + np.sqrt(space.most))
        inside = d + keys[1] + slack < space.radius(q, high.astype(np.float64)) - 2 * SLACK * np.sqrt(space.most)
        at = np.flatnonzero(_wanted(d, now, *keys, slack) & ~_wanted(d, before, *keys, slack) & ~inside)
        if not len(at):
            return None
        exact = float(np.abs(v).max(initial=0)) * float(np.abs(q[at]).max(initial=0)) * max(dims, 1) < 2**53
        scores = (q[at].astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if exact else q[at] @ v.T
        ok = (labels == of[at, None]) == same[at, None]
        ok &= (rows != own[at, None]) & (scores >= low[at, None]) & (scores <= high[at, None])
        out = []
        for i, j in enumerate(at.tolist()):
            r = np.flatnonzero(ok[i])
            if len(r) > k[j]:
                r = r[scores[i, r] >= np.partition(scores[i, r], -k[j])[-k[j]]]
            r = r[np.lexsort((rows[r], ids[r], ~known[r], -scores[i, r]))][: k[j]]
            out.append((np.full(len(r), query[j]), ids[r], known[r], rows[r], scores[i, r]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return meet


def search(blocks: DataFrame, space: Space, dims: int, queries: DataFrame) -> DataFrame:
    """The first k rows of each query (columns of _QUERY) by score, ties by smaller id: query, id, row, score, rank.

    Candidates are rows of the query's label (``same``) or of any other, not the query's own row, with scores from ``low``
    to ``high``.  A round ends with one number on the driver, the count of queries still open.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(4), dims)
            d = space.of_query(q)
            near = d.argmin(axis=1)
            start = np.full(len(q), FIRST * space.reach)
            end = space.radius(q, batch.column(6).to_numpy().astype(np.float64))
            names = [*batch.schema.names, "near", "gap", "before", "now", "last"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (near.astype(np.int64), d[np.arange(len(d)), near], np.full(len(q), -np.inf), np.minimum(start, end), end))], names)

    def tile(t: pa.Table) -> list[bytes]:
        column = lambda c: t[c].combine_chunks()
        number = lambda c: column(c).to_numpy(zero_copy_only=False)
        return [x.tobytes() for x in (number("query"), number("row"), number("label"), matrix(column("v"), dims).astype(np.int64), number("same").astype(bool), number("low"), number("high"), number("k").astype(np.int32), number("before"), number("now"))]

    def intervals(f: str):
        def of(t: pa.Table) -> list[float]:
            d = space.of_query(matrix(t["v"].combine_chunks(), dims))
            before, now = (t[c].combine_chunks().to_numpy(zero_copy_only=False)[:, None] for c in ("before", "now"))
            return {"lo": (d - now).min(axis=0), "hi": (d + now).max(axis=0), "seen_lo": (d - before).max(axis=0), "seen_hi": (d + before).min(axis=0)}[f].tolist()

        return of

    slack = SLACK * (1 + float(np.sqrt(space.most)))
    bounds = {f: ("array<double>", intervals(f)) for f in ("lo", "hi", "seen_lo", "seen_hi")}
    found, open_ = None, written(queries.mapInArrow(opened, _QUERY + ", near long, gap double, before double, now double, last double"), "queries")
    places = blocks.select("block", "pivot", F.col("lo").alias("least"), F.col("hi").alias("most"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"))
    n_blocks = blocks.count()
    while m := open_.count():
        groups = -(-m // (TILE * CELL))
        sorted_ = open_.repartitionByRange("near", "gap", "query").sortWithinPartitions("near", "gap", "query")
        tiles = written(packed(sorted_, "near", TILE, tile, bounds).withColumn("tile", F.monotonically_increasing_id()), "tiles")
        by_pivot = tiles.select("tile", F.posexplode(F.arrays_zip("lo", "hi", "seen_lo", "seen_hi")).alias("pivot", "x")).select("tile", F.col("pivot").cast("long").alias("pivot"), "x.*", F.explode(F.sequence(F.expr("0L"), F.expr(f"{SALTS - 1}L"))).alias("salt"))
        meets = (F.col("lo") <= F.col("most") + slack) & (F.col("hi") >= F.col("least") - slack) & ~((F.col("seen_lo") <= F.col("most") - slack) & (F.col("seen_hi") >= F.col("least") + slack))
        pairs = written(by_pivot.join(places, ["pivot", "salt"]).where(meets).select("tile", "block", F.pmod(F.xxhash64("tile"), F.lit(groups)).alias("group")), "pairs")
        wanted = pairs.select("block", "group").distinct().join(blocks.select("block", "parts"), "block")
        new = meetings(wanted, pairs.join(tiles.select("tile", "parts"), "tile"), n_blocks * groups, _meet(space, dims))
        asked = queries.select("query", "k")
        new = new if found is None else new.unionByName(found.drop("rank"))
        old, found = found, written(best(new.join(asked, "query"), F.col("k")).drop("k"), "found")
        kth = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        state = written(open_.join(kth, "query", "left").mapInArrow(_next(space, dims), open_.schema), "queries")
        for used in (tiles, pairs, open_, *([old] if old is not None else [])):
            discard(used)
        open_ = state
    return found if found is not None else queries.sparkSession.createDataFrame([], "query long, id long, row long, score long, rank int")


def _next(space: Space, dims: int):
    """Queries that aren't certain yet, with their next radius: that which makes them so, or half of it if that is far."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            number = lambda c: batch.column(names.index(c)).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            q = matrix(batch.column(names.index("v")), dims)
            kth = space.radius(q, number("kth").astype(np.float64))
            now, last = number("now"), number("last")
            target = np.where(number("n") >= number("k"), np.minimum(kth, last), last)
            then = np.where(target > 2 * now, np.maximum(target / 2, 2 * now), target)
            # Without a floor the last radius is beyond all rows.
            out = batch.set_column(names.index("before"), "before", pa.array(now)).set_column(names.index("now"), "now", pa.array(then))
            yield out.filter(pa.array(target > now)).select([n for n in names if n not in ("n", "kth")])

    return step


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` comes from ``exact_vectors``.  An anchor's positives are its first rows of the same label; a positive's
    negatives are the first rows of other labels whose score is at most the positive's and at least ``percent`` hundredths of it.
    Ties go to smaller ids (null ids last), rows that share an id are rows of their own, shorter
    vectors end in zeros, and scores must fit 64 bits.
    """
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    space = fitted(vectors, dims)
    blocks = index(vectors, space, dims)
    asking = vectors.where(anchors)
    least, most = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    first = asking.select(F.col("row").alias("query"), "id", "row", "label", "v", F.lit(True).alias("same"), least.alias("low"), most.alias("high"), F.lit(positives).alias("k"))
    near = search(blocks, space, dims, first).select(F.col("query").alias("anchor"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = written(near.withColumn("query", F.monotonically_increasing_id()), "positives")
    # A floor above the ceiling leaves nothing: positives of negative score have no negatives.
    ceiling = pairs.where("positive_score >= 0").withColumn("low", F.expr(f"({percent} * positive_score + 99) div 100"))
    second = ceiling.join(asking, ceiling["anchor"] == asking["row"]).select("query", "id", "row", "label", "v", F.lit(False).alias("same"), "low", F.col("positive_score").alias("high"), F.lit(negatives).alias("k"))
    found = search(blocks, space, dims, written(second, "asked"))
    names = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(pairs, "query").join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, over the whole ``embeddings``.

    Rows with a null label or vector, or with a null or non-finite component, take no part, and null ids don't ask; an
    empty table gives no rows; other columns aren't read.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = exact_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256, label)
    return hard_negatives(vectors, F.col("id") % 100 == 0)


OP11_SQL = """
with vectors as (
 select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v, row_number() over () as r
 from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
 select a.id as anchor_id, a.r as a, c.id, c.r as c, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
 from vectors a join vectors c on a.r != c.r where a.id % 100 = 0
), positives as (
 select * from scored where same qualify row_number() over (partition by a order by score desc, id) <= 5
)
select p.anchor_id, p.id as positive_id, cast(row_number() over (partition by p.a, p.c order by n.score desc, n.id) as int) as rank, n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.a = p.a and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""
