"""Operator 10, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Documents with equal shingle sets are one class; the join works on one document of each.

1. Candidates.  In any global order of shingles, two sets that link share some l of the
   first ``n - ceil(0.8 n) + l`` shingles of each; l is a sixteenth of n.  The order puts shingles of crowded hash
   buckets last (bucket counts over all documents, a table of fixed size), and the longest
   first, so neither passages that many documents share nor common words in a row make
   many candidates.  Postings of these shingles are shuffled by shingle; those without
   another class of fitting size end there, and so do sets that have fewer than l left.
   Postings of buckets far over the mean are dealt to several tasks and all stay candidates.
2. Tiles.  Documents that postings connect, directly or through others, form a cluster; a
   cluster is a tile.  A crowded one has a tile for each band of set sizes, where the sets of
   the band above are guests; a tile still crowded is cut into parts and becomes a tile for
   each pair of parts.  A tile's texts travel to it once.  There each set gets a bitmap of hashed
   shingles, wider for larger sets; only sets of one size band or of neighbouring ones meet,
   and the bits in which their bitmaps differ bound the overlap from above, and with it
   what can link.
3. Exact check.  What passes is verified by intersecting the sorted shingle arrays.  A tile
   gives a spanning forest of its links: a set that has a place in the forest is compared
   no more, so a dense group of copies costs little more than its size.

A cluster of more than MAX_PARTS parts, which chance may join together in a very large
corpus, is cut otherwise: into tiles of one shingle each.  There a first round finds forests
in the cells of each set's most shared shingle, and a second takes all pairs that bitmaps
allow between its components, and verifies them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.caches import trim, use
from causeway.llm.common import discard, free_names, table, written
from causeway.llm.components import components
from causeway.llm.tokens import byte_chunks
from causeway.llm.words import mix, shingle_sets

#: Sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
CHUNK_BYTES = 1 << 20
#: Hash buckets of the shingle counts; a bucket is crowded from CROWDED standard deviations over the mean on.
BUCKET_BITS, CROWDED, BLOCKS = 19, 8, 128
#: Rows of a bucket over the mean, if they are more than the mean itself, that one task takes; more are dealt to several.
HOT = 1 << 16
#: Sets of a tile's cell, and shingles of them where their texts are together.
CELL, CELL_SHINGLES = 8192, 4_000_000
#: Bits of the filter that finds the rows of some ids before a join: 8 MB, at most 16 MB of rows to the driver.
FILTER_BITS = 26
NARROW, WIDE = 64, 1 << 14
#: Parts of a band of a cluster up to which each pair of them is a tile.
MAX_PARTS = 16


#: l is one such part of a set's size, or 1; and rounds of dropping sets with too few postings.
PART, PEELS = 16, 1


def prefix_length(n: int) -> int:
    """With l = max(1, n // PART) of them shared at least by the set of the earlier last shingle."""
    return n + NUM * -n // DEN + max(1, n // PART)


def peeled(postings: DataFrame) -> DataFrame:
    """Without the sets that share fewer postings than any link needs; a partner has 0.8 n shingles at least."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUM / DEN) / PART))
    few = postings.groupBy("doc_id").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= least).select("doc_id")
    return shared(postings.join(few, "doc_id", "left_semi"))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _bucket(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(24)) & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bits of a set: a power of two of them, at least four times its size, from NARROW to WIDE."""
    bits = min(WIDE, max(NARROW, 4 << (len(s) - 1).bit_length()))
    out = np.zeros(bits, dtype=np.uint8)
    out[s & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def band(n: np.ndarray) -> np.ndarray:
    """Sizes of one band differ by less than 1.25 times; linked sizes are in one band or in neighbours."""
    return np.floor(np.log(n) / np.log(DEN / NUM) + 1e-9).astype(np.int32)


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    use("shingles")
    for at, _, data, offsets in byte_chunks(batch.column(k), CHUNK_BYTES):
        for i, s in enumerate(shingle_sets(data, offsets)):
            yield at + i, s


def crowded_buckets(docs: DataFrame) -> tuple[bytes, dict[int, int]]:
    """Which hash buckets hold far more shingles than the mean, counted over all texts, as bits,
    and the tasks that the postings of the hot ones among these are dealt to.

    Every task counts repeated sets once and emits its counts in BLOCKS rows; they are added
    up as they arrive, and what reaches the driver has a fixed size.
    """
    per = (1 << BUCKET_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64), set()
        for batch in batches:
            for _, s in _texts(batch, 0):
                if len(s) and (f := _fingerprint(s)) not in seen:
                    seen.add(f)
                    bucket, n = np.unique(_bucket(s), return_counts=True)
                    total[bucket] += n
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([total[k * per : (k + 1) * per].astype("<u4").tobytes() for k in range(BLOCKS)], pa.binary())], ["block", "counts"])
        seen.clear()
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_py(), "<u4").astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    total = np.zeros((BLOCKS, per), dtype=np.int64)
    for r in rows:
        total[r.block] = np.frombuffer(r.counts, "<i8")
    total = total.ravel()
    mean = total.mean()
    late = total > mean + CROWDED * (1 + np.sqrt(mean))
    share = max(HOT, mean)
    hot = np.flatnonzero(late & (total - mean > share))
    return np.packbits(late).tobytes(), dict(zip(hot.tolist(), np.ceil((total[hot] - mean) / share).astype(int).tolist(), strict=True))


def prefix_sets(docs: DataFrame, crowded: bytes, hot: dict[int, int]) -> DataFrame:
    """doc_id, n, two fingerprints, and the prefix of the set; null where its task had the set before.

    ``parts`` is null for a prefix without hot shingles, else 0 for each shingle that isn't
    hot and the number of a part, from 1, for each one that is.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = np.unpackbits(np.frombuffer(crowded, np.uint8)).astype(bool), set()
        dealt = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        dealt[list(hot)] = list(hot.values())
        for batch in batches:
            names, n, a, b, tokens, parts = batch.column(0).to_pylist(), [], [], [], [], []
            for k, s in _texts(batch, 1):
                f = _fingerprint(s)
                n.append(len(s))
                a.append(f[0])
                b.append(f[1])
                if not len(s) or f in seen:
                    tokens.append(None)
                    parts.append(None)
                    continue
                seen.add(f)
                last = late[_bucket(s)]
                prefix = np.concatenate([s[~last], s[last]])[: prefix_length(len(s))]
                tokens.append(prefix.view(np.int64))
                of = dealt[_bucket(prefix)]
                mine = ((names[k] or 0) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33
                parts.append(np.where(of > 0, mine % np.maximum(of, 1) + 1, 0).astype(np.int32) if of.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "n", "fa", "fb", "tokens", "parts"])
        seen.clear()
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, "doc_id long, n long, fa long, fb long, tokens array<long>, parts array<int>")


def _partners(token: np.ndarray, doc: np.ndarray, label: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The rows that ``shared`` keeps, and the size of their group."""
    order = np.lexsort((doc, n, token))
    token, doc, label, n = token[order], doc[order], label[order], n[order]
    near = (token[1:] == token[:-1]) & (DEN * n[:-1] >= NUM * n[1:])
    other = np.zeros(len(token), dtype=bool)
    other[1:] |= near
    other[:-1] |= near
    token, doc, label, n = token[other], doc[other], label[other], n[other]
    if not len(token):
        return [token, doc, label, n, np.zeros(0, np.int64)]
    group = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1
    several = np.zeros(group[-1] + 1, dtype=bool)
    several[group[1:][(token[1:] == token[:-1]) & (label[1:] != label[:-1])]] = True
    ok = several[group]
    return [token[ok], doc[ok], label[ok], n[ok], np.bincount(group)[group[ok]]]


def shared(postings: DataFrame) -> DataFrame:
    """Of (token, part, doc_id, label, n) the rows of tokens with two labels whose n is near that of another
    row, and the size of their group.

    Near: the ratio lets the two sets link.  A row whose neighbours in the order of n are too
    far has no partner in its token.  Hot tokens are in parts and keep all rows, which the
    exact check allows; so a task holds the rows of one token at a time, and a bounded number of them.
    """
    names = ["token", "part", "doc_id", "label", "n"]

    def out(rows: list[np.ndarray], part: int | np.ndarray = 0) -> Iterator[pa.RecordBatch]:
        token, doc, label, n, size = rows
        if len(token):
            part = np.broadcast_to(np.asarray(part, dtype=np.int32), len(token))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, part, doc, label, n, size)], [*names, "size"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            token, part, doc, label, n = (batch[c].to_numpy() for c in names)
            hot = part > 0
            if hot.any():
                yield from out([token[hot], doc[hot], label[hot], n[hot], np.full(hot.sum(), HOT)], part[hot])
                token, doc, label, n = token[~hot], doc[~hot], label[~hot], n[~hot]
            if not len(token):
                continue
            # Sorted by token: the last token's rows wait for the next batch.
            cut = int(np.searchsorted(token, token[-1]))
            if held and (cut or held[-1][0][-1] != token[-1]):
                held.append([x[:cut] for x in (token, doc, label, n)])
                yield from out(_partners(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held = []
            elif cut:
                yield from out(_partners(*(x[:cut] for x in (token, doc, label, n))))
            held.append([x[cut:] for x in (token, doc, label, n)])
        if held:
            yield from out(_partners(*(np.concatenate(x) for x in zip(*held, strict=True))))
        held = []
        trim()

    rows = postings.select(*names).repartition("token", "part").sortWithinPartitions("token")
    return rows.mapInArrow(keep, "token long, part int, doc_id long, label long, n long, size long")


def _popcount_gap(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows ^ x).sum(axis=1, dtype=np.int64)


def _can_link(n: int, bits: np.ndarray, ns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether the sizes and bitmaps allow each row to link with a set of ``n``."""
    both = ns + n
    need = -(-NUM * both // (NUM + DEN))
    fits = need <= np.minimum(ns, n)
    at = np.flatnonzero(fits)
    fits[at] = _popcount_gap(bits, rows[at]) <= both[at] - 2 * need[at]
    return fits


def may_be_in(ids: DataFrame, key: str = "doc_id") -> Callable[[Column], Column]:
    """A test of ids: true for all of ``ids`` and for few others (the more, the fuller a bitmap of fixed size).

    It keeps the texts of other documents out of the shuffle of an exact join, which has to
    follow; a full bitmap costs a larger shuffle and nothing else.
    """
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS)
    at = place(F.col(key))
    words = ids.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr("1L").alias("one"), F.pmod(at, F.lit(64)).cast("int").alias("b"))
    found = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()

    @F.arrow_udf("boolean")
    def test(places: pa.Array) -> pa.Array:
        p = places.to_numpy(zero_copy_only=False)
        return pa.array((bitmap[p >> 6] >> (p & 63) & 1).astype(bool))

    return lambda c: test(place(c))


def forest(places: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the tiles (token, part, doc_id): doc_id, and a document of its tile that it links with, if any.

    The links of a tile form a spanning forest of those within it.  The join's plan is the same at
    every size: no side is broadcast where it happens to be small.
    """
    rows = docs.where(may_be_in(places)(F.col("doc_id"))).join(places.hint("merge"), "doc_id").select("token", "part", "doc_id", "text")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = list(_forest(ids, sets))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            keys, names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(2).to_pylist()
            for k, s in _texts(batch, 3):
                if keys[k] != key:
                    if ids:
                        yield done()
                    key, ids, sets = keys[k], [], []
                if len(s):
                    ids.append(names[k])
                    sets.append(s)
        if ids:
            yield done()
        ids, sets = [], []
        trim()

    return rows.repartition("token", "part").sortWithinPartitions("token", "part", "doc_id").mapInArrow(links, "a long, b long")


def _forest(ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect what the sets' links connect; sets meet within a size band and its neighbours."""
    n = np.array([len(s) for s in sets])
    bands = band(n)
    bits = [bitmap(s) for s in sets]
    # Folded bitmaps for each pair of neighbouring bands.
    near = {}
    for x in np.unique(bands).tolist():
        at = np.flatnonzero((bands == x) | (bands == x + 1))
        near[x] = at, _folded([bits[k] for k in at])
    free = np.ones(len(ids), dtype=bool)
    for root in range(len(ids)):
        if not free[root]:
            continue
        free[root] = False
        frontier = [root]
        while frontier:
            k = frontier.pop()
            for x in (int(bands[k]), int(bands[k]) - 1):
                if x not in near:
                    continue
                at, rows = near[x]
                left = np.flatnonzero(free[at])
                if not len(left):
                    continue
                me = int(np.searchsorted(at, k))
                for j in at[left[_can_link(int(n[k]), rows[me], n[at[left]], rows[left])]].tolist():
                    if links_with(sets[k], sets[j]):
                        free[j] = False
                        frontier.append(j)
                        yield ids[j], ids[k]


def links_with(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on sorted distinct arrays."""
    i = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * i >= NUM * (len(a) + len(b) - i)


def _folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of the narrowest one's width; wider ones are folded."""
    width = min(map(len, bits))
    out = np.zeros((len(bits), width), dtype=np.uint8)
    for k, x in enumerate(bits):
        out[k] = np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def tiles(postings: DataFrame) -> DataFrame:
    """Of (token, doc_id, label, n, bits), pairs of different labels that sizes and bitmaps allow to link."""
    counts = postings.groupBy("token").count().where(F.col("count") > CELL).select("token", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    rows = postings.join(counts, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    # Each pair of parts is a cell.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("cell", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        token, cell, doc, label, n = (t[c].to_numpy() for c in ("token", "cell", "doc_id", "label", "n"))
        order = np.lexsort((doc, cell, token))
        new = np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (cell[order][1:] != cell[order][:-1])))
        edges = np.flatnonzero(new)
        bits = t["bits"].combine_chunks()
        found: set[tuple[int, int]] = set()
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            i = order[a:b]
            if b - a < 2:
                continue
            bands = band(n[i])
            for x in np.unique(bands):
                k = i[(bands == x) | (bands == x + 1)]
                if len(k) > 1:
                    found.update(_cell_pairs(doc[k], label[k], n[k], bands[(bands == x) | (bands == x + 1)] == x, _folded([bits[int(j)].as_py() for j in k])))
            if len(found) > 1 << 18:
                yield _pairs_batch(found)
                found.clear()
        yield _pairs_batch(found)

    placed = rows.select("token", "cell", "doc_id", "label", "n", "bits").repartition("token", "cell")
    return placed.mapInArrow(pairs, "a long, b long").distinct()


def _pairs_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    p = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


def _cell_pairs(doc: np.ndarray, label: np.ndarray, n: np.ndarray, own: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    names, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    largest = count.argmax()
    for k in np.flatnonzero(inverse != largest):
        # Against the largest label, and those before it among the others; a guest only against owners.
        other = np.flatnonzero(((inverse == largest) | (np.arange(len(doc)) < k)) & (inverse != inverse[k]) & (own | own[k]))
        for j in other[_can_link(int(n[k]), rows[k], n[other], rows[other])]:
            yield min(doc[k], doc[j]), max(doc[k], doc[j])


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link, by the exact intersection of their sorted shingle arrays."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.where(may_be_in(ids)(F.col("doc_id"))).join(ids, "doc_id", "left_semi")

    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        sets = [[s for at, _, data, offsets in byte_chunks(z, CHUNK_BYTES) for s in shingle_sets(data, offsets)] for z in (x, y)]
        return pa.array([links_with(a, b) for a, b in zip(*sets, strict=True)], pa.bool_())

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.where(F.arrow_udf(check, "boolean")("ta", "tb")).select("a", "b").distinct()


def _by_token(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that connect the documents of clusters too large for tiles of their own."""
    chosen = postings.groupBy("doc_id").agg(F.max_by("token", F.struct("size", "token")).alias("token"), F.first("n").alias("n"))
    cells = chosen.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("parts"))
    places = chosen.join(cells, "token").select("doc_id", "token", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    first = written(forest(places, docs), "forest")
    names = components(first).select(F.col("id").alias("doc_id"), F.col("component").alias("__c"))
    labelled = postings.join(names, "doc_id", "left").select("token", "part", "doc_id", F.coalesce("__c", "doc_id").alias("label"), "n")
    several = labelled.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("token")
    rest = written(shared(labelled.join(several, "token", "left_semi")), "rest")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bitmap(s) for _, s in _texts(batch, 1)], pa.binary())], ["doc_id", "bits"])

    wanted = rest.select("doc_id").distinct()
    bits = docs.where(may_be_in(wanted)(F.col("doc_id"))).join(wanted, "doc_id", "left_semi").where("text is not null").mapInArrow(sign, "doc_id long, bits binary")
    return first.unionByName(verify(written(tiles(rest.join(bits, "doc_id")), "pairs"), docs))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and link with nothing; a very long text is one set
    of all its shingles; rows that share an id are one document, linked through any of them;
    rows of null id have a null component; an empty table gives no rows; other columns,
    whatever their names, aren't read.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prefixes = written(prefix_sets(docs, *crowded_buckets(docs)), "prefixes")
    postings = prefixes.where("tokens is not null and doc_id is not null").select(F.posexplode("tokens").alias("at", "token"), F.col("parts"), "doc_id", F.col("fa").alias("label"), "n")
    postings = written(shared(postings.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.get("parts", "at")))), "postings")
    for _ in range(PEELS):
        before, postings = postings, written(peeled(postings), "postings")
        discard(before)

    low = postings.groupBy("token").agg(F.min("doc_id").alias("b"))
    joined = postings.join(low, "token").select(F.col("doc_id").alias("a"), "b").where("a != b")
    clusters = components(joined)
    nodes = postings.groupBy("doc_id").agg(F.first("n").alias("n")).join(clusters.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    need = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("parts")
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")
    crowded = nodes.groupBy("component").agg(need)
    tiles_of = nodes.join(crowded, "component").withColumn("band", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(-2))).otherwise(F.array(size, size - 1)))).drop("parts")
    parts = tiles_of.groupBy("component", "band").agg(need)
    placed = written(tiles_of.join(parts, ["component", "band"]).select("doc_id", "component", F.xxhash64("component", "band").alias("token"), "parts", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("own")), "placed")
    other = placed.where(F.col("parts") <= MAX_PARTS).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Of several parts, a tile is a pair of different ones, which also holds the pairs within each.
    other = other.where("parts = 1 or own != other")
    places = other.select("doc_id", "token", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part"))
    links = written(forest(places, docs), "forest")
    large = placed.where(F.col("parts") > MAX_PARTS).select("component").distinct().join(placed, "component")
    if not large.isEmpty():
        links = links.unionByName(_by_token(postings.join(large.select("doc_id").distinct(), "doc_id", "left_semi"), docs))

    classes = prefixes.where("n > 0 and doc_id is not null").groupBy("fa", "fb", "n")
    copies = prefixes.where("n > 0").join(classes.agg(F.min("doc_id").alias("b"), F.count("*").alias("copies")).where("copies > 1"), ["fa", "fb", "n"]).select(F.col("doc_id").alias("a"), "b").where("a != b")
    found = components(links.unionByName(copies))
    return prefixes.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of linked documents of the whole ``documents``."""
    return similar_groups(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id; of rows that share an id, one.

    Rows of null id, and those without words, stay; all columns are kept, whatever their
    names; an empty table gives none.
    """
    (name,) = free_names(docs, "__id")
    groups = written(similar_groups(docs), "groups")
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    repeated = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name)
    # Only rows that may be concerned are shuffled, once.
    doc_id = F.col("doc_id").cast("long")
    test = F.col("doc_id").isNotNull() & may_be_in(gone.unionByName(repeated), name)(doc_id)
    maybe = docs.where(test).join(gone.hint("merge"), doc_id == F.col(name), "left").where(F.col(name).isNull())
    first = F.row_number().over(Window.partitionBy(doc_id).orderBy("text"))
    return docs.where(~test).unionByName(maybe.withColumn(name, first).where(F.col(name) == 1).drop(name))
