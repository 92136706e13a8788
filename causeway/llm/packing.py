"""Operator 7, best-fit packing: bounded-space online best-fit over one pass, without a shuffle.

Each task encodes its documents and packs their pieces as they come.  A fixed number of bins
is open; a bitset has a bit for each free space that some open bin has, so the fullest bin
that still takes a piece is the lowest set bit from the piece's length on.  When a new bin
would be one too many, the fullest closes.  Pieces arrive in blocks of bounded size sorted
by falling length, which leaves the short ones to fill the gaps.  Sequence ids hold the
partition number, so no numbering across tasks is needed, and a repeated task gives the
same rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import table
from causeway.llm.tokens import IdCoder, byte_chunks, coder, encode_ended

CAPACITY = 2048
OPEN_BINS = 8192
#: Pieces that are sorted together, and the bytes of their ids where ids are kept.
BLOCK_PIECES, BLOCK_BYTES = 1 << 13, 32 << 20


class BestFit:
    """At most ``open_bins`` open bins of ``capacity``; ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: an open bin has f free
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.next = 0

    def _take(self, space: int) -> int:
        at = self.bins[space]
        b = at.pop()
        if not at:
            self.free &= ~(1 << space)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            if self.open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, b = self.capacity, self.next
            self.next += 1
        left = space - length
        if left:
            self.bins[left].append(b)
            self.free |= 1 << left
            self.open += 1
        return b, self.capacity - space


def piece_bounds(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of ``n`` ids begin, and ``n``: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity), n] if n else [0]


def pack_documents(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    A null or empty text is its end id alone; a very long one is cut into full pieces behind a shorter first one; rows of
    null or repeated keys are packed each; an empty table gives no rows; other columns aren't read.
    """
    fields = f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in fields.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        c, bins = coder(IdCoder, path), BestFit(capacity, open_bins)
        block: list[tuple] = []
        size = 0

        def placed() -> pa.RecordBatch:
            order = sorted(range(len(block)), key=lambda i: -block[i][3])
            where: list = [None] * len(block)
            for i in order:
                where[i] = bins.place(block[i][3])
            columns = [pa.array(x, k) for x, k in zip(zip(*((*b[:5], base + at, offset, *b[5:]) for b, (at, offset) in zip(block, where, strict=True)), strict=True), kinds, strict=False)]
            return pa.RecordBatch.from_arrays(columns, names)

        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, _, data, offsets in byte_chunks(batch.column(1)):
                ids, bounds = encode_ended(c, data, offsets, end_id)
                bounds = bounds.tolist()
                for k in range(len(bounds) - 1):
                    cuts = piece_bounds(bounds[k + 1] - bounds[k], capacity)
                    for p in range(len(cuts) - 1):
                        part = ids[bounds[k] + cuts[p] : bounds[k] + cuts[p + 1]]
                        row = (keys[at + k], p, cuts[p], len(part), zlib.crc32(part))
                        if with_ids:
                            row += (part.tobytes(),)
                            size += 4 * len(part)
                        block.append(row)
                    if len(block) >= BLOCK_PIECES or size >= BLOCK_BYTES:
                        yield placed()
                        block.clear()
                        size = 0
        if block:
            yield placed()

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(pack, fields)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all ``documents`` under the 50k byte vocabulary, each ended by id 0, into sequences of 2048."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
