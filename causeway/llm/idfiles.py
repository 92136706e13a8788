"""Operator 2, token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id and sorted; each task encodes its range and writes one
shard: ``*.ids`` (little-endian uint16 where the vocabulary allows it, else uint32),
``*.offsets`` (int64, one more than documents, from 0) and ``*.docs`` (int64 document ids).
A shard's name is new for each attempt of a task, so a repeated or speculative task never
writes over another; only shards of successful attempts enter ``manifest.json``.  The bases
of the shards are the prefix sums of their sizes: the driver handles one row for each shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import filesystem, scratch, table
from causeway.llm.tokens import IdCoder, byte_chunks, coder, encode_ended

_SHARD = "shard int, name string, n_docs long, n_nulls long, n_tokens long"


def write_token_files(docs: DataFrame, path: str, end_id: int, to: str, text: str = "text", key: str = "doc_id") -> dict:
    """Encodes every whole text and writes the shards and ``manifest.json`` to folder ``to``.

    Order: ascending key (null first: a shard's manifest says how many of its documents have none), then a hash of the
    text, so the rows of one key may fill several shards.  A null or empty text has the end id alone; a text of any
    length is encoded whole, in pieces; repeated rows are documents of their own; other columns aren't read; an empty table gives a
    manifest without shards.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = coder(IdCoder, path)
        kind = "<u2" if c.size_of_vocabulary <= 1 << 16 else "<u4"
        files, folder = filesystem(to)
        shard, name = TaskContext.get().partitionId(), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        n_docs = n_nulls = n_tokens = 0
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{name}.ids") as ids_to, files.open_output_stream(f"{folder}/{name}.offsets") as offsets_to, files.open_output_stream(f"{folder}/{name}.docs") as docs_to:
            offsets_to.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                n_nulls += batch.column(0).null_count
                keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                for at, n, data, offsets in byte_chunks(batch.column(1)):
                    ids, bounds = encode_ended(c, data, offsets, end_id)
                    ids_to.write(ids.astype(kind).tobytes())
                    offsets_to.write((n_tokens + bounds[1:]).astype("<i8").tobytes())
                    docs_to.write(keys[at : at + n].tobytes())
                    n_docs, n_tokens = n_docs + n, n_tokens + len(ids)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": [n_docs], "n_nulls": [n_nulls], "n_tokens": [n_tokens]})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    order = ["k", F.xxhash64("t")]
    shards = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, _SHARD).collect()
    shards.sort(key=lambda x: x.shard)
    sizes = np.array([[0, 0]] + [[x.n_docs, x.n_tokens] for x in shards], dtype=np.int64).cumsum(axis=0)
    manifest = {
        "dtype": "<u2" if coder(IdCoder, path).size_of_vocabulary <= 1 << 16 else "<u4",
        "n_docs": int(sizes[-1, 0]),
        "n_tokens": int(sizes[-1, 1]),
        "shards": [{"name": x.name, "n_docs": x.n_docs, "n_nulls": x.n_nulls, "n_tokens": x.n_tokens, "first_doc": int(d), "first_token": int(t)} for x, (d, t) in zip(shards, sizes[:-1].tolist(), strict=True)],
    }
    files, folder = filesystem(to)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    files, at = filesystem(folder)
    with files.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


def _open(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read."""
    files, at = filesystem(folder)
    if files.type_name == "local":
        with pa.memory_map(f"{at}/{name}") as f:
            return np.frombuffer(f.read_buffer(), dtype=kind)
    with files.open_input_file(f"{at}/{name}") as f:
        return np.frombuffer(f.read(), dtype=kind)


class TokenFiles:
    """Random access to the documents of a folder in their order; shards are mapped when first used."""

    def __init__(self, folder: str):
        self.folder, self.manifest = folder, read_manifest(folder)
        self.first = [s["first_doc"] for s in self.manifest["shards"]]
        self.shards: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return self.manifest["n_docs"]

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        s = bisect_right(self.first, k) - 1
        if s not in self.shards:
            name = self.manifest["shards"][s]["name"]
            self.shards[s] = _open(self.folder, f"{name}.ids", self.manifest["dtype"]), _open(self.folder, f"{name}.offsets", "<i8")
        ids, offsets = self.shards[s]
        j = k - self.first[s]
        return ids[offsets[j] : offsets[j + 1]]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    manifest = read_manifest(folder)
    shards, kind = manifest["shards"], manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = shards[k]
                ids, offsets, docs = (_open(folder, f"{shard['name']}.{x}", y) for x, y in (("ids", kind), ("offsets", "<i8"), ("docs", "<i8")))
                for a in range(0, len(docs), 4096):
                    b = min(len(docs), a + 4096)
                    at = offsets[a : b + 1]
                    wide = ids[at[0] : at[-1]].astype("<u4")
                    cut = (at - at[0]).tolist()
                    out = {
                        "doc_id": pa.array(docs[a:b], mask=np.arange(a, b) < shard["n_nulls"]),
                        "start": pa.array(at[:-1] + shard["first_token"]),
                        "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array([zlib.crc32(wide[x:y]) for x, y in zip(cut, cut[1:], strict=False)], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(wide.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``documents`` under the 49k word vocabulary with end id 2, and reads the files back."""
    import public_tokenizers

    to = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, to)
    return read_token_files(spark, to)
