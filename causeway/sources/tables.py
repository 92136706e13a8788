"""Keyed tables on shared storage: appends, keyed merges and lookups, each one commit of a manifest.

A table is a folder: ``data`` holds the writes, each a folder of Parquet files partitioned by bucket, and ``log``
one manifest for each version, which names the writes that make up each bucket.  A bucket is a hash of the first key
column, so the rows of one case are read from one bucket and a merge rewrites only the buckets it touches.

A write is invisible until its manifest is there, and a manifest appears by one rename that fails if the version exists:
a job that dies half way leaves files that no version names.  A writer numbers its batches; one that has been committed
is skipped, so repeated runs change nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causeway.sources.scratch import written

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class StoredTable:
    """A table at ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._at = lambda p: self._hadoop.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = self._at(self.path).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toString()

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 64) -> StoredTable:
        """A new table without rows; the key may have null parts, and a table without a key takes appends only."""
        schema = spark.createDataFrame([], schema).schema
        table = cls(spark, path)
        table._commit({"version": 0, "schema": schema.json(), "key": key, "buckets": buckets, "writes": {}, "batches": {}})
        return table

    # Versions

    def version(self) -> int:
        log = self._at(f"{self.path}/log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        found = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
        if not found:
            raise ValueError(f"no table at {self.path}")
        return max(found)

    def manifest(self, version: int | None = None) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/log/{self.version() if version is None else version:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        final, new = f"{self.path}/log/{manifest['version']:012}.json", f"{self.path}/log/.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(new), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._at(final)
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._at(new), target, plain)
        except Exception as e:
            self._fs.delete(self._at(new), False)
            if self._fs.exists(target):
                raise Conflict(final) from e
            raise

    # Reading

    def schema(self, manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"]))

    def _bucket(self, manifest: dict) -> Column:
        first = F.col(manifest["key"][0]) if manifest["key"] else F.lit(0)
        return F.coalesce(F.pmod(F.xxhash64(first.cast("string")), F.lit(manifest["buckets"])), F.lit(0)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = self.schema(manifest)
        paths = [f"{self.path}/data/{w}/{BUCKET}={b}" for w, held in manifest["writes"].items() for b in held if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, as of a version or now."""
        return self._read(self.manifest(version))

    def lookup(self, value: object) -> DataFrame:
        """The rows whose first key column is ``value``, from its bucket alone; the filter reaches the files."""
        m = self.manifest()
        name = m["key"][0]
        kind = self.schema(m)[name].dataType
        bucket = self.spark.range(1).select(F.lit(value).cast(kind).alias(name)).select(self._bucket(m)).first()[0]
        return self._read(m, [bucket]).where(F.col(name).eqNullSafe(F.lit(value).cast(kind)))

    # Writing

    def _write(self, rows: DataFrame, m: dict) -> tuple[str, list[int]]:
        """The rows by bucket, columns not given as null; a bucket's rows come from as many tasks as hold some."""
        name = uuid.uuid4().hex
        given = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(m)]
        rows.select(*given, self._bucket(m).alias(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        at = self._at(f"{self.path}/data/{name}")
        return name, sorted(int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(at) if "=" in f.getPath().getName())

    def _change(self, batch: tuple[str, int] | None, work: Callable[[dict], dict | None], tries: int = 10) -> bool:
        for _ in range(tries):
            m = self.manifest()
            if batch and m["batches"].get(batch[0], -1) >= batch[1]:
                return False
            writes = work(m)
            if writes is None:
                return False
            batches = m["batches"] | ({batch[0]: batch[1]} if batch else {})
            try:
                self._commit(m | {"version": m["version"] + 1, "writes": {w: b for w, b in writes.items() if b}, "batches": batches})
                return True
            except Conflict:
                continue
        raise Conflict(self.path)

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds the rows as they are, repeated ones too; false if this batch (writer, number) was there before or has no rows."""
        done: list[tuple[str, list[int]]] = []

        def work(m: dict) -> dict | None:
            if not done:  # another writer's commit in between changes nothing about these files
                done.append(self._write(rows, m))
            return m["writes"] | {done[0][0]: done[0][1]} if done[0][1] else None

        return self._change(batch, work)

    def merge(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None, combine: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Merges rows by key: a column that isn't null takes the place of the stored one, columns not given or null keep it, new keys
        are added.

        Of several rows of a key a later one by ``order`` (null first) goes over an earlier one.  Only the buckets that
        ``rows`` touch are read and rewritten.  Instead of that rule, ``combine`` may make the new rows of a key from the stored
        and the given ones together.
        """
        columns = rows.columns

        def work(m: dict) -> dict | None:
            schema, key = self.schema(m), m["key"]
            if not key:
                raise ValueError("a merge needs a key")
            rank = F.struct(F.lit(1).alias("o"), (F.col(order) if order else F.lit(0)).alias("n"))
            full = rows.select(*[(F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], rank.alias("__rank"), self._bucket(m).alias(BUCKET))
            new = written(full, "merged")
            touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most the number of buckets
            if not touched:
                return None
            stored = self._read(m, touched).withColumn("__rank", F.struct(F.lit(0).alias("o"), F.lit(None).cast(new.schema["__rank"].dataType["n"].dataType).alias("n")))
            both = stored.unionByName(new.drop(BUCKET))
            if combine:
                made = combine(both.select(*schema.names))
            last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c) for c in schema.names if c not in key]
            if not combine:
                made = both.groupBy(*key).agg(*(last or [F.count("*").alias("__n")]))
            name, held = self._write(made, m)
            rest = {w: [b for b in bs if b not in touched] for w, bs in m["writes"].items()}
            return rest | {name: held}

        return self._change(batch, work)

    def clean(self) -> int:
        """Deletes writes that the newest version doesn't name, and older versions; only while no other job uses the table."""
        m, gone = self.manifest(), 0
        data = self._at(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in m["writes"]:
                gone += self._fs.delete(f.getPath(), True)
        for f in self._fs.listStatus(self._at(f"{self.path}/log")):
            if f.getPath().getName() != f"{m['version']:012}.json":
                self._fs.delete(f.getPath(), False)
        return gone
