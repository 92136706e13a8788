"""JSON lines as a sink whose output appears as a whole: tasks write files of their own, and one commit names them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COMMIT = "_committed.json"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Part:
        files, at = _place(self.path)
        files.create_dir(at, recursive=True)
        name, n = f"part-{self.job}-{uuid.uuid4().hex}.jsonl", 0
        with files.open_output_stream(f"{at}/{name}") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str, separators=(",", ":")).encode() + b"\n")
                n += 1
        return _Part(name, n)

    def commit(self, messages: list[_Part | None]) -> None:
        files, at = _place(self.path)
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m is not None]
        if not self.overwrite:
            parts = committed(self.path) + parts
        with files.open_output_stream(f"{at}/{COMMIT}.{self.job}") as out:
            out.write(json.dumps({"parts": parts}).encode())
        files.move(f"{at}/{COMMIT}.{self.job}", f"{at}/{COMMIT}")

    def abort(self, messages: list[_Part | None]) -> None:
        """Deletes what the job's tasks have written, those that failed too."""
        files, at = _place(self.path)
        for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-"):
                files.delete_file(f.path)


class JsonLines(DataSource):
    """``df.write.format("json_lines").mode("append").save(folder)`` after ``spark.dataSource.register(JsonLines)``."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def committed(path: str) -> list[dict]:
    """The files that commits have named, and how many rows each has."""
    files, at = _place(path)
    if files.get_file_info(f"{at}/{COMMIT}").type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(f"{at}/{COMMIT}") as f:
        return json.loads(f.read())["parts"]


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The committed rows; files of jobs that failed aren't read."""
    names = [f"{path.rstrip('/')}/{p['name']}" for p in committed(path)]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(JsonLines)
    df.write.format("json_lines").mode(mode).save(path)
