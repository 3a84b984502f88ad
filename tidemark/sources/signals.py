"""Signals as a data source: JSON lines in and out, as streams that neither lose nor repeat a row.

    spark.dataSource.register(JsonLines)
    spark.readStream.format("tidemark_jsonl").schema(SIGNALS).load(path)
    df.writeStream.format("tidemark_jsonl").option("checkpointLocation", c).start(path)

Paths are URIs that Arrow's file systems open, seen by all executors.

Reading: files are taken in order of their names; a stream's offset is the last
name taken, so a file that comes later must sort later. A file is a partition.
Lines that aren't JSON objects are passed over; fields that a line lacks are
null, as are values of another kind.

Writing: each task writes a file aside and tells its name. The driver commits a
batch: it removes what an earlier attempt at the same batch left, gives the files
their final names, which begin with the batch, and leaves a mark. A batch with a
mark is never written again. Files aside are invisible to readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from tidemark import schemas

KINDS = {StringType: (str,), LongType: (int,), IntegerType: (int,), ShortType: (int,), DoubleType: (int, float), FloatType: (int, float), BooleanType: (bool,)}


def opened(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def names(uri: str) -> list[str]:
    """The visible files below a folder, by name."""
    from pyarrow import fs

    files, root = opened(uri)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "_." and f.base_name.endswith(".jsonl"))


def parsed(line: bytes, schema: StructType) -> tuple | None:
    """A line's fields in the schema's order."""
    try:
        held = json.loads(line)
    except ValueError:
        return None
    if not isinstance(held, dict):
        return None

    def value(f):
        v = held.get(f.name)
        fits = isinstance(v, KINDS[type(f.dataType)]) and (isinstance(v, bool) == isinstance(f.dataType, BooleanType))
        return (float(v) if isinstance(f.dataType, DoubleType | FloatType) else v) if fits else None

    return tuple(value(f) for f in schema)


@dataclass
class OneFile(InputPartition):
    name: str


class Lines:
    """What the batch and the stream reader share."""

    def __init__(self, path: str, schema: StructType):
        odd = [f.name for f in schema if type(f.dataType) not in KINDS]
        if odd:
            raise ValueError(f"no plain values: {', '.join(odd)}")
        self.path, self.wanted = path, schema

    def read(self, partition: OneFile | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are no files
            return
        files, root = opened(self.path)
        with files.open_input_stream(f"{root}/{partition.name}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (x for x in (parsed(line, self.wanted) for line in lines if line) if x is not None)
            last = parsed(rest, self.wanted) if rest else None
            if last is not None:
                yield last


class BatchReader(Lines, DataSourceReader):
    def partitions(self) -> list[OneFile]:
        return [OneFile(n) for n in names(self.path)]


class StreamReader(Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        return [OneFile(n) for n in names(self.path) if start["last"] < n <= end["last"]]

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Wrote(WriterCommitMessage):
    name: str | None


class LineWriter:
    """A task's part of a write: a file aside, or none where there are no rows."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Wrote:
        files, root = opened(self.path)
        files.create_dir(f"{root}/_aside", recursive=True)
        name, out = f"{uuid.uuid4().hex}.jsonl", None
        for r in rows:
            out = out or files.open_output_stream(f"{root}/_aside/{name}")
            out.write(json.dumps(r.asDict(), ensure_ascii=False, default=str).encode() + b"\n")
        if out is None:
            return Wrote(None)
        out.close()
        return Wrote(name)

    def put(self, messages: list[Wrote | None], prefix: str) -> None:
        """Final names for the files of one write, in place of what an earlier attempt at it left."""
        files, root = opened(self.path)
        for old in names(self.path):
            if old.startswith(f"{prefix}-"):
                files.delete_file(f"{root}/{old}")
        for i, m in enumerate(sorted(m.name for m in messages if m is not None and m.name)):
            files.move(f"{root}/_aside/{m}", f"{root}/{prefix}-{i:05d}.jsonl")

    def drop(self, messages: list[Wrote | None]) -> None:
        files, root = opened(self.path)
        for m in messages:
            if m is not None and m.name and files.get_file_info(f"{root}/_aside/{m.name}").is_file:
                files.delete_file(f"{root}/_aside/{m.name}")


class BatchWriter(LineWriter, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.put(messages, f"write-{uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        self.drop(messages)


class StreamWriter(LineWriter, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        files, root = opened(self.path)
        mark = f"{root}/_commits/{batchId}"
        if files.get_file_info(mark).is_file:
            self.drop(messages)
            return
        self.put(messages, f"batch-{batchId:012d}")
        files.create_dir(f"{root}/_commits", recursive=True)
        files.open_output_stream(mark).close()

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


class JsonLines(DataSource):
    """Format tidemark_jsonl, with the option path."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_jsonl"

    def schema(self) -> str:
        return schemas.SIGNALS

    def _path(self) -> str:
        path = self.options["path"].rstrip("/")
        return path if "://" in path or path.startswith("file:") else f"file://{path}"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self._path(), schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("rows are only ever added")
        return BatchWriter(self._path())

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self._path())
