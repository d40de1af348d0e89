"""A streaming source of text files that grow: ``spark.readStream.format("growing_lines")``, after ``register``.

Options: ``path``, a folder or file that pyarrow's file systems open on the driver and all executors; ``suffix``, of the files to read (default: all); ``begin``, ``earliest`` (default)
or ``latest`` for what is added from now on only; ``part_bytes``, how much a task reads.

The stream's offset is each file's size. A line belongs to the micro-batch, and there to the part, that has its line feed: a part looks back for where its first line
began, so a line that was cut comes whole once its end is there, and no line is kept anywhere in between. What stands behind the last line feed waits. A file that has become
shorter is read from its start. Bytes that are no UTF-8 become replacement marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PART_BYTES, LOOK_BACK = 64 << 20, 64 << 10
SCHEMA = "file string, offset long, value string"


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Source(NamedTuple):
    files: fs.FileSystem
    root: str


def _opened(path: str) -> _Source:
    return _Source(*(fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.begin, self.part_bytes = options.get("begin", "earliest"), int(options.get("part_bytes", PART_BYTES))

    def initialOffset(self) -> dict:
        return {} if self.begin == "earliest" else self.latestOffset()

    def latestOffset(self) -> dict:
        files, root = _opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for path, size in end.items():
            known = start.get(path, 0)
            known = known if known <= size else 0
            out += [Part(path, at, min(size, at + self.part_bytes)) for at in range(known, size, self.part_bytes)]
        return out

    def read(self, partition: Part) -> Iterator[tuple | pa.RecordBatch]:
        files, _ = _opened(self.path)
        with files.open_input_file(partition.path) as f:
            data = f.read_at(partition.end - partition.start, partition.start)
            last = data.rfind(b"\n")
            if last < 0:
                return
            head, at = b"", partition.start
            while at:  # where the first line began
                step = min(LOOK_BACK, at)
                before = f.read_at(step, at - step)
                feed = before.rfind(b"\n")
                head, at = before[feed + 1 :] + head, at - step
                if feed >= 0:
                    at += feed + 1
                    break
        for line in (head + data[:last]).split(b"\n"):
            yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line) + 1


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)


def lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of (file, offset, value): each line once, when its line feed is there."""
    register(spark)
    return spark.readStream.format("growing_lines").options(path=path, **options).load()
