"""The first lines of files, without reading the files: a batch source that stops after ``n`` lines of each."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_path string, block_start bigint, line_id bigint, raw string"
READ = 1 << 16
FILES = 32
_ENDS = re.compile(rb"\r\n|\n|\r")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", path))
    return fs.FileSystem.from_uri(path)


@dataclass
class Group(InputPartition):
    paths: list[str]


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.n = json.loads(options["files"]), int(options["n"])
        self.skip = options.get("skip") or None

    def partitions(self) -> Sequence[InputPartition]:
        return [Group(self.paths[i : i + FILES]) for i in range(0, len(self.paths), FILES)]

    def head(self, path: str) -> list[tuple[int, str]]:
        """(number, text) of the first lines; a file of one line without end is read up to that end only."""
        system, inside = _open(path)
        out: list[tuple[int, str]] = []
        held, number = [], 0
        with system.open_input_stream(inside, compression="detect") as file:
            while len(out) < self.n:
                data = file.read(READ)
                held.append(data)
                if data and (not _ENDS.search(data) or data.endswith(b"\r")):
                    continue
                parts = _ENDS.split(b"".join(held))
                held = [parts.pop()] if data else []
                if not data and not parts[-1]:
                    parts.pop()
                for raw in parts:
                    text = raw.decode("utf-8", "replace")
                    if self.skip is None or text.strip(self.skip):
                        out.append((number, text))
                    number += 1
                if not data:
                    break
        return out[: self.n]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            rows = self.head(path)
            if rows:
                numbers, texts = zip(*rows)
                where = [re.sub("^file:/+", "file:/", path)] * len(rows)
                arrays = [pa.array(where), pa.array([0] * len(rows), pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["source_path", "block_start", "line_id", "raw"])


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)


def read_heads(spark: SparkSession, paths: list[str] | str, n: int, skip: str | None = None) -> DataFrame | None:
    """LINES: the first ``n`` lines of every file, ``line_id`` counting from 0; None if only Spark can open the files.

    One task takes a group of files and reads 64 KB at a time until it has its lines, so the bytes read do not
    grow with the files. With ``skip`` (characters) lines of these alone do not count. Paths are those of a text
    scan: patterns and folders are resolved by Spark, compressed files are told by their ending. Lines, line
    ends and broken UTF-8 are read as a text scan reads them; empty files have no row.
    """
    files = sorted(spark.read.text(paths).inputFiles())
    try:
        for scheme in {f.split(":", 1)[0]: f for f in files}.values():
            _open(scheme)
    except (pa.ArrowException, OSError, NotImplementedError):
        return None
    spark.dataSource.register(FileHeads)
    reader = spark.read.format("file_heads").option("files", json.dumps(files)).option("n", n)
    return (reader.option("skip", skip) if skip else reader).load()
