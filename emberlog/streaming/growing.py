"""Lines appended to growing files: a streaming source that keeps a byte offset for each file.

Spark's file source sees a file once. This one looks at the sizes of the files of a folder at every trigger and hands
out the complete lines between two offsets, in partitions of bounded size. Offsets lie in the query's checkpoint, so a
restarted query goes on where it was. A file that was replaced starts over.
"""

from __future__ import annotations

import fnmatch
import json
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source_path string, block_start bigint, line_id bigint, raw string"
HEAD = 256
LOOK = 1 << 16
READ = 1 << 22
PIECE = 64 << 20

# Workers get the classes themselves, so the package need not be installed where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _open(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path inside it, and what to put before a path to get its address."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file://"
    system, inside = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return system, inside, "file://"
    return system, inside, path[: path.index("://") + 3] + (path.split("://", 1)[1].split("/", 1)[0] if inside.startswith("/") else "")


@dataclass
class Piece(InputPartition):
    """Lines that start in [begin, stop) of a file; ``whole`` if a line starts at ``begin``."""

    path: str
    begin: int
    stop: int
    whole: bool


class GrowingReader(DataSourceStreamReader):
    """Offsets are ``{path: [position, head size, head checksum]}``; positions are starts of lines."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.glob = options.get("glob", "*")
        self.first = int(options.get("first", "-1"))
        self.piece = int(options.get("piece", PIECE))
        self.lines = int(options.get("lines", "0"))
        self.progress = options.get("progress")
        if self.lines and not self.progress:
            raise ValueError("a limit of lines needs a progress file to go on from after a restart")
        self.at: dict[str, list[int]] | None = None
        self.known: dict[str, tuple[int, int]] = {}

    # Files.

    def sizes(self) -> dict[str, int]:
        system, inside, _ = _open(self.path)
        info = system.get_file_info(inside)
        if info.type == fs.FileType.File:
            return {info.path: info.size}
        found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
        keep = lambda name: name[0] not in "_." and fnmatch.fnmatch(name, self.glob)
        return {f.path: f.size for f in found if f.type == fs.FileType.File and keep(f.base_name)}

    def read_at(self, path: str, begin: int, n: int) -> bytes:
        with _open(self.path)[0].open_input_file(path) as file:
            file.seek(begin)
            return file.read(n)

    def back(self, path: str, stop: int, n: int) -> int:
        """Start of the last n lines that end before ``stop``; with n 0 the end of the last complete line."""
        left, at = n + 1, stop
        while at > 0:
            begin = max(0, at - LOOK)
            data = self.read_at(path, begin, at - begin)
            k = len(data)
            while left and (k := data.rfind(b"\n", 0, k)) >= 0:
                left -= 1
                if not left:
                    return begin + k + 1
            at = begin
        return 0

    def on(self, path: str, begin: int, stop: int, n: int) -> tuple[int, int]:
        """Where the n-th line from ``begin`` ends, at most ``stop``, and how many lines that were."""
        done, at = 0, begin
        while at < stop:
            data = self.read_at(path, at, min(LOOK, stop - at))
            if not data:
                break
            k = 0
            while (k := data.find(b"\n", k) + 1) > 0:
                done += 1
                if done == n:
                    return at + k, done
            at += len(data)
        return stop, done

    def entry(self, path: str, position: int) -> list[int]:
        head = self.read_at(path, 0, min(HEAD, position))
        return [position, len(head), zlib.crc32(head)]

    def ends(self) -> dict[str, int]:
        """End of the last complete line of every file; files of unchanged size are not read again."""
        out = {}
        for path, size in self.sizes().items():
            if self.known.get(path, (-1, 0))[0] != size:
                self.known[path] = (size, self.back(path, size, 0))
            out[path] = self.known[path][1]
        return out

    def begin_of(self, path: str, entry: list[int] | None, stop: int) -> int:
        """Where to go on in a file: at its old position, or at 0 if it is new or not the same file any more."""
        if entry is None:
            return 0
        position, size, check = entry
        same = position <= stop and zlib.crc32(self.read_at(path, 0, size)) == check
        return position if same else 0

    # Offsets.

    def initialOffset(self) -> dict:
        if self.first < 0:
            self.at = {}
        else:
            self.at = {p: self.entry(p, self.back(p, end, self.first) if end else 0) for p, end in self.ends().items()}
        return self.at

    def latestOffset(self) -> dict:
        ends = self.ends()
        if not self.lines:
            return {p: self.entry(p, end) for p, end in sorted(ends.items())}
        if self.at is None:
            self.at = self.stored()
        left, out = self.lines, {}
        for path, end in sorted(ends.items()):
            begin = self.begin_of(path, self.at.get(path), end)
            if left:
                end, n = self.on(path, begin, end, left)
                left -= n
            else:
                end = begin
            if end or path in self.at:
                out[path] = self.entry(path, end)
        self.at = out
        return out

    def stored(self) -> dict[str, list[int]]:
        system, inside, _ = _open(self.progress)
        if system.get_file_info(inside).type != fs.FileType.File:
            return {}
        with system.open_input_file(inside) as file:
            return json.loads(file.read())

    def commit(self, end: dict) -> None:
        if self.lines:
            system, inside, _ = _open(self.progress)
            with system.open_output_stream(inside + ".new") as file:
                file.write(json.dumps(end).encode())
            system.move(inside + ".new", inside)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path, (stop, *_) in end.items():
            begin = self.begin_of(path, start.get(path), stop)
            for a in range(begin, stop, self.piece):
                out.append(Piece(path, a, min(stop, a + self.piece), a == begin))
        return out

    # Lines.

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _, before = _open(self.path)
        held, at, start = b"", partition.begin, partition.begin if partition.whole else None
        with system.open_input_file(partition.path) as file:
            if start is None:
                at -= 1
            file.seek(at)
            while start is None or start < partition.stop:
                data = file.read(READ)
                if not data:
                    return
                if start is None:  # the line that crosses the border belongs to the piece before
                    k = data.find(b"\n")
                    if k < 0:
                        at += len(data)
                        continue
                    start = at + k + 1
                    data = data[k + 1 :]
                held += data
                stop = held.rfind(b"\n") + 1
                at = file.tell()
                if not stop:
                    continue
                lines, ids = held[:stop].split(b"\n")[:-1], []
                held = held[stop:]
                for line in lines:
                    ids.append(start)
                    start += len(line) + 1
                n = sum(i < partition.stop for i in ids)
                if n:
                    raw = [(x[:-1] if x.endswith(b"\r") else x).decode("utf-8", "replace") for x in lines[:n]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([before + partition.path] * n),
                            pa.array([partition.begin] * n, pa.int64()),
                            pa.array(ids[:n], pa.int64()),
                            pa.array(raw, pa.string()),
                        ],
                        ["source_path", "block_start", "line_id", "raw"],
                    )


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options)


def growing_lines(
    spark: SparkSession,
    path: str,
    first: int = -1,
    glob: str = "*",
    lines: int = 0,
    progress: str | None = None,
    piece: int = PIECE,
) -> DataFrame:
    """Stream of LINES of the files in a folder (or of one file), with what is appended to them later.

    ``first`` lines at the end of each file that is there when the query starts for the first time come first; -1 means
    all of them. Files that appear later are read from their beginning. Only lines that have their line end are
    handed out; the rest of a line comes with it. ``line_id`` is the byte a line starts at, ``block_start`` that of
    its partition. A line ends at ``\\n`` or ``\\r\\n``; broken UTF-8 becomes U+FFFD.

    A file that got shorter, or whose first bytes (up to 256) changed, is a new file. With ``lines`` at most that many
    lines come with a trigger, files in order of their paths; ``progress`` names the file in which the position is
    kept for restarts. The driver keeps one offset for each file and reads 64 KB of a file that changed.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("path", path).option("first", first).option("glob", glob)
    reader = reader.option("piece", piece).option("lines", lines)
    return (reader.option("progress", progress) if progress else reader).load()
