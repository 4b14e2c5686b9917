"""Lines of growing files as a stream whose offsets are bytes.

Spark's file source takes a file once, whole, and never sees what is appended later. This one remembers how far it has
read each file. An offset names a byte after the last complete line of every file, so a micro-batch that is repeated
reads the same bytes again, and a line that is still being written waits for its end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME, SCHEMA = "growing_lines", "value string, file string, at long"
# Bytes of a task, and of one look for the end of a line.
PIECE, LOOK = 32 << 20, 1 << 16

# the processes that plan a stream and read it need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Piece(InputPartition):
    """Lines of ``file`` that begin in ``start:end``, where ``low`` is the beginning of a line."""

    def __init__(self, file: str, low: int, start: int, end: int):
        self.file, self.low, self.start, self.end = file, low, start, end


class GrowingLines(DataSource):
    """``path``: a folder, read with all folders below; names that begin with ``_`` or ``.`` are passed over."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(self.options["path"], int(self.options.get("pieceBytes", PIECE)))


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = [f"/{mark}" for mark in "_."]
        return system, [f for f in found if f.is_file and not any(mark in f.path[len(root):] for mark in hidden)]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, files = self._files()
        ends = {f.path: self._last_line_end(system, f) for f in files}
        return {path: end for path, end in ends.items() if end}

    @staticmethod
    def _last_line_end(system: fs.FileSystem, info: fs.FileInfo) -> int:
        end = info.size
        with system.open_input_file(info.path) as file:
            while end > 0:
                start = max(0, end - LOOK)
                at = file.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces = []
        for file, last in sorted(end.items()):
            first = start.get(file, 0)
            pieces += [Piece(file, first, at, min(at + self.piece, last)) for at in range(first, last, self.piece)]
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        with system.open_input_stream(partition.file) as file:
            # the line that holds the byte before the piece belongs to the piece before
            at = partition.start if partition.start == partition.low else partition.start - 1
            file.seek(at) if file.seekable() else file.read(at)
            rest, skip = b"", at < partition.start
            while at < partition.end or rest:
                data = file.read(LOOK)
                if not data:
                    return
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    if not skip:
                        if at >= partition.end:
                            return
                        yield line.decode("utf-8", "replace"), partition.file, at
                    skip, at = False, at + len(line) + 1
                if at >= partition.end:
                    return

    def commit(self, end: dict) -> None:
        pass


def growing_feed(spark: SparkSession, path: str, *, piece_bytes: int = PIECE) -> DataFrame:
    """The messages of a folder as a stream of ``value, file, at`` that also sees what is appended to known files.

    The offset has an entry per file: meant for folders with a bounded number of files that grow, such as logs that are
    rotated. Files must not shrink or change. ``at`` is the byte where the line begins, in order within a file.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("path", path).option("pieceBytes", piece_bytes).load()
