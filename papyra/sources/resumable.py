"""Lines of files as a stream that goes on where it stopped, by file, byte and signature.

The offset of the stream holds for each file how many bytes are done, up to the end of a line, and a digest of the first of them.  A
file may grow between runs, and new files may come; a file whose beginning is another one than when it was read, or that has become
shorter, is refused.  Ranges of bytes are dealt to tasks, which find the line ends themselves, so the driver reads
no lines but looks for the last line end of each file.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE, HEAD, LINES = 8 << 20, 1 << 16, 4096
SCHEMA = "file string, at long, value string"


class _Range(InputPartition):
    """Lines of ``file`` that begin at bytes from ``first`` to before ``last``."""

    def __init__(self, file: str, first: int, last: int, aligned: bool):
        self.file, self.first, self.last, self.aligned = file, first, last, aligned


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        store, root = self._store()
        found = {}
        for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                with store.open_input_file(info.path) as f:
                    found[info.base_name] = self._done(f, info.size)
        return {"files": found}

    @staticmethod
    def _done(f, size: int) -> list:
        """[bytes up to the last line end, digest of the first of them]."""
        low = size
        while low:
            high, low = low, max(0, low - HEAD)
            f.seek(low)
            if (at := f.read(high - low).rfind(b"\n")) >= 0:
                return [low + at + 1, _Reader._digest(f, low + at + 1)]
        return [0, _Reader._digest(f, 0)]

    @staticmethod
    def _digest(f, done: int) -> str:
        f.seek(0)
        return hashlib.md5(f.read(min(done, HEAD))).hexdigest()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, root = self._store()
        ranges = []
        for name, (upto, _) in sorted(end["files"].items()):
            done, digest = start["files"].get(name, (0, None))
            if done:
                with store.open_input_file(f"{root}/{name}") as f:
                    if upto < done or self._digest(f, done) != digest:
                        raise ValueError(f"{name} is not the file that was read before")
            ranges += [_Range(name, k, min(k + RANGE, upto), k == done) for k in range(done, upto, RANGE)]
        return ranges

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        with store.open_input_file(f"{root}/{part.file}") as native, io.BufferedReader(native, 1 << 20) as f:
            f.seek(part.first if part.aligned else part.first - 1)
            if not part.aligned:
                f.readline()  # the rest of a line that begins before this range
            places, lines = [], []
            while (at := f.tell()) < part.last and (line := f.readline()):
                places.append(at)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                if len(lines) == LINES:
                    yield self._batch(part.file, places, lines)
                    places, lines = [], []
            if lines:
                yield self._batch(part.file, places, lines)

    @staticmethod
    def _batch(file: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "at", "value"])

    def commit(self, end: dict) -> None:
        pass


class ResumableLines(DataSource):
    """``spark.readStream.format("resumable_lines").option("path", folder)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "resumable_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResumableLines)
