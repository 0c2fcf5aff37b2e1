"""A Python data source that replays recorded feed messages, in batch and as a stream.

``spark.dataSource.register(FeedSource)``, then ``spark.readStream.format("recorded_feed").option("lines", …)`` for a few messages, or
``spark.read.format("recorded_feed").load(folder)`` for recorded files, each of which is read by a task of its own. Offsets are line numbers, of the n-th file
from n * FILE on; a message that does not parse is kept with a null type, so that one bad message never ends the feed.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

FILE = 1 << 40
SCHEMA = "n long, ts_ms long, type string, body string"


def parse(n: int, line: str) -> tuple:
    try:
        m = json.loads(line)
        return n, int(m.get("ts", 0)), str(m.get("type")), json.dumps(m.get("data"))
    except (ValueError, AttributeError, TypeError):
        return n, 0, None, line


class _Batch(DataSourceReader):
    def __init__(self, lines: list[str], parts: int):
        self.lines, self.parts = lines, max(1, parts)

    def partitions(self) -> list[InputPartition]:
        size = -(-len(self.lines) // self.parts) or 1
        return [InputPartition((a, self.lines[a : a + size])) for a in range(0, len(self.lines), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, lines = partition.value
        return (parse(at + k, x) for k, x in enumerate(lines))


class _Files(DataSourceReader):
    """One partition a file: the driver lists the names only."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file)
        return [InputPartition((k * FILE, name)) for k, name in enumerate(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, name = partition.value
        fs, _ = pafs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with fs.open_input_stream(name) as f:
            for k, line in enumerate(io.TextIOWrapper(f, encoding="utf-8", errors="replace")):
                if line := line.rstrip("\n"):
                    yield parse(at + k, line)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, lines: list[str], step: int):
        self.lines, self.step = lines, step

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(len(self.lines), start["n"] + self.step)
        return (parse(n, self.lines[n]) for n in range(start["n"], end)), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (parse(n, self.lines[n]) for n in range(start["n"], end["n"]))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_feed"

    def schema(self) -> str:
        return SCHEMA

    def _lines(self) -> list[str]:
        return [x for x in self.options.get("lines", "").split("\n") if x]

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"]) if "path" in self.options else _Batch(self._lines(), int(self.options.get("parts", "2")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self._lines(), int(self.options.get("step", "100")))
