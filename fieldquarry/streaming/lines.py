"""A sink for event-stream lines: each micro-batch's lines once, however often it is run.

A task writes the lines of its part of an epoch to a file of its own; the epoch's commit lists the
files of the attempts that count in one small file named by the epoch. An epoch that is replayed
after a failure writes its list again, so readers see each line once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from fieldquarry.sources.shared import located


@dataclass
class Part(WriterCommitMessage):
    name: str
    lines: int


class LineWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str, column: str) -> None:
        self.folder, self.column = folder, column

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        where, base = located(self.folder)
        where.create_dir(f"{base}/parts", recursive=True)
        name, n = f"{uuid.uuid4().hex}.txt", 0
        with where.open_output_stream(f"{base}/parts/{name}", compression=None) as out:
            for batch in iterator:
                for line in batch.column(self.column).to_pylist():
                    if line is not None:
                        out.write(line.encode())
                        n += 1
        return Part(name, n)

    def commit(self, messages: list, batchId: int) -> None:
        where, base = located(self.folder)
        where.create_dir(f"{base}/epochs", recursive=True)
        parts = [m.name for m in messages if m is not None and m.lines]
        with where.open_output_stream(f"{base}/epochs/.{batchId}") as out:
            out.write(json.dumps(parts).encode())
        where.move(f"{base}/epochs/.{batchId}", f"{base}/epochs/{batchId:012d}.json")

    def abort(self, messages: list, batchId: int) -> None:
        where, base = located(self.folder)
        for m in messages:
            if m is not None:
                where.delete_file(f"{base}/parts/{m.name}")


class LineSink(DataSource):
    """`format("event_lines")`. Options: path; column, which holds lines with their own ends."""

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "line string"

    def streamWriter(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], self.options.get("column", "line"))


def write_lines(lines: DataFrame, folder: str, checkpoint: str, column: str = "line"):
    """Start a stream of lines into a folder; what is there by now is written, then it ends."""
    lines.sparkSession.dataSource.register(LineSink)
    return lines.select(column).writeStream.format("event_lines").option("column", column).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_files(folder: str) -> list[str]:
    """Files of the committed epochs, in their order."""
    where, base = located(folder)
    out = []
    for f in sorted(where.get_file_info(fs.FileSelector(f"{base}/epochs", allow_not_found=True)), key=lambda f: f.base_name):
        if f.base_name.endswith(".json"):
            with where.open_input_stream(f.path) as held:
                out += [f"{folder.rstrip('/')}/parts/{name}" for name in json.loads(held.read())]
    return out


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value): the lines of committed epochs, each once."""
    files = committed_files(folder)
    return spark.read.option("lineSep", "\n\n").text(files) if files else spark.createDataFrame([], "value string")
