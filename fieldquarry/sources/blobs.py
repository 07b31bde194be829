"""A sink for binary files: each row is a file, and only what a job commits is there; and its reader.

A task writes its files below a staged folder of its own. The job's commit moves each finished
task's folder into place (one rename a task), so a task that runs twice, or a job that fails, leaves
one copy or none. Read back, a task lists and opens the files of one such folder, so that the driver
knows folders only, not files. Names that occur twice in one folder are told apart before writing (`distinct_names`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fieldquarry.sources.shared import located


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class BlobWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        where, base = located(self.folder)
        own = f"{base}/{self.job}/part-{uuid.uuid4().hex}"
        made: set[str] = set()
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name is None or content is None or ".." in name.split("/") or name.startswith("/"):
                    raise ValueError(f"not a file: {name!r}")
                path = f"{own}/{name}"
                if (parent := path.rsplit("/", 1)[0]) not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                with where.open_output_stream(path, compression=None) as out:
                    out.write(content)
        return Staged(own if made else "")

    def commit(self, messages: list) -> None:
        where, base = located(self.folder)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    where.delete_dir(old.path)
        for m in messages:
            if m is not None and m.folder:
                where.move(m.folder, f"{base}/{m.folder.rsplit('/', 1)[1]}")
        self._clear(where, base)

    def abort(self, messages: list) -> None:
        self._clear(*located(self.folder))

    def _clear(self, where: fs.FileSystem, base: str) -> None:
        if where.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            where.delete_dir(f"{base}/{self.job}")


#: Bytes and files of a batch that is read, about.
BATCH_BYTES, BATCH_FILES = 4 << 20, 1000


@dataclass
class Part(InputPartition):
    folder: str | None


class BlobReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[Part]:
        where, base = located(self.folder)
        listed = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [Part(f.path) for f in sorted(listed, key=lambda f: f.path) if f.type == fs.FileType.Directory and f.base_name.startswith("part-")] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, _ = located(self.folder)
        names, contents, held = [], [], 0
        listed = where.get_file_info(fs.FileSelector(partition.folder, recursive=True)) if partition.folder else []
        for path in sorted(f.path for f in listed if f.is_file):
            with where.open_input_file(path) as f:
                contents.append(f.read())
            names.append(path[len(partition.folder) + 1 :])
            held += len(contents[-1])
            if held > BATCH_BYTES or len(names) >= BATCH_FILES:
                yield pa.RecordBatch.from_pydict({"name": names, "content": contents}, FILES)
                names, contents, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"name": names, "content": contents}, FILES)


FILES = pa.schema([("name", pa.string()), ("content", pa.binary())])


class BlobSink(DataSource):
    """`format("blobs")`: rows (name, content) become files <path>/part-.../<name>, and are read from them."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"], overwrite)

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options["path"])


def write_files(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows (name, content) as files; read them with `read_files` (or, a few, with `binaryFile` and recursiveFileLookup)."""
    files.sparkSession.dataSource.register(BlobSink)
    files.select("name", "content").write.format("blobs").mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of all files that `write_files` wrote to a folder."""
    spark.dataSource.register(BlobSink)
    return spark.read.format("blobs").load(folder)


def distinct_names(files: DataFrame, *order: str) -> DataFrame:
    """files with `_2`, `_3` ... before the ending of names that came before in `order`; the same in every run."""
    n = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return files.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.regexp_replace("name", F.lit(r"(?s)\A(.*?)(\.[^./]*)?\z"), F.concat(F.lit("$1_"), n.cast("string"), F.lit("$2")))))
