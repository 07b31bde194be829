"""Pages of document files as a Spark data source: planned by file and share, with pushed filters.

Small files are read several to a task; a large PDF is read in shares of its pages by several tasks,
each of which opens only the pages of its share. Filters on `page` and `path` are taken over: with
`page = 1` no other page is opened, files whose path does not fit are not opened at all.

Rows: path, page (from 1), n_pages, text, error. A page that cannot be read has null text and the
error; a file that cannot be read is one row of page 0. PDF files are known by their ending; all
others are UTF-8 texts with form feeds between pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from fieldquarry.sources.pdf import Pdf
from fieldquarry.sources.shared import located

SCHEMA = "path string, page int, n_pages int, text string, error string"
ARROW = pa.schema([("path", pa.string()), ("page", pa.int32()), ("n_pages", pa.int32()), ("text", pa.string()), ("error", pa.string())])
#: Bytes of files that a task reads, about: larger PDF files are shared among tasks.
SPLIT = 16 << 20
#: Characters of texts in a batch, about.
BATCH = 4 << 20


@dataclass
class Wanted:
    """What filters leave: pages between two numbers, perhaps only listed ones, and tests on the path."""

    low: int = 0
    high: int | None = None
    listed: set[int] | None = None
    paths: list[Callable[[str], bool]] = field(default_factory=list)

    def take(self, f: ds.Filter) -> bool:
        """Whether the filter is applied from now on."""
        if getattr(f, "attribute", None) == ("page",):
            v = getattr(f, "value", None)
            if isinstance(f, ds.EqualTo) and v is not None:
                self.low, self.high = max(self.low, v), v if self.high is None else min(self.high, v)
            elif isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual):
                self.low = max(self.low, v + isinstance(f, ds.GreaterThan))
            elif isinstance(f, ds.LessThan | ds.LessThanOrEqual):
                v -= isinstance(f, ds.LessThan)
                self.high = v if self.high is None else min(self.high, v)
            elif isinstance(f, ds.In) and None not in v:
                self.listed = set(v) if self.listed is None else self.listed & set(v)
                self.low, self.high = max(self.low, min(v, default=1)), max(v, default=0) if self.high is None else min(self.high, max(v, default=0))
            else:
                return isinstance(f, ds.IsNotNull)
            return True
        if getattr(f, "attribute", None) == ("path",):
            tests = {ds.EqualTo: lambda p, v=getattr(f, "value", None): p == v, ds.StringStartsWith: lambda p, v=getattr(f, "value", None): p.startswith(v), ds.StringEndsWith: lambda p, v=getattr(f, "value", None): p.endswith(v), ds.StringContains: lambda p, v=getattr(f, "value", None): v in p}
            if type(f) in tests and getattr(f, "value", None) is not None:
                self.paths.append(tests[type(f)])
                return True
            return isinstance(f, ds.IsNotNull)
        return False

    def has(self, page: int) -> bool:
        return page >= self.low and (self.high is None or page <= self.high) and (self.listed is None or page in self.listed)


@dataclass
class Share(ds.InputPartition):
    """Files read whole, or the i-th of k shares of one file's pages."""

    files: list[tuple[str, int]]
    i: int = 0
    k: int = 1


class PageReader(ds.DataSourceReader):
    def __init__(self, folder: str, glob: str, split: int) -> None:
        self.folder, self.glob, self.split, self.wanted = folder, glob, split, Wanted()

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Share]:
        where, base = located(self.folder)
        listed = where.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(base) :].split("/"))
        files = sorted((f.path, f.size) for f in listed if f.is_file and not hidden(f.path) and fnmatch(f.base_name, self.glob) and all(t(f.path) for t in self.wanted.paths))
        out, group, held = [], [], 0
        few = self.wanted.high is not None and self.wanted.high - self.wanted.low < 64
        for path, size in files:
            if size > self.split and path.lower().endswith(".pdf") and not few:
                shares = -(-size // self.split)
                out += [Share([(path, size)], i, shares) for i in range(shares)]
                continue
            cost = min(size, 1 << 18) if few else size
            if group and held + cost > self.split:
                out.append(Share(group))
                group, held = [], 0
            group.append((path, size))
            held += cost
        return [*out, Share(group)] if group or not out else out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        where, _ = located(self.folder)
        rows, held = [], 0
        for path, size in partition.files:
            for row in self.pages(where, path, size, partition):
                rows.append((path, *row))
                held += len(row[2] or "")
                if held > BATCH or len(rows) >= 1000:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def pages(self, where, path: str, size: int, share: Share) -> Iterator[tuple]:
        """(page, n_pages, text, error) of the wanted pages of a file's share."""
        try:
            with where.open_input_file(path) as f:
                if path.lower().endswith(".pdf"):
                    pdf = Pdf(size, lambda at, n: f.read_at(n, at))
                    n, text = pdf.n_pages, pdf.text
                else:
                    parts = f.read().decode("utf-8").split("\f")
                    n, text = len(parts), parts.__getitem__
                first, last = share.i * n // share.k, (share.i + 1) * n // share.k
                last = last if self.wanted.high is None else min(last, self.wanted.high)
                for i in range(max(first, self.wanted.low - 1), last):
                    if self.wanted.has(i + 1):
                        try:
                            yield i + 1, n, text(i), None
                        except Exception as e:
                            yield i + 1, n, None, told(e)
        except Exception as e:
            if share.i == 0 and self.wanted.has(0):
                yield 0, None, None, told(e)


def told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:200]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class PageSource(ds.DataSource):
    """`format("pages")`. Options: glob (of file names), split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], self.options.get("glob", "*"), int(self.options.get("split", SPLIT)))


def read_pages(spark: SparkSession, folder: str, glob: str = "*", split: int = SPLIT) -> DataFrame:
    """All pages of a folder's files. Lets Python data sources take filters over (a setting of the session)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").option("glob", glob).option("split", str(split)).load(folder)
