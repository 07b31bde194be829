"""Web archives: WARC files as a Spark data source, and capture histories by external merge.

`WarcSource` writes rows as gzip-compressed WARC records, one member each, into archive files of
bounded size and reads archives back, one task an archive. A task that is run again writes other
files; only those that the commit lists are part of the archive.

Pages whose payloads of at least `LEAST` bytes are equal are stored once: the least page_id's record
is a response, the others are revisits that refer to it. What archives hold is read back as index
entries. Each task sorts what it reads into runs; sampled keys cut the key space into buckets, and
every bucket's slices of runs are merged by a loser tree. Keys end with the place in the archive, so
no two are equal and one URL's captures split over as many buckets as they need.

Defined results: null html is empty; null url has no target (its key is empty and comes first); null
page_id sorts last and, in a group with other ids, is a revisit; rows that repeat the least page_id
of their group are all responses; empty tables give no rows. Other columns are ignored. Control
characters and blanks of a URL are percent-encoded, as a header line cannot hold them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fieldquarry.llm.common import Scratch, shared_dir, small_batches

#: Payloads from this many bytes on are stored once.
LEAST = 100
#: An archive is closed when it holds so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Entries of a sorted run, and of a block, in which runs are stored.
RUN, BLOCK = 65_536, 1024
#: Expected entries of a bucket; buckets at most; sampled keys at most, about.
BUCKET, BUCKETS, SAMPLE = 65_536, 10_000, 100_000
#: Repeated digests up to this number are broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 200_000
#: Digests of over a share of 1/HOT of all rows (so fewer than HOT) are broadcast always.
HOT = 1000

NAMES = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "uri": "WARC-Target-URI", "captured": "WARC-Date"}
SCHEMA = "archive string, position long, length long, record_type string, record_id string, refers_to string, uri string, captured string, payload_bytes long, payload_digest string, payload binary, error string"
WRITTEN = "record_type string, record_id string, refers_to string, uri string, captured string, payload_digest string, payload binary"


# ---- records ------------------------------------------------------------------------------------
def header_value(text: str) -> str:
    """text without what would end a header line: controls and blanks as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict) -> bytes:
    """One WARC record. A revisit has the response's HTTP head, whose length tells the payload's, and no body."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1", *(f"{name}: {header_value(row[key])}" for key, name in NAMES.items() if row.get(key) is not None)]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header fields of a block of lines from `at`, names in lower case, and where its body begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def parsed(data: bytes) -> dict:
    """A record's fields; the payload is taken from the bytes, a revisit's length and digest from its heads."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields, start = head(data, 0)
    size = int(fields["content-length"])
    if len(data) < start + size:
        raise ValueError("record cut short")
    out = {key: fields.get(name.lower()) for key, name in NAMES.items()} | {"payload": None, "payload_bytes": None, "payload_digest": None, "error": None}
    block = data[start : start + size]
    said = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if out["record_type"] == "revisit":
        http, _ = head(block, 0)
        return out | {"payload_bytes": int(http["content-length"]), "payload_digest": said}
    payload = block[head(block, 0)[1] :] if "http" in fields.get("content-type", "") else block
    digest = hashlib.sha256(payload).hexdigest()
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "error": None if said in (None, digest) else "payload differs from its digest"}


def members(stream, step: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored length, bytes) of each gzip member; plain archives are cut by their records' lengths."""
    rest, offset = stream.read(max(2, step)), 0
    packed = rest[:2] == b"\x1f\x8b"
    while rest:
        if packed:
            unzip, out, used = zlib.decompressobj(31), [], 0
            while not unzip.eof:
                if not rest:
                    rest = stream.read(step)
                    if not rest:
                        raise ValueError("member cut short")
                out.append(unzip.decompress(rest))
                used, rest = used + len(rest) - len(unzip.unused_data), unzip.unused_data
            yield offset, used, b"".join(out)
        else:
            while b"\r\n\r\n" not in rest and (more := stream.read(step)):
                rest += more
            fields, start = head(rest, 0)
            used = start + int(fields["content-length"]) + 4
            held, have = [rest], len(rest)
            while have < used and (more := stream.read(max(step, used - have))):
                held.append(more)
                have += len(more)
            rest = b"".join(held)
            yield offset, min(used, have), rest[:used]
            rest = rest[used:]
        offset += used
        rest = rest or stream.read(step)


# ---- data source --------------------------------------------------------------------------------
def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Archive(InputPartition):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, limit: int) -> None:
        self.folder, self.limit = folder, limit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = opened(self.folder)
        where.create_dir(base, recursive=True)
        out, size, files = None, 0, []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = where.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                    zip_ = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = zip_.compress(record(row)) + zip_.flush()
                    out.write(data)
                    size += len(data)
                    if size >= self.limit:
                        out.close()
                        out = None
        except BaseException:
            if out is not None:
                out.close()
            for name in files:
                where.delete_file(f"{base}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, base = opened(self.folder)
        where.create_dir(base, recursive=True)
        names = sorted(name for m in messages if m is not None for name in m.files)
        with where.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        where, base = opened(self.folder)
        for m in messages:
            for name in m.files if m is not None else []:
                where.delete_file(f"{base}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool) -> None:
        self.folder, self.payload = folder, payload

    def partitions(self) -> list[Archive]:
        """One for each archive that a manifest lists; without manifests, every archive of the folder."""
        where, base = opened(self.folder)
        found = [f.path for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file]
        listed = [p for p in found if re.search(r"/manifest-\w+\.json$", p)]
        if not listed:
            return [Archive(p.rsplit("/", 1)[1]) for p in sorted(found) if re.search(r"\.warc(\.gz)?$", p)]
        names = set()
        for p in listed:
            with where.open_input_stream(p) as lines:
                names.update(json.loads(lines.read()))
        return [Archive(n) for n in sorted(names)]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        where, base = opened(self.folder)
        kinds = [pa.field(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (c.split() for c in SCHEMA.split(", "))]
        rows, held = [], 0
        with where.open_input_stream(f"{base}/{partition.name}", compression=None) as stream:
            try:
                for position, length, data in members(stream):
                    row = {"archive": partition.name, "position": position, "length": length} | parsed(data)
                    held += len(row["payload"] or b"") if self.payload else 0
                    rows.append(row if self.payload else row | {"payload": None})
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                        rows, held = [], 0
            except (ValueError, KeyError, zlib.error) as e:  # what comes after damage cannot be found
                rows.append({"archive": partition.name, "record_type": "damaged", "error": f"{type(e).__name__}: {e}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


class WarcSource(DataSource):
    """`format("warc")`: folders of WARC archives. Options: payload=false leaves payloads out of what is read, limit is the archive size."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("limit", ARCHIVE_BYTES)))


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> None:
    """Append records (columns of WRITTEN) to a folder of archives."""
    records.sparkSession.dataSource.register(WarcSource)
    names = [c.split()[0] for c in WRITTEN.split(", ")]
    small_batches(records).select(*names).write.format("warc").mode("append").option("limit", str(limit)).save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records of a folder of archives; a damaged archive gives its sound records and one row with `error`."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


# ---- pages to records ---------------------------------------------------------------------------
def records_of(pages: DataFrame, scratch: Scratch, captured, least: int = LEAST, broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """A record for each row of (page_id, url, html). captured: a timestamp column over them.

    Digests are counted with map-side sums. Few repeated ones are broadcast; else only the hottest,
    fewer than HOT by their share, and rows of all others are joined by shuffle, so that no
    digest of the shuffle has more than 1/HOT of the rows.
    """
    rows = pages.select("page_id", "url", captured.alias("captured"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    sums = rows.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = scratch.put(sums.where("n > 1"), "warc-repeated")
    few = repeated.count() <= broadcast
    if few:
        typed = rows.join(F.broadcast(repeated), "payload_digest", "left")
    else:
        share = pages.count() / HOT
        hot = F.broadcast(repeated.where(F.col("n") > share))
        of_hot = rows.join(hot, "payload_digest")
        rest = rows.join(hot, "payload_digest", "left_anti").join(repeated.where(F.col("n") <= share).hint("merge"), "payload_digest", "left")
        typed = of_hot.unionByName(rest)
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return typed.select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.when(revisits, urn("first")).alias("refers_to"),
        F.col("url").alias("uri"), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), "payload_digest", "payload",
    )


# ---- capture index ------------------------------------------------------------------------------
ENTRY = pa.struct([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("position", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
ENTRY_SQL = "url_key string, captured string, page_id long, archive string, position long, payload_bytes long, payload_digest string, record_type string, refers_to long"
BLOCKS = f"run string, block int, entries array<struct<{ENTRY_SQL.replace(' string', ': string').replace(' long', ': long')}>>"


def url_key(url: str | None) -> str:
    """Host labels reversed and in lower case, then path and query: captures of a site sort together."""
    m = re.fullmatch(r"(?s)[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)(#.*)?", url or "")
    if m is None:
        return url or ""
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def key_of(e: dict) -> tuple:
    """Order of captures: URL key, time, page (null last), place in the archives. No two are equal."""
    page = e["page_id"]
    return (0, e["url_key"], e["captured"] or "", page is None, page or 0, e["archive"], e["position"])


def _run_blocks(entries: list[dict]) -> pa.RecordBatch:
    run = f"{entries[0]['archive']}:{entries[0]['position']}"
    entries.sort(key=key_of)
    cut = [entries[i : i + BLOCK] for i in range(0, len(entries), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array([run] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.list_(ENTRY))], ["run", "block", "entries"])


def _runs(batches):
    """Sorted runs, as blocks, of the records that a task reads."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if r["error"] is not None:
                raise ValueError(f"{r['archive']}: {r['error']}")
            held.append({"url_key": url_key(r["uri"]), "captured": re.sub(r"\D", "", r["captured"] or ""), "page_id": page_of(r["record_id"]), "refers_to": page_of(r["refers_to"]), **{k: r[k] for k in ("archive", "position", "payload_bytes", "payload_digest", "record_type")}})
            if len(held) >= RUN:
                yield _run_blocks(held)
                held = []
    if held:
        yield _run_blocks(held)


def sorted_runs(records: DataFrame) -> DataFrame:
    """(run, block, entries): locally sorted index entries. Damage in an archive is an error here."""
    names = ("archive", "position", "record_type", "record_id", "refers_to", "uri", "captured", "payload_bytes", "payload_digest", "error")
    return records.select(*names).mapInArrow(_runs, BLOCKS)


def bounds_of(runs: DataFrame, bucket: int = BUCKET) -> list[tuple]:
    """Keys that cut all entries into buckets: quantiles of the blocks' first keys, at most SAMPLE of which are fetched."""
    n = runs.agg(F.sum(F.size("entries")).alias("n"), F.count("*").alias("blocks")).first()
    if not n["n"]:
        return []
    part = min(1.0, SAMPLE / n["blocks"])
    taken = runs.where(F.pmod(F.xxhash64("run", "block"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else runs
    keys = sorted(key_of(r["e"].asDict()) for r in taken.select(F.col("entries")[0].alias("e")).collect())
    count = min(BUCKETS, -(-n["n"] // bucket), len(keys))
    return sorted({keys[i * len(keys) // count] for i in range(1, count)})


def split_runs(runs: DataFrame, bounds: list[tuple]) -> DataFrame:
    """(bucket, run, block, n, entries): blocks cut at the bounds."""
    held = runs.sparkSession.sparkContext.broadcast(bounds)

    def cut(batches):
        for b in batches:
            out = []
            for run, block, entries in zip(b.column("run").to_pylist(), b.column("block").to_pylist(), b.column("entries").to_pylist(), strict=True):
                keys = [key_of(e) for e in entries]
                # bucket i holds keys from bounds[i-1] on, below bounds[i]
                at = 0
                while at < len(keys):
                    i = bisect_right(held.value, keys[at])  # bucket i holds keys from bounds[i - 1] on, below bounds[i]
                    end = bisect_left(keys, held.value[i], at) if i < len(held.value) else len(keys)
                    out.append((i, run, block, end - at, entries[at:end]))
                    at = end
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(ENTRY)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "run", "block", "n", "entries"])

    return runs.mapInArrow(cut, "bucket int, " + BLOCKS.replace("entries", "n long, entries"))


#: Greater than every key: a source that has ended.
ENDED = (1,)


class LoserTree:
    """A tournament of k sorted sources: each inner node keeps the loser of its match, `winner` won all of its own."""

    def __init__(self, keys: list[tuple]) -> None:
        self.keys = keys
        self.k = len(keys)
        self.losers = [0] * self.k
        best = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self.losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
        self.winner = best[1] if self.k > 1 else 0

    def rival(self) -> tuple:
        """Least key among those that lost to the winner: up to it, the winner's source needs no match."""
        node, least = (self.k + self.winner) // 2, ENDED
        while node:
            least = min(least, self.keys[self.losers[node]])
            node //= 2
        return least

    def replace(self, key: tuple) -> None:
        """The winner's source goes on at `key`; only matches on its way up are played again."""
        at = self.winner
        self.keys[at] = key
        node = (self.k + at) // 2
        while node:
            if self.keys[self.losers[node]] < self.keys[at]:
                self.losers[node], at = at, self.losers[node]
            node //= 2
        self.winner = at


def merged(sources: list[Iterator[list[dict]]]) -> Iterator[dict]:
    """Entries of k sources, each an iterator of sorted blocks, in the order of their keys."""
    blocks = [next(s, []) for s in sources]
    keys = [[key_of(e) for e in b] for b in blocks]
    at = [0] * len(sources)
    tree = LoserTree([k[0] if k else ENDED for k in keys])
    while sources and tree.keys[tree.winner] != ENDED:
        w, rival = tree.winner, tree.rival()
        end = bisect_left(keys[w], rival, at[w])
        yield from blocks[w][at[w] : end]
        at[w] = end
        if end == len(keys[w]):
            blocks[w], at[w] = next(sources[w], []), 0
            keys[w] = [key_of(e) for e in blocks[w]]
        tree.replace(keys[w][at[w]] if keys[w] else ENDED)


def _merge_bucket(table: pa.Table) -> pa.Table:
    table = table.sort_by([("run", "ascending"), ("block", "ascending")]).combine_chunks()
    runs, entries = table.column("run").to_pylist(), table.column("entries").chunk(0)
    starts = [i for i, r in enumerate(runs) if i == 0 or r != runs[i - 1]]
    sources = [(entries[i].as_py() for i in range(a, b)) for a, b in zip(starts, [*starts[1:], len(runs)], strict=True)]
    rows, parts = [], []
    for e in merged(sources):
        rows.append(e)
        if len(rows) == 16_384:
            parts.append(pa.array(rows, ENTRY))
            rows = []
    parts.append(pa.array(rows, ENTRY))
    whole = pa.chunked_array(parts, ENTRY).combine_chunks()
    whole = whole if isinstance(whole, pa.StructArray) else whole.chunk(0)
    n = len(whole)
    return pa.table([pa.array([table.column("bucket")[0].as_py()] * n, pa.int32()), pa.array(range(1, n + 1), pa.int64()), *whole.flatten()], names=["bucket", "place", *(f.name for f in ENTRY)])


def capture_history(records: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """Index entries of all records with `capture_no`, their place (from 1) in the order of URL key, time and page."""
    runs = scratch.put(sorted_runs(records), "warc-runs")
    slices = scratch.put(split_runs(runs, bounds_of(runs, bucket)), "warc-slices")
    merged_ = slices.groupBy("bucket").applyInArrow(_merge_bucket, f"bucket int, place long, {ENTRY_SQL}")
    sizes = slices.groupBy("bucket").agg(F.sum("n").alias("n"))  # at most BUCKETS rows
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    return merged_.join(F.broadcast(before), "bucket").withColumn("capture_no", F.col("before") + F.col("place")).drop("bucket", "place", "before")


def op11_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no capture time; the query takes one second after another of a year, by page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch, folder = Scratch(), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id"), F.lit(31_536_000)))
        write_archives(records_of(pages, scratch, captured), folder)
        found = capture_history(read_archives(spark, folder, payload=False), scratch)
        columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_no")
        return scratch.finish(found.select(*columns), "warc-history")
    finally:
        scratch.clear()
        drop_folder(spark, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
d AS (SELECT page_id, url, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first,
             regexp_matches(url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://.*') AS full_url,
             regexp_replace(url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g') AS rest FROM d),
k AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host,
             strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y%m%d%H%M%S') AS captured FROM f),
u AS (SELECT *, CASE WHEN full_url THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')'
                     || coalesce(nullif(substr(rest, length(host) + 1), ''), '/') ELSE url END AS url_key FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url_key, captured,
       row_number() OVER (ORDER BY url_key, captured, page_id) AS capture_no
FROM u
"""
