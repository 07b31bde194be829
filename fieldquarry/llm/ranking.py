"""Ranked lexical search: document-sharded postings with integer impacts, scored term at a time.

A shard holds the postings of about `SHARD_BYTES` of consecutive texts, where these lie, as a CSR
matrix by term: for every term of the index's vocabulary the positions of the documents that hold it
and how often. Document counts, lengths and frequencies are sums over all shards; a second pass
turns each posting into its impact. A search adds impacts into a dense accumulator per shard, takes
the best by partition (with all ties at the cut, which doc_id then decides), and merges by task,
then by query. Documents are never shuffled.

The query set is worked off in blocks of about `QUERIES` distinct texts; the index of a block has the
block's terms only, so what a task is sent is bounded by the block and not by the corpus.

Defined results: a null text has no terms, and documents without terms are not counted; a null
doc_id comes last among equal scores; repeated rows are documents of their own; repeated items are
ranked each; items without a scoring document, and empty tables, give no rows. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldquarry.llm.common import Scratch, arrow_words, joined, small_batches, text_slices

#: Text bytes and documents of a shard, about; a longer document is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 65_536
#: Distinct query texts of a block, about.
QUERIES = 20_000
TOP = 10
#: What ends a term: every ASCII byte but digits and letters. A-Z become a-z, other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(texts: pa.Array) -> pa.Array:
    """texts with one blank for each byte that ends terms, in lower case."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(FOLD))
    return pa.LargeStringArray.from_buffers(len(texts), offsets, data, None, 0, texts.offset)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in turn, and for each the text that holds it."""
    words, rows = arrow_words(folded(texts), lower=False)
    return words, rows.to_numpy(zero_copy_only=False).astype(np.int64)


# ---- index --------------------------------------------------------------------------------------
def postings(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each text, terms met, first posting of each and the end, positions, counts)."""
    words, rows = terms_of(texts)
    lengths = np.bincount(rows, minlength=len(texts))
    found = pc.index_in(words, value_set=vocabulary)
    known = pc.is_valid(found).to_numpy(zero_copy_only=False)
    term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    cells, counts = np.unique(term * len(texts) + rows[known], return_counts=True)
    of_term, position = np.divmod(cells, max(1, len(texts)))
    terms, starts = np.unique(of_term, return_index=True)
    return lengths, terms, np.append(starts, len(cells)), position, counts


SHARDS = "ids array<long>, lengths binary, terms array<int>, dfs array<int>, positions binary, counts binary"


def shards_of(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Postings of every document, a row for each shard."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def build(batches):
        known = pa.array(held.value, pa.large_string())
        for ids, texts in text_slices(joined(batches, SHARD_BYTES), limit=2 * SHARD_BYTES, most=SHARD_DOCS):
            lengths, terms, starts, positions, counts = postings(texts, known)
            row = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), _packed(lengths, np.int64), pa.array([terms.tolist()], pa.list_(pa.int32())), pa.array([np.diff(starts).tolist()], pa.list_(pa.int32())), _packed(positions, np.int32), _packed(counts, np.int32)]
            yield pa.RecordBatch.from_arrays(row, [c.split()[0] for c in SHARDS.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, SHARDS)


def _packed(values: np.ndarray, kind) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


@dataclass
class Index:
    """Shards with the impact of each posting, all of documents' statistics applied. n_docs and n_terms are the corpus's."""

    shards: DataFrame
    vocabulary: pa.Array
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, vocabulary: pa.Array, scratch: Scratch) -> Index:
    """Index (doc_id, text) by the terms of `vocabulary` (distinct, folded)."""
    raw = scratch.put(shards_of(docs, vocabulary), "postings")
    n_docs, n_terms = 0, 0
    df = np.zeros(len(vocabulary), np.int64)
    lengths = raw.select("lengths").mapInArrow(_length_sums, "n_docs long, n_terms long")
    sums = lengths.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(sums[0] or 0), int(sums[1] or 0)
    pairs = raw.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    met = pairs.toArrow()  # a row for each term of the vocabulary at most
    df[met.column("terms").to_numpy()] = met.column("df").to_numpy()
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    held = raw.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches):
        for b in batches:
            out = []
            for terms, dfs, lengths, positions, counts in zip(*(b.column(c).to_pylist() for c in ("terms", "dfs", "lengths", "positions", "counts")), strict=True):
                m = 25 + 75 * np.frombuffer(lengths, np.int64) * n_docs // max(1, n_terms)
                tf = np.frombuffer(counts, np.int32).astype(np.int64)
                share = 1_000_000_000 * tf // (1000 * tf + 8 * m[np.frombuffer(positions, np.int32)])
                out.append((np.repeat(held.value[np.array(terms, np.int64)], dfs) * share).tobytes())
            cols = [b.column(c) for c in ("ids", "terms", "dfs", "positions")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], ["ids", "terms", "dfs", "positions", "impacts"])

    shards = raw.mapInArrow(weigh, "ids array<long>, terms array<int>, dfs array<int>, positions binary, impacts binary")
    return Index(scratch.put(shards, "impacts"), vocabulary, n_docs, n_terms)


def _length_sums(batches):
    for b in batches:
        all_ = [np.frombuffer(x, np.int64) for x in b.column("lengths").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in all_], pa.int64()), pa.array([int(x.sum()) for x in all_], pa.int64())], ["n_docs", "n_terms"])


# ---- search -------------------------------------------------------------------------------------
def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores above 0, equal ones by ascending id. A partition finds the cut; its ties all compete."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        cut = scores[found[np.argpartition(scores[found], len(found) - k)[len(found) - k]]]
        found = found[scores[found] >= cut]
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


#: Sorts after every id; given for null.
LAST = np.iinfo(np.int64).max


def search(index: Index, queries: list[tuple[str, dict[int, int]]], k: int = TOP) -> DataFrame:
    """(q, doc_id, score) of the k best documents of each query (name, term -> occurrences), with those of other tasks merged in."""
    held = index.shards.sparkSession.sparkContext.broadcast(queries)

    def score(batches):
        best: dict[int, tuple] = {}  # query -> scores, ids (LAST for null), null flags of the best so far
        for b in batches:
            for ids, terms, dfs, positions, impacts in zip(*(b.column(c) for c in ("ids", "terms", "dfs", "positions", "impacts")), strict=True):
                ids = ids.values
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(dfs.values.to_numpy())))
                where = {t: i for i, t in enumerate(terms.as_py())}
                positions, impacts = np.frombuffer(positions.as_py(), np.int32), np.frombuffer(impacts.as_py(), np.int64)
                for q, (_, wanted) in enumerate(held.value):
                    total = None
                    for term, times in wanted.items():
                        if (i := where.get(term)) is not None:
                            total = np.zeros(len(ids), np.int64) if total is None else total
                            total[positions[ends[i] : ends[i + 1]]] += times * impacts[ends[i] : ends[i + 1]]
                    if total is None:
                        continue
                    top = best_of(total, ids, k)
                    new = total[top], ids[top], none[top]
                    if q in best:
                        new = tuple(np.concatenate(x) for x in zip(best[q], new, strict=True))
                        order = np.lexsort((new[2], new[1], -new[0]))[:k]
                        new = tuple(x[order] for x in new)
                    best[q] = new
        for q, (scores, ids, none) in best.items():
            name = pa.array([held.value[q][0]] * len(ids))
            yield pa.RecordBatch.from_arrays([name, pa.array(ids, pa.int64(), mask=none), pa.array(scores, pa.int64())], ["q", "doc_id", "score"])

    parts = index.shards.mapInArrow(score, "q string, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = TOP, block: int = QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents for each row of (item_id, text)."""
    keyed = scratch.put(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("q", F.sha2(F.col("text").cast("binary"), 256)), "query-items")
    texts = scratch.put(keyed.groupBy("q").agg(F.first("text").alias("text")), "query-texts")
    blocks = max(1, -(-texts.count() // block))
    found = None
    for i in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()  # about `block` texts
        words, of_text = terms_of(rows.column("text").combine_chunks())
        vocabulary = pc.unique(words)
        terms = pc.index_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False)
        queries = [(q, {}) for q in rows.column("q").to_pylist()]
        for t, r in zip(terms.tolist(), of_text.tolist(), strict=True):
            queries[r][1][t] = queries[r][1].get(t, 0) + 1
        part = scratch.put(search(build_index(docs, vocabulary, scratch), queries, k), "query-top")
        found = part if found is None else found.unionByName(part)
    return keyed.select("item_id", "q").join(found, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch()
    try:
        out = ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)
        return scratch.finish(out, "query-ranked")
    finally:
        scratch.clear()


def oracle() -> str:
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {terms} AS terms FROM documents),
n AS (SELECT d, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, {terms} AS terms FROM benchmark),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
p AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
m AS (SELECT d, doc_id, 100 - 75 + ((75 * n * nn) // ll) AS m FROM n, s),
r AS (SELECT i, item_id, doc_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
