"""Near-duplicate documents: BagMinHash signatures, bands, exact multiset overlap, components.

A document is the multiset of its five-word shingles (lower-case A-Z, words between white space).
BagMinHash draws, for every shingle and every dyadic level of its weight, a Poisson process of points
over the signature's components; a point of a level that the weight covers in part counts if its
height is below the weight. The least point of each component collides for two documents with the
probability of their weighted Jaccard similarity. Points come in rounds and stop at the largest
component, so long documents need about one point a shingle. Signatures are cut into bands; documents
that share a band are compared by exact multiset overlap, and links at SIMILARITY or more are united.

Copies (equal word sequences) are one node from the start. Each document that shares a bucket first
meets one hub, the member with most neighbours, and linked documents fall together. Of the buckets
that then hold several components, all pairs across components are compared, in blocks of bounded
size: first by their signatures, each pair in the least band that it shares; then, with the shingles
of the rows that remain, as products of membership matrices that give back a spanning forest of
links. So no pair that shares a band is lost, and no table of pairs is ever made.

Defined cases: a text of one to four words is one shingle; null, empty and blank texts have none and
link with nothing; rows that share a doc_id each belong to the class of their own text (equal rows to
one); rows without a doc_id link with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldquarry.llm.common import Scratch, arrow_words, connected_components, forest_roots, joined, small_batches, small_side, store, text_slices, tidy

WORDS, SIMILARITY = 5, (4, 5)
#: Bands and rows of a band: a pair of similarity 0.8 is missed with a chance of 6e-5, one of 0.9 of 1e-11.
BANDS, ROWS = 32, 6
#: Components of two signatures that must agree before their shingles are compared: a pair of similarity 0.8 falls below
#: with a chance of about 1e-11. Pairs whose signatures are compared at once.
AGREE, PAIRS = 115, 8192
#: Documents and shingles of a block that is compared with itself or another; rows and bytes of a cell of blocks; columns of
#: a product.
BLOCK, BLOCK_SHINGLES, CELL, CELL_BYTES, COLUMNS = 512, 500_000, 1024, 4 << 20, 2048
#: Documents of a slice, so that a document's number and a 52-bit shingle hash share a word; its bytes of text.
SLICE_DOCS, HASH_BITS, SLICE_TEXT = 4000, 52, 3 << 20

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, 52-bit shingle, count) sorted, and a 64-bit hash of each document's words (0: none)."""
    import xxhash

    words, rows = arrow_words(texts, lower=True)
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    of = rows.to_numpy(zero_copy_only=False).astype(np.int64)
    h = table[coded.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(0, np.uint64)
    n = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(n) - n
    place = (np.arange(len(of)) - starts[of]).astype(np.uint64)
    whole = np.zeros(len(texts), np.uint64)
    if len(of):
        np.add.at(whole, of, mix(h ^ mix(place * _STEP + np.uint64(1))))
    power = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(WORDS)]
    grams = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        grams += h[k : len(grams) + k] * power[k]
    inside = of[WORDS - 1 :] == of[: len(of) - WORDS + 1] if len(of) >= WORDS else np.zeros(0, bool)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    short = np.array([sum(int(h[starts[d] + k]) * int(power[k]) for k in range(n[d])) + int(n[d]) & (1 << 64) - 1 for d in few], np.uint64)
    doc = np.concatenate([of[: len(grams)][inside], few]).astype(np.uint64)
    value = mix(np.concatenate([grams[inside], short]))
    key = np.sort(doc << np.uint64(HASH_BITS) | value >> np.uint64(64 - HASH_BITS))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), count, mix(whole)


def bag_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n_docs, m) least points; two documents agree in a component with their weighted Jaccard's chance."""
    sig = np.full(n_docs * m, np.inf)
    # levels [0, 1), [1, 2), [2, 4), ...: one process for each that the weight reaches
    reach = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    if (reach == 1).all():
        own, level = np.arange(len(doc)), np.zeros(len(doc), np.int64)
    else:
        own = np.repeat(np.arange(len(doc)), reach)
        level = np.arange(len(own)) - np.repeat(np.cumsum(reach) - reach, reach)
    width = np.where(level > 1, 2.0 ** np.maximum(level - 1, 0), 1.0)
    low = np.where(level > 0, width, 0.0)
    share = np.minimum(1.0, (weight[own] - low) / width)
    seed = mix(item[own] * _STEP + level.astype(np.uint64))
    at, of = np.zeros(len(own)), doc[own]
    top = np.full(n_docs, np.inf)
    turn = 0
    while len(of):
        turn += 1
        r = mix(seed + np.uint64(2 * turn * int(_STEP) & (1 << 64) - 1))
        s = mix(seed + np.uint64((2 * turn + 1) * int(_STEP) & (1 << 64) - 1))
        at = at - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        comp = (s & np.uint64(0xFFFFFFFF)).astype(np.int64) * m >> 32
        counts = (s >> np.uint64(32)).astype(np.float64) * 2.0**-32 < share
        np.minimum.at(sig, (of * m + comp)[counts], at[counts])
        if turn < 4 or turn % 8 == 0:
            live = np.unique(of)
            top[live] = sig.reshape(n_docs, m)[live].max(axis=1)
        keep = at < top[of]
        if not keep.all():
            at, of, seed, width, share = at[keep], of[keep], seed[keep], width[keep], share[keep]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, bits.shape[:2]).copy()
    for r in range(bits.shape[2]):
        key = mix(key ^ mix(bits[:, :, r]))
    return key.view(np.int64)


def _sketch(batches):
    for rows, texts in text_slices(joined(batches, SLICE_TEXT), "row", limit=SLICE_TEXT, most=SLICE_DOCS):
        doc, item, count, whole = shingle_counts(texts)
        total = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        keys = band_keys(bag_minhash(doc, item, count, len(texts)))
        has = total > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
        bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[has].ravel()))
        yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(whole.view(np.int64), mask=~has), pa.array(total), bands], ["doc_id", "text_key", "fp", "n", "bands"])


def _shingle_sets(batches):
    """fp, signature and the multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    for want, texts in text_slices(joined(batches, SLICE_TEXT), "want", limit=SLICE_TEXT, most=SLICE_DOCS):
        doc, item, count, whole = shingle_counts(texts)
        fp = whole.view(np.int64)
        own = np.repeat(np.arange(len(doc)), count)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        tagged = mix(item[own] * _STEP + nth.astype(np.uint64)).view(np.int64)
        sizes = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(tagged))
        sig = mix(bag_minhash(doc, item, count, len(texts)).view(np.uint64).ravel()).astype(np.uint32).view(np.uint8)
        sigs = pa.Array.from_buffers(pa.binary(4 * BANDS * ROWS), len(texts), [None, pa.py_buffer(sig)]).cast(pa.binary())
        asked = pa.array(fp == want.to_numpy())  # of rows that share an id only those with the wanted text
        yield pa.RecordBatch.from_arrays([pa.array(fp), sigs, sets], ["id", "sig", "items"]).filter(asked)


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, components) of a binary column of signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def _alike(agree: int):
    """Of pairs (a, b, sa, sb) those whose signatures agree in so many components or more."""

    def run(batches):
        for b in batches:
            ok = (_signatures(b.column("sa")) == _signatures(b.column("sb"))).sum(axis=1) >= agree
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _cuts(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal rows of sorted columns."""
    if not len(columns[0]):
        return []
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(np.concatenate([[True], new])).tolist()
    return list(zip(starts, [*starts[1:], len(columns[0])], strict=True))


def _block_candidates(table: pa.Table, agree: int) -> pa.Table:
    """Of the blocks of a cell, the rows that some row of another component may be linked with.

    A pair counts only in the least band that it shares, where its signatures agree in `agree` components
    or more and its sizes do not rule it out.
    """
    table = table.combine_chunks().sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
    bucket, i, j, own, n, band, component = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "n", "band", "component"))
    sig = _signatures(table.column("sig"))
    keep = np.zeros(table.num_rows, bool)
    for s, e in _cuts(bucket, i, j):
        if e - s < 2:
            continue
        pair = component[s:e, None] != component[None, s:e]
        pair &= np.minimum(n[s:e, None], n[None, s:e]) * 5 >= np.maximum(n[s:e, None], n[None, s:e]) * 4
        if i[s] != j[s]:
            pair &= own[s:e, None] != own[None, s:e]
        x, y = np.nonzero(np.triu(pair))
        for at in range(0, len(x), PAIRS):
            same = sig[s + x[at : at + PAIRS]] == sig[s + y[at : at + PAIRS]]
            ok = same.sum(axis=1) >= agree
            ok &= same.reshape(len(same), BANDS, ROWS).all(axis=2).argmax(axis=1) == band[s]
            keep[s + x[at : at + PAIRS][ok]] = True
            keep[s + y[at : at + PAIRS][ok]] = True
    return table.select(["bucket", "i", "j", "own", "id", "n", "component"]).filter(pa.array(keep))


def _overlaps(items: list[np.ndarray]) -> np.ndarray:
    """Common elements of all pairs of sets, by products of membership matrices a few columns wide."""
    sizes = np.array([len(x) for x in items])
    of = np.repeat(np.arange(len(items)), sizes)
    _, code, df = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    common = df[code] > 1
    of, code = of[common], np.unique(code[common], return_inverse=True)[1]
    out = np.zeros((len(items), len(items)), np.float32)
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, z = np.searchsorted(code, [first, first + COLUMNS])
        member = np.zeros((len(items), COLUMNS), np.float32)
        member[of[a:z], code[a:z] - first] = 1
        out += member @ member.T
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """A spanning forest of the links across components, for each (bucket, i, j) of a cell."""
    table = table.combine_chunks().sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
    bucket, i, j, own, ids, component = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "id", "component"))
    rows = table.column("items").combine_chunks()
    flat, offsets = rows.values.to_numpy(), rows.offsets.to_numpy()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in _cuts(bucket, i, j):
        common = _overlaps([flat[offsets[k] : offsets[k + 1]] for k in range(s, e)])
        n = np.diff(offsets[s : e + 1])
        link = common * SIMILARITY[1] >= (n[:, None] + n[None, :] - common) * SIMILARITY[0]
        link &= component[s:e, None] != component[None, s:e]
        if i[s] != j[s]:
            link &= own[s:e, None] != own[None, s:e]
        x, y = np.nonzero(link)
        root = forest_roots(x, y, e - s)
        moved = np.flatnonzero(root != np.arange(e - s))
        a.append(ids[s:e][moved])
        b.append(ids[s:e][root[moved]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose multisets overlap enough."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y")).alias("common")
    sized = both.select("a", "b", common, (F.size("x") + F.size("y")).alias("total"))
    return sized.where(F.col("common") * SIMILARITY[1] >= (F.col("total") - F.col("common")) * SIMILARITY[0]).select("a", "b")


def _largest(now: DataFrame) -> DataFrame:
    """(bucket, size, shingles, top) of buckets with several components; top: the one with most rows."""
    each = now.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    each = each.groupBy("bucket").agg(F.count("*").alias("components"), F.sum("c").alias("size"), F.sum("n").alias("shingles"), F.max(F.struct("c", "component")).alias("top"))
    return each.where("components > 1").select("bucket", "size", "shingles", F.col("top.component").alias("top"), F.col("top.c").alias("top_size"))


def _in_blocks(now: DataFrame) -> DataFrame:
    """Rows of buckets with several components, once for every pair of blocks (i <= j) that they are part of.

    The rows of a bucket's largest component have blocks of their own, which meet the blocks of the
    others but not each other: few strangers in a large group cost rows in proportion to it.
    """
    per = lambda share: F.greatest(F.ceil(F.col("size") * share / BLOCK), F.ceil(F.col("shingles") * share / BLOCK_SHINGLES), F.lit(1)).cast("int")
    top_share = F.col("top_size") / F.col("size")
    sized = _largest(now).withColumns({"others": per(1 - top_share), "tops": per(top_share)})
    own = F.pmod(F.xxhash64("id"), F.when(F.col("component") == F.col("top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    at = now.join(sized.drop("size", "shingles", "top_size"), "bucket").withColumn("is_top", F.col("component") == F.col("top"))
    at = at.withColumn("own", own + F.when(F.col("is_top"), F.col("others")).otherwise(0))
    last = F.when(F.col("is_top"), F.col("others") - 1).otherwise(F.col("others") + F.col("tops") - 1)
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return at.select("bucket", "band", "id", "n", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _dealt(rows: DataFrame, bytes_each) -> DataFrame:
    """rows with a cell of bounded size, on average, for their blocks."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(bytes_each), F.lit(0)).alias("b")).head()
    cells = max(1, -(-size.n // CELL), -(-size.b // CELL_BYTES))
    return rows.withColumn("cell", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(cells)))


def _classes(docs: DataFrame, id_col: str, text_col: str, agree: int = AGREE, into: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, n_shingles, fp, class, component_id) per row, as a table that stays, or one of `into`.

    class: a number of its own for each class. All other tables go, also where a step fails.
    """
    with Scratch() as scratch:
        out = _united(docs, id_col, text_col, agree, scratch)
        return store(out, "classes").df if into is None else into.put(out, "classes")


def _united(docs: DataFrame, id_col: str, text_col: str, agree: int, scratch: Scratch) -> DataFrame:
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketch = rows.select(F.struct("doc_id", "text_key").alias("row"), "text").mapInArrow(tidy(_sketch), "doc_id long, text_key long, fp long, n long, bands array<long>")
    sketch = scratch.put(sketch, "sketch")
    named = sketch.where("doc_id IS NOT NULL AND fp IS NOT NULL")
    # nodes: one for each different text; rep: the least id that has it
    reps = scratch.put(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "reps")
    placed = reps.select(F.col("fp").alias("id"), "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = scratch.put(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.put(placed.join(small_side(buckets), "bucket"), "members")
    wanted = members.select(F.col("id").alias("want")).distinct().join(reps.select(F.col("fp").alias("want"), "rep"), "want")
    wanted = scratch.put(wanted, "wanted")
    found = rows.drop("text_key").join(small_side(wanted), F.col("doc_id") == F.col("rep")).select("want", "text")
    sets = scratch.put(found.mapInArrow(tidy(_shingle_sets), "id long, sig binary, items array<long>").dropDuplicates(["id"]), "sets")
    sigs = sets.select("id", "sig")

    # first each document meets one hub: the member with most neighbours of the buckets it is in
    hub = members.join(members.groupBy("id").agg(F.sum("size").alias("centre")), "id")
    hub = hub.groupBy("bucket").agg(F.max(F.struct("centre", "id", "n")).alias("h"))
    hub = hub.select("bucket", F.col("h.id").alias("p"), F.col("h.n").alias("pn"), F.col("h.centre").alias("centre"))
    near = members.join(scratch.put(hub, "hubs"), "bucket").where("id <> p AND least(n, pn) * 5 >= greatest(n, pn) * 4")
    near = near.groupBy("id", "p").agg(F.count("*").alias("shared"), F.max("centre").alias("centre"))
    near = near.groupBy("id").agg(F.max(F.struct("shared", "centre", "p")).alias("b"))
    near = near.select(F.least("id", "b.p").alias("a"), F.greatest("id", "b.p").alias("b")).distinct()
    near = near.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    near = scratch.put(near.mapInArrow(_alike(agree), "a long, b long"), "pairs")
    links = scratch.put(_verified(near, sets), "links")
    labels = connected_components(links, scratch)

    # then, in buckets that still hold several components, every pair across them, block by block
    now = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    open_ = scratch.put(_in_blocks(scratch.put(now, "placed")), "open")
    asked = _dealt(open_, F.lit(4 * BANDS * ROWS)).join(sigs, "id")
    asked = scratch.put(asked.groupBy("cell").applyInArrow(lambda table: _block_candidates(table, agree), "bucket long, i int, j int, own int, id long, n long, component long"), "asked")
    asked = _dealt(asked, F.col("n") * 8).join(sets.select("id", "items"), "id")
    more = scratch.put(asked.groupBy("cell").applyInArrow(_block_links, "a long, b long").distinct(), "links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), scratch)
    classes = reps.select("fp", "rep").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
    classes = scratch.put(classes, "classes")
    classes = classes.join(classes.groupBy("class").agg(F.min("rep").alias("component_id")), "class").select("fp", "class", "component_id")
    out = sketch.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(classes, "fp", "left")
    return out.select("doc_id", "text_key", "n_shingles", "fp", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", agree: int = AGREE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row; component_id: least doc_id of the class.

    agree: components of two signatures that must be equal before their shingles are compared; with 0
    all pairs that share a band are compared exactly.
    """
    return _classes(docs, id_col, text_col, agree).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class (that of the least id, then of the least hash of its text; of equal rows
    the least by the hash of all columns); rows without an id stay. All columns are as they are."""
    with Scratch() as scratch:
        return _first_of_classes(docs, id_col, text_col, scratch)


def _first_of_classes(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    keys = _classes(docs, id_col, text_col, into=scratch).where("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.first("class").alias("class"), F.count("*").alias("n"))
    keys = scratch.put(keys.withColumn("class", F.coalesce(F.col("class").cast("string"), F.concat_ws(":", F.lit("-"), "doc_id", "text_key"))), "row-keys")
    first = keys.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select("f.*")
    repeated = scratch.put(keys.join(first, ["doc_id", "text_key"]).where("n > 1").select("doc_id", "text_key"), "repeated-rows")
    gone = keys.join(first, ["doc_id", "text_key"], "left_anti").select("doc_id", "text_key").unionByName(repeated)
    gone = store(gone.select(F.col("doc_id").alias("nd_id"), F.col("text_key").alias("nd_key")), "duplicates").df
    keyed = docs.withColumns({"nd_id": F.col(id_col).cast("long"), "nd_key": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    out = keyed.join(small_side(gone), ["nd_id", "nd_key"], "left_anti").select(*docs.columns)
    if not repeated.isEmpty():
        again = keyed.join(small_side(store(repeated.select(F.col("doc_id").alias("nd_id"), F.col("text_key").alias("nd_key")), "repeated").df), ["nd_id", "nd_key"], "left_semi")
        order = Window.partitionBy("nd_id", "nd_key").orderBy(F.xxhash64(*docs.columns))
        out = out.unionByName(again.withColumn("nd_at", F.row_number().over(order)).where("nd_at = 1").select(*docs.columns))
    return out


def op6_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
