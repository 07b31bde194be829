"""Embedding near-duplicates: a navigable small-world hierarchy per shard, all shards queried.

Different vectors are dealt into shards by hash. Each shard builds a hierarchy of proximity graphs:
a point's top layer is drawn from its id, layers are built from the top down by beam search in
batches, and neighbours are picked for diversity. Every vector is searched in every shard. Beams
widen while an audit against brute force, on a sample of the block's and of the shard's own vectors
(which have themselves to find), finds too small a share of the links of a vector, on average over
vectors of one link, of few and of many apart, so that no large group outweighs the rest; and for
every single vector whose beam is full of links. A beam as wide as the shard is exact. Cosines are in
double precision. A task counts and unites its links step by step and reports counts and a spanning
forest, so groups of near copies cost memory and rows in proportion to their members, and what its
audit found.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths do not link; equal vectors are one node with a multiplicity;
rows without an id count as copies but have no component; an empty table gives no rows.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.llm.common import Scratch, connected_components, forest_roots, small_batches
from fieldquarry.llm.neardup import mix

THRESHOLD = 0.95
#: Fewest shards, vectors of a shard and of a query block at most.
MIN_SHARDS, SHARD_ROWS, BLOCK_ROWS = 8, 100_000, 25_000
#: Bytes of a shard's vectors at most; pairs of vectors that are compared or held at once; share of a shard above which a
#: widened beam is replaced by the whole shard.
SHARD_BYTES, PAIRS, EXACT_SHARE = 192 << 20, 4 << 20, 256
#: Bytes of a piece of a graph: no row that the JVM sorts, shuffles or hands over is larger; pieces in a file.
PIECE, PIECES_A_FILE = 4 << 20, 4
#: Neighbours of a point, beams of building and of a first search, points searched in step.
NEIGHBOURS, BUILD_BEAM, SEARCH_BEAM, STEP = 12, 32, 24, 256
#: Vectors of an audit (of the block, and of the shard itself), and the mean share of a vector's links that must be found.
AUDIT, AUDIT_RECALL = 192, 0.995


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@dataclass
class Graph:
    """Layers from the bottom up: for each, its points and their neighbours (positions; -1: none)."""

    vectors: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: The vectors in the order of the lowest layer's points, made at the first search.
    ordered: np.ndarray | None = None

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"{k}{i}": a for i, layer in enumerate(self.layers) for k, a in zip("pn", layer, strict=True)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        f = np.load(io.BytesIO(data))
        return cls(f["vectors"], [(f[f"p{i}"], f[f"n{i}"]) for i in range(len(f.files) // 2)])


def beam_search(vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cosines) of each query's beam, best first; all queries advance in step."""
    q, n = len(queries), len(vectors)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the place of missing neighbours
    ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", queries, vectors[entry])
    seen[np.arange(q), entry] = True
    live = np.arange(q)
    wide = 2 if beam >= 16 else 1
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
        pick = np.argpartition(-open_, wide - 1, axis=1)[:, :wide] if open_.shape[1] > wide else np.arange(open_.shape[1])[None].repeat(len(live), 0)
        good = np.take_along_axis(open_, pick, 1) > -np.inf
        some = good.any(axis=1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        rows = live[:, None]
        done[rows, pick] |= good
        nb = near[np.where(good, ids[rows, pick], 0)]
        nb = np.where(good[:, :, None], nb, -1).reshape(len(live), -1)
        nb = np.where(nb < 0, n, nb)
        fresh = ~seen[rows, nb]
        seen[rows, nb] = True
        # a neighbour that two picks share is fresh once
        order = np.argsort(nb, axis=1, kind="stable")
        sorted_ = np.take_along_axis(nb, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        s = np.full(nb.shape, -np.inf)
        s[r, c] = np.einsum("kd,kd->k", queries[live[r]], vectors[nb[r, c]])
        all_s = np.concatenate([sims[live], s], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, nb, -1)], axis=1)
        all_d = np.concatenate([done[live], np.zeros(nb.shape, bool)], axis=1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_i, all_s, all_d))
    return ids, sims


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (best first): those no kept one is nearer to, then the nearest."""
    c = vectors[np.maximum(ids, 0)]
    between = c @ c.transpose(0, 2, 1)
    ok = ids >= 0
    kept = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        kept[:, j] = ok[:, j] & (kept.sum(1) < m) & ~(kept & (between[:, j] > sims[:, j, None])).any(1)
    rank = np.where(kept, 0, np.where(ok, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    top = np.argsort(rank, axis=1)[:, :m]
    return np.take_along_axis(np.where(ok, ids, -1), top, 1)


def build(vectors: np.ndarray, ids: np.ndarray) -> Graph:
    """A hierarchy over unit vectors; ids decide levels and order, so it is the same on every run."""
    n = len(vectors)
    u = (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    level = np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(NEIGHBOURS)).astype(np.int64)
    order = np.lexsort((ids, u))  # high levels first
    graph = Graph(vectors)
    for l in range(int(level.max(initial=0)), -1, -1):
        points = order[: int((level >= l).sum())]
        if len(points):
            graph.layers.insert(0, (points, _layer(vectors[points], graph, 2 * NEIGHBOURS if l == 0 else NEIGHBOURS)))
    return graph


def _layer(own: np.ndarray, above: Graph, cap: int) -> np.ndarray:
    """Neighbours within one layer, built by batches; above: the finished upper layers."""
    n = len(own)
    near = np.full((n, cap), -1, np.int64)
    degree = np.zeros(n, np.int64)
    at = 0
    while at < n:
        stop = min(n, at + min(STEP, max(16, at)))
        batch = np.arange(at, stop)
        inner = own[batch] @ own[batch].T
        inner[np.arange(len(batch)), np.arange(len(batch))] = -np.inf
        take = min(BUILD_BEAM, len(batch))
        best = np.argsort(-inner, axis=1, kind="stable")[:, :take]
        ids, sims = np.where(np.take_along_axis(inner, best, 1) > -np.inf, batch[best], -1), np.take_along_axis(inner, best, 1)
        if at:
            if above.layers:  # the layers above hold a prefix of these points in the same order
                known = len(above.layers[0][0])
                entry = _descend(above, own[batch], own)
                entry = np.where(entry < at, entry, 0) if known else np.zeros(len(batch), np.int64)
            else:
                entry = np.zeros(len(batch), np.int64)
            found, fs = beam_search(own[:at], near[:at], own[batch], entry, min(BUILD_BEAM, at))
            ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([fs, sims], axis=1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        chosen = diverse(own, ids, sims, min(NEIGHBOURS, cap))
        near[batch, : chosen.shape[1]] = chosen
        degree[batch] = (chosen >= 0).sum(1)
        # back links; a full list is picked anew
        src = np.repeat(batch, chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        at = stop
        if not len(dst):
            continue
        cuts = np.flatnonzero(np.diff(dst)) + 1
        nodes = dst[np.concatenate([[0], cuts])]
        sizes = np.diff(np.concatenate([[0], cuts, [len(dst)]]))
        place = np.arange(len(dst)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = degree[nodes] + sizes <= cap
        ok = np.repeat(fits, sizes)
        near[dst[ok], degree[dst[ok]] + place[ok]] = src[ok]
        degree[nodes[fits]] += sizes[fits]
        full, slot = nodes[~fits], np.repeat(np.cumsum(~fits) - 1, sizes)[~ok]
        if not len(full):
            continue
        new = np.full((len(full), int(sizes[~fits].max())), -1, np.int64)
        new[slot, place[~ok]] = src[~ok]
        for i in range(0, len(full), STEP):
            who = full[i : i + STEP]
            cand = np.concatenate([near[who], new[i : i + STEP]], axis=1)
            sims = np.where(cand >= 0, np.matmul(own[np.maximum(cand, 0)], own[who][:, :, None])[:, :, 0], -np.inf)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : cap + NEIGHBOURS]
            kept = diverse(own, np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1), cap)
            near[who] = -1
            near[who, : kept.shape[1]] = kept
            degree[who] = (kept >= 0).sum(1)
    return near


def _descend(above: Graph, queries: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Position of the best entry point that the upper layers lead to (positions agree by prefix)."""
    entry = np.zeros(len(queries), np.int64)
    for points, near in reversed(above.layers):
        ids, _ = beam_search(own[: len(points)], near, queries, entry, 1)
        entry = ids[:, 0]
    return entry


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    points, near = graph.layers[0]
    if graph.ordered is None:
        graph.ordered = graph.vectors[points]
    own = graph.ordered
    entry = _descend(Graph(graph.vectors, graph.layers[1:]), queries, own)
    ids, sims = beam_search(own, near, queries, entry, min(beam, len(points)))
    return np.where(ids >= 0, points[ids], -1), sims


def audit_passes(truth: np.ndarray, found: np.ndarray) -> bool:
    """Whether vectors of one link, of few and of many each find enough of their own links on average."""
    size = np.digitize(truth, [1, 2, SEARCH_BEAM + 1])
    return all((found[size == k] / truth[size == k]).mean() >= AUDIT_RECALL for k in (1, 2, 3) if (size == k).any())


def links_of(graph: Graph, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, point) of all links found, and the beam that passed the audit."""
    at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    beam, _, _ = audited_beam(graph, queries, threshold)
    for q, p in link_steps(graph, queries, threshold, beam):
        at.append(q)
        to.append(p)
    at, to = np.concatenate(at), np.concatenate(to)
    order = np.argsort(at, kind="stable")
    return at[order], to[order], beam


def audited_beam(graph: Graph, queries: np.ndarray, threshold: float) -> tuple[int, int, int]:
    """The first beam that passes the audit, the links of the sampled vectors, and those it found."""
    n, beam = len(graph.vectors), SEARCH_BEAM
    spread = lambda m: np.linspace(0, m - 1, min(AUDIT, m)).astype(np.int64)
    # the shard's own vectors have at least themselves to find; the block's may have links here
    sample = np.concatenate([queries[spread(len(queries))], graph.vectors[spread(n)]])
    step = max(1, min(STEP, PAIRS // max(n, 1)))
    truth = np.concatenate([(sample[i : i + step] @ graph.vectors.T >= threshold).sum(1) for i in range(0, len(sample), step)])
    while True:
        found = np.zeros(len(sample), np.int64)
        for q, _ in link_steps(graph, sample, threshold, beam):
            found += np.bincount(q, minlength=len(sample))
        if audit_passes(truth, found):
            return beam, int(truth.sum()), int(found.sum())
        if beam >= n:
            raise RuntimeError("a search of the whole shard misses links")
        beam *= 2


def link_steps(graph: Graph, queries: np.ndarray, threshold: float, beam: int):
    """(query, point) of links, a bounded number of queries at a time."""
    for i in range(0, len(queries), STEP // 2):
        ids, sims = _search_all(graph, queries[i : i + STEP // 2], beam, threshold)
        n_of = [int((s >= threshold).sum()) for s in sims]
        if any(n_of):
            yield i + np.repeat(np.arange(len(n_of)), n_of), np.concatenate([own[:k] for own, k in zip(ids, n_of, strict=True)]).astype(np.int64)


def _search_all(graph: Graph, queries: np.ndarray, beam: int, threshold: float):
    """Per query its beam, best first; beams full of links widen until one entry is below.

    A beam widened beyond 1 / EXACT_SHARE of the shard costs more than comparing with every point: from
    there on it is as wide as the shard (all links, and nothing else, are returned).
    """
    ids: list = [None] * len(queries)
    sims: list = [None] * len(queries)
    todo, n = np.arange(len(queries)), len(graph.vectors)
    while len(todo):
        more = []
        whole = beam >= n or (beam > 4 * SEARCH_BEAM and beam * EXACT_SHARE >= n)
        step = max(1, min(STEP, PAIRS // n)) if whole else max(16, STEP * SEARCH_BEAM // max(beam, SEARCH_BEAM))
        for i in range(0, len(todo), step):
            part = todo[i : i + step]
            if whole:
                all_sims = queries[part] @ graph.vectors.T
                for k, p in enumerate(part):
                    own = np.flatnonzero(all_sims[k] >= threshold).astype(np.int32)
                    ids[p] = own[np.argsort(-all_sims[k][own], kind="stable")]
                    sims[p] = all_sims[k][ids[p]]
                continue
            fi, fs = search(graph, queries[part], beam)
            for k, p in enumerate(part):
                ids[p], sims[p] = fi[k], fs[k]
            more.append(part[fs[:, -1] >= threshold])
        todo = np.concatenate(more) if more else np.zeros(0, np.int64)
        beam *= 4
    return ids, sims


# ---- tables -------------------------------------------------------------------------------------
def _matrix(table: pa.Table) -> np.ndarray:
    rows = table.column("embedding").combine_chunks()
    return unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))


def _build(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by([("key", "ascending"), ("node", "ascending")])
    graph = build(_matrix(table), table.column("key").to_numpy())
    whole = memoryview(graph.dump())
    pieces = [whole[i : i + PIECE] for i in range(0, len(whole), PIECE)]
    keys = [pa.array([table.column(c)[0].as_py()] * len(pieces), pa.int64()) for c in ("dim", "shard")]
    own = [pa.array([table.column(c).to_numpy().tobytes(), *[None] * (len(pieces) - 1)], pa.binary()) for c in ("node", "copies")]
    return pa.table([*keys, pa.array(range(len(pieces)), pa.int64()), *own, pa.array(pieces, pa.binary())], ["dim", "shard", "piece", "nodes", "copies", "graph"])


def _shard(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Graph]:
    """(nodes, copies, graph) of a shard's pieces, in any order; one row may be a whole shard."""
    order = np.argsort(table.column("piece").to_numpy()) if "piece" in table.column_names else [0]
    own = (np.frombuffer(table.column(c)[int(order[0])].as_py(), np.int64) for c in ("nodes", "copies"))
    return *own, Graph.load(b"".join(table.column("graph")[int(i)].as_buffer() for i in order))


LINKS = {"node": pa.int64(), "n": pa.int64(), "root": pa.int64(), "beam": pa.int64(), "sampled": pa.int64(), "found": pa.int64()}


def _link(threshold: float):
    """Per shard and block: (node, n, root), link counts and a forest of the links; and a row of its audit."""

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return pa.table({k: pa.array([], t) for k, t in LINKS.items()})
        own, copies, graph = _shard(shard)
        del shard  # the pieces are held once more in the graph
        asks, queries = block.column("node").to_numpy(), _matrix(block.combine_chunks())
        beam, sampled, found = audited_beam(graph, queries, threshold)
        names, place = np.unique(np.concatenate([asks, own]), return_inverse=True)
        q_at, p_at = place[: len(asks)], place[len(asks) :]
        n, root = np.zeros(len(names), np.int64), np.arange(len(names))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def unite() -> None:
            nonlocal root, held, size
            if held:
                x, y = (np.concatenate(v) for v in zip(*held, strict=True))
                root = forest_roots(np.concatenate([x, np.arange(len(names))]), np.concatenate([y, root]), len(names))
            held, size = [], 0

        for q, p in link_steps(graph, queries, threshold, beam):
            x, y = q_at[q], p_at[p]
            other = x != y
            x, y = x[other], y[other]
            n += np.bincount(x, weights=copies[p[other]], minlength=len(names)).astype(np.int64)
            apart = root[x] != root[y]  # links that the forest does not hold yet
            held.append((x[apart], y[apart]))
            size += int(apart.sum())
            if size > PAIRS:
                unite()
        unite()
        linked = np.flatnonzero((n > 0) | (root != np.arange(len(names))) | np.isin(np.arange(len(names)), root[root != np.arange(len(names))]))
        none = pa.nulls(len(linked), pa.int64())
        out = pa.table([pa.array(names[linked]), pa.array(n[linked]), pa.array(names[root[linked]]), none, none, none], list(LINKS))
        audit = pa.table([*([pa.nulls(1, pa.int64())] * 3), *(pa.array([v], pa.int64()) for v in (beam, sampled, found))], list(LINKS))
        return pa.concat_tables([out, audit])

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, audit_recall) per row of vectors; audit_recall: share of the links of
    all audited vectors that the beams found (1.0 where none had links)."""
    scratch = Scratch()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = scratch.put(rows.withColumn("embedding", F.when(fine, F.col("embedding"))), "vectors")
    # a node is a distinct vector, whatever ids its rows have; key: decides its shard, level and order on every run
    nodes = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "key": F.xxhash64("embedding"), "dim": F.size("embedding").cast("long")})
    nodes = scratch.put(nodes, "vector-nodes")
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).head()
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * size.dim)))
    shards, blocks = max(MIN_SHARDS, -(-size.n // most)), max(1, -(-size.n // min(BLOCK_ROWS, most)))
    deal = nodes.select("dim", "node", "key", "copies", "embedding", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    graphs = small_batches(deal).groupBy("dim", "shard").applyInArrow(_build, "dim long, shard long, piece long, nodes binary, copies binary, graph binary")
    graphs = scratch.put(graphs, "graphs", PIECES_A_FILE)
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    asks = nodes.select("dim", "node", "embedding", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(_link(threshold), ", ".join(f"{k} long" for k in LINKS))
    found = scratch.put(found, "vector-links")
    audit = found.agg(F.coalesce(F.sum("sampled"), F.lit(0)).alias("sampled"), F.coalesce(F.sum("found"), F.lit(0)).alias("found")).head()
    found = found.where("node IS NOT NULL")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    known = nodes.join(counts, "node", "left").join(labels, "node", "left").select("embedding", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    known = scratch.put(known, "vector-classes")
    known = known.join(known.groupBy("class").agg(F.min("id").alias("component")), "class").select("embedding", "n_links", "component")
    out = rows.join(known, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return scratch.finish(out.withColumn("audit_recall", F.lit(audit.found / audit.sampled if audit.sampled else 1.0)), "embedding-links")


def op2_hnsw_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "audit_recall")
