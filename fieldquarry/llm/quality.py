"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages. Every passage of the whole text is described by its byte and
byte-class-pair frequencies and by how repetitive it is, encoded by a tanh layer, weighted by gated
attention (softmax of w . (tanh(V h) * sigmoid(U h))), and the weighted passage representation is
scored by a logistic unit. Weights are learned from document labels alone, by Adam on the driver,
over a bounded sample of labelled rows: the first by hash of their id, whole texts only, until there
are `MAX_TRAIN` rows or the next one would bring more than `TRAIN_PASSAGES` passages in all, so the
driver's share does not grow with texts; scoring covers all.

Defined cases: null and empty texts are one blank passage; null labels are not learned from; equal
rows (id, label and text) are learned from once; without labelled rows (or with one class) the score
is 0.5, or that class's share; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.llm.common import small_batches, text_slices, tidy

#: Bytes of a passage; labelled rows learned from, and their passages in all, at most; passages' hidden and attention width.
PASSAGE, MAX_TRAIN, TRAIN_PASSAGES, HIDDEN, ATTENTION = 512, 2000, 100_000, 24, 12
EPOCHS, BATCH, RATE, DECAY = 10, 32, 4e-3, 1e-4
#: Text bytes whose features are computed at once (small enough for a CPU's cache).
FEATURE_BYTES = 1 << 20
THRESHOLD = 0.3

# byte classes: control, newline, space, digit, lower, upper, sentence mark, comma-like, quote, symbol, non-ASCII lead, continuation
_CLASS = np.full(256, 9, dtype=np.int32)
_CLASS[:32] = 0
_CLASS[10] = 1
_CLASS[[32, 9]] = 2
_CLASS[48:58] = 3
_CLASS[97:123] = 4
_CLASS[65:91] = 5
_CLASS[[33, 46, 63]] = 6
_CLASS[[44, 58, 59, 45]] = 7
_CLASS[[34, 39]] = 8
_CLASS[192:] = 10
_CLASS[128:192] = 11
N_CLASS = 12
#: Bins of the byte histogram (non-ASCII bytes share four) and of all features.
_BIN = np.concatenate([np.arange(128), 128 + np.arange(128) // 32]).astype(np.int32)
N_BYTES = 132
N_FEATURES = N_BYTES + N_CLASS * N_CLASS + 4


def _passage_sizes(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes of every passage: full ones, and what is left in each text's last."""
    out = np.full(int(n.sum()), PASSAGE)
    out[np.cumsum(n) - 1] = sizes - (n - 1) * PASSAGE
    return out


def passage_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages of each text)."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    where = np.repeat(np.arange(total := int(n.sum()), dtype=np.int32), _passage_sizes(sizes, n))
    held = np.maximum(1, np.bincount(where, minlength=total)).astype(np.float32)
    hist = np.bincount(where * N_BYTES + _BIN[data], minlength=total * N_BYTES).reshape(total, N_BYTES)
    cls = _CLASS[data]
    pair = where[1:] * (N_CLASS * N_CLASS) + cls[:-1] * N_CLASS + cls[1:]
    pairs = np.bincount(pair[where[1:] == where[:-1]], minlength=total * N_CLASS * N_CLASS).reshape(total, -1)
    # repetition: distinct hashes of 8-byte windows, by passage and by document, as a share of the windows
    more = np.zeros((total, 4), dtype=np.float32)
    if len(data) >= 8:
        h = np.ndarray(len(data) - 7, dtype="<u8", buffer=data.tobytes(), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for col, owner, bits, count in ((0, where, 9, total), (1, doc, 14, len(sizes))):
            ok = owner[7:] == owner[:-7]
            own = owner[:-7][ok]
            slot = (own.astype(np.int64) << bits) | (h[ok] >> np.uint64(64 - bits)).astype(np.int64)
            seen = np.zeros(count << bits, dtype=bool)
            seen[slot] = True
            share = seen.reshape(count, -1).sum(1) / np.maximum(1, np.bincount(own, minlength=count))
            more[:, col] = share if col == 0 else np.repeat(share, n)
    more[:, 2] = np.repeat(np.log1p(sizes) / 12, n)
    more[:, 3] = held / PASSAGE
    x = np.concatenate([np.sqrt(hist / held[:, None]), np.sqrt(pairs / held[:, None]), more], axis=1)
    return x.astype(np.float32), n


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    prior: float | None = None

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(n), self.prior)
        return _forward(self.weights, x, n)[0]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _forward(w: dict, x: np.ndarray, n: np.ndarray):
    """Scores of bags (n passages each, in order) and what the gradient needs."""
    starts = np.cumsum(n) - n
    xn = (x - w["mean"]) * w["scale"]
    h = np.tanh(xn @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
    a = e / np.repeat(np.add.reduceat(e, starts), n)
    z = np.add.reduceat(h * a[:, None], starts)
    return _sigmoid(z @ w["c"] + w["d"]), xn, h, t, g, a, z


def gradient(w: dict, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over bags (n passages each, labels y), by weight."""
    p, xn, h, t, g, a, z = _forward(w, x, n)
    dlogit = (p - y) / len(y)
    dzr = np.repeat(np.outer(dlogit, w["c"]), n, axis=0)
    dh = dzr * a[:, None]
    da = (dzr * h).sum(1)
    starts = np.cumsum(n) - n
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
    dtg = np.outer(de, w["w"])
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh += dt @ w["V"].T + dg @ w["U"].T
    dpre = dh * (1 - h * h)
    return {"W": xn.T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dlogit, "d": np.array([dlogit.sum()])}


def train(x: np.ndarray, n: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    w = {"mean": x.mean(0), "scale": 1 / (x.std(0) + 0.02)}
    shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
    for k, s in shape.items():
        w[k] = (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32)
    m, v, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    starts = np.cumsum(n) - n
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            bags = order[i : i + BATCH]
            rows = np.concatenate([np.arange(starts[b], starts[b] + n[b]) for b in bags])
            nb, yb = n[bags], y[bags]
            grad = gradient(w, x[rows], nb, yb)
            step += 1
            for k, gk in grad.items():
                gk = gk + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = w[k] - (RATE * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(w)


def _featurise(batches):
    for keys, texts in text_slices(batches, "place", limit=FEATURE_BYTES):
        x, n = passage_features(texts)
        bags = [part.astype(np.float16).tobytes() for part in np.split(x, np.cumsum(n)[:-1])]
        yield pa.RecordBatch.from_arrays([keys, pa.array(bags, pa.binary())], ["place", "x"])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_passages: int = TRAIN_PASSAGES
) -> Model:
    """Learn from at most max_train labelled rows of at most max_passages passages in all, the first by hash of their id.

    The rows are chosen by their keys and sizes alone; their texts become features where they lie.
    """
    docs = small_batches(docs)
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").distinct()
    lab = lab.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "label").limit(max_train)
    text = F.coalesce(F.col(text_col), F.lit(""))
    bags = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(lab), "doc_id")
    passages = F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1)).alias("n")
    keys = bags.select("doc_id", "label", "h", passages).distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "label", "h").limit(max_train).collect()
    through = np.cumsum([k.n for k in keys])
    keys = keys[: int(np.searchsorted(through, max_passages, "right"))]
    if not keys:
        return train(np.zeros((0, N_FEATURES), np.float32), np.zeros(0, dtype=np.int64), np.zeros(0))
    schema = bags.select("doc_id", "label", "h", F.lit(0).alias("place")).schema
    chosen = docs.sparkSession.createDataFrame([(k.doc_id, k.label, k.h, i) for i, k in enumerate(keys)], schema)
    rows = bags.join(F.broadcast(chosen), ["doc_id", "label", "h"]).select("place", "text").dropDuplicates(["place"])
    found = {r.place: r.x for r in rows.mapInArrow(tidy(_featurise), "place int, x binary").collect()}
    x = np.empty((int(through[len(keys) - 1]), N_FEATURES), np.float32)
    ends = through[: len(keys)]
    for i, end in enumerate(ends):
        x[end - keys[i].n : end] = np.frombuffer(found.pop(i), dtype=np.float16).reshape(-1, N_FEATURES)
    return train(x, np.array([k.n for k in keys], dtype=np.int64), np.array([k.label for k in keys], dtype=np.float64))


def _scorer(model: Model):
    def run(batches):
        for ids, texts in text_slices(batches, limit=FEATURE_BYTES):
            x, n = passage_features(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(x, n).astype(np.float64), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(_scorer(model)), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores threshold or more."""

    def run(batches):
        for b in batches:
            marks = [model.score(*passage_features(t)) >= threshold for _, t in text_slices([b], text_col, text_col, limit=FEATURE_BYTES)]
            yield b.filter(pa.array(np.concatenate(marks))) if marks else b

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
