"""LM scoring by subword lattice likelihood.

An existing subword vocabulary supplies pieces and their ranks; the corpus supplies how often each
occurs: first by the vocabulary's own segmentation of all training words, on top of a prior that falls
with rank, then in expectation over all their segmentations (EM_ROUNDS rounds of forward and backward
sums). That gives unigram piece probabilities and one for the end of a text. A text's probability
is the sum over all segmentations of all its words, by forward recursion in log space. Pieces never
cross white space, so the sum factorises: each distinct word's lattice is summed once.

Word counts and word scores have as many rows as the corpus has words, so neither is broadcast. Each
task cuts its texts into slices of bounded size, where they lie; a slice asks for each of its words
once and keeps its texts as numbers of its words; the answers come back by slice, and the slice adds
them up. Texts are read once and never shuffled. A word's rows are at most one per slice, so frequent
words and repeated rows make no hot keys.

Defined cases: null and empty texts are the end token alone; repeated rows count and score one by
one; null ids train (their remainder is undefined) and are scored; characters that the vocabulary
lacks are spelt in byte pieces; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.llm.common import Scratch, arrow_words, joined, runs_of, small_batches, text_slices, tidy

#: Bytes of a slice, about; words of a lattice batch; longest batched word (longer ones are summed one by one).
SLICE_TEXT, LATTICE_BATCH, LATTICE_LENGTH = 12 << 20, 60_000, 24
#: Occurrences that the rank prior is worth in all.
PRIOR = 1000.0
#: Rounds of expectation-maximisation over all segmentations after the first counts.
EM_ROUNDS = 2
MARK = "▁"
#: Columns of what slices ask; rows of it at once.
ASKED, ASK_ROWS = ["slice", "at", "word", "n_train", "docs", "codes"], 100_000


@dataclass
class Vocabulary:
    """Pieces of an existing vocabulary; rank: 1 for the first."""

    path: str
    pieces: list[str]
    bytes_: list[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        return cls(path, [sp.id_to_piece(i) for i in range(n)], [i for i in range(n) if sp.is_byte(i)])

    def prior(self) -> np.ndarray:
        """Pseudo-counts that fall with the vocabulary's order of scores; control pieces have none."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        scores = np.array([sp.get_score(i) for i in range(len(self.pieces))])
        rank = np.empty(len(scores))
        rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
        weight = 1 / (rank + 2.7)
        weight[[i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i)]] = 0
        return PRIOR * weight / weight.sum()


@dataclass
class Lattice:
    """log10 probabilities of pieces; sums over all segmentations of a word."""

    pieces: list[str]
    logp: np.ndarray
    byte_logp: np.ndarray
    end: float

    def __post_init__(self) -> None:
        use = [i for i, p in enumerate(self.pieces) if np.isfinite(self.logp[i]) and not (p.startswith("<0x") and p.endswith(">"))]
        self.names = [self.pieces[i] for i in use]
        self.values = np.append(self.logp[use], -np.inf)
        self.table = dict(zip(self.names, self.logp[use].tolist(), strict=True))
        self.place = {n: i for i, n in enumerate(self.names)}
        self.longest = max(map(len, self.names), default=1)

    def char(self, c: str) -> float:
        known = self.table.get(c)
        return known if known is not None else float(sum(self.byte_logp[b] for b in c.encode()))

    def word(self, text: str) -> float:
        """Forward recursion over one word."""
        s = MARK + text
        alpha = [0.0]
        for j in range(1, len(s) + 1):
            terms = [alpha[j - 1] + self.char(s[j - 1])]
            for i in range(max(0, j - self.longest), j - 1):
                lp = self.table.get(s[i:j])
                if lp is not None:
                    terms.append(alpha[i] + lp)
            top = max(terms)
            alpha.append(top + math.log10(sum(10 ** (t - top) for t in terms)))
        return alpha[-1]

    def words(self, texts: pa.Array) -> np.ndarray:
        """Forward recursion over many words at once, by length; the same sums as `word`."""
        out = np.empty(len(texts))
        for where, own, n in self._groups(texts):
            if own is None:
                out[where] = [self.word(t) for t in texts.take(pa.array(where)).to_pylist()]
            else:
                out[where] = self._forward(self._edges(own, n)[0], n)[n]
        return out

    def expected(self, texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each named piece over all segmentations, and the positions of words that have none."""
        total, none = np.zeros(len(self.values)), [np.zeros(0, np.int64)]
        for where, own, n in self._groups(texts, least=1):
            if own is None:
                for k, text in zip(where.tolist(), texts.take(pa.array(where)).to_pylist(), strict=True):
                    self._expected_one(MARK + text, float(weights[k]), total)
                continue
            lp, found = self._edges(own, n)
            alpha, beta = self._forward(lp, n), self._backward(lp, n)
            none.append(where[~np.isfinite(alpha[n])])
            scale = np.log10(weights[where].astype(float)) - alpha[n]
            at = 0
            for j in range(1, n + 1):
                first = max(0, j - self.longest)
                use = alpha[first:j] + lp[at : at + j - first] + beta[j] + scale
                ids = found[at : at + j - first]
                real = (ids < len(self.names)) & np.isfinite(use)
                total += np.bincount(ids[real], weights=10 ** use[real], minlength=len(total))
                at += j - first
        return total[:-1], np.concatenate(none)

    def _expected_one(self, s: str, weight: float, total: np.ndarray) -> None:
        """The same for one word of any length: in natural logs, edges found once."""
        n, ten = len(s), math.log(10)
        place, get = self.place, self.table.get
        edges: list[list[tuple[int, float, int]]] = []  # by end: (start, log probability, piece)
        alpha = [0.0]
        for j in range(1, n + 1):
            own = [(i, lp * ten, place[s[i:j]]) for i in range(max(0, j - self.longest), j) if (lp := get(s[i:j])) is not None]
            if not own or own[-1][0] != j - 1:
                own.append((j - 1, self.char(s[j - 1]) * ten, -1))
            edges.append(own)
            top = max(alpha[i] + lp for i, lp, _ in own)
            alpha.append(top + math.log(sum(math.exp(alpha[i] + lp - top) for i, lp, _ in own)))
        # backwards: what is left of the word's weight at each end, shared among the edges that end there
        mass = [0.0] * n + [weight]
        for j in range(n, 0, -1):
            if mass[j]:
                for i, lp, piece in edges[j - 1]:
                    use = mass[j] * math.exp(alpha[i] + lp - alpha[j])
                    mass[i] += use
                    if piece >= 0:
                        total[piece] += use

    def _groups(self, texts: pa.Array, least: int = 32):
        """(positions, marked words or None, length): words of one length; None where too long or few."""
        marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False)
        for n in np.unique(lengths):
            where = np.flatnonzero(lengths == n)
            good = n <= LATTICE_LENGTH and len(where) >= least
            yield where, marked.take(pa.array(where)) if good else None, int(n)

    def _edges(self, own: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and piece (len(names): none) of all spans, by their ends, then starts."""
        spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
        subs = pa.chunked_array([pc.utf8_slice_codeunits(own, i, j) for i, j in spans])
        found = pc.fill_null(pc.index_in(subs, value_set=pa.array(self.names, pa.large_string())), len(self.names)).to_numpy().reshape(len(spans), len(own))
        lp = self.values[found]
        for k, (i, j) in enumerate(spans):
            if j - i == 1:  # byte pieces spell characters that are no piece
                lost = np.flatnonzero(np.isneginf(lp[k]))
                if len(lost):
                    lp[k, lost] = [self.char(c) for c in pc.utf8_slice_codeunits(own.take(pa.array(lost)), i, j).to_pylist()]
        return lp, found

    def _forward(self, lp: np.ndarray, n: int) -> np.ndarray:
        alpha = np.full((n + 1, lp.shape[1]), -np.inf)
        alpha[0] = 0
        at = 0
        for j in range(1, n + 1):
            first = max(0, j - self.longest)
            alpha[j] = _log_sum(alpha[first:j] + lp[at : at + j - first])
            at += j - first
        return alpha

    def _backward(self, lp: np.ndarray, n: int) -> np.ndarray:
        at, where = 0, {}
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                where[i, j] = at
                at += 1
        beta = np.full((n + 1, lp.shape[1]), -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            ends = range(i + 1, min(n, i + self.longest) + 1)
            beta[i] = _log_sum(np.stack([lp[where[i, j]] + beta[j] for j in ends]))
        return beta


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    return top + np.log10((10 ** (terms - top)).sum(axis=0))


def _coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts in turn, words of each text)."""
    if len(texts) == 1 and len(texts[0].as_buffer()) > 2 * SLICE_TEXT:  # a long text, run by run
        split = [arrow_words(pa.array([run], pa.large_string()), lower=True)[0] for run in runs_of(texts[0].as_py(), SLICE_TEXT)]
        coded = pa.chunked_array(split, pa.large_string()).dictionary_encode().combine_chunks()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0)
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.array([len(coded)])
    words, rows = arrow_words(texts, lower=True)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
    return coded.dictionary, codes, np.bincount(rows.to_numpy(zero_copy_only=False), minlength=len(texts)) if len(words) else np.zeros(len(texts), np.int64)


SCORES = {"doc_id": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _ask(batches):
    """Per slice a row for each of its words (slice, at, word, n_train), and one with its texts as numbers of words."""
    from pyspark import TaskContext

    part, count = TaskContext.get().partitionId(), 0
    empty = lambda n, kind: pa.nulls(n, kind)
    for row, texts in text_slices(joined(batches, SLICE_TEXT), "row", limit=SLICE_TEXT):
        words, codes, n = _coded_words(texts)
        ids, train = row.flatten()
        learnt = np.repeat(train.to_numpy(zero_copy_only=False).astype(float), n)
        seen = np.bincount(codes, weights=learnt, minlength=len(words)).astype(np.int64)
        slice_ = (part << 32) + count
        count += 1
        one = pa.RecordBatch.from_arrays([ids, train, pa.array(n, pa.int64())], ["doc_id", "train", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, one.schema) as out:
            out.write_batch(one)
        packed = pa.compress(codes.astype(np.int32).tobytes(), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int64()), empty(1, pa.int32()), empty(1, pa.string()), empty(1, pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([packed], pa.binary())], ASKED)
        for a in range(0, len(words), ASK_ROWS):
            w = words.slice(a, ASK_ROWS).cast(pa.string())
            k = len(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, slice_)), pa.array(np.arange(a, a + k), pa.int32()), w, pa.array(seen[a : a + k]), empty(k, pa.binary()), empty(k, pa.binary())], ASKED)


def _segment(path: str, n_pieces: int):
    """Piece counts of words (word, c), a row for each piece that a task has seen."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(n_pieces)
        for b in batches:
            ids = sp.encode(b.column("word").to_pylist(), num_threads=1)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
            total += np.bincount(flat, weights=np.repeat(b.column("c").to_numpy().astype(float), n), minlength=n_pieces)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen].astype(np.int64))], ["piece", "n"])

    return run


def _batched(batches, size: int):
    """(word, c) columns of consecutive batches, about `size` words at a time."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= size:
            t = pa.Table.from_batches(held).combine_chunks()
            yield t.column("word").chunk(0), t.column("c").chunk(0)
            held, rows = [], 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t.column("word").chunk(0), t.column("c").chunk(0)


def _score_words(lattice: Lattice):
    def run(batches):
        for words, c in _batched(batches, LATTICE_BATCH):
            yield pa.RecordBatch.from_arrays([words, c, pa.array(lattice.words(words))], ["word", "c", "g"])

    return run


def _expect(lattice: Lattice):
    """Expected piece counts of words (word, c)."""

    def run(batches):
        place = {n: i for i, n in enumerate(lattice.pieces)}
        total = np.zeros(len(lattice.pieces))
        named = np.array([place[n] for n in lattice.names], dtype=np.int64)
        for words, c in _batched(batches, LATTICE_BATCH):
            total[named] += lattice.expected(words, c.to_numpy())[0]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["piece", "n"])

    return run


def _add_up(base_of, end_base: float, end_known: int, end_score: float):
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        at = answers.column("at").to_numpy()
        c, g = np.empty(len(at), np.int64), np.empty(len(at))
        c[at], g[at] = answers.column("c").to_numpy(), answers.column("g").to_numpy()
        known, base = (c > 0).astype(float), base_of(c)
        for docs, codes in zip(slices.column("docs").to_pylist(), slices.column("codes").to_pylist(), strict=True):
            with pa.ipc.open_stream(docs) as one:
                rows = one.read_all()
            n = rows.column("n").to_numpy()
            codes = np.frombuffer(pa.decompress(codes, 4 * int(n.sum()), codec="zstd"), np.int32)
            of = np.repeat(np.arange(len(n)), n)
            add = lambda v: np.bincount(of, weights=v[codes], minlength=len(n))
            out.append(pa.table({"doc_id": rows.column("doc_id"), "train": rows.column("train"), "n_tokens": n + 1, "n_known": add(known).astype(np.int64) + end_known, "base_score": add(base) + end_base, "score": add(g) + end_score}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in SCORES.items()})

    return run


def _estimate(vocabulary: Vocabulary, uses: dict[int, float], docs: int) -> Lattice:
    """Probabilities of pieces and of the end from (expected) uses on top of the prior."""
    counts = vocabulary.prior()
    for piece, n in uses.items():
        counts[piece] += n if counts[piece] else 0
    ends = docs + 1
    with np.errstate(divide="ignore"):
        logp = np.log10(counts / (counts.sum() + ends))
    return Lattice(vocabulary.pieces, logp, logp[vocabulary.bytes_], math.log10(ends / (counts.sum() + ends)))


def score_documents(docs: DataFrame, vocabulary_path: str, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    scratch = Scratch()
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).alias("text"))
    asked = rows.select(F.struct("doc_id", "train").alias("row"), "text").mapInArrow(tidy(_ask), "slice long, at int, word string, n_train long, docs binary, codes binary")
    asked = scratch.put(asked, "asked")
    words = scratch.put(asked.where("word IS NOT NULL").groupBy("word").agg(F.sum("n_train").alias("c")), "words")
    trained = rows.agg(F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)).alias("docs")).head().docs
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).head()
    n, v = total.n + trained, total.v + int(trained > 0)

    vocabulary = Vocabulary.load(vocabulary_path)
    seen = words.where("c > 0").mapInArrow(tidy(_segment(vocabulary_path, len(vocabulary.pieces))), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    lattice = _estimate(vocabulary, {r.piece: r.n for r in seen.collect()}, trained)  # at most a row for each piece
    for _ in range(EM_ROUNDS):
        uses = words.where("c > 0").mapInArrow(tidy(_expect(lattice)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        lattice = _estimate(vocabulary, {r.piece: r.n for r in uses.collect()}, trained)

    scored = words.mapInArrow(tidy(_score_words(lattice)), "word string, c long, g double")
    answers = asked.where("word IS NOT NULL").select("slice", "at", "word").join(scored, "word").select(F.col("slice").alias("of"), "at", "c", "g")
    floor = n + (v + 1)

    def base_of(c):
        return np.log10((c + 1) / floor)

    slices = asked.where("docs IS NOT NULL").select("slice", "docs", "codes")
    schema = ", ".join(f"{k} {'boolean' if pa.types.is_boolean(t) else 'double' if pa.types.is_floating(t) else 'long'}" for k, t in SCORES.items())
    out = slices.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(_add_up(base_of, float(base_of(trained)), int(trained > 0), lattice.end), schema)
    return scratch.finish(out.withColumn("train_tokens", F.lit(n).cast("long")), "lm-scores")


def op3_lm_score(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_documents(docs, vocabulary_path, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
