"""Operator 8: quality classifier on random-indexing word vectors.

Every word (and sign; a word in capitals is another one) has a sparse ternary index vector, drawn
from its hash.  Word vectors, the sums of the index vectors around a word's occurrences in all
documents, are kept in a table of VOCAB rows to which words are hashed.  A document is the
weighted mean and spread of its words' vectors, with its length, distinct words and share of
capitals; a two-layer numpy network scores it and one temperature calibrates the probability.

Word vectors are exact integer sums over all documents, so they do not depend on the
order of work; they are VOCAB x SIZE numbers at any corpus size.  The network is fitted
on at most SAMPLE_ROWS labelled documents of each class, distinct in id and text and chosen
by a hash of the id.

Defined results: null and empty texts are scored like a document without words; labels
that are null or other than 0 and 1 are not learned from, nor those of rows without an
id; of several labels of a document, the smallest counts; without labels of both
classes every score is 0.5; repeated rows are each scored (and learned from once); a score
of exactly CUT is predicted 1; texts are read whole; an empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from . import common, tokens
from .language import held_out

VOCAB, SIZE, NONZERO, WINDOW = 1 << 13, 32, 6, 2
#: Rows of word vectors in one block of partial sums.
BLOCK = 256
SAMPLE_ROWS = 4000
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.02, 1e-4
CUT = 0.7


def index_vectors(h: np.ndarray) -> np.ndarray:
    """The sparse ternary index vector of each word, drawn from its hash: NONZERO signed ones, which add up where they meet.
    So every word has its own, however many there are."""
    bits = tokens.finish(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(8))
    out, row = np.zeros((len(h), SIZE), np.int8), np.arange(len(h))
    for k in range(NONZERO):
        out[row, (bits >> np.uint64(5 * k) & np.uint64(SIZE - 1)).astype(np.int64)] += np.where(bits >> np.uint64(40 + k) & np.uint64(1), 1, -1).astype(np.int8)
    return out


def ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a run of texts, in order, the text each belongs to, and which are written in capitals; those count as other words."""
    starts, ends, h, doc = tokens.split(data, offsets)
    capital = (data >= 65) & (data <= 90)
    n_cap = np.r_[0, np.cumsum(capital)]
    shout = (n_cap[ends] - n_cap[starts] >= 2) if len(starts) else np.empty(0, bool)
    return np.where(shout, tokens.finish(h + np.uint64(1)), h), doc, shout


def row_of(h: np.ndarray) -> np.ndarray:
    """The row of the table of word vectors that a word shares with others of its hash."""
    return (h >> np.uint64(64 - 13)).astype(np.int64)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(vectors VOCAB x SIZE, occurrences) from all texts of ``docs``."""
    common.small_batches(docs.sparkSession)
    cells = BLOCK * (SIZE + 1)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((SIZE, VOCAB)), np.zeros(VOCAB, np.int64)
        for b in batches:
            for data, offsets in tokens.chunks(b.column(0)):
                h, doc, _ = ids(data, offsets)
                if not len(h):
                    continue
                slot = row_of(h)
                seen += np.bincount(slot, minlength=VOCAB)
                words, which = np.unique(h, return_inverse=True)
                index = np.concatenate([index_vectors(words), np.zeros((1, SIZE), np.int8)])  # the last stands for a document's edge
                # WINDOW edges between documents
                at = np.arange(len(slot)) + WINDOW * (doc + 1)
                line = np.full(len(slot) + WINDOW * (len(offsets) + 1), len(words))
                line[at] = which
                for d in range(SIZE):
                    v = index[line, d].astype(np.float64)
                    near = np.zeros(len(line))
                    for k in range(1, WINDOW + 1):
                        near[k:] += v[:-k]
                        near[:-k] += v[k:]
                    total[d] += np.bincount(slot, near[at], VOCAB)
        rows = np.concatenate([total.T.astype(np.int64), seen[:, None]], axis=1).reshape(-1, cells)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), part)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, total = None, 0, np.zeros(cells, np.int64)
        for b in batches:
            for block, p, sums in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and (block, p) != (now, part):
                    yield pa.RecordBatch.from_pydict({"block": [now], "part": [0], "sums": [total.tobytes()]})
                    total = np.zeros(cells, np.int64)
                now, part = block, p
                total += np.frombuffer(sums, np.int64)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"block": [now], "part": [0], "sums": [total.tobytes()]})

    schema = "block long, part long, sums binary"
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(collect), schema)
    for _ in range(2):  # partial sums of 64 groups of tasks, then all
        sums = sums.repartition(VOCAB // BLOCK, "block", "part").sortWithinPartitions("block", "part").mapInArrow(common.tidy(add), schema)
    got = np.zeros((VOCAB, SIZE + 1), np.int64)
    for block, _, raw in sums.collect():  # VOCAB / BLOCK rows
        got[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, np.int64).reshape(BLOCK, SIZE + 1)
    return got[:, :SIZE].astype(np.float64), got[:, SIZE].astype(np.float64)


class Pool:
    """Turns runs of texts into document vectors."""

    width = 2 * SIZE + 4

    def __init__(self, vectors: np.ndarray, seen: np.ndarray):
        vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-9)
        weight = 1e-3 / (1e-3 + seen / max(seen.sum(), 1))
        self.table = np.concatenate([vectors * weight[:, None], weight[:, None]], axis=1).astype(np.float32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.zeros((n, self.width), np.float32)
        h, doc, shout = ids(data, offsets)
        if not len(h):
            return out
        slot = row_of(h)
        firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        who, count = doc[firsts], np.diff(np.r_[firsts, len(doc)])[:, None]
        sums = np.empty((len(firsts), SIZE + 1))
        squares = np.empty((len(firsts), SIZE + 1))
        for d in range(SIZE + 1):
            v = self.table[slot, d].astype(np.float64)
            sums[:, d] = np.add.reduceat(v, firsts)
            squares[:, d] = np.add.reduceat(v * v, firsts)
        mean = sums / count
        out[who, :SIZE] = mean[:, :SIZE] / np.maximum(np.sqrt((mean[:, :SIZE] ** 2).sum(axis=1, keepdims=True)), 1e-9)
        out[who, SIZE : 2 * SIZE] = np.sqrt(np.maximum(squares / count - mean**2, 0))[:, :SIZE]
        distinct = np.bincount(np.searchsorted(firsts, np.unique(np.searchsorted(firsts, np.arange(len(doc)), "right") * VOCAB + slot, return_index=True)[1], "right") - 1, minlength=len(firsts))
        out[who, 2 * SIZE] = mean[:, SIZE]
        out[who, 2 * SIZE + 1] = distinct / np.sqrt(count[:, 0])
        out[who, 2 * SIZE + 2] = np.log1p(count[:, 0])
        out[who, 2 * SIZE + 3] = np.add.reduceat(shout.astype(np.float64), firsts) / count[:, 0]
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        parts = [self(d, o) for d, o in tokens.chunks(column)]
        return np.concatenate(parts) if parts else np.zeros((0, self.width), np.float32)


class Network:
    """Two layers, tanh and sigmoid, with standardised inputs and a temperature."""

    def __init__(self):
        self.layers, self.temp = None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(x))
        mean, sd, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / sd @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temp, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        rng = np.random.default_rng(88)
        order = rng.permutation(len(x))
        check, keep = order[: len(x) // 5], order[len(x) // 5 :]
        if len(set(y[keep].tolist())) < 2:
            return
        x = x.astype(np.float64)
        mean, sd = x[keep].mean(axis=0), x[keep].std(axis=0) + 1e-6
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        a, t, w = (x[keep] - mean) / sd, y[keep], weight[keep] / weight[keep].sum()
        for step in range(1, EPOCHS + 1):  # Adam on the whole sample
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - t) * w
            back = e[:, None] * p[2][None, :] * (1 - h * h)
            grads = [a.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ e + DECAY * p[2], e.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = (mean, sd, *p)
        if len(check):
            z, t, w = self.logits(x[check]), y[check], weight[check]
            losses = {k: float((w * np.logaddexp(0, -(2 * t - 1) * z / k)).sum()) for k in np.exp(np.linspace(-2, 3, 101))}
            self.temp = min(losses, key=losses.get)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Pool, Network]:
    """Word vectors from all ``docs``; the network from ``labels`` (doc_id, quality)."""
    pool = Pool(*word_vectors(docs))
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    network = Network()
    if len(n) < 2:
        return pool, network
    # about twice as many ids by a hash, of them the sample_rows of least hash for each class
    draw = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    share = F.when(F.col("quality") == 1, min(1.0, 2 * sample_rows / n[1])).otherwise(min(1.0, 2 * sample_rows / n[0]))
    least = F.row_number().over(Window.partitionBy("quality").orderBy("draw"))
    sample = labels.withColumn("draw", draw).where(F.col("draw") < share).withColumn("k", least).where(F.col("k") <= sample_rows).drop("k")
    # at most 2 * sample_rows ids: a broadcast join of a proven size.  An id may have any number of rows, so the limit holds once more
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", "text", F.xxhash64(F.lit(8), "doc_id", "text").alias("pick"), "draw")
    rows = rows.dropDuplicates(["quality", "pick"]).withColumn("k", F.row_number().over(Window.partitionBy("quality").orderBy("draw", "pick")))
    rows = rows.where(F.col("k") <= sample_rows).select("draw", "quality", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pool.texts(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["draw", "quality", "x"])

    got = rows.withColumn("quality", F.col("quality").cast("int")).mapInArrow(common.tidy(vectors), "draw double, quality int, x binary").collect()
    got = sorted(got, key=lambda r: (r.draw, r.quality, r.x))
    if got:
        y = np.array([r.quality for r in got], np.float64)
        weight = np.where(y == 1, n[1] / max((y == 1).sum(), 1), n[0] / max((y == 0).sum(), 1))  # classes count as they occur
        network.fit(np.array([np.frombuffer(r.x, np.float32) for r in got]), y, weight)
    return pool, network


def score(docs: DataFrame, pool: Pool, network: Network) -> DataFrame:
    """``docs`` without its text and with a score; text is its last column."""
    common.small_batches(docs.sparkSession)
    import pyspark.sql.types as T

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = network.score(pool.texts(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s.astype(np.float64))], names=[*b.schema.names[:-1], "score"])

    return docs.mapInArrow(common.tidy(task), T.StructType([*docs.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; held-out rows' labels are not used."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))
    pool, network = train(docs, labels)
    out = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), pool, network)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
