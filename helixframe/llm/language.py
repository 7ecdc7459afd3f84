"""Operator 5: language identification.

Character n-grams (1 to 3) are hashed into a fixed number of features and weighted
by TF-IDF; a sparse multinomial logistic regression is trained with
follow-the-regularised-leader (proximal, elastic net) and its probabilities are
calibrated with one temperature.  Document frequencies come from all training
documents; the regression is fitted on at most SAMPLE_ROWS of them for each language,
distinct in id and text and chosen by a hash of both.  What reaches the driver is bounded by FEATURES and
SAMPLE_ROWS times the number of languages.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows
with a null lang or a null id are predicted but not learned from; without any
labelled training row every prediction is ``und``; with one language it is that one;
repeated rows are each predicted (and learned from once); of equally likely languages
the first in order is taken; texts are read whole, one at a time; an empty table gives
no rows; other columns are not read, and ``predict`` passes them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession, Window

from . import common

FEATURES = 1 << 15
GRAMS = 3
#: Training documents for each language.
SAMPLE_ROWS = 800
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, GRAMS + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        slot = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
        total += np.bincount(slot.astype(np.int64), minlength=FEATURES)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


# -- training --------------------------------------------------------------------


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, classes: int, features: int = FEATURES):
        self.z = np.zeros((classes, features))
        self.n = np.zeros((classes, features))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Languages, IDF, sparse weights and temperature; small enough to go with each task."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temp: float):
        self.langs, self.idf, self.weights, self.temp = langs, idf.astype(np.float32), weights.astype(np.float32), temp

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        at, counts = grams(text)
        p = softmax((self.weights[:, at] @ weigh(counts, self.idf[at])).astype(np.float64) / self.temp)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on ``docs`` (doc_id, text, lang)."""
    common.small_batches(docs.sparkSession)
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros(FEATURES), np.zeros((0, FEATURES)), 1.0)
    langs, total = sorted(counts), sum(counts.values())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES, np.int64)
        for b in batches:
            for t in b.column(0):
                df[grams(t.as_py())[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": at, "n": df[at]})

    seen = usable.select("text").mapInArrow(common.tidy(frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(FEATURES)
    for feature, n in seen.collect():  # FEATURES rows at most
        df[feature] = n
    idf = np.log((1 + total) / (1 + df)) + 1

    # at most sample_rows distinct (id, text) for each language: about twice as many by a hash, of them the least hashes
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * sample_rows / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)
    least = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [grams(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["draw", "lang", "at", "counts"])

    sample = usable.withColumn("draw", draw).where(F.col("draw") < share).select("draw", "lang", "text").dropDuplicates(["lang", "draw"])
    sample = sample.withColumn("k", least).where(F.col("k") <= sample_rows).select("draw", "lang", "text")
    rows = sorted(sample.mapInArrow(common.tidy(features), "draw double, lang string, at binary, counts binary").collect(), key=lambda r: (r.draw, r.lang, r["at"]))
    order = np.random.default_rng(5).permutation(len(rows))
    data = [(np.frombuffer(rows[i]["at"], np.int32), np.frombuffer(rows[i]["counts"], np.float32), langs.index(rows[i]["lang"])) for i in order]
    data = [(at, weigh(c, idf[at]), label) for at, c, label in data]
    keep, check = data[len(data) // 5 :], data[: len(data) // 5]
    model = Ftrl(len(langs))
    for _ in range(EPOCHS):
        for at, x, label in keep:
            model.learn(at, x, label)
    w = model.weights()
    logits = np.array([w[:, at] @ x for at, x, _ in check]).reshape(len(check), len(langs))
    return Model(langs, idf, w, temperature(logits, np.array([label for *_, label in check], int)) if len(langs) > 1 else 1.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added as its last columns."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(common.tidy(task), T.StructType(docs.schema.fields + added))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of ``docs`` that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
