"""Operator 9: mixing sources to target weights.

Each source's documents, in a fixed order, form one stream of words that is cut into
blocks of fixed length (the last may be short).  A source takes its stream as often as its
target holds it whole, and of the rest as many words: whole blocks, then the beginning of one.
Each of these takings is a slot.  For every output shard the counts of sources are drawn from
the multinomial of their slots; what the draws of all shards together take too much of one
source and too little of another is exchanged in the last shards, so the totals are the targets.
A source's slot k takes block perm(k mod blocks) of pass k div blocks, with another
pseudorandom permutation for each pass (a short block comes last); blocks are then joined with
the pieces of documents they hold by (source, block).

Rows that are equal in id, source and text are counted before they are laid out, and word
offsets are prefix sums over (source, bucket) and then within a bucket, so neither a hot source
nor a hot row meets in one task.  There is one row for each source on the driver.

Defined results: null text has no words and is never taken (taken 0); null sources
form one source, last in order; repeated rows are separate documents; ties in the order of a
stream are rows that are equal; texts of any length are taken whole or by their blocks; an empty
table gives no rows; other columns are not read by ``mix`` and pass ``mixed_documents``, which
numbers rows that are equal in id, source and text by a hash of their other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window

from . import common

#: Words in a block.
BLOCK = 256
#: Slots in an output shard.
SHARD_SLOTS = 4096
#: No source is taken more often than this.
MOST = 3
SEED = 20240917
#: Shards whose draws one row of work stands for.
SHARDS = 64
#: Copies of a row that are laid out by one row of work.
COPIES = 1000
#: Documents in one bucket of a source's stream.
BUCKET_ROWS = 20_000


def mix64(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a four-round Feistel network on the
    next power of four, walked until the value is below n.  All arguments are uint64 arrays."""
    half = np.maximum(1, (np.frexp(np.maximum(n, 2).astype(np.float64) - 1)[1] + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            salt = np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix64(right + k + salt) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out


@dataclass
class Mix:
    """What :func:`mix` makes; all are DataFrames.

    sources: src, source, source_size, target, and how it is reached: blocks (full of them whole), passes, rest, left, slots
    docs: row keys (doc_id, src, start), size, text_hash, copy
    slots: shard, slot, src, block, pass, take (words from the block's beginning), part (whether that is less than the block)
    pieces: doc_id, src, start, size, block, from_word, words (the part of the document in that block), ahead (words of the block ahead of it)
    """

    sources: DataFrame
    docs: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for each document."""
        times = self.slots.groupBy("src", "block").agg(F.count_if(~F.col("part")).alias("times"), F.max(F.when(F.col("part"), F.col("take"))).alias("most"))
        words = F.col("words") * F.coalesce("times", F.lit(0)) + F.greatest(F.lit(0), F.least("words", F.coalesce("most", F.lit(0)) - F.col("ahead")))
        got = (
            self.pieces.join(times.hint("merge"), ["src", "block"], "left")
            .groupBy("doc_id", "src", "start", "size").agg(F.sum(words).alias("taken")).select("doc_id", "src", "size", "taken")
        )
        none = self.docs.where("size = 0").select("doc_id", "src", "size", F.lit(0).cast("long").alias("taken"))
        out = common.join_bounded(got.union(none), self.sources.select("src", "source_size", "target"), ["src"])
        return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    """Sources (source, source_size) with their targets.  Weights are dealt by code point
    order, null last.  A target is weight times one common level, or ``most`` times the
    source's size if that is less; the level is where the targets sum to all words."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("src", F.row_number().over(order)).withColumn("weight", w.cast("double"))
    rows = rows.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "src")
    everything = Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - full) / open_)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"]
    rows = rows.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0))))
    size = F.col("source_size")
    whole = F.least(F.round("target").cast("long"), most * size)  # words to take
    rows = rows.withColumn("blocks", F.ceil(size / block).cast("long")).withColumn("full", F.floor(size / block).cast("long"))
    rows = rows.withColumn("passes", F.when(size > 0, F.floor(whole / size)).otherwise(0).cast("long")).withColumn("more", whole - F.col("passes") * size)
    rows = rows.withColumn("rest", F.least(F.floor(F.col("more") / block).cast("long"), "full")).withColumn("left", F.col("more") - F.col("rest") * block)
    rows = rows.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("rest") + (F.col("left") > 0).cast("long"))
    return rows.select("src", "source", "source_size", "weight", "target", "blocks", "full", "passes", "rest", "left", "slots")


def streams(docs: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Adds src and start, the document's offset in its source's stream of words."""
    rows = common.join_bounded(docs, sources.select("source", "src"), ["source"]).drop("source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(buckets)))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("src", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "bucket").orderBy("doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(base, ["src", "bucket"])
    return rows.select("doc_id", "src", (F.col("base") + F.col("inner")).alias("start"), "size", "text_hash", "copy")


class Draws:
    """The multinomial draws of all shards, and which of a source's slots each place takes."""

    def __init__(self, sources: list, shard_slots: int, block: int, seed: int):
        self.src, self.size, self.blocks, self.full, self.passes, self.rest, self.left, self.slots = (
            np.array([r[k] for r in sources], np.int64) for k in ("src", "source_size", "blocks", "full", "passes", "rest", "left", "slots")
        )
        self.shard_slots, self.block, self.seed = shard_slots, block, seed
        self.total = int(self.slots.sum())
        self.shards = -(-self.total // shard_slots)
        self.groups = -(-self.shards // SHARDS)

    def group(self, g: int) -> range:
        return range(g * SHARDS, min((g + 1) * SHARDS, self.shards))

    def places(self, shard: int) -> int:
        return min(self.shard_slots, self.total - shard * self.shard_slots)

    def draw(self, shard: int) -> np.ndarray:
        """Slots of each source in a shard."""
        return np.random.default_rng([self.seed, shard]).multinomial(self.places(shard), self.slots / self.total)

    def settle(self, drawn: np.ndarray) -> None:
        """Takes the draws' totals: places behind a source's last slot go to the sources that were drawn too seldom."""
        self.drawn = drawn
        self.over = np.cumsum(np.maximum(drawn - self.slots, 0)) - np.maximum(drawn - self.slots, 0)
        self.under = np.cumsum(np.maximum(self.slots - drawn, 0))

    def taken(self, shard: int, ahead: np.ndarray) -> list[np.ndarray]:
        """slot, src, block, pass, take, part of a shard's places; ``ahead`` are the sources' draws in all shards ahead."""
        counts = self.draw(shard)
        at = np.repeat(np.arange(len(counts)), counts)
        k = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + ahead[at]
        moved = np.flatnonzero(k >= self.slots[at])
        u = self.over[at[moved]] + k[moved] - self.slots[at[moved]]
        to = np.searchsorted(self.under, u, "right")
        short = np.maximum(self.slots - self.drawn, 0)
        at[moved], k[moved] = to, self.drawn[to] + u - (self.under[to] - short[to])
        turn, j = k // self.blocks[at], k % self.blocks[at]
        key = mix64(turn.astype(np.uint64) * np.uint64(0x9E3779B9) + (self.src[at] * 0x85EBCA6B + self.seed).astype(np.uint64))
        number = j.copy()
        inner = np.flatnonzero(j < self.full[at])  # a short block is the last of its pass
        number[inner] = permute(j[inner].astype(np.uint64), self.full[at[inner]].astype(np.uint64), key[inner]).astype(np.int64)
        part = (turn == self.passes[at]) & (j == self.rest[at])
        take = np.where(part, self.left[at], np.minimum(self.block, self.size[at] - number * self.block))
        same = lambda v: np.full(len(k), v, np.uint64)
        slot = permute(np.arange(len(k), dtype=np.uint64), same(len(k)), same(self.seed + shard)).astype(np.int64)
        return [slot, self.src[at], number, turn, take, part]


SLOTS = "shard long, slot long, src long, block long, pass long, take long, part boolean"


def deal(sources: DataFrame, shard_slots: int, block: int, seed: int) -> DataFrame:
    """The slot table.  Joins with it ask for a sort-merge: a few rows become very many here, which Spark's size
    estimate cannot see, so it might broadcast them."""
    spark = sources.sparkSession
    draws = Draws(sorted((r.asDict() for r in sources.where("slots > 0").collect()), key=lambda r: r["src"]), shard_slots, block, seed)  # a row for each source
    if not draws.total:
        return spark.createDataFrame([], SLOTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.column(0).to_pylist():
                n = sum(draws.draw(s) for s in draws.group(g))
                yield pa.RecordBatch.from_pydict({"g": np.full(len(n), g), "at": np.arange(len(n)), "n": n})

    groups = spark.range(0, draws.groups, 1, min(draws.groups, 4 * spark.sparkContext.defaultParallelism))
    sums = common.cut(groups.mapInArrow(common.tidy(count), "g long, at long, n long"))
    drawn = np.zeros(len(draws.src), np.int64)
    for r in sums.groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each source
        drawn[r["at"]] = r.n
    draws.settle(drawn)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("at").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    begin = sums.withColumn("before", before).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "before"))).alias("before"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ahead = np.array([x["before"] for x in r["before"]], np.int64)
                for shard in draws.group(r["g"]):
                    cols = draws.taken(shard, ahead)
                    ahead = ahead + draws.draw(shard)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), shard)), *map(pa.array, cols)], names=["shard", "slot", "src", "block", "pass", "take", "part"])

    return begin.mapInArrow(common.tidy(task), SLOTS)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Plans the mix of ``docs`` (doc_id, text, source)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = common.cut(sized.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    sources = common.cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most, block).withColumn("src", F.col("src").cast("long")))
    buckets = max(256, -(-(rows.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS))
    many = rows.where(F.col("n") > COPIES).withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)"))).repartition("doc_id", "text_hash", "first")
    few = rows.where(F.col("n") <= COPIES).withColumn("first", F.lit(0).cast("long"))
    copies = few.unionByName(many).withColumn("copy", F.explode(F.expr(f"sequence(first, least(first + {COPIES}L, n) - 1)"))).drop("n", "first")
    laid = common.cut(streams(copies, sources, buckets))
    holds = laid.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    begin = F.greatest(F.col("block") * block, F.col("start"))
    pieces = holds.select(
        "doc_id", "src", "start", "size", "text_hash", "copy", "block", (begin - F.col("start")).alias("from_word"),
        (F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - begin).alias("words"), (begin - F.col("block") * block).alias("ahead"),
    )
    return Mix(sources, laid, deal(sources, shard_slots, block, seed), pieces)


# -- texts -----------------------------------------------------------------------


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words [first, first + count) of a text, with the white space between them; separate spans are joined by a line feed."""
    import re

    found = [m.span() for m in re.finditer(common.WORD, text)]
    merged: list[list[int]] = []
    for first, count in sorted(spans):
        if merged and merged[-1][1] == first:
            merged[-1][1] = first + count
        else:
            merged.append([first, first + count])
    if len(merged) == 1 and merged[0] == [0, len(found)]:
        return text
    return "\n".join(text[found[a][0] : found[b - 1][1]] for a, b in merged)


def mixed_documents(docs: DataFrame, places: bool = False, **options) -> DataFrame:
    """The mix as documents: for each pass over a source, each document's words that the pass takes, as a
    row with the columns of ``docs``; text and n_chars are those of the taken words.  A document that
    no slot takes has no row, one that is taken again has a row for each time.  A row belongs to the shard
    that its first block was dealt to; the rows of a shard come out together, in the order of its slots
    (with ``places``, their numbers are added as columns shard and slot)."""
    made = mix(docs, **options)
    words = F.least("words", F.col("take") - F.col("ahead"))
    want = made.pieces.join(made.slots.hint("merge"), ["src", "block"]).withColumn("words", words).where("words > 0")
    place = F.min(F.struct("shard", "slot")).alias("place")
    want = want.groupBy("doc_id", "src", "start", "text_hash", "copy", "pass").agg(place, F.collect_list(F.struct("from_word", "words")).alias("spans"))
    want = want.groupBy("doc_id", "src", "start", "text_hash", "copy").agg(F.collect_list(F.struct("place", "spans")).alias("passes"))
    want = common.join_bounded(want, made.sources.select("src", "source"), ["src"]).select("doc_id", "source", "text_hash", "copy", "passes")
    # columns by number, so that no name clashes; keys without nulls: the numbering of equal rows and the join share one exchange of the texts
    at = {c: i for i, c in enumerate(docs.columns)}
    i_text, i_chars, width = at["text"], at.get("n_chars"), len(at)
    plain = docs.toDF(*[f"c{i}" for i in range(width)])
    ident = lambda i, s: F.xxhash64(i, F.isnull(i), s, F.isnull(s))
    hashable = [f"c{i}" for i, f in enumerate(docs.schema.fields) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = plain.withColumn("row", ident(F.col(f"c{at['doc_id']}").cast("long"), F.col(f"c{at['source']}").cast("string"))).withColumn("hash", F.xxhash64(f"c{i_text}"))
    keyed = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("row", "hash").orderBy(F.xxhash64(*hashable))) - 1)
    want = want.select(ident(F.col("doc_id"), F.col("source")).alias("r"), F.col("text_hash").alias("h"), F.col("copy").alias("k"), "passes")
    rows = keyed.join(want, (keyed["row"] == want["r"]) & (keyed["hash"] == want["h"]) & (keyed["copy"] - want["k"] == 0)).select(*plain.columns, "passes")
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick, texts, shard, slot = [], [], [], []
            for i, (text, passes) in enumerate(zip(b.column(i_text).to_pylist(), b.column(width).to_pylist())):
                for p in passes:
                    pick.append(i)
                    texts.append(cut_words(text, [(s["from_word"], s["words"]) for s in p["spans"]]))
                    shard.append(p["place"]["shard"])
                    slot.append(p["place"]["slot"])
            cols = [b.column(i).take(pa.array(pick, pa.int64())) for i in range(width)]
            cols[i_text] = pa.array(texts, pa.string())
            if i_chars is not None:
                cols[i_chars] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shard, pa.int64()), pa.array(slot, pa.int64())], names=[*b.schema.names[:-1], "shard", "slot"])

    fields = [T.StructField(f"c{i}", f.dataType if i not in (i_text, i_chars) else T.StringType() if i == i_text else T.LongType()) for i, f in enumerate(docs.schema.fields)]
    out = rows.mapInArrow(common.tidy(task), T.StructType([*fields, T.StructField("shard", T.LongType()), T.StructField("slot", T.LongType())]))
    out = out.repartition("shard").sortWithinPartitions("shard", "slot")
    return out.toDF(*docs.columns, "shard", "slot") if places else out.drop("shard", "slot").toDF(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
