"""Operator 7: repeated strings of 200 bytes, by prefix-free parsing.

A rolling hash over TRIGGER bytes gives every position a value; the trigger of a
200-byte string is the position of its least value (the first of equals), so it depends on the
string alone and every string has one.  Texts are parsed at their triggers: what leads up to
a trigger and ends with its bytes is a phrase, what follows to a depth of 200 bytes is the parse
behind it.  The strings of one trigger start in its phrase.  No phrase suffix of a trigger is a
proper prefix of another (the trigger would stand in it earlier), so strings are in the order
of their phrase suffixes and, where these are equal, of the parse behind them.

The parse is reduced to its distinct phrases with what follows and how often each occurs: one
that occurs twice repeats all its strings, a trigger that occurs once repeats none.  For what is
left, the suffix array of the dictionary (distinct phrases, each ended) and the sorted parse
with its common prefixes are built for runs of triggers and combined into corpus order; a
string repeats if its common prefix with a neighbour there, the phrase suffix and the least
common prefix of the parse between them, is 200 bytes long.  Bytes are compared, hashes only
bring equal triggers together.  A trigger of more than GROUP phrases is dealt out by string
instead, with 128 bits of hash beside the trigger's.

Defined results: null counts as empty; texts under 200 bytes lose nothing; strings never
span documents; repeated rows are separate documents, so all their strings repeat; of equal
strings (ties) all are removed; null ids are allowed; very long texts are parsed in parts; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

LENGTH = 200
TRIGGER = 48
#: Start positions handled at once; longer texts are parsed in overlapping parts.
STEP = 1 << 20
#: Distinct phrases of one trigger that a task may hold.
GROUP = 4096
_B1, _B2, _B3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_POS = np.uint64((1 << 24) - 1)


def rolling(data: np.ndarray, base: int, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the polynomial hash modulo 2 ** 64 of the bytes from every position on, by doubling."""
    powers, h, n = {}, data.astype(np.uint64) + np.uint64(1), 1
    while True:
        powers[n] = h
        if 2 * n > max(lengths) or len(h) <= n:
            break
        h, n = h[:-n] * np.uint64(pow(base, n, 1 << 64)) + h[n:], 2 * n
    out = []
    for length in lengths:
        count = len(data) - length + 1
        if count <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        total, at = np.zeros(count, np.uint64), 0
        for size in sorted(powers, reverse=True):
            if length - at >= size:
                total = total * np.uint64(pow(base, size, 1 << 64)) + powers[size][at : at + count]
                at += size
        out.append(total)
    return out


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width`` positions."""
    n, count = 1, len(v) - width + 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    return np.minimum(v[:count], v[width - n : width - n + count])


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of a run of texts: (text, first and last start in the text, trigger's place behind the first, trigger hash, hash of the phrase and what follows)."""
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for base in range(0, max(len(data) - length + 1, 0), STEP):
        part = data[base : base + STEP + length - 1]
        (short,) = rolling(part, _B1, (TRIGGER,))
        (full,) = rolling(part, _B2, (length,))
        value = tokens.finish(short)
        least = window_min((value & ~_POS) | np.arange(len(value), dtype=np.uint64), length - TRIGGER + 1)
        trigger = (least & _POS).astype(np.int64)
        start = np.arange(base, base + len(trigger))
        ok = start + length <= ends[start]
        first = ok & np.r_[True, (trigger[1:] != trigger[:-1]) | (doc[start[1:]] != doc[start[:-1]]) | ~ok[:-1]]
        lo = np.flatnonzero(first)
        if not len(lo):
            continue
        stop = np.r_[first[1:] | ~ok[1:], True] & ok
        hi = np.flatnonzero(stop)
        phrase = tokens.finish(tokens.finish(full[lo]) * np.uint64(3) + tokens.finish(full[hi] + np.uint64(7)) + (hi - lo).astype(np.uint64))
        of = doc[lo + base]
        yield of, lo + base - offsets[of], hi + base - offsets[of], trigger[lo] - lo, value[trigger[lo]], phrase


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with equal id and text get equal results, so (did, th) identifies them."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("did", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("th", F.xxhash64("text"))


def phrases(docs: DataFrame, length: int) -> DataFrame:
    """(did, th, lo, hi, at, trigger, phrase) for all texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for data, offsets in tokens.chunks(b.column(2)):
                for of, lo, hi, at, trigger, phrase in parse(data, offsets, length):
                    rows = pa.array(of + done)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64))], names=["did", "th", "lo", "hi", "at", "trigger", "phrase"])
                done += len(offsets) - 1

    cols = docs.select("did", "th", "text").where(F.octet_length("text") >= length)
    return cols.mapInArrow(common.tidy(task), "did long, th long, lo int, hi int, at int, trigger long, phrase long")


def suffixes(docs: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """The dictionary's phrases with their bytes and what follows, read from the document that each was first seen in."""
    wanted = dictionary.groupBy("did", "th").agg(F.collect_list(F.struct("lo", "hi", "at", "trigger", "once")).alias("spans"))
    # repeated rows hold the same phrases: one of them is enough
    rows = docs.select("did", "th", "text").join(wanted, ["did", "th"]).dropDuplicates(["did", "th"]).select("did", "th", "text", "spans")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["trigger", "did", "th", "lo", "hi", "at", "once", "bytes"]
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                lo, hi, at, trigger, once = b.column(3)[i].values.flatten()
                for s in range(0, len(lo), 10_000):
                    lo_, hi_, at_, trigger_, once_ = (x.slice(s, 10_000) for x in (lo, hi, at, trigger, once))
                    cut = pa.array([data[x : y + length] for x, y in zip(lo_.to_pylist(), hi_.to_pylist())], pa.binary())
                    same = pa.array(np.full(len(cut), i))
                    yield pa.RecordBatch.from_arrays([trigger_, b.column(0).take(same), b.column(1).take(same), lo_, hi_, at_, once_, cut], names=names)

    return rows.mapInArrow(common.tidy(task), "trigger long, did long, th long, lo int, hi int, at int, once boolean, bytes binary")


def suffix_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary, as ranks: for the byte at each place of the phrases put together (each ended by
    a sign below all others) the rank of the suffix from there to the phrase's end; and the phrases' first places.
    Equal suffixes have equal ranks.  By prefix doubling, from seven bytes on."""
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases)) + 1
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(phrases) + b"\0", np.uint8).astype(np.int64) + 1
    data[first + sizes - 1] = 0
    left = np.repeat(first + sizes, sizes) - np.arange(len(data))  # bytes to the end, with the ending sign
    key, h = np.zeros(len(data), np.int64), 7
    for j in range(h):
        key[: len(data) - j] += np.where(left[: len(data) - j] > j, data[j:], 0) << (9 * (h - 1 - j))
    rank = np.unique(key, return_inverse=True)[1]
    while h < sizes.max():
        ahead = np.zeros(len(data), np.int64)
        far = np.flatnonzero(left > h)
        ahead[far] = rank[far + h] + 1
        rank = np.unique(rank * (len(data) + 1) + ahead, return_inverse=True)[1]
        h *= 2
    return rank, first


def sorted_parse(follow: list[bytes], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of what follows the phrases, and a sparse table of least common prefixes: row k has those of 2 ** k neighbours on."""
    order = sorted(range(len(follow)), key=follow.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lines = np.frombuffer(b"".join(follow[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
    sizes = np.fromiter((len(follow[i]) for i in order), np.int64, len(order))
    differ = lines[1:] != lines[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if len(order) > 1 else np.empty(0, np.int64)
    table = [np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))]
    while len(table[-1]) > (step := 1 << (len(table) - 1)):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    return rank, table


def common_prefix(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of what has the ranks a < b: the least between them."""
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level).tolist():
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(table[k][a[of]], table[k][b[of] - (1 << k)])
    return out


def corpus_order(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, held: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of entries (phrase and what follows) in corpus order: entry, start behind its first, and whether
    the string is equal to the next one."""
    dictionary: dict[bytes, int] = {}
    phrase = np.fromiter((dictionary.setdefault(x[: p + TRIGGER], len(dictionary)) for x, p in zip(held, at.tolist())), np.int64, len(held))
    suffix, first = suffix_ranks(list(dictionary))
    behind, table = sorted_parse([x[p:] for x, p in zip(held, at.tolist())], length)
    counts = (hi - lo + 1).astype(np.int64)
    entry = np.repeat(np.arange(len(lo)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    alpha, beta = suffix[first[phrase[entry]] + inner], behind[entry]
    order = np.argsort(alpha * (len(held) + 1) + beta, kind="stable")
    entry, inner, alpha, beta = (x[order] for x in (entry, inner, alpha, beta))
    equal = np.zeros(len(order), bool)
    near = np.flatnonzero(alpha[1:] == alpha[:-1])  # no two strings of an entry have equal phrase suffixes
    equal[near] = common_prefix(table, beta[near], beta[near + 1]) >= length - (at[entry[near]] - inner[near])
    return entry, inner, equal


def fingerprints(lo: np.ndarray, hi: np.ndarray, column: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """For every string of a run of phrases: (phrase, start in its document, two fingerprints)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    counts = (hi - lo + 1).astype(np.int64)
    phrase = np.repeat(np.arange(len(lo)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    of = (ends[:-1] - ends[0])[phrase] + inner
    return phrase, lo[phrase] + inner, *(tokens.finish(rolling(data, base, (length,))[0][of]) for base in (_B2, _B3))


def ranges(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, first, last) of runs of neighbouring positions; both arguments sorted."""
    new = np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)] if len(of) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return of[first], at[first], at[np.r_[first[1:], len(of)] - 1] if len(of) else at


def order_groups(length: int):
    """mapInArrow over suffixes sorted by trigger: (did, th, lo, hi) of the repeated strings of phrases that
    occur once, read from the corpus order of all strings of a run of triggers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.sorted_groups(batches, 1):
            did, th, lo, hi, at, once = (t.column(i).to_numpy() for i in range(1, 7))
            entry, inner, equal = corpus_order(lo, hi, at, t.column(7).to_pylist(), length)
            twice = equal.copy()
            twice[1:] |= equal[:-1]
            twice &= once[entry]
            entry, start = entry[twice], (lo[entry] + inner)[twice]
            line = np.lexsort((start, entry))
            of, first, last = ranges(entry[line], start[line])
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(did[of]), pa.array(th[of]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["did", "th", "lo", "hi"])

    return task


def order_strings(held: DataFrame, length: int, store: common.Store) -> DataFrame:
    """The same for triggers of very many phrases: every string is a row, dealt by its fingerprints."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trigger, did, th, lo, hi, _, once = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            step = 2000
            for s in range(0, b.num_rows, step):
                phrase, start, one, two = fingerprints(lo[s : s + step], hi[s : s + step], b.column(7).slice(s, step), length)
                phrase += s
                yield pa.RecordBatch.from_arrays([pa.array(trigger[phrase]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(did[phrase]), pa.array(th[phrase]), pa.array(start.astype(np.int32)), pa.array(once[phrase])], names=["trigger", "one", "two", "did", "th", "at", "once"])

    key = ["trigger", "one", "two"]
    rows = store.keep(held.mapInArrow(common.tidy(task), "trigger long, one long, two long, did long, th long, at int, once boolean"), "strings")
    twice = store.keep(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    return common.join_hot(rows.where("once"), twice, key, "n", rows.count(), "left_semi").select("did", "th", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeated(docs: DataFrame, store: common.Store, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(did, th, lo, hi): start positions lo..hi of strings that also start elsewhere."""
    found = store.keep(phrases(docs, length), "phrases")
    by_trigger = found.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("a"), F.max("phrase").alias("b"))
    again = store.keep(by_trigger.where("n > 1").select("trigger", (F.col("a") != F.col("b")).alias("mixed"), "n"), "triggers")
    parsed = store.keep(common.join_hot(found, again, ["trigger"], "n", found.count()), "repeats")
    store.drop(2)
    # triggers of one phrase only: it repeats
    whole = parsed.where("not mixed").select("did", "th", "lo", "hi")
    mixed = parsed.where("mixed").drop("mixed")
    first = F.min(F.struct("did", "th", "lo", "hi", "at")).alias("first")
    dictionary = mixed.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("n"), first)
    dictionary = store.keep(dictionary.select("trigger", "phrase", "n", "first.*"), "dictionary")
    often = dictionary.where("n > 1").select("trigger", "phrase", "n")
    many = common.join_hot(mixed, often, ["trigger", "phrase"], "n", mixed.count(), "left_semi").select("did", "th", "lo", "hi")
    wide = common.cut(dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("trigger"))
    n_wide = wide.count()
    held = store.keep(suffixes(docs, dictionary.withColumn("once", F.col("n") == 1), length), "suffixes")
    out = whole.union(many)
    if n_wide:
        wide = F.broadcast(wide) if n_wide <= 10_000 else wide
        out = out.union(order_strings(held.join(wide, "trigger", "left_semi"), length, store))
        held = held.join(wide, "trigger", "left_anti")
    few = held.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(common.tidy(order_groups(length)), "did long, th long, lo int, hi int")
    return out.union(few)


def cut_out(data: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the bytes kept."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs, store = keyed(docs, id_col, text_col), common.Store(spark)
    try:
        spans = repeated(docs, store, length).groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # a row that repeats gives its spans once
        spans = store.keep(spans, "spans")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            for b in batches:
                rows = []
                for i in range(b.num_rows):
                    data, spans = b.column(1)[i].as_py().encode("utf-8", "surrogatepass"), b.column(2)[i]
                    gone, runs, left = 0, 0, data
                    if spans.is_valid:
                        gone, runs, left = cut_out(data, *(x.to_numpy().astype(np.int64) for x in spans.values.flatten()), length)
                    rows.append((b.column(0)[i].as_py(), len(data), gone, runs, hashlib.sha256(left).hexdigest(), left if texts else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        joined = docs.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans")
        out = joined.mapInArrow(common.tidy(task), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        return common.cut(out if texts else out.drop("kept"))
    finally:
        store.drop()


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
