"""Operator 4: SimHash near-duplicates by generalised pigeonhole.

Fingerprints are reduced to distinct ones first, so copies cost nothing.  The bits
are grouped into partitions of correlated bits; thresholds t_i with
sum(t_i) = tau - partitions + 1 are allocated by dynamic programming on estimated
candidate counts (-1 leaves a partition out).  Two fingerprints within tau bits are
within t_i bits in some partition; each fingerprint is filed under every key within
ceil(t_i / 2) bits of its partition's value, so such two meet in a bucket.  A bucket
emits a spanning forest of its verified links, never all pairs.  A bucket of more
than BUCKET_ROWS distinct fingerprints is split: for tau <= 2 its members are filed
again with the whole fingerprint as the one partition, otherwise compared block by
block, so no link is lost and no task holds it whole.

Defined results: null and empty texts have fingerprint zero and link like any other;
repeated rows each get a result row; rows with null ids link like any other, and a component
is null only if none of its rows has an id; very long texts are read whole, one at a time;
ties of a bit (half of the hashes) give 0; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from . import common

SEED = 42
#: Distinct fingerprints that one bucket may hold in a task.
BUCKET_ROWS = 4096
MAX_PARTITIONS = 6
#: Filed rows that one task compares.
FILED_ROWS = 500_000
#: A comparison within a bucket against a row that is filed, sent and sorted (measured).
PAIR_COST = 0.01


# -- fingerprints ---------------------------------------------------------------


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased, repeats included."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts, stops = (ends - sizes)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def scramble(h: np.ndarray, lane: int) -> np.ndarray:
    """Another independent hash of each hash; lane 0 is the hash itself."""
    if not lane:
        return h
    z = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes | None, words: int = 3, lanes: int = 1) -> list[int]:
    h = shingle_hashes(text, words)
    return [majority(scramble(h, k)) for k in range(lanes)]


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp array<long>) of whole texts; a fingerprint's lanes are 64-bit words, stored signed, th is a hash of the text."""
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            rows = [fingerprint(t.as_py(), words, lanes) for t in texts]
            flat = np.array(rows, np.uint64).reshape(len(rows), lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(flat), pa.list_(pa.int64()))], names=["doc_id", "th", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("th"))
    return cols.mapInArrow(common.tidy(task), "doc_id long, th long, fp array<long>")


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


# -- partitions and thresholds ----------------------------------------------------


def bit_counts(reps: DataFrame, lane: int) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints and, for each pair of bits, how many set both: 64 x 64 sums over all of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for b in batches:
            fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.RecordBatch.from_pydict({"cell": np.append(np.arange(4096), -1), "n": np.append(total.ravel(), n)})

    sums = reps.select(reps.columns[1 + lane]).mapInArrow(common.tidy(task), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = dict(map(tuple, sums.collect()))  # 4097 rows at any size
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(4096)], np.float64).reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` near-equal partitions; a bit goes where its mean absolute correlation is largest."""
    f = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(f * (1 - f), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(f, f)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    room = [64 // parts + (i < 64 % parts) for i in range(parts)]
    groups: list[list[int]] = []
    left = list(range(64))
    for size in room:
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def estimated(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For t = 0..most: estimated pairs that meet in a bucket of this partition, from the chance of each bit to differ."""
    f = np.diag(both)[bits] / max(n, 1)
    dist = np.zeros(len(bits) + 1)
    dist[0] = 1
    for p in 2 * f * (1 - f):
        dist[1:] = dist[1:] * (1 - p) + dist[:-1] * p
        dist[0] *= 1 - p
    reach = np.cumsum(dist)
    # a ball of radius r brings together what is within 2 r bits
    return [n * n / 2 * reach[min(2 * math.ceil(t / 2), len(bits))] for t in range(most + 1)]


def ball(width: int, t: int) -> int:
    return sum(math.comb(width, k) for k in range(math.ceil(t / 2) + 1))


def allocate(n: int, both: np.ndarray, tau: int) -> tuple[list[tuple[list[int], int]], float]:
    """The partitions (bits, threshold) of least estimated cost: signatures filed plus candidates compared."""
    best: tuple[list[tuple[list[int], int]], float] = ([], math.inf)
    for parts in range(1, min(MAX_PARTITIONS, tau + 1) + 1):
        groups = group_bits(n, both, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:  # table: sum of (t_i + 1) so far -> least cost and its thresholds
            pairs, after = estimated(n, both, bits, min(tau, 4)), {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, min(tau, 4) + 1):
                    to = used + t + 1
                    if to > tau + 1:
                        break
                    c = cost if t < 0 else cost + n * ball(len(bits), t) + pairs[t] * PAIR_COST
                    if c < after.get(to, (math.inf,))[0]:
                        after[to] = (c, [*chosen, t])
            table = after
        if tau + 1 in table and table[tau + 1][0] < best[1]:
            best = [(g, t) for g, t in zip(groups, table[tau + 1][1]) if t >= 0], table[tau + 1][0]
    return best


# -- probing and verifying --------------------------------------------------------


def flips(bits: list[int], t: int) -> np.ndarray:
    """Masks that change at most ceil(t / 2) of the bits."""
    masks = [0] + [1 << b for b in bits] * (t > 0)
    if t > 2:
        masks += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[:i]]
    return np.array(masks, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, lane: int, tau: int, total: int) -> np.ndarray:
    """Whether fingerprints (lanes last) are linked by way of ``lane``: it is within ``tau`` bits, all together within ``total``.
    A pair that is linked by way of another lane is found when that lane is probed."""
    near = np.bitwise_count(a[..., lane] ^ b[..., lane]) <= tau
    if a.shape[-1] > 1 and near.any():
        hit = np.nonzero(near)
        a, b = np.broadcast_arrays(a, b)
        near[hit] = np.bitwise_count(a[hit] ^ b[hit]).sum(axis=-1) <= total
    return near


def forest(rows: np.ndarray, lane: int, tau: int, total: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links among fingerprints (rows x lanes)."""
    left = np.arange(len(rows))
    edges = []
    while len(left):
        head = left[:64]
        near = alike(rows[head][:, None, :], rows[left][None, :, :], lane, tau, total)
        near[np.arange(len(head)), np.arange(len(head))] = False
        linked = near.any(axis=1)
        if not linked.any():  # the usual case: none of these is near any that is left
            left = left[len(head) :]
            continue
        stays = np.ones(len(left), bool)
        stays[: len(head)] = linked
        first = int(linked.argmax())
        stays[first] = False
        queue, left = [head[first]], left[stays]
        while queue and len(left):
            x = queue.pop()
            near = alike(rows[left], rows[x][None, :], lane, tau, total)
            queue += (hit := left[near]).tolist()
            edges += [(int(x), int(y)) for y in hit]
            left = left[~near]
    return edges


EDGE = "a long, b long"
#: Buckets up to this size are compared as arrays of equal buckets, larger ones one by one.
SMALL = 16


def bucket_edges(lane: int, tau: int, totals: tuple[int, ...]):
    """mapInArrow over (key, rep, f0, f1, ...) sorted by key: edges between representatives, a forest for each bound of ``totals``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [common.Forest() for _ in totals]  # what this task has linked already
        for t in common.sorted_groups(batches, 1):
            key, rep, *lanes = (t.column(i).to_numpy() for i in range(t.num_columns))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            if (sizes < 2).all():
                continue
            fp = np.stack(lanes, axis=1).view(np.uint64)
            for total, linked in zip(totals, seen):
                a, b = [], []
                for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
                    at = starts[sizes == n]
                    for i in range(n):
                        for j in range(i):
                            near = alike(fp[at + i], fp[at + j], lane, tau, total)
                            a.append(at[near] + i)
                            b.append(at[near] + j)
                for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                    if edges := forest(fp[s : s + n], lane, tau, total):
                        x, y = np.array(edges).T
                        a.append(s + x)
                        b.append(s + y)
                if sum(map(len, a)):
                    a, b = np.concatenate(a), np.concatenate(b)
                    if len(totals) > 1:  # edges that will be verified: of two ways to join, the closer one
                        order = np.argsort(np.bitwise_count(fp[a] ^ fp[b]).sum(axis=-1), kind="stable")
                        a, b = a[order], b[order]
                    if thin := linked.thin(rep[a], rep[b]):
                        yield thin

    return task


def hashed(pid: int, value: np.ndarray) -> np.ndarray:
    """A partition's value as a bucket key; unrelated values that collide cost a comparison, no more."""
    return scramble(value, pid + 1).view(np.int64)


def signatures(reps: DataFrame, lane: int, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(key, rep, f0, f1, ...): every representative under each key of each partition."""
    jobs = [(i, np.uint64(sum(1 << b for b in bits)), flips(bits, t)) for i, (bits, t) in enumerate(plan)]
    names = ["key", *reps.columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = b.column(1 + lane).to_numpy(zero_copy_only=False).view(np.uint64)
            for pid, mask, masks in jobs:
                step = max(1, 200_000 // len(masks))
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    keys = hashed(pid, ((word[i : i + step] & mask)[:, None] ^ masks[None, :]).ravel())
                    pick = pa.array(np.repeat(np.arange(part.num_rows), len(masks)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(pick) for c in part.columns)], names=names)

    return reps.mapInArrow(common.tidy(task), ", ".join(f"{n} long" for n in names))


def maybe_hot(reps: DataFrame, lane: int, plan: list[tuple[list[int], int]], bucket_rows: int) -> DataFrame | None:
    """Keys that may hold more than ``bucket_rows``: those next to a value that alone has its share of as many.  None if there are none."""
    jobs = [(i, np.uint64(sum(1 << b for b in bits)), flips(bits, t)) for i, (bits, t) in enumerate(plan)]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for pid, mask, _ in jobs:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), pid, np.int32)), pa.array((word & mask).view(np.int64))], names=["pid", "value"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, value in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(hashed(pid, value ^ jobs[pid][2]))], names=["key"])

    share = F.element_at(F.array(*[F.lit(max(1, bucket_rows // len(m))) for *_, m in jobs]), F.col("pid") + 1)
    counts = reps.select(reps.columns[1 + lane]).mapInArrow(common.tidy(values), "pid int, value long").groupBy("pid", "value").agg(F.count(F.lit(1)).alias("n"))
    heavy = common.cut(counts.where(F.col("n") >= share).select("pid", "value"))
    return None if heavy.isEmpty() else heavy.mapInArrow(common.tidy(around), "key long").distinct()


def links(reps: DataFrame, tau: int, total: int | None = None, bucket_rows: int = BUCKET_ROWS, close: int | None = None) -> DataFrame:
    """Edges (a, b) between the representatives of distinct fingerprints (rep, f0, f1, ...) that
    connect all that is linked.  A link differs in at most ``tau`` bits in some lane and, with
    ``total``, in at most that many bits in all lanes together.  With ``close``, the edges also
    connect all that differs in at most that many bits, without the help of other links."""
    lanes = len(reps.columns) - 1
    total = (tau if total is None else total,) if close is None else (close, total)
    edges = reps.sparkSession.createDataFrame([], EDGE)
    for lane in range(lanes):
        n, both = bit_counts(reps, lane)
        plan, _ = allocate(n, both, tau)
        # few large tasks: each emits a spanning forest of what it sees
        tasks = max(2 * reps.sparkSession.sparkContext.defaultParallelism, n * sum(ball(len(bits), t) for bits, t in plan) // FILED_ROWS)
        filed = signatures(reps, lane, plan)
        hot, found = maybe_hot(reps, lane, plan, bucket_rows), []
        if hot is not None:
            hot = filed.join(hot.hint("merge"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
            hot = common.cut(hot)
            n_hot = hot.count()
            if n_hot:
                big = F.broadcast(hot) if n_hot <= 10_000 else hot
                members = filed.join(big, "key")
                if lanes == 1 and tau <= 2 and close is None:
                    again = signatures(members.select(*reps.columns).distinct(), lane, [(list(range(64)), tau)])
                    hubs = again.groupBy("key").agg(F.min("rep").alias("b"))
                    found.append(again.select("key", "rep").join(hubs.hint("merge"), "key").where("rep <> b").select(F.col("rep").alias("a"), "b"))
                else:
                    found.append(block_edges(members, bucket_rows, lane, tau, total))
                filed = filed.join(big, "key", "left_anti")
        found.append(filed.repartition("key").coalesce(tasks).sortWithinPartitions("key").mapInArrow(common.tidy(bucket_edges(lane, tau, total)), EDGE))
        for more in found:
            edges = edges.union(common.cut(more) if lanes > 1 else more)  # a lane's shuffle goes before the next begins
    return edges


def block_edges(members: DataFrame, rows: int, lane: int, tau: int, total: tuple[int, ...]) -> DataFrame:
    """All links within large buckets: members are dealt into blocks of about ``rows`` and every
    pair of blocks meets in a task of its own."""
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / rows).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")
    paired = dealt.select(cell, *[c for c in members.columns if c not in ("key", "n")])
    return paired.repartition("key").sortWithinPartitions("key").mapInArrow(common.tidy(bucket_edges(lane, tau, total)), EDGE)


def similar(edges: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The edges (a, b) whose texts (rep, text) have a Jaccard similarity of their sets of shingles of at least ``least``."""

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["rep", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                keep.append(both >= least * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sets = common.cut(texts.mapInArrow(common.tidy(shingle_sets), "rep long, s binary"))
    pairs = edges.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(common.tidy(compare), EDGE)


def near_duplicates(docs: DataFrame, words: int = 3, tau: int = 2, lanes: int = 1, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", close: int | None = None, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest id reachable over links.

    With ``similarity`` (and ``close``), fingerprints only propose: a link counts if the shingle sets of its texts
    have that Jaccard similarity.  Every edge of the proposed forests is verified; those of the closest pairs come first,
    so what a rejected edge would have joined is joined by closer ones where there are any."""
    fps = common.cut(fingerprints(docs, words, lanes, id_col, text_col))
    words64 = [F.col("fp")[k].alias(f"f{k}") for k in range(lanes)]
    # a fingerprint's node is a number of its own, as ids may be null
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.count(F.lit(1)).alias("n"))
    reps = common.cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    edges = links(reps.select("rep", *words64), tau, total, close=close)
    if similarity is not None:
        edges = common.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        nodes = reps.select("rep", "th").join(edges.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep")
        texts = docs.select(text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("th"))
        edges = similar(edges, texts.join(nodes, "th").dropDuplicates(["rep"]).select("rep", "text"), words, similarity)
    roots = common.components(edges)
    linked = common.cut(reps.select("rep", "least").join(roots.withColumnRenamed("node", "rep"), "rep"))
    groups = common.cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_rep = common.join_hot(linked.select("rep", "root"), groups, ["root"], "n", linked.count()).select("rep", "component_id", F.lit(True).alias("linked"))
    of_fp = reps.join(of_rep, "rep", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "n")
    return common.join_hot(fps, common.cut(of_fp), ["fp"], "n", fps.count()).select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
