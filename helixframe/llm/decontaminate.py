"""Operator 3: benchmark decontamination.

Test items are indexed as BM25 postings in blocks of items with block maxima; every
passage of every training document is a query.  Impacts are divided by the item's own
score, so one threshold serves all items, and a passage that holds an item scores 1.
A vectorised bound (matched anchors plus all other terms, which for every item stay below
the threshold) discards most passages and none that reaches it; the others, if they hold a
shingle without which the verification fails, go through block-max WAND, which returns all
items above the threshold; what it returns is verified by the overlap of five-word shingles
with the item's question (all but its last sentence) and answer (the last sentence).

A passage leaks an item if at least OVERLAP of the question's shingles and OVERLAP of the
answer's are in it, or OVERLAP of the shingles of both in a row, or OVERLAP of the question's
alone: a question gives the item away without its answer.  The last holds for questions of
five words or more, which are also indexed by themselves; an answer alone is no leak.  A part
of fewer than five words is held if all its words stand in a row.  The score is the item's or
its question's, the higher one.

An item of fewer than five words leaks if all of them stand in a row.  A word is a run of
letters and digits; each character of a script without spaces is one.

Passages are windows of twice the longest item with a stride of its length, so every
occurrence lies whole in some passage.  Statistics (items, mean and greatest length, document
frequencies) are those of all items.  Indexes are built by tasks in blocks of about half of
INDEX_ITEMS items, a fixed bound, and written to the shared folder; a larger benchmark means
more blocks, and results do not depend on their number.  Documents are read and cut into words
once: up to KEPT blocks stay in a task, of more each is loaded in turn for HOLD bytes of text.

Defined results: null and empty texts, and items that are null or without a word, match
nothing; repeated documents each get their rows; repeated items each match; of equal scores
(ties) all count, as no item is preferred; texts and items of any length are read whole; empty
tables give no rows; documents' other columns are not read by ``leaks`` and pass ``drop_leaks``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from . import common, tokens

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
MIN_STRIDE = 64
#: Items in one index at most; about 10 MB of postings.
INDEX_ITEMS = 20_000
#: Indexes that a task holds at once, and bytes of text that are searched by each when there are more.
KEPT, HOLD = 8, 32 << 20
BLOCK = 64
#: Postings of anchors that are summed at once.
POSTINGS = 1 << 20


def words(text: str) -> np.ndarray:
    """Hashes of the words of one text, signs left out."""
    out = [tokens.split(d, o, signs=False)[2] for d, o in tokens.chunks(pa.array([text], pa.string()))]
    return out[0] if out else np.empty(0, np.uint64)


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words; of a shorter text, of the whole."""
    k = min(k, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + h[i : i + n]
    return tokens.finish(out + np.uint64(k))


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence, its last quarter."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    if len(parts) > 1:
        cut = text.rstrip().rfind(parts[-1])
        return text[:cut], text[cut:]
    found = text.split()
    n = max(1, len(found) // 4)
    return " ".join(found[:-n]), " ".join(found[-n:])


class Stats(NamedTuple):
    """Of all items that have words: how many, their mean and greatest length, and document frequencies of (at least the index's) terms."""

    items: int
    mean: float
    longest: int
    df: dict[int, int]


class Index:
    """Inverted index of items with block maxima.  Fits a task: INDEX_ITEMS bounds it.  Without ``stats`` the items are all there are."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, overlap: float = OVERLAP, stats: Stats | None = None):
        self.threshold, self.overlap = threshold, overlap
        kept = [(i, t, words(t)) for i, t in items if t]
        kept = [x for x in kept if len(x[2])]
        parted = [(w, *np.split(w, [len(words(question_answer(t)[0]))])) for _, t, w in kept]
        # entries: the whole items, then the questions that are long enough not to match by chance
        self.of = [*range(len(kept)), *(k for k, (w, q, _) in enumerate(parted) if SHINGLE <= len(q) < len(w))]
        self.ids = [kept[k][0] for k in self.of]
        self.parts = [tuple(np.unique(shingles(x)) for x in parted[k]) for k in self.of]
        self.sizes = [tuple(min(SHINGLE, len(x)) for x in parted[k]) for k in self.of]
        self.stride = max([MIN_STRIDE, *(len(w) for *_, w in kept)] if stats is None else [MIN_STRIDE, stats.longest])
        # a passage can pass the verification only if it holds a shingle of the item or, where both parts are short, the question
        needed = [(n[0], x[0]) for n, x in zip(self.sizes, self.parts)] + [(n[1], x[1]) for n, x in zip(self.sizes, self.parts) if 0 < n[1] < SHINGLE > n[2]]
        self.needed = {}
        for k in sorted({k for k, _ in needed}):
            known = np.unique(np.concatenate([x for j, x in needed if j == k]))
            bits = np.zeros(1 << 18, bool)
            bits[(known & np.uint64(0x3FFFF)).astype(np.int64)] = True
            self.needed[k] = known, bits
        here = len(kept)
        n = here if stats is None else stats.items
        avg = sum(len(w) for *_, w in kept) / max(n, 1) if stats is None else stats.mean
        uniq = [np.unique(w, return_counts=True) for *_, w in kept]
        self.vocab, df = np.unique(np.concatenate([u for u, _ in uniq] or [np.empty(0, np.uint64)]), return_counts=True)
        if stats is not None:
            df = np.array([stats.df[t] for t in self.vocab.view(np.int64).tolist()], np.int64)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        item, term, impact, anchor = [], [], [], []
        uniq += [np.unique(parted[k][1], return_counts=True) for k in self.of[here:]]
        for k, (u, tf) in enumerate(uniq):
            at = np.searchsorted(self.vocab, u)
            score = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / avg))
            item.append(np.full(len(u), k))
            term.append(at)
            impact.append(score / score.sum())
            # rare terms, then the least frequent others until what is left cannot reach the threshold
            by = np.argsort(df[at], kind="stable")
            ahead = np.cumsum(impact[-1][by]) - impact[-1][by]
            anchor.append(df[at] <= max(2, n // 10))
            anchor[-1][by[1 - ahead >= threshold - 1e-6]] = True
        item, term, impact, anchor = (np.concatenate(x or [np.empty(0)]) for x in (item, term, impact, anchor))
        anchor = anchor.astype(bool)
        order = np.lexsort((item, term))
        self.item, self.impact = item[order].astype(np.int64), impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocab) + 1))
        # only anchors start a candidate; what an item's other terms add up to is its base, below the threshold
        self.base = np.bincount(item[~anchor].astype(int), impact[~anchor], len(self.of))
        held = order[anchor[order]]
        self.start_item, self.start_impact = item[held].astype(np.int64), impact[held]
        self.start_first = np.searchsorted(term[held], np.arange(len(self.vocab) + 1))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.lists = [self._list(t) for t in range(len(self.vocab))]

    def _list(self, t: int) -> tuple:
        a, b = self.first[t], self.first[t + 1]
        item, impact = self.item[a:b], self.impact[a:b]
        ends = np.arange(BLOCK, len(item) + BLOCK, BLOCK).clip(max=len(item))
        peaks = np.array([impact[e - BLOCK if e % BLOCK == 0 else e - e % BLOCK : e].max() for e in ends]) if len(item) else impact
        return item, impact, item[ends - 1] if len(item) else item, peaks, float(impact.max()) if len(item) else 0.0

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score for the distinct ``terms`` reaches the threshold, by block-max WAND."""
        cursors = [[self.lists[t], 0] for t in terms.tolist()]
        out, bar = [], self.threshold - 1e-9
        while True:
            cursors = sorted((c for c in cursors if c[1] < len(c[0][0])), key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[0][4]
                if bound >= bar:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = int(cursors[pivot][0][0][cursors[pivot][1]])
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            # block maxima of the lists up to the pivot
            peak, until = 0.0, None
            for (ids, _, lasts, peaks, _), _at in cursors[: pivot + 1]:
                k = int(np.searchsorted(lasts, item))
                if k < len(lasts):
                    peak += peaks[k]
                    until = int(lasts[k]) if until is None else min(until, int(lasts[k]))
            if peak < bar:
                to = (item if until is None else until) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, int(cursors[pivot + 1][0][0][cursors[pivot + 1][1]]))
                to = max(to, item + 1)
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    at = c[1] + int(np.searchsorted(c[0][0][c[1] :], item))
                    if at < len(c[0][0]) and c[0][0][at] == item:
                        score += c[0][1][at]
                if score >= bar:
                    out.append((item, float(score)))
                to = item + 1
            for c in cursors[: pivot + 1]:
                c[1] += int(np.searchsorted(c[0][0][c[1] :], to))

    def search(self, h: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(document, item) -> best score, question and answer overlap, over all passages of a run of documents."""
        hits: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(h) or not len(self.vocab):
            return hits
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.vocab, h[at]).clip(max=len(self.vocab) - 1)
        at, term = at[good := self.vocab[term] == h[at]], term[good]
        # segments of one stride; a passage is two neighbouring ones of a document
        firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        inside = np.arange(len(h)) - np.repeat(firsts, np.diff(np.r_[firsts, len(h)]))
        new = np.r_[True, (inside[1:] // self.stride != inside[:-1] // self.stride) | (doc[1:] != doc[:-1])]
        seg = np.cumsum(new) - 1
        seg_first = np.flatnonzero(new)
        seg_doc = doc[seg_first]
        worth = self.worth(h, seg, len(seg_first))
        # each segment's distinct terms that are an anchor of some item
        starts = (self.start_first[term + 1] > self.start_first[term]) & (worth | np.r_[False, worth[:-1]])[seg[at]]
        pair = np.unique(seg[at[starts]] * len(self.vocab) + term[starts])
        p_seg, p_term = pair // len(self.vocab), pair % len(self.vocab)
        sizes = self.start_first[p_term + 1] - self.start_first[p_term]
        total = np.r_[0, np.cumsum(sizes)]
        todo, n = set(), len(self.ids)
        seg_at = np.searchsorted(p_seg, np.arange(len(seg_first) + 1))
        seg_total = total[seg_at]
        follows = np.r_[False, seg_doc[1:] == seg_doc[:-1]]
        s = 0
        while s < len(seg_first):  # runs of segments of about POSTINGS, each with the first segment of the next run
            e = max(s + 1, int(np.searchsorted(seg_total, seg_total[s] + POSTINGS)) - 1)
            lo, hi = seg_at[s], seg_at[min(e + 1, len(seg_first))]
            post = np.repeat(self.start_first[p_term[lo:hi]] - (total[lo:hi] - total[lo]), sizes[lo:hi]) + np.arange(total[hi] - total[lo])
            key, back = np.unique(np.repeat(p_seg[lo:hi], sizes[lo:hi]) * n + self.start_item[post], return_inverse=True)
            weight = np.bincount(back, self.start_impact[post], len(key))
            # of the passage that begins at a segment, and of the one that ends there
            nxt = np.searchsorted(key, key + n).clip(max=max(len(key) - 1, 0))
            both = weight + np.where(key[nxt] == key + n, weight[nxt], 0) if len(key) else weight
            base, of = self.base[key % n], key // n
            todo.update(of[both + base >= self.threshold - 1e-9].tolist())
            todo.update((of[(weight + base >= self.threshold - 1e-9) & follows[of]] - 1).tolist())
            s = e
        for s in sorted(t for t in todo if worth[t]):
            a = seg_first[s]
            last = s + 1 < len(seg_first) and seg_doc[s + 1] == seg_doc[s]
            e = s + 1 + last
            b = seg_first[e] if e < len(seg_first) else len(h)
            lo, hi = np.searchsorted(at, (a, b))
            found = self.wand(np.unique(term[lo:hi]))
            if not found:
                continue
            have = {k: np.unique(shingles(h[a:b], k)) for k in range(1, SHINGLE + 1)}
            for k, score in found:
                overlaps = [float(np.isin(x, have[n]).mean()) if n else 1.0 for x, n in zip(self.parts[k], self.sizes[k])]
                if self.leaked(k, *overlaps):
                    at_item = int(seg_doc[s]), self.of[k]
                    hits[at_item] = tuple(map(max, hits.get(at_item, (0, 0, 0)), (round(score, 9), *overlaps[1:])))
        return hits

    def worth(self, h: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
        """Which of the passages that begin at the ``n`` segments hold a shingle without which the verification fails."""
        if self.overlap <= 0:
            return np.ones(n, bool)
        out = np.zeros(n + 1, bool)
        for k, (known, bits) in self.needed.items():
            x = shingles(h, k)
            at = np.flatnonzero(bits[(x & np.uint64(0x3FFFF)).astype(np.int64)])
            out[seg[at[known[np.searchsorted(known, x[at]).clip(max=len(known) - 1)] == x[at]]]] = True
        return out[:-1] | out[1:]

    def leaked(self, k: int, whole: float, question: float, answer: float) -> bool:
        """Whether a passage with these overlaps leaks the item of entry ``k``."""
        if whole >= self.overlap or self.sizes[k][0] < SHINGLE:
            return whole >= self.overlap
        return question >= self.overlap and (answer >= self.overlap or self.sizes[k][1] == SHINGLE)


def split_all(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(rows ahead, word hashes, row of each word from there) of runs of texts."""
    out, done = [], 0
    for data, offsets in tokens.chunks(texts):
        out.append((done, *tokens.split(data, offsets, signs=False)[2:]))
        done += len(offsets) - 1
    return out


def found(index: Index, texts: pa.Array | list) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
    """(row of ``texts``, item, (score, question and answer overlap)); ``texts`` may be what :func:`split_all` made of them."""
    for done, h, doc in texts if isinstance(texts, list) else split_all(texts):
        for (d, item), r in index.search(h, doc).items():
            yield done + d, item, r


def build(items: DataFrame, uri: str, threshold: float, overlap: float, index_items: int = INDEX_ITEMS) -> list[str]:
    """Writes the indexes of all ``items`` below ``uri``; their files' names, one for each block of items."""
    common.small_batches(items.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(t) for t in b.column(1).to_pylist()]
            terms = pa.array([np.unique(w).view(np.int64) for w in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(w) for w in found], pa.int64()), terms], names=["item_id", "text", "n", "terms"])

    rows = items.where("text is not null").mapInArrow(common.tidy(split), "item_id long, text string, n long, terms array<long>")
    rows = common.cut(rows.where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    if not total.items:
        return []
    n_blocks = -(-total.items // (index_items // 2))
    rows = rows.withColumn("block", F.pmod("row", F.lit(n_blocks)))
    # frequencies over all items, for each block those of its terms
    terms = rows.select("block", F.explode("terms").alias("term")).groupBy("block", "term").agg(F.count(F.lit(1)).alias("n"))
    df = terms.withColumn("df", F.sum("n").over(Window.partitionBy("term")))  # a row for each block that has the term
    df = df.groupBy("block").agg(F.collect_list(F.struct("term", "df")).alias("df"))
    blocks = rows.groupBy("block").agg(F.collect_list(F.struct("item_id", "text")).alias("items")).join(df, "block")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                stats = Stats(total.items, total.mean, total.longest, {x["term"]: x["df"] for x in r["df"]})
                mine = sorted(((x["item_id"], x["text"]) for x in r["items"]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
                name = f"index-{r['block']:06d}-{common.attempt()}"
                common.put(uri, name, pickle.dumps(vars(Index(mine, threshold, overlap, stats)), protocol=5))
                yield pa.RecordBatch.from_pydict({"file": [name]})

    names = blocks.select("block", "items", "df").repartition(n_blocks, "block").mapInArrow(common.tidy(write), "file string")
    return sorted(r.file for r in names.collect())  # one for each block


def searched(batches: Iterator[pa.RecordBatch], column: int, uri: str, files: list[str]) -> Iterator[tuple[pa.RecordBatch, Iterator]]:
    """Each batch with the hits in its texts: (row, item_id, (score, question and answer overlap))."""

    def load(name: str) -> Index:
        index = object.__new__(Index)
        vars(index).update(pickle.loads(common.get(uri, name)))
        return index

    kept = [load(f) for f in files] if len(files) <= KEPT else None
    held: list[tuple[pa.RecordBatch, list, list]] = []
    size = 0

    def search() -> Iterator[tuple[pa.RecordBatch, list]]:
        for index in kept or map(load, files):
            for _, texts, hits in held:
                hits += [(d, index.ids[item], r) for d, item, r in found(index, texts)]
        for b, _, hits in held:
            yield b, hits

    for b in batches:
        held.append((b, split_all(b.column(column)), []))
        size += b.column(column).nbytes
        if kept is not None or size >= HOLD:
            yield from search()
            held, size = [], 0
    if held:
        yield from search()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each document and the items found in it."""
    uri = common.shared_path(docs.sparkSession, "items")
    files = build(items, uri, threshold, overlap, index_items)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
        for b, hits in searched(batches, 1, uri, files):
            rows = [(b.column(0)[d].as_py(), item, *r) for d, item, r in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return cols.mapInArrow(common.tidy(task), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, in place: nothing is joined or shuffled."""
    uri = common.shared_path(docs.sparkSession, "items")
    files = build(items, uri, threshold, overlap)
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits in searched(batches, at, uri, files):
            keep = np.ones(b.num_rows, bool)
            keep[[d for d, _, _ in hits]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(common.tidy(task), docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
