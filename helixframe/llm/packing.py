"""Operator 1: token ids packed into fixed-length rows, as binary files.

Documents are tokenised with a public vocabulary file (its path is a parameter), each
ends with the end-of-text id, and what is longer than a row is split into pieces whose
concatenation is the document.  Pieces are packed by best-fit-decreasing: a segment
tree over capacities finds the fullest row that still has room.  Packing happens within
shards of SHARD_TOKENS tokens, the unit of memory of a task and of recovery; nothing is
shuffled.

A shard is one ``.npz`` file: ids (rows x length), cu_seqlens with row bounds, and for
each segment the document, its piece number and count.  Position ids restart at 0 at
every segment, so the resets of a row are its cu_seqlens without the last entry.

Defined results: null and empty texts are one segment that holds the end-of-text id;
repeated rows are packed as often as they occur; a null id stays null; an empty table
writes no file and gives no rows; a text of any length has the ids that the vocabulary gives
the whole of it; documents of one length keep their order; other columns are not read.
"""

from __future__ import annotations

import base64
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value of the vocabulary: how text is cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
ROW = 2048
SHARD_TOKENS = 1 << 22
#: Table of the shards, below their folder.
MANIFEST = "manifest"
#: Runs of white space from this length on are more than the encoder's own pattern search has a stack for.
_LONG_SPACE = re.compile(r"\s{20000}")


class Tokenizer:
    """A tiktoken vocabulary read once on the driver and sent to tasks as its bytes."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, end: int = END):
        with open(path, "rb") as f:
            self.raw = f.read()
        self.pattern, self.end, self.encoding = pattern, end, None

    def __getstate__(self):
        return self.__dict__ | {"encoding": None}

    def _load(self):
        if self.encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            self.encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.encoding

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text and the end-of-text id."""
        text, encoding = text or "", self._load()
        if _LONG_SPACE.search(text):  # the same pattern, searched without recursion
            import regex

            pieces = (m[0].encode() for m in regex.finditer(self.pattern, text))
            out = [i for p in pieces for i in encoding._encode_single_piece(p)]
        else:
            out = encoding.encode_ordinary(text)
        return np.array([*out, self.end], np.uint16)

    def decode(self, ids: np.ndarray) -> str:
        return self._load().decode([int(i) for i in ids if i != self.end])


class Capacities:
    """Segment tree over remaining capacities 0..length: how many rows have each, and the rows."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the least capacity that is at least ``need``."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:  # down, to its leftmost row
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of positions in ``sizes``; every size is 1..length."""
    rows: list[list[int]] = []
    free = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        hit = free.take(sizes[i])
        if hit is None:
            rows.append([])
            hit = (length, len(rows) - 1)
        rows[hit[1]].append(i)
        if hit[0] > sizes[i]:
            free.add(hit[0] - sizes[i], hit[1])
    return rows


def pack_shard(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> dict[str, np.ndarray]:
    """Arrays of one shard from (document, ids)."""
    pieces = [(doc, k, -(-len(ids) // length), ids[k * length : (k + 1) * length]) for doc, ids in docs for k in range(-(-len(ids) // length))]
    rows = best_fit_decreasing([len(p[3]) for p in pieces], length)
    matrix = np.full((len(rows), length), pad, np.uint16)
    bounds, segments, of_row = [], [], [0]
    for r, row in enumerate(rows):
        at = 0
        bounds.append(0)
        for i in row:
            doc, k, n, ids = pieces[i]
            matrix[r, at : at + len(ids)] = ids
            at += len(ids)
            bounds.append(at)
            segments.append((0 if doc is None else doc, doc is None, k, n))
        of_row.append(len(segments))
    seg = np.array(segments, np.int64).reshape(-1, 4)
    return {
        "ids": matrix, "cu_seqlens": np.array(bounds, np.int32), "segment_rows": np.array(of_row, np.int64),
        "doc_id": seg[:, 0], "doc_is_null": seg[:, 1].astype(bool), "piece": seg[:, 2].astype(np.int32), "pieces": seg[:, 3].astype(np.int32),
    }


def write_packed(docs: DataFrame, uri: str, tokenizer: Tokenizer, length: int = ROW, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards below ``uri``; lazily returns a manifest (shard, file, n_rows, n_tokens)."""
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal n, held, size
            name, out = f"shard-{part:06d}-{n:05d}", io.BytesIO()
            file = f"{name}-{common.attempt()}.npz"
            arrays = pack_shard(held, length, tokenizer.end)
            np.savez(out, **arrays)
            common.put(uri, file, out.getvalue())
            row = pa.RecordBatch.from_pydict({"shard": [name], "file": [file], "n_rows": [len(arrays["ids"])], "n_tokens": [size]})
            n, held, size = n + 1, [], 0
            return row

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids = tokenizer.encode(text.as_py())
                held.append((doc.as_py(), ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(common.tidy(task), "shard string, file string, n_rows long, n_tokens long")


SCHEMA = "shard string, row long, n_tokens long, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<string>"


def read_packed(spark: SparkSession, uri: str) -> DataFrame:
    """Rows of the shards that the manifest below ``uri`` lists; ids are little-endian unsigned 16-bit, pieces are "k/n"."""
    common.small_batches(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z = np.load(io.BytesIO(common.get(uri, file)))
                of_row, seams = z["segment_rows"], z["cu_seqlens"]
                ids, docs, nulls, piece, pieces = (z[k] for k in ("ids", "doc_id", "doc_is_null", "piece", "pieces"))
                for at in range(0, len(ids), 512):
                    cols: list[list] = [[] for _ in range(8)]
                    for r in range(at, min(at + 512, len(ids))):
                        a, e = int(of_row[r]), int(of_row[r + 1])
                        cu = seams[a + r : e + r + 1].tolist()
                        row = (name, r, cu[-1], ids[r].astype("<u2").tobytes(), cu, cu[:-1], [None if nulls[i] else int(docs[i]) for i in range(a, e)], [f"{piece[i]}/{pieces[i]}" for i in range(a, e)])
                        for c, v in zip(cols, row):
                            c.append(v)
                    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
                    names = ["shard", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return spark.read.parquet(f"{uri}/{MANIFEST}").select("shard", "file").mapInArrow(common.tidy(task), SCHEMA)


def pack(docs: DataFrame, uri: str | None = None, vocabulary: str = VOCABULARY, length: int = ROW) -> DataFrame:
    """Writes the packed shards of ``docs`` below ``uri`` (by default in the shared folder) and returns their rows as read back."""
    spark = docs.sparkSession
    uri = uri or common.shared_path(spark, "packed")
    write_packed(docs, uri, Tokenizer(vocabulary), length).write.parquet(f"{uri}/{MANIFEST}")
    return read_packed(spark, uri)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
