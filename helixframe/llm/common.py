"""Pieces shared by the corpus operators: lineage cuts, group statistics that
survive hot keys, and prefix sums that survive hot groups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import graph
from ..operators.graph import Store, components, cut, join_hot, release, shared_path, shared_root  # noqa: F401  pieces of the library

#: Documents in one Arrow batch.  A batch is what a Python worker holds at once,
#: so very long texts need a small one.
BATCH_ROWS = 1024

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word: a run without space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to :data:`BATCH_ROWS` rows unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def salted(df: DataFrame, row: Column, salts: int, name: str = "__salt") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))


def group_stats(df: DataFrame, key: str, partial: dict[str, Column], merge: dict[str, Column], salt: str = "__salt") -> DataFrame:
    """One row per ``key`` with the merged aggregates and ``__salts``, the salts its rows
    carry.  Rows are combined per (key, salt) first, so no task receives a hot group."""
    part = df.groupBy(key, salt).agg(*[c.alias(n) for n, c in partial.items()])
    return part.groupBy(key).agg(*[c.alias(n) for n, c in merge.items()], F.collect_set(salt).alias("__salts"))


def attach(df: DataFrame, stats: DataFrame, key: str, salt: str = "__salt", how: str = "inner") -> DataFrame:
    """Joins each row of ``df`` with its group's row of :func:`group_stats`, on (key, salt):
    a hot group is spread over as many tasks as there are salts."""
    spread = stats.withColumn(salt, F.explode("__salts")).drop("__salts")
    return df.join(spread, [key, salt], how).drop(salt)


def join_bounded(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = 100_000, rows: int | None = None) -> DataFrame:
    """Joins with a table that has one row for each key.  Up to ``limit`` rows (counted, not
    guessed) it is broadcast; beyond that Spark's own join is used, split by AQE.  Null keys match."""
    n = small.count() if rows is None else rows
    renamed = small.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [df[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    out = df.join(F.broadcast(renamed) if n <= limit else renamed, on, how)
    return out.drop(*[f"__r_{k}" for k in keys])


class Forest(graph.Forest):
    """Union-find that thins arrays of edges."""

    def thin(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
        """The edges among (a, b) that join what was apart."""
        keep = [i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())) if self.add(x, y)]
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"]) if keep else None


def attempt() -> int:
    """A number that no two attempts at a task share: files named with it are never written twice."""
    return TaskContext.get().taskAttemptId() if TaskContext.get() else 0


def put(uri: str, name: str, data: bytes) -> None:
    """Writes one file.  Names hold :func:`attempt`, and readers take the files that the manifest of the
    attempts that succeeded lists, so a lost or repeated task's files are never read."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(data)


def get(uri: str, name: str) -> bytes:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first ``keys`` columns; many groups in a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if held and any(held[-1].column(i)[-1] != b.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            held.append(b.slice(0, int(new[-1]) + 1))
            yield pa.Table.from_batches(held)
            held = [b.slice(int(new[-1]) + 1)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def tidy(task):
    """A mapInArrow function that gives unused memory back when its partition ends, as Python workers outlive it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run
