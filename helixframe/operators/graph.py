"""Connected components, lineage cuts in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: Edges of which one task keeps a spanning forest.
EDGES_PER_TASK = 1_000_000
#: Edges that are too few to be worth a distributed round: one task ends with them.
FEW_EDGES = 10_000
#: Rows of a few numbers that go to one checkpoint file.
ROWS_PER_FILE = 500_000
#: A key is hot if more than one row in so many carries it; there are fewer hot keys than this.
HOT = 10_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local one is made in local mode; a cluster could not read it, so there it is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="helixframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under :func:`shared_root`."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there: later jobs neither
    recompute it nor depend on the executors that made it.  With ``rows``, about how many
    there are, they go to few files instead of one for each task."""
    shared_root(df.sparkSession)
    if rows is not None:
        df = df.repartition(2 + rows // ROWS_PER_FILE)
    out = df.checkpoint(eager=True)
    if rows is None or rows > ROWS_PER_FILE:
        release(df.sparkSession)
    return out


class Store:
    """Parquet tables in the shared folder that live until :meth:`drop`: for what is read more than once,
    by column, and is too large for a checkpoint, or goes through rounds (a checkpoint passes on the size
    estimates of its plan, which rounds of joins multiply; a table has its true size)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """With ``rows``, about how many there are, they go to few files instead of one for each task."""
        path = shared_path(self.spark, name)
        self.paths.append(path)
        (df if rows is None else df.repartition(2 + rows // ROWS_PER_FILE)).write.parquet(path)
        if rows is None or rows > ROWS_PER_FILE:
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, first: int | None = None) -> None:
        """Deletes all tables, or the ``first`` so many."""
        jvm = self.spark.sparkContext._jvm
        for path in self.paths[:first]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = [] if first is None else self.paths[first:]


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with ``table``, which has one row for each key and, in ``n``, at least the number of
    rows that carry it; ``total`` is at least the sum of n.  Keys of more than one row in HOT are fewer
    than HOT and are broadcast; the rest meet in an exchange in which no key is much.  Both are read
    twice, so they should be stored.  ``n`` is dropped; null keys match nothing."""
    is_hot = F.col(n) > total // HOT
    if not (n_hot := table.where(is_hot).count()):
        return rows.join(table.drop(n), keys, how)
    hot = F.broadcast(table.where(is_hot).drop(n))
    if total <= HOT:  # all are
        return rows.join(hot, keys, how)
    assert n_hot <= HOT, "a key has more rows than its count says"
    cold = table.where(~is_hot).drop(n)
    return rows.join(hot, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(cold.hint("merge"), keys, how))


class Forest:
    """Union-find over any keys; the root of a set is its least key."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def add(self, a, b) -> bool:
        """Joins a and b; whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task's edges, as an edge from each node to the least node of its component there."""
    forest, schema = Forest(), None
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.add(x, y)
    nodes = list(forest.parent)
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([forest.find(x) for x in part], schema.types[0]), pa.array(part, schema.types[1])], schema=schema)


def components(edges: DataFrame, few: int = FEW_EDGES, edges_per_task: int = EDGES_PER_TASK, rounds: list | None = None) -> DataFrame:
    """Connected components of the undirected edges (a, b): (node, root) for each node of an edge between
    two nodes, root being the smallest node reachable; null ends are left out.

    The graph is contracted until ``few`` edges are left, which one task resolves.  First each task replaces
    its share of the edges by stars.  Then every node joins the first of itself and its neighbours, in odd
    rounds by value, which collapses stars, and in even rounds by a hash, which in expectation leaves a
    constant share of the nodes of any graph; so rounds grow with the logarithm of the graph and all of them
    read a multiple of it.  The rounds' maps are put together at the end, the smallest first.  ``rounds`` gets
    each round's edges."""
    ends = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    store = Store(edges.sparkSession)
    try:
        live = store.keep(ends, "edges")
        live = store.keep(live.repartition(1 + live.count() // edges_per_task).mapInArrow(stars, ends.schema).distinct(), "stars")
        return cut(contract(live, store, few, [] if rounds is None else rounds))
    finally:
        store.drop()


def contract(live: DataFrame, store: Store, few: int, rounds: list) -> DataFrame:
    """The rounds of :func:`components`."""
    first = total = live.count()
    maps: list[tuple[DataFrame, int]] = []
    while total > few:
        rounds.append(total)
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, k=len(maps): F.struct(*[F.xxhash64(F.lit(k), F.col(c)).alias("h")] * (k % 2), F.col(c).alias("to"))
        best = both.groupBy("a").agg(F.min(order("b")).alias("best"), F.count(F.lit(1)).alias("n"))
        step = store.keep(best.select(F.col("a").alias("node"), F.least("best", order("a"))["to"].alias("parent"), "n"), "step", 2 * total)
        maps.append((step.select("node", "parent"), 2 * total))
        to = {end: step.select(F.col("node").alias(end), F.col("parent").alias(f"{end}2"), "n") for end in "ab"}
        live = store.keep(join_hot(live, to["a"], ["a"], "n", 2 * total), "moved", total)
        live = join_hot(live, to["b"], ["b"], "n", 2 * total).where("a2 <> b2")
        live = store.keep(live.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "live", total)
        total = live.count()
    last = live.repartition(1).mapInArrow(stars, live.schema)
    last = last.select(F.col("b").alias("node"), F.col("a").alias("rep")).union(last.select("a", "a").distinct())
    if not maps:
        return last.withColumnRenamed("rep", "root")
    out = store.keep(last, "last", few)
    for step, size in reversed(maps):
        parents = step.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        ends = parents.join(out.withColumnRenamed("node", "parent"), "parent", "left").select("parent", F.coalesce("rep", "parent").alias("rep"), "n")
        out = store.keep(join_hot(step, store.keep(ends, "ends", size), ["parent"], "n", size).select("node", "rep"), "reps", size)
    # a node is an end of an edge, so there are at most two for each
    least = out.groupBy("rep").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n"))
    return join_hot(out, store.keep(least, "least", first), ["rep"], "n", 2 * first).select("node", "root")
