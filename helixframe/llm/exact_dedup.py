"""Operator 10: exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest (32 bytes), below the shared folder, with
buckets for its count of digests.  A batch of documents is reduced to one row per digest,
anti-joined with the index by sort-merge (the index side needs no exchange) and what is new
is appended.  Everything is DataFrame functions.

Defined results: null text counts as empty; an empty batch gives no rows; a digest
that the index already holds keeps the index's document, so all of its rows in the
batch are dropped; of repeated rows (same id, same text) one is kept, a tie that the rows'
places decide; a null id stays only where no row of its group has an id; texts of any length are
hashed whole.  Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Digests in one bucket of a new index: about 100 MB.
BUCKET_ROWS = 2_000_000
#: Files in a bucket, which are appends, from which the index is written anew, one sorted file for each bucket.
MOST_FILES = 8
#: Tasks over which one group of copies is spread.
SALTS = 64


class DigestIndex:
    """Digest -> kept document, as a table bucketed and sorted by digest.  ``buckets`` fixes their number; else a
    new index takes it from its first batch and one that is written anew from all it holds."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, root: str | None = None):
        self.spark, self.table, self.fixed = spark, table, buckets
        self.root = root or f"{common.shared_root(spark)}/{table}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], "digest binary, keep_id long")
        return self.spark.table(self.table)

    def buckets(self) -> int:
        """Buckets that the table has."""
        return int(next(r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {self.table}").collect() if r.col_name == "Num Buckets"))

    def append(self, rows: DataFrame) -> None:
        """Adds (digest, keep_id) rows; each task writes one sorted file of one bucket."""
        if not self.exists():
            return self._write(rows, self.table, self.fixed or 1 + rows.count() // BUCKET_ROWS)
        self._write(rows, self.table, buckets := self.buckets())
        if len(self.spark.table(self.table).inputFiles()) > MOST_FILES * buckets:
            self.compact()

    def _write(self, rows: DataFrame, table: str, buckets: int) -> None:
        # by the bucket's number: a plain repartition by digest of rows read from the index itself would be planned away
        (
            rows.select("digest", F.col("keep_id").cast("long")).repartition(buckets, F.pmod(F.hash("digest"), F.lit(buckets)))
            .write.mode("append").format("parquet").option("path", self._path(table))
            .bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)
        )

    def _path(self, table: str) -> str:
        """The folder of a table: that of the catalogue, or a new one."""
        if self.spark.catalog.tableExists(table):
            return next(r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Location")
        return f"{self.root}/{uuid.uuid4().hex}"

    def compact(self) -> None:
        """Writes the index anew, one sorted file for each of as many buckets as it needs, and takes that in the old one's place."""
        rows, old, fresh = self.read(), self._path(self.table), f"{self.table}_{uuid.uuid4().hex[:8]}"
        self._write(rows, fresh, self.fixed or 1 + rows.count() // BUCKET_ROWS)
        self.spark.sql(f"DROP TABLE {self.table}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.table}")
        self._delete(old)

    def _delete(self, folder: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._delete(self.root)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Deduplicates ``docs`` against ``index`` and itself and appends what is new.

    Returns doc_id, keep_id, group_size (rows of the batch with this text), kept and
    text_sha256 (of the text with A-Z lower-cased), one row per row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = F.unhex(F.sha2(common.lower_ascii(F.col("text")).cast("binary"), 256))
    batch = docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    batch = common.cut(common.salted(batch, F.col("row"), salts))
    top = F.max(F.struct("doc_id", "row"))  # the largest id; of its rows the last
    groups = common.cut(common.group_stats(batch, "digest", {"top": top, "n": F.count(F.lit(1))}, {"top": F.max("top"), "group_size": F.sum("n")}))
    held, parts = index.read().hint("merge"), ["digest", "group_size", "__salts"]
    fresh = common.cut(groups.join(held, "digest", "left_anti").select(*parts, F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("stays")))
    known = common.cut(groups.join(held, "digest").select(*parts, "keep_id", F.lit(None).cast("long").alias("stays"))) if index.exists() else None
    index.append(fresh.select("digest", "keep_id"))
    out = common.attach(batch, fresh if known is None else fresh.union(known), "digest")
    kept = F.coalesce(F.col("row") == F.col("stays"), F.lit(False)).alias("kept")
    return out.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` as the first batch of a new index."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)
    finally:
        index.drop()


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
