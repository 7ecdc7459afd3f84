"""Operators on tab-delimited tables and region lookups."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.columns import natural_key
from . import intervals


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, order: list[str], name: str, split: str | None = None, missing: str = "") -> DataFrame:
    """Adds ``name``: the table's value for a key (of equal keys the last by ``order``); with ``split`` the key is a list and values
    are joined by comma in its order."""
    last = table.groupBy(F.col(table_key).alias("__k")).agg(F.max_by(F.col(value).cast("string"), F.struct(*order)).alias("__v"))
    if split is None:
        out = df.join(last, df[key] == last["__k"], "left")
        return out.withColumn(name, F.coalesce("__v", F.lit(missing))).drop("__k", "__v")
    rows = df.withColumns(intervals.row_key(df))
    parts = rows.select("__id", "__id2", F.posexplode(F.split(key, split)).alias("__i", "__k")).distinct().join(last, "__k")
    got = parts.groupBy("__id", "__id2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]), ",").alias("__j"))
    return rows.join(got, ["__id", "__id2"], "left").withColumn(name, F.coalesce("__j", F.lit(missing))).drop("__id", "__id2", "__j")


def in_table(df: DataFrame, key: str, values: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether the key is among ``values`` (value)."""
    hits = values.select(F.col("value").alias("__k")).distinct().withColumn("__hit", F.lit(True))
    return df.join(hits, df[key] == hits["__k"], "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


def annotate(df: DataFrame, key: list[str], table: DataFrame, value: str, how: str, order: list[str] = (), name: str = "value") -> DataFrame:
    """Adds ``name`` from overlapping rows of a region table: ``first`` (by ``order``), ``mean``, ``median``, ``min``, ``max``, ``count``,
    ``collapse`` (sorted set joined by comma) or ``flag``."""
    pairs = intervals.range_join(df.select(*key, "chrom", "start", "end"), table)
    v = F.col(f"r_{value}")
    agg = {
        "mean": F.avg(v), "median": F.percentile(v, 0.5) if how == "median" else None, "min": F.min(v), "max": F.max(v), "count": F.count(F.lit(1)), "flag": F.lit(True),
        "collapse": F.array_join(F.array_sort(F.collect_set(v.cast("string"))), ","), "first": F.min_by(v, F.struct(*[F.col(f"r_{o}") for o in order])) if order else F.first(v),
    }[how]
    out = df.join(pairs.groupBy(*key).agg(agg.alias("__v")), key, "left")
    return out.withColumn(name, F.coalesce("__v", F.lit(0)) if how == "count" else F.coalesce("__v", F.lit(False)) if how == "flag" else F.col("__v")).drop("__v")


def weighted_overlap(df: DataFrame, key: list[str], graph: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """key and ``how`` of the graph's values weighted by the length of overlap: ``mean``, ``median``, ``min`` or ``max``."""
    from ..functions.stats import weighted_mean, weighted_median

    pairs = intervals.range_join(df.select(*key, "chrom", "start", "end"), graph)
    pairs = pairs.select(*key, F.col(f"r_{value}").alias("v"), (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("w")).where("w > 0")
    if how == "median":
        return weighted_median(pairs, key, "v", "w")
    return pairs.groupBy(*key).agg({"mean": weighted_mean(F.col("v"), F.col("w")), "min": F.min("v"), "max": F.max("v")}[how].alias(how))


def query_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows that overlap one region; the contig is found with or without ``chr``.  Plain predicates, so a scan prunes by them."""
    names = [chrom, chrom[3:] if chrom.startswith("chr") else f"chr{chrom}"]
    return df.where(F.col("chrom").isin(names) & (F.col("start") < end) & (F.col("end") > start))


def reg2bin(start: Column, end: Column, shift: int = 14, depth: int = 5) -> Column:
    """Smallest bin of the hierarchical index that holds [start, end)."""
    last, out = end - 1, F.lit(0)
    for level in range(1, depth + 1):
        s = shift + 3 * (depth - level)
        first = sum(8**k for k in range(level))
        out = F.when(F.shiftright(start.cast("long"), s) == F.shiftright(last.cast("long"), s), first + F.shiftright(start.cast("long"), s)).otherwise(out)
    return out.cast("long")


def split(df: DataFrame, by: str = "chrom") -> DataFrame:
    return df.withColumn("part", F.col(by))


def concat(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables in natural order of their file names, with that name as column file."""
    out = None
    for name in tables:
        part = tables[name].withColumn("file", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(natural_key(F.col("file")))


def sort_rows(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Sorts by typed keys: ``s`` text, ``i`` whole numbers, ``f`` numbers, ``n`` natural order; upper case is descending."""
    order = []
    for name, kind in keys:
        c = {"s": lambda c: c.cast("string"), "i": lambda c: c.try_cast("long"), "f": lambda c: c.try_cast("double"), "n": natural_key}[kind.lower()](F.col(name))
        order.append(c.desc() if kind.isupper() else c.asc())
    return df.orderBy(*order)


def digests(df: DataFrame, column: str = "content") -> DataFrame:
    """MD5, SHA-1 and SHA-256 of a binary column (as of ``binaryFile``)."""
    return df.withColumns({"md5": F.md5(column), "sha1": F.sha1(column), "sha256": F.sha2(column, 256)})
