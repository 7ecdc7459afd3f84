"""Running aggregates over long keys (a contig, a source) without putting a key in one task.

Rows are cut into blocks by position; a block's total goes ahead of the next block as a
base, and windows run within (keys, block) only.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def running(df: DataFrame, keys: list[str], block: str, order: list[str | Column], value: Column, kind: str, name: str, inclusive: bool = True) -> DataFrame:
    """Adds ``name``: running sum or max of ``value`` over (keys, order); null ahead of the first row if exclusive.
    ``block`` must not decrease along ``order``."""
    agg = {"sum": F.sum, "max": F.max}[kind]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}[kind]
    rows = df.withColumn("__v", value)
    totals = rows.groupBy(*keys, block).agg(agg("__v").alias("__t"))
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, block, agg("__t").over(ahead).alias("__base"))
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.join(base, [*keys, block]).withColumn("__in", agg("__v").over(inner))
    return rows.withColumn(name, join(F.col("__base"), F.col("__in"))).drop("__v", "__base", "__in")


def following(df: DataFrame, keys: list[str], block: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: the next row's ``order`` value within ``keys``; null on the last."""
    firsts = df.groupBy(*keys, block).agg(F.min(order).alias("__first"))
    nxt = firsts.select(*keys, block, F.lead("__first").over(Window.partitionBy(*keys).orderBy(block)).alias("__next"))
    rows = df.join(nxt, [*keys, block])
    inner = F.lead(order).over(Window.partitionBy(*keys, block).orderBy(order))
    return rows.withColumn(name, F.coalesce(inner, "__next")).drop("__next")
