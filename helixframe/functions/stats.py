"""Statistics: tests and distributions as Column functions or pandas UDFs, corrections as DataFrame functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def _table(a: int, b: int, c: int, d: int) -> float:
    f = log_factorial
    return math.exp(f(a + b) + f(c + d) + f(a + c) + f(b + d) - f(a) - f(b) - f(c) - f(d) - f(a + b + c + d))


def _tail(a: int, b: int, c: int, d: int, step: int, below: float) -> float:
    """Sum over tables reached by moving one count at a time that are less likely than ``below``."""
    total = 0.0
    while (a > 0 and d > 0) if step < 0 else (b > 0 and c > 0):
        a, b, c, d = a + step, b - step, c - step, d + step
        p = _table(a, b, c, d)
        total += p if p < below * (1 - 1e-7) else 0.0  # tables as likely as the given one differ by rounding only
    return total


def fisher(a: int, b: int, c: int, d: int, tail: str = "both") -> float:
    """Fisher's exact test: ``exact`` (the table alone), ``left`` (with it), ``right`` (tables beyond it only) or ``both``."""
    p = _table(a, b, c, d)
    if tail == "exact":
        return p
    left = _tail(a, b, c, d, -1, p) if tail in ("left", "both") else 0.0
    right = _tail(a, b, c, d, 1, p) if tail in ("right", "both") else 0.0
    return right if tail == "right" else p + left + right


def fisher_test(a: Column, b: Column, c: Column, d: Column, tail: str = "both") -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        cache: dict = {}
        out = []
        for key in zip(a, b, c, d):
            if key not in cache:
                cache[key] = None if any(pd.isna(x) for x in key) else fisher(*map(int, key), tail)
            out.append(cache[key])
        return pd.Series(out, dtype="float64")

    return run(a, b, c, d)


def proportion_pvalue(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-squared test of a 2 x 2 table with Yates's correction."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    chi = F.try_divide(n * F.pow(F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2), 2), (a + c) * (b + d) * (a + b) * (c + d))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v and v is not None else None).astype("float64")

    return tail(chi)


def poisson_pmf(x: int, mean: float) -> float:
    return math.exp(x * math.log(mean) - mean - math.lgamma(x + 1)) if mean > 0 else float(x == 0)


def poisson_cdf(x: int, mean: float) -> float:
    return sum(poisson_pmf(k, mean) for k in range(x + 1))


def poisson_upper(x: Column, mean: Column) -> Column:
    """P(X >= x)."""
    @F.pandas_udf("double")
    def run(x: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) or pd.isna(m) else max(0.0, 1 - poisson_cdf(int(k) - 1, float(m))) for k, m in zip(x, mean)], dtype="float64")

    return run(x.cast("long"), mean.cast("double"))


def nbinom_pmf(x: int, r: int, p: float) -> float:
    """Failures x before success r."""
    if x < 0 or r <= 0 or p <= 0:
        return 0.0
    if p >= 1:
        return float(x == 0)
    return math.exp(math.lgamma(x + r) - math.lgamma(r) - math.lgamma(x + 1) + r * math.log(p) + x * math.log1p(-p))


def nbinom_cdf(x: int, r: int, p: float) -> float:
    return sum(nbinom_pmf(k, r, p) for k in range(x + 1))


def _success(total: int, error: float) -> float:
    return 1 - max(1.0, math.ceil(total * error)) / total


def genotype_pvalue(kind: str, allele: int, total: int, error: float = 0.001) -> float:
    """``hom`` (the other reads are errors), ``het`` (half the reads), ``background`` (the reads are errors) or ``present`` (at its own frequency)."""
    if kind == "hom":
        return nbinom_pmf(total - allele, total, _success(total, error))
    if kind == "het":
        return nbinom_pmf(allele, (total + 1) // 2, 0.5)
    if kind == "background":
        return 1.0 if _success(total, error) == 0 else nbinom_pmf(allele, total, _success(total, error))
    return nbinom_pmf(total - allele, allele, allele / total)


def bonferroni(df: DataFrame, p: str = "pvalue") -> DataFrame:
    n = df.where(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(F.broadcast(n)).withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("__n"))).drop("__n")


def value_blocks(counts: DataFrame, value: str, name: str, blocks: int) -> DataFrame:
    """Adds ``name``: the block of a value, by quantiles of the rows of ``counts``, so that blocks are even however values are spread."""
    none = F.array().cast("array<double>")
    marks = counts.agg(F.coalesce(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), 10_000), none).alias("__cuts")) if blocks > 1 else counts.limit(0).agg(none.alias("__cuts"))
    # every sixteenth cut first, then those behind it
    marks = marks.withColumn("__coarse", F.filter("__cuts", lambda c, i: (i + 1) % 16 == 0))
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    rows = counts.join(F.broadcast(marks)).withColumn("__k", below(F.col("__coarse")) * 16)
    return rows.withColumn(name, F.col("__k") + below(F.slice("__cuts", F.col("__k") + 1, F.lit(16)))).drop("__cuts", "__coarse", "__k")


def ranks(df: DataFrame, value: str, blocks: int = 256) -> DataFrame:
    """Distinct values with n (rows of each), least_rank and rank (its first and last row in ascending order, from 1) and total (rows in all).
    Nulls have no rank.  Equal values are counted first, and windows run within blocks of values, so no task sorts them all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    counts = value_blocks(counts, value, "__b", blocks)
    totals = counts.groupBy("__b").agg(F.sum("n").alias("k"))  # one row for each block
    ahead = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__b", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("__base"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("total"))
    rows = counts.join(F.broadcast(base), "__b")
    rank = F.col("__base") + F.sum("n").over(Window.partitionBy("__b").orderBy(value))
    return rows.withColumn("rank", rank).withColumn("least_rank", F.col("rank") - F.col("n") + 1).select(value, "n", "least_rank", "rank", "total", "__b")


def benjamini_hochberg(df: DataFrame, p: str = "pvalue", blocks: int = 256) -> DataFrame:
    """Adds adjusted = min over larger p of p * n / rank; null for a null p.  Ranks and the running minimum are those of :func:`ranks`."""
    rows = ranks(df, p, blocks).withColumn("__q", F.col(p) * F.col("total") / F.col("rank"))
    least = rows.groupBy("__b").agg(F.min("__q").alias("m"))
    behind = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    least = least.select("__b", F.coalesce(F.min("m").over(behind), F.lit(1.0)).alias("__m"))
    within = F.min("__q").over(Window.partitionBy("__b").orderBy(F.col(p).desc()))
    adjusted = rows.join(F.broadcast(least), "__b").select(p, F.least(F.lit(1.0), within, F.col("__m")).alias("adjusted"))
    return df.join(adjusted, p, "left")


def mean_stddev(value: Column) -> list[Column]:
    """Aggregates: mean and sample standard deviation (n - 1; null for fewer than two values)."""
    return [F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.lit(1)).alias("stddev")]


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Median of values repeated by integer weight: keys, median.  Weights are summed by value first."""
    rows = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("__t", F.sum("__w").over(w)).withColumn("__c", F.sum("__w").over(w.orderBy(value)))
    lower = F.min(F.when(F.col("__c") >= F.ceil(F.col("__t") / 2), F.col(value)))
    upper = F.min(F.when(F.col("__c") >= F.floor(F.col("__t") / 2) + 1, F.col(value)))
    return rows.groupBy(*keys).agg(((lower + upper) / 2).alias("median"))


def permuted(score: Column, test: Column, pseudocount: int = 1) -> Column:
    """Aggregate: two-sided p value of ``test`` (one value for each group) against permuted scores; null without scores."""
    extreme = F.count_if(F.abs(score) >= F.abs(test))
    return F.least(F.lit(1.0), F.try_divide(F.lit(pseudocount) + extreme, F.count(score)))


def permuted_pvalue(scores: np.ndarray, test: float, pseudocount: int = 1) -> float:
    """Two-sided p value against permuted scores."""
    return min(1.0, (pseudocount + int((np.abs(scores) >= abs(test)).sum())) / len(scores))
