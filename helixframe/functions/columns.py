"""Column functions shared by the operators."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column


def natural_key(name: Column) -> Column:
    """Sort key for contig names: runs of digits compare as numbers (chr2 < chr10 < chrM < chrX)."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 18, "0")).otherwise(p)), "")


def strands_match(a: Column, b: Column) -> Column:
    """``*`` (or null) matches any strand."""
    a, b = F.coalesce(a, F.lit("*")), F.coalesce(b, F.lit("*"))
    return (a == "*") | (b == "*") | (a == b)


def glob_regex(pattern: str) -> str:
    """A glob of ``*`` (any run) and ``?`` (at most one character) as an anchored regular expression."""
    import re

    return "^" + "".join({"*": ".*", "?": ".?"}.get(c, re.escape(c)) for c in pattern) + "$"


def matches_any(name: Column, globs: list[str]) -> Column:
    return name.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def region(text: Column, zero_based: bool = False) -> Column:
    """``ref:start-end`` (1-based unless ``zero_based``; ``\\:`` is a colon of the name) as (chrom, start, end);
    a bare name is the whole contig, with start -1."""
    whole = F.regexp_replace(text, r"\\:", "\u0001")
    chrom = F.regexp_replace(F.regexp_extract(whole, r"^([^:]+)", 1), "\u0001", ":")
    first = F.regexp_extract(whole, r":(\d+)", 1)
    last = F.regexp_extract(whole, r":\d+-(\d+)", 1)
    begin = F.when(first == "", -1).otherwise(first.try_cast("long") - (0 if zero_based else 1))
    end = F.when(first == "", -1).when(last == "", begin + 1).otherwise(last.try_cast("long"))
    return F.struct(chrom.alias("chrom"), begin.cast("long").alias("start"), end.cast("long").alias("end"))


def phred(p: Column) -> Column:
    """-10 log10 p; 255 for p <= 0, 0 for p >= 1."""
    return F.when(p <= 0, 255.0).when(p >= 1, 0.0).otherwise(-10 * F.log10(p))


def trim_zero(value: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
