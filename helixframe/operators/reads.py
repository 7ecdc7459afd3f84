"""Sequence-read operators.  A read has name, comment, seq, qual (phred + 33) and mate (1 or 2)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.sequences import count_of, revcomp

#: Adapter of the ``--trim-illumina`` preset.
ILLUMINA = "AGATCGGAAGAGC"
#: Bases that the adapter search compares at once.
BASES = 4_000_000


def _cut(df: DataFrame, start: Column, length: Column, tag: str | None = None) -> DataFrame:
    """Keeps [start, start + length) of seq and qual; a changed read's comment gets ``tag``."""
    new = {"seq": F.substring(F.col("seq"), start + 1, length), "qual": F.substring(F.col("qual"), start + 1, length)}
    if tag:
        changed = length < F.length("seq")
        new["comment"] = F.when(changed, F.trim(F.concat_ws(" ", "comment", F.lit(tag)))).otherwise(F.col("comment"))
    return df.withColumns(new)


def name_contains(df: DataFrame, parts: list[str]) -> DataFrame:
    """Reads whose name and comment hold every part."""
    text = F.concat_ws(" ", "name", "comment")
    for p in parts:
        df = df.where(text.contains(p))
    return df


def include(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names.select("name"), "name", "left_semi")


def exclude(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names.select("name"), "name", "left_anti")


def trim_prefix(df: DataFrame, n: int, tag: bool = True) -> DataFrame:
    return _cut(df, F.lit(n), F.greatest(F.length("seq") - n, F.lit(0)), "#prefix" if tag else None)


def trim_suffix(df: DataFrame, n: int, tag: bool = True) -> DataFrame:
    return _cut(df, F.lit(0), F.greatest(F.length("seq") - n, F.lit(0)), "#suffix" if tag else None)


def trim_flanking(df: DataFrame) -> DataFrame:
    """Strips wildcards (N, n and .) from both ends."""
    start = F.length("seq") - F.length(F.regexp_replace("seq", r"^[Nn.]+", ""))
    end = F.length(F.regexp_replace("seq", r"[Nn.]+$", ""))
    return _cut(df, F.least(start, end), F.greatest(end - start, F.lit(0)))


def _below(least: int) -> str:
    """Character class of the qualities below ``least``."""
    return "[" + "".join(f"\\x{33 + q:02x}" for q in range(least)) + "]"


def trim_quality(df: DataFrame, least: int, prefix: bool = False) -> DataFrame:
    """Trims bases of quality below ``least`` from the end, or from the start."""
    if prefix:
        left = F.length(F.regexp_replace("qual", f"^{_below(least)}+", ""))
        return _cut(df, F.length("qual") - left, left)
    return _cut(df, F.lit(0), F.length(F.regexp_replace("qual", f"{_below(least)}+$", "")))


def adapter_ends(texts: list[str], adapter: str, overlap: int, identity: float) -> np.ndarray:
    """Length of the shortest end of each text that matches the adapter's start, 0 if none does; all texts as one array."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat, want = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in ("".join(texts), adapter))
    stop, full = np.cumsum(sizes), len(want)
    cut = np.zeros(len(texts), np.int64)
    for n in range(overlap, full):  # ends shorter than the adapter
        left = np.flatnonzero((cut == 0) & (sizes >= n))
        same = (flat[(stop[left] - n)[:, None] + np.arange(n)] == want[:n]).sum(axis=1)
        cut[left[same >= math.ceil(n * identity)]] = n
    if len(flat) >= full:
        last = len(flat) - full + 1
        same = np.zeros(last, np.int32)
        for k in range(full):
            same += flat[k : last + k] == want[k]
        at = np.flatnonzero(same >= math.ceil(full * identity))
        read = np.searchsorted(stop, at, side="right")
        fits = at + max(full, overlap) <= stop[read]
        found = np.full(len(texts), -1)
        np.maximum.at(found, read[fits], at[fits])
        cut = np.where((cut == 0) & (found >= 0), stop - found, cut)
    return cut


def trim_adapter(df: DataFrame, adapter: str = ILLUMINA, overlap: int = 4, identity: float = 0.9) -> DataFrame:
    """Cuts the shortest read end of at least ``overlap`` (1 or more) bases that matches the adapter's start: over the
    compared length at least ceil(length * identity) bases agree.  Reads are compared in Arrow batches, some millions of bases at once."""

    @F.pandas_udf("int")
    def ends(seq: pd.Series) -> pd.Series:
        texts, out, i = seq.fillna("").tolist(), [], 0
        while i < len(texts):
            j, bases = i, 0
            while j < len(texts) and (j == i or bases + len(texts[j]) <= BASES):
                bases += len(texts[j])
                j += 1
            out.append(adapter_ends(texts[i:j], adapter, overlap, identity))
            i = j
        return pd.Series(np.concatenate(out) if out else [], dtype="int32")

    return _cut(df.withColumn("__cut", ends("seq")), F.lit(0), F.length("seq") - F.col("__cut")).drop("__cut")


def few_wildcards(df: DataFrame, most: int) -> DataFrame:
    return df.where(count_of(F.col("seq"), "Nn.456") <= most)


def min_size(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.length("qual") >= least)


def paired(df: DataFrame) -> DataFrame:
    """Reads whose name occurs at least twice: counted first, so a hot name is pre-aggregated."""
    names = df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("name")
    return df.join(names, "name", "left_semi")


def filter_chain(df: DataFrame, steps: list[tuple[str, object]]) -> tuple[DataFrame, DataFrame]:
    """Applies named steps in order; returns the reads and a table (step, reads) of what each left."""
    counts = []
    for i, (name, step) in enumerate(steps):
        df = step(df)
        counts.append(df.agg(F.lit(i).alias("order"), F.lit(name).alias("step"), F.count(F.lit(1)).alias("reads")))
    table = counts[0]
    for c in counts[1:]:
        table = table.union(c)
    return df, table


def sort_reads(df: DataFrame, by_seq: bool = False) -> DataFrame:
    return df.orderBy("seq" if by_seq else "name", "mate")


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of both files in pairs, in name order; a name of one file only is an error of the input and is left out."""
    both = first.select("name").distinct().join(second.select("name").distinct(), "name")
    rows = first.withColumn("mate", F.lit(1)).unionByName(second.withColumn("mate", F.lit(2)))
    return rows.join(both, "name", "left_semi").orderBy("name", "mate")


def separate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("mate = 1"), df.where("mate = 2")


def split(df: DataFrame, parts: int) -> DataFrame:
    """Adds part: reads of one name go together, names are dealt by hash, so nothing is numbered globally."""
    number = F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.pmod(number, F.lit(parts)).cast("int"))


def barcode_matches(text: Column, barcode: str, mismatches: int = 0, wildcard: bool = False) -> Column:
    """Whether the barcode occurs in ``text`` with at most so many substitutions; N of the text fits any base with ``wildcard``."""
    n = len(barcode)

    def wrong(at: Column) -> Column:
        total = F.lit(0)
        for k, c in enumerate(barcode):
            b = F.substring(text, at + k, F.lit(1))
            total = total + ((b != c) & (~(b == "N") if wildcard else F.lit(True))).cast("int")
        return total

    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return (F.length(text) >= n) & F.exists(starts, lambda at: wrong(at) <= mismatches)


def demultiplex(df: DataFrame, groups: list[tuple[str, str, str]], mismatches: int = 1, wildcard: bool = False) -> DataFrame:
    """A row for each read and read group (id, lane substring, barcode) that fits; a read may fit several, and ``unmatched`` is none."""
    text = F.concat_ws(" ", "name", "comment")
    code = F.substring_index("comment", ":", -1)
    fits = [F.when((text.contains(lane) if lane else F.lit(True)) & barcode_matches(code, barcode, mismatches, wildcard), rg) for rg, lane, barcode in groups]
    found = F.array_compact(F.array(*fits))
    return df.withColumn("read_group", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unmatched")))))


def barcodes(df: DataFrame, least: float = 0.0, wildcards: bool = True) -> DataFrame:
    """Reads by lane and barcode with their share, for shares of at least ``least``."""
    lane, code = F.substring_index("comment", ":", 2), F.substring_index("comment", ":", -1)
    rows = df if wildcards else df.where(~code.contains("N"))
    got = rows.groupBy(lane.alias("lane"), code.alias("barcode")).agg(F.count(F.lit(1)).alias("count"))
    total = got.agg(F.sum("count").alias("__n"))
    return got.join(F.broadcast(total)).withColumn("fraction", F.col("count") / F.col("__n")).drop("__n").where(F.col("fraction") >= least)


def check(df: DataFrame) -> DataFrame:
    """Counts of reads whose seq and qual differ in length, with unfit quality characters, and of names that are not a pair."""
    singles = df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") != 2).alias("unpaired"))
    reads = df.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.length("seq") != F.length("qual")).alias("lengths"), F.count_if(F.col("qual").rlike(r"[^!-~]")).alias("quality"))
    return reads.join(F.broadcast(singles))


def length_stats(df: DataFrame) -> DataFrame:
    n = F.length("seq")
    return df.groupBy("mate").agg(F.count(F.lit(1)).alias("reads"), F.min(n).alias("min"), F.percentile(n, 0.25).alias("q25"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.75).alias("q75"), F.max(n).alias("max"))


def base_frequencies(df: DataFrame) -> DataFrame:
    """Bases by cycle: counted per read position before the shuffle."""
    rows = df.select("mate", F.posexplode(F.split("seq", "")).alias("cycle", "base")).where("base <> ''")
    return rows.groupBy("mate", (F.col("cycle") + 1).alias("cycle"), "base").agg(F.count(F.lit(1)).alias("count"))


def quality_by_cycle(df: DataFrame) -> DataFrame:
    """Quartiles of quality by cycle, from counts by quality."""
    rows = df.select("mate", F.posexplode(F.split("qual", "")).alias("cycle", "q")).where("q <> ''")
    counts = rows.groupBy("mate", (F.col("cycle") + 1).alias("cycle"), (F.ascii("q") - 33).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("mate", "cycle").agg(*[F.percentile("q", p, F.col("n")).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)], F.sum(F.col("q") * F.col("n")).alias("total"))


def gc_histogram(df: DataFrame) -> DataFrame:
    share = F.floor(100 * count_of(F.col("seq"), "GCgc") / F.length("seq"))
    return df.where("length(seq) > 0").groupBy("mate", share.cast("long").alias("gc")).agg(F.count(F.lit(1)).alias("count"))


def median_quality_histogram(df: DataFrame) -> DataFrame:
    """Reads by their median quality (the lower middle one)."""
    q = F.array_sort(F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33))
    return df.where("length(qual) > 0").groupBy("mate", F.get(q, F.floor((F.size(q) - 1) / 2).cast("int")).alias("quality")).agg(F.count(F.lit(1)).alias("count"))


def merge_overlapping(df: DataFrame, overlap: int = 10) -> DataFrame:
    """Merged pairs: the longest exact end of read 1 that begins the reverse complement of read 2; seq continues with the rest
    of that, qual with read 2's qualities from there on, unreversed."""
    one = df.where("mate = 1").select("name", F.col("seq").alias("s1"), F.col("qual").alias("q1"))
    two = df.where("mate = 2").select("name", revcomp(F.col("seq")).alias("s2"), F.col("qual").alias("q2"))
    rows = one.join(two, "name")
    n = F.least(F.length("s1"), F.length("s2"))
    fits = F.when(n >= overlap, F.filter(F.sequence(F.lit(overlap), F.greatest(n, F.lit(overlap))), lambda i: F.right("s1", i) == F.left("s2", i)))
    rows = rows.withColumn("best", F.array_max(fits)).where("best is not null")
    return rows.select("name", F.concat("s1", F.expr("substring(s2, best + 1)")).alias("seq"), F.concat("q1", F.expr("substring(q2, best + 1)")).alias("qual"), F.col("best").alias("overlap"))


def remix(tables: list[tuple[DataFrame, float]], seed: int = 1) -> DataFrame:
    """ceil(names * ratio) fragments of each table, those of the least digest of seed and name; mates stay together."""
    out = None
    for k, (df, ratio) in enumerate(tables):
        names = df.select("name").distinct().withColumn("__h", F.md5(F.concat(F.lit(f"{seed + k}:"), "name")))
        want = -(-int(names.count() * ratio * 1_000_000) // 1_000_000)
        chosen = names.orderBy("__h", "name").limit(want).select("name")
        part = df.join(chosen, "name", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def to_alignments(df: DataFrame) -> DataFrame:
    """Unmapped alignment rows: paired, first and second flags, the comment as tag CO."""
    flag = F.when(F.col("mate") == 1, 77).when(F.col("mate") == 2, 141).otherwise(4)
    return df.select("name", flag.cast("int").alias("flag"), F.lit("*").alias("chrom"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), "seq", "qual", F.create_map(F.lit("CO"), F.col("comment")).alias("tags"))


def to_fasta(df: DataFrame) -> DataFrame:
    return df.select("name", "comment", "seq")


def from_alignments(df: DataFrame, mapped: bool = True, unmapped: bool = True) -> DataFrame:
    """Reads of alignments: primary rows, reverse-strand ones reverse-complemented, one for each name and mate."""
    flag = F.col("flag")
    rows = df.where(flag.bitwiseAND(0x900) == 0)
    if not mapped:
        rows = rows.where(flag.bitwiseAND(4) != 0)
    if not unmapped:
        rows = rows.where(flag.bitwiseAND(4) == 0)
    minus = flag.bitwiseAND(16) != 0
    mate = F.when(flag.bitwiseAND(1) == 0, 0).when(flag.bitwiseAND(128) != 0, 2).otherwise(1)
    rows = rows.select("name", mate.alias("mate"), F.when(minus, revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(minus, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))
    return rows.groupBy("name", "mate").agg(F.min(F.struct("seq", "qual")).alias("r")).select("name", "mate", "r.*")
