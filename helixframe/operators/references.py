"""Operators on reference sequences (name, seq), or in chunks (chrom, chunk_start, seq) so that no contig is one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.columns import matches_any
from ..functions.sequences import AMBIGUITY, count_of, gc_fraction, iupac_regex, random_sequence, revcomp

CHUNK = 65_536
#: Chunk of what holds every window of a chunk at once.
WINDOW_CHUNK = 4_096


def chunked(df: DataFrame, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """(chrom, chunk_start, seq, length): pieces of ``size`` bases, each followed by ``overlap`` more."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size)))
    rows = df.select(F.col("name").alias("chrom"), "seq", F.length("seq").alias("length"), starts.alias("chunk_start"))
    return rows.select("chrom", F.col("chunk_start").cast("long").alias("chunk_start"), F.substring(F.col("seq"), F.col("chunk_start") + 1, F.lit(size + overlap)).alias("seq"), "length")


def names(df: DataFrame) -> DataFrame:
    return df.select("name")


def filter_names(df: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    if include:
        df = df.where(matches_any(F.col("name"), list(include)))
    return df.where(~matches_any(F.col("name"), list(exclude))) if exclude else df


def tag(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.withColumn("name", F.concat(F.lit(prefix), "name", F.lit(suffix)))


def wrap(df: DataFrame, width: int) -> DataFrame:
    """Lines of ``width`` bases."""
    return df.withColumn("seq", F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n"))


def reverse_complement(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", revcomp(F.col("seq")))


def subsequence(df: DataFrame, regions: DataFrame, stranded: bool = False) -> DataFrame:
    """Sequences of regions (chrom, start, end, strand); minus ones reverse-complemented if ``stranded``."""
    rows = regions.join(df.withColumnRenamed("name", "chrom"), "chrom")
    seq = F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return rows.withColumn("seq", F.when(F.col("strand") == "-", revcomp(seq)).otherwise(seq) if stranded else seq)


def fetch(df: DataFrame, regions: DataFrame, stranded: bool = True) -> DataFrame:
    """FASTA records (name, seq) of regions: named ``chrom:start-end`` (behind the region's own name, if it has one), ends swapped on
    the minus strand."""
    swap = (F.col("strand") == "-") & F.lit(stranded)
    a, b = F.when(swap, F.col("end")).otherwise(F.col("start")), F.when(swap, F.col("start")).otherwise(F.col("end"))
    place = F.concat("chrom", F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"))
    name = F.concat_ws("|", "name", place) if "name" in regions.columns else place
    return subsequence(df, regions, stranded).select(name.alias("name"), "seq")


def gc(df: DataFrame, size: int) -> DataFrame:
    """GC share in bins of each sequence; null without A, C, G or T."""
    rows = chunked(df, size)
    return rows.select("chrom", F.col("chunk_start").alias("start"), (F.col("chunk_start") + F.length("seq")).alias("end"), gc_fraction(F.col("seq")).alias("gc"))


def windows(df: DataFrame, size: int, step: int = 1) -> DataFrame:
    """(chrom, pos, seq) for each start, in one pass over chunks that overlap by ``size`` - 1."""
    span = WINDOW_CHUNK - WINDOW_CHUNK % step
    rows = chunked(df, span, size - 1)
    every = F.regexp_extract_all("seq", F.lit(f"(?=(.{{{size}}}))"), F.lit(1))
    if step > 1:
        every = F.filter(F.transform(every, lambda s, i: F.when(i % step == 0, s)), lambda s: s.isNotNull())
    rows = rows.select("chrom", "chunk_start", F.posexplode(every).alias("i", "seq"))
    return rows.select("chrom", (F.col("chunk_start") + F.col("i") * step).alias("pos"), "seq")


def trinucleotides(df: DataFrame) -> DataFrame:
    """Counts of trinucleotides, each counted under its pyrimidine-centred form; only those of A, C, G and T count.
    Chunks are counted as arrays, 64 numbers for each batch, so that no base becomes a row."""
    code = np.full(256, 64, np.int64)
    code[[ord(c) for c in "ACGT"]] = range(4)
    words = [x + y + z for x in "ACGT" for y in "ACGT" for z in "ACGT"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # pieces do not run into each other: a separator has no code
            c = code[np.frombuffer("\n".join(filter(None, batch.column(0).to_pylist())).encode(), np.uint8)]
            if len(c) > 2:
                word = 16 * c[:-2] + 4 * c[1:-1] + c[2:]
                fine = (c[:-2] < 4) & (c[1:-1] < 4) & (c[2:] < 4)
                yield pa.RecordBatch.from_pydict({"tri": words, "n": np.bincount(word[fine], minlength=64)})

    counts = chunked(df, WINDOW_CHUNK, 2).select("seq").mapInArrow(count, "tri string, n long").where("n > 0")
    canonical = F.when(F.substring("tri", 2, 1).isin("C", "T"), F.col("tri")).otherwise(revcomp(F.col("tri")))
    return counts.groupBy(canonical.alias("tri")).agg(F.sum("n").alias("count"))


def grep(df: DataFrame, bait: str, both: bool = True) -> DataFrame:
    """Positions (1-based) where the bait's codes fit, overlapping ones included."""
    found = None
    for strand in "+-" if both else "+":
        motif = bait if strand == "+" else reverse_motif(bait)
        rows = chunked(df, CHUNK, len(bait) - 1)
        pieces = F.split(F.regexp_replace("seq", f"(?=({iupac_regex(motif)}))", "\n"), "\n", -1)
        lengths = F.transform(pieces, lambda p: F.length(p))
        rows = rows.select("chrom", "chunk_start", F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))).alias("n"))
        hits = rows.select("chrom", "chunk_start", F.posexplode("n").alias("k", "len"))
        at = F.sum("len").over(Window.partitionBy("chrom", "chunk_start").orderBy("k"))
        hits = hits.select("chrom", (F.col("chunk_start") + at + 1).alias("pos"), F.lit(strand).alias("strand"))
        found = hits if found is None else found.union(hits)
    return found


def reverse_motif(motif: str) -> str:
    pair = dict(zip("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"))
    return "".join(pair[c] for c in reversed(motif.upper()))


def motif_score(df: DataFrame, matrix: dict[str, list[float]], threshold: float, pseudo: float = 0.8, background: float = 0.25) -> DataFrame:
    """Positions (0-based) and strand of windows whose log-odds against a count matrix reach the threshold."""
    counts = np.array([matrix[b] for b in "ACGT"], float)
    odds = np.log2((counts + pseudo) / (counts.sum(axis=0) + 4 * pseudo) / background)
    size = odds.shape[1]
    codes = np.full(256, 4)
    for i, b in enumerate(b"ACGT"):
        codes[[b, b + 32]] = i
    table = np.vstack([odds, np.full(size, -1e9)])
    flipped = np.vstack([odds[::-1, ::-1], np.full(size, -1e9)])

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for chrom, start, seq in zip(p.chrom, p.chunk_start, p.seq):
                c = codes[np.frombuffer(seq.encode(), np.uint8)]
                n = len(c) - size + 1
                if n <= 0:
                    continue
                for strand, t in (("+", table), ("-", flipped)):
                    score = sum(t[c[k : k + n], k] for k in range(size))
                    at = np.flatnonzero(score >= threshold)
                    if len(at):
                        yield pd.DataFrame({"chrom": chrom, "pos": at + start, "strand": strand, "score": score[at]})

    return chunked(df, CHUNK, size - 1).select("chrom", "chunk_start", "seq").mapInPandas(scan, "chrom string, pos long, strand string, score double")


def motif_pvalue(df: DataFrame, matrix: dict[str, list[float]], draws: int = 100_000, seed: int = 123, pseudo: float = 0.8, background: float = 0.25) -> DataFrame:
    """Adds pvalue to motif scores: the share of random sequences that score as high, from one seeded null distribution."""
    counts = np.array([matrix[b] for b in "ACGT"], float)
    odds = np.log2((counts + pseudo) / (counts.sum(axis=0) + 4 * pseudo) / background)
    pick = np.random.default_rng(seed).integers(0, 4, (draws, odds.shape[1]))
    null = np.sort(odds[pick, np.arange(odds.shape[1])].sum(axis=1))

    @F.pandas_udf("double")
    def tail(score: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(1.0, (1 + draws - np.searchsorted(null, score.to_numpy() - 1e-9)) / draws))

    return df.withColumn("pvalue", tail("score"))


def generate_reads(df: DataFrame, size: int, step: int, most_wildcards: int = 0, quality: str = "I") -> DataFrame:
    """Tiled reads with a constant quality, ``#`` for N."""
    rows = windows(df, size, step).where(count_of(F.col("seq"), "Nn") <= most_wildcards)
    name = F.concat_ws(":", "chrom", (F.col("pos") + 1).cast("string"))
    return rows.select(name.alias("name"), "seq", F.translate(F.regexp_replace("seq", "[^Nn]", quality), "Nn", "##").alias("qual"))


def mask(df: DataFrame, regions: DataFrame, lower: bool = False) -> DataFrame:
    """Sequences with the bases of regions (chrom, start, end) as N or in lower case; regions are merged first."""
    from .intervals import reduce_regions

    merged = reduce_regions(regions.select("chrom", "start", "end").withColumns({"name": F.lit(""), "score": F.lit(0.0)}), stranded=False)
    spans = merged.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = df.join(spans, df.name == spans.chrom, "left").drop("chrom")
    piece = lambda a, n: F.substring(F.col("seq"), (a + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))

    def part(s, i):
        before = F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(F.lit(0).cast("long"))
        hit = piece(s["start"], s["end"] - s["start"])
        return F.concat(piece(before, s["start"] - before), F.lower(hit) if lower else F.regexp_replace(hit, ".", "N"))

    tail = F.get("spans", F.size("spans") - 1)["end"]
    done = F.concat(F.array_join(F.transform("spans", part), ""), piece(tail, F.length("seq") - tail))
    return rows.withColumn("seq", F.when(F.col("spans").isNotNull(), done).otherwise(F.col("seq"))).drop("spans")


def random_sequences(spark, count: int, length: int, seed: int = 1) -> DataFrame:
    rows = spark.range(count).select(F.concat(F.lit("random"), F.col("id").cast("string")).alias("name"), (F.col("id") * 1_000_003 + seed).alias("s"))
    return rows.select("name", random_sequence(length, F.col("s")).alias("seq"))


def split(df: DataFrame, per_file: int = 1) -> DataFrame:
    """Adds part, the file a sequence goes to: one each, or ``per_file`` together by name order."""
    if per_file == 1:
        return df.withColumn("part", F.col("name"))
    rank = F.row_number().over(Window.orderBy("name")) - 1
    order = df.select("name").withColumn("part", F.floor(rank / per_file).cast("string"))  # names only
    return df.join(order, "name")


__all__ = [n for n in dir() if not n.startswith("_")] + ["AMBIGUITY"]
