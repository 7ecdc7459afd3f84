"""Alignment operators.

An alignment has name, flag, chrom, pos (0-based start), mapq, cigar, seq, qual, tags map<string,string>
and, for mates, mate_chrom, mate_pos and tlen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.columns import natural_key
from ..functions.sequences import ambiguous
from . import intervals

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))
#: Flags that counting and coverage leave out by default.
COUNT_FILTER, COVERAGE_FILTER = 3844, 1796
#: Positions of a bin of the pileup: a task holds the bases of one.
PILEUP_BIN = 128
#: Positions whose variants a read's block is compared with at once.
SITE_BIN = 64


def has(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) == bits


def lacks(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) == 0


def flags(df: DataFrame, drop: int = 0, need: int = 0) -> DataFrame:
    return df.where(lacks(drop) & has(need))


def tag(key: str) -> Column:
    """A tag as a number; MAPQ and TLEN (absolute) are columns."""
    if key == "MAPQ":
        return F.col("mapq")
    return F.abs("tlen") if key == "TLEN" else F.try_element_at("tags", F.lit(key)).try_cast("int")


def by_names(df: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    """Alignments whose name is among ``names`` (name), or the others."""
    return df.join(names.select("name").distinct(), "name", "left_semi" if keep else "left_anti").select(*df.columns)


def contigs(include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Alignments on the contigs to include (all, if none is named) and not on those to exclude."""
    name = F.coalesce("chrom", F.lit("*"))
    return (name.isin(*include) if include else F.lit(True)) & ~(name.isin(*exclude) if exclude else F.lit(False))


def sift(df: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Alignments that pass all tests, and the others with column failed, the first test they fail (a null test fails)."""
    fails = F.coalesce(*[F.when(~F.coalesce(v, F.lit(False)), k) for k, v in tests.items()], F.lit(None).cast("string"))
    rows = df.withColumn("failed", fails)
    return rows.where("failed is null").drop("failed"), rows.where("failed is not null")


def unique_mapping() -> Column:
    """NH is 1, else IH is 1, else the mapping quality is not 0."""
    return F.coalesce(tag("NH") == 1, tag("IH") == 1, F.col("mapq") != 0)


def tag_test(bounds: dict[str, int], op: str) -> Column:
    """Every tag present and ``min`` (at least), ``max`` (at most) or ``eq``."""
    out = F.lit(True)
    for k, v in bounds.items():
        t = tag(k)
        out &= F.coalesce({"min": t >= v, "max": t <= v, "eq": t == v}[op], F.lit(False))
    return out


def tag_text(key: str, value: str) -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit(key)) == value, F.lit(False))


def sane_pair() -> Column:
    """Both mates mapped to one contig on opposite strands."""
    return lacks(UNMAPPED | MATE_UNMAPPED) & (F.col("chrom") == F.col("mate_chrom")) & (has(REVERSE) != has(MATE_REVERSE))


def blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each operation of the CIGAR: ``columns``, chrom, k (its letter), start, end, read_start, n,
    and for what is behind an aligned base (with no gap of kind N between) prev (the letter ahead) and that base's place, base_pos and base_read."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    kinds = F.regexp_extract_all("cigar", F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    parts = F.zip_with(ops, kinds, lambda n, k: F.struct(n.cast("long").alias("n"), k.alias("k")))
    zero = F.struct(F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.lit("").alias("last"), F.lit(-1).cast("long").alias("on"), F.lit(-1).cast("long").alias("at"), F.array().cast("array<struct<ref:bigint,read:bigint,n:bigint,k:string,prev:string,on:bigint,at:bigint>>").alias("out"))

    def base(a: Column, p: Column, end: str, name: str) -> Column:
        return F.when(p["k"].isin("M", "=", "X"), a[end] + p["n"] - 1).when(p["k"].isin("I", "D"), a[name]).otherwise(-1).cast("long").alias(name)

    def step(a: Column, p: Column) -> Column:
        on_ref, on_read = p["k"].isin("M", "D", "N", "=", "X"), p["k"].isin("M", "I", "S", "=", "X")
        return F.struct(
            (a["ref"] + F.when(on_ref, p["n"]).otherwise(0)).alias("ref"), (a["read"] + F.when(on_read, p["n"]).otherwise(0)).alias("read"), p["k"].alias("last"),
            base(a, p, "ref", "on"), base(a, p, "read", "at"),
            F.concat(a["out"], F.array(F.struct(a["ref"].alias("ref"), a["read"].alias("read"), p["n"].alias("n"), p["k"].alias("k"), a["last"].alias("prev"), a["on"].alias("on"), a["at"].alias("at")))).alias("out"),
        )

    every = F.aggregate(parts, zero, step)["out"]
    return df.select(*columns, "chrom", "pos", F.explode(every).alias("b")).select(*columns, "chrom", "b.k", (F.col("pos") + F.col("b.ref")).alias("start"), (F.col("pos") + F.col("b.ref") + F.col("b.n")).alias("end"), F.col("b.read").alias("read_start"), "b.n", "b.prev", (F.col("pos") + F.col("b.on")).alias("base_pos"), F.col("b.at").alias("base_read"))


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    return blocks(df, columns).where(F.col("k").isin("M", "=", "X"))


def reference_length() -> Column:
    """Bases of the reference that the CIGAR covers."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(ops, F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))


def spans(df: DataFrame) -> DataFrame:
    """Adds start, end and strand of the whole alignment."""
    return df.withColumns({"start": F.col("pos"), "end": F.col("pos") + reference_length(), "strand": F.when(has(REVERSE), "-").otherwise("+")})


def effective_strand(orientation: str) -> Column:
    """Strand of the fragment: by library orientation ``FR`` (read 1 is sense), ``RF`` or unstranded (``*``)."""
    if orientation not in ("FR", "RF"):
        return F.lit("*")
    minus = has(REVERSE) != has(SECOND)
    return F.when(minus if orientation == "FR" else ~minus, "-").otherwise("+")


def in_regions(df: DataFrame, key: list[str], regions: DataFrame, keep: bool = True, within: bool = False, start_only: bool = False, stranded: bool = False) -> DataFrame:
    """Alignments with some aligned block in a region (or all of them, with ``within``, or the 5' start only), or the others."""
    rows = spans(df)
    if start_only:
        five = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))
        parts = rows.select(*key, "chrom", five.alias("start"), (five + 1).alias("end"), "strand")
    else:
        parts = aligned(rows.withColumn("__strand", F.col("strand")), [*key, "__strand"]).withColumnRenamed("__strand", "strand").select(*key, "chrom", "start", "end", "strand")
    if within:
        numbered = parts.withColumn("__part", F.xxhash64("chrom", "start", "end"))
        inside = intervals.range_join(regions, numbered, contained=True, stranded=stranded)
        hit = inside.select(*[F.col(f"r_{k}").alias(k) for k in key], F.col("r___part").alias("__part")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("a"))
        every = numbered.select(*key, "__part").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
        hits = hit.join(every, key).where("a = b").select(*key)
    else:
        hits = intervals.range_join(parts, regions, stranded=stranded).select(*key).distinct()
    return df.join(hits, key, "left_semi" if keep else "left_anti")


def junctions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spliced gaps (N) of alignments: ``columns``, chrom, start, end."""
    return blocks(df, columns).where("k = 'N'").select(*columns, "chrom", "start", "end")


def junctions_in(df: DataFrame, key: list[str], known: DataFrame) -> DataFrame:
    """Alignments all of whose junctions are in ``known`` (chrom, start, end)."""
    bad = junctions(df, key).join(known, ["chrom", "start", "end"], "left_anti").select(*key).distinct()
    return df.join(bad, key, "left_anti")


def unique_start(df: DataFrame, order: list[str]) -> DataFrame:
    """The first alignment (by ``order``) at each contig, strand and 5' position; unmapped ones go."""
    rows = spans(df.where(lacks(UNMAPPED)))
    five = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    best = rows.groupBy("chrom", "strand", five.alias("five")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def pair_filter(df: DataFrame, passes: Column, keep_any: bool = True) -> DataFrame:
    """All rows of a name if any passes, or only if all do."""
    agg = F.max if keep_any else F.min
    names = df.groupBy("name").agg(agg(passes.cast("int")).alias("ok")).where("ok = 1").select("name")
    return df.join(names, "name", "left_semi")


def duplicates(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds duplicate: of alignments with one contig, start and template length all but the best (mapping quality, then
    ``order``); mates follow by name."""
    rows = df.where(lacks(UNMAPPED | SECONDARY | SUPPLEMENTARY))
    site = ["chrom", "pos", "tlen", "mate_chrom", "mate_pos"]
    keyed = rows.withColumns({"mate_chrom": F.when(F.col("tlen") == 0, F.col("mate_chrom")), "mate_pos": F.when(F.col("tlen") == 0, F.col("mate_pos"))})
    best = keyed.groupBy(*site).agg(F.min(F.struct((-F.col("mapq")).alias("q"), *order)).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = keyed.join(best, [keyed[c].eqNullSafe(best[c]) for c in site])
    losers = marked.where(F.struct((-F.col("mapq")).alias("q"), *order) != F.col("best")).select("name").distinct().withColumn("duplicate", F.lit(True))
    return df.join(losers, "name", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def best_source(tables: list[DataFrame], key: list[str], tags: list[tuple[str, bool]], drop_ties: bool = False) -> DataFrame:
    """For each read of several alignments of the same reads the table with the best tags (name, greater is better): key, source.
    Ties go to the first table, or are dropped."""
    rows = None
    for i, t in enumerate(tables):
        score = [F.coalesce(tag(k) * (-1 if up else 1), F.lit(1 << 30)).alias(f"s{j}") for j, (k, up) in enumerate(tags)]
        part = t.where(lacks(UNMAPPED)).select(*key, F.struct(*score).alias("score"), F.lit(i).alias("source"))
        rows = part if rows is None else rows.union(part)
    best = rows.groupBy(*key, "score").agg(F.min("source").alias("source"), F.countDistinct("source").alias("n"))
    out = best.groupBy(*key).agg(F.min(F.struct("score", "source", "n")).alias("b"))
    return (out.where("b.n = 1") if drop_ties else out).select(*key, F.col("b.source").alias("source"))


def concordance(longest: int) -> Column:
    """``orphan``, ``discordant`` (other contig, one strand, or the end further than ``longest`` from the mate's start) or ``concordant``."""
    far = F.abs(F.col("pos") + reference_length() - F.col("mate_pos")) > longest
    apart = (F.col("chrom") != F.col("mate_chrom")) | (has(REVERSE) == has(MATE_REVERSE)) | far
    return F.when(has(UNMAPPED) | has(MATE_UNMAPPED), "orphan").when(apart, "discordant").otherwise("concordant")


def ref_counts(df: DataFrame) -> DataFrame:
    """First reads by contig, without duplicates, secondary and unmapped ones, in natural order."""
    rows = df.where(lacks(DUPLICATE | SECONDARY | UNMAPPED) & (has(FIRST) | lacks(PAIRED)))
    return rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("count")).orderBy(natural_key(F.col("chrom")))


def span_counts(df: DataFrame, groups: DataFrame, key: list[str], orientation: str = "unstranded", drop: int = COUNT_FILTER) -> DataFrame:
    """``groups`` rows (key, chrom, start, end, strand; several rows may share a key) with the distinct read names that
    overlap each key.  Pairs of regions and reads are made only for keys of several rows."""
    stranded = orientation in ("FR", "RF")
    rows = spans(df.where(lacks(drop))).withColumn("strand", effective_strand(orientation))
    rows = rows.where("name is not null").select("chrom", "start", "end", "strand", "name")
    one, more = _by_rows(groups, key)
    sums = intervals.first_sums(one, rows, "name", ["start", "end"], {"count": F.lit(1)}, stranded)
    pairs = intervals.range_join(more, rows, stranded=stranded)
    keys = [f"__k{i}" for i in range(len(key))]
    got = sums.select(*keys, "count").union(pairs.groupBy(*keys).agg(F.countDistinct("r_name").alias("count"))).toDF(*key, "count")
    return groups.select(*key).distinct().join(got, key, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def _by_rows(groups: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups whose key has one row, which is a region, and the rows of the others; the key's columns are __k0 and so on."""
    fields, keys = [c for c in ("chrom", "start", "end", "strand") if c in groups.columns], [f"__k{i}" for i in range(len(key))]
    lists = groups.groupBy(*[F.col(k).alias(n) for k, n in zip(key, keys)]).agg(F.collect_set(F.struct(*fields)).alias("__rows"))
    single = (F.size("__rows") == 1) & F.coalesce((F.col("__rows")[0]["start"] <= F.col("__rows")[0]["end"]) & F.col("__rows")[0]["chrom"].isNotNull(), F.lit(False))
    rows = lists.select(*keys, F.explode("__rows").alias("r"), single.alias("__one")).select(*keys, "r.*", "__one")
    return rows.where("__one").drop("__one"), rows.where("not __one").drop("__one")


def span_details(df: DataFrame, groups: DataFrame, key: list[str], orientation: str = "unstranded", drop: int = COUNT_FILTER, need: int = 0, unique: bool = False) -> DataFrame:
    """As ``span_counts``, with what the counted reads are: proper, not_proper, ratio (not_proper / proper, or 0), insert (mean
    absolute tlen of proper ones, or 0) and inverted (proper, mates on one strand).  Of a name's reads the first by position
    counts; with ``unique`` it does so only if it maps uniquely."""
    stranded = orientation in ("FR", "RF")
    rows = spans(flags(df, drop, need)).withColumn("strand", effective_strand(orientation))
    read = {"proper": has(PAIRED | PROPER), "not_proper": has(PAIRED) & lacks(PROPER), "inverted": has(PAIRED | PROPER) & (has(REVERSE) == has(MATE_REVERSE)), "size": F.abs("tlen").cast("long"), "fine": unique_mapping() if unique else F.lit(True)}
    rows = rows.select("chrom", "start", "end", "strand", "name", "flag", *[c.alias(k) for k, c in read.items()])
    # what is summed over a key's reads, from a read's columns
    fine, proper = F.col("fine").cast("int"), F.col("fine") & F.col("proper")
    parts = {"count": fine, "proper": proper.cast("int"), "not_proper": (F.col("fine") & F.col("not_proper")).cast("int"), "inverted": (F.col("fine") & F.col("inverted")).cast("int"), "total": F.when(proper, F.col("size")), "sizes": (proper & F.col("size").isNotNull()).cast("int")}
    order = ["start", "end", "flag", "size", "fine"]
    one, more = _by_rows(groups, key)
    sums = intervals.first_sums(one, rows, "name", order, parts, stranded)
    pairs = intervals.range_join(more, rows, stranded=stranded)
    first = F.min_by(F.struct(*[F.col(f"r_{k}").alias(k) for k in read]), F.struct(*[F.col(f"r_{k}") for k in order])).alias("r")
    keys = [f"__k{i}" for i in range(len(key))]
    firsts = pairs.groupBy(*keys, "r_name").agg(first).select(*keys, "r.*")
    several = firsts.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(k) for k, c in parts.items()])
    got = groups.select(*key).distinct().join(sums.select(*keys, *parts).union(several).toDF(*key, *parts), key, "left")
    got = got.withColumn("insert", F.when(F.col("sizes") > 0, F.col("total") / F.col("sizes")))
    got = got.select(*key, *[F.coalesce(k, F.lit(0)).alias(k) for k in ("count", "proper", "not_proper", "insert", "inverted")])
    return got.withColumn("ratio", F.when(F.col("proper") > 0, F.col("not_proper") / F.col("proper")).otherwise(0.0))


def depth(df: DataFrame, drop: int = COVERAGE_FILTER) -> DataFrame:
    """Run-length encoded depth of aligned bases."""
    return intervals.depth(aligned(df.where(lacks(drop)), []))


def coverage_quantiles(df: DataFrame, drop: int = COVERAGE_FILTER) -> DataFrame:
    """Quantiles of depth over covered positions, weighted by run length (no position is a row)."""
    runs = depth(df, drop).groupBy("depth").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    return runs.agg(*[F.percentile("depth", p / 100, F.col("n")).alias(f"q{p}") for p in (1, 5, 25, 50, 75, 95, 99)], F.min("depth").alias("min"), F.max("depth").alias("max"))


def expressed(df: DataFrame, least: int = 1, extend: int = 0, longer_than: int = 0, drop: int = COVERAGE_FILTER) -> DataFrame:
    """Regions of depth ``least`` or more, joined across gaps of up to ``extend``: chrom, start, end, peak."""
    runs = depth(df, drop).where(F.col("depth") >= least).withColumn("strand", F.lit("*"))
    grown = runs.withColumns({"from": F.col("start"), "to": F.col("end"), "end": F.col("end") + extend + 1})
    rows = intervals.islands(grown, ["chrom"]).groupBy("chrom", "island").agg(F.min("from").alias("start"), F.max("to").alias("end"), F.max("depth").alias("peak"))
    return rows.where(F.col("end") - F.col("start") > longer_than).drop("island")


def soft_clips(df: DataFrame, least: int = 1) -> DataFrame:
    """Soft-clipped ends by breakpoint: chrom, pos, count."""
    clips = blocks(df.where(lacks(UNMAPPED)), []).where((F.col("k") == "S") & (F.col("n") >= least))
    return clips.groupBy("chrom", F.col("start").alias("pos")).agg(F.count(F.lit(1)).alias("count"))


def protection(fragments: DataFrame, window: int = 120) -> DataFrame:
    """Windowed protection score by position: fragments that span the window around it less those that end in it, for positions
    some fragment covers or cuts.  Both are depths of shifted intervals, so nothing is joined by position."""
    half = window // 2
    rest = window - half
    spanning = fragments.select("chrom", (F.col("start") + half).alias("start"), (F.col("end") - rest + 1).alias("end")).where("end > start")
    # positions whose window [p - half, p + rest) has a fragment's first or last base inside
    cut = lambda c: fragments.select("chrom", F.greatest(c - rest + 1, F.lit(0)).alias("start"), (c + half + 1).alias("end"), "id")
    merged = cut(F.col("start")).union(cut(F.col("end") - 1))
    # a fragment with both ends inside counts once
    twice = fragments.where(F.col("end") - 1 - F.col("start") < window).select("chrom", F.greatest(F.col("end") - 1 - rest + 1, F.lit(0)).alias("start"), (F.col("start") + half + 1).alias("end")).where("end > start")
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    events = None
    for df, sign, kind in ((spanning, 1, "s"), (merged.drop("id"), 1, "e"), (twice, -1, "e")):
        part = df.select("chrom", ends.alias("x")).select("chrom", "x.pos", F.lit(kind).alias("kind"), (F.col("x.d") * sign).alias("d"))
        events = part if events is None else events.union(part)
    sums = events.groupBy("chrom", "pos").agg(F.sum(F.when(F.col("kind") == "s", F.col("d")).otherwise(0)).alias("ds"), F.sum(F.when(F.col("kind") == "e", F.col("d")).otherwise(0)).alias("de"))
    sums = sums.withColumn("__b", F.floor(F.col("pos") / intervals.BLOCK))
    from .blocks import following, running

    rows = running(sums, ["chrom"], "__b", ["pos"], F.col("ds"), "sum", "span")
    rows = running(rows, ["chrom"], "__b", ["pos"], F.col("de"), "sum", "cut")
    rows = following(rows, ["chrom"], "__b", "pos", "next").where("next is not null and span + cut > 0")
    return rows.select("chrom", F.col("pos").alias("start"), F.col("next").alias("end"), (F.col("span") - F.col("cut")).cast("long").alias("wps"))


def base_calls(df: DataFrame, least_quality: int = 0, drop: int = COVERAGE_FILTER) -> DataFrame:
    """Bases by position: chrom, pos, A, C, G, T, N, ins, del, plus, minus, depth."""
    rows = df.where(lacks(drop)).withColumn("__minus", has(REVERSE).cast("int"))
    parts = blocks(rows, ["seq", "qual", "__minus"])
    i = F.explode(F.expr("sequence(0L, n - 1)"))
    match = parts.where(F.col("k").isin("M", "=", "X")).withColumn("i", i)
    at = (F.col("read_start") + F.col("i") + 1).cast("int")
    match = match.select("chrom", (F.col("start") + F.col("i")).alias("pos"), F.substring(F.col("seq"), at, F.lit(1)).alias("call"), (F.ascii(F.substring(F.col("qual"), at, F.lit(1))) - 33).alias("q"), "__minus")
    match = match.where(F.col("q") >= least_quality).drop("q")
    gone = parts.where("k = 'D'").withColumn("i", i).select("chrom", (F.col("start") + F.col("i")).alias("pos"), F.lit("del").alias("call"), "__minus")
    more = parts.where("k = 'I'").select("chrom", (F.col("start") - 1).alias("pos"), F.lit("ins").alias("call"), "__minus")
    every = match.union(gone).union(more)
    counts = [F.count_if(F.col("call") == c).alias(c) for c in ("A", "C", "G", "T", "N", "ins", "del")]
    return every.groupBy("chrom", "pos").agg(*counts, F.count_if(F.col("call").isin(*"ACGTN") & (F.col("__minus") == 0)).alias("plus"), F.count_if(F.col("call").isin(*"ACGTN") & (F.col("__minus") == 1)).alias("minus"), F.count_if(F.col("call").isin(*"ACGTN")).alias("depth"))


def consensus_base(least_share: float = 0.2, least_depth: int = 1) -> Column:
    """IUPAC code of the bases whose share of A, C, G and T is at least ``least_share``; N below ``least_depth``."""
    total = sum(F.col(b) for b in "ACGT")
    strong = F.concat(*[F.when(F.col(b) >= least_share * total, b).otherwise("") for b in "ACGT"])
    import itertools

    table = [x for n in range(1, 5) for c in itertools.combinations("ACGT", n) for x in (F.lit("".join(c)), F.lit(ambiguous(set(c))))]
    return F.when(total >= least_depth, F.coalesce(F.try_element_at(F.create_map(*table), strong), F.lit("N"))).otherwise("N")


def allele_calls(df: DataFrame, least_quality: int = 0, drop: int = COVERAGE_FILTER, gaps: bool = False) -> DataFrame:
    """Alleles by position: chrom, pos, call, plus, minus, count.  A call is a base, ``+`` and the bases inserted behind the position, or
    ``-`` and the number of bases deleted behind it; a base that an insertion or deletion follows counts as that alone.
    The base's quality decides on both.  Insertions ahead of the first aligned base have no position and do not count.
    With ``gaps``, deleted positions have calls ``*``, whatever the qualities."""
    parts = blocks(df.where(lacks(drop)).withColumn("__minus", has(REVERSE)), ["seq", "qual", "__minus"])
    base = lambda c, i: F.substring(F.col(c), (i + 1).cast("int"), F.lit(1))
    i = F.col("read_start") + F.col("i")
    match = parts.where(F.col("k").isin("M", "=", "X")).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    match = match.select("chrom", (F.col("start") + F.col("i")).alias("pos"), base("seq", i).alias("call"), (F.ascii(base("qual", i)) - 33).alias("q"), "__minus", F.lit(1).alias("w"))
    # an indel is filed under the base ahead of it, whose own call is taken back
    ahead, on = F.col("base_read"), F.col("prev").isin("M", "=", "X")
    what = F.when(F.col("k") == "I", F.concat(F.lit("+"), F.substring(F.col("seq"), (F.col("read_start") + 1).cast("int"), F.col("n").cast("int")))).otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    indel = parts.where(F.col("k").isin("I", "D") & (F.col("base_read") >= 0))
    two = F.array(F.struct(what.alias("call"), F.lit(1).alias("w")), F.struct(base("seq", ahead).alias("call"), F.when(on, -1).otherwise(0).alias("w")))
    indel = indel.select("chrom", F.col("base_pos").alias("pos"), F.explode(two).alias("x"), (F.ascii(base("qual", ahead)) - 33).alias("q"), "__minus")
    every = match.unionByName(indel.select("chrom", "pos", "x.call", "q", "__minus", "x.w")).where(F.col("q") >= least_quality)
    if gaps:
        gone = parts.where("k = 'D'").withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
        every = every.unionByName(gone.select("chrom", (F.col("start") + F.col("i")).alias("pos"), F.lit("*").alias("call"), F.lit(0).alias("q"), "__minus", F.lit(1).alias("w")))
    minus = F.sum(F.when(F.col("__minus"), F.col("w")).otherwise(0))
    return every.groupBy("chrom", "pos", "call").agg((F.sum("w") - minus).alias("plus"), minus.alias("minus"), F.sum("w").alias("count")).where("count > 0")


def _tally(calls: DataFrame, name: str) -> DataFrame:
    """Alleles of a position in one array, the most frequent first, equal counts by call; as many as there are distinct ones."""
    each = F.struct((-F.col("count")).alias("order"), "call", "count", "plus", "minus")
    return calls.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(each)).alias(name))


def _total(tally: Column) -> Column:
    return F.aggregate(tally, F.lit(0).cast("long"), lambda a, x: a + x["count"])


def _called(somatic: bool, error: float):
    """What counts of a position are: ``hom`` or ``het``, ``present`` (somatic) or ``background``, whichever is likeliest; where two
    are equally likely but for rounding (a share of 1e-9), ``background``."""
    from ..functions.stats import genotype_pvalue

    above = lambda x, *others: all(x > o * (1 + 1e-9) for o in others)

    @F.pandas_udf("array<string>")
    def run(counts: pd.Series, total: pd.Series) -> pd.Series:
        seen: dict[tuple[int, int], str] = {}

        def kind(a: int, n: int) -> str:
            if (a, n) not in seen:
                noise = genotype_pvalue("background", a, n, error)
                if somatic:
                    seen[a, n] = "present" if above(genotype_pvalue("present", a, n), noise) else "background"
                else:
                    hom, het = genotype_pvalue("hom", a, n, error), genotype_pvalue("het", a, n)
                    seen[a, n] = "hom" if above(hom, het, noise) else "het" if above(het, hom, noise) else "background"
            return seen[a, n]

        return pd.Series([[kind(int(a), int(n)) for a in c] for c, n in zip(counts, total)], dtype="object")

    return run.asNondeterministic()  # else projections are merged and the call ends up in a lambda, where Spark cannot run it


def _codes() -> Column:
    """IUPAC code of a sorted set of bases."""
    import itertools

    return F.create_map(*[x for n in range(1, 5) for c in itertools.combinations("ACGT", n) for x in (F.lit("".join(c)), F.lit(ambiguous(set(c))))])


def consensus_chunks(calls: DataFrame, reference: DataFrame, least_depth: int = 1, least_share: float = 0.2, least_count: int = 1) -> DataFrame:
    """The chunks of a reference (chrom, chunk_start, seq) as the reads of :func:`allele_calls` (with gaps) have them: chrom, chunk_start, seq.

    An allele counts if at least ``least_share`` of the position's calls and ``least_count`` of them have it.  Positions of fewer than
    ``least_depth`` calls, or without such an allele, keep the reference in lower case.  One allele is written as it is: a base, the base
    and what is inserted behind it, nothing for a gap, the reference's base ahead of a deletion.  Several are written as the
    ambiguity code of the bases among them, as a sequence cannot hold indels beside bases; without a base among them the reference stays."""
    least = F.greatest(F.ceil(F.sum("count").over(Window.partitionBy("chrom", "pos")) * least_share), F.lit(least_count))
    at = calls.withColumn("fits", F.col("count") >= least).groupBy("chrom", "pos").agg(F.sum("count").alias("depth"), F.array_sort(F.collect_list(F.when(F.col("fits"), F.col("call")))).alias("alleles"))
    each = reference.select("chrom", "chunk_start", F.posexplode(F.split("seq", "(?!$)")).alias("i", "base")).withColumn("pos", F.col("chunk_start") + F.col("i"))
    rows = each.join(at, ["chrom", "pos"], "left")
    only, upper, lower = F.get("alleles", F.lit(0)), F.upper("base"), F.lower("base")
    one = F.when(only == "*", "").when(only.startswith("-"), upper).when(only.startswith("+"), F.concat(upper, F.substring(only, F.lit(2), F.length(only)))).otherwise(only)
    some = F.coalesce(F.try_element_at(_codes(), F.array_join(F.filter("alleles", lambda c: c.isin(*"ACGT")), "")), lower)
    called = F.when(F.coalesce("depth", F.lit(0)) < least_depth, lower).when(F.size("alleles") == 0, lower).when(F.size("alleles") == 1, one).otherwise(some)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce(called, lower).alias("s")))), lambda x: x["s"]), "")
    return rows.groupBy("chrom", "chunk_start").agg(text.alias("seq"))


def call_variants(
    first: DataFrame, reference: DataFrame, chunk: int, second: DataFrame | None = None, tumor_only: bool = False, error: float = 0.02, least_depth: int = 1, least_alt: int = 0,
    least_af: float = 0.0, least_normal_depth: int = 0, most_normal: int | None = None, most_normal_af: float | None = None, passing: bool = False,
) -> DataFrame:
    """Variants of :func:`allele_calls` against a chunked reference: chrom, pos (1-based), ref, alt (array), gt, filters (null: all passed),
    dp and ad (all samples), and for each sample depth, ad, af and sac (plus and minus counts of ref and alts).

    With ``second`` (a normal sample), alleles that it carries are not alts of ``first`` and calls are somatic: an allele present rather than
    noise; likewise with ``tumor_only``.  Else calls are hom, het or noise.  ``ref`` covers the longest deletion and all alts are written against it.
    Positions where the reference is not A, C, G or T, or without an alt, give no row."""
    somatic = tumor_only or second is not None
    rows = _tally(first, "t")
    none = F.array().cast("array<struct<order:bigint,call:string,count:bigint,plus:bigint,minus:bigint>>")
    rows = rows.join(_tally(second, "n"), ["chrom", "pos"], "left") if second is not None else rows.withColumn("n", none)
    rows = rows.withColumn("n", F.coalesce("n", none))
    gone = lambda c: F.coalesce(F.array_max(F.transform(F.filter(c, lambda x: x["call"].startswith("-")), lambda x: F.substring(x["call"], 2, 9).cast("long"))), F.lit(0))
    # the reference from the position to the end of its longest deletion, put together from the chunks it touches
    lo, hi = F.col("pos"), F.col("pos") + 1 + gone(F.col("t"))
    parts = rows.withColumn("chunk_start", F.explode(F.sequence(F.floor(lo / chunk), F.floor((hi - 1) / chunk)))).withColumn("chunk_start", F.col("chunk_start") * chunk)
    begin = F.greatest(lo - F.col("chunk_start"), F.lit(0))
    text = F.substring(F.col("seq"), (begin + 1).cast("int"), (F.least(hi - F.col("chunk_start"), F.lit(chunk)) - begin).cast("int"))
    parts = parts.join(reference, ["chrom", "chunk_start"]).groupBy("chrom", "pos").agg(
        F.first("t").alias("t"), F.first("n").alias("n"), F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", text.alias("s")))), lambda x: x["s"]), "")).alias("window"))
    counts = lambda c: F.transform(c, lambda x: x["count"])
    rows = parts.withColumn("base", F.substring("window", 1, 1)).where("base in ('A', 'C', 'G', 'T')")
    if second is not None:
        kinds = _called(False, error)(counts(F.col("n")), _total(F.col("n")))
        rows = rows.withColumn("kinds", kinds)
        known = F.filter(F.transform("n", lambda x, i: F.when(F.get("kinds", i) != "background", x["call"])), lambda x: x.isNotNull())
        rows = rows.withColumn("known", known)
    else:
        rows = rows.withColumn("known", F.array().cast("array<string>"))
    other = lambda x: (x["call"] != F.col("base")) & ~F.exists("known", lambda y: y == x["call"])
    rows = rows.withColumn("a", F.filter("t", other)).where(F.size("a") > 0)
    at = lambda c, call: F.coalesce(F.get(F.filter(c, lambda x: x["call"] == call), F.lit(0)), F.struct(F.lit(0).cast("long").alias("order"), call.alias("call"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus")))
    part = lambda s: lambda call: at(F.col(s), call)
    for s in ("t", "n"):
        rows = rows.withColumn(f"{s}_each", F.transform(F.concat(F.array("base"), F.transform("a", lambda x: x["call"])), part(s)))
    rows = rows.withColumn("depth", F.get("t_each", F.lit(0))["count"] + _total(F.col("a"))).withColumn("normal", _total(F.col("n_each")))
    rows = rows.withColumn("kinds", _called(somatic, error)(counts(F.col("a")), F.col("depth")))
    good = F.filter(F.transform("kinds", lambda k, i: F.when(k != "background", i + 1)), lambda i: i.isNotNull())
    hom = F.array_position("kinds", "hom")
    gt = F.when(hom > 0, F.concat_ws("/", hom.cast("string"), hom.cast("string"))).when(F.size("good") == 0, "0/0").when(F.size("good") == 1, F.concat(F.lit("0/"), F.col("good")[0].cast("string")))
    gt = gt.when(F.size("good") == 2, F.array_join(F.transform("good", lambda i: i.cast("string")), "/")).otherwise("./.")
    alt = F.get("a", F.lit(0))["count"]
    second_alt = F.get("n_each", F.lit(1))["count"]
    tests = {
        "low_pred_call_tumor" if somatic else "low_pred_call_germline": F.size("good") == 0, "multi_alleles": F.size(F.filter("t_each", lambda x: x["count"] > 0)) > 3,
        "multi_indel": F.size(F.filter("a", lambda x: x["call"].rlike("^[+-]"))) > 1, "min_depth": F.col("depth") < least_depth, "min_abs_count": alt < least_alt, "min_af": alt / F.col("depth") < least_af,
    }
    if second is not None and not tumor_only:
        tests["min_normal_depth"] = F.col("normal") < least_normal_depth
        tests["max_normal_abs_count"] = second_alt > most_normal if most_normal is not None else F.lit(False)
        tests["max_normal_af"] = F.try_divide(second_alt, F.col("normal")) > most_normal_af if most_normal_af is not None else F.lit(False)
    failed = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), k) for k, v in tests.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("good", good).withColumn("filters", failed).withColumn("ref", F.substring(F.col("window"), F.lit(1), (1 + gone(F.col("a"))).cast("int")))
    tail = F.substring(F.col("ref"), F.lit(2), F.length("ref"))

    def written(x: Column) -> Column:
        call, n = x["call"], F.substring(x["call"], 2, 9).try_cast("int")
        cut = F.concat(F.col("base"), F.substring(F.col("ref"), n + 2, F.length("ref")))
        return F.when(call.startswith("+"), F.concat(F.col("base"), F.substring(call, F.lit(2), F.length(call)), tail)).when(call.startswith("-"), cut).otherwise(F.concat(call, tail))

    def sample(s: str) -> list[Column]:
        every = _total(F.col(s))
        share = F.transform(F.slice(f"{s}_each", 2, 1 << 30), lambda x: F.coalesce(F.try_divide(x["count"], every), F.lit(0.0)))
        return [every.alias(f"{s}_depth"), counts(F.col(f"{s}_each")).alias(f"{s}_ad"), share.alias(f"{s}_af"), F.flatten(F.transform(f"{s}_each", lambda x: F.array(x["plus"], x["minus"]))).alias(f"{s}_sac")]

    rows = rows.where(F.size("filters") == 0) if passing else rows
    both = F.zip_with("t_each", "n_each", lambda x, y: x["count"] + y["count"])
    filters = F.when(F.size("filters") > 0, F.col("filters")).alias("filters")
    return rows.select("chrom", (F.col("pos") + 1).alias("pos"), "ref", F.transform("a", written).alias("alt"), gt.alias("gt"), filters, (F.col("depth") + F.col("normal")).alias("dp"), both.alias("ad"), *sample("t"), *(sample("n") if second is not None else []))


def count_alleles(calls: DataFrame, variants: DataFrame) -> DataFrame:
    """Reads of :func:`allele_calls` for variants (chrom, pos 1-based, ref, alt): ref_count, alt_count (0 where nothing covers them), depth and af
    (alt among all alleles there, null without any).  Deletions count by length, insertions by their bases.  Where the variants carry
    vcf_ref and vcf_alt, also vcf_af and pvalue: whether both samples have one share of alt (chi-squared with Yates's correction; 1 if
    neither has ref, or neither alt; null if one has no reads)."""
    from ..functions.stats import proportion_pvalue

    ref, alt = F.col("ref"), F.col("alt")
    added = F.when(alt.startswith(ref), F.substring(alt, F.length(ref) + 1, F.length(alt))).otherwise(alt)
    first = F.when(F.length(ref) > 1, alt).otherwise(ref)
    other = F.when(F.length(ref) > 1, F.concat(F.lit("-"), (F.length(ref) - 1).cast("string"))).when(F.length(alt) > 1, F.concat(F.lit("+"), added)).otherwise(alt)
    at = calls.groupBy("chrom", (F.col("pos") + 1).alias("pos")).agg(F.map_from_entries(F.collect_list(F.struct("call", "count"))).alias("__c"), F.sum("count").alias("depth"))
    of = lambda k: F.coalesce(F.try_element_at("__c", k), F.lit(0))
    rows = variants.join(at, ["chrom", "pos"], "left").withColumns({"ref_count": of(first), "alt_count": of(other), "depth": F.coalesce("depth", F.lit(0)), "af": F.try_divide(of(other), F.col("depth"))}).drop("__c")
    if "vcf_ref" not in variants.columns:
        return rows
    a, b, c, d = F.col("vcf_alt"), F.col("vcf_ref"), F.col("alt_count"), F.col("ref_count")
    same = ((b == 0) & (d == 0)) | ((a == 0) & (c == 0))
    pvalue = F.when(same, 1.0).when((a + b > 0) & (c + d > 0), proportion_pvalue(a, b, c, d))
    return rows.withColumns({"vcf_af": F.try_divide(a, a + b), "pvalue": pvalue})


def informative_reads(df: DataFrame, variants: DataFrame, key: list[str], names: bool = True) -> DataFrame:
    """Reads that cover each variant (key, chrom, pos 1-based, ref, alt), by allele: key, allele, count, names (sorted; left out without ``names``).

    Reads are looked at once for each position with variants, not for each variant: a name's bases there are a set (two masks of
    ASCII codes; 0 for a base that the sequence lacks or that is not ASCII), names are counted by set, and a variant takes the sets that
    hold its alleles.  Keys of several variants are counted from the names of their positions."""
    keys = [f"__k{i}" for i in range(len(key))]
    at = variants.select(*[F.col(k).alias(n) for k, n in zip(key, keys)], "chrom", (F.col("pos") - 1).alias("at"), "ref", "alt")
    sites = at.where("chrom is not null and at is not null").select("chrom", "at").distinct().groupBy("chrom", F.floor(F.col("at") / SITE_BIN).alias("bin")).agg(F.collect_list("at").alias("sites"))
    parts = aligned(df, ["name", "seq"]).where("n > 0").select("name", "seq", "chrom", "start", "end", "read_start")
    parts = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / SITE_BIN), F.floor((F.col("end") - 1) / SITE_BIN))))
    seen = parts.join(sites, ["chrom", "bin"]).withColumn("at", F.explode(F.filter("sites", lambda p: (p >= F.col("start")) & (p < F.col("end")))))
    base = lambda c: F.coalesce(F.when(F.ascii(c) < 128, F.ascii(c)), F.lit(0))
    code = base(F.substring("seq", (F.col("read_start") + F.col("at") - F.col("start") + 1).cast("int"), F.lit(1)))
    bit = lambda code, half: F.when(F.floor(code / 64) == half, F.call_function("shiftleft", F.lit(1).cast("long"), (code % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    halves = lambda code: [bit(code, h).alias(f"m{h}") for h in (0, 1)]
    seen = seen.select("chrom", "at", "name", *halves(code)).groupBy("chrom", "at", "name").agg(F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1"))
    # masks of the variant's alleles; longer alleles are no base's
    allele = lambda c, h: F.when((F.length(c) == 1) & (F.ascii(c) < 128), bit(base(F.col(c)), h)).otherwise(F.lit(0).cast("long"))
    wants = {"ref": [allele("ref", h) for h in (0, 1)]}
    wants["alt"] = [allele("alt", h).bitwiseAND(F.bitwise_not(wants["ref"][h])) for h in (0, 1)]
    wants["other"] = [F.bitwise_not(allele("ref", h).bitwiseOR(allele("alt", h))) for h in (0, 1)]
    masks = F.array(*[F.struct(F.lit(k).alias("allele"), a.alias("w0"), b.alias("w1")) for k, (a, b) in wants.items()])
    meets = lambda w, x: (w["w0"].bitwiseAND(x["m0"]) != 0) | (w["w1"].bitwiseAND(x["m1"]) != 0)
    at = at.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    one, more = at.where("__n = 1"), at.where("__n > 1")
    some = [F.collect_list("name").alias("names")] if names else []
    sets = seen.groupBy("chrom", "at", "m0", "m1").agg(F.count("name").alias("n"), *some)
    sets = sets.groupBy("chrom", "at").agg(F.collect_list(F.struct("m0", "m1", "n", *(["names"] if names else []))).alias("sets"))
    found = one.join(sets, ["chrom", "at"]).select(*keys, "sets", F.explode(masks).alias("w")).withColumn("sets", F.filter("sets", lambda x: meets(F.col("w"), x))).where("size(sets) > 0")
    out = [F.aggregate("sets", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("count")]
    out += [F.array_join(F.array_sort(F.flatten(F.transform("sets", lambda x: x["names"]))), ",").alias("names")] if names else []
    found = found.select(*keys, "w.allele", *out)
    rows = more.join(seen, ["chrom", "at"]).select(*keys, "name", "m0", "m1", F.explode(masks).alias("w")).where(meets(F.col("w"), {"m0": F.col("m0"), "m1": F.col("m1")}))
    some = [F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")] if names else []
    rows = rows.groupBy(*keys, "w.allele").agg(F.countDistinct("name").alias("count"), *some)
    return found.union(rows).toDF(*key, "allele", "count", *(["names"] if names else []))


def phase(df: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """Phase sets: heterozygous variants linked by reads that carry two of them.  Reads vote for cis or trans of each pair of
    neighbours on a read; (key, phase_set, side), the set's name being its smallest key (a whole number).  side is 0 if the alt lies on one
    haplotype with the alt of the set's smallest variant, 1 if with its ref, null in a set whose votes contradict each other.

    Components are those of a graph with two nodes for each variant, its alt and its ref: cis links like ends of two variants, trans unlike ones."""
    from .graph import components

    at = variants.select(key, "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "ref", "alt")
    pairs = intervals.range_join(at, aligned(df, ["name", "seq"]).select("name", "seq", "chrom", "start", "end", "read_start"))
    base = F.substring(F.col("r_seq"), (F.col("r_read_start") + F.col("start") - F.col("r_start") + 1).cast("int"), F.lit(1))
    seen = pairs.withColumn("allele", F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1)).where("allele is not null")
    seen = seen.select("r_name", key, "start", "allele").distinct()
    w = Window.partitionBy("r_name").orderBy("start", key)
    steps = seen.select(F.lag(key).over(w).alias("a"), F.col(key).alias("b"), (F.lag("allele").over(w) == F.col("allele")).alias("cis")).where("a is not null and a <> b")
    votes = steps.groupBy("a", "b").agg(F.count_if("cis").alias("cis"), F.count_if(~F.col("cis")).alias("trans")).where("cis <> trans")
    trans = F.when(F.col("cis") > F.col("trans"), 0).otherwise(1)
    ends = votes.select("a", "b", trans.alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    ends = ends.select((F.col("a") * 2 + F.col("s")).alias("a"), (F.col("b") * 2 + F.col("s").bitwiseXOR(F.col("t"))).alias("b"))
    nodes = components(ends).select(F.shiftright("node", 1).alias(key), F.col("node").bitwiseAND(1).alias("s"), "root")
    both = nodes.groupBy(key).agg(F.min(F.when(F.col("s") == 0, F.col("root"))).alias("alt"), F.min("root").alias("least"), F.max("root").alias("most"))
    side = F.when(F.col("least") != F.col("most"), F.col("alt").bitwiseAND(1)).cast("int")
    return both.select(key, F.shiftright("least", 1).alias("phase_set"), side.alias("side"))


def remove_clipping(df: DataFrame) -> DataFrame:
    """Cuts soft clips from seq and qual and S and H from the CIGAR; tags ZA, ZB (clipped at start, end) and ZC (share clipped)."""
    left = F.coalesce(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    right = F.coalesce(F.regexp_extract("cigar", r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))
    size = F.length("seq")
    more = F.create_map(F.lit("ZA"), left.cast("string"), F.lit("ZB"), right.cast("string"), F.lit("ZC"), F.round((left + right) / size, 4).cast("string"))
    clipped = left + right > 0
    return df.withColumns({
        "seq": F.substring(F.col("seq"), left + 1, size - left - right), "qual": F.substring(F.col("qual"), left + 1, size - left - right),
        "cigar": F.regexp_replace("cigar", r"\d+[SH]", ""), "tags": F.when(clipped, F.map_concat(F.col("tags"), more)).otherwise(F.col("tags")),
    })


def set_read_group(df: DataFrame, rg: str) -> DataFrame:
    return df.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, v: k != "RG"), F.create_map(F.lit("RG"), F.lit(rg))))


def concat(tables: list[DataFrame]) -> DataFrame:
    """Alignments of several tables; a read group id that two tables use gets ``_i`` in the later one."""
    seen: set[str] = set()
    out = None
    for i, t in enumerate(tables):
        rg = F.try_element_at("tags", F.lit("RG"))
        ids = {r[0] for r in t.select(rg.alias("rg")).where("rg is not null").distinct().collect()}  # header entries
        clash = [F.lit(x) for k in sorted(ids & seen) for x in (k, f"{k}_{i}")]
        if clash:
            new = F.coalesce(F.try_element_at(F.create_map(*clash), rg), rg)
            t = t.withColumn("tags", F.when(rg.isNotNull(), F.map_concat(F.map_filter("tags", lambda k, v: k != "RG"), F.create_map(F.lit("RG"), new))).otherwise(F.col("tags")))
        seen |= {c for k in ids for c in ((f"{k}_{i}" if k in seen else k),)}
        out = t if out is None else out.unionByName(t)
    return out


def clean(df: DataFrame) -> DataFrame:
    """Mapping quality 0 for unmapped alignments."""
    return df.withColumn("mapq", F.when(has(UNMAPPED), 0).otherwise(F.col("mapq")))


def check(df: DataFrame) -> DataFrame:
    """Counts of rows without a name, of seq and qual of different lengths, and of paired names without both mates."""
    mates = df.where(has(PAIRED) & lacks(SECONDARY | SUPPLEMENTARY)).groupBy("name").agg(F.max(has(FIRST).cast("int")).alias("a"), F.max(has(SECOND).cast("int")).alias("b"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col("name"), F.lit("")) == "").alias("unnamed"), F.count_if(F.length("seq") != F.length("qual")).alias("lengths"))
    return rows.join(F.broadcast(mates.agg(F.count_if(F.col("a") + F.col("b") < 2).alias("single"))))


def sample_names(df: DataFrame, n: int, lists: int = 1, seed: int = 1) -> DataFrame:
    """``lists`` samples of ``n`` distinct names (all, if there are fewer), those of the least digest of seed and name."""
    names = df.select("name").distinct()
    out = None
    for k in range(lists):
        part = names.orderBy(F.md5(F.concat(F.lit(f"{seed + k}:"), "name")), "name").limit(n).select(F.lit(k).alias("list"), "name")
        out = part if out is None else out.union(part)
    return out


def split(df: DataFrame, by: str = "chrom", size: int | None = None, order: list[str] = ()) -> DataFrame:
    """Adds part: the contig, or chunks of about ``size`` that never split one start position (counted by position first)."""
    if size is None:
        return df.withColumn("part", F.col(by))
    at = df.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).withColumn("__b", F.floor(F.col("pos") / intervals.BLOCK))
    from .blocks import running

    ahead = running(at, ["chrom"], "__b", ["pos"], F.col("n"), "sum", "ahead", inclusive=False)
    part = F.concat_ws(".", "chrom", F.floor(F.coalesce("ahead", F.lit(0)) / size).cast("string"))
    return df.join(ahead.select("chrom", "pos", part.alias("part")), ["chrom", "pos"])


def stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(lacks(UNMAPPED)).alias("mapped"), F.count_if(has(DUPLICATE)).alias("duplicates"), F.count_if(has(SECONDARY)).alias("secondary"),
        F.count_if(has(PROPER)).alias("proper"), F.percentile(F.when(has(FIRST) & has(PROPER), F.abs("tlen")), 0.5).alias("insert_median"),
    )


def _summarised(unique: bool = False) -> Column:
    """Reads that tallies are about: mapped, not second of a pair, no duplicate, failed or supplementary one."""
    fine = lacks(UNMAPPED | DUPLICATE | FAILED | SUPPLEMENTARY) & ~(has(PAIRED) & has(SECOND))
    return fine & unique_mapping() if unique else fine


def read_stats(df: DataFrame, unique: bool = False) -> DataFrame:
    """One row about reads, seconds of pairs left out: total, mapped, unmapped, multiple (not uniquely mapped) and the median
    insert size of proper pairs on one contig; about all mapped bases but those of duplicates: total_bases, q30_bases and
    gapped (reads with an N in the CIGAR).  ``unique`` leaves reads that do not map uniquely out of the bases and sizes."""
    first, kept = ~(has(PAIRED) & has(SECOND)), lacks(DUPLICATE | FAILED | SUPPLEMENTARY)
    measured = lacks(DUPLICATE | UNMAPPED) & (unique_mapping() if unique else F.lit(True))
    bases = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[M=XI]"), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    left = F.coalesce(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    right = F.coalesce(F.regexp_extract("cigar", r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))
    qual = F.when(F.col("qual") != "*", F.substring(F.col("qual"), left + 1, F.length("qual") - left - right))
    sized = _summarised(unique) & has(PAIRED | PROPER) & (F.col("chrom") == F.col("mate_chrom"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return df.agg(
        F.count_if(first).alias("total"), F.count_if(first & kept & lacks(UNMAPPED)).alias("mapped"), F.count_if(first & kept & has(UNMAPPED)).alias("unmapped"),
        F.count_if(first & kept & lacks(UNMAPPED) & ~unique_mapping()).alias("multiple"), zero(F.sum(F.when(measured, bases))).alias("total_bases"),
        zero(F.sum(F.when(measured, F.regexp_count(qual, F.lit("[?-~]"))))).alias("q30_bases"), F.count_if(measured & F.col("cigar").contains("N")).alias("gapped"),
        F.percentile(F.when(sized, F.abs("tlen")), 0.5).alias("insert_median"),
    )


def flag_tally(df: DataFrame) -> DataFrame:
    """(flag, count) of the flag bits that occur, over all reads but seconds of pairs; one pass, twelve sums."""
    bits = [1 << i for i in range(12)]
    sums = df.where(~(has(PAIRED) & has(SECOND))).agg(*[F.count_if(has(b)).alias(f"f{b}") for b in bits])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("flag"), F.col(f"f{b}").alias("count")) for b in bits])).alias("r")
    return sums.select(rows).select("r.flag", "r.count").where("count > 0")


def tag_tally(df: DataFrame, tags: list[str], unique: bool = False) -> DataFrame:
    """(tag, value, count) over the reads that tallies are about; value is null where a read lacks the tag.  MAPQ is the column,
    CHROM the contig."""
    column = {"MAPQ": F.col("mapq").cast("string"), "CHROM": F.col("chrom")}
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), column.get(t, F.try_element_at("tags", F.lit(t))).alias("value")) for t in tags])).alias("r")
    return df.where(_summarised(unique)).select(rows).groupBy("r.tag", "r.value").agg(F.count(F.lit(1)).alias("count"))


def on_target(df: DataFrame, key: list[str], regions: DataFrame) -> DataFrame:
    """Alignments on and off the regions."""
    hits = in_regions(df, key, regions).agg(F.count(F.lit(1)).alias("on_target"))
    return hits.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).select("on_target", (F.col("total") - F.col("on_target")).alias("off_target"))


def to_bed(df: DataFrame, one_based: bool = False) -> DataFrame:
    """BED6 of first reads."""
    rows = spans(df.where(lacks(UNMAPPED) & (has(FIRST) | lacks(PAIRED))))
    return rows.select("chrom", (F.col("start") + int(one_based)).alias("start"), "end", "name", F.col("mapq").alias("score"), "strand")


def to_bedpe(df: DataFrame) -> DataFrame:
    """First reads joined with their mates."""
    rows = spans(df.where(lacks(UNMAPPED | SECONDARY | SUPPLEMENTARY)))
    one = rows.where(has(FIRST)).select("name", F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("strand").alias("strand1"), F.col("mapq").alias("score"))
    two = rows.where(has(SECOND)).select("name", F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("strand").alias("strand2"))
    return one.join(two, "name").select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "name", "score", "strand1", "strand2")


def extract(df: DataFrame, key: list[str], regions: DataFrame, mates: bool = False, **options) -> DataFrame:
    """Alignments in regions, with all rows of their names if ``mates``."""
    hits = in_regions(df, key, regions, **options)
    return df.join(hits.select("name").distinct(), "name", "left_semi") if mates else hits


def sort_alignments(df: DataFrame, by_name: bool = False) -> DataFrame:
    return df.orderBy("name", "flag") if by_name else df.orderBy(F.col("chrom") == "*", natural_key(F.col("chrom")), "pos", "name", "flag")


def pileup(df: DataFrame, drop: int = COVERAGE_FILTER) -> DataFrame:
    """Text pileup: chrom, pos (0-based), depth and the bases in name order, lower case on the reverse strand.

    Aligned blocks are cut at bins of positions and sorted by name within a bin; a task turns one bin at a time into lines, so it holds
    the bases of one bin and no names of others.  A base that the sequence lacks counts in depth only."""
    parts = aligned(df.where(lacks(drop)).withColumn("__minus", has(REVERSE)), ["name", "seq", "__minus"]).where("n > 0")
    bins = F.sequence(F.floor(F.col("start") / PILEUP_BIN), F.floor((F.col("end") - 1) / PILEUP_BIN))
    parts = parts.withColumn("bin", F.explode(bins)).withColumn("from", F.greatest("start", F.col("bin") * PILEUP_BIN))
    size = (F.least("end", (F.col("bin") + 1) * PILEUP_BIN) - F.col("from")).cast("int")
    bases = F.coalesce(F.substring("seq", (F.col("read_start") + F.col("from") - F.col("start") + 1).cast("int"), size), F.lit(""))
    bases = F.rpad(F.when(F.col("__minus"), F.lower(bases)).otherwise(bases), size, "\0")
    parts = parts.select("chrom", "bin", "name", (F.col("from") - F.col("bin") * PILEUP_BIN).cast("int").alias("at"), size.alias("n"), bases.alias("bases"))
    parts = parts.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "name")
    return parts.mapInArrow(_pileup_lines, "chrom string, pos long, depth long, bases string")


def _pileup_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a pileup from pieces (chrom, bin, name, at, n, bases) sorted by the first three; a bin may span batches."""
    held, key = [], None
    for b in batches:
        chroms, bins = b["chrom"].to_pylist(), b["bin"].to_numpy()
        cuts = [0, *(i for i in range(1, len(bins)) if bins[i] != bins[i - 1] or chroms[i] != chroms[i - 1]), len(bins)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and (chroms[lo], bins[lo]) != key:
                yield _pileup_bin(*key, held)
                held = []
            key = chroms[lo], bins[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield _pileup_bin(*key, held)


def _pileup_bin(chrom: str | None, bin_: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    rank = t["name"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, at = t["n"].to_numpy().astype(np.int64), t["at"].to_numpy().astype(np.int64)
    call = np.frombuffer("".join(t["bases"].to_pylist()).encode("utf-32-le"), "<u4")
    pos = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(call))
    order = np.lexsort((call, np.repeat(rank, n), pos))
    call, depth = call[order], np.bincount(pos, minlength=PILEUP_BIN)
    ends = np.cumsum(depth)
    lines = [call[e - d : e].tobytes().decode("utf-32-le").replace("\0", "") for e, d in zip(ends, depth) if d]
    on = np.flatnonzero(depth)
    return pa.RecordBatch.from_arrays([pa.array([chrom] * len(on), pa.string()), pa.array(on + int(bin_) * PILEUP_BIN, pa.int64()), pa.array(depth[on], pa.int64()), pa.array(lines, pa.string())], ["chrom", "pos", "depth", "bases"])
