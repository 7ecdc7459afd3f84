"""Interval algebra: joins, nearest, merging, depth and formats of 0-based half-open intervals.

Inputs have columns chrom, start, end and, where used, strand (``+``, ``-`` or ``*``),
name and score.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.columns import natural_key, strands_match
from .blocks import following, running

#: Length of a bin of the range join: a few typical intervals; an interval of many bins is filed under each.
BIN = 10_000
#: Length of a block of sweeps and islands.
BLOCK = 1_000_000


def overlaps(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    """Whether [b, b_end) overlaps [a, a_end), empty intervals included as their start lies inside."""
    return ((a <= b) & (b < a_end)) | ((a < b_end) & (b_end <= a_end)) | ((b <= a) & (a_end <= b_end))


def range_join(left: DataFrame, right: DataFrame, within: int = 0, stranded: bool = False, contained: bool = False, bin_size: int = BIN, deal: int | None = None) -> DataFrame:
    """All pairs on one chrom whose intervals overlap (or lie within ``within`` positions of each other);
    with ``contained``, the right one lies inside the left.  Right columns get the prefix ``r_``.

    Both sides are filed under the bins they touch and joined on (chrom, bin); a pair is kept in the
    first bin that both touch, so nothing is emitted twice and nothing needs a distinct.

    ``deal`` is for bins that one task cannot hold (a locus of great depth): left rows are counted by bin first, those of a bin of more than
    ``deal`` rows are dealt by their hash to parts of about that many, and the right rows of such a bin go to each of its parts.
    Equal left rows stay together.  Pairs are the same; the left side is read twice."""
    a = left.withColumn("__lo", F.col("start") - within).withColumn("__hi", F.greatest(F.col("end") + within, F.col("start") - within + 1))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("__rhi", F.greatest(F.col("r_end"), F.col("r_start") + 1))
    floor = lambda c: F.floor(c / bin_size)
    # abutting intervals count within a distance, so the bins reach one position further
    a = a.withColumn("__bin", F.explode(F.sequence(floor(F.col("__lo") - int(within > 0)), floor(F.col("__hi") - int(within == 0)))))
    b = b.withColumn("__rbin", F.explode(F.sequence(floor(F.col("r_start")), floor(F.col("__rhi") - int(within == 0)))))
    first = F.greatest(floor(F.col("__lo") - int(within > 0)), floor(F.col("r_start")))
    if deal is not None:
        counts = a.groupBy("chrom", "__bin").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > deal)
        counts = counts.select("chrom", "__bin", F.ceil(F.col("__n") / deal).alias("__parts"))
        part = F.coalesce(F.pmod(F.xxhash64(*[c for c in left.columns]), F.col("__parts")), F.lit(0))
        a = a.join(counts, ["chrom", "__bin"], "left").withColumn("__part", part).select(*a.columns, "__part")
        right_parts = counts.select(F.col("chrom").alias("r_chrom"), F.col("__bin").alias("__rbin"), F.col("__parts"))
        every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__parts"), F.lit(1)) - 1)
        b = b.join(right_parts, ["r_chrom", "__rbin"], "left").withColumn("__rpart", F.explode(every)).select(*b.columns, "__rpart")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("__bin") == F.col("__rbin")) & (F.col("__bin") == first)
    if deal is not None:
        on &= F.col("__part") == F.col("__rpart")
    if contained:
        on &= (F.col("start") <= F.col("r_start")) & (F.col("r_end") <= F.col("end"))
    elif within:
        on &= (F.col("r_start") <= F.col("__hi")) & (F.col("r_end") >= F.col("__lo"))
    else:
        on &= overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    if stranded:
        on &= strands_match(F.col("strand"), F.col("r_strand"))
    return a.join(b, on).drop("__lo", "__hi", "__rhi", "__bin", "__rbin", "__part", "__rpart")


def row_key(df: DataFrame) -> dict[str, Column]:
    """Columns __id and __id2: 128 bits that stand for a row's values."""
    return {"__id": F.xxhash64(*df.columns), "__id2": F.xxhash64(F.lit(7), *df.columns)}


def semi(left: DataFrame, right: DataFrame, keep: bool = True, **options) -> DataFrame:
    """Rows of ``left`` that overlap some row of ``right`` (or none, without ``keep``): an existence join on bins."""
    marked = left.withColumns(row_key(left))  # equal rows have equal answers
    hits = range_join(marked, right.select(*[c for c in ("chrom", "start", "end", "strand") if c in right.columns]), **options).select("__id", "__id2").distinct()
    return marked.join(hits, ["__id", "__id2"], "left_semi" if keep else "left_anti").drop("__id", "__id2")


def count_overlaps(refs: DataFrame, queries: DataFrame, key: list[str], stranded: bool = True, **options) -> DataFrame:
    """``refs`` with count: the rows of ``queries`` that overlap each; ``key`` identifies a ref."""
    pairs = range_join(queries, refs, stranded=stranded, **options).groupBy(*[F.col(f"r_{k}").alias(k) for k in key]).agg(F.count(F.lit(1)).alias("__n"))
    return refs.join(pairs, key, "left").withColumn("count", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")


def first_sums(regions: DataFrame, rows: DataFrame, name: str, order: list[str], values: dict[str, Column], stranded: bool = False, block: int = BLOCK) -> DataFrame:
    """``regions`` (chrom, start, end not before it and, if ``stranded``, strand) with sums of whole-number ``values`` over the names that overlap each:
    a name gives the values of the first of its overlapping rows.  ``order`` begins with start and end.

    No pairs are made.  With M the furthest end of a name's rows ahead of a row, the row is a region's first if and only if
    M <= region start < end and start < region end.  Where M < start, these are the rows with start < region end, less those with
    end <= region start, less those whose gap from M to start lies inside the region; otherwise they are the rows with M <= region start
    less those with end <= region start.  The first three are running sums; gaps inside regions go by ``_inside``.
    Positions are doubled, so that an empty interval reaches one to both sides (see ``overlaps``)."""
    names = list(values)
    lo = F.when(F.col("start") == F.col("end"), 2 * F.col("start") - 1).otherwise(2 * F.col("start"))
    hi = F.when(F.col("start") == F.col("end"), 2 * F.col("end") + 1).otherwise(2 * F.col("end"))
    strand = lambda df: F.coalesce("strand", F.lit("*")) if stranded and "strand" in df.columns else F.lit("*")
    places = ["chrom", "side"]
    at = regions.withColumns({"side": strand(regions), "__lo": lo, "__hi": hi})
    # a row counts on its own side and on *, a row of * on all
    sides = F.array_distinct(F.array(F.lit("*"), strand(rows))) if stranded else F.array(F.lit("*"))
    sides = F.when(strand(rows) == "*", F.array(F.lit("*"), F.lit("+"), F.lit("-"))).otherwise(sides) if stranded else sides
    read = rows.where("chrom is not null and start <= end").select("chrom", F.explode(sides).alias("side"), F.col(name).alias("__name"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], lo.alias("lo"), hi.alias("hi"), *[F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(k) for k, v in values.items()])
    # ends of empty rows reach further than their order by start and end tells, so rows go by the doubled start first
    ahead = Window.partitionBy(*places, "__name").orderBy("lo", *[f"__o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumn("m", F.max("hi").over(ahead)).where("m is null or m < hi").where(" or ".join(f"`{k}` <> 0" for k in names))
    near = F.col("m") >= F.col("lo")
    event = lambda kind, pos, sign: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), F.lit(sign).alias("sign"))
    # starts count for regions that end behind them, the others for regions that start there or behind
    events = F.array(F.when(near, event("s", F.col("m"), 1)).otherwise(event("e", F.col("lo") + 1, 1)), event("s", F.col("hi"), -1))
    moves = read.select(*places, F.explode(events).alias("e"), *names).groupBy(*places, "e.kind", "e.pos").agg(*[F.sum(F.col(k) * F.col("e.sign")).alias(k) for k in names])
    spots = F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("__lo").alias("pos")), F.struct(F.lit("e").alias("kind"), F.col("__hi").alias("pos"))))
    asked = at.select(*places, spots.alias("e")).select(*places, "e.kind", "e.pos").distinct()
    asked = asked.select("*", *[F.lit(0).cast("long").alias(k) for k in names], F.lit(True).alias("ask"))
    every = _running_sums(moves.withColumn("ask", F.lit(False)).unionByName(asked), [*places, "kind"], "pos", names, block).where("ask")
    told = {k: every.where(F.col("kind") == k).select(*places, F.col("pos").alias(c), F.struct(*names).alias(f"__{k}")) for k, c in (("s", "__lo"), ("e", "__hi"))}
    distinct = at.select(*places, "__lo", "__hi").distinct()
    gaps = read.where(~near).select(*places, F.col("m").alias("lo"), F.col("lo").alias("hi"), *names)
    inside = _inside(distinct, gaps, places, names, block).select(*places, "__lo", "__hi", F.struct(*names).alias("__i"))
    got = distinct.join(told["s"], [*places, "__lo"]).join(told["e"], [*places, "__hi"]).join(inside, [*places, "__lo", "__hi"], "left")
    got = got.select(*places, "__lo", "__hi", *[(F.col(f"__s.{k}") + F.col(f"__e.{k}") - F.coalesce(F.col(f"__i.{k}"), F.lit(0))).alias(k) for k in names])
    return at.join(got, [*places, "__lo", "__hi"]).select(*regions.columns, *names)


def _running_sums(df: DataFrame, keys: list[str], pos: str, names: list[str], block: int) -> DataFrame:
    """``df`` with its ``names`` summed up to and with each position."""
    rows = df.withColumn("__b", F.floor(F.col(pos) / block))
    totals = rows.groupBy(*keys, "__b").agg(*[F.sum(k).alias(k) for k in names])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "__b", F.struct(*[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in names]).alias("__base"))
    within = Window.partitionBy(*keys, "__b").orderBy(pos).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.struct(*[F.sum(k).over(within).alias(k) for k in names])).join(base, [*keys, "__b"])
    return rows.withColumns({k: F.col(f"__base.{k}") + F.col(f"__in.{k}") for k in names}).drop("__b", "__base", "__in")


def _inside(regions: DataFrame, gaps: DataFrame, places: list[str], names: list[str], block: int) -> DataFrame:
    """Distinct ``regions`` (places, __lo, __hi) with sums over the gaps (lo, hi) with __lo < lo and hi < __hi; those without gaps are left out.

    A region's positions are cut into nodes, ranges of a power of two that begin at a multiple of it, at most two of each size.  A gap
    is filed under the node of each size that holds its lo, up to the size of the longest region.  Within a node only hi decides: a running sum."""
    longest = regions.agg(F.max(F.col("__hi") - F.col("__lo")).alias("__longest"))
    gaps = gaps.crossJoin(F.broadcast(longest)).where(F.col("hi") - F.col("lo") < F.col("__longest"))
    gaps = gaps.groupBy(*places, "lo", "hi", "__longest").agg(*[F.sum(k).alias(k) for k in names])
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.col("__longest"), F.lit(1)))).cast("int"))
    filed = gaps.select(*places, "lo", F.col("hi").alias("pos"), *names, F.explode(levels).alias("level")).withColumn("node", F.expr("shiftright(lo, level)"))
    moves = filed.groupBy(*places, "level", "node", "pos").agg(*[F.sum(k).alias(k) for k in names]).withColumn("ask", F.lit(False))
    # nodes of [a, b): at each level the first if a is odd there, the last if b is
    a, b = F.col("__lo") + 1, F.col("__hi")
    zero = F.struct(a.alias("a"), b.alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def step(x: Column, level: Column) -> Column:
        live = x["a"] < x["b"]
        odd, last = live & (F.pmod(x["a"], F.lit(2)) == 1), live & (F.pmod(x["b"], F.lit(2)) == 1)
        node = lambda on, n: F.when(on, F.array(F.struct(level.cast("int").alias("level"), n.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        up, down = F.when(odd, x["a"] + 1).otherwise(x["a"]), F.when(last, x["b"] - 1).otherwise(x["b"])
        return F.struct(F.shiftright(up, 1).alias("a"), F.shiftright(down, 1).alias("b"), F.concat(x["out"], node(odd, x["a"]), node(last, x["b"] - 1)).alias("out"))

    nodes = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(b - a, F.lit(1)) + 1)).cast("int") + 1), zero, step)["out"]
    parts = regions.where(a < b).select(*places, "__lo", "__hi", F.explode(nodes).alias("n")).select(*places, "__lo", "__hi", "n.level", "n.node")
    parts = parts.join(moves.select(*places, "level", "node").distinct(), [*places, "level", "node"], "left_semi")
    asked = parts.select(*places, "level", "node", (F.col("__hi") - 1).alias("pos")).distinct().select("*", *[F.lit(0).cast("long").alias(k) for k in names], F.lit(True).alias("ask"))
    told = _running_sums(moves.unionByName(asked), [*places, "level", "node"], "pos", names, block).where("ask").drop("ask")
    found = parts.withColumn("pos", F.col("__hi") - 1).join(told, [*places, "level", "node", "pos"])
    return found.groupBy(*places, "__lo", "__hi").agg(*[F.sum(k).alias(k) for k in names])


def distance(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    """Signed distance from [a, a_end) to [b, b_end): 0 if they touch, negative if b lies before a."""
    return F.when(a > b_end, b_end - a).when(a_end < b, b - a_end).otherwise(F.lit(0))


def nearest(queries: DataFrame, refs: DataFrame, key: list[str], up: int = 0, down: int = 0, stranded: bool = True) -> DataFrame:
    """``queries`` with the nearest refs' names (sorted, joined by comma; ``*`` if none), the distance (positive
    downstream of the ref) and the ref's strand.  Upstream and downstream are those of the ref.
    Candidates are aggregated by minimum, so no window holds them."""
    pairs = range_join(queries, refs, within=max(up, down), stranded=stranded)
    signed = distance(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end"))
    minus = F.coalesce(F.col("r_strand"), F.lit("*")) == "-"
    signed = F.when(minus, -signed).otherwise(signed)
    pairs = pairs.withColumn("__d", signed).where((F.col("__d") >= -up) & (F.col("__d") <= down))
    if not max(up, down):
        pairs = pairs.where("__d = 0")
    by_distance = pairs.groupBy(*key, F.abs("__d").alias("__abs")).agg(
        F.array_join(F.array_sort(F.collect_set("r_name")), ",").alias("names"),
        F.min(F.struct("r_start", "r_end", "r_name", "__d", F.when(minus, "-").otherwise("+").alias("s"))).alias("__one"),
    )
    best = by_distance.groupBy(*key).agg(F.min_by(F.struct("names", "__one"), "__abs").alias("__best"))
    out = queries.join(best, key, "left")
    return out.select(
        *queries.columns, F.coalesce("__best.names", F.lit("*")).alias("nearest"),
        F.col("__best.__one.__d").cast("long").alias("distance"), F.col("__best.__one.s").alias("ref_strand"),
    )


def islands(df: DataFrame, keys: list[str], extend: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds island: the number of the run of overlapping intervals (extended by ``extend`` on both sides)
    within ``keys``.  Touching intervals are not merged.  Running maxima go by blocks."""
    rows = df.withColumn("__s", F.col("start") - extend).withColumn("__e", F.col("end") + extend).withColumn("__b", F.floor(F.col("__s") / block))
    order = ["__s", "__e"]
    rows = running(rows, keys, "__b", order, F.col("__e"), "max", "__reach", inclusive=False)
    rows = rows.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("__s") >= F.col("__reach")), 1).otherwise(0))
    rows = running(rows, keys, "__b", [*order, "__reach"], F.col("__new"), "sum", "island")
    return rows.drop("__s", "__e", "__b", "__reach", "__new")


def reduce_regions(df: DataFrame, extend: int = 0, stranded: bool = True, count_score: bool = False) -> DataFrame:
    """Unions of overlapping regions: chrom, start, end, name (sorted set joined by ``|``), score (sum, or the number
    of regions) and strand (``*`` without ``stranded``)."""
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    rows = islands(df if stranded else df.withColumn("strand", F.lit("*")), keys, extend)
    score = F.count(F.lit(1)).cast("double") if count_score else F.sum("score")
    return rows.groupBy("chrom", "strand", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("name"), score.alias("score"),
    ).select("chrom", "start", "end", "name", "score", "strand")


def resize(df: DataFrame, five: int = 0, three: int = 0, longest: int | None = None) -> DataFrame:
    """Extends (or shrinks) the 5' and 3' ends by strand, start at 0 at least; regions of ``longest`` or more stay."""
    minus = F.col("strand") == "-"
    start = F.greatest(F.lit(0), F.col("start") - F.when(minus, three).otherwise(five))
    end = F.col("end") + F.when(minus, five).otherwise(three)
    stays = F.lit(False) if longest is None else F.col("end") - F.col("start") >= longest
    return df.withColumns({"start": F.when(stays, F.col("start")).otherwise(start), "end": F.when(stays, F.col("end")).otherwise(end)})


def clean_score(df: DataFrame) -> DataFrame:
    """Score cut to an integer, toward zero."""
    return df.withColumn("score", F.col("score").cast("int"))


def to_bed3(df: DataFrame) -> DataFrame:
    return df.select("chrom", "start", "end")


def to_bed6(df: DataFrame) -> DataFrame:
    """Six columns; a missing strand is printed as ``+``."""
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("+")
    return df.select("chrom", "start", "end", "name", "score", strand.alias("strand"))


def sort_regions(df: DataFrame, by_name: bool = False) -> DataFrame:
    """By natural contig order, start, end and strand, or by name."""
    return df.orderBy("name") if by_name else df.orderBy(natural_key(F.col("chrom")), "chrom", "start", "end", "strand")


def stats(df: DataFrame) -> DataFrame:
    """Regions, bases, mean, median, least and greatest size."""
    size = F.col("end") - F.col("start")
    return df.agg(
        F.count(F.lit(1)).alias("regions"), F.sum(size).alias("bases"), F.avg(size).alias("mean_size"),
        F.percentile(size, 0.5).alias("median_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"),
    )


def depth(df: DataFrame, zero: bool = False, block: int = BLOCK) -> DataFrame:
    """Run-length encoded depth: chrom, start, end, depth; runs of depth 0 between covered ones with ``zero``."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    events = df.where("end > start").select("chrom", ends.alias("e")).groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta"))
    events = events.where("delta <> 0").withColumn("__b", F.floor(F.col("pos") / block))
    rows = running(events, ["chrom"], "__b", ["pos"], F.col("delta"), "sum", "depth")
    rows = following(rows, ["chrom"], "__b", "pos", "next")
    rows = rows.where(F.col("next").isNotNull() & (F.lit(zero) | (F.col("depth") > 0)))
    return rows.select("chrom", F.col("pos").alias("start"), F.col("next").alias("end"), F.col("depth").cast("long").alias("depth"))


def depth_at(df: DataFrame, **options) -> DataFrame:
    """Depth of each covered position: chrom, pos, depth."""
    runs = depth(df, **options)
    return runs.select("chrom", F.explode(F.expr("sequence(start, end - 1)")).alias("pos"), "depth")


def position_counts(df: DataFrame, column: str = "pos") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def split_segments(df: DataFrame, stranded: bool = False, bin_size: int = BIN) -> DataFrame:
    """Disjoint segments with the union of names over each: chrom, start, end, name (sorted, joined by ``|``).
    Regions of one name are merged where they overlap; segments begin and end where some name does."""
    keys = ["chrom", "strand", "name"] if stranded else ["chrom", "name"]
    merged = islands(df, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    group = ["chrom", "strand"] if stranded else ["chrom"]
    cuts = merged.select(*group, F.explode(F.array("start", "end")).alias("pos")).distinct().withColumn("__b", F.floor(F.col("pos") / BLOCK))
    parts = following(cuts, group, "__b", "pos", "end").where("end is not null").select(*group, F.col("pos").alias("start"), "end")
    found = range_join(parts, merged, stranded=stranded, bin_size=bin_size)
    return found.groupBy(*group, "start", "end").agg(F.array_join(F.array_sort(F.collect_set("r_name")), "|").alias("name"))


def merge_files(tagged: list[DataFrame], split: bool = False, single: bool = False, background: DataFrame | None = None, default: str = "") -> DataFrame:
    """Merges region tables: union of overlapping regions with the set of names, or disjoint segments with ``split``;
    ``single`` keeps the first name; ``background`` (chrom, length) adds whole contigs under the name ``default``."""
    cols = ["chrom", "start", "end", "name"]
    rows = tagged[0].select(*cols)
    for t in tagged[1:]:
        rows = rows.unionByName(t.select(*cols))
    if background is not None:
        rows = rows.unionByName(background.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(default).alias("name")))
    out = split_segments(rows) if split else reduce_regions(rows.withColumn("score", F.lit(0.0)), stranded=False).select(*cols)
    return out.withColumn("name", F.split("name", r"\|")[0]) if single else out


def tile(contigs: DataFrame, window: int, step: int | None = None) -> DataFrame:
    """Windows of each contig (chrom, length), the last one cut at its end; chunked, so a contig is not one row's array."""
    step = step or window
    chunk = step * 100_000
    spans = contigs.where("length > 0").withColumn("__c", F.explode(F.expr(f"sequence(0L, length - 1, {chunk}L)")))
    starts = F.explode(F.expr(f"sequence(__c, least(__c + {chunk - 1}L, length - 1), {step}L)"))
    rows = spans.withColumn("start", starts)
    return rows.select("chrom", "start", F.least(F.col("start") + window, F.col("length")).alias("end"))


def bin_counts(df: DataFrame, size: int = 50, stranded: bool = False, contigs: DataFrame | None = None) -> DataFrame:
    """Rows by bin of their 5' position (start, or end - 1 on the minus strand); empty bins too if ``contigs`` is given."""
    five = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))
    keys = ["chrom", "start", *(["strand"] if stranded else [])]
    got = df.withColumn("start", (F.floor(five / size) * size).cast("long")).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    if contigs is not None:
        every = tile(contigs, size).select("chrom", "start")
        if stranded:
            every = every.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
        got = every.join(got, keys, "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    return got.select("chrom", "start", (F.col("start") + size).alias("end"), *keys[2:], "count")


def to_bedpe(first: DataFrame, second: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of regions with one name: of those on one chrom and different (or no) strands the pair with the least
    distance, else the first of each; score is the greater.  ``key`` orders equal candidates.  Rows without a name have no pair.

    A sweep over (name, chrom, strand) gives each first region its least distance to a second one; only the best first region of a
    name then meets the name's second regions, so no name's pairs are listed."""
    a = first.where("name is not null").select("name", F.struct(*first.columns).alias("a"))
    b = second.where("name is not null").select("name", F.struct(*second.columns).alias("b"))
    strand, none = F.col("b.strand"), F.lit(None)
    partners = F.when(strand == "*", F.array(*map(F.lit, ("+", "-", "*", "")))).when(strand == "+", F.array(F.lit("-"), F.lit("*"))).when(strand == "-", F.array(F.lit("+"), F.lit("*"))).otherwise(F.array(F.lit("*")))
    ends = a.select("name", F.col("a.chrom").alias("chrom"), F.coalesce("a.strand", F.lit("")).alias("side"), F.col("a.end").alias("pos"), F.lit(1).alias("o"), none.cast("long").alias("reach"), "a")
    starts = b.select("name", F.col("b.chrom").alias("chrom"), F.explode(partners).alias("side"), F.col("b.start").alias("pos"), F.lit(0).alias("o"), F.col("b.end").alias("reach"), none.cast(a.schema["a"].dataType).alias("a"))
    rows = ends.union(starts).withColumn("__b", F.floor(F.col("pos") / block)).withColumn("__back", -F.col("__b"))
    keys = ["name", "chrom", "side"]
    rows = running(rows, keys, "__b", ["pos", "o"], F.col("reach"), "max", "left")
    rows = running(rows, keys, "__back", [F.desc("pos"), F.desc("o")], F.when(F.col("o") == 0, -F.col("pos")), "max", "right")
    behind = F.when(F.col("left").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("a.start") - F.col("left")))
    least = F.least(behind, -F.col("right") - F.col("a.end"))
    order = [F.col(f"a.{k}").alias(f"k{i}") for i, k in enumerate(key)]
    rows = rows.where("o = 1").withColumn("gap", least)
    one = rows.groupBy("name").agg(
        F.min_by(F.struct("a", "gap"), F.when(F.col("gap").isNotNull(), F.struct("gap", *order))).alias("near"), F.min_by("a", F.struct(*order)).alias("head"),
    )
    one = one.select("name", F.coalesce("near.a", "head").alias("a"), F.col("near.gap").alias("gap"))
    good = (F.col("a.chrom") == F.col("b.chrom")) & ((F.col("a.strand") != strand) | (F.col("a.strand") == "*") | (strand == "*"))
    gap = F.abs(distance(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")))
    met = one.join(b, "name").where(F.col("gap").isNull() | (good & (gap == F.col("gap"))))
    best = met.groupBy("name").agg(F.first("a").alias("a"), F.min_by("b", F.struct(*[F.col(f"b.{k}").alias(f"k{i}") for i, k in enumerate(key)])).alias("b"))
    return best.select(
        F.col("a.chrom").alias("chrom1"), F.col("a.start").alias("start1"), F.col("a.end").alias("end1"),
        F.col("b.chrom").alias("chrom2"), F.col("b.start").alias("start2"), F.col("b.end").alias("end2"), "name",
        F.greatest("a.score", "b.score").alias("score"), F.col("a.strand").alias("strand1"), F.col("b.strand").alias("strand2"),
    )


def from_bedpe(pairs: DataFrame, mode: str = "combine", longest: int = 10_000) -> DataFrame:
    """Regions of pairs: ``split`` (both mates), ``first``, ``second`` or ``combine``: one region from the least start to
    the greatest end of pairs on one chrom, not further apart than ``longest``, on different or no strands."""
    one = pairs.select(F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), F.col("end1").alias("end"), "name", "score", F.col("strand1").alias("strand"))
    two = pairs.select(F.col("chrom2").alias("chrom"), F.col("start2").alias("start"), F.col("end2").alias("end"), "name", "score", F.col("strand2").alias("strand"))
    if mode != "combine":
        return {"split": one.unionByName(two), "first": one, "second": two}[mode]
    gap = F.greatest(F.col("start1"), F.col("start2")) - F.least(F.col("end1"), F.col("end2"))
    fine = (F.col("chrom1") == F.col("chrom2")) & (gap <= longest)
    fine &= (F.col("strand1") != F.col("strand2")) | (F.col("strand1") == "*") | (F.col("strand2") == "*")
    return pairs.where(fine).select(
        F.col("chrom1").alias("chrom"), F.least("start1", "start2").alias("start"), F.greatest("end1", "end2").alias("end"), "name", "score",
        F.when(F.col("strand1") == F.col("strand2"), F.col("strand1")).otherwise("*").alias("strand"),
    )
