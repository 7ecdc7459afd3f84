"""Variant operators.

A variant table has chrom, pos (1-based), id, ref, alt array<string>, qual double (null is
missing), filters array<string> (null is PASS), info map<string,string> (a flag is the empty
string) and samples array<map<string,string>>, one map for each sample.
"""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.columns import matches_any, natural_key
from . import intervals

# -- filters: each is a Column that is true where the filter applies -----------------------


def chrom_pass(names: list[str]) -> Column:
    return ~F.col("chrom").isin(names)


def chrom_fail(names: list[str]) -> Column:
    return F.col("chrom").isin(names)


def indel() -> Column:
    return (F.length("ref") != 1) | F.exists("alt", lambda a: F.length(a) != 1)


def snv() -> Column:
    return (F.length("ref") == 1) & F.forall("alt", lambda a: F.length(a) == 1)


def max_insert(n: int) -> Column:
    return F.exists("alt", lambda a: F.length(a) - 1 > n)


def max_delete(n: int) -> Column:
    return F.length("ref") - 1 > n


def quality(least: float) -> Column:
    """A missing quality counts as -1."""
    return F.coalesce("qual", F.lit(-1.0)) < least


def any_sample(test) -> Column:
    return F.coalesce(F.exists("samples", test), F.lit(False))


def _alleles(sample: Column) -> Column:
    return F.split(F.try_element_at(sample, F.lit("GT")), r"[/|]")


def homozygous() -> Column:
    return any_sample(lambda s: F.coalesce((F.size(_alleles(s)) == 2) & (F.get(_alleles(s), F.lit(0)) == F.get(_alleles(s), F.lit(1))), F.lit(False)))


def heterozygous() -> Column:
    return any_sample(lambda s: F.coalesce((F.size(_alleles(s)) == 2) & (F.get(_alleles(s), F.lit(0)) != F.get(_alleles(s), F.lit(1))), F.lit(False)))


def flag_present(key: str) -> Column:
    return F.coalesce(F.map_contains_key("info", key), F.lit(False))


def flag_missing(key: str) -> Column:
    return ~flag_present(key)


def allele_text(value: Column, allele: str | None) -> Column:
    """A value's part for an allele: ``ref``, ``alt1`` or an index; the whole without one."""
    if not allele:
        return value
    at = {"ref": 0, "alt1": 1}.get(allele)
    return F.get(F.split(value, ","), F.lit(int(allele) if at is None else at))


def allele_number(value: Column, allele: str | None) -> Column:
    """A value as a double: one allele, or ``sum``, ``nref`` (all but the first), ``min`` or ``max`` of its parts."""
    if allele not in ("sum", "nref", "min", "max"):
        return allele_text(value, allele).try_cast("double")
    parts = F.transform(F.filter(F.split(value, ","), lambda p: p != ""), lambda p: p.try_cast("double"))
    if allele in ("min", "max"):
        return (F.array_min if allele == "min" else F.array_max)(parts)
    if allele == "nref":
        parts = F.slice(parts, 2, 1 << 30)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def on_values(key: str, sample: str | int | None, test, missing: bool) -> Column:
    """``test`` of a value: of INFO (sample ``"INFO"``), of one sample (its index), or of any sample."""
    def one(v: Column) -> Column:
        return F.when(v.isNull() | (v == "."), F.lit(missing)).otherwise(F.coalesce(test(v), F.lit(False)))

    if sample == "INFO":
        return one(F.try_element_at("info", F.lit(key)))
    if isinstance(sample, int):
        return one(F.try_element_at(F.get("samples", F.lit(sample)), F.lit(key)))
    return any_sample(lambda s: one(F.try_element_at(s, F.lit(key))))


def value_missing(key: str, sample=None) -> Column:
    gone = lambda v: v.isin("./.", ".|.") if key == "GT" else F.lit(False)
    return on_values(key, sample, gone, True)


def equals(key: str, value: str, sample=None, allele: str | None = None) -> Column:
    if allele == "sum":
        return on_values(key, sample, lambda v: allele_number(v, "sum") == float(value), False)
    return on_values(key, sample, lambda v: allele_text(v, allele) == value, False)


def not_equals(key: str, value: str, sample=None, allele: str | None = None) -> Column:
    if allele == "sum":
        return on_values(key, sample, lambda v: allele_number(v, "sum") != float(value), value != "")
    return on_values(key, sample, lambda v: allele_text(v, allele) != value, value != "")


def contains(key: str, value: str, sample=None) -> Column:
    return on_values(key, sample, lambda v: v.contains(value), False)


def not_contains(key: str, value: str, sample=None) -> Column:
    return on_values(key, sample, lambda v: ~v.contains(value), False)


def in_list(key: str, values: list[str], sample=None) -> Column:
    return on_values(key, sample, lambda v: v.isin(values), False)


def not_in_list(key: str, values: list[str], sample=None) -> Column:
    return on_values(key, sample, lambda v: ~v.isin(values), True)


def compares(op: str, key: str, bound: float, sample=None, allele: str | None = None) -> Column:
    """``lt``, ``lte``, ``gt`` or ``gte``; missing is false, NaN true."""
    tests = {"lt": lambda x: x < bound, "lte": lambda x: x <= bound, "gt": lambda x: x > bound, "gte": lambda x: x >= bound}
    return on_values(key, sample, lambda v: F.isnan(allele_number(v, allele)) | tests[op](allele_number(v, allele)), False)


def filter_id(*parts: object) -> str:
    """A filter's name, unfit characters made ``_``."""
    return re.sub(r"_+", "_", re.sub(r"[,;<> \t\r\n]", "_", "_".join(str(p) for p in parts if p not in (None, ""))))


def mark(df: DataFrame, filters: dict[str, Column], keep: str = "all") -> DataFrame:
    """Adds each filter's id where its Column is true; ``keep`` passing or failing rows only."""
    ids = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in filters.items()]))
    both = F.array_union(F.coalesce("filters", F.array().cast("array<string>")), ids)
    out = df.withColumn("filters", F.when(F.size(ids) > 0, both).otherwise(F.col("filters")))
    passing = F.col("filters").isNull() | (F.size("filters") == 0)
    return {"all": out, "passing": out.where(passing), "failing": out.where(~passing)}[keep]


def filter_stats(df: DataFrame) -> DataFrame:
    """Variants by combination of filters, sorted by name; PASS without any."""
    combo = F.when(F.col("filters").isNull(), "PASS").otherwise(F.array_join(F.array_sort("filters"), ";"))
    return df.groupBy(combo.alias("filters")).agg(F.count(F.lit(1)).alias("count"))


# -- annotators ---------------------------------------------------------------------


def with_info(df: DataFrame, **values: Column) -> DataFrame:
    """Sets INFO keys; a null value leaves its key out."""
    new = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]))
    old = F.map_filter(F.coalesce("info", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(values)))
    return df.withColumn("info", F.map_concat(old, F.map_filter(new, lambda k, v: v.isNotNull())))


def with_format(df: DataFrame, key: str, value) -> DataFrame:
    """Sets a FORMAT key of each sample to ``value(sample)``."""
    put = lambda s: F.map_concat(F.map_filter(s, lambda k, _: k != key), F.create_map(F.lit(key), value(s).cast("string")))
    return df.withColumn("samples", F.transform("samples", put))


def variant_distance(df: DataFrame, order: list[str], block: int = 1_000_000) -> Column | DataFrame:
    """INFO CG_VARDIST: distance to the nearest other variant of the contig, -1 if alone.  Neighbours across blocks come from each block's ends."""
    rows = df.withColumn("__b", F.floor(F.col("pos") / block))
    w = Window.partitionBy("chrom", "__b").orderBy("pos", *order)
    ends = rows.groupBy("chrom", "__b").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = Window.partitionBy("chrom").orderBy("__b")
    ends = ends.select("chrom", "__b", F.lag("hi").over(along).alias("__ahead"), F.lead("lo").over(along).alias("__behind"))
    rows = rows.join(ends, ["chrom", "__b"])
    prev = F.coalesce(F.lag("pos").over(w), "__ahead")
    nxt = F.coalesce(F.lead("pos").over(w), "__behind")
    rows = rows.withColumn("__d", F.coalesce(F.least(F.col("pos") - prev, nxt - F.col("pos")), F.lit(-1)))
    return with_info(rows, CG_VARDIST=F.col("__d")).drop("__b", "__ahead", "__behind", "__d")


def _counts(sample: Column, key: str) -> Column:
    return F.transform(F.split(F.try_element_at(sample, F.lit(key)), ","), lambda x: x.try_cast("double"))


def _per_alt(sample: Column, value) -> Column:
    """Joins ``value(plus, minus, total)`` over the alternative alleles of SAC (plus, minus for each allele)."""
    sac = _counts(sample, "SAC")
    total = F.aggregate(sac, F.lit(0.0), lambda a, x: a + x)
    n = F.floor(F.size(sac) / 2).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: value(F.get(sac, 2 * i), F.get(sac, 2 * i + 1), total))
    return F.when(n > 1, F.array_join(each, ","))


def allele_frequency(df: DataFrame) -> DataFrame:
    """FORMAT CG_VAF: (plus + minus) / total of each alternative allele, three places."""
    value = lambda p, m, t: F.when(p + m > 0, F.format_string("%.3f", (p + m) / t)).otherwise("0.0")
    return with_format(df, "CG_VAF", lambda s: _per_alt(s, value))


def minor_strand(df: DataFrame) -> DataFrame:
    """FORMAT CG_SBPCT: the lesser strand's share of each alternative allele, three places."""
    value = lambda p, m, t: F.when(p + m > 0, F.format_string("%.3f", F.least(p, m) / (p + m))).otherwise("0.0")
    return with_format(df, "CG_SBPCT", lambda s: _per_alt(s, value))


def dosage(df: DataFrame) -> DataFrame:
    """FORMAT CG_DS: how often GT has each alternative allele."""
    def value(s: Column) -> Column:
        return F.array_join(F.transform("alt", lambda _, i: F.size(F.filter(_alleles(s), lambda a: a == (i + 1).cast("string"))).cast("string")), ",")

    return with_format(df, "CG_DS", value)


def indel_sizes(df: DataFrame) -> DataFrame:
    """INFO CG_INSERT, CG_DELETE (flags), CG_INSLEN, CG_DELLEN and CG_INDELLEN (negative for a deletion)."""
    ins = F.array_max(F.transform("alt", lambda a: F.length(a))) - 1
    gain, loss = F.array_max(F.transform("alt", lambda a: F.length(a) - F.length("ref"))), F.length("ref") - 1
    return with_info(df, CG_INSERT=F.when(ins > 0, ""), CG_DELETE=F.when(loss > 0, ""), CG_INSLEN=F.when(ins > 0, ins), CG_DELLEN=F.when(loss > 0, loss),
                     CG_INDELLEN=F.when((ins > 0) | (loss > 0), F.when(loss > 0, -loss).otherwise(gain)))


def substitution(ref: Column, alt: Column) -> Column:
    """TS or TV of a single-base change; null otherwise."""
    pair = F.concat(ref, alt)
    one = (F.length(ref) == 1) & (F.length(alt) == 1) & (ref != alt)
    return F.when(one & pair.isin("AG", "GA", "CT", "TC"), "TS").when(one & pair.rlike("^[ACGT]{2}$"), "TV")


def tstv(df: DataFrame) -> DataFrame:
    return with_info(df, CG_TSTV=F.when(F.size("alt") == 1, substitution(F.col("ref"), F.col("alt")[0])))


def auto_id(df: DataFrame) -> DataFrame:
    """ID from chrom, pos, ref and each alt."""
    one = lambda a: F.concat_ws("_", F.col("chrom"), F.col("pos").cast("string"), F.col("ref"), a)
    return df.withColumn("id", F.array_join(F.transform("alt", one), ";"))


def copy_log_ratio(df: DataFrame, somatic: int, germline: int, key: str = "AD", totals: tuple[float, float] | None = None) -> DataFrame:
    """INFO CG_CNLR: log2 of summed depths, somatic against germline, normalised by ``totals``; six places."""
    depth = lambda i: F.aggregate(_counts(F.get("samples", F.lit(i)), key), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    a, b = (depth(i) / F.lit(t) for i, t in zip((somatic, germline), totals or (1.0, 1.0)))
    return with_info(df, CG_CNLR=F.when((a > 0) & (b > 0), F.format_string("%.6f", F.log2(a) - F.log2(b))))


def constant(df: DataFrame, key: str, value: str = "") -> DataFrame:
    return with_info(df, **{key: F.lit(value)})


def span(df: DataFrame) -> DataFrame:
    """start and end (0-based) of a variant for region lookups: behind the anchor base of an indel."""
    start = F.when(F.length("ref") > 1, F.col("pos")).otherwise(F.col("pos") - 1)
    return df.withColumns({"start": start, "end": F.greatest(F.col("pos") - 1 + F.length("ref"), start + 1)})


def annotate_regions(df: DataFrame, key: list[str], regions: DataFrame, name: str, flag: bool = False) -> DataFrame:
    """INFO ``name``: names of overlapping regions (sorted, joined by comma), or a flag."""
    at = span(df.select(*key, "chrom", "pos", "ref"))
    pairs = intervals.range_join(at, regions.select("chrom", "start", "end", "name"))
    found = pairs.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("r_name")), ",").alias("__names"))
    out = df.join(found, key, "left")
    return with_info(out, **{name: F.when(F.col("__names").isNotNull(), "") if flag else F.col("__names")}).drop("__names")


def annotate_variants(df: DataFrame, key: list[str], other: DataFrame, name: str, field: str | None = None, exact: bool = False, passing: bool = False, unique: bool = False) -> DataFrame:
    """INFO ``name`` from variants at the same position: an INFO field, the id (``field="ID"``) or a flag;
    ``exact`` asks for the same ref and a shared alt."""
    b = other.where(F.col("filters").isNull()) if passing else other
    value = F.lit("") if field is None else F.col("id") if field == "ID" else F.try_element_at("info", F.lit(field))
    b = b.select(F.col("chrom").alias("b_chrom"), F.col("pos").alias("b_pos"), F.col("ref").alias("b_ref"), F.col("alt").alias("b_alt"), value.alias("b_value"))
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("pos") == F.col("b_pos"))
    if exact:
        on &= (F.col("ref") == F.col("b_ref")) & F.arrays_overlap("alt", "b_alt")
    got = df.select(*key, "chrom", "pos", "ref", "alt").join(b, on).where("b_value is not null")
    every = F.collect_set("b_value") if unique or field is None else F.collect_list("b_value")
    got = got.groupBy(*key).agg(F.array_join(F.array_sort(every), ",").alias("__v"))
    return with_info(df.join(got, key, "left"), **{name: F.col("__v")}).drop("__v")


def info_in_list(df: DataFrame, key: list[str], field: str, values: DataFrame, name: str, split: str | None = None) -> DataFrame:
    """INFO flag ``name`` where a field's value (or one of its parts) is in ``values`` (value)."""
    text = F.try_element_at("info", F.lit(field))
    parts = F.explode(F.split(text, split) if split else F.array(text))
    hits = df.select(*key, parts.alias("value")).join(values.select("value").distinct(), "value", "left_semi").select(*key).distinct().withColumn("__hit", F.lit(""))
    return with_info(df.join(hits, key, "left"), **{name: F.col("__hit")}).drop("__hit")


def flanking(df: DataFrame, key: list[str], reference: DataFrame, chunk: int, size: int = 1) -> DataFrame:
    """INFO CG_FLANKING and CG_FLANKING_SUB (``A[C>A]A``, pyrimidine as ref) of SNVs from a chunked reference
    (chrom, chunk_start, seq): the chunks a window touches are joined and put together."""
    from ..functions.sequences import revcomp

    rows = df.where(snv()).select(*key, "chrom", "pos", "ref", F.col("alt")[0].alias("a"))
    lo, hi = F.col("pos") - 1 - size, F.col("pos") + size
    rows = rows.withColumn("chunk_start", F.explode(F.sequence(F.floor(lo / chunk), F.floor((hi - 1) / chunk))))
    rows = rows.withColumn("chunk_start", F.col("chunk_start") * chunk)
    part = F.substring(F.col("seq"), F.greatest(lo - F.col("chunk_start"), F.lit(0)) + 1, F.least(hi - F.col("chunk_start"), F.lit(chunk)) - F.greatest(lo - F.col("chunk_start"), F.lit(0)))
    parts = rows.join(reference, ["chrom", "chunk_start"]).groupBy(*key, "ref", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", part.alias("s")))), lambda x: x["s"]), "").alias("flank"))
    parts = parts.where(F.length("flank") == 2 * size + 1)
    purine = F.col("ref").isin("A", "G")
    flank = F.when(purine, revcomp(F.col("flank"))).otherwise(F.col("flank"))
    sub = F.concat(F.substring(flank, F.lit(1), F.lit(size)), F.lit("["), F.when(purine, revcomp(F.col("ref"))).otherwise(F.col("ref")), F.lit(">"), F.when(purine, revcomp(F.col("a"))).otherwise(F.col("a")), F.lit("]"), F.substring(flank, F.lit(size + 2), F.lit(size)))
    parts = parts.select(*key, flank.alias("__f"), sub.alias("__s"))
    return with_info(df.join(parts, key, "left"), CG_FLANKING=F.col("__f"), CG_FLANKING_SUB=F.col("__s")).drop("__f", "__s")


# -- structural variants -------------------------------------------------------------


def alt_positions(df: DataFrame) -> DataFrame:
    """One row for each alt with alt_chrom, alt_pos, sv_type and connection."""
    info = lambda k: F.try_element_at("info", F.lit(k))
    rows = df.select("*", F.posexplode("alt").alias("alt_index", "allele"))
    a = F.col("allele")
    where = F.regexp_extract(a, r"[\[\]]([^\[\]]+):(\d+)[\[\]]", 1)
    at = F.regexp_extract(a, r"[\[\]]([^\[\]]+):(\d+)[\[\]]", 2).try_cast("long")
    bnd = a.rlike(r"[\[\]]")
    joined = F.when(a.rlike(r"^\["), "5to5").when(a.rlike(r"^\]"), "5to3").when(a.rlike(r"\[$"), "3to5").otherwise("3to3")
    kind = (
        F.when(bnd, "BND").when(a.startswith("<DEL"), "DEL").when(a.startswith("<DUP"), "DUP").when(a.startswith("<INV"), "INV").when(a.startswith("<CNV"), "CNV")
        .when(a.startswith("<INS") | (~a.startswith("<") & (F.length(a) > 1)), "INS").when(a.startswith("<"), "UNK").when(F.length("ref") > 1, "DEL").otherwise("SNV")
    )
    end = info("END").try_cast("long")
    pos = F.when(bnd, at).when(kind == "DEL", F.coalesce(end, F.col("pos") + F.length("ref"))).otherwise(F.coalesce(end, F.col("pos")))
    conn = F.when(bnd, joined).when(kind == "DEL", "3to5").when(kind == "DUP", "5to3").when(kind == "INS", "NToN").when(kind.isin("INV", "CNV", "UNK"), "UNK").otherwise("NA")
    return rows.withColumns({
        "alt_chrom": F.when(bnd, where).otherwise(F.coalesce(info("CHR2"), F.col("chrom"))), "alt_pos": pos,
        "sv_type": F.coalesce(info("SVTYPE"), kind), "connection": F.coalesce(info("CT"), conn),
    })


def to_bed(df: DataFrame, padding: int = 0) -> DataFrame:
    """Regions of variants on one contig: chrom, start, end, name (the type)."""
    rows = alt_positions(df).where("alt_chrom = chrom")
    return rows.select("chrom", F.greatest(F.lit(0), F.col("pos") - 1 - padding).alias("start"), (F.greatest("pos", "alt_pos") + padding).alias("end"), F.col("sv_type").alias("name"))


def sv_regions(df: DataFrame, flank: int = 0) -> DataFrame:
    """Both ends of variants that join two places: chrom, start, end; reads around either are those to extract."""
    ends = to_bedpe(df)
    side = lambda k: ends.select(F.col(f"chrom{k}").alias("chrom"), F.greatest(F.lit(0), F.col(f"start{k}") - flank).alias("start"), (F.col(f"end{k}") + flank).alias("end"))
    return side(1).union(side(2)).distinct()


def to_bedpe(df: DataFrame, del_offset: bool = True) -> DataFrame:
    """A pair of regions for each alt; a deletion begins behind its anchor base unless ``del_offset`` is off.  Of one EVENT the first row stays."""
    event = F.try_element_at("info", F.lit("EVENT"))
    rows = alt_positions(df).withColumn("__event", F.coalesce(event, F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "allele")))
    rows = rows.groupBy("__event").agg(F.min_by(F.struct("chrom", "pos", "alt_chrom", "alt_pos", "id", "sv_type", "connection", "qual"), F.struct("chrom", "pos", "allele")).alias("r")).select("r.*")
    shift = F.when((F.col("sv_type") == "DEL") & F.lit(del_offset), 1).otherwise(0)
    return rows.select(
        F.col("chrom").alias("chrom1"), (F.col("pos") - 1 + shift).alias("start1"), (F.col("pos") + shift).alias("end1"),
        F.col("alt_chrom").alias("chrom2"), (F.col("alt_pos") - 1).alias("start2"), F.col("alt_pos").alias("end2"),
        F.coalesce("id", F.lit(".")).alias("name"), F.coalesce("qual", F.lit(0.0)).alias("score"), "sv_type", "connection",
    )


# -- commands ------------------------------------------------------------------------


def stats(df: DataFrame) -> DataFrame:
    one = F.size("alt") == 1
    kind = F.when(one, substitution(F.col("ref"), F.col("alt")[0]))
    passing = F.col("filters").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(passing).alias("passing"), F.count_if(~passing).alias("filtered"), F.count_if(snv()).alias("snvs"),
        F.count_if(indel()).alias("indels"), F.count_if(kind == "TS").alias("ts"), F.count_if(kind == "TV").alias("tv"),
    )


def tstv_ratio(df: DataFrame) -> DataFrame:
    kind = F.when(F.size("alt") == 1, substitution(F.col("ref"), F.col("alt")[0]))
    out = df.agg(F.count_if(kind == "TS").alias("ts"), F.count_if(kind == "TV").alias("tv"))
    return out.withColumn("ratio", F.try_divide("ts", "tv"))


def info_tally(df: DataFrame) -> DataFrame:
    """Variants that carry each INFO key."""
    return df.select(F.explode(F.map_keys("info")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count"))


def to_count(df: DataFrame, sample: int = 0) -> DataFrame:
    """One row for each alt: ref and alt counts (AD, else RO and AO), their sum and the alt's share."""
    s = F.get("samples", F.lit(sample))
    part = lambda k, i: F.get(_counts(s, k), i)
    rows = df.select("chrom", "pos", "ref", "samples", F.posexplode("alt").alias("i", "allele"))
    ref = F.coalesce(part("AD", F.lit(0)), part("RO", F.lit(0)), F.lit(0.0)).cast("long")
    alt = F.coalesce(part("AD", F.col("i") + 1), part("AO", F.col("i")), F.lit(0.0)).cast("long")
    rows = rows.select("chrom", "pos", "ref", F.col("allele").alias("alt"), ref.alias("ref_count"), alt.alias("alt_count"))
    total = F.col("ref_count") + F.col("alt_count")
    return rows.withColumns({"total": total, "af": F.when(total > 0, F.col("alt_count") / total).otherwise(0.0)})


def bed_count(df: DataFrame, regions: DataFrame, key: list[str], sample: int | None = None) -> DataFrame:
    """``regions`` with the variants that start in each and their rate per million bases; with ``sample`` only where its GT is not 0/0."""
    if sample is not None:
        gt = F.try_element_at(F.get("samples", F.lit(sample)), F.lit("GT"))
        df = df.where(gt.isNotNull() & ~gt.isin("0/0", "0|0", "./.", ".|."))
    points = df.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    out = intervals.count_overlaps(regions, points, key, stranded=False)
    return out.withColumn("per_mb", F.col("count") * 1e6 / (F.col("end") - F.col("start")))


def tmb(counts: DataFrame) -> DataFrame:
    """Upper tail of a Poisson distribution for each region's count, at the mean rate of all regions."""
    from ..functions.stats import poisson_upper

    rate = counts.agg(F.sum("count").alias("n"), F.sum(F.col("end") - F.col("start")).alias("size")).select((F.col("n") / F.col("size")).alias("__rate"))
    return counts.join(F.broadcast(rate)).withColumn("pvalue", poisson_upper(F.col("count"), F.col("__rate") * (F.col("end") - F.col("start")))).drop("__rate")


def sample_export(df: DataFrame, names: list[str], keys: list[str], bases: bool = False) -> DataFrame:
    """One row for each variant and sample with the chosen FORMAT keys; GT as bases if asked."""
    rows = df.select("chrom", "pos", "ref", "alt", F.concat(F.array("ref"), "alt").alias("alleles"), F.posexplode("samples").alias("i", "s"))
    rows = rows.withColumn("sample", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1))
    alleles = F.col("alleles")

    def value(k: str) -> Column:
        v = F.try_element_at("s", F.lit(k))
        if k == "GT" and bases:
            sep = F.when(v.contains("|"), "|").otherwise("/")
            v = F.call_function("array_join", F.transform(F.split(v, r"[/|]"), lambda a: F.coalesce(F.get(alleles, a.try_cast("int")), F.lit("."))), sep)
        return F.coalesce(v, F.lit("")).alias(k.lower())

    return rows.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "sample", *map(value, keys))


def export(df: DataFrame, info: list[str] = (), formats: list[tuple[int, str]] = (), names: list[str] = ()) -> DataFrame:
    """Position and alleles with id, qual, filters and chosen INFO and FORMAT values as columns."""
    cols = ["chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "id", "qual", F.coalesce(F.array_join("filters", ";"), F.lit("PASS")).alias("filter")]
    cols += [F.try_element_at("info", F.lit(k)).alias(k.lower()) for k in info]
    cols += [F.try_element_at(F.get("samples", F.lit(i)), F.lit(k)).alias(f"{names[i] if names else i}_{k}".lower()) for i, k in formats]
    return df.select(*cols)


def unique_events(df: DataFrame, event: Column, order: list[Column]) -> DataFrame:
    """The first row of each event by ``order``; rows without an event all stay."""
    rows = df.withColumn("__e", event)
    first = rows.where("__e is not null").groupBy("__e").agg(F.min_by(F.struct(*df.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")).select("r.*")
    return first.unionByName(rows.where("__e is null").drop("__e"))


def chrom_fix(df: DataFrame, to: str = "ucsc", primary: bool = False) -> DataFrame:
    """Contig names between Ensembl (1, MT) and UCSC (chr1, chrM); ``primary`` keeps the human primary set."""
    c = F.col("chrom")
    bare = F.regexp_replace(c, "^chr", "")
    new = F.when(bare.isin("M", "MT"), "chrM" if to == "ucsc" else "MT").otherwise(F.concat(F.lit("chr"), bare) if to == "ucsc" else bare)
    out = df.withColumn("chrom", new)
    return out.where(F.regexp_replace("chrom", "^chr", "").rlike("^(?:[1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$")) if primary else out


def clear_filters(df: DataFrame, names: list[str], only: bool = False) -> DataFrame:
    """Removes filters (with ``only`` just where no other is set) and notes them as INFO CG_CLEARED_FILTER."""
    drop = F.array(*map(F.lit, names))
    rest, gone = F.array_except("filters", drop), F.array_intersect("filters", drop)
    act = F.size(gone) > 0
    if only:
        act &= F.size(rest) == 0
    act = F.coalesce(act, F.lit(False))
    out = with_info(df, CG_CLEARED_FILTER=F.when(act, F.array_join(gone, ",")))
    return out.withColumn("filters", F.when(act, F.when(F.size(rest) > 0, rest)).otherwise(F.col("filters")))


def strip(df: DataFrame, info: list[str] = (), keep_info: list[str] = (), formats: list[str] = (), keep_formats: list[str] = (), filters: list[str] = (), keep_filters: list[str] = (), ids: bool = False) -> DataFrame:
    """Removes INFO, FORMAT and FILTER entries by glob, except those that a keep glob matches."""
    goes = lambda name, globs, keeps: matches_any(name, list(globs)) & ~matches_any(name, list(keeps))
    df = df.withColumn("info", F.map_filter("info", lambda k, v: ~goes(k, info, keep_info)))
    df = df.withColumn("samples", F.transform("samples", lambda s: F.map_filter(s, lambda k, v: ~goes(k, formats, keep_formats))))
    left = F.filter("filters", lambda f: ~goes(f, filters, keep_filters))
    df = df.withColumn("filters", F.when(F.size(left) > 0, left))
    return df.withColumn("id", F.lit(None).cast("string")) if ids else df


def fold_flags(df: DataFrame, key: str = "CG_FLAGS") -> DataFrame:
    """Moves INFO flags into one comma-joined key."""
    flags = F.array_sort(F.map_keys(F.map_filter("info", lambda k, v: v == "")))
    out = df.withColumn("__f", flags).withColumn("info", F.map_filter("info", lambda k, v: v != ""))
    return with_info(out, **{key: F.when(F.size("__f") > 0, F.array_join("__f", ","))}).drop("__f")


def rename(names: list[str], new: dict[str, str]) -> list[str]:
    """Sample names with some replaced, by name or 1-based position; the rows hold no names."""
    return [new.get(n, new.get(str(i), n)) for i, n in enumerate(names, 1)]


def reorder_samples(df: DataFrame, order: list[int]) -> DataFrame:
    return df.withColumn("samples", F.array(*[F.get("samples", F.lit(i)) for i in order]))


def concat(tables: list[DataFrame], contigs: list[str] | None = None) -> DataFrame:
    """Variants of several tables in contig and position order; two tables with one position are an error.
    Contigs come in the order of ``contigs`` (a header's), those that it does not list behind them in natural order."""
    rows = tables[0].withColumn("__t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        rows = rows.unionByName(t.withColumn("__t", F.lit(i)))
    shared = rows.groupBy("chrom", "pos").agg(F.min("__t").alias("a"), F.max("__t").alias("b")).where("a < b")
    if not shared.isEmpty():
        raise ValueError("variants of two inputs share a position")
    listed = F.create_map(*[F.lit(x) for i, c in enumerate(contigs) for x in (c, i)])[F.col("chrom")] if contigs else F.lit(None).cast("int")
    return rows.drop("__t").orderBy(listed.asc_nulls_last(), natural_key(F.col("chrom")), "pos")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joins the same variants of two tables: INFO and samples of both, the first table's values where both have a key."""
    b = right.select("chrom", "pos", "ref", "alt", F.col("id").alias("b_id"), F.col("filters").alias("b_filters"), F.col("info").alias("b_info"), F.col("samples").alias("b_samples"))
    out = left.join(b, ["chrom", "pos", "ref", "alt"])
    more = F.map_filter("b_info", lambda k, v: ~F.map_contains_key("info", k))
    both = F.array_union(F.coalesce("filters", F.array().cast("array<string>")), F.coalesce("b_filters", F.array().cast("array<string>")))
    return out.withColumns({
        "info": F.map_concat("info", more), "samples": F.concat("samples", "b_samples"), "id": F.coalesce("id", "b_id"),
        "filters": F.when(F.size(both) > 0, both),
    }).drop("b_id", "b_filters", "b_info", "b_samples")


def split(df: DataFrame, size: int, order: list[str], block: int = 1_000_000) -> DataFrame:
    """Adds chunk: ``size`` variants each in contig and position order; row numbers come from block totals."""
    rows = df.withColumn("__b", F.floor(F.col("pos") / block))
    w = Window.partitionBy("chrom", "__b").orderBy("pos", *order)
    totals = rows.groupBy("chrom", "__b").agg(F.count(F.lit(1)).alias("n"))
    base = totals.select("chrom", "__b", F.coalesce(F.sum("n").over(Window.orderBy("chrom", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.join(base, ["chrom", "__b"])
    return rows.withColumn("chunk", F.floor((F.col("base") + F.row_number().over(w) - 1) / size)).drop("__b", "base")


def reference_match(df: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """Share of SNVs whose ref is the reference's base."""
    rows = df.where(snv()).withColumn("chunk_start", F.floor((F.col("pos") - 1) / chunk) * chunk)
    base = F.upper(F.substring(F.col("seq"), F.col("pos") - F.col("chunk_start"), F.lit(1)))
    return rows.join(reference, ["chrom", "chunk_start"]).agg(F.count(F.lit(1)).alias("checked"), F.avg((base == F.upper("ref")).cast("int")).alias("fraction"))


def consensus(calls: DataFrame, precise: int = 10, imprecise: int = 200, least: int = 2, passing: bool = False, rescue: bool = False, event: str | None = None) -> DataFrame:
    """Variants called alike by at least ``least`` inputs (column caller): same type, ends within the buffer (``precise``, or
    ``imprecise`` if INFO IMPRECISE is set on either).  SNVs need the same alt, insertions only their position, an inversion matches breakends too;
    other calls need the same connection.  Copy-number and unknown types are left out.  Distinct sites are linked by
    range joins and grouped by connected components; a group's row is its first call by caller and position.

    ``passing`` keeps groups whose calls all passed their filters, with ``rescue`` also those where any did (rescue: CG_PASS_RESCUE,
    orig_filter: the filters it had).  With ``event`` (an INFO key), groups that hold a call of the same input and event as a kept group come
    too (linked), whoever called them; of their calls, with ``rescue`` filters are lifted (CG_EVENT_RESCUE), else ``passing`` applies."""
    from .graph import components

    site = ["chrom", "pos", "ref", "allele", "sv_type", "alt_chrom", "alt_pos", "connection"]
    rows = alt_positions(calls).where(~F.coalesce(F.col("sv_type").isin("CNV", "UNK"), F.lit(False)))
    loose = F.coalesce(F.map_contains_key("info", F.lit("IMPRECISE")), F.lit(False))
    named = F.nullif(F.try_element_at("info", F.lit(event)), F.lit("")) if event else F.lit(None).cast("string")
    failed = F.array_join(F.array_sort("filters"), ",") if "filters" in calls.columns else F.lit(None).cast("string")
    rows = rows.select(*site, "caller", loose.alias("loose"), named.alias("event"), F.nullif(failed, F.lit("")).alias("failed")).withColumn("site", F.xxhash64(*site))
    sites = rows.groupBy("site", *site).agg(F.max("loose").alias("loose"))
    a = sites.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), *[c for c in site if c != "chrom"], "loose", "site")
    near = F.when(F.col("loose") | F.col("r_loose"), imprecise).otherwise(precise)
    right = (F.col("alt_chrom") == F.col("r_alt_chrom")) & (F.abs(F.col("alt_pos") - F.col("r_alt_pos")) <= near)
    same, conn = F.col("sv_type") == F.col("r_sv_type"), F.col("connection") == F.col("r_connection")
    kinds = F.sort_array(F.array("sv_type", "r_sv_type")) == F.array(F.lit("BND"), F.lit("INV"))
    alike = F.when(F.col("sv_type") == "SNV", same & (F.col("allele") == F.col("r_allele"))).when(F.col("sv_type") == "INS", same & conn & (F.col("alt_chrom") == F.col("r_alt_chrom")))
    alike = alike.when(F.col("sv_type") == "INV", (same | kinds) & right).otherwise((same & conn | kinds) & right)
    linked = lambda x, y, within: intervals.range_join(x, y, within=within).where((F.abs(F.col("pos") - F.col("r_pos")) <= near) & alike & (F.col("site") != F.col("r_site"))).select(F.least("site", "r_site").alias("a"), F.greatest("site", "r_site").alias("b"))
    # the wide buffer only where one side is imprecise
    links = linked(a, a, precise).union(linked(a.where("loose"), a, imprecise)).distinct()
    roots = components(links).withColumnsRenamed({"node": "site", "root": "cluster"})
    rows = rows.join(roots.select("site", "cluster"), "site", "left").withColumn("cluster", F.coalesce("cluster", "site"))
    first = F.min_by(F.struct("chrom", "pos", "ref", "allele", "sv_type", "alt_chrom", "alt_pos"), F.struct("caller", "chrom", "pos", "allele", "ref", "alt_chrom", "alt_pos")).alias("v")
    groups = rows.groupBy("cluster").agg(first, F.countDistinct("caller").alias("callers"), F.bool_and(F.col("failed").isNull()).alias("all_pass"), F.bool_or(F.col("failed").isNull()).alias("any_pass"), F.array_join(F.array_sort(F.collect_set("failed")), ",").alias("orig_filter"))
    fine = F.col("any_pass") if rescue else F.col("all_pass")
    kept = (F.col("callers") >= least) & (fine if passing else F.lit(True))
    groups = groups.withColumn("kept", kept)
    if event:
        ties = rows.where("event is not null").select("caller", "event", "cluster").distinct()
        begun = ties.join(groups.where("kept").select("cluster", (F.col("any_pass") if passing and rescue else F.col("all_pass")).alias("passed")), "cluster")
        reached = ties.join(begun.groupBy("caller", "event").agg(F.bool_or("passed").alias("lifted")), ["caller", "event"]).groupBy("cluster").agg(F.bool_or("lifted").alias("lifted"))
        groups = groups.join(reached, "cluster", "left")
    else:
        groups = groups.withColumn("lifted", F.lit(None).cast("boolean"))
    lifted = F.lit(rescue) & F.coalesce("lifted", F.lit(False))
    linked_in = ~F.col("kept") & F.col("lifted").isNotNull() & (F.col("all_pass") | lifted if passing else F.lit(True))
    mark = F.when(F.col("kept") & ~F.col("all_pass") & F.lit(passing and rescue), "CG_PASS_RESCUE").when(~F.col("all_pass") & lifted, "CG_EVENT_RESCUE")
    out = groups.withColumn("linked", linked_in).where("kept or linked").withColumn("rescue", mark)
    return out.select("v.*", "callers", "linked", "rescue", F.when(F.col("rescue").isNotNull(), F.col("orig_filter")).alias("orig_filter"))
