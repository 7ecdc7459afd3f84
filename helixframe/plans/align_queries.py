"""Queries of the alignment operators."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import alignments as A
from .fixtures import frame, with_sql

KEY = ["event_id"]


def al(s, d):
    """The projection al as an alignment table; the mate is the other row of the name."""
    rows = frame(s, d, "al")
    tags = F.map_filter(F.create_map(F.lit("NH"), F.col("nh").cast("string"), F.lit("NM"), F.col("nm").cast("string"), F.lit("AS"), F.col("score_as").cast("string"), F.lit("RG"), F.col("read_group")), lambda k, v: v.isNotNull())
    mate = rows.select((F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 1).otherwise(F.col("event_id") - 1)).alias("event_id"), F.col("chrom").alias("mate_chrom"), F.col("pos").alias("mate_pos"), F.col("flag").bitwiseAND(16).alias("mr"), F.col("flag").bitwiseAND(4).alias("mu"))
    rows = rows.join(mate, "event_id", "left")
    flag = F.col("flag") + F.coalesce("mr", F.lit(0)) * 2 + F.coalesce("mu", F.lit(0)) * 2
    return rows.select("event_id", "name", flag.cast("int").alias("flag"), "chrom", "pos", "mapq", "cigar", "tlen", "mate_chrom", "mate_pos", "seq", "qual", tags.alias("tags"))


def rg(s, d):
    return frame(s, d, "rg").withColumns({"start": (F.col("start") % 20000).cast("long"), "end": (F.col("start") % 20000 + F.col("end") - F.col("start")).cast("long")})


def ids(df):
    return df.select("event_id")


def flag_filter(s, d):
    return ids(A.flags(al(s, d), A.COUNT_FILTER, A.PAIRED | A.PROPER))


def bam_names(s, d):
    return ids(A.by_names(al(s, d), frame(s, d, "iv").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("name"))))


def bam_contigs(s, d):
    return ids(al(s, d).where(A.contigs(["chr1", "chr2", "chr3"], ["chr2"])))


def _sifted(s, d):
    return A.sift(al(s, d), {"mapq": F.col("mapq") >= 10, "flags": A.lacks(A.COUNT_FILTER), "nh": A.tag("NH") == 1})


def bam_passed(s, d):
    return ids(_sifted(s, d)[0])


def bam_failed(s, d):
    return _sifted(s, d)[1].select("event_id", "failed")


def bam_sort(s, d):
    return A.sort_alignments(al(s, d)).select("event_id", "chrom", "pos")


def unique_mapping(s, d):
    return ids(al(s, d).where(A.unique_mapping()))


def pair_keep(s, d):
    return ids(A.pair_filter(al(s, d), F.col("mapq") >= 40))


def pair_remove(s, d):
    return ids(A.pair_filter(al(s, d), F.col("mapq") >= 10, keep_any=False))


def sane_pairs(s, d):
    return ids(al(s, d).where(A.sane_pair()))


def tag_min(s, d):
    return ids(al(s, d).where(A.tag_test({"AS": 20, "MAPQ": 30}, "min")))


def tag_max(s, d):
    return ids(al(s, d).where(A.tag_test({"NM": 2, "TLEN": 200}, "max")))


def tag_eq(s, d):
    return ids(al(s, d).where(A.tag_test({"NH": 1}, "eq") & A.tag_text("RG", "rg1")))


def unique_start(s, d):
    return A.unique_start(al(s, d), KEY).select("event_id", "chrom", "pos")


def bam_region_include(s, d):
    return ids(A.in_regions(al(s, d), KEY, rg(s, d).where("score > 990")))


def bam_region_exclude(s, d):
    return ids(A.in_regions(al(s, d), KEY, rg(s, d).where("score > 990"), keep=False))


def bam_region_within(s, d):
    return ids(A.in_regions(al(s, d), KEY, rg(s, d).where("score > 990"), within=True))


def bam_junctions(s, d):
    known = A.junctions(al(s, d).where("mapq > 30"), []).distinct()
    return ids(A.junctions_in(al(s, d), KEY, known))


def dups(s, d):
    return A.duplicates(al(s, d).withColumn("tlen", F.floor(F.col("tlen") / 100).cast("int")), KEY).select("event_id", "duplicate")


def best(s, d):
    rows = al(s, d)
    other = rows.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, v: k != "AS"), F.create_map(F.lit("AS"), (F.col("event_id") % 47).cast("string"))))
    return A.best_source([rows, other], KEY, [("AS", True), ("NM", False)])


def discord(s, d):
    return al(s, d).select("event_id", A.concordance(5000).alias("kind"))


def ref_count(s, d):
    return A.ref_counts(al(s, d))


def span_count(s, d):
    return A.span_counts(al(s, d), rg(s, d), ["region_id"]).select("region_id", "count")


def span_count_stranded(s, d):
    return A.span_counts(al(s, d), rg(s, d), ["region_id"], "FR").select("region_id", "count")


def span_count_details(s, d):
    return A.span_details(al(s, d), rg(s, d), ["region_id"]).select("region_id", "count", "proper", "not_proper", F.round("ratio", 9).alias("ratio"), F.round("insert", 6).alias("insert"), "inverted")


def bam_bedgraph(s, d):
    return A.depth(al(s, d))


def coverage_quantiles(s, d):
    return A.coverage_quantiles(al(s, d))


def expressed_regions(s, d):
    return A.expressed(al(s, d), 8, 10, 20)


def softclip(s, d):
    return A.soft_clips(al(s, d), 5)


def wps(s, d):
    pairs = frame(s, d, "iv").select("chrom", "start", "end", F.monotonically_increasing_id().alias("id"))
    return A.protection(pairs, 20).select("chrom", F.explode(F.expr("sequence(start, end - 1)")).alias("pos"), "wps")


def base_call(s, d):
    return A.base_calls(al(s, d), 10)


def bam_consensus(s, d):
    return A.base_calls(al(s, d)).select("chrom", "pos", A.consensus_base(0.3, 4).alias("base"))


def _reference(calls):
    """A base for each position, in chunks of one."""
    return calls.select("chrom", F.col("pos").alias("chunk_start")).distinct().withColumn("seq", F.substring(F.translate(F.md5(F.concat_ws(":", "chrom", F.col("chunk_start").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 1))


def allele_calls(s, d):
    return A.allele_calls(al(s, d), 10)


def bam_tofasta(s, d):
    starts = s.range(0, 21000, 1000).select(F.explode(F.array(*[F.lit(f"chr{k}") for k in range(1, 6)])).alias("chrom"), F.col("id").alias("chunk_start"))
    reference = starts.withColumn("seq", F.expr("substring(repeat('ACGTTGCAAGCT', 85), cast(chunk_start % 12 as int) + 1, 1000)"))
    return A.consensus_chunks(A.allele_calls(al(s, d), gaps=True), reference, 4, 0.3, 2)


def bam_varcall(s, d):
    reference = _reference(A.base_calls(al(s, d)))
    return A.call_variants(A.allele_calls(al(s, d)), reference, 1, least_depth=8, least_alt=2).select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "gt", F.array_join("filters", ",").alias("filters"), "dp")


def bam_varcall_normal(s, d):
    rows = al(s, d)
    first, second = (A.allele_calls(rows.where(f"event_id % 2 = {k}")) for k in (0, 1))
    called = A.call_variants(first, _reference(A.base_calls(rows)), 1, second, least_depth=4, most_normal=1)
    return called.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "gt", F.array_join("filters", ",").alias("filters"), "dp", "t_depth", "n_depth")


def bam_removeclipping(s, d):
    return A.remove_clipping(al(s, d)).select("event_id", "cigar", "seq", F.col("tags")["ZA"].alias("za"))


def bam_readgroup(s, d):
    return A.set_read_group(al(s, d), "new").select("event_id", F.col("tags")["RG"].alias("rg"))


def bam_concat(s, d):
    rows = al(s, d)
    return A.concat([rows, rows.where("mapq < 30")]).select("event_id", F.col("tags")["RG"].alias("rg"))


def bam_clean(s, d):
    return A.clean(al(s, d)).select("event_id", "mapq")


def bam_check(s, d):
    return A.check(al(s, d))


def bam_split(s, d):
    return A.split(al(s, d), size=1000).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("positions"))


def bam_stats(s, d):
    return A.stats(al(s, d))


def bam_stats_reads(s, d):
    return A.read_stats(al(s, d))


def bam_stats_flags(s, d):
    return A.flag_tally(al(s, d))


def bam_stats_tags(s, d):
    return A.tag_tally(al(s, d), ["CHROM", "MAPQ", "NH", "RG"])


def bam_stats_unique(s, d):
    return A.tag_tally(al(s, d), ["CHROM", "NM"], unique=True)


def bam_on_target(s, d):
    return A.on_target(al(s, d), KEY, rg(s, d).where("score > 990"))


def bam_tobed(s, d):
    return A.to_bed(al(s, d))


def bam_tobedpe(s, d):
    return A.to_bedpe(al(s, d))


def bam_extract(s, d):
    return ids(A.extract(al(s, d), KEY, rg(s, d).where("score > 995"), mates=True))


def bam_sample(s, d):
    return A.sample_names(al(s, d), 100, 2)


def bam_pileup(s, d):
    return A.pileup(al(s, d))


def vcf_count(s, d):
    sites = frame(s, d, "vr").select("var_id", "chrom", (F.col("pos") % 20000 + 1).alias("pos"), "ref", "alt", (F.col("sac0") + F.col("sac1")).alias("vcf_ref"), (F.col("sac2") + F.col("sac3")).alias("vcf_alt"))
    rows = A.count_alleles(A.allele_calls(al(s, d)), sites)
    return rows.select("var_id", "chrom", "pos", "ref", "alt", "ref_count", "alt_count", "depth", F.round("af", 9).alias("af"), F.round("vcf_af", 9).alias("vcf_af"), F.round("pvalue", 8).alias("pvalue"))


def bam_pir(s, d):
    sites = frame(s, d, "vr").select("var_id", "chrom", (F.col("pos") % 20000 + 1).alias("pos"), "ref", "alt")
    return A.informative_reads(al(s, d), sites, ["var_id"], names=False).select("var_id", "allele", "count")


def bam_phase(s, d):
    sites = frame(s, d, "vr").where("length(alt) = 1 and ref <> alt").groupBy("chrom", (F.col("pos") % 20000 + 1).alias("pos")).agg(F.min(F.struct("var_id", "ref", "alt")).alias("v")).select("chrom", "pos", "v.*")
    return A.phase(al(s, d), sites, "var_id")


QUERIES = {f.__name__: f for f in (
    flag_filter, bam_names, bam_contigs, bam_passed, bam_failed, bam_sort, unique_mapping, pair_keep, pair_remove, sane_pairs, tag_min, tag_max, tag_eq, unique_start, bam_region_include, bam_region_exclude, bam_region_within, bam_junctions, dups,
    best, discord, ref_count, span_count, span_count_stranded, span_count_details, bam_bedgraph, coverage_quantiles, expressed_regions, softclip, wps, base_call, bam_consensus, allele_calls, bam_tofasta, bam_varcall, bam_varcall_normal, bam_removeclipping,
    bam_readgroup, bam_concat, bam_clean, bam_check, bam_split, bam_stats, bam_stats_reads, bam_stats_flags, bam_stats_tags, bam_stats_unique, bam_on_target, bam_tobed, bam_tobedpe, bam_extract, bam_sample, bam_pileup, vcf_count, bam_pir, bam_phase,
)}

# The mate's flags, CIGAR blocks and spans of al, in SQL.
_AM = """am AS (SELECT a.* EXCLUDE (flag), CAST(a.flag + coalesce(b.flag & 16, 0) * 2 + coalesce(b.flag & 4, 0) * 2 AS INT) AS flag, b.chrom AS mate_chrom, b.pos AS mate_pos,
  CAST(CASE event_id % 6 WHEN 0 THEN 50 WHEN 1 THEN 40 WHEN 2 THEN 45 WHEN 3 THEN 60 WHEN 4 THEN 150 ELSE 40 END AS BIGINT) AS rlen
  FROM al a LEFT JOIN (SELECT event_id AS e, flag, chrom, pos FROM al) b ON b.e = CASE WHEN a.event_id % 2 = 0 THEN a.event_id + 1 ELSE a.event_id - 1 END)"""
_BL = """bl AS (SELECT event_id, name, flag, chrom, pos + o AS s, pos + o + n AS e, r AS rs, n, seq, qual, mapq FROM am, LATERAL (SELECT unnest(CASE event_id % 6
  WHEN 0 THEN [{'o': 0, 'n': 50, 'r': 0}] WHEN 1 THEN [{'o': 0, 'n': 40, 'r': 10}] WHEN 2 THEN [{'o': 0, 'n': 20, 'r': 0}, {'o': 20, 'n': 25, 'r': 25}]
  WHEN 3 THEN [{'o': 0, 'n': 20, 'r': 0}, {'o': 30, 'n': 30, 'r': 20}] WHEN 4 THEN [{'o': 0, 'n': 25, 'r': 0}, {'o': 125, 'n': 25, 'r': 25}] ELSE [{'o': 0, 'n': 40, 'r': 0}] END, recursive := true)) t(n, o, r))""".replace("t(n, o, r)", "t")
_RGM = """rgm AS (SELECT region_id, score, chrom, strand, "start" % 20000 AS s, "start" % 20000 + "end" - "start" AS e FROM rg)"""


def sql(body: str, more: str = "", names: str = "al") -> str:
    """DuckDB SQL over am (alignments with mate flags) and the CTEs ``more``."""
    return with_sql(names, f"WITH {_AM}{', ' + more if more else ''}\n{body}" if not body.strip().startswith("WITH") else f"WITH {_AM}{', ' + more if more else ''}, {body.strip()[5:]}")


_DEPTH = """WITH p AS (SELECT chrom, unnest(generate_series(s, e - 1)) AS pos FROM bl WHERE flag & 1796 = 0), d AS (SELECT chrom, pos, count(*) AS depth FROM p GROUP BY ALL) """
_HIT = "EXISTS (SELECT 1 FROM bl JOIN rgm ON rgm.chrom = bl.chrom AND rgm.score > {score} AND bl.s < rgm.e AND bl.e > rgm.s WHERE bl.event_id = am.event_id)"
_CALLS = """WITH b AS (SELECT chrom, s + i AS pos, substr(seq, CAST(rs + i + 1 AS INT), 1) AS call, ascii(substr(qual, CAST(rs + i + 1 AS INT), 1)) - 33 AS q, flag & 16 AS m FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM bl WHERE flag & 1796 = 0)),
c AS (SELECT chrom, pos, call, m FROM b WHERE q >= {q} UNION ALL SELECT chrom, pos + 20 + i, 'del', flag & 16 FROM (SELECT *, unnest(generate_series(0, 9)) AS i FROM am WHERE flag & 1796 = 0 AND event_id % 6 = 3) UNION ALL SELECT chrom, pos + 19, 'ins', flag & 16 FROM am WHERE flag & 1796 = 0 AND event_id % 6 = 2),
g AS (SELECT chrom, pos, count(*) FILTER (call = 'A') AS "A", count(*) FILTER (call = 'C') AS "C", count(*) FILTER (call = 'G') AS "G", count(*) FILTER (call = 'T') AS "T", count(*) FILTER (call = 'N') AS "N",
 count(*) FILTER (call = 'ins') AS ins, count(*) FILTER (call = 'del') AS del, count(*) FILTER (length(call) = 1 AND m = 0) AS plus, count(*) FILTER (length(call) = 1 AND m <> 0) AS minus, count(*) FILTER (length(call) = 1) AS depth FROM c GROUP BY chrom, pos)
"""
# Calls by position: an indel takes the place of the base ahead of it (the twentieth, where there is one).
_ALLELES = """WITH b AS (SELECT event_id, chrom, s + i AS pos, rs + i AS ra, substr(seq, CAST(rs + i + 1 AS INT), 1) AS call, ascii(substr(qual, CAST(rs + i + 1 AS INT), 1)) - 33 AS q, flag & 16 AS m, seq FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM bl WHERE flag & 1796 = 0)),
c AS (SELECT chrom, pos, CASE WHEN event_id % 6 = 2 AND ra = 19 THEN '+' || substr(seq, 21, 5) WHEN event_id % 6 = 3 AND ra = 19 THEN '-10' ELSE call END AS call, m FROM b WHERE q >= {q})"""
_MD5_BASE = "translate(left(md5(chrom || ':' || {0}), 1), '0123456789abcdef', 'ACGTACGTACGTACGT')"
#: Failures x before success r, of probability p.
_PMF = "CASE WHEN {x} < 0 OR {p} <= 0 THEN 0.0::DOUBLE WHEN {p} >= 1 THEN CASE WHEN {x} = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE exp(lgamma({x} + {r}) - lgamma({r}) - lgamma({x} + 1) + {r} * ln({p}) + {x} * ln(1 - {p})) END"
_IUPAC = "CASE x WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' WHEN 'CGT' THEN 'B' WHEN 'AGT' THEN 'D' WHEN 'ACT' THEN 'H' WHEN 'ACG' THEN 'V' ELSE 'N' END"
_SITES = "sites AS (SELECT var_id, chrom, pos % 20000 + 1 AS pos, ref, alt FROM vr)"
ORACLE_SQL = {
    "wps": with_sql("iv", """WITH f AS (SELECT chrom, "start" AS s, "end" AS e, row_number() OVER () AS id FROM iv), a AS (SELECT chrom, unnest(generate_series(s + 10, e - 10)) AS pos FROM f WHERE e - s >= 20),
c AS (SELECT DISTINCT chrom, id, unnest(list_concat(generate_series(greatest(s - 9, 0), s + 10), generate_series(greatest(e - 10, 0), e + 9))) AS pos FROM f),
u AS (SELECT chrom, pos, 1 AS x, 0 AS y FROM a UNION ALL SELECT chrom, pos, 0, 1 FROM c) SELECT chrom, pos, CAST(sum(x) - sum(y) AS BIGINT) AS wps FROM u GROUP BY chrom, pos"""),
    "bam_sample": sql("WITH n AS (SELECT DISTINCT name FROM am), r AS (SELECT l.list, name, row_number() OVER (PARTITION BY l.list ORDER BY md5((l.list + 1) || ':' || name), name) AS k FROM n, (VALUES (0), (1)) AS l(list)) SELECT CAST(list AS INT) AS list, name FROM r WHERE k <= 100"),
    "flag_filter": sql("SELECT event_id FROM am WHERE flag & 3844 = 0 AND flag & 3 = 3"),
    "bam_names": sql("SELECT event_id FROM am WHERE name IN (SELECT 'r' || l_orderkey FROM iv)", "", "al iv"),
    "bam_contigs": sql("SELECT event_id FROM am WHERE chrom IN ('chr1', 'chr3')"),
    "bam_passed": sql("SELECT event_id FROM am WHERE mapq >= 10 AND flag & 3844 = 0 AND nh = 1"),
    "bam_failed": sql("SELECT * FROM (SELECT event_id, CASE WHEN mapq < 10 THEN 'mapq' WHEN flag & 3844 <> 0 THEN 'flags' WHEN coalesce(nh, 0) <> 1 THEN 'nh' END AS failed FROM am) WHERE failed IS NOT NULL"),
    "bam_sort": sql("SELECT event_id, chrom, pos FROM am"),
    "unique_mapping": sql("SELECT event_id FROM am WHERE coalesce(nh = 1, mapq <> 0)"),
    "pair_keep": sql("SELECT event_id FROM am WHERE name IN (SELECT name FROM am WHERE mapq >= 40)"),
    "pair_remove": sql("SELECT event_id FROM am WHERE name NOT IN (SELECT name FROM am WHERE mapq < 10)"),
    "sane_pairs": sql("SELECT event_id FROM am WHERE flag & 12 = 0 AND chrom = mate_chrom AND (flag & 16 <> 0) <> (flag & 32 <> 0)"),
    "tag_min": sql("SELECT event_id FROM am WHERE score_as >= 20 AND mapq >= 30"),
    "tag_max": sql("SELECT event_id FROM am WHERE nm <= 2 AND abs(tlen) <= 200"),
    "tag_eq": sql("SELECT event_id FROM am WHERE nh = 1 AND read_group = 'rg1'"),
    "unique_start": sql("SELECT event_id, chrom, pos FROM (SELECT *, row_number() OVER (PARTITION BY chrom, flag & 16, CASE WHEN flag & 16 <> 0 THEN pos + rlen ELSE pos END ORDER BY event_id) AS k FROM am WHERE flag & 4 = 0) WHERE k = 1"),
    "bam_region_include": sql(f"SELECT event_id FROM am WHERE {_HIT.format(score=990)}", f"{_BL}, {_RGM}", "al rg"),
    "bam_region_exclude": sql(f"SELECT event_id FROM am WHERE NOT {_HIT.format(score=990)}", f"{_BL}, {_RGM}", "al rg"),
    "bam_region_within": sql("SELECT event_id FROM am WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.event_id = am.event_id AND NOT EXISTS (SELECT 1 FROM rgm WHERE rgm.score > 990 AND rgm.chrom = bl.chrom AND rgm.s <= bl.s AND bl.e <= rgm.e))", f"{_BL}, {_RGM}", "al rg"),
    "bam_junctions": sql("SELECT event_id FROM am WHERE event_id % 6 <> 4 OR EXISTS (SELECT 1 FROM am b WHERE b.event_id % 6 = 4 AND b.mapq > 30 AND b.chrom = am.chrom AND b.pos = am.pos)"),
    "dups": sql("""WITH k AS (SELECT *, CAST(floor(tlen / 100) AS INT) AS t FROM am WHERE flag & 2308 = 0), w AS (SELECT name, row_number() OVER (PARTITION BY chrom, pos, t, CASE WHEN t = 0 THEN mate_chrom END, CASE WHEN t = 0 THEN mate_pos END ORDER BY mapq DESC, event_id) AS n FROM k)
SELECT event_id, name IN (SELECT name FROM w WHERE n > 1) AS duplicate FROM am"""),
    "best": sql("SELECT event_id, CAST(CASE WHEN event_id % 47 > score_as THEN 1 ELSE 0 END AS INT) AS source FROM am WHERE flag & 4 = 0"),
    "discord": sql("SELECT event_id, CASE WHEN flag & 4 <> 0 OR flag & 8 <> 0 THEN 'orphan' WHEN chrom <> mate_chrom OR (flag & 16 <> 0) = (flag & 32 <> 0) OR abs(pos + rlen - mate_pos) > 5000 THEN 'discordant' ELSE 'concordant' END AS kind FROM am"),
    "ref_count": sql('SELECT chrom, count(*) AS "count" FROM am WHERE flag & 1284 = 0 AND flag & 64 <> 0 GROUP BY chrom'),
    "span_count": sql('SELECT region_id, count(DISTINCT am.name) AS "count" FROM rgm LEFT JOIN am ON am.chrom = rgm.chrom AND am.flag & 3844 = 0 AND am.pos < rgm.e AND am.pos + rlen > rgm.s GROUP BY region_id', _RGM, "al rg"),
    "span_count_stranded": sql("""SELECT region_id, count(DISTINCT am.name) AS "count" FROM rgm LEFT JOIN am ON am.chrom = rgm.chrom AND am.flag & 3844 = 0 AND am.pos < rgm.e AND am.pos + rlen > rgm.s
AND rgm.strand = CASE WHEN (flag & 16 <> 0) <> (flag & 128 <> 0) THEN '-' ELSE '+' END GROUP BY region_id""", _RGM, "al rg"),
    "bam_bedgraph": sql(_DEPTH + """, r AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, depth ORDER BY pos) AS k FROM d) SELECT chrom, min(pos) AS "start", max(pos) + 1 AS "end", depth FROM r GROUP BY chrom, depth, k""", _BL),
    "coverage_quantiles": sql(_DEPTH + "SELECT " + ", ".join(f"quantile_cont(depth, {p / 100}) AS q{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + ", min(depth) AS min, max(depth) AS max FROM d", _BL),
    "expressed_regions": sql(_DEPTH + """, k AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 11 THEN 0 ELSE 1 END AS n FROM d WHERE depth >= 8), g AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY pos) AS i FROM k)
SELECT chrom, min(pos) AS "start", max(pos) + 1 AS "end", max(depth) AS peak FROM g GROUP BY chrom, i HAVING max(pos) + 1 - min(pos) > 20""", _BL),
    "softclip": sql('SELECT chrom, CASE event_id % 6 WHEN 1 THEN pos ELSE pos + 40 END AS pos, count(*) AS "count" FROM am WHERE flag & 4 = 0 AND event_id % 6 IN (1, 5) GROUP BY ALL'),
    "base_call": sql(_CALLS.format(q=10) + "SELECT * FROM g", _BL),
    "bam_consensus": sql(_CALLS.format(q=0) + f""", t AS (SELECT *, "A" + "C" + "G" + "T" AS k FROM g), u AS (SELECT chrom, pos, k, concat(CASE WHEN "A" >= 0.3 * k THEN 'A' END, CASE WHEN "C" >= 0.3 * k THEN 'C' END, CASE WHEN "G" >= 0.3 * k THEN 'G' END, CASE WHEN "T" >= 0.3 * k THEN 'T' END) AS x FROM t)
SELECT chrom, pos, CASE WHEN k >= 4 THEN {_IUPAC} ELSE 'N' END AS base FROM u""", _BL),
    "bam_removeclipping": sql("SELECT event_id, regexp_replace(cigar, '\\d+S', '', 'g') AS cigar, CASE event_id % 6 WHEN 1 THEN substr(seq, 11) WHEN 5 THEN left(seq, 40) ELSE seq END AS seq, CASE event_id % 6 WHEN 1 THEN '10' WHEN 5 THEN '0' END AS za FROM am"),
    "bam_readgroup": sql("SELECT event_id, 'new' AS rg FROM am"),
    "bam_concat": sql("SELECT event_id, read_group AS rg FROM am UNION ALL SELECT event_id, read_group || '_1' FROM am WHERE mapq < 30"),
    "bam_clean": sql("SELECT event_id, CASE WHEN flag & 4 <> 0 THEN 0 ELSE mapq END AS mapq FROM am"),
    "bam_check": sql("""SELECT count(*) AS "rows", 0::BIGINT AS unnamed, count(*) FILTER (length(seq) <> length(qual)) AS lengths, (SELECT count(*) FROM (SELECT name FROM am WHERE flag & 2304 = 0 GROUP BY name HAVING count(DISTINCT flag & 192) < 2)) AS single FROM am"""),
    "bam_split": sql("""WITH p AS (SELECT chrom, pos, count(*) AS k FROM am GROUP BY ALL), q AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p)
SELECT chrom || '.' || CAST(a // 1000 AS BIGINT) AS part, CAST(sum(k) AS BIGINT) AS n, count(*) AS positions FROM q GROUP BY 1"""),
    "bam_stats": sql("SELECT count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1024 <> 0) AS duplicates, count(*) FILTER (flag & 256 <> 0) AS secondary, count(*) FILTER (flag & 2 <> 0) AS proper, quantile_cont(CASE WHEN flag & 66 = 66 THEN abs(tlen) END, 0.5) AS insert_median FROM am"),
    "span_count_details": sql("""WITH h AS (SELECT region_id, am.name, arg_min({'f': flag, 't': abs(tlen)}, (pos, pos + rlen, flag, abs(tlen))) AS r FROM rgm JOIN am ON am.chrom = rgm.chrom AND am.flag & 3844 = 0 AND am.pos < rgm.e AND am.pos + rlen > rgm.s GROUP BY ALL),
k AS (SELECT region_id, count(*) AS "count", count(*) FILTER (r.f & 3 = 3) AS proper, count(*) FILTER (r.f & 3 = 1) AS not_proper, avg(CASE WHEN r.f & 3 = 3 THEN r.t END) AS insert, count(*) FILTER (r.f & 3 = 3 AND (r.f & 16 <> 0) = (r.f & 32 <> 0)) AS inverted FROM h GROUP BY region_id)
SELECT rgm.region_id, coalesce("count", 0) AS "count", coalesce(proper, 0) AS proper, coalesce(not_proper, 0) AS not_proper, CASE WHEN proper > 0 THEN round(not_proper / proper, 9) ELSE 0.0 END AS ratio, round(coalesce(insert, 0.0), 6) AS insert, coalesce(inverted, 0) AS inverted FROM rgm LEFT JOIN k USING (region_id)""", _RGM, "al rg"),
    "bam_stats_reads": sql("""WITH t AS (SELECT *, flag & 128 = 0 AS f, flag & 3584 = 0 AS k, flag & 1028 = 0 AS m, coalesce(nh = 1, mapq <> 0) AS u, CASE event_id % 6 WHEN 1 THEN substr(qual, 11) WHEN 5 THEN left(qual, 40) ELSE qual END AS q, CASE WHEN event_id % 6 IN (1, 5) THEN 40 ELSE 50 END AS n FROM am)
SELECT count(*) FILTER (f) AS total, count(*) FILTER (f AND k AND flag & 4 = 0) AS mapped, count(*) FILTER (f AND k AND flag & 4 <> 0) AS unmapped, count(*) FILTER (f AND k AND flag & 4 = 0 AND NOT u) AS multiple, CAST(sum(n) FILTER (m) AS BIGINT) AS total_bases, CAST(sum(length(regexp_replace(q, '[^?-~]', '', 'g'))) FILTER (m) AS BIGINT) AS q30_bases,
count(*) FILTER (m AND event_id % 6 = 4) AS gapped, quantile_cont(CASE WHEN f AND k AND flag & 4 = 0 AND flag & 3 = 3 AND chrom = mate_chrom THEN abs(tlen) END, 0.5) AS insert_median FROM t"""),
    "bam_stats_flags": sql('WITH b AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) AS flag) SELECT CAST(b.flag AS INT) AS flag, count(*) AS "count" FROM am JOIN b ON am.flag & b.flag <> 0 WHERE am.flag & 128 = 0 GROUP BY b.flag'),
    "bam_stats_tags": sql("""WITH t AS (SELECT unnest([{'tag': 'CHROM', 'value': chrom}, {'tag': 'MAPQ', 'value': CAST(mapq AS VARCHAR)}, {'tag': 'NH', 'value': CAST(nh AS VARCHAR)}, {'tag': 'RG', 'value': read_group}], recursive := true) FROM am WHERE flag & 128 = 0 AND flag & 3588 = 0) SELECT tag, value, count(*) AS "count" FROM t GROUP BY tag, value"""),
    "bam_stats_unique": sql("""WITH t AS (SELECT unnest([{'tag': 'CHROM', 'value': chrom}, {'tag': 'NM', 'value': CAST(nm AS VARCHAR)}], recursive := true) FROM am WHERE flag & 128 = 0 AND flag & 3588 = 0 AND coalesce(nh = 1, mapq <> 0)) SELECT tag, value, count(*) AS "count" FROM t GROUP BY tag, value"""),
    "bam_on_target": sql(f"SELECT count(*) FILTER ({_HIT.format(score=990)}) AS on_target, count(*) FILTER (NOT {_HIT.format(score=990)}) AS off_target FROM am", f"{_BL}, {_RGM}", "al rg"),
    "bam_tobed": sql("""SELECT chrom, pos AS "start", pos + rlen AS "end", name, mapq AS score, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM am WHERE flag & 4 = 0 AND flag & 64 <> 0"""),
    "bam_tobedpe": sql("""SELECT a.chrom AS chrom1, a.pos AS start1, a.pos + a.rlen AS end1, b.chrom AS chrom2, b.pos AS start2, b.pos + b.rlen AS end2, a.name, a.mapq AS score, CASE WHEN a.flag & 16 <> 0 THEN '-' ELSE '+' END AS strand1, CASE WHEN b.flag & 16 <> 0 THEN '-' ELSE '+' END AS strand2
FROM am a JOIN am b ON a.name = b.name AND a.flag & 64 <> 0 AND b.flag & 128 <> 0 WHERE a.flag & 2308 = 0 AND b.flag & 2308 = 0"""),
    "bam_extract": sql(f"SELECT event_id FROM am a WHERE name IN (SELECT name FROM am WHERE {_HIT.format(score=995)})", f"{_BL}, {_RGM}", "al rg"),
    "bam_pileup": sql("""WITH b AS (SELECT name, flag, chrom, s + i AS pos, substr(seq, CAST(rs + i + 1 AS INT), 1) AS c FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM bl WHERE flag & 1796 = 0)), l AS (SELECT chrom, pos, name, CASE WHEN flag & 16 <> 0 THEN lower(c) ELSE c END AS c FROM b)
SELECT chrom, pos, count(*) AS depth, string_agg(c, '' ORDER BY name, c) AS bases FROM l GROUP BY chrom, pos""", _BL),
    "bam_varcall": sql(_ALLELES.format(q=0) + f""", k AS (SELECT chrom, pos, call, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT *, {_MD5_BASE.format('pos')} AS base, sum(n) OVER (PARTITION BY chrom, pos) AS depth FROM k),
s AS (SELECT *, 1 - greatest(1.0::DOUBLE, ceil(depth * 0.02::DOUBLE)) / depth AS p FROM p), t AS (SELECT *, {_PMF.format(x='(depth - n)', r='depth', p='p')} AS hom, {_PMF.format(x='n', r='((depth + 1) // 2)', p='0.5::DOUBLE')} AS het, CASE WHEN p = 0 THEN 1.0::DOUBLE ELSE {_PMF.format(x='n', r='depth', p='p')} END AS noise FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, call) AS i, bool_or(call[1] = '-') OVER (PARTITION BY chrom, pos) AS gone, CASE WHEN hom > het * (1 + 1e-9) AND hom > noise * (1 + 1e-9) THEN 'hom' WHEN het > hom * (1 + 1e-9) AND het > noise * (1 + 1e-9) THEN 'het' END AS kind FROM t WHERE call <> base),
w AS (SELECT *, CASE WHEN gone THEN {' || '.join(_MD5_BASE.format(f'(pos + {j})') for j in range(1, 11))} ELSE '' END AS tail FROM a),
g AS (SELECT chrom, pos, any_value(base) || any_value(tail) AS ref, string_agg(CASE call[1] WHEN '+' THEN base || substr(call, 2) || tail WHEN '-' THEN base ELSE call || tail END, ',' ORDER BY i) AS alt, list(i ORDER BY i) FILTER (kind IS NOT NULL) AS good, min(i) FILTER (kind = 'hom') AS hom, CAST(any_value(depth) AS BIGINT) AS dp, sum(n) AS other, count(*) AS alts, count(*) FILTER (call[1] IN ('+', '-')) AS indels, max(n) AS top FROM w GROUP BY chrom, pos)
SELECT chrom, pos + 1 AS pos, ref, alt, CASE WHEN hom IS NOT NULL THEN hom || '/' || hom WHEN good IS NULL THEN '0/0' WHEN len(good) = 1 THEN '0/' || good[1] WHEN len(good) = 2 THEN good[1] || '/' || good[2] ELSE './.' END AS gt,
 nullif(concat_ws(',', CASE WHEN good IS NULL THEN 'low_pred_call_germline' END, CASE WHEN alts + CASE WHEN dp > other THEN 1 ELSE 0 END > 3 THEN 'multi_alleles' END, CASE WHEN indels > 1 THEN 'multi_indel' END, CASE WHEN dp < 8 THEN 'min_depth' END, CASE WHEN top < 2 THEN 'min_abs_count' END), '') AS filters, dp FROM g""", _BL),
    "bam_tofasta": sql(_ALLELES.format(q=0) + f""", a AS (SELECT chrom, pos, call FROM c UNION ALL SELECT chrom, pos + 20 + i, '*' FROM (SELECT *, unnest(generate_series(0, 9)) AS i FROM am WHERE flag & 1796 = 0 AND event_id % 6 = 3)),
k AS (SELECT chrom, pos, call, count(*) AS n FROM a GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY chrom, pos) AS depth FROM k), v AS (SELECT chrom, pos, max(depth) AS depth, list(call ORDER BY call) FILTER (n >= greatest(ceil(depth * 0.3), 2)) AS al, string_agg(call, '' ORDER BY call) FILTER (n >= greatest(ceil(depth * 0.3), 2) AND call IN ('A', 'C', 'G', 'T')) AS x FROM w GROUP BY chrom, pos),
r AS (SELECT 'chr' || unnest([1, 2, 3, 4, 5]) AS chrom, p AS pos, substr('ACGTTGCAAGCT', p % 12 + 1, 1) AS base FROM range(21000) AS t(p)),
o AS (SELECT r.chrom, r.pos, CASE WHEN coalesce(depth, 0) < 4 OR al IS NULL THEN lower(base) WHEN len(al) = 1 THEN CASE WHEN al[1] = '*' THEN '' WHEN al[1][1] = '-' THEN base WHEN al[1][1] = '+' THEN base || substr(al[1], 2) ELSE al[1] END WHEN x IS NULL THEN lower(base) ELSE {_IUPAC} END AS s FROM r LEFT JOIN v ON v.chrom = r.chrom AND v.pos = r.pos)
SELECT chrom, CAST(pos // 1000 * 1000 AS BIGINT) AS chunk_start, string_agg(s, '' ORDER BY pos) AS seq FROM o GROUP BY chrom, pos // 1000""", _BL),
    "allele_calls": sql(_ALLELES.format(q=10) + 'SELECT chrom, pos, call, CAST(count(*) FILTER (m = 0) AS BIGINT) AS plus, CAST(count(*) FILTER (m <> 0) AS BIGINT) AS minus, count(*) AS "count" FROM c GROUP BY ALL', _BL),
    "vcf_count": sql(_ALLELES.format(q=0) + """, k AS (SELECT chrom, pos + 1 AS pos, call, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT chrom, pos, sum(n) AS depth FROM k GROUP BY ALL),
j AS (SELECT s.*, coalesce((SELECT n FROM k WHERE k.chrom = s.chrom AND k.pos = s.pos AND k.call = s.ref), 0) AS ref_count, coalesce((SELECT n FROM k WHERE k.chrom = s.chrom AND k.pos = s.pos AND k.call = CASE WHEN length(s.alt) = 1 THEN s.alt WHEN starts_with(s.alt, s.ref) THEN '+' || substr(s.alt, 2) ELSE '+' || s.alt END), 0) AS alt_count, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
 sac0 + sac1 AS b, sac2 + sac3 AS a FROM sites s LEFT JOIN t ON t.chrom = s.chrom AND t.pos = s.pos),
x AS (SELECT *, a + b + alt_count + ref_count AS n, sqrt(n * greatest(0.0, abs(a * ref_count - b * alt_count) - n / 2.0) ** 2 / nullif((a + alt_count) * (b + ref_count) * (a + b) * (alt_count + ref_count), 0) / 2.0) AS z FROM j)
SELECT var_id, chrom, pos, ref, alt, ref_count, alt_count, depth, CASE WHEN depth > 0 THEN round(alt_count / depth, 9) END AS af, CASE WHEN a + b > 0 THEN round(a / (a + b), 9) END AS vcf_af,
 CASE WHEN (b = 0 AND ref_count = 0) OR (a = 0 AND alt_count = 0) THEN 1.0 WHEN a + b > 0 AND alt_count + ref_count > 0 THEN round(1 - 2 / sqrt(pi()) * least(z, 6.0) / 1200 * list_sum(list_transform(range(401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(0 - power(least(z, 6.0) * i / 400, 2)))), 8) END AS pvalue FROM x""",
 f"{_BL}, {_SITES.replace('ref, alt', 'ref, alt, sac0, sac1, sac2, sac3')}", "al vr"),
    "bam_pir": sql("""WITH h AS (SELECT v.var_id, bl.name, substr(bl.seq, CAST(bl.rs + v.pos - 1 - bl.s + 1 AS INT), 1) AS c, v.ref, v.alt FROM sites v JOIN bl ON bl.chrom = v.chrom AND bl.s <= v.pos - 1 AND v.pos - 1 < bl.e)
SELECT var_id, CASE c WHEN ref THEN 'ref' WHEN alt THEN 'alt' ELSE 'other' END AS allele, count(DISTINCT name) AS "count" FROM h GROUP BY ALL""", f"{_BL}, {_SITES}", "al vr"),
}
