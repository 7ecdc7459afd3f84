"""Queries of the interval operators."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import intervals as I
from .fixtures import frame, with_sql

IV_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
OVER = '(q."start" < r."end" AND q."end" > r."start")'
STRAND = "(q.strand = r.strand)"


def iv(s, d):
    return frame(s, d, "iv")


def rg(s, d):
    return frame(s, d, "rg")


def bed_overlap(s, d):
    pairs = I.range_join(iv(s, d), rg(s, d))
    return pairs.select(*IV_KEY, "chrom", "start", "end", F.col("r_region_id").alias("region_id"), F.greatest("start", "r_start").alias("o_start"), F.least("end", "r_end").alias("o_end"))


def bed_overlap_dealt(s, d):
    pairs = I.range_join(iv(s, d), rg(s, d), bin_size=2000, deal=50)
    return pairs.select(*IV_KEY, F.col("r_region_id").alias("region_id"))


def bed_contains(s, d):
    return I.range_join(rg(s, d), iv(s, d), contained=True).select("region_id", *[F.col(f"r_{k}").alias(k) for k in IV_KEY])


def bed_semi(s, d):
    return I.semi(iv(s, d), rg(s, d).where("score > 985"))


def bed_anti(s, d):
    return I.semi(iv(s, d), rg(s, d).where("score > 985"), keep=False, stranded=True)


def bed_count(s, d):
    return I.count_overlaps(rg(s, d), iv(s, d), ["region_id"]).select("region_id", "chrom", "start", "end", "strand", "count")


def bed_count_ns(s, d):
    return I.count_overlaps(rg(s, d), iv(s, d), ["region_id"], stranded=False).select("region_id", "count")


def bed_nearest(s, d):
    q = rg(s, d)
    refs = iv(s, d).where("score > 30000").select("chrom", "start", "end", "name", "strand")
    return I.nearest(q, refs, ["region_id"], up=100, down=200, stranded=False).select("region_id", "nearest", "distance")


def bed_reduce(s, d):
    return I.reduce_regions(iv(s, d).withColumn("score", F.lit(1.0)))


def bed_reduce_extend(s, d):
    return I.reduce_regions(iv(s, d), extend=20, count_score=True)


def bed_reduce_ns(s, d):
    return I.reduce_regions(iv(s, d), stranded=False, count_score=True)


def bed_resize(s, d):
    return I.resize(iv(s, d), five=60, three=15, longest=40).select(*IV_KEY, "start", "end", "strand")


def bed_clean(s, d):
    return I.clean_score(iv(s, d)).select(*IV_KEY, "score")


def bed_to3(s, d):
    return I.to_bed3(iv(s, d))


def bed_to6(s, d):
    return I.to_bed6(rg(s, d))


def bed_stats(s, d):
    return I.stats(iv(s, d))


def bed_stats_chrom(s, d):
    return iv(s, d).groupBy("chrom").agg(F.count(F.lit(1)).alias("regions"))


def bed_bedgraph(s, d):
    return I.depth(iv(s, d))


def bed_bedgraph_zero(s, d):
    return I.depth(rg(s, d), zero=True)


def bed_depth_positions(s, d):
    return I.depth_at(rg(s, d))


def bed_split_merge(s, d):
    return I.split_segments(iv(s, d).unionByName(rg(s, d), allowMissingColumns=True))


def bed_merge(s, d):
    return I.merge_files([iv(s, d), rg(s, d)])


def bed_sort(s, d):
    from pyspark.sql import Window

    from ..functions.columns import natural_key

    order = [natural_key(F.col("chrom")), "start", "end", "strand", "region_id"]
    return I.sort_regions(rg(s, d)).withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy(*order))).select("region_id", "chrom", "start", "end", "rank")


def bed_to_bedpe(s, d):
    rows = rg(s, d)
    return I.to_bedpe(rows.where("score < 950"), rows.where("score >= 950"), ["region_id"])


def bedpe_to_bed(s, d):
    return I.from_bedpe(bed_to_bedpe(s, d))


def bedpe_split(s, d):
    return I.from_bedpe(bed_to_bedpe(s, d), "split")


def contigs(s, d):
    return iv(s, d).groupBy("chrom").agg(F.max("end").alias("length"))


def fasta_bins(s, d):
    return I.tile(contigs(s, d), 1000, 400)


def bin_counts(s, d):
    return I.bin_counts(iv(s, d), 50, stranded=True)


def bin_counts_all(s, d):
    return I.bin_counts(iv(s, d), 500, contigs=contigs(s, d))


def position_counts(s, d):
    return I.position_counts(iv(s, d), "start")


_ISLANDS = """
WITH e AS (SELECT *, "start" - {x} AS s, "end" + {x} AS e FROM ivs),
f AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY chrom{p} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM e),
g AS (SELECT *, sum(n) OVER (PARTITION BY chrom{p} ORDER BY s, e, n DESC ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT chrom, min("start") AS "start", max("end") AS "end", string_agg(DISTINCT name, '|' ORDER BY name) AS name, {score} AS score, {strand} AS strand
FROM g GROUP BY chrom{p}, island"""


def islands_sql(extend: int = 0, stranded: bool = True, score: str = "CAST(count(*) AS DOUBLE)") -> str:
    body = _ISLANDS.format(x=extend, p=", strand" if stranded else "", score=score, strand="strand" if stranded else "'*'").replace("FROM ivs", "FROM iv")
    return with_sql("iv", body)


_PE = """
WITH p AS (
  SELECT a.name, a.chrom AS chrom1, a."start" AS start1, a."end" AS end1, b.chrom AS chrom2, b."start" AS start2, b."end" AS end2,
         greatest(a.score, b.score) AS score, a.strand AS strand1, b.strand AS strand2,
         row_number() OVER (PARTITION BY a.name ORDER BY
           CASE WHEN a.chrom = b.chrom AND a.strand <> b.strand THEN 0 ELSE 1 END,
           CASE WHEN a.chrom = b.chrom AND a.strand <> b.strand THEN
             CASE WHEN a."start" > b."end" THEN a."start" - b."end" WHEN a."end" < b."start" THEN b."start" - a."end" ELSE 0 END ELSE 0 END,
           a.region_id, b.region_id) AS n
  FROM rg a JOIN rg b ON a.name = b.name WHERE a.score < 950 AND b.score >= 950)
"""

QUERIES = {f.__name__: f for f in (
    bed_overlap, bed_overlap_dealt, bed_contains, bed_semi, bed_anti, bed_count, bed_count_ns, bed_nearest, bed_reduce, bed_reduce_extend, bed_reduce_ns, bed_resize,
    bed_clean, bed_to3, bed_to6, bed_stats, bed_stats_chrom, bed_bedgraph, bed_bedgraph_zero, bed_depth_positions, bed_split_merge, bed_merge, bed_sort,
    bed_to_bedpe, bedpe_to_bed, bedpe_split, fasta_bins, bin_counts, bin_counts_all, position_counts,
)}

_KEYS = ", ".join(IV_KEY)
_QKEYS = ", ".join(f"q.{k}" for k in IV_KEY)
_SWEEP = """
WITH e AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, "start" AS pos, 1 AS d FROM {t} UNION ALL SELECT chrom, "end", -1 FROM {t}) GROUP BY chrom, pos HAVING sum(d) <> 0),
w AS (SELECT chrom, pos, CAST(sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt FROM e)
"""
ORACLE_SQL = {
    "bed_overlap": with_sql("iv rg", f'SELECT {_QKEYS}, q.chrom, q."start", q."end", r.region_id, greatest(q."start", r."start") AS o_start, least(q."end", r."end") AS o_end FROM iv q JOIN rg r ON q.chrom = r.chrom AND {OVER}'),
    "bed_overlap_dealt": with_sql("iv rg", f'SELECT {_QKEYS}, r.region_id FROM iv q JOIN rg r ON q.chrom = r.chrom AND {OVER}'),
    "bed_contains": with_sql("iv rg", f'SELECT r.region_id, {_QKEYS} FROM iv q JOIN rg r ON q.chrom = r.chrom AND r."start" <= q."start" AND q."end" <= r."end"'),
    "bed_semi": with_sql("iv rg", f"SELECT * FROM iv q WHERE EXISTS (SELECT 1 FROM rg r WHERE r.score > 985 AND r.chrom = q.chrom AND {OVER})"),
    "bed_anti": with_sql("iv rg", f"SELECT * FROM iv q WHERE NOT EXISTS (SELECT 1 FROM rg r WHERE r.score > 985 AND r.chrom = q.chrom AND {OVER} AND {STRAND})"),
    "bed_count": with_sql("iv rg", f'SELECT r.region_id, r.chrom, r."start", r."end", r.strand, count(q.l_orderkey) AS "count" FROM rg r LEFT JOIN iv q ON q.chrom = r.chrom AND {OVER} AND {STRAND} GROUP BY ALL'),
    "bed_count_ns": with_sql("iv rg", f'SELECT r.region_id, count(q.l_orderkey) AS "count" FROM rg r LEFT JOIN iv q ON q.chrom = r.chrom AND {OVER} GROUP BY ALL'),
    "bed_nearest": with_sql("iv rg", """
WITH c AS (
  SELECT q.region_id, r.name, r.strand, r."start", r."end",
         CASE WHEN r.strand = '-' THEN -1 ELSE 1 END * CASE WHEN r."start" > q."end" THEN q."end" - r."start" WHEN r."end" < q."start" THEN q."start" - r."end" ELSE 0 END AS d
  FROM rg q JOIN iv r ON q.chrom = r.chrom AND r.score > 30000 AND r."start" <= q."end" + 200 AND r."end" >= q."start" - 200),
k AS (SELECT *, min(abs(d)) OVER (PARTITION BY region_id) AS m FROM c WHERE d >= -100 AND d <= 200),
b AS (SELECT region_id, string_agg(DISTINCT name, ',' ORDER BY name) AS nearest, arg_min(d, ("start", "end", name, d)) AS distance FROM k WHERE abs(d) = m GROUP BY region_id)
SELECT q.region_id, coalesce(b.nearest, '*') AS nearest, b.distance FROM rg q LEFT JOIN b USING (region_id)"""),
    "bed_reduce": islands_sql(),
    "bed_reduce_extend": islands_sql(20),
    "bed_reduce_ns": islands_sql(stranded=False),
    "bed_resize": with_sql("iv", f"""SELECT {_KEYS}, CASE WHEN "end" - "start" >= 40 THEN "start" ELSE greatest(0, "start" - CASE WHEN strand = '-' THEN 15 ELSE 60 END) END AS "start",
 CASE WHEN "end" - "start" >= 40 THEN "end" ELSE "end" + CASE WHEN strand = '-' THEN 60 ELSE 15 END END AS "end", strand FROM iv"""),
    "bed_clean": with_sql("iv", f"SELECT {_KEYS}, CAST(trunc(score) AS INT) AS score FROM iv"),
    "bed_to3": with_sql("iv", 'SELECT chrom, "start", "end" FROM iv'),
    "bed_to6": with_sql("rg", 'SELECT chrom, "start", "end", name, score, strand FROM rg'),
    "bed_stats": with_sql("iv", 'SELECT count(*) AS regions, CAST(sum("end" - "start") AS BIGINT) AS bases, avg("end" - "start") AS mean_size, quantile_cont("end" - "start", 0.5) AS median_size, min("end" - "start") AS min_size, max("end" - "start") AS max_size FROM iv'),
    "bed_stats_chrom": with_sql("iv", "SELECT chrom, count(*) AS regions FROM iv GROUP BY chrom"),
    "bed_bedgraph": with_sql("iv", _SWEEP.format(t="iv") + 'SELECT chrom, pos AS "start", nxt AS "end", depth FROM w WHERE depth > 0'),
    "bed_bedgraph_zero": with_sql("rg", _SWEEP.format(t="rg") + 'SELECT chrom, pos AS "start", nxt AS "end", depth FROM w WHERE nxt IS NOT NULL'),
    "bed_depth_positions": with_sql("rg", """WITH p AS (SELECT chrom, unnest(generate_series("start", "end" - 1)) AS pos FROM rg) SELECT chrom, pos, count(*) AS depth FROM p GROUP BY chrom, pos"""),
    "bed_split_merge": with_sql("iv rg", """
WITH u AS (SELECT chrom, "start", "end", name FROM iv UNION ALL SELECT chrom, "start", "end", name FROM rg),
f AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY chrom, name ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM u),
g AS (SELECT *, sum(n) OVER (PARTITION BY chrom, name ORDER BY "start", "end", n DESC ROWS UNBOUNDED PRECEDING) AS i FROM f),
m AS (SELECT chrom, name, min("start") AS s, max("end") AS e FROM g GROUP BY chrom, name, i),
c AS (SELECT DISTINCT chrom, unnest([s, e]) AS pos FROM m),
t AS (SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt FROM c)
SELECT t.chrom, t.pos AS "start", t.nxt AS "end", string_agg(DISTINCT m.name, '|' ORDER BY m.name) AS name FROM t JOIN m ON t.chrom = m.chrom AND m.s < t.nxt AND m.e > t.pos WHERE t.nxt IS NOT NULL GROUP BY ALL"""),
    "bed_merge": with_sql("iv rg", """
WITH u AS (SELECT chrom, "start", "end", name FROM iv UNION ALL SELECT chrom, "start", "end", name FROM rg),
f AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM u),
g AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY "start", "end", n DESC ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT chrom, min("start") AS "start", max("end") AS "end", string_agg(DISTINCT name, '|' ORDER BY name) AS name FROM g GROUP BY chrom, i"""),
    "bed_sort": with_sql("rg", 'SELECT region_id, chrom, "start", "end", row_number() OVER (PARTITION BY chrom ORDER BY "start", "end", strand, region_id) AS rank FROM rg'),
    "bed_to_bedpe": with_sql("rg", _PE + "SELECT chrom1, start1, end1, chrom2, start2, end2, name, score, strand1, strand2 FROM p WHERE n = 1"),
    "bedpe_to_bed": with_sql("rg", _PE + """SELECT chrom1 AS chrom, least(start1, start2) AS "start", greatest(end1, end2) AS "end", name, score, CASE WHEN strand1 = strand2 THEN strand1 ELSE '*' END AS strand
FROM p WHERE n = 1 AND chrom1 = chrom2 AND strand1 <> strand2 AND greatest(start1, start2) - least(end1, end2) <= 10000"""),
    "bedpe_split": with_sql("rg", _PE + """SELECT chrom1 AS chrom, start1 AS "start", end1 AS "end", name, score, strand1 AS strand FROM p WHERE n = 1 UNION ALL SELECT chrom2, start2, end2, name, score, strand2 FROM p WHERE n = 1"""),
    "fasta_bins": with_sql("iv", """WITH c AS (SELECT chrom, max("end") AS n FROM iv GROUP BY chrom), t AS (SELECT chrom, n, unnest(generate_series(0, n - 1, 400)) AS s FROM c) SELECT chrom, s AS "start", least(s + 1000, n) AS "end" FROM t"""),
    "bin_counts": with_sql("iv", """WITH p AS (SELECT chrom, strand, (CASE WHEN strand = '-' THEN "end" - 1 ELSE "start" END) // 50 * 50 AS b FROM iv) SELECT chrom, b AS "start", b + 50 AS "end", strand, count(*) AS "count" FROM p GROUP BY ALL"""),
    "bin_counts_all": with_sql("iv", """WITH c AS (SELECT chrom, max("end") AS n FROM iv GROUP BY chrom), t AS (SELECT chrom, unnest(generate_series(0, n - 1, 500)) AS b FROM c),
p AS (SELECT chrom, (CASE WHEN strand = '-' THEN "end" - 1 ELSE "start" END) // 500 * 500 AS b, count(*) AS k FROM iv GROUP BY ALL) SELECT t.chrom, t.b AS "start", t.b + 500 AS "end", coalesce(k, 0) AS "count" FROM t LEFT JOIN p ON p.chrom = t.chrom AND p.b = t.b"""),
    "position_counts": with_sql("iv", 'SELECT "start", count(*) AS "count" FROM iv GROUP BY "start"'),
}
