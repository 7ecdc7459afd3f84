"""Queries of the gene-model, table and statistics operators."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions import stats as S
from ..operators import genes as G
from ..operators import intervals as I
from ..operators import tables as T
from .fixtures import frame, table, with_sql

CDS_FROM, CDS_TO = 60, 40


def model(s, d):
    """The projection gx as a gene model: two transcripts a gene, three exons the first and two the second; a coding
    gene's CDS runs from CDS_FROM bases into its first exon to CDS_TO before the end of its last."""
    rows = frame(s, d, "gx").where("not (transcript = 2 and exon = 1)")
    rows = rows.withColumn("transcript_id", F.concat_ws(".", "gene_id", F.col("transcript").cast("string")))
    cds = rows.where("biotype = 'protein_coding'").withColumns({
        "start": F.when(F.col("exon") == 0, F.col("start") + CDS_FROM).otherwise(F.col("start")),
        "end": F.when(F.col("exon") == 2, F.col("end") - CDS_TO).otherwise(F.col("end")),
    })
    cols = [*G.GENE, "transcript_id", "start", "end"]
    return rows.select(*cols, F.lit("exon").alias("kind")).union(cds.select(*cols, F.lit("CDS").alias("kind")))


def iv(s, d):
    return frame(s, d, "iv")


def rg(s, d):
    return frame(s, d, "rg")


def gtf_genes(s, d):
    return G.genes(model(s, d))


def gtf_transcripts(s, d):
    return G.transcripts(model(s, d)).select("transcript_id", "start", "end")


def gtf_exons(s, d):
    return G.exons(model(s, d)).select("transcript_id", "start", "end")


def gtf_exons_combined(s, d):
    return G.combine(G.exons(model(s, d))).select("gene_id", "start", "end")


def gtf_introns(s, d):
    return G.introns(model(s, d)).select("transcript_id", "start", "end")


def gtf_junctions(s, d):
    return G.junctions(model(s, d)).select("gene_id", "start", "end")


def gtf_donors(s, d):
    return G.splice_sites(model(s, d), "donor").select("gene_id", "start", "end")


def gtf_tss(s, d):
    return G.starts(model(s, d)).select("gene_id", "start", "end")


def gtf_tlss(s, d):
    return G.translation_starts(model(s, d)).select("gene_id", "start", "end")


def gtf_orf(s, d):
    return G.reading_frames(model(s, d)).select("transcript_id", "start", "end")


def gtf_utr5(s, d):
    return G.utr(model(s, d), True).select("transcript_id", "start", "end")


def gtf_utr3(s, d):
    return G.utr(model(s, d), False).select("transcript_id", "start", "end")


def gtf_geneinfo(s, d):
    return G.info(model(s, d)).select("gene_id", "genomic_size", "transcript_size", "longest_intron")


def gtf_find_junction(s, d):
    found = G.introns(model(s, d)).select("chrom", "start", "end").distinct()
    return G.find_junction(model(s, d), found).select("chrom", "start", "end", "gene_id")


def gtf_classify(s, d):
    points = frame(s, d, "vr").select("var_id", "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.lit("*").alias("strand"))
    return G.classify(points, ["var_id"], model(s, d)).select("var_id", "region")


def annotate_gtf(s, d):
    return G.annotate(rg(s, d), ["region_id"], model(s, d)).select("region_id", "gene_ids")


def annotate_repeat(s, d):
    repeats = iv(s, d).withColumn("family", F.concat(F.lit("f"), "name"))
    return G.annotate_repeats(rg(s, d), ["region_id"], repeats).select("region_id", "repeats", "families")


def vcf_effect(s, d):
    parts = model(s, d).where("kind = 'CDS'").withColumn("seq", F.expr("substring(repeat('ATGGCTTGCAAGGATTTCGGC', 40), 1, cast(end - start as int))"))
    sites = frame(s, d, "vr").where("ref <> alt").select("var_id", "chrom", "pos", "ref", "alt")
    return G.effects(sites, ["var_id"], model(s, d), G.spliced(parts))


def vcf_peptide(s, d):
    return G.peptides(vcf_effect(s, d), ["var_id"])


def gtf_tofasta(s, d):
    """Coding sequences of transcripts and their proteins' lengths."""
    parts = model(s, d).where("kind = 'CDS'").withColumn("seq", F.expr("substring(repeat('ATGGCTTGCAAGGATTTCGGC', 40), 1, cast(end - start as int))"))
    prot = G.proteins(parts).select("transcript_id", F.length("seq").alias("aa"))
    return G.spliced(parts).select("transcript_id", F.md5("seq").alias("md5"), F.length("seq").alias("n")).join(prot, "transcript_id")


def vcf_svtofasta(s, d):
    joins = frame(s, d, "rg").select(F.concat(F.lit("j"), F.col("region_id").cast("string")).alias("name"), F.lit("ctg").alias("chrom"), (F.col("region_id") % 400 + 60).alias("pos"), F.lit("ctg").alias("alt_chrom"), (F.col("start") % 400 + 60).alias("alt_pos"), F.element_at(F.array(*map(F.lit, ("3to5", "5to3", "5to5", "3to3"))), (F.col("region_id") % 4 + 1).cast("int")).alias("connection"))
    ref = s.range(1).select(F.lit("ctg").alias("name"), F.expr("repeat('ACGTTGCAAGCT', 50)").alias("seq"))
    return G.sv_sequences(joins, ref, 20)


def tdf_join(s, d):
    nation = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    rows = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return T.lookup(rows, nation, "key", "k", "n_name", ["n_name"], "nation").select("c_custkey", "nation")


def tdf_join_csv(s, d):
    nation = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    rows = table(s, d, "supplier").select("s_suppkey", F.concat_ws(",", F.col("s_nationkey").cast("string"), ((F.col("s_nationkey") + 1) % 27).cast("string")).alias("key"))
    return T.lookup(rows, nation, "key", "k", "n_name", ["n_name"], "nations", split=",").select("s_suppkey", "nations")


def tdf_infile(s, d):
    values = table(s, d, "region").select(F.col("r_regionkey").alias("value"))
    return T.in_table(table(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", values, "hit").select("n_nationkey", "hit")


def _tab(how, **options):
    def query(s, d):
        ref = iv(s, d).select("chrom", "start", "end", "name", "score", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return T.annotate(rg(s, d), ["region_id"], ref, options.pop("value", "score") if "value" in options else VALUE.get(how, "score"), how, ORDER if how == "first" else ()).select("region_id", "value")

    query.__name__ = f"tab_annotate_{how}"
    return query


VALUE = {"collapse": "name", "flag": "name"}
ORDER = ["score", "l_orderkey", "l_linenumber"]
HOW = ("mean", "median", "min", "max", "count", "collapse", "first", "flag")


def tab_bedgraph_weighted(s, d):
    return T.weighted_overlap(rg(s, d), ["region_id"], I.depth(iv(s, d)), "depth").select("region_id", F.round("mean", 9).alias("mean"))


def tab_bedgraph_median(s, d):
    return T.weighted_overlap(rg(s, d), ["region_id"], I.depth(iv(s, d)), "depth", "median").select("region_id", "median")


def tabix_region(s, d):
    return T.query_region(rg(s, d), "2", 1000, 60000).select("region_id")


def tabix_indexed(s, d):
    from ..operators.graph import shared_path
    from ..sources.indexes import read_regions, write_indexed

    files = write_indexed(iv(s, d).select("chrom", "start", "end", "name", "l_orderkey", "l_linenumber"), shared_path(s, "indexed"))
    c = F.split("value", "\t")
    return read_regions(files, [("chr1", 1000, 90000), ("2", 5000, 5100), ("chr9", 0, 10)]).select("region", "chrom", "start", "end", c[3].alias("name"), c[4].cast("long").alias("l_orderkey"), c[5].cast("int").alias("l_linenumber"))


def tabix_bins(s, d):
    return iv(s, d).groupBy(T.reg2bin(F.col("start"), F.col("end")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def sort_rows(s, d):
    rows = T.sort_rows(rg(s, d), [("chrom", "n"), ("score", "F"), ("region_id", "i")])
    return rows.select("region_id", "chrom", "score")


def tabix_concat(s, d):
    parts = {f"part{i}": rg(s, d).where(f"score {op} 950") for i, op in ((10, "<"), (2, ">="))}
    return T.concat(parts).select("file", "region_id")


def tabix_split(s, d):
    return T.split(iv(s, d)).groupBy("part").agg(F.count(F.lit(1)).alias("count"))


def pvalues(s, d):
    return table(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 100003 / 100003.0).alias("pvalue"))


def bh(s, d):
    return S.benjamini_hochberg(pvalues(s, d)).select("o_orderkey", F.round("adjusted", 9).alias("adjusted"))


def value_ranks(s, d):
    return S.ranks(table(s, d, "lineitem").withColumn("v", F.col("l_quantity").cast("double")), "v").select("v", "n", "least_rank", "rank", "total")


def mean_stddev(s, d):
    rows = table(s, d, "lineitem").groupBy("l_suppkey").agg(*S.mean_stddev(F.col("l_extendedprice").cast("double")))
    return rows.select("l_suppkey", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


def permuted(s, d):
    rows = table(s, d, "lineitem").withColumn("v", F.col("l_quantity").cast("double") - 25)
    return rows.groupBy("l_suppkey").agg(F.round(S.permuted(F.col("v"), F.lit(20.0)), 9).alias("pvalue"))


def bonferroni(s, d):
    return S.bonferroni(pvalues(s, d)).select("o_orderkey", F.round("adjusted", 9).alias("adjusted"))


def weighted_mean(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(S.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("mean"))


def weighted_median(s, d):
    rows = table(s, d, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return S.weighted_median(rows, ["l_returnflag"], "l_extendedprice", "w")


def _counts(s, d):
    return table(s, d, "part").select("p_partkey", (F.col("p_size") % 13).alias("a"), (F.col("p_partkey") % 17).cast("int").alias("b"), (F.col("p_size") % 7 + 1).alias("c"), (F.col("p_partkey") % 11 + 1).cast("int").alias("d"))


def prop_test(s, d):
    return _counts(s, d).select("p_partkey", F.round(S.proportion_pvalue(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 9).alias("pvalue"))


def fisher_test(s, d):
    return _counts(s, d).select("p_partkey", F.round(S.fisher_test(F.col("a"), F.col("b"), F.col("c"), F.col("d"), "exact"), 9).alias("pvalue"))


def fisher_sb(s, d):
    from ..functions.columns import phred

    half = F.floor((F.col("c") + F.col("d")) / 2).cast("int")
    return _counts(s, d).select("p_partkey", F.round(phred(S.fisher_test(half, half, F.col("c"), F.col("d"))), 3).alias("fsb"))


def running_extremes(s, d):
    from ..operators.blocks import running

    rows = table(s, d, "events").select("event_id", "value").withColumn("b", F.floor(F.col("event_id") / 1000)).withColumn("k", F.lit(0))
    rows = running(rows, ["k"], "b", ["event_id"], F.col("value"), "max", "high")
    rows = running(rows, ["k"], "b", ["event_id"], (F.col("value") * 100).cast("long"), "sum", "cents")
    return rows.select("event_id", "high", "cents")


_PLAIN = (
    gtf_genes, gtf_transcripts, gtf_exons, gtf_exons_combined, gtf_introns, gtf_junctions, gtf_donors, gtf_tss, gtf_tlss, gtf_orf, gtf_utr5, gtf_utr3, gtf_geneinfo, gtf_find_junction,
    gtf_classify, annotate_gtf, annotate_repeat, vcf_effect, vcf_peptide, gtf_tofasta, vcf_svtofasta, tdf_join, tdf_join_csv, tdf_infile, tab_bedgraph_weighted, tab_bedgraph_median, tabix_region, tabix_indexed, tabix_bins, sort_rows, tabix_concat, tabix_split, bh,
    value_ranks, mean_stddev, permuted, bonferroni, weighted_mean, weighted_median, prop_test, fisher_test, fisher_sb, running_extremes,
)
QUERIES = {f.__name__: f for f in _PLAIN} | {f"tab_annotate_{h}": _tab(h) for h in HOW}

_M = f"""ex AS (SELECT *, gene_id || '.' || transcript AS transcript_id, "start" AS s, "end" AS e FROM gx WHERE NOT (transcript = 2 AND exon = 1)),
cd AS (SELECT * REPLACE (CASE WHEN exon = 0 THEN s + {CDS_FROM} ELSE s END AS s, CASE WHEN exon = 2 THEN e - {CDS_TO} ELSE e END AS e) FROM ex WHERE biotype = 'protein_coding'),
ns AS (SELECT *, lag(e) OVER (PARTITION BY transcript_id ORDER BY s) AS p FROM ex), it AS (SELECT * REPLACE (p AS s, s AS e) FROM ns WHERE p < s),
orf AS (SELECT transcript_id, gene_id, strand, min(s) AS cs, max(e) AS ce FROM cd GROUP BY ALL)"""


def _g(body: str, names: str = "gx") -> str:
    return with_sql(names, f"WITH {_M}{', ' + body.strip()[5:] if body.strip().startswith('WITH') else ' ' + body}")


_OV = "(q.\"start\" < r.\"end\" AND q.\"end\" > r.\"start\")"
_AGG = {
    "mean": "avg(q.score)", "median": "quantile_cont(q.score, 0.5)", "min": "min(q.score)", "max": "max(q.score)", "count": "count(q.score)",
    "collapse": "string_agg(DISTINCT q.name, ',' ORDER BY q.name)", "first": "arg_min(q.score, (q.score, q.l_orderkey, q.l_linenumber))", "flag": "count(q.score) > 0",
}
_LF = "lgamma({0} + 1)"
_P = "exp(" + " + ".join(_LF.format(x) for x in ("a + b", "c + d", "a + c", "b + d")) + "".join(f" - {_LF.format(x)}" for x in ("a", "b", "c", "d", "a + b + c + d")) + ")"
_CT = "ct AS (SELECT p_partkey, CAST(p_size % 13 AS BIGINT) AS a, p_partkey % 17 AS b, CAST(p_size % 7 + 1 AS BIGINT) AS c, p_partkey % 11 + 1 AS d FROM part)"
_UTR = """SELECT transcript_id, "start", "end" FROM (SELECT ex.transcript_id, CASE WHEN {left} THEN s ELSE greatest(s, ce) END AS "start", CASE WHEN {left} THEN least(e, cs) ELSE e END AS "end" FROM ex JOIN orf USING (transcript_id)) WHERE "start" < "end" """
_BG = """WITH ev AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, "start" AS pos, 1 AS d FROM iv UNION ALL SELECT chrom, "end", -1 FROM iv) GROUP BY chrom, pos HAVING sum(d) <> 0),
w AS (SELECT chrom, pos AS s, sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS e FROM ev),
o AS (SELECT region_id, depth, least(w.e, r."end") - greatest(w.s, r."start") AS n FROM rg r JOIN w ON w.chrom = r.chrom AND w.depth > 0 AND w.s < r."end" AND w.e > r."start")
"""
_WM = """k AS (SELECT {key}, {v} AS v, sum({w}) AS w FROM {t} GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY {key}) AS t, sum(w) OVER (PARTITION BY {key} ORDER BY v) AS r FROM k)
SELECT {key}, (min(v) FILTER (r >= ceil(t / 2)) + min(v) FILTER (r >= floor(t / 2) + 1)) / 2 AS median FROM c GROUP BY {key}"""
_FP = " ".join(["exp(lgamma(h + h + 1) + lgamma(c + d + 1) + lgamma(h + c + 1) + lgamma(h + d + 1) - lgamma({0} + 1) - lgamma(2 * h - {0} + 1) - lgamma(h + c - {0} + 1) - lgamma(d - h + {0} + 1) - lgamma(2 * h + c + d + 1))"])
ORACLE_SQL = {
    "fisher_sb": f"""WITH {{_CT}}, q AS (SELECT p_partkey, (c + d) // 2 AS h, c, d FROM ct), r AS (SELECT *, {_FP.format('h')} AS p0 FROM q),
s AS (SELECT p_partkey, p0 + coalesce(list_sum(list_transform(list_filter(range(greatest(0, h - d), least(2 * h, h + c) + 1), lambda x: x <> h AND {_FP.format('x')} < p0 * (1 - 1e-7)), lambda x: {_FP.format('x')})), 0) AS p FROM r)
SELECT p_partkey, round(CASE WHEN p <= 0 THEN 255 WHEN p >= 1 THEN 0 ELSE -10 * log10(p) END, 3) AS fsb FROM s""".replace("{_CT}", _CT),
    "gtf_genes": _g('SELECT gene_id, gene_name, biotype, chrom, strand, min(s) AS "start", max(e) AS "end" FROM ex GROUP BY ALL'),
    "gtf_transcripts": _g('SELECT transcript_id, min(s) AS "start", max(e) AS "end" FROM ex GROUP BY ALL'),
    "gtf_exons": _g('SELECT transcript_id, s AS "start", e AS "end" FROM ex'),
    "gtf_exons_combined": _g("""WITH f AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ex), k AS (SELECT *, sum(n) OVER (PARTITION BY gene_id ORDER BY s, e, n DESC ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT gene_id, min(s) AS "start", max(e) AS "end" FROM k GROUP BY gene_id, i"""),
    "gtf_introns": _g('SELECT transcript_id, s AS "start", e AS "end" FROM it'),
    "gtf_junctions": _g('SELECT DISTINCT gene_id, s AS "start", e AS "end" FROM it'),
    "gtf_donors": _g("""SELECT DISTINCT gene_id, CASE WHEN strand = '+' THEN s ELSE e - 1 END AS "start", CASE WHEN strand = '+' THEN s + 1 ELSE e END AS "end" FROM it"""),
    "gtf_tss": _g("""WITH t AS (SELECT gene_id, strand, min(s) AS s, max(e) AS e FROM ex GROUP BY gene_id, strand, transcript_id) SELECT DISTINCT gene_id, CASE WHEN strand = '-' THEN e - 1 ELSE s END AS "start", CASE WHEN strand = '-' THEN e ELSE s + 1 END AS "end" FROM t"""),
    "gtf_tlss": _g("""SELECT DISTINCT gene_id, CASE WHEN strand = '-' THEN ce - 1 ELSE cs END AS "start", CASE WHEN strand = '-' THEN ce ELSE cs + 1 END AS "end" FROM orf"""),
    "gtf_orf": _g('SELECT transcript_id, cs AS "start", ce AS "end" FROM orf'),
    "gtf_utr5": _g(_UTR.format(left="ex.strand <> '-'")),
    "gtf_utr3": _g(_UTR.format(left="ex.strand = '-'")),
    "gtf_geneinfo": _g("""WITH t AS (SELECT gene_id, transcript_id, sum(e - s) AS n, min(s) AS s, max(e) AS e FROM ex WHERE biotype = 'protein_coding' GROUP BY ALL), i AS (SELECT gene_id, max(e - s) AS k FROM it GROUP BY gene_id)
SELECT t.gene_id, max(e) - min(s) AS genomic_size, CAST(max(n) AS BIGINT) AS transcript_size, coalesce(max(k), 0) AS longest_intron FROM t LEFT JOIN i USING (gene_id) GROUP BY t.gene_id"""),
    "gtf_find_junction": _g('WITH j AS (SELECT DISTINCT chrom, s, e FROM it) SELECT j.chrom, j.s AS "start", j.e AS "end", g.gene_id FROM j JOIN (SELECT DISTINCT gene_id, chrom, e FROM ex) g ON g.chrom = j.chrom AND g.e = j.s JOIN (SELECT DISTINCT gene_id, chrom, s FROM ex) h ON h.chrom = j.chrom AND h.s = j.e AND h.gene_id = g.gene_id'),
    "gtf_classify": _g("""WITH pt AS (SELECT chrom, s, e, 0 AS code FROM cd
UNION ALL SELECT chrom, s, least(e, cs), CASE WHEN ex.strand = '-' THEN 2 ELSE 1 END FROM ex JOIN orf USING (transcript_id) WHERE s < least(e, cs)
UNION ALL SELECT chrom, greatest(s, ce), e, CASE WHEN ex.strand = '-' THEN 1 ELSE 2 END FROM ex JOIN orf USING (transcript_id) WHERE greatest(s, ce) < e
UNION ALL SELECT chrom, s, e, 3 FROM ex WHERE biotype <> 'protein_coding'
UNION ALL SELECT chrom, s, e, CASE WHEN cs IS NULL THEN 7 WHEN e <= cs THEN CASE WHEN it.strand = '-' THEN 6 ELSE 5 END WHEN s >= ce THEN CASE WHEN it.strand = '-' THEN 5 ELSE 6 END ELSE 4 END FROM it LEFT JOIN orf USING (transcript_id)),
b AS (SELECT v.var_id, min(code) AS code FROM vr v LEFT JOIN pt ON pt.chrom = v.chrom AND pt.s <= v.pos AND v.pos < pt.e GROUP BY v.var_id)
SELECT var_id, CASE code WHEN 0 THEN 'coding_exon' WHEN 1 THEN '5_utr' WHEN 2 THEN '3_utr' WHEN 3 THEN 'nc_exon' WHEN 4 THEN 'coding_intron' WHEN 5 THEN '5_utr_intron' WHEN 6 THEN '3_utr_intron' WHEN 7 THEN 'nc_intron' ELSE 'intergenic' END AS region FROM b""", "gx vr"),
    "annotate_gtf": _g("""WITH g AS (SELECT gene_id, chrom, strand, min(s) AS s, max(e) AS e FROM ex GROUP BY ALL), h AS (SELECT r.region_id, g.gene_id, CASE WHEN r.strand = g.strand THEN 0 ELSE 1 END AS other FROM rg r JOIN g ON g.chrom = r.chrom AND g.s < r."end" AND g.e > r."start"),
k AS (SELECT region_id, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS gene_ids FROM (SELECT *, min(other) OVER (PARTITION BY region_id) AS m FROM h) WHERE other = m GROUP BY region_id) SELECT rg.region_id, coalesce(gene_ids, '') AS gene_ids FROM rg LEFT JOIN k USING (region_id)""", "gx rg"),
    "annotate_repeat": with_sql("iv rg", f"SELECT r.region_id, coalesce(string_agg(DISTINCT q.name, ',' ORDER BY q.name), '') AS repeats, coalesce(string_agg(DISTINCT 'f' || q.name, ',' ORDER BY 'f' || q.name), '') AS families FROM rg r LEFT JOIN iv q ON q.chrom = r.chrom AND {_OV} GROUP BY r.region_id"),
    "vcf_svtofasta": with_sql("rg", """WITH j AS (SELECT 'j' || region_id AS name, region_id % 400 + 60 AS p, "start" % 400 + 60 AS q, region_id % 4 AS k, repeat('ACGTTGCAAGCT', 50) AS seq FROM rg),
x AS (SELECT name, k, CASE WHEN k IN (0, 3) THEN substr(seq, CAST(p - 19 AS INT), 20) ELSE reverse(translate(substr(seq, CAST(p AS INT), 20), 'ACGT', 'TGCA')) END AS a, CASE WHEN k IN (0, 2) THEN substr(seq, CAST(q AS INT), 20) ELSE reverse(translate(substr(seq, CAST(q - 19 AS INT), 20), 'ACGT', 'TGCA')) END AS b FROM j) SELECT name, a || b AS seq FROM x"""),
    "gtf_tofasta": _g("""WITH p AS (SELECT transcript_id, strand, string_agg(substr(repeat('ATGGCTTGCAAGGATTTCGGC', 40), 1, CAST(e - s AS INT)), '' ORDER BY s) AS seq FROM cd GROUP BY ALL), q AS (SELECT transcript_id, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM p),
c AS (SELECT transcript_id, seq, list_transform(range(0, CAST(length(seq) // 3 AS BIGINT)), lambda i: substr(seq, CAST(3 * i + 1 AS INT), 3)) AS k FROM q)
SELECT transcript_id, md5(seq) AS md5, CAST(length(seq) AS INT) AS n, CAST(coalesce(list_min(list_filter(range(1, len(k) + 1), lambda i: k[i] IN ('TAA', 'TAG', 'TGA'))) - 1, len(k)) AS INT) AS aa FROM c"""),
    "tdf_join": "SELECT c_custkey, coalesce(n_name, '') AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "tdf_join_csv": "SELECT s_suppkey, concat_ws(',', a.n_name, b.n_name) AS nations FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey LEFT JOIN nation b ON b.n_nationkey = (s_nationkey + 1) % 27",
    "tdf_infile": "SELECT n_nationkey, n_nationkey IN (SELECT r_regionkey FROM region) AS hit FROM nation",
    "tab_bedgraph_weighted": with_sql("iv rg", _BG + "SELECT region_id, round(sum(depth * n) / sum(n), 9) AS mean FROM o GROUP BY region_id"),
    "tab_bedgraph_median": with_sql("iv rg", _BG.rstrip() + ", " + _WM.format(key="region_id", v="depth", w="n", t="o")),
    "tabix_region": with_sql("rg", """SELECT region_id FROM rg WHERE chrom IN ('2', 'chr2') AND "start" < 60000 AND "end" > 1000"""),
    "tabix_indexed": with_sql("iv", """WITH r AS (SELECT * FROM (VALUES (0, 'chr1', 1000, 90000), (1, 'chr2', 5000, 5100)) AS r(region, c, s, e)) SELECT CAST(region AS INT) AS region, chrom, "start", "end", name, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber FROM r JOIN iv ON chrom = c AND "start" < e AND "end" > s"""),
    "tabix_bins": with_sql("iv", """SELECT CAST(CASE WHEN "start" >> 14 = ("end" - 1) >> 14 THEN 4681 + ("start" >> 14) WHEN "start" >> 17 = ("end" - 1) >> 17 THEN 585 + ("start" >> 17) WHEN "start" >> 20 = ("end" - 1) >> 20 THEN 73 + ("start" >> 20) ELSE 0 END AS BIGINT) AS bin, count(*) AS "count" FROM iv GROUP BY 1"""),
    "sort_rows": with_sql("rg", "SELECT region_id, chrom, score FROM rg"),
    "tabix_concat": with_sql("rg", "SELECT CASE WHEN score < 950 THEN 'part10' ELSE 'part2' END AS file, region_id FROM rg"),
    "tabix_split": with_sql("iv", 'SELECT chrom AS part, count(*) AS "count" FROM iv GROUP BY chrom'),
    "prop_test": f"""WITH {_CT}, x AS (SELECT p_partkey, sqrt((a + b + c + d) * greatest(0.0, abs(a * d - b * c) - (a + b + c + d) / 2.0) ** 2 / nullif((a + c) * (b + d) * (a + b) * (c + d), 0) / 2.0) AS z FROM ct)
SELECT p_partkey, CASE WHEN z IS NOT NULL THEN round(1 - 2 / sqrt(pi()) * least(z, 6.0) / 1200 * list_sum(list_transform(range(401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(0 - power(least(z, 6.0) * i / 400, 2)))), 9) END AS pvalue FROM x""",
    "bh": "WITH p AS (SELECT o_orderkey, (o_orderkey * 7919) % 100003 / 100003.0 AS p FROM orders), r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM p) SELECT o_orderkey, round(least(1.0, min(p * n / k) OVER (ORDER BY p DESC)), 9) AS adjusted FROM r",
    "value_ranks": "WITH k AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT v, n, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS rank, CAST(sum(n) OVER () AS BIGINT) AS total FROM k) SELECT v, n, rank - n + 1 AS least_rank, rank, total FROM r",
    "mean_stddev": "SELECT l_suppkey, round(avg(CAST(l_extendedprice AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST(l_extendedprice AS DOUBLE)), 4) AS stddev FROM lineitem GROUP BY l_suppkey",
    "permuted": "SELECT l_suppkey, round(least(1.0, (1 + count(*) FILTER (abs(CAST(l_quantity AS DOUBLE) - 25) >= 20)) / count(l_quantity)), 9) AS pvalue FROM lineitem GROUP BY l_suppkey",
    "bonferroni": "WITH p AS (SELECT o_orderkey, (o_orderkey * 7919) % 100003 / 100003.0 AS p FROM orders) SELECT o_orderkey, round(least(1.0, p * count(*) OVER ()), 9) AS adjusted FROM p",
    "weighted_mean": "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "weighted_median": "WITH li AS (SELECT l_returnflag, l_extendedprice, CAST(l_quantity AS BIGINT) AS w FROM lineitem), " + _WM.format(key="l_returnflag", v="l_extendedprice", w="w", t="li"),
    "fisher_test": f"WITH {_CT} SELECT p_partkey, round({_P}, 9) AS pvalue FROM ct",
    "running_extremes": "SELECT event_id, max(value) OVER w AS high, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents FROM events WINDOW w AS (ORDER BY event_id)",
} | {f"tab_annotate_{h}": with_sql("iv rg", f"SELECT r.region_id, {_AGG[h]} AS value FROM rg r LEFT JOIN iv q ON q.chrom = r.chrom AND {_OV} GROUP BY r.region_id") for h in HOW}
