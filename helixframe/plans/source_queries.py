"""Queries that write a projection in a format, in the shared folder, and read it again."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators.graph import shared_path
from ..sources import sequences, text
from .align_queries import al
from .fixtures import frame, with_sql
from .vcf_queries import variants


def source_bed(s, d):
    path = shared_path(s, "bed")
    text.write_bed(frame(s, d, "iv").withColumn("extras", F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))), path)
    return text.read_bed(s, path).select("chrom", "start", "end", "name", F.round("score", 2).alias("score"), "strand", F.col("extras")[0].cast("long").alias("l_orderkey"), F.col("extras")[1].cast("int").alias("l_linenumber"))


def source_bedpe(s, d):
    path = shared_path(s, "bedpe")
    rows = frame(s, d, "rg").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("chr9"), F.lit("5"), F.lit("9"), F.col("region_id").cast("string"), F.lit("0"), "strand", F.lit("*")))
    rows.write.text(path)
    return text.read_bedpe(s, path)


def source_bedgraph(s, d):
    path = shared_path(s, "bedgraph")
    frame(s, d, "rg").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("region_id").cast("string"))).write.text(path)
    return text.read_bedgraph(s, path)


def source_vcf(s, d):
    """Strict reading: a row that does not fit is an error."""
    path = shared_path(s, "vcf")
    text.vcf_lines(variants(s, d)).write.text(path)
    rows = text.read_vcf(s, path, strict=True)
    info, sample = lambda k: F.try_element_at("info", F.lit(k)), lambda i, k: F.col("samples")[i][k]
    return rows.select("chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), F.round("qual", 5).alias("qual"), F.array_join("filters", ",").alias("filters"), info("DP").alias("dp"), info("KNOWN").isNotNull().alias("known"), sample(0, "GT").alias("gt_a"), sample(1, "GT").alias("gt_b"), sample(0, "SAC").alias("sac"))


def _written_vcf(s, d):
    path = shared_path(s, "vcf")
    header = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all reads">', '##INFO=<ID=KNOWN,Number=0,Type=Flag,Description="Known">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    text.write_vcf(variants(s, d), path, header, ["tumor", "normal"])
    return text.read_vcf_header(s, path)


def vcf_header_info(s, d):
    return text.header_table(s, _written_vcf(s, d), "INFO").drop("length")


def vcf_samples(s, d):
    return text.header_table(s, _written_vcf(s, d), "samples")


def vcf_concat_n(s, d):
    root, rows = shared_path(s, "numbered"), variants(s, d)
    for k in range(3):
        text.vcf_lines(rows.where(f"pos div 20000 = {k}")).write.text(f"{root}/calls.{k + 1}.vcf")
    text.vcf_lines(rows).write.text(f"{root}/calls.5.vcf")  # behind a gap
    return text.read_numbered(s, f"{root}/calls.1.vcf").select("chunk", "chrom", "pos", "id")


def source_sam(s, d):
    path = shared_path(s, "sam")
    text.write_sam(al(s, d), path)
    return text.read_sam(s, path).select("name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual", *[F.try_element_at("tags", F.lit(k)).alias(k.lower()) for k in ("NH", "NM", "RG")])


def source_fastq(s, d):
    path = shared_path(s, "fastq")
    sequences.write_fastq(frame(s, d, "fq").where("length(seq) = length(qual)"), path)
    return sequences.read_fastq(s, path)


def source_fastq_names(s, d):
    """The suffix of read 1 and 2 is taken off the name and gives the mate."""
    path = shared_path(s, "fastq")
    rows = frame(s, d, "fq").where("length(seq) = length(qual)")
    sequences.write_fastq(rows.withColumn("name", F.concat("name", F.lit("/"), F.col("mate").cast("string"))), path)
    return sequences.split_mates(sequences.read_fastq(s, path)).select("name", "mate", "seq")


def source_fasta(s, d):
    path = shared_path(s, "fasta")
    sequences.write_fasta(frame(s, d, "fa").where("seq <> ''"), path, 70)
    return sequences.read_fasta(s, path).select("name", "seq")


def source_gtf(s, d):
    path = shared_path(s, "gtf")
    g = frame(s, d, "gx")
    attributes = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; gene_name "'), "gene_name", F.lit('"; gene_biotype "'), "biotype", F.lit('"; transcript_id "'), F.concat_ws(".", "gene_id", F.col("transcript").cast("string")), F.lit('";'))
    g.select(F.concat_ws("\t", "chrom", F.lit("src"), F.lit("exon"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attributes)).write.text(path)
    return text.read_gtf(s, path).select("gene_id", "gene_name", "biotype", "chrom", "strand", "transcript_id", "kind", "start", "end")


def source_repeatmasker(s, d):
    path = shared_path(s, "repeats")
    frame(s, d, "rg").select(F.concat_ws(" ", F.lit(" 463 1.3 0.6 1.7"), "chrom", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("(1)"), F.when(F.col("strand") == "-", "C").otherwise("+"), F.translate("name", "#", "_"), F.lit("LINE/L1 1 2 (0) 1"))).write.text(path)
    return text.read_repeatmasker(s, path)


def source_tab(s, d):
    path = shared_path(s, "tab")
    text.write_tab(frame(s, d, "rg").select("region_id", "chrom", "strand"), path)
    return text.read_tab(s, path).select(F.col("region_id").cast("long").alias("region_id"), "chrom", "strand")


def source_pileup(s, d):
    from ..operators.alignments import pileup

    path = shared_path(s, "pileup")
    pileup(al(s, d)).select(F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("N"), F.col("depth").cast("string"), "bases", F.repeat(F.lit("I"), F.col("depth").cast("int")))).write.text(path)
    calls = sequences.read_pileup(s, path)
    count = lambda b: F.size(F.filter("calls", lambda c: c["call"] == b)).cast("long").alias(b)
    return calls.select("chrom", "pos", "depth", count("A"), count("C"), count("G"), count("T"))


_FUNCTIONS = (
    source_bed, source_bedpe, source_bedgraph, source_vcf, vcf_header_info, vcf_samples, vcf_concat_n, source_sam, source_fastq, source_fastq_names, source_fasta, source_gtf, source_repeatmasker, source_tab, source_pileup,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_MATES = """m AS (SELECT a.*, CAST(a.flag + coalesce(b.flag & 16, 0) * 2 + coalesce(b.flag & 4, 0) * 2 AS INT) AS f, b.chrom AS mc, b.pos AS mp FROM al a LEFT JOIN al b ON b.event_id = CASE WHEN a.event_id % 2 = 0 THEN a.event_id + 1 ELSE a.event_id - 1 END)"""
ORACLE_SQL = {
    "source_bed": with_sql("iv", 'SELECT chrom, "start", "end", name, round(CAST(score AS DOUBLE), 2) AS score, strand, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber FROM iv'),
    "source_bedpe": with_sql("rg", """SELECT chrom AS chrom1, "start" AS start1, "end" AS end1, 'chr9' AS chrom2, CAST(5 AS BIGINT) AS start2, CAST(9 AS BIGINT) AS end2, CAST(region_id AS VARCHAR) AS name, '0' AS score, strand AS strand1, '*' AS strand2 FROM rg"""),
    "source_bedgraph": with_sql("rg", 'SELECT chrom, "start", "end", CAST(region_id AS DOUBLE) AS value FROM rg'),
    "source_vcf": with_sql("vr", """SELECT chrom, pos, 'v' || var_id AS id, ref, alt, round(CAST(qual AS DOUBLE), 5) AS qual, filter AS filters, CAST(dp AS VARCHAR) AS dp, flag = 1 AS known, gt_a, gt_b, concat_ws(',', sac0, sac1, sac2, sac3) AS sac FROM vr"""),
    "vcf_header_info": "SELECT * FROM (VALUES ('DP', '1', 'Integer', 'Depth, all reads'), ('KNOWN', '0', 'Flag', 'Known')) AS t(id, number, type, description)",
    "vcf_samples": "SELECT * FROM (VALUES (1::INT, 'tumor'), (2::INT, 'normal')) AS t(position, sample)",
    "vcf_concat_n": with_sql("vr", "SELECT CAST(pos // 20000 + 1 AS INT) AS chunk, chrom, pos, 'v' || var_id AS id FROM vr WHERE pos // 20000 < 3"),
    "source_sam": with_sql("al", f"WITH {_MATES} SELECT name, f AS flag, chrom, pos, mapq, cigar, coalesce(mc, '*') AS mate_chrom, coalesce(mp, -1) AS mate_pos, tlen, seq, qual, CAST(nh AS VARCHAR) AS nh, CAST(nm AS VARCHAR) AS nm, read_group AS rg FROM m"),
    "source_fastq": with_sql("fq", "SELECT name, comment, seq, qual FROM fq WHERE length(seq) = length(qual)"),
    "source_fastq_names": with_sql("fq", "SELECT name, mate, seq FROM fq WHERE length(seq) = length(qual)"),
    "source_fasta": with_sql("fa", "SELECT name, seq FROM fa WHERE seq <> ''"),
    "source_gtf": with_sql("gx", """SELECT gene_id, gene_name, biotype, chrom, strand, gene_id || '.' || transcript AS transcript_id, 'exon' AS kind, "start", "end" FROM gx"""),
    "source_repeatmasker": with_sql("rg", """SELECT chrom, "start", "end", strand, translate(name, '#', '_') AS name, 'LINE/L1' AS family FROM rg"""),
    "source_tab": with_sql("rg", "SELECT region_id, chrom, strand FROM rg"),
    "source_pileup": with_sql("al", """WITH bl AS (SELECT chrom, pos + o AS s, r AS rs, n, seq FROM al, LATERAL (SELECT unnest(CASE event_id % 6
  WHEN 0 THEN [{'o': 0, 'n': 50, 'r': 0}] WHEN 1 THEN [{'o': 0, 'n': 40, 'r': 10}] WHEN 2 THEN [{'o': 0, 'n': 20, 'r': 0}, {'o': 20, 'n': 25, 'r': 25}]
  WHEN 3 THEN [{'o': 0, 'n': 20, 'r': 0}, {'o': 30, 'n': 30, 'r': 20}] WHEN 4 THEN [{'o': 0, 'n': 25, 'r': 0}, {'o': 125, 'n': 25, 'r': 25}] ELSE [{'o': 0, 'n': 40, 'r': 0}] END, recursive := true)) t WHERE flag & 1796 = 0),
b AS (SELECT chrom, s + i AS pos, substr(seq, CAST(rs + i + 1 AS INT), 1) AS c FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM bl))
SELECT chrom, pos, count(*) AS depth, count(*) FILTER (c = 'A') AS "A", count(*) FILTER (c = 'C') AS "C", count(*) FILTER (c = 'G') AS "G", count(*) FILTER (c = 'T') AS "T" FROM b GROUP BY chrom, pos"""),
}
