"""Readers and writers of the usual text formats, as DataFrames over Spark's text source.

Everything is parsed with column expressions; gzip and bzip2 files are read by their
extension (block gzip is a multi-member gzip file).  A plain file is split by blocks, a
gzip file is one task.
"""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.columns import trim_zero


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))


# -- intervals ------------------------------------------------------------------------


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name (default empty), score (default 0), strand (default ``*``), extras; rows of fewer than three columns are skipped."""
    c = F.split("value", "\t")
    rows = _lines(spark, path).select(c.alias("c")).where(F.size("c") >= 3)
    strand = F.get("c", F.lit(5))
    return rows.select(
        F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("start"), F.col("c")[2].cast("long").alias("end"),
        F.coalesce(F.get("c", F.lit(3)), F.lit("")).alias("name"), F.coalesce(F.get("c", F.lit(4)).try_cast("double"), F.lit(0.0)).alias("score"),
        F.when(strand.isin("+", "-"), strand).otherwise("*").alias("strand"), F.when(F.size("c") > 6, F.slice("c", 7, 1 << 30)).otherwise(F.array().cast("array<string>")).alias("extras"),
    )


def write_bed(df: DataFrame, path: str, integer_score: bool = False) -> None:
    score = F.col("score").cast("int").cast("string") if integer_score else trim_zero(F.col("score"))
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("+")
    cols = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("name", F.lit("")), score, strand]
    line = F.concat_ws("\t", *cols)
    if "extras" in df.columns:
        line = F.when(F.size("extras") > 0, F.concat_ws("\t", line, F.array_join("extras", "\t"))).otherwise(line)
    df.select(line).write.text(path)


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    rows = _lines(spark, path).select(c.alias("c")).where(F.size("c") >= 6)
    strand = lambda i: F.when(F.get("c", F.lit(i)).isin("+", "-"), F.get("c", F.lit(i))).otherwise("*")
    return rows.select(
        F.col("c")[0].alias("chrom1"), F.col("c")[1].cast("long").alias("start1"), F.col("c")[2].cast("long").alias("end1"),
        F.col("c")[3].alias("chrom2"), F.col("c")[4].cast("long").alias("start2"), F.col("c")[5].cast("long").alias("end2"),
        F.coalesce(F.get("c", F.lit(6)), F.lit("")).alias("name"), F.coalesce(F.get("c", F.lit(7)), F.lit("")).alias("score"), strand(8).alias("strand1"), strand(9).alias("strand2"),
    )


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("track")).select(c.alias("c")).where(F.size("c") >= 4)
    return rows.select(F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("start"), F.col("c")[2].cast("long").alias("end"), F.col("c")[3].cast("double").alias("value"))


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, strand, name, family of a RepeatMasker table; its three header lines do not begin with a score."""
    c = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s")).select(c.alias("c"))
    return rows.select(F.col("c")[4].alias("chrom"), (F.col("c")[5].cast("long") - 1).alias("start"), F.col("c")[6].cast("long").alias("end"), F.when(F.col("c")[8] == "C", "-").otherwise("+").alias("strand"), F.col("c")[9].alias("name"), F.col("c")[10].alias("family"))


# -- variants -------------------------------------------------------------------------


def read_vcf_header(spark: SparkSession, path: str) -> dict:
    """Definitions and samples of a VCF header: {"INFO": {id: fields}, "FORMAT", "FILTER", "contig", "ALT", "samples", "lines"}."""
    lines = [r.value for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()]  # header lines
    out: dict = {"INFO": {}, "FORMAT": {}, "FILTER": {}, "contig": {}, "ALT": {}, "samples": [], "lines": []}
    for line in lines:
        m = re.match(r"##(INFO|FORMAT|FILTER|contig|ALT)=<(.*)>\s*$", line)
        if m:
            fields = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2])}
            out[m[1]][fields.get("ID", "")] = fields
        elif line.startswith("#CHROM"):
            out["samples"] = line.rstrip("\n").split("\t")[9:]
        else:
            out["lines"].append(line)
    return out


def header_table(spark: SparkSession, header: dict, kind: str) -> DataFrame:
    """Definitions of one kind (or the samples) as rows."""
    if kind == "samples":
        return spark.createDataFrame([(i, s) for i, s in enumerate(header["samples"], 1)], "position int, sample string")
    rows = [(k, v.get("Number"), v.get("Type"), v.get("Description"), v.get("length")) for k, v in header[kind].items()]
    return spark.createDataFrame(rows, "id string, number string, type string, description string, length string")


def _missing(c: Column) -> Column:
    return F.when(c != ".", c)


def read_vcf(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Variant rows.  With ``strict`` a row of fewer than eight columns or an unfit position or quality raises; otherwise such values are null."""
    c = F.split("value", "\t")
    rows = _lines(spark, path).select(c.alias("c"))
    if strict:
        fine = (F.size("c") >= 8) & F.col("c")[1].rlike(r"^\d+$") & F.col("c")[5].rlike(r"^(?:\.|-?[0-9.eE+-]+)$")
        rows = rows.select(F.when(fine, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("unfit VCF row: "), F.array_join("c", " ")))).alias("c"))
    col = F.col("c")
    entries = F.filter(F.split(col[7], ";"), lambda e: (e != "") & (e != "."))
    pair = lambda e: F.struct(F.substring_index(e, "=", 1).alias("key"), F.when(e.contains("="), F.regexp_replace(e, "^[^=]*=", "")).otherwise("").alias("value"))
    keys = F.split(F.get(col, F.lit(8)), ":")

    def sample(text: Column) -> Column:
        values = F.split(text, ":")
        return F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.coalesce(F.get(values, i), F.lit("."))))

    samples = F.when(F.size("c") > 9, F.transform(F.slice("c", 10, 1 << 30), sample)).otherwise(F.array().cast("array<map<string,string>>"))
    filters = F.when(col[6] == "PASS", None).when(col[6] == ".", F.array().cast("array<string>")).otherwise(F.split(col[6], ";"))
    return rows.select(
        col[0].alias("chrom"), col[1].try_cast("long").alias("pos"), _missing(col[2]).alias("id"), col[3].alias("ref"),
        F.when(col[4] == ".", F.array().cast("array<string>")).otherwise(F.split(col[4], ",")).alias("alt"), _missing(col[5]).try_cast("double").alias("qual"),
        filters.alias("filters"), F.map_from_entries(F.array_distinct(F.transform(entries, pair))).alias("info"), samples.alias("samples"),
    )


def read_numbered(spark: SparkSession, first: str) -> DataFrame:
    """Variant rows of files numbered from ``first`` (``calls.1.vcf``, ``calls.2.vcf``, ...) up to the first gap, with the number as column chunk."""
    m = re.fullmatch(r"(.*\.)(\d+)(\.[^/]*)", first)
    if m is None:
        raise ValueError(f"no number in {first}")
    folder, name = m[1].rpartition("/")[::2]
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder or ".")
    listed = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(there)
    present, k, out = {s.getPath().getName() for s in listed}, int(m[2]), None
    while f"{name}{k}{m[3]}" in present:
        part = read_vcf(spark, f"{m[1]}{k}{m[3]}").withColumn("chunk", F.lit(k))
        out, k = part if out is None else out.union(part), k + 1
    if out is None:
        raise FileNotFoundError(first)
    return out


def vcf_lines(df: DataFrame) -> DataFrame:
    """Variant rows as VCF text lines; FORMAT keys are those of the first sample, GT first."""
    text = lambda c: F.coalesce(c, F.lit("."))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    keys = F.array_sort(F.map_keys(F.get("samples", F.lit(0))))
    keys = F.concat(F.filter(keys, lambda k: k == "GT"), F.filter(keys, lambda k: k != "GT"))
    each = F.transform("samples", lambda s: F.array_join(F.transform(keys, lambda k: F.coalesce(F.try_element_at(s, k), F.lit("."))), ":"))
    filters = F.when(F.col("filters").isNull(), "PASS").when(F.size("filters") == 0, ".").otherwise(F.array_join("filters", ";"))
    line = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), text(F.col("id")), "ref", F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise("."), text(trim_zero(F.col("qual"))), filters,
        F.when(info == "", ".").otherwise(info), F.when(F.size("samples") > 0, F.concat_ws("\t", F.array_join(keys, ":"), F.array_join(each, "\t"))),
    )
    return df.select(line.alias("value"))


def write_vcf(df: DataFrame, path: str, header: list[str], samples: list[str]) -> None:
    """Header and rows in contig and position order; one file, as the format asks for."""
    spark = df.sparkSession
    top = [*header, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]
    head = spark.createDataFrame([(i, "", 0, x) for i, x in enumerate(top)], "o int, chrom string, pos long, value string")
    body = vcf_lines(df).withColumn("o", F.lit(1 << 30)).withColumn("chrom", F.substring_index("value", "\t", 1))
    body = body.withColumn("pos", F.split("value", "\t")[1].cast("long")).select("o", "chrom", "pos", "value")
    head.union(body).orderBy("o", "chrom", "pos", "value").coalesce(1).select("value").write.text(path)


# -- genes ----------------------------------------------------------------------------


def read_gtf(spark: SparkSession, path: str, tags: list[str] = ()) -> DataFrame:
    """Features of a GTF file (exon, CDS, start_codon, stop_codon): the gene model's columns and attributes; with ``tags`` only lines that carry all."""
    c = F.split("value", "\t")
    rows = _lines(spark, path).select(c.alias("c")).where(F.size("c") >= 9)
    a = F.col("c")[8]
    attr = lambda k: F.nullif(F.regexp_extract(a, rf'(?:^|[; ]){k} "?([^";]*)"?', 1), F.lit(""))
    for t in tags:
        rows = rows.where(a.contains(f'tag "{t}"'))
    entries = F.regexp_extract_all(a, F.lit(r'(\w+) "?([^";]*)"?'), F.lit(0))
    pairs = F.transform(entries, lambda e: F.struct(F.substring_index(e, " ", 1).alias("key"), F.regexp_replace(F.regexp_replace(e, r"^\w+ ", ""), '"', "").alias("value")))
    first = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.create_map(p["key"], p["value"]))))
    return rows.select(
        attr("gene_id").alias("gene_id"), F.coalesce(attr("gene_name"), attr("gene"), attr("gene_id")).alias("gene_name"), F.coalesce(attr("gene_biotype"), attr("gene_type")).alias("biotype"),
        F.col("c")[0].alias("chrom"), F.col("c")[6].alias("strand"), attr("transcript_id").alias("transcript_id"), F.col("c")[2].alias("kind"),
        (F.col("c")[3].cast("long") - 1).alias("start"), F.col("c")[4].cast("long").alias("end"), first.alias("attributes"),
    )


# -- alignments -----------------------------------------------------------------------


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of a SAM file (pos 0-based, tags without their types)."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(c.alias("c")).where(F.size("c") >= 11)
    col = F.col("c")
    tags = F.map_from_entries(F.transform(F.slice("c", 12, 1 << 30), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.regexp_replace(t, r"^..:.:", "").alias("value"))))
    return rows.select(
        col[0].alias("name"), col[1].cast("int").alias("flag"), col[2].alias("chrom"), (col[3].cast("long") - 1).alias("pos"), col[4].cast("int").alias("mapq"), col[5].alias("cigar"),
        F.when(col[6] == "=", col[2]).otherwise(col[6]).alias("mate_chrom"), (col[7].cast("long") - 1).alias("mate_pos"), col[8].cast("int").alias("tlen"), col[9].alias("seq"), col[10].alias("qual"),
        F.when(F.size("c") > 11, tags).otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
    )


def write_sam(df: DataFrame, path: str) -> None:
    """Alignment rows as SAM lines, without a header; tags that are whole numbers are typed ``i``, the others ``Z``."""
    tag = lambda e: F.concat_ws(":", e["key"], F.when(e["value"].rlike(r"^-?\d+$"), "i").otherwise("Z"), e["value"])
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), tag), "\t")
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(F.coalesce("mate_chrom", F.lit("*")))
    cols = [F.col("name"), F.col("flag"), F.col("chrom"), F.col("pos") + 1, F.col("mapq"), F.col("cigar"), mate, F.coalesce(F.col("mate_pos") + 1, F.lit(0)), F.coalesce("tlen", F.lit(0)), F.col("seq"), F.col("qual")]
    line = F.concat_ws("\t", *[c.cast("string") for c in cols])
    df.select(F.when(F.size("tags") > 0, F.concat_ws("\t", line, tags)).otherwise(line)).write.text(path)


# -- tables ---------------------------------------------------------------------------


def read_tab(spark: SparkSession, path: str, header: bool = True, commented_header: bool = False) -> DataFrame:
    """A tab-delimited file, all strings; a commented header is the last line that begins with ``#``."""
    if not commented_header:
        return spark.read.csv(path, sep="\t", header=header, comment="#", quote="", inferSchema=False)
    names = [r.value for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()][-1].lstrip("#").split("\t")
    rows = spark.read.csv(path, sep="\t", header=False, comment="#", quote="", inferSchema=False)
    return rows.toDF(*names)


def write_tab(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="")
