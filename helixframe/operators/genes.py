"""Gene-model operators.

A model is one table of features: gene_id, gene_name, biotype, transcript_id, chrom, strand, kind
(``exon`` or ``CDS``), start, end (0-based half-open).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.sequences import COMPLEMENTS, BASES, STANDARD_CODE, codons, revcomp, translate
from . import intervals

# Region codes from the most to the least specific.
REGIONS = ("coding_exon", "5_utr", "3_utr", "nc_exon", "coding_intron", "5_utr_intron", "3_utr_intron", "nc_intron")
# Impact of a consequence; all others are MODIFIER.
IMPACT = {
    "transcriptional_start_loss": "HIGH", "splice_acceptor_variant": "HIGH", "splice_donor_variant": "HIGH", "stop_gained": "HIGH", "stop_lost": "HIGH",
    "frameshift_variant": "HIGH", "start_lost": "HIGH", "inframe_insertion": "MODERATE", "inframe_deletion": "MODERATE", "missense_variant": "MODERATE",
    "synonymous_variant": "LOW",
}
PEPTIDES = ("frameshift_variant", "inframe_insertion", "inframe_deletion", "missense_variant", "stop_lost")
GENE = ["gene_id", "gene_name", "biotype", "chrom", "strand"]


def exons(model: DataFrame) -> DataFrame:
    return model.where("kind = 'exon'")


def genes(model: DataFrame) -> DataFrame:
    return exons(model).groupBy(*GENE).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def transcripts(model: DataFrame) -> DataFrame:
    return exons(model).groupBy(*GENE, "transcript_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def introns(model: DataFrame) -> DataFrame:
    """Gaps between neighbouring exons of a transcript."""
    w = Window.partitionBy("gene_id", "transcript_id", "chrom").orderBy("start", "end")
    rows = exons(model).withColumn("__prev", F.lag("end").over(w)).where(F.col("__prev") < F.col("start"))
    return rows.select(*GENE, "transcript_id", F.col("__prev").alias("start"), F.col("start").alias("end"))


def junctions(model: DataFrame) -> DataFrame:
    """Distinct introns of each gene."""
    return introns(model).select(*GENE, "start", "end").distinct()


def splice_sites(model: DataFrame, kind: str) -> DataFrame:
    """Distinct donor or acceptor positions of each gene, one base long, by strand."""
    first = (F.col("strand") == "+") == F.lit(kind == "donor")
    at = F.when(first, F.col("start")).otherwise(F.col("end") - 1)
    return junctions(model).select(*GENE, at.alias("start"), (at + 1).alias("end")).distinct()


def starts(model: DataFrame, by: str = "transcript") -> DataFrame:
    """Transcription start sites of transcripts (or genes), one base long."""
    rows = transcripts(model) if by == "transcript" else genes(model)
    at = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))
    return rows.select(*GENE, at.alias("start"), (at + 1).alias("end")).distinct()


def translation_starts(model: DataFrame) -> DataFrame:
    """First coding base of each transcript."""
    rows = model.where("kind = 'CDS'").groupBy(*GENE, "transcript_id").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    at = F.when(F.col("strand") == "-", F.col("e") - 1).otherwise(F.col("s"))
    return rows.select(*GENE, at.alias("start"), (at + 1).alias("end")).distinct()


def reading_frames(model: DataFrame) -> DataFrame:
    """From the first to the last coding base of each transcript."""
    return model.where("kind = 'CDS'").groupBy(*GENE, "transcript_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def utr(model: DataFrame, five: bool = True) -> DataFrame:
    """Parts of exons ahead of (or behind) the coding bases."""
    cds = reading_frames(model).select("gene_id", "transcript_id", F.col("start").alias("cs"), F.col("end").alias("ce"))
    rows = exons(model).join(cds, ["gene_id", "transcript_id"])
    left = (F.col("strand") != "-") == F.lit(five)
    lo = F.when(left, F.col("start")).otherwise(F.greatest("start", "ce"))
    hi = F.when(left, F.least("end", "cs")).otherwise(F.col("end"))
    return rows.select(*GENE, "transcript_id", lo.alias("start"), hi.alias("end")).where("start < end")


def combine(rows: DataFrame) -> DataFrame:
    """Merges overlapping features of one gene."""
    merged = intervals.islands(rows, ["gene_id", "chrom"])
    return merged.groupBy(*GENE, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def info(model: DataFrame) -> DataFrame:
    """Coding genes: genomic size, longest transcript (sum of its exons) and longest intron."""
    coding = model.join(model.where("kind = 'CDS'").select("gene_id").distinct(), "gene_id", "left_semi")
    sizes = exons(coding).groupBy(*GENE, "transcript_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.min("start").alias("s"), F.max("end").alias("e"))
    out = sizes.groupBy(*GENE).agg((F.max("e") - F.min("s")).alias("genomic_size"), F.max("n").alias("transcript_size"))
    longest = introns(coding).groupBy("gene_id").agg(F.max(F.col("end") - F.col("start")).alias("longest_intron"))
    return out.join(longest, "gene_id", "left").withColumn("longest_intron", F.coalesce("longest_intron", F.lit(0).cast("long")))


def find_junction(model: DataFrame, found: DataFrame) -> DataFrame:
    """Genes with an exon that ends at a junction's start and one that begins at its end: found's columns and gene_id."""
    ends = exons(model).select("chrom", F.col("end").alias("start"), "gene_id").distinct()
    begins = exons(model).select("chrom", F.col("start").alias("end"), "gene_id").distinct()
    return found.join(ends, ["chrom", "start"]).join(begins, ["chrom", "end", "gene_id"])


def region_parts(model: DataFrame) -> DataFrame:
    """Every transcript as parts with a region code: chrom, start, end, strand, gene_id, gene_name, code (index of REGIONS)."""
    cds = reading_frames(model).select("gene_id", "transcript_id", F.col("start").alias("cs"), F.col("end").alias("ce"))
    coding = model.where("kind = 'CDS'").select(*GENE, "start", "end", F.lit(0).alias("code"))
    five = utr(model, True).select(*GENE, "start", "end", F.lit(1).alias("code"))
    three = utr(model, False).select(*GENE, "start", "end", F.lit(2).alias("code"))
    plain = exons(model).join(cds, ["gene_id", "transcript_id"], "left_anti").select(*GENE, "start", "end", F.lit(3).alias("code"))
    gaps = introns(model).join(cds, ["gene_id", "transcript_id"], "left")
    minus = F.col("strand") == "-"
    ahead, behind = F.col("end") <= F.col("cs"), F.col("start") >= F.col("ce")
    code = F.when(F.col("cs").isNull(), 7).when(ahead, F.when(minus, 6).otherwise(5)).when(behind, F.when(minus, 5).otherwise(6)).otherwise(4)
    return coding.union(five).union(three).union(plain).union(gaps.select(*GENE, "start", "end", code.alias("code")))


def classify(points: DataFrame, key: list[str], model: DataFrame, mito: tuple[str, ...] = ("chrM", "MT", "M")) -> DataFrame:
    """Adds region and genes: the most specific code over all transcripts that cover a point (chrom, start, end, strand), sense before
    antisense (``anti_``); ``mitochondrial`` and ``intergenic`` otherwise."""
    parts = region_parts(model)
    pairs = intervals.range_join(points.select(*key, "chrom", "start", "end", "strand"), parts)
    anti = (F.col("strand") != "*") & (F.col("r_strand") != F.col("strand"))
    rank = F.col("r_code") + F.when(anti, 100).otherwise(0)
    best = pairs.groupBy(*key).agg(F.min(rank).alias("__rank"))
    named = pairs.withColumn("__r", F.when(anti, 1).otherwise(0)).groupBy(*key).agg(F.min_by(F.struct("r_gene_name"), F.struct("__r", "r_code", "r_gene_name")).alias("__g"))
    out = points.join(best, key, "left").join(named, key, "left")
    names = F.array(*map(F.lit, REGIONS))
    code = F.concat(F.when(F.col("__rank") >= 100, "anti_").otherwise(""), F.element_at(names, (F.col("__rank") % 100 + 1).cast("int")))
    region = F.when(F.col("chrom").isin(list(mito)), "mitochondrial").when(F.col("__rank").isNull(), "intergenic").otherwise(code)
    return out.withColumn("region", region).withColumn("gene", F.coalesce("__g.r_gene_name", F.lit(""))).drop("__rank", "__g")


def annotate(rows: DataFrame, key: list[str], model: DataFrame, within: int = 0) -> DataFrame:
    """Adds gene_ids, gene_names and biotypes (sorted, joined by comma) of genes that overlap on the strand, or else on the other one."""
    pairs = intervals.range_join(rows.select(*key, "chrom", "start", "end", "strand"), genes(model), within=within)
    sense = (F.col("strand") == "*") | (F.col("strand") == F.col("r_strand"))
    pairs = pairs.withColumn("__anti", F.when(sense, 0).otherwise(1))
    side = pairs.groupBy(*key, "__anti").agg(*[F.array_join(F.array_sort(F.collect_set(f"r_{c}")), ",").alias(f"{c}s") for c in ("gene_id", "gene_name", "biotype")])
    best = side.groupBy(*key).agg(F.min(F.struct("__anti", "gene_ids", "gene_names", "biotypes")).alias("b"))
    return rows.join(best, key, "left").select(*rows.columns, *[F.coalesce(f"b.{c}", F.lit("")).alias(c) for c in ("gene_ids", "gene_names", "biotypes")])


def annotate_repeats(rows: DataFrame, key: list[str], repeats: DataFrame) -> DataFrame:
    """Adds repeats and families (sorted, joined by comma) that overlap."""
    pairs = intervals.range_join(rows.select(*key, "chrom", "start", "end"), repeats)
    found = pairs.groupBy(*key).agg(*[F.array_join(F.array_sort(F.collect_set(f"r_{c}")), ",").alias(n) for c, n in (("name", "repeats"), ("family", "families"))])
    return rows.join(found, key, "left").select(*rows.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in ("repeats", "families")])


def spliced(parts: DataFrame) -> DataFrame:
    """Joined sequences of exons or CDS with their bases (column seq, plus strand), by transcript and strand."""
    joined = parts.groupBy(*GENE, "transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return joined.withColumn("seq", F.when(F.col("strand") == "-", revcomp(F.col("seq"))).otherwise(F.col("seq")))


def proteins(parts: DataFrame, code: str = STANDARD_CODE) -> DataFrame:
    return spliced(parts).withColumn("seq", translate(F.col("seq"), code))


# -- coding effects -------------------------------------------------------------------

_PAIR = dict(zip(BASES, COMPLEMENTS))


def reverse(seq: str) -> str:
    return "".join(_PAIR.get(c, "N") for c in reversed(seq))


def protein(cds: str, table: dict[str, str]) -> str:
    return "".join(table.get(cds[i : i + 3], "X") for i in range(0, len(cds) - 2, 3))


def effect(exon_spans: list[tuple[int, int]], cds_spans: list[tuple[int, int]], cds: str, strand: str, pos: int, ref: str, alt: str, table: dict[str, str] | None = None, flank: int = 10) -> dict[str, str]:
    """Consequence of a variant (pos 1-based, alleles on the plus strand) for a transcript with ``cds`` in transcript direction:
    consequence, impact, cds_change, aa_change and, where amino acids change, the peptide with ``flank`` of them on both sides."""
    table, changed = table or codons(), cds

    def result(consequence: str, c: str = "", p: str = "") -> dict[str, str]:
        pep = peptide(cds, changed, flank, table) if consequence in PEPTIDES else ""
        return {"consequence": consequence, "impact": IMPACT.get(consequence, "MODIFIER"), "cds_change": c, "aa_change": p, "peptide": pep}

    plus, start, end = strand != "-", pos - 1, pos - 1 + len(ref)
    exon_spans, cds_spans = sorted(exon_spans), sorted(cds_spans)
    first, last = exon_spans[0][0], exon_spans[-1][1]
    if (start < first < end) if plus else (start < last < end):
        return result("transcriptional_start_loss")
    for (_, a), (b, _) in zip(exon_spans, exon_spans[1:]):
        if start >= a and end <= b:  # inside this intron
            if start - a < 2:
                return result("splice_donor_variant" if plus else "splice_acceptor_variant")
            if b - end < 2:
                return result("splice_acceptor_variant" if plus else "splice_donor_variant")
            return result("intron_variant")
    if not cds_spans:
        return result("non_coding_transcript_variant")
    if start < cds_spans[0][0]:
        return result("5_prime_UTR_variant" if plus else "3_prime_UTR_variant")
    if start >= cds_spans[-1][1]:
        return result("3_prime_UTR_variant" if plus else "5_prime_UTR_variant")
    genomic = [p for a, b in cds_spans for p in range(a, b)]
    order = genomic if plus else genomic[::-1]
    hit = [i for i, p in enumerate(order) if start <= p < end]
    if not hit:
        return result("intron_variant")
    new = alt if plus else reverse(alt)
    kept = sum(1 for p in genomic if start <= p < end)
    gone = ref[: kept] if plus else reverse(ref[:kept])
    changed = cds[: hit[0]] + new + cds[hit[-1] + 1 :]
    before, after = protein(cds, table), protein(changed, table)
    at = hit[0] // 3
    shift = len(alt) - len(ref)
    c = f"c.{hit[0] + 1}{gone}>{new}" if shift == 0 else f"c.{hit[0] + 1}_{hit[-1] + 1}{'del' if shift < 0 else 'ins'}{(gone[len(new):] if plus else gone[: len(gone) - len(new)]) if shift < 0 else (new[len(gone):] if plus else new[: len(new) - len(gone)])}"
    if shift % 3:
        return result("frameshift_variant", c, f"p.{before[at : at + 1]}{at + 1}fs")
    if before[:1] == "M" and after[:1] != "M":
        return result("start_lost", c, f"p.M1{after[:1]}")
    if "*" in before and "*" not in after:
        return result("stop_lost", c, f"p.*{before.index('*') + 1}{after[before.index('*') : before.index('*') + 1]}")
    if shift:
        return result("inframe_insertion" if shift > 0 else "inframe_deletion", c, f"p.{at + 1}{'ins' if shift > 0 else 'del'}")
    if before == after:
        return result("synonymous_variant", c, f"p.{before[at : at + 1]}{at + 1}=")
    k = next((i for i, (x, y) in enumerate(zip(before, after)) if x != y), at)
    return result("stop_gained" if after[k] == "*" else "missense_variant", c, f"p.{before[k]}{k + 1}{after[k]}")


def peptide(cds: str, changed: str, flank: int, table: dict[str, str] | None = None) -> str:
    """Amino acids around the first difference of two coding sequences, to the next stop of a shifted frame."""
    table = table or codons()
    a, b = protein(cds, table).split("*")[0], protein(changed, table).split("*")[0]
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    back = 0
    while back < min(len(a), len(b)) - first and a[-1 - back] == b[-1 - back]:
        back += 1
    return b[max(0, first - flank) : min(len(b), len(b) - back + flank)]


def effects(variants: DataFrame, key: list[str], model: DataFrame, cds: DataFrame) -> DataFrame:
    """Effect of each variant (key, chrom, pos, ref, alt) on each transcript it overlaps: key, transcript_id, consequence, impact,
    cds_change, aa_change, peptide.  ``cds`` has transcript_id and seq in transcript direction."""
    span = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "end")))).alias(name)
    whole = model.groupBy("transcript_id", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), span("exon", "exons"), span("CDS", "coding"))
    whole = whole.join(cds.select("transcript_id", F.col("seq").alias("cds")), "transcript_id", "left")
    at = variants.select(*key, "chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"), "pos", "ref", "alt")
    pairs = intervals.range_join(at, whole).select(*key, "pos", "ref", "alt", F.col("r_transcript_id").alias("transcript_id"), F.col("r_strand").alias("strand"), F.col("r_exons").alias("exons"), F.col("r_coding").alias("coding"), F.col("r_cds").alias("cds"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = codons()
        for p in parts:
            got = [effect([(x["start"], x["end"]) for x in e], [(x["start"], x["end"]) for x in c], s or "", st, int(pos), r, a, table) for e, c, s, st, pos, r, a in zip(p.exons, p.coding, p.cds, p.strand, p.pos, p.ref, p.alt)]
            out = p[[*key, "transcript_id"]].copy()
            for name in ("consequence", "impact", "cds_change", "aa_change", "peptide"):
                out[name] = [g[name] for g in got]
            yield out

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in key)
    return pairs.mapInPandas(run, f"{kept}, transcript_id string, consequence string, impact string, cds_change string, aa_change string, peptide string")


def peptides(found: DataFrame, key: list[str]) -> DataFrame:
    """Distinct mutated peptides of each variant: key, peptide and its transcripts (sorted, joined by comma)."""
    rows = found.where("peptide <> ''").groupBy(*key, "peptide")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("transcript_id")), ",").alias("transcripts"))


def sv_sequences(joins: DataFrame, reference: DataFrame, flank: int) -> DataFrame:
    """Junction sequences of structural variants (name, chrom, pos, alt_chrom, alt_pos, connection): the bases up to one breakend
    joined with those from the other, turned as the connection says.  ``reference`` has name and seq."""
    a = reference.select(F.col("name").alias("chrom"), F.col("seq").alias("sa"))
    b = reference.select(F.col("name").alias("alt_chrom"), F.col("seq").alias("sb"))
    rows = joins.join(a, "chrom").join(b, "alt_chrom")

    def side(seq: Column, pos: Column, left: Column) -> Column:
        lo = F.when(left, F.greatest(pos - flank, F.lit(0))).otherwise(pos - 1)
        hi = F.when(left, pos).otherwise(pos - 1 + flank)
        return F.substring(seq, (lo + 1).cast("int"), (hi - lo).cast("int"))

    c = F.col("connection")
    first = side(F.col("sa"), F.col("pos"), c.startswith("3"))
    second = side(F.col("sb"), F.col("alt_pos"), c.endswith("3"))
    first = F.when(c.startswith("3"), first).otherwise(revcomp(first))
    second = F.when(c.endswith("5"), second).otherwise(revcomp(second))
    return rows.select("name", F.concat(first, second).alias("seq"))
