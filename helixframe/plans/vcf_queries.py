"""Queries of the variant operators."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import variants as V
from .fixtures import frame, with_sql

KEY = ["var_id"]


def variants(s, d):
    """The projection vr as a variant table with two samples."""
    r = frame(s, d, "vr")
    sac = F.concat_ws(",", *[F.col(f"sac{i}").cast("string") for i in range(4)])
    ad = F.concat_ws(",", (F.col("sac0") + F.col("sac1")).cast("string"), (F.col("sac2") + F.col("sac3")).cast("string"))
    info = F.create_map(F.lit("DP"), F.col("dp").cast("string"), F.lit("ST"), F.col("status"))
    info = F.when(F.col("flag") == 1, F.map_concat(info, F.create_map(F.lit("KNOWN"), F.lit("")))).otherwise(info)
    return r.select(
        "var_id", "chrom", "pos", F.concat(F.lit("v"), F.col("var_id").cast("string")).alias("id"), "ref", F.array("alt").alias("alt"), "qual",
        F.when(F.col("filter").isNotNull(), F.array("filter")).alias("filters"), info.alias("info"),
        F.array(F.create_map(F.lit("GT"), F.col("gt_a"), F.lit("SAC"), sac, F.lit("AD"), ad), F.create_map(F.lit("GT"), F.col("gt_b"), F.lit("AD"), ad)).alias("samples"),
    )


#: Predicate of each filter query in Spark and in DuckDB over vr.
PREDICATES = {
    "chrom_pass": (lambda: V.chrom_pass(["chr1", "chr2"]), "chrom NOT IN ('chr1', 'chr2')"),
    "chrom_fail": (lambda: V.chrom_fail(["chr1", "chr2"]), "chrom IN ('chr1', 'chr2')"),
    "indel": (V.indel, "length(ref) <> 1 OR length(alt) <> 1"),
    "snv": (V.snv, "length(ref) = 1 AND length(alt) = 1"),
    "max_ins": (lambda: V.max_insert(1), "length(alt) - 1 > 1"),
    "max_del": (lambda: V.max_delete(0), "length(ref) - 1 > 0"),
    "qual": (lambda: V.quality(100), "coalesce(qual, -1) < 100"),
    "hom": (V.homozygous, "gt_a IN ('0/0', '1|1') OR gt_a = './.' OR gt_b IN ('1/1', '0|0')"),
    "het": (V.heterozygous, "gt_a = '0/1' OR gt_b = '0/1'"),
    "flag_present": (lambda: V.flag_present("KNOWN"), "flag = 1"),
    "flag_missing": (lambda: V.flag_missing("KNOWN"), "flag <> 1"),
    "value_missing": (lambda: V.value_missing("GT", 0), "gt_a = './.'"),
    "value_missing_key": (lambda: V.value_missing("SAC"), "true"),
    "eq": (lambda: V.equals("ST", "O", "INFO"), "status = 'O'"),
    "eq_sum": (lambda: V.equals("AD", "50", 0, "sum"), "sac0 + sac1 + sac2 + sac3 = 50"),
    "neq": (lambda: V.not_equals("ST", "O", "INFO"), "status <> 'O'"),
    "contain": (lambda: V.contains("GT", "|", 0), "contains(gt_a, '|')"),
    "not_contain": (lambda: V.not_contains("GT", "|", 0), "NOT contains(gt_a, '|')"),
    "in": (lambda: V.in_list("ST", ["O", "P"], "INFO"), "status IN ('O', 'P')"),
    "not_in": (lambda: V.not_in_list("ST", ["O", "P"], "INFO"), "status NOT IN ('O', 'P')"),
    "lt": (lambda: V.compares("lt", "DP", 30, "INFO"), "dp < 30"),
    "lte": (lambda: V.compares("lte", "AD", 12, 0, "ref"), "sac0 + sac1 <= 12"),
    "gt": (lambda: V.compares("gt", "AD", 40, 0, "alt1"), "sac2 + sac3 > 40"),
    "gte": (lambda: V.compares("gte", "SAC", 35, 0, "max"), "greatest(sac0, sac1, sac2, sac3) >= 35"),
}


def filter_query(name):
    def query(s, d):
        rows = V.mark(variants(s, d), {name: PREDICATES[name][0]()})
        return rows.select("var_id", F.coalesce(F.array_join("filters", ";"), F.lit("PASS")).alias("filters"))

    query.__name__ = f"vcf_filter_{name}"
    return query


def filter_sql(name):
    hit = PREDICATES[name][1]
    return with_sql("vr", f"SELECT var_id, coalesce(nullif(concat_ws(';', filter, CASE WHEN {hit} THEN '{name}' END), ''), 'PASS') AS filters FROM vr")


def info(key):
    return F.try_element_at("info", F.lit(key))


def form(key, i=0):
    return F.try_element_at(F.get("samples", F.lit(i)), F.lit(key))


def vcf_filter_passing(s, d):
    rows = V.mark(variants(s, d), {"lowq": V.quality(100), "indel": V.indel()}, keep="passing")
    return rows.select("var_id", "qual")


def vcf_filter_stats(s, d):
    return V.filter_stats(V.mark(variants(s, d), {"lowq": V.quality(100), "indel": V.indel()}))


def vcf_vardist(s, d):
    return V.variant_distance(variants(s, d), KEY).select("var_id", info("CG_VARDIST").cast("long").alias("dist"))


def vcf_tstv(s, d):
    return V.tstv(variants(s, d)).select("var_id", info("CG_TSTV").alias("tstv"))


def vcf_tstv_ratio(s, d):
    return V.tstv_ratio(variants(s, d))


def vcf_indel(s, d):
    return V.indel_sizes(variants(s, d)).select("var_id", info("CG_INSLEN").cast("int").alias("inslen"), info("CG_INDELLEN").cast("int").alias("indellen"), info("CG_INSERT").alias("ins"))


def vcf_dosage(s, d):
    return V.dosage(variants(s, d)).select("var_id", form("CG_DS").alias("ds_a"), form("CG_DS", 1).alias("ds_b"))


def vcf_vaf(s, d):
    return V.allele_frequency(variants(s, d)).select("var_id", F.col("samples")[0]["CG_VAF"].cast("double").alias("vaf"))


def vcf_minor_strand(s, d):
    return V.minor_strand(variants(s, d)).select("var_id", F.col("samples")[0]["CG_SBPCT"].cast("double").alias("pct"))


def vcf_auto_id(s, d):
    return V.auto_id(variants(s, d)).select("var_id", "id")


def vcf_copy_ratio(s, d):
    return V.copy_log_ratio(variants(s, d), 0, 1, totals=(100.0, 50.0)).select("var_id", F.round(info("CG_CNLR").cast("double"), 5).alias("ratio"))


def vcf_bed_annotate(s, d):
    return V.annotate_regions(variants(s, d), KEY, frame(s, d, "rg"), "CG_BED").select("var_id", info("CG_BED").alias("names"))


def vcf_bed_flag(s, d):
    return V.annotate_regions(variants(s, d), KEY, frame(s, d, "rg").where("score > 985"), "CG_BED", flag=True).select("var_id", info("CG_BED").isNotNull().alias("hit"))


def vcf_vcf_annotate(s, d):
    other = variants(s, d).where("filters is null").withColumn("alt", F.array(F.lit("A"), F.lit("C")))
    return V.annotate_variants(variants(s, d), KEY, other, "CG_ST", "ST", exact=True, unique=True).select("var_id", info("CG_ST").alias("st"))


def vcf_in_file(s, d):
    values = s.createDataFrame([("O",), ("X",)], "value string")
    return V.info_in_list(variants(s, d), KEY, "ST", values, "CG_IN").select("var_id", info("CG_IN").isNotNull().alias("hit"))


def vcf_tag(s, d):
    return V.constant(variants(s, d), "BATCH", "b1").select("var_id", info("BATCH").alias("batch"), F.size("info").alias("n"))


def vcf_stats(s, d):
    return V.stats(variants(s, d))


def vcf_info_tally(s, d):
    return V.info_tally(variants(s, d))


def vcf_tocount(s, d):
    return V.to_count(variants(s, d))


def vcf_bedcount(s, d):
    return V.bed_count(variants(s, d), frame(s, d, "rg"), ["region_id"], sample=0).select("region_id", "count", F.round("per_mb", 6).alias("per_mb"))


def vcf_sample_export(s, d):
    return V.sample_export(variants(s, d), ["a", "b"], ["GT", "AD"], bases=True)


def vcf_export(s, d):
    return V.export(variants(s, d), ["DP", "ST"], [(0, "AD")], ["a", "b"])


def vcf_chrfix(s, d):
    return V.chrom_fix(variants(s, d), "ensembl", primary=True).select("var_id", "chrom")


def vcf_clearfilter(s, d):
    return V.clear_filters(variants(s, d), ["q10"]).select("var_id", F.coalesce(F.array_join("filters", ";"), F.lit("PASS")).alias("filters"), info("CG_CLEARED_FILTER").alias("cleared"))


def vcf_strip(s, d):
    rows = V.strip(variants(s, d), info=["*"], keep_info=["S?"], formats=["A*"], filters=["s*"], ids=True)
    return rows.select("var_id", F.array_join(F.array_sort(F.map_keys("info")), ",").alias("info"), F.array_join(F.array_sort(F.map_keys(F.col("samples")[0])), ",").alias("format"), F.coalesce(F.array_join("filters", ";"), F.lit("PASS")).alias("filters"), "id")


def vcf_remove_flags(s, d):
    return V.fold_flags(variants(s, d)).select("var_id", info("CG_FLAGS").alias("flags"), info("KNOWN").isNull().alias("gone"))


def vcf_reorder(s, d):
    return V.reorder_samples(variants(s, d), [1, 0]).select("var_id", form("GT").alias("first"), form("GT", 1).alias("second"))


def _unique(s, d):
    return variants(s, d).groupBy("chrom", "pos", "ref", "alt").agg(F.min_by(F.struct("var_id", "id", "qual", "filters", "info", "samples"), "var_id").alias("r")).select("chrom", "pos", "ref", "alt", "r.*")


def vcf_merge(s, d):
    rows = _unique(s, d)
    return V.merge(rows.withColumn("samples", F.slice("samples", 1, 1)), rows.withColumn("samples", F.slice("samples", 2, 1))).select("var_id", "chrom", "pos", form("GT").alias("a"), form("GT", 1).alias("b"))


def vcf_concat(s, d):
    rows = variants(s, d)
    return V.concat([rows.where("pos % 20 = 1"), rows.where("pos % 20 <> 1")]).select("var_id", "chrom", "pos")


def vcf_split(s, d):
    return V.split(variants(s, d), 1000, KEY).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def vcf_export_unique_event(s, d):
    rows = variants(s, d)
    return V.unique_events(rows, F.when(F.col("filters").isNull(), F.concat_ws(":", "chrom", F.col("pos").cast("string"))), [F.col("qual").isNull(), -F.coalesce("qual", F.lit(0.0)), F.col("var_id")]).select("var_id", "chrom", "pos")


def vcf_tobed(s, d):
    return V.to_bed(variants(s, d), 5)


def vcf_tobedpe(s, d):
    return V.to_bedpe(variants(s, d)).select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "sv_type")


def vcf_consensus(s, d):
    rows = variants(s, d).withColumn("caller", F.concat(F.lit("c"), (F.col("var_id") % 3).cast("string")))
    return V.consensus(rows)


def vcf_consensus_passing(s, d):
    rows = variants(s, d).withColumn("caller", F.concat(F.lit("c"), (F.col("var_id") % 3).cast("string")))
    return V.consensus(rows, precise=0, passing=True, rescue=True, event="ST")


def poisson_tmb(s, d):
    return V.tmb(V.bed_count(variants(s, d), frame(s, d, "rg"), ["region_id"])).select("region_id", "count", F.round("pvalue", 7).alias("pvalue"))


def vcf_rename(s, d):
    return V.sample_export(variants(s, d), V.rename(["a", "b"], {"a": "tumor", "2": "normal"}), ["GT"]).groupBy("sample", "gt").agg(F.count(F.lit(1)).alias("n"))


def reference(s, d):
    """One base for each position, in chunks of one."""
    return frame(s, d, "vr").select("chrom", (F.col("pos") - 1).alias("chunk_start")).distinct().withColumn("seq", F.substring(F.translate(F.md5(F.concat_ws(":", "chrom", F.col("chunk_start").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 1))


def vcf_refbuild(s, d):
    return V.reference_match(variants(s, d), reference(s, d), 1)


def vcf_flanking(s, d):
    bases = frame(s, d, "vr").select("chrom", F.explode(F.array(F.col("pos") - 2, F.col("pos") - 1, F.col("pos"))).alias("chunk_start")).distinct()
    bases = bases.withColumn("seq", F.substring(F.translate(F.md5(F.concat_ws(":", "chrom", F.col("chunk_start").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 1))
    return V.flanking(variants(s, d), KEY, bases, 1).select("var_id", info("CG_FLANKING").alias("flank"), info("CG_FLANKING_SUB").alias("sub"))


_SUM = "(sac0 + sac1 + sac2 + sac3)"
_QUERIES = (
    vcf_filter_passing, vcf_filter_stats, vcf_vardist, vcf_tstv, vcf_tstv_ratio, vcf_indel, vcf_dosage, vcf_vaf, vcf_minor_strand, vcf_auto_id, vcf_copy_ratio, vcf_bed_annotate,
    vcf_bed_flag, vcf_vcf_annotate, vcf_in_file, vcf_tag, vcf_stats, vcf_info_tally, vcf_tocount, vcf_bedcount, vcf_sample_export, vcf_export, vcf_chrfix, vcf_clearfilter, vcf_strip,
    vcf_remove_flags, vcf_reorder, vcf_merge, vcf_concat, vcf_split, vcf_export_unique_event, vcf_tobed, vcf_tobedpe, vcf_consensus, vcf_consensus_passing, poisson_tmb, vcf_rename, vcf_refbuild, vcf_flanking,
)
QUERIES = {f"vcf_filter_{k}": filter_query(k) for k in PREDICATES} | {f.__name__: f for f in _QUERIES}

_BOTH = "CASE WHEN coalesce(qual, -1) < 100 THEN 'lowq' END, CASE WHEN length(alt) <> 1 THEN 'indel' END"
_BASES = "list_transform(string_split(replace({0}, '|', '/'), '/'), lambda x: CASE x WHEN '0' THEN ref WHEN '1' THEN alt ELSE '.' END)"
_GT = "CASE WHEN contains({0}, '|') THEN array_to_string(" + _BASES + ", '|') ELSE array_to_string(" + _BASES + ", '/') END"
_ADS = "CAST(sac0 + sac1 AS VARCHAR) || ',' || CAST(sac2 + sac3 AS VARCHAR)"
_TS = "CASE WHEN length(alt) = 1 AND ref <> alt THEN CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 'TS' ELSE 'TV' END END"
_BASE = "substr(translate(md5(v.chrom || ':' || ({0})), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 1)"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
# Alike calls: runs of positions by contig and type (and alt, for SNVs).
_CONSENSUS = """WITH b AS (SELECT *, 'c' || (var_id % 3) AS caller, CASE WHEN length(alt) > 1 THEN 'INS' ELSE 'SNV' END AS t, CASE WHEN length(alt) > 1 THEN '' ELSE alt END AS a FROM vr),
n AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= {gap} THEN 0 ELSE 1 END AS f FROM b WINDOW w AS (PARTITION BY chrom, t, a ORDER BY pos, var_id)),
c AS (SELECT *, sum(f) OVER (PARTITION BY chrom, t, a ORDER BY pos, var_id ROWS UNBOUNDED PRECEDING) AS i FROM n),
g AS (SELECT chrom, t, a, i, arg_min({{'chrom': chrom, 'pos': pos, 'ref': ref, 'alt': alt, 't': t}}, (caller, chrom, pos, alt, ref)) AS v, count(DISTINCT caller) AS callers, bool_and(filter IS NULL) AS all_pass, bool_or(filter IS NULL) AS any_pass, string_agg(DISTINCT filter, ',' ORDER BY filter) AS was FROM c GROUP BY chrom, t, a, i)"""
ORACLE_SQL = {f"vcf_filter_{k}": filter_sql(k) for k in PREDICATES} | {
    "vcf_rename": with_sql("vr", "SELECT 'tumor' AS sample, gt_a AS gt, count(*) AS n FROM vr GROUP BY gt_a UNION ALL SELECT 'normal', gt_b, count(*) FROM vr GROUP BY gt_b"),
    "vcf_consensus": with_sql("vr", _CONSENSUS.format(gap=10) + " SELECT v.chrom AS chrom, v.pos AS pos, v.ref AS ref, v.alt AS allele, v.t AS sv_type, v.chrom AS alt_chrom, v.pos AS alt_pos, callers, false AS linked, CAST(NULL AS VARCHAR) AS rescue, CAST(NULL AS VARCHAR) AS orig_filter FROM g WHERE callers >= 2"),
    "vcf_consensus_passing": with_sql("vr", _CONSENSUS.format(gap=0) + """, k AS (SELECT *, callers >= 2 AND any_pass AS kept FROM g), e AS (SELECT DISTINCT c.caller, c.status FROM c JOIN k USING (chrom, t, a, i) WHERE kept),
r AS (SELECT DISTINCT chrom, t, a, i FROM c JOIN e USING (caller, status)), o AS (SELECT k.*, r.i IS NOT NULL AS hit FROM k LEFT JOIN r USING (chrom, t, a, i)), u AS (SELECT *, NOT kept AND hit AS linked FROM o WHERE kept OR hit)
SELECT v.chrom AS chrom, v.pos AS pos, v.ref AS ref, v.alt AS allele, v.t AS sv_type, v.chrom AS alt_chrom, v.pos AS alt_pos, callers, linked, CASE WHEN all_pass THEN NULL WHEN kept THEN 'CG_PASS_RESCUE' ELSE 'CG_EVENT_RESCUE' END AS rescue, CASE WHEN NOT all_pass THEN was END AS orig_filter FROM u"""),
    "vcf_refbuild": with_sql("vr", f"SELECT count(*) AS checked, avg(CASE WHEN ref = {_BASE.format('pos - 1')} THEN 1 ELSE 0 END) AS fraction FROM vr v WHERE length(alt) = 1"),
    "vcf_flanking": with_sql("vr", f"""WITH f AS (SELECT var_id, ref, alt, {_BASE.format('pos - 2')} || {_BASE.format('pos - 1')} || {_BASE.format('pos')} AS x FROM vr v WHERE length(alt) = 1), g AS (SELECT var_id, CASE WHEN ref IN ('A', 'G') THEN {_RC.format('x')} ELSE x END AS x, CASE WHEN ref IN ('A', 'G') THEN {_RC.format('ref')} ELSE ref END AS r, CASE WHEN ref IN ('A', 'G') THEN {_RC.format('alt')} ELSE alt END AS a FROM f)
SELECT vr.var_id, g.x AS flank, left(g.x, 1) || '[' || r || '>' || a || ']' || right(g.x, 1) AS sub FROM vr LEFT JOIN g USING (var_id)"""),
    "poisson_tmb": with_sql("vr rg", """WITH c AS (SELECT r.region_id, r."end" - r."start" AS n, count(v.var_id) AS k FROM rg r LEFT JOIN vr v ON r.chrom = v.chrom AND r."start" <= v.pos - 1 AND v.pos - 1 < r."end" GROUP BY ALL), t AS (SELECT sum(k) / sum(n) AS rate FROM c), m AS (SELECT region_id, k, n * rate AS mu FROM c, t)
SELECT region_id, k AS "count", round(greatest(0.0, 1 - coalesce(list_sum(list_transform(range(0, k), lambda i: exp(i * ln(mu) - mu - lgamma(i + 1)))), 0)), 7) AS pvalue FROM m"""),

    "vcf_filter_passing": with_sql("vr", "SELECT var_id, qual FROM vr WHERE filter IS NULL AND qual >= 100 AND length(alt) = 1"),
    "vcf_filter_stats": with_sql("vr", f"""SELECT coalesce(nullif(array_to_string(list_sort(list_filter([filter, {_BOTH}], lambda x: x IS NOT NULL)), ';'), ''), 'PASS') AS filters, count(*) AS "count" FROM vr GROUP BY 1"""),
    "vcf_vardist": with_sql("vr", "SELECT var_id, coalesce(least(pos - lag(pos) OVER w, lead(pos) OVER w - pos), -1) AS dist FROM vr WINDOW w AS (PARTITION BY chrom ORDER BY pos, var_id)"),
    "vcf_tstv": with_sql("vr", f"SELECT var_id, {_TS} AS tstv FROM vr"),
    "vcf_tstv_ratio": with_sql("vr", f"WITH t AS (SELECT {_TS} AS k FROM vr) SELECT count(*) FILTER (k = 'TS') AS ts, count(*) FILTER (k = 'TV') AS tv, count(*) FILTER (k = 'TS') / count(*) FILTER (k = 'TV') AS ratio FROM t"),
    "vcf_indel": with_sql("vr", "SELECT var_id, CASE WHEN length(alt) > 1 THEN CAST(length(alt) - 1 AS INT) END AS inslen, CASE WHEN length(alt) > 1 THEN CAST(length(alt) - 1 AS INT) END AS indellen, CASE WHEN length(alt) > 1 THEN '' END AS ins FROM vr"),
    "vcf_dosage": with_sql("vr", "SELECT var_id, CAST(length(gt_a) - length(replace(gt_a, '1', '')) AS VARCHAR) AS ds_a, CAST(length(gt_b) - length(replace(gt_b, '1', '')) AS VARCHAR) AS ds_b FROM vr"),
    "vcf_vaf": with_sql("vr", f"SELECT var_id, CASE WHEN sac2 + sac3 > 0 THEN round((sac2 + sac3) / {_SUM}, 3) ELSE 0.0 END AS vaf FROM vr"),
    "vcf_minor_strand": with_sql("vr", "SELECT var_id, CASE WHEN sac2 + sac3 > 0 THEN round(least(sac2, sac3) / (sac2 + sac3), 3) ELSE 0.0 END AS pct FROM vr"),
    "vcf_auto_id": with_sql("vr", "SELECT var_id, concat_ws('_', chrom, pos, ref, alt) AS id FROM vr"),
    "vcf_copy_ratio": with_sql("vr", f"SELECT var_id, CASE WHEN {_SUM} > 0 THEN round(log2({_SUM} / 100.0) - log2({_SUM} / 50.0), 5) END AS ratio FROM vr"),
    "vcf_bed_annotate": with_sql("vr rg", 'SELECT v.var_id, string_agg(DISTINCT r.name, \',\' ORDER BY r.name) AS names FROM vr v LEFT JOIN rg r ON r.chrom = v.chrom AND r."start" <= v.pos - 1 AND v.pos - 1 < r."end" GROUP BY v.var_id'),
    "vcf_bed_flag": with_sql("vr rg", 'SELECT var_id, EXISTS (SELECT 1 FROM rg r WHERE r.score > 985 AND r.chrom = v.chrom AND r."start" <= v.pos - 1 AND v.pos - 1 < r."end") AS hit FROM vr v'),
    "vcf_vcf_annotate": with_sql("vr", "SELECT v.var_id, string_agg(DISTINCT o.status, ',' ORDER BY o.status) AS st FROM vr v LEFT JOIN vr o ON o.filter IS NULL AND o.chrom = v.chrom AND o.pos = v.pos AND o.ref = v.ref AND v.alt IN ('A', 'C') GROUP BY v.var_id"),
    "vcf_in_file": with_sql("vr", "SELECT var_id, status IN ('O', 'X') AS hit FROM vr"),
    "vcf_tag": with_sql("vr", "SELECT var_id, 'b1' AS batch, CAST(CASE WHEN flag = 1 THEN 4 ELSE 3 END AS INT) AS n FROM vr"),
    "vcf_stats": with_sql("vr", f"WITH t AS (SELECT *, {_TS} AS k FROM vr) SELECT count(*) AS total, count(*) FILTER (filter IS NULL) AS passing, count(*) FILTER (filter IS NOT NULL) AS filtered, count(*) FILTER (length(alt) = 1) AS snvs, count(*) FILTER (length(alt) <> 1) AS indels, count(*) FILTER (k = 'TS') AS ts, count(*) FILTER (k = 'TV') AS tv FROM t"),
    "vcf_info_tally": with_sql("vr", """WITH t AS (SELECT unnest(CASE WHEN flag = 1 THEN ['DP', 'ST', 'KNOWN'] ELSE ['DP', 'ST'] END) AS key FROM vr) SELECT key, count(*) AS "count" FROM t GROUP BY key"""),
    "vcf_tocount": with_sql("vr", f"SELECT chrom, pos, ref, alt, sac0 + sac1 AS ref_count, sac2 + sac3 AS alt_count, {_SUM} AS total, CASE WHEN {_SUM} > 0 THEN (sac2 + sac3) / {_SUM} ELSE 0.0 END AS af FROM vr"),
    "vcf_bedcount": with_sql("vr rg", """SELECT r.region_id, count(v.var_id) AS "count", round(count(v.var_id) * 1e6 / (r."end" - r."start"), 6) AS per_mb FROM rg r LEFT JOIN vr v ON v.gt_a NOT IN ('0/0', './.') AND r.chrom = v.chrom AND r."start" <= v.pos - 1 AND v.pos - 1 < r."end" GROUP BY r.region_id, r."start", r."end" """),
    "vcf_sample_export": with_sql("vr", f"SELECT chrom, pos, ref, alt, 'a' AS sample, {_GT.format('gt_a')} AS gt, {_ADS} AS ad FROM vr UNION ALL SELECT chrom, pos, ref, alt, 'b', {_GT.format('gt_b')}, {_ADS} FROM vr"),
    "vcf_export": with_sql("vr", f"SELECT chrom, pos, ref, alt, 'v' || var_id AS id, qual, coalesce(filter, 'PASS') AS filter, CAST(dp AS VARCHAR) AS dp, status AS st, {_ADS} AS a_ad FROM vr"),
    "vcf_chrfix": with_sql("vr", "SELECT var_id, replace(chrom, 'chr', '') AS chrom FROM vr"),
    "vcf_clearfilter": with_sql("vr", "SELECT var_id, CASE WHEN filter = 'q10' THEN 'PASS' ELSE coalesce(filter, 'PASS') END AS filters, CASE WHEN filter = 'q10' THEN 'q10' END AS cleared FROM vr"),
    "vcf_strip": with_sql("vr", "SELECT var_id, 'ST' AS info, 'GT,SAC' AS format, CASE WHEN filter = 's50' THEN 'PASS' ELSE coalesce(filter, 'PASS') END AS filters, CAST(NULL AS VARCHAR) AS id FROM vr"),
    "vcf_remove_flags": with_sql("vr", "SELECT var_id, CASE WHEN flag = 1 THEN 'KNOWN' END AS flags, true AS gone FROM vr"),
    "vcf_reorder": with_sql("vr", "SELECT var_id, gt_b AS first, gt_a AS second FROM vr"),
    "vcf_merge": with_sql("vr", "SELECT var_id, chrom, pos, gt_a AS a, gt_b AS b FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY var_id) AS n FROM vr) WHERE n = 1"),
    "vcf_concat": with_sql("vr", "SELECT var_id, chrom, pos FROM vr"),
    "vcf_split": with_sql("vr", "WITH t AS (SELECT pos, (row_number() OVER (ORDER BY chrom, pos, var_id) - 1) // 1000 AS chunk FROM vr) SELECT chunk, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM t GROUP BY chunk"),
    "vcf_export_unique_event": with_sql("vr", "SELECT var_id, chrom, pos FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY qual IS NULL, qual DESC, var_id) AS n FROM vr WHERE filter IS NULL) WHERE n = 1 UNION ALL SELECT var_id, chrom, pos FROM vr WHERE filter IS NOT NULL"),
    "vcf_tobed": with_sql("vr", """SELECT chrom, greatest(0, pos - 1 - 5) AS "start", pos + 5 AS "end", CASE WHEN length(alt) > 1 THEN 'INS' ELSE 'SNV' END AS name FROM vr"""),
    "vcf_tobedpe": with_sql("vr", "SELECT chrom AS chrom1, pos - 1 AS start1, pos AS end1, chrom AS chrom2, pos - 1 AS start2, pos AS end2, CASE WHEN length(alt) > 1 THEN 'INS' ELSE 'SNV' END AS sv_type FROM (SELECT DISTINCT chrom, pos, ref, alt FROM vr)"),
}
