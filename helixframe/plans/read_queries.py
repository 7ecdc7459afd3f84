"""Queries of the read and reference-sequence operators."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import reads as R
from ..operators import references as A
from .fixtures import frame, with_sql

ID = "event_id"


def fq(s, d):
    return frame(s, d, "fq")


def fa(s, d):
    return frame(s, d, "fa")


def _seq(df):
    return df.select(ID, "seq", "qual")


def fq_trim_prefix(s, d):
    return R.trim_prefix(fq(s, d), 5).select(ID, "seq", "qual", "comment")


def fq_trim_suffix(s, d):
    return _seq(R.trim_suffix(fq(s, d), 30))


def fq_trim_flanking(s, d):
    return _seq(R.trim_flanking(fq(s, d)))


def fq_trim_qual(s, d):
    return _seq(R.trim_quality(fq(s, d), 15))


def fq_trim_qual_prefix(s, d):
    return _seq(R.trim_quality(fq(s, d), 15, prefix=True))


def fq_adapter_trim(s, d):
    return _seq(R.trim_adapter(fq(s, d), "AGATCGGAAGAGCAC", 6, 1.0))


def fq_wildcard(s, d):
    return R.few_wildcards(fq(s, d), 2).select(ID)


def fq_size(s, d):
    return R.min_size(fq(s, d), 36).select(ID)


def fq_include(s, d):
    return R.include(fq(s, d), frame(s, d, "al").where("mapq > 50").select("name")).select(ID)


def fq_exclude(s, d):
    return R.exclude(fq(s, d), frame(s, d, "al").where("mapq > 50").select("name")).select(ID)


def fq_substr(s, d):
    return R.name_contains(fq(s, d), ["r1", "FC1:2"]).select(ID)


def fq_paired(s, d):
    return R.paired(R.min_size(fq(s, d), 28)).select(ID)


def fq_sort(s, d):
    return R.sort_reads(fq(s, d)).select(ID, "name")


def fq_interleave(s, d):
    one, two = R.separate(fq(s, d).drop("event_id"))
    return R.interleave(R.min_size(one, 30), R.min_size(two, 30)).select("name", "mate", "seq")


def fq_split(s, d):
    return R.split(fq(s, d), 7).select(ID, "part")


GROUPS = [("g1", "FC1:1", "{0}"), ("g2", "", "{1}"), ("g3", "FC1:3", "{2}")]


def _groups():
    import hashlib

    code = lambda i: hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT"))[:6]
    return [(rg, lane, code(i)) for i, (rg, lane, _) in enumerate(GROUPS)]


def fq_demux(s, d):
    return R.demultiplex(fq(s, d), _groups(), 0).select(ID, "read_group")


def fq_barcode(s, d):
    return R.barcodes(fq(s, d), 0.01)


def fq_check(s, d):
    return R.check(fq(s, d))


def fq_stats_len(s, d):
    return R.length_stats(fq(s, d))


def fq_stats_basefreq(s, d):
    return R.base_frequencies(fq(s, d))


def fq_stats_qual(s, d):
    return R.quality_by_cycle(fq(s, d))


def fq_stats_gc(s, d):
    return R.gc_histogram(fq(s, d))


def fq_stats_readqual(s, d):
    return R.median_quality_histogram(fq(s, d))


def fq_overlap(s, d):
    return R.merge_overlapping(fq(s, d), 3)


def fq_remix(s, d):
    return R.remix([(fq(s, d).where("mate = 1"), 0.25), (fq(s, d).where("mate = 2"), 0.5)]).select(ID)


def fq_tobam(s, d):
    return R.to_alignments(fq(s, d)).select("name", "flag", "seq", F.col("tags")["CO"].alias("co"))


def fq_tofasta(s, d):
    return R.to_fasta(fq(s, d))


def bam_tofastq(s, d):
    return R.from_alignments(frame(s, d, "al"))


def fa_gc(s, d):
    return A.gc(fa(s, d), 200)


def fa_tri(s, d):
    return A.trinucleotides(fa(s, d))


def fa_revcomp(s, d):
    return A.reverse_complement(fa(s, d))


def fa_subseq(s, d):
    regions = frame(s, d, "rg").select(F.concat(F.lit("ctg"), F.col("region_id").cast("string")).alias("chrom"), "region_id", (F.col("start") % 300).alias("start"), (F.col("start") % 300 + 40).alias("end"), "strand")
    return A.subsequence(fa(s, d), regions, stranded=True).select("region_id", "seq")


def fa_mask(s, d):
    regions = frame(s, d, "rg").select(F.concat(F.lit("ctg"), (F.col("region_id") % 500).cast("string")).alias("chrom"), (F.col("start") % 300).alias("start"), (F.col("start") % 300 + 40).alias("end"))
    return A.mask(fa(s, d), regions).select("name", F.md5("seq").alias("md5"), F.length("seq").alias("n"))


def fa_grep(s, d):
    return A.grep(fa(s, d), "ACRTYG")


def fa_wrap(s, d):
    return A.wrap(fa(s, d), 60).select("name", F.length("seq").alias("n"), F.md5("seq").alias("md5"))


def fa_tag(s, d):
    return A.tag(fa(s, d), "a_", "_z").select("name")


def fa_names(s, d):
    return A.names(fa(s, d))


def fa_filter(s, d):
    return A.filter_names(fa(s, d), ["ctg1*"], ["ctg?2*"]).select("name")


def fa_genreads(s, d):
    return A.generate_reads(fa(s, d), 50, 25, 1)


MATRIX = {"A": [8, 0, 0, 3], "C": [0, 9, 1, 2], "G": [1, 0, 9, 2], "T": [1, 1, 0, 3]}


def fa_motif(s, d):
    return A.motif_score(fa(s, d), MATRIX, 4.0).select("chrom", "pos", "strand", F.round("score", 6).alias("score"))


def fa_translate(s, d):
    from ..functions.sequences import translate

    return fa(s, d).select("name", translate(F.col("seq"), stop=False).alias("protein"))


def fa_fetch(s, d):
    """Regions as FASTA records named by position, ends swapped on the minus strand."""
    regions = frame(s, d, "rg").select(F.concat(F.lit("ctg"), F.col("region_id").cast("string")).alias("chrom"), (F.col("start") % 300).alias("start"), (F.col("start") % 300 + 25).alias("end"), "strand")
    return A.fetch(fa(s, d), regions)


def digests(s, d):
    from ..operators.tables import digests as hashes

    return hashes(fa(s, d).withColumn("content", F.col("seq").cast("binary"))).select("name", "md5", "sha1", "sha256")


def fa_split(s, d):
    return A.split(fa(s, d), 10).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def fa_random(s, d):
    return A.random_sequences(s, 20, 500)


_CLASS = "[" + "".join({"\\": "\\\\", "]": "\\]", "-": "\\-", "^": "\\^"}.get(chr(33 + q), chr(33 + q)) for q in range(15)).replace("'", "''") + "]"
_RC = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"
_FITS = [f"{f'contains(name || chr(32) || comment, {lane!r}) AND ' if lane else ''}contains(split_part(comment, ':', 3), '{code}')" for _, lane, code in _groups()]
_ODDS = "(VALUES " + ", ".join(f"({k}, '{b}', {MATRIX[b][k]}, {sum(MATRIX[x][k] for x in 'ACGT')})" for k in range(4) for b in "ACGT") + ") AS m(k, b, c, n)"

QUERIES = {f.__name__: f for f in (
    fq_trim_prefix, fq_trim_suffix, fq_trim_flanking, fq_trim_qual, fq_trim_qual_prefix, fq_adapter_trim, fq_wildcard, fq_size, fq_include, fq_exclude, fq_substr, fq_paired, fq_sort,
    fq_interleave, fq_split, fq_demux, fq_barcode, fq_check, fq_stats_len, fq_stats_basefreq, fq_stats_qual, fq_stats_gc, fq_stats_readqual, fq_overlap, fq_remix, fq_tobam, fq_tofasta,
    bam_tofastq, fa_gc, fa_tri, fa_revcomp, fa_subseq, fa_mask, fa_grep, fa_wrap, fa_tag, fa_names, fa_filter, fa_genreads, fa_motif, fa_translate, fa_fetch, digests, fa_split, fa_random,
)}

from ..functions.sequences import codons  # noqa: E402

_CODONS = ", ".join(f"('{k}', '{v}')" for k, v in codons().items())
ORACLE_SQL = {
    "fq_split": with_sql("fq", "SELECT event_id, CAST(CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % 7 AS INT) AS part FROM fq"),
    "fq_remix": with_sql("fq", """WITH n AS (SELECT DISTINCT mate, name FROM fq), r AS (SELECT *, row_number() OVER (PARTITION BY mate ORDER BY md5(mate || ':' || name), name) AS k, count(*) OVER (PARTITION BY mate) AS c FROM n)
SELECT event_id FROM fq JOIN r USING (mate, name) WHERE k <= ceil(c * CASE mate WHEN 1 THEN 0.25 ELSE 0.5 END)"""),
    "fa_split": with_sql("fa", "WITH r AS (SELECT (row_number() OVER (ORDER BY name) - 1) // 10 AS p FROM fa) SELECT CAST(p AS VARCHAR) AS part, count(*) AS n FROM r GROUP BY p"),
    "fa_fetch": with_sql("fa rg", f"""WITH r AS (SELECT region_id, strand, "start" % 300 AS s, 'ctg' || region_id AS c FROM rg) SELECT c || ':' || CASE WHEN strand = '-' THEN (s + 25) || '-' || s ELSE s || '-' || (s + 25) END AS name, CASE WHEN strand = '-' THEN {_RC.format('substr(seq, CAST(s + 1 AS INT), 25)')} ELSE substr(seq, CAST(s + 1 AS INT), 25) END AS seq FROM r JOIN fa ON fa.name = r.c"""),
    "digests": with_sql("fa", "SELECT name, md5(seq) AS md5, sha1(seq) AS sha1, sha256(seq) AS sha256 FROM fa"),
    "fa_translate": with_sql("fa", f"""WITH c(k, a) AS (VALUES {_CODONS}), t AS (SELECT name, seq, unnest(generate_series(1, length(seq) - 2, 3)) AS i FROM fa),
p AS (SELECT name, string_agg(coalesce(a, 'X'), '' ORDER BY i) AS protein FROM t LEFT JOIN c ON c.k = substr(seq, i, 3) GROUP BY name) SELECT fa.name, coalesce(protein, '') AS protein FROM fa LEFT JOIN p USING (name)"""),
    "fq_trim_prefix": with_sql("fq", "SELECT event_id, substr(seq, 6) AS seq, substr(qual, 6) AS qual, comment || ' #prefix' AS comment FROM fq"),
    "fq_trim_suffix": with_sql("fq", "SELECT event_id, left(seq, greatest(length(seq) - 30, 0)) AS seq, left(qual, greatest(length(seq) - 30, 0)) AS qual FROM fq"),
    "fq_trim_flanking": with_sql("fq", "WITH t AS (SELECT event_id, qual, rtrim(seq, 'Nn.') AS r, length(seq) - length(ltrim(seq, 'Nn.')) AS k FROM fq) SELECT event_id, substr(r, k + 1) AS seq, substr(qual, k + 1, length(r) - k) AS qual FROM t"),
    "fq_trim_qual": with_sql("fq", f"WITH t AS (SELECT *, length(regexp_replace(qual, '{_CLASS}+$', '')) AS n FROM fq) SELECT event_id, left(seq, n) AS seq, left(qual, n) AS qual FROM t"),
    "fq_trim_qual_prefix": with_sql("fq", f"WITH t AS (SELECT *, length(regexp_replace(qual, '^{_CLASS}+', '')) AS n FROM fq) SELECT event_id, right(seq, n) AS seq, right(qual, n) AS qual FROM t"),
    "fq_adapter_trim": with_sql("fq", """WITH t AS (SELECT *, coalesce(list_min(list_filter(generate_series(6, length(seq)), lambda i: starts_with('AGATCGGAAGAGCAC', left(right(seq, i), 15)) OR starts_with(right(seq, i), 'AGATCGGAAGAGCAC'))), 0) AS cut FROM fq)
SELECT event_id, left(seq, length(seq) - cut) AS seq, left(qual, length(seq) - cut) AS qual FROM t"""),
    "fq_wildcard": with_sql("fq", "SELECT event_id FROM fq WHERE length(seq) - length(translate(seq, 'Nn.456', '')) <= 2"),
    "fq_size": with_sql("fq", "SELECT event_id FROM fq WHERE length(qual) >= 36"),
    "fq_include": with_sql("fq al", "SELECT event_id FROM fq WHERE name IN (SELECT name FROM al WHERE mapq > 50)"),
    "fq_exclude": with_sql("fq al", "SELECT event_id FROM fq WHERE name NOT IN (SELECT name FROM al WHERE mapq > 50)"),
    "fq_substr": with_sql("fq", "SELECT event_id FROM fq WHERE contains(name || ' ' || comment, 'r1') AND contains(name || ' ' || comment, 'FC1:2')"),
    "fq_paired": with_sql("fq", "SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM fq WHERE length(qual) >= 28) WHERE n >= 2"),
    "fq_sort": with_sql("fq", "SELECT event_id, name FROM fq"),
    "fq_interleave": with_sql("fq", "SELECT name, mate, seq FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM fq WHERE length(qual) >= 30) WHERE n = 2"),
    "fq_demux": with_sql("fq", f"WITH t AS (SELECT event_id, list_filter([{', '.join(f'CASE WHEN {p} THEN {g[0]!r} END' for p, g in zip(_FITS, GROUPS))}], lambda x: x IS NOT NULL) AS g FROM fq) SELECT event_id, unnest(CASE WHEN len(g) > 0 THEN g ELSE ['unmatched'] END) AS read_group FROM t"),
    "fq_barcode": with_sql("fq", """WITH t AS (SELECT split_part(comment, ':', 1) || ':' || split_part(comment, ':', 2) AS lane, split_part(comment, ':', 3) AS barcode, count(*) AS k FROM fq GROUP BY ALL) SELECT lane, barcode, k AS "count", k / sum(k) OVER () AS fraction FROM t QUALIFY k / sum(k) OVER () >= 0.01"""),
    "fq_check": with_sql("fq", "SELECT count(*) AS reads, count(*) FILTER (length(seq) <> length(qual)) AS lengths, 0::BIGINT AS quality, (SELECT count(*) FROM (SELECT name FROM fq GROUP BY name HAVING count(*) <> 2)) AS unpaired FROM fq"),
    "fq_stats_len": with_sql("fq", "SELECT mate, count(*) AS reads, CAST(min(length(seq)) AS INT) AS min, quantile_cont(length(seq), 0.25) AS q25, quantile_cont(length(seq), 0.5) AS median, quantile_cont(length(seq), 0.75) AS q75, CAST(max(length(seq)) AS INT) AS max FROM fq GROUP BY mate"),
    "fq_stats_basefreq": with_sql("fq", """WITH t AS (SELECT mate, seq, unnest(generate_series(1, length(seq))) AS c FROM fq) SELECT mate, CAST(c AS INT) AS cycle, substr(seq, c, 1) AS base, count(*) AS "count" FROM t GROUP BY ALL"""),
    "fq_stats_qual": with_sql("fq", "WITH t AS (SELECT mate, qual, unnest(generate_series(1, length(qual))) AS c FROM fq), u AS (SELECT mate, c, ascii(substr(qual, c, 1)) - 33 AS q FROM t) SELECT mate, CAST(c AS INT) AS cycle, quantile_cont(q, 0.25) AS q25, quantile_cont(q, 0.5) AS q50, quantile_cont(q, 0.75) AS q75, CAST(sum(q) AS BIGINT) AS total FROM u GROUP BY mate, c"),
    "fq_stats_gc": with_sql("fq", """SELECT mate, CAST(floor(100 * (length(seq) - length(translate(seq, 'GCgc', ''))) / length(seq)) AS BIGINT) AS gc, count(*) AS "count" FROM fq WHERE length(seq) > 0 GROUP BY ALL"""),
    "fq_stats_readqual": with_sql("fq", """WITH t AS (SELECT mate, list_sort(list_transform(generate_series(1, length(qual)), lambda i: ascii(substr(qual, i, 1)) - 33)) AS q FROM fq WHERE length(qual) > 0) SELECT mate, CAST(q[(len(q) - 1) // 2 + 1] AS INT) AS quality, count(*) AS "count" FROM t GROUP BY ALL"""),
    "fq_overlap": with_sql("fq", f"""WITH p AS (SELECT a.name, a.seq AS s1, a.qual AS q1, {_RC.format('b.seq')} AS s2, b.qual AS q2 FROM fq a JOIN fq b ON a.name = b.name AND a.mate = 1 AND b.mate = 2),
t AS (SELECT *, list_max(list_filter(generate_series(3, least(length(s1), length(s2))), lambda i: right(s1, i) = left(s2, i))) AS best FROM p)
SELECT name, s1 || substr(s2, best + 1) AS seq, q1 || substr(q2, best + 1) AS qual, CAST(best AS INT) AS overlap FROM t WHERE best IS NOT NULL"""),
    "fq_tobam": with_sql("fq", "SELECT name, CAST(CASE mate WHEN 1 THEN 77 ELSE 141 END AS INT) AS flag, seq, comment AS co FROM fq"),
    "fq_tofasta": with_sql("fq", "SELECT name, comment, seq FROM fq"),
    "bam_tofastq": with_sql("al", f"SELECT name, CAST(CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS INT) AS mate, CASE WHEN flag & 16 <> 0 THEN {_RC.format('seq')} ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM al WHERE flag & 2304 = 0"),
    "fa_gc": with_sql("fa", """WITH t AS (SELECT name, seq, unnest(generate_series(0, greatest(length(seq) - 1, 0), 200)) AS s FROM fa), u AS (SELECT name, s, substr(seq, s + 1, 200) AS p FROM t)
SELECT name AS chrom, CAST(s AS BIGINT) AS "start", CAST(s + length(p) AS BIGINT) AS "end", (length(p) - length(translate(p, 'GC', ''))) / nullif(length(p) - length(translate(p, 'ACGT', '')), 0) AS gc FROM u"""),
    "fa_tri": with_sql("fa", f"""WITH t AS (SELECT substr(seq, i, 3) AS t FROM (SELECT seq, unnest(generate_series(1, length(seq) - 2)) AS i FROM fa)) SELECT CASE WHEN substr(t, 2, 1) IN ('C', 'T') THEN t ELSE {_RC.format('t')} END AS tri, count(*) AS "count" FROM t WHERE regexp_full_match(t, '[ACGT]{{3}}') GROUP BY 1"""),
    "fa_revcomp": with_sql("fa", f"SELECT name, {_RC.format('seq')} AS seq FROM fa"),
    "fa_subseq": with_sql("fa rg", f"""WITH r AS (SELECT region_id, strand, "start" % 300 AS s, 'ctg' || region_id AS c FROM rg) SELECT region_id, CASE WHEN strand = '-' THEN {_RC.format('substr(seq, s + 1, 40)')} ELSE substr(seq, s + 1, 40) END AS seq FROM r JOIN fa ON fa.name = r.c"""),
    "fa_mask": with_sql("fa rg", """WITH r AS (SELECT DISTINCT 'ctg' || (region_id % 500) AS c, "start" % 300 AS s FROM rg), b AS (SELECT name, seq, unnest(generate_series(0, length(seq) - 1)) AS i FROM fa),
m AS (SELECT name, i, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.c = b.name AND r.s <= b.i AND b.i < r.s + 40) THEN 'N' ELSE substr(seq, i + 1, 1) END AS x FROM b),
j AS (SELECT name, string_agg(x, '' ORDER BY i) AS seq FROM m GROUP BY name) SELECT fa.name, md5(coalesce(j.seq, '')) AS md5, CAST(length(coalesce(j.seq, '')) AS INT) AS n FROM fa LEFT JOIN j USING (name)"""),
    "fa_grep": with_sql("fa", """WITH t AS (SELECT name, seq, unnest(generate_series(1, length(seq) - 5)) AS i FROM fa), w AS (SELECT name, i, substr(seq, i, 6) AS k FROM t)
SELECT name AS chrom, CAST(i AS BIGINT) AS pos, '+' AS strand FROM w WHERE regexp_full_match(k, 'AC[AG]T[CT]G') UNION ALL SELECT name, CAST(i AS BIGINT), '-' FROM w WHERE regexp_full_match(k, 'C[AG]A[CT]GT')"""),
    "fa_wrap": with_sql("fa", r"""WITH t AS (SELECT name, rtrim(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10)) AS s FROM fa) SELECT name, CAST(length(s) AS INT) AS n, md5(s) AS md5 FROM t"""),
    "fa_tag": with_sql("fa", "SELECT 'a_' || name || '_z' AS name FROM fa"),
    "fa_names": with_sql("fa", "SELECT name FROM fa"),
    "fa_filter": with_sql("fa", "SELECT name FROM fa WHERE regexp_full_match(name, 'ctg1.*') AND NOT regexp_full_match(name, 'ctg.?2.*')"),
    "fa_genreads": with_sql("fa", """WITH t AS (SELECT name, seq, unnest(generate_series(0, length(seq) - 50, 25)) AS i FROM fa), w AS (SELECT name, i, substr(seq, i + 1, 50) AS k FROM t)
SELECT name || ':' || (i + 1) AS name, k AS seq, translate(regexp_replace(k, '[^N]', 'I', 'g'), 'N', '#') AS qual FROM w WHERE length(k) - length(replace(k, 'N', '')) <= 1"""),
    "fa_motif": with_sql("fa", f"""WITH m AS (SELECT k, b, log2((c + 0.8) / (n + 3.2) / 0.25) AS o FROM {_ODDS}),
t AS (SELECT name, seq, unnest(generate_series(0, length(seq) - 4)) AS i FROM fa), w AS (SELECT name, i, substr(seq, i + 1, 4) AS k4 FROM t), u AS (SELECT DISTINCT k4 FROM w WHERE regexp_full_match(k4, '[ACGT]{{4}}')),
s AS (SELECT k4, '+' AS strand, sum(o) AS score FROM u JOIN m ON substr(k4, CAST(m.k + 1 AS INT), 1) = m.b GROUP BY k4 UNION ALL SELECT k4, '-', sum(o) FROM u JOIN m ON substr({_RC.format('k4')}, CAST(m.k + 1 AS INT), 1) = m.b GROUP BY k4)
SELECT name AS chrom, CAST(i AS BIGINT) AS pos, strand, round(score, 6) AS score FROM w JOIN s USING (k4) WHERE score >= 4"""),
}
