"""Formats: round trips and odd input."""

import gzip

import pytest
from helixframe.sources import sequences as Q
from helixframe.sources import text as T


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_bed(spark, tmp_path):
    path = write(tmp_path, "a.bed", "#c\nchr1\t10\t20\nchr1\t30\t40\tx\t1.5\t-\te1\te2\n\nbad\t1\n")
    rows = T.read_bed(spark, path).collect()
    assert [(r.chrom, r.start, r.end, r.name, r.score, r.strand, r.extras) for r in rows] == [("chr1", 10, 20, "", 0.0, "*", []), ("chr1", 30, 40, "x", 1.5, "-", ["e1", "e2"])]
    out = str(tmp_path / "o")
    T.write_bed(T.read_bed(spark, path), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["chr1\t10\t20\t\t0\t+", "chr1\t30\t40\tx\t1.5\t-\te1\te2"]


def test_bedpe(spark, tmp_path):
    path = write(tmp_path, "a.bedpe", "c\t1\t2\td\t3\t4\tn\t5\t+\t-\n\n")
    assert [tuple(r) for r in T.read_bedpe(spark, path).collect()] == [("c", 1, 2, "d", 3, 4, "n", "5", "+", "-")]


VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##contig=<ID=1,length=100>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
1\t5\t.\tA\tC,G\t.\tPASS\tDP=3;DB\tGT:AD\t0/1:1,2\t1/1
1\t9\trs1\tAT\t.\t50\tq10;s50\t.\tGT\t./.\t0/0
1\t12\t.\tA\tT\t1\t.\tDP=1
"""


def test_vcf(spark, tmp_path):
    path = write(tmp_path, "a.vcf", VCF)
    rows = T.read_vcf(spark, path).collect()
    assert [(r.pos, r.id, r.alt, r.qual, r.filters, r.info) for r in rows] == [(5, None, ["C", "G"], None, None, {"DP": "3", "DB": ""}), (9, "rs1", [], 50.0, ["q10", "s50"], {}), (12, None, ["T"], 1.0, [], {"DP": "1"})]
    assert rows[0].samples == [{"GT": "0/1", "AD": "1,2"}, {"GT": "1/1", "AD": "."}] and rows[2].samples == []
    head = T.read_vcf_header(spark, path)
    assert head["samples"] == ["s1", "s2"] and head["INFO"]["DP"]["Description"] == "Depth, total" and "1" in head["contig"]
    assert T.header_table(spark, head, "INFO").first().type == "Integer"
    out = str(tmp_path / "o")
    T.write_vcf(T.read_vcf(spark, path).where("pos < 10"), out, ["##fileformat=VCFv4.2"], ["s1", "s2"])
    again = T.read_vcf(spark, out).orderBy("pos").collect()
    assert [(r.pos, r.alt, r.filters, r.info, r.samples) for r in again] == [(r.pos, r.alt, r.filters, r.info, r.samples) for r in rows[:2]]


def test_vcf_strict(spark, tmp_path):
    path = write(tmp_path, "b.vcf", "1\tx\t.\tA\tC\t.\t.\t.\n")
    assert T.read_vcf(spark, path).first().pos is None
    with pytest.raises(Exception, match="unfit VCF row"):
        T.read_vcf(spark, path, strict=True).collect()


def test_gtf(spark, tmp_path):
    line = 'chr1\tsrc\texon\t11\t20\t.\t-\t.\tgene_id "g1"; transcript_id "t1"; gene_name "N"; gene_biotype "protein_coding"; tag "basic"; tag "x";\n'
    path = write(tmp_path, "a.gtf", "#!head\n" + line + line.replace("exon", "CDS").replace('tag "basic"; ', "").replace('gene_name "N"; ', ""))
    rows = T.read_gtf(spark, path).collect()
    assert [(r.gene_id, r.gene_name, r.biotype, r.transcript_id, r.kind, r.start, r.end, r.strand) for r in rows] == [("g1", "N", "protein_coding", "t1", "exon", 10, 20, "-"), ("g1", "g1", "protein_coding", "t1", "CDS", 10, 20, "-")]
    assert T.read_gtf(spark, path, ["basic"]).count() == 1


def test_sam(spark, tmp_path):
    path = write(tmp_path, "a.sam", "@HD\tVN:1.6\nr1\t99\tchr1\t11\t60\t4M\t=\t31\t24\tACGT\tIIII\tNH:i:1\tRG:Z:x\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    rows = T.read_sam(spark, path)
    a, b = rows.collect()
    assert (a.pos, a.mate_chrom, a.mate_pos, a.tags, b.tags) == (10, "chr1", 30, {"NH": "1", "RG": "x"}, {})
    T.write_sam(rows, str(tmp_path / "o"))
    assert sorted(map(str, T.read_sam(spark, str(tmp_path / "o")).collect())) == sorted(map(str, [a, b]))


def test_repeats_and_tables(spark, tmp_path):
    path = write(tmp_path, "r.out", "   SW  perc\nscore  div.\n\n  463   1.3  0.6  1.7  chr1  10001 10468 (1) +  (TAA)n  Simple_repeat 1 471 (0) 1\n 3612  11.4 21.5  1.3  chr1  10469 11447 (1) C  TAR1    Satellite/telo (399) 1712 483 2\n")
    assert [tuple(r) for r in T.read_repeatmasker(spark, path).collect()] == [("chr1", 10000, 10468, "+", "(TAA)n", "Simple_repeat"), ("chr1", 10468, 11447, "-", "TAR1", "Satellite/telo")]
    path = write(tmp_path, "t.txt", "#x\n#a\tb\n1\t2\n")
    assert T.read_tab(spark, path, commented_header=True).columns == ["a", "b"]


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "a.fa", ">s1 first one\nACGT\nAC\r\n>s2\n\n>s3\nNN")
    rows = sorted(tuple(r) for r in Q.read_fasta(spark, path).collect())
    assert rows == [("s1", "first one", "ACGTAC"), ("s2", "", ""), ("s3", "", "NN")]
    Q.write_fasta(Q.read_fasta(spark, path), str(tmp_path / "o"), 4)
    assert sorted(tuple(r) for r in Q.read_fasta(spark, str(tmp_path / "o" / "part-*")).collect() if r.seq) == [r for r in rows if r[2]]
    assert {r.chrom: r.length for r in Q.fasta_index(Q.read_fasta(spark, path)).collect()} == {"s1": 6, "s2": 0, "s3": 2}


def test_fastq(spark, tmp_path):
    text = "@r1 c x\nACGT\n+\n@@II\n@r2\nAC\n+r2\n@I\n@r3\nAC\nGT\n+\nII\n@I\n"
    rows = sorted(tuple(r) for r in Q.read_fastq(spark, write(tmp_path, "a.fq", text)).collect())
    assert rows == [("r1", "c x", "ACGT", "@@II"), ("r2", "", "AC", "@I"), ("r3", "", "ACGT", "II@I")]
    packed = write(tmp_path, "b.fq.gz", gzip.compress(text.encode()))
    assert sorted(tuple(r) for r in Q.read_fastq(spark, packed).collect()) == rows
    with pytest.raises(Exception, match="cut off"):
        Q.read_fastq(spark, write(tmp_path, "c.fq", text + "@r4\nACGT\n+\nII\n")).collect()


def test_pileup(spark, tmp_path):
    assert Q.parse_pileup("^I.,+2agT$*-1c<", "IIIII", "A") == [("match", "A", True), ("match", "A", False), ("ins", "AG", False), ("match", "T", True), ("gap", "*", True), ("del", "C", False), ("skip", "", False)]
    row = Q.read_pileup(spark, write(tmp_path, "p", "chr1\t5\tA\t2\t.C\tI!\n"), 10).first()
    assert (row.pos, row.depth, [c.call for c in row.calls]) == (4, 2, ["A"])


def test_block_gzip(spark, tmp_path):
    data = bytes(range(256)) * 1000
    packed = Q.bgzf(data)
    assert gzip.decompress(packed) == data and packed.endswith(Q.BGZF_END)
    blocks = Q.bgzf_blocks(packed)
    assert sum(b[2] for b in blocks) == len(data) and blocks[-1][2] == 0
    assert Q.block_table(spark, write(tmp_path, "x.bgz", packed)).count() == len(blocks)
    with pytest.raises(ValueError):
        Q.bgzf_blocks(packed[5:])


def test_matrix():
    assert Q.read_matrix(">MA1 x\nA [1 2]\nC [ 0 0 ]\nG [3 1]\nT [0 1]\n") == ("MA1 x", {"A": [1, 2], "C": [0, 0], "G": [3, 1], "T": [0, 1]})


def test_stream(spark, tmp_path):
    from helixframe.streaming import windows

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed_counts(stream, late="365 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from w").collect())) == sorted(map(tuple, windows.windowed_counts(rows).collect()))
    assert windows.sessions(stream).isStreaming and windows.concurrency(stream).isStreaming and windows.binned_positions(stream, "user_id", 10).isStreaming


def test_indexes(spark, tmp_path):
    import io
    import random

    from helixframe.sources import indexes as X

    rng = random.Random(3)
    rows = sorted((f"chr{rng.randint(1, 3)}", s := rng.choice([rng.randrange(100), rng.randrange(90_000_000)]), s + rng.choice([1, 50, 40_000, 5_000_000]), "x" * rng.choice([0, 5, 200, 70_000 if k % 50 == 0 else 9]), k) for k in range(3000))
    sink = io.BytesIO()
    writer = X.Writer(sink, X.Index([]))
    for r in rows:
        writer.add("\t".join(map(str, r)))
    index, path = writer.close(), write(tmp_path, "a.bed.gz", sink.getvalue())
    assert gzip.decompress(sink.getvalue()).decode() == "".join("\t".join(map(str, r)) + "\n" for r in rows)
    regions = [("chr1", 0, 60), ("2", 30_000_000, 31_000_000), ("chr3", 89_000_000, 99_000_000), ("chr3", 500_000_000, 500_000_100), ("chrX", 0, 10)]
    for csi in (False, True):
        again = X.parse_index(X.format_index(index, csi))
        assert (again.names, again.bins, again.linear) == (index.names, index.bins, [] if csi else index.linear)
        got = {}
        for n, (c, a, b) in enumerate(regions):
            lines = [x for u, v in again.chunks(c, a, b) for x in X.chunk_lines(path, u, v)]
            got[n] = sorted(x for x in lines if index.row(x)[1] < b and index.row(x)[2] > a)
        assert got == {n: sorted("\t".join(map(str, r)) for r in rows if c in (r[0], r[0][3:]) and r[1] < b and r[2] > a) for n, (c, a, b) in enumerate(regions)}
        assert sum(v - u for u, v in again.chunks("chr1", 0, 60)) < sum(v - u for k in index.bins for x in k.values() for u, v in x)
    write(tmp_path, "a.bed.gz.csi", X.format_index(index, True))
    assert X.read_region(spark, path, "1", 0, 60).count() == len([r for r in rows if r[0] == "chr1" and r[1] < 60])
    with pytest.raises(ValueError, match="sorted"):
        writer = X.Writer(io.BytesIO(), X.Index([]))
        writer.add("c\t5\t6")
        writer.add("c\t4\t6")
    with pytest.raises(ValueError, match="neither"):
        X.parse_index(b"nothing")


def test_indexed_variants(tmp_path):
    import io

    from helixframe.sources import indexes as X

    sink = io.BytesIO()
    writer = X.Writer(sink, X.Index([], preset=X.VCF_PRESET, end=0))
    for line in ("1\t10\t.\tACGT\tA", "1\t12\t.\tA\tC", "1\t14\t.\tA\tC"):
        writer.add(line)
    index, path = writer.close(), write(tmp_path, "a.vcf.gz", sink.getvalue())
    lines = [x for c in X.parse_index(X.format_index(index)).chunks("chr1", 12, 13) for x in X.chunk_lines(path, *c)]
    assert [x for x in lines if index.row(x)[1] < 13 and index.row(x)[2] > 12] == ["1\t10\t.\tACGT\tA"]


def test_indexed_table(spark, tmp_path):
    from helixframe.sources import indexes as X

    df = spark.createDataFrame([(f"chr{i % 2}", 7 * i, 7 * i + 20, None if i % 5 else "n") for i in range(500)], "chrom string, start long, end long, name string")
    files = X.write_indexed(df, str(tmp_path / "t"), 3)
    assert files.count() == 3 and files.agg({"rows": "sum"}).first()[0] == 500
    (tmp_path / "t" / "stale.gz").write_bytes(b"not of the manifest")
    got = X.read_regions(files, [("0", 100, 200), ("chr1", 100, 200), ("chr1", 150, 160)])
    want = {n: df.where(f"chrom = '{c}' and start < {b} and end > {a}").count() for n, (c, a, b) in enumerate([("chr0", 100, 200), ("chr1", 100, 200), ("chr1", 150, 160)])}
    assert {r.region: r["count"] for r in got.groupBy("region").count().collect()} == want


def test_deep_pileup(spark, tmp_path):
    """Calls by arrays are those of the parser; deep lines leave a task in pieces, not as one batch of all their calls."""
    import random

    rng = random.Random(3)
    tokens = ["A", "c", "N", ".", ",", "*", "#", "<", ">", "^I", "^+", "^$", "$", "+2ag", "-3NNN", "="]
    lines = [("".join(rng.choice(tokens[: 8 + 8 * (i % 2)]) for _ in range(rng.randrange(40))), "".join(chr(rng.randrange(33, 80)) for _ in range(rng.randrange(40))), rng.choice("acGT")) for i in range(400)]
    got = Q.pileup_calls(*map(list, zip(*lines)), 10).to_pylist()
    assert got == [[{"kind": k, "call": x, "plus": p} for k, x, p in Q.parse_pileup(*v, 10)] for v in lines]
    deep = "".join(f"chr1\t{i}\tN\t50000\t{'Ac' * 25000}\t{'I' * 50000}\n" for i in range(1, 31))
    rows = Q.read_pileup(spark, write(tmp_path, "deep", deep))
    sizes = rows.mapInArrow(lambda bs: (b.select(["pos"]) for b in bs), "pos long")
    assert sizes.count() == 30
    assert rows.selectExpr("size(filter(calls, c -> c.call = 'C' and not c.plus)) n", "depth").distinct().collect() == [(25000, 50000)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan  # a scalar function returns a batch of lines as one
