"""Readers and writers of sequence formats whose records span lines: FASTA, FASTQ, pileup, motif matrices, block gzip.

FASTA and FASTQ are read by Spark's text source with a record separator, so plain files
split over tasks; what a separator cuts wrong is put right within the record.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq: records begin with ``>`` at the start of a line."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = rows.select(F.substring_index(text, "\n", 1).alias("head"), F.regexp_replace(text, r"^[^\n]*(?:\n|$)", "").alias("body")).where("head <> ''")
    head = F.col("head")
    return rows.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("comment"), F.regexp_replace("body", r"\s", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    comment = F.coalesce("comment", F.lit("")) if "comment" in df.columns else F.lit("")
    df.select(F.concat(F.lit(">"), "name", F.when(comment != "", F.concat(F.lit(" "), comment)).otherwise(""), F.lit("\n"), body)).write.text(path)


def fasta_index(df: DataFrame) -> DataFrame:
    """Names and lengths, as an index holds them."""
    return df.select(F.col("name").alias("chrom"), F.length("seq").cast("long").alias("length"))


def read_fastq(spark: SparkSession, path: str, mate: int | None = None) -> DataFrame:
    """name, comment, seq, qual of four-line records.  The separator is a line feed with ``@``; a quality line that begins with ``@``
    cuts a record in two, which its line count shows, so pieces are joined again within the file."""
    rows = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, where = None, None
        for p in parts:
            out = []
            for value, file in zip(p.value, p.file):
                if held is None or file != where:
                    value = value.removeprefix("@")
                held = value if held is None or file != where else f"{held}\n@{value}"
                where = file
                lines = held.replace("\r", "").rstrip("\n").split("\n")
                plus = next((i for i, x in enumerate(lines) if i and x.startswith("+")), None)
                if plus is None:
                    continue
                seq, qual = "".join(lines[1:plus]), "".join(lines[plus + 1 :])
                if len(qual) >= len(seq):
                    name, _, comment = lines[0].partition(" ")
                    out.append((name, comment, seq.upper(), qual))
                    held = None
            yield pd.DataFrame(out, columns=["name", "comment", "seq", "qual"])
        if held is not None and held.strip():
            raise ValueError("the last FASTQ record is cut off")

    # one file's records stay in order in one task; many files are many tasks
    ordered = rows.repartition("file").sortWithinPartitions("file", "n")
    out = ordered.select("value", "file").mapInPandas(join, "name string, comment string, seq string, qual string")
    return out if mate is None else out.withColumn("mate", F.lit(mate))


def split_mates(df: DataFrame) -> DataFrame:
    """Takes ``/1`` or ``/2`` off the names as column mate; where a name has none, the number that begins the comment (``1:N:0:ACGT``), else 1."""
    end = F.regexp_extract("name", r"/([12])$", 1)
    other = F.regexp_extract("comment", r"^([12]):", 1)
    mate = F.coalesce(F.nullif(end, F.lit("")), F.nullif(other, F.lit("")), F.lit("1")).cast("int")
    return df.withColumn("mate", mate).withColumn("name", F.regexp_replace("name", r"/[12]$", ""))


def write_fastq(df: DataFrame, path: str) -> None:
    head = F.concat(F.lit("@"), "name", F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" "), "comment")).otherwise(""))
    df.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual")).write.text(path)


def parse_pileup(bases: str, quals: str, ref: str, least: int = 0) -> list[tuple[str, str, bool]]:
    """Calls of one pileup column: (kind, call, plus strand); kinds are match, ins, del, gap and skip."""
    out, i, q = [], 0, 0
    while i < len(bases):
        c = bases[i]
        if c == "^":
            i += 2
        elif c == "$":
            i += 1
        elif c in "+-":
            n = re.match(r"\d+", bases[i + 1 :])[0]
            i += 1 + len(n)
            text = bases[i : i + int(n)]
            out.append(("ins" if c == "+" else "del", text.upper(), text.isupper()))
            i += int(n)
        else:
            fine = q < len(quals) and ord(quals[q]) - 33 >= least
            if c in "<>":
                out.append(("skip", "", c == ">"))
            elif c in "*#":
                if fine:
                    out.append(("gap", "*", c == "*"))
            elif fine:
                out.append(("match", ref.upper() if c in ".," else c.upper(), c == "." or c.isupper()))
            i, q = i + 1, q + 1
    return out


#: Characters of bases that are turned into calls at once.
PILEUP_CALLS = 200_000
_KINDS = ("match", "gap", "skip", "ins", "del")


def _pileup_codes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, call (its own character's code, 128 for the reference, 129 for none) and strand of each character that is a call by itself."""
    kind, call, plus = np.zeros(128, np.int8), np.zeros(128, np.int32), np.zeros(128, bool)
    for i in range(128):
        c = chr(i)
        kind[i] = 2 if c in "<>" else 1 if c in "*#" else 0
        call[i] = 129 if c in "<>" else ord("*") if c in "*#" else 128 if c in ".," else ord(c.upper())
        plus[i] = c in ">*." or c.isupper()
    return kind, call, plus


_CODES = _pileup_codes()


def pileup_calls(bases: list[str], quals: list[str], refs: list[str], least: int = 0) -> pa.Array:
    """``parse_pileup`` of many lines.  Lines without indels go by arrays."""
    kinds, calls, plus, sizes = [], [], [], []
    names = {"": 129, **{chr(i): i for i in range(128)}}
    table = [*map(chr, range(128)), "", ""]

    def code(call: str) -> int:
        if call not in names:
            names[call] = len(table)
            table.append(call)
        return names[call]

    for b, q, r in zip(bases, quals, refs):
        plain = re.sub(r"\^.|\$", "", b, flags=re.S)
        if plain.isascii() and q.isascii() and not re.search(r"[+^-]", plain):
            x = np.frombuffer(plain.encode(), np.uint8)
            v = np.zeros(len(x), np.int16)
            v[: len(q)] = np.frombuffer(q.encode(), np.uint8)[: len(x)]
            fine = (v - 33 >= least) & (np.arange(len(x)) < len(q))
            k, c, p = (t[x] for t in _CODES)
            stays = fine | (k == 2)
            k, c, p = k[stays], c[stays], p[stays]
            if (c == 128).any():
                c[c == 128] = code(r.upper())
        else:
            got = parse_pileup(b, q, r, least)
            k = np.array([_KINDS.index(g[0]) for g in got], np.int8)
            c = np.array([code(g[1]) for g in got], np.int32)
            p = np.array([g[2] for g in got], bool)
        kinds.append(k), calls.append(c), plus.append(p), sizes.append(len(k))
    flat = lambda a, kind: np.concatenate(a) if a else np.empty(0, kind)
    fields = [pa.array(_KINDS).take(pa.array(flat(kinds, np.int8))), pa.array(table).take(pa.array(flat(calls, np.int32))), pa.array(flat(plus, bool))]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "call", "plus"]))


def read_pileup(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """chrom, pos (0-based), ref, depth, calls array<struct<kind,call,plus>> of a one-sample pileup."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select(c.alias("c")).where(F.size("c") >= 6)
    rows = rows.select(F.col("c")[0].alias("chrom"), (F.col("c")[1].cast("long") - 1).alias("pos"), F.col("c")[2].alias("ref"), F.col("c")[3].cast("long").alias("depth"), F.col("c")[4].alias("b"), F.col("c")[5].alias("q"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a deep line has many calls, so a batch of lines goes out in pieces
            sizes = np.cumsum(pc.binary_length(batch["b"]).fill_null(0).to_numpy(zero_copy_only=False)) // PILEUP_CALLS
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                calls = pileup_calls(part["b"].to_pylist(), part["q"].to_pylist(), part["ref"].to_pylist(), least)
                yield pa.RecordBatch.from_arrays([*(part[k] for k in ("chrom", "pos", "ref", "depth")), calls], ["chrom", "pos", "ref", "depth", "calls"])

    return rows.mapInArrow(parse, "chrom string, pos long, ref string, depth long, calls array<struct<kind:string,call:string,plus:boolean>>")


def read_matrix(text: str) -> tuple[str, dict[str, list[float]]]:
    """Name and counts of a motif matrix: a ``>`` line and a bracketed row for each base."""
    name, rows = "", {}
    for line in text.splitlines():
        if line.startswith(">"):
            name = line[1:].strip()
        elif m := re.match(r"\s*([ACGT])\s*\[?([^\]]*)\]?", line):
            rows[m[1]] = [float(x) for x in m[2].split()]
    return name, rows


# The empty block that ends a block-gzip file, and the most bytes a block holds.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BGZF_BLOCK = 65_280


def bgzf(data: bytes) -> bytes:
    """``data`` as a block-gzip file."""
    out = []
    for i in range(0, len(data), BGZF_BLOCK):
        part = data[i : i + BGZF_BLOCK]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + BGZF_END


def bgzf_blocks(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of each block."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b" or data[at + 12 : at + 14] != b"BC":
            raise ValueError(f"no block at byte {at}")
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        out.append((at, size, struct.unpack_from("<I", data, at + size - 4)[0]))
        at += size
    return out


def block_table(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, compressed, uncompressed of the blocks of block-gzip files."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(f, *b) for f, data in zip(p.path, p.content) for b in bgzf_blocks(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "offset", "compressed", "uncompressed"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(scan, "path string, offset long, compressed long, uncompressed long")


def bai_bins(data: bytes) -> list[tuple[int, int, int, int]]:
    """(reference, bin, first offset, last offset) of the chunks of a binary alignment index."""
    if data[:4] != b"BAI\1":
        raise ValueError("not an alignment index")
    n_ref, at, out = struct.unpack_from("<i", data, 4)[0], 8, []
    for ref in range(n_ref):
        n_bin, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(n_bin):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            for _ in range(chunks):
                out.append((ref, number, *struct.unpack_from("<QQ", data, at)))
                at += 16
        at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
    return out
