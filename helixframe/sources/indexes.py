"""Indexed block-gzip tables: bin indexes (TBI and CSI) are read and written, and a region query reads only the blocks they point to.

A virtual offset is ``block << 16 | byte``: where a block begins in the file and a byte of its text.  Files are opened
through ``pyarrow.fs``, so tasks read ranges of local, HDFS or object-store files.  A table is written as many files,
each with an index of its own; what counts is listed in a manifest, so files that a lost task left are never read.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs as pafs
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .sequences import BGZF_BLOCK, BGZF_END, bgzf

# Fixed values of the formats: bit of zero-based coordinates, the preset of VCF, levels and least shift of the plain index,
# its step of linear offsets, and bytes ahead of a block's text.
ZERO_BASED, VCF_PRESET = 0x10000, 2
SHIFT, DEPTH = 14, 5
HEAD = 18


@dataclass
class Index:
    """Columns are 1-based; ``end`` 0 means that a row covers one position (for VCF, its ref)."""

    names: list[str]
    preset: int = ZERO_BASED
    seq: int = 1
    begin: int = 2
    end: int = 3
    meta: str = "#"
    skip: int = 0
    shift: int = SHIFT
    depth: int = DEPTH
    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    linear: list[list[int]] = field(default_factory=list)

    def row(self, line: str) -> tuple[str, int, int]:
        """(name, start, end) of a line, zero-based and half open."""
        cells = line.split("\t")
        start = int(cells[self.begin - 1]) - (0 if self.preset & ZERO_BASED else 1)
        if self.preset & 0xFFFF == VCF_PRESET:
            return cells[self.seq - 1], start, start + max(1, len(cells[3]))
        return cells[self.seq - 1], start, int(cells[self.end - 1]) if self.end else start + 1

    def name_of(self, chrom: str) -> str | None:
        """The index's name for a contig, which may be written with or without ``chr``."""
        other = chrom[3:] if chrom.startswith("chr") else f"chr{chrom}"
        return next((c for c in (chrom, other) if c in self.names), None)

    def chunks(self, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that may hold rows of a region."""
        name = self.name_of(chrom)
        if name is None or end <= start:
            return []
        k = self.names.index(name)
        ahead = self.linear[k] if self.linear else []
        least = ahead[min(start >> SHIFT, len(ahead) - 1)] if ahead else 0
        found = self.bins[k]
        return sorted(c for b in region_bins(start, end, self.shift, self.depth, found) for c in found[b] if c[1] > least)


def bin_of(start: int, end: int, shift: int = SHIFT, depth: int = DEPTH) -> int:
    """Smallest bin that holds [start, end): bins of a level are numbered behind those of all wider ones."""
    last = max(start, end - 1)
    for level in range(depth, 0, -1):
        width = shift + 3 * (depth - level)
        if start >> width == last >> width:
            return (8**level - 1) // 7 + (start >> width)
    return 0


def region_bins(start: int, end: int, shift: int, depth: int, present: dict) -> list[int]:
    """Bins among ``present`` that may hold rows of [start, end)."""
    spans = [((8**k - 1) // 7, shift + 3 * (depth - k)) for k in range(depth + 1)]
    ranges = [(first + (start >> width), first + ((end - 1) >> width)) for first, width in spans]
    return [b for b in present if any(lo <= b <= hi for lo, hi in ranges)]


def parse_index(data: bytes) -> Index:
    """A TBI or CSI file, block-gzipped or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    plain = data[:4] == b"TBI\1"
    if not plain and data[:4] != b"CSI\1":
        raise ValueError("neither a TBI nor a CSI index")
    if plain:
        n_ref, at, shift, depth = struct.unpack_from("<i", data, 4)[0], 8, SHIFT, DEPTH
    else:
        shift, depth, extra = struct.unpack_from("<3i", data, 4)
        at = 16
        if extra < 28:
            raise ValueError("a CSI index without the columns of a table")
    preset, seq, begin, end, meta, skip, size = struct.unpack_from("<7i", data, at)
    names = [x.decode() for x in data[at + 28 : at + 28 + size].split(b"\0")[:-1]]
    at = at + 28 + size if plain else 16 + extra
    if not plain:
        n_ref, at = struct.unpack_from("<i", data, at)[0], at + 4
    out = Index(names, preset, seq, begin, end, chr(meta), skip, shift, depth)
    summary = (8 ** (depth + 1) - 1) // 7 + 1  # a bin of statistics, not of rows
    for _ in range(n_ref):
        n_bin, at = struct.unpack_from("<i", data, at)[0], at + 4
        bins: dict[int, list[tuple[int, int]]] = {}
        for _ in range(n_bin):
            number, at = struct.unpack_from("<I", data, at)[0], at + (4 if plain else 12)
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            if number != summary:
                bins[number] = [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(n)]
            at += 16 * n
        out.bins.append(bins)
        if plain:
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            out.linear.append(list(struct.unpack_from(f"<{n}Q", data, at)))
            at += 8 * n
    return out


def format_index(index: Index, csi: bool = False) -> bytes:
    """The index as a TBI file, or as a CSI one."""
    names = b"".join(n.encode() + b"\0" for n in index.names)
    columns = struct.pack("<7i", index.preset, index.seq, index.begin, index.end, ord(index.meta), index.skip, len(names)) + names
    n_ref = struct.pack("<i", len(index.names))
    out = [b"CSI\1", struct.pack("<3i", index.shift, index.depth, len(columns)), columns, n_ref] if csi else [b"TBI\1", n_ref, columns]
    for k, bins in enumerate(index.bins):
        out.append(struct.pack("<i", len(bins)))
        for number, chunks in sorted(bins.items()):
            first = struct.pack("<Q", chunks[0][0]) if csi else b""
            out += [struct.pack("<I", number), first, struct.pack("<i", len(chunks)), *[struct.pack("<QQ", *c) for c in chunks]]
        if not csi:
            out.append(struct.pack(f"<i{len(index.linear[k])}Q", len(index.linear[k]), *index.linear[k]))
    return bgzf(b"".join(out))


class Writer:
    """Writes sorted lines as block gzip and keeps their index; one block's text is held."""

    def __init__(self, sink, like: Index):
        self.sink, self.like = sink, like
        self.held, self.at, self.names = bytearray(), 0, []
        self.bins: list = []
        self.linear: list = []
        self.last = -1

    def offset(self) -> int:
        return self.at << 16 | len(self.held)

    def flush(self) -> None:
        if self.held:
            block = bgzf(bytes(self.held))[: -len(BGZF_END)]
            self.sink.write(block)
            self.at += len(block)
            self.held.clear()

    def add(self, line: str) -> None:
        name, start, end = self.like.row(line)
        if not self.names or name != self.names[-1]:
            if name in self.names:
                raise ValueError(f"rows of {name} are not together")
            self.names.append(name)
            self.bins.append(defaultdict(list))
            self.linear.append([])
            self.last = -1
        if start < self.last:
            raise ValueError(f"rows of {name} are not sorted by position")
        self.last = start
        first = self.offset()
        data = line.encode() + b"\n"
        while data:
            room = BGZF_BLOCK - len(self.held)
            self.held += data[:room]
            data = data[room:]
            if len(self.held) == BGZF_BLOCK:
                self.flush()
        chunks, line_of = self.bins[-1][bin_of(start, end, self.like.shift, self.like.depth)], self.linear[-1]
        # rows of a bin that follow each other are one chunk
        if chunks and chunks[-1][1] == first:
            chunks[-1] = (chunks[-1][0], self.offset())
        else:
            chunks.append((first, self.offset()))
        while len(line_of) <= (end - 1) >> SHIFT:
            line_of.append(first)

    def close(self) -> Index:
        self.flush()
        self.sink.write(BGZF_END)
        i = self.like
        return Index(self.names, i.preset, i.seq, i.begin, i.end, i.meta, i.skip, i.shift, i.depth, [dict(b) for b in self.bins], self.linear)


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def chunk_lines(path: str, first: int, last: int) -> Iterator[str]:
    """Lines that begin in [first, last) of the virtual offsets; block after block is read."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        size, at, byte = f.size(), first >> 16, first & 0xFFFF
        held, begins = b"", first
        while at < size:
            head = f.read_at(HEAD, at)
            if head[:2] != b"\x1f\x8b" or head[12:14] != b"BC":
                raise ValueError(f"no block at byte {at} of {path}")
            n = struct.unpack_from("<H", head, 16)[0] + 1
            text = zlib.decompress(f.read_at(n - HEAD, at + HEAD), -15)
            while (stop := text.find(b"\n", byte)) >= 0:
                if begins >= last:
                    return
                yield (held + text[byte:stop]).decode()
                held, byte = b"", stop + 1
                begins = at << 16 | byte if byte < len(text) else (at + n) << 16
            if not held and byte < len(text):
                begins = at << 16 | byte
            held += text[byte:]
            at, byte = at + n, 0
            if begins >= last:
                return
        if held and begins < last:
            yield held.decode()


def write_indexed(df: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Rows (chrom, start, end and other columns, as tab-delimited lines) in files that are sorted and indexed; the manifest
    (path, index, rows) is written beside them and returned.  Ranges of (chrom, start) are dealt to tasks, so no task sorts a contig."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    rest = [c for c in df.columns if c not in ("chrom", "start", "end")]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("chrom", "start", "end", *rest)])
    rows = df.where("chrom is not null and start is not null and end is not null").select("chrom", "start", line.alias("value"))
    rows = rows.repartitionByRange(files, "chrom", "start") if files else rows.repartitionByRange("chrom", "start")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, n, sink, out = f"{root}/{run}-{uuid.uuid4().hex}.gz", 0, None, None
        for p in parts:
            for value in p.value:
                if out is None:
                    sink = fs.open_output_stream(name, compression=None)
                    out = Writer(sink, Index([]))
                out.add(value)
                n += 1
        if out is not None:
            index = out.close()
            sink.close()
            with fs.open_output_stream(f"{name}.tbi", compression=None) as f:
                f.write(format_index(index))
            path = f"{folder}/{name.rpartition('/')[2]}"
            yield pd.DataFrame([(path, f"{path}.tbi", n)], columns=["path", "index", "rows"])

    done = rows.sortWithinPartitions("chrom", "start", "value").select("value").mapInPandas(write, "path string, index string, rows long")
    done.write.parquet(f"{folder}/manifest-{run}")
    return spark.read.parquet(f"{folder}/manifest-{run}")


def read_regions(files: DataFrame, regions: list[tuple[str, int, int]]) -> DataFrame:
    """region (its number), chrom, start, end and value (the line) of the rows of ``files`` (path, index) that overlap each of a list of
    regions.  Indexes are read by tasks; every chunk they point to is a row that a task reads, once for all regions that need it."""
    wanted = list(regions)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, where in zip(p.path, p["index"]):
                fs, name = _open(where)
                with fs.open_input_file(name) as f:
                    index = parse_index(f.read())
                users: dict = defaultdict(list)
                for r, region in enumerate(wanted):
                    for c in index.chunks(*region):
                        users[c].append(r)
                roles = [index.preset, index.seq, index.begin, index.end]
                out += [(path, a, b, u, roles, index.meta) for (a, b), u in users.items()]
            yield pd.DataFrame(out, columns=["path", "a", "b", "users", "roles", "meta"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, a, b, users, roles, meta in zip(p.path, p.a, p.b, p.users, p.roles, p.meta):
                like, out = Index([], *map(int, roles)), []
                names = {r: {wanted[r][0], wanted[r][0].removeprefix("chr"), f"chr{wanted[r][0]}"} for r in users}
                for line in chunk_lines(path, a, b):
                    if line.startswith(meta):
                        continue
                    chrom, start, end = like.row(line)
                    out += [(int(r), chrom, start, end, line) for r in users if chrom in names[r] and start < wanted[r][2] and end > wanted[r][1]]
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=["region", "chrom", "start", "end", "value"])
                        out = []
                yield pd.DataFrame(out, columns=["region", "chrom", "start", "end", "value"])

    chunks = files.select("path", "index").mapInPandas(find, "path string, a long, b long, users array<int>, roles array<int>, meta string")
    return chunks.repartition("path", "a").mapInPandas(read, "region int, chrom string, start long, end long, value string")


def read_region(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of one block-gzip file with its index beside it (``.tbi``, else ``.csi``)."""
    fs, name = _open(path)
    kinds = [x for x in (".tbi", ".csi") if fs.get_file_info(name + x).type == pafs.FileType.File]
    if not kinds:
        raise FileNotFoundError(f"no index beside {path}")
    return read_regions(spark.createDataFrame([(path, path + kinds[0])], "path string, index string"), [(chrom, start, end)]).drop("region")
