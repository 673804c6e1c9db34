"""SRC1 to SRC3: BAM files as a Python data source; files are split at their blocks, records come in Arrow batches."""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, contig string, pos int, mapq int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>, nm int"
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
BATCH = 10_000
#: Least bytes of a file that a task reads; 0 leaves files whole.
SPLIT_BYTES = 1 << 27
#: Records in a row that must make sense where a task looks for its first one.
CHAIN = 8
LARGEST_BLOCK = 1 << 16
#: Head of a BGZF block and its extra field (fixed values).
MAGIC, EXTRA = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def inflate(path: str, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of the blocks of a BGZF file from the one that begins at ``at``."""
    with open(path, "rb") as f:
        f.seek(at)
        while head := f.read(18):
            if head[:4] != MAGIC:
                raise ValueError(f"{path} is no BGZF file")
            size = struct.unpack("<H", head[16:18])[0] + 1
            yield at, zlib.decompress(f.read(size - 18)[:-8], -15)
            at += size


def block_after(path: str, at: int) -> int | None:
    """Where the first block at or after ``at`` begins: a block's head with another head, or the file's end, behind it."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(at)
        window = f.read(2 * LARGEST_BLOCK + 18)

        def size(i: int) -> int:
            head = window[i : i + 18]
            return struct.unpack("<H", head[16:18])[0] + 1 if len(head) == 18 and head[:4] == MAGIC and head[10:16] == EXTRA else 0

        i = window.find(MAGIC)
        while i >= 0:
            n = size(i)
            if n and (at + i + n == end or size(i + n)):
                return at + i
            i = window.find(MAGIC, i + 1)
    if at + len(window) < end:
        raise ValueError(f"{path} is no BGZF file")
    return None


class Bytes:
    """A byte stream over inflated blocks that knows in which block it is."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.held, self.at = blocks, b"", 0
        self.ends: list[tuple[int, int, int]] = []  # of each block held: end and start in ``held``, place in the file

    def _more(self) -> bool:
        place, data = next(self.blocks, (None, b""))
        if place is None:
            return False
        used, self.at = self.at, 0
        self.held = self.held[used:]
        self.ends = [(e - used, a - used, p) for e, a, p in self.ends if e > used]
        self.ends.append((len(self.held) + len(data), len(self.held), place))
        self.held += data
        return True

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end, which stay."""
        while len(self.held) - self.at < n and self._more():
            pass
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            if out:
                raise ValueError("the file ends inside a record")
            return b""
        self.at += n
        return out

    def where(self) -> tuple[int, int] | None:
        """(place of the block, place in it) of the next byte, nothing at the end."""
        if not self.peek(1):
            return None
        _, start, place = next(x for x in self.ends if x[0] > self.at)
        return place, self.at - start


def references(s: Bytes) -> list[tuple[str, int]]:
    """SRC4: names and lengths of the header."""
    if s.take(4) != b"BAM\x01":
        raise ValueError("no BAM header")
    s.take(struct.unpack("<i", s.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        name = s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", s.take(4))[0]))
    return out


def bam_contigs(path: str) -> list[tuple[str, int, int]]:
    """SRC4: name, length and place in the header of every contig of a BAM file."""
    first = sorted(p for part in path.split(",") for p in glob.glob(part))[0]
    return [(name, length, i) for i, (name, length) in enumerate(references(Bytes(inflate(first))))]


#: Two letters for each byte of packed bases.
PAIRS = [a + b for a in BASES for b in BASES]


def nm_tag(tags: bytes) -> int | None:
    i = 0
    while i < len(tags):
        name, kind = tags[i : i + 2], chr(tags[i + 2])
        i += 3
        if name == b"NM" and kind in NUMBERS:
            return struct.unpack(NUMBERS[kind], tags[i : i + SIZES[kind]])[0]
        if kind in "ZH":
            i = tags.index(0, i) + 1
        elif kind == "B":
            i += 5 + SIZES[chr(tags[i])] * struct.unpack("<i", tags[i + 1 : i + 5])[0]
        else:
            i += SIZES[kind]
    return None


def record(raw: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack("<iiBBHHHi", raw[:20])
    at = 32
    name = raw[at : at + n_name - 1].decode()
    at += n_name
    cigar = [{"op": OPS[x & 15], "len": x >> 4} for x in struct.unpack(f"<{n_cigar}I", raw[at : at + 4 * n_cigar])]
    at += 4 * n_cigar
    packed = raw[at : at + (n_seq + 1) // 2]
    seq = "".join(map(PAIRS.__getitem__, packed))[:n_seq]
    at += (n_seq + 1) // 2
    qual = list(raw[at : at + n_seq])
    if qual and qual[0] == 255:
        qual = []
    return name, flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar, seq, qual, nm_tag(raw[at + n_seq :])


def makes_sense(s: Bytes, at: int, n_refs: int) -> int | None:
    """The size of the record ``at`` bytes ahead if there can be one, 0 at the stream's end, nothing if there can't."""
    head = s.peek(at + 36)[at:]
    if len(head) < 36:
        return None if head else 0
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos, _ = struct.unpack("<iiiBBHHHiiii", head)
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return None
    rest = s.peek(at + 36 + n_name + 4 * n_cigar)[at + 36 :]
    name, cigar = rest[:n_name], rest[n_name:]
    if len(cigar) < 4 * n_cigar or name[-1] or any(not 33 <= c <= 126 for c in name[:-1]) or any(c & 15 > 8 for c in cigar[::4]):
        return None
    return size + 4


def first_record(path: str, at: int, n_refs: int) -> tuple[int, int] | None:
    """(place of the block, place in it) of the first record that begins in a block at or after ``at``."""
    block = block_after(path, at)
    if block is None:
        return None
    s = Bytes(inflate(path, block))
    while s.peek(36):
        ahead = 0
        for _ in range(CHAIN):
            size = makes_sense(s, ahead, n_refs)
            if not size:
                break
            ahead += size
        if size or (size == 0 and ahead):
            return s.where()
        s.take(1)
    return None


@dataclass
class FilePart(InputPartition):
    """The records that begin in the blocks of a file that begin in [first, last)."""

    path: str
    first: int
    last: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part))
        if not self.paths:
            raise FileNotFoundError(options["path"])
        self.contig, self.first, self.last = options.get("contig"), int(options.get("first", 0)), int(options.get("last", 2**31 - 1))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[FilePart]:
        parts = []
        for p in self.paths:
            size = max(1, os.path.getsize(p))
            step = self.split or size
            parts += [FilePart(p, a, min(a + step, size)) for a in range(0, size, step)]
        return parts

    def _records(self, part: FilePart) -> Iterator[tuple]:
        s = Bytes(inflate(part.path))
        names = [n for n, _ in references(s)]
        here = begin = s.where()  # the first record of the file
        if here and here[0] < part.first:
            here = first_record(part.path, part.first, len(names))
            if here:
                s = Bytes(inflate(part.path, here[0]))
                s.take(here[1])
        while here and here[0] < part.last:
            yield record(s.take(struct.unpack("<i", s.take(4))[0]), names)
            here = s.where()
        # Where the next task begins, as it finds it itself unless that is where the header ends.
        if begin and begin[0] < part.last and first_record(part.path, part.last, len(names)) != here:
            raise ValueError(f"{part.path} can't be split at {part.last}; read it with split_bytes 0")

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])), pa.string(), pa.list_(pa.int32()), pa.int32()]
        columns = [x.split()[0] for x in SCHEMA.replace("array<struct<op:string,len:int>>", "x").split(", ")]
        rows: list[tuple] = []
        for r in self._records(partition):
            span = sum(x["len"] for x in r[5] if x["op"] in "MDN=X") or 1
            if self.contig is None or (r[2] == self.contig and r[3] <= self.last and r[3] + span > self.first):
                rows.append(r)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)


class BamSource(DataSource):
    """``spark.dataSource.register(BamSource)``, then ``spark.read.format("bam").option("path", ...).load()``.

    ``path`` may be a pattern or several paths with commas; ``contig``, ``first``
    and ``last`` (0-based) keep the records that overlap a region. Large files are
    split at blocks into parts of ``split_bytes``: a task looks for the first record
    that begins in its part, and the task before it, which gets there record by
    record, proves that it is the right one. A missing or damaged file fails the
    job, and so does one in which a task would begin at a wrong record.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)
