"""BAM files as a Spark data source: split inside files, ranged by an index where there is one.

A partition is a range of compressed bytes. Its task looks for the first block
that begins there, by the block's own header, and in it for the first alignment
record: an offset from which a chain of records with plausible fixed fields
follows. It reads the records that begin in its blocks, so each record belongs to
one partition, and holds a few blocks at a time, whatever the file's size. ord is
a record's virtual offset: the block's place in the file, then the place in it.

Files are opened by path, so they must lie where every executor sees them.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "chrom string, ord long, qname string, flag int, pos0 long, mapq int, cigar string, tlen int, seq string, qual array<int>, md string, mi string, sa string"
)
# Fixed values of the format.
_SEQ, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_MAGIC = b"\x1f\x8b\x08\x04"
#: Bytes of a partition, and records that must follow each other where a first one is looked for.
SPLIT_BYTES = 64 << 20
CHAIN = 6
_FIXED = struct.Struct("<iiBBHHHiiii")


def _block_size(head: bytes) -> int | None:
    """Whole size of the block with this header, or None if it is none."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head) - 2):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Blocks:
    """Inflated blocks of a file from one of them on, with where each begins."""

    def __init__(self, file, at: int):
        self.file, self.next = file, at
        self.data = b""
        #: (offset in data, place in the file) of the blocks held.
        self.starts: list[tuple[int, int]] = []

    def more(self) -> bool:
        """Take one more block; False at the end of the file."""
        self.file.seek(self.next)
        head = self.file.read(1 << 16)
        if not head:
            return False
        size = _block_size(head)
        if size is None:
            raise ValueError(f"no block at byte {self.next}")
        if size > len(head):
            head += self.file.read(size - len(head))
        self.starts.append((len(self.data), self.next))
        self.data += zlib.decompress(head[:size], 31)
        self.next += size
        return True

    def have(self, upto: int) -> bool:
        while len(self.data) < upto:
            if not self.more():
                return False
        return True

    def place(self, at: int) -> int:
        """Virtual offset of a byte of data."""
        begin, place = next(s for s in reversed(self.starts) if s[0] <= at)
        return place << 16 | at - begin

    def drop(self, before: int) -> int:
        """Forget the blocks that end at or before an offset; how many bytes went."""
        held = [s for s in self.starts if s[0] <= before]
        gone = held[-1][0] if held else 0
        if gone:
            self.data = self.data[gone:]
            self.starts = [(b - gone, p) for b, p in self.starts if b >= gone]
        return gone


def first_block(file, start: int, size: int) -> int | None:
    """Place of the first block at or after a byte; a block is followed by another one or by the end."""
    at = start
    while at < size:
        file.seek(at)
        window = file.read((1 << 17) + 18)
        found = window.find(_MAGIC)
        while 0 <= found < 1 << 17:
            length = _block_size(window[found : found + 64])
            if length:
                following = at + found + length
                file.seek(following)
                if following == size or _block_size(file.read(64)):
                    return at + found
            found = window.find(_MAGIC, found + 1)
        at += 1 << 17
    return None


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    #: Virtual offset of the first record.
    first: int


def read_header(path: str) -> Header:
    with open(path, "rb") as file:
        blocks = Blocks(file, 0)

        def take(at: int, n: int) -> bytes:
            if not blocks.have(at + n):
                raise ValueError(f"{path} ends in its header")
            return blocks.data[at : at + n]

        if take(0, 4) != b"BAM\x01":
            raise ValueError(f"{path} is no BAM file")
        size = struct.unpack("<i", take(4, 4))[0]
        text = take(8, size).rstrip(b"\0").decode()
        at = 8 + size
        names, lengths = [], []
        n = struct.unpack("<i", take(at, 4))[0]
        at += 4
        for _ in range(n):
            size = struct.unpack("<i", take(at, 4))[0]
            names.append(take(at + 4, size)[:-1].decode())
            lengths.append(struct.unpack("<i", take(at + 4 + size, 4))[0])
            at += 8 + size
        if not blocks.have(at + 1):  # no records
            return Header(text, names, lengths, blocks.next << 16)
        return Header(text, names, lengths, blocks.place(at))


def _plausible(blocks: Blocks, at: int, header: Header) -> int | None:
    """End of the record at an offset, or None if there can't be one."""
    if not blocks.have(at + 36):
        return None
    size = struct.unpack_from("<i", blocks.data, at)[0]
    ref, pos, name, _, _, ops, _, n, mate, mate_pos, _ = _FIXED.unpack_from(blocks.data, at + 4)
    if not (32 <= size < 1 << 28 and name and -1 <= ref < len(header.names) and -1 <= mate < len(header.names) and n >= 0):
        return None
    if 32 + name + 4 * ops + (n + 1) // 2 + n > size or not -1 <= pos or not -1 <= mate_pos:
        return None
    if (ref >= 0 and pos > header.lengths[ref]) or (mate >= 0 and mate_pos > header.lengths[mate]):
        return None
    if not blocks.have(at + 36 + name):
        return None
    text = blocks.data[at + 36 : at + 36 + name]
    if text[-1] or any(not 33 <= c <= 126 for c in text[:-1]):
        return None
    return at + 4 + size


def first_record(blocks: Blocks, header: Header) -> int | None:
    """Offset in the held data of the first record that begins in its first block, or None."""
    if not blocks.more():
        return None
    size = len(blocks.data)
    for at in range(size):
        end, links = at, 0
        while links < CHAIN:
            following = _plausible(blocks, end, header)
            if following is None:
                break
            end, links = following, links + 1
        if links == CHAIN or links and not blocks.have(end + 1) and end == len(blocks.data):
            return at
    return None


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            size, n = _SIZES[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + size * n
        else:
            at += _SIZES[kind]
    return out


def _row(record: bytes, names: list[str], ord_: int) -> tuple:
    ref, pos, name_size, mapq, _, n_ops, flag, n_seq, _, _, tlen = _FIXED.unpack_from(record)
    at = 32
    qname = record[at : at + name_size - 1].decode()
    at += name_size
    ops = struct.unpack_from(f"<{n_ops}I", record, at)
    at += 4 * n_ops
    packed = record[at : at + (n_seq + 1) // 2]
    at += len(packed)
    seq = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in packed)[:n_seq]
    qual = list(record[at : at + n_seq])
    tags = _tags(record[at + n_seq :])
    cigar = "".join(f"{op >> 4}{_OPS[op & 15]}" for op in ops) or None
    missing = not qual or qual[0] == 255
    return (
        names[ref] if ref >= 0 else None, ord_, qname, flag, pos, mapq, cigar, tlen, seq, None if missing else qual, tags.get("MD"), tags.get("MI"), tags.get("SA"),
    )


def records(path: str, start: int, end: int, header: Header | None = None) -> Iterator[tuple]:
    """Rows of the records that begin in blocks at bytes [start, end) of a file."""
    header = header or read_header(path)
    with open(path, "rb") as file:
        if start <= header.first >> 16:
            blocks = Blocks(file, header.first >> 16)
            at = header.first & 0xFFFF
        else:
            place = first_block(file, start, os.path.getsize(path))
            at = None
            while place is not None and place < end and at is None:
                blocks = Blocks(file, place)
                at = first_record(blocks, header)
                place = first_block(file, place + 1, os.path.getsize(path)) if at is None else place
            if at is None:
                return
        while blocks.have(at + 4):
            ord_ = blocks.place(at)
            if ord_ >> 16 >= end:
                return
            size = struct.unpack_from("<i", blocks.data, at)[0]
            if not blocks.have(at + 4 + size):
                raise ValueError(f"{path} ends in a record")
            yield _row(blocks.data[at + 4 : at + 4 + size], header.names, ord_)
            at += 4 + size
            at -= blocks.drop(at)


# ---- the index ------------------------------------------------------------------------------------------


def _bins(lo: int, hi: int) -> list[int]:
    """Numbers of the index bins that an interval meets."""
    hi -= 1
    return [0] + [b + i for shift, b in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for i in range(lo >> shift, (hi >> shift) + 1)]


def read_index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """For each reference the chunks of its bins and its linear index, as virtual offsets."""
    with open(path, "rb") as file:
        data = file.read()
    if data[:4] != b"BAI\x01":
        raise ValueError(f"{path} is no BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n_bins, at = struct.unpack_from("<i", data, at)[0], at + 4
        bins = {}
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", data, at)
            pairs = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            bins[number] = list(zip(pairs[::2], pairs[1::2], strict=True))
            at += 8 + 16 * n
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at))))
        at += 8 * n
    return out


def ranges(index: list, names: list[str], regions: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Byte ranges [start, end) of blocks that hold all records over the regions, joined where they touch."""
    found = []
    for chrom, lo, hi in regions:
        if chrom not in names or hi <= max(lo, 0):
            continue
        bins, linear = index[names.index(chrom)]
        window = max(lo, 0) >> 14
        least = linear[window] if window < len(linear) else (linear[-1] if linear else 0)
        found += [(max(a, least) >> 16, (b >> 16) + 1) for n in _bins(max(lo, 0), hi) for a, b in bins.get(n, []) if b > least]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


# ---- the source -----------------------------------------------------------------------------------------


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"]
        found = sorted(glob.glob(os.path.join(path, "*.bam"))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        self.paths, self.split = found, int(options.get("splitbytes", SPLIT_BYTES))
        listed = options.get("regions", "")
        self.regions = [(c, int(a), int(b)) for c, a, b in (r.rsplit(":", 2) for r in listed.split(";") if r)] if listed else None

    def partitions(self) -> list[Split]:
        out = []
        for path in self.paths:
            spans = [(0, os.path.getsize(path))]
            index = next((i for i in (f"{path}.bai", f"{path[:-4]}.bai") if os.path.exists(i)), None)
            if self.regions is not None and index:
                spans = ranges(read_index(index), read_header(path).names, self.regions)
            out += [Split(path, a, min(a + self.split, end)) for start, end in spans for a in range(start, end, self.split)]
        return out

    def read(self, partition: Split) -> Iterator[tuple]:
        yield from records(partition.path, partition.start, partition.end)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandloom_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)
