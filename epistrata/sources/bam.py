"""Binary alignments (BAM) with their index (BAI), read in parallel by stretches of the chromosomes.

``spark.dataSource.register(BamSource)`` is done by ``read_bam``. The files must lie where all executors can open them."""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "chr string, qname string, pos long, xm string, xr string, xg string, quals array<int>"
#: Fixed values of the format: bases of a linear index's interval, sizes of tag values, and letters of packed bases.
INTERVAL = 1 << 14
TAG_SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
#: Bases that one task reads, at least.
SLAB = 64 * INTERVAL


class Blocks:
    """The bytes of a BGZF file from a virtual offset on."""

    def __init__(self, path: str, offset: int = 0):
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(offset >> 16)
        self.held = b""
        self._more()
        self.held = self.held[offset & 0xFFFF :]

    def _more(self) -> bool:
        head = self.file.read(12)
        if len(head) < 12:
            return False
        extra = self.file.read(struct.unpack("<H", head[10:12])[0])
        at, size = 0, None
        while at < len(extra):
            tag, n = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if tag == b"BC":
                size = struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
            at += 4 + n
        if head[:2] != b"\x1f\x8b" or size is None:
            raise ValueError("not a BGZF block")
        body = self.file.read(size - 12 - len(extra))
        self.held += zlib.decompress(body[:-8], -15)
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out

    def close(self) -> None:
        self.file.close()


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """Names and lengths of the chromosomes; the blocks then stand at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


def tags(raw: bytes, wanted: tuple[bytes, ...]) -> dict[bytes, str]:
    """The text tags among ``wanted``, by name."""
    at, out = 0, {}
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2], raw[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            end = raw.index(b"\0", at)
            if name in wanted:
                out[name] = raw[at:end].decode()
            at = end + 1
        elif kind == b"B":
            at += 5 + TAG_SIZES[raw[at : at + 1]] * struct.unpack("<i", raw[at + 1 : at + 5])[0]
        else:
            at += TAG_SIZES[kind]
    return out


def records(blocks: Blocks) -> Iterator[tuple[int, int, tuple]]:
    """(chromosome's number, position from 0, (qname, xm, xr, xg, quals)) of the records that follow."""
    while len(size := blocks.read(4)) == 4:
        r = blocks.read(struct.unpack("<i", size)[0])
        ref, pos, n_name, n_cigar, n_seq = *struct.unpack("<iiB", r[:9]), *struct.unpack("<H2xi", r[12:20])
        at = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2
        quals = list(r[at : at + n_seq])
        found = tags(r[at + n_seq :], (b"XM", b"XR", b"XG"))
        yield ref, pos, (r[32 : 32 + n_name - 1].decode(), found.get(b"XM"), found.get(b"XR"), found.get(b"XG"), [] if quals[:1] == [255] else quals)


def linear_index(path: str) -> list[list[int]]:
    """For each chromosome the virtual offset of the first record that reaches into each INTERVAL of it."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise ValueError("not a BAI file")
    at, out = 8, []
    for _ in range(struct.unpack("<i", raw[4:8])[0]):
        bins = struct.unpack("<i", raw[at : at + 4])[0]
        at += 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack("<i", raw[at + 4 : at + 8])[0]
        n = struct.unpack("<i", raw[at : at + 4])[0]
        out.append(list(struct.unpack(f"<{n}Q", raw[at + 4 : at + 4 + 8 * n])))
        at += 4 + 8 * n
    return out


@dataclass
class Slab(InputPartition):
    """Records of chromosome ``ref`` that begin in [start, end), from a virtual offset on; ref -1: the whole file."""

    ref: int
    start: int
    end: int
    offset: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")
        self.index = options.get("index") or (f"{self.path}.bai" if os.path.exists(f"{self.path}.bai") else None)
        self.slab = max(1, int(options.get("slab", SLAB)) // INTERVAL) * INTERVAL
        self.regions = [r.rsplit(":", 2) for r in options.get("regions", "").split(",") if r]

    def partitions(self) -> list[Slab]:
        """Stretches by the linear index; with ``regions`` (chr:start:end, from 1, both included) only those that a region touches."""
        if not self.index:
            return [Slab(-1, 0, 0, 0)]
        blocks = Blocks(self.path)
        names = header(blocks)
        blocks.close()
        out = []
        for ref, offsets in enumerate(linear_index(self.index)):
            name, length = names[ref]
            step = self.slab // INTERVAL
            for i in range(0, len(offsets), step):
                start = i * INTERVAL
                end = start + self.slab if i + step < len(offsets) else max(length, start + self.slab)
                # an alignment may begin in a stretch and be first met in an interval after it; zero: no record reaches into the interval
                offset = next((o for o in offsets[i:] if o), 0)
                if offset and (not self.regions or any(c == name and int(a) - 1 < end and int(b) > start for c, a, b in self.regions)):
                    out.append(Slab(ref, start, end, offset))
        return out

    def _near(self) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {}
        for c, a, b in sorted((c, int(a), int(b)) for c, a, b in self.regions):
            spans = out.setdefault(c, [])
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return out

    def read(self, partition: Slab):
        """Half-open stretches, so that a read comes once. With regions: reads whose calls reach into one."""
        whole = Blocks(self.path)
        names = [n for n, _ in header(whole)]
        near = self._near()
        if partition.ref < 0:
            blocks = whole
        else:
            whole.close()
            blocks = Blocks(self.path, partition.offset)
        for ref, pos, (qname, xm, xr, xg, quals) in records(blocks):
            if partition.ref >= 0 and (ref != partition.ref or pos >= partition.end):
                break
            if pos < partition.start and partition.ref >= 0:
                continue
            name = names[ref] if ref >= 0 else "*"
            if self.regions:
                spans = near.get(name, [])
                k = bisect.bisect_right(spans, (pos + max(1, len(xm or "")), float("inf"))) - 1
                if k < 0 or spans[k][1] < pos + 1:
                    continue
            yield name, qname, pos + 1 if ref >= 0 and pos >= 0 else None, xm, xr, xg, quals
        blocks.close()


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epistrata_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, slab: int = SLAB, index: str | None = None) -> DataFrame:
    """(chr, qname, pos, xm, xr, xg, quals) as ``sam.read_sam`` gives them: a task per stretch of ``slab`` bases if there is an index, else one.

    ``regions`` (chr, first, last; from 1): only stretches that the index says they touch are opened. Reads without place come only if there is no index."""
    if not os.path.exists(path.removeprefix("file:")):
        raise FileNotFoundError(path)
    spark.dataSource.register(BamSource)
    reader = spark.read.format("epistrata_bam").option("path", path).option("slab", str(slab))
    if index:
        reader = reader.option("index", index)
    if regions:
        reader = reader.option("regions", ",".join(f"{c}:{a}:{b}" for c, a, b in regions))
    return reader.load()
