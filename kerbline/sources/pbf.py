"""Spark data source `osmpbf`: nodes, ways and header of an OSM PBF extract, or of all those in a folder.

The driver reads only the length and header of each blob of each file; a partition is a run of blobs of one file, the largest
first, which a task inflates and decodes one at a time into Arrow batches. Files open through pyarrow's file systems (local
paths or URIs). In a folder, files of every depth whose names end in .pbf are read; extracts
that overlap give their common nodes and ways as often as they hold them.

    spark.dataSource.register(OsmPbf)
    spark.read.format("osmpbf").option("kind", "nodes").load(path)     # or ways, header
        .option("box", "south,west,north,east")   # nanodegrees: only nodes inside (borders included)
        .option("ids", "from,to")                 # only nodes or ways with these ids (both included)
        .option("tag", "highway")                 # only ways that have this key

What the options leave out is dropped before Arrow batches are made; nodes are filtered as arrays. Parts of a block that the
kind or the options do not ask for are not decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "nodes": "id bigint, lat bigint, lon bigint",
    "ways": "way_id bigint, refs array<bigint>, tags map<string, string>",
    "header": "min_lat bigint, max_lat bigint, min_lon bigint, max_lon bigint",
}
#: Compressed bytes of one partition.
PARTITION_BYTES = 32 << 20


def varints(data: bytes) -> np.ndarray:
    """All varints of a packed field, as unsigned 64-bit numbers."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    parts = (b[: ends[-1] + 1].astype(np.uint64) & np.uint64(127)) << (np.uint64(7) * place.astype(np.uint64))
    return np.bitwise_or.reduceat(parts, starts)


def zigzag(n: np.ndarray) -> np.ndarray:
    return (n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers for varints, bytes for the rest."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
            yield key >> 3, value
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            yield key >> 3, data[at : at + size]
            at += size


def signed(n: int) -> int:
    """A plain (not zigzag) signed varint."""
    return n - (1 << 64) if n >> 63 else n


def inflate(blob: bytes) -> bytes:
    at = dict(fields(blob))
    if 1 in at:
        return at[1]
    if 3 in at:
        return zlib.decompress(at[3])
    raise ValueError("only raw and zlib blobs can be read")


def decode_block(block: bytes, kind: str = "", tag: str | None = None) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray, dict[str, str]]]]:
    """Node arrays (rows id, lat, lon) and ways (those with a tag, if one is given) of all groups of a primitive block; of one kind, if it is given."""
    top, groups = {17: 100, 19: 0, 20: 0}, []
    raw_strings: bytes = b""
    for f, v in fields(block):
        if f == 1:
            raw_strings = v
        elif f == 2:
            groups.append(v)
        elif f in (17, 19, 20):
            top[f] = signed(v)
    strings = [] if kind == "nodes" else [s.decode() for _, s in fields(raw_strings)]
    if tag is not None and tag not in strings and kind == "ways":
        return [], []
    nodes, ways = [], []
    place = lambda raw, offset: offset + top[17] * raw
    for group in groups:
        plain = []
        for f, v in fields(group):
            if f == 1 and kind != "ways":
                n = dict(fields(v))
                plain.append([int(zigzag(np.array([n.get(k, 0)], np.uint64))[0]) for k in (1, 8, 9)])
            elif f == 2 and kind != "ways":
                d = dict(fields(v))
                ids, lats, lons = (zigzag(varints(d.get(k, b""))).cumsum() for k in (1, 8, 9))
                nodes.append(np.stack([ids, place(lats, top[19]), place(lons, top[20])]))
            elif f == 3 and kind != "nodes":
                w = dict(fields(v))
                keys, vals = varints(w.get(2, b"")).tolist(), varints(w.get(3, b"")).tolist()
                tags = {strings[k]: strings[x] for k, x in zip(keys, vals, strict=True)}
                if tag is None or tag in tags:
                    ways.append((signed(w.get(1, 0)), zigzag(varints(w.get(8, b""))).cumsum(), tags))
        if plain:
            p = np.array(plain, np.int64).T
            nodes.append(np.stack([p[0], place(p[1], top[19]), place(p[2], top[20])]))
    return nodes, ways


class Run(InputPartition):
    def __init__(self, path: str, blobs: list[tuple[int, int]]):
        self.path, self.blobs = path, blobs


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(path: str) -> list[str]:
    """path, or the .pbf files of every depth below it if it is a folder."""
    system, name = located(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    begin = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted(begin + i.path for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".pbf"))


def open_file(path: str):
    system, name = located(path)
    return system.open_input_file(name)


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, partition_bytes: int, box: str | None = None, ids: str | None = None, tag: str | None = None):
        self.path, self.kind, self.partition_bytes, self.tag = path, kind, partition_bytes, tag
        numbers = lambda text, n: None if text is None else self.numbers(text, n)
        self.box, self.ids = numbers(box, 4), numbers(ids, 2)

    @staticmethod
    def numbers(text: str, n: int) -> list[int]:
        found = [int(x) for x in text.split(",")]
        if len(found) != n:
            raise ValueError(f"{n} numbers are needed, not {text!r}")
        return found

    def partitions(self) -> list[Run]:
        runs = [r for path in files(self.path) for r in self.runs(path)]
        return sorted(runs, key=lambda r: -sum(size for _, size in r.blobs)) or [Run(self.path, [])]

    def runs(self, path: str) -> list[Run]:
        """The blobs of a file in runs of about partition_bytes."""
        wanted = b"OSMHeader" if self.kind == "header" else b"OSMData"
        runs: list[Run] = []
        held = 0
        with open_file(path) as f:
            while len(head := f.read(4)) == 4:
                at = dict(fields(f.read(int.from_bytes(head, "big"))))
                if at[1] == wanted:
                    if not runs or held + at[3] > self.partition_bytes:
                        runs.append(Run(path, []))
                        held = 0
                    runs[-1].blobs.append((f.tell(), at[3]))
                    held += at[3]
                    if self.kind == "header":
                        break
                f.seek(at[3], 1)
        return runs

    def kept(self, nodes: np.ndarray) -> np.ndarray:
        """Those of node arrays (id, lat, lon) that the options ask for."""
        good = np.ones(nodes.shape[1], bool)
        if self.box:
            south, west, north, east = self.box
            good &= (nodes[1] >= south) & (nodes[1] <= north) & (nodes[2] >= west) & (nodes[2] <= east)
        if self.ids:
            good &= (nodes[0] >= self.ids[0]) & (nodes[0] <= self.ids[1])
        return nodes[:, good]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        with open_file(run.path) as f:
            for at, size in run.blobs:
                f.seek(at)
                block = inflate(f.read(size))
                if self.kind == "header":
                    box = {k: int(zigzag(np.array([v], np.uint64))[0]) for k, v in fields(dict(fields(block)).get(1, b""))}
                    if box:
                        yield pa.RecordBatch.from_arrays([pa.array([box.get(k, 0)], pa.int64()) for k in (4, 3, 1, 2)], ["min_lat", "max_lat", "min_lon", "max_lon"])
                    continue
                nodes, ways = decode_block(block, self.kind, self.tag)
                if self.ids:
                    ways = [w for w in ways if self.ids[0] <= w[0] <= self.ids[1]]
                for n in nodes:
                    if (n := self.kept(n)).shape[1]:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in n], ["id", "lat", "lon"])
                if ways:
                    tags = pa.array([list(t.items()) for _, _, t in ways], pa.map_(pa.string(), pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in ways], pa.int64()), pa.array([r.tolist() for _, r, _ in ways], pa.list_(pa.int64())), tags], ["way_id", "refs", "tags"])


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("kind", "nodes"), int(self.options.get("partitionBytes", PARTITION_BYTES)), *map(self.options.get, ("box", "ids", "tag")))
