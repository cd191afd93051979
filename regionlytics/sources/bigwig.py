"""A Spark data source for bigWig files: ``spark.read.format("bigwig").load(path)``.

A bigWig file holds a tree of chromosome names, blocks of at most some thousand values, usually
compressed, and a tree over the blocks' places. The driver reads the names and walks the place tree
only as far down as it takes to have enough subtrees to deal out; a task walks its subtrees to their
blocks and reads those. Conditions on chrom, start and end are pushed into the source: subtrees and
blocks that they rule out aren't read. Files are opened through pyarrow's file systems, at the
places that are needed only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

# Marks and layouts of the format, without byte order.
MAGIC, NAMES_MAGIC, PLACES_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEADER, NAMES_HEAD, PLACES_HEAD, NODE, SECTION = "IHHQQQHHQQIQ", "IIIIQQ", "IIQIIIIQII", "BBH", "IIIIIBBH"
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3

PUSHDOWN_CONF = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "chrom string, start bigint, end bigint, value double"
#: Subtrees a partition that the driver looks for, values of a batch, and bytes read at once from neighbouring blocks.
SUBTREES, BATCH, STRETCH = 4, 200_000, 4 << 20


class _File:
    """Random access to a file by its path or URI; numbers come in the file's byte order."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.handle = where.open_input_file(name)
        magic = self.at(0, 4)
        self.order = next((o for o in "<>" if struct.unpack(o + "I", magic) == (MAGIC,)), "") if len(magic) == 4 else ""
        if not self.order:
            self.handle.close()
            raise ValueError(f"not a bigWig file: {path}")

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()

    def at(self, offset: int, size: int) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(size)

    def numbers(self, layout: str, offset: int) -> tuple:
        layout = self.order + layout
        return struct.unpack(layout, self.at(offset, struct.calcsize(layout)))


@dataclass(frozen=True)
class Bounds:
    """What rows must fulfil: chrom among ``chroms`` (None: any), start and end within the bounds, both included."""

    chroms: frozenset[str] | None = None
    start: tuple[float, float] = (-np.inf, np.inf)
    end: tuple[float, float] = (-np.inf, np.inf)

    def with_filter(self, f: ds.Filter) -> Bounds | None:
        """These bounds and f; None where f can't be told by bounds."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        value = getattr(f, "value", None)
        if name == "chrom" and isinstance(f, ds.EqualTo | ds.In):
            named = frozenset(value if isinstance(f, ds.In) else [value])
            return replace(self, chroms=named if self.chroms is None else self.chroms & named)
        if name in ("start", "end") and isinstance(value, int):
            low, high = getattr(self, name)
            kind = {ds.EqualTo: (value, value), ds.GreaterThan: (value + 1, high), ds.GreaterThanOrEqual: (value, high), ds.LessThan: (low, value - 1), ds.LessThanOrEqual: (low, value)}
            if type(f) in kind:
                return replace(self, **{name: (max(low, kind[type(f)][0]), min(high, kind[type(f)][1]))})
        return self if isinstance(f, ds.IsNotNull) else None

    def may_hold(self, first: tuple[int, int], last: tuple[int, int], known: list[int] | None) -> bool:
        """Whether rows between two places (chromosome number, base) may fulfil them. known: the numbers asked for, ascending."""
        chroms = known is None or any(first[0] <= c <= last[0] for c in known)
        if first[0] != last[0]:
            return chroms
        return chroms and first[1] <= self.start[1] and last[1] >= self.end[0] and last[1] > self.start[0] and first[1] < self.end[1]


@dataclass
class Layout:
    """What the driver reads of a file: chromosome numbers with names, the place tree's root, and whether blocks are compressed."""

    names: dict[int, str] = field(default_factory=dict)
    lengths: dict[int, int] = field(default_factory=dict)
    root: int = 0
    packed: bool = False

    @classmethod
    def of(cls, file: _File) -> Layout:
        head = file.numbers(HEADER, 0)
        out = cls(root=head[5] + struct.calcsize("=" + PLACES_HEAD), packed=head[10] > 0)
        if file.numbers("I", head[5]) != (PLACES_MAGIC,) or file.numbers("I", head[3]) != (NAMES_MAGIC,):
            raise ValueError("the trees of names and places aren't where the header says")
        key = file.numbers(NAMES_HEAD, head[3])[2]
        todo = [head[3] + struct.calcsize("=" + NAMES_HEAD)]
        while todo:
            at = todo.pop()
            leaf, _, n = file.numbers(NODE, at)
            item = f"{key}sII" if leaf else f"{key}sQ"
            for i in range(n):
                name, *rest = file.numbers(item, at + 4 + i * struct.calcsize("=" + item))
                if leaf:
                    out.names[rest[0]], out.lengths[rest[0]] = name.rstrip(b"\0").decode(), rest[1]
                else:
                    todo.append(rest[0])
        return out

    def numbers(self, bounds: Bounds) -> list[int] | None:
        return None if bounds.chroms is None else sorted(i for i, n in self.names.items() if n in bounds.chroms)


def _children(file: _File, node: int, bounds: Bounds, known: list[int] | None) -> tuple[bool, list[tuple[int, int]]]:
    """Whether a node of the place tree is a leaf, and the (offset, bytes) of what it leads to and bounds allow; nodes have no size."""
    leaf, _, n = file.numbers(NODE, node)
    kind = np.dtype([(x, file.order + "u4") for x in ("c", "s", "d", "e")] + [("at", file.order + "u8")] + [("size", file.order + "u8")] * bool(leaf))
    out = []
    for x in np.frombuffer(file.at(node + 4, n * kind.itemsize), kind).tolist():
        if bounds.may_hold((x[0], x[1]), (x[2], x[3]), known):
            out.append((x[4], x[5] if leaf else 0))
    return bool(leaf), out


def _values(data: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome number, starts, ends and values of an unpacked block."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + SECTION, data)
    at = struct.calcsize("=" + SECTION)
    if kind == BEDGRAPH:
        x = np.frombuffer(data, [("s", order + "u4"), ("e", order + "u4"), ("v", order + "f4")], n, at)
        return chrom, x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"].astype(np.float64)
    if kind == VARIABLE:
        x = np.frombuffer(data, [("s", order + "u4"), ("v", order + "f4")], n, at)
        return chrom, x["s"].astype(np.int64), x["s"].astype(np.int64) + span, x["v"].astype(np.float64)
    if kind != FIXED:
        raise ValueError(f"a block of unknown kind {kind}")
    s = start + step * np.arange(n, dtype=np.int64)
    return chrom, s, s + span, np.frombuffer(data, order + "f4", n, at).astype(np.float64)


def _stretches(blocks: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Blocks in file order, neighbouring ones together up to STRETCH bytes."""
    run: list[tuple[int, int]] = []
    for at, size in sorted(blocks):
        if run and (at != sum(run[-1]) or at + size - run[0][0] > STRETCH):
            yield run
            run = []
        run.append((at, size))
    if run:
        yield run


@dataclass
class Subtrees(ds.InputPartition):
    path: str
    nodes: list[int]


class BigWigReader(ds.DataSourceReader):
    def __init__(self, paths: list[str], wanted: int):
        self.paths, self.wanted, self.bounds = paths, wanted, Bounds()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            more = self.bounds.with_filter(f)
            if more is None:
                yield f
            else:
                self.bounds = more

    def partitions(self) -> list[Subtrees]:
        out = []
        for path in self.paths:
            with _File(path) as file:
                layout = Layout.of(file)
                known, nodes = layout.numbers(self.bounds), [layout.root]
                # one level after the other, until there are enough subtrees or the next level is blocks
                while 0 < len(nodes) < self.wanted * SUBTREES:
                    below = [_children(file, n, self.bounds, known) for n in nodes]
                    if any(leaf for leaf, _ in below):
                        break
                    nodes = [at for _, found in below for at, _ in found]
            share = -(-len(nodes) // self.wanted)
            out += [Subtrees(path, nodes[i : i + share]) for i in range(0, len(nodes), share or 1)]
        return out or [Subtrees("", [])]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        if not partition.nodes:
            return
        with _File(partition.path) as file:
            layout = Layout.of(file)
            known, todo, held, rows = layout.numbers(self.bounds), list(reversed(partition.nodes)), [], 0
            while todo:
                leaf, found = _children(file, todo.pop(), self.bounds, known)
                if not leaf:
                    todo += [at for at, _ in reversed(found)]
                    continue
                for run in _stretches(found):
                    data = file.at(run[0][0], sum(run[-1]) - run[0][0])
                    for at, size in run:
                        block = data[at - run[0][0] : at - run[0][0] + size]
                        held.append(self._kept(*_values(zlib.decompress(block) if layout.packed else block, file.order), layout))
                        rows += held[-1].num_rows
                        if rows >= BATCH:
                            yield from held
                            held, rows = [], 0
            yield from held

    def _kept(self, chrom: int, start: np.ndarray, end: np.ndarray, value: np.ndarray, layout: Layout) -> pa.RecordBatch:
        (a, b), (c, d) = self.bounds.start, self.bounds.end
        name = layout.names[chrom]
        good = (start >= a) & (start <= b) & (end >= c) & (end <= d) & (self.bounds.chroms is None or name in self.bounds.chroms)
        n = int(good.sum())
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), n), pa.array(start[good]), pa.array(end[good]), pa.array(value[good])], names=["chrom", "start", "end", "value"])


class BigWig(ds.DataSource):
    """The format ``bigwig``: rows (chrom, start, end, value) of one file, or of several in ``paths``, one a line. ``partitions``: tasks a file, 32 unless said."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        paths = self.options.get("paths") or self.options.get("path") or ""
        return BigWigReader([p for p in paths.split("\n") if p], int(self.options.get("partitions", 32)))


def is_bigwig(path: str) -> bool:
    """Whether the path is a file that begins as bigWig files do."""
    try:
        with _File(path):
            return True
    except (ValueError, OSError):
        return False


def read_bigwig(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """(chrom, start, end, value) of bigWig files. Lets the session push conditions into Python data sources."""
    spark.dataSource.register(BigWig)
    spark.conf.set(PUSHDOWN_CONF, "true")
    tasks = partitions or spark.sparkContext.defaultParallelism * 2
    return spark.read.format("bigwig").option("paths", path if isinstance(path, str) else "\n".join(path)).option("partitions", str(tasks)).load()
