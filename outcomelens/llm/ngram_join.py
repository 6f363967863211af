"""N-gram Jaccard join through R-trees over count vectors.

A document's set is its distinct word shingles. Shingles are hashed into groups, and the counts of the groups are
a point: the overlap of two sets is at most the sum of the smaller coordinates of their points.

1. A scan task makes the sets. Sets of sizes that can link fall into size classes; a class cuts its groups into so
   many slices that two linked sets must agree in all group counts of one slice that is not empty. The
   slices' counts are the top of the tree: sets that agree in one meet in the same cell, others cannot link.
2. Cells with two or more sets get their points, at a resolution that follows the class. A small cell is a leaf; in a
   larger one an R-tree is packed over the points and joined with itself, from the root down, as long as
   size ranges and the sum of coordinate minima of two boxes allow a link. Very large cells are
   dealt out as pairs of tiles.
3. Pairs whose points allow a link are verified on the whole sets. A cell with many such pairs first sends a few per set;
   what is not connected by them is sent in a second round, so a group of copies never becomes all its pairs.
4. Links of verified pairs and of equal sets make the components.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import bounded, components, keyed

#: A cell of more sets is dealt out as pairs of tiles; one of more than a leaf gets a tree.
TILE, LEAF = 4096, 32
#: A cell that finds more pairs than this a set sends a few and is looked at again.
PAIRS_A_SET = 4
#: Slice keys are looked through in so many rounds, so their shuffle takes that part of its disk.
ROUNDS = 4
_CLASS_BITS = 6

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """The code of a word; remembered, but never more than half a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


def shingles(text: str | None, n: int, codes: Words) -> np.ndarray:
    """Sorted codes of the distinct n-word shingles of a whole text; a shorter text is one shingle, none without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    if len(code) < n:
        return scramble(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64))
    mixed = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        mixed = scramble(mixed ^ code[k : len(code) - n + 1 + k])
    return np.unique(mixed)


@dataclass(frozen=True)
class SizeClass:
    """Sets of ``low`` to ``high`` - 1 shingles and those that can link with one: touched slices, slices, spare ones."""

    number: int
    low: int
    high: int
    touched: int
    slices: int

    @property
    def spare(self) -> int:
        return self.slices - self.touched - 1


def size_class(number: int, percent: int, ratio: float = 1.6) -> SizeClass:
    """The classes cover 1, 2, ... without gaps; ``ratio`` is at least 100 / percent, so links cross one border at most."""
    ratio = max(ratio, 100 / percent)
    low, k = 1, 0
    while True:
        high = max(low + 1, math.ceil(low * ratio))
        if k == number:
            break
        low, k = high, k + 1
    touched = 2 * (high - 1) * (100 - percent) // (100 + percent)
    slices = touched + 1
    empty = slices * math.exp(-low * percent / 100 / slices)
    return SizeClass(number, low, high, touched, slices + (math.ceil(empty + 3 * math.sqrt(empty)) if touched else 0))


def classes_up_to(most: int, percent: int) -> list[SizeClass]:
    out = [size_class(0, percent)]
    while out[-1].high <= most:
        out.append(size_class(len(out), percent))
    return out


def slice_keys(codes: np.ndarray, one: SizeClass) -> np.ndarray:
    """A key for the group counts of each slice, with the class in its last bits.

    Linked sets agree in at least ``spare`` + 1 slices. So a set with at most ``spare`` empty slices needs no keys for
    those; one with more has keys for them too, and meets there only others with as many.
    """
    at = (codes >> np.uint64(20)) % np.uint64(one.slices)
    point = scramble((at << np.uint64(20)) | (codes & np.uint64(0xFFFFF)))
    sums, rows = np.zeros(one.slices, np.uint64), np.zeros(one.slices, np.int64)
    at = at.astype(np.int64)
    np.add.at(sums, at, point)
    np.add.at(rows, at, 1)
    keys = scramble(scramble(sums) ^ (np.arange(one.slices, dtype=np.uint64) << np.uint64(16)))
    keys = (keys << np.uint64(_CLASS_BITS)) | np.uint64(one.number)
    filled = rows > 0
    return keys if one.slices - filled.sum() > one.spare else keys[filled]


def count_vector(codes: np.ndarray, one: SizeClass) -> bytes:
    """Group counts of a set: about four shingles a group. 255 stands for that or more."""
    groups = 1 << max(5, math.ceil(math.log2(one.high / 4)))
    counts = np.bincount((codes >> np.uint64(44)).astype(np.int64) & (groups - 1), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _packed(point: bytes) -> bytes:
    """A point as it is kept and sent: one goes to every cell of its set, and small counts need few bits."""
    return zlib.compress(point, 6, -15)


def may_link(bound: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles that share at most ``bound`` can reach the similarity."""
    shared = np.minimum(bound, np.minimum(n, m))
    return 100 * shared >= percent * (n + m - shared)


class RTree:
    """A packed R-tree over count vectors; its boxes keep the largest counts and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        depth = max(0, math.ceil(math.log2(max(1, len(points)) / leaf)))
        ranges = [(0, len(points))]
        order = np.arange(len(points))
        self.levels: list[list[tuple[int, int]]] = [ranges]
        for _ in range(depth):
            halves = []
            for a, b in ranges:
                own = order[a:b]
                # cut across the widest side; the size is one of the coordinates
                box = points[own]
                spread = np.append(np.ptp(box, axis=0).astype(float), np.ptp(sizes[own]) / 4)
                side = int(spread.argmax())
                value = sizes[own] if side == points.shape[1] else box[:, side]
                order[a:b] = own[np.argsort(value, kind="stable")]
                halves += [(a, (a + b) // 2), ((a + b) // 2, b)]
            ranges = halves
            self.levels.append(ranges)
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.top = [np.stack([self.points[a:b].max(axis=0) for a, b in level]) for level in self.levels]
        self.least = [np.array([self.sizes[a:b].min() for a, b in level]) for level in self.levels]
        self.most = [np.array([self.sizes[a:b].max() for a, b in level]) for level in self.levels]

    def join(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different points (as given, each pair once) whose bound allows a link, leaf by leaf."""
        left = right = np.zeros(1, np.int64)
        for level in range(len(self.levels)):
            if level:
                left, right = np.tile(2 * left, 4), np.tile(2 * right, 4)
                left[len(left) // 2 :] += 1
                quarter = len(right) // 4
                right[quarter : 2 * quarter] += 1
                right[3 * quarter :] += 1
                once = left <= right
                left, right = left[once], right[once]
            least, most, top = self.least[level], self.most[level], self.top[level]
            low, high = np.maximum(least[left], least[right]), np.minimum(most[left], most[right])
            near = 100 * high >= percent * low
            left, right = left[near], right[near]
            bound = overlap_bound(top, left, right)
            # two of the smallest sets of the boxes need the least overlap
            keep = 100 * bound >= percent * np.maximum(least[left] + least[right] - bound, 1)
            left, right = left[keep], right[keep]
        ranges = self.levels[-1]
        for a, b in zip(left, right, strict=True):
            (i, j), (k, m) = ranges[a], ranges[b]
            x, y = np.meshgrid(np.arange(i, j), np.arange(k, m), indexing="ij")
            x, y = x.ravel(), y.ravel()
            if a == b:
                x, y = x[x < y], y[x < y]
            close = close_pairs(self.points, self.sizes, x, y, percent)
            if close.any():
                yield self.order[x[close]], self.order[y[close]]


def overlap_bound(points: np.ndarray, x: np.ndarray, y: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Sums of coordinate minima, a bounded number of cells at a time; a pair of full coordinates bounds nothing."""
    out = np.empty(len(x), np.int64)
    rows = max(1, step // points.shape[1])
    for at in range(0, len(x), rows):
        least = np.minimum(points[x[at : at + rows]], points[y[at : at + rows]])
        out[at : at + rows] = least.sum(axis=1, dtype=np.int64)
        out[at : at + rows][(least == 255).any(axis=1)] = 1 << 40
    return out


def close_pairs(points: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of points allow a link."""
    out = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
    rows = np.flatnonzero(out)
    bound = overlap_bound(points, x[rows], y[rows])
    out[rows] = may_link(bound, sizes[x[rows]], sizes[y[rows]], percent)
    return out


def _sets(n: int, percent: int):
    """Scan task: number, first equal set of the task, size, fingerprint, slice keys and points of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 36
        codes, firsts, ladder = Words(), {}, classes_up_to(1, percent)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("node", "first", "n", "f1", "f2", "class", "point", "upper")}
            keys, ends = [], [0]
            for text in batch.column(1).to_pylist():
                own = shingles(text, n, codes)
                size = len(own)
                f1, f2 = fingerprint(own)
                first = firsts.setdefault((size, f1, f2), node) if size else node
                at, point, upper, found = None, None, None, 0
                if size and first == node:
                    while ladder[-1].high <= -(-100 * size // percent) + 1:
                        ladder.append(size_class(len(ladder), percent))
                    at = bisect_right([c.low for c in ladder], size) - 1
                    for one in ladder[at : at + 2]:
                        if one.touched and (one.number == at or 100 * size >= percent * one.low):
                            keys.append(slice_keys(own, one))
                            found += len(keys[-1])
                            vector = _packed(count_vector(own, one))
                            point, upper = (vector, upper) if one.number == at else (point, vector)
                ends.append(ends[-1] + found)
                for c, v in zip(rows, (node, first, size, f1, f2, at, point, upper), strict=True):
                    rows[c].append(v)
                node += 1
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            kinds = {"class": pa.int32(), "point": pa.binary(), "upper": pa.binary()}
            columns = [pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, lists], names=["doc_id", *rows, "keys"])

    return run


def fingerprint(codes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        a, b = codes.sum(dtype=np.uint64), scramble(codes ^ _M3).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _cell_pairs(percent: int, again: bool):
    """Task over whole cells (key, node, n, point, component), sorted by key: pairs to verify.

    The first time, a cell with many pairs gives each set's pair with the lowest set, and a row without
    sets that says the cell is open. ``again`` gives every pair across components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for piece in (p for cells in _whole_cells(batches) for p in _pieces(cells, percent, again)):
            held.append(piece)
            count += piece.shape[1]
            if count >= 50_000:
                yield _rows_of(held)
                held, count = [], 0
        if held:
            yield _rows_of(held)

    return run


def _rows_of(pieces: list[np.ndarray]) -> pa.RecordBatch:
    key, a, b = np.concatenate(pieces, axis=1)
    void = a < 0
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a, mask=void), pa.array(b, mask=void)], names=["key", "a", "b"])


def _pieces(cells: dict[str, np.ndarray], percent: int, again: bool) -> Iterator[np.ndarray]:
    """Rows (key, a, b) of some whole cells, a bounded number of cells or leaves at a time."""
    key = cells["key"]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(starts[1:], len(key))
    width_of = np.array([len(cells["point"][k]) for k in starts])
    members = ends - starts
    for width in np.unique(width_of):
        small = np.flatnonzero((width_of == width) & (members > 1) & (members <= 2 * LEAF))
        for s in np.unique(members[small]):
            first = starts[small[members[small] == s]]
            step = max(1, min(200_000 // int(s * s), (8 << 20) // int(s * width)))
            for k in range(0, len(first), step):
                yield _leaf_pairs(cells, first[k : k + step], int(s), percent, again)
    for k in np.flatnonzero(members > 2 * LEAF):
        yield from _tree_pairs(cells, starts[k], ends[k], percent, again)


def _whole_cells(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[dict[str, np.ndarray]]:
    """Columns of some whole cells at a time; a cell is one tile pair at most, so this is bounded."""
    held: list[pa.RecordBatch] = []
    count = 0  # bytes
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if count >= size:
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(keys != last, True)) if keys[-1] != last else len(keys)
            if cut < len(keys):
                yield _columns([*held, batch.slice(0, cut)])
                held, count = [], 0
                batch = batch.slice(cut)
        held.append(batch)
        count += batch.nbytes
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    out = {c: table.column(c).to_numpy() for c in ("key", "node", "n", "component")}
    points = np.empty(table.num_rows, object)
    points[:] = [zlib.decompress(p, -15) for p in table.column("point").to_pylist()]
    return out | {"point": points}


def _matrix(points: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)


def _sent(key, node, component, x, y, members: int, again: bool) -> np.ndarray:
    """Rows (key, a, b) of one cell's close pairs, positions x and y."""
    if again:
        cross = component[x] != component[y]
        x, y = x[cross], y[cross]
        return np.stack([np.full(len(x), key), node[x], node[y]])
    if len(x) <= PAIRS_A_SET * members:
        return np.stack([np.full(len(x), key), node[x], node[y]])
    least = np.full(members, members)
    low, high = np.minimum(x, y), np.maximum(x, y)
    np.minimum.at(least, high, low)
    has = np.flatnonzero(least < members)
    rows = np.stack([np.full(len(has), key), node[has], node[least[has]]])
    return np.concatenate([rows, [[key], [-1], [-1]]], axis=1)


def _leaf_pairs(cells: dict, first: np.ndarray, s: int, percent: int, again: bool) -> np.ndarray:
    """Close pairs of cells of s sets each that begin at ``first``."""
    i, j = np.triu_indices(s, 1)
    rows = (first[:, None] + np.arange(s)).ravel()
    base = np.repeat(np.arange(len(first)) * s, len(i))
    x, y = base + np.tile(i, len(first)), base + np.tile(j, len(first))
    close = close_pairs(_matrix(cells["point"][rows]), cells["n"][rows], x, y, percent)
    x, y = x[close], y[close]
    node, component, key = cells["node"][rows], cells["component"][rows], cells["key"][rows]
    cell = x // s
    many = np.bincount(cell, minlength=len(first)) > PAIRS_A_SET * s
    if again or not many.any():
        keep = component[x] != component[y] if again else np.ones(len(x), bool)
        return np.stack([key[x[keep]], node[x[keep]], node[y[keep]]])
    few = ~many[cell]
    out = [np.stack([key[x[few]], node[x[few]], node[y[few]]])]
    for k in np.flatnonzero(many):
        own = cell == k
        part = slice(k * s, (k + 1) * s)
        out.append(_sent(key[k * s], node[part], component[part], x[own] - k * s, y[own] - k * s, s, again))
    return np.concatenate(out, axis=1)


def _tree_pairs(cells: dict, start: int, end: int, percent: int, again: bool) -> Iterator[np.ndarray]:
    """Close pairs of one large cell, leaf by leaf."""
    node, component, n = (cells[c][start:end] for c in ("node", "component", "n"))
    key = cells["key"][start]
    tree = RTree(_matrix(cells["point"][start:end]), n)
    least, count, found = np.full(len(node), len(node)), 0, [np.empty((2, 0), np.int64)]
    for x, y in tree.join(percent):
        if again:
            cross = component[x] != component[y]
            if cross.any():
                yield np.stack([np.full(cross.sum(), key), node[x[cross]], node[y[cross]]])
            continue
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        count += len(x)
        if count <= PAIRS_A_SET * len(node):
            found.append(np.stack([x, y]))
    if again:
        return
    if count <= PAIRS_A_SET * len(node):
        x, y = np.concatenate(found, axis=1)
        yield np.stack([np.full(len(x), key), node[x], node[y]])
        return
    has = np.flatnonzero(least < len(node))
    yield np.stack([np.full(len(has), key), node[has], node[least[has]]])
    yield np.array([[key], [-1], [-1]])


def _verified(percent: int):
    """Pairs (a, b, codes_a, codes_b) whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("codes_a"), batch.column("codes_b")
            keep = []
            for k in range(batch.num_rows):
                x, y = left[k].values.to_numpy(), right[k].values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _codes_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Words()
        for batch in batches:
            own = [shingles(text, n, codes) for text in batch.column(1).to_pylist()]
            prints = [fingerprint(s) for s in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())),
                ],
                names=["doc_id", "f1", "f2", "codes"],
            )

    return run


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs that link. Sets are made again from the texts of the documents concerned."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.table(sets.join(nodes, "node").select("node", "doc_id", "f1", "f2"), "wanted")
    ids = bounded(scratch.table(wanted.select(F.col("doc_id").alias("_id")).distinct(), "ids"))
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = texts.mapInArrow(_codes_of(n), f"doc_id {dict(docs.dtypes)['doc_id']}, f1 long, f2 long, codes array<long>")
    same = F.col("made.doc_id").eqNullSafe(F.col("wanted.doc_id"))
    for c in ("f1", "f2"):
        same = same & (F.col(f"made.{c}") == F.col(f"wanted.{c}"))
    codes = made.alias("made").join(wanted.alias("wanted"), same).select("node", "codes").dropDuplicates(["node"])
    codes = scratch.table(codes, "codes")
    rows = pairs.join(codes.select(F.col("node").alias("a"), F.col("codes").alias("codes_a")), "a")
    rows = rows.join(codes.select(F.col("node").alias("b"), F.col("codes").alias("codes_b")), "b")
    return rows.select("a", "b", "codes_a", "codes_b").mapInArrow(_verified(percent), "a long, b long")


def jaccard_components(docs: DataFrame, scratch: Scratch, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id, leader.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set is the distinct n-word shingles, or the whole
    sequence of fewer words. Two documents link when 100 * shared >= percent * union. ``component_id`` is the smallest
    doc_id reachable by links; ``leader`` is true for one row of each component, one with that id. Documents without
    words or text have size 0 and link with nothing; texts may have any length. Rows that repeat a doc_id are documents of their own; of
    a component in which all ids are null the component_id is null. Other columns are ignored.
    """
    if not 50 <= percent <= 99:
        raise ValueError("the similarity must be from 50 to 99 percent")
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, node long, first long, n long, f1 long, f2 long, class int, point binary, upper binary, keys array<long>"
    made = scratch.table(docs.mapInArrow(_sets(n, percent), schema), "made")
    made_at = scratch.paths[-1]
    sets = scratch.table(made.select("doc_id", "node", "first", "n", "f1", "f2"), "sets")

    # equal sets: of each task's first ones, the smallest number goes on alone
    firsts = sets.where("node = first and n > 0").select("node", "n", "f1", "f2")
    classes = firsts.groupBy("n", "f1", "f2").agg(F.min("node").alias("root"), F.count("*").alias("_copies")).where("_copies > 1")
    same = scratch.table(firsts.join(classes, ["n", "f1", "f2"]).where("node <> root").select("node", "root"), "same")

    keys = made.select("node", F.explode("keys").alias("key")).join(bounded(same.select("node")), "node", "left_anti")
    part, cell = F.pmod(F.shiftright("key", _CLASS_BITS), F.lit(ROUNDS)), Window.partitionBy("key")
    # sets that share many slices share many cells: of cells with the same members one stays, named by a hash of them
    one = F.shiftleft(F.bit_xor(F.xxhash64("node")).over(cell), _CLASS_BITS).bitwiseOR(
        F.col("key").bitwiseAND((1 << _CLASS_BITS) - 1)
    )
    rounds = []
    for k in range(ROUNDS):
        found = keys.where(part == k).withColumn("members", F.count("*").over(cell)).withColumn("_same", one).where("members > 1")
        # written, so that the shuffle files of a round's keys are gone by the next
        rounds.append(scratch.table(found.select(F.col("_same").alias("key"), "node", "members"), "round"))
    cells = scratch.table(reduce(DataFrame.unionByName, rounds).distinct(), "members")
    # a very large cell becomes pairs of tiles, each a cell of its own
    tiles = F.ceil(F.col("members") / TILE).cast("long")
    cells = cells.withColumn("_tiles", tiles).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_tiles")))
    cells = cells.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    cells = cells.select("node", F.when(F.col("_tiles") == 1, F.col("key")).otherwise(pair).alias("key"), F.col("key").bitwiseAND((1 << _CLASS_BITS) - 1).alias("_class"))
    cells = cells.join(made.select("node", "n", "class", "point", "upper"), "node").select(
        "key", "node", "n", F.when(F.col("_class") == F.col("class"), F.col("point")).otherwise(F.col("upper")).alias("point")
    )
    cells = scratch.table(cells, "cells")
    scratch.release(made_at)  # the keys are the largest table of all

    def close(rows: DataFrame, again: bool) -> DataFrame:
        rows = rows.select("key", "node", "n", "component", "point").repartition("key").sortWithinPartitions("key", "node")
        return rows.mapInArrow(_cell_pairs(percent, again), "key long, a long, b long")

    found = scratch.table(close(cells.withColumn("component", F.col("node")), False), "close")
    pairs = scratch.table(found.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = scratch.table(_verify(pairs, docs, sets, n, percent, scratch), "links")
    still = found.where("a is null").select("key").distinct()
    if still.take(1):
        known = components(links, scratch)
        open_cells = cells.join(still, "key", "left_semi").join(known, "node", "left")
        more = close(open_cells.withColumn("component", F.coalesce("component", "node")), True)
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        links = links.unionByName(_verify(scratch.table(more, "more"), docs, sets, n, percent, scratch))

    equal = sets.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    equal = equal.unionByName(same.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = scratch.table(components(links.unionByName(equal), scratch), "components")
    named = sets.select("node", "doc_id").join(found, "node")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("_least"))
    named = named.select("node", "component").join(least, "component").select(
        F.col("node").alias("_node"), F.col("_least.doc_id").alias("component_id"), (F.col("node") == F.col("_least.node")).alias("leader")
    )
    rows = sets.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, F.col("node") == F.col("_node"), "left")
    alone = F.col("_node").isNull()
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("leader", F.lit(True)).alias("leader"),
    )


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays: that with the smallest doc_id.

    Documents link as in ``jaccard_components``; of rows that repeat the smallest doc_id of a component one stays. Documents
    without words link with nothing and stay.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    rows = keyed(plain, scratch).withColumn("key", F.struct("_file", "_at")).drop("_file", "_at")
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    groups = jaccard_components(rows.select(F.col("key").alias("doc_id"), text.alias("text")), scratch, n, percent)
    groups = groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"))
    groups = scratch.table(groups, "groups")
    several = groups.groupBy("component").agg(F.count("*").alias("_rows")).where("_rows > 1").select("component")
    members = groups.join(several, "component").join(rows.select("key", doc_id.alias("id")), "key")
    best = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("best"))
    dropped = scratch.table(members.join(best, "component").where(F.col("key") != F.col("best.key")).select("key"), "dropped")
    kept = rows.join(bounded(dropped), "key", "left_anti")
    return kept.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(names)])
