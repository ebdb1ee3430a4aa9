"""Label propagation over blocks of a graph: edges are placed once, rounds send a label or a bit between blocks for each node next to them."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.shared import discard
from lorespan.shared import materialize as written

#: Edges of a block, each counted at both its ends.
BLOCK_EDGES = 1 << 20
#: Edges of the largest block that a task may hold.
MOST_EDGES = 3 << 20

#: What a row holds of block ``part``: links, weights and neighbours stay; state and what block ``src`` says are of one step; edges are laid out once.
LINKS, WEIGHTS, NEAR, STATE, SAID, ENDS = range(6)
ROWS = "part int, src int, open long, data binary, kind int"
_FIELDS = pa.schema([("part", pa.int32()), ("src", pa.int32()), ("open", pa.int64()), ("data", pa.binary()), ("kind", pa.int32())])

Row = tuple[int, int, int, bytes, int]

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def xxhash64(longs: np.ndarray, turn: int | None = None) -> np.ndarray:
    """Spark's ``xxhash64`` of a long, or of a long and an int."""
    with np.errstate(over="ignore"):
        x = np.uint64(42 + 8) + _P5 ^ _rotated(longs.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        x = _mixed(_rotated(x, 27) * _P1 + _P4)
        if turn is not None:
            x = x + _P5 + np.uint64(4) ^ np.uint64(turn & 0xFFFFFFFF) * _P1
            x = _mixed(_rotated(x, 23) * _P2 + _P3)
    return x.view(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in the fewest bytes that hold their values, arrays of flags as bits."""
    kinds, parts = [], []
    for x in arrays:
        if x.dtype == bool:
            kinds.append(("?", len(x)))
            parts.append(np.packbits(x).tobytes())
            continue
        low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        kinds.append((kind, len(x)))
        parts.append(x.astype(kind).tobytes())
    head = json.dumps(kinds).encode()
    return b"".join([struct.pack("<I", len(head)), head, *parts])


def unpack(data: bytes | pa.Buffer) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    view = memoryview(data)
    at = 4 + struct.unpack("<I", view[:4])[0]
    arrays = []
    for kind, n in json.loads(bytes(view[4:at])):
        size = -(-n // 8) if kind == "?" else n * np.dtype(kind).itemsize
        x = np.frombuffer(view[at : at + size], np.uint8 if kind == "?" else kind)
        arrays.append(np.unpackbits(x, count=n).astype(bool) if kind == "?" else x)
        at += size
    return arrays


def _cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[len(sorted_keys) > 0, sorted_keys[1:] != sorted_keys[:-1]])


def _batch(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def _messages(part: int, send: np.ndarray, cut: np.ndarray, *values: np.ndarray, only: np.ndarray | None = None) -> list[Row]:
    """What a block says to each block next to it: its nodes' values in the order in which that block keeps them; nothing where ``only`` holds for none."""
    rows = []
    for to in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        mine = send[cut[to] : cut[to + 1]]
        if only is None or only[mine].any():
            rows.append((to, part, 0, pack(*(v[mine] for v in values)), SAID))
    return rows


def _votes(own: np.ndarray, labels: np.ndarray, near: np.ndarray, weights: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of edges sorted by ``own``: their nodes, the label that each wants, and whether it outweighs the one ``held`` by the node.

    ``near`` says where in ``labels`` an edge's neighbour is.
    """
    names, rank = np.unique(labels, return_inverse=True)
    key = own.astype(np.int64) * len(names) + rank[near]
    if (weights == weights[0]).all():
        key.sort()
        cut = _cuts(key)
        votes = np.diff(np.r_[cut, len(key)]) * weights[0].astype(np.int64)
    else:
        order = np.argsort(key)
        key = key[order]
        cut = _cuts(key)
        votes = np.add.reduceat(weights[order].astype(np.int64), cut)
    key = key[cut]
    node, label = key // len(names), names[key % len(names)]
    first = _cuts(node)
    most = np.maximum.reduceat(votes, first)
    best = np.flatnonzero(votes == np.repeat(most, np.diff(np.r_[first, len(node)])))
    best = best[np.searchsorted(best, first)]
    nodes = node[first]
    mine = label == held[node]
    now = np.full(len(held), np.iinfo(np.int64).min)
    now[node[mine]] = votes[mine]
    kept = np.zeros(len(held), bool)
    kept[node[mine]] = True
    return nodes, label[best], ~kept[nodes] | (most > now[nodes])


def deal(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the ends (node, other, weight, whether ``node`` is the edge's ``b``) of edges (a, b, weight) by the node's block."""

    def packed(got: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, b, weight = (np.concatenate(c) for c in zip(*got, strict=True))
        node = np.concatenate([a, b])
        block = np.mod(xxhash64(node), parts).astype(np.min_scalar_type(parts))
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(parts + 1))
        ends = [x[order] for x in (node, np.concatenate([b, a]), np.concatenate([weight, weight]), np.arange(len(node)) >= len(a))]
        return _batch([(p, -1, int(cut[p + 1] - cut[p]), pack(*(x[cut[p] : cut[p + 1]] for x in ends)), ENDS) for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for batch in batches:
            if batch.num_rows:
                got.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n >= BLOCK_EDGES // 2:
                yield packed(got)
                got, n = [], 0
        if got:
            yield packed(got)

    return run


def lay_out(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes blocks of the ends that ``deal`` packed, and the first round's wants."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[list[np.ndarray]]] = {}
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data"), strict=True):
                blocks.setdefault(part, []).append(unpack(data.as_buffer()))
        while blocks:
            yield laid_out(*blocks.popitem())

    def laid_out(part: int, got: list[list[np.ndarray]]) -> pa.RecordBatch:
        node, other, weight, side = (np.concatenate(c) for c in zip(*got, strict=True))
        got.clear()
        node, other = node.astype(np.int64), other.astype(np.int64)
        order = np.lexsort((other, node))
        node, other, weight, side = node[order], other[order], weight[order].astype(np.int64), side[order]
        begins = _cuts(node)
        if np.add.reduceat(np.abs(weight.astype(np.float64)), begins).max() >= 2**63:
            raise OverflowError("the weights of a node's edges don't fit a long")
        ids, side = node[begins], np.logical_and.reduceat(side, begins).astype(np.int8)
        once = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])])
        node, other, weight = node[once], other[once], np.add.reduceat(weight, once)
        own = np.repeat(np.arange(len(ids)), np.diff(np.r_[_cuts(node), len(node)]))
        # neighbours are kept by their block, then by number, the order in which their block sends
        halo, near = np.unique(other, return_inverse=True)
        owner = np.mod(xxhash64(halo), parts)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(halo), np.int64)
        place[order] = np.arange(len(halo))
        halo, cut, near = halo[order], np.searchsorted(owner[order], np.arange(parts + 1)), place[near]
        key = np.unique(owner[order][near] * len(ids) + own)
        send, send_cut = key % len(ids), np.searchsorted(key // len(ids), np.arange(parts + 1))
        _, wanted, wants = _votes(own, halo, near, weight, ids)
        return _batch([
            (part, -1, 0, pack(np.bincount(own), near, cut, send, send_cut), LINKS),
            (part, -1, 0, pack(weight), WEIGHTS),
            (part, -1, 0, pack(halo), NEAR),
            (part, -1, int(wants.sum()), pack(ids, side, ids, wanted, wants, np.zeros(len(ids), bool)), STATE),
            *_messages(part, send, send_cut, wants, side == 0, only=wants),
        ])

    return run


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, dict[int, list[np.ndarray]]]]]:
    """Each block of a partition with its rows' arrays by kind and source."""
    blocks: dict[int, dict[int, dict[int, list[np.ndarray]]]] = {}
    for b in batches:
        for part, src, data, kind in zip(b.column("part").to_pylist(), b.column("src").to_pylist(), b.column("data"), b.column("kind").to_pylist(), strict=True):
            blocks.setdefault(part, {k: {} for k in range(5)})[kind][src] = unpack(data.as_buffer())
    while blocks:
        yield blocks.popitem()


def move(turn: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of neighbours that want to change the one of the greatest urge moves; blocks say their labels and which are new."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            degree, near, cut, send, send_cut = rows[LINKS][-1]
            ids, side, labels, wanted, wants, _ = rows[STATE][-1]
            (halo,) = rows[NEAR][-1]
            rival, first = np.zeros(len(halo), bool), np.zeros(len(halo), bool)
            for src, (asks, is_a) in rows[SAID].items():
                rival[cut[src] : cut[src + 1]], first[cut[src] : cut[src + 1]] = asks, is_a
            own = np.repeat(np.arange(len(ids), dtype=np.int32), degree)
            both = np.flatnonzero(rival[near] & wants[own])
            own, near = own[both], near[both]
            turn_own, turn_near = (side == turn % 2)[own], (first == (turn % 2 == 0))[near]
            hash_own, hash_near = xxhash64(ids, turn)[own], xxhash64(halo, turn)[near]
            later = (hash_near > hash_own) | ((hash_near == hash_own) & (halo[near] > ids[own]))
            moved = wants.copy()
            moved[own[turn_near & ~turn_own | (turn_near == turn_own) & later]] = False
            labels = np.where(moved, wanted, labels)
            yield _batch([(part, -1, 0, pack(ids, side, labels, wanted, wants & ~moved, moved), STATE), *_messages(part, send, send_cut, labels, moved)])

    return run


def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes next to a new label count their neighbours' labels again, the others want what they wanted; blocks say who wants to change."""
    for part, rows in _by_part(batches):
        degree, near, cut, send, send_cut = rows[LINKS][-1]
        (weight,) = rows[WEIGHTS][-1]
        ids, side, labels, wanted, wants, moved = rows[STATE][-1]
        heard, new = np.empty(cut[-1], np.int64), np.empty(cut[-1], bool)
        for src, (said, is_new) in rows[SAID].items():
            heard[cut[src] : cut[src + 1]], new[cut[src] : cut[src + 1]] = said, is_new
        begins = np.cumsum(degree, dtype=np.int64) - degree
        stirred = np.logical_or.reduceat(new[near], begins)
        own = np.repeat(np.arange(len(ids), dtype=np.int32), degree)
        asked = np.flatnonzero(stirred[own])
        if len(asked):
            wanted, wants = wanted.astype(np.int64), wants.copy()
            nodes, best, more = _votes(own[asked], heard, near[asked], weight[asked], labels)
            wanted[nodes], wants[nodes] = best, more
        yield _batch([(part, -1, int(wants.sum()), pack(ids, side, labels, wanted, wants, moved), STATE), *_messages(part, send, send_cut, wants, side == 0, only=wants)])


def _labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column("data"):
            ids, _, labels, *_ = unpack(data.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(labels.astype(np.int64))], names=["node", "label"])


def labels_by_blocks(edges: DataFrame) -> DataFrame | None:
    """(node, label) of ``graph.label_communities`` for written edges (a, b, weight) of longs, or None where a block would be too large for a task.

    A block holds its nodes' edges as places in arrays and knows the labels of all neighbours, so that a round moves a
    label for each node and block next to it, not a row for each edge, and only nodes next to a new label count again.
    """
    spark = edges.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-2 * edges.count() // BLOCK_EDGES))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    if (nodes.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts))).count().agg(F.max("count")).first()[0] or 0) > MOST_EDGES:
        return None
    ends = edges.select("a", "b", F.col("weight").cast("long").alias("weight")).mapInArrow(deal(parts), ROWS)
    blocks = written(ends.repartitionById(parts, F.col("part")).mapInArrow(lay_out(parts), ROWS), "blocks", "kind")

    def step(work: Callable, now: DataFrame, *kinds: int) -> DataFrame:
        rows = blocks.filter(F.col("kind").isin(*kinds)).unionByName(now.filter(F.col("kind") >= STATE))
        return written(rows.repartitionById(parts, "part").mapInArrow(work, ROWS), "round", "kind")

    now, turn = blocks, 0
    while now.filter(F.col("kind") == STATE).agg(F.sum("open")).first()[0]:
        moved = step(move(turn), now, LINKS, NEAR)
        asked = step(vote, moved, LINKS, WEIGHTS)
        discard(moved, *([now] if turn else []))
        now, turn = asked, turn + 1
    labels = written(now.filter(F.col("kind") == STATE).select("data").mapInArrow(_labels, "node long, label long"), "labels")
    discard(blocks, *([now] if turn else []))
    return labels
