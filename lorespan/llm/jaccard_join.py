"""Exact n-gram Jaccard join by universe partitioning.

A document is the set of its word shingles, as 64-bit hashes; sets that are equal (by 128 bits) are one
class. Sizes fall into bands so wide that similar sets lie in one band or in neighbouring ones. Two sets
with a Jaccard similarity of at least t differ in at most H = (a + b)(1 - t) / (1 + t)
elements, so of m > H segments of the hash universe at least m - H hold equal subsets. Each
set signs the subset that it has in each segment, under its own band's segments and, as the
smaller set of a pair, under those of the band above.

Allocation by cost: what a segment costs a set is the number of sets that its signature meets. Empty
subsets are free to share and cost the most, so they get nothing; others get one signature; of these a
set leaves out its most frequent ones, as many as the pairs that it can be in share beyond one. That finds
every pair of which one set has fewer than m - H empty segments. One-deletion neighbourhoods would allow
half as many segments, but cost a signature per element, about five times the index, so only the few sets
that equal segments can't guarantee sign them too; sets that even those can't guarantee meet in one block
per band.

Signatures whose groups have the same members are kept once. Members of a group are first compared with
its least one, exactly. A group that links leave with several components goes to one task, or to several
by pairs of blocks, whose bit maps bound every intersection across components from above; what passes is
compared exactly. So every pair across components is compared or ruled out, and copies are never expanded into
pairs. Up to a block rows grow with the members of groups; of k blocks each is dealt to k tasks, so a group or a
component of very many different sets makes rows in proportion to its members times its blocks.

Links lie inside components, so the links of each class are counted there: a component is dealt out by
pairs of blocks, whose tasks intersect whole sets. That takes time in proportion to a component's pairs
of different sets; who needs no number of links can leave it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.llm.common import ROW_BATCH_BYTES, bounded_batches, discard, forget, map_texts, materialize, slices, table

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Members of a signature group, and sets of a component, are compared in blocks of about so many.
BLOCK = 512
#: A block of whole sets holds about so many elements, unless one set alone has more.
BLOCK_ITEMS = 1 << 21
#: Bits of a bit map at most.
MOST_BITS = 1 << 14
#: Elements that more sets than this have are counted by a matrix product, the others pair by pair.
DENSE = 16
#: Classes or pairs that a task remembers, so as not to repeat them.
REMEMBERED = 500_000
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(29))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


class _Powers:
    """Powers of the hash base and of its inverse, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _BASE, np.uint64))))
            self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _BASE_INVERSE, np.uint64))))
        return self.up, self.down


_powers = _Powers()


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; of the whole sequence if it has fewer words.

    Words are runs of characters other than space and \\t to \\r, A to Z in lower case.
    """
    data = _LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    gaps = np.concatenate(([True], _SPACE[data], [True]))
    edges = np.flatnonzero(gaps[1:] != gaps[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers.upto(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = len(words) - size + 1
    if n < 1:
        return mix((words * _PLACE[: len(words)]).sum(keepdims=True) + _U(len(words)))
    total = words[:n] * _PLACE[0]
    for k in range(1, size):
        total += words[k : n + k] * _PLACE[k]
    return np.unique(mix(total + _U(size)))


def set_key(items: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    n = _U(len(items))
    return tuple(int(mix(mix(items ^ salt).sum(keepdims=True) + n)[0].astype(np.int64)) for salt in (_U(0), _U(0x5BD1E995A5A5F00D)))


@lru_cache(maxsize=64)
def bands(percent: int, most: int) -> tuple[tuple[int, int, int], ...]:
    """(smallest size, largest size, segments) of each band, up to a size of ``most``."""
    out, low = [], 1
    while low <= most or len(out) < 2:
        high = max(low, 100 * low // percent)
        differ = 2 * high * (100 - percent) // (100 + percent)
        out.append((low, high, differ + 2 + (differ + 1) // 12))
        low = high + 1
    return tuple(out)


def signatures(items: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set, under its own band and as the smaller set under the band above."""
    n = len(items)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    largest = 100 * n // percent  # of a set similar to this one
    table_ = bands(percent, 1 << max(8, (2 * n).bit_length()))
    at = int(np.searchsorted([b[1] for b in table_], n))
    out = []
    mixed = mix(items ^ _U(0xA5A5A5A5A5A5A5A5))
    for band in (at, at + 1):
        low, high, m = table_[band]
        if largest < low:
            continue
        differ = (n + min(high, largest)) * (100 - percent) // (100 + percent)
        if not differ:
            continue  # only equal sets, which are one class, are similar
        segment = ((items >> _U(32)) * _U(m)) >> _U(32)  # ascending, as the items are
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        sums = np.add.reduceat(mixed, first)
        tags = mix(segment[first] + _U((band + 1) << 32))
        begun = len(out)
        out.append(mix(sums ^ tags))
        if m - len(first) >= m - differ:  # too many empty segments to rely on equal ones
            sizes = np.diff(np.concatenate((first, [n])))
            out.append(mix(sums + tags * _U(3)))
            each = np.repeat(np.arange(len(first)), sizes)
            several = sizes[each] > 1
            out.append(mix((sums[each] - mixed + tags[each] * _U(3))[several]))
            if 2 * int((sizes > 1).sum()) + int((sizes == 1).sum()) <= differ:
                out.append(mix(np.array([(band + 1) << 48], dtype=np.uint64)))
        # the last bit tells under which of its two bands a set signs
        out[begun:] = [(x & ~_U(1)) | _U(band & 1) for x in out[begun:]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shared_at_least(items: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """How many signatures any similar set shares with this one, at the least, under its band of even and of odd number.

    At most ``differ`` segments are unequal, so of those that are not empty here all but ``differ`` are equal.
    """
    need, n = [1, 1], len(items)
    if n:
        largest = 100 * n // percent
        table_ = bands(percent, 1 << max(8, (2 * n).bit_length()))
        at = int(np.searchsorted([b[1] for b in table_], n))
        for band in (at, at + 1):
            low, high, m = table_[band]
            if largest >= low:
                segment = ((items >> _U(32)) * _U(m)) >> _U(32)
                differ = (n + min(high, largest)) * (100 - percent) // (100 + percent)
                need[band & 1] = max(1, 1 + int((segment[1:] != segment[:-1]).sum()) - differ)
    return need[0], need[1]


def bit_map(items: np.ndarray) -> bytes:
    """Bits that the elements set: 8 to 16 an element, a power of two, MOST_BITS at most."""
    bits = min(MOST_BITS, 64 << max(0, (len(items) - 1).bit_length() - 3))
    out = np.zeros(bits, dtype=np.uint8)
    out[(items >> _U(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out).tobytes()


def document_sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key, key2, even, odd (signatures that similar sets share at least) of every row."""

    def compute(texts: list[str]) -> list:
        forget()
        sets = [shingles(t, size) for t in texts]
        keys = [set_key(s) for s in sets]
        need = [shared_at_least(s, percent) for s in sets]
        return [[len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], [x[0] for x in need], [x[1] for x in need]]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).withColumn("text_hash", F.xxhash64("body"))
    return map_texts(rows, compute, [(f, "long") for f in ("n_shingles", "key", "key2", "even", "odd")], "id", "body", carry=("text_hash",), most=ROW_BATCH_BYTES)


def signature_rows(docs: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """(sig, key), each class about once in a task."""
    bounded_batches(docs.sparkSession, ROW_BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        for _, texts in slices(batches, 0):
            sigs, keys, times = [], [], []
            for text in texts:
                items = shingles(text, size)
                key = set_key(items)[0]
                if len(items) and key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    sigs.append(signatures(items, percent))
                    keys.append(key)
                    times.append(len(sigs[-1]))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), times))], names=["sig", "key"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sig long, key long")


def rare_signatures(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, cls) of signatures that several sets have, without each set's most frequent ones.

    If similar sets share c signatures or more, they share one that is not among the c - 1 most frequent of
    either, frequencies being the same for all. Sets that have fewer than c shared signatures leave altogether.
    Of signatures with the same members one is kept, told by their number and two sums of hashes.
    """
    by_sig = Window.partitionBy("sig")
    shared = rows.withColumn("low", F.min("key").over(by_sig)).withColumn("high", F.max("key").over(by_sig)).withColumn("times", F.count("*").over(by_sig))
    shared = materialize(shared.filter("low <> high").select("sig", "key", "times").distinct(), "shared")
    side = F.col("sig").bitwiseAND(1)
    by_set = Window.partitionBy("cls", side).orderBy(F.col("times").desc(), F.col("sig").desc())
    ranked = shared.join(classes.select("key", "cls", "even", "odd"), "key").withColumn("nth", F.row_number().over(by_set))
    kept = ranked.filter(F.col("nth") >= F.when(side == 0, F.col("even")).otherwise(F.col("odd"))).select("sig", "cls")
    small = F.shiftrightunsigned  # sums of 32-bit hashes don't overflow
    sums = [F.sum(small(F.xxhash64("cls", F.lit(k)), 32)).over(by_sig).alias(f"sum{k}") for k in (1, 2, 3, 4)]
    kept = materialize(kept.select("sig", "cls", F.count("*").over(by_sig).alias("size"), *sums).filter("size > 1"), "kept")
    discard(shared)
    alike = ["size", "sum1", "sum2", "sum3", "sum4"]
    once = kept.groupBy(*alike).agg(F.min("sig").alias("sig")).select("sig")
    groups = materialize(kept.join(once, "sig", "left_semi").select("sig", "cls"), "groups")
    discard(kept)
    return groups


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(cls, n, items, bits) of the wanted classes (id, text_hash, cls, key, key2), whose texts alone are cut into shingles again."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("body")).withColumn("row_hash", F.xxhash64("body"))
    # the planner broadcasts the wanted rows only below its limit of bytes
    picked = rows.join(wanted, (F.col("row_hash") == F.col("text_hash")) & F.col("row_id").eqNullSafe(F.col("id"))).select("row_id", "body", "cls", "key", "key2")

    def compute(texts: list[str]) -> list:
        sets = [shingles(t, size) for t in texts]
        keys = [set_key(s) for s in sets]
        return [[k[0] for k in keys], [k[1] for k in keys], [len(s) for s in sets], [s.view(np.int64) for s in sets], [bit_map(s) for s in sets]]

    fields = [("own", "long"), ("own2", "long"), ("n", "long"), ("items", "array<long>"), ("bits", "binary")]
    found = map_texts(picked, compute, fields, "row_id", "body", carry=("cls", "key", "key2"), most=ROW_BATCH_BYTES)
    # different texts of one id and hash are told apart by their sets
    found = materialize(found.filter("own = key AND own2 = key2").select("cls", "n", "items", "bits"), "items")
    # sets are large: they are shuffled to be made unique only if rows are repeated
    return found if found.count() == found.select("cls").distinct().count() else materialize(found.dropDuplicates(["cls"]), "items")


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the least class that links (a, b) lead to, by least labels of neighbours and pointer jumping."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("further"))
        now = materialize(nearer.join(jump, "comp", "left").select("cls", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        discard(labels)
        labels = now
        if now.filter("comp <> old").isEmpty():
            discard(both)
            return labels.select("cls", "comp")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def dealt(rows: DataFrame, group: str, blocks: Column, member: str = "cls") -> DataFrame:
    """Rows of each group by pairs of its blocks, x <= y: every two members meet in one pair; ``side`` is 0 in block x and 1 in block y."""
    placed = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.hash(member), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.select("*", other.alias("other"))
    met = met.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    met = met.drop("blocks", "own", "other")
    return met.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "side", member)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows whose first ``keys`` columns are equal, as rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[at] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def _bit_rows(maps: list[bytes]) -> np.ndarray:
    """Bit maps as rows of 64-bit words, all folded to the shortest."""
    width = min(map(len, maps))
    out = np.zeros((len(maps), width), dtype=np.uint8)
    for i, m in enumerate(maps):
        part = np.frombuffer(m, dtype=np.uint8)
        out[i] = part if len(m) == width else np.bitwise_or.reduce(part.reshape(-1, width), axis=0)
    return out.view(np.uint64)


def possible_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) across components within runs of (sig, x, y, side, cls, comp, n, bits) that bit maps don't rule out.

    Bits of one set that the other has not set stand for elements that it lacks, one at least each.
    """
    seen: set[tuple[int, int]] = set()
    for run in grouped(batches, 3):
        cls, comp, n = (run.column(i).to_numpy() for i in (4, 5, 6))
        if comp.min() == comp.max():
            continue
        side = run.column(3).to_numpy()
        within = run.column(1)[0].as_py() == run.column(2)[0].as_py()
        maps = _bit_rows(run.column(7).to_pylist())
        spare = n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        firsts = range(len(cls)) if within else np.flatnonzero(side == 0).tolist()
        found: list[tuple[int, int]] = []
        for i in firsts:
            others = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1 if within else np.flatnonzero((side == 1) & (comp != comp[i]))
            if not len(others):
                continue
            both = np.bitwise_count(maps[others] & maps[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(both + np.minimum(spare[others], spare[i]), np.minimum(n[others], n[i]))
            for j in others[100 * most >= percent * (n[others] + n[i] - most)].tolist():
                pair = (int(min(cls[i], cls[j])), int(max(cls[i], cls[j])))
                if pair not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(pair)
                    found.append(pair)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def across_components(groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of different components that share a group and that bit maps don't rule out; its least member has met all others."""
    by_sig = Window.partitionBy("sig")
    named = groups.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).withColumn("hub", F.min("cls").over(by_sig)).filter("hub <> cls")
    open_ = named.withColumn("lo", F.min("comp").over(by_sig)).withColumn("hi", F.max("comp").over(by_sig)).filter("lo <> hi").withColumn("size", F.count("*").over(by_sig))
    rows = materialize(open_.select("sig", "cls", "comp", "size"), "open").join(sets.select("cls", "n", "bits"), "cls")
    rows = dealt(rows, "sig", F.ceil(F.col("size") / block)).select("sig", "x", "y", "side", "cls", "comp", "n", "bits")
    return rows.mapInArrow(lambda batches: possible_pairs(batches, percent), "a long, b long").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    g = len(sets)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    times = np.diff(np.append(first, len(items)))
    out = np.zeros(g * g, dtype=np.int64)
    for f in range(2, DENSE + 1):  # owners ascend within an element
        at = first[times == f]
        for i in range(f):
            for j in range(i + 1, f):
                out += np.bincount(owner[at + i] * g + owner[at + j], minlength=g * g)
    out = out.reshape(g, g)
    out += out.T
    often = np.flatnonzero(times > DENSE)
    for at in range(0, len(often), 4096):
        some = often[at : at + 4096]
        column = np.repeat(np.arange(len(some)), times[some])
        places = np.concatenate([np.arange(first[e], first[e] + times[e]) for e in some])
        has = np.zeros((g, len(some)), dtype=np.float32)
        has[owner[places], column] = 1
        out += np.rint(has @ has.T).astype(np.int64)
    return out


def count_block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(cls, links) of each set in runs of (comp, x, y, side, cls, items): how many sets of the run it is similar to."""
    for run in grouped(batches, 3):
        cls, side = run.column(4).to_numpy(), run.column(3).to_numpy()
        column = run.column(5).combine_chunks()
        bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
        sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        common = intersections(sets)
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        if run.column(1)[0].as_py() == run.column(2)[0].as_py():
            np.fill_diagonal(linked, False)
        else:
            linked &= side[:, None] != side[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(linked.sum(axis=1).astype(np.int64))], names=["cls", "links"])


def count_links_of(labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(cls, n_links): with how many other classes of its component each class is linked."""
    members = labels.join(sets.select("cls", "n", "items"), "cls")
    sizes = labels.join(sets.select("cls", "n"), "cls").groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("elements") / BLOCK_ITEMS))
    rows = dealt(members.join(sizes.select("comp", blocks.alias("parts")), "comp"), "comp", F.col("parts")).select("comp", "x", "y", "side", "cls", "items")
    counts = rows.mapInArrow(lambda batches: count_block_links(batches, percent), "cls long, links long")
    return counts.groupBy("cls").agg(F.sum("links").alias("n_links"))


def link_classes(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str, count_links: bool, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, key, key2) and, of every class of a non-empty set, (key, key2, id, text_hash, comp, n_links).

    id and text_hash tell the class's first row, by id, null ids last.
    """
    narrow = materialize(document_sets(docs, id_col, text_col, size, percent), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), "text_hash")).alias("first")
    classes = narrow.filter("n_shingles > 0").groupBy("key", "key2").agg(first, F.first("even").alias("even"), F.first("odd").alias("odd"))
    classes = materialize(classes.select("key", "key2", "first.id", "first.text_hash", "even", "odd", F.monotonically_increasing_id().alias("cls")), "classes")
    groups = rare_signatures(signature_rows(docs, text_col, size, percent), classes)
    wanted = classes.join(groups.select("cls").distinct(), "cls", "left_semi").select("id", "text_hash", "cls", "key", "key2")
    sets = sets_of(docs, wanted, id_col, text_col, size)
    hub = F.min("cls").over(Window.partitionBy("sig"))
    pairs = materialize(groups.select(hub.alias("a"), F.col("cls").alias("b")).filter("a <> b").distinct(), "pairs")
    links = materialize(verified(pairs, sets, percent), "found")
    labels = components(links)
    further = materialize(across_components(groups, labels, sets, percent, block), "pairs")
    discard(groups, pairs)
    more = materialize(verified(further, sets, percent), "found")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    of_class = classes.select("key", "key2", "id", "text_hash", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    if count_links:
        of_class = of_class.join(count_links_of(labels, sets, percent, block), "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    of_class = materialize(of_class.drop("cls"), "linked")
    discard(sets, further)
    return narrow, of_class


def link_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True, block: int = BLOCK) -> DataFrame:
    """Class and component of every document under Jaccard similarity of word shingles.

    Returns doc_id, n_shingles, component_id (least doc_id reachable by links), class_id (least doc_id with
    the same set) and n_links (how many different classes its class is similar to; left out
    without ``count_links``), one row per row of ``docs``. Null and wordless texts have empty sets, are linked with
    nothing and are their own component. Rows of one id with different texts are linked through
    their texts only. Rows with a null id link like others, but a null id is never the least: only a
    component or class of nothing but null ids has a null name.
    """
    narrow, of_class = link_classes(docs, percent, size, id_col, text_col, count_links, block)
    named = of_class.join(of_class.groupBy("comp").agg(F.min("id").alias("component_id")), "comp")
    out = narrow.join(named.drop("text_hash", "comp").withColumnRenamed("id", "class_id"), ["key", "key2"], "left")
    alone = F.col("n_shingles") == 0
    made = out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []),
    )
    return made


def deduplicate(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the least id; all columns kept.

    Documents without words stay. A row with a null id goes if its component has another row that comes
    first: one with an id, or else the row of the least hash. Of repeated rows with one id and one text, one stays;
    rows with neither id nor words all stay.
    """
    narrow, of_class = link_classes(docs, percent, size, id_col, text_col, False, BLOCK)
    order = F.struct(F.col("id").isNull().alias("without"), "id", "text_hash")
    stays = of_class.groupBy("comp").agg(F.min(order).alias("stays"))
    named = narrow.filter("n_shingles > 0").select("doc_id", F.col("text_hash").alias("own_hash"), "key", "key2").join(of_class.drop("id", "text_hash"), ["key", "key2"]).join(stays, "comp")
    first = F.col("doc_id").eqNullSafe(F.col("stays.id")) & (F.col("own_hash") == F.col("stays.text_hash"))
    dropped = materialize(named.filter(~first).select(F.col("doc_id").alias("_lore_id"), F.col("own_hash").alias("_lore_hash")).distinct(), "dropped")
    repeated = narrow.filter("doc_id IS NOT NULL OR n_shingles > 0").groupBy(F.col("doc_id").alias("_lore_id"), F.col("text_hash").alias("_lore_hash")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")

    def without(frame: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        text = frame[text_col].cast("string")
        return frame.join(rows, frame[id_col].eqNullSafe(F.col("_lore_id")) & (F.xxhash64(text) == F.col("_lore_hash")), how)

    kept = without(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return kept
    once = without(kept, repeated, "left_semi").dropDuplicates([id_col, text_col])
    return without(kept, repeated, "left_anti").unionByName(once)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))
