"""Jaccard join over word n-grams by prefix filtering.

The n-grams of a text form a set; all pairs of texts are wanted whose sets have a Jaccard similarity of at least t.

1. Frequencies of n-grams over all documents are counted in hashed buckets, a sketch of fixed size, which gives every n-gram
   its place in one global order: rare ones first, ties by hash. Any global order gives the same pairs.
2. Of each set, the first |x| - ceil(t |x|) + l n-grams are its prefix. Two similar sets share at least l prefix n-grams, where
   l, which grows with the sets (``EXTRA``), is that of the one with less. Prefixes are sent to the partition of each n-gram,
   with the set's size and the n-gram's place, and joined there under the length filter (|x| >= t |y|) and the positional
   filter (what is left behind a common n-gram must suffice). A set is written once for its n-grams in a blob (:func:`_tight`), so
   these partitions are fewer (``_FEWER``) than the others.
   An n-gram of more than ``_HOT`` sets isn't joined there: with the others that nearly the same sets have it goes to one partition, their
   home, where a product of matrices counts what each pair has in common, and each pair is sent once for all of them (:func:`_dense`).
3. Common prefix n-grams of a pair are counted over the cluster; pairs with l of them are candidates. Each set of a pair goes to
   the partition where the pair is verified, once, first by the suffix filter (the parts of both sets in fixed ranges of hashes bound their overlap), then exactly.

Groups of near copies grow with the table and their pairs with its square, so no task holds all pairs or sets that it sees: pairs are
sent on and counted in bounded portions, and large groups are verified by blocks of sets, each after its texts were read.

Equal sets have equal fingerprints and are one set throughout; :func:`classes` counts their documents, only :func:`pairs` spreads
pairs over them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import components
from . import common
from .text import grams, mix, words

#: Buckets of the frequency sketch, in so many rows that are summed apart.
_BUCKETS, _ROWS = 1 << 20, 64
_PARTS = 16
#: n-grams of the sets of one block, two of which one task verifies at a time.
_BLOCK = 3 << 19
#: Bits of an n-gram's hash that are sent, and how many times fewer the partitions of n-grams are than the others.
_BITS, _FEWER = 28, 3
#: n-grams of more sets than this are joined with others at their home, and the columns of their entries there: home, n-gram, set and the set's size.
_HOT, _AT_HOME = 128, (np.uint64, np.uint64, np.int64, np.uint32)
#: Columns of an entry: the n-gram (high and low bits), its set, the set's size and the n-gram's place.
_ENTRY = (np.uint32, np.uint8, np.int64, np.uint32, np.uint32)
#: Of similar sets, 1 and this share of the lesser one's n-grams must be common to both prefixes, which are as much longer.
EXTRA = 0.05


def _common(size: np.ndarray) -> np.ndarray:
    return 1 + (EXTRA * size).astype(np.int64)


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, sorted, and the offsets of the rows."""
    g, at = grams(words(column), n)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    row, g = row[new], g[new]
    return row, g, np.searchsorted(row, np.arange(len(at)))


def _fingerprints(row: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the sets, equal for equal sets; 0 of the empty one."""
    size = np.diff(at)
    with np.errstate(over="ignore"):
        total = np.zeros(len(size), np.uint64)
        full = size > 0
        if full.any():
            total[full] = np.add.reduceat(mix(g + np.uint64(0x2545F4914F6CDD1D)), at[:-1][full])
            total[full] = mix(total[full] + mix(size[full]))
    return total.view(np.int64)


def _order(source: DataFrame, n: int) -> np.ndarray:
    """A level for each bucket of the sketch: 8 times the binary logarithm of its count over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                _, g, _ = _sets(part.column("text"), n)
                total += np.bincount((g >> np.uint64(44)).astype(np.int64), minlength=_BUCKETS)
        parts = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in total.reshape(_ROWS, -1)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], ["r", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(pa.decompress(blob.as_py(), _BUCKETS // _ROWS * 8, "zstd"), np.int64)
                total[r] = total[r] + x if r in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["r", "counts"])

    levels = np.zeros((_ROWS, _BUCKETS // _ROWS), np.uint8)
    schema = "r int, counts binary"
    for r in source.mapInArrow(count, schema).repartition(min(_ROWS, common.partitions(source.sparkSession)), "r").mapInArrow(add, schema).toLocalIterator():
        levels[r.r] = np.minimum(255, 8 * np.log2(1 + np.frombuffer(bytes(r.counts), np.int64)))
    return levels.ravel()


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all 32-bit numbers, then the second ones and so on: most are alike."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _tight(parts: int, key: np.ndarray, fp: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Prefix entries that come set by set as a blob for each partition, for :func:`_loose`: each set and its size once, ``_BITS`` bits of
    each n-gram, and its place in a byte, rounded down, by which the positional filter lets more pass, never fewer. What is distributed
    alike is compressed together."""
    to = (key % np.uint64(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    fp, size, cut = fp[order], size[order], np.searchsorted(to[order], np.arange(parts + 1))
    bits = (key[order] >> np.uint64(64 - _BITS)).astype(np.uint32)
    place = (place[order] // np.maximum(1, size >> 6)).astype(np.uint8)
    rows = []
    for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        if b > a:
            head = np.flatnonzero(np.concatenate([[True], fp[a + 1 : b] != fp[a : b - 1]]))
            low, numbers = _planes(bits[a:b]), _planes(size[a:b][head]) + _planes(np.diff(np.append(head, b - a)))
            own = [pa.compress(x, "zstd", asbytes=True) for x in (fp[a:b][head].tobytes(), numbers, low[: 3 * (b - a)], low[3 * (b - a) :], np.diff(place[a:b], prepend=np.uint8(0)).tobytes())]
            rows.append((p, b - a, b"".join((np.array([len(head), *map(len, own)], np.uint32).tobytes(), *own))))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "entries"])


def _loose(batch: pa.RecordBatch, kinds: tuple = _ENTRY) -> list[np.ndarray]:
    """The entries in the blobs of a batch, in columns of these kinds."""
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for n, blob in zip(batch.column("n").to_pylist(), batch.column("entries")):
        blob = blob.as_py()
        sets, *long = np.frombuffer(blob, np.uint32, 6).tolist()
        at = np.cumsum([24, *long]).tolist()
        own, numbers, low, high, step = (pa.decompress(blob[a:b], m, "zstd", asbytes=True) for a, b, m in zip(at[:-1], at[1:], (8 * sets, 8 * sets, 3 * n, n, n)))
        size, many = _numbers(numbers[: 4 * sets]), _numbers(numbers[4 * sets :])
        bits, fp, size = _numbers(low + high), np.repeat(np.frombuffer(own, np.int64), many), np.repeat(size, many)
        place = np.cumsum(np.frombuffer(step, np.uint8), dtype=np.uint8) * np.maximum(1, size >> 6)
        for x, c, k in zip(out, (bits, np.zeros(n, np.uint8), fp, size, place), kinds):
            x.append(c.astype(k))
    return [np.concatenate(x) for x in out]


def _prefixes(levels: np.ndarray, n: int, t: float, parts: int, flush: int = 1 << 20):
    """For mapInArrow: prefix entries (bits of the n-gram's hash, set, size, place) in a blob for each partition that they go to.

    n-grams with the same bits in one partition only make a pair a candidate more often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit() -> pa.RecordBatch:
            key, fp, size, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return _tight(parts, key, fp, size, place)

        for batch in batches:
            for part in common.slices(batch, "text"):
                row, g, at = _sets(part.column("text"), n)
                if not len(g):
                    continue
                fp, size = _fingerprints(row, g, at), np.diff(at)
                _, one = np.unique(fp, return_index=True)
                key = (levels[(g >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(g) >> np.uint64(8))
                order = np.lexsort((key, row))
                key, place = key[order], np.arange(len(g)) - np.repeat(at[:-1], size)
                length = size - np.ceil(t * size - 1e-9).astype(np.int64) + np.minimum(_common(size), np.ceil(t * size - 1e-9).astype(np.int64))
                use = (place < length[row]) & np.isin(row, one)
                held.append((mix(key[use]), fp[row[use]], size[row[use]].astype(np.uint32), place[use].astype(np.uint32)))
                if sum(len(h[0]) for h in held) >= flush:
                    yield emit()
        if held:
            yield emit()

    return run


def _need(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Of pairs of sets of these sizes: the common prefix n-grams that make them candidates."""
    lesser = np.minimum(a, b)
    return np.minimum(_common(lesser), np.ceil(t * lesser - 1e-9).astype(np.int64))


def _join(t: float, parts: int, chunk: int = 1 << 19, read: Callable = common.unpacked, hot: int | None = None):
    """For mapInArrow: pairs of sets of a partition's entries with the number of common prefix n-grams there, to the partition of the lesser set.

    With ``hot``, n-grams of more sets than that are sent to their home instead, for :func:`_dense`; a column says which rows those are.

    Pairs are sent when they are many, so that a pair may be sent several times; :func:`_count` adds up. n-grams that occur once,
    which are most, are left out before the entries are held together. ``read`` gives the entries of blobs.
    """

    def marked(batch: pa.RecordBatch, often: bool) -> pa.RecordBatch:
        return batch if hot is None else batch.append_column("hot", pa.array(np.full(batch.num_rows, often)))

    def homes(key: np.ndarray, fp: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        # the home of an n-gram is the least hash of its sets: n-grams that nearly the same sets have are likely to share it
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        home = np.repeat(np.minimum.reduceat(mix(fp.view(np.uint64)), first), np.diff(np.append(first, len(key))))
        for lo in range(0, len(key), chunk):
            h, k, f, n = (c[lo : lo + chunk] for c in (home, key, fp, size))
            yield marked(common.packed(parts, mix(h), [h, k, f, n.astype(np.uint32)]), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)]
        if not held:
            return
        key = lambda c: c[0].astype(np.uint64) << np.uint64(8) | c[1]
        keys = np.concatenate([key(read(x, _ENTRY)) for x in held])
        keys.sort()
        keys = np.unique(keys[1:][keys[1:] == keys[:-1]])
        if not len(keys):
            return
        kept: list[tuple[np.ndarray, ...]] = []
        while held:
            columns = read(held.pop(), _ENTRY)
            own = key(columns)
            code = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            turn = np.full(len(own), len(held)) << 32 | np.cumsum(np.concatenate([[False], columns[2][1:] != columns[2][:-1]]))
            use = keys[code] == own
            kept.append((code[use], turn[use], *(c[use] for c in columns[2:])))
        code, turn, fp, size, place = (np.concatenate(c) for c in zip(*kept))
        kept.clear()
        # equal sets give equal entries: those of one of them are used; a set may still have an n-gram twice, by its bits
        sets, first, own = np.unique(fp, return_index=True, return_inverse=True)
        use = turn == turn[first][own]
        del turn, fp
        code, own, size, place = code[use], own[use], size[use].astype(np.int64), place[use].astype(np.int64)
        order = np.lexsort((own, size, code))
        code, own, size, place = code[order], own[order], size[order], place[order]
        if hot is not None:
            often = np.bincount(code)[code] > hot
            if often.any():
                yield from homes(keys[code[often]], sets[own[often]], size[often])
                code, own, size, place = code[~often], own[~often], size[~often], place[~often]
        # entries of an n-gram by size: the partners of an entry are those behind it that aren't too long
        wide = int(size.max(initial=0)) + 2
        limit = np.minimum((size / t + 1e-9).astype(np.int64), wide - 1)
        upto = np.searchsorted(code * wide + size, code * wide + limit, side="right")
        count = np.maximum(0, upto - np.arange(len(code)) - 1)
        total = np.concatenate([[0], np.cumsum(count)])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size_of = np.zeros(len(sets), np.int64)
        size_of[own] = size
        ell = np.minimum(_common(size), np.ceil(t * size - 1e-9).astype(np.int64))

        def add_up() -> None:
            pair, code = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            found[:] = [(pair, np.bincount(code, np.concatenate([c for _, c in found])).astype(np.int64))]

        def emit() -> Iterator[pa.RecordBatch]:
            pairs, times = found.pop()
            for lo in range(0, len(pairs), chunk):
                p = pairs[lo : lo + chunk]
                a, b = p // len(sets), p % len(sets)
                yield marked(_pairs(parts, sets[a], sets[b], times[lo : lo + chunk], _need(size_of[a], size_of[b], t)), False)

        for lo in range(0, int(total[-1]), chunk):
            at = np.arange(lo, min(lo + chunk, int(total[-1])))
            a = np.searchsorted(total, at, side="right") - 1
            b = a + 1 + at - total[a]
            least = np.ceil(t / (1 + t) * (size[a] + size[b]) - 1e-9)
            fit = (np.minimum(ell[a], ell[b]) + np.minimum(size[a] - place[a], size[b] - place[b]) - 1 >= least) & (own[a] != own[b])
            x, y = own[a[fit]], own[b[fit]]
            found.append(np.unique(np.minimum(x, y) * len(sets) + np.maximum(x, y), return_counts=True))
            if sum(len(p) for p, _ in found) > 2 * chunk:
                add_up()
                if len(found[0][0]) > chunk:
                    yield from emit()
        if found:
            add_up()
            yield from emit()

    return run


def _pairs(parts: int, a: np.ndarray, b: np.ndarray, times: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    """Pairs for :func:`_count`. Sorted by a and sent by a: the partners of the sets of one group of copies are alike, which the blobs' compression finds."""
    return common.packed(parts, mix(a), [a, b, times.astype(np.int32), need.astype(np.int32)])


def _dense(t: float, parts: int, chunk: int = 1 << 19, wide: int = 1 << 22):
    """For mapInArrow, over rows of :func:`_join` with ``hot``: pairs pass, entries at their home become pairs with the number of n-grams that they share there.

    Matrices of sets by n-grams have at most ``wide`` numbers or a column, those of sets by sets ``chunk`` or a row. Pairs that don't pass the
    positional filter count, too: more become candidates, never fewer.
    """

    def products(key: np.ndarray, fp: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets, first, own = np.unique(fp, return_index=True, return_inverse=True)
        size, column = size[first].astype(np.int64), np.unique(key, return_inverse=True)[1]
        longest = np.floor(size / t + 1e-9)
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        n, across, down = len(sets), max(1, wide // len(sets)), max(1, chunk // len(sets))
        cuts = list(range(0, int(column[-1]) + 1, across))

        def matrix(at: int) -> np.ndarray:
            lo, hi = np.searchsorted(column, [at, at + across])
            columns = int(column[hi - 1]) + 1 - at
            return np.bincount(own[lo:hi] * columns + column[lo:hi] - at, minlength=n * columns).astype(np.float32).reshape(n, columns)

        whole = matrix(0) if len(cuts) == 1 else None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ready = 0
        for lo in range(0, n, down):
            hi = min(lo + down, n)
            common_ = sum(m[lo:hi] @ m[lo:].T for m in ((whole,) if whole is not None else map(matrix, cuts)))
            fit = (common_ > 0) & (size[lo:] <= longest[lo:hi, None]) & (size[lo:hi, None] <= longest[lo:])
            a, b = np.nonzero(np.triu(fit, 1))
            found.append((lo + a, lo + b, common_[a, b]))
            ready += len(a)
            if ready >= chunk or hi == n:
                a, b, times = (np.concatenate(c) for c in zip(*found))
                found.clear()
                ready = 0
                if len(a):
                    need = _need(size[a], size[b], t)
                    yield _pairs(parts, sets[a], sets[b], np.minimum(times, need), need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            often = batch.column("hot")
            pairs = batch.filter(pc.invert(often)).select(["part", "n", "entries"])
            if pairs.num_rows:
                yield pairs
            own = batch.filter(often)
            held += [own.slice(k, 1) for k in range(own.num_rows)]
        if not held:
            return
        home, key, fp, size = (np.concatenate(c) for c in zip(*(common.unpacked(x, _AT_HOME) for x in held)))
        held.clear()
        order = np.argsort(home, kind="stable")
        home, key, fp, size = home[order], key[order], fp[order], size[order]
        edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield from products(key[lo:hi], fp[lo:hi], size[lo:hi])

    return run


def _added(a: np.ndarray, b: np.ndarray, times: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, in order, its times added up."""
    order = np.lexsort((b, a))
    a, b, times, need = a[order], b[order], times[order], need[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return (a[first], b[first], np.add.reduceat(times, first), need[first]) if len(first) else (a, b, times, need)


def _count(limit: int = 1 << 20, wide: int = 512):
    """For mapInArrow: sets with the others that they have enough common prefix n-grams with, in rows of at most ``wide`` others.

    Entries stay compressed, cut into ranges of sets with about ``limit`` of them, which are added up one after the other.
    """
    kinds = (np.int64, np.int64, np.int32, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)]
        total = sum(x.column("n")[0].as_py() for x in held)
        if not total:
            return
        ranges = [held]
        if total > limit:
            some = np.sort(np.concatenate([common.unpacked(x, kinds)[0][::64].copy() for x in held]))
            edges = np.unique(some[[k * len(some) // (total // limit + 1) for k in range(1, total // limit + 1)]])
            ranges = [[] for _ in range(len(edges) + 1)]
            some = []
            while held:
                some.append(common.unpacked(held.pop(), kinds))
                if not held or sum(len(c[0]) for c in some) > limit // 4:
                    columns = [np.concatenate(c) for c in zip(*some)]
                    some.clear()
                    cut = common.packed(len(ranges), np.searchsorted(edges, columns[0], side="right").astype(np.uint64), columns)
                    for k, to in enumerate(cut.column("part").to_pylist()):
                        ranges[to].append(cut.slice(k, 1))
        for own in ranges:
            parts: list[list[np.ndarray]] = []
            while own:
                parts.append(common.unpacked(own.pop(), kinds))
                if not own or sum(len(c[0]) for c in parts) > 2 * limit:
                    parts[:] = [list(_added(*(np.concatenate(c) for c in zip(*parts))))]
            if not parts:
                continue
            a, b, times, need = parts.pop()
            enough = times >= need
            a, b = a[enough], b[enough]
            if not len(a):
                continue
            runs = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            at = np.flatnonzero((np.arange(len(a)) - np.repeat(runs, np.diff(np.append(runs, len(a))))) % wide == 0)
            ends = np.append(at[1:], len(a))
            for lo in range(0, len(at), 1024):
                x, y = at[lo : lo + 1024], ends[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(a[x]), pa.ListArray.from_arrays(pa.array(np.append(x, y[-1]) - x[0], pa.int32()), pa.array(b[x[0] : y[-1]]))], ["a", "b"])

    return run


class _Group:
    """Sets that pairs are verified among, the forest of the pairs found and how many documents they link each set to."""

    def __init__(self, sets: dict[int, np.ndarray], docs: dict[int, int], t: float) -> None:
        self.t, self.names = t, np.array(sorted(sets), np.int64)
        self.docs = np.array([docs[k] for k in self.names.tolist()], np.int64)
        flat = np.concatenate([sets[k] for k in self.names.tolist()])
        self.size = np.array([len(sets[k]) for k in self.names.tolist()], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        # suffix filter: ranges of hashes part the universe; a pair's overlap is at most the sum of the lesser parts
        parts = np.repeat(np.arange(len(self.names)) * _PARTS, self.size) + (flat >> np.uint64(60)).astype(np.int64)
        self.part = np.bincount(parts, minlength=len(self.names) * _PARTS).reshape(-1, _PARTS).astype(np.int32)
        del parts
        self.code = np.unique(flat, return_inverse=True)[1]
        self.mark = np.zeros(int(self.code.max(initial=0)) + 1, bool)
        self.root, self.linked = np.arange(len(self.names)), np.zeros(len(self.names), np.int64)

    def similar(self, a: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(a, its similar b, their similarities) by position in names; ``most`` n-grams are looked up at a time."""
        a, b = np.searchsorted(self.names, a), np.searchsorted(self.names, b)
        least = np.ceil(self.t / (1 + self.t) * (self.size[a] + self.size[b]) - 1e-9)
        use = np.concatenate([np.minimum(self.part[a[k : k + 65536]], self.part[b[k : k + 65536]]).sum(1) for k in range(0, len(a), 65536)]) >= least
        a, b = a[use], b[use]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])).tolist()
        for first, end in zip(begins, [*begins[1:], len(a)]):
            k = int(a[first])
            mine = self.code[self.at[k] : self.at[k + 1]]
            self.mark[mine] = True
            long = np.cumsum(self.size[b[first:end]])
            lo = first
            while lo < end:
                hi = max(lo + 1, first + int(np.searchsorted(long, most + (long[lo - first - 1] if lo > first else 0), side="right")))
                other = b[lo:hi]
                length = self.size[other]
                begin = np.cumsum(length) - length
                both = np.add.reduceat(self.mark[self.code[np.arange(length.sum()) - np.repeat(begin - self.at[other], length)]].astype(np.int64), begin)
                j = both / (self.size[k] + length - both)
                hit = j >= self.t
                if hit.any():
                    yield k, other[hit], j[hit]
                lo = hi
            self.mark[mine] = False

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = int(self.root[x])
        return x

    def joined(self, k: int, others: np.ndarray) -> list[int]:
        """Those of the others that weren't connected with k before."""
        mine, new = self.find(k), []
        for x in others[self.root[others] != mine].tolist():
            its = self.find(x)
            if its != mine:
                self.root[its] = mine
                new.append(x)
            self.root[x] = mine
        return new


def _verify(n: int, t: float, whole: bool, most: int = 1 << 20):
    """For mapInArrow, over rows sorted so that the texts of a group come before its pairs: all similar pairs (``whole``), or else a forest
    that connects the same sets, and for each set the number of documents that its pairs link it to (b is null). Groups are held together
    up to ``most`` n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        docs: dict[int, int] = {}
        held: list[np.ndarray] = []
        group: _Group | None = None
        weight = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal group
            if not held:
                return
            if group is None:
                group = _Group(sets, docs, t)
            todo = np.concatenate(held)
            held.clear()
            out: list[tuple[np.ndarray, ...]] = []
            ready = 0
            for k, others, j in group.similar(todo[:, 0], todo[:, 1]):
                if not whole:
                    group.linked[k] += group.docs[others].sum()
                    group.linked[others] += group.docs[k]
                    others = np.array(group.joined(k, others), np.int64)
                    j = np.zeros(len(others))
                if len(others):
                    out.append((np.full(len(others), group.names[k]), group.names[others], j))
                    ready += len(others)
                if ready >= 1 << 16:
                    yield rows(out)
                    ready = 0
            if out:
                yield rows(out)

        def rows(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b, j = (np.concatenate(c) for c in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(j) if whole else pa.nulls(len(a), pa.int64())], ["a", "b", "jaccard" if whole else "linked"])

        def sums() -> Iterator[pa.RecordBatch]:
            if group is not None and not whole and group.linked.any():
                on = group.linked > 0
                yield pa.RecordBatch.from_arrays([pa.array(group.names[on]), pa.nulls(int(on.sum()), pa.int64()), pa.array(group.linked[on])], ["a", "b", "linked"])

        for batch in batches:
            is_text = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero(is_text[1:] != is_text[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(turns[:-1], turns[1:]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                names = part.column("a").to_numpy(zero_copy_only=False)
                if not is_text[lo]:
                    lists = part.column("b")
                    held.append(np.column_stack([np.repeat(names, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)]).astype(np.int64))
                    if sum(len(x) for x in held) > most:
                        yield from settle()
                    continue
                if weight > most and (held or group is not None):  # a new group begins
                    yield from settle()
                    yield from sums()
                    sets, docs, weight, group = {}, {}, 0, None
                elif group is not None:  # its index lacks the sets that come now
                    yield from settle()
                    yield from sums()
                    group = None
                for from_ in range(0, hi - lo, 256):
                    some = part.slice(from_, 256)
                    own = [pa.decompress(x.as_py(), y[0].as_py(), "zstd", asbytes=True).decode() for x, y in zip(some.column("text"), some.column("b"))]
                    n_docs = [y[1].as_py() for y in some.column("b")]
                    texts = pa.RecordBatch.from_arrays([pa.array(own, pa.large_string()), some.column("a"), pa.array(n_docs, pa.int64())], ["text", "a", "n"])
                    for s in common.slices(texts, "text"):
                        row, g, at = _sets(s.column("text"), n)
                        for fp, want, many, x, y in zip(_fingerprints(row, g, at).tolist(), s.column("a").to_pylist(), s.column("n").to_pylist(), at[:-1], at[1:]):
                            if fp == want and fp not in sets:  # else another text of a repeated id
                                sets[fp], docs[fp] = g[x:y].copy(), many
                                weight += int(y - x) + _PARTS
        yield from settle()
        yield from sums()

    return run


def _seen(needed: DataFrame, most: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of needed.doc_id: 16 bits for each id, ``most`` bits at most; too few bits let more pass, never fewer."""
    n = needed.count()
    bits = min(most, 1 << max(10, math.ceil(math.log2(16 * n + 1))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits, bool)
        for batch in batches:
            for h in _places(common.ids(batch), bits):
                on[h] = True
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(np.packbits(on).tobytes(), "zstd", asbytes=True)], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for r in needed.select("doc_id").repartition(4).mapInArrow(mark, "bits binary").toLocalIterator():
        total |= np.frombuffer(pa.decompress(bytes(r.bits), bits // 8, "zstd", asbytes=True), np.uint8)
    return total


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(ids.view(np.uint64) + np.uint64(k * 0x9E3779B9)) & np.uint64(bits - 1)).astype(np.int64) for k in range(1, 5)]


def similar_sets(docs: DataFrame, *, n: int = 3, t: float = 0.5, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links of fingerprints of similar sets; members doc_id, fp, size), both written tables.

    ``whole``: links are all pairs a, b, jaccard. Else they are a, b of a forest with the same connected components, and rows a, linked
    without b, which add up to the number of documents with sets similar to a; so the result grows with the sets, not with their pairs.
    Texts without words have no set: their fp is null, and they are in no pair.
    """
    source = common.texts(docs, id_col, text_col)
    spark = docs.sparkSession
    parts = common.partitions(spark)
    levels = _order(source, n)

    def fingerprint(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, g, at = _sets(batch.column("text"), n)
        fp, full = _fingerprints(row, g, at), np.diff(at) > 0
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, mask=~full), pa.array(np.diff(at))], ["doc_id", "fp", "size"])

    every = common.written(source.mapInArrow(common.over_slices(fingerprint), "doc_id long, fp long, size long").distinct(), "members")
    members = every.where("fp is not null")
    fewer = math.ceil(parts / _FEWER)
    entries = source.mapInArrow(_prefixes(levels, n, t, fewer), common.PACKED)
    found = entries.repartitionById(fewer, F.col("part")).mapInArrow(_join(t, parts, read=_loose, hot=_HOT), common.PACKED + ", hot boolean")
    found = found.repartitionById(parts, F.col("part")).mapInArrow(_dense(t, parts), common.PACKED).repartitionById(parts, F.col("part")).mapInArrow(_count(), "a long, b array<long>")
    candidates = common.written(found, "candidates")
    # a pair is verified at the least neighbour of its lesser set: sets of one group of copies meet there, once
    least = candidates.select("a", F.array_min("b").alias("x")).unionByName(candidates.select(F.explode("b").alias("a"), F.col("a").alias("x")).groupBy("a").agg(F.min("x").alias("x")))
    place = least.groupBy("a").agg(F.least(F.min("x"), F.col("a")).alias("k"))
    placed = common.written(candidates.join(place, "a"), "placed")
    sized = members.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max("size").alias("size"))
    ends = common.written(placed.select("k", F.explode(F.concat(F.array("a"), "b")).alias("fp")).distinct().join(sized, "fp"), "ends")
    # of a group too large for one task, blocks of sets meet two by two
    large = ends.groupBy("k").agg(F.ceil(F.sum(F.col("size") + _PARTS) / _BLOCK).alias("blocks")).where("blocks > 1")
    large = F.broadcast(common.written(large, "large"))
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)).alias("y")
    two = lambda x: (F.least(x, "y").alias("i"), F.greatest(x, "y").alias("j"))
    split = placed.join(large, "k", "left").select("k", "a", "b", "blocks", block("a").alias("x"), each)
    split = split.select("k", *two(F.col("x")), "a", F.when(F.col("blocks").isNull(), F.col("b")).otherwise(F.filter("b", lambda v: block(v) == F.col("y"))).alias("b"), "blocks").where(F.size("b") > 0)
    used = split.where("blocks is not null").select("k", "i", "j").distinct()
    sent = ends.join(large, "k", "left").select("k", "fp", "doc_id", "n", "blocks", block("fp").alias("x"), each).select("k", *two(F.col("x")), "fp", "doc_id", "n", "blocks")
    sent = sent.where("blocks is null").unionByName(sent.where("blocks is not null").join(used, ["k", "i", "j"], "left_semi"))
    needed = common.written(sent.drop("blocks"), "needed")
    seen = _seen(needed)  # most texts are in no candidate pair and needn't be shuffled

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        on = np.ones(batch.num_rows, bool)
        for h in _places(common.ids(batch), 8 * len(seen)):
            on &= (seen[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1
        batch = batch.filter(pa.array(on))
        raw = [x.as_buffer() for x in batch.column("text").cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.size for x in raw], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())], ["doc_id", "size", "text"])

    squeezed = source.mapInArrow(common.over_slices(squeeze), "doc_id long, size long, text binary")
    shipped = squeezed.join(needed, "doc_id").select("k", "i", "j", F.col("fp").alias("a"), F.array("size", "n").alias("b"), "text")
    work = shipped.unionByName(split.drop("blocks").withColumn("text", F.lit(None).cast("binary")))
    work = work.repartition(parts, "k", "i", "j").sortWithinPartitions("k", "i", "j", F.col("text").isNull())
    links = work.select("a", "b", "text").mapInArrow(_verify(n, t, whole), "a long, b long, " + ("jaccard double" if whole else "linked long"))
    return common.written(links, "similar"), every


def pairs(docs: DataFrame, *, n: int = 3, t: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_a < doc_b and jaccard (rounded to 6 places) of all pairs of documents whose sets of word n-grams are similar.

    A text of fewer than n words has one n-gram of all its words; texts without words, and null ones, are similar to none. Rows
    that repeat count once; an id with several texts is similar where any of them is, by the most similar; rows without an id are
    skipped; an empty table gives no rows; other columns are not read.
    """
    similar, members = similar_sets(docs, n=n, t=t, id_col=id_col, text_col=text_col, whole=True)
    members = members.where("fp is not null")
    a, b = members.select(F.col("fp").alias("a"), F.col("doc_id").alias("x")), members.select(F.col("fp").alias("b"), F.col("doc_id").alias("y"))
    apart = similar.join(a, "a").join(b, "b").select("x", "y", "jaccard")
    alike = a.join(b.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    every = apart.unionByName(alike).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    several = members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if several.count():
        every = every.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    return every.select("doc_a", "doc_b", F.round("jaccard", 6).alias("jaccard"))


def classes(docs: DataFrame, *, n: int = 3, t: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and n_links of each document: the least id among the documents that links connect, and the number of documents with a similarity of at least t.

    Copies are counted, not paired: equal sets are one node, and a link to it counts as often as it has documents. Documents without
    a link, null texts and those without words are a class of their own. Rows that repeat count once; texts of one id with
    different sets are documents of their own, with a row each, which links may connect; very long texts are compared whole; rows
    without an id are skipped; an empty table gives no rows; other columns are not read.
    """
    similar, members = similar_sets(docs, n=n, t=t, id_col=id_col, text_col=text_col)
    linked = similar.where("b is null").groupBy("a").agg(F.sum("linked").alias("linked"))
    return common.classes(members.withColumnRenamed("fp", "node"), similar.where("b is not null"), "doc_id", linked)


def deduplicate(docs: DataFrame, *, n: int = 3, t: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the least id of each group, in the columns of docs; groups are the connected components of similar documents.

    Texts without words, null texts and rows without an id stay; so do rows that share the id that stays.
    """
    similar, members = similar_sets(docs, n=n, t=t, id_col=id_col, text_col=text_col)
    members, roots = members.where("fp is not null"), components(similar.where("b is not null").select("a", "b"))
    grouped = members.join(roots, members.fp == roots.node, "left").select("doc_id", F.coalesce("component", "fp").alias("g"))
    first = grouped.groupBy("g").agg(F.min("doc_id").alias("keep"))
    gone = grouped.join(first, "g").groupBy("doc_id").agg(F.max(F.when(F.col("doc_id") == F.col("keep"), 1).otherwise(0)).alias("kept")).where("kept = 0").select("doc_id")
    return common.without(docs, common.written(gone, "duplicates"), id_col)
