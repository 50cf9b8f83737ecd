"""Near duplicates of embeddings by spherical-cap filters from structured random product codes.

A filter is a direction; a vector is in it where their cosine exceeds alpha. The directions are a product code: the space,
rotated at random, is split into m blocks with B random unit vectors each, and every combination of one from each block is a
direction, B^m in all. List decoding finds all exceeding directions of a vector from m lists of B inner products, block by block,
leaving out what can't reach alpha any more. Similar vectors share filters; pairs within a filter are checked against
vectors of 8-bit numbers, with a margin that loses none, then exactly.

Several codes, each with a rotation of its own, share the filters: under one alone, a vector whose parts in the blocks are of very
unequal length would be in few filters or none. alpha and B follow from the number of vectors: a pair at the threshold shares
``shared`` filters on average, and a vector meets about ``strangers`` unrelated vectors in all of its filters, as far as the codes
can be that fine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text import mix


class Code(NamedTuple):
    rotation: np.ndarray
    blocks: tuple[np.ndarray, ...]
    alpha: float


def _tail(d: int, grid: int = 20001) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, density, P(coordinate >= x)) of a coordinate of a random unit vector in d dimensions."""
    x = np.linspace(-1, 1, grid)
    f = np.clip(1 - x * x, 1e-300, None) ** ((d - 3) / 2)
    f /= f.sum()
    return x, f, f[::-1].cumsum()[::-1]


def parameters(n: int, d: int, t: float, shared: float = 20.0, strangers: float = 64.0) -> tuple[float, float]:
    """(alpha, number of directions) for n vectors."""
    x, f, tail = _tail(d)
    y, _, rest = _tail(max(3, d - 1))
    best = (0.0, 1.0)
    for alpha in np.linspace(0.5, 8, 76) / math.sqrt(d):
        if alpha >= 0.95:
            break
        on = x >= alpha
        p = f[on].sum()
        z = (alpha - t * x[on]) / np.maximum(1e-9, math.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(1e-12, 1 - x[on] ** 2)))
        both = (f[on] * np.where(z > 1, 0, np.where(z < -1, 1, np.interp(z, y, rest)))).sum()
        if both <= 0 or shared / both > 2**30:
            break
        best = (float(alpha), shared / both)
        if n * best[1] * p * p <= strangers:
            break
    return best


def codes(n: int, d: int, t: float, *, rotations: int = 4, shared: float = 20.0, strangers: float = 64.0) -> list[Code]:
    return [code(n, d, t, seed=17 + k, shared=shared / rotations, strangers=strangers / rotations) for k in range(rotations)]


def decode_all(v: np.ndarray, own: list[Code]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of all codes that a row of v is in."""
    found = [decode(v, c) for c in own]
    return np.concatenate([row for row, _ in found]), np.concatenate([number * len(own) + k for k, (_, number) in enumerate(found)])


def code(n: int, d: int, t: float, seed: int = 17, **options: float) -> Code:
    """A code with as many directions as the options ask for."""
    alpha, many = parameters(n, d, t, **options)
    m = 1 if d < 4 or many <= 64 else 2 if many <= 2**22 or d < 12 else 3
    size = max(1, math.ceil(many ** (1 / m)))
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    blocks = []
    for part in np.array_split(np.arange(d), m):
        c = r.standard_normal((size, len(part)))
        blocks.append((c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(m)).astype(np.float32))
    return Code(q.astype(np.float32), tuple(blocks), alpha)


def decode(v: np.ndarray, c: Code) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all directions whose cosine with a row of v is at least alpha."""
    x = v.astype(np.float32) @ c.rotation
    cut = np.cumsum([0] + [b.shape[1] for b in c.blocks])
    product = [x[:, a:z] @ b.T for a, z, b in zip(cut[:-1], cut[1:], c.blocks)]
    top = [p.max(1) for p in product]
    row, total, number = np.arange(len(v)), np.zeros(len(v), np.float32), np.zeros(len(v), np.int64)
    for k, p in enumerate(product):
        order = np.argsort(-p, axis=1)
        ranked = np.take_along_axis(p, order, 1)
        left = sum(top[k + 1 :], np.zeros(len(v), np.float32))
        need = c.alpha - total - left[row]
        # of each partial sum, the codewords that can still reach alpha: a prefix of the block's ranked list
        lo, hi = np.zeros(len(row), np.int64), np.full(len(row), p.shape[1])
        while (on := lo < hi).any():
            mid = (lo + hi) // 2
            up = on & (ranked[row, np.minimum(mid, p.shape[1] - 1)] >= need)
            lo = np.where(up, mid + 1, lo)
            hi = np.where(on & ~up, mid, hi)
        at = np.repeat(np.arange(len(row)), lo)
        j = np.arange(len(at)) - np.repeat(np.cumsum(lo) - lo, lo)
        row, total, number = row[at], total[at] + ranked[row[at], j], number[at] * p.shape[1] + order[row[at], j]
    return row, number


def _unit(lists: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable vectors, their unit vectors)"""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.array([len(x) if x.is_valid else -1 for x in lists]) if lists.null_count else np.diff(lists.offsets.to_numpy())
    at = np.flatnonzero(size == d)
    flat = lists.take(pa.array(at)).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d)
    norm = np.linalg.norm(v, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return at[good], v[good] / norm[good, None]


def _read(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(distinct id, v and h, the hash of v, null where v can't be compared; the dimension, 0 if there is none)."""
    own = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).distinct()
    sizes = own.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = int(sizes.d) if sizes else 0
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    usable = (F.size("v") == d) & length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf"))
    return common.written(own.withColumn("h", F.when(F.lit(d > 0) & usable, F.xxhash64("v"))), "vectors"), d


def near_pairs(vectors: DataFrame, *, t: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shared: float = 20.0, strangers: float = 64.0) -> DataFrame:
    """id_a < id_b and cosine (rounded to 6 places) of pairs of vectors whose cosine is at least t; recall is approximate.

    The dimension is that of most vectors; null and zero vectors, those with nulls or numbers that aren't finite and those of
    another dimension are near none; rows that repeat count once; an id with several vectors is near where any of them is, by
    the nearest; rows without an id are skipped; an empty table gives no rows; other columns are not read.
    """
    own, d = _read(vectors, id_col, vector_col)
    found = _near(own.where("h is not null"), d, t, shared, strangers).where("id_a <> id_b")
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "cosine").groupBy("id_a", "id_b").agg(F.round(F.max("cosine"), 6).alias("cosine"))


def near_classes(vectors: DataFrame, *, t: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shared: float = 20.0, strangers: float = 64.0) -> DataFrame:
    """id_col, class_id and n_links of each vector: the least id among the vectors that links connect, and the number of vectors with a cosine of at least t.

    Equal vectors are one node, whose links count as often as it has rows, so copies are never paired; links between different
    vectors are those of :func:`near_pairs`. Vectors that can't be compared (null, zero, not finite, of another dimension than most) are
    a class of their own. Rows that repeat count once; different vectors of one id have a row each, which links may connect; rows without an
    id are skipped; an empty table gives no rows; other columns are not read.
    """
    own, d = _read(vectors, id_col, vector_col)
    nodes = own.where("h is not null").groupBy("h").agg(F.first("v").alias("v")).select(F.col("h").alias("id"), "v", "h")
    links = common.written(_near(nodes, d, t, shared, strangers).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "links")
    return common.classes(own.select(F.col("id").alias(id_col), F.col("h").alias("node")), links, id_col)


def _near(own: DataFrame, d: int, t: float, shared: float, strangers: float) -> DataFrame:
    """id_a, id_b and cosine of near rows of own (id, v, h) with different ids, each pair of rows once."""
    spark, parts, schema = own.sparkSession, common.partitions(own.sparkSession), "id_a long, id_b long, cosine double"
    own = common.written(own, "nodes")
    n = own.count()
    if not n:
        return spark.createDataFrame([], schema)
    own_codes = codes(n, d, t, shared=shared, strangers=strangers)
    margin = math.sqrt(d) / 127 + d / 4 / 127**2  # two rounding errors of half a 127th in each place

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                at, v = _unit(part.column("v"), d)
                if not len(at):
                    continue
                key, h = part.column("id").to_numpy()[at], part.column("h").to_numpy()[at]
                row, number = decode_all(v, own_codes)
                to = (mix(number) % np.uint64(parts)).astype(np.int64)
                if len(row):
                    b = common.packed(parts, to.astype(np.uint64), [number, key[row], h[row]])
                    yield b.append_column("vectors", pa.array(np.zeros(b.num_rows, bool)))
                    once = np.unique(to * len(at) + row)
                    vector = np.round(v * 127).astype(np.int8)
                    b = common.packed(parts, (once // len(at)).astype(np.uint64), [key[once % len(at)], h[once % len(at)], np.ascontiguousarray(vector[once % len(at)]).view(f"V{d}").ravel()])
                    yield b.append_column("vectors", pa.array(np.ones(b.num_rows, bool)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, known = [], []
        for batch in batches:
            is_vector = batch.column("vectors")
            for flag, into, kinds in ((False, entries, (np.int64, np.int64, np.int64)), (True, known, (np.int64, np.int64, f"V{d}"))):
                part = batch.filter(is_vector if flag else pa.array(~is_vector.to_numpy(zero_copy_only=False)))
                if part.num_rows:
                    into.append(common.unpacked(part, kinds))
        if not entries:
            return
        number, key, h = (np.concatenate(x) for x in zip(*entries))
        kid, kh, vector = (np.concatenate(x) for x in zip(*known))
        vector = np.ascontiguousarray(vector).view(np.int8).reshape(-1, d).astype(np.float32) / 127
        order = np.lexsort((kh, kid))
        kid, kh, vector = kid[order], kh[order], vector[order]
        name = lambda a, b: mix(a.view(np.uint64) * np.uint64(3) ^ mix(b.view(np.uint64)))
        names = name(kid, kh)
        by = np.argsort(names)
        own_row = by[np.searchsorted(names[by], name(key, h))]
        order = np.lexsort((own_row, number))
        number, own_row = number[order], own_row[order]
        end = np.searchsorted(number, number, side="right")
        count = end - np.arange(len(number)) - 1
        total = np.concatenate([[0], np.cumsum(count)])
        lo, found = 0, []
        while lo < len(number):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 21))) - 1)
            a = np.repeat(np.arange(lo, hi), count[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])
            pair = np.unique(own_row[a] * len(kid) + own_row[b])
            for s in range(0, len(pair), 1 << 16):
                x, y = pair[s : s + (1 << 16)] // len(kid), pair[s : s + (1 << 16)] % len(kid)
                near = np.einsum("ij,ij->i", vector[x], vector[y]) >= t - margin - 1e-6
                found.append(pair[s : s + (1 << 16)][near & (kid[x] != kid[y])])
            lo = hi
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        for s in range(0, len(pair), 1 << 18):
            x, y = pair[s : s + (1 << 18)] // len(kid), pair[s : s + (1 << 18)] % len(kid)
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (kid[x], kh[x], kid[y], kh[y])], ["a", "ha", "b", "hb"])

    met = own.mapInArrow(filters, common.PACKED + ", vectors boolean").repartitionById(parts, F.col("part")).mapInArrow(meet, "a long, ha long, b long, hb long")
    candidates = met.distinct()
    x, y = own.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("v").alias("va")), own.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("v").alias("vb"))
    joined = candidates.join(x, ["a", "ha"]).join(y, ["b", "hb"]).select("a", "b", "va", "vb")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (_, va), (_, vb) = _unit(batch.column("va"), d), _unit(batch.column("vb"), d)
                cosine = np.einsum("ij,ij->i", va, vb)
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                hit = cosine >= t
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[hit]), pa.array(np.maximum(a, b)[hit]), pa.array(cosine[hit])], ["id_a", "id_b", "cosine"])

    return joined.mapInArrow(exact, schema)
