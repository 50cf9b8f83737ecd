"""Best-fit packing by patterns and non-negative least squares.

Texts are cut into pieces of at most ``capacity`` tokens, and the pieces are packed into sequences of that capacity. Lengths are
rounded up to one of ``bins`` widths. Patterns are the combinations of up to ``depth`` bins that fill a sequence to the brim;
how often each is used is fitted to the histogram of the pieces by non-negative least squares (Lawson-Hanson), rounded down,
and what the patterns leave over is packed by best-fit decreasing over the bins' counts. All of that works on the histogram,
whose size is fixed; the pieces are only numbered within their bins, by counts of (shard, bin), and looked up in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, token_counts
from .text import words


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """The x >= 0 with the least ||ax - b||, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    ata, atb = a.T @ a, a.T @ b
    x, active = np.zeros(n), np.zeros(n, bool)
    eps = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds):
        w = atb - ata @ x
        w[active] = -np.inf
        k = int(np.argmax(w)) if n else 0
        if not n or w[k] <= eps:
            break
        active[k] = True
        while True:
            own = np.flatnonzero(active)
            s = np.linalg.lstsq(ata[np.ix_(own, own)], atb[own], rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[own] = s
                break
            low = s <= 0
            step = np.min(x[own][low] / np.maximum(x[own][low] - s[low], 1e-300))
            x[own] += step * (s - x[own])
            active[own[x[own] <= eps * 1e-6]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing bin numbers 1..bins, at most depth of them, that add up to bins."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < depth:
            for b in range(min(left, most), 0, -1):
                if b * (depth - len(head)) >= left:
                    extend((*head, b), left - b, b)

    extend((), bins, bins)
    return found


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats) that hold each piece of the histogram exactly once; histogram[b] counts the bins 1 to len - 1."""
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    own = [p for p in patterns(bins, depth) if all(left[b] for b in p)]
    if own:
        a = np.zeros((bins + 1, len(own)))
        for j, p in enumerate(own):
            np.add.at(a[:, j], list(p), 1)
        weight = np.sqrt(1 + np.arange(bins + 1))[:, None]  # long pieces are the hard ones to place
        x = nnls(a * weight, (left * weight[:, 0]).astype(float))
        for j in np.argsort(-x, kind="stable"):
            need = a[:, j].astype(np.int64)
            n = int(min(np.floor(x[j] + 1e-6), *(left[b] // need[b] for b in set(own[j]))))
            if n > 0:
                out.append((own[j], n))
                left -= n * need
    out += _best_fit(left)
    return out


def _best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: pieces of a bin go where they leave the least room, as many at once as fit alike."""
    bins = len(left) - 1
    room: dict[int, dict[tuple[int, ...], int]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(p: tuple[int, ...], n: int) -> None:
        free = bins - sum(p)
        if free:
            at = room.setdefault(free, {})
            at[p] = at.get(p, 0) + n
        else:
            done.append((p, n))

    for b in range(bins, 0, -1):
        n = int(left[b])
        while n:
            free = min((f for f, at in room.items() if f >= b and at), default=None)
            if free is None:
                each = bins // b
                if n >= each:
                    put((b,) * each, n // each)
                    n %= each
                else:
                    put((b,) * n, 1)
                    n = 0
                continue
            p = max(room[free])
            take = min(n, room[free].pop(p) if n >= room[free][p] else n)
            if p in room[free]:
                room[free][p] -= take
            put((*p, b), take)
            n -= take
    return done + [(p, n) for _, at in sorted(room.items()) for p, n in sorted(at.items()) if n]


def _table(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, from rank, to rank, first sequence, offset in bins): pieces of a bin in the order of their rank fill one slot of a pattern after another."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for p, n in planned:
        at = 0
        for b in p:
            lo = used.get(b, 0)
            rows.append((b, lo, lo + n, first, at))
            used[b] = lo + n
            at += b
        first += n
    return rows


def _lengths(column: pa.Array, vocabulary: str | None) -> np.ndarray:
    """Tokens of each whole text, or its words without a vocabulary."""
    if vocabulary is None:
        return np.diff(words(column).doc)
    return np.array([len(token_counts.encode(t, vocabulary)) for t in column.to_pylist()], np.int64)


def pieces(docs: DataFrame, capacity: int, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start and n_tokens of each piece; a text of w > 0 tokens has ceil(w / capacity) pieces."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = _lengths(batch.column("text"), vocabulary)
        parts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(capacity, n[row] - piece * capacity)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece), pa.array(piece * capacity), pa.array(size)], ["doc_id", "piece", "start", "n_tokens"])

    return common.texts(docs, id_col, text_col).mapInArrow(common.over_slices(count), "doc_id long, piece long, start long, n_tokens long")


def pack(docs: DataFrame, *, capacity: int = 2048, bins: int = 64, depth: int = 3, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, n_tokens, sequence and offset: where in which sequence of ``capacity`` tokens each piece goes.

    Tokens are those of the whole text's encoding by ``vocabulary``, a file of ranks as in :mod:`token_counts`, or words without one;
    a piece starts at token ``start`` of its text and takes the slot at ``offset``, which is as wide as its bin;
    slots of a sequence don't overlap and end within the capacity. Rows that repeat, or share an id, are packed each; null and
    empty texts have no pieces; rows without an id are skipped; an empty table gives no rows; other columns are not read.
    ``capacity`` must be a multiple of ``bins``.
    """
    if capacity % bins:
        raise ValueError("capacity must be a multiple of bins")
    spark, width = docs.sparkSession, capacity // bins
    n = common.partitions(spark)
    own = common.written(pieces(docs, capacity, vocabulary=vocabulary, id_col=id_col, text_col=text_col).withColumn("bin", F.ceil(F.col("n_tokens") / width).cast("int")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(16 * n)).cast("int")), "pieces")
    counts = own.groupBy("bin", "shard").agg(F.count("*").alias("n"))
    histogram = np.zeros(bins + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        histogram[r.bin] = r.n
    rows = _table(plan(histogram, depth))
    # ranks: place within (shard, bin), after the pieces of the bin in earlier shards
    before = counts.select("bin", "shard", (F.sum("n").over(W.partitionBy("bin").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    place = F.row_number().over(W.partitionBy("shard", "bin").orderBy("doc_id", "piece", "n_tokens")) - 1
    ranked = own.withColumn("place", place).join(before, ["bin", "shard"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("place"))
    bounds = {}
    for b, lo, _, first, at in rows:
        bounds.setdefault(b, []).append((lo, first, at * width))
    bounds = {b: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for b, v in bounds.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, rank = (batch.column(c).to_numpy() for c in ("bin", "rank"))
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for own_bin in np.unique(b):
                at = np.flatnonzero(b == own_bin)
                lo, first, start = bounds[int(own_bin)]
                k = np.searchsorted(lo, rank[at], side="right") - 1
                sequence[at], offset[at] = first[k] + rank[at] - lo[k], start[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "n_tokens")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "n_tokens", "sequence", "offset"])

    return ranked.select("doc_id", "piece", "start", "n_tokens", "bin", "rank").mapInArrow(assign, "doc_id long, piece long, start long, n_tokens long, sequence long, offset long")
