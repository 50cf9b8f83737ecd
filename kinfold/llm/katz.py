"""Scores of documents under a Katz back-off model of the whole corpus.

A trigram model over words: Good-Turing discounts for counts up to 5, n-grams of ``least`` occurrences or more in the tables
(1: all; 2 leaves those seen once to the lower order), and back-off weights make every conditional distribution sum to one. The
vocabulary is the words seen at least twice; all others are one symbol, as is each document's end.

* Unigrams are counted with map-side sums. The vocabulary goes to the executors while its size, which is checked, allows it;
  beyond that, words get their numbers by a join.
* n-grams go to the partition of their last context word v, first counted beforehand for the counts of counts, from which the
  discounts of the whole corpus are made.
* Then tokens go to the same partitions with their documents. There are all trigrams u v w and bigrams v w of v, so counts,
  probabilities and both orders' back-off weights of v are made in place, and no table of n-grams is written or sent: the
  trigram if it is kept, else the weight of u v times the bigram, else the weight of v times the unigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .text import mix, words

#: Symbols before the words of the vocabulary: before and after a document, and any word outside the vocabulary.
BEGIN, END, UNKNOWN, FIRST = 0, 1, 2, 3
K = 5


class Vocabulary(NamedTuple):
    """hash: sorted word hashes; number: their numbers, by falling count."""

    hash: np.ndarray
    number: np.ndarray


def unigrams(source: DataFrame, parts: int) -> DataFrame:
    """hash, n of every word of source (doc_id, text), in a written table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            h, code = np.unique(h, return_inverse=True)
            return common.packed(parts, h, [h, np.bincount(code, c).astype(np.int64)])

        for batch in batches:
            for part in common.slices(batch, "text"):
                w = words(part.column("text"))
                if len(w.hash):
                    held.append(np.unique(w.hash, return_counts=True))
                if sum(len(x[0]) for x in held) > 1 << 21:
                    yield emit()
        if held:
            yield emit()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [common.unpacked(batch, (np.uint64, np.int64)) for batch in batches]
        if held:
            h, c = (np.concatenate(x) for x in zip(*held))
            h, code = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(code, c).astype(np.int64))], ["hash", "n"])

    return common.written(source.mapInArrow(count, common.PACKED).repartitionById(parts, F.col("part")).mapInArrow(add, "hash long, n long"), "unigrams")


def numbered(counts: DataFrame) -> Vocabulary:
    """The vocabulary on the driver, most frequent words first."""
    rows = counts.where("n > 1").toArrow()
    h, n = rows.column("hash").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    number = np.empty(len(h), np.uint32)
    number[np.lexsort((h.view(np.int64), -n))] = np.arange(FIRST, FIRST + len(h))
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], number[by_hash])


def discounts(n: dict[int, int]) -> np.ndarray:
    """Good-Turing factors for counts 0 to K, from the number n[r] of n-grams with each count r up to K + 1.

    Where the counts of counts are too few or uneven for a factor in (0, 1], that count isn't discounted.
    """
    d = np.ones(K + 1)
    tail = (K + 1) * n.get(K + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, K + 1):
        if n.get(r) and n.get(r + 1) and tail < 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
            if 0 < x <= 1:
                d[r] = x
    return d


def _weights(group: np.ndarray, count: np.ndarray, total: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each n-gram, back-off weight of each context).

    group: the context's number of each n-gram; total: tokens of each context; lower: each n-gram's probability in the lower order.
    """
    size = len(total)
    raw = np.where(count <= K, d[np.minimum(count, K)], 1.0) * count
    left = total - np.bincount(group, raw, size)
    full = left < 1e-9 * np.maximum(total, 1)  # nothing is left to unseen words: one token is added to the context for them
    denominator = total + full
    p = raw / denominator[group]
    seen, below = np.bincount(group, p, size), np.bincount(group, lower, size)
    closed = 1 - below < 1e-12  # every word is seen
    p = np.where(closed[group], p / np.where(seen > 0, seen, 1)[group], p)
    return p, np.where(closed, 0.0, (1 - seen) / np.where(closed, 1, 1 - below))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted keys, whether it's there)"""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _encode(column: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of each text and the offsets of the texts."""
    w = words(column)
    at, known = _find(v.hash, w.hash)
    return (np.where(known, v.number[at], UNKNOWN) if len(v.hash) else np.full(len(w.hash), UNKNOWN)).astype(np.uint32), w.doc


def _trigrams(number: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, u, v, w) of each token and each end of a text."""
    size = np.diff(doc)
    rows = len(size)
    begin = doc[:-1] + 3 * np.arange(rows)  # two symbols before each text, one behind
    s = np.full(len(number) + 3 * rows, BEGIN, np.uint32)
    own = np.arange(len(number)) + np.repeat(2 + 3 * np.arange(rows), size)
    s[own] = number
    s[begin + size + 2] = END
    keep = np.ones(len(s), bool)
    keep[begin] = keep[begin + 1] = False
    at = np.flatnonzero(keep)
    return np.repeat(np.arange(rows), size + 1), s[at - 2], s[at - 1], s[at]


def _occurrences(encoded, parts: int, with_documents: bool):
    """For mapInArrow: distinct trigrams with counts, or each with its document, to the partition of the middle word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit() -> pa.RecordBatch:
            doc, u, v, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if with_documents:
                columns = [doc, u, v, w]
            else:
                order = np.lexsort((w, u, v))
                u, v, w = u[order], v[order], w[order]
                new = np.ones(len(u), bool)
                new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
                first = np.flatnonzero(new)
                columns = [np.diff(np.append(first, len(u))), u[first], v[first], w[first]]
            return common.packed(parts, mix(columns[2]), columns)

        for batch in batches:
            for ids, number, doc in encoded(batch):
                row, u, v, w = _trigrams(number, doc)
                held.append((ids[row], u, v, w))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    yield emit()
        if held:
            yield emit()

    return run


_KINDS = (np.int64, np.uint32, np.uint32, np.uint32)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_BLOCK = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of counts of a partition: how many n-grams of each order are seen r times, for r up to K + 1."""
    held = [common.unpacked(batch, _KINDS) for batch in batches if batch.num_rows]
    if not held:
        return
    c, u, v, w = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.lexsort((w, u, v))
    c, u, v, w = c[order], u[order], v[order], w[order]
    for n in (3, 2):
        if n == 2:
            order = np.lexsort((w, v))
            c, v, w = c[order], v[order], w[order]
            u = np.zeros(len(v), np.uint32)
        new = np.ones(len(c), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        c, u, v, w = np.add.reduceat(c, np.flatnonzero(new)), u[new], v[new], w[new]
        low = np.bincount(c[c <= K + 1], minlength=K + 2)[1:]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(K + 1, n, np.int32)), pa.array(np.arange(1, K + 2, dtype=np.int32)), pa.array(low.astype(np.int64))], ["order", "r", "n"])


def _backed_off(context: np.ndarray, count: np.ndarray, lower: np.ndarray, d: np.ndarray, least: int) -> np.ndarray:
    """Probability of each n-gram that is seen: its own with least occurrences or more, else the weight of its context times the lower order's."""
    _, group = np.unique(context, return_inverse=True)
    total = np.bincount(group, count)
    kept = count >= least
    p, weight = _weights(group[kept], count[kept], total, lower[kept], d)
    out = weight[group] * lower
    out[kept] = p
    return out


def _bigrams(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct bigrams (v in the upper half, w in the lower) and their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(v), _BLOCK):
        held.append(np.unique(v[lo : lo + _BLOCK].astype(np.uint64) << _HALF | w[lo : lo + _BLOCK], return_counts=True))
        if len(held) > 3 or lo + _BLOCK >= len(v):
            key, count = (np.concatenate(x) for x in zip(*held))
            key, code = np.unique(key, return_inverse=True)
            held = [(key, np.bincount(code, count).astype(np.int64))]
    return held[0]


def _evaluated(parts: int, unigram, d: dict[int, np.ndarray], least: int):
    """For mapInArrow, over a partition's tokens: sums of each document's log probabilities, to the partition of the document.

    Bigrams are counted over the whole partition; trigrams by groups of their contexts u v, about so many tokens at a time as _BLOCK.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [common.unpacked(batch, _KINDS) for batch in batches if batch.num_rows]
        if not held:
            return
        p_of = unigram()
        doc, u, v, w = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]
        held.clear()
        two, count = _bigrams(v, w)
        p2 = _backed_off(two >> _HALF, count, p_of((two & _LOW).astype(np.int64)), d[2], least)
        groups = -(-len(doc) // _BLOCK)
        group = np.concatenate([(_context(u[lo : lo + _BLOCK], v[lo : lo + _BLOCK]) % np.uint64(groups)).astype(np.uint16) for lo in range(0, len(doc), _BLOCK)])
        for k in range(groups):
            at = np.flatnonzero(group == k)
            if not len(at):
                continue
            own, code = np.unique(v[at].astype(np.uint64) << _HALF | w[at], return_inverse=True)
            key = u[at].astype(np.uint64) << _HALF | code.astype(np.uint64)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            three, count = key[first], np.diff(np.append(first, len(key)))
            bigram = (three & _LOW).astype(np.int64)
            context = three >> _HALF << _HALF | own[bigram] >> _HALF
            p3 = _backed_off(context, count, p2[np.searchsorted(two, own)][bigram], d[3], least)
            ids, code = np.unique(doc[at][order], return_inverse=True)
            yield common.packed(parts, mix(ids), [ids, np.bincount(code, np.repeat(np.log(p3), count)), np.bincount(code).astype(np.int32)])

    return run


def _context(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u.astype(np.uint64) << _HALF | v)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [common.unpacked(batch, (np.int64, np.float64, np.int32)) for batch in batches]
    if held:
        doc, log, n = (np.concatenate(x) for x in zip(*held))
        doc, code = np.unique(doc, return_inverse=True)
        log, n = np.bincount(code, log), np.bincount(code, n).astype(np.int64)
        for lo in range(0, len(doc), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(n[part]), pa.array(np.round(log[part] / n[part], 9)), pa.array(np.round(np.exp(-log[part] / n[part]), 6))], ["doc_id", "n_tokens", "log_prob", "perplexity"])


def _unigram(documents: int, once: int, steps: tuple[np.ndarray, np.ndarray], total: int):
    """Probabilities of symbols by number."""
    first, count = steps
    first, p = np.concatenate([np.arange(FIRST), first]), np.concatenate([[0, documents, once], count]) / max(1, total)
    return lambda w: p[np.searchsorted(first, w, side="right") - 1]


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 256 << 20, least: int = 1) -> DataFrame:
    """doc_id, n_tokens, log_prob (the natural logarithm's mean over the tokens) and perplexity of each document under the model of all of docs.

    n_tokens counts the words and one end for each row. Rows that repeat, or share an id, count in the corpus each and are scored
    together; null and empty texts are an end alone; rows without an id are left out altogether; an empty table gives no rows;
    other columns are not read; very long texts are scored whole. n-grams of fewer than ``least`` occurrences are left to the lower order; with 1 none is, and those
    seen once get their Good-Turing discount. A vocabulary of more than ``broadcast_bytes`` is joined instead of sent to the executors.
    """
    spark = docs.sparkSession
    source = common.texts(docs, id_col, text_col)
    parts = 2 * common.partitions(spark)
    counts = unigrams(source, parts)
    documents = source.count()
    kept, once, total = counts.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("n") == 1), F.coalesce(F.sum("n"), F.lit(0))).first()
    levels = counts.where("n > 1").groupBy("n").count().orderBy(F.desc("n")).toPandas()
    size = levels["count"].to_numpy(np.int64)
    steps = (FIRST + np.cumsum(size) - size, levels["n"].to_numpy(np.int64))

    def unigram():
        return _unigram(documents, once, steps, total + documents)

    if kept * 12 > broadcast_bytes:
        numbered_docs = _joined(source, counts, parts)

        def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            lists = batch.column("numbers")
            size = np.array([len(x) for x in lists], np.int64)
            yield common.ids(batch), lists.flatten().to_numpy().astype(np.uint32), np.concatenate([[0], np.cumsum(size)])

        return _scores(numbered_docs, read, unigram, parts, least)
    shared = spark.sparkContext.broadcast(numbered(counts))

    def encoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part in common.slices(batch, "text"):
            yield common.ids(part), *_encode(part.column("text"), shared.value)

    return _scores(source, encoded, unigram, parts, least)


def _joined(source: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """doc_id, numbers of the words of each row, in a written table, without the vocabulary in any one place."""
    ranged = common.written(counts.where("n > 1").repartitionByRange(parts, F.desc("n"), "hash").withColumn("part", F.spark_partition_id()), "vocabulary")
    offset = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(offset), F.lit(0)).alias("before"))
    own = W.partitionBy("part").orderBy(F.desc("n"), "hash")
    vocabulary = ranged.withColumn("r", F.row_number().over(own)).join(F.broadcast(before), "part").select("hash", (F.col("before") + F.col("r") - 1 + FIRST).alias("number"))
    copies = source.withColumn("text_hash", F.xxhash64("text")).withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("text_hash")))

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column("text"))
        row, at, h = w.row, w.index, w.hash
        empty = np.flatnonzero(np.diff(w.doc) == 0)  # a row of its own, else the text is lost
        row, at, h = np.concatenate([row, empty]), np.concatenate([at, np.full(len(empty), -1)]), np.concatenate([h, np.zeros(len(empty), np.uint64)])
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_hash", "copy")] + [pa.array(at), pa.array(h.view(np.int64))], ["doc_id", "text_hash", "copy", "at", "hash"])

    tokens = copies.mapInArrow(common.over_slices(explode), "doc_id long, text_hash long, copy int, at long, hash long")
    named = tokens.join(vocabulary, "hash", "left").select("doc_id", "text_hash", "copy", "at", F.coalesce("number", F.lit(UNKNOWN)).cast("int").alias("number"))
    lists = named.groupBy("doc_id", "text_hash", "copy").agg(F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "number")))).alias("x"))
    return common.written(lists.select("doc_id", F.col("x.number").alias("numbers")), "numbered")


def _scores(source: DataFrame, encoded, unigram, parts: int, least: int) -> DataFrame:
    counted = source.mapInArrow(_occurrences(encoded, parts, False), common.PACKED).repartitionById(parts, F.col("part")).mapInArrow(_counted, "`order` int, r int, n long")
    of: dict[int, dict[int, int]] = {2: {}, 3: {}}
    for r in counted.groupBy("order", "r").agg(F.sum("n").alias("n")).collect():
        of[r.order][r.r] = r.n
    d = {order: discounts(n) for order, n in of.items()}
    tokens = source.mapInArrow(_occurrences(encoded, parts, True), common.PACKED).repartitionById(parts, F.col("part"))
    return tokens.mapInArrow(_evaluated(parts, unigram, d, least), common.PACKED).repartitionById(parts, F.col("part")).mapInArrow(_summed, "doc_id long, n_tokens long, log_prob double, perplexity double")
