"""Benchmark decontamination with an FM-index for every training shard.

A phrase is each window of ``n`` words of a benchmark item (all of its words where it has fewer, ``least`` at least). A
shard is what a task reads at a time, up to :data:`SHARD_BYTES` of text; the words that occur in no phrase are folded into one symbol, and what lies between two
such symbols is left out where it is too short for any phrase, which changes no count of any phrase. Over the rest the
shard gets a suffix array, its Burrows-Wheeler transform in a wavelet matrix and every 32nd suffix position; phrases are
searched backwards through ranks, all at once, located by LF steps to the next sampled position, and the spans of a
document are merged where they overlap or touch. Nothing is shuffled, unless the benchmark takes several passes: then rows are
numbered and written, the spans of all passes are merged for each row, and texts are joined with them to be cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .text import WORD, words

_CASED = regex.compile(WORD.replace("[", "[A-Z"))
_SAMPLE = 32
#: Text of a shard, each of which has an index of its own; a single longer text is a shard alone.
SHARD_BYTES = 8 << 20
SCHEMA = "doc_id long, start long, end long, n_words int, items array<long>"
#: With the place of the first word.
_FOUND = f"{SCHEMA}, first long"


class WaveletMatrix:
    """Ranks of symbols in a sequence of non-negative integers, vectorised over queries."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (sequence >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            one, z = (symbol >> k) & 1 == 1, self.zeros[level]
            a, b = self.ones[level][lo], self.ones[level][hi]
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b)
        return hi - lo


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    key = s[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    h = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffix = order[at]
        first, second = group[at], rank[np.minimum(suffix + h, n)]
        o = np.lexsort((second, first))
        order[at] = suffix[o]
        first, second = first[o], second[o]
        head = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[at] = head
        group[at] = np.maximum.accumulate(np.where(head, at, 0))
        rank[order[at]] = group[at]
        h *= 2


class FMIndex:
    """Over symbols of 1 and more; a smallest symbol 0 is set at the end."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        s = np.concatenate([sequence, [0]])
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        sampled = order % _SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.positions = sampled, order[sampled]

    def count(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each phrase; phrases are padded rows."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for back in range(int(sizes.max(initial=0))):
            on = np.flatnonzero((back < sizes) & (lo < hi))
            if not len(on):
                break
            c = phrases[on, sizes[on] - 1 - back]
            lo[on], hi[on] = self.first[c] + self.wavelet.rank(c, lo[on]), self.first[c] + self.wavelet.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.positions[self.marks[at[done]]] + steps
            left, at = left[~done], at[~done]
            c = self.bwt[at]
            at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


def phrases_of(items: list[tuple[int, str]], n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary of word hashes, padded phrases of 1-based word numbers, their sizes, their items)."""
    w = words(pa.array([t for _, t in items], pa.string()))
    vocabulary, code = np.unique(w.hash, return_inverse=True)
    rows, owner = [], []
    for k, (item, _) in enumerate(items):
        own = (code[w.doc[k] : w.doc[k + 1]] + 1).astype(np.int32)
        if len(own) >= n:
            rows.append(np.lib.stride_tricks.sliding_window_view(own, n))
            owner += [item] * (len(own) - n + 1)
        elif len(own) >= least:
            rows.append(np.pad(own, (0, n - len(own)))[None])
            owner.append(item)
    phrases = np.concatenate(rows) if rows else np.zeros((0, n), np.int32)
    return vocabulary, phrases, (phrases > 0).sum(1), np.array(owner, np.int64)


def _matches(column: pa.Array, vocabulary: np.ndarray, phrases: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, first word, words, phrase) of each occurrence."""
    w = words(column)
    if not len(w.hash) or not len(phrases):
        return
    place = np.searchsorted(vocabulary, w.hash)
    place[place == len(vocabulary)] = 0
    code = np.where(vocabulary[place] == w.hash, place + 1, 0)
    # runs of known words within a row; shorter ones than every phrase can't hold any
    known = code > 0
    edge = np.zeros(len(code) + 1, bool)
    edge[w.doc] = True
    begin = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | edge[:-1]))
    end = np.flatnonzero(known & (np.concatenate([~known[1:], [True]]) | edge[1:])) + 1
    long = end - begin >= sizes.min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return
    size = end - begin + 1  # with one folded symbol behind each run
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(begin, size)
    fold = len(vocabulary) + 1
    sequence = np.where(np.isin(np.arange(at[-1]), at[1:] - 1), fold, code[np.minimum(source, len(code) - 1)])
    index = FMIndex(sequence, fold)
    lo, hi = index.count(phrases, sizes)
    found = np.flatnonzero(hi > lo)
    many = (hi - lo)[found]
    if not len(found):
        return
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)
    which = np.repeat(found, many)
    word = source[index.locate(rows)]
    row = np.searchsorted(w.doc, word, side="right") - 1
    yield from zip(row.tolist(), (word - w.doc[row]).tolist(), sizes[which].tolist(), which.tolist())


def _finder(vocabulary: np.ndarray, phrases: np.ndarray, sizes: np.ndarray, owner: np.ndarray, least: int):
    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        by_row: dict[int, list[tuple[int, int, int]]] = {}
        for row, first, size, phrase in _matches(batch.column("text"), vocabulary, phrases, sizes, least):
            by_row.setdefault(row, []).append((first, first + size, int(owner[phrase])))
        out = []
        for row, spans in sorted(by_row.items()):
            merged: list[list] = []
            for a, b, item in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                    merged[-1][2].add(item)
                else:
                    merged.append([a, b, {item}])
            at = [m.span() for m in _CASED.finditer(batch.column("text")[row].as_py())]
            doc = batch.column("doc_id")[row].as_py()
            out += [(doc, at[a][0], at[b - 1][1], b - a, sorted(items), a) for a, b, items in merged]
        if not out:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "start", "end", "n_words", "items", "first"])

    return find


def _batches(benchmark: DataFrame, item_col: str, item_text_col: str, items_at_once: int, chars_at_once: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """(number of passes, the distinct items of each): at most about so many items and characters come to the driver at a time."""
    own = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("words")).distinct()
    n, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    passes = max(-(-n // items_at_once), -(-chars // chars_at_once))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, passes)))
    return passes, (sorted(map(tuple, own.where(part == k).collect())) for k in range(passes))


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_at_once: int = 100_000, chars_at_once: int = 16 << 20) -> DataFrame:
    """Merged spans of docs that hold phrases of the benchmark: doc_id, start and end in characters, n_words, items.

    About ``items_at_once`` items and ``chars_at_once`` characters of the benchmark are sent to the executors at a time; a larger
    one is searched in as many passes, with the same result. Null ids are skipped, on either side; null and empty texts match
    nothing; very long texts are searched whole; items of fewer than ``least`` words, which everyday prose would match, are no
    phrases; an item that has the same phrase as another is named with it; rows that repeat, or share an id, give their spans
    each; an empty table on either side gives no rows; other columns are not read.
    """
    passes, batches = _batches(benchmark, item_col, item_text_col, items_at_once, chars_at_once)
    source = common.texts(docs, id_col, text_col)
    if passes <= 1:
        return source.mapInArrow(common.over_slices(_finder(*phrases_of(next(batches, []), n, least), least), limit=SHARD_BYTES), _FOUND).drop("first")
    rows = common.written(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    spans = _merge(rows.select(F.col("row").alias("doc_id"), "text"), batches, n, least)
    return spans.join(rows.select("row", "doc_id"), "row").select("doc_id", "start", "end", "n_words", "items")


def _merge(rows: DataFrame, batches: Iterator[list[tuple[int, str]]], n: int, least: int) -> DataFrame:
    """row, start, end, n_words, items: the spans of several passes over rows (their number as doc_id, text), merged within each row by their words."""
    spans = None
    for items in batches:
        found = common.written(rows.mapInArrow(common.over_slices(_finder(*phrases_of(items, n, least), least), limit=SHARD_BYTES), _FOUND), "spans")
        spans = found if spans is None else spans.unionByName(found)
    last = F.col("first") + F.col("n_words")
    w = W.partitionBy("doc_id").orderBy("first", last)
    reach = F.max(last).over(w.rowsBetween(W.unboundedPreceding, -1))
    part = spans.withColumn("part", F.sum(F.when(reach >= F.col("first"), 0).otherwise(1)).over(w))
    own = (F.min("start").alias("start"), F.max("end").alias("end"), (F.max(last) - F.min("first")).cast("int").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return part.groupBy("doc_id", "part").agg(*own).select(F.col("doc_id").alias("row"), "start", "end", "n_words", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, least: int = 5, text_col: str = "text", length_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text", items_at_once: int = 100_000, chars_at_once: int = 16 << 20) -> DataFrame:
    """docs without the spans of :func:`contamination`, in the columns of docs; a text of which only white space and punctuation stays goes.

    Texts without a match and null or empty texts stay as they are; rows without an id are searched like others; rows that repeat
    are cut alike; an empty table on either side changes nothing. ``length_col``, where docs has it, is set anew where a text
    changes. A benchmark of several passes is searched in the texts as they are, and each text is cut once.
    """
    passes, batches = _batches(benchmark, item_col, item_text_col, items_at_once, chars_at_once)
    if not passes:
        return docs
    t, size = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None
    if passes == 1:
        find = _finder(*phrases_of(next(batches), n, least), least)

        def search(part: pa.RecordBatch) -> list[tuple[int, int, int]]:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(t).cast(pa.string()).fill_null("")], ["doc_id", "text"])
            spans = find(own)
            return [] if spans is None else list(zip(*(spans.column(k).to_pylist() for k in range(3))))

        return docs.mapInArrow(_cut(search, t, size, len(docs.columns)), docs.schema)
    row, cuts = (f"__{x}_{uuid.uuid4().hex[:8]}" for x in ("row", "cuts"))
    rows = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = _merge(texts, batches, n, least).groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))

    def known(part: pa.RecordBatch) -> list[tuple[int, int, int]]:
        return [(k, x["start"], x["end"]) for k, own in enumerate(part.column(part.num_columns - 1).to_pylist()) for x in own or ()]

    return rows.join(spans, row, "left").select(*[f"`{c}`" for c in docs.columns], cuts).mapInArrow(_cut(known, t, size, len(docs.columns)), docs.schema)


def _cut(search: Callable[[pa.RecordBatch], list[tuple[int, int, int]]], t: int, size: int | None, width: int):
    """For mapInArrow: the first ``width`` columns of the rows, without the spans (row, start, end) that search gives in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, t, SHARD_BYTES):
                spans = search(part)
                part = part.select(list(range(width)))
                if not spans:
                    yield part
                    continue
                by_row: dict[int, list[tuple[int, int]]] = {}
                for row, a, b in spans:
                    by_row.setdefault(row, []).append((a, b))
                text, keep = part.column(t).to_pylist(), np.ones(part.num_rows, bool)
                length = part.column(size).to_pylist() if size is not None else None
                for row, cuts in by_row.items():
                    whole, at, pieces = text[row], 0, []
                    for a, b in cuts:
                        pieces.append(whole[at:a])
                        at = b
                    text[row] = "".join([*pieces, whole[at:]])
                    keep[row] = _CASED.search(text[row]) is not None
                    if length is not None:
                        length[row] = len(text[row])
                arrays = list(part.columns)
                arrays[t] = pa.array(text, part.column(t).type)
                if length is not None:
                    arrays[size] = pa.array(length, part.column(size).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array(keep))

    return cut
