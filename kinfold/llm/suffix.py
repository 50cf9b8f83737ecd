"""Repeated passages by a sparse suffix array, sorted by the deep-shallow method.

Wanted are the words that lie in a passage of at least L words which occurs more than once in the corpus. Not all suffixes are
needed for that, only those at anchors: of each L consecutive words the last of the least hashes of k words (robust winnowing).
Whichever passage of L words occurs twice has its anchor at the same place both times.

1. Anchors go to the partition of their k words' hash with a hash of their context, the words that passages around them can
   reach. Equal contexts are one suffix, however many copies have it, so no group of copies meets in the sort: an anchor whose
   context occurs twice is settled by that equality of 64-bit hashes, since all passages around it repeat. Where the k words occur
   in different contexts, one anchor of each is asked for its words.
2. The suffixes at those anchors are sorted: multikey quicksort orders them by their first words down to a shallow depth, for
   all groups at once; blind tries order each group that still ties, and give the longest common prefixes. Passages around
   two anchors are equal where a common prefix and the words before both suffice.
3. The spans of a document are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .text import Words, mix, words


def _least(v: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over each w consecutive values (van Herk); len(v) - w + 1 of them."""
    n = len(v)
    rows = -(-n // w)
    x = np.full(rows * w, fill, np.uint64)
    x[:n] = v
    x = x.reshape(rows, w)
    ahead = f.accumulate(x, axis=1).ravel()
    back = f.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def anchors(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, hash of the k words) of the anchors."""
    n, wide = len(w.hash) - k + 1, length - k + 1
    if n < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = w.hash.copy()
    for j in range(1, k):
        g[:-j] = mix(g[:-j] * np.uint64(3) + w.hash[j:])
    g = g[:n]
    row, index = w.row, w.index.astype(np.uint64)
    v = (mix(g) & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - (index[:n] & np.uint64(0xFFFFFF)))
    low = _least(v, wide, np.minimum, 0xFFFFFFFFFFFFFFFF)
    low[row[: len(low)] != row[length - 1 : length - 1 + len(low)]] = 0
    pad = np.concatenate([np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)])
    top = _least(pad, wide, np.maximum, 0)
    at = np.flatnonzero(top[:n] == v)
    return at, g[at]


def _width(length: int) -> type:
    """The least type that holds numbers of words up to length."""
    return np.uint8 if length < 1 << 8 else np.uint16 if length < 1 << 16 else np.uint32


def _contexts(w: Words, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before (length - k at most) and from (length at most) each anchor that are in its text."""
    row = w.row[at]
    return np.minimum(length - k, at - w.doc[row]), np.minimum(length, w.doc[row + 1] - at)


class BlindTrie:
    """Sequences in order: nodes know the depth at which they branch and the words there, not those between."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.root = rows, None
        self.bytes = [r.tobytes() for r in rows]

    def insert(self, i: int) -> None:
        """Blind search for some leaf, a comparison with it alone, then the place for the new leaf."""
        if self.root is None:
            self.root = [i]
            return
        own, node = self.rows[i], self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(int(own[depth])) or next(iter(children.values()))
        other = node[0]
        if self.bytes[other] == self.bytes[i]:
            node.append(i)
            return
        lcp = int((self.rows[other] != own).argmax())
        parent, word, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            parent, word = node, int(own[node[0]])
            node = node[1][word]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][int(own[lcp])] = [i]
            return
        new = (lcp, {int(self.rows[other][lcp]): node, int(own[lcp]): [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][word] = new

    def order(self) -> tuple[list[int], list[int]]:
        """(rows in order, common prefix of each with the one before; the first has 0)."""
        out: list[int] = []
        lcps: list[int] = []
        full = self.rows.shape[1]
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, tuple):
                depth, children = node
                keys = sorted(children)
                stack += [(children[x], depth if k else lcp) for k, x in reversed(list(enumerate(keys)))]
            else:
                out += node
                lcps += [lcp] + [full] * (len(node) - 1)
        return out, lcps


def deep_shallow(group: np.ndarray, rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and row, common prefix with the one before, -1 at the first of a group)."""
    n = len(group)
    order = np.argsort(group, kind="stable")
    label = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if n else np.zeros(0, bool)
    lcp = np.where(label, -1, 0)
    for depth in range(min(shallow, rows.shape[1])):  # multikey quicksort: each group splits by the word at this depth
        tied = ~label
        tied[:-1] |= ~label[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        part, word = np.cumsum(label)[at], rows[order[at], depth]
        o = np.lexsort((word, part))
        order[at], part, word = order[at][o], part[o], word[o]
        split = np.concatenate([[False], (part[1:] == part[:-1]) & (word[1:] != word[:-1])])
        lcp[at[split]] = depth
        label[at[split]] = True
    lcp[~label] = shallow
    begin = np.flatnonzero(label)
    end = np.append(begin[1:], n)
    for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):  # deep: blind tries
        own = order[a:b]
        trie = BlindTrie(rows[own, shallow:])
        for i in range(b - a):
            trie.insert(i)
        inner, common_words = trie.order()
        order[a:b] = own[inner]
        lcp[a + 1 : b] = shallow + np.array(common_words[1:])
    return order, lcp


def _settle(length: int):
    """For mapInArrow, over the anchors of a partition: spans of settled ones and requests for the words of others."""
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, _width(length), _width(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [common.unpacked(batch, kinds) for batch in batches]
        if not held:
            return
        g, context, doc, text, at, left, right = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((at, text, doc, context, g))
        g, context, doc, text, at, left, right = (x[order] for x in (g, context, doc, text, at, left, right))
        same = np.zeros(len(g), bool)
        same[1:] = (g[1:] == g[:-1]) & (context[1:] == context[:-1]) & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (at[1:] == at[:-1])
        g, context, doc, text, at, left, right = (x[~same] for x in (g, context, doc, text, at, left, right))  # repeated rows count once
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (context[1:] != context[:-1])
        one = np.ones(len(g), bool)
        one[1:] = g[1:] != g[:-1]
        kind = np.cumsum(first) - 1
        settled = np.bincount(kind)[kind] > 1
        family = np.cumsum(one) - 1
        asked = first & (np.bincount(family, first)[family] > 1)
        none = lambda n: np.zeros(n, np.int64)
        for pick, request in ((settled, False), (asked, True)):
            i = np.flatnonzero(pick)
            n = len(i)
            columns = [doc[i], text[i], at[i] - (0 if request else left[i].astype(np.int64)), none(n) if request else at[i] + right[i].astype(np.int64), g[i].view(np.int64) if request else none(n), np.full(n, request)]
            for lo in range(0, n, 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 18)]) for c in columns], ["doc_id", "text_hash", "start", "end", "g", "request"])

    return run


def _compare(length: int, k: int, shallow: int):
    """For mapInArrow, over the contexts of a partition: spans of the passages that repeat."""
    left_words, wide = length - k, 2 * length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        order = np.lexsort([rows.column(c).to_numpy() for c in ("at", "text_hash", "doc_id", "g")])
        columns = [rows.column(c).to_numpy()[order] for c in ("g", "doc_id", "text_hash", "at")]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        rows = rows.take(pa.array(order[new]))  # repeated rows answer once
        g, doc, text, at, left, right = (rows.column(c).to_numpy() for c in ("g", "doc_id", "text_hash", "at", "n_left", "n_right"))
        context = np.frombuffer(b"".join(x.as_py() for x in rows.column("words")), np.uint32).reshape(-1, wide)
        order, lcp = deep_shallow(g, np.ascontiguousarray(context[:, left_words:]), shallow)
        before = np.zeros(len(g), np.uint64)
        low, high = np.full(len(g), 1 << 30), np.full(len(g), -1)
        for back in range(left_words + 1):
            if back:
                before = mix(before * np.uint64(3) + context[:, left_words - back].astype(np.uint64) + np.uint64(1))
            block = np.cumsum(lcp < length - back)  # suffixes with so long a common prefix
            fits = (left[order] >= back) & (right[order] >= length - back)
            own = order[fits]
            key = mix(before[own] ^ mix(block[fits].astype(np.uint64)))
            o = np.argsort(key, kind="stable")
            key = key[o]
            twice = np.zeros(len(key), bool)
            twice[1:] = key[1:] == key[:-1]
            twice[:-1] |= twice[1:]
            hit = own[o[twice]]
            low[hit] = np.minimum(low[hit], back)
            high[hit] = np.maximum(high[hit], back)
        hit = np.flatnonzero(high >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(text[hit]), pa.array(at[hit] - high[hit]), pa.array(at[hit] - low[hit] + length)], ["doc_id", "text_hash", "start", "end"])

    return run


def repeats(docs: DataFrame, *, length: int = 50, k: int = 8, shallow: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start and end (counted in words, end excluded) and n_words of the merged passages of at least ``length`` words that occur elsewhere too.

    Elsewhere is another document or another place of the same one; passages that overlap or touch are one. Null and empty
    texts have none; rows that repeat count once; texts that share an id are documents of their own and give their spans each;
    rows without an id are skipped; an empty table gives no rows; other columns are not read. Very long texts are read whole;
    equal passages are all given, none of them is the first. ``length`` is at least ``k``.
    """
    if not 0 < k <= length:
        raise ValueError("length must be at least k")
    source = common.texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    parts = common.partitions(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for part in common.slices(batch, "text"):
                w = words(part.column("text"))
                at, g = anchors(w, length, k)
                if not len(at):
                    continue
                left, right = _contexts(w, at, length, k)
                own = np.zeros(len(at), np.uint64)
                padded = np.concatenate([w.hash, np.zeros(length, np.uint64)])
                for j in range(k - length, length):
                    inside = (j >= -left) & (j < right)
                    own = np.where(inside, mix(own * np.uint64(3) + padded[at + np.where(inside, j, 0)]), mix(own + np.uint64(1)))
                row = w.row[at]
                held.append([g, own, common.ids(part)[row], common.ids(part, "text_hash")[row], at - w.doc[row], left.astype(_width(length)), right.astype(_width(length))])
                if sum(len(h[0]) for h in held) > 1 << 20:
                    columns = [np.concatenate(c) for c in zip(*held)]
                    held.clear()
                    yield common.packed(parts, mix(columns[0]), columns)
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield common.packed(parts, mix(columns[0]), columns)

    entries = source.mapInArrow(find, common.PACKED)
    spans = "doc_id long, text_hash long, start long, end long"
    found = common.written(entries.repartitionById(parts, F.col("part")).mapInArrow(_settle(length), spans + ", g long, request boolean"), "anchors")
    asked = found.where("request").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "g")).alias("asked"))

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.as_buffer() for x in batch.column("text").cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([x.size for x in raw], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())], ["doc_id", "text_hash", "size", "squeezed"])

    squeezed = source.mapInArrow(common.over_slices(squeeze), "doc_id long, text_hash long, size long, squeezed binary")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                text = [pa.decompress(t.as_py(), n, "zstd", asbytes=True).decode() for t, n in zip(part.column("squeezed"), part.column("size").to_pylist())]
                w = words(pa.array(text, pa.large_string()))
                lists = part.column("asked")
                n = np.array([len(x) for x in lists])
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), n)
                at, g = flat.field("start").to_numpy() + w.doc[row], flat.field("g")
                left, right = _contexts(w, at, length, k)
                j = np.arange(k - length, length)
                inside = (j >= -left[:, None]) & (j < right[:, None])
                context = np.where(inside, (w.hash[np.where(inside, at[:, None] + j, 0)] >> np.uint64(32)).astype(np.uint32), np.uint32(0))
                own = [x.tobytes() for x in context]
                yield pa.RecordBatch.from_arrays([g, part.column("doc_id").take(pa.array(row)), part.column("text_hash").take(pa.array(row)), flat.field("start"), pa.array(left), pa.array(right), pa.array(own, pa.binary())], ["g", "doc_id", "text_hash", "at", "n_left", "n_right", "words"])

    contexts = squeezed.join(asked, ["doc_id", "text_hash"]).mapInArrow(answer, "g long, doc_id long, text_hash long, at long, n_left long, n_right long, words binary")
    unsettled = contexts.repartition(parts, "g").mapInArrow(_compare(length, k, shallow), spans)
    every = found.where("not request").select("doc_id", "text_hash", "start", "end").unionByName(unsettled)
    by = W.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    merged = every.withColumn("head", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("part", F.sum("head").over(by)).groupBy("doc_id", "text_hash", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
