"""Reading, batching and lineage helpers shared by the operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.cluster import components

#: Bytes of text that a vectorised step holds at a time; a single longer text is held alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a table of the shared folder and read again: its lineage ends there, and losing executors loses nothing."""
    return storage.written(df, name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, text: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with at most limit bytes of text or a single row."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(text).cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def over_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: int | str = "text", limit: int = SLICE_BYTES) -> Callable:
    """For mapInArrow: f over each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), whatever else docs has; rows without an id are left out, null texts are empty."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs whose id is not in bad.doc_id, with the columns of docs; rows without an id stay."""
    key = "__kinfold_" + uuid.uuid4().hex[:8]
    bad = bad.select(F.col("doc_id").alias(key))
    return docs.join(bad, F.col(id_col).cast("long") == F.col(key), "left_anti")


#: Nodes with more than this share of all members are looked up apart; there are fewer than so many of them.
_HOT = 64


def classes(members: DataFrame, links: DataFrame, id_col: str, linked: DataFrame | None = None) -> DataFrame:
    """id_col, class_id and n_links of each row of members (id_col, node), where links (a, b) join similar nodes, each pair once.

    class_id is the least id in the connected component of the node, n_links the number of other members of the node and of all
    members of linked nodes. Where ``linked`` has that number of linked nodes' members (a, linked), links need only connect the same nodes.
    A null node has no links. Nodes that hold a large share of all members don't meet in one task.
    """
    nodes = members.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min(id_col).alias("least"))
    nodes = written(nodes, "nodes")
    if linked is None:
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = ends.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked"))
    roots = components(links.select("a", "b"))
    own = nodes.join(linked.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left").where("n > 1 or linked is not null")
    own = own.select("node", "least", F.coalesce("component", "node").alias("root"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "n")
    first = own.groupBy("root").agg(F.min("least").alias("class_id"))
    known = written(own.join(first, "root").select("node", "class_id", "n_links", "n"), "classes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = known.where(F.col("n") * _HOT > total).drop("n")  # fewer than _HOT rows
    given = members.where("node is not null")
    apart = given.join(F.broadcast(hot), "node").select(id_col, "class_id", "n_links")
    rest = given.join(F.broadcast(hot.select("node")), "node", "left_anti").join(known.drop("n"), "node", "left")
    rest = rest.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    none = members.where("node is null").select(id_col, F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return apart.unionByName(rest).unionByName(none)


#: Rows of arrays that are sent to a partition together, see :func:`packed`.
PACKED = "part int, n long, entries binary"


def packed(parts: int, key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Equally long arrays as a compressed blob for each partition, chosen by key; for repartitionById(parts, "part")."""
    to = (key % np.uint64(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    columns = [c[order] for c in columns]
    cut = np.searchsorted(to[order], np.arange(parts + 1))
    rows = [(p, b - a, pa.compress(b"".join(c[a:b].tobytes() for c in columns), "zstd", asbytes=True)) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "entries"])


def unpacked(batch: pa.RecordBatch, kinds: tuple) -> list[np.ndarray]:
    """The arrays of the blobs of a batch."""
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    width = sum(np.dtype(k).itemsize for k in kinds)
    for n, blob in zip(batch.column("n").to_pylist(), batch.column("entries")):
        raw, at = pa.decompress(blob.as_py(), n * width, "zstd", asbytes=True), 0
        for x, k in zip(out, kinds):
            x.append(np.frombuffer(raw, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in out]
