"""Normaliser of monolithic gzip WARC files.

A WARC file whose records share one gzip stream can't be read from the middle. The normaliser inflates such a file once, as a
stream, rewrites every record as a gzip member of its own and writes an index of the members beside it. Files are spread over
the cluster; within a file the work is sequential by its nature and keeps one record in memory.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from . import common

INDEX = pa.schema([("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("inflated", pa.int64()), ("crc32", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("url", pa.string())])
_CHUNK = 1 << 16


class WarcError(ValueError):
    """A file that isn't whole WARC records."""


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def record(url: str, body: bytes, number: int) -> bytes:
    """A WARC/1.1 response record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:{number}>\r\nWARC-Date: {datetime(2024, 1, 1, tzinfo=UTC):%Y-%m-%dT%H:%M:%SZ}\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def _inflated(file: BinaryIO) -> Iterator[bytes]:
    """The content of all members of a gzip file, whichever they are, in bounded parts."""
    z, begun = zlib.decompressobj(31), False
    while data := file.read(_CHUNK):
        while data:
            part = z.decompress(data, 1 << 20)
            begun = True
            if part:
                yield part
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
    if begun:
        raise WarcError("the gzip stream ends early")


def records(file: BinaryIO) -> Iterator[tuple[bytes, dict[str, str]]]:
    """(whole record with the empty lines behind it, its headers) of each record of a gzip file."""
    parts = _inflated(file)
    held = bytearray()

    def need(n: int) -> bool:
        if len(held) < n:
            for part in parts:
                held.extend(part)
                if len(held) >= n:
                    return True
            return False
        return True

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        if not need(1):
            return
        at = 0
        while (end := held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(held)
            if not need(at + 1):
                if held.strip(b"\r\n"):
                    raise WarcError("a record's headers don't end")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
        head: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        try:
            size = end + 4 + int(head["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a content length") from e
        if not need(size):
            raise WarcError("the last record ends early")
        need(size + 4)
        tail = 4 if held[size : size + 4] == b"\r\n\r\n" else 0
        yield bytes(held[: size + tail]), head
        del held[: size + tail]


def normalise(source: str, target: str, index: str, level: int = 6) -> pa.Table:
    """Rewrite a gzip WARC file with a member for each record; the index goes to a Parquet file and is returned. A malformed file raises an error and leaves nothing.

    Members are byte for byte the records of the source, in order; an empty file gives an empty file and index; a file with a
    member for each record already comes out the same but for its compression. Both files appear under their names only when
    whole: a task that is run again, or twice at a time, writes the same bytes and replaces them.
    """
    own = f".{os.getpid()}-{os.urandom(4).hex()}"
    (fs, src), (to, dst), (_, idx) = _filesystem(source), _filesystem(target), _filesystem(index)
    rows: list[tuple] = []
    try:
        with fs.open_input_stream(src, compression=None) as file, to.open_output_stream(dst + own, compression=None) as out:
            at = 0
            for n, (whole, head) in enumerate(records(file)):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(whole) + z.flush()
                out.write(member)
                rows.append((n, at, len(member), len(whole), zlib.crc32(whole), head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri")))
                at += len(member)
    except (WarcError, zlib.error):
        to.delete_file(dst + own)
        raise
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(INDEX), INDEX)], schema=INDEX)
    with to.open_output_stream(idx + own, compression=None) as out:
        pyarrow.parquet.write_table(table, out)
    to.move(dst + own, dst)
    to.move(idx + own, idx)
    return table


def read_member(path: str, offset: int, length: int) -> bytes:
    """The record at an offset of a normalised file, by that member alone."""
    fs, p = _filesystem(path)
    with fs.open_input_file(p) as file:
        file.seek(offset)
        return zlib.decompress(file.read(length), 31)


def write_monolithic(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 1) -> DataFrame:
    """A monolithic gzip WARC file of each partition of pages; path and number of records of each file.

    Null pages have empty bodies, null addresses are empty; rows without an id are left out; empty partitions give no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        fs, p = _filesystem(path)
        own, n, out, z = f"{p}.{os.getpid()}-{os.urandom(4).hex()}", 0, None, zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for key, url, html in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if out is None:
                    fs.create_dir(os.path.dirname(p), recursive=True)
                    out = fs.open_output_stream(own, compression=None)
                out.write(z.compress(record(url or "", (html or "").encode(), key)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            fs.move(own, p)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "n_records"])

    own = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(write, "path string, n_records long")


def normalise_all(spark: SparkSession, paths: list[str], folder: str, *, level: int = 6) -> DataFrame:
    """The index of all members that :func:`normalise` makes of the files, a task for each file: file, then the columns of the index, then error.

    The same rows are in the sidecar file ``<file>.index.parquet`` beside each normalised file. A malformed file gives one row, of
    its name and what is wrong with it, and neither a normalised file nor a sidecar; the others are normalised all the same. Files of
    the same name in different folders would replace each other and are refused.
    """
    if len({os.path.basename(p) for p in paths}) < len(set(paths)):
        raise ValueError("files must have different names")
    paths = sorted(set(paths))
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(max(1, len(paths)), "path") if paths else spark.createDataFrame([], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/{os.path.basename(path)}"
                fs, p = _filesystem(target)
                fs.create_dir(os.path.dirname(p), recursive=True)
                try:
                    index, error = normalise(path, target, target + ".index.parquet", level), None
                except (WarcError, zlib.error) as e:
                    index, error = pa.Table.from_arrays([pa.nulls(1, f.type) for f in INDEX], schema=INDEX), str(e)
                name, said = (pa.array([x] * len(index), pa.string()) for x in (os.path.basename(path), error))
                yield from index.add_column(0, "file", name).append_column("error", said).to_batches(max_chunksize=10_000)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return files.mapInArrow(run, "file string, " + ", ".join(f"`{f.name}` {kinds[f.type]}" for f in INDEX) + ", error string")


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Pages written as monolithic files in the shared folder, normalised: the index of all members, with its file.

    What :func:`write_monolithic` says of nulls holds; rows that repeat, or share an id, are records each; a very long page is one
    record, held in memory alone; an empty table gives no rows; other columns are not read.
    """
    folder = f"{storage.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    paths = [r.path for r in write_monolithic(pages, f"{folder}/raw", **options).select("path").toLocalIterator()]
    return normalise_all(spark, sorted(paths), f"{folder}/members")
