"""Token ids in files of compressed planes.

Ids are cut into blocks of a fixed number. A block is transposed into byte planes (the first byte of every id, then
the second, ...) or bit planes, and each plane is compressed with zstandard by itself: high planes are nearly empty,
low ones even. A file is its chunks one after the other, then an index of them and the index's place:

    magic | chunk | chunk | ... | index (JSON, zstandard) | 8 bytes: index's offset | magic

A chunk holds planes of ids, or a part of the table of documents (keys and numbers of ids, as an Arrow stream).
Files are written by tasks under names of their own and count once the manifest lists them, so that what a lost or
repeated task leaves is never read.
"""

from __future__ import annotations

import json
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank, small_batches, width
from .encoding import Encoder, portions

MAGIC, BLOCK, DOCS = b"IDPLANE1", 1 << 16, 1 << 14


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [row.tobytes() for row in octets]
    return [np.packbits((octets[k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The block of `n` ids that split_planes() took apart."""
    octets = np.zeros((4, n), dtype=np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if len(planes) == 4:
            octets[k] = raw
        else:
            octets[k // 8] |= np.unpackbits(raw, count=n) << (k % 8)
    return np.ascontiguousarray(octets.T).reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file to a binary stream; holds one block of ids and one part of the document table."""

    def __init__(self, out, keys: pa.DataType, block: int = BLOCK, bits: bool = False, level: int = 3):
        import zstandard

        self.out, self.block, self.bits, self.keys = out, block, bits, keys
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.index: list[dict] = []
        self.waiting, self.docs = bytearray(), []
        self.at = self.tokens = self.rows = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, key, ids: bytes) -> None:
        self.waiting += ids
        self.docs.append((key, len(ids) // 4))
        if len(self.docs) >= DOCS:
            self._docs()
        while len(self.waiting) >= 4 * self.block:
            self._ids(4 * self.block)

    def _ids(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.waiting[:size]), dtype="<u4")
        del self.waiting[:size]
        at = self.at
        sizes = [self._write(self.pack(p)) for p in split_planes(ids, self.bits)]
        self.index.append({"kind": "ids", "at": at, "n": len(ids), "first": self.tokens, "sizes": sizes})
        self.tokens += len(ids)

    def _docs(self) -> None:
        sink = pa.BufferOutputStream()
        rows = pa.record_batch([pa.array([k for k, _ in self.docs], type=self.keys), pa.array([n for _, n in self.docs], type=pa.int64())], names=["key", "n"])
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows)
        at, first = self.at, self.rows
        self.index.append({"kind": "docs", "at": at, "n": len(self.docs), "first": first, "sizes": [self._write(self.pack(sink.getvalue().to_pybytes()))]})
        self.rows += len(self.docs)
        self.docs = []

    def close(self) -> None:
        if self.waiting:
            self._ids(len(self.waiting))
        if self.docs:
            self._docs()
        at = self.at
        self._write(self.pack(json.dumps({"block": self.block, "chunks": self.index}).encode()))
        self._write(at.to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads one file from a binary stream that can seek; documents() holds one block of ids and one document."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        end = self._read(size - 16, 16)
        if end[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a complete file of id planes")
        at = int.from_bytes(end[:8], "little")
        self.index = json.loads(self.unpack(self._read(at, size - 16 - at)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _chunks(self, kind: str):
        for c in (c for c in self.index["chunks"] if c["kind"] == kind):
            raw, at, parts = self._read(c["at"], sum(c["sizes"])), 0, []
            for n in c["sizes"]:
                parts.append(self.unpack(raw[at : at + n]))
                at += n
            yield c, parts

    def block(self, number: int) -> np.ndarray:
        """One block of ids, by the index alone."""
        c = [c for c in self.index["chunks"] if c["kind"] == "ids"][number]
        raw, at, parts = self._read(c["at"], sum(c["sizes"])), 0, []
        for n in c["sizes"]:
            parts.append(self.unpack(raw[at : at + n]))
            at += n
        return join_planes(parts, c["n"])

    def documents(self):
        """(key, ids as little-endian bytes) of each document, in the file's order."""
        blocks, ready, at = self._chunks("ids"), b"", 0
        for _, (table,) in self._chunks("docs"):
            rows = pa.ipc.open_stream(table).read_all()
            for key, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                parts, lack = [], 4 * n
                while lack > len(ready) - at:
                    parts.append(ready[at:])
                    lack -= len(ready) - at
                    c, planes = next(blocks)
                    ready, at = join_planes(planes, c["n"]).tobytes(), 0
                parts.append(ready[at : at + lack])
                at += lack
                yield key, b"".join(parts)


def _write(batches, folder: str, tokenizer: str, end_id: int, block: int, bits: bool, keys: pa.DataType):
    from pyarrow.fs import FileSystem

    encoder, end = Encoder.of(tokenizer), end_id.to_bytes(4, "little")
    fs, root = FileSystem.from_uri(folder)
    number, writer = TaskContext.get().partitionId(), None
    name = f"{root}/ids-{number:06d}-{uuid.uuid4().hex[:12]}.planes"
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in portions(texts):
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = PlaneWriter(fs.open_output_stream(name), keys, block, bits)
            for key, found in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                writer.add(key, found + end)
    if writer is not None:
        writer.close()
        writer.out.close()
        yield pa.RecordBatch.from_pydict({"shard": [number], "file": [name.rsplit("/", 1)[1]], "docs": [writer.rows], "tokens": [writer.tokens], "bytes": [writer.at]})


def write_ids(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 2, block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Encode every row of `docs` and write files to `folder` (a URI that all executors reach) in ascending order of `key`, nulls first.

    A document is its ids and `end_id`; a null or empty text is that id alone. Rows are range-partitioned and sorted
    by key; each partition is one file, so that file number and place in it follow the key. Rows that repeat a key
    stand next to each other in any order. Returns the manifest: shard, file, start (ids before the file), docs,
    tokens, bytes; a row a file, none for an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    keys = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    rows = docs.select(F.col(key).alias("key"), blank(text).alias("text")).repartitionByRange(width(spark), "key").sortWithinPartitions("key")
    work = partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, block=block, bits=bits, keys=keys)
    # a row a file: as many as there are partitions
    found = sorted(tuple(r) for r in rows.mapInArrow(work, "shard long, file string, docs long, tokens long, bytes long").collect())
    start, listed = 0, []
    for shard, file, n, tokens, size in found:
        listed.append((shard, file, start, n, tokens, size))
        start += tokens
    manifest = spark.createDataFrame(listed, "shard long, file string, start long, docs long, tokens long, bytes long")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest


def _read(batches, folder: str, keys: pa.DataType):
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    for batch in batches:
        for file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, held, at = [], 0, start
            with fs.open_input_file(f"{root}/{file}") as source:
                for key, ids in PlaneReader(source, size).documents():
                    rows.append((key, at, len(ids) // 4, ids))
                    at, held = at + len(ids) // 4, held + len(ids)
                    if held > 4_000_000:
                        yield _rows(rows, keys)
                        rows, held = [], 0
            if rows:
                yield _rows(rows, keys)


def _rows(rows: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
    kinds = (keys, pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Rows of the files that the manifest in `folder` lists: `key`, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    manifest = spark.read.schema("shard long, file string, start long, docs long, tokens long, bytes long").json(f"{folder}/manifest")
    n = max(1, manifest.count())
    keys = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    files = manifest.repartitionByRange(n, "shard").select("file", "start", "bytes")
    return files.mapInArrow(partial(_read, folder=folder, keys=keys), f"key {kind}, start long, n_tokens long, ids binary").withColumnRenamed("key", key)
