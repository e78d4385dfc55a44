"""Operator 4, token-id output: fixed-width bit packing with block offsets.

A shard file holds ids of documents in ascending order of doc_id:

    blocks      each ``block`` ids packed with ``bits`` bits an id, least significant bit first,
                padded to whole bytes
    offsets     one 64-bit word for each block and one more: where its bytes begin
    documents   for each document: id, 1 if the id is null, first id's number in the shard
    footer      16 little-endian unsigned 64-bit words, see FOOTER

``bits`` is the least width that holds every id of the vocabulary and the end id.  Unpacking is
one ``numpy.unpackbits`` over a block; any document is read from its own blocks only.

Documents are range-partitioned by doc_id, and a task closes a shard and begins the next when it
has ``shard_ids`` ids, so shards follow each other in order and none grows with the table; a writer
holds one block and the index of one shard.  A shard is written under a name of its own attempt
and renamed when complete; a lost executor or a second attempt leaves no half-written shard.  The
manifest (one row for each shard) is all that the driver holds.

Defined results: a null or empty text is the end id alone; null doc_ids come first; repeated
doc_ids keep one entry for each row, ordered by text.  A document of any length lies in one shard.
An empty table writes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = int.from_bytes(b"weftbits", "little")
#: magic, version, bits, block, n_ids, n_docs, where offsets begin, where documents begin, 8 unused
FOOTER = "<16Q"
FOOTER_BYTES = 128
BLOCK = 8192
#: Ids after which a shard ends, and documents.
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20


def width(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; holds one block of ids and the document index."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.at, self.offsets, self.docs, self.rest, self.n, self.held = 0, [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.n))
        self.rest.append(ids)
        self.n, self.held = self.n + len(ids), self.held + len(ids)
        if self.held >= self.block:
            self._flush(self.held - self.held % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for i in range(0, n, self.block):
            data = pack(ids[i : min(i + self.block, n)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        offsets, docs = np.array([*self.offsets, self.at], "<u8"), np.array(self.docs, "<i8").reshape(-1, 3)
        self.sink.write(offsets.tobytes())
        self.sink.write(docs.tobytes())
        self.sink.write(struct.pack(FOOTER, MAGIC, 2, self.bits, self.block, self.n, len(docs), self.at, self.at + offsets.nbytes, *[0] * 8))


class ShardReader:
    """Random access to a shard through any seekable file object."""

    def __init__(self, source):
        self.source = source
        foot = struct.unpack(FOOTER, self._at(source.seek(0, 2) - FOOTER_BYTES, FOOTER_BYTES))
        if foot[0] != MAGIC or foot[1] != 2:
            raise ValueError("not a packed token shard")
        _, _, self.bits, self.block, self.n_ids, self.n_docs, at, docs = foot[:8]
        self.offsets = np.frombuffer(self._at(at, docs - at), "<u8")
        self.docs = np.frombuffer(self._at(docs, self.n_docs * 24), "<i8").reshape(-1, 3)
        self.starts = np.append(self.docs[:, 2], self.n_ids)
        self.cached: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> np.ndarray:
        if self.cached[0] != k:
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            self.cached = k, unpack(self._at(a, b - a), self.bits, min(self.block, self.n_ids - k * self.block))
        return self.cached[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids number ``start`` to ``end`` of the shard."""
        parts = [self._block(k)[max(0, start - k * self.block) : end - k * self.block] for k in range(start // self.block, -(-end // self.block))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int, block: int = BLOCK, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode and write all documents; the manifest: (part, shard, path, n_docs, n_ids)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits, writer, shard = width(max(enc.vocab, end_id + 1)), None, 0
        files, root = file_system(folder)

        def finished() -> pd.DataFrame:
            writer.close()
            sink.close()
            path = f"{root}/shard-{part:06d}-{shard:04d}.bits"
            if files.get_file_info(path).type == pafs.FileType.NotFound:
                files.move(name, path)
            else:  # another attempt was first; its rows, and so its bytes, are the same
                files.delete_file(name)
            return pd.DataFrame({"part": [part], "shard": [shard], "path": [path.rpartition("/")[2]], "n_docs": [len(writer.docs)], "n_ids": [writer.n]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    name = f"{root}/.{part:06d}.{uuid.uuid4().hex}"
                    sink = files.open_output_stream(name)
                    writer = ShardWriter(sink, bits, block)
                writer.add(None if doc_id is None else int(doc_id), np.append(enc.encode(text or ""), np.uint32(end_id)))
                if writer.n >= shard_ids or len(writer.docs) >= shard_docs:
                    yield finished()
                    writer, shard = None, shard + 1
        if writer is not None:
            yield finished()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(partitions, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .select(common.id_text(), "text")
    )
    return ordered.mapInPandas(task, "part long, shard long, path string, n_docs long, n_ids long")


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """One row per document of the shards, in any order: (doc_id, start, n_tokens, ids_crc32)."""
    rows, at = [], 0
    for m in sorted(manifest, key=lambda m: (m["part"], m["shard"])):
        rows.append((f"{folder}/{m['path']}", at))
        at += m["n_ids"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                files, name = file_system(path)
                with files.open_input_file(name) as source:
                    shard = ShardReader(source)
                    for a in range(0, shard.n_docs, 4096):
                        b = min(a + 4096, shard.n_docs)
                        ids = shard.ids(int(shard.starts[a]), int(shard.starts[b])).astype("<u4")
                        cut = shard.starts[a : b + 1] - shard.starts[a]
                        data = memoryview(ids.tobytes())
                        yield pd.DataFrame({
                            "doc_id": pd.arrays.IntegerArray(shard.docs[a:b, 0].copy(), shard.docs[a:b, 1] == 1),
                            "start": start + shard.starts[a:b],
                            "n_tokens": np.diff(cut),
                            "ids_crc32": [zlib.crc32(data[4 * int(x) : 4 * int(y)]) for x, y in zip(cut[:-1], cut[1:], strict=True)],
                        })

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    paths = spark.createDataFrame(rows, "path string, start long").repartition(len(rows))
    return paths.mapInPandas(task, schema)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1, partitions: int | None = None, folder: str | None = None, **options) -> DataFrame:
    """Write all documents as shards, then return what the files hold.

    ``partitions`` defaults to the number of shuffle partitions; ``options`` go to :func:`write_shards`.
    """
    spark = docs.sparkSession
    folder = folder or common.new_folder(spark, "tokens")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = write_shards(docs, folder, tokenizer, end_id, partitions, **options).collect()  # a row for each shard
    return read_shards(spark, folder, manifest)
