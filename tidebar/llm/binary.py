"""Token ids in bit-packed files: the minimum bits for the vocabulary, block offsets, random access.

A file: magic, bits, ids per block, documents, ids (header); the documents' ids (int64, and one
flag byte each for null), their token counts (uint32), the blocks' byte offsets (uint64), then
the blocks, each of which starts at a whole byte.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path
from .tokens import word_tokenizer

MAGIC, HEADER = b"TIDEPK01", struct.Struct("<8sIIQQ")
#: Ids of a block (a multiple of 8), ids of a file before it is closed, and files up to which their starts are broadcast.
BLOCK, FILE_IDS, MAX_BROADCAST_FILES = 4096, 1 << 20, 200_000


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the ids at ``bits`` each, low bits first; eight ids take exactly ``bits`` bytes."""
    n = -(-len(ids) // 8) * 8
    x = np.zeros(n, dtype=np.uint64)
    x[: len(ids)] = ids
    out = np.zeros((n // 8, bits + 8), dtype=np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        v = x[k::8] << np.uint64(shift)
        for j in range((shift + bits + 7) // 8):
            out[:, byte + j] |= ((v >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].reshape(-1)[: (len(ids) * bits + 7) // 8]


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as little-endian 32-bit numbers."""
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, dtype=np.uint8)
    raw[: min(len(data), len(raw))] = data[: len(raw)]
    raw = np.concatenate([raw.reshape(groups, bits), np.zeros((groups, 8), dtype=np.uint8)], axis=1)
    out = np.empty((groups, 8), dtype="<u4")
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        v = np.zeros(groups, dtype=np.uint64)
        for j in range((shift + bits + 7) // 8):
            v |= raw[:, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (v >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def build_file(doc_ids: list, parts: list[bytes], bits: int) -> bytes:
    counts = np.array([len(p) // 4 for p in parts], dtype="<u4")
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    blocks = [pack(ids[i : i + BLOCK], bits).tobytes() for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = bytes(d is None for d in doc_ids)
    return b"".join([HEADER.pack(MAGIC, bits, BLOCK, len(parts), len(ids)), keys.tobytes(), nulls, counts.tobytes(), offsets.tobytes(), *blocks])


class PackedFile:
    """Random access to the documents of one file."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEADER.size
        self.doc_ids, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        self.nulls, at = np.frombuffer(data, np.uint8, n, at), at + n
        self.counts, at = np.frombuffer(data, "<u4", n, at), at + 4 * n
        self.starts = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        n_blocks = -(-self.n_ids // self.block)
        self.offsets, at = np.frombuffer(data, "<u8", n_blocks + 1, at), at + 8 * (n_blocks + 1)
        self.payload = np.frombuffer(data, np.uint8, -1, at)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The file's ids lo to hi, from the blocks that hold them alone."""
        if hi <= lo:
            return np.empty(0, "<u4")
        first, last = lo // self.block, (hi - 1) // self.block
        out = [unpack(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write(docs: DataFrame, tokenizer: str, end_id: int = 1) -> tuple[str, DataFrame]:
    """Encode (doc_id, text), append ``end_id``, and write packed files in ascending doc_id order (nulls first,
    equal ids by text). Returns the folder and the table of its files: file, part, seq, n_docs, n_ids.

    Each task sorts one range of ids and writes files of about FILE_IDS ids under names of their own; the table,
    written with the tasks' results, lists only files of tasks that succeeded, so repeated or lost tasks do no harm.
    A null text gives the end id alone; an empty table gives no files.
    """
    folder = new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        t = word_tokenizer(tokenizer)
        bits, end = bits_for(max(t.vocab_size, end_id + 1)), np.array([end_id], "<u4").tobytes()
        part, seq, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        table = []

        def close():
            nonlocal seq, ids, parts, size
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tpk"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(build_file(ids, parts, bits))
            table.append((name, part, seq, len(parts), size // 4))
            seq, ids, parts, size = seq + 1, [], [], 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                parts.append(t.encode(text) + end)
                size += len(parts[-1])
                if size >= 4 * FILE_IDS:
                    close()
        if parts:
            close()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], k) for i, k in enumerate(kinds)], ["file", "part", "seq", "n_docs", "n_ids"])

    return folder, materialize(rows.mapInArrow(run, "file string, part int, seq int, n_docs bigint, n_ids bigint"), "token-files")


def read(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, unpacked from the files."""
    spark = files.sparkSession
    # starts of parts from one row a part, and of files inside their part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("at"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part").select("file", (F.col("at") + F.col("inside")).alias("base"))
    n = files.count()
    if not n:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    if n <= MAX_BROADCAST_FILES:
        starts = F.broadcast(starts)
    found = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content").join(starts, "file").select("base", "content")

    def run(batches):
        for b in batches:
            for base, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = PackedFile(content.as_py())
                raw = f.ids(0, f.n_ids).tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * c]) for a, c in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, mask=f.nulls.astype(bool)), pa.array(f.starts[:-1] + base), pa.array(f.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
