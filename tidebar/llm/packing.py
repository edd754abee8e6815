"""Best-fit-decreasing packing of token windows into fixed-length sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, materialize, ranked
from .tokens import word_tokenizer

WINDOW = 4096
#: Placement runs up to which they are broadcast; beyond, they are joined.
MAX_BROADCAST_RUNS = 300_000


class CapacityTree:
    """A segment tree over remaining capacities 0..n: which hold open windows, and the least that is at least x."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.open[2 * i])
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over whole length classes: (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Pieces of one length are placed together: the tightest open windows that can take one take as many as
    fit, for the piece after the first again finds the same window tightest. So the result is that of piece by
    piece placement, while the work and the list depend on the number of different lengths, not of documents.
    """
    tree, pools, used, runs = CapacityTree(window), {}, 0, []

    def put(capacity: int, lo: int, hi: int) -> None:
        if hi > lo and capacity > 0:
            if not pools.get(capacity):
                tree.set(capacity, True)
                pools[capacity] = []
            pools[capacity].append((lo, hi))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                capacity, lo, hi = window, used, used - (-left // each)
                used = hi
            else:
                each = capacity // length
                lo, hi = pools[capacity].pop()
                if not pools[capacity]:
                    tree.set(capacity, False)
            n = min(left, (hi - lo) * each)
            full, some = divmod(n, each)
            runs.append((length, rank, rank + n, lo, each, window - capacity))
            rank, left = rank + n, left - n
            put(capacity - each * length, lo, lo + full)
            if some:
                put(capacity - some * length, lo + full, lo + full + 1)
                full += 1
            put(capacity, lo + full, hi)
    return runs


def windows(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for): each document's ids and ``end_id``,
    cut into full windows and a rest. A null text is empty: one piece with the end id alone."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids

    def run(batches):
        t, end, step = word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * window
        for b in batches:
            who, rows, ids = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                raw = t.encode(text) + end
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    who.append(i)
                    rows.append((at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4))
                    if with_ids:
                        ids.append(part)
            cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int32())), *(pa.array(cols[:, k]) for k in range(4)), *([pa.array(ids, pa.binary())] * with_ids)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of ``windows`` with sequence_id and offset (gapless from 0 in each sequence).

    The driver gets the number of pieces of each length (at most ``window`` numbers) and plans all sequences from
    it; a piece finds its place by its rank among those of its length. Other columns are ignored; repeated rows are
    packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(windows(docs, tokenizer, end_id, window, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan(histogram, window)
    places = spark.createDataFrame(runs, "__l bigint, __lo bigint, __hi bigint, __seq bigint, __each bigint, __off bigint")
    if len(runs) <= MAX_BROADCAST_RUNS:
        places = F.broadcast(places)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string"))
    placed = ranked(pieces, ["length"], id_bucket(key), ["doc_id", "start", "ids_crc32", "doc_tokens"], "__rank")
    placed = placed.join(places, (F.col("length") == F.col("__l")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    at = F.col("__rank") - F.col("__lo")
    return placed.select(*pieces.columns, (F.col("__seq") + F.expr("(__rank - __lo) div __each")).alias("sequence_id"), (F.col("__off") + at % F.col("__each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (array<int>): packed pieces with their ids, put together and padded to ``window`` ids; a sequence whose
    length is a power of two stays as long as it is."""

    def run(pdf):
        import pandas as pd

        raw = b"".join(pdf.sort_values("offset")["ids"])
        own = np.frombuffer(raw, "<u4")
        ids = np.full(window if len(own) & (len(own) - 1) else len(own), pad_id, dtype=np.int32)
        ids[: len(own)] = own
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(run, "sequence_id bigint, ids array<int>")
