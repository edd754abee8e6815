"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where their boundaries agree, then encoded."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sliced
from .tokens import byte_decoder, byte_tokenizer, seam

#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10


def boundaries(pattern: str, text: str) -> list[int]:
    """Where the pre-tokens of a text begin."""
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def _cuts(seen: DataFrame, chunk: int) -> DataFrame:
    """__row, k, from, to, piece: the part of each chunk that is its own and the piece it belongs to.

    A chunk's boundaries are those of the whole text from the first one on that it shares with a neighbour whose
    boundaries are, or that is a boundary in any text (``seam``). Neighbours are cut at the first boundary that both
    have in their overlap, if the left one's are the text's; chunks that aren't cut apart are one piece. One row a
    chunk, without its text, is ordered for each text.
    """
    order = Window.partitionBy("__row").orderBy("k")
    df = seen.withColumn("cut", F.array_min(F.array_intersect("lefts", F.lag("rights").over(order))))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.max(F.when(F.col("sure") | (F.col("k") == 0), F.col("k"))).over(so_far)
    broken = F.max(F.when(F.col("cut").isNull() & (F.col("k") > 0), F.col("k"))).over(so_far)
    df = df.withColumn("true", F.coalesce(anchor >= broken, F.lit(True)))
    df = df.withColumn("cut", F.when(F.lag("true").over(order), F.col("cut")))
    df = df.withColumn("piece", F.sum(F.col("cut").isNotNull().cast("int")).over(so_far))
    return df.select("__row", "k", F.coalesce("cut", F.lit(0)).alias("from"), (F.coalesce(F.lead("cut").over(order), F.lit(0)) + chunk).alias("to"), "piece")


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (array of binaries: little-endian 32-bit ids, in order).

    Texts of at most ``chunk`` + ``overlap`` characters are a single chunk, encoded where they lie. Longer ones become
    chunks that overlap by ``overlap`` characters, dealt evenly over the tasks and pre-tokenised there; they are stitched
    where their boundaries agree, and the pieces between cuts are encoded. Chunks whose overlap has no boundary in
    common (a pre-token that is longer, or boundaries that never agree) are put together into one piece. Null texts
    have no ids. Rows with equal ids or texts stay apart; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk + overlap

    def whole(batches):
        t = byte_tokenizer(path, pattern)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[t.encode(x)] for x in b.column(1).to_pylist()], pa.list_(pa.binary()))], ["doc_id", "ids"])

    id_type = dict(docs.dtypes)["doc_id"]
    short = rows.where(~long).mapInArrow(whole, f"doc_id {id_type}, ids array<binary>")
    n = F.ceil((F.length("text") - overlap) / chunk).cast("int")
    chunks = rows.where(long).withColumn("__row", F.monotonically_increasing_id()).select("__row", "doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), "text")
    chunks = materialize(chunks.select("__row", "doc_id", "n", "k", F.expr(f"substr(text, k * {chunk} + 1, {chunk + overlap})").alias("part")).repartition("__row", "k"), "chunks")

    def pre_tokenise(batches):
        for b in sliced(batches):
            left, right, sure = [], [], []
            for part, k, last in zip(b.column("part").to_pylist(), b.column("k").to_pylist(), b.column("n").to_pylist(), strict=True):
                at = np.array(boundaries(pattern, part), dtype=np.int64)
                left.append(at[at < overlap].tolist() if k else [])
                right.append((at[at >= chunk] - chunk).tolist() if k + 1 < last else [])
                # a boundary in any text, before the right overlap begins
                sure.append(any(seam(part, i) for i in at[at < chunk].tolist()))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("k"), *(pa.array(x, t) for x, t in zip((left, right, sure), kinds, strict=True))], ["__row", "k", "lefts", "rights", "sure"])

    seen = chunks.select("__row", "n", "k", "part").mapInArrow(pre_tokenise, "__row bigint, k int, lefts array<int>, rights array<int>, sure boolean")
    own = chunks.join(_cuts(seen, chunk), ["__row", "k"])
    body = F.expr("if(k + 1 = n, substr(part, from + 1), substr(part, from + 1, to - from))")
    pieces = own.groupBy("__row", "doc_id", "piece").agg(F.sort_array(F.collect_list(F.struct("k", body.alias("text")))).alias("p"))
    pieces = pieces.select("__row", "doc_id", "piece", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))

    def by_piece(batches):
        t = byte_tokenizer(path, pattern)
        for b in sliced(batches):
            ids = [t.encode(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__row", "doc_id", "piece")), pa.array(ids, pa.binary())], ["__row", "doc_id", "piece", "ids"])

    done = pieces.mapInArrow(by_piece, f"__row bigint, doc_id {id_type}, piece bigint, ids binary")
    done = done.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    return short.unionByName(done.select("doc_id", F.transform("p", lambda x: x["ids"]).alias("ids")))


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids are decoded by joining their tokens' bytes."""

    def run(batches):
        t = byte_decoder(path)
        for b in sliced(batches):
            out = []
            for parts in b.column("ids"):
                ids = np.frombuffer(b"".join(parts.as_py()), dtype="<u4")
                text = ",".join(map(t.decimal.__getitem__, ids.tolist()))
                out.append((len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()))
            n, a, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
