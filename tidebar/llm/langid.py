"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in numpy as sparse counts times log-probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Buckets of hashed n-grams (a power of two), longest n-gram, smoothing, and characters handled at once.
BUCKETS, N_MAX, SMOOTH, CHUNK = 1 << 15, 3, 0.5, 1 << 19
#: Rows learned from in each language at most, and languages at most, the most frequent ones (documented bounds). So the model has
#: at most MAX_LANGS x BUCKETS numbers, 131 MB.
MAX_ROWS_PER_LANG, MAX_LANGS = 20_000, 500
UNKNOWN = "und"
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _pieces(texts: list[str], size: int = CHUNK) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(documents, first symbols, code points) of chunks of about ``size`` characters; a long text runs over several chunks.

    Each text is lower-cased and framed by spaces; a piece is followed by the two symbols its last n-grams reach into.
    """
    docs, parts, starts, total = [], [], [], 0
    for d, text in enumerate(texts):
        framed = f" {text.lower()} "
        for at in range(0, len(framed), size):
            piece = framed[at : at + size + N_MAX - 1]
            piece += " " * (N_MAX - 1 - max(0, len(piece) - size) if len(piece) > size else N_MAX - 1)
            docs.append(d)
            starts.append(total)
            parts.append(piece)
            total += len(piece)
            if total >= size:
                yield docs, np.array(starts), _codes(parts)
                docs, parts, starts, total = [], [], [], 0
    if docs:
        yield docs, np.array(starts), _codes(parts)


def _codes(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of the n-gram that starts at each symbol, for n = 1 to N_MAX; the last n-1 wrap around and count nowhere."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    h = np.zeros_like(codes)
    with np.errstate(over="ignore"):
        for n in range(N_MAX):
            h = (h + np.roll(codes, -n) + np.uint64(n + 1)) * _MULT[n]
            h ^= h >> np.uint64(29)
            yield ((h * _MULT[0]) >> shift).astype(np.int64)


def _body(starts: np.ndarray, size: int) -> np.ndarray:
    """1 for symbols of the pieces, 0 for the N_MAX-1 that follow each."""
    mask = np.ones(size, dtype=bool)
    ends = np.append(starts[1:], size)
    for k in range(1, N_MAX):
        mask[ends - k] = False
    return mask


def _sparse(starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of n-grams of a batch of pieces as a sparse matrix by rows: (where each piece's entries begin, their buckets,
    their counts). A piece has at least one symbol of its own, so no row is empty."""
    body = _body(starts, len(codes))
    piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))[body] * BUCKETS
    entries, n = np.unique(np.concatenate([piece + h[body] for h in _hashes(codes)]), return_counts=True)
    return np.searchsorted(entries, np.arange(len(starts)) * BUCKETS), entries % BUCKETS, n


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS_PER_LANG) -> dict:
    """{"langs": sorted names, "logp": float64 [BUCKETS, langs], "prior": [langs]}, learned from rows with text and lang.

    Of a language with more than ``max_rows`` rows, an even share chosen by the hash of id and text is used, and of more
    than MAX_LANGS languages the most frequent: bounded samples. Tasks add up counts in numpy and send the nonzero ones;
    the result is langs x BUCKETS numbers.
    """
    by = F.xxhash64(*dict.fromkeys([*(["doc_id"] if "doc_id" in docs.columns else []), text]))
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), by.alias("by")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "logp": np.zeros((BUCKETS, 0)), "prior": np.zeros(0)}
    share = F.create_map(*(x for name in langs for x in (F.lit(name), F.lit(int(2**31 * min(1.0, max_rows / sizes[name]))))))
    rows = rows.where(F.pmod("by", F.lit(2**31)) < F.try_element_at(share, F.col("lang"))).select("text", "lang")

    def count(batches):
        index = {name: i for i, name in enumerate(langs)}
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for b in batches:
            by: dict[int, list[str]] = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(index[name], []).append(t)
            for i, texts in by.items():
                for _, starts, codes in _pieces(texts):
                    body = _body(starts, len(codes))
                    for h in _hashes(codes):
                        total[i] += np.bincount(h[body], minlength=BUCKETS)
        i, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(total[i, k], pa.int64())], ["l", "k", "n"])

    counts = rows.mapInArrow(count, "l int, k int, n bigint").groupBy("l", "k").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(langs), BUCKETS))
    table[counts["l"], counts["k"]] = counts["n"]
    logp = np.log(table + SMOOTH) - np.log(table.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    prior = np.log(np.array([sizes[x] for x in langs], dtype=float) / sum(sizes.values()))
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T), "prior": prior}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of the predicted language, 0 to 1).

    A batch of texts becomes a sparse matrix of counts, one entry for each text and bucket that occurs in it, which is
    multiplied with the broadcast log-probabilities. Only the text is used. ``und`` with score 0 for a null text, one without a letter, or a model without
    languages. Ties go to the first name. Existing columns lang_pred and score are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast((model["langs"], model["logp"], model["prior"]))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = docs.columns.index(text)

    def run(batches):
        import regex

        langs, logp, prior = shared.value
        letter = regex.compile(r"\p{L}")
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if langs and t is not None and letter.search(t)]
            total = np.tile(prior, (len(texts), 1)) if langs else np.zeros((len(texts), 1))
            for own, starts, codes in _pieces([texts[i] for i in known], max(1 << 13, CHUNK * 8 // max(8, N_MAX * len(langs)))):
                first, bucket, n = _sparse(starts, codes)
                np.add.at(total, np.array(known)[own], np.add.reduceat(logp[bucket] * n[:, None], first, axis=0))
            best = total.argmax(axis=1)
            post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            ok = np.zeros(len(texts), dtype=bool)
            ok[known] = True
            names = [langs[k] if o else UNKNOWN for k, o in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.where(ok, post, 0.0))], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def evaluate(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that aren't held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.where("not held_out"))
    return predict(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")

