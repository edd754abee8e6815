"""Embedding near-duplicates by sorted projection passes over bounded neighbour windows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ranked
from .components import connected

#: Vectors of a window; random bits of a pass's order, and fewest of them that a run shares; chance of missing a link at the threshold.
WINDOW, BITS, LEAST_BITS, MISS = 64, 30, 4, 1e-6


def schedule(size: int, threshold: float, window: int = WINDOW) -> tuple[int, int]:
    """(prefix bits, passes) for a label of ``size`` vectors.

    Vectors that agree in the first bits are always compared, so many bits that a window holds a random run; a
    link at the threshold agrees in all of them with probability (1 - angle/pi)**bits a pass.
    """
    bits = min(BITS, max(LEAST_BITS, math.ceil(math.log2(max(size, 1) / window)) + 1))
    p = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, 1 if p >= 1 else max(1, math.ceil(math.log(MISS) / math.log(1 - p)))


def _schedules(threshold: float, window: int) -> list[tuple[int, int, int]]:
    """(largest size, bits, passes): the schedule changes where the size passes a power of two times the window."""
    out = []
    for bits in range(LEAST_BITS, BITS + 1):
        out.append(((window << (bits - 1)) if bits < BITS else 1 << 62, *schedule(window << (bits - 1), threshold, window)))
    return out


def _usable(docs: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    ok &= ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return docs.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), e.alias("e")).where(F.coalesce(ok, F.lit(False)))


def _signatures(rows: DataFrame, threshold: float, window: int, seed: int, single: bool) -> DataFrame:
    """id, label, dim, bits, vec (the components as they came), key (128 bits of label and direction), sigs (the order of each
    pass): BITS random signs, high bits first, for as many passes as the label's ``size`` asks for."""
    plan = _schedules(threshold, window)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            out = []
            for i, label, x, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = x.values.to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
                v = unit(raw[None, :])[0]
                if (p := planes.get(len(v))) is None:
                    p = planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((plan[-1][2], BITS, len(v)))
                _, bits, passes = next(s for s in plan if size <= s[0])
                out.append((i, label, len(v), bits, raw.tobytes(), hashlib.blake2b(v.tobytes() + label.encode(), digest_size=16).digest(), ((p[:passes] @ v > 0) @ weights).tolist()))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "label", "dim", "bits", "vec", "key", "sigs"])

    return rows.select("id", "label", "e", "size").mapInArrow(run, "id bigint, label string, dim int, bits int, vec binary, key binary, sigs array<bigint>")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, also of very small and very large vectors."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """The least member of each member's component in a symmetric boolean matrix."""
    root = np.arange(len(adjacent))
    reach = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(reach, root[None, :], len(root)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(docs: DataFrame, threshold: float = 0.98, window: int = WINDOW, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, members, classes): found has, from each comparison of windows, a node (the representative of a class), the
    number n of vectors newly linked with it and a link (node, other) of a forest that spans what the windows link; members has
    id and key of each usable vector; classes has key, rep (the least id) and size of each class.

    Vectors of one label with equal directions are a class, of which only the representative is compared.

    In each pass the vectors of a label lie in the order of their random sign bits and are cut into windows of
    ``window``; a window is compared with itself and the next one, and with every later window that a run of
    equal leading bits reaches, so long runs are compared whole, block by block. A link counts in the first
    pass that brings its ends together, which the two rows' places tell. The number of bits and passes follows from the
    label's size.
    """
    rows = _usable(docs).dropDuplicates(["id"])
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    single = docs.schema["embedding"].dataType.elementType.simpleString() == "float"
    signed = materialize(_signatures(rows.join(sizes, "label"), threshold, window, seed, single), "signatures")
    classes = materialize(signed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "vector-classes")
    vecs = materialize(signed.join(classes.select(F.col("rep").alias("id"), "size"), "id").drop("key"), "class-signatures")
    flat = vecs.select("id", "label", "dim", "bits", F.posexplode("sigs").alias("pass", "sig"))
    groups = ["pass", "label", "dim"]
    # order-preserving pieces: the leading bits of the order
    sub = F.expr(f"shiftright(sig, {BITS} - least({BITS}, bits + 4))")
    placed = ranked(flat, groups, sub, ["sig", "id"], "rank").withColumn("block", F.expr(f"cast(rank div {window} as int)"))
    placed = materialize(placed.withColumn("prefix", F.expr(f"shiftright(sig, {BITS} - bits)")).select(*groups, "id", "block", "prefix"), "places")
    places = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pass", "block", "prefix"))).alias("p"))
    places = places.select("id", F.transform("p", lambda x: x["block"]).alias("blocks"), F.transform("p", lambda x: x["prefix"].cast("int")).alias("prefixes"))
    full = materialize(vecs.select("id", "vec", "size").join(places, "id"), "placed-vectors")
    # windows that a run of equal leading bits spans: the first block of each run
    runs = placed.groupBy(*groups, "prefix").agg(F.min("block").alias("run_from"))
    spans = placed.join(runs, [*groups, "prefix"]).groupBy(*groups, "block").agg(F.min("run_from").alias("first"))
    home = placed.select(*groups, "id", "block").join(spans, [*groups, "block"])
    home = home.withColumn("i", F.explode(F.sequence(F.least("first", F.greatest(F.col("block") - 1, F.lit(0))), F.col("block"))))
    # a window with itself and the next one is one group; further windows of a run one each
    home = home.withColumn("j", F.when(F.col("block") <= F.col("i") + 1, -1).otherwise(F.col("block")))
    far = home.where("j >= 0").select(*groups, "i", "j").distinct()
    again = home.where("block = i").drop("j").join(far, [*groups, "i"])
    cols = [*groups, "i", "j", "block", "id"]
    todo = home.select(*cols).union(again.select(*cols)).join(full, "id")
    kind = np.float32 if single else np.float64

    def run(pdf):
        import pandas as pd

        at, i, far_one = int(pdf["pass"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]) >= 0
        u = unit(np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), -1))
        ids, block, size = pdf["id"].to_numpy(), pdf["block"].to_numpy(), pdf["size"].to_numpy()
        where, prefix = np.array(pdf["blocks"].tolist()), np.array(pdf["prefixes"].tolist())
        left = np.flatnonzero(block == i)
        hit = u[left] @ u.T >= threshold - 1e-12
        hit &= (block[None, :] != i) if far_one else (block[None, :] > i) | (ids[None, :] > ids[left][:, None])
        x, y = np.nonzero(hit)
        x = left[x]
        if far_one:  # only what the run holds
            ok = prefix[x, at] == prefix[y, at]
            x, y = x[ok], y[ok]
        exact = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
        before = ((np.abs(where[x, :at] - where[y, :at]) <= 1) | (prefix[x, :at] == prefix[y, :at])).any(axis=1) if at else np.zeros(len(x), bool)
        x, y = x[exact & ~before], y[exact & ~before]
        n = np.bincount(x, size[y], len(ids)) + np.bincount(y, size[x], len(ids))
        adjacent = np.zeros((len(ids), len(ids)), dtype=bool)
        adjacent[x, y] = adjacent[y, x] = True
        own = np.flatnonzero(n)
        return pd.DataFrame({"node": ids[own], "n": n[own].astype(np.int64), "other": ids[_forest(adjacent)[own]]})

    found = materialize(todo.groupBy(*groups, "i", "j").applyInPandas(run, "node bigint, n bigint, other bigint"), "vector-links")
    discard(vecs, placed, full)
    return found, signed.select("id", "key"), classes


def near_duplicates(docs: DataFrame, threshold: float = 0.98, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept for each distinct vec_id of ``docs`` (vec_id, embedding, label).

    Vectors that are null, empty, zero, or hold a null or non-finite component, and those with a null label or
    id, have no links. Vectors of different lengths aren't compared. Rows that repeat a vec_id are one vector
    (one of them is used); a null vec_id is a row of its own with nulls. Other columns are ignored; an empty table gives no rows.
    """
    found, members, classes = links(docs, threshold, window)
    degree = found.groupBy("node").agg(F.sum("n").alias("n"))
    found = connected(found, "node", "other").join(degree, "node", "left")
    info = classes.join(found, F.col("rep") == F.col("node"), "left")
    info = info.select("key", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    own = members.join(info, "key").select("id", "n", "component")
    ids = docs.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = ids.join(own, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
