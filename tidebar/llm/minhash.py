"""HyperMinHash near-duplicates: compressed registers, banding, corrected estimates, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, discard, materialize
from .components import connected

#: Buckets, registers of a band, mantissa bits of a register. 40 bands of 5 miss a pair at similarity 0.8 with probability 1.3e-7.
BUCKETS, BAND, MANTISSA = 200, 5, 9
#: Sets smaller than this aren't judged by estimate; larger ones are verified if the estimate is within MARGIN below the threshold (over six deviations).
MIN_ESTIMATED, MARGIN = 64, 0.25
#: Members up to which an open bucket's pairs become rows, bytes of sets and registers in a block of a family, followers of a hub in one task.
SMALL, BLOCK_BYTES, FOLLOWERS = 8, 4 << 20, 2048
#: Hub rounds go on while a round links more than this share of the pairs that it tries.
PROGRESS = 0.02
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


#: The place of each bucket in the order in which an empty bucket looks for a filled one.
_TURN = np.random.default_rng(11).permuted(np.tile(np.arange(BUCKETS, dtype=np.int16), (BUCKETS, 1)), axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's k-word shingles; A-Z in lower case. With fewer words, their whole sequence is the one shingle."""
    import xxhash

    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(w))
    if not n:
        return w
    size = len(w) - n + 1
    h = np.full(size, n, dtype=np.uint64)
    for i in range(n):
        h = _mix(h * _MIX[0] + w[i : i + size])
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """BUCKETS 16-bit registers of a sorted set: the leading-zero count and MANTISSA bits of the least value in each bucket.

    An empty bucket takes the register of the filled bucket that comes first in an order of its own, so the
    registers of a small set are drawn independently and agree with those of another with the sets' similarity.
    """
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = np.minimum.reduceat(_mix(hashes * _MIX[3] + np.uint64(1)), first)
    # a double's exponent and leading mantissa bits are the position of the leading one and the bits after it
    short = (low.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)).astype(np.int64)
    short = (short & ((1 << MANTISSA) - 1)) | (((1023 + 64 - (short >> MANTISSA)) & 0x7F) << MANTISSA)
    out = np.full(BUCKETS, -1, dtype=np.int64)
    out[bucket[first].astype(np.int64)] = short
    empty = np.flatnonzero(out < 0)
    if len(empty):
        filled = np.flatnonzero(out >= 0)
        out[empty] = out[filled[_TURN[empty[:, None], filled].argmin(axis=1)]]
    return out.astype(np.uint16)


def collision_rate() -> float:
    """The chance that registers of unrelated sets agree: leading-zero counts agree in a third of cases, mantissas in 2**-MANTISSA."""
    return 2.0**-MANTISSA / 3


def estimate(matches: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance collisions."""
    c = collision_rate()
    return (matches / BUCKETS - c) / (1 - c)


def set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and two 64-bit keys of the text, which find a row's text again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tk"))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th, tk, n_shingles, set_key (128-bit key of the set) and regs of each row; the last two are null for empty sets."""

    def run(batches):
        for b in batches:
            n, keys, regs = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "th", "tk")), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "th", "tk", "n_shingles", "set_key", "regs"])

    return _identified(docs).mapInArrow(run, "doc_id bigint, th bigint, tk bigint, n_shingles bigint, set_key binary, regs binary")


def _candidates(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """cid, n, regs, s (the whole set) of the classes in ``ids``, from the texts of their first rows; a cid may come more than once."""
    want = classes.join(ids, "cid", "left_semi").select("cid", "set_key", "regs", *(F.col(c).alias(f"__{c}") for c in ("doc_id", "th", "tk")))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("th") == F.col("__th")) & (F.col("tk") == F.col("__tk"))
    own = _identified(docs).join(want, same).select("cid", "set_key", "regs", "text")

    def build(batches):
        seen: set[int] = set()
        for b in batches:
            rows = []
            for cid, key, regs, text in zip(*(b.column(c) for c in ("cid", "set_key", "regs", "text")), strict=True):
                cid = cid.as_py()
                if cid not in seen:
                    s = shingle_set(text.as_py(), k)
                    if set_key(s) == key.as_py():
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(cid)
                        rows.append((cid, len(s), regs.as_py(), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cid", "n", "regs", "s"])

    return own.mapInArrow(build, "cid bigint, n bigint, regs binary, s binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted whole sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) * 100 < percent * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _likely(rx: np.ndarray, ry: np.ndarray, nx, ny, percent: int) -> np.ndarray:
    """Which rows of ry the sizes and corrected estimates allow to be linked with rx."""
    ok = (nx * 100 >= percent * ny) & (ny * 100 >= percent * nx)
    return ok & ((estimate((ry == rx).sum(axis=-1)) >= percent / 100 - MARGIN) | (np.minimum(nx, ny) < MIN_ESTIMATED))


def verify(pairs: DataFrame, cands: DataFrame, percent: int) -> DataFrame:
    """ca, cb of the pairs (a, b, ca, cb) that an estimate allows and whole sets confirm.

    The pairs lie sorted by a (a hub with many followers is dealt over several tasks), so a's set is sent once
    for FOLLOWERS of them, and b's once a pair.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    many = parts.where("parts > 1").withColumnRenamed("a", "__a")
    rows = pairs.join(many, F.col("a") == F.col("__a"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int"))
    cols = ["a", "part", "b", "ca", "cb", "n", "regs", "s"]
    none = [F.lit(None).cast("bigint").alias(c) for c in ("b", "ca", "cb")]
    need = hubs.select(F.col("a").alias("cid"), "a", "part", *none).union(rows.select(F.col("b").alias("cid"), "a", "part", "b", "ca", "cb"))
    dealt = need.join(cands, "cid").select(*cols).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches):
        hub, n, regs, s = None, 0, None, None
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c) for c in cols), strict=True):
                a, _, b, ca, cb, m = (x.as_py() for x in r[:6])
                if b is None:
                    hub, n, regs, s = a, m, np.frombuffer(r[6].as_py(), np.uint16), np.frombuffer(r[7].as_py(), np.uint64)
                elif a == hub and _likely(regs, np.frombuffer(r[6].as_py(), np.uint16), n, m, percent) and linked(s, np.frombuffer(r[7].as_py(), np.uint64), percent):
                    out.append((ca, cb))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["ca", "cb"])

    return dealt.mapInArrow(run, "ca bigint, cb bigint").distinct()


def _hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """a, b, ca, cb: each member b of a bucket with several components against the bucket's hub a, the member first in the turn's order."""
    rank = F.xxhash64("cid", F.lit(turn))
    hubs = members.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "cid", "comp")).alias("hub"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1")
    hubs = hubs.select(F.col("key").alias("__key"), F.col("hub.cid").alias("a"), F.col("hub.comp").alias("ca"))
    pairs = members.join(hubs, F.col("key") == F.col("__key")).where("comp != ca").select("a", F.col("cid").alias("b"), "ca", F.col("comp").alias("cb"))
    if turn:
        return pairs.distinct()
    # at first, only the hub that comes first in the order: most copies of a group share it
    best = pairs.groupBy("b", "cb").agg(F.min(F.struct(F.xxhash64("a", F.lit(turn)).alias("r"), "a", "ca")).alias("x"))
    return best.select("x.a", "b", "x.ca", "cb")


def _relabelled(members: DataFrame, new: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components, after the components ``new`` of components."""
    m = members.join(new, F.col("comp") == F.col("node"), "left").select("key", "cid", F.coalesce("component", "comp").alias("comp"))
    m = materialize(m, "relabelled")
    still = m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key")
    out = materialize(m.join(still, "key"), "open-buckets")
    discard(m, members)
    return out


def _small_pairs(members: DataFrame) -> DataFrame:
    """Every pair of different components in the buckets of at most SMALL members, once."""
    few = members.groupBy("key").agg(F.collect_list(F.struct("cid", "comp")).alias("m"))
    x = few.select("m", F.explode("m").alias("x"))
    others = F.filter("m", lambda y: (y["cid"] < F.col("x.cid")) & (y["comp"] != F.col("x.comp")))
    return x.select("x", F.explode(others).alias("y")).select(F.col("y.cid").alias("a"), F.col("x.cid").alias("b"), F.col("y.comp").alias("ca"), F.col("x.comp").alias("cb")).distinct()


def _family_links(members: DataFrame, cands: DataFrame, percent: int) -> DataFrame:
    """Links (ca, cb) between components that meet in larger buckets, found and confirmed block against block.

    Buckets that share members are a family. Its largest component is held against the others only, and these
    against each other, in blocks of about BLOCK_BYTES; a task compares members that share a band and skips pairs
    that it has connected already, so it returns fewer links than it has members.
    """
    low = members.groupBy("key").agg(F.min("cid").alias("first"))
    family = connected(members.join(low, "key").select(F.col("cid").alias("a"), F.col("first").alias("b")))
    own = members.select("cid", "comp").distinct().join(family, F.col("cid") == F.col("node")).select(F.col("component").alias("family"), "cid", "comp")
    own = own.join(cands.select("cid", "n").distinct(), "cid").withColumn("w", F.lit(500) + 8 * F.col("n"))
    own = materialize(own, "families")
    discard(family)
    parts = own.groupBy("family", "comp").agg(F.sum("w").alias("w"))
    parts = parts.groupBy("family").agg(F.max_by("comp", F.struct("w", "comp")).alias("main"), F.max("w").alias("most"), F.sum("w").alias("all"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / BLOCK_BYTES)).cast("int")
    parts = parts.select(F.col("family").alias("__f"), "main", blocks(F.col("most")).alias("ng"), blocks(F.col("all") - F.col("most")).alias("no"))
    rows = own.join(parts, F.col("family") == F.col("__f")).withColumn("in_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cid"), F.when(F.col("in_main"), F.col("ng")).otherwise(F.col("no"))).cast("int"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    blk = F.col("blk")
    tasks = F.when(F.col("in_main"), F.transform(to("no"), lambda o: task(0, blk, o))).otherwise(
        F.concat(F.transform(to("ng"), lambda g: task(0, g, blk)), F.transform(to("no"), lambda o: task(1, F.least(o, blk), F.greatest(o, blk))))
    )
    rows = rows.select("family", "cid", "comp", "in_main", "blk", F.explode(tasks).alias("t")).select("family", "cid", "comp", "in_main", "blk", "t.*")
    rows = rows.join(cands, "cid")

    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("cid")
        kind, i, j = (int(pdf[c].iloc[0]) for c in ("kind", "i", "j"))
        regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(pdf), BUCKETS)
        comp, n, blk, in_main = (pdf[c].to_numpy() for c in ("comp", "n", "blk", "in_main"))
        sets = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
        # a number for each band's registers; two that agree by chance only cost an estimate
        bands = (regs.reshape(len(pdf), -1, BAND).astype(np.uint64) * (_MIX[0] ** np.arange(1, BAND + 1, dtype=np.uint64))).sum(axis=2)
        if kind == 0:
            left, right = np.flatnonzero(~in_main), np.flatnonzero(in_main)
        elif i != j:
            left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        else:
            left = right = np.arange(len(pdf))
        root, out = {int(c): int(c) for c in comp}, []

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for x in left.tolist():
            ys = right[right > x] if kind and i == j else right
            if not len(ys):
                continue
            ys = ys[(comp[ys] != comp[x]) & (bands[ys] == bands[x]).any(axis=1)]
            ys = ys[_likely(regs[x], regs[ys], n[x], n[ys], percent)]
            for y in ys.tolist():
                cx, cy = find(int(comp[x])), find(int(comp[y]))
                if cx != cy and linked(sets[x], sets[y], percent):
                    root[max(cx, cy)] = min(cx, cy)
                    out.append((int(comp[x]), int(comp[y])))
        return pd.DataFrame(out, columns=["ca", "cb"], dtype="int64")

    found = materialize(rows.groupBy("family", "kind", "i", "j").applyInPandas(run, "ca bigint, cb bigint").distinct(), "links")
    discard(own)
    return found


def labelled(rows: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """``rows`` with comp (at first its cid) led through the components of components in ``maps``."""
    for m in maps:
        rows = rows.join(m, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component")
    return rows


def set_links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(maps, links): components of components, to be applied one after the other, and links (ca, cb) between the last ones, that
    connect all classes (cid, set_key, regs, doc_id, th, tk) with linked sets.

    Classes that share a band's registers are a bucket. In each round, members of buckets with several components
    are held against one hub a bucket, in another order each time, and what is linked becomes one component; large
    groups of copies are joined by a few comparisons a member. When rounds find little more, every pair of different
    components that a bucket holds is compared, so no link that banding finds is missed.
    """
    width = 2 * BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // BAND - 1)), lambda b: F.xxhash64(b, F.substring("regs", b * width + 1, F.lit(width))))
    members = classes.select("cid", F.explode(keys).alias("key"))
    shared = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
    members = materialize(members.join(shared, "key").select("key", "cid", F.col("cid").alias("comp")), "bucket-members")
    discard(shared)
    cands = materialize(_candidates(docs, classes, members.select("cid").distinct(), k), "candidates")
    maps, found, turn = [], [], 0
    while True:
        pairs = materialize(_hub_pairs(members, turn), "hub-pairs")
        links = materialize(verify(pairs, cands, percent), "links")
        n, tried, turn = links.count(), pairs.count(), turn + 1
        if n:
            maps.append(connected(links, "ca", "cb"))
            members = _relabelled(members, maps[-1])
        discard(pairs, links)
        if n <= PROGRESS * tried:
            break
        if turn == 1:  # most candidates are settled by now
            still = materialize(cands.join(members.select("cid").distinct(), "cid", "left_semi"), "candidates")
            discard(cands)
            cands = still
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1")
    rest = materialize(members.join(size.select("key", "size"), "key"), "open-buckets")
    discard(members)
    pairs = materialize(_small_pairs(rest.where(F.col("size") <= SMALL).select("key", "cid", "comp")), "small-pairs")
    found.append(materialize(verify(pairs, cands, percent), "links"))
    large = rest.where(F.col("size") > SMALL).select("key", "cid", "comp")
    if not large.isEmpty():
        found.append(_family_links(large, cands, percent))
    discard(rest, pairs, cands)
    return maps, found


def _sketched(docs: DataFrame, k: int, used: Column) -> tuple[DataFrame, DataFrame]:
    """The sketches without their registers; and cid, set_key, regs and the first row (doc_id, th, tk; null ids last)
    of each class of equal sets among the ``used`` rows."""
    whole = materialize(sketches(docs, k), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "tk")).alias("x")
    c = whole.where(used & F.col("set_key").isNotNull()).groupBy("set_key").agg(first, F.first("regs").alias("regs"))
    classes = materialize(c.select(F.monotonically_increasing_id().alias("cid"), "set_key", "regs", "x.doc_id", "x.th", "x.tk"), "set-classes")
    rows = materialize(whole.drop("regs"), "sketched-rows")
    discard(whole)
    return rows, classes


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Equal sets (by a 128-bit key) are one class, and classes are linked by set_links. Sets are of 64-bit hashes of
    shingles: for two sets of together n shingles some two collide with a chance of n**2 / 2**65, 1e-11 for 20,000.
    Rows without words or text are linked with nothing and are kept. Rows with one
    doc_id are one document: their links are pooled. A null doc_id has a null component and is kept. Other columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    sketch, classes = _sketched(docs, k, F.col("doc_id").isNotNull())
    maps, found = set_links(docs, classes, k, percent)
    own = sketch.where("doc_id is not null").join(classes.select("set_key", F.col("cid").alias("comp")), "set_key").select("doc_id", "comp")
    own = materialize(labelled(own, maps).distinct(), "documents-of-components")
    # a document of several rows connects their components
    several = own.groupBy("doc_id").agg(F.min("comp").alias("ca"), F.max("comp").alias("cb")).where("ca != cb")
    edges = own.join(several.select("doc_id", "ca"), "doc_id").select("ca", F.col("comp").alias("cb"))
    for links in found:
        edges = edges.union(links.select("ca", "cb"))
    last = connected(edges, "ca", "cb")
    groups = labelled(own, [last])
    low = groups.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    low = materialize(groups.join(low, "comp").select(F.col("doc_id").alias("__d"), "component_id").distinct(), "component-ids")
    out = sketch.select("doc_id", "n_shingles").join(low, F.col("doc_id") == F.col("__d"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates")
    discard(sketch, classes, own, low, last, *maps, *found)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates, all columns.

    Each row is a document of its own, whatever its doc_id: of rows that repeat, and of copies without an id,
    one stays, and a unique text isn't dropped for another row of its doc_id. The row of the least doc_id stays
    (null last, then by keys of the text). Rows without words or text are all kept.
    """
    sketch, classes = _sketched(docs, k, F.lit(True))
    maps, found = set_links(docs, classes, k, percent)
    edges = found[0]
    for links in found[1:]:
        edges = edges.union(links)
    maps.append(connected(edges, "ca", "cb"))
    first = labelled(classes.select("doc_id", "th", "tk", F.col("cid").alias("comp")), maps).groupBy("comp")
    first = first.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "tk")).alias("x")).select(*(F.col(f"x.{c}").alias(f"__{c}") for c in ("doc_id", "th", "tk")))
    same = lambda d: d["doc_id"].cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(d["text"]) == F.col("__th")) & (F.xxhash64(F.lit(1), d["text"]) == F.col("__tk"))
    rows = sketch.where("set_key is not null").groupBy("doc_id", "th", "tk").agg(F.count(F.lit(1)).alias("__n"))
    stay = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("th") == F.col("__th")) & (F.col("tk") == F.col("__tk"))
    first = materialize(first.join(rows, stay).select("__doc_id", "__th", "__tk", "__n"), "kept-rows")
    discard(sketch, classes, *maps, *found)
    out = docs.join(first.where("__n = 1"), same(docs), "left").where(F.col("__th").isNotNull() | ~F.coalesce(docs["text"].rlike(WORD_CLASS), F.lit(False))).select(*(docs[c] for c in docs.columns))
    again = first.where("__n > 1")
    if again.isEmpty():
        return out
    twice = docs.join(again, same(docs), "left_semi").withColumns({"__th": F.xxhash64("text"), "__tk": F.xxhash64(F.lit(1), "text")})
    return out.union(twice.dropDuplicates(["doc_id", "__th", "__tk"]).select(*docs.columns))
