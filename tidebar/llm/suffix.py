"""Removal of repeated byte strings by column-wise construction of a Burrows-Wheeler order.

Every window of ``length`` bytes is represented by its anchor, the ``gram`` bytes in it with the least
hash; equal windows have equal anchors at equal places. Anchors that occur once end here. The surroundings
of the others form, for each anchor, a collection of short strings aligned at it. One symbol of each string
is inserted a round, from the right: the round's symbols in the order so far are the layer's Burrows-Wheeler
transform, a stable sort of them gives the next order, and the common prefixes of neighbours are carried
along. A window is repeated if a neighbour's common prefix reaches its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

LENGTH, GRAM = 200, 32
#: Bytes handled at once, strings of one anchor compared in one task, strings inserted together, neighbouring windows looked up by
#: the bytes they share, and blocks of an anchor for each part into which its windows are dealt.
PART, BLOCK, TOGETHER, NEAR, DEAL = 1 << 21, 512, 16_384, 16, 64
_POS_BITS = 22
_END = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of the anchors of at most PART bytes."""
    h, span = _mix(data.astype(np.uint64) + np.uint64(1)), 1
    while span < gram:  # the hash of a gram from those of its halves
        h, span = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + h[span:], 2 * span
    h = _mix(h)
    low = (h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | np.arange(len(h), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    p = place[first]
    return h[p].view(np.int64), p, first, last


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of all anchors; a long text is handled in overlapping parts."""
    a, found = np.frombuffer(data, np.uint8), []
    for at in range(0, max(0, len(a) - length + 1), PART):
        h, p, lo, hi = _anchors(a[at : at + PART + length - 1], length, gram)
        found.append((h, p + at, lo + at, hi + at))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_windows(strings: list[bytes], at: np.ndarray, group: np.ndarray, n_windows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, leading), boolean [strings, windows]: whether a string of its group has the window too, and
    whether it is the first of its class. strings[i] has its anchor at at[i] and n_windows[i] windows from its start."""
    n, reach, width = len(strings), length, length - gram + 1
    size = np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    start = np.cumsum(size) - size
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, dtype=np.int32)  # with the one before; the last entry stays 0
    repeated = np.zeros((n, width), dtype=bool)
    leading = np.zeros((n, width), dtype=bool)
    for column in range(reach - 1, -width, -1):
        i = at + column
        inside = (i >= 0) & (i < size)
        symbol = np.full(n, _END, dtype=np.int64)
        symbol[inside] = flat[(start + i)[inside]]
        layer = symbol[order]  # the collection's Burrows-Wheeler transform at this round
        key = group[order] * (_END + 1) + layer
        move = np.argsort(key, kind="stable")
        same = key[move[1:]] == key[move[:-1]]
        same &= layer[move[1:]] != _END
        new = np.zeros(n + 1, dtype=np.int32)
        to = np.flatnonzero(same) + 1
        lo, hi = move[to - 1] + 1, move[to]
        value = common[hi]
        wide = np.flatnonzero(hi > lo)
        if len(wide):
            value[wide] = np.minimum.reduceat(common, np.stack([lo[wide], hi[wide] + 1], axis=1).ravel())[::2]
        new[to] = value + 1
        order, common = order[move], new
        if column <= 0:
            w = i[order]
            valid = (w >= 0) & (w < n_windows[order])
            before = common[:-1] >= length
            rows = order[valid]
            repeated[rows, w[valid]] = (before | (common[1:] >= length))[valid]
            leading[rows, w[valid]] = ~before[valid]
    return repeated, leading


def _contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, th, lo, hi, at, kh, ctx (128-bit key of the surroundings), bytes of every anchor that occurs more than once.

    bytes is null where the same task has given the same surroundings before.
    """
    id_type = dict(rows.dtypes)["doc_id"]

    def find(batches):
        for b in batches:
            for k, text in enumerate(b.column("text").to_pylist()):
                h, p, lo, hi = anchors(text.encode("utf-8", "surrogatepass"), length, gram)
                if len(h):
                    ids = b.column("doc_id").take(pa.array(np.full(len(h), k, np.int32)))
                    th = b.column("th").take(pa.array(np.full(len(h), k, np.int32)))
                    yield pa.RecordBatch.from_arrays([ids, th, pa.array(h), *(pa.array(x.astype(np.int32)) for x in (p, lo, hi))], ["doc_id", "th", "kh", "p", "lo", "hi"])

    found = materialize(rows.mapInArrow(lambda it: _merged(find(it)), f"doc_id {id_type}, th bigint, kh bigint, p int, lo int, hi int"), "anchors")
    # written, so that both sides of the join are plain shuffles and a hot anchor is split over tasks
    again = materialize(found.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh"), "anchors-again")
    spots = found.join(again, "kh").groupBy("doc_id", "th").agg(F.collect_set(F.struct("p", "lo", "hi", "kh")).alias("spots"))
    spots = spots.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spots")
    own = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t"))).select("doc_id", "th", "text", "spots")

    def cut(batches):
        seen: set[bytes] = set()
        for b in batches:
            who, cols = [], [[] for _ in range(6)]
            for k, (text, spots) in enumerate(zip(b.column("text"), b.column("spots"), strict=True)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                v = spots.values
                for p, lo, hi, kh in sorted(zip(*(v.field(c).to_pylist() for c in range(4)), strict=True)):
                    s = data[lo : hi + length]
                    ctx = hashlib.blake2b(s, digest_size=16, key=(p - lo).to_bytes(4, "little")).digest()
                    if len(seen) > 300_000:
                        seen.clear()
                    new = ctx not in seen
                    seen.add(ctx)
                    who.append(k)
                    for c, x in zip(cols, (lo, hi, p - lo, kh, ctx, s if new else None), strict=True):
                        c.append(x)
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            take = pa.array(who, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "th", "lo", "hi", "at", "kh", "ctx", "bytes"])

    out = materialize(own.mapInArrow(cut, f"doc_id {id_type}, th bigint, lo bigint, hi bigint, at bigint, kh bigint, ctx binary, bytes binary"), "contexts")
    discard(found, again)
    return out


def _merged(batches, rows: int = 50_000):
    """Small batches put together, so that each carries about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _compare(strings: DataFrame, length: int, gram: int) -> DataFrame:
    """strings: kh, block, blocks, ctx, at, hi - lo + 1 as n, bytes. Rows: ctx and bits (its repeated windows), and for anchors
    of several blocks kh, near, core (a key of the bytes that up to NEAR neighbouring windows share), part (dealt by the
    windows' keys where there are very many blocks) and their classes in the block: place, wh (128-bit key), ctx and w
    (the window) if it is alone there. Equal windows have equal cores and parts."""
    kind = pa.struct([("place", pa.int32()), ("wh", pa.binary()), ("ctx", pa.binary()), ("w", pa.int32())])
    schema = pa.schema([("ctx", pa.binary()), ("bits", pa.binary()), ("kh", pa.int64()), ("near", pa.int32()), ("core", pa.binary()), ("part", pa.int32()), ("classes", pa.list_(kind))])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("kh", "block", "blocks", "ctx", "at", "n", "bytes")), strict=True):
                if len(held) >= TOGETHER and (r[0], r[1]) != held[-1][:2]:
                    yield from work(held)
                    held = []
                held.append(r)
        if held:
            yield from work(held)

    def work(held: list[tuple]):
        rows = list({(r[0], r[3]): r for r in held}.values())
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault(r[:2], len(names)) for r in rows])
        sizes = np.bincount(group)
        use = [i for i, r in enumerate(rows) if sizes[group[i]] > 1 or r[2] > 1]
        if not use:
            return
        rows, group = [rows[i] for i in use], group[use]
        at, n = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        repeated, leading = repeated_windows([r[6] for r in rows], at, group, n, length, gram)
        hit = np.flatnonzero(repeated.any(axis=1)).tolist()
        out: list[tuple] = [(rows[i][3], np.packbits(repeated[i]).tobytes(), None, None, None, None, None) for i in hit]
        cores: dict[tuple, list[dict]] = {}
        key = lambda b: hashlib.blake2b(b, digest_size=16).digest()
        for i, r in enumerate(rows):
            if r[2] > 1:
                for w in np.flatnonzero(leading[i]).tolist():
                    alone, place = not repeated[i, w], w - r[4]
                    near = place // NEAR
                    core = r[6][r[4] + near * NEAR + NEAR - 1 : r[4] + near * NEAR + length]
                    wh = key(r[6][w : w + length])
                    part = int.from_bytes(wh[:4], "little") % -(-r[2] // DEAL)
                    cores.setdefault((r[0], r[1], near, core, part), []).append({"place": place, "wh": wh, "ctx": r[3] if alone else None, "w": w if alone else None})
        out += [(None, None, kh, near, key(core), part, classes) for (kh, _, near, core, part), classes in cores.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return strings.mapInArrow(run, "ctx binary, bits binary, kh bigint, near int, core binary, part int, classes array<struct<place:int,wh:binary,ctx:binary,w:int>>")


def _across_blocks(cores: DataFrame) -> DataFrame:
    """ctx, more: the windows that are alone in their block and occur in another block of the anchor. Rows of one core lie
    together, one a block; a task reads them in order and holds one core's classes."""
    at = ["kh", "near", "core", "part"]
    shared = materialize(cores.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-cores")
    dealt = cores.join(shared, at).select(*at, "classes").repartition(*at).sortWithinPartitions(*at)

    def run(batches):
        group, seen = None, {}

        def done():
            more: dict[bytes, list[int]] = {}
            for owners in seen.values():
                if len(owners) > 1:
                    for ctx, w in owners:
                        if ctx is not None:
                            more.setdefault(ctx, []).append(w)
            if more:
                yield pa.RecordBatch.from_arrays([pa.array(more.keys(), pa.binary()), pa.array(more.values(), pa.list_(pa.int32()))], ["ctx", "more"])

        for b in batches:
            for kh, near, core, part, classes in zip(*(b.column(c) for c in (*at, "classes")), strict=True):
                g = (kh.as_py(), near.as_py(), core.as_py(), part.as_py())
                if g != group:
                    yield from done()
                    group, seen = g, {}
                v = classes.values
                for place, wh, ctx, w in zip(*(v.field(i).to_pylist() for i in range(4)), strict=True):
                    seen.setdefault((place, wh), []).append((ctx, w))
        yield from done()

    found = dealt.mapInArrow(lambda it: _merged(run(it)), "ctx binary, more array<int>")
    out = materialize(found.groupBy("ctx").agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more")), "across-blocks")
    discard(shared)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, spots): the documents as doc_id, text, th, and for each doc_id and th the anchors with repeated windows,
    as an array of lo, hi, whole (all of lo to hi), bits (repeated ones of them), more (further ones)."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *dict.fromkeys(["doc_id", *carry])).withColumn("th", F.xxhash64("text"))
    occ = _contexts(rows.select("doc_id", "text", "th"), length, gram)
    whole = occ.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ctx", F.lit(True).alias("whole"))
    strings = occ.where("bytes is not null")
    blocks = strings.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks, "anchor-blocks")
    strings = strings.join(blocks, "kh").withColumn("block", F.pmod(F.xxhash64("ctx"), F.col("blocks")).cast("int"))
    strings = strings.select("kh", "block", "blocks", "ctx", "at", (F.col("hi") - F.col("lo") + 1).alias("n"), "bytes")
    strings = strings.repartition("kh", "block").sortWithinPartitions("kh", "block")
    found = materialize(_compare(strings, length, gram), "repeats")
    more = _across_blocks(found.where("core is not null").select("kh", "near", "core", "part", "classes"))
    marks = whole.select("ctx", "whole", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<int>").alias("more"))
    marks = marks.union(found.where("bits is not null").select("ctx", F.lit(None).cast("boolean"), "bits", F.lit(None).cast("array<int>")))
    marks = marks.union(more.select("ctx", F.lit(None).cast("boolean"), F.lit(None).cast("binary"), "more"))
    spots = occ.select("doc_id", "th", "lo", "hi", "ctx").join(marks, "ctx").groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "whole", "bits", "more")).alias("spots"))
    spots = materialize(spots, "spots")
    discard(occ, blocks, found, more)
    return rows, spots


def _removed(n: int, spots: pa.Scalar, length: int) -> np.ndarray:
    """Which of n bytes a repeated window covers."""
    gone = np.zeros(n, dtype=bool)
    if not spots.is_valid:
        return gone
    v = spots.values
    lo, hi = v.field("lo").to_numpy(), v.field("hi").to_numpy()
    whole = v.field("whole").is_valid().to_numpy(zero_copy_only=False)
    edge = np.bincount(lo[whole], minlength=n + 1) - np.bincount(hi[whole] + length, minlength=n + 1)
    gone |= np.cumsum(edge[:-1]) > 0
    bits, more = v.field("bits"), v.field("more")
    for k in np.flatnonzero(~whole).tolist():
        if (b := bits[k]).is_valid:
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(b.as_py(), np.uint8))[: hi[k] - lo[k] + 1])
        else:
            starts = np.array(more[k].as_py(), dtype=np.int64)
        starts = np.sort(starts)
        new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + 1]))
        for a, z in zip(starts[new].tolist(), starts[np.append(new[1:], len(starts)) - 1].tolist(), strict=True):
            gone[lo[k] + a : lo[k] + z + length] = True
    return gone


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, carry: list[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs`` (doc_id, text), kept_text if asked for, and the
    columns named in ``carry``.

    Bytes covered by a ``length``-byte string that starts anywhere else too are removed, judged on the input. A
    null text is empty; texts shorter than ``length`` lose nothing. Repeated rows are copies of each other.
    kept_text drops characters of which only a part remains. Other columns are ignored; an empty table gives no rows.
    """
    carry = [c for c in dict.fromkeys(carry) if c != "doc_id"]
    rows, spots = repeated_spans(docs, length, gram, carry)
    spots = spots.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spots")
    own = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")), "left").select("doc_id", *carry, "text", "spots")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]
    kinds_of = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for b in batches:
            out = []
            for text, spots in zip(b.column("text"), b.column("spots"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                gone = _removed(len(data), spots, length)
                n = int(gone.sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if n else 0
                out.append((len(data), n, spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] * with_text)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            cols = list(zip(*out, strict=True)) if out else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), *(b.column(c) for c in carry)], [*names, *carry])

    return own.mapInArrow(run, f"doc_id {kinds_of['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", `{c}` {kinds_of[c]}" for c in carry))
