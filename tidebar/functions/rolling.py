"""Trailing window primitives over (symbol, bar_idx): NULL until n non-null observations are in the frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS, ORDER = ["symbol"], "bar_idx"
EPS = 1e-12
#: Rows of a block of the recurrence scan, and bars of a piece of a series that one task sorts.
SCAN_BLOCK, PIECE = 64, 1 << 16


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over(before: int | None = None, after: int = 0):
    w = Window.partitionBy(*KEYS).orderBy(ORDER)
    return w if before is None else w.rowsBetween(-before, after)


def running(*more: str):
    return Window.partitionBy(*KEYS, *more).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(col(c), k).over(over())


def _full(c: Column, n: int, value: Column) -> Column:
    return F.when(F.count(c).over(over(n - 1)) >= n, value)


def sma(c, n: int) -> Column:
    return _full(col(c), n, F.avg(col(c)).over(over(n - 1)))


def std(c, n: int) -> Column:
    return _full(col(c), n, F.stddev_samp(col(c)).over(over(n - 1)))


def low(c, n: int) -> Column:
    return _full(col(c), n, F.min(col(c)).over(over(n - 1)))


def high(c, n: int) -> Column:
    return _full(col(c), n, F.max(col(c)).over(over(n - 1)))


def pct_rank(c, n: int) -> Column:
    """Rank of the last value among the last n, ties averaged, divided by n."""
    c = col(c)
    seen = F.collect_list(c).over(over(n - 1))
    rank = F.size(F.filter(seen, lambda x: x < c)) + (F.size(F.filter(seen, lambda x: x == c)) + 1) / 2
    return _full(c, n, rank / n)


def zscore(c, n: int) -> Column:
    return (col(c) - sma(c, n)) / (std(c, n) + EPS)


def true_range() -> Column:
    prev = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def in_pieces(df: DataFrame, step: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int | None = None) -> DataFrame:
    """``step(df)`` computed on pieces of ``size`` bars of each series, so that a long series spreads over many tasks.

    A piece also gets the ``before`` bars that precede it and the ``after`` bars that follow; ``step`` may look no
    further in its windows over (symbol, bar_idx). Inside, symbol is a struct of the symbol and the piece.
    """
    size = size or PIECE
    at = lambda x: F.floor(x / size).cast("bigint")
    piece = F.sequence(at(F.greatest(F.col(ORDER) - after, F.lit(0))), at(F.col(ORDER) + before))
    df = df.withColumn("__own", at(F.col(ORDER))).withColumn("__piece", F.explode(piece))
    df = df.withColumn("symbol", F.struct("symbol", "__piece"))
    # filtered after the windows; pieces past the end of a series hold borrowed bars only and vanish here
    return step(df).where(F.col("symbol.__piece") == F.col("__own")).withColumn("symbol", F.col("symbol.symbol")).drop("__own", "__piece")


def _carried(df: DataFrame, x: Column, out: str, fold, empty, size: int | None) -> DataFrame:
    """Adds ``out``: fold (F.sum or F.max) of x over all bars so far, piece by piece with one carried row a piece."""
    df = df.withColumns({"__x": x, "__p": F.floor(F.col(ORDER) / (size or PIECE)).cast("bigint")})
    inside = Window.partitionBy(*KEYS, "__p").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*KEYS).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*KEYS, "__p").agg(fold("__x").alias("__f")).select(*KEYS, "__p", fold("__f").over(earlier).alias("__carry"))
    df = df.withColumn("__here", fold("__x").over(inside)).join(carry, [*KEYS, "__p"])
    both = F.greatest("__here", "__carry") if fold is F.max else F.coalesce("__here", F.lit(empty)) + F.coalesce("__carry", F.lit(empty))
    return df.withColumn(out, both).drop("__x", "__p", "__here", "__carry")


def with_running_sum(df: DataFrame, x: Column, out: str, size: int | None = None) -> DataFrame:
    return _carried(df, x, out, F.sum, 0.0, size)


def with_streak(df: DataFrame, change: Column, out: str, size: int | None = None) -> DataFrame:
    """Signed length of the current run of equal signs of ``change`` (which may look one bar back); a run of zeros has 0."""
    df = in_pieces(df, lambda d: d.withColumn("__sign", F.coalesce(F.signum(change), F.lit(0.0))), 1, 0, size)
    df = in_pieces(df, lambda d: d.withColumn("__prev", lag("__sign")), 1, 0, size)
    begins = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("__sign")), F.col(ORDER))
    df = _carried(df, begins, "__begin", F.max, None, size)
    return df.withColumn(out, F.col("__sign") * (F.col(ORDER) - F.col("__begin") + 1)).drop("__sign", "__prev", "__begin")


def scans(df: DataFrame, specs: Mapping[str, tuple[Column | str, float, int, int]]) -> DataFrame:
    """Adds y[t] = (1-a) y[t-1] + a x[t] for each ``out: (x, a, start, n)``; y[start] = x[start], NULL before start + n - 1.

    x must be non-null from row ``start`` on. All scans of one dependency level go through one pass: sums inside
    blocks of 64 rows run in parallel, one row a block is folded along the series, and the carries are joined back,
    so that one long series spreads over many tasks. The fold looks back as far as a carry can matter in double precision.
    """
    block, k = F.expr(f"{ORDER} div {SCAN_BLOCK}"), F.expr(f"{ORDER} % {SCAN_BLOCK}")
    df = df.withColumns({"__b": block, "__k": k, **{f"__x_{o}": col(x).cast("double") for o, (x, *_) in specs.items()}})
    inside = Window.partitionBy(*KEYS, "__b").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for out, (_, a, start, _) in specs.items():
        q = 1 - a
        w = F.when(F.col(ORDER) < start, 0.0).when(F.col(ORDER) == start, F.col(f"__x_{out}")).otherwise(F.col(f"__x_{out}") * a)
        local[f"__y_{out}"] = F.sum(w * F.pow(F.lit(q), -F.col("__k"))).over(inside) * F.pow(F.lit(q), F.col("__k"))
    df = df.withColumns(local)
    tails = df.groupBy(*KEYS, "__b").agg(*(F.max_by(f"__y_{o}", ORDER).alias(f"__t_{o}") for o in specs))
    carries = []
    for out, (_, a, *_) in specs.items():
        step = (1 - a) ** SCAN_BLOCK
        back = max(1, math.ceil(-45 / math.log(step))) if step > 1e-300 else 1
        before = Window.partitionBy(*KEYS).orderBy("__b").rowsBetween(-back, -1)
        carries.append(F.aggregate(F.collect_list(f"__t_{out}").over(before), F.lit(0.0), _horner(step)).alias(f"__c_{out}"))
    df = df.join(tails.select(*KEYS, "__b", *carries), [*KEYS, "__b"])
    done = {o: F.when(F.col(ORDER) >= start + n - 1, F.col(f"__y_{o}") + F.col(f"__c_{o}") * F.pow(F.lit(1 - a), F.col("__k") + 1)) for o, (_, a, start, n) in specs.items()}
    return df.withColumns(done).drop("__b", "__k", *(f"__{p}_{o}" for p in "xyc" for o in specs))


def _horner(step: float):
    return lambda acc, x: acc * step + x


def ema_alpha(n: int) -> float:
    return 2 / (n + 1)
