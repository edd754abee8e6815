"""Triple-barrier labels: which of stop, target or time limit each bar's trade meets first, in units of risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import in_pieces, over

STOP, TARGET, TIME, NONE = 0, 1, 2, -1


def _side(long: bool, tp: float, sl: float, cost: float) -> tuple[Column, Column, Column]:
    """(R, exit index, outcome) of one side; needs __path, __risk, entry_price and the levels."""
    name = "long" if long else "short"
    stop, target, path = F.col(f"{name}_stop"), F.col(f"{name}_target"), F.col("__path")
    at_stop = (lambda p: p["l"] <= stop) if long else (lambda p: p["h"] >= stop)
    at_target = (lambda p: p["h"] >= target) if long else (lambda p: p["l"] <= target)
    first = F.get(F.filter(path, lambda p: at_stop(p) | at_target(p)), F.lit(0))
    last = F.element_at(path, -1)
    move = (last["c"] - F.col("entry_price")) * (1 if long else -1)
    outcome = F.when(first.isNull(), TIME).when(at_stop(first), STOP).otherwise(TARGET)
    fee = F.lit(float(cost)) / F.col("__risk")
    r = F.when(first.isNull(), (move - cost) / F.col("__risk")).when(at_stop(first), -1.0 - fee).otherwise(tp / sl - fee)
    ok = F.col("valid")
    return F.when(ok, r), F.when(ok, F.coalesce(first["i"], last["i"])).otherwise(-1), F.when(ok, outcome).otherwise(NONE)


def triple_barrier(bars: DataFrame, tp: float, sl: float, max_bars: int, cost: float = 0.0, atr: str = "atr", size: int | None = None) -> DataFrame:
    """The labels of ``_barriers``, computed on pieces of ``size`` bars of a series."""
    return in_pieces(bars, lambda d: _barriers(d, tp, sl, max_bars, cost, atr), 0, max(1, max_bars), size)


def _barriers(bars: DataFrame, tp: float, sl: float, max_bars: int, cost: float, atr: str) -> DataFrame:
    """``bars`` with entry_price, the levels, long_R/short_R, long_exit/short_exit, long_out/short_out, label and valid.

    Entry is the next open. Each of the next ``max_bars`` bars (fewer at the end) is held against the stop, then the
    target; without a touch the trade ends at the last close. Bars without a next one or with no positive ATR are invalid.
    """
    entry, a = F.lead("open").over(over()), F.col(atr)
    path = F.collect_list(F.struct(F.col("bar_idx").alias("i"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))).over(over(-1, max_bars))
    df = bars.withColumns({"entry_price": entry, "__path": path})
    df = df.withColumns({"valid": F.coalesce(F.col("entry_price").isNotNull() & (a > 0), F.lit(False)), "__risk": F.expr(f"nullif({float(sl)} * `{atr}`, 0)")})
    e = F.col("entry_price")
    df = df.withColumns({"long_stop": e - sl * a, "long_target": e + tp * a, "short_stop": e + sl * a, "short_target": e - tp * a})
    # a generator keeps filters on the outcome above it, so that the paths are walked once
    out = [x for long, name in ((True, "long"), (False, "short")) for x in zip(_side(long, tp, sl, cost), (f"{name}_R", f"{name}_exit", f"{name}_out"), ("double", "bigint", "tinyint"), strict=True)]
    df = df.select(*(c for c in df.columns if c not in ("__path", "__risk")), F.inline(F.array(F.struct(*(c.cast(t).alias(n) for c, n, t in out)))))
    up, down = F.col("long_out") == TARGET, F.col("short_out") == TARGET
    label = F.when(up & down, F.when(F.col("long_exit") <= F.col("short_exit"), 1).otherwise(-1)).when(up, 1).when(down, -1).otherwise(0)
    return df.withColumn("label", label.cast("tinyint"))
