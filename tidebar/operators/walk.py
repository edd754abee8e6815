"""Walk-forward folds, filters, signals and the one-position trade walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import in_pieces, lag, over


def folds(n_bars: int, train: int, test: int, max_bars: int, max_folds: int | None = None, anchored: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(fold, tr_lo, tr_hi, te_lo, te_hi), half-open; an embargo of max_bars + 1 bars lies before each test window.

    Test windows of ``test`` bars follow one another from the first one that a whole training window precedes;
    those with too little to learn from are left out, and the last ``max_folds`` are kept.
    """
    gap, least = max_bars + 1, max(200, train // 4)
    starts = range(train + gap, n_bars - test + 1, test)
    windows = [(0 if anchored else max(0, s - gap - train), s - gap, s, s + test) for s in starts]
    usable = [w for w in windows if w[1] - w[0] >= least]
    return [(i, *w) for i, w in enumerate(usable[-max_folds:] if max_folds else usable)]


def fold_frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "fold int, tr_lo bigint, tr_hi bigint, te_lo bigint, te_hi bigint")


def fold_windows(bars: DataFrame, train: int, test: int, max_bars: int, max_folds: int | None = None, anchored: bool = False) -> DataFrame:
    """symbol and its folds() as rows, over as many bars as the symbol has; a symbol too short for any has no row."""
    embargo = max_bars + 1
    n = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).cast("long").alias("__n"))
    at = F.when(F.col("__n") >= train + embargo + test, F.sequence(F.lit(train + embargo).cast("long"), F.col("__n") - test, F.lit(test).cast("long")))
    lo = lambda x: F.lit(0).cast("long") if anchored else F.greatest(F.lit(0).cast("long"), x - embargo - train)
    at = F.filter(at, lambda x: x - embargo - lo(x) >= max(200, train // 4))
    if max_folds:
        at = F.slice(at, F.greatest(F.lit(1), F.size(at) - max_folds + 1), F.lit(max_folds))
    x = F.col("te_lo")
    return n.select("symbol", F.posexplode(at).alias("fold", "te_lo")).select("symbol", "fold", lo(x).alias("tr_lo"), (x - embargo).alias("tr_hi"), "te_lo", (x + test).alias("te_hi"))


def in_windows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars of the test windows of their symbol (a table as of fold_windows) with their fold."""
    w = windows.select(F.col("symbol").alias("__s"), "fold", F.explode(F.sequence("te_lo", F.col("te_hi") - 1)).alias("__i"))
    return bars.join(w, F.col("symbol").eqNullSafe(F.col("__s")) & (F.col("bar_idx") == F.col("__i"))).drop("__s", "__i")


def holdout_cut(bars: DataFrame, months: int) -> DataFrame:
    """symbol, cut_ts, cut_idx: the first bar at or after the last timestamp less ``months`` calendar months."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("__last")).select(F.col("symbol").alias("__s"), (F.col("__last") - F.make_ym_interval(F.lit(0), F.lit(months))).alias("cut_ts"))
    return bars.join(last, F.col("symbol") == F.col("__s")).groupBy("symbol", "cut_ts").agg(F.count_if(F.col("ts") < F.col("cut_ts")).alias("cut_idx"))


def in_test(bars: DataFrame, fold_rows) -> DataFrame:
    """Bars of the test windows with their fold: a range join against a handful of folds."""
    f = fold_frame(bars.sparkSession, fold_rows)
    return bars.join(F.broadcast(f), (F.col("bar_idx") >= F.col("te_lo")) & (F.col("bar_idx") < F.col("te_hi"))).drop("tr_lo", "tr_hi", "te_lo", "te_hi")


def session_mask(session: str) -> Column:
    m = F.col("minute_of_day")
    masks = {"all": F.lit(True), "rth": F.col("is_rth") == 1, "globex": F.col("is_globex") == 1, "rth_no_open": (F.col("is_rth") == 1) & (m >= 600), "open_drive": F.col("is_open_drive") == 1}
    return masks[session]


def static_mask(session: str = "all", adx_min: float = 0.0, atr_min: float = 0.0, atr_max: float = 99.0) -> Column:
    ok = session_mask(session) & F.col("atr14_pct").between(atr_min, atr_max)
    if adx_min > 0:
        ok &= F.col("adx14") >= adx_min
    return F.coalesce(ok, F.lit(False))


def trend_aligned(direction: Column) -> Column:
    """The distance to the slow average is known and doesn't oppose the direction (1 or -1)."""
    return F.coalesce(F.signum("ema200_dist") * direction >= 0, F.lit(False))


def capacity(masked_bars, max_bars: int, min_trades: int):
    """Whether so many admitted test bars (a number or a column) can hold enough trades."""
    return masked_bars / max(0.35 * max_bars, 1.0) >= min_trades


def momentum_signal(df: DataFrame, k: int = 3) -> DataFrame:
    """p_long and p_short of a plain rule: the logistic of the last k-bar move in ATRs. Stands in for a model in queries."""
    x = F.try_divide(F.col("close") - lag("close", k), F.expr("nullif(atr, 0)"))
    return in_pieces(df, lambda d: d.withColumn("p_long", 1 / (1 + F.exp(-x))), k).withColumn("p_short", 1 - F.col("p_long"))


def signal(long_thr: float, short_thr: float, margin: float, allow_long: bool = True, allow_short: bool = True) -> Column:
    pl, ps = F.col("p_long"), F.col("p_short")
    go_long = F.lit(allow_long) & (pl >= long_thr) & (pl - ps >= margin)
    go_short = F.lit(allow_short) & (ps >= short_thr) & (ps - pl >= margin)
    return F.when(go_long, 1).when(go_short, -1).otherwise(0)


def candidates(df: DataFrame) -> DataFrame:
    """Rows with a direction whose trade resolves: R, exit_idx and confidence of the chosen side."""
    is_long = F.col("direction") == 1
    out = df.where("direction != 0").withColumns(
        {"R": F.when(is_long, F.col("long_R")).otherwise(F.col("short_R")), "exit_idx": F.when(is_long, F.col("long_exit")).otherwise(F.col("short_exit")), "confidence": F.when(is_long, F.col("p_long")).otherwise(F.col("p_short"))}
    )
    return out.where("R is not null and exit_idx >= 0")


def one_position(cands: DataFrame, keys: list[str], max_per_day: int | None = None) -> DataFrame:
    """The candidates that a trader with one position takes, scanning each group by bar_idx: a signal inside an open
    trade, or beyond the session's quota, is passed over.

    The groups (strategy, symbol, fold) are walked in parallel; a walk carries two numbers, so a group streams
    through Arrow batches sorted by bar.
    """
    import pyarrow as pa

    schema = cands.schema
    quota = max_per_day or 0
    n_keys = [schema.names.index(k) for k in keys]
    i, x, s = (schema.names.index(c) for c in ("bar_idx", "exit_idx", "session_date"))

    def walk(batches):
        group, busy, day, used = None, -1, None, 0
        for b in batches:
            take = []
            cols = [b.column(k).to_pylist() for k in n_keys]
            for row, (g, at, exit_, session) in enumerate(zip(zip(*cols, strict=True), b.column(i).to_pylist(), b.column(x).to_pylist(), b.column(s).to_pylist(), strict=True)):
                if g != group:
                    group, busy, day, used = g, -1, None, 0
                if session != day:
                    day, used = session, 0
                if at > busy and (not quota or used < quota):
                    take.append(row)
                    busy, used = exit_, used + 1
            yield b.take(pa.array(take, pa.int64()))

    dealt = cands.repartition(*keys).sortWithinPartitions(*keys, "bar_idx")
    return dealt.mapInArrow(walk, schema)


def trade_log(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """The walk's trades with entry and exit times and prices (exit price from the net R)."""
    entry = in_pieces(bars.select("symbol", "bar_idx", "ts"), lambda d: d.withColumn("entry_time", F.lead("ts").over(over())), 0, 1).select("symbol", "bar_idx", F.coalesce("entry_time", "ts").alias("entry_time"))
    out = bars.select("symbol", F.col("bar_idx").alias("exit_idx"), F.col("ts").alias("exit_time"))
    df = trades.withColumnRenamed("ts", "signal_time").join(entry, ["symbol", "bar_idx"]).join(out, ["symbol", "exit_idx"])
    is_long = F.col("direction") == 1
    risk = F.abs(F.col("entry_price") - F.col("long_stop"))
    return df.select(
        *(c for c in ("strategy", "symbol", "fold") if c in df.columns), "signal_time", "entry_time", "exit_time",
        F.when(is_long, "long").otherwise("short").alias("direction"), F.bround("entry_price", 2).alias("entry_price"),
        F.bround(F.when(is_long, F.col("long_stop")).otherwise(F.col("short_stop")), 2).alias("stop_price"),
        F.bround(F.when(is_long, F.col("long_target")).otherwise(F.col("short_target")), 2).alias("target_price"),
        F.bround(F.col("entry_price") + F.col("R") * risk * F.col("direction"), 2).alias("exit_price"), F.bround(risk, 2).alias("risk_points"),
        (F.col("exit_idx") - F.col("bar_idx")).cast("int").alias("bars_held"), F.bround("confidence", 4).alias("confidence"), F.bround("R", 4).alias("R"),
    )
