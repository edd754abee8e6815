"""Bars: cleaning, deduplication, resampling and session tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes of each timeframe name.
TIMEFRAMES = {"1min": 1, "2min": 2, "3min": 3, "5min": 5, "10min": 10, "15min": 15, "30min": 30, "60min": 60, "1h": 60, "4h": 240, "1d": 1440}
PRICES = ["open", "high", "low", "close"]


def tf_minutes(name: str) -> int:
    try:
        return TIMEFRAMES[name]
    except KeyError:
        raise ValueError(f"unknown timeframe {name!r}; known: {', '.join(TIMEFRAMES)}") from None


def front_month(df: DataFrame) -> DataFrame:
    """One row for each (symbol, ts): the largest volume; a NULL volume wins, further ties go to the larger prices."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.col("volume").isNull().desc(), F.desc("volume"), *(F.desc(c) for c in PRICES))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def geometry_ok(tol: float = 1e-9) -> Column:
    o, h, lo, c = (F.col(x) for x in PRICES)
    return F.coalesce((h >= lo) & (h >= F.greatest(o, c) - tol) & (lo <= F.least(o, c) + tol) & (c > 0) & o.isNotNull(), F.lit(False))


def valid_bars(df: DataFrame) -> DataFrame:
    """Bars of sound geometry; a missing volume becomes 0."""
    return df.where(geometry_ok()).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def native_spacing(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spacing: the median of the positive gaps in minutes; 0 with fewer than three rows."""
    gap = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts")).cast("timestamp"))) / 60
    g = df.withColumn("__gap", gap)
    return g.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.expr("percentile(if(__gap > 0, __gap, null), 0.5)"), F.lit(0.0))).otherwise(0.0).alias("spacing"))


def bucket(timeframe: str, ts: str = "ts") -> Column:
    """Start of a row's bucket: left-closed, left-labelled, aligned to midnight of the wall clock."""
    minutes = tf_minutes(timeframe)
    day = F.to_date(ts).cast("timestamp_ntz")
    if minutes == 1440:
        return day
    of_day = (F.hour(ts) * 60 + F.minute(ts)).cast("int")
    return day + F.make_dt_interval(F.lit(0), F.lit(0), (of_day - of_day % minutes).cast("int"))


def resample(df: DataFrame, timeframe: str, order: list[str] = ()) -> DataFrame:
    """OHLCV bars of (symbol, bucket); ``order`` breaks ties of ts for the first and last price. Empty buckets have no row."""
    at = F.struct("ts", *order)
    return (
        df.withColumn("__at", at)
        .groupBy("symbol", bucket(timeframe).alias("__ts"))
        .agg(F.min_by("open", "__at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "__at").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("__ts", "ts")
    )


def ticks_to_bars(df: DataFrame, timeframe: str, order: list[str] = ()) -> DataFrame:
    """Bars from (symbol, ts, price, volume)."""
    return resample(df.select("symbol", "ts", *order, *(F.col("price").alias(c) for c in PRICES), "volume"), timeframe, order)


def indexed(df: DataFrame) -> DataFrame:
    """bar_idx: the dense 0-based place of a bar in its symbol. A task sorts one day of a symbol; the days' counts give each its start."""
    df = df.withColumn("__day", F.to_date("ts"))
    before = Window.partitionBy("__s").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy(F.col("symbol").alias("__s"), F.col("__day").alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    days = days.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    df = df.withColumn("__rn", F.row_number().over(Window.partitionBy("symbol", "__day").orderBy("ts")))
    df = df.join(days, F.col("symbol").eqNullSafe(F.col("__s")) & F.col("__day").eqNullSafe(F.col("__d")))
    return df.withColumn("bar_idx", (F.col("__start") + F.col("__rn") - 1).cast("bigint")).drop("__s", "__d", "__day", "__start", "__rn")


def tag_sessions(df: DataFrame) -> DataFrame:
    m = F.hour("ts") * 60 + F.minute("ts")
    flag = lambda c: F.when(c, 1).otherwise(0).cast("tinyint")
    day = F.to_date("ts")
    return df.withColumns(
        {
            "minute_of_day": m,
            "is_rth": flag((m >= 570) & (m < 960)),
            "is_open_drive": flag((m >= 570) & (m < 630)),
            "is_close": flag((m >= 900) & (m < 960)),
            "is_globex": flag((m < 570) | (m >= 960)),
            "dow": F.weekday("ts").cast("tinyint"),
            "session_date": F.when(m >= 1080, F.date_add(day, 1)).otherwise(day),
        }
    )


def bars_per_year(df: DataFrame) -> DataFrame:
    span = (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) / 86400
    return df.groupBy("symbol").agg((F.count(F.lit(1)) / F.greatest(span, F.lit(1e-9)) * 365.25).alias("bars_per_year"))


def time_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both ends included."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast(df.schema["ts"].dataType))
    return df if end is None else df.where(F.col("ts") <= F.lit(end).cast(df.schema["ts"].dataType))
