"""Bars from folders of CSV files: discovery, delimiters, headers, time zones, cleaning, and a Parquet cache."""

from __future__ import annotations

import glob
import gzip
import hashlib
import json
import logging
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B

log = logging.getLogger(__name__)
SUFFIXES = (".csv", ".csv.gz", ".txt", ".tsv")
#: Header names that mean a canonical column.
ALIASES = {
    "timestamp": "ts", "date": "ts", "datetime": "ts", "time": "ts", "ts": "ts", "ts_event": "ts", "date_time": "ts",
    "open": "open", "o": "open", "px_open": "open", "high": "high", "h": "high", "px_high": "high",
    "low": "low", "l": "low", "px_low": "low", "close": "close", "c": "close", "px_close": "close",
    "volume": "volume", "v": "volume", "vol": "volume", "vwap": "vwap",
    "tick_volume": "tick_volume", "tickvolume": "tick_volume", "tick_vol": "tick_volume", "ticks": "tick_volume", "trades": "tick_volume", "count": "tick_volume",
}
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "yyyyMMdd HHmmss", "yyyy-MM-dd", "yyyy.MM.dd"]
REQUIRED = ["open", "high", "low", "close"]
MAX_VOLUME = 50_000


def discover(path: str) -> list[str]:
    """Files of a folder and its subfolders, or of a pattern, sorted."""
    path = os.path.expanduser(path)
    if os.path.isdir(path):
        return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith(SUFFIXES))
    return sorted(glob.glob(path))


def first_line(path: str) -> str:
    with (gzip.open if path.endswith(".gz") else open)(path, "rt", errors="replace") as f:
        return f.readline().rstrip("\r\n")


def sniff(line: str) -> str:
    best = max("\t;,|", key=line.count)
    return best if line.count(best) >= 3 else ","


def _timestamp(c: Column, tz: str) -> Column:
    """New York wall clock. In a gap of the source zone the first later instant is taken; a doubled time is NULL."""
    local = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in FORMATS))
    back = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.convert_timezone(F.lit(tz), F.lit("UTC"), local))
    moved = F.convert_timezone(F.lit(tz), F.lit("America/New_York"), local)
    hour = F.expr("interval 1 hour")
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), local)
    # doubled: an hour later in absolute time the wall clock shows the same
    doubled = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc + hour) == local
    at_gap = F.convert_timezone(F.lit(tz), F.lit("America/New_York"), F.date_trunc("hour", back))
    return F.when(doubled, None).when(back != local, at_gap).otherwise(moved)


def read_one(spark: SparkSession, path: str, source_tz: str, max_volume: float | None = MAX_VOLUME) -> DataFrame:
    """ts, OHLC, volume of one file; an unknown header means six columns without one. Sound rows only."""
    line = first_line(path)
    sep = sniff(line)
    names = [x.strip().strip('"').lower() for x in line.split(sep)]
    headered = any(x in ALIASES for x in names)
    if not headered and len(names) < 6:
        raise ValueError(f"{path}: no known columns")
    if headered:
        df = spark.read.csv(f"file://{os.path.abspath(path)}", sep=sep, header=True)
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        if "symbol" in line.replace(sep, " ").split() and "symbol" in names:
            df = df.where(~F.col(f"c{names.index('symbol')}").contains("-"))
        if max_volume and "volume" in [x.strip() for x in line.split(sep)]:
            df = df.where(F.col(f"c{names.index('volume')}").try_cast("double") < max_volume)
        found: dict[str, list[str]] = {}
        for i, x in enumerate(names):
            if x in ALIASES:
                found.setdefault(ALIASES[x], []).append(f"c{i}")
    else:
        df = spark.read.csv(f"file://{os.path.abspath(path)}", sep=sep, header=False)
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        found = {k: [f"c{i}"] for i, k in enumerate(["ts", *REQUIRED, "volume"])}
    if missing := [c for c in ["ts", *REQUIRED] if c not in found]:
        raise ValueError(f"{path}: missing columns {missing}")
    number = lambda k: F.coalesce(*(F.col(c).try_cast("double") for c in found[k])) if k in found else F.lit(None).cast("double")
    df = df.select(_timestamp(F.coalesce(*(F.col(c) for c in found["ts"])), source_tz).alias("ts"), *(F.nanvl(number(c), F.lit(None)).alias(c) for c in REQUIRED), number("volume").alias("volume"), number("tick_volume").alias("tick_volume"))
    if "tick_volume" in found:
        total = df.agg(F.coalesce(F.sum(F.abs("volume")), F.lit(0.0))).first()[0]
        if not total:
            df = df.withColumn("volume", F.col("tick_volume"))
    return df.where("ts is not null").drop("tick_volume")


def load_csv(spark: SparkSession, path: str, timeframe: str, symbol: str = "NQ", source_tz: str = "America/New_York") -> DataFrame:
    """One series from all files of a folder. Unreadable, empty and too coarse files are skipped with a warning; of rows
    with one timestamp the largest volume of a file wins, and later files win over earlier ones."""
    parts = []
    for k, f in enumerate(discover(path)):
        try:
            df = B.valid_bars(B.front_month(read_one(spark, f, source_tz).withColumn("symbol", F.lit(symbol))))
            spacing = B.native_spacing(df, ["symbol"]).first()
            if spacing is None:
                raise ValueError("no rows")
            if spacing["spacing"] > 1.5 * B.tf_minutes(timeframe):
                raise ValueError(f"bars of {spacing['spacing']:g} minutes are too coarse for {timeframe}")
            parts.append(df.withColumn("__file", F.lit(k)))
        except Exception as e:
            log.warning("skipped %s: %s", f, e)
    if not parts:
        raise ValueError(f"no usable file in {path}")
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc("__file"))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__file")


def _no_network(name: str):
    def load(spark: SparkSession, path: str, timeframe: str, **options) -> DataFrame:
        """Needs the vendor's client; none is bundled. Register an own adapter under this name."""
        raise RuntimeError(f"the {name} client isn't installed")

    return load


#: Adapter name -> callable(spark, path, timeframe, **options) returning symbol, ts, OHLCV. Add your own.
ADAPTERS = {"csv": load_csv, "databento": _no_network("databento"), "yfinance": _no_network("yfinance")}


def cache_key(path: str, timeframe: str, options: dict) -> str:
    files = [(os.path.basename(f), (s := os.stat(f)).st_size, s.st_mtime_ns) for f in discover(path)]
    return hashlib.sha1(json.dumps([path, timeframe, options, files], sort_keys=True, default=str).encode()).hexdigest()[:16]


def _age_hours(spark: SparkSession, path: str) -> float:
    """Hours since a file was written; infinity if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return (time.time() - fs.getFileStatus(at).getModificationTime() / 1000) / 3600 if fs.exists(at) else float("inf")


def load_bars(spark: SparkSession, path: str, timeframe: str = "15min", adapter: str = "csv", start=None, end=None, cache_dir: str | None = None, max_age_hours: float = 12, **options) -> DataFrame:
    """Tagged and indexed bars of a source, resampled to ``timeframe``; from the cache if files and options are unchanged and
    it isn't older than ``max_age_hours``. ``cache_dir`` is a folder that all executors see: a URI, or a path where there is
    one machine only."""
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(sorted(ADAPTERS))}")
    at = cache_dir and f"{cache_dir.rstrip('/') if '://' in cache_dir else 'file://' + os.path.abspath(cache_dir)}/bars_{cache_key(path, timeframe, options | {'adapter': adapter})}"
    if at and _age_hours(spark, f"{at}/_SUCCESS") <= max_age_hours:
        df = spark.read.parquet(at)
    else:
        df = B.resample(ADAPTERS[adapter](spark, path, timeframe, **options), timeframe)
        if at:
            df.write.mode("overwrite").parquet(at)
            df = spark.read.parquet(at)
    return B.tag_sessions(B.indexed(B.time_range(df, start, end)))


def synthetic(spark: SparkSession, n: int, seed: int = 42, start: str = "2022-01-03 00:00:00", minutes: int = 5, symbol: str = "SYN") -> DataFrame:
    """n bars of a made-up market: weekdays without the hour from 17:00, busy sessions with bursts at the open and close,
    slowly changing volatility, fat tails and a little momentum. One short series for trials, made on the driver."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    grid = pd.date_range(start, periods=2 * n + 4096, freq=f"{minutes}min")
    at = grid[(grid.dayofweek < 5) & (grid.hour != 17)][:n]
    minute = (at.hour * 60 + at.minute).to_numpy(float)
    burst = lambda centre, width, size: 1 + size * np.exp(-((minute - centre) ** 2) / (2 * width**2))
    busy = np.where((minute >= 570) & (minute < 960), 1.0, 0.35) * burst(575, 25, 0.9) * burst(950, 20, 0.5)

    def recursive(x: np.ndarray, *lags: float) -> np.ndarray:
        out = x.copy()
        for i in range(len(lags), n):
            out[i] += sum(w * out[i - 1 - k] for k, w in enumerate(lags))
        return out

    level = np.exp(recursive(rng.normal(0, 0.03, n), 0.995))
    vol = 0.00045 * level * busy * np.sqrt(minutes / 5)
    close = 13000 * np.exp(np.cumsum(recursive(vol * rng.standard_t(4, n) / np.sqrt(2), 0.045, -0.02)))
    open_ = np.concatenate([close[:1], close[:-1]])
    reach, up = np.abs(close - open_) + vol * close * rng.uniform(0.4, 1.6, n), rng.uniform(0, 1, n)
    pdf = pd.DataFrame({"symbol": symbol, "ts": at, "open": open_, "high": np.maximum(open_, close) + 0.6 * reach * up, "low": np.minimum(open_, close) - 0.6 * reach * (1 - up), "close": close, "volume": np.round(rng.gamma(3.0, 1200.0, n) * busy)})
    return spark.createDataFrame(pdf.round({c: 2 for c in ("open", "high", "low", "close")}), "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
