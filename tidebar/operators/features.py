"""The causal features of a bar, in seven groups; a group that isn't asked for is never computed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R

GROUPS: dict[str, list[str]] = {
    "trend": [*(f"ema{n}_{k}" for n in (9, 21, 50, 200) for k in ("dist", "slope")), "ema9_21", "ema21_50", "ema50_200", "sma20_dist", "ema_stack", "adx14", "di_diff"],
    "momentum": ["rsi14", "rsi7", "rsi14_slope", "macd", "macd_hist", "macd_hist_slope", "roc10", "roc30", "stoch_k"],
    "volatility": ["atr14_pct", "atr_ratio", "bb_width", "bb_pos", "rvol20", "rvol_ratio", "range_pctile50"],
    "volume": ["vol_z", "vol_ratio", "obv_slope", "vwap_dist", "vwap_cross", "dollar_vol_z"],
    "patterns": ["body_ratio", "upper_wick_ratio", "lower_wick_ratio", "wick_imbalance", "is_doji", "is_pin_bull", "is_pin_bear", "engulf_bull", "engulf_bear", "inside_bar", "outside_bar", "body_vs_atr", "gap_atr", "consec_up"],
    "session": ["tod_sin", "tod_cos", "is_rth", "is_open_drive", "is_close_hour", "dow", "mins_from_rth_open", "bars_into_session", "pos_in_day_range", "dist_day_high", "dist_day_low"],
    "returns": [*(f"ret{k}_atr" for k in (1, 2, 3, 5, 10, 20)), "ret1_z", "hl_ratio5"],
}
ALL = [f for g in GROUPS.values() for f in g]


#: What each group reads of the recurrences; every ATR-scaled feature needs atr14.
EMAS = {"trend": (9, 21, 50, 200), "momentum": (12, 26)}
#: Bars that a window of any feature looks back, with the bar before the first.
LOOK_BACK = 128


def indicators(df: DataFrame, groups: list[str] | None = None, size: int | None = None) -> DataFrame:
    """The recurrences that the groups (all by default) read: moving averages, ATR, RSI, ADX and MACD.

    Scans of one level share a pass; ADX and the MACD signal, which read others, take a second one if asked for.
    """
    groups = list(GROUPS) if groups is None else groups

    def moves(d: DataFrame) -> DataFrame:
        change = F.col("close") - R.lag("close")
        up_move, down_move = F.col("high") - R.lag("high"), R.lag("low") - F.col("low")
        cols = {"__tr": R.true_range()}
        if "momentum" in groups:
            cols |= {"__up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "__down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
        if "trend" in groups:
            cols |= {"__pdm": F.when((up_move > down_move) & (up_move > 0), up_move).otherwise(0.0), "__ndm": F.when((down_move > up_move) & (down_move > 0), down_move).otherwise(0.0)}
        return d.withColumns(cols)

    df = R.in_pieces(df, moves, 1, 0, size)
    one = {f"ema{n}": ("close", R.ema_alpha(n), 0, n) for g in groups for n in EMAS.get(g, ())}
    one |= {f"atr{n}": ("__tr", 1 / n, 0, n) for n in ((14, 50) if "volatility" in groups else (14,))}
    if "momentum" in groups:
        one |= {f"__{s}{n}": (f"__{s}", 1 / n, 1, n) for n in (7, 14) for s in ("up", "down")}
    if "trend" in groups:
        one |= {f"__{s}14": (f"__{s}", 1 / 14, 0, 14) for s in ("pdm", "ndm")}
    df = R.scans(df, one)
    two = {}
    if "momentum" in groups:
        for n in (7, 14):
            df = df.withColumn(f"rsi{n}", 100 - 100 / (1 + F.col(f"__up{n}") / (F.col(f"__down{n}") + R.EPS)))
        df = df.withColumn("__macd", F.col("ema12") - F.col("ema26"))
        two["__signal"] = ("__macd", R.ema_alpha(9), 25, 9)
    if "trend" in groups:
        di = lambda s: 100 * F.col(f"__{s}14") / (F.col("atr14") + R.EPS)
        df = df.withColumns({"plus_di": di("pdm"), "minus_di": di("ndm")})
        df = df.withColumn("__dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / (F.col("plus_di") + F.col("minus_di") + R.EPS))
        two["adx14_raw"] = ("__dx", 1 / 14, 13, 14)
    if two:
        df = R.scans(df, two)
    return df.drop(*(c for c in df.columns if c.startswith(("__up", "__down", "__pdm", "__ndm", "__dx", "__tr"))))


def with_session_vwap(df: DataFrame) -> DataFrame:
    """__vwap: the volume-weighted typical price of the session so far."""
    typical, so_far = (F.col("high") + F.col("low") + F.col("close")) / 3, R.running("session_date")
    return df.withColumn("__vwap", F.sum(typical * F.col("volume")).over(so_far) / (F.sum("volume").over(so_far) + R.EPS))


def signed_volume() -> Column:
    """The bar's share in the on-balance volume."""
    return F.coalesce(F.signum(F.col("close") - R.lag("close")), F.lit(0.0)) * F.col("volume")


def with_obv(df: DataFrame, size: int | None = None) -> DataFrame:
    df = R.in_pieces(df, lambda d: d.withColumn("__sv", signed_volume()), 1, 0, size)
    return R.with_running_sum(df, F.col("__sv"), "__obv", size).drop("__sv")


def stoch_k(n: int = 14) -> Column:
    floor, ceiling = R.low("low", n), R.high("high", n)
    return 100 * (F.col("close") - floor) / (ceiling - floor + R.EPS)


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def _trend(div, scale) -> dict[str, Column]:
    f, c = {}, F.col("close")
    for n in EMAS["trend"]:
        f[f"ema{n}_dist"] = div(c - F.col(f"ema{n}"), scale)
        f[f"ema{n}_slope"] = div(F.col(f"ema{n}") - R.lag(f"ema{n}", 5), scale)
    gaps = [(a, b, F.col(f"ema{a}") - F.col(f"ema{b}")) for a, b in ((9, 21), (21, 50), (50, 200))]
    f |= {f"ema{a}_{b}": div(gap, scale) for a, b, gap in gaps}
    signs = [F.signum(gap) for *_, gap in gaps]
    return f | {"sma20_dist": div(c - R.sma(c, 20), scale), "ema_stack": signs[0] + signs[1] + signs[2], "adx14": F.col("adx14_raw"), "di_diff": F.col("plus_di") - F.col("minus_di")}


def _momentum(div, scale) -> dict[str, Column]:
    c, hist = F.col("close"), F.col("__macd") - F.col("__signal")
    f = {"rsi14_slope": F.col("rsi14") - R.lag("rsi14", 3), "macd": div(F.col("__macd"), scale), "macd_hist": div(hist, scale), "macd_hist_slope": div(hist, scale) - R.lag(div(hist, scale), 2)}
    return f | {f"roc{k}": (div(c, R.lag(c, k)) - 1) * 100 for k in (10, 30)} | {"stoch_k": stoch_k()}


def _volatility(div, scale) -> dict[str, Column]:
    c, mean, sd, ret = F.col("close"), R.sma("close", 20), R.std("close", 20), F.col("__ret")
    return {
        "atr14_pct": div(F.col("atr14"), c) * 100, "atr_ratio": F.col("atr14") / (F.col("atr50") + R.EPS), "bb_width": 4 * sd / (mean + R.EPS) * 100, "bb_pos": (c - mean) / (2 * sd + R.EPS),
        "rvol20": R.std(ret, 20) * 100, "rvol_ratio": R.std(ret, 20) * 100 / (R.std(ret, 100) * 100 + R.EPS), "range_pctile50": R.pct_rank(F.col("high") - F.col("low"), 50),
    }


def _volume(div, scale) -> dict[str, Column]:
    c, v, vwap = F.col("close"), F.col("volume"), F.col("__vwap")
    last10 = F.when(F.col("bar_idx") >= 10, F.sum("__sv").over(R.over(9)))  # the on-balance volume's change over ten bars
    return {
        "vol_z": R.zscore(v, 50), "vol_ratio": v / (R.sma(v, 50) + R.EPS), "obv_slope": last10 / (R.sma(v, 50) * 10 + R.EPS), "vwap_dist": div(c - vwap, scale),
        "vwap_cross": F.signum(c - vwap) - F.signum(R.lag(c) - R.lag(vwap)), "dollar_vol_z": R.zscore(c * v, 50),
    }


def _patterns(div, scale) -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, ph, pl, pc = (R.lag(x) for x in (o, h, lo, c))
    body, rng, upper, lower = c - o, F.expr("nullif(high - low, 0)"), h - F.greatest(o, c), F.least(o, c) - lo
    return {
        "body_ratio": body / rng, "upper_wick_ratio": upper / rng, "lower_wick_ratio": lower / rng, "wick_imbalance": (upper - lower) / rng,
        "is_doji": _flag(F.abs(body) / rng < 0.1), "is_pin_bull": _flag((lower / rng > 0.6) & (body > 0)), "is_pin_bear": _flag((upper / rng > 0.6) & (body < 0)),
        "engulf_bull": _flag((c > o) & (pc < po) & (c >= po) & (o <= pc)), "engulf_bear": _flag((c < o) & (pc > po) & (c <= po) & (o >= pc)),
        "inside_bar": _flag((h <= ph) & (lo >= pl)), "outside_bar": _flag((h > ph) & (lo < pl)), "body_vs_atr": div(F.abs(body), scale), "gap_atr": div(o - pc, scale),
    }


def _session(div, scale) -> dict[str, Column]:
    c, m = F.col("close"), F.col("minute_of_day")
    turn = m * (2 * math.pi / 1440)
    f = {"tod_sin": F.sin(turn), "tod_cos": F.cos(turn), "is_close_hour": F.col("is_close").cast("double"), **{x: F.col(x).cast("double") for x in ("is_rth", "is_open_drive", "dow")}}
    f["mins_from_rth_open"] = F.greatest(F.lit(-1440.0), F.least(F.lit(1440.0), (m - 570).cast("double")))
    high, low = F.col("__day_high"), F.col("__day_low")
    return f | {"bars_into_session": F.col("__in_session"), "pos_in_day_range": (c - low) / (high - low + R.EPS), "dist_day_high": div(high - c, scale), "dist_day_low": div(c - low, scale)}


def _returns(div, scale) -> dict[str, Column]:
    c, ret = F.col("close"), F.col("__ret")
    f = {f"ret{k}_atr": div(c - R.lag(c, k), scale) for k in (1, 2, 3, 5, 10, 20)}
    return f | {"ret1_z": ret / (R.std(ret, 50) + R.EPS), "hl_ratio5": (R.high("high", 5) - c) / (c - R.low("low", 5) + R.EPS)}


_BUILD = {"trend": _trend, "momentum": _momentum, "volatility": _volatility, "volume": _volume, "patterns": _patterns, "session": _session, "returns": _returns}


def build_features(bars: DataFrame, groups: list[str] | None = None, size: int | None = None) -> DataFrame:
    """``bars`` (symbol, ts, OHLCV, bar_idx and session tags) with the features of the groups (all by default), doubles; never NaN or infinite.

    Only what the groups read is computed. Windows run over pieces of ``size`` bars of a series and over sessions.
    """
    groups = list(GROUPS) if groups is None else list(groups)
    df, h, lo = bars, F.col("high"), F.col("low")
    if "volume" in groups:
        df = with_session_vwap(df)
    if "session" in groups:
        so_far = R.running("session_date")
        df = df.withColumns({"__day_high": F.max(h).over(so_far), "__day_low": F.min(lo).over(so_far), "__in_session": (F.count(F.lit(1)).over(so_far) - 1).cast("double")})
    if "patterns" in groups:
        df = R.with_streak(df, F.col("close") - F.col("open"), "consec_up", size)
    df = indicators(df, groups, size)

    def windows(d: DataFrame) -> DataFrame:
        extra = {"__ret": F.log(F.try_divide("close", R.lag("close")))} if {"volatility", "returns"} & set(groups) else {}
        if "volume" in groups:
            extra["__sv"] = signed_volume()
        d, scale = d.withColumns(extra) if extra else d, F.expr("nullif(atr14, 0)")
        f = {k: v for g in groups for k, v in _BUILD[g](F.try_divide, scale).items()}
        return d.withColumns(f)

    out = R.in_pieces(df, windows, LOOK_BACK, 0, size)
    return out.drop(*(x for x in out.columns if x.startswith("__")))


def select_columns(groups: list[str]) -> list[str]:
    return [x for g in groups for x in GROUPS[g]]
