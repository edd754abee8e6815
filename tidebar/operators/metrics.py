"""R-multiple metrics, the composite score, haircuts and verdicts: grouped aggregates and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the score: weight and scale of each part.
PARTS = {"expectancy_R": (0.34, 0.20), "sharpe": (0.22, 1.5), "recovery_factor": (0.22, 3.0), "payoff_ratio": (0.22, 2.0)}
MIN_TRADES, T_FULL, T_MARGIN = 100, 3.5, 0.5


def _path(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    df = trades.withColumns({"__eq": F.sum("R").over(to_here), "__lose": (F.col("R") <= 0).cast("int"), "__pos": F.row_number().over(w)})
    df = df.withColumns({"__peak": F.greatest(F.max("__eq").over(to_here), F.lit(0.0)), "__last_win": F.coalesce(F.max(F.when(F.col("__lose") == 0, F.col("__pos"))).over(to_here), F.lit(0))})
    return df.withColumns({"__dd": F.col("__peak") - F.col("__eq"), "__streak": F.col("__pos") - F.col("__last_win")})


def r_metrics(trades: DataFrame, keys: list[str], order: list[str], min_trades: int = MIN_TRADES) -> DataFrame:
    """keys and the metrics of ``trades`` (keys, order, R, entry_time); rounded, then scored.

    NULL, NaN and infinite R are left out, but their entries count towards the time span. Keys whose trades have no
    finite R get the empty metrics; for strategies without any row see ``with_empty``.
    """
    finite = F.col("R").isNotNull() & ~F.isnan("R") & (F.abs("R") != float("inf"))
    days = (F.unix_micros(F.max("entry_time").cast("timestamp")) - F.unix_micros(F.min("entry_time").cast("timestamp"))) / 86400e6
    spans = trades.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, F.greatest(days, F.lit(1e-9))).otherwise(0.0).alias("span"))
    df = _path(trades.where(finite), keys, order)
    win = F.col("R") > 0
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(win.cast("double")).alias("wr"), F.coalesce(F.avg(F.when(win, F.col("R"))), F.lit(0.0)).alias("aw"), F.coalesce(F.avg(F.when(~win, F.col("R"))), F.lit(0.0)).alias("al"),
        F.avg("R").alias("mean"), F.sum("R").alias("total"), F.max("__dd").alias("dd"), F.coalesce(F.stddev_samp("R"), F.lit(0.0)).alias("sd"), F.max("__streak").alias("streak"), F.max("R").alias("best"), F.min("R").alias("worst"),
        F.sum(F.when(win, F.col("R")).otherwise(0.0)).alias("gain"), F.sum(F.when(~win, F.col("R")).otherwise(0.0)).alias("loss"),
    )
    agg = _joined(agg, spans, keys)
    expectancy = F.expr("wr * aw + (1 - wr) * al")
    per_year = F.try_divide("n", "span") * 365.25
    has_sd = F.col("sd") > 1e-9
    out = agg.withColumns({"exp": expectancy, "tpy": F.when(F.col("span") > 0, per_year).otherwise(0.0)})
    cols = {
        "trades": F.col("n"),
        "win_rate": F.bround("wr", 4),
        "avg_R": F.bround("mean", 4),
        "avg_win_R": F.bround("aw", 4),
        "avg_loss_R": F.bround("al", 4),
        "expectancy_R": F.bround("exp", 4),
        "total_R": F.bround("total", 2),
        "max_dd_R": F.bround("dd", 2),
        "recovery_factor": F.bround(F.when(F.col("dd") > 1e-9, F.try_divide("total", "dd")).otherwise(F.greatest("total", F.lit(0.0))), 3),
        "sharpe": F.bround(F.when(has_sd, F.try_divide("exp", "sd") * F.sqrt("tpy")).otherwise(0.0), 3),
        "profit_factor": F.bround(F.when(F.col("loss") < 0, F.least(F.try_divide("gain", F.abs("loss")), F.lit(999.0))).otherwise(999.0), 3),
        "payoff_ratio": F.bround(F.when(F.col("al") < -1e-9, F.least(F.try_divide("aw", F.abs("al")), F.lit(999.0))).when(F.col("aw") > 0, 10.0).otherwise(0.0), 3),
        "t_stat": F.bround(F.when(has_sd, F.try_divide("exp", "sd") * F.sqrt("n")).otherwise(0.0), 3),
        "max_losing_streak": F.col("streak").cast("bigint"),
        "trades_per_year": F.bround("tpy", 1),
        "span_days": F.bround("span", 1),
        "best_R": F.bround("best", 2),
        "worst_R": F.bround("worst", 2),
    }
    scored = out.select(*keys, *(v.alias(k) for k, v in cols.items())).withColumn("score", composite(min_trades))
    return with_empty(scored, trades.select(*keys).distinct(), keys)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which some may be NULL."""
    right = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, cond, how).drop(*(f"__{k}" for k in keys))


#: The metrics of a strategy without trades: zero each, but for the score.
EMPTY_SCORE = -1.0


def with_empty(scored: DataFrame, strategies: DataFrame, keys: list[str]) -> DataFrame:
    """``scored`` with a row of empty metrics for each of the ``strategies`` (distinct keys) that isn't in it."""
    zeros = {f.name: F.lit(EMPTY_SCORE if f.name == "score" else 0).cast(f.dataType) for f in scored.schema if f.name not in keys}
    out = _joined(strategies.select(*keys), scored.withColumn("__known", F.lit(True)), keys, "left")
    return out.select(*keys, *(F.when(F.col("__known"), F.col(c)).otherwise(z).alias(c) for c, z in zeros.items()))


def composite(min_trades: int = MIN_TRADES) -> Column:
    """Weighted tanh parts (payoff only with a positive expectancy), shrunk for weak t-statistics and few trades, within ±1."""
    raw = F.lit(0.0)
    for name, (weight, scale) in PARTS.items():
        part = weight * F.tanh(F.col(name) / scale)
        raw = raw + (F.when(F.col("expectancy_R") > 0, part).otherwise(0.0) if name == "payoff_ratio" else part)
    penalty = F.least(F.lit(1.0), F.greatest("t_stat", F.lit(0.0)) / T_FULL) * F.sqrt(F.least(F.lit(1.0), F.col("trades") / float(min_trades)))
    # bound by a one-element array, so that each part is evaluated once
    parts = F.array(F.struct(raw.alias("raw"), penalty.alias("pen")))
    score = F.transform(parts, lambda p: F.when(p["raw"] > 0, p["raw"] * p["pen"]).otherwise(p["raw"] / F.greatest(p["pen"], F.lit(0.25))))[0]
    return F.when(F.col("trades") == 0, -1.0).otherwise(F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 5))


def noise_ceiling(n: Column) -> Column:
    """The expected largest of n (at least 3) standard normal scores, by the Gumbel approximation."""
    m = F.greatest(n.cast("bigint"), F.lit(3)).cast("double")
    a = F.sqrt(2 * F.log(m))
    return a - (F.log(F.log(m)) + math.log(4 * math.pi)) / (2 * a)


def fold_consistency(by_fold: DataFrame, keys: list[str]) -> DataFrame:
    """keys and folds, folds_profitable, fold_win_rate, worst_fold_R, fold_R_std (population), concentration, over folds with trades."""
    total = F.when(F.col("trades") > 0, F.col("total_R"))
    f = by_fold.groupBy(*keys).agg(F.count(total).alias("folds"), F.count_if(total > 0).alias("folds_profitable"), F.min(total).alias("worst"), F.stddev_pop(total).alias("sd"), F.sum(total).alias("sum"), F.max(total).alias("top"))
    conc = F.when(F.col("sum") > 0, F.least(F.lit(1.0), F.try_divide("top", "sum"))).otherwise(1.0)
    or0 = lambda c: F.coalesce(c, F.lit(0.0))
    return f.select(*keys, "folds", "folds_profitable", or0(F.bround(F.try_divide("folds_profitable", "folds"), 3)).alias("fold_win_rate"), or0(F.bround("worst", 2)).alias("worst_fold_R"), or0(F.bround("sd", 2)).alias("fold_R_std"), F.bround(conc, 3).alias("concentration"))


def haircut(score: Column | None = None) -> Column:
    """The score less what inconsistent or concentrated folds take from it; needs folds, fold_win_rate, concentration."""
    s = F.col("score") if score is None else score
    cut = s * (0.4 + 0.6 * F.col("fold_win_rate")) * F.when(F.col("concentration") > 0.7, 1 - (F.col("concentration") - 0.7)).otherwise(1.0)
    return F.when((F.col("folds") < 3) | (s <= 0), s).otherwise(F.bround(cut, 5))


def assess(df: DataFrame, n_tried: Column, min_trades: int = MIN_TRADES, margin: float = T_MARGIN) -> DataFrame:
    """``df`` with checks (label, ok), passed, total and tier. A holdout (holdout_trades, holdout_expectancy_R, if present) confirms or refutes."""
    ceiling = noise_ceiling(n_tried)
    rules = {
        "expectancy": F.col("expectancy_R") > 0,
        "t_stat": F.col("t_stat") >= ceiling + margin,
        "payoff": F.col("payoff_ratio") >= 2,
        "trades": F.col("trades") >= max(min_trades, 200),
        "folds": F.col("fold_win_rate") >= 0.65,
        "concentration": F.col("concentration") <= 0.45,
        "recovery": F.col("recovery_factor") >= 2,
    }
    oks = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    passed = sum((v.cast("int") for v in oks.values()), F.lit(0))
    df = df.withColumn("passed", passed)
    passed = F.col("passed")
    checks = [F.struct(F.lit(k).alias("label"), v.alias("ok")) for k, v in oks.items()]
    tier = F.when(passed == len(oks), "candidate").when(passed == len(oks) - 1, "watch").otherwise("")
    total = F.lit(len(oks))
    if "holdout_trades" in df.columns:
        known = F.col("holdout_trades").isNotNull()
        held = F.coalesce((F.col("holdout_expectancy_R") > 0) & (F.col("holdout_trades") >= 30), F.lit(False))
        tier = F.when(known & ~held, "").when(known & held & (passed == len(oks)), "confirmed").otherwise(tier)
        total = total + known.cast("int")
    return df.withColumns({"checks": F.array(*checks), "total": total, "tier": tier})


def holdout_verdict() -> Column:
    """Of holdout_trades, holdout_expectancy_R against expectancy_R; NULL without a holdout."""
    e = F.col("holdout_expectancy_R")
    return F.when(F.col("holdout_trades").isNull(), None).when(F.col("holdout_trades") < 30, "INCONCLUSIVE").when(e <= 0, "FAILED").when(e < 0.5 * F.col("expectancy_R"), "WEAK").otherwise("HELD UP")

