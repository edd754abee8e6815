"""Walk-forward evaluation of genomes: features, labels, one model a fold, filters, the trade walk, metrics and score."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.tables import cut
from ..operators import features, labels, metrics, walk
from . import boosting

#: Rows that a fold needs to learn from, rows of a class, and the share of features a row to learn from must have.
MIN_TRAIN, MIN_CLASS, KNOWN = 300, 10, 0.8
#: Trades below which a screen doesn't judge the edge, and the slack with which a pace of trades is carried on.
SCREEN_TRADES, SLACK = 60, 3.0


@dataclass
class Settings:
    """The walk-forward, cost and screening settings of an evaluation."""

    train: int = 8000
    test: int = 1500
    max_folds: int = 24
    anchored: bool = False
    holdout_months: int = 0
    cost: float = 1.0
    min_trades: int = 100
    min_folds: int = 3
    screen_folds: int = 0
    screen_z: float = 2.0
    seed: int = 7
    backend: str | None = None

    @classmethod
    def of(cls, config: dict) -> Settings:
        w, s = config.get("walkforward", {}), config.get("search", {})
        own = {"train": w.get("train_bars"), "test": w.get("test_bars"), "max_folds": w.get("max_folds"), "anchored": w.get("anchored"), "holdout_months": w.get("holdout_months"), "cost": config.get("costs", {}).get("round_trip_points"), "backend": config.get("model", {}).get("backend")}
        own |= {k: s.get(k) for k in ("min_trades", "min_folds", "screen_folds", "screen_z", "seed")}
        return cls(**{k: v for k, v in own.items() if v is not None})


@dataclass
class Result:
    """metrics (a dict with score, fold figures and reject_reason), trades, a row of metrics a fold, and importance."""

    metrics: dict
    trades: DataFrame | None = None
    folds: list[dict] = field(default_factory=list)
    importance: dict[str, float] = field(default_factory=dict)


def rejected(why: str) -> Result:
    zero = {"trades": 0, "win_rate": 0.0, "avg_R": 0.0, "avg_win_R": 0.0, "avg_loss_R": 0.0, "expectancy_R": 0.0, "total_R": 0.0, "max_dd_R": 0.0, "recovery_factor": 0.0, "sharpe": 0.0, "profit_factor": 0.0, "payoff_ratio": 0.0, "t_stat": 0.0, "max_losing_streak": 0, "trades_per_year": 0.0, "span_days": 0.0, "best_R": 0.0, "worst_R": 0.0, "score": metrics.EMPTY_SCORE}
    return Result(zero | {"reject_reason": why})


class Evaluator:
    """What doesn't depend on a genome (features, filter inputs, labels of each geometry) is kept, so that another genome is cheap."""

    def __init__(self, bars: DataFrame, settings: Settings):
        self.settings, self._labels = settings, {}
        self.features = cut(features.build_features(bars))
        self.n = self.searchable = self.features.count()
        if settings.holdout_months and self.n:
            self.searchable = int(walk.holdout_cut(self.features.select("symbol", "ts"), settings.holdout_months).first()["cut_idx"])

    def labelled(self, g: dict) -> DataFrame:
        """The features with labels of the genome's geometry, from the memo if it has been asked for."""
        key = tuple(g[k] for k in ("label.atr_period", "label.tp_mult", "label.sl_mult", "label.max_bars"))
        if key not in self._labels:
            n, tp, sl, bars = key
            ohlc = R.in_pieces(self.features.select("symbol", "bar_idx", "open", "high", "low", "close"), lambda d: d.withColumn("__tr", R.true_range()), 1)
            own = labels.triple_barrier(R.scans(ohlc, {"atr": ("__tr", 1 / n, 0, n)}), tp, sl, int(bars), self.settings.cost)
            own = own.select("symbol", "bar_idx", "entry_price", "valid", "label", *(f"{s}_{x}" for s in ("long", "short") for x in ("stop", "target", "R", "exit")))
            if len(self._labels) >= 64:
                self._labels.pop(next(iter(self._labels)))
            self._labels[key] = cut(own)
        return self.features.join(self._labels[key], ["symbol", "bar_idx"])

    def plan(self, max_bars: int, holdout: bool) -> list[tuple]:
        s = self.settings
        if not holdout:
            return walk.folds(self.searchable, s.train, s.test, max_bars, s.max_folds or None, s.anchored)
        hi = self.searchable - max_bars - 1
        lo = 0 if s.anchored else max(0, hi - s.train)
        return [(0, lo, hi, self.searchable, self.n)] if self.searchable < self.n and hi - lo >= max(200, s.train // 4) else []

    def evaluate(self, g: dict, holdout: bool = False) -> Result:
        s, max_bars, cols = self.settings, int(g["label.max_bars"]), features.select_columns(g["feat.groups"])
        if len(cols) < 3:
            return rejected("too few features")
        plan = self.plan(max_bars, holdout)
        if not plan:
            return rejected("no held-out period" if holdout else "not enough bars for a fold")
        df = self.labelled(g)
        mask = walk.static_mask(g["filter.session"], g["filter.adx_min"], g["filter.atr_pct_min"], g["filter.atr_pct_max"])
        if not holdout:
            admitted = walk.in_test(self.features, plan).where(mask).count()
            if not walk.capacity(admitted, max_bars, s.min_trades):
                return rejected(f"filters admit only {admitted} test bars, too few for {s.min_trades} trades")
        stages = [[f[0] for f in plan]]
        if not holdout and s.screen_folds >= 3 and len(plan) >= 2 * s.screen_folds:
            first = sorted({int(i * len(plan) / s.screen_folds) for i in range(s.screen_folds)})
            stages = [first, [f[0] for f in plan if f[0] not in first]]
        found, counts, gains = [], [], np.zeros(len(cols))
        for k, ids in enumerate(stages):
            scored = cut(score_folds(df, [f for f in plan if f[0] in ids], cols, g, s))
            notes = scored.where("bar_idx < 0").collect()
            for r in notes:
                total = sum(r["gain"])
                gains += np.array(r["gain"]) / total if total > 0 else 0.0
            found.append(cut(self._trades(df, scored, g, mask)))
            by_fold = {r["fold"]: r["count"] for r in found[-1].groupBy("fold").count().collect()}
            counts += [(r["fold"], by_fold.get(r["fold"], 0)) for r in sorted(notes, key=lambda r: ids.index(r["fold"]))]
            why = None if holdout else hopeless([c for _, c in counts], len(plan), s.min_trades)
            if not why and k == 0 and len(stages) > 1:
                why = screen(found[0], sum(c for _, c in counts), len(ids), len(plan), s)
            if why:
                return rejected(why)
        trades = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return self._result(trades, sorted(f for f, _ in counts), gains, cols)

    def _trades(self, df: DataFrame, scored: DataFrame, g: dict, mask) -> DataFrame:
        p = scored.where("bar_idx >= 0").select("symbol", "fold", "bar_idx", "p_long", "p_short")
        rows = df.join(p, ["symbol", "bar_idx"]).where(mask)
        rows = rows.withColumn("direction", walk.signal(g["signal.long_thresh"], g["signal.short_thresh"], g["signal.edge_margin"], g["signal.allow_long"], g["signal.allow_short"]))
        if g["filter.trend_align"]:
            rows = rows.where(walk.trend_aligned(F.col("direction")))
        cands = walk.candidates(rows).select("symbol", "fold", "bar_idx", "exit_idx", "session_date", "ts", "direction", "R", "confidence", "entry_price", "long_stop", "short_stop", "long_target", "short_target")
        return walk.trade_log(walk.one_position(cands, ["symbol", "fold"], int(g["filter.max_trades_per_day"])), self.features)

    def _result(self, trades: DataFrame, fitted: list[int], gains: np.ndarray, cols: list[str]) -> Result:
        spark, least = trades.sparkSession, self.settings.min_trades
        own = trades.withColumn("__all", F.lit(1))
        total = metrics.with_empty(metrics.r_metrics(own, ["__all"], ["fold", "signal_time"], least), spark.range(1).select(F.lit(1).alias("__all")), ["__all"])
        folds = spark.createDataFrame([(f,) for f in fitted], "fold int")
        by_fold = metrics.with_empty(metrics.r_metrics(trades, ["fold"], ["signal_time"], least), folds, ["fold"])
        same = metrics.fold_consistency(by_fold.withColumn("__all", F.lit(1)), ["__all"])
        one = lambda d: {k: v for k, v in d.first().asDict().items() if k != "__all"}
        row = total.join(same, "__all", "left").na.fill({"folds": 0, "folds_profitable": 0, "fold_win_rate": 0.0, "worst_fold_R": 0.0, "fold_R_std": 0.0, "concentration": 1.0}).withColumn("score", F.bround(metrics.haircut(), 5))
        named = {(f"fold_{k}" if k in same.columns else k): v for k, v in one(row).items()}
        whole = gains.sum()
        share = {c: round(float(x / whole), 5) for c, x in zip(cols, gains, strict=True)} if whole > 0 else {}
        return Result(named | {"reject_reason": None}, trades, [r.asDict() for r in by_fold.orderBy("fold").collect()], dict(sorted(share.items(), key=lambda x: -x[1])))


def score_folds(df: DataFrame, plan: list[tuple], cols: list[str], g: dict, s: Settings) -> DataFrame:
    """symbol, fold, bar_idx, p_long, p_short of the test bars of each fold that can be learned, and a row a fold with bar_idx -1
    and the features' gain. Folds are learned side by side, one in a task: a training window has a bounded number of bars."""
    known = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) / len(cols)
    windows = walk.fold_frame(df.sparkSession, plan)
    rows = df.select("symbol", "bar_idx", "valid", F.col("label").cast("int").alias("label"), known.alias("known"), *cols).where("valid and known > 0")
    rows = rows.join(F.broadcast(windows), (F.col("bar_idx") >= F.col("tr_lo")) & (F.col("bar_idx") < F.col("te_hi")))
    rows = rows.withColumn("learn", F.col("bar_idx") < F.col("tr_hi")).where(F.when(F.col("learn"), F.col("known") > KNOWN).otherwise(F.col("bar_idx") >= F.col("te_lo")))
    rows = rows.drop("valid", "known", "tr_lo", "tr_hi", "te_lo", "te_hi").na.fill(0.0, cols)
    seed, backend = s.seed, s.backend

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bar_idx")
        own, test = pdf[pdf["learn"]], pdf[~pdf["learn"]]
        y = own["label"].to_numpy()
        classes = [c for c in (-1, 0, 1) if (y == c).sum() >= MIN_CLASS]
        empty = pd.DataFrame({"symbol": [], "fold": [], "bar_idx": [], "p_long": [], "p_short": [], "gain": []})
        if len(own) < MIN_TRAIN or len(classes) < 2 or not len(test):
            return empty
        model = boosting.make(g, seed, backend).fit(own[cols].to_numpy(float), y, classes)
        p = model.predict(test[cols].to_numpy(float))
        side = lambda c: p[:, classes.index(c)] if c in classes else np.zeros(len(test))
        out = pd.DataFrame({"symbol": test["symbol"], "fold": test["fold"], "bar_idx": test["bar_idx"], "p_long": side(1), "p_short": side(-1), "gain": None})
        note = pd.DataFrame({"symbol": [test["symbol"].iloc[0]], "fold": [test["fold"].iloc[0]], "bar_idx": [-1], "p_long": [0.0], "p_short": [0.0], "gain": [model.gain.tolist()]})
        return pd.concat([note, out])

    return rows.groupBy("symbol", "fold").applyInPandas(learn, "symbol string, fold int, bar_idx bigint, p_long double, p_short double, gain array<double>")


def hopeless(counts: list[int], n_folds: int, min_trades: int) -> str | None:
    """Why the trades of the folds so far, in the order in which they were judged, can't reach the least number, if so.

    Asked after each fold from the third on, in the second half of the folds, but for the last one.
    """
    for done in range(max(3, -(-n_folds // 2)), min(len(counts), n_folds - 1) + 1):
        n = sum(counts[:done])
        if n / done * n_folds * SLACK < min_trades:
            return f"only {n} trades after {done}/{n_folds} folds, {min_trades} can't be reached"
    return None


def screen(trades: DataFrame, n: int, screened: int, n_folds: int, s: Settings) -> str | None:
    """Why the folds of the first stage rule a genome out: too slow a pace, or a loss beyond ``screen_z`` standard errors."""
    if n / max(screened, 1) * n_folds * SLACK < s.min_trades:
        return f"screened out: {n} trades on {screened}/{n_folds} folds, {s.min_trades} can't be reached"
    r = trades.agg(F.count("R").alias("n"), F.avg("R").alias("mean"), F.stddev_samp("R").alias("sd")).first()
    if n < SCREEN_TRADES or r["n"] < SCREEN_TRADES:
        return None
    upper = r["mean"] + s.screen_z * r["sd"] / r["n"] ** 0.5
    return f"screened out: {r['mean']:+.3f}R over {n} trades on {screened}/{n_folds} folds" if upper < 0 else None
