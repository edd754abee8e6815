"""Bounded reports: leaderboard and strategy pages with verdicts, equity curves, trade logs and genome files."""

from __future__ import annotations

import html
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.registry import stats, top
from .genome import describe

MAX_ROWS, PREVIEW, IMPORTANT = 60, 15, 30
_CARDS = ["score", "trades", "win_rate", "expectancy_R", "total_R", "max_dd_R", "sharpe", "profit_factor", "payoff_ratio", "avg_win_R", "avg_loss_R", "max_losing_streak", "recovery_factor"]
_STYLE = "body{font:14px sans-serif;margin:2em;max-width:75em}table{border-collapse:collapse}td,th{padding:3px 9px;text-align:right;border-bottom:1px solid #ddd}.card{display:inline-block;border:1px solid #ccc;padding:6px 12px;margin:3px}.candidate,.confirmed{background:#d9f2d9}.watch{background:#fff3cd}.no{color:#a00}.bar{display:inline-block;height:9px;background:#36c}.note{border:1px solid #c90;padding:9px}"


def equity(trades: DataFrame, keys: list[str], order: list[str], points: int = 1400) -> DataFrame:
    """keys, n, equity, peak at every k-th trade and the last, so that a curve has about ``points`` points."""
    w = Window.partitionBy(*keys).orderBy(*order)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    df = trades.withColumns({"n": F.row_number().over(w), "equity": F.sum("R").over(to_here), "__size": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    df = df.withColumn("peak", F.greatest(F.max("equity").over(to_here), F.lit(0.0)))
    step = F.greatest(F.lit(1), F.ceil(F.col("__size") / points))
    return df.where(((F.col("n") - 1) % step == 0) | (F.col("n") == F.col("__size"))).select(*keys, "n", "equity", "peak")


def equity_svg(points: list[tuple[float, float]], width: int = 900, height: int = 240) -> str:
    if not points:
        return "<svg/>"
    values = [v for p in points for v in p] + [0.0]
    low, span = min(values), (max(values) - min(values)) or 1.0
    x = lambda i: i / max(1, len(points) - 1) * width
    y = lambda v: height - (v - low) / span * height
    line = lambda k: " ".join(f"{x(i):.1f},{y(p[k]):.1f}" for i, p in enumerate(points))
    return f'<svg viewBox="0 0 {width} {height}"><polyline fill="none" stroke="#999" stroke-dasharray="4" points="{line(1)}"/><polyline fill="none" stroke="#06c" points="{line(0)}"/></svg>'


def _cell(v) -> str:
    return v if isinstance(v, _Raw) else html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))


class _Raw(str):
    """Text that is HTML already."""


def _table(head: list[str], rows: list[list], classes: list[str] | None = None) -> str:
    body = "".join(f'<tr class="{c}">' + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r, c in zip(rows, classes or [""] * len(rows), strict=True))
    return f"<table><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in head)}</tr>{body}</table>"


def _cards(items: dict) -> str:
    return "".join(f'<div class="card">{html.escape(str(k))}<br><b>{_cell(v)}</b></div>' for k, v in items.items())


def _page(title: str, body: str) -> str:
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style><h1>{html.escape(title)}</h1>{body}'


def verdicts(spark: SparkSession, records: list[dict], tried: int, min_trades: int) -> list[dict]:
    """tier, passed, total, failing of recorded metrics (at most MAX_ROWS of them), by the same checks as ``assess``."""
    if not records:
        return []
    need = {"expectancy_R": 0.0, "t_stat": 0.0, "payoff_ratio": 0.0, "trades": 0.0, "fold_fold_win_rate": 0.0, "fold_concentration": 1.0, "recovery_factor": 0.0}
    held = ["holdout_trades", "holdout_expectancy_R"]
    rows = [(i, *(float(m.get(k, d)) for k, d in need.items()), *(None if k not in m else float(m[k]) for k in held)) for i, m in enumerate(records)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{k} double" for k in [*need, *held]))
    df = df.withColumnsRenamed({"fold_fold_win_rate": "fold_win_rate", "fold_concentration": "concentration"})
    found = M.assess(df, F.lit(max(tried, 0)), min_trades).orderBy("i").select("tier", "passed", "total", "checks").collect()
    return [{"tier": r["tier"], "passed": r["passed"], "total": r["total"], "failing": [c["label"] for c in r["checks"] if not c["ok"]]} for r in found]


def leaderboard(state: DataFrame, min_trades: int = 100, extra: dict | None = None, n: int = MAX_ROWS, have: set[str] = frozenset()) -> str:
    """The page of the best strategies: cards, a banner (finds, or the nearest miss and what it lacks), and the table.
    Strategies in ``have`` are linked to their pages."""
    s = stats(state).first()
    best = [r.asDict() for r in top(state, min(n, MAX_ROWS)).collect()]
    metrics = [json.loads(r["metrics"] or "{}") for r in best]
    judged = verdicts(state.sparkSession, metrics, s["total"] or 0, min_trades)
    link = lambda f: _Raw(f'<a href="strategies/{f}.html">{f}</a>') if f in have else f
    bar = state.sparkSession.range(1).select(M.noise_ceiling(F.lit(s["total"] or 0)) + M.T_MARGIN).first()[0]
    finds = [(r, m, v) for r, m, v in zip(best, metrics, judged, strict=True) if v["tier"] in ("candidate", "confirmed")]
    banner = "".join(f'<div class="{v["tier"]}"><h3>{v["tier"]}: {link(r["fingerprint"])}</h3>{_name(r)}, {m.get("trades", 0)} trades, t {m.get("t_stat", 0):.2f} of {bar:.2f}</div>' for r, m, v in finds[:5])
    if best and not finds:
        near = max(zip(best, judged, strict=True), key=lambda x: (x[1]["passed"], x[0]["score"]))
        banner = f'<div class="note"><h3>No find yet</h3>Nearest is {link(near[0]["fingerprint"])} with {near[1]["passed"]} of {near[1]["total"]} checks; it lacks: {", ".join(near[1]["failing"])}. The t-statistic needed is {bar:.2f} after {s["total"]} strategies.</div>'
    head = ["rank", "fingerprint", "verdict", "score", "trades", "win rate", "expectancy", "reward/risk", "total R", "max DD", "sharpe", "profit factor", "folds won", "generation", "origin", "strategy"]
    figures = ["trades", "win_rate", "expectancy_R", "payoff_ratio", "total_R", "max_dd_R", "sharpe", "profit_factor"]
    rows = [[i + 1, link(r["fingerprint"]), v["tier"] or f"{v['passed']}/{v['total']}", r["score"], *(m.get(k, 0) for k in figures), f"{m.get('fold_folds_profitable', 0)}/{m.get('fold_folds', 0)}", r["generation"], r["origin"], _name(r)] for i, (r, m, v) in enumerate(zip(best, metrics, judged, strict=True))]
    cards = {"tried": s["total"], "accepted": s["ok"], "rejected": s["rejected"], "failed": s["failed"], "best score": s["best_score"], "generation": s["max_generation"], "seconds each": s["avg_secs"]} | (extra or {})
    return _page("Leaderboard", time.strftime("%Y-%m-%d %H:%M:%S") + _cards(cards) + banner + _table(head, rows, [v["tier"] for v in judged]))


def _name(r: dict) -> str:
    try:
        return describe(json.loads(r["genome"]))
    except (KeyError, TypeError, ValueError):
        return ""


def strategy_page(record: dict, result, tried: int, min_trades: int) -> str:
    m, trades = result.metrics, result.trades
    parts = [f"<p>{html.escape(_name(record))}; {record.get('origin') or '?'}, generation {record.get('generation') or 0}</p>"]
    if trades is not None:
        v = verdicts(trades.sparkSession, [m], tried, min_trades)[0]
        lacks = f"; it lacks: {', '.join(v['failing'])}" if v["failing"] else ""
        parts.append(f'<div class="{v["tier"] or "note"}"><b>{v["tier"] or "verdict"}</b>: {v["passed"]} of {v["total"]} checks{lacks}</div>')
    parts.append(_cards({k: m.get(k, 0) for k in _CARDS}))
    if trades is not None:
        curve = equity(trades, ["symbol"], ["fold", "signal_time"]).orderBy("n").select("equity", "peak").collect()
        parts.append("<h2>Equity in R</h2>" + equity_svg([tuple(r) for r in curve]))
    cols = ["fold", "trades", "win_rate", "expectancy_R", "total_R", "max_dd_R"]
    parts.append("<h2>Folds</h2>" + _table(cols, [[f[c] for c in cols] for f in result.folds]))
    share = list(result.importance.items())[:IMPORTANT]
    most = max((x for _, x in share), default=0) or 1
    parts.append("<h2>Importance</h2>" + _table(["feature", "share", ""], [[k, x, _Raw(f'<span class="bar" style="width:{220 * x / most:.0f}px"></span>')] for k, x in share]))
    if trades is not None:
        ends = [trades.orderBy(o).limit(PREVIEW).collect() for o in ("signal_time", F.desc("signal_time"))]
        rows = list(dict.fromkeys([*ends[0], *reversed(ends[1])]))
        parts.append("<h2>First and last trades</h2>" + _table(trades.columns, [list(r) for r in rows]))
    return _page(f"Strategy {record['fingerprint']}", "".join(parts) + f"<h2>Genome</h2><pre>{html.escape(json.dumps(json.loads(record['genome']), indent=1))}</pre>")


def write_trades(trades: DataFrame, path: str) -> None:
    """One CSV file in the folder ``path``: one strategy's trades, a bounded number."""
    trades.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_strategy(out_dir: str, record: dict, result, tried: int, min_trades: int) -> str:
    """The strategy's page, its trades as CSV, and a JSON of genome and metrics, on the driver; returns the page's path."""
    folder = os.path.join(out_dir, "strategies")
    os.makedirs(folder, exist_ok=True)
    base = os.path.join(folder, record["fingerprint"])
    if result.trades is not None:
        result.trades.orderBy("fold", "signal_time").toPandas().to_csv(f"{base}_trades.csv", index=False)
    with open(f"{base}_genome.json", "w", encoding="utf-8") as f:
        json.dump({"fingerprint": record["fingerprint"], "genome": json.loads(record["genome"]), "metrics": result.metrics}, f, indent=1, default=str)
    with open(f"{base}.html", "w", encoding="utf-8") as f:
        f.write(strategy_page(record, result, tried, min_trades))
    return f"{base}.html"


def write_leaderboard(out_dir: str, state: DataFrame, min_trades: int = 100, extra: dict | None = None) -> str:
    folder = os.path.join(out_dir, "strategies")
    have = {x.removesuffix(".html") for x in os.listdir(folder) if x.endswith(".html")} if os.path.isdir(folder) else set()
    os.makedirs(out_dir, exist_ok=True)
    path = os.path.join(out_dir, "leaderboard.html")
    with open(path, "w", encoding="utf-8") as f:
        f.write(leaderboard(state, min_trades, extra, have=have))
    return path
