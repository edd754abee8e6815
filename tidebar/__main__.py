"""python -m tidebar search|status|report|holdout|rescore|revalidate|reset [--config FILE] ..."""

from __future__ import annotations

import argparse
import json
import logging
import os
import shutil
import sys

from pyspark.sql import SparkSession

from . import config as C
from .operators.registry import Registry, stats, top
from .plans import report
from .plans import search as S
from .plans.evaluate import Evaluator, Settings
from .plans.genome import describe
from .sources.csv_bars import load_bars


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidebar", description=__doc__)
    p.add_argument("command", choices=["search", "status", "report", "holdout", "rescore", "revalidate", "reset"])
    p.add_argument("fingerprint", nargs="*")
    p.add_argument("--config")
    p.add_argument("--iters", type=int, default=0, help="0: until stopped")
    p.add_argument("--top", type=int, default=0)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--yes", action="store_true", help="reset without asking")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def set_up_logging(cfg: dict, verbose: bool) -> None:
    os.makedirs(cfg["output"]["dir"], exist_ok=True)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if file := cfg["output"].get("log_file"):
        os.makedirs(os.path.dirname(file) or ".", exist_ok=True)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)
    logging.getLogger("tidebar").setLevel(logging.DEBUG if verbose else logging.INFO)


def status(registry: Registry) -> str:
    s = stats(registry.latest()).first().asDict()
    lines = [json.dumps(s, default=str)]
    for i, r in enumerate(top(registry.latest(), 15).collect(), 1):
        m = json.loads(r["metrics"] or "{}")
        lines.append(f"{i:3} {r['fingerprint']} {r['score']:+.4f} {m.get('trades', 0):6} trades {m.get('expectancy_R', 0):+.3f}R {m.get('total_R', 0):+8.1f}R  {describe(json.loads(r['genome']))}")
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    cfg = C.load(a.config)
    set_up_logging(cfg, a.verbose)
    spark = spark or SparkSession.builder.appName("tidebar").getOrCreate()
    out_dir = cfg["output"]["dir"]
    path = os.path.join(os.path.abspath(out_dir), "registry")
    if a.command == "reset":
        if a.yes or input(f"Delete {path}? [y/N] ").strip().lower() == "y":
            for x in (path, f"{path}_runs", f"{path}_meta"):
                shutil.rmtree(x, ignore_errors=True)
        return 0
    registry = Registry(spark, f"file://{path}")
    if a.command == "status":
        print(status(registry))
        return 0
    if a.command == "rescore":
        for r in S.rescore(registry, cfg["search"]["min_trades"], a.dry_run).collect():
            print(f"{r['fingerprint']} {r['old']} -> {r['new']}")
        return 0
    d = cfg["data"]
    cache = None if a.no_cache else os.path.join(out_dir, "cache")
    bars = load_bars(spark, d["path"], d["timeframe"], d["source"], d["start"], d["end"], cache, d["cache_max_age_hours"], **({"source_tz": d["source_tz"]} if d["source"] == "csv" else {}))
    have, need = bars.count(), C.bars_needed(cfg)
    if have < need:
        logging.error("%d bars are too few for the walk-forward settings, which need %d", have, need)
        return 1
    evaluator = Evaluator(bars, Settings.of(cfg))
    names = a.fingerprint or [r["fingerprint"] for r in top(registry.latest(), a.top).collect()]
    if a.command == "search":
        registry.start_run(cfg, f"timeframe {d['timeframe']}")
        search = S.Search(evaluator, registry, S.Options.of(cfg))
        search.stop_on_signals()
        print(f"{search.run(a.iters)} accepted")
    elif a.command == "report":
        for f in names:
            known = registry.get(f).first()
            if known is None:
                logging.error("unknown strategy %s", f)
                return 1
            result = evaluator.evaluate(json.loads(known["genome"]))
            print(report.write_strategy(out_dir, known.asDict(), result, stats(registry.latest()).first()["total"], cfg["search"]["min_trades"]))
        print(report.write_leaderboard(out_dir, registry.latest(), cfg["search"]["min_trades"]))
    elif a.command == "holdout":
        for r in S.hold_out(evaluator, registry, names):
            figures = [f"{k} {r['in'].get(k, 0)} -> {r['out'][k]}" for k in ("trades", "win_rate", "expectancy_R", "payoff_ratio", "total_R", "max_dd_R", "sharpe", "t_stat")] if "out" in r else []
            print("; ".join([r["fingerprint"], *figures, r["verdict"]]))
    else:
        print(f"{S.revalidate(evaluator, registry, a.top or 40)} accepted again")
    return 0


if __name__ == "__main__":
    sys.exit(main())
