"""The search loop: propose unseen genomes in batches, reserve, evaluate, record, and keep niched elites; and the tools on its registry."""

from __future__ import annotations

import json
import logging
import signal
import time
import traceback
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.registry import REJECTED, Registry, niched_elites, stats, top
from . import genome as G
from . import report
from .evaluate import Evaluator, Result, Settings

log = logging.getLogger(__name__)
FIGURES = ["trades", "expectancy_R", "sharpe", "recovery_factor", "payoff_ratio", "t_stat", "trades_per_year", "avg_win_R", "avg_loss_R", "fold_folds", "fold_fold_win_rate", "fold_concentration"]


@dataclass
class Options:
    """Settings of the search itself."""

    seed: int = 7
    warmup: int = 60
    elite_k: int = 25
    p_crossover: float = 0.25
    batch: int = 8
    max_duplicate_tries: int = 400
    report_every: int = 10
    out_dir: str | None = None

    @classmethod
    def of(cls, config: dict) -> Options:
        s = config.get("search", {})
        return cls(**{k: s[k] for k in ("seed", "warmup", "elite_k", "p_crossover", "max_duplicate_tries", "report_every") if k in s}, out_dir=config.get("output", {}).get("dir"))


def decoded(state: DataFrame) -> DataFrame:
    """The registry's state with what niches read: rr and session of the genome."""
    gene = lambda g: F.get_json_object("genome", f"$['{g}']")
    return state.withColumns({"rr": F.try_divide(gene("label.tp_mult").cast("double"), gene("label.sl_mult").cast("double")), "session": gene("filter.session")})


class Search:
    def __init__(self, evaluator: Evaluator, registry: Registry, options: Options | None = None):
        self.evaluator, self.registry, self.options = evaluator, registry, options or Options()
        self.rng, self.stopped, self.accepted, self.duplicates, self.best = np.random.default_rng(self.options.seed), False, 0, 0, None

    def stop_on_signals(self) -> None:
        """The first interrupt lets the running genome end, the second one ends the process as usual."""

        def asked(number, frame):
            if self.stopped:
                raise KeyboardInterrupt
            self.stopped = True

        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, asked)

    def elites(self) -> list[dict]:
        rows = niched_elites(decoded(self.registry.latest()), self.options.elite_k).select("genome", "fingerprint", "generation").collect()
        return [{"genome": json.loads(r["genome"]), "fingerprint": r["fingerprint"], "generation": r["generation"] or 0} for r in rows]

    def next_unseen(self, n: int) -> list[dict]:
        """Up to n reserved candidates that the registry doesn't know; each further draw is more desperate."""
        o, elites, taken, tries = self.options, self.elites(), [], 0
        warm = (stats(self.registry.latest()).first()["ok"] or 0) >= o.warmup
        while len(taken) < n and tries < o.max_duplicate_tries:
            drawn = G.propose(elites, n - len(taken), self.rng, tries / o.max_duplicate_tries, warm, o.p_crossover)
            rows = [(G.fingerprint(g), json.dumps(g, sort_keys=True), generation, origin, parents) for g, origin, generation, parents in drawn]
            frame = self.registry.spark.createDataFrame(rows, "fingerprint string, genome string, generation int, origin string, parents array<string>")
            new = self.registry.reserve(frame).collect()
            self.duplicates += len(drawn) - len(new)
            taken += [r.asDict() for r in new]
            tries += n
        return taken

    def run(self, iterations: int) -> int:
        """Evaluates ``iterations`` genomes (0: until stopped); returns how many were accepted."""
        self.registry.sweep()
        done, began, dry = 0, time.time(), 0
        while not self.stopped and (not iterations or done < iterations):
            todo = self.next_unseen(min(self.options.batch, iterations - done) if iterations else self.options.batch)
            dry = 0 if todo else dry + 1
            if not todo:
                log.warning("no unseen genome found in %d draws", self.options.max_duplicate_tries)
                if dry > 3:
                    break
            for r in todo:
                if self.stopped:
                    break
                self._one(r)
                done += 1
                if done % self.options.report_every == 0:
                    self.checkpoint(began)
        self.checkpoint(began)
        return self.accepted

    def _one(self, r: dict) -> None:
        began, f, spark = time.time(), r["fingerprint"], self.registry.spark
        try:
            result = self.evaluator.evaluate(json.loads(r["genome"]))
        except Exception:
            self.registry.fail(spark.createDataFrame([(f, traceback.format_exc())], "fingerprint string, error string"))
            log.exception("%s failed", f)
            return
        m, why = result.metrics, gate(result, self.evaluator.settings)
        row = spark.createDataFrame([(f, float(m["score"]), json.dumps(m, default=str), time.time() - began, why)], "fingerprint string, score double, metrics string, eval_secs double, error string")
        if why:
            self.registry.reject(row.drop("score"))
            log.info("%s rejected: %s", f, why)
            return
        self.registry.complete(row)
        self.accepted += 1
        best = self.best is None or m["score"] >= self.best - 1e-9
        self.best = m["score"] if best else self.best
        log.info("%s score %+.4f, %d trades, %+.3fR%s", f, m["score"], m["trades"], m["expectancy_R"], ", new best" if best else "")
        if best and self.options.out_dir:
            report.write_strategy(self.options.out_dir, r, result, stats(self.registry.latest()).first()["total"], self.evaluator.settings.min_trades)

    def checkpoint(self, began: float) -> None:
        self.registry.set_meta("last_checkpoint", str(time.time()))
        rate = self.accepted / max(time.time() - began, 1e-9) * 3600
        if self.options.out_dir:
            extra = {"evaluated this run": self.accepted, "duplicates avoided": self.duplicates, "accepted an hour": round(rate, 1)}
            report.write_leaderboard(self.options.out_dir, self.registry.latest(), self.evaluator.settings.min_trades, extra)


def gate(result: Result, s: Settings) -> str | None:
    """Why a result isn't accepted, or None."""
    m = result.metrics
    if m.get("reject_reason"):
        return m["reject_reason"]
    if len(result.folds) < s.min_folds:
        return f"only {len(result.folds)} usable folds, {s.min_folds} are needed"
    return f"only {m['trades']} trades, {s.min_trades} are needed" if m["trades"] < s.min_trades else None


def rescored(state: DataFrame, min_trades: int = 100) -> DataFrame:
    """fingerprint, old, new: the score that the recorded metrics give. A t-statistic or payoff that older records lack follows
    from the others."""
    df = state.where("status = 'ok'").select("fingerprint", F.col("score").alias("old"), *(F.get_json_object("metrics", f"$.{n}").cast("double").alias(n) for n in FIGURES))
    per_year, payoff = F.coalesce("trades_per_year", F.lit(0.0)), F.try_divide("avg_win_R", F.abs("avg_loss_R"))
    t = F.when(per_year > 0, F.bround(F.coalesce("sharpe", F.lit(0.0)) / F.sqrt(per_year) * F.sqrt(F.coalesce("trades", F.lit(0.0))), 3)).otherwise(0.0)
    df = df.withColumns({"t_stat": F.coalesce("t_stat", t), "payoff_ratio": F.coalesce("payoff_ratio", F.when(F.col("avg_loss_R") < -1e-9, F.bround(payoff, 3)).otherwise(F.when(F.col("avg_win_R") > 0, 10.0).otherwise(0.0)))})
    df = df.withColumns({"folds": F.coalesce("fold_folds", F.lit(0.0)), "fold_win_rate": F.coalesce("fold_fold_win_rate", F.lit(0.0)), "concentration": F.coalesce("fold_concentration", F.lit(1.0))}).na.fill(0.0)
    return df.withColumn("score", M.composite(min_trades)).select("fingerprint", "old", F.bround(M.haircut(), 5).alias("new"))


def rescore(registry: Registry, min_trades: int = 100, dry_run: bool = False) -> DataFrame:
    """Records the scores that change; returns them."""
    changed = rescored(registry.latest(), min_trades).where(F.abs(F.col("new") - F.coalesce("old", F.lit(0.0))) > 1e-9)
    rows = registry.spark.createDataFrame(changed.collect(), changed.schema)  # a registry's completed strategies
    if not dry_run:
        registry.append(rows.select("fingerprint", F.col("new").alias("score")))
    return rows


def revalidate(evaluator: Evaluator, registry: Registry, n: int = 40) -> int:
    """Marks accepted strategies as legacy and evaluates the best n again; returns how many are accepted again."""
    best = top(registry.latest(), n).select("fingerprint", "genome").collect()
    registry.append(registry.latest().where("status = 'ok'").select("fingerprint", F.lit("legacy").alias("status")))
    restored = 0
    for r in best:
        began = time.time()
        result = evaluator.evaluate(json.loads(r["genome"]))
        m, why = result.metrics, gate(result, evaluator.settings)
        row = [(r["fingerprint"], REJECTED if why else float(m["score"]), json.dumps(m, default=str), time.time() - began, why)]
        row = registry.spark.createDataFrame(row, "fingerprint string, score double, metrics string, eval_secs double, error string")
        registry.reject(row) if why else registry.complete(row)
        restored += not why
    return restored


def hold_out(evaluator: Evaluator, registry: Registry, fingerprints: list[str]) -> list[dict]:
    """Evaluates strategies on the held-out months, adds the figures to their metrics and returns fingerprint, in, out, verdict."""
    if evaluator.searchable >= evaluator.n:
        raise ValueError("no months are held out")
    span = evaluator.features.where(F.col("bar_idx") >= evaluator.searchable).agg(F.min("ts"), F.max("ts")).first()
    out = []
    for f in fingerprints:
        known = registry.get(f).first()
        if known is None:
            out.append({"fingerprint": f, "verdict": "unknown"})
            continue
        before, m = json.loads(known["metrics"] or "{}"), evaluator.evaluate(json.loads(known["genome"]), holdout=True).metrics
        if m.get("reject_reason"):
            out.append({"fingerprint": f, "verdict": m["reject_reason"]})
            continue
        added = {f"holdout_{k}": m[k] for k in ("trades", "expectancy_R", "payoff_ratio", "total_R", "t_stat")} | {"holdout_from": str(span[0])[:10], "holdout_to": str(span[1])[:10]}
        figures = registry.spark.createDataFrame([(f, m["trades"], float(m["expectancy_R"]), float(before.get("expectancy_R", 0.0)), json.dumps(before | added))], "fingerprint string, holdout_trades bigint, holdout_expectancy_R double, expectancy_R double, metrics string")
        registry.append(figures.select("fingerprint", "metrics"))
        out.append({"fingerprint": f, "in": before, "out": m, "verdict": figures.select(M.holdout_verdict()).first()[0]})
    return out
