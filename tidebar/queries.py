"""Named queries over the driver's tables, and the same in DuckDB SQL.

``events`` are ticks: symbol = event_type, price = value, volume = 1 + user_id % 9. Hourly bars of them feed the
indicator, label and trade queries. ``lineitem`` and ``customer`` stand in for raw rows and for the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rolling as R
from .operators import bars as B
from .operators import features, labels, metrics, registry, walk
from .plans import genome as G
from .plans import report, search

LABEL = {"tp": 2.0, "sl": 1.0, "max_bars": 12, "cost": 0.05}
TRAIN, TEST = 200, 60


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str):
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + 0.0).alias(name)


def big(c, name: str):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name)


def ticks(spark, sf) -> DataFrame:
    return _t(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), (1 + F.col("user_id") % 9).cast("double").alias("volume"))


def hourly(spark, sf) -> DataFrame:
    return B.tag_sessions(B.indexed(B.ticks_to_bars(ticks(spark, sf), "1h")))


def raw_bars(spark, sf) -> DataFrame:
    x = F.col("l_extendedprice")
    return _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), x.alias("open"), (x * (1 + F.col("l_tax") - 0.02)).alias("high"), (x * (1 - F.col("l_discount") + 0.01)).alias("low"), (x * (1 + (F.col("l_tax") - F.col("l_discount")) / 2)).alias("close"), F.col("l_quantity").alias("volume"))


def _bars(timeframe):
    return lambda spark, sf: B.ticks_to_bars(ticks(spark, sf), timeframe).select("symbol", F.col("ts").cast("string").alias("ts"), "open", "high", "low", "close", "volume")


def bars_daily_orders(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))
    return B.ticks_to_bars(o, "1d", ["o_orderkey"]).select("symbol", F.col("ts").cast("date").cast("string").alias("day"), "open", "high", "low", "close", "volume")


def bars_session_tags(spark, sf):
    return B.tag_sessions(ticks(spark, sf)).select("symbol", F.col("ts").cast("string").alias("ts"), *(big(c, c) for c in ("minute_of_day", "is_rth", "is_open_drive", "is_close", "is_globex", "dow")), F.col("session_date").cast("string").alias("session_date"))


def bars_dedup_front_month(spark, sf):
    d = B.front_month(raw_bars(spark, sf))
    return d.select("symbol", F.col("ts").cast("date").cast("string").alias("day"), "volume", r6("open", "open"), r6("close", "close"))


def bars_geometry_filter(spark, sf):
    return B.valid_bars(raw_bars(spark, sf)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.max("close"), "max_close"))


def native_spacing_median(spark, sf):
    return B.native_spacing(ticks(spark, sf), ["symbol"]).select("symbol", r6("spacing", "spacing"))


def bars_per_year(spark, sf):
    return B.bars_per_year(hourly(spark, sf)).select("symbol", r6("bars_per_year", "bars_per_year"))


def _ind(group, *names):
    return lambda spark, sf: features.indicators(hourly(spark, sf), [group]).select("symbol", "bar_idx", *(r6(n, n.strip("_")) for n in names))


def ind_sma_bands(spark, sf):
    return hourly(spark, sf).select("symbol", "bar_idx", r6(R.sma("close", 20), "sma20"), r6(R.std("close", 20), "sd20"), r6(R.zscore("volume", 50), "vol_z"))


def ind_stoch(spark, sf):
    return hourly(spark, sf).select("symbol", "bar_idx", r6(features.stoch_k(), "stoch_k"))


def ind_range_rank(spark, sf):
    return hourly(spark, sf).withColumn("rng", F.col("high") - F.col("low")).select("symbol", "bar_idx", r6(R.pct_rank("rng", 50), "range_pctile50"))


def ind_session_vwap_obv(spark, sf):
    df = features.with_obv(features.with_session_vwap(hourly(spark, sf)))
    return df.select("symbol", "bar_idx", r6("__vwap", "vwap"), r6("__obv", "obv"))


def ind_run_length(spark, sf):
    return R.with_streak(hourly(spark, sf), F.col("close") - R.lag("close"), "streak").select("symbol", "bar_idx", big("streak", "streak"))


def _features(group):
    return lambda spark, sf: features.build_features(hourly(spark, sf), [group]).select("symbol", "bar_idx", *(r6(c, c) for c in features.GROUPS[group]))


def labelled(bars: DataFrame) -> DataFrame:
    bars = R.in_pieces(bars, lambda d: d.withColumn("__tr", R.true_range()), 1)
    return labels.triple_barrier(R.scans(bars, {"atr": ("__tr", 1 / 14, 0, 14)}).drop("__tr"), **LABEL)


def label_triple_barrier(spark, sf):
    return labelled(hourly(spark, sf)).where("valid").select("symbol", "bar_idx", r6("long_R", "long_r"), r6("short_R", "short_r"), "long_exit", "short_exit", *(big(c, c) for c in ("long_out", "short_out", "label")))


def folds_walk_forward(spark, sf):
    return walk.fold_windows(hourly(spark, sf), TRAIN, TEST, LABEL["max_bars"]).select("symbol", big("fold", "fold"), "tr_lo", "tr_hi", "te_lo", "te_hi")


def filter_static_mask(spark, sf):
    df = features.build_features(hourly(spark, sf), ["trend", "volatility"]).withColumn("ok", walk.static_mask("rth", 15.0, 1.0, 99.0))
    return df.groupBy("symbol").agg(F.count_if("ok").alias("admitted"), F.count(F.lit(1)).alias("n")).withColumn("enough", walk.capacity(F.col("admitted"), 12, 20))


def _walked(bars: DataFrame, max_per_day: int | None = None) -> DataFrame:
    df = walk.momentum_signal(labelled(bars)).withColumn("direction", walk.signal(0.6, 0.6, 0.1))
    df = walk.in_windows(df, walk.fold_windows(bars, TRAIN, TEST, LABEL["max_bars"]))
    return walk.one_position(walk.candidates(df), ["symbol", "fold"], max_per_day)


def _trades(bars: DataFrame, max_per_day: int | None = None) -> DataFrame:
    return _walked(bars, max_per_day).select("symbol", big("fold", "fold"), "bar_idx", "exit_idx", big("direction", "direction"), r6("R", "r"))


def trades_one_position(spark, sf):
    return _trades(hourly(spark, sf))


def market(spark, sf) -> DataFrame:
    """Hourly bars of all ticks as one series, whatever their symbol: long enough for folds on the smallest table too."""
    t = _t(spark, sf, "events").select(F.lit("all").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), (1 + F.col("user_id") % 9).cast("double").alias("volume"))
    return B.tag_sessions(B.indexed(B.ticks_to_bars(t, "1h", ["event_id"])))


def trades_whole_market(spark, sf):
    return _trades(market(spark, sf))


def trades_daily_quota(spark, sf):
    """The trade walk with at most one trade a session."""
    return _trades(market(spark, sf), max_per_day=1)


def trade_log(spark, sf):
    bars = market(spark, sf)
    log = walk.trade_log(_walked(bars), bars)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return log.select(*(text(c) if c.endswith("_time") else big(c, c) if c in ("fold", "bars_held") else c for c in log.columns))


def trend_filter(spark, sf):
    df = features.build_features(hourly(spark, sf), ["trend"])
    side = lambda d: F.count_if(walk.trend_aligned(F.lit(d)))
    return df.groupBy("symbol").agg(side(1).alias("long_ok"), side(-1).alias("short_ok"))


def holdout_cut(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))
    return walk.holdout_cut(B.ticks_to_bars(o, "1d", ["o_orderkey"]), 6).select("symbol", F.col("cut_ts").cast("date").cast("string").alias("cut_day"), "cut_idx")


def bars_time_range(spark, sf):
    """Sound bars of a span of days, both ends included, where every fifth volume is missing."""
    raw = raw_bars(spark, sf).withColumn("volume", F.expr("if(volume % 5 = 0, null, volume)"))
    df = B.time_range(B.valid_bars(raw), "1994-03-01", "1996-06-30")
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("volume") == 0).alias("without_volume"), r6(F.sum("volume"), "volume"))


def genome_fingerprints(spark, sf):
    """Fingerprints of genomes that are made from the keys of customer, as the search computes them."""
    k = F.col("c_custkey")
    grid = lambda g: F.element_at(F.array(*(F.lit(x) for x in G.GRID[g])), (k * (G.GENES.index(g) + 1) % len(G.GRID[g]) + 1).cast("int"))
    genes = {g: grid(g) for g in G.GENES} | {G.SUBSET: F.slice(F.array(*(F.lit(x) for x in G.POOL)), 1, (k % 6 + 2).cast("int"))}
    return _t(spark, sf, "customer").select(k.alias("c_custkey"), G.fingerprint_column(genes).alias("fingerprint"))


def _r_rows(spark, sf) -> DataFrame:
    r = F.round((F.col("l_partkey") * 31 + F.col("l_orderkey") * 17) % 700 / 100 - 3.2, 2)
    return _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("strategy"), (F.col("l_partkey") % 6).alias("fold"), "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("entry_time"), r.alias("R"))


ORDER = ["entry_time", "l_orderkey", "l_linenumber"]


def metrics_r_core(spark, sf):
    m = metrics.r_metrics(_r_rows(spark, sf), ["strategy"], ORDER)
    return m.select("strategy", *(big(c, c) if c in ("trades", "max_losing_streak") else r6(c, c) for c in m.columns[1:]))


def metrics_by_fold(spark, sf):
    return metrics.r_metrics(_r_rows(spark, sf), ["strategy", "fold"], ORDER).select("strategy", "fold", big("trades", "trades"), r6("total_R", "total_r"), r6("max_dd_R", "max_dd_r"), big("max_losing_streak", "streak"))


def score_haircut(spark, sf):
    rows = _r_rows(spark, sf)
    total = metrics.r_metrics(rows, ["strategy"], ORDER)
    folds = metrics.fold_consistency(metrics.r_metrics(rows, ["strategy", "fold"], ORDER), ["strategy"])
    df = metrics.assess(total.join(folds, "strategy"), F.lit(40)).withColumn("final", metrics.haircut())
    return df.select("strategy", r6("score", "score"), r6("final", "final_score"), big("folds", "folds"), r6("fold_win_rate", "fold_win_rate"), r6("fold_R_std", "fold_std"), r6("concentration", "concentration"), big("passed", "passed"), "tier")


def metrics_with_empty(spark, sf):
    """Metrics of strategies of which some never traded."""
    known = _t(spark, sf, "part").select((F.col("p_partkey") % 50).alias("strategy")).distinct()
    m = metrics.with_empty(metrics.r_metrics(_r_rows(spark, sf), ["strategy"], ORDER), known, ["strategy"])
    return m.select("strategy", big("trades", "trades"), r6("total_R", "total_r"), r6("profit_factor", "profit_factor"), r6("t_stat", "t_stat"), r6("score", "score"))


def equity_curve(spark, sf):
    return report.equity(_r_rows(spark, sf), ["strategy"], ORDER).select("strategy", big("n", "n"), r6("equity", "equity"), r6("peak", "peak"))


def _figures(spark, sf) -> DataFrame:
    """Recorded figures of strategies, made from the keys of customer by _FIGURES."""
    return _t(spark, sf, "customer").select("c_custkey", *(F.expr(x).alias(n) for n, x in _FIGURES.items()))


def tiers_and_holdout(spark, sf):
    df = metrics.assess(_figures(spark, sf), F.lit(40))
    return df.select("c_custkey", big("passed", "passed"), big("total", "total"), "tier", metrics.holdout_verdict().alias("verdict"))


def registry_rescored(spark, sf):
    """Scores from the recorded JSON figures, of which some lack the t-statistic or the payoff ratio."""
    f = _figures(spark, sf)
    known = f.withColumns({"t_stat": F.expr("if(c_custkey % 3 = 0, null, t_stat)"), "payoff_ratio": F.expr("if(c_custkey % 2 = 0, null, payoff_ratio)")})
    known = known.withColumnsRenamed({"folds": "fold_folds", "fold_win_rate": "fold_fold_win_rate", "concentration": "fold_concentration"})
    df = known.select(F.col("c_custkey").cast("string").alias("fingerprint"), F.lit("ok").alias("status"), F.lit(0.0).alias("score"), F.to_json(F.struct(*search.FIGURES)).alias("metrics"))
    return search.rescored(df).select("fingerprint", r6("new", "score"))


def noise_ceiling(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", r6(metrics.noise_ceiling(F.col("p_partkey")), "ceiling"))


def state(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 11 == 0, "pending").when(k % 7 == 0, "failed").when(k % 5 == 0, "rejected").otherwise("ok")
    return _t(spark, sf, "customer").select(F.col("c_name").alias("fingerprint"), status.alias("status"), F.when(status == "ok", F.col("c_acctbal") / 10000).alias("score"), (k % 30).cast("int").alias("generation"), (k % 13).cast("double").alias("eval_secs"), (k % 500).cast("string").alias("genome"), ((k % 45) / 10 + 0.5).alias("rr"), F.col("c_mktsegment").alias("session"))


def registry_stats(spark, sf):
    s = registry.stats(state(spark, sf))
    return s.select(*(big(c, c) if c not in ("best_score", "avg_secs") else r6(c, c) for c in s.columns))


def registry_topk(spark, sf):
    return registry.top(state(spark, sf), 25, 3).select("fingerprint", r6("score", "score"), big("generation", "generation"))


def registry_unseen(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_name").alias("fingerprint")).union(_t(spark, sf, "supplier").select(F.col("s_name").alias("fingerprint")))
    return registry.unseen(c, state(spark, sf).where("status = 'ok'"))


def registry_dup_audit(spark, sf):
    return registry.audit(state(spark, sf))


def elites_niched(spark, sf):
    return registry.niched_elites(state(spark, sf), 25).select("fingerprint", r6("score", "score"), "niche", big("place", "place"))


#: Figures of tiers_and_holdout and registry_rescored, in both dialects.
_FIGURES = {
    "trades": "c_custkey % 13 * 25e0", "expectancy_R": "c_custkey % 17 / 20e0 - 1e-1", "sharpe": "c_custkey % 13 / 4e0 - 1", "recovery_factor": "1 + c_custkey % 6 * 8e-1",
    "payoff_ratio": "15e-1 + c_custkey % 5 * 4e-1", "t_stat": "c_custkey % 11 * 6e-1", "trades_per_year": "c_custkey % 5 * 60e0", "avg_win_R": "c_custkey % 7 / 2e0", "avg_loss_R": "0e0 - c_custkey % 4 / 3e0",
    "folds": "c_custkey % 6 * 1e0", "fold_win_rate": "55e-2 + c_custkey % 4 * 8e-2", "concentration": "3e-1 + c_custkey % 7 * 1e-1",
    "holdout_trades": "case when c_custkey % 3 != 0 then c_custkey % 60 end", "holdout_expectancy_R": "case when c_custkey % 3 != 0 then (c_custkey % 41 - 10) / 50e0 end",
}


# the same in SQL


def _bar_sql(unit: str, minutes: int | None = None) -> str:
    at = f"date_trunc('{unit}', ts)" if minutes is None else f"time_bucket(interval {minutes} minutes, ts)"
    return f"select event_type as symbol, {at} as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, sum(1 + user_id % 9)::double as volume from events group by 1, 2"


def _tags(ts: str) -> str:
    m = f"(hour({ts}) * 60 + minute({ts}))"
    return (
        f"{m} as minute_of_day, ({m} >= 570 and {m} < 960)::bigint as is_rth, ({m} >= 570 and {m} < 630)::bigint as is_open_drive, ({m} >= 900 and {m} < 960)::bigint as is_close, "
        f"({m} < 570 or {m} >= 960)::bigint as is_globex, (isodow({ts}) - 1)::bigint as dow, (case when {m} >= 1080 then {ts}::date + 1 else {ts}::date end)::date as session_date"
    )


_B = f"b0 as ({_bar_sql('hour')}), b as (select *, row_number() over (partition by symbol order by ts) - 1 as bar_idx, {_tags('ts')} from b0)"
_W = "over (partition by symbol order by bar_idx)"


def _f(n: int) -> str:
    return f"over (partition by symbol order by bar_idx rows between {n - 1} preceding and current row)"


def _full(expr: str, c: str, n: int) -> str:
    return f"case when count({c}) {_f(n)} >= {n} then {expr} {_f(n)} end"


def _rec(name: str, src: str, x: str, alpha: str, start: int, n: int) -> str:
    """A recurrence as two expressions: the recursion, and its values from row start + n - 1 on."""
    return (
        f"{name}_r as (select symbol, bar_idx, {x}::double as y from {src} where bar_idx = {start} union all "
        f"select s.symbol, s.bar_idx, r.y * (1 - {alpha}) + ({alpha}) * s.{x} from {name}_r r join {src} s on s.symbol = r.symbol and s.bar_idx = r.bar_idx + 1), "
        f"{name} as (select symbol, bar_idx, case when bar_idx >= {start + n - 1} then y end as {name} from {name}_r)"
    )


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 as {name}"


_P = f"""p as (select *, lag(close) {_W} as pc, lag(open) {_W} as po, lag(high) {_W} as ph, lag(low) {_W} as pl from b),
q as (select *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr, greatest(close - pc, 0) as up, greatest(pc - close, 0) as down,
  coalesce(case when high - ph > pl - low and high - ph > 0 then high - ph end, 0) as pdm, coalesce(case when pl - low > high - ph and pl - low > 0 then pl - low end, 0) as ndm from p)"""
_ATR = _rec("atr14", "q", "tr", "1/14.0", 0, 14)


def _feature_sql(select: str, more: str = "") -> str:
    return f"with recursive {_B}, {_P}, {_ATR}, f as (select q.*, atr14, nullif(atr14, 0) as scale from q join atr14 using (symbol, bar_idx)){more} select symbol, bar_idx, {select} from f"


def _lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) {_W}"


_rng = "nullif(high - low, 0)"
_up, _low = "(high - greatest(open, close))", "(least(open, close) - low)"
_flag = lambda c: f"coalesce(({c}), false)::int::double"
_streak = lambda x: f", s1 as (select *, coalesce(sign({x}), 0) as sg from f), s2 as (select *, coalesce((sg != lag(sg) {_W})::int, 1) as nw from s1), s3 as (select *, sum(nw) {_W} as run from s2), s4 as (select *, sum(sg) over (partition by symbol, run order by bar_idx) as streak from s3)"
_SESS = "over (partition by symbol, session_date order by bar_idx)"

_LBL = f"""with recursive {_B}, {_P}, {_ATR},
e as (select q.*, atr14 as atr, lead(open) {_W} as entry, max(bar_idx) over (partition by symbol) as n_last from q join atr14 using (symbol, bar_idx)),
v as (select *, least(bar_idx + 12, n_last) as last from e where entry is not null and atr > 0),
j as (select v.symbol, v.bar_idx, v.entry, v.atr, v.last,
  min(f.bar_idx) filter (where f.low <= v.entry - v.atr or f.high >= v.entry + 2 * v.atr) as li, min(f.bar_idx) filter (where f.high >= v.entry + v.atr or f.low <= v.entry - 2 * v.atr) as si
  from v join b f on f.symbol = v.symbol and f.bar_idx between v.bar_idx + 1 and v.last group by all),
k as (select j.*, a.low as ll, c.high as sh, z.close as zc from j left join b a on a.symbol = j.symbol and a.bar_idx = j.li left join b c on c.symbol = j.symbol and c.bar_idx = j.si join b z on z.symbol = j.symbol and z.bar_idx = j.last),
lbl as (select symbol, bar_idx, entry, atr, coalesce(li, last) as long_exit, coalesce(si, last) as short_exit,
  case when li is null then 2 when ll <= entry - atr then 0 else 1 end as long_out, case when si is null then 2 when sh >= entry + atr then 0 else 1 end as short_out,
  case when li is null then (zc - entry - 0.05) / atr when ll <= entry - atr then -1 - 0.05 / atr else 2 - 0.05 / atr end as long_r,
  case when si is null then (entry - zc - 0.05) / atr when sh >= entry + atr then -1 - 0.05 / atr else 2 - 0.05 / atr end as short_r from k)"""
#: Folds as windows over each symbol's own number of bars: 200 to learn from, 13 of embargo, 60 to test.
_FOLDS = """nb as (select symbol, max(bar_idx) + 1 as n from b group by 1), w as (select symbol, unnest(generate_series(213, n - 60, 60)) as te_lo from nb where n >= 273),
  fk as (select symbol, te_lo, greatest(0, te_lo - 213) as tr_lo, te_lo - 13 as tr_hi, te_lo + 60 as te_hi from w),
  fo as (select symbol, row_number() over (partition by symbol order by te_lo) - 1 as fold, tr_lo, tr_hi, te_lo, te_hi from fk where tr_hi - tr_lo >= 200)"""

_RAW = "raw as (select l_returnflag as symbol, l_shipdate as ts, l_extendedprice as open, l_extendedprice * (1 + l_tax - 0.02) as high, l_extendedprice * (1 - l_discount + 0.01) as low, l_extendedprice * (1 + (l_tax - l_discount) / 2) as close, l_quantity as volume from lineitem)"
_RR = "rr as (select l_suppkey % 40 as strategy, l_partkey % 6 as fold, l_orderkey, l_linenumber, l_shipdate as entry_time, round((l_partkey * 31 + l_orderkey * 17) % 700 / 100.0 - 3.2, 2)::double as r from lineitem)"


def _metrics(keys: str, name: str) -> str:
    w = f"partition by {keys} order by entry_time, l_orderkey, l_linenumber"
    return f"""{name}1 as (select *, sum(r) over ({w} rows unbounded preceding) as eq, row_number() over ({w}) as pos from rr),
{name}2 as (select *, greatest(max(eq) over ({w} rows unbounded preceding), 0) - eq as dd, pos - coalesce(max(case when r > 0 then pos end) over ({w} rows unbounded preceding), 0) as streak from {name}1),
{name}3 as (select {keys}, count(*) as n, avg((r > 0)::int) as wr, coalesce(avg(r) filter (where r > 0), 0) as aw, coalesce(avg(r) filter (where r <= 0), 0) as al, avg(r) as mean, sum(r) as total, max(dd) as dd, coalesce(stddev_samp(r), 0) as sd, max(streak) as streak,
  max(r) as best, min(r) as worst, coalesce(sum(r) filter (where r > 0), 0) as gain, coalesce(sum(r) filter (where r <= 0), 0) as loss, case when count(*) >= 2 then greatest((epoch(max(entry_time)) - epoch(min(entry_time))) / 86400.0, 1e-9) else 0 end as span from {name}2 group by {keys}),
{name}4 as (select *, wr * aw + (1 - wr) * al as ex, case when span > 0 then n / span * 365.25 else 0 end as tpy from {name}3),
{name} as (select {keys}, n as trades, round_even(wr, 4) as win_rate, round_even(mean, 4) as avg_R, round_even(aw, 4) as avg_win_R, round_even(al, 4) as avg_loss_R, round_even(ex, 4) as expectancy_R, round_even(total, 2) as total_R, round_even(dd, 2) as max_dd_R,
  round_even(case when dd > 1e-9 then total / dd else greatest(total, 0) end, 3) as recovery_factor, round_even(case when sd > 1e-9 then ex / sd * sqrt(tpy) else 0 end, 3) as sharpe,
  round_even(case when loss < 0 then least(gain / abs(loss), 999) else 999 end, 3) as profit_factor, round_even(case when al < -1e-9 then least(aw / abs(al), 999) when aw > 0 then 10 else 0 end, 3) as payoff_ratio,
  round_even(case when sd > 1e-9 then ex / sd * sqrt(n) else 0 end, 3) as t_stat, streak::bigint as max_losing_streak, round_even(tpy, 1) as trades_per_year, round_even(span, 1) as span_days, round_even(best, 2) as best_R, round_even(worst, 2) as worst_R from {name}4)"""


_SCORE = """sc0 as (select *, 0.34 * tanh(expectancy_R / 0.20) + 0.22 * tanh(sharpe / 1.5) + 0.22 * tanh(recovery_factor / 3.0) + case when expectancy_R > 0 then 0.22 * tanh(payoff_ratio / 2.0) else 0 end as raw,
  least(1.0, greatest(t_stat, 0) / 3.5) * sqrt(least(1.0, trades / 100.0)) as pen from m),
sc as (select *, round_even(greatest(-1, least(1, case when raw > 0 then raw * pen else raw / greatest(pen, 0.25) end)), 5) as score from sc0)"""
_STATE = """st0 as (select c_name as fingerprint, case when c_custkey % 11 = 0 then 'pending' when c_custkey % 7 = 0 then 'failed' when c_custkey % 5 = 0 then 'rejected' else 'ok' end as status, c_acctbal, c_custkey % 30 as generation, (c_custkey % 13)::double as eval_secs,
  (c_custkey % 500)::varchar as genome, (c_custkey % 45) / 10.0 + 0.5 as rr, c_mktsegment as session from customer), st as (select *, case when status = 'ok' then c_acctbal / 10000 end as score from st0)"""
_METRIC_COLS = ["trades", "win_rate", "avg_R", "avg_win_R", "avg_loss_R", "expectancy_R", "total_R", "max_dd_R", "recovery_factor", "sharpe", "profit_factor", "payoff_ratio", "t_stat", "max_losing_streak", "trades_per_year", "span_days", "best_R", "worst_R", "score"]
_K = {n: f"2 / {n + 1}.0" for n in (9, 12, 21, 26, 50, 200)}
_ADX = ", ".join([_rec("pdm14", "q", "pdm", "1/14.0", 0, 14), _rec("ndm14", "q", "ndm", "1/14.0", 0, 14)]) + ", di as (select symbol, bar_idx, 100 * pdm14 / (atr14 + 1e-12) as plus_di, 100 * ndm14 / (atr14 + 1e-12) as minus_di from atr14 join pdm14 using (symbol, bar_idx) join ndm14 using (symbol, bar_idx)), dxs as (select *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-12) as dx from di), " + _rec("adx14", "dxs", "dx", "1/14.0", 13, 14)


def _EMAS(*periods: int) -> str:
    return ", ".join(_rec(f"ema{n}", "b", "close", _K[n], 0, n) for n in periods)


def _JOIN(*tables: str) -> str:
    return " ".join(f"left join {t} using (symbol, bar_idx)" for t in tables)


def _ceiling(x: str) -> str:
    a = f"sqrt(2 * ln({x}))"
    return f"({a} - (ln(ln({x})) + ln(4 * pi())) / (2 * {a}))"



def _genome_sql() -> str:
    """The canonical text of genome_fingerprints' genomes, gene by gene in the order of their names."""
    text = lambda x: "'" + (f'"{x}"' if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)) + "'"
    pick = lambda g: f"list_extract([{', '.join(text(x) for x in G.GRID[g])}], (c_custkey * {G.GENES.index(g) + 1} % {len(G.GRID[g])} + 1)::int)"
    groups = "'[\"' || array_to_string(list_sort(list_slice([" + ", ".join(f"'{x}'" for x in G.POOL) + "], 1, (c_custkey % 6 + 2)::int)), '\",\"') || '\"]'"
    genes = [f"'\"{g}\":' || " + (groups if g == G.SUBSET else pick(g)) for g in sorted([*G.GENES, G.SUBSET])]
    return "select c_custkey, substr(sha256('{' || " + " || ',' || ".join(genes) + " || '}'), 1, 20) as fingerprint from customer"


def _whole_market(sql: str) -> str:
    return sql.replace("select event_type as symbol", "select 'all' as symbol").replace("arg_min(value, ts)", "arg_min(value, (ts, event_id))").replace("arg_max(value, ts)", "arg_max(value, (ts, event_id))")


QUERIES = {
    "bars_resample_1h": (_bars("1h"), f"with b as ({_bar_sql('hour')}) select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, open, high, low, close, volume from b"),
    "bars_resample_15min": (_bars("15min"), f"with b as ({_bar_sql('', 15)}) select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, open, high, low, close, volume from b"),
    "bars_resample_1d": (_bars("1d"), f"with b as ({_bar_sql('day')}) select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, open, high, low, close, volume from b"),
    "bars_daily_orders": (bars_daily_orders, "select o_orderpriority as symbol, strftime(o_orderdate, '%Y-%m-%d') as day, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as open, max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as close, count(*)::double as volume from orders group by 1, 2"),
    "bars_session_tags": (bars_session_tags, f"with t as (select event_type as symbol, ts as tt, {_tags('ts')} from events) select symbol, rtrim(rtrim(strftime(tt, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') as ts, minute_of_day, is_rth, is_open_drive, is_close, is_globex, dow, session_date::varchar as session_date from t"),
    "bars_dedup_front_month": (bars_dedup_front_month, f"with {_RAW}, k as (select *, row_number() over (partition by symbol, ts order by volume desc, open desc, high desc, low desc, close desc) as rn from raw) select symbol, strftime(ts, '%Y-%m-%d') as day, volume, {_r('open', 'open')}, {_r('close', 'close')} from k where rn = 1"),
    "bars_geometry_filter": (bars_geometry_filter, f"with {_RAW} select symbol, count(*) as n, {_r('max(close)', 'max_close')} from raw where high >= low and high >= greatest(open, close) - 1e-9 and low <= least(open, close) + 1e-9 and close > 0 group by 1"),
    "native_spacing_median": (native_spacing_median, f"with g as (select event_type as symbol, date_diff('second', date_trunc('second', lag(ts) over (partition by event_type order by ts)), date_trunc('second', ts)) / 60.0 as gap from events) select symbol, {_r('quantile_cont(case when gap > 0 then gap end, 0.5)', 'spacing')} from g group by 1"),
    "bars_per_year": (bars_per_year, f"with {_B} select symbol, {_r('count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 86400.0) * 365.25', 'bars_per_year')} from b group by 1"),
    "ind_sma_bands": (ind_sma_bands, f"with {_B}, x as (select symbol, bar_idx, {_full('avg(close)', 'close', 20)} as a, {_full('stddev_samp(close)', 'close', 20)} as s, volume, {_full('avg(volume)', 'volume', 50)} as va, {_full('stddev_samp(volume)', 'volume', 50)} as vs from b) select symbol, bar_idx, {_r('a', 'sma20')}, {_r('s', 'sd20')}, {_r('(volume - va) / (vs + 1e-12)', 'vol_z')} from x"),
    "ind_ema": (_ind("trend", "ema9", "ema21", "ema50", "ema200"), f"with recursive {_B}, {', '.join(_rec(f'ema{n}', 'b', 'close', _K[n], 0, n) for n in (9, 21, 50, 200))} select symbol, bar_idx, {', '.join(_r(f'ema{n}', f'ema{n}') for n in (9, 21, 50, 200))} from ema9 join ema21 using (symbol, bar_idx) join ema50 using (symbol, bar_idx) join ema200 using (symbol, bar_idx)"),
    "ind_atr": (_ind("volatility", "atr14", "atr50"), f"with recursive {_B}, {_P}, {_ATR}, {_rec('atr50', 'q', 'tr', '1/50.0', 0, 50)} select symbol, bar_idx, {_r('atr14', 'atr14')}, {_r('atr50', 'atr50')} from atr14 join atr50 using (symbol, bar_idx)"),
    "ind_rsi": (_ind("momentum", "rsi14", "rsi7"), f"with recursive {_B}, {_P}, {', '.join(_rec(f'{s}{n}', 'q', s, f'1/{n}.0', 1, n) for s in ('up', 'down') for n in (7, 14))} select b.symbol, b.bar_idx, {_r('100 - 100 / (1 + up14 / (down14 + 1e-12))', 'rsi14')}, {_r('100 - 100 / (1 + up7 / (down7 + 1e-12))', 'rsi7')} from b left join up14 using (symbol, bar_idx) left join down14 using (symbol, bar_idx) left join up7 using (symbol, bar_idx) left join down7 using (symbol, bar_idx)"),
    "ind_adx": (_ind("trend", "plus_di", "minus_di", "adx14_raw"), f"with recursive {_B}, {_P}, {_ATR}, {_ADX} select symbol, bar_idx, {_r('plus_di', 'plus_di')}, {_r('minus_di', 'minus_di')}, {_r('adx14', 'adx14_raw')} from di left join adx14 using (symbol, bar_idx)"),
    "ind_macd": (_ind("momentum", "__macd", "__signal"), f"with recursive {_B}, {_rec('ema12', 'b', 'close', _K[12], 0, 12)}, {_rec('ema26', 'b', 'close', _K[26], 0, 26)}, mm as (select symbol, bar_idx, ema12 - ema26 as macd from ema12 join ema26 using (symbol, bar_idx)), {_rec('sgn', 'mm', 'macd', _K[9], 25, 9)} select symbol, bar_idx, {_r('macd', 'macd')}, {_r('sgn', 'signal')} from mm left join sgn using (symbol, bar_idx)"),
    "ind_stoch": (ind_stoch, f"with {_B}, x as (select symbol, bar_idx, close, {_full('min(low)', 'low', 14)} as lo, {_full('max(high)', 'high', 14)} as hi from b) select symbol, bar_idx, {_r('100 * (close - lo) / (hi - lo + 1e-12)', 'stoch_k')} from x"),
    "ind_range_rank": (ind_range_rank, f"with {_B}, x as (select symbol, bar_idx, high - low as r from b) select a.symbol, a.bar_idx, {_r('case when a.bar_idx >= 49 then (count(*) filter (where c.r < a.r) + (count(*) filter (where c.r = a.r) + 1) / 2.0) / 50 end', 'range_pctile50')} from x a join x c on c.symbol = a.symbol and c.bar_idx between a.bar_idx - 49 and a.bar_idx group by a.symbol, a.bar_idx"),
    "ind_session_vwap_obv": (ind_session_vwap_obv, f"with {_B}, x as (select *, coalesce(sign(close - lag(close) {_W}), 0) * volume as sv from b) select symbol, bar_idx, {_r(f'sum((high + low + close) / 3 * volume) {_SESS} / (sum(volume) {_SESS} + 1e-12)', 'vwap')}, {_r(f'sum(sv) {_W}', 'obv')} from x"),
    "ind_run_length": (ind_run_length, f"with recursive {_B}, {_P}, f as (select * from q){_streak('close - pc')} select symbol, bar_idx, streak::bigint as streak from s4"),
    "feat_patterns": (
        _features("patterns"),
        f"with recursive {_B}, {_P}, {_ATR}, f as (select q.*, nullif(atr14, 0) as scale from q join atr14 using (symbol, bar_idx)){_streak('close - open')} select symbol, bar_idx, "
        + ", ".join(
            _r(e, n)
            for n, e in {
                "body_ratio": f"(close - open) / {_rng}", "upper_wick_ratio": f"{_up} / {_rng}", "lower_wick_ratio": f"{_low} / {_rng}", "wick_imbalance": f"({_up} - {_low}) / {_rng}",
                "is_doji": _flag(f"abs(close - open) / {_rng} < 0.1"), "is_pin_bull": _flag(f"{_low} / {_rng} > 0.6 and close > open"), "is_pin_bear": _flag(f"{_up} / {_rng} > 0.6 and close < open"),
                "engulf_bull": _flag("close > open and pc < po and close >= po and open <= pc"), "engulf_bear": _flag("close < open and pc > po and close <= po and open >= pc"),
                "inside_bar": _flag("high <= ph and low >= pl"), "outside_bar": _flag("high > ph and low < pl"), "body_vs_atr": "abs(close - open) / scale", "gap_atr": "(open - pc) / scale", "consec_up": "streak::double",
            }.items()
        )
        + " from s4",
    ),
    "feat_returns": (
        _features("returns"),
        f"with recursive {_B}, {_P}, {_ATR}, f as (select q.*, ln(close / pc) as r1, nullif(atr14, 0) as scale from q join atr14 using (symbol, bar_idx)) select symbol, bar_idx, "
        + ", ".join(_r(f"(close - {_lag('close', k)}) / scale", f"ret{k}_atr") for k in (1, 2, 3, 5, 10, 20))
        + ", " + _r(f"r1 / ({_full('stddev_samp(r1)', 'r1', 50)} + 1e-12)", "ret1_z") + ", " + _r(f"({_full('max(high)', 'high', 5)} - close) / (close - {_full('min(low)', 'low', 5)} + 1e-12)", "hl_ratio5") + " from f",
    ),
    "feat_session": (
        _features("session"),
        _feature_sql(
            ", ".join(
                [_r("sin(minute_of_day * (2 * pi() / 1440))", "tod_sin"), _r("cos(minute_of_day * (2 * pi() / 1440))", "tod_cos"), _r("is_rth::double", "is_rth"), _r("is_open_drive::double", "is_open_drive"), _r("is_close::double", "is_close_hour"), _r("dow::double", "dow"), _r("greatest(-1440.0, least(1440.0, minute_of_day - 570.0))::double", "mins_from_rth_open"),
                 _r(f"(count(*) {_SESS} - 1)::double", "bars_into_session"), _r(f"(close - min(low) {_SESS}) / (max(high) {_SESS} - min(low) {_SESS} + 1e-12)", "pos_in_day_range"), _r(f"(max(high) {_SESS} - close) / scale", "dist_day_high"), _r(f"(close - min(low) {_SESS}) / scale", "dist_day_low")]
            )
        ),
    ),
    "feat_trend": (
        _features("trend"),
        f"with recursive {_B}, {_P}, {_ATR}, {_EMAS(9, 21, 50, 200)}, {_ADX}, f as (select q.*, nullif(atr14, 0) as scale, ema9, ema21, ema50, ema200, adx14, plus_di, minus_di from q {_JOIN('atr14', 'ema9', 'ema21', 'ema50', 'ema200', 'di', 'adx14')}) select symbol, bar_idx, "
        + ", ".join(_r(f"(close - ema{n}) / scale", f"ema{n}_dist") + ", " + _r(f"(ema{n} - {_lag(f'ema{n}', 5)}) / scale", f"ema{n}_slope") for n in (9, 21, 50, 200))
        + ", " + ", ".join(_r(f"(ema{a} - ema{b}) / scale", f"ema{a}_{b}") for a, b in ((9, 21), (21, 50), (50, 200)))
        + ", " + _r(f"(close - {_full('avg(close)', 'close', 20)}) / scale", "sma20_dist") + ", " + _r("(sign(ema9 - ema21) + sign(ema21 - ema50) + sign(ema50 - ema200))::double", "ema_stack") + ", " + _r("adx14", "adx14") + ", " + _r("plus_di - minus_di", "di_diff") + " from f",
    ),
    "feat_momentum": (
        _features("momentum"),
        f"with recursive {_B}, {_P}, {_ATR}, {', '.join(_rec(f'{s}{n}', 'q', s, f'1/{n}.0', 1, n) for s in ('up', 'down') for n in (7, 14))}, {_EMAS(12, 26)}, mm as (select symbol, bar_idx, ema12 - ema26 as macd from ema12 join ema26 using (symbol, bar_idx)), {_rec('sgn', 'mm', 'macd', _K[9], 25, 9)}, "
        f"f as (select q.*, nullif(atr14, 0) as scale, 100 - 100 / (1 + up14 / (down14 + 1e-12)) as rsi14, 100 - 100 / (1 + up7 / (down7 + 1e-12)) as rsi7, macd, macd - sgn as hist from q {_JOIN('atr14', 'up14', 'down14', 'up7', 'down7', 'mm', 'sgn')}) select symbol, bar_idx, "
        + ", ".join(_r(e, n) for n, e in {"rsi14": "rsi14", "rsi7": "rsi7", "rsi14_slope": f"rsi14 - {_lag('rsi14', 3)}", "macd": "macd / scale", "macd_hist": "hist / scale", "macd_hist_slope": f"hist / scale - {_lag('hist / scale', 2)}", "roc10": f"(close / {_lag('close', 10)} - 1) * 100", "roc30": f"(close / {_lag('close', 30)} - 1) * 100"}.items())
        + ", " + _r(f"100 * (close - {_full('min(low)', 'low', 14)}) / ({_full('max(high)', 'high', 14)} - {_full('min(low)', 'low', 14)} + 1e-12)", "stoch_k") + " from f",
    ),
    "feat_volatility": (
        _features("volatility"),
        f"with recursive {_B}, {_P}, {_ATR}, {_rec('atr50', 'q', 'tr', '1/50.0', 0, 50)}, f as (select q.*, atr14, atr50, ln(close / pc) as r1, high - low as rng from q {_JOIN('atr14', 'atr50')}), "
        "rk as (select a.symbol, a.bar_idx, case when a.bar_idx >= 49 then (count(*) filter (where c.rng < a.rng) + (count(*) filter (where c.rng = a.rng) + 1) / 2.0) / 50 end as rank50 from f a join f c on c.symbol = a.symbol and c.bar_idx between a.bar_idx - 49 and a.bar_idx group by a.symbol, a.bar_idx) select symbol, bar_idx, "
        + ", ".join(_r(e, n) for n, e in {"atr14_pct": "atr14 / close * 100", "atr_ratio": "atr14 / (atr50 + 1e-12)", "bb_width": f"4 * {_full('stddev_samp(close)', 'close', 20)} / ({_full('avg(close)', 'close', 20)} + 1e-12) * 100", "bb_pos": f"(close - {_full('avg(close)', 'close', 20)}) / (2 * {_full('stddev_samp(close)', 'close', 20)} + 1e-12)", "rvol20": f"{_full('stddev_samp(r1)', 'r1', 20)} * 100", "rvol_ratio": f"{_full('stddev_samp(r1)', 'r1', 20)} * 100 / ({_full('stddev_samp(r1)', 'r1', 100)} * 100 + 1e-12)", "range_pctile50": "rank50"}.items())
        + " from f join rk using (symbol, bar_idx)",
    ),
    "feat_volume": (
        _features("volume"),
        f"with recursive {_B}, {_P}, {_ATR}, f0 as (select q.*, nullif(atr14, 0) as scale, coalesce(sign(close - pc), 0) * volume as sv, close * volume as dv, sum((high + low + close) / 3 * volume) {_SESS} / (sum(volume) {_SESS} + 1e-12) as vwap from q join atr14 using (symbol, bar_idx)), f as (select *, sum(sv) {_W} as obv from f0) select symbol, bar_idx, "
        + ", ".join(_r(e, n) for n, e in {"vol_z": f"(volume - {_full('avg(volume)', 'volume', 50)}) / ({_full('stddev_samp(volume)', 'volume', 50)} + 1e-12)", "vol_ratio": f"volume / ({_full('avg(volume)', 'volume', 50)} + 1e-12)", "obv_slope": f"(obv - {_lag('obv', 10)}) / ({_full('avg(volume)', 'volume', 50)} * 10 + 1e-12)", "vwap_dist": "(close - vwap) / scale", "vwap_cross": f"(sign(close - vwap) - sign({_lag('close')} - {_lag('vwap')}))::double", "dollar_vol_z": f"(dv - {_full('avg(dv)', 'dv', 50)}) / ({_full('stddev_samp(dv)', 'dv', 50)} + 1e-12)"}.items())
        + " from f",
    ),
    "label_triple_barrier": (label_triple_barrier, f"{_LBL} select symbol, bar_idx, {_r('long_r', 'long_r')}, {_r('short_r', 'short_r')}, long_exit, short_exit, long_out::bigint as long_out, short_out::bigint as short_out, (case when long_out = 1 and short_out = 1 then case when long_exit <= short_exit then 1 else -1 end when long_out = 1 then 1 when short_out = 1 then -1 else 0 end)::bigint as label from lbl"),
    "folds_walk_forward": (folds_walk_forward, f"with {_B}, {_FOLDS} select symbol, fold, tr_lo, tr_hi, te_lo, te_hi from fo"),
    "filter_static_mask": (filter_static_mask, f"with recursive {_B}, {_P}, {_ATR}, {_ADX}, x as (select b.symbol, coalesce(is_rth = 1 and adx14 >= 15 and atr14 / close * 100 between 1 and 99, false) as ok from b left join atr14 using (symbol, bar_idx) left join adx14 using (symbol, bar_idx)) select symbol, count(*) filter (where ok) as admitted, count(*) as n, count(*) filter (where ok) / (0.35 * 12) >= 20 as enough from x group by 1"),
    "trades_one_position": (
        trades_one_position,
        f"{_LBL}, sg as (select lbl.*, 1 / (1 + exp(-((q.close - q3.close) / lbl.atr))) as pl from lbl join q using (symbol, bar_idx) join q q3 on q3.symbol = lbl.symbol and q3.bar_idx = lbl.bar_idx - 3), "
        f"{_FOLDS}, di0 as (select *, case when pl >= 0.6 and pl - (1 - pl) >= 0.1 then 1 when 1 - pl >= 0.6 and (1 - pl) - pl >= 0.1 then -1 else 0 end as direction from sg), "
        "c as (select di0.symbol, fold, bar_idx, direction, case when direction = 1 then long_exit else short_exit end as exit_idx, case when direction = 1 then long_r else short_r end as r from di0 join fo on fo.symbol = di0.symbol and bar_idx >= te_lo and bar_idx < te_hi where direction != 0), "
        "wk as (select symbol, fold, min(bar_idx) as bar_idx, arg_min(exit_idx, bar_idx) as exit_idx from c group by 1, 2 union all select c.symbol, c.fold, min(c.bar_idx), arg_min(c.exit_idx, c.bar_idx) from wk join c on c.symbol = wk.symbol and c.fold = wk.fold and c.bar_idx > wk.exit_idx group by c.symbol, c.fold) "
        f"select c.symbol, c.fold::bigint as fold, c.bar_idx, c.exit_idx, c.direction::bigint as direction, {_r('c.r', 'r')} from wk join c using (symbol, fold, bar_idx)",
    ),
    "metrics_r_core": (metrics_r_core, f"with {_RR}, {_metrics('strategy', 'm')}, {_SCORE} select strategy, " + ", ".join(c if c in ("trades", "max_losing_streak") else _r(c, c) for c in _METRIC_COLS) + " from sc"),
    "metrics_by_fold": (metrics_by_fold, f"with {_RR}, {_metrics('strategy, fold', 'mf')} select strategy, fold, trades, {_r('total_R', 'total_r')}, {_r('max_dd_R', 'max_dd_r')}, max_losing_streak as streak from mf"),
    "score_haircut": (
        score_haircut,
        f"with {_RR}, {_metrics('strategy', 'm')}, {_metrics('strategy, fold', 'mf')}, {_SCORE}, fc0 as (select strategy, count(*) as folds, count(*) filter (where total_R > 0) as good, stddev_pop(total_R) as sd, sum(total_R) as s, max(total_R) as top from mf where trades > 0 group by 1), "
        "fc as (select strategy, folds, round_even(good / folds, 3) as fold_win_rate, round_even(sd, 2) as fold_std, round_even(case when s > 0 then least(1.0, top / s) else 1 end, 3) as concentration from fc0), "
        "y as (select *, case when folds < 3 or score <= 0 then score else round_even(score * (0.4 + 0.6 * fold_win_rate) * case when concentration > 0.7 then 1 - (concentration - 0.7) else 1 end, 5) end as final, "
        f"((expectancy_R > 0)::int + (t_stat >= {_ceiling('40.0')} + 0.5)::int + (payoff_ratio >= 2)::int + (trades >= 200)::int + (fold_win_rate >= 0.65)::int + (concentration <= 0.45)::int + (recovery_factor >= 2)::int) as passed from sc join fc using (strategy)) "
        f"select strategy, {_r('score', 'score')}, {_r('final', 'final_score')}, folds, {_r('fold_win_rate', 'fold_win_rate')}, {_r('fold_std', 'fold_std')}, {_r('concentration', 'concentration')}, passed::bigint as passed, case passed when 7 then 'candidate' when 6 then 'watch' else '' end as tier from y",
    ),
    "noise_ceiling": (noise_ceiling, f"with n as (select p_partkey, greatest(p_partkey, 3)::double as x from part) select p_partkey, {_r(_ceiling('x'), 'ceiling')} from n"),
    "registry_stats": (registry_stats, f"with {_STATE} select count(*) as total, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'rejected') as rejected, {_r('max(score)', 'best_score')}, max(generation) as max_generation, {_r('avg(eval_secs)', 'avg_secs')} from st"),
    "registry_topk": (registry_topk, f"with {_STATE} select fingerprint, {_r('score', 'score')}, generation from st where status = 'ok' and score is not null and generation > 3 order by st.score desc, fingerprint limit 25"),
    "registry_unseen": (registry_unseen, f"with {_STATE}, c as (select c_name as fingerprint from customer union select s_name from supplier) select fingerprint from c where not exists (select 1 from st where st.fingerprint = c.fingerprint and status = 'ok')"),
    "registry_dup_audit": (registry_dup_audit, f"with {_STATE} select count(*) as n_rows, count(distinct fingerprint) as fingerprints, count(distinct genome) as genomes from st"),
    "elites_niched": (
        elites_niched,
        f"with {_STATE}, pool as (select * from st where status = 'ok' and score is not null and generation > -1 order by score desc, fingerprint limit 100), n as (select *, ((rr >= 1.5)::int + (rr >= 2)::int + (rr >= 3)::int + (rr >= 4)::int)::varchar || '/' || session as niche from pool), "
        f"r as (select *, row_number() over (partition by niche order by score desc, fingerprint) as place from n) select fingerprint, {_r('score', 'score')}, niche, place from r order by (place > 1)::int, r.score desc, fingerprint limit 25",
    ),
    "genome_fingerprints": (genome_fingerprints, _genome_sql()),
}
QUERIES["trades_whole_market"] = (trades_whole_market, _whole_market(QUERIES["trades_one_position"][1]))
_FIG = "fig as (select c_custkey, " + ", ".join(f"{x} as {n}" for n, x in _FIGURES.items()) + " from customer)"
_LAST = QUERIES["trades_whole_market"][1].rpartition(" select c.symbol, c.fold")[0]
_STEPS = _LAST[: _LAST.index("wk as (")]
_PASSED = f"(expectancy_R > 0)::int + (t_stat >= {_ceiling('40.0')} + 0.5)::int + (payoff_ratio >= 2)::int + (trades >= 200)::int + (fold_win_rate >= 0.65)::int + (concentration <= 0.45)::int + (recovery_factor >= 2)::int"
QUERIES |= {
    "trades_daily_quota": (
        trades_daily_quota,
        _STEPS + "cd as (select c.*, b.session_date as day from c join b using (symbol, bar_idx)), "
        "wk as (select symbol, fold, min(bar_idx) as bar_idx, arg_min(exit_idx, bar_idx) as exit_idx, arg_min(day, bar_idx) as day, 1 as used from cd group by 1, 2 union all "
        "select cd.symbol, cd.fold, min(cd.bar_idx), arg_min(cd.exit_idx, cd.bar_idx), arg_min(cd.day, cd.bar_idx), arg_min(case when cd.day = wk.day then wk.used + 1 else 1 end, cd.bar_idx) "
        "from wk join cd on cd.symbol = wk.symbol and cd.fold = wk.fold and cd.bar_idx > wk.exit_idx and (cd.day != wk.day or wk.used < 1) group by cd.symbol, cd.fold) "
        f"select c.symbol, c.fold::bigint as fold, c.bar_idx, c.exit_idx, c.direction::bigint as direction, {_r('c.r', 'r')} from wk join c using (symbol, fold, bar_idx)",
    ),
    "trade_log": (
        trade_log,
        _LAST + " select c.symbol, c.fold::bigint as fold, " + ", ".join(f"strftime({x}, '%Y-%m-%d %H:%M:%S') as {n}" for n, x in {"signal_time": "s.ts", "entry_time": "n.ts", "exit_time": "o.ts"}.items())
        + ", case c.direction when 1 then 'long' else 'short' end as direction, "
        + ", ".join(f"round_even({x}, {k}) as {n}" for n, x, k in [("entry_price", "y.entry", 2), ("stop_price", "y.entry - c.direction * y.atr", 2), ("target_price", "y.entry + 2 * c.direction * y.atr", 2), ("exit_price", "y.entry + c.r * y.atr * c.direction", 2), ("risk_points", "y.atr", 2), ("confidence", "case c.direction when 1 then y.pl else 1 - y.pl end", 4), ("R", "c.r", 4)])
        + ", (c.exit_idx - c.bar_idx)::bigint as bars_held from wk join c using (symbol, fold, bar_idx) join di0 y using (symbol, bar_idx) join b s using (symbol, bar_idx) join b n on n.symbol = c.symbol and n.bar_idx = c.bar_idx + 1 join b o on o.symbol = c.symbol and o.bar_idx = c.exit_idx",
    ),
    "trend_filter": (trend_filter, f"with recursive {_B}, {_P}, {_ATR}, {_EMAS(200)} select symbol, count(*) filter (where atr14 <> 0 and close >= ema200) as long_ok, count(*) filter (where atr14 <> 0 and close <= ema200) as short_ok from q {_JOIN('atr14', 'ema200')} group by 1"),
    "holdout_cut": (holdout_cut, "with d as (select distinct o_orderpriority as symbol, o_orderdate::date as ts from orders), k as (select symbol, max(ts) - interval 6 months as cut from d group by 1) select symbol, strftime(cut, '%Y-%m-%d') as cut_day, count(*) filter (where ts < cut) as cut_idx from d join k using (symbol) group by symbol, cut"),
    "bars_time_range": (bars_time_range, f"with {_RAW} select symbol, count(*) as n, count(*) filter (where volume % 5 = 0) as without_volume, {_r('sum(case when volume % 5 = 0 then 0 else volume end)', 'volume')} from raw where high >= low and high >= greatest(open, close) - 1e-9 and low <= least(open, close) + 1e-9 and close > 0 and ts between '1994-03-01' and '1996-06-30' group by 1"),
    "metrics_with_empty": (metrics_with_empty, f"with {_RR}, {_metrics('strategy', 'm')}, {_SCORE}, k as (select distinct p_partkey % 50 as strategy from part) select strategy, coalesce(trades, 0) as trades, {_r('coalesce(total_R, 0)', 'total_r')}, {_r('coalesce(profit_factor, 0)', 'profit_factor')}, {_r('coalesce(t_stat, 0)', 't_stat')}, {_r('coalesce(score, -1)', 'score')} from k left join sc using (strategy)"),
    "equity_curve": (equity_curve, f"with {_RR}, e as (select strategy, row_number() over w as n, sum(r) over w as equity, count(*) over (partition by strategy) as size from rr window w as (partition by strategy order by entry_time, l_orderkey, l_linenumber rows unbounded preceding)), p as (select *, greatest(0, max(equity) over (partition by strategy order by n)) as peak from e) select strategy, n, {_r('equity', 'equity')}, {_r('peak', 'peak')} from p where n = size or (n - 1) % greatest(1, ceil(size / 1400))::bigint = 0"),
    "tiers_and_holdout": (
        tiers_and_holdout,
        f"with {_FIG}, x as (select *, {_PASSED} as passed from fig) select c_custkey, passed::bigint as passed, (7 + (holdout_trades is not null)::int)::bigint as total, "
        "case when holdout_trades is not null and not (holdout_expectancy_R > 0 and holdout_trades >= 30) then '' when holdout_trades is not null and passed = 7 then 'confirmed' when passed = 7 then 'candidate' when passed = 6 then 'watch' else '' end as tier, "
        "case when holdout_trades is null then null when holdout_trades < 30 then 'INCONCLUSIVE' when holdout_expectancy_R <= 0 then 'FAILED' when holdout_expectancy_R < 0.5 * expectancy_R then 'WEAK' else 'HELD UP' end as verdict from x",
    ),
    "registry_rescored": (
        registry_rescored,
        f"with {_FIG}, m as (select * replace (case when c_custkey % 3 = 0 then case when trades_per_year > 0 then round_even(sharpe / sqrt(trades_per_year) * sqrt(trades), 3) else 0 end else t_stat end as t_stat, "
        "case when c_custkey % 2 = 0 then case when avg_loss_R < -1e-9 then round_even(avg_win_R / abs(avg_loss_R), 3) when avg_win_R > 0 then 10 else 0 end else payoff_ratio end as payoff_ratio) from fig), "
        f"{_SCORE}, y as (select *, case when trades = 0 then -1 else score end as own from sc) select c_custkey::varchar as fingerprint, "
        + _r("case when folds < 3 or own <= 0 then own else round_even(own * (0.4 + 0.6 * fold_win_rate) * case when concentration > 0.7 then 1 - (concentration - 0.7) else 1 end, 5) end", "score") + " from y",
    ),
}
