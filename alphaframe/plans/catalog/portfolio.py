"""Portfolio tables on the weekly panel, scenario keyed from the start."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import calendar as C
from ...operators import metrics as M
from ...operators import portfolio as P
from ...operators.ranks import top_bottom_k
from ...sources.bars import ordered_key
from ..materialize import cut
from ..strategy import PRESETS, evaluate, run_strategy, scenario
from . import inputs as I
from .base import cte, register, six

# The given prices move several-fold within weeks, so test portfolios hold little of them.
LG, SG = 0.02, 0.01
_S = dict(warmup_days=20, long_count=10, short_count=5, long_gross=LG, short_gross=SG, rebalance_days=4)
SCENARIOS = [
    scenario("base", **_S), scenario("cost_x2", **_S | {"cost_bps": 22.0}), scenario("cost_x3", **_S | {"cost_bps": 33.0}),
    scenario("every_8", **_S | {"rebalance_days": 8}), scenario("top_20", **_S | {"long_count": 20}),
    scenario("gross_half", **_S | {"long_gross": LG / 2, "short_gross": SG / 2}),
]
BASE = SCENARIOS[:1]
LONG_ONLY = dict(warmup_days=20, long_gross=LG)
PRESET_NAMES = list(PRESETS)
# All presets on the weekly panel: their own counts and bands, a common cadence and little gross exposure.
PRESET_ROWS = [scenario(p, p, warmup_days=20, rebalance_days=10, long_gross=LG, **({"short_gross": SG} if PRESETS[p]["short_count"] else {})) for p in PRESET_NAMES]


def scen_sql(rows) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        f"('{s['scenario']}', {s['rebalance_days']}, {s['warmup_days']}, {s['long_count']}, {s['short_count']}, {s['min_names']},"
        f" {s['long_gross']}::DOUBLE, {s['short_gross']}::DOUBLE, {s['cost_bps']}::DOUBLE, {s['rank_buffer']})" for s in rows
    ) + ") v(scenario, every, warm, nl, ns, mn, lg, sg, bps, buf)"


def band_sql(rk: str, on: str = "r.date = signal_date") -> str:
    """Selected names under a retention band: a walk over the rebalances of a scenario with lists of names."""
    keep = lambda held, near, n: (
        f"list_concat(list_filter({near}, lambda x: list_contains({held}, x)), list_filter({near}, lambda x: NOT list_contains({held}, x)))[1:{n}]")
    return f"""
WITH RECURSIVE ends AS MATERIALIZED (
  SELECT *, least(nl, candidates) AS n_long, least(ns, candidates - least(nl, candidates)) AS n_short
  FROM sched@ JOIN scen@ USING (scenario) JOIN {rk} r ON {on} WHERE candidates >= mn
), near AS MATERIALIZED (
  SELECT scenario, rebalance_id, n_long, n_short, row_number() OVER (PARTITION BY scenario ORDER BY rebalance_id) AS k,
    list(symbol ORDER BY rank) FILTER (rank <= n_long + buf) AS tops,
    coalesce(list(symbol ORDER BY rank DESC) FILTER (n_short > 0 AND rank > candidates - n_short - buf), []) AS lows FROM ends GROUP BY 1, 2, 3, 4
), walk AS (
  SELECT scenario, rebalance_id, k, tops[1:n_long] AS longs, lows[1:n_short] AS shorts FROM near WHERE k = 1
  UNION ALL
  SELECT n.scenario, n.rebalance_id, n.k, {keep('longs', 'tops', 'n_long')}, {keep('shorts', 'lows', 'n_short')}
  FROM walk w JOIN near n ON n.scenario = w.scenario AND n.k = w.k + 1
), held AS (
  SELECT scenario, rebalance_id, unnest(list_concat(longs, shorts)) AS symbol,
    unnest(list_concat(list_transform(longs, lambda x: 'LONG'), list_transform(shorts, lambda x: 'SHORT'))) AS side FROM walk)
SELECT h.scenario, h.rebalance_id, h.symbol, h.side, s.signal_date, s.signal_idx, s.entry_date, s.entry_idx, s.exit_date, s.exit_idx, r.score, r.rank,
  r.candidates, c.lg, c.sg, r.scale FROM held h JOIN sched@ s USING (scenario, rebalance_id) JOIN scen@ c USING (scenario)
JOIN {rk} r ON r.symbol = h.symbol AND {on.replace('scen_p.', 'c.')}"""


cte("scen", scen_sql([*SCENARIOS, scenario("long_only", "long_only", **LONG_ONLY)]))
cte("rk", """SELECT date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank,
  count(*) OVER (PARTITION BY date) AS candidates, 1.0::DOUBLE AS scale FROM panel_w WHERE score IS NOT NULL""", ["panel_w"])


def perf_sql(source: str, initial: str = "100000") -> str:
    return f"""
SELECT *, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END AS calmar FROM (
SELECT scenario, g - 1 AS total_return, pow(g, 1 / elapsed_years) - 1 AS cagr, volatility, ann / (volatility + 1e-12) AS sharpe,
  ann / (down + 1e-12) AS sortino, max_drawdown, elapsed_years, observations FROM (
  SELECT scenario, arg_max(equity_usd, date) / {initial} AS g, greatest(date_diff('day', min(date), max(date)) / 365.25, 1 / 365.25)::DOUBLE AS elapsed_years,
    count(daily_return) AS observations, avg(daily_return) * 252 AS ann, stddev_samp(daily_return) * sqrt(252) AS volatility,
    stddev_samp(daily_return) FILTER (daily_return < 0) * sqrt(252) AS down, min(dd) AS max_drawdown
  FROM (SELECT *, equity_usd / max(equity_usd) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {source})
  GROUP BY scenario))"""


OWN = {"scen", "sched", "sel", "wts", "held", "gross", "trades", "costs", "net", "acct", "mark", "full_days", "journal", "perf", "metrics"}


def chain(x: str, sel: str, needs: list[str]) -> None:
    """The sub-queries from scenarios to figures; ``x`` ends their names, so that other scenario tables can have their own."""
    def add(name: str, body: str, *uses: str) -> None:
        cte(name + x, body.replace("@", x), [u + x if u in OWN else u for u in uses])

    add("sched", """
SELECT * FROM (SELECT scenario, row_number() OVER w AS rebalance_id, date AS signal_date, idx AS signal_idx, entry_date,
  idx + 1 AS entry_idx, lead(entry_date) OVER w AS exit_date, lead(idx) OVER w + 1 AS exit_idx
  FROM (SELECT *, lead(date) OVER (ORDER BY idx) AS entry_date FROM cal_w), scen@ WHERE idx >= warm AND (idx - warm) % every = 0
  WINDOW w AS (PARTITION BY scenario ORDER BY idx)) WHERE exit_date IS NOT NULL""", "cal_w", "scen")
    add("sel", sel, *needs)
    add("wts", """SELECT * FROM (SELECT *, CASE side WHEN 'LONG' THEN lg ELSE -sg END * scale / count(*) OVER (PARTITION BY scenario, rebalance_id, side)
  AS weight FROM sel@) WHERE abs(weight) > 1e-12""", "sel")
    add("held", """
SELECT w.*, a.open AS entry_price, b.open AS exit_price, b.open / a.open - 1 AS asset_return,
  weight * (b.open / a.open - 1) AS contribution
FROM wts@ w JOIN bars_w a ON a.symbol = w.symbol AND a.date = w.entry_date
LEFT JOIN bars_w b ON b.symbol = w.symbol AND b.date = w.exit_date""", "wts", "bars_w")
    add("gross", """SELECT scenario, rebalance_id, coalesce(sum(contribution), 0) AS gross_return, count(*) AS positions
FROM held@ GROUP BY 1, 2""", "held")
    add("trades", """
SELECT coalesce(t.scenario, p.scenario) AS scenario, coalesce(t.rebalance_id, p.nxt) AS rebalance_id,
  coalesce(t.symbol, p.symbol) AS symbol, coalesce(drift, 0) AS prior_weight, coalesce(weight, 0) AS target_weight,
  coalesce(weight, 0) - coalesce(drift, 0) AS traded
FROM held@ t FULL JOIN (
  SELECT h.scenario, h.symbol, nxt, weight * (1 + coalesce(asset_return, 0)) / (1 + gross_return) AS drift
  FROM held@ h JOIN (SELECT *, lead(rebalance_id) OVER (PARTITION BY scenario ORDER BY rebalance_id) AS nxt FROM gross@) g
    ON h.scenario = g.scenario AND h.rebalance_id = g.rebalance_id WHERE nxt IS NOT NULL) p
ON t.scenario = p.scenario AND t.rebalance_id = p.nxt AND t.symbol = p.symbol""", "held", "gross")
    add("costs", """SELECT scenario, rebalance_id, sum(abs(traded)) AS turnover, sum(abs(traded)) * any_value(bps) / 10000 AS cost
FROM trades@ JOIN scen@ USING (scenario) GROUP BY 1, 2""", "trades", "scen")
    add("net", """
SELECT *, product(1 + net_return) OVER (PARTITION BY scenario ORDER BY rebalance_id ROWS UNBOUNDED PRECEDING) AS equity
FROM (SELECT *, gross_return - cost AS net_return FROM gross@ JOIN costs@ USING (scenario, rebalance_id))""", "gross", "costs")
    add("acct", """
SELECT n.scenario, rebalance_id, 100000 * coalesce(lag(equity) OVER (PARTITION BY n.scenario ORDER BY rebalance_id), 1) AS s0,
  100000 * equity AS s1, cost, turnover, entry_idx, exit_idx, entry_date, exit_date
FROM net@ n JOIN sched@ USING (scenario, rebalance_id)""", "net", "sched")
    add("mark", """
SELECT scenario, rebalance_id, date, equity_usd, balance_usd, gross_exposure, position_count, turnover, cost_usd FROM (
 SELECT *, row_number() OVER (PARTITION BY scenario, date ORDER BY prio DESC, rebalance_id DESC) AS rn FROM (
  SELECT a.scenario, a.rebalance_id, c.date, 1 AS prio, s0 * (1 - a.cost + sum(weight * (b.open / entry_price - 1))) AS equity_usd,
    s0 * (1 - a.cost) AS balance_usd, sum(abs(weight)) AS gross_exposure, count(*) AS position_count,
    CASE WHEN c.date = a.entry_date THEN a.turnover ELSE 0.0 END AS turnover,
    CASE WHEN c.date = a.entry_date THEN a.cost * s0 ELSE 0.0 END AS cost_usd
  FROM acct@ a JOIN cal_w c ON c.idx >= a.entry_idx AND c.idx < a.exit_idx
  JOIN held@ h ON h.scenario = a.scenario AND h.rebalance_id = a.rebalance_id JOIN bars_w b ON b.symbol = h.symbol AND b.date = c.date
  GROUP BY a.scenario, a.rebalance_id, c.date, s0, a.cost, a.turnover, a.entry_date
  UNION ALL SELECT scenario, rebalance_id, exit_date, 0, s1, s1, 0.0, 0, 0.0, 0.0 FROM acct@)) WHERE rn = 1""", "acct", "held", "cal_w", "bars_w")
    add("full_days", """
SELECT d.scenario, d.date, rebalance_id, last_value(equity_usd IGNORE NULLS) OVER w AS equity_usd,
  last_value(balance_usd IGNORE NULLS) OVER w AS balance_usd, coalesce(gross_exposure, 0) AS gross_exposure,
  coalesce(position_count, 0) AS position_count, coalesce(turnover, 0) AS turnover, coalesce(cost_usd, 0) AS cost_usd,
  1 - coalesce(gross_exposure, 0) AS cash_pct, equity_usd IS NULL AS is_cash_day
FROM (SELECT scenario, date FROM cal_w, (SELECT scenario, min(date) AS a, max(date) AS b FROM mark@ GROUP BY 1) WHERE date BETWEEN a AND b) d
LEFT JOIN mark@ m ON m.scenario = d.scenario AND m.date = d.date
WINDOW w AS (PARTITION BY d.scenario ORDER BY d.date ROWS UNBOUNDED PRECEDING)""", "mark", "cal_w")
    add("journal", """
SELECT *, equity_usd - pv AS daily_pnl_usd, equity_usd / greatest(pv, 1e-12) - 1 AS daily_return,
  equity_usd / greatest(100000, max(equity_usd) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown
FROM (SELECT *, coalesce(lag(equity_usd) OVER (PARTITION BY scenario ORDER BY date), 100000) AS pv FROM full_days@)""", "full_days")
    add("perf", perf_sql("journal@"), "journal")
    add("metrics", """SELECT * FROM perf@ JOIN (SELECT scenario, avg(turnover) AS avg_turnover, count(*) AS rebalance_count
FROM net@ GROUP BY 1) USING (scenario) WHERE scenario <> 'long_only'""", "perf", "net")


chain("", band_sql("rk"), ["rk", "sched", "scen"])
PERF = ("total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "elapsed_years")


def ev(spark, sf, scenarios=BASE):
    """The transactions are read once; panel, prices and marks all start from the stored bars."""
    bars = cut(I.bars_w(spark, sf))
    return evaluate(I.panel_w(spark, sf, bars), bars, "score", scenarios, universe=I.universe_size(spark, sf))


@register("align_execution_dates", """SELECT rebalance_id, signal_date, signal_idx, entry_date, entry_idx, exit_date, exit_idx
FROM sched WHERE scenario = 'base'""", ["sched"])
def _(spark, sf):
    return C.align_execution_dates(I.cal_w(spark, sf), 4, 20)


@register("scenario_cross", """
SELECT *, row_number() OVER (ORDER BY long_count, short_count, rebalance_days) AS scenario FROM (
  SELECT long_count, short_count, rebalance_days, count(*) AS rebalances, min(date) AS first_date, max(date) AS last_date
  FROM cal_w, (VALUES (10), (20), (30)) a(long_count), (VALUES (10), (20), (30)) b(short_count), (VALUES (5), (10), (21)) c(rebalance_days)
  WHERE idx % rebalance_days = 0 GROUP BY 1, 2, 3)""", ["cal_w"])
def _(spark, sf):
    """The sweep's grid over the sessions of the data: when each point of it rebalances."""
    grid = {"long_count": [10, 20, 30], "short_count": [10, 20, 30], "rebalance_days": [5, 10, 21]}
    runs = P.scenario_cross(I.cal_w(spark, sf).select("idx", "date"), grid).where("idx % rebalance_days = 0")
    return runs.groupBy(*grid, "scenario").agg(
        F.count("*").alias("rebalances"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("top_bottom_k", """SELECT date, symbol, rank, candidates, CASE WHEN rank <= 10 THEN 'LONG' ELSE 'SHORT' END AS side FROM rk
WHERE candidates >= 20 AND (rank <= 10 OR rank > candidates - 5)""", ["rk"])
def _(spark, sf):
    out = top_bottom_k(I.panel_w(spark, sf), "score", 10, 5, min_names=20, universe=I.universe_size(spark, sf))
    return out.select("date", "symbol", "rank", "candidates", "side")


@register("target_weights", "SELECT scenario, rebalance_id, symbol, side, weight FROM wts WHERE scenario = 'base'", ["wts"], six("weight"))
def _(spark, sf):
    sched = P.schedules(I.cal_w(spark, sf), BASE)
    sel = P.select_names(I.panel_w(spark, sf), "score", sched, BASE, I.universe_size(spark, sf))
    return P.target_weights(sel, LG, SG).select("scenario", "rebalance_id", "symbol", "side", "weight")


@register("target_weights_scaled", """
SELECT scenario, rebalance_id, symbol, least(greatest(lg * score / n, -0.0015), 0.0015) AS weight FROM (
  SELECT *, count(*) OVER (PARTITION BY scenario, rebalance_id, side) AS n FROM sel WHERE scenario = 'base' AND side = 'LONG')
WHERE abs(lg * score / n) > 1e-12""", ["sel"], six("weight"))
def _(spark, sf):
    """Sized by the score, unused share in cash, capped per name."""
    sched = P.schedules(I.cal_w(spark, sf), BASE)
    sel = P.select_names(I.panel_w(spark, sf), "score", sched, BASE, I.universe_size(spark, sf)).where("side = 'LONG'")
    out = P.target_weights(sel, LG, 0.0, scale="score", normalize=False, cap=0.0015)
    return out.select("scenario", "rebalance_id", "symbol", "weight")


@register("entry_exit_prices", "SELECT rebalance_id, symbol, entry_price, exit_price FROM held WHERE scenario = 'base'",
          ["held"], six("entry_price", "exit_price"))
def _(spark, sf):
    return ev(spark, sf).held.select("rebalance_id", "symbol", "entry_price", "exit_price")


@register("period_returns", "SELECT rebalance_id, symbol, side, asset_return, contribution FROM held WHERE scenario = 'base'",
          ["held"], six("asset_return", "contribution"))
def _(spark, sf):
    return ev(spark, sf).held.select("rebalance_id", "symbol", "side", "asset_return", "contribution")


@register("turnover_costs", "SELECT * FROM costs WHERE scenario = 'base'", ["costs"], six("turnover", "cost"))
def _(spark, sf):
    return ev(spark, sf).ledger.select("scenario", "rebalance_id", "turnover", "cost")


@register("split_orders", """
SELECT rebalance_id, symbol, action, qty FROM (
  SELECT *, unnest(['COVER', 'BUY', 'SELL', 'SHORT']) AS action, unnest([
    greatest(-prior_weight, 0) - greatest(-target_weight, 0), greatest(target_weight, 0) - greatest(prior_weight, 0),
    greatest(prior_weight, 0) - greatest(target_weight, 0), greatest(-target_weight, 0) - greatest(-prior_weight, 0)]) AS qty
  FROM trades WHERE scenario = 'base') WHERE qty > 1e-9""", ["trades"], six("qty"))
def _(spark, sf):
    return P.split_orders(ev(spark, sf).trades).select("rebalance_id", "symbol", "action", "qty")


@register("net_returns", "SELECT rebalance_id, gross_return, positions, turnover, cost, net_return, equity FROM net WHERE scenario = 'base'",
          ["net"], six("gross_return", "turnover", "cost", "net_return", "equity"))
def _(spark, sf):
    return ev(spark, sf).ledger.drop("scenario")


@register("compound_equity", """SELECT date, market_ret, product(1 + least(greatest(market_ret, -0.9), 0.9) / 100)
  OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM mrs0 WHERE market_ret IS NOT NULL""", ["mrs0"], six("market_ret", "equity"))
def _(spark, sf):
    from ...operators.technical import market_risk_scale

    df = market_risk_scale(I.bars_w(spark, sf)).where("market_ret is not null")
    df = df.withColumn("_r", F.greatest(F.lit(-0.9), F.least(F.lit(0.9), F.col("market_ret"))) / 100)
    return M.compound_equity(df, (), "date", "_r").select("date", "market_ret", "equity")


@register("daily_mark", "SELECT * EXCLUDE (scenario) FROM mark WHERE scenario = 'base'", ["mark"],
          {"equity_usd": 4, "balance_usd": 4, "gross_exposure": 6, "turnover": 6, "cost_usd": 4})
def _(spark, sf):
    return ev(spark, sf).marks.drop("scenario")


@register("complete_calendar", "SELECT * FROM full_days WHERE scenario = 'every_8'", ["full_days"],
          {"equity_usd": 4, "balance_usd": 4, "gross_exposure": 6, "turnover": 6, "cost_usd": 4, "cash_pct": 6})
def _(spark, sf):
    e = ev(spark, sf, [SCENARIOS[3]])
    return e.daily.drop("daily_pnl_usd", "daily_return", "drawdown")


@register("running_drawdown", "SELECT date, equity_usd, daily_pnl_usd, daily_return, drawdown FROM journal WHERE scenario = 'base'",
          ["journal"], {"equity_usd": 4, "daily_pnl_usd": 4, "daily_return": 6, "drawdown": 6})
def _(spark, sf):
    return ev(spark, sf).daily.select("date", "equity_usd", "daily_pnl_usd", "daily_return", "drawdown")


@register("period_performance", "SELECT * FROM perf WHERE scenario = 'base'", ["perf"], six(*PERF))
def _(spark, sf):
    return M.period_performance(ev(spark, sf).daily, ["scenario"], 100_000.0)


@register("rebalance_performance", """
SELECT g - 1 AS total_return, pow(g, 1 / y) - 1 AS cagr, vol AS volatility, ann / (vol + 1e-12) AS sharpe, ann / (down + 1e-12) AS sortino,
  CASE WHEN mdd < 0 THEN (pow(g, 1 / y) - 1) / abs(mdd) END AS calmar, mdd AS max_drawdown, y AS elapsed_years, n AS observations
FROM (SELECT arg_max(equity, rebalance_id) AS g, count(*) / 13.0::DOUBLE AS y, count(net_return) AS n, avg(net_return) * 13 AS ann,
  stddev_samp(net_return) * sqrt(13) AS vol, stddev_samp(net_return) FILTER (net_return < 0) * sqrt(13) AS down, min(dd) AS mdd
  FROM (SELECT *, equity / max(equity) OVER (ORDER BY rebalance_id ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM net WHERE scenario = 'base'))""",
          ["net"], six(*PERF))
def _(spark, sf):
    return M.rebalance_performance(ev(spark, sf).ledger, 13.0)


@register("sweep_best", "SELECT scenario, sharpe, cagr FROM metrics ORDER BY sharpe DESC NULLS LAST, scenario LIMIT 1", ["metrics"], six("sharpe", "cagr"))
def _(spark, sf):
    m = ev(spark, sf, SCENARIOS).metrics
    return M.sweep_best(m).select("scenario", "sharpe", "cagr")


@register("robustness_summary", """
SELECT avg((sharpe > 0)::INT) AS positive_sharpe_ratio, quantile_cont(sharpe, 0.5) AS median_sharpe, min(sharpe) AS min_sharpe,
  coalesce(bool_and(sharpe > 0) FILTER (scenario IN ('cost_x2', 'cost_x3')), TRUE) AS cost_stress_pass,
  avg((sharpe > 0)::INT) >= 0.7 AND coalesce(bool_and(sharpe > 0) FILTER (scenario IN ('cost_x2', 'cost_x3')), TRUE) AS passed,
  max(avg_turnover) FILTER (scenario = 'base') AS turnover_base FROM metrics""", ["metrics"],
          six("positive_sharpe_ratio", "median_sharpe", "min_sharpe", "turnover_base"))
def _(spark, sf):
    m = ev(spark, sf, SCENARIOS).metrics
    return M.robustness_summary(m, ["cost_x2", "cost_x3"])


cte("bench", """
SELECT 'bench' AS scenario, date, daily_return, 100000 * product(1 + daily_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity_usd
FROM (SELECT date, CASE WHEN row_number() OVER (ORDER BY date) = 1 THEN 0.0 ELSE coalesce(m, 0) END AS daily_return FROM (
  SELECT date, avg(r) AS m FROM (SELECT date, open / lag(open) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars_w) GROUP BY date)
  WHERE date BETWEEN (SELECT min(date) FROM full_days WHERE scenario = 'base') AND (SELECT max(date) FROM full_days WHERE scenario = 'base'))""",
    ["bars_w", "full_days"])
cte("bench_perf", perf_sql("bench"), ["bench"])


def bench(spark, sf, daily):
    """Equal weights over the dates of a strategy's own days."""
    first, last = daily.agg(F.min("date")).scalar(), daily.agg(F.max("date")).scalar()
    return M.equal_weight_benchmark(I.bars_w(spark, sf), first).where(F.col("date") <= last)


@register("equal_weight_benchmark", "SELECT date, daily_return, ln(equity_usd) AS log_equity FROM bench", ["bench"],
          six("daily_return", "log_equity"))
def _(spark, sf):
    return bench(spark, sf, ev(spark, sf).daily).select("date", "daily_return", F.log("equity_usd").alias("log_equity"))


@register("excess_vs_benchmark", """SELECT p.scenario, p.sharpe, b.sharpe AS benchmark_sharpe, b.max_drawdown AS benchmark_max_drawdown,
  ln(1 + b.cagr) AS log_benchmark_cagr, (p.cagr - b.cagr) / (1 + abs(b.cagr)) AS relative_excess
FROM perf p, bench_perf b WHERE p.scenario = 'base'""", ["perf", "bench_perf"],
          six("sharpe", "benchmark_sharpe", "benchmark_max_drawdown", "log_benchmark_cagr", "relative_excess"))
def _(spark, sf):
    daily = ev(spark, sf).daily
    b = M.period_performance(bench(spark, sf, daily), initial=100_000.0)
    out = M.excess_vs_benchmark(M.period_performance(daily, ["scenario"], 100_000.0), b)
    return out.select(
        "scenario", "sharpe", "benchmark_sharpe", "benchmark_max_drawdown", F.log1p("benchmark_cagr").alias("log_benchmark_cagr"),
        (F.col("excess_cagr_vs_equal_weight") / (1 + F.abs("benchmark_cagr"))).alias("relative_excess"))


# --- ledgers and reports ---------------------------------------------------------------------

cte("pos", """SELECT h.scenario, h.rebalance_id, symbol, side, weight, asset_return, s0 * weight * asset_return AS gross_pnl_usd,
  s0 * coalesce(abs(traded), 0) * 0.0011 AS estimated_cost_usd,
  s0 * weight * asset_return - s0 * coalesce(abs(traded), 0) * 0.0011 AS net_pnl_usd
FROM held h JOIN acct USING (scenario, rebalance_id) LEFT JOIN trades t USING (scenario, rebalance_id, symbol)
WHERE asset_return IS NOT NULL""", ["held", "acct", "trades"])


def positions(spark, sf):
    """Closed positions with money columns, from the base evaluation."""
    e = ev(spark, sf)
    w = Window.partitionBy("scenario").orderBy("rebalance_id")
    start = e.ledger.select(*P.KEY, (F.coalesce(F.lag("equity").over(w), F.lit(1.0)) * 100_000.0).alias("s0"))
    traded = e.trades.select(*P.KEY, "symbol", (F.abs("traded") * 0.0011).alias("_c"))
    j = e.held.where("asset_return is not null").join(start, list(P.KEY)).join(traded, [*P.KEY, "symbol"], "left")
    gross, cost = F.col("s0") * F.col("contribution"), F.col("s0") * F.coalesce("_c", F.lit(0.0))
    return e, start, j.select(
        *P.KEY, "symbol", "side", "weight", "asset_return", gross.alias("gross_pnl_usd"),
        cost.alias("estimated_cost_usd"), (gross - cost).alias("net_pnl_usd"))


POS = ("win_rate", "profit_factor", "avg_position_period_return", "best_position_pnl_usd", "worst_position_pnl_usd", "long_pnl_usd", "short_pnl_usd")


@register("position_stats", """
SELECT count(*) AS position_periods, avg((net_pnl_usd > 0)::INT) AS win_rate,
  coalesce(sum(net_pnl_usd) FILTER (net_pnl_usd > 0), 0) / abs(sum(net_pnl_usd) FILTER (net_pnl_usd < 0)) AS profit_factor,
  avg(asset_return * CASE side WHEN 'LONG' THEN 1 ELSE -1 END) AS avg_position_period_return,
  max(net_pnl_usd) AS best_position_pnl_usd, min(net_pnl_usd) AS worst_position_pnl_usd,
  coalesce(sum(net_pnl_usd) FILTER (side = 'LONG'), 0) AS long_pnl_usd, coalesce(sum(net_pnl_usd) FILTER (side = 'SHORT'), 0) AS short_pnl_usd
FROM pos WHERE scenario = 'base'""", ["pos"], six(*POS[:3]) | {c: 2 for c in POS[3:]})
def _(spark, sf):
    return M.position_stats(positions(spark, sf)[2])


@register("side_attribution", """
WITH g AS (SELECT side AS book, sum(gross_pnl_usd) AS g FROM pos WHERE scenario = 'base' GROUP BY 1), c AS (
  SELECT CASE WHEN action IN ('BUY', 'SELL') THEN 'LONG' ELSE 'SHORT' END AS book, sum(qty * s0 * 0.0011) AS c FROM (
    SELECT *, unnest(['COVER', 'BUY', 'SELL', 'SHORT']) AS action, unnest([
      greatest(-prior_weight, 0) - greatest(-target_weight, 0), greatest(target_weight, 0) - greatest(prior_weight, 0),
      greatest(prior_weight, 0) - greatest(target_weight, 0), greatest(-target_weight, 0) - greatest(-prior_weight, 0)]) AS qty
    FROM trades WHERE scenario = 'base') JOIN acct USING (scenario, rebalance_id) WHERE qty > 1e-9 GROUP BY 1)
SELECT book, coalesce(g, 0) AS gross_pnl_usd, coalesce(c, 0) AS costs_usd, coalesce(g, 0) - coalesce(c, 0) AS net_pnl_usd
FROM g FULL JOIN c USING (book)""", ["pos", "trades", "acct"], {"gross_pnl_usd": 2, "costs_usd": 2, "net_pnl_usd": 2})
def _(spark, sf):
    e, start, pos = positions(spark, sf)
    orders = P.split_orders(e.trades).join(start, list(P.KEY)).withColumn(
        "estimated_cost_usd", F.col("qty") * F.col("s0") * 0.0011)
    return M.side_attribution(pos, orders)


@register("exposure_summary", """
SELECT rebalance_id, sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure, 1 - sum(abs(weight)) AS cash_pct,
  max(abs(weight)) AS largest_weight, count(*) AS position_count, list_sort(list(DISTINCT symbol)) AS active_symbols
FROM held WHERE scenario = 'base' GROUP BY 1""", ["held"], six("gross_exposure", "net_exposure", "cash_pct", "largest_weight"))
def _(spark, sf):
    return M.exposure_summary(ev(spark, sf).held)


_LEGS = """unnest(['COVER', 'BUY', 'SELL', 'SHORT']) AS action, unnest([
      greatest(-prior_weight, 0) - greatest(-target_weight, 0), greatest(target_weight, 0) - greatest(prior_weight, 0),
      greatest(prior_weight, 0) - greatest(target_weight, 0), greatest(-target_weight, 0) - greatest(-prior_weight, 0)]) AS qty"""
cte("legs", f"SELECT * FROM (SELECT scenario, rebalance_id, symbol, {_LEGS} FROM trades) WHERE qty > 1e-9", ["trades"])
cte("sig", """SELECT date, avg(0.5 + 0.45 * ((CAST(symbol AS BIGINT) * 37 + idx * 11) % 101) / 101.0) AS avg_meta_probability, 0.6::DOUBLE AS meta_threshold
FROM rk JOIN cal_w USING (date) WHERE rank <= 12 GROUP BY date""", ["rk", "cal_w"])
cte("day_rows", """
SELECT j.*, CASE WHEN position_count > 0 THEN largest END AS largest_weight,
  CASE WHEN position_count > 0 AND j.date = s.entry_date THEN coalesce(sent, 0) ELSE 0 END AS trade_count, avg_meta_probability, meta_threshold
FROM journal j LEFT JOIN sched s USING (scenario, rebalance_id)
LEFT JOIN (SELECT scenario, rebalance_id, max(abs(weight)) AS largest FROM held GROUP BY 1, 2) h USING (scenario, rebalance_id)
LEFT JOIN (SELECT scenario, rebalance_id, count(*) AS sent FROM legs GROUP BY 1, 2) o USING (scenario, rebalance_id)
LEFT JOIN sig c ON c.date = s.signal_date AND position_count > 0""", ["journal", "sched", "held", "legs", "sig"])
_TOTALS = {"daily_pnl_usd": 2, "daily_return": 6, "equity_usd": 2, "balance_usd": 2, "drawdown": 6, "gross_exposure": 6, "cash_pct": 6, "turnover": 6,
           "largest_weight": 6, "cost_usd": 2, "avg_meta_probability": 6, "meta_threshold": 6}
TOTALS_SQL = """sum(daily_pnl_usd) AS daily_pnl_usd, product(1 + daily_return) - 1 AS daily_return,
  arg_max(equity_usd, date) AS equity_usd, arg_max(balance_usd, date) AS balance_usd, min(drawdown) AS drawdown, avg(gross_exposure) AS gross_exposure,
  avg(cash_pct) AS cash_pct, sum(turnover) AS turnover, CAST(sum(trade_count) AS BIGINT) AS trade_count, max(largest_weight) AS largest_weight,
  sum(cost_usd) AS cost_usd, avg(avg_meta_probability) AS avg_meta_probability, avg(meta_threshold) AS meta_threshold"""


def signal_days(spark, sf, bars):
    """Mean probability and threshold of the best names of each date."""
    best = top_bottom_k(I.panel_w(spark, sf, bars), "score", 12, min_names=0, universe=I.universe_size(spark, sf)).join(C.sessions(bars), "date")
    prob = 0.5 + 0.45 * ((F.col("symbol").cast("bigint") * 37 + F.col("idx") * 11) % 101) / 101.0
    return best.groupBy("date").agg(F.avg(prob).alias("avg_meta_probability"), F.lit(0.6).alias("meta_threshold"))


@register("journal_totals", f"SELECT scenario, {TOTALS_SQL} FROM day_rows WHERE scenario <> 'long_only' GROUP BY 1", ["day_rows"], _TOTALS)
def _(spark, sf):
    """Totals per scenario, with largest weights and orders from the holdings and the trades."""
    bars = cut(I.bars_w(spark, sf))
    e = evaluate(I.panel_w(spark, sf, bars), bars, "score", SCENARIOS, universe=I.universe_size(spark, sf))
    rows = M.journal_rows(e.daily, e.held, P.split_orders(e.trades), e.schedule, signal_days(spark, sf, bars))
    return M.journal_totals(rows, ["scenario"])


@register("ledger_drilldown", """
SELECT p.*, d.date FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scenario, rebalance_id, kind ORDER BY round(abs(value), 9) DESC, symbol, action) AS INTEGER) AS place FROM (
  SELECT scenario, rebalance_id, 'rebalance' AS kind, NULL AS symbol, NULL AS action, turnover AS value FROM net
  UNION ALL SELECT scenario, rebalance_id, 'order', symbol, action, qty FROM legs
  UNION ALL SELECT scenario, rebalance_id, 'position', symbol, side, weight FROM held)) p
JOIN (SELECT scenario, rebalance_id, date FROM mark) d ON d.scenario = p.scenario AND d.rebalance_id = p.rebalance_id WHERE d.scenario = 'base'""", ["mark", "held", "legs", "net"], six("value"))
def _(spark, sf):
    """Rebalance, orders and positions behind every day of the journal."""
    e = ev(spark, sf)
    day = e.daily.where(F.col("rebalance_id").isNotNull())
    return P.day_detail(day, e.held, P.split_orders(e.trades), e.ledger)


@register("compare_runs", """
SELECT date, max(equity_usd) FILTER (scenario = 'base') AS eq_base, max(equity_usd) FILTER (scenario = 'every_8') AS eq_every_8,
  max(equity_usd) FILTER (scenario = 'top_20') AS eq_top_20 FROM full_days WHERE scenario IN ('base', 'every_8', 'top_20') GROUP BY 1""",
          ["full_days"], {"eq_base": 4, "eq_every_8": 4, "eq_top_20": 4})
def _(spark, sf):
    d = ev(spark, sf, [SCENARIOS[0], SCENARIOS[3], SCENARIOS[4]]).daily
    return M.compare_runs(d, ["base", "every_8", "top_20"], run="scenario")


@register("symbol_search", """SELECT rebalance_id, active_symbols FROM (
  SELECT rebalance_id, list_sort(list(DISTINCT symbol)) AS active_symbols FROM held WHERE scenario = 'base' GROUP BY 1)
WHERE len(list_filter(active_symbols, lambda x: contains(upper(x), '7'))) > 0""", ["held"])
def _(spark, sf):
    days = M.exposure_summary(ev(spark, sf).held).select("rebalance_id", "active_symbols")
    return M.symbol_search(days, "7")


@register("sort_journal", """SELECT date, daily_return, row_number() OVER (ORDER BY daily_return DESC NULLS LAST, date) AS pos
FROM journal WHERE scenario = 'base'""", ["journal"], six("daily_return"))
def _(spark, sf):
    d = M.sort_journal(ev(spark, sf).daily, "daily_return", descending=True)
    w = Window.orderBy(F.col("daily_return").desc_nulls_last(), "date")
    return d.select("date", "daily_return", F.row_number().over(w).alias("pos"))


@register("dedup_keep_last", """SELECT date, symbol, close FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS symbol,
  l_extendedprice AS close, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn
FROM lineitem) WHERE rn = 1""", (), {"close": 4})
def _(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_extendedprice").alias("close"), ordered_key(l_orderkey=15, l_linenumber=2, l_partkey=12).alias("at"))
    return P.dedup_keep_last(rows, ["date", "symbol"], ["at"]).select("date", "symbol", "close")


# --- live portfolio checks -------------------------------------------------------------------

cte("last_tgt", "SELECT symbol, weight FROM wts WHERE scenario = 'base' AND rebalance_id = (SELECT max(rebalance_id) FROM wts WHERE scenario = 'base')", ["wts"])
cte("cur", """SELECT symbol, close * volume * CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN 1 ELSE -1 END / 50 AS notional
FROM bars_w WHERE date = (SELECT max(date) FROM bars_w) AND CAST(symbol AS INT) % 3 = 0""", ["bars_w"])


def last_targets(spark, sf):
    sched = P.schedules(I.cal_w(spark, sf), BASE)
    last = sched.agg(F.max("rebalance_id")).scalar()
    sel = P.select_names(I.panel_w(spark, sf), "score", sched.where(F.col("rebalance_id") == last), BASE, I.universe_size(spark, sf))
    return P.target_weights(sel, LG, SG).select("symbol", "weight")


@register("rebalance_diff", """
SELECT coalesce(c.symbol, t.symbol) AS symbol, CASE WHEN weight IS NULL THEN 'CLOSE' WHEN coalesce(weight, 0) * 100000 > coalesce(notional, 0) THEN 'BUY' ELSE 'SELL' END AS action,
  coalesce(notional, 0) AS current_notional, coalesce(weight, 0) * 100000 AS target_notional, coalesce(weight, 0) * 100000 - coalesce(notional, 0) AS delta
FROM cur c FULL JOIN last_tgt t ON c.symbol = t.symbol
WHERE weight IS NULL OR abs(coalesce(weight, 0) * 100000 - coalesce(notional, 0)) >= 100""", ["cur", "last_tgt"],
          {"current_notional": 4, "target_notional": 4, "delta": 4})
def _(spark, sf):
    sign = F.when(F.col("symbol").cast("int") % 2 == 0, 1).otherwise(-1)
    cur = C.latest_cross_section(I.bars_w(spark, sf)).where(F.col("symbol").cast("int") % 3 == 0).select(
        "symbol", (F.col("close") * F.col("volume") * sign / 50).alias("notional"))
    return P.rebalance_diff(cur, last_targets(spark, sf), 100_000.0)


cte("tradables", """SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_suppkey % 7 <> 0 AS tradable, s_suppkey % 4 <> 0 AS shortable,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Hard_To_Borrow' ELSE 'easy' END AS borrow_status FROM supplier WHERE s_suppkey % 9 <> 0""")


@register("untradable_anti", """
SELECT * FROM (SELECT t.symbol, t.weight, unnest([CASE WHEN NOT coalesce(tradable, FALSE) THEN 'not_tradable' END,
  CASE WHEN t.weight < 0 AND NOT coalesce(shortable, FALSE) THEN 'not_shortable' END,
  CASE WHEN t.weight < 0 AND lower(borrow_status) = 'hard_to_borrow' THEN 'hard_to_borrow' END]) AS reason
  FROM (SELECT symbol, CAST(weight AS DOUBLE) AS weight FROM wts WHERE scenario = 'base') t
  LEFT JOIN tradables a ON a.symbol = t.symbol) WHERE reason IS NOT NULL""", ["wts", "tradables"], six("weight"))
def _(spark, sf):
    k = F.col("s_suppkey")
    a = I.table(spark, sf, "supplier").where(k % 9 != 0).select(
        k.cast("string").alias("symbol"), (k % 7 != 0).alias("tradable"), (k % 4 != 0).alias("shortable"),
        F.when(k % 5 == 0, "Hard_To_Borrow").otherwise("easy").alias("borrow_status"))
    sel = P.select_names(I.panel_w(spark, sf), "score", P.schedules(I.cal_w(spark, sf), BASE), BASE, I.universe_size(spark, sf))
    return P.untradable_anti(P.target_weights(sel, LG, SG), a)


@register("exposure_gate", """
SELECT 'gross_exposure' AS name, coalesce(sum(abs(weight)), 0) <= 2.0001 AS ok, coalesce(sum(abs(weight)), 0)::DOUBLE AS value FROM last_tgt
UNION ALL SELECT 'net_exposure', abs(coalesce(sum(weight), 0)) <= 0.10, coalesce(sum(weight), 0) FROM last_tgt
UNION ALL SELECT 'position_count', count(*) > 0 AND count(*) <= 200, count(*) FROM last_tgt
UNION ALL SELECT 'data_freshness', date_diff('day', max(date), DATE '2002-01-15') <= 4, date_diff('day', max(date), DATE '2002-01-15') FROM bars""",
          ["last_tgt", "bars"], six("value"))
def _(spark, sf):
    latest = I.cal(spark, sf).agg(F.max("date")).scalar()
    return P.exposure_gate(last_targets(spark, sf), F.lit("2002-01-15").cast("date"), latest)


cte("bench_lo", """
SELECT 'bench' AS scenario, date, daily_return, 100000 * product(1 + daily_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity_usd
FROM (SELECT date, CASE WHEN row_number() OVER (ORDER BY date) = 1 THEN 0.0 ELSE coalesce(m, 0) END AS daily_return FROM (
  SELECT date, avg(r) AS m FROM (SELECT date, open / lag(open) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars_w) GROUP BY date)
  WHERE date BETWEEN (SELECT min(date) FROM full_days WHERE scenario = 'long_only') AND (SELECT max(date) FROM full_days WHERE scenario = 'long_only'))""",
    ["bars_w", "full_days"])
cte("bench_lo_perf", perf_sql("bench_lo"), ["bench_lo"])


@register("run_strategy", """
SELECT p.*, avg_turnover, rebalance_count, b.sharpe AS benchmark_sharpe, b.max_drawdown AS benchmark_max_drawdown,
  ln(1 + b.cagr) AS log_benchmark_cagr, (p.cagr - b.cagr) / (1 + abs(b.cagr)) AS relative_excess
FROM perf p, bench_lo_perf b, (SELECT avg(turnover) AS avg_turnover, count(*) AS rebalance_count FROM net WHERE scenario = 'long_only')
WHERE p.scenario = 'long_only'""", ["perf", "bench_lo_perf", "net"],
          six(*PERF, "avg_turnover", "benchmark_sharpe", "benchmark_max_drawdown", "log_benchmark_cagr", "relative_excess"))
def _(spark, sf):
    """One preset end to end on the weekly panel, beside its equal-weight benchmark."""
    bars = cut(I.bars_w(spark, sf))
    out = run_strategy(I.panel_w(spark, sf, bars), bars, "long_only", "score", universe=I.universe_size(spark, sf), **LONG_ONLY)
    # The benchmark of these prices grows beyond any scale, so its growth is shown as a logarithm.
    return out.withColumns({
        "log_benchmark_cagr": F.log1p("benchmark_cagr"),
        "relative_excess": F.col("excess_cagr_vs_equal_weight") / (1 + F.abs("benchmark_cagr")),
    }).drop("benchmark_cagr", "excess_cagr_vs_equal_weight")


@register("paper_vs_model", """
SELECT *, paper_return - model_return AS return_gap FROM (
SELECT count(*) AS snapshots, arg_max(o_totalprice, o_orderkey) / arg_min(o_totalprice, o_orderkey) - 1 AS paper_return,
  (SELECT arg_max(equity_usd, date) / arg_min(equity_usd, date) - 1 FROM mark m WHERE scenario = 'base'
     AND date BETWEEN (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AND (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS model_return
FROM (SELECT o_totalprice, row(o_orderdate, o_orderkey) AS o_orderkey FROM orders))""", ["mark"],
          six("paper_return", "model_return", "return_gap"))
def _(spark, sf):
    o = I.table(spark, sf, "orders")
    snaps = P.dedup_keep_last(
        o.select(F.col("o_orderdate").alias("created_at"), "o_orderkey", F.col("o_totalprice").alias("equity")),
        ["created_at", "o_orderkey"], ["equity"])
    curve = ev(spark, sf).daily.where("not is_cash_day").select("date", F.col("equity_usd").alias("equity"))
    return M.paper_vs_model(snaps, curve, tie="o_orderkey")
