"""Portfolio tables: selections to weights, returns, costs, orders and the daily account.

Tables are keyed by (scenario, rebalance_id[, symbol]) and hold at most the selected names of a
rebalance, so they stay small next to the bars they are joined with.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, period_return, ratio
from ..functions.cols import EPS
from .calendar import held_sessions
from .ranks import top_bottom_k

KEY = ("scenario", "rebalance_id")


def scenario_cross(df: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Repeat rows for each point of the product of parameter lists, numbered in order.

    One literal array per list, exploded in turn, so no cross join is planned; the number comes from
    the places in the lists.
    """
    for name, values in grid.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_{name}", name))
    number, stride = F.lit(1), 1
    for name in reversed(list(grid)):
        number, stride = number + F.col(f"_{name}") * stride, stride * len(grid[name])
    return df.withColumn("scenario", number).drop(*[f"_{name}" for name in grid])


def with_scenarios(df: DataFrame, scenarios: Sequence[Mapping]) -> DataFrame:
    """Repeat rows once per scenario row, the fields all of them have becoming columns (a literal explode)."""
    fields = [k for k in scenarios[0] if all(k in s for s in scenarios)]
    structs = F.array(*[F.struct(*[F.lit(s[k]).alias(k) for k in fields]) for s in scenarios])
    return df.withColumn("_s", F.explode(structs)).select("*", "_s.*").drop("_s")


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def schedules(cal: DataFrame, scenarios: Sequence[Mapping]) -> DataFrame:
    """``align_execution_dates`` for every scenario at once (fields rebalance_days, warmup_days)."""
    nxt = cal.withColumn("entry_date", F.lead("date", 1).over(Window.orderBy("idx")))
    rows = with_scenarios(nxt, scenarios).where(
        (F.col("idx") >= F.col("warmup_days"))
        & ((F.col("idx") - F.col("warmup_days")) % F.col("rebalance_days") == 0)
    )
    w = Window.partitionBy("scenario").orderBy("idx")
    return rows.select(
        "scenario", F.row_number().over(w).alias("rebalance_id"), F.col("date").alias("signal_date"),
        F.col("idx").alias("signal_idx"), "entry_date", (F.col("idx") + F.lit(1)).alias("entry_idx"),
        F.lead("entry_date").over(w).alias("exit_date"), (F.lead("idx").over(w) + F.lit(1)).alias("exit_idx"),
    ).where(F.col("exit_date").isNotNull())


def select_names(scored: DataFrame, score: str, schedule: DataFrame, scenarios: Sequence[Mapping], universe: int | None = None) -> DataFrame:
    """Longs and shorts of every scenario and rebalance.

    A date is ranked once, cut to the largest count any scenario asks for, and only then
    repeated per scenario, so extra scenarios cost rows of selected names, not of the panel. Scenarios
    with a ``rank_buffer`` keep a held name until it ranks that many places behind their count.
    """
    buffers = {s["scenario"]: int(s.get("rank_buffer") or 0) for s in scenarios}
    most_long = max(int(s["long_count"]) + buffers[s["scenario"]] for s in scenarios)
    most_short = max(int(s["short_count"]) + (buffers[s["scenario"]] if s["short_count"] else 0) for s in scenarios)
    cut = top_bottom_k(scored, score, most_long, most_short, min_names=0, universe=universe).drop("side")
    up = F.col("candidates") - F.col("rank") + F.lit(1)
    rows = with_scenarios(cut, scenarios).withColumnRenamed("date", "signal_date").where(F.col("candidates") >= F.col("min_names"))
    n_long = F.least("long_count", "candidates")
    n_short = F.least(F.col("short_count"), F.col("candidates") - n_long)
    side = F.when(F.col("rank") <= n_long, "LONG").when(up <= n_short, "SHORT")
    joined = rows.join(schedule, ["scenario", "signal_date"])
    banded = [name for name, b in buffers.items() if b]
    if not banded:
        return joined.withColumn("side", side).where(F.col("side").isNotNull())
    plain = joined.where(~F.col("scenario").isin(banded)).withColumn("side", side).where(F.col("side").isNotNull())
    buffer = F.when(F.lit(True), per_scenario([{"scenario": n, "b": b} for n, b in buffers.items()], "b"))
    near = joined.where(F.col("scenario").isin(banded)).withColumns({"_n_long": n_long, "_n_short": n_short, "_up": up, "_buffer": buffer})
    kept = retained_names(near)
    return plain.unionByName(near.join(kept, [*KEY, "symbol"]).select(*plain.columns))


def retained_names(near: DataFrame) -> DataFrame:
    """(scenario, rebalance_id, symbol, side) under a retention band.

    ``near`` has, per scenario and rebalance, the names within count and buffer of either end (rank, _up, _n_long, _n_short,
    _buffer). A rebalance first keeps what it held that is still within the band, by rank, then takes the best others up
    to its count. The fold runs over the rebalances of a scenario; it holds those few names, not the panel.
    """
    def end(place: str, count: str, side: str) -> DataFrame:
        close = (F.col(place) <= F.col(count) + F.col("_buffer")) & (F.col(count) > 0)
        per = near.where(close).groupBy(*KEY).agg(
            F.transform(F.sort_array(F.collect_list(F.struct(place, "symbol"))), lambda x: x["symbol"]).alias("names"),
            F.max(count).cast("int").alias("n"))
        listed = per.groupBy("scenario").agg(F.sort_array(F.collect_list(F.struct("rebalance_id", "names", "n"))).alias("all"))
        empty = F.struct(
            F.array().cast("array<string>").alias("held"),
            F.array().cast("array<struct<rebalance_id:int,names:array<string>>>").alias("out"))

        def step(acc, now):
            stays = F.filter(now["names"], lambda s: F.array_contains(acc["held"], s))
            held = F.slice(F.concat(stays, F.filter(now["names"], lambda s: ~F.array_contains(acc["held"], s))), 1, now["n"])
            row = F.struct(now["rebalance_id"].cast("int").alias("rebalance_id"), held.alias("names"))
            return F.struct(held.alias("held"), F.array_append(acc["out"], row).alias("out"))

        picks = listed.select("scenario", F.explode(F.aggregate("all", empty, step, lambda acc: acc["out"])).alias("r"))
        return picks.select("scenario", "r.rebalance_id", F.explode("r.names").alias("symbol"), F.lit(side).alias("side"))

    return end("rank", "_n_long", "LONG").unionByName(end("_up", "_n_short", "SHORT"))


def target_weights(
    sel: DataFrame, long_gross=1.0, short_gross=0.0, scale: str | None = None,
    normalize: bool = True, cap: float | None = None, by: Sequence[str] = KEY,
) -> DataFrame:
    """Equal weights per side, or weights by a 0..1 scale; shorts are negative.

    With ``normalize`` the scales of a side sum to its gross; without it an unused share of
    each slot stays in cash. Zero weights are dropped.
    """
    side = Window.partitionBy(*by, "side")
    gross = F.when(F.col("side") == "LONG", _num(long_gross)).otherwise(-_num(short_gross))
    n = F.count("*").over(side)
    if scale is None:
        w = gross / n
    else:
        s = F.coalesce(clip(scale, 0.0, 1.0), F.lit(0.0))
        total = F.sum(s).over(side)
        slot = gross * s / n
        w = F.when(total > F.lit(EPS), ratio(gross * s, total)).otherwise(slot) if normalize else slot
    if cap is not None:
        w = clip(w, -cap, cap)
    return sel.withColumn("weight", w).where(F.abs("weight") > F.lit(EPS))


def entry_exit_prices(weights: DataFrame, bars: DataFrame) -> DataFrame:
    """Opens at entry and exit of the held names. No entry price drops the name; no exit price
    leaves a null. The bars are read once: both prices come from one join and one group."""
    marks = weights.select(
        "*", F.explode(F.array(F.col("entry_date"), F.col("exit_date"))).alias("date")
    )
    opens = bars.select("date", "symbol", "open").where(F.col("open") > 0)
    keys = weights.columns
    return (
        marks.join(opens, ["date", "symbol"], "left").groupBy(*keys)
        .agg(
            F.max(F.when(F.col("date") == F.col("entry_date"), F.col("open"))).alias("entry_price"),
            F.max(F.when(F.col("date") == F.col("exit_date"), F.col("open"))).alias("exit_price"),
        )
        .where(F.col("entry_price").isNotNull())
    )


def period_returns(weights: DataFrame, bars: DataFrame) -> DataFrame:
    """Open-to-open return and contribution of each held name."""
    priced = entry_exit_prices(weights, bars).withColumn(
        "asset_return", period_return("exit_price", "entry_price")
    )
    return priced.withColumn("contribution", F.col("weight") * F.col("asset_return"))


def gross_returns(held: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return held.groupBy(*by).agg(
        F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("gross_return"), F.count("*").alias("positions")
    )


def turnover_trades(held: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Signed weight traded per name at each rebalance, exits included.

    The weights of the rebalance before drift by (1 + r_i) / (1 + gross return) until they are
    traded. Each row feeds its own rebalance as the target and the next one as the holding, so
    one aggregation replaces a full outer join.
    """
    scen, rid = by
    total = F.sum(F.coalesce("contribution", F.lit(0.0))).over(Window.partitionBy(*by))
    rows = held.select(
        scen, rid, "symbol", "weight",
        (F.col("weight") * (F.lit(1.0) + F.coalesce("asset_return", F.lit(0.0)))
         / (F.lit(1.0) + total)).alias("_drift"),
    )
    follow = rows.select(scen, rid).distinct().withColumn(
        "_next", F.lead(rid).over(Window.partitionBy(scen).orderBy(rid))
    )
    rows = rows.join(follow, [scen, rid])
    both = rows.select(
        scen, "symbol",
        F.explode(F.array(
            F.struct(F.col(rid).alias(rid), F.col("weight").alias("target"), F.lit(0.0).alias("prior")),
            F.struct(F.col("_next").alias(rid), F.lit(0.0).alias("target"), F.col("_drift").alias("prior")),
        )).alias("_m"),
    ).select(scen, "symbol", f"_m.{rid}", "_m.target", "_m.prior").where(F.col(rid).isNotNull())
    return both.groupBy(scen, rid, "symbol").agg(
        F.sum("prior").alias("prior_weight"), F.sum("target").alias("target_weight")
    ).withColumn("traded", F.col("target_weight") - F.col("prior_weight"))


def turnover_costs(held: DataFrame, bps, by: Sequence[str] = KEY) -> DataFrame:
    """Turnover and cost per rebalance; ``bps`` is a number or a per-scenario column expression."""
    traded = turnover_trades(held, by).groupBy(*by).agg(F.sum(F.abs("traded")).alias("turnover"))
    return traded.withColumn("cost", F.col("turnover") * _num(bps) / F.lit(10_000.0))


def per_scenario(scenarios: Sequence[Mapping], field: str) -> Column:
    """The value of a scenario field as an expression over the ``scenario`` column."""
    pairs = [x for s in scenarios for x in (F.lit(s["scenario"]), F.lit(s[field]))]
    return F.try_element_at(F.create_map(*pairs), F.col("scenario"))


def split_orders(trades: DataFrame, min_qty: float = 1e-9) -> DataFrame:
    """Signed change to BUY / SELL / SHORT / COVER rows; a change of side yields two."""
    prior, target = F.col("prior_weight"), F.col("target_weight")
    leg = lambda action, qty: F.struct(F.lit(action).alias("action"), qty.alias("qty"))
    zero = F.lit(0.0)
    pos, neg = lambda c: F.greatest(c, zero), lambda c: F.greatest(-c, zero)
    # Long and short parts move separately: growing a long part is BUY, shrinking it SELL;
    # shrinking a short part is COVER, growing it SHORT.
    legs = F.array(
        leg("COVER", neg(prior) - neg(target)), leg("BUY", pos(target) - pos(prior)),
        leg("SELL", pos(prior) - pos(target)), leg("SHORT", neg(target) - neg(prior)),
    )
    rest = [c for c in trades.columns]
    return trades.select(
        *rest, F.explode(F.filter(legs, lambda x: x["qty"] > F.lit(min_qty))).alias("_o")
    ).select(*rest, "_o.action", "_o.qty")


def net_returns(held: DataFrame, costs: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Gross, cost, net and compounded equity per rebalance."""
    from .metrics import compound_equity

    rows = gross_returns(held, by).join(costs, list(by)).withColumn(
        "net_return", F.col("gross_return") - F.col("cost")
    )
    return compound_equity(rows, by[:1], by[1])


def daily_mark(
    held: DataFrame, ledger: DataFrame, schedule: DataFrame, bars: DataFrame, cal: DataFrame,
    initial: float = 100_000.0,
) -> DataFrame:
    """Account equity on every session of a holding period, and a flat row at its exit.

    ``held``: weights with entry prices; ``ledger``: net_returns output; ``schedule`` with
    session indices per (scenario, rebalance_id). On a shared date the next entry wins over the
    previous exit.
    """
    w = Window.partitionBy("scenario").orderBy("rebalance_id")
    start = F.coalesce(F.lag("equity").over(w), F.lit(1.0)) * F.lit(float(initial))
    acct = ledger.select(
        *KEY, start.alias("_start"), (F.col("equity") * F.lit(float(initial))).alias("_end"),
        "cost", "turnover",
    ).join(schedule.select(*KEY, "entry_idx", "exit_idx", "entry_date", "exit_date"), list(KEY))
    days = held_sessions(acct.select(*KEY, "entry_idx", "exit_idx"), cal).select(*KEY, "date")
    marks = (
        days.join(held.select(*KEY, "symbol", "weight", "entry_price"), list(KEY))
        .join(bars.select("date", "symbol", "open"), ["date", "symbol"])
        .groupBy(*KEY, "date")
        .agg(
            F.sum(F.col("weight") * period_return("open", "entry_price")).alias("_float"),
            F.sum(F.abs("weight")).alias("gross_exposure"), F.count("*").alias("position_count"),
        )
    )
    first = F.col("date") == F.col("entry_date")
    opened = marks.join(acct, list(KEY)).select(
        *KEY, "date", F.lit(1).alias("_prio"),
        (F.col("_start") * (F.lit(1.0) - F.col("cost") + F.col("_float"))).alias("equity_usd"),
        (F.col("_start") * (F.lit(1.0) - F.col("cost"))).alias("balance_usd"),
        "gross_exposure", "position_count",
        F.when(first, F.col("turnover")).otherwise(0.0).alias("turnover"),
        F.when(first, F.col("cost") * F.col("_start")).otherwise(0.0).alias("cost_usd"),
    )
    closed = acct.select(
        *KEY, F.col("exit_date").alias("date"), F.lit(0).alias("_prio"), F.col("_end").alias("equity_usd"),
        F.col("_end").alias("balance_usd"), F.lit(0.0).alias("gross_exposure"),
        F.lit(0).cast("bigint").alias("position_count"), F.lit(0.0).alias("turnover"),
        F.lit(0.0).alias("cost_usd"),
    )
    return dedup_keep_last(opened.unionByName(closed), ["scenario", "date"], ["_prio", "rebalance_id"]).drop("_prio")


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``, as an aggregation (no per-key sort). One whole number as ``order``
    (``ordered_key`` packs several) keeps it hashed; several columns make it sort."""
    rest = [c for c in df.columns if c not in keys]
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    # Each column by itself: a plain value beside a plain order is what a hashed aggregation can hold.
    if len(order) == 1:
        return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in rest])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*")


def complete_calendar(ledger: DataFrame, cal: DataFrame, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Sessions without a row between a ledger's first and last become flat cash days."""
    span = ledger.groupBy(*by).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    pos = cal.select("date", "idx")
    ends = span.join(pos.withColumnsRenamed({"date": "_a", "idx": "_ia"}), "_a").join(
        pos.withColumnsRenamed({"date": "_b", "idx": "_ib"}), "_b"
    )
    days = ends.select(*by, F.explode(F.sequence("_ia", "_ib")).alias("idx")).join(pos, "idx").drop("idx")
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = days.join(ledger.withColumn("_real", F.lit(True)), [*by, "date"], "left")
    carried = {c: F.last(c, ignorenulls=True).over(w) for c in ("equity_usd", "balance_usd")}
    flat = {
        "gross_exposure": F.coalesce("gross_exposure", F.lit(0.0)),
        "position_count": F.coalesce("position_count", F.lit(0)),
        "turnover": F.coalesce("turnover", F.lit(0.0)), "cost_usd": F.coalesce("cost_usd", F.lit(0.0)),
    }
    # The carried balance of a cash day is the equity it was carried with.
    return joined.withColumns(carried).withColumns(flat).withColumns({
        "cash_pct": F.lit(1.0) - F.col("gross_exposure"),
        "is_cash_day": F.col("_real").isNull(),
    }).drop("_real")


def ledger_drilldown(day: DataFrame, pos: DataFrame) -> DataFrame:
    """Positions behind a journal day, largest absolute weight first."""
    return day.select("scenario", "rebalance_id", "date").join(pos, list(KEY)).orderBy(
        "date", F.abs("weight").desc(), "symbol"
    )


def day_detail(day: DataFrame, positions: DataFrame, orders: DataFrame, rebalances: DataFrame) -> DataFrame:
    """All that lies behind a journal day: its rebalance, the orders of that, and the positions by absolute weight.

    (scenario, rebalance_id, date, kind, place, symbol, action, value): turnover of the rebalance, traded weight of an order, weight of
    a position.
    """
    days = day.select(*KEY, "date")
    parts = (
        rebalances.select(*KEY, F.lit("rebalance").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("action"), F.col("turnover").alias("value")),
        orders.select(*KEY, F.lit("order").alias("kind"), "symbol", "action", F.col("qty").alias("value")),
        positions.select(*KEY, F.lit("position").alias("kind"), "symbol", F.col("side").alias("action"), F.col("weight").alias("value")),
    )
    # Numbered once per rebalance, before days repeat them; rounded, so that equal weights tie by symbol.
    order = Window.partitionBy(*KEY, "kind").orderBy(F.round(F.abs("value"), 9).desc(), "symbol", "action")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("place", F.row_number().over(order)).join(days, list(KEY))


def rebalance_diff(current: DataFrame, targets: DataFrame, equity: float, min_usd: float = 25.0, min_share: float = 0.001) -> DataFrame:
    """Proposed orders: CLOSE what is not wanted, BUY or SELL what moves enough."""
    j = current.select("symbol", F.col("notional").alias("_c")).join(
        targets.select("symbol", (F.col("weight") * F.lit(float(equity))).alias("_t")), "symbol", "full"
    )
    cur, tgt = F.coalesce("_c", F.lit(0.0)), F.coalesce("_t", F.lit(0.0))
    delta = tgt - cur
    action = F.when(F.col("_t").isNull(), "CLOSE").when(delta > 0, "BUY").otherwise("SELL")
    floor = F.lit(max(float(min_usd), float(equity) * float(min_share)))
    return j.where(F.col("_t").isNull() | (F.abs(delta) >= floor)).select(
        "symbol", action.alias("action"), cur.alias("current_notional"), tgt.alias("target_notional"),
        delta.alias("delta"),
    )


def untradable_anti(targets: DataFrame, assets: DataFrame) -> DataFrame:
    """Targets that cannot be traded, or not sold short, with the reason."""
    a = assets.select("symbol", "tradable", "shortable", "borrow_status")
    j = targets.join(a, "symbol", "left")
    short = F.col("weight") < 0
    reasons = F.filter(F.array(
        F.when(~F.coalesce("tradable", F.lit(False)), F.lit("not_tradable")),
        F.when(short & ~F.coalesce("shortable", F.lit(False)), F.lit("not_shortable")),
        F.when(short & (F.lower("borrow_status") == "hard_to_borrow"), F.lit("hard_to_borrow")),
    ), lambda r: r.isNotNull())
    return j.select("symbol", "weight", F.explode(reasons).alias("reason"))


def exposure_gate(targets: DataFrame, today, latest) -> DataFrame:
    """Pre-trade checks of a target table as (name, ok, value) rows."""
    agg = targets.agg(
        F.coalesce(F.sum(F.abs("weight")), F.lit(0.0)).alias("_g"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_n"), F.count("*").alias("_k"),
    ).withColumn("_age", F.datediff(today, latest))
    check = lambda name, ok, v: F.struct(
        F.lit(name).alias("name"), ok.alias("ok"), v.cast("double").alias("value"))
    rows = F.array(
        check("gross_exposure", F.col("_g") <= 2.0001, F.col("_g")),
        check("net_exposure", F.abs("_n") <= 0.10, F.col("_n")),
        check("position_count", (F.col("_k") > 0) & (F.col("_k") <= 200), F.col("_k")),
        check("data_freshness", F.col("_age") <= 4, F.col("_age")),
    )
    return agg.select(F.explode(rows).alias("c")).select("c.*")
