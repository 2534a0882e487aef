"""Per-symbol time-series features on bars: one shuffle and one sort serve all of them."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import by_date, by_symbol, clip, dealt, full_window, past, period_return, ratio, true_or_false
from ..functions.cols import TRADING_DAYS
from ..plans.materialize import cut
from .ranks import medians, too_wide

ANNUAL = TRADING_DAYS ** 0.5


def returns_n(df: DataFrame, ns: Sequence[int], price: str = "close") -> DataFrame:
    """ret_{n}d = price / price n rows back - 1, with no filling."""
    w = by_symbol()
    return df.withColumns({f"ret_{n}d": period_return(price, F.lag(price, n).over(w)) for n in ns})


def momentum_12_1(df: DataFrame) -> DataFrame:
    return df.withColumn("momentum_12_1", F.col("ret_252d") - F.col("ret_20d"))


def rolling_vol(df: DataFrame, ns: Sequence[int], ret: str = "ret_1d") -> DataFrame:
    """Annualised sample deviation over a full window of daily returns."""
    w = by_symbol()
    return df.withColumns({
        f"vol_{n}d": full_window(F.stddev_samp(ret), F.col(ret), past(w, n), n) * F.lit(ANNUAL)
        for n in ns
    })


def sma_trend(df: DataFrame, ns: Sequence[int], price: str = "close") -> DataFrame:
    """Simple moving averages and the distance of the price from them.

    The mean of n rows is a difference of running sums, so a long average costs no more than a
    short one; a sliding frame would add up all n values again for every row.
    """
    w = by_symbol()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    base = df.withColumns({
        "_sum": F.sum(F.coalesce(price, F.lit(0.0))).over(run), "_known": F.count(price).over(run)
    })

    def sma(n: int):
        before = lambda c: F.coalesce(F.lag(c, n).over(w), F.lit(0))
        full = F.col("_known") - before("_known") == F.lit(n)
        return F.when(full, (F.col("_sum") - before("_sum")) / F.lit(float(n)))

    return (
        base.withColumns({f"sma_{n}": sma(n) for n in ns})
        .withColumns({f"trend_{n}": period_return(price, f"sma_{n}") for n in ns})
        .drop("_sum", "_known")
    )


def rolling_median_dv(df: DataFrame, n: int = 60, need: int = 40) -> DataFrame:
    """Median dollar volume of the last ``n`` bars, once ``need`` are known.

    Sorting the (at most ``n``) values of the frame is about three times faster than the
    ``percentile`` aggregate, which rebuilds a hash map for every row.
    """
    w = past(by_symbol(), n)
    size = F.size("_dv")
    low = F.try_element_at("_dv", F.floor((size + F.lit(1)) / F.lit(2)).cast("int"))
    high = F.try_element_at("_dv", F.floor(size / F.lit(2)).cast("int") + F.lit(1))
    return (
        df.withColumn("_dv", F.sort_array(F.collect_list("dollar_volume").over(w)))
        .withColumn(
            f"median_dollar_volume_{n}", F.when(size >= F.lit(need), (low + high) / F.lit(2.0))
        )
        .drop("_dv")
    )


def sessions_to_date(df: DataFrame) -> DataFrame:
    return df.withColumn("history_sessions_to_date", F.row_number().over(by_symbol()))


def solid_eligible(
    df: DataFrame, min_price: float, min_sessions: int, min_dollar_volume: float, max_vol: float,
    base: str = "solid_fundamental_eligible",
) -> DataFrame:
    """Point-in-time trading eligibility; anything unknown is not eligible."""
    ok = (
        F.col(base)
        & (F.col("close") >= F.lit(float(min_price)))
        & (F.col("history_sessions_to_date") >= F.lit(int(min_sessions)))
        & (F.col("median_dollar_volume_60") >= F.lit(float(min_dollar_volume)))
        & (F.col("vol_60d") <= F.lit(float(max_vol)))
    )
    return df.withColumn("solid_eligible", true_or_false(ok))


def technical(bars: DataFrame) -> DataFrame:
    """All per-symbol columns of the feature panel."""
    df = bars.withColumn("dollar_volume", F.col("close") * F.col("volume"))
    df = returns_n(df, [1, 5, 20, 60, 120, 252])
    df = rolling_vol(momentum_12_1(df), [20, 60])
    df = rolling_median_dv(sma_trend(df, [50, 200]))
    return sessions_to_date(df)


def forward_return(
    df: DataFrame, h: int = 20, price: str = "close", universe: int | None = None, rows_bound: int | None = None,
) -> DataFrame:
    """Return over the next ``h`` rows of the symbol, and the excess over the date's mean.

    With ``rows_bound``, an upper bound of the rows, whole dates are dealt to tasks of bounded size.
    """
    fwd, rel = f"future_{h}d", f"future_relative_{h}d"
    out = df.withColumn(fwd, period_return(F.lead(price, h).over(by_symbol()), price))
    return _excess(out if too_wide(universe) else dealt(out, ["date"], rows_bound), fwd, rel, universe)


def _excess(df: DataFrame, col: str, out: str, universe: int | None) -> DataFrame:
    """Value minus the mean of its date. The window shares the shuffle of later date ranks; for
    a wide universe the rows are stored, the mean is aggregated map side and joined back."""
    if too_wide(universe):
        df = cut(df)
        mean = df.groupBy("date").agg(F.avg(col).alias("_mean"))
        return df.join(mean, "date", "left").withColumn(out, F.col(col) - F.col("_mean")).drop("_mean")
    return df.withColumn(out, F.col(col) - F.avg(col).over(by_date()))


def execution_target(df: DataFrame, h: int = 10, universe: int | None = None) -> DataFrame:
    """Open-to-open return entered one session after the signal and held ``h`` sessions."""
    w = by_symbol()
    out = df.withColumn(
        "future_open_return",
        period_return(F.lead("open", h + 1).over(w), F.lead("open", 1).over(w)),
    )
    return _excess(out, "future_open_return", "future_relative_open", universe)


EWMA_BLOCK = 64


def ewma_score(
    df: DataFrame, col: str, span: float = 5, out: str | None = None, by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """One-sided exponential smoothing per symbol, s = a*x + (1-a)*previous, from its first row.

    The known rows of a key are numbered and cut into blocks. Within a block s is a running sum of
    inputs scaled by powers of 1-a, whose range 64 rows keep; what the earlier blocks leave is folded
    over one number per block and joined back. Exact for each span, linear in the rows. Rows whose input is null carry no smoothed value.
    """
    alpha, name, x = 2.0 / (span + 1.0), out or f"{col}_smooth", F.col(col)
    if alpha >= 1.0:
        return df.withColumn(name, x.cast("double"))
    rest, keys = F.lit(1.0 - alpha), list(by)
    past_rows = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # Rows without input take the number of the known row before them and add nothing.
    known = df.withColumn("_n", F.count(x).over(past_rows) - 1).withColumns({
        "_block": F.floor(F.col("_n") / EWMA_BLOCK).cast("int"), "_pos": F.pmod("_n", F.lit(EWMA_BLOCK)),
    })
    term = F.col(col) * F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    sums = F.sum(term * F.pow(rest, -F.col("_pos"))).over(
        Window.partitionBy(*keys, "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("_in", F.pow(rest, F.col("_pos").cast("double")) * sums)
    # What the end of a block hands on; a key has one row per 64 of its own.
    ends = known.where((F.col("_pos") == EWMA_BLOCK - 1) & x.isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_block", "_in"))).alias("_ends"))
    empty = F.array().cast("array<struct<_block:int,_carry:double>>")
    carried = F.aggregate("_ends", empty, lambda done, e: F.concat(done, F.array(F.struct(
        (e["_block"] + 1).alias("_block"),
        (e["_in"] + F.pow(rest, F.lit(float(EWMA_BLOCK))) * F.coalesce(F.try_element_at(done, F.lit(-1))["_carry"], F.lit(0.0))).alias("_carry"),
    ))))
    carries = ends.select(*keys, F.explode(carried).alias("_c")).select(*keys, "_c._block", "_c._carry")
    smooth = F.col("_in") + F.pow(rest, F.col("_pos") + 1.0) * F.coalesce("_carry", F.lit(0.0))
    return known.join(carries, [*keys, "_block"], "left").withColumn(name, F.when(x.isNotNull(), smooth)).select(*df.columns, name)


def eps_change(pit: DataFrame) -> DataFrame:
    """Row-to-row change of the as-of EPS: non-zero only on the row a filing lands."""
    return pit.withColumn("earnings_raw", period_return("eps", F.lag("eps").over(by_symbol())))


def band_membership(df: DataFrame, n: int, buffer: int, rank: str = "rank", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Enter at rank <= n, leave at rank > n + buffer, otherwise keep the last state."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col(rank) <= F.lit(n), F.lit(True)).when(
        F.col(rank) > F.lit(n + buffer), F.lit(False)
    )
    return df.withColumn("held", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))


# --- date-level series -------------------------------------------------------------------


def market_context(panel: DataFrame, universe: int | None = None) -> DataFrame:
    """Per date: mean and spread of 20-day returns, median volatility, two breadth shares."""
    up = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
    out = panel.groupBy("date").agg(
        F.avg("ret_20d").alias("market_ret_20"),
        *([] if too_wide(universe) else [F.percentile("vol_20d", F.lit(0.5)).alias("market_vol_20")]),
        F.stddev_samp("ret_20d").alias("market_dispersion_20"),
        up("ret_20d").alias("market_breadth_20"),
        up("trend_200").alias("market_trend_breadth"),
    )
    if too_wide(universe):
        out = out.join(medians(panel, "vol_20d", ["date"], "market_vol_20", universe), "date", "left")
    return out.select("date", "market_ret_20", "market_vol_20", "market_dispersion_20", "market_breadth_20", "market_trend_breadth")


def expanding_median(df: DataFrame, col: str, out: str, need: int = 60) -> DataFrame:
    """Median of all earlier dates (the current one excluded) once ``need`` are known.

    Date-level input only: one row per session. Earlier values are kept in order as they come, so a date costs
    a search and an insertion instead of a sort of its past.
    """
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past: list[float] = []
        for batch in batches:
            found = []
            for v in batch.column(col).to_pylist():
                n = len(past)
                found.append(0.5 * past[(n - 1) // 2] + 0.5 * past[n // 2] if n >= max(need, 1) else None)
                if v is not None:
                    insort(past, v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=schema.names)

    return df.repartition(1).sortWithinPartitions("date").mapInArrow(run, schema)


def vol_reference(ctx: DataFrame) -> DataFrame:
    return expanding_median(ctx, "market_vol_20", "vol_reference")


REGIMES = ("TREND_UP", "NEUTRAL", "HIGH_VOL", "RISK_OFF")


def classify_regime(
    ctx: DataFrame, risk_off: float = -0.03, trend_up: float = 0.03, vol_ratio: float = 1.25,
    out: str = "regime",
) -> DataFrame:
    label = (
        F.when(true_or_false(F.col("market_ret_20") < F.lit(risk_off)), "RISK_OFF")
        .when(true_or_false(F.col("market_vol_20") > F.col("vol_reference") * F.lit(vol_ratio)), "HIGH_VOL")
        .when(true_or_false(F.col("market_ret_20") > F.lit(trend_up)), "TREND_UP")
        .otherwise("NEUTRAL")
    )
    return ctx.withColumn(out, label)


def market_vol_ratio(bars: DataFrame, lookback: int = 20, need: int = 60) -> DataFrame:
    """(date, market_ret, market_vol, calm): usual market volatility of the past over the present one."""
    daily = (
        returns_n(bars, [1]).groupBy("date").agg(F.avg("ret_1d").alias("market_ret"))
    )
    w = past(Window.orderBy("date"), lookback)
    vol = full_window(F.stddev_samp("market_ret"), F.col("market_ret"), w, lookback) * F.lit(ANNUAL)
    daily = expanding_median(daily.withColumn("market_vol", vol), "market_vol", "_ref", need)
    return daily.withColumn("calm", ratio("_ref", "market_vol")).drop("_ref")


def market_risk_scale(bars: DataFrame, floor: float = 0.45, lookback: int = 20, need: int = 60) -> DataFrame:
    """(date, market_ret, market_vol, scale): calm market 1, stressed market down to ``floor``."""
    scale = F.coalesce(clip("calm", floor, 1.0), F.lit(1.0))
    return market_vol_ratio(bars, lookback, need).withColumn("scale", scale).drop("calm")
