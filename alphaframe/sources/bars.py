"""Market data: bars, snapshots, asset lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import any_of, dealt, ratio
from ..functions.frames import ROWS_PER_HASH

BAR_COLUMNS = ("open", "high", "low", "close", "volume", "vwap")

# Exchanges traded, name fragments of fund-like products and fund sponsors.
EXCHANGES = ("NASDAQ", "NYSE", "ARCA", "AMEX")
FUND_WORDS = (" ETF", " ETN", " FUND", " WARRANT", " RIGHTS", " UNIT")
SPONSOR_WORDS = (
    "PROSHARES", "DIREXION", "ISHARES", "SPDR ", "VANGUARD ", "GLOBAL X ", "WISDOMTREE",
    "VANECK ", "ARK ETF", "ULTRAPRO", "ULTRASHORT", "DAILY BULL", "DAILY BEAR", "2X SHARES",
    "3X SHARES",
)

_BARS_JSON = (
    "struct<bars: map<string, array<struct<"
    "t: string, o: double, h: double, l: double, c: double, v: double, vw: double>>>>"
)
_BAR = "struct<c: double, v: double>"
_SNAPSHOTS_JSON = f"map<string, struct<dailyBar: {_BAR}, prevDailyBar: {_BAR}>>"


def scan_bars(spark: SparkSession, path: str, order: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    """Bars unique on (date, symbol); the first by ``order`` wins, which makes it repeatable."""
    return unique_bars(spark.read.parquet(path), order)


def unique_bars(df: DataFrame, order: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    """Aggregation rather than a window, so duplicates collapse before the shuffle; one whole number as ``order`` keeps
    it hashed, several columns make it sort."""
    rest = [c for c in df.columns if c not in ("date", "symbol")]
    if len(order) == 1:
        return df.groupBy("date", "symbol").agg(*[F.min_by(c, order[0]).alias(c) for c in rest])
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy("date", "symbol").agg(first).select("date", "symbol", "_b.*")


def resample_bars(
    df: DataFrame, date: Column, price: Column, qty: Column, symbol: Column, tie: Column, rows_bound: int | None = None,
) -> DataFrame:
    """Transactions to one OHLCV + vwap bar per (date, symbol), pre-aggregated map side.

    Where most bars have few transactions, the map side keeps a group for nearly every row it reads, and its
    table grows with the file split. ``rows_bound``, an upper bound of the transactions, deals them by bar to tasks of
    bounded size before anything is grouped; all transactions of one bar then pass one task, which keeps one group for them.

    ``tie`` orders the transactions of a bar and has to be unique inside it. Give it as one
    number where possible (``ordered_key`` packs several): the aggregation then stays hashed,
    while a struct would make it sort.
    """
    rows = df.select(
        date.alias("date"), symbol.alias("symbol"), price.alias("_p"), qty.alias("_q"),
        tie.alias("_at"),
    )
    return dealt(rows, ["date", "symbol"], rows_bound, ROWS_PER_HASH).groupBy("date", "symbol").agg(
        F.min_by("_p", "_at").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_at").alias("close"),
        F.sum("_q").alias("volume"),
        ratio(F.sum(F.col("_p") * F.col("_q")), F.sum("_q")).alias("vwap"),
    )


def ordered_key(**digits: int) -> Column:
    """Several whole-number columns as one decimal with their lexicographic order.

    ``digits`` gives the width of each column; together at most 38. A value that does not fit
    raises instead of losing the order.
    """
    left, total = sum(digits.values()), None
    for name, width in digits.items():
        left -= width
        part = F.col(name).cast(f"decimal({width},0)")
        if left:
            part = part * F.lit(10 ** left).cast(f"decimal({left + 1},0)")
        total = part if total is None else total + part
    return total


def flatten_bars_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """{"bars": {symbol: [{t,o,h,l,c,v,vw}]}} to rows; vwap falls back to the close."""
    parsed = df.select(F.from_json(payload, _BARS_JSON).alias("j"))
    rows = parsed.select(F.explode("j.bars").alias("symbol", "list")).select(
        "symbol", F.explode("list").alias("b")
    )
    return rows.select(
        F.to_date(F.to_timestamp("b.t")).alias("date"), "symbol",
        F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"),
        F.col("b.c").alias("close"), F.col("b.v").alias("volume"),
        F.coalesce("b.vw", "b.c").alias("vwap"),
    )


def flatten_snapshots(df: DataFrame, min_price: float, payload: str = "payload") -> DataFrame:
    """Snapshot maps to (symbol, price, volume, dollar_volume); today's bar, else yesterday's.

    Accepts the bare map and the one wrapped in {"snapshots": …}.
    """
    inner = F.coalesce(F.get_json_object(payload, "$.snapshots"), F.col(payload))
    rows = df.select(F.explode(F.from_json(inner, _SNAPSHOTS_JSON)).alias("symbol", "s"))
    bar = rows.select("symbol", F.coalesce("s.dailyBar", "s.prevDailyBar").alias("b"))
    priced = bar.select(
        "symbol", F.coalesce("b.c", F.lit(0.0)).alias("price"), F.coalesce("b.v", F.lit(0.0)).alias("volume")
    )
    return (
        priced.where((F.col("price") >= F.lit(float(min_price))) & (F.col("volume") > 0))
        .withColumn("dollar_volume", F.col("price") * F.col("volume"))
        .orderBy(F.col("dollar_volume").desc(), "symbol")
    )


def filter_assets(df: DataFrame) -> DataFrame:
    """Distinct tradable, fractionable common-stock tickers of the listed exchanges."""
    ticker = F.upper("symbol")
    name = F.concat(F.lit(" "), F.upper(F.coalesce("name", F.lit(""))))
    fund = any_of([F.contains(name, F.lit(w)) for w in FUND_WORDS + SPONSOR_WORDS])
    return (
        df.where(
            (F.length(ticker) <= 10) & ticker.rlike(r"^[A-Z0-9.\-]+$")
            & F.col("exchange").isin(*EXCHANGES) & F.col("tradable") & F.col("fractionable") & ~fund
        )
        .select(ticker.alias("symbol")).distinct().orderBy("symbol")
    )
