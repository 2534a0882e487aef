"""Session calendar and positional date arithmetic.

The calendar has one row per trading date, so single-partition windows over it are bounded
by the length of history, whatever the number of symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, idx): distinct dates with their zero-based position."""
    w = Window.orderBy("date")
    return (
        df.select(F.col(date).alias("date")).distinct()
        .withColumn("idx", F.row_number().over(w) - F.lit(1))
    )


def align_execution_dates(cal: DataFrame, every: int, warmup: int = 0) -> DataFrame:
    """Signal at session T, entry at T+1, exit at (next signal)+1; rows past the end are dropped."""
    w = Window.orderBy("idx")
    nxt = cal.withColumn("entry_date", F.lead("date", 1).over(w))
    signals = nxt.where(
        (F.col("idx") >= F.lit(warmup)) & ((F.col("idx") - F.lit(warmup)) % F.lit(every) == 0)
    )
    return (
        signals
        .withColumn("exit_date", F.lead("entry_date", 1).over(w))
        .withColumn("exit_idx", F.lead("idx", 1).over(w) + F.lit(1))
        .withColumn("rebalance_id", F.row_number().over(w))
        .where(F.col("exit_date").isNotNull())
        .select(
            "rebalance_id", F.col("date").alias("signal_date"), F.col("idx").alias("signal_idx"),
            "entry_date", (F.col("idx") + F.lit(1)).alias("entry_idx"), "exit_date", "exit_idx",
        )
    )


def trailing_sessions(decisions: DataFrame, cal: DataFrame, lookback: int) -> DataFrame:
    """(decision, date): each decision date with its last ``lookback`` sessions, itself included.

    The interval is expanded with ``sequence`` and resolved by an equi join on the session
    index, so no range join is planned.
    """
    pos = cal.select(F.col("date").alias("decision"), F.col("idx").alias("_d"))
    wanted = (
        decisions.select("decision").distinct().join(pos, "decision")
        .select(
            "decision",
            F.explode(F.sequence(F.greatest(F.lit(0), F.col("_d") - F.lit(lookback - 1)), F.col("_d")))
            .alias("idx"),
        )
    )
    return wanted.join(cal, "idx").select("decision", "date")


def held_sessions(schedule: DataFrame, cal: DataFrame) -> DataFrame:
    """Every session a rebalance is open: entry included, exit excluded."""
    span = schedule.withColumn(
        "idx", F.explode(F.sequence(F.col("entry_idx"), F.col("exit_idx") - F.lit(1)))
    )
    return span.join(cal, "idx").drop("idx")


def fold_range_join(cal: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, role, date) for folds given as session-index intervals.

    ``folds``: fold, train_stop, val_start, val_stop, test_start, test_stop (half open; the
    validation interval may be null). Both sides are calendar sized.
    """
    roles = folds.select(
        "fold",
        F.explode(F.array(
            F.struct(F.lit("train").alias("role"), F.lit(0).alias("lo"), F.col("train_stop").alias("hi")),
            F.struct(F.lit("validation").alias("role"), F.col("val_start").alias("lo"), F.col("val_stop").alias("hi")),
            F.struct(F.lit("test").alias("role"), F.col("test_start").alias("lo"), F.col("test_stop").alias("hi")),
        )).alias("r"),
    ).select("fold", "r.role", "r.lo", "r.hi").where(F.col("hi") > F.col("lo"))
    expanded = roles.select(
        "fold", "role", F.explode(F.sequence(F.col("lo"), F.col("hi") - F.lit(1))).alias("idx")
    )
    return expanded.join(cal, "idx").select("fold", "role", "date")


def latest_cross_section(df: DataFrame, score: str | None = None, last: Column | None = None) -> DataFrame:
    """Rows of the last date, or of the last date on which ``score`` is known.

    ``last`` saves planning ``df`` twice when a cheaper source knows that date.
    """
    known = df if score is None else df.where(F.col(score).isNotNull())
    return known.where(F.col("date") == (known.agg(F.max("date")).scalar() if last is None else last))


def period_filter(df: DataFrame, days: int | None, last: Column | None = None) -> DataFrame:
    """Rows within ``days`` calendar days of the end of the series, or of ``last``; all rows for None."""
    if days is None:
        return df
    end = df.agg(F.max("date")).scalar() if last is None else last
    return df.where(F.col("date") >= F.date_sub(end, days))
