"""Cross-sectional ranks.

Two physical plans give the same ranks:

* one window per group: right while a group (one date) fits one task comfortably;
* range split (``universe`` above ``SPLIT_AT``): the distinct values of a group are cut into
  value ranges at approximate quantiles, ranked inside each range, and shifted by the number
  of rows in the ranges below. Values are counted before the shuffle, so a value shared by
  many rows is one row there, and no task ever sorts a whole group. Rows meet their ranks once a column, so they
  are stored first and after each column: what made them runs once, and the shuffles of one column at a time take disk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, ratio
from ..plans.materialize import cut, discard

SPLIT_AT = 400_000     # rows of one group a single task may sort; ten ranks of 250,000 take 2.2 GB in all, orders one after another
RANGE_ROWS = 100_000   # target rows per value range in the split plan
RANK_FLOOR, RANK_CEIL = 0.001, 0.999


def _window_rank(value: str, by: Sequence[str]) -> tuple[Column, Column]:
    """(average rank, number of known values), both from one sort order."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    upto_ties = F.count(value).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    known = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (F.rank().over(w) + upto_ties) / F.lit(2.0), known


def value_ranks(df: DataFrame, value: str, by: Sequence[str], ranges: int) -> DataFrame:
    """(by…, value, avg_rank, known) for each distinct value, ranked range by range."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    cuts = counted.groupBy(*by).agg(
        F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts")
    )
    placed = counted.join(cuts, list(by)).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    sizes = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows"))
    g = Window.partitionBy(*by).orderBy("_range")
    below = sizes.select(
        *by, "_range",
        (F.sum("_rows").over(g) - F.col("_rows")).alias("_below"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("known"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    return (
        placed.withColumn("_upto", F.sum("_n").over(inside))
        .join(below, [*by, "_range"])
        .select(
            *by, value, "known",
            (F.col("_below") + F.col("_upto") - (F.col("_n") - F.lit(1)) / F.lit(2.0)).alias("avg_rank"),
        )
    )


def medians(df: DataFrame, value: str, by: Sequence[str], out: str, universe: int | None = None) -> DataFrame:
    """(by…, out): the exact median of the known values of each group.

    A group too wide for one buffer is selected from: distinct values are counted, cut at approximate quantiles, and only
    the ranges that hold the middle are looked into.
    """
    known = df.where(F.col(value).isNotNull())
    if not too_wide(universe):
        return known.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias(out))
    ranges = _ranges(universe)
    counted = known.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = counted.groupBy(*by).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    placed = counted.join(cuts, list(by)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    g = Window.partitionBy(*by).orderBy("_range")
    sizes = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows")).select(
        *by, "_range", (F.sum("_rows").over(g) - F.col("_rows")).alias("_below"), F.sum("_rows").over(g).alias("_upto"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda k: (F.col("_below") < k) & (k <= F.col("_upto"))
    middle = sizes.where(holds(low) | holds(high)).drop("_upto")
    inside = Window.partitionBy(*by, "_range").orderBy("_v")
    rows = placed.join(middle, [*by, "_range"]).withColumn("_upto", F.col("_below") + F.sum("_n").over(inside)).withColumn(
        "_below", F.col("_upto") - F.col("_n"))
    at = lambda k: F.max(F.when(holds(k), F.col("_v")))
    return rows.groupBy(*by).agg((at(low) * F.lit(0.5) + at(high) * F.lit(0.5)).alias(out))


def pct_rank(
    df: DataFrame,
    cols: Sequence[str] | dict[str, str],
    by: Sequence[str] = ("date",),
    invert: Sequence[str] = (),
    universe: int | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Percentile rank: average rank of ties over the count of known values, clipped.

    ``cols`` maps source column to output column (a list appends ``_rank``); outputs named in
    ``invert`` become one minus the rank. Null stays null. ``universe`` is the largest number
    of rows a group can have, if known.
    """
    names = cols if isinstance(cols, dict) else {c: f"{c}_rank" for c in cols}
    split = too_wide(universe)
    out = df = cut(df) if split else df
    kept: list[DataFrame] = []
    ranked: dict[str, Column] = {}
    for src, dst in names.items():
        if split:
            if ranked:
                out = cut(out)
                discard(*kept)
                kept = [out]
            table = value_ranks(df, src, by, _ranges(universe))
            share = ratio("avg_rank", "known")
            table = table.select(*by, src, share.alias(f"_share_{dst}"))
            out = out.join(table, [*by, src], "left")
            share = F.col(f"_share_{dst}")
        else:
            rank, known = _window_rank(src, by)
            share = F.when(F.col(src).isNotNull(), ratio(rank, known))
        if bounded:
            share = clip(share, RANK_FLOOR, RANK_CEIL)
        ranked[dst] = F.lit(1.0) - share if dst in invert else share
    out = out.withColumns(ranked)
    return out.drop(*[f"_share_{d}" for d in names.values()]) if split else out


def too_wide(universe: int | None) -> bool:
    """Whether a group of ``universe`` rows should not be handled by a single task."""
    return universe is not None and universe > SPLIT_AT


def _ranges(universe: int) -> int:
    return max(2, -(-universe // RANGE_ROWS))


def split_ordinal(df: DataFrame, value: str, by: Sequence[str], tie: str, ranges: int) -> DataFrame:
    """Adds ``_ord`` (row number by value, then tie) and ``_known`` without sorting a whole group:
    rows are numbered inside value ranges and shifted by the size of the ranges below."""
    rows = cut(df.where(F.col(value).isNotNull()))
    cuts = rows.groupBy(*by).agg(
        F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    placed = rows.join(cuts, list(by)).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    g = Window.partitionBy(*by).orderBy("_range")
    below = placed.groupBy(*by, "_range").agg(F.count("*").alias("_rows")).select(
        *by, "_range", (F.sum("_rows").over(g) - F.col("_rows")).alias("_below"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_known"))
    inside = Window.partitionBy(*by, "_range").orderBy(value, tie)
    return (
        placed.withColumn("_in", F.row_number().over(inside)).join(below, [*by, "_range"])
        .withColumn("_ord", F.col("_below") + F.col("_in")).drop("_in", "_below", "_range")
    )


def bin_of(ordinal: Column, known: Column, k: int) -> Column:
    """Equal-count bin (0 … k-1) of the ordinal-th of ``known`` rows."""
    edge = F.ceil(ratio((ordinal - F.lit(1)) * F.lit(k), known - F.lit(1))) - F.lit(1)
    return F.greatest(F.lit(0), F.coalesce(edge, F.lit(0))).cast("int")


def quantile_bins(
    df: DataFrame, value: str, k: int = 5, by: Sequence[str] = ("date",), tie: str = "symbol",
    out: str = "bin", universe: int | None = None,
) -> DataFrame:
    """Equal-count bins of the ordinal rank; rows with a null value are dropped."""
    if too_wide(universe):
        rows = split_ordinal(df, value, by, tie, _ranges(universe))
        return rows.withColumn(out, bin_of(F.col("_ord"), F.col("_known"), k)).drop("_ord", "_known")
    w = Window.partitionBy(*by).orderBy(value, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.where(F.col(value).isNotNull()).withColumn(
        out, bin_of(F.row_number().over(w), F.count("*").over(whole), k))


def top_bottom_k(
    df: DataFrame,
    score: str,
    top: int,
    bottom: int = 0,
    min_names: int | None = None,
    by: Sequence[str] = ("date",),
    tie: str = "symbol",
    universe: int | None = None,
) -> DataFrame:
    """Long the ``top`` best and short the ``bottom`` worst names per group.

    Groups with fewer scored names than ``min_names`` (default top + bottom) are skipped. A
    short group larger than what is left after the longs is cut to the rest. For a wide
    universe each end is a separate "row number <= k", which Spark cuts down before the
    shuffle, and group sizes are counted map side; otherwise one window does it all.
    """
    need = top + bottom if min_names is None else min_names
    scored = df.where(F.col(score).isNotNull())
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    if too_wide(universe):
        up = Window.partitionBy(*by).orderBy(F.col(score).asc(), F.col(tie).desc())
        sizes = scored.groupBy(*by).agg(F.count("*").alias("candidates"))
        heads = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(top))
        ranked = heads.join(sizes, list(by))
        if bottom:
            tails = scored.withColumn("_up", F.row_number().over(up)).where(F.col("_up") <= F.lit(bottom))
            tails = tails.join(sizes, list(by)).withColumn(
                "rank", (F.col("candidates") - F.col("_up") + F.lit(1)).cast("int")).drop("_up")
            ranked = ranked.unionByName(tails.where(F.col("rank") > F.lit(top)))
    else:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = scored.withColumns(
            {"rank": F.row_number().over(w), "candidates": F.count("*").over(whole)})
    n_long = F.least(F.lit(top), F.col("candidates"))
    n_short = F.least(F.lit(bottom), F.col("candidates") - n_long)
    side = F.when(F.col("rank") <= n_long, F.lit("LONG")).when(
        F.col("rank") > F.col("candidates") - n_short, F.lit("SHORT")
    )
    return (
        ranked.where(F.col("candidates") >= F.lit(need))
        .withColumn("side", side).where(F.col("side").isNotNull())
    )


def row_numbers(df: DataFrame, order: Column, by: Sequence[str], tie: str, out: str, universe: int | None = None) -> DataFrame:
    """Adds the row number by ``order`` descending (unknown last), then ``tie``; range by range where a group is too wide for a task."""
    if too_wide(universe):
        down = df.withColumn("_down", F.coalesce(-order, F.lit(float("inf"))))
        return split_ordinal(down, "_down", by, tie, _ranges(universe)).withColumn(out, F.col("_ord").cast("int")).select(*df.columns, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order.desc_nulls_last(), F.col(tie).asc())))


def first_rank_filter(
    df: DataFrame, score: str, accepted: str, keep: int, by: Sequence[str] = ("date",),
    tie: str = "symbol", universe: int | None = None,
) -> DataFrame:
    """Number the accepted rows of a group by score and flag the first ``keep``; others have no number.

    Only accepted rows are ordered, and where a group may be too wide for one task, range by range.
    """
    counted = F.coalesce(F.col(accepted) & F.col(score).isNotNull(), F.lit(False))
    ordered = row_numbers(df.where(counted), F.col(score), by, tie, "selected_rank", universe)
    rest = df.where(~counted).withColumn("selected_rank", F.lit(None).cast("int"))
    return ordered.unionByName(rest).withColumn(
        "selected", F.coalesce(F.col("selected_rank") <= F.lit(keep), F.lit(False))
    )


def ranking_report(df: DataFrame, score: str, top: int = 30, bottom: int = 30) -> DataFrame:
    """Best and worst names of the last scored date with their rank in the whole list.

    Both ends are plain top-k scans, numbered after the cut, so the cross-section is never
    sorted as a whole.
    """
    from .calendar import latest_cross_section

    snap = latest_cross_section(df, score)
    size = snap.agg(F.count("*")).scalar()
    first = Window.orderBy(F.col(score).desc(), F.col("symbol").asc())
    last = Window.orderBy(F.col(score).asc(), F.col("symbol").desc())
    head = (
        snap.orderBy(F.col(score).desc(), F.col("symbol").asc()).limit(top)
        .withColumn("rank", F.row_number().over(first).cast("bigint")).withColumn("part", F.lit("TOP"))
    )
    tail = (
        snap.orderBy(F.col(score).asc(), F.col("symbol").desc()).limit(bottom)
        .withColumn("_up", F.row_number().over(last))
        .withColumn("rank", size - F.col("_up") + F.lit(1)).withColumn("part", F.lit("BOTTOM"))
    )
    keep = ["part", "rank", "date", "symbol", F.col(score).alias("score")]
    return head.select(*keep).unionByName(tail.select(*keep))


def explain_symbol(df: DataFrame, symbol: str | Column, score: str, factors: Sequence[str], k: int = 3) -> DataFrame:
    """One row per known factor of a symbol: its rank in the last universe, and whether the
    factor is among its ``k`` strongest or weakest."""
    from .calendar import latest_cross_section

    snap = latest_cross_section(df)
    wanted = F.lit(symbol) if isinstance(symbol, str) else symbol
    me = snap.where(F.upper("symbol") == F.upper(wanted))
    mine, name = me.agg(F.max(score)).scalar(), me.agg(F.max("symbol")).scalar()
    ahead = (F.col(score) > mine) | ((F.col(score) == mine) & (F.col("symbol") < name))
    # Ranking one symbol needs a count of the names ahead of it, not a sort of all of them.
    rank = snap.where(ahead).agg(F.count("*") + F.lit(1)).scalar()
    size = snap.agg(F.count("*")).scalar()
    long = me.select("date", "symbol", F.col(score).alias("score"), *factors).unpivot(
        ["date", "symbol", "score"], list(factors), "factor", "value"
    ).where(F.col("value").isNotNull())
    strong = Window.partitionBy("symbol").orderBy(F.col("value").desc(), F.col("factor"))
    weak = Window.partitionBy("symbol").orderBy(F.col("value").asc(), F.col("factor"))
    return (
        long.withColumn("strongest", F.row_number().over(strong) <= F.lit(k))
        .withColumn("weakest", F.row_number().over(weak) <= F.lit(k))
        .withColumns({"rank": rank, "universe_size": size})
    )
