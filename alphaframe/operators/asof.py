"""Backward as-of join without a range join: tag, union, carry the last value forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dealt


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
    cols: Sequence[str], chunk: str | None = None, per_column: bool = False, rows_bound: int | None = None,
) -> DataFrame:
    """Each left row with the last right values at or before it, per key.

    Right rows sort before left rows of the same instant, so the bound is inclusive. The right
    side has to be unique on (key, time). With ``per_column`` every column keeps its own last
    known value; otherwise the columns come from one and the same right row.

    ``chunk`` (a ``date_trunc`` unit) splits the rows of a key into time slices: a slice is
    resolved in its own task and the last values of the earlier slices are handed in through a
    table of one row per (key, slice). Use it where one key may hold a large share of the rows;
    without it the rows of a key are sorted in one task. ``rows_bound``, an upper bound of the left
    rows, deals whole keys to tasks of bounded size.
    """
    picked = list(cols) if per_column else ["_row"]
    side = right.select(
        *by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
        *([F.col(c) for c in cols] if per_column else [F.struct(*cols).alias("_row")]),
    )
    base = left.select("*", F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"))
    for c in picked:
        base = base.withColumn(c, F.lit(None).cast(side.schema[c].dataType))
    rows = base.unionByName(side, allowMissingColumns=True)

    keys = list(by)
    if chunk is not None:
        rows = rows.withColumn("_slice", F.date_trunc(chunk, F.col("_ts").cast("timestamp")))
        keys = [*by, "_slice"]
    rows = dealt(rows, keys, rows_bound)
    w = Window.partitionBy(*keys).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in picked})

    if chunk is not None:
        ends = side.withColumn("_slice", F.date_trunc(chunk, F.col("_ts").cast("timestamp")))
        ends = ends.groupBy(*keys).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_ts"))).alias(c) for c in picked
        ])
        # Probe slices without facts need a row too, to receive what came before them.
        probes = base.select(
            *by, F.date_trunc(chunk, F.col("_ts").cast("timestamp")).alias("_slice")
        ).distinct()
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            probes.join(ends, keys, "full")
            .select(*keys, *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in picked])
        )
        rows = rows.where(F.col("_side") == 1).join(carried, keys, "left")
        rows = rows.withColumns({c: F.coalesce(c, f"_in_{c}") for c in picked})

    out = rows.where(F.col("_side") == 1)
    values = picked if per_column else [F.col(f"_row.{c}").alias(c) for c in cols]
    return out.select(*left.columns, *values)
