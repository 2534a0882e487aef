"""Window shapes shared by the operators.

Size of a window partition, since each is sorted in one task:
* ``by_symbol``: bars are unique on (date, symbol), so at most one row per session.
* ``by_date``: at most one row per symbol; for universes too large for one task the
  ranking operators take ``universe=`` and switch to a range-split plan.

A task sorts all partitions it is dealt, once for every order that follows; ``dealt`` keeps their rows in bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


ROWS_PER_TASK = 40_000  # rows that a task of a chain of windows should sort
ROWS_PER_HASH = 320_000  # rows that a task of one hashed aggregation should take in
MOST_TASKS = 2_000      # beyond this, lists of shuffle blocks cost more than smaller tasks save


def dealt(df: DataFrame, by: Sequence[str], rows: int | None, per_task: int | None = None) -> DataFrame:
    """``df`` partitioned by ``by`` so that the rows of a task stay the same however large the input.

    ``rows`` is an upper bound of the rows; without one, or where Spark's own number of tasks is enough, ``df`` as it is.
    A task takes ``ROWS_PER_TASK`` of them unless ``per_task`` says otherwise.
    """
    tasks = min(MOST_TASKS, -(-(rows or 0) // (per_task or ROWS_PER_TASK)))
    return df.repartition(tasks, *by) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def past(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def full_window(agg: Column, counted: Column, w: WindowSpec, need: int) -> Column:
    """A windowed aggregate that is null until ``need`` known values are in the frame."""
    return F.when(F.count(counted).over(w) >= F.lit(need), agg.over(w))
