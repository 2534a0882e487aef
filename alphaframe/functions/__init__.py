"""Column-level helpers: built-in Spark expressions only, no Python on rows."""

from .cols import (
    any_of,
    clip,
    corr_of,
    finite,
    mean_known,
    null_nan,
    period_return,
    ratio,
    true_or_false,
)
from .frames import by_date, by_symbol, dealt, full_window, past

__all__ = [
    "any_of", "by_date", "by_symbol", "clip", "corr_of", "dealt", "finite", "full_window",
    "mean_known", "null_nan", "past", "period_return", "ratio", "true_or_false",
]
