"""News items to one decayed tone score per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that count for and against a company.
POSITIVE = (
    "beat", "beats", "growth", "record", "upgrade", "raises", "strong", "profit", "surge", "wins",
    "approval", "buyback", "outperform",
)
NEGATIVE = (
    "miss", "misses", "cuts", "downgrade", "lawsuit", "probe", "weak", "loss", "decline", "layoffs",
    "recall", "fraud", "underperform",
)
UNKNOWN_AGE_DAYS = 30


def score_news(
    df: DataFrame, age_days: Column, pos: Sequence[str] = POSITIVE, neg: Sequence[str] = NEGATIVE,
) -> DataFrame:
    """Mean over a symbol's items of (pos - neg) / max(1, pos + neg) * exp(-age / 7).

    Whole texts are tokenised in the JVM; items are reduced to one number before they are
    exploded to symbols, so only (symbol, double) is shuffled.
    """
    text = F.lower(F.concat_ws(" ", F.col("headline"), F.col("summary")))
    words = F.split(F.translate(text, ",.", "  "), r"\s+")
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    n_pos = F.size(F.array_intersect(words, listed(pos)))
    n_neg = F.size(F.array_intersect(words, listed(neg)))
    age = F.greatest(F.lit(0), F.coalesce(age_days, F.lit(UNKNOWN_AGE_DAYS)))
    tone = (n_pos - n_neg) / F.greatest(F.lit(1), n_pos + n_neg) * F.exp(-age / F.lit(7.0))
    return (
        df.select("symbols", tone.alias("_tone"))
        .select(F.explode("symbols").alias("symbol"), "_tone")
        .groupBy("symbol").agg(F.avg("_tone").alias("news_score"))
    )


def pit_news_mask(
    df: DataFrame, scores: DataFrame, out: str = "news_raw", last: Column | None = None,
) -> DataFrame:
    """News is known for a recent window only: it is written on the last date and 0 elsewhere.

    ``last`` saves working out the last date of ``df`` when a cheaper source knows it.
    """
    last = df.agg(F.max("date")).scalar() if last is None else last
    joined = df.join(scores.select("symbol", F.col("news_score").alias("_n")), "symbol", "left")
    value = F.when(F.col("date") == last, F.coalesce("_n", F.lit(0.0))).otherwise(F.lit(0.0))
    return joined.withColumn(out, value).drop("_n")
