"""Query registry: each entry pairs a Spark plan with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# A hair above one half: quotients of prices and counts often lie exactly between two rounded
# values, where the last bit of a float sum would decide.
HALF = 0.500001
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, needs: Sequence[str] = ()) -> None:
    CTES[name] = (tuple(needs), body)


def with_ctes(names: Sequence[str], body: str) -> str:
    """Prefix a statement with the named sub-queries and what they need, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        needs, _ = CTES[n]
        for m in needs:
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body if order else body


def _round(c: str, d: int):
    """Half-up in plain double arithmetic, the same steps in both engines."""
    return F.floor(F.col(c) * F.lit(float(10 ** d)) + F.lit(HALF)) / F.lit(float(10 ** d))


def register(
    name: str, body: str | None = None, ctes: Sequence[str] = (),
    round_to: Mapping[str, int] | None = None,
):
    """Register a plan. ``round_to`` rounds float columns on both sides, since float sums depend
    on order; ``body`` is the SQL twin (None: checked by tests on small fixtures instead)."""
    digits = dict(round_to or {})

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: _round(c, d) for c, d in digits.items()}) if digits else df

        run.__doc__, run.__name__ = fn.__doc__, name
        QUERIES[name] = run
        if body is not None:
            sql = body
            if digits:
                fixed = ", ".join(
                    f"floor({c} * 1e{d} + {HALF}) / 1e{d} AS {c}" for c, d in digits.items()
                )
                sql = f"SELECT * REPLACE ({fixed}) FROM ({body})"
            ORACLES[name] = with_ctes(ctes, sql)
        return run

    return wrap


def six(*cols: str) -> dict[str, int]:
    return {c: 6 for c in cols}
