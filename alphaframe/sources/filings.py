"""Company filings: nested documents to long facts, identifiers, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tag names that may carry each metric, in order of preference.
CONCEPTS: dict[str, tuple[str, ...]] = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "net_income": ("NetIncomeLoss",),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "assets": ("Assets",),
    "equity": (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
    "cash": (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ),
    "debt": (
        "LongTermDebtAndFinanceLeaseObligationsCurrent", "LongTermDebtCurrent", "LongTermDebtNoncurrent",
    ),
    "operating_cf": ("NetCashProvidedByUsedInOperatingActivities",),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "shares": ("CommonStocksIncludingAdditionalPaidInCapitalMember", "CommonStockSharesOutstanding"),
    "eps": ("EarningsPerShareDiluted", "EarningsPerShareBasic"),
}
METRICS = tuple(CONCEPTS)
UNITS = ("USD", "USD/shares", "shares", "pure")
FORMS = ("10-Q", "10-K", "10-Q/A", "10-K/A")

_FACT = (
    "struct<`end`: string, val: double, form: string, filed: string, fy: int, fp: string, accn: string>"
)
_DOC = f"struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, array<{_FACT}>>>>>>"


def flatten_company_facts(
    df: DataFrame, concepts: Mapping[str, Sequence[str]] = CONCEPTS, payload: str = "payload",
    symbol: str = "symbol",
) -> DataFrame:
    """Nested filing documents to (symbol, metric, value, period_end, available_at, …).

    Per metric the first tag with any usable row wins; per tag the preferred unit, else the
    first listed. A document holds all tags of its company, so the choice is made inside the
    row and nothing is shuffled.
    """
    doc = df.select(
        F.col(symbol).alias("symbol"),
        F.from_json(payload, _DOC).getField("facts").getField("us-gaap").alias("tags"),
    )

    def usable(tag: str):
        units = F.try_element_at("tags", F.lit(tag)).getField("units")
        listed = F.coalesce(
            *[F.try_element_at(units, F.lit(u)) for u in UNITS],
            F.try_element_at(F.map_values(units), F.lit(1)),
        )
        kept = F.filter(listed, lambda r: (
            r["form"].isin(*FORMS) & r["filed"].isNotNull() & (r["filed"] != "") & r["val"].isNotNull()
        ))
        return F.when(F.size(kept) > 0, kept)

    chosen = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.coalesce(*[usable(t) for t in tags]).alias("rows"))
        for metric, tags in concepts.items()
    ])
    rows = doc.select("symbol", F.explode(chosen).alias("m")).select(
        "symbol", "m.metric", F.explode("m.rows").alias("r")
    )
    return rows.select(
        "symbol", "metric", F.col("r.val").alias("value"),
        F.to_date("r.end").alias("period_end"), F.to_date("r.filed").alias("available_at"),
        "r.fy", "r.fp", "r.form", "r.accn",
    )


def dedup_facts(df: DataFrame) -> DataFrame:
    """One fact per (symbol, metric, available_at): the latest period, then the larger value."""
    rest = [c for c in df.columns if c not in ("symbol", "metric", "available_at")]
    last = F.max_by(F.struct(*rest), F.struct("period_end", "value")).alias("_f")
    return df.groupBy("symbol", "metric", "available_at").agg(last).select(
        "symbol", "metric", "available_at", "_f.*"
    )


def resolve_entity_ids(df: DataFrame, id_map: DataFrame) -> DataFrame:
    """Attach (entity_id, title) by the dashed form of the ticker, else the ticker as is.

    One join on both candidate spellings instead of two: the symbol is exploded into its
    distinct spellings and the preferred match is kept.
    """
    ids = id_map.select(
        F.upper("ticker").alias("_spelling"),
        F.lpad(F.col("entity_id").cast("string"), 10, "0").alias("entity_id"), "title",
    )
    up = F.upper("symbol")
    forms = F.array_distinct(F.array(F.replace(up, F.lit("."), F.lit("-")), up))
    spelled = df.select("symbol").distinct().select("symbol", F.posexplode(forms).alias("_p", "_spelling"))
    hit = spelled.join(ids, "_spelling", "left").withColumn(
        "_rank", F.when(F.col("entity_id").isNotNull(), F.col("_p")).otherwise(F.lit(9))
    )
    return hit.groupBy("symbol").agg(
        F.min_by("entity_id", "_rank").alias("entity_id"), F.min_by("title", "_rank").alias("title")
    ).withColumn("matched", F.col("entity_id").isNotNull())


def filing_coverage(universe: DataFrame, facts: DataFrame, id_map: DataFrame) -> DataFrame:
    """One row: symbols asked, symbols with facts, facts, symbols without an identifier."""
    counts = facts.groupBy("symbol").agg(F.count("*").alias("n"))
    asked = universe.select("symbol").distinct().join(counts, "symbol", "left")
    unmatched = resolve_entity_ids(universe, id_map).where(~F.col("matched")).agg(F.count("*")).scalar()
    return asked.agg(
        F.count("*").alias("symbols_asked"),
        F.count_if(F.col("n") > 0).alias("symbols_with_facts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("facts"),
    ).withColumn("unmatched", unmatched)
