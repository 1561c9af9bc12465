"""Contract items: cleaning, duplicate codes, change orders, manual edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.numbers import CONTRACT_MARKS, parse_number
from tallyline.functions.text import parse_uom, strip

# Codes that are headings or gaps, not items.
NOT_CODES = ("nan", "code", "item")

_ITEM = ("description", "uom", "unit_price", "est_qty", "is_change_order", "effective_date")


def contract_items(cells: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Typed items from text columns code, description, uom, unit_price, est_qty, line_no.

    Rows without a code or a numeric price are headings, subtotals or gaps and go.
    """
    code = strip(F.coalesce(F.col("code"), F.lit("")))
    price = parse_number(F.col("unit_price"), CONTRACT_MARKS)
    return cells.filter((code != "") & ~F.lower(code).isin(*NOT_CODES) & price.isNotNull()).select(
        *scope,
        code.alias("code"),
        strip(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        F.coalesce(parse_uom(F.col("uom")), F.lit("EA")).alias("uom"),
        price.alias("unit_price"),
        F.coalesce(parse_number(F.col("est_qty"), CONTRACT_MARKS), F.lit(0.0)).alias("est_qty"),
        F.lit(False).alias("is_change_order"),
        F.lit(None).cast("string").alias("effective_date"),
        "line_no",
    )


def edited_items(edits: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Items typed into an edit grid, which replaces the contract: blank codes go, a
    missing number is zero."""
    code = strip(F.coalesce(F.col("code"), F.lit("")))
    return edits.filter((code != "") & (F.lower(code) != "nan")).select(
        *scope,
        code.alias("code"),
        strip(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        F.coalesce(parse_uom(F.col("uom")), F.lit("EA")).alias("uom"),
        F.coalesce(F.col("unit_price").cast("double"), F.lit(0.0)).alias("unit_price"),
        F.coalesce(F.col("est_qty").cast("double"), F.lit(0.0)).alias("est_qty"),
        F.coalesce(F.col("is_change_order"), F.lit(False)).alias("is_change_order"),
        F.lit(None).cast("string").alias("effective_date"),
        "line_no",
    )


def contract_index(contract: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """One item per code; of duplicates the last line counts."""
    columns = [c for c in (*_ITEM, "line_no") if c in contract.columns]
    latest = F.max_by(F.struct(*columns), F.col("line_no"))
    return contract.groupBy(*scope, "code").agg(latest.alias("item")).select(*scope, "code", "item.*")


def apply_change_orders(contract: DataFrame, orders: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """A change order replaces the item of the same code or extends the contract.

    The position of a revised code stays that of the base item; additions follow.
    """
    base = contract.withColumn("__round", F.lit(0))
    extra = orders.withColumn("is_change_order", F.lit(True)).withColumn("__round", F.lit(1))
    both = base.unionByName(extra, allowMissingColumns=True)
    columns = [c for c in _ITEM if c in both.columns]
    place = F.struct("__round", "line_no")
    return (
        both.groupBy(*scope, "code")
        .agg(F.max_by(F.struct(*columns), place).alias("item"), F.min(place).alias("place"))
        .select(*scope, "code", "item.*", F.col("place.__round").alias("added_by_order"), F.col("place.line_no").alias("line_no"))
    )
