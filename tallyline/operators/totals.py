"""Cycle headline figures, retainage, severity counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.config import RETAINAGE_PCT, RETAINAGE_SLACK
from tallyline.functions.numbers import exact_sum, money, significant
from tallyline.operators.rollup import join_null_safe
from tallyline.schemas import CYCLE_KEYS

FLAGGED = ("critical", "warning")
SETTLED = ("ok", "info")

# The labels of the summary metrics, in order.
METRICS = (
    ("Billed this cycle (gross)", "total_billed"),
    ("Expected (built × contract)", "total_expected"),
    ("Flagged over-billing", "flagged_over_billing"),
    ("Retainage held", "retainage_held"),
    ("Net recommended", "net_recommended"),
    ("Critical flags", "n_critical"),
    ("Warnings", "n_warning"),
    ("Reconciled / info", "n_ok"),
)


def over_billing() -> Column:
    """The money held back: positive variances of critical rows."""
    return exact_sum(F.when((F.col("severity") == "critical") & (F.col("variance") > 0), F.col("variance")).otherwise(0))


def _sum0(c: str) -> Column:
    return F.coalesce(exact_sum(F.col(c)), F.lit(0.0))


def cycle_totals(
    rows: DataFrame,
    keys: Sequence[str] = CYCLE_KEYS,
    *,
    cycles: DataFrame | None = None,
    retainage_pct: float = RETAINAGE_PCT,
) -> DataFrame:
    """The eight headline numbers per cycle. ``cycles`` gives each cycle its own rate."""
    totals = rows.groupBy(*keys).agg(
        _sum0("billed_amount").alias("total_billed"),
        _sum0("expected_amount").alias("total_expected"),
        F.coalesce(over_billing(), F.lit(0.0)).alias("flagged_over_billing"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "warning").alias("n_warning"),
        F.count_if(F.col("severity").isin(*SETTLED)).alias("n_ok"),
        F.count(F.lit(1)).alias("n_units"),
    )
    if cycles is None:
        totals = totals.withColumn("retainage_pct", F.lit(float(retainage_pct)))
    else:
        totals = join_null_safe(totals, cycles.select(*keys, "retainage_pct"), keys, "left")
    return with_retainage(totals)


def with_retainage(totals: DataFrame) -> DataFrame:
    held = F.col("total_billed") * (F.coalesce("retainage_pct", F.lit(0.0)) / 100.0)
    return totals.withColumn("retainage_held", held).withColumn(
        "net_recommended", F.col("total_billed") - F.col("flagged_over_billing") - F.col("retainage_held")
    )


def check_retainage(df: DataFrame, gross: str = "total_billed", pct: str = "retainage_pct",
                    actual: str = "actual_retainage", slack: float = RETAINAGE_SLACK) -> DataFrame:
    """Withheld against required retainage, with a verdict and its wording."""
    c = F.col
    rate = F.concat(significant(c(pct), group=False), F.lit("%"))
    checked = (
        df.withColumn("expected_retainage", c(gross) * (c(pct) / 100.0))
        .withColumn("retainage_variance", F.coalesce(c(actual) - c("expected_retainage"), F.lit(0.0)))
        .withColumn("retainage_ok", F.abs("retainage_variance") <= slack)
    )
    required = money(c("expected_retainage"))
    off = F.when(c("retainage_variance") > 0, "over-withheld").otherwise("under-withheld")
    message = (
        F.when(c(actual).isNull(), F.concat(F.lit("Contract retainage "), rate, F.lit(" → $"), required, F.lit(" withheld this cycle.")))
        .when(c("retainage_ok"), F.concat(F.lit("Retainage matches contract ("), rate, F.lit("): $"), money(c(actual)), F.lit(" withheld.")))
        .otherwise(
            F.concat(
                F.lit("Retainage "), off, F.lit(" by $"), money(F.abs("retainage_variance")),
                F.lit(" — invoice withheld $"), money(c(actual)), F.lit(", contract "), rate, F.lit(" = $"), required, F.lit("."),
            )
        )
    )
    return checked.withColumn("retainage_message", message)


def summary_metrics(totals: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Totals as (metric_no, metric, value) rows; with a retainage check, its two rows too."""
    metrics = [F.struct(F.lit(i + 1).alias("metric_no"), F.lit(label).alias("metric"), F.col(name).cast("double").alias("value"))
               for i, (label, name) in enumerate(METRICS)]
    if "actual_retainage" in totals.columns:
        for i, (label, name) in enumerate([("Retainage — withheld on invoice", "actual_retainage"), ("Retainage — variance", "retainage_variance")]):
            given = F.struct(F.lit(len(METRICS) + 1 + i).alias("metric_no"), F.lit(label).alias("metric"), F.col(name).cast("double").alias("value"))
            metrics.append(F.when(F.col("actual_retainage").isNotNull(), given))
    return totals.select(*keys, F.inline(F.array_compact(F.array(*metrics))))


def severity_counts(rows: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Counts behind the severity filter: all, critical, warning, ok (with info)."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "warning").alias("n_warning"),
        F.count_if(F.col("severity").isin(*SETTLED)).alias("n_ok"),
    )
