"""Units against the contract: prices, deltas, flags, severity, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.config import CUMULATIVE, Rules
from tallyline.functions.numbers import money, significant
from tallyline.functions.text import NOT_DESCRIBED, base_uom, row_key
from tallyline.operators.contract import contract_index
from tallyline.operators.rollup import activity, same, unit_rollup
from tallyline.schemas import CYCLE_KEYS

# Severities from least to most serious, and the finding texts.
SEVERITIES = ("ok", "info", "warning", "critical")
NO_CONTRACT = "Unit billed with no contract item (unauthorized / needs change order)"
UNMATCHED = "Line not matched to a contract unit — resolve in crosswalk before finalize"


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def tolerance_band(uom: Column, built: Column, rules: Rules = Rules()) -> Column:
    t = rules.tolerance
    length = F.greatest(F.lit(float(t.length_floor)), F.abs(built) * float(t.length_share))
    return F.when(uom.isin("FT", "100FT"), length).otherwise(F.lit(float(t.count_band)))


def with_contract(
    units: DataFrame,
    contract: DataFrame,
    keys: Sequence[str] = CYCLE_KEYS,
    rules: Rules = Rules(),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Units with their contract item. A contract without project_id serves all projects.

    No broadcast is forced: after the rollup both sides hold one row per unit, and
    Spark compares measured sizes at run time.
    """
    scope = [k for k in keys if k in contract.columns]
    items = contract_index(contract, scope).select(
        *scope,
        "code",
        F.lit(True).alias("in_contract"),
        F.col("description").alias("contract_desc"),
        F.col("uom").alias("contract_uom"),
        F.col("unit_price").alias("contract_price"),
        "est_qty",
        "is_change_order",
    )
    joined = join_on_code(units, items, scope)
    if rules.convert_billed_hundreds:
        per_foot = F.when(F.col("contract_uom") == "100FT", F.lit(100.0)).otherwise(F.lit(1.0))
        joined = (
            joined.withColumn("billed_qty", F.col("billed_qty") * per_foot)
            .withColumn("billed_price", F.col("billed_price") / per_foot)
            .withColumn("contract_price", F.col("contract_price") / per_foot)
            .withColumn("est_qty", F.col("est_qty") * per_foot)
        )
    return joined.select(
        *keys,
        "unit_key",
        "code",
        F.when(F.col("in_contract"), F.col("contract_desc"))
        .otherwise(F.coalesce(F.nullif(F.col("raw_desc"), F.lit("")), F.nullif(F.col("code"), F.lit("")), F.lit(NOT_DESCRIBED)))
        .alias("description"),
        F.coalesce(base_uom(F.col("contract_uom")), base_uom(F.col("built_uom")), F.lit("EA")).alias("uom"),
        "billing_mode",
        "built_qty",
        "billed_qty",
        "contract_price",
        "billed_price",
        "est_qty",
        F.coalesce("is_change_order", F.lit(False)).alias("is_change_order"),
        "n_built",
        "n_billed",
        "first_seen",
        *extra,
    )


def join_on_code(units: DataFrame, items: DataFrame, scope: Sequence[str]) -> DataFrame:
    """A null code matches no item, so the code compares plainly; the rest null-safe."""
    renamed = items.select(*[F.col(c).alias(f"__{c}" if c in (*scope, "code") else c) for c in items.columns])
    condition = F.col("code") == F.col("__code")
    for k in scope:
        condition = condition & same(F.col(k), F.col(f"__{k}"), k)
    return units.join(renamed, condition, "left").drop("__code", *[f"__{k}" for k in scope])


def with_prior(units: DataFrame, prior: DataFrame | None, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Attach the prior cycle's billed-to-date quantity (cumulative cycles only).

    ``prior``: the cycle keys of the *current* cycle (or fewer), code, prior_billed_qty.
    """
    none = F.lit(None).cast("double")
    if prior is None:
        return units.withColumn("prior_billed_qty", none)
    scope = [k for k in keys if k in prior.columns]
    joined = join_on_code(units, prior.select(*scope, "code", F.col("prior_billed_qty").alias("__prior")), scope)
    usable = (F.col("billing_mode") == CUMULATIVE) & (F.coalesce(F.col("code"), F.lit("")) != "")
    return joined.withColumn("prior_billed_qty", F.when(usable, F.col("__prior"))).drop("__prior")


def with_measures(rows: DataFrame) -> DataFrame:
    """The derived quantities and amounts of a row."""
    c = F.col
    return (
        rows.withColumn("qty_delta", c("billed_qty") - c("built_qty"))
        .withColumn("price_delta", F.coalesce(c("billed_price") - c("contract_price"), F.lit(0.0)))
        .withColumn("current_period_qty", c("billed_qty") - c("prior_billed_qty"))
        .withColumn("billed_amount", c("billed_qty") * c("billed_price"))
        .withColumn("expected_amount", F.coalesce(c("built_qty") * c("contract_price"), F.lit(0.0)))
        .withColumn("variance", c("billed_amount") - c("expected_amount"))
    )


def is_billed() -> Column:
    return (F.col("billed_qty") > 0) | (F.col("billed_amount") != 0)


def _flag(condition: Column, rule: str, severity: str, *message: Column | str) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), text.alias("message")))


def flag_list(rules: Rules = Rules()) -> Column:
    """The eight rules, in evaluation order, over a row that carries its measures."""
    c = F.col
    band = tolerance_band(c("uom"), c("built_qty"), rules)
    eps = F.lit(float(rules.price_epsilon))
    larger = F.greatest(c("built_qty"), c("billed_qty"))
    priced = c("contract_price").isNotNull()
    findings = [
        _flag(~priced & is_billed(), "no_contract", "critical", NO_CONTRACT),
        _flag(
            c("qty_delta") > band, "qty_over", "critical",
            "Billed qty exceeds built by ", significant(c("qty_delta")), " ", c("uom"),
            " (tolerance ±", significant(band), ")",
        ),
        _flag(
            priced & (c("billed_price") > c("contract_price") + eps), "price_over", "critical",
            "Unit price $", money(c("billed_price")), " over contract $", money(c("contract_price")),
            " (+$", money(c("price_delta")), "/unit)",
        ),
        _flag(
            (c("est_qty") != 0) & (larger > c("est_qty")), "over_run", "warning",
            "Over-run vs bid estimate (+", significant(larger - c("est_qty")), " over ", significant(c("est_qty")), ")",
        ),
        _flag(c("code").isNull() & is_billed(), "unmatched", "warning", UNMATCHED),
        _flag(
            (c("billing_mode") == CUMULATIVE) & (c("prior_billed_qty") - c("billed_qty") > band),
            "cumulative_decrease", "warning",
            "Billed-to-date ", significant(c("billed_qty")), " fell below prior cycle ",
            significant(c("prior_billed_qty")), " ", c("uom"), " — a cumulative pay app should not decrease",
        ),
        _flag(
            -c("qty_delta") > band, "under_billed", "info",
            "Built but not yet billed: ", significant(-c("qty_delta")), " ", c("uom"), " (under-billed)",
        ),
        _flag(
            priced & (c("billed_price") < c("contract_price") - eps) & is_billed(), "price_under", "info",
            "Unit price $", money(c("billed_price")), " below contract $", money(c("contract_price")),
        ),
    ]
    return F.array_compact(F.array(*findings))


def severity_of(flags: Column) -> Column:
    worst = F.coalesce(F.array_max(F.transform(flags, lambda f: severity_rank(f["severity"]))), F.lit(0))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), worst.cast("int") + 1)


def with_flags(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return (
        with_measures(rows)
        .withColumn("flags", flag_list(rules))
        .withColumn("severity", severity_of(F.col("flags")))
        .withColumn("row_key", row_key(F.col("code"), F.col("description")))
    )


def reconcile(
    asbuilt: DataFrame,
    invoices: DataFrame,
    contract: DataFrame,
    *,
    keys: Sequence[str] = CYCLE_KEYS,
    rules: Rules = Rules(),
    cycles: DataFrame | None = None,
    prior: DataFrame | None = None,
) -> DataFrame:
    """One row per unit that was built or billed, for every cycle in the input."""
    act = activity(asbuilt, invoices, keys)
    return reconcile_activity(act, contract, keys=keys, rules=rules, cycles=cycles, prior=prior)


def reconcile_activity(
    act: DataFrame,
    contract: DataFrame,
    *,
    keys: Sequence[str] = CYCLE_KEYS,
    rules: Rules = Rules(),
    cycles: DataFrame | None = None,
    prior: DataFrame | None = None,
) -> DataFrame:
    units = unit_rollup(act, keys, billing_mode=rules.billing_mode, cycles=cycles)
    return reconcile_units(units, contract, keys=keys, rules=rules, prior=prior)


def reconcile_units(
    units: DataFrame,
    contract: DataFrame,
    *,
    keys: Sequence[str] = CYCLE_KEYS,
    rules: Rules = Rules(),
    prior: DataFrame | None = None,
) -> DataFrame:
    return with_flags(with_prior(with_contract(units, contract, keys, rules), prior, keys), rules)


def exposure_order() -> list[Column]:
    """Most serious first, then the largest exposure, then first come."""
    return [severity_rank(F.col("severity")).desc(), F.abs(F.col("variance")).desc(), F.col("first_seen").asc()]


def in_exposure_order(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy(*keys, *exposure_order())
