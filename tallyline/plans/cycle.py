"""Whole-cycle plans: every cycle of the input in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.config import CUMULATIVE, DISCRETE, Matching, Rules
from tallyline.functions.text import unit_key
from tallyline.operators.contract import apply_change_orders
from tallyline.operators.crosswalk import resolve, triage
from tallyline.operators.history import with_prior_in_place
from tallyline.operators.reconcile import reconcile_activity, reconcile_units, with_contract, with_flags
from tallyline.operators.rollup import activity, finish_rollup, join_null_safe, line_states, merge_states, unit_rollup
from tallyline.schemas import CYCLE_KEYS


def reconcile_series(
    act: DataFrame, contract: DataFrame, cycles: DataFrame, *, rules: Rules = Rules(), per_cycle_mode: bool = False
) -> DataFrame:
    """All cycles of all contractors with the prior check between consecutive ones."""
    units = unit_rollup(act, CYCLE_KEYS, billing_mode=rules.billing_mode, cycles=cycles if per_cycle_mode else None)
    rows = with_contract(with_prior_in_place(units, cycles), contract, CYCLE_KEYS, rules, extra=("prior_billed_qty",))
    return with_flags(rows, rules)


def reconcile_with_changes(
    act: DataFrame, contract: DataFrame, orders: DataFrame, *, keys: Sequence[str] = CYCLE_KEYS, rules: Rules = Rules()
) -> DataFrame:
    scope = [k for k in keys if k in contract.columns]
    return reconcile_activity(act, apply_change_orders(contract, orders, scope), keys=keys, rules=rules)


def reconcile_described(
    asbuilt: DataFrame,
    invoices: DataFrame,
    contract: DataFrame,
    *,
    aliases: DataFrame | None = None,
    decisions: DataFrame | None = None,
    keys: Sequence[str] = CYCLE_KEYS,
    rules: Rules = Rules(),
    matching: Matching = Matching(),
    prior: DataFrame | None = None,
) -> DataFrame:
    """From uncoded lines to reconciled rows.

    Lines are rolled up by description before anything is matched, so the crosswalk and
    the join of its codes see one row per cycle and description, however often a
    description is billed; the states then merge into units.
    """
    states = line_states(
        activity(asbuilt, invoices, keys).withColumn("code", F.lit(None).cast("string")),
        [*keys, "raw_desc"],
        cumulative=rules.billing_mode == CUMULATIVE,
        discrete=rules.billing_mode == DISCRETE,
    )
    triaged = crosswalk(states, contract, aliases=aliases, decisions=decisions, keys=keys, matching=matching)
    scope = [k for k in keys if k in contract.columns]
    units = merge_states(code_states(states, triaged, scope), [*keys, "unit_key"])
    return reconcile_units(finish_rollup(units, keys, billing_mode=rules.billing_mode), contract, keys=keys, rules=rules, prior=prior)


def crosswalk(
    lines: DataFrame,
    contract: DataFrame,
    *,
    aliases: DataFrame | None = None,
    decisions: DataFrame | None = None,
    keys: Sequence[str] = CYCLE_KEYS,
    matching: Matching = Matching(),
) -> DataFrame:
    scope = [k for k in keys if k in contract.columns]
    matches = resolve(lines.select(*scope, "raw_desc"), contract, aliases, scope=scope, matching=matching)
    if decisions is None:
        schema = ", ".join(f"{k} string" for k in scope) + (", " if scope else "")
        decisions = lines.sparkSession.createDataFrame([], schema + "raw_desc string, mapped_code string, not_in_contract boolean")
    return triage(matches, decisions, scope, matching)


def code_states(states: DataFrame, triaged: DataFrame, scope: Sequence[str]) -> DataFrame:
    """States per description with the code of their description and their unit key."""
    coded = join_null_safe(states, triaged.select(*scope, "raw_desc", "final_code"), [*scope, "raw_desc"], "left")
    return coded.withColumn("unit_key", unit_key(F.col("final_code"), F.col("raw_desc"))).withColumn(
        "first_seen", F.struct("first_seen.feed", "first_seen.line", F.col("final_code").alias("code"), "first_seen.raw_desc")
    )
