"""Reviewer decisions, sign-off gates, report datasets, fingerprints, progress."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.config import APPROVAL_ROWS
from tallyline.functions.text import flag_messages
from tallyline.operators.reconcile import exposure_order
from tallyline.operators.rollup import join_null_safe
from tallyline.operators.totals import FLAGGED, SETTLED
from tallyline.schemas import CYCLE_KEYS

# The gates in order, with label and the step that clears them.
GATES = (
    ("contract", "Bid schedule loaded", "contract"),
    ("confidence", "Extracted quantities confirmed", "asbuilt"),
    ("crosswalk", "Crosswalk resolved", "crosswalk"),
    ("criticals", "Critical flags decided", "reconcile"),
)
DECISIONS = ("hold", "approve", "note")
DASH = "—"


# --- filters -----------------------------------------------------------------
def with_severity(rows: DataFrame, chip: str = "all") -> DataFrame:
    """Rows behind a filter chip: all, critical, warning, or ok (which includes info)."""
    if chip == "ok":
        return rows.filter(F.col("severity").isin(*SETTLED))
    return rows.filter(F.col("severity") == chip) if chip in FLAGGED else rows


def flagged(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("severity").isin(*FLAGGED))


def unmatched(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("code").isNull() | F.col("contract_price").isNull())


def unconfirmed(asbuilt: DataFrame) -> DataFrame:
    return asbuilt.filter(F.col("confidence") == "annot")


# --- decisions ---------------------------------------------------------------
def fold_resolutions(events: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Current decision per row from a log of decisions.

    An event with a null status clears the decision and with it the note. A null note
    keeps the note as it was, an empty one clears it. ``seq`` may be of any orderable
    type, a struct of natural keys as well.
    """
    set_now, seq = F.col("status").isNotNull(), F.col("seq")

    def alive(at: Column) -> Column:
        return F.col("cleared").isNull() | (at > F.col("cleared"))

    return (
        events.groupBy(*keys, "row_key")
        .agg(
            F.max(F.when(~set_now, seq)).alias("cleared"),
            F.max(F.when(set_now, F.struct("seq", "status", "by", "at"))).alias("last"),
            F.max(F.when(set_now & F.col("note").isNotNull(), F.struct("seq", "note"))).alias("noted"),
        )
        .filter(F.col("last").isNotNull() & alive(F.col("last.seq")))
        .select(
            *keys,
            "row_key",
            F.col("last.status").alias("status"),
            F.coalesce(F.when(alive(F.col("noted.seq")), F.col("noted.note")), F.lit("")).alias("note"),
            F.coalesce(F.col("last.by"), F.lit("")).alias("by"),
            F.col("last.at").alias("at"),
        )
    )


def with_resolutions(rows: DataFrame, resolutions: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    picked = resolutions.select(
        *keys,
        "row_key",
        F.col("status").alias("resolution"),
        F.nullif(F.col("note"), F.lit("")).alias("resolution_note"),
        F.nullif(F.col("by"), F.lit("")).alias("resolved_by"),
        F.col("at").alias("resolved_at"),
    )
    return join_null_safe(rows, picked, [*keys, "row_key"], "left")


def open_criticals(rows: DataFrame, resolutions: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Critical rows nobody has decided on."""
    return join_null_safe(rows.filter("severity = 'critical'"), resolutions.select(*keys, "row_key"), [*keys, "row_key"], "left_anti")


def review_progress(rows: DataFrame, resolutions: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Reviewed against flagged rows, open criticals and decreases per cycle."""
    joined = with_resolutions(rows, resolutions, keys)
    is_flagged = F.col("severity").isin(*FLAGGED)
    decided = F.col("resolution").isNotNull()
    return joined.groupBy(*keys).agg(
        F.count_if(is_flagged).alias("n_flagged"),
        F.count_if(is_flagged & decided).alias("n_reviewed"),
        F.count_if((F.col("severity") == "critical") & ~decided).alias("n_open_criticals"),
        F.count_if(F.exists("flags", lambda f: f["rule"] == "cumulative_decrease")).alias("n_decreases"),
    )


# --- gates -------------------------------------------------------------------
def cycle_counts(
    cycles: DataFrame,
    *,
    contract: DataFrame | None = None,
    asbuilt: DataFrame | None = None,
    invoices: DataFrame | None = None,
    review: DataFrame | None = None,
    mapped: DataFrame | None = None,
    rows: DataFrame | None = None,
    resolutions: DataFrame | None = None,
    keys: Sequence[str] = CYCLE_KEYS,
) -> DataFrame:
    """Counts of every stage per cycle. Each stage is read once, whatever is counted of it; rows
    meet their decisions in that same pass. The cycles and all stages that know their cycle are
    stacked as (keys, measures) and added up in one grouping, without a join; a stage of whole
    projects is joined on its own keys, one of everything is a single value."""
    every, critical = F.lit(True), F.col("severity") == "critical"
    is_open = critical
    if rows is not None and resolutions is not None:
        decided = resolutions.select(*keys, "row_key", F.lit(True).alias("__decided"))
        rows, is_open = join_null_safe(rows, decided, [*keys, "row_key"], "left"), critical & F.col("__decided").isNull()
    stages: list[tuple[DataFrame | None, dict[str, Column]]] = [
        (contract, {"n_contract": every}),
        (asbuilt, {"n_asbuilt": every, "n_unconfirmed": F.col("confidence") == "annot"}),
        (invoices, {"n_invoice": every}),
        (review, {"n_review": every}),
        (mapped, {"n_mapped": every}),
        (rows, {"n_rows": every, "n_critical": critical, "n_open_criticals": is_open}),
    ]
    names = [name for _, counts in stages for name in counts]
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    stacked = cycles.select(*keys, one.alias("__cycle"), *[zero.alias(n) for n in names])
    for df, counts in stages:
        if df is not None and all(k in df.columns for k in keys):
            measures = [F.when(counts[n], one).otherwise(zero).alias(n) if n in counts else zero.alias(n) for n in names]
            stacked = stacked.unionByName(df.select(*keys, zero.alias("__cycle"), *measures))
    out = stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("__cycle", *names)]).filter("__cycle > 0").drop("__cycle")
    for df, counts in stages:
        if df is None or all(k in df.columns for k in keys):
            continue
        scope = [k for k in keys if k in df.columns]
        counted = df.groupBy(*scope).agg(*[F.count_if(c).alias(f"__{name}") for name, c in counts.items()])
        if scope:
            out = join_null_safe(out, counted, scope, "left").withColumns({n: F.coalesce(f"__{n}", zero) for n in counts}).drop(*[f"__{n}" for n in counts])
        else:
            out = out.withColumns({n: F.coalesce(counted.select(f"__{n}").scalar(), zero) for n in counts})
    return out


def gates(counts: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Four checks per cycle, in order, with what is missing spelt out."""
    c = F.col
    text = {
        "contract": (
            c("n_contract") > 0,
            F.concat(c("n_contract"), F.lit(" contract units")),
            F.lit("No bid schedule — dollar variances can't be checked"),
        ),
        "confidence": (
            c("n_unconfirmed") == 0,
            F.lit("All built quantities confirmed"),
            F.concat(c("n_unconfirmed"), F.lit(" extracted row(s) not yet confirmed by a human")),
        ),
        "crosswalk": (
            c("n_review") == 0,
            F.lit("Every description is mapped"),
            F.concat(c("n_review"), F.lit(" description(s) still need review")),
        ),
        "criticals": (
            c("n_open_criticals") == 0,
            F.lit("No critical items awaiting a decision"),
            F.concat(c("n_open_criticals"), F.lit(" critical item(s) need a hold or approve")),
        ),
    }
    rows = [
        F.struct(
            F.lit(i + 1).alias("gate_no"),
            F.lit(key).alias("gate"),
            text[key][0].alias("ok"),
            F.lit(label).alias("label"),
            F.when(text[key][0], text[key][1]).otherwise(text[key][2]).alias("detail"),
            F.lit(step).alias("fix_step"),
        )
        for i, (key, label, step) in enumerate(GATES)
    ]
    return counts.select(*keys, F.inline(F.array(*rows)))


def blocking(gate_rows: DataFrame) -> DataFrame:
    return gate_rows.filter(~F.col("ok"))


def export_state(gate_rows: DataFrame, overrides: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Whether a cycle may be exported. An override needs a reason and counts only
    while a gate is closed."""
    closed = gate_rows.groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("n_blocking"))
    given = overrides.filter(F.trim(F.coalesce("reason", F.lit(""))) != "").select(
        *keys, F.trim("reason").alias("reason"), F.col("by").alias("override_by"), F.col("at").alias("override_at")
    )
    joined = join_null_safe(closed, given, keys, "left")
    needed = F.col("n_blocking") > 0
    for column in ("reason", "override_by", "override_at"):
        joined = joined.withColumn(column, F.when(needed, F.col(column)))
    return joined.withColumn("overridden", F.col("reason").isNotNull()).withColumn("locked", needed & ~F.col("overridden"))


def progress(counts: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Which of the six steps of a cycle are done, with their live counts."""
    c = F.col
    has_lines = (c("n_asbuilt") > 0) | (c("n_invoice") > 0)
    return counts.select(
        *keys,
        (c("n_contract") > 0).alias("contract_done"),
        (c("n_asbuilt") > 0).alias("asbuilt_done"),
        (c("n_invoice") > 0).alias("invoices_done"),
        ((c("n_contract") > 0) & has_lines & (c("n_review") == 0)).alias("crosswalk_done"),
        (c("n_rows") > 0).alias("reconcile_done"),
        "n_contract", "n_asbuilt", "n_invoice", "n_review", "n_mapped", "n_critical",
    )


# --- report datasets ---------------------------------------------------------
def detail_table(rows: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """The thirteen columns of the full detail report."""
    return rows.select(
        *keys,
        F.coalesce(F.nullif(F.col("code"), F.lit("")), F.lit(DASH)).alias("code"),
        "description", "uom", "built_qty", "billed_qty", "contract_price", "billed_price", "est_qty",
        "billed_amount", "expected_amount", "variance", "severity",
        flag_messages(F.col("flags")).alias("flags"),
    )


def approval_rows(rows: DataFrame, resolutions: DataFrame, keys: Sequence[str] = CYCLE_KEYS, top: int = APPROVAL_ROWS) -> DataFrame:
    """The flagged rows printed in the approval packet of each cycle, in order.

    Spark keeps only the first ``top`` rows of each cycle on the map side before it
    shuffles (a window group limit), so a cycle with very many units stays cheap.
    """
    order = Window.partitionBy(*keys).orderBy(*exposure_order())
    ranked = flagged(rows).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
    status = F.upper(F.coalesce("resolution", F.lit("open")))
    note = F.when(F.col("resolution_note").isNotNull(), F.concat(F.lit(" — "), F.col("resolution_note"))).otherwise("")
    return with_resolutions(ranked, resolutions, keys).select(
        *keys,
        "position",
        F.coalesce(F.nullif(F.col("code"), F.lit("")), F.lit(DASH)).alias("code"),
        "description", "built_qty", "billed_qty", "variance",
        F.upper("severity").alias("severity"),
        F.coalesce(F.nullif(flag_messages(F.col("flags"), "; "), F.lit("")), F.lit(DASH)).alias("finding"),
        F.concat(status, note).alias("resolution"),
    )


def approval_head(totals: DataFrame, keys: Sequence[str] = CYCLE_KEYS, top: int = APPROVAL_ROWS, overrides: DataFrame | None = None) -> DataFrame:
    """Recommendation per cycle and how many flagged rows do not fit the packet."""
    n_flagged = F.col("n_critical") + F.col("n_warning")
    head = totals.select(
        *keys, "net_recommended", "flagged_over_billing", "retainage_held", "n_critical", "n_warning", "n_ok",
        n_flagged.alias("n_flagged"),
        F.greatest(n_flagged - top, F.lit(0)).alias("n_more"),
    )
    if overrides is None:
        return head
    stamp = F.concat(
        F.lit("Reason: "), F.col("reason"), F.lit(" ("), F.coalesce(F.nullif(F.col("by"), F.lit("")), F.lit("reviewer")),
        F.lit(" "), F.coalesce("at", F.lit("")), F.lit(")"),
    )
    return join_null_safe(head, overrides.select(*keys, stamp.alias("override_stamp")), keys, "left")


# --- fingerprint -------------------------------------------------------------
LIMBS = ("limb1", "limb2", "limb3", "limb4")


def _spelled(df: DataFrame, column: str) -> Column:
    """A value as text in one spelling: numbers with ten places, nulls apart from any text, lengths first."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = value.cast("decimal(38,10)").cast("string")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(F.struct(column), {"ignoreNullFields": "false"})
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_limbs(name: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, limbs, n_inputs): the SHA-256 values of the rows of each key as four numbers, added up.

    Sums do not depend on the order of the rows, repeated rows count each, and Spark adds in
    every task before it shuffles.
    """
    values = sorted(c for c in rows.columns if c not in keys)
    digest = F.sha2(F.concat(F.lit(f"{name}|"), *[_spelled(rows, c) for c in values]).cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").alias(limb) for i, limb in enumerate(LIMBS)]
    return add_limbs(rows.select(*keys, *parts, F.lit(1).cast("bigint").alias("n_inputs")), keys)


def add_limbs(limbs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Limbs of equal keys in one, each modulo 2**64."""
    sums = [F.pmod(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias(c) for c in LIMBS]
    return limbs.groupBy(*keys).agg(*sums, F.sum("n_inputs").alias("n_inputs"))


def limbs_text(limbs: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """(keys, fingerprint of 64 hexadecimal digits, n_inputs)."""
    hexed = [F.lpad(F.lower(F.conv(F.col(c).cast("string"), 10, 16)), 16, "0") for c in LIMBS]
    return limbs.select(*keys, F.concat(*hexed).alias("fingerprint"), "n_inputs")


def fingerprint(parts: dict[str, DataFrame], keys: Sequence[str] = CYCLE_KEYS, cycles: DataFrame | None = None) -> DataFrame:
    """A digest of everything that feeds a cycle, to skip cycles that did not change.

    ``parts`` maps a name to rows with the cycle keys and the columns that matter. A part that
    lacks some of the keys (a project's contract, aliases of all projects) counts for all
    ``cycles`` it belongs to.
    """
    own = {n: df for n, df in parts.items() if all(k in df.columns for k in keys)}
    stacked = functools.reduce(DataFrame.unionByName, [digest_limbs(n, df, keys) for n, df in sorted(own.items())])
    for name, df in sorted(parts.items()):
        if name not in own:
            if cycles is None:
                raise ValueError(f"{name} has not all keys of a cycle: give the cycles")
            stacked = stacked.unionByName(spread_limbs(digest_limbs(name, df, [k for k in keys if k in df.columns]), cycles, keys))
    return limbs_text(add_limbs(stacked, keys), keys)


def spread_limbs(limbs: DataFrame, cycles: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """The limbs of a project, or of everything, at each of its cycles."""
    scope = [k for k in keys if k in limbs.columns]
    each = cycles.select(*keys).distinct()
    if scope:
        return join_null_safe(each, limbs, scope, "inner").select(*keys, *LIMBS, "n_inputs")
    one = limbs.select(F.struct(*LIMBS, "n_inputs").alias("one")).scalar()
    return each.withColumn("one", one).filter("one is not null").select(*keys, "one.*")


def changed_cycles(now: DataFrame, before: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Cycles whose inputs differ from the last run."""
    same = now.select(*keys, "fingerprint")
    return join_null_safe(same, before.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti").select(*keys)
