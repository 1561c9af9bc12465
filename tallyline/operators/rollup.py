"""Built and billed lines rolled up to units, both sides in one pass.

The two feeds are stacked and grouped once, so a full outer join is never needed. All
measures are mergeable (sums, minima and maxima of small structs): Spark combines them
before the shuffle, and a unit that owns a third of all lines costs one row per task.
Source references are kept as a table of their own (:func:`references`) and never
collected into a row of unknown length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.config import CUMULATIVE, DISCRETE
from tallyline.functions.numbers import exact_sum
from tallyline.functions.text import base_qty, base_uom, source_reference, unit_key
from tallyline.schemas import CYCLE_KEYS

BUILT, BILLED = 0, 1


def activity(asbuilt: DataFrame, invoices: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Stack both feeds into one narrow table; the other side's measures are null."""
    order = asbuilt.schema["line_no"].dataType
    none = F.lit(None).cast("double")
    built = asbuilt.select(
        *keys,
        "code",
        "raw_desc",
        F.lit(BUILT).alias("feed"),
        "line_no",
        base_qty(F.col("qty"), F.col("uom")).alias("built_qty"),
        base_uom(F.col("uom")).alias("built_uom"),
        none.alias("billed_qty"),
        none.alias("unit_price"),
        none.alias("amount"),
    )
    billed = invoices.select(
        *keys,
        "code",
        "raw_desc",
        F.lit(BILLED).alias("feed"),
        F.col("line_no").cast(order).alias("line_no"),
        none.alias("built_qty"),
        F.lit(None).cast("string").alias("built_uom"),
        F.col("qty").alias("billed_qty"),
        "unit_price",
        "amount",
    )
    return built.unionByName(billed)


def _line_amount() -> Column:
    return F.when(F.col("amount") != 0, F.col("amount")).otherwise(F.col("billed_qty") * F.col("unit_price"))


def _top_line() -> Column:
    """Greatest quantity first, then the earliest line: minimum of (-qty, line)."""
    return F.min(
        F.when(
            F.col("billed_qty").isNotNull(),
            F.struct(
                (-F.col("billed_qty")).alias("neg_qty"),
                F.col("line_no").alias("line"),
                _line_amount().alias("amount"),
            ),
        )
    )


def line_states(
    act: DataFrame, group: Sequence[str | Column], *, cumulative: bool = True, discrete: bool = True
) -> DataFrame:
    """Mergeable state per group: everything a unit needs, before codes are known."""
    measures = [
        F.min(F.struct("feed", F.col("line_no").alias("line"), "code", "raw_desc")).alias("first_seen"),
        exact_sum(F.col("built_qty")).alias("built_sum"),
        F.min(
            F.when(F.col("built_uom").isNotNull(), F.struct(F.col("line_no").alias("line"), F.col("built_uom").alias("uom")))
        ).alias("first_uom"),
        F.min(
            F.when(F.col("billed_qty").isNotNull(), F.struct(F.col("line_no").alias("line"), F.col("unit_price").alias("price")))
        ).alias("first_price"),
        F.count("built_qty").alias("n_built"),
        F.count("billed_qty").alias("n_billed"),
    ]
    if cumulative:
        measures.append(_top_line().alias("top_line"))
    if discrete:
        measures += [exact_sum(F.col("billed_qty")).alias("billed_sum"), exact_sum(_line_amount()).alias("amount_sum")]
    return act.groupBy(*group).agg(*measures)


def merge_states(states: DataFrame, group: Sequence[str | Column]) -> DataFrame:
    """Merge states of several groups into one (used after codes were looked up)."""
    measures = [
        F.min("first_seen").alias("first_seen"),
        exact_sum(F.col("built_sum")).alias("built_sum"),
        F.min("first_uom").alias("first_uom"),
        F.min("first_price").alias("first_price"),
        F.sum("n_built").alias("n_built"),
        F.sum("n_billed").alias("n_billed"),
    ]
    if "top_line" in states.columns:
        measures.append(F.min("top_line").alias("top_line"))
    if "billed_sum" in states.columns:
        measures += [exact_sum(F.col("billed_sum")).alias("billed_sum"), exact_sum(F.col("amount_sum")).alias("amount_sum")]
    return states.groupBy(*group).agg(*measures)


def unit_rollup(
    act: DataFrame,
    keys: Sequence[str] = CYCLE_KEYS,
    *,
    billing_mode: str | None = CUMULATIVE,
    cycles: DataFrame | None = None,
) -> DataFrame:
    """One row per unit with built and billed figures.

    ``billing_mode`` applies to all cycles; with ``cycles`` (cycle keys + billing_mode)
    each cycle uses its own mode.
    """
    mixed = cycles is not None
    states = line_states(
        act.withColumn("unit_key", unit_key(F.col("code"), F.col("raw_desc"))),
        [*keys, "unit_key"],
        cumulative=mixed or billing_mode == CUMULATIVE,
        discrete=mixed or billing_mode == DISCRETE,
    )
    return finish_rollup(states, keys, billing_mode=billing_mode, cycles=cycles)


def finish_rollup(
    states: DataFrame,
    keys: Sequence[str] = CYCLE_KEYS,
    *,
    billing_mode: str | None = CUMULATIVE,
    cycles: DataFrame | None = None,
) -> DataFrame:
    """Read the figures of the chosen billing mode out of the states."""
    top_qty, top_amount = -F.col("top_line.neg_qty"), F.col("top_line.amount")
    if cycles is not None:
        states = join_null_safe(states, cycles.select(*keys, "billing_mode"), keys, "left")
        is_cumulative = F.coalesce(F.col("billing_mode"), F.lit(CUMULATIVE)) == CUMULATIVE
        qty = F.when(is_cumulative, top_qty).otherwise(F.col("billed_sum"))
        amount = F.when(is_cumulative, top_amount).otherwise(F.col("amount_sum"))
        mode = F.coalesce(F.col("billing_mode"), F.lit(CUMULATIVE))
    elif billing_mode == CUMULATIVE:
        qty, amount, mode = top_qty, top_amount, F.lit(CUMULATIVE)
    else:
        qty, amount, mode = F.col("billed_sum"), F.col("amount_sum"), F.lit(DISCRETE)
    zero = F.lit(0.0)
    return (
        states.withColumn("billed_qty", F.coalesce(qty, zero))
        .withColumn("line_amount", F.coalesce(amount, zero))
        .select(
            *keys,
            "unit_key",
            F.col("first_seen.code").alias("code"),
            F.col("first_seen.raw_desc").alias("raw_desc"),
            mode.alias("billing_mode"),
            F.coalesce("built_sum", zero).alias("built_qty"),
            F.col("first_uom.uom").alias("built_uom"),
            "billed_qty",
            F.coalesce(
                F.when(F.col("billed_qty") != 0, F.col("line_amount") / F.col("billed_qty")),
                F.col("first_price.price"),
                zero,
            ).alias("billed_price"),
            F.col("n_built").cast("bigint").alias("n_built"),
            F.col("n_billed").cast("bigint").alias("n_billed"),
            F.struct("first_seen.feed", "first_seen.line").alias("first_seen"),
        )
    )


def same(left: Column, right: Column, key: str) -> Column:
    """Key equality. Only the contractor may be missing, and missing equals missing."""
    return left.eqNullSafe(right) if "contractor" in key else left == right


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on cycle keys, in which a cycle without contractor finds its like."""
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    condition = same(F.col(keys[0]), F.col(f"__{keys[0]}"), keys[0])
    for k in keys[1:]:
        condition = condition & same(F.col(k), F.col(f"__{k}"), k)
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def references(asbuilt: DataFrame, invoices: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Drill-down table: one row per contributing line of a unit, in line order."""
    key = unit_key(F.col("code"), F.col("raw_desc")).alias("unit_key")
    return asbuilt.select(
        *keys, key, F.lit(BUILT).alias("feed"), "line_no",
        source_reference("as-built", F.col("source_file"), F.col("source_ref")).alias("reference"),
    ).unionByName(
        invoices.select(
            *keys, key, F.lit(BILLED).alias("feed"), "line_no",
            source_reference("invoice", F.col("source_file"), F.col("line_ref")).alias("reference"),
        )
    )


def joined_in_parts(
    df: DataFrame, keys: Sequence[str], text: str, line: str, separator: str = "; ", part_lines: int = 10_000
) -> DataFrame:
    """Join many short texts per group, in line order, in parts of bounded length.

    A part covers a fixed span of line numbers, so no task ever collects more than
    ``part_lines`` texts of one group (line numbers are unique per group). Feeds of up
    to that many lines give one part, numbered 0; longer ones give the rest in order.
    """
    part = F.floor(F.col(line) / F.lit(part_lines)).cast("bigint")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), F.col(text).alias("text"))))
    return (
        df.filter(F.col(text).isNotNull() & (F.col(text) != ""))
        .groupBy(*keys, part.alias("part_no"))
        .agg(pairs.alias("pairs"))
        .select(
            *keys, "part_no",
            F.size("pairs").alias("n_texts"),
            F.array_join(F.transform("pairs", lambda p: p["text"]), separator).alias(text),
        )
    )
