"""Saved cycles: prior figures, summaries, trend, portfolio, registers.

Tables are plain DataFrames. ``cycles`` holds one row per (project, contractor or null,
cycle_no); ``results`` the reconciled rows under the same keys. What the history views
need is grouped once over all projects; nothing loops over projects or cycles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.config import CUMULATIVE
from tallyline.functions.numbers import exact_sum
from tallyline.operators.rollup import join_null_safe
from tallyline.operators.totals import over_billing
from tallyline.schemas import CYCLE_KEYS

UNATTRIBUTED = "— Unattributed"


def _sum0(c: str) -> Column:
    return F.coalesce(exact_sum(F.col(c)), F.lit(0.0))


# --- prior cycle -------------------------------------------------------------
def prior_cycles(cycles: DataFrame) -> DataFrame:
    """For every cycle the cycle its billing is compared with: the greatest earlier
    cycle number of the same contractor, or, for a cycle without contractor, of any
    contractor of the project (of several, the one created first)."""
    seq = F.col("created_at") if "created_at" in cycles.columns else F.lit(0)
    listed = cycles.select(*CYCLE_KEYS, seq.alias("__seq"))
    named = (
        listed.filter("contractor_id is not null")
        .withColumn("prior_cycle_no", F.lag("cycle_no").over(Window.partitionBy("project_id", "contractor_id").orderBy("cycle_no")))
        .withColumn("prior_contractor_id", F.col("contractor_id"))
    )
    # One row per project and number first, so the window sees few rows per project.
    numbers = listed.groupBy("project_id", "cycle_no").agg(
        F.min(F.struct("__seq", "contractor_id")).alias("first"),
        F.max(F.col("contractor_id").isNull()).alias("has_open"),
    )
    earlier = Window.partitionBy("project_id").orderBy("cycle_no")
    open_cycles = (
        numbers.withColumn("before", F.lag(F.struct("cycle_no", "first.contractor_id")).over(earlier))
        .filter("has_open")
        .select(
            "project_id",
            F.lit(None).cast(cycles.schema["contractor_id"].dataType).alias("contractor_id"),
            "cycle_no",
            F.col("before.cycle_no").alias("prior_cycle_no"),
            F.col("before.contractor_id").alias("prior_contractor_id"),
        )
    )
    return named.drop("__seq").unionByName(open_cycles).filter("prior_cycle_no is not null")


def prior_billed(results: DataFrame, cycles: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(cycle keys, code, prior_billed_qty) to hand to the reconciliation.

    ``cycles``: all that there are; or ``links``, what each cycle is compared with. Few links
    that come from a filter let Spark read only the partitions of the cycles they name.
    """
    link = prior_cycles(cycles) if links is None else links
    saved = results.filter("coalesce(code, '') <> ''").select(
        F.col("project_id").alias("__p"),
        F.col("contractor_id").alias("__c"),
        F.col("cycle_no").alias("__n"),
        "code",
        F.coalesce("billed_qty", F.lit(0.0)).alias("prior_billed_qty"),
    )
    on = (
        (F.col("project_id") == F.col("__p"))
        & (F.col("prior_cycle_no") == F.col("__n"))
        & F.col("prior_contractor_id").eqNullSafe(F.col("__c"))
    )
    return link.join(saved, on).select(*CYCLE_KEYS, "code", "prior_billed_qty")


def with_prior_in_place(units: DataFrame, cycles: DataFrame) -> DataFrame:
    """Prior quantities for a table that already holds every cycle.

    Instead of joining the units to themselves, each unit looks at its own previous
    appearance, which counts only if it lies in the cycle directly before. A cycle without
    contractor compares with another contractor's cycle: the units of that one (known from
    ``cycles`` alone) leave a mark under the cycle they are compared with, and the unit
    there finds the mark directly before itself.
    """
    links = prior_cycles(cycles)
    marked = links.filter("contractor_id is null").select(
        F.col("project_id").alias("__p"),
        F.col("prior_contractor_id").alias("__c"),
        F.col("prior_cycle_no").alias("__n"),
        F.col("cycle_no").alias("__at"),
    )
    here = (
        (F.col("project_id") == F.col("__p"))
        & F.col("contractor_id").eqNullSafe(F.col("__c"))
        & (F.col("cycle_no") == F.col("__n"))
    )
    own = F.struct(F.col("contractor_id").alias("c"), F.col("cycle_no").alias("n"), F.lit(1).alias("own"))
    mark = F.struct(F.lit(None).cast(units.schema["contractor_id"].dataType).alias("c"), F.col("__at").alias("n"), F.lit(0).alias("own"))
    placed = (
        units.join(marked, here, "left")
        .withColumn("__to", F.explode(F.when(F.col("__at").isNull(), F.array(own)).otherwise(F.array(own, mark))))
        .withColumns({"contractor_id": F.col("__to.c"), "cycle_no": F.col("__to.n")})
    )
    per_unit = Window.partitionBy("project_id", "contractor_id", "unit_key").orderBy("cycle_no", "__to.own")
    seen = F.lag(F.struct("cycle_no", "__to.own", "billed_qty")).over(per_unit)
    before = links.filter("contractor_id is not null").select(*CYCLE_KEYS, "prior_cycle_no")
    usable = (F.col("billing_mode") == CUMULATIVE) & (F.coalesce(F.col("code"), F.lit("")) != "")
    of_anyone = F.col("contractor_id").isNull() & (F.col("__seen.own") == 0) & (F.col("__seen.cycle_no") == F.col("cycle_no"))
    return (
        join_null_safe(placed.withColumn("__seen", seen).filter("__to.own = 1"), before, CYCLE_KEYS, "left")
        .withColumn(
            "prior_billed_qty",
            F.when(usable & ((F.col("__seen.cycle_no") == F.col("prior_cycle_no")) | of_anyone), F.col("__seen.billed_qty")),
        )
        .drop("__seen", "prior_cycle_no", "__to", "__p", "__c", "__n", "__at")
    )


# --- summaries ---------------------------------------------------------------
def cycle_summaries(cycles: DataFrame, results: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Headline numbers of every saved cycle, recomputed from its stored rows."""
    sums = results.groupBy(*keys).agg(
        exact_sum(F.col("billed_amount")).alias("billed"),
        exact_sum(F.col("expected_amount")).alias("expected"),
        over_billing().alias("flagged"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count(F.lit(1)).alias("n_units"),
    )
    joined = join_null_safe(cycles, sums, keys, "left")
    zero, none = F.lit(0.0), F.lit(0)
    for c in ("billed", "expected", "flagged"):
        joined = joined.withColumn(c, F.coalesce(c, zero))
    for c in ("n_critical", "n_units"):
        joined = joined.withColumn(c, F.coalesce(c, none).cast("bigint"))
    return joined.withColumn("retainage", F.col("billed") * F.coalesce("retainage_pct", zero) / 100.0).withColumn(
        "net", F.col("billed") - F.col("flagged") - F.col("retainage")
    )


def trend(cycles: DataFrame, results: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """Built against billed value per cycle; a cycle without rows keeps null sums."""
    sums = results.groupBy(*keys).agg(
        exact_sum(F.col("expected_amount")).alias("built_value"),
        exact_sum(F.col("billed_amount")).alias("billed_value"),
    )
    return join_null_safe(cycles.select(*keys, "period_label"), sums, keys, "left")


def project_contractors(links: DataFrame, contractors: DataFrame) -> DataFrame:
    """Contractors attached to a project."""
    return links.join(contractors, "contractor_id").select("project_id", *contractors.columns)


def portfolio_stats(projects: DataFrame, links: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per project: cycles, billed, built and flagged value, latest period.

    ``billed`` adds the cycles up, as a portfolio view does even where they bill to
    date; ``latest_to_date`` holds the sum of each contractor's last cycle beside it.
    """
    per_contractor = summaries.groupBy("project_id", "contractor_id").agg(
        F.count(F.lit(1)).alias("n_cycles"),
        exact_sum(F.col("billed")).alias("billed"),
        exact_sum(F.col("expected")).alias("built"),
        exact_sum(F.col("flagged")).alias("flagged"),
        F.max(F.struct("cycle_no", "contractor_id", "period_label", "billed")).alias("latest"),
    )
    per_project = per_contractor.groupBy("project_id").agg(
        F.sum("n_cycles").alias("n_cycles"),
        exact_sum(F.col("billed")).alias("billed"),
        exact_sum(F.col("built")).alias("built"),
        exact_sum(F.col("flagged")).alias("flagged"),
        exact_sum(F.col("latest.billed")).alias("latest_to_date"),
        F.max("latest").alias("latest"),
    )
    attached = links.groupBy("project_id").agg(F.count_distinct("contractor_id").alias("n_contractors"))
    stats = projects.join(per_project, "project_id", "left").join(attached, "project_id", "left")
    for c in ("billed", "built", "flagged", "latest_to_date"):
        stats = stats.withColumn(c, F.coalesce(c, F.lit(0.0)))
    for c in ("n_cycles", "n_contractors"):
        stats = stats.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    return (
        stats.withColumn("status", F.coalesce("status", F.lit("active")))
        .withColumn("latest_period", F.col("latest.period_label"))
        .drop("latest")
    )


def portfolio_kpis(stats: DataFrame, links: DataFrame) -> DataFrame:
    """The figures above the project list, in one row."""
    names = links.select("contractor_id").distinct()
    none = F.lit(0).cast("bigint")
    per_project = stats.select(
        F.lit(1).alias("n_projects"),
        (F.lower(F.coalesce("status", F.lit("active"))) == "active").cast("int").alias("n_active"),
        none.alias("n_contractors"),
        "n_cycles", "billed", "built", "flagged",
    )
    per_name = names.select(
        F.lit(0).alias("n_projects"), F.lit(0).alias("n_active"), F.lit(1).alias("n_contractors"), none.alias("n_cycles"),
        *[F.lit(0.0).alias(c) for c in ("billed", "built", "flagged")],
    )
    return per_project.unionByName(per_name).agg(
        *[F.coalesce(F.sum(c), none).alias(c) for c in ("n_projects", "n_active", "n_contractors", "n_cycles")],
        *[_sum0(c).alias(c) for c in ("billed", "built", "flagged")],
    )


def portfolio_rollup(summaries: DataFrame) -> DataFrame:
    """Cycle, contractor, project and grand totals from one grouping."""
    return summaries.rollup("project_id", "contractor_id", "cycle_no").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n_cycles"),
        exact_sum(F.col("billed")).alias("billed"),
        exact_sum(F.col("expected")).alias("built"),
        exact_sum(F.col("flagged")).alias("flagged"),
    )


def cycles_by_contractor(cycles: DataFrame, links: DataFrame, contractors: DataFrame) -> DataFrame:
    """Cycles of each project under their contractor; attached contractors without a
    cycle are listed empty, cycles without contractor come last."""
    names = contractors.select("contractor_id", F.col("name").alias("contractor"))
    attached = links.select("project_id", "contractor_id").join(names, "contractor_id")
    given = cycles.join(names, "contractor_id", "left").withColumn("contractor", F.coalesce("contractor", F.lit(UNATTRIBUTED)))
    empty = join_null_safe(attached, cycles.select("project_id", "contractor_id"), ("project_id", "contractor_id"), "left_anti")
    both = given.unionByName(empty.select("project_id", "contractor_id", "contractor"), allowMissingColumns=True)
    return both.withColumn("group_no", F.when(F.col("contractor") == UNATTRIBUTED, 1).otherwise(0)).withColumn(
        "has_cycles", F.col("cycle_no").isNotNull()
    )


def contractor_projects(contractors: DataFrame, links: DataFrame, projects: DataFrame) -> DataFrame:
    """Every contractor beside each project it is attached to; without any, once with null."""
    named = links.join(projects.select("project_id", F.col("name").alias("project")), "project_id")
    return contractors.join(named.select("contractor_id", "project"), "contractor_id", "left")


def next_cycle_numbers(links: DataFrame, cycles: DataFrame) -> DataFrame:
    """Greatest number plus one per project and contractor; 1 where none is saved."""
    last = cycles.groupBy("project_id", "contractor_id").agg(F.max("cycle_no").alias("last_no"))
    pairs = links.select("project_id", "contractor_id").distinct()
    return join_null_safe(pairs, last, ("project_id", "contractor_id"), "left").select(
        "project_id", "contractor_id", (F.coalesce("last_no", F.lit(0)) + 1).alias("next_cycle_no")
    )


def next_cycle_number_of_project(projects: DataFrame, cycles: DataFrame) -> DataFrame:
    last = cycles.groupBy("project_id").agg(F.max("cycle_no").alias("last_no"))
    return projects.select("project_id").join(last, "project_id", "left").select(
        "project_id", (F.coalesce("last_no", F.lit(0)) + 1).alias("next_cycle_no")
    )


def scoped_cycles(cycles: DataFrame, project_id: str, contractor_id: str | None = None) -> DataFrame:
    """Cycles of a project, of one contractor if named, oldest first."""
    mine = cycles.filter(F.col("project_id") == project_id)
    if contractor_id is not None:
        mine = mine.filter(F.col("contractor_id") == contractor_id)
    return mine.orderBy("cycle_no")


def same_cycle(project_id: str, contractor_id: str | None, cycle_no: int) -> Column:
    """Exact identity of a cycle; a missing contractor equals only a missing one."""
    return (
        (F.col("project_id") == project_id)
        & F.col("contractor_id").eqNullSafe(F.lit(contractor_id))
        & (F.col("cycle_no") == cycle_no)
    )


# --- registers ---------------------------------------------------------------
def last_wins(log: DataFrame, keys: Sequence[str], order: Column, deleted: Column | None = None) -> DataFrame:
    """Current state of a keyed log: the latest entry per key, deletions dropped."""
    rest = [c for c in log.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("entry")).select(*keys, "entry.*")
    return latest if deleted is None else latest.filter(~F.coalesce(deleted, F.lit(False)))


def alias_upsert(aliases: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Learned mappings with new confirmations; per text the latest one holds. Equal
    times go to the new batch."""
    both = aliases.withColumn("__batch", F.lit(0)).unionByName(confirmed.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, ["normalized_desc"], F.struct("confirmed_at", "__batch", "code")).drop("__batch")


def alias_forget(aliases: DataFrame, reopened: DataFrame) -> DataFrame:
    """Drop the mappings of texts that were reopened for review."""
    return aliases.join(reopened.select("normalized_desc"), "normalized_desc", "left_anti")


def profiles(log: DataFrame) -> DataFrame:
    """Saved template profiles: last save per contractor, deleted ones gone."""
    return last_wins(log, ["contractor"], F.col("updated_at"), F.col("deleted"))


def register(existing: DataFrame, names: DataFrame, id_column: str) -> DataFrame:
    """Get-or-create: rows for the names that are not there yet. The id is a hash of
    the name, so any number of writers agree on it without a counter."""
    clean = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    new = clean.join(existing.select("name"), "name", "left_anti")
    return new.select(F.xxhash64("name").cast("string").alias(id_column), "name")


def link(existing: DataFrame, pairs: DataFrame) -> DataFrame:
    """Insert-or-ignore of project-contractor pairs."""
    keys = ["project_id", "contractor_id"]
    return pairs.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def latest_project_by_name(projects: DataFrame) -> DataFrame:
    """Of projects with one name the newest."""
    rest = [c for c in projects.columns if c != "name"]
    return projects.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("created_at", "project_id")).alias("p")).select("name", "p.*")


def newest_projects(projects: DataFrame, n: int | None = None) -> DataFrame:
    ordered = projects.orderBy(F.col("created_at").desc(), F.col("project_id").desc())
    return ordered if n is None else ordered.limit(n)


# --- audit -------------------------------------------------------------------
def audit_entry(df: DataFrame, actor: Column, action: str, entity: str, entity_id: Column, detail: dict[str, Column]) -> DataFrame:
    """Audit rows for what a job did, ready to be appended."""
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.current_timestamp().alias("ts"),
        actor.cast("string").alias("actor"),
        F.lit(action).alias("action"),
        F.lit(entity).alias("entity"),
        entity_id.cast("string").alias("entity_id"),
        F.create_map(*pairs).alias("detail"),
    )


def audit_trail(log: DataFrame, limit: int | None = 200, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Newest entries first, all of them without a limit."""
    ordered = log.orderBy(*[F.col(c).desc() for c in order])
    return ordered if limit is None else ordered.limit(limit)


def detail_text(detail: Column, width: int | None = None) -> Column:
    """``k=v, …`` of a detail map, whole unless a width is asked for."""
    pairs = F.transform(F.map_entries(detail), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    text = F.array_join(pairs, ", ")
    return text if width is None else F.substring(text, 1, width)


def project_overview(project_id: str, projects: DataFrame, links: DataFrame, contractors: DataFrame, cycles: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The tables of a project's page: header with sums, contractors, cycles, trend. The
    filters on the project reach the partitions of the stored tables."""
    mine = F.col("project_id") == project_id
    saved, rows = cycles.filter(mine), results.filter(mine)
    summaries = cycle_summaries(saved, rows)
    return {
        "header": portfolio_stats(projects.filter(mine), links.filter(mine), summaries),
        "contractors": project_contractors(links.filter(mine), contractors).orderBy("name"),
        "cycles": summaries.orderBy("cycle_no"),
        "trend": trend(saved, rows).orderBy("cycle_no"),
    }


def confidence_kinds(asbuilt: DataFrame, keys: Sequence[str] = CYCLE_KEYS) -> DataFrame:
    """The kinds of confidence among a cycle's as-built lines, sorted."""
    kinds = asbuilt.select(*keys, "confidence").distinct()
    return kinds.groupBy(*keys).agg(F.array_sort(F.collect_set("confidence")).alias("kinds"))
