"""Reconcile again only what changed: stored feeds, their digests, and the cycles these tell apart.

A feed is stored by cycle, and its digest per cycle beside it in the same save. What feeds a cycle
is the sum of digests: its lines, its contract, the codes and marks of its project, its billing
mode and rate, and its prior cycle's result. A run adds the stored digests, drops the cycles whose
sum it has seen, and joins the feeds with the few that are left, so that Spark opens their
partitions alone. Where nothing changed no feed is read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.config import Rules
from tallyline.operators import review
from tallyline.operators.history import prior_billed, prior_cycles
from tallyline.operators.reconcile import reconcile
from tallyline.operators.rollup import join_null_safe
from tallyline.schemas import ASBUILT_LINE, CYCLE_KEYS, INVOICE_LINE
from tallyline.sources.tables import PARTITIONS, Store

FEEDS = {"asbuilt": ASBUILT_LINE, "invoices": INVOICE_LINE}
_LIMBS = ", ".join(f"{limb} decimal(20,0)" for limb in review.LIMBS) + ", n_inputs bigint"
_KEYS = "project_id string, contractor_id string, cycle_no int"
DIGESTS, DONE, CHANGED = "feed_digest", "reconciled_digest", "changed_cycle"


def save_feed(store: Store, name: str, lines: DataFrame) -> None:
    """The lines of whole cycles, replacing what these cycles had, and their digests."""
    store.replace_partitions(lines, name)
    stored = join_null_safe(store.read(name, FEEDS[name]), lines.select(*CYCLE_KEYS).distinct(), CYCLE_KEYS, "left_semi")
    digests = review.digest_limbs(name, stored, CYCLE_KEYS).withColumn("feed", F.lit(name))
    store.replace_partitions(digests, DIGESTS, ("feed", *PARTITIONS))


def cycle_digests(store: Store, contract: DataFrame, cycles: DataFrame, shared: Mapping[str, DataFrame], rules: Rules) -> DataFrame:
    """(cycle keys, fingerprint, n_inputs) of all stored cycles. ``shared`` has what projects or
    all of them have in common, such as mappings and marks."""
    feeds = store.read(DIGESTS, f"{_LIMBS}, feed string, {_KEYS}").drop("feed")
    every = feeds.select(*CYCLE_KEYS).distinct()
    settings = join_null_safe(every, cycles.dropDuplicates(list(CYCLE_KEYS)), CYCLE_KEYS, "left").withColumn("rules", F.lit(repr(rules)))
    parts = [feeds.select(*CYCLE_KEYS, *review.LIMBS, "n_inputs"), review.digest_limbs("settings", settings, CYCLE_KEYS)]
    for name, df in {"contract": contract, **shared}.items():
        scope = [k for k in CYCLE_KEYS if k in df.columns]
        parts.append(review.spread_limbs(review.digest_limbs(name, df, scope), every))
    links = prior_cycles(every)
    before = prior_billed(store.results(), links=links)
    parts.append(review.digest_limbs("prior", before, CYCLE_KEYS))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return review.limbs_text(review.add_limbs(stacked, CYCLE_KEYS))


def _of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the cycles in keys. Spark prunes partitions by plain equality alone, so a missing
    contractor is compared as text as well."""
    named = keys.select(*[F.col(k).alias(f"__{k}") for k in CYCLE_KEYS])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    same = (F.col("project_id") == F.col("__project_id")) & (F.col("cycle_no") == F.col("__cycle_no")) & (text("contractor_id") == text("__contractor_id"))
    return rows.join(named, same & F.col("contractor_id").eqNullSafe(F.col("__contractor_id")), "left_semi")


def recompute(store: Store, contract: DataFrame, cycles: DataFrame, shared: Mapping[str, DataFrame] | None = None, rules: Rules = Rules()) -> int:
    """Reconcile and save the cycles whose inputs changed since the last run; returns how many.

    ``cycles``: cycle keys with billing_mode and whatever else decides. A cycle whose prior
    cycle was reconciled in this run is due in the next, as its input changed by that: run until
    none is left to settle whole chains.
    """
    now = cycle_digests(store, contract, cycles, shared or {}, rules)
    before = store.read(DONE, f"fingerprint string, {_KEYS}")
    due = join_null_safe(now, before.select(*CYCLE_KEYS, F.col("fingerprint").alias("was")), CYCLE_KEYS, "left")
    store.overwrite(due.filter("was is null or was <> fingerprint").select(*CYCLE_KEYS, "fingerprint", F.lit(1).alias("due")), CHANGED)
    # Read back under a filter, so that it prunes the feeds it is joined with.
    changed = store.read(CHANGED, f"{_KEYS}, fingerprint string, due int").filter("due = 1")
    n = changed.count()
    if n:
        keys = changed.select(*CYCLE_KEYS)
        built, billed = (_of(store.read(f, FEEDS[f]), keys) for f in FEEDS)
        modes = join_null_safe(keys, cycles.select(*CYCLE_KEYS, "billing_mode").dropDuplicates(list(CYCLE_KEYS)), CYCLE_KEYS, "left").withColumn("billing_mode", F.coalesce("billing_mode", F.lit(rules.billing_mode)))
        every = store.read(DIGESTS, f"{_LIMBS}, feed string, {_KEYS}").select(*CYCLE_KEYS).distinct()
        links = join_null_safe(prior_cycles(every), keys, CYCLE_KEYS, "left_semi")
        store.save_results(reconcile(built, billed, contract, rules=rules, cycles=modes, prior=prior_billed(store.results(), links=links)))
        store.replace_partitions(changed.select("fingerprint", *PARTITIONS), DONE)
    return n
