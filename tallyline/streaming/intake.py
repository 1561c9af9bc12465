"""Invoices as they arrive: a folder of files to reconciled, saved cycles.

A micro-batch adds what is new in it: its lines that no earlier batch of their cycle has, and
the states these give. States of a cycle merge, so reconciling it again reads one row per unit
and batch, never its lines. Both are stored under the batch's number before anything is computed
from them, and cycles are saved by replacing them: a batch that runs again after a failure
writes the same files and the same cycles, and nothing is counted twice. Batches of a cycle are
folded into one now and then, which bounds the number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.config import Rules
from tallyline.operators.feeds import dedupe_invoices
from tallyline.functions.text import unit_key
from tallyline.operators.history import prior_billed, prior_cycles
from tallyline.operators.reconcile import reconcile_units
from tallyline.operators.rollup import activity, finish_rollup, join_null_safe, line_states, merge_states
from tallyline.schemas import CYCLE_KEYS, INVOICE_LINE
from tallyline.sources.tables import Store

DUPLICATE_KEY = (*CYCLE_KEYS, "invoice_id", "raw_desc", "qty", "unit_price")
LINES, STATES, TOUCHED, PRIOR = "invoice_line", "line_state", "touched_cycle", "prior_cycle"
#: Batches of a cycle that are kept apart before they are folded into one.
BATCHES_KEPT = 16


def checkpoint_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """The shared folder a query keeps its progress in: given, or that of the cluster."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("no checkpoint folder: set spark.checkpoint.dir or give one")
    return f"{base.rstrip('/')}/{name}"


def invoice_stream(spark: SparkSession, folder: str, schema: str = INVOICE_LINE, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of typed invoice lines as they arrive in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
        .withColumn("arrived", F.col("_metadata.file_modification_time"))
    )


def first_arrivals(lines: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Drop lines that repeat one of the last ``horizon``; the state is bounded by it.
    The saved cycles do not depend on it: they are de-duplicated over all their lines."""
    return lines.withWatermark("arrived", horizon).dropDuplicatesWithinWatermark(list(DUPLICATE_KEY))


def unit_states(asbuilt: DataFrame, invoices: DataFrame) -> DataFrame:
    """Mergeable states of lines by unit, for either billing mode."""
    act = activity(asbuilt, invoices).withColumn("unit_key", unit_key(F.col("code"), F.col("raw_desc")))
    return line_states(act, [*CYCLE_KEYS, "unit_key"])


def new_lines(batch: DataFrame, store: Store, touched: DataFrame, batch_id: int) -> DataFrame:
    """Lines of a batch that no earlier batch has. Of the stored lines only the duplicate key
    of the touched cycles is read."""
    once = dedupe_invoices(batch, CYCLE_KEYS, order=("source_file", "line_no"))
    seen = store.batches(LINES, INVOICE_LINE + ", arrived timestamp", touched).filter(F.col("batch_id") < batch_id).select(*DUPLICATE_KEY)
    same = F.lit(True)
    for k in DUPLICATE_KEY:
        same = same & once[k].eqNullSafe(seen[k])
    return once.join(seen, same, "left_anti")


def prior_of(store: Store, touched: DataFrame, known: DataFrame, batch_id: int) -> DataFrame:
    """What the cycles of a batch compare with, from the stored results.

    Which cycles there are is read from the partitions of the touched projects alone; the links
    found are stored, a row for each touched cycle, and prune the results to the prior cycles.
    """
    projects = touched.select("project_id").distinct()
    here = lambda df: join_null_safe(df.select(*CYCLE_KEYS), projects, ["project_id"], "left_semi")
    every = here(known).unionByName(touched).unionByName(here(store.results())).distinct()
    links = join_null_safe(prior_cycles(every), touched, CYCLE_KEYS, "left_semi")
    store.overwrite(links.withColumn("batch_id", F.lit(batch_id).cast("bigint")), PRIOR)
    read = store.read(PRIOR, "project_id string, contractor_id string, cycle_no int, prior_cycle_no int, prior_contractor_id string, batch_id bigint")
    return prior_billed(store.results(), links=read.filter(F.col("batch_id") == batch_id).drop("batch_id"))


def keep_cycles_current(
    lines: DataFrame,
    store: Store,
    asbuilt: DataFrame,
    contract: DataFrame,
    *,
    rules: Rules = Rules(),
    cycles: DataFrame | None = None,
    name: str = "invoice_intake",
    checkpoint: str | None = None,
    available_now: bool = False,
    batches_kept: int = BATCHES_KEPT,
) -> StreamingQuery:
    """Reconcile and save again every cycle that new lines belong to.

    ``cycles`` gives each cycle's billing mode; the stored cycles do where it is not given,
    and that of ``rules`` where neither has any. Cycles are compared with the stored rows
    of their prior cycle, and decisions stored beside the rows stay.
    """
    none = asbuilt.limit(0)

    def save(batch: DataFrame, batch_id: int) -> None:
        marked = batch.select(*CYCLE_KEYS).distinct().withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        store.overwrite(marked, TOUCHED)
        # Read back under a filter, so that it prunes what it is joined with.
        touched = store.read(TOUCHED, "project_id string, contractor_id string, cycle_no int, batch_id bigint").filter(F.col("batch_id") == batch_id).drop("batch_id")
        store.put_batch(new_lines(batch, store, touched, batch_id), LINES, batch_id)
        added = store.batches(LINES, INVOICE_LINE + ", arrived timestamp", touched).filter((F.col("batch_id") == batch_id) & (F.col("base") == 0))
        delta = unit_states(none, added)
        store.put_batch(delta, STATES, batch_id)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in delta.schema.fields)

        billed = join_null_safe(store.batches(STATES, schema, touched).drop("base", "batch_id"), touched, CYCLE_KEYS, "left_semi")
        built = unit_states(join_null_safe(asbuilt, touched, CYCLE_KEYS, "left_semi"), added.limit(0))
        states = merge_states(billed.unionByName(built), [*CYCLE_KEYS, "unit_key"])
        known = (store.cycles() if cycles is None else cycles).select(*CYCLE_KEYS, "billing_mode").dropDuplicates(list(CYCLE_KEYS))
        modes = join_null_safe(touched, known, CYCLE_KEYS, "left").withColumn("billing_mode", F.coalesce("billing_mode", F.lit(rules.billing_mode)))
        units = finish_rollup(states, CYCLE_KEYS, cycles=modes)
        store.save_results(reconcile_units(units, contract, rules=rules, prior=prior_of(store, touched, known, batch_id)))

        store.fold_batches(STATES, schema, touched, batches_kept, lambda df: merge_states(df, [*CYCLE_KEYS, "unit_key"]))
        store.fold_batches(LINES, INVOICE_LINE + ", arrived timestamp", touched, batches_kept, lambda df: df)

    writer = lines.writeStream.queryName(name).foreachBatch(save).option("checkpointLocation", checkpoint_folder(lines.sparkSession, name, checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
