"""Stored tables: cycle results, contract snapshots, registers, report files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import schemas
from tallyline.functions.text import row_key
from tallyline.operators.history import audit_entry, same_cycle
from tallyline.operators.reconcile import with_measures
from tallyline.operators.review import detail_table, flagged, unmatched, with_resolutions
from tallyline.operators.rollup import join_null_safe
from tallyline.operators.totals import summary_metrics


PARTITIONS = ("project_id", "contractor_id", "cycle_no")
BATCH_PARTITIONS = ("project_id", "cycle_no", "base", "batch_id")
RESULT_COLUMNS = (
    "code", "description", "uom", "built_qty", "billed_qty", "contract_price", "billed_price", "est_qty", "billed_amount",
    "expected_amount", "variance", "severity", "flags", "resolution", "resolution_note", "resolved_by", "resolved_at",
)


class Store:
    """Parquet tables under one folder that all executors share.

    Cycle tables are partitioned by cycle, and a save replaces exactly the cycles it
    holds, so saving twice changes nothing. Rows are rebalanced before a write: Spark
    splits a cycle that is too large for one task and merges small ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str, schema: str) -> DataFrame:
        """A table, empty while it was never written. Files of older layouts are read
        with the columns they lack as null."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mergeSchema", True).parquet(self.path(name))

    def replace_partitions(self, df: DataFrame, name: str, by: Sequence[str] = PARTITIONS) -> None:
        (
            df.hint("rebalance", *by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*by)
            .parquet(self.path(name))
        )

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(self.path(name))

    def overwrite(self, df: DataFrame, name: str) -> None:
        """The whole of a small table."""
        df.write.mode("overwrite").parquet(self.path(name))

    # --- batches -------------------------------------------------------------
    def put_batch(self, df: DataFrame, name: str, batch_id: int) -> None:
        """Rows of cycles that one batch adds. A batch that is put again replaces what it put."""
        marked = df.withColumn("base", F.lit(0)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        self.replace_partitions(marked, name, BATCH_PARTITIONS)

    def batches(self, name: str, schema: str, touched: DataFrame | None = None) -> DataFrame:
        """Rows of all batches, or of the cycles of ``touched``, with ``base`` and ``batch_id``.

        Where batches of a cycle were folded, what the fold holds is not read a second time,
        also if the batches folded are still there.
        """
        rows = self.read(name, f"{schema}, base int, batch_id bigint")
        if touched is not None:
            rows = join_null_safe(rows, touched.select("project_id", "cycle_no").distinct(), ["project_id", "cycle_no"], "left_semi")
        folds = rows.filter("base = 1").groupBy(F.col("project_id").alias("__p"), F.col("cycle_no").alias("__n")).agg(F.max("batch_id").alias("__to"))
        joined = rows.join(folds, (F.col("project_id") == F.col("__p")) & (F.col("cycle_no") == F.col("__n")), "left")
        return joined.filter("__to is null or batch_id > __to or (base = 1 and batch_id = __to)").drop("__p", "__n", "__to")

    def fold_batches(self, name: str, schema: str, touched: DataFrame, kept: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Cycles of ``touched`` with more than ``kept`` batches get one that holds them all.

        It is written as a whole before the others go, and counts from then on; a fold that
        fails leaves everything as it was, one that fails while removing is finished by the next.
        """
        rows = self.batches(name, schema, touched)
        counts = rows.select("project_id", "cycle_no", "base", "batch_id").distinct().groupBy("project_id", "cycle_no").agg(F.count(F.lit(1)).alias("__n"), F.max("batch_id").alias("__last"))
        full = counts.filter(F.col("__n") > kept).collect()  # a row for each cycle that is folded now
        if not full:
            return
        chosen = self.spark.createDataFrame([(r["project_id"], r["cycle_no"], r["__last"]) for r in full], "project_id string, cycle_no int, __last bigint")
        folded = join_null_safe(rows, chosen.drop("__last"), ["project_id", "cycle_no"], "left_semi")
        whole = join_null_safe(fold(folded.drop("base", "batch_id")), chosen, ["project_id", "cycle_no"], "inner")
        self.replace_partitions(whole.withColumn("base", F.lit(1)).withColumnRenamed("__last", "batch_id"), name, BATCH_PARTITIONS)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path(name)).getFileSystem(self.spark._jsc.hadoopConfiguration())
        last = {(r["project_id"], r["cycle_no"]): r["__last"] for r in full}
        stored = self.read(name, f"{schema}, base int, batch_id bigint")
        old = join_null_safe(stored, chosen.drop("__last"), ["project_id", "cycle_no"], "left_semi").select("project_id", "cycle_no", "base", "batch_id", F.col("_metadata.file_path").alias("file")).distinct()
        for r in old.collect():
            if (r["base"], r["batch_id"]) != (1, last[r["project_id"], r["cycle_no"]]) and r["batch_id"] <= last[r["project_id"], r["cycle_no"]]:
                fs.delete(fs_path(r["file"]).getParent(), True)

    # --- cycles --------------------------------------------------------------
    def save_results(self, rows: DataFrame, resolutions: DataFrame | None = None) -> None:
        """Reconciled rows of whole cycles, with the reviewer decisions beside them. Without
        ``resolutions`` the decisions that are stored for these rows stay."""
        if resolutions is None and "resolution" not in rows.columns:
            resolutions = self.decisions()
        if resolutions is not None:
            rows = with_resolutions(rows, resolutions)
        for c in ("resolution", "resolution_note", "resolved_by", "resolved_at"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        self.replace_partitions(rows.select(*PARTITIONS, *RESULT_COLUMNS), "recon_result")

    def decisions(self) -> DataFrame:
        """The decisions stored beside the rows, as they are handed to a save."""
        decided = self.results().filter("resolution is not null or resolution_note is not null")
        return decided.select(
            *PARTITIONS, row_key(F.col("code"), F.col("description")).alias("row_key"), F.col("resolution").alias("status"),
            F.col("resolution_note").alias("note"), F.col("resolved_by").alias("by"), F.col("resolved_at").alias("at"),
        )

    def results(self) -> DataFrame:
        return self.read("recon_result", schemas.RECON_RESULT)

    def cycle_results(self, project_id: str, contractor_id: str | None, cycle_no: int) -> DataFrame:
        """One cycle in code order; only its own files are read."""
        return self.results().filter(same_cycle(project_id, contractor_id, cycle_no)).orderBy(F.asc_nulls_first("code"))

    def save_cycles(self, cycles: DataFrame) -> None:
        """Cycle metadata. A cycle saved again keeps the time it was first created."""
        known = self.read("billing_cycle", schemas.BILLING_CYCLE).select(*PARTITIONS, F.col("created_at").alias("first_created"))
        merged = join_null_safe(cycles.drop("created_at"), known, PARTITIONS, "left")
        fresh = merged.withColumn("created_at", F.coalesce("first_created", F.current_timestamp())).drop("first_created")
        self.replace_partitions(self._shaped(fresh, schemas.BILLING_CYCLE), "billing_cycle")

    def cycles(self) -> DataFrame:
        return self.read("billing_cycle", schemas.BILLING_CYCLE)

    def save_contract(self, items: DataFrame) -> None:
        """The contract of whole projects, as it is: duplicate codes stay."""
        self.replace_partitions(self._shaped(items, schemas.CONTRACT_ITEM), "contract_item", ("project_id",))

    def contract(self, project_id: str | None = None) -> DataFrame:
        items = self.read("contract_item", schemas.CONTRACT_ITEM).withColumn("est_qty", F.coalesce("est_qty", F.lit(0.0)))
        return items if project_id is None else items.filter(F.col("project_id") == project_id).orderBy("code")

    def _shaped(self, df: DataFrame, schema: str) -> DataFrame:
        fields = self.spark.createDataFrame([], schema).schema.fields
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def save_snapshot(
        self, rows: DataFrame, contract: DataFrame, cycles: DataFrame, resolutions: DataFrame | None = None, actor: str | None = None
    ) -> None:
        """Finalise cycles: registers, contract, metadata, rows, audit. Each table is
        replaced for the given keys only, so a repeated save gives the same state."""
        named = cycles.filter("coalesce(contractor_id, '') <> ''")
        self.register("contractor", named.select(F.col("contractor_id").alias("contractor_id")).distinct())
        self.register("project_contractor", named.select("project_id", "contractor_id").distinct())
        self.register("project", cycles.select("project_id").distinct())
        self.save_contract(contract)
        self.save_cycles(cycles)
        self.save_results(rows, resolutions)
        saved = cycles.select(*PARTITIONS).distinct()
        stored = join_null_safe(self.results(), saved, PARTITIONS, "left_semi")
        counts = join_null_safe(saved, stored.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n_units")), PARTITIONS, "left")
        detail = {
            "project": F.col("project_id"), "contractor": F.col("contractor_id"), "cycle_no": F.col("cycle_no"),
            "n_units": F.coalesce("n_units", F.lit(0)),
        }
        entity_id = F.concat_ws("/", "project_id", "contractor_id", "cycle_no")
        self.append(audit_entry(counts, F.lit(actor), "save_cycle", "billing_cycle", entity_id, detail), "audit_log")

    # --- registers -----------------------------------------------------------
    REGISTERS = {
        "project": "project_id string, created_at timestamp",
        "contractor": "contractor_id string, created_at timestamp",
        "project_contractor": "project_id string, contractor_id string, created_at timestamp",
    }

    def register(self, name: str, rows: DataFrame) -> None:
        """Add the rows that are not registered yet."""
        keys = rows.columns
        new = rows.join(self.read(name, self.REGISTERS[name]).select(*keys), keys, "left_anti")
        self.append(new.withColumn("created_at", F.current_timestamp()), name)

    def registered(self, name: str) -> DataFrame:
        return self.read(name, self.REGISTERS[name])

    def audit(self) -> DataFrame:
        return self.read("audit_log", "ts timestamp, actor string, action string, entity string, entity_id string, detail map<string,string>")

    # --- reports -------------------------------------------------------------
    def write_reports(self, rows: DataFrame, totals: DataFrame, name: str = "reports") -> None:
        """Summary, flagged, full and unmatched tables as csv, one folder each."""
        tables = {
            "summary": summary_metrics(totals), "flagged": detail_table(flagged(rows)), "detail": detail_table(rows),
            "unmatched": detail_table(unmatched(rows)),
        }
        for part, df in tables.items():
            df.write.mode("overwrite").option("header", True).csv(f"{self.path(name)}/{part}")


def cycle_detail(results: DataFrame) -> DataFrame:
    """Saved rows as a reconciliation again: derived figures and row keys are computed,
    what was not stored (change-order mark, prior quantity) is empty."""
    return (
        with_measures(results.withColumn("prior_billed_qty", F.lit(None).cast("double")))
        .withColumn("is_change_order", F.lit(False))
        .withColumn("row_key", row_key(F.col("code"), F.col("description")))
    )


def flags_to_json(flags: Column) -> Column:
    return F.to_json(flags)


def flags_from_json(text: Column) -> Column:
    return F.from_json(text, f"array<{schemas.FLAG}>")
