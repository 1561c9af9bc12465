"""From folders of sheets to reconciled cycles, in one plan.

Sheets lie below ``<root>/<kind>/project_id=…/contractor_id=…/cycle_no=…`` (bid schedules below
``project_id=…`` alone), so what a line belongs to comes from its path, and cycles that are not
asked for are left out before a file is opened. A sheet that cannot be read as its kind becomes
a row with the reason, beside the lines of the others: one bad file fails no cycle and is not
lost either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.config import Matching, Rules
from tallyline.operators import feeds
from tallyline.operators.contract import contract_items
from tallyline.operators.header import CONTRACT_WORDS, INVOICE_WORDS, TABLE, TALLY_WORDS, claim_columns, find_headers, first_row_headers, match_columns
from tallyline.plans.cycle import reconcile_described
from tallyline.schemas import CYCLE_KEYS
from tallyline.sources.grids import read_folder

CONTRACTS, TALLIES, INVOICES = "contract", "tally", "invoices"
PROJECT = ("project_id",)
#: Columns without which a sheet of a kind cannot be read.
NEEDED = {CONTRACTS: ("code", "description", "unit_price"), TALLIES: ("desc", "qty"), INVOICES: ("desc", "qty")}
REJECT = "kind string, project_id string, contractor_id string, cycle_no int, file string, reason string"


def sheets(spark: SparkSession, root: str, kind: str, where: str | None = None) -> DataFrame:
    """The rows of all sheets of a kind with the keys of their folders. ``where``, a condition on
    these keys, decides which files are opened."""
    keys = PROJECT if kind == CONTRACTS else CYCLE_KEYS
    return read_folder(spark, f"{root.rstrip('/')}/{kind}", {k: "int" if k == "cycle_no" else "string" for k in keys}, where)


def _headers(grid: DataFrame, kind: str) -> DataFrame:
    if kind == CONTRACTS:
        return claim_columns(first_row_headers(grid), CONTRACT_WORDS, prefixes=True)
    if kind == TALLIES:
        return match_columns(find_headers(grid, TALLY_WORDS, fall_back=True), TALLY_WORDS)
    return match_columns(first_row_headers(grid), INVOICE_WORDS)


def _missing(kind: str) -> Column:
    """The needed columns that a header lacks, as text; empty where it has all."""
    lacks = F.array(*[F.when(F.col(f"at_{c}").isNull(), F.lit(c)) for c in NEEDED[kind]])
    return F.array_join(F.array_compact(lacks), ", ")


def rejects(grid: DataFrame, kind: str, lines: DataFrame | None = None) -> DataFrame:
    """Sheets that cannot be read as their kind, with the reason; given the ``lines`` that were
    read, also those that have all columns but no line."""
    keys = [k for k in CYCLE_KEYS if k in grid.columns]
    whose = grid.groupBy(*TABLE).agg(*[F.min(k).alias(k) for k in keys])
    headers = _headers(grid, kind).select(*TABLE, _missing(kind).alias("lacks"))
    told = whose.join(headers, list(TABLE), "left")
    reason = F.when(F.col("lacks").isNull(), "no header").when(F.col("lacks") != "", F.concat(F.lit("no column for "), F.col("lacks")))
    if lines is not None:
        some = lines.select("file").distinct().withColumn("__some", F.lit(True))
        told = told.join(some, "file", "left")
        reason = F.coalesce(reason, F.when(F.col("__some").isNull(), "no lines"))
    bad = told.withColumn("reason", reason).filter("reason is not null")
    given = [F.col(k) if k in keys else F.lit(None).cast("int" if k == "cycle_no" else "string").alias(k) for k in CYCLE_KEYS]
    return bad.select(F.lit(kind).alias("kind"), *given, "file", "reason")


def contract_lines(grid: DataFrame) -> DataFrame:
    """Items of all bid schedules that can be read; of a project's sheets in order of their names."""
    headers = _headers(grid, CONTRACTS).filter(_missing(CONTRACTS) == "")
    body = feeds.body(grid, headers)
    cells = body.select(*PROJECT, "file", F.struct("file", F.col("row_no").cast("bigint").alias("row")).alias("line_no"), *[feeds.cell(F.col(f"at_{r}")).alias(r) for r in CONTRACT_WORDS])
    return contract_items(cells, [*PROJECT, "file"])


def _ordered(lines: DataFrame) -> DataFrame:
    """Lines of several files in one order: by file, then by row."""
    file = F.when(F.col("file") != "", F.col("file"))  # so that both feeds may lack it, and their orders are of one type
    return lines.withColumn("line_no", F.struct(file.alias("file"), F.col("line_no").cast("bigint").alias("row")))


def cycle_feeds(spark: SparkSession, root: str, where: str | None = None, cumulative: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(contract, as-built lines, invoice lines, rejected sheets) of the cycles below a folder."""
    grids = {kind: sheets(spark, root, kind, None if kind == CONTRACTS else where) for kind in NEEDED}
    contract = contract_lines(grids[CONTRACTS])
    built = feeds.tally_lines(grids[TALLIES], strict=False)
    billed = feeds.tabular_invoices(grids[INVOICES], strict=False, cumulative=cumulative)
    bad = rejects(grids[CONTRACTS], CONTRACTS, contract).unionByName(rejects(grids[TALLIES], TALLIES)).unionByName(rejects(grids[INVOICES], INVOICES))
    once = feeds.dedupe_invoices(billed, CYCLE_KEYS)
    return contract.drop("file"), _ordered(built), _ordered(once), bad


def reconcile_sheets(
    spark: SparkSession,
    root: str,
    *,
    where: str | None = None,
    aliases: DataFrame | None = None,
    decisions: DataFrame | None = None,
    prior: DataFrame | None = None,
    rules: Rules = Rules(),
    matching: Matching = Matching(),
    keys: Sequence[str] = CYCLE_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(reconciled rows of all cycles below a folder, rejected sheets)."""
    contract, built, billed, bad = cycle_feeds(spark, root, where, cumulative=rules.billing_mode == "cumulative")
    rows = reconcile_described(built, billed, contract, aliases=aliases, decisions=decisions, keys=keys, rules=rules, matching=matching, prior=prior)
    return rows, bad
