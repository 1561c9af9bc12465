"""Sheets to typed lines: bid schedules, tallies, invoices; grouping and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.numbers import GRID_MARKS, INVOICE_MARKS, TALLY_MARKS, derive_amount, derive_price, exact_sum, number_text, read_number
from tallyline.functions.text import blank_to_null, file_name, file_stem, normalize, parse_uom, strip
from tallyline.operators.contract import contract_items
from tallyline.operators.header import (
    CONTRACT_WORDS, GRID_WORDS, INVOICE_WORDS, TABLE, TALLY_WORDS, cell, claim_columns, find_headers, first_row_headers,
    match_columns, once, require_columns, with_columns,
)
from tallyline.operators.rollup import joined_in_parts

# Descriptions that head totals, per kind of sheet.
TALLY_TOTALS = ("total", "subtotal", "sum", "grand total")
INVOICE_TOTALS = ("total", "subtotal", "sum")
GRID_TOTALS = ("total", "subtotal", "sum", "grand total")


def body(grid: DataFrame, headers: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Rows below the header beside the column positions of their table."""
    positions = headers.drop("header")
    return grid.join(positions, list(keys)).filter(F.col("row_no") > F.col("header_row"))


def _in_tables(grid: DataFrame) -> DataFrame:
    """Rows without a table meet no header. Said before the search, it is the same for all readers
    of the grid, so that Spark shuffles it and searches it once."""
    for k in TABLE:
        grid = grid.filter(F.col(k).isNotNull())
    return grid


def _extra(grid: DataFrame) -> list[str]:
    return [c for c in grid.columns if c not in (*TABLE, "row_no", "cells")]


# --- bid schedules -----------------------------------------------------------
def bid_schedule(grid: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Contract items of bid-schedule sheets (header in the first row). A sheet without
    code, description and price columns, or without any item, is an error."""
    claimed, needed = claim_columns(first_row_headers(grid), CONTRACT_WORDS, prefixes=True), ("code", "description", "unit_price")
    headers = require_columns(claimed, needed, "Bid schedule")
    cells = body(grid, headers).select(
        *scope, "file", F.col("row_no").cast("bigint").alias("line_no"), *[cell(F.col(f"at_{r}")).alias(r) for r in CONTRACT_WORDS]
    )
    items = contract_items(cells, [*scope, "file"])
    # A sheet without items meets the items as a row that fails when it is read.
    none = with_columns(claimed, needed).select("file").distinct().join(items.select(F.col("file").alias("__with")).distinct(), F.col("file") == F.col("__with"), "left_anti")
    fails = F.raise_error(F.concat(F.lit("Bid schedule parsed to zero items: "), F.col("file")))
    failing = none.select("file", *[fails.cast(items.schema[c].dataType).alias(c) for c in items.columns if c != "file"])
    return items.unionByName(failing)


# --- tallies -----------------------------------------------------------------
def tally_lines(grid: DataFrame, *, strict: bool = True) -> DataFrame:
    """As-built lines of tally sheets, ungrouped."""
    grid = _in_tables(grid)
    headers = match_columns(find_headers(grid, TALLY_WORDS, fall_back=True), TALLY_WORDS)
    needed = ("desc", "qty")
    headers = require_columns(headers, needed, "Tally sheet") if strict else with_columns(headers, needed)
    texts = once(
        body(grid, headers),
        [strip(cell(F.col(f"at_{r}"))).alias(r) for r in ("desc", "uom", "segment")] + [number_text(cell(F.col("at_qty")), TALLY_MARKS).alias("qty_text")],
    )
    read = once(
        texts,
        [
            F.nullif("desc", F.lit("")).alias("raw_desc"),
            read_number(F.col("qty_text")).alias("qty"),
            parse_uom(F.col("uom")).alias("unit"),
        ],
    ).select(
        *_extra(grid), *TABLE, F.col("row_no").cast("bigint").alias("line_no"), "raw_desc", "qty", F.col("unit").alias("uom"),
        F.nullif("segment", F.lit("")).alias("segment"),
    )
    kept = read.filter(F.col("raw_desc").isNotNull() & F.col("qty").isNotNull() & ~F.lower("raw_desc").isin(*TALLY_TOTALS))
    return kept.select(
        *kept.columns,
        F.lit(None).cast("string").alias("code"),
        file_name(F.col("file")).alias("source_file"),
        F.concat(F.lit("row "), F.col("line_no") + 1).alias("source_ref"),
        F.lit("sum").alias("confidence"),
    )


def group_tally(lines: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Lines of one sheet that say the same, added up under the first wording.

    The rows they came from and their segments are listed by :func:`tally_references`
    and :func:`tally_segments`: texts of unknown length are not built in a row here.
    """
    return (
        lines.groupBy(*keys, normalize(F.col("raw_desc")).alias("text_key"))
        .agg(
            F.min(F.struct("line_no", "raw_desc")).alias("first"),
            exact_sum(F.col("qty")).alias("qty"),
            F.min(F.when(F.col("uom").isNotNull(), F.struct("line_no", "uom"))).alias("unit"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        .select(
            *keys,
            "text_key",
            F.col("first.line_no").alias("line_no"),
            F.col("first.raw_desc").alias("raw_desc"),
            "qty",
            F.col("unit.uom").alias("uom"),
            F.lit(None).cast("string").alias("code"),
            F.lit("sum").alias("confidence"),
            "n_lines",
        )
    )


def tally_references(lines: DataFrame, keys: Sequence[str] = TABLE, part_lines: int = 10_000) -> DataFrame:
    """``row 2; row 7; …`` per group, in parts of bounded length."""
    keyed = lines.withColumn("text_key", normalize(F.col("raw_desc")))
    return joined_in_parts(keyed, [*keys, "text_key"], "source_ref", "line_no", "; ", part_lines)


def tally_segments(lines: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Each distinct segment of a group, in one row per segment."""
    return lines.filter("segment is not null").select(*keys, normalize(F.col("raw_desc")).alias("text_key"), "segment").distinct()


def tally_segment_text(segments: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """``A, B, …`` per group: one short text per sheet group, from distinct segments."""
    return segments.groupBy(*keys, "text_key").agg(F.array_join(F.array_sort(F.collect_set("segment")), ", ").alias("segment"))


# --- invoices ----------------------------------------------------------------
def _invoice_lines(read: DataFrame, totals: Sequence[str], fallback: Column, line_ref: Column, cumulative: bool) -> DataFrame:
    kept = read.filter(F.col("raw_desc").isNotNull() & F.col("qty").isNotNull() & ~F.lower("raw_desc").isin(*totals))
    priced = kept.withColumn("price", derive_price(F.col("qty"), F.col("price"), F.col("amount"))).withColumn(
        "amount", derive_amount(F.col("qty"), F.col("price"), F.col("amount"))
    )
    spare = [c for c in read.columns if c not in ("raw_desc", "qty", "price", "amount", "invoice", "period")]
    return priced.select(
        *spare,
        F.coalesce("invoice", fallback).alias("invoice_id"),
        "raw_desc",
        "qty",
        F.coalesce("price", F.lit(0.0)).alias("unit_price"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        "period",
        F.lit(cumulative).alias("is_cumulative"),
        F.lit(None).cast("string").alias("code"),
        file_name(F.col("file")).alias("source_file"),
        line_ref.alias("line_ref"),
    )


def tabular_invoices(grid: DataFrame, *, strict: bool = True, cumulative: bool = True) -> DataFrame:
    """Lines of plain invoice files, whose first row is the header."""
    headers = match_columns(first_row_headers(grid), INVOICE_WORDS)
    needed = ("desc", "qty")
    headers = require_columns(headers, needed, "Invoice") if strict else with_columns(headers, needed)
    read = _read_invoice(body(grid, headers), _extra(grid), INVOICE_MARKS)
    return _invoice_lines(
        read, INVOICE_TOTALS, file_stem(file_name(F.col("file"))), F.concat(F.lit("line "), F.col("line_no")), cumulative
    )


def _read_invoice(below: DataFrame, extra: Sequence[str], marks: str, prefix: str = "at_", breaks: bool = False) -> DataFrame:
    def at(role: str) -> Column:
        return cell(F.col(f"{prefix}{role}"))

    words, figures = ("desc", "invoice", "period"), ("qty", "price", "amount")
    texts = once(
        below,
        [(_tidy(at(r)) if breaks else strip(at(r))).alias(f"{r}_text") for r in words] + [number_text(at(r), marks).alias(f"{r}_text") for r in figures],
    )
    read = once(
        texts,
        [F.nullif(f"{r}_text", F.lit("")).alias("raw_desc" if r == "desc" else r) for r in words] + [read_number(F.col(f"{r}_text")).alias(r) for r in figures],
    )
    return read.select(*extra, *TABLE, F.col("row_no").cast("bigint").alias("line_no"), "raw_desc", "qty", "price", "amount", "invoice", "period")


def _tidy(c: Column) -> Column:
    """A cell of an extracted table: line breaks inside it are spaces."""
    return F.replace(strip(c), F.lit("\n"), F.lit(" "))


def clean_cells(grid: DataFrame, cells: str = "cells") -> DataFrame:
    """Cells of extracted tables: null is empty, line breaks are spaces."""
    return grid.withColumn(cells, F.transform(cells, lambda c: _tidy(F.coalesce(c, F.lit("")))))


def extracted_invoices(
    grid: DataFrame, *, profiles: DataFrame | None = None, contractor: str = "contractor_id", cumulative: bool = True
) -> DataFrame:
    """Lines of tables that were extracted from documents.

    A table whose contractor saved a profile is read by it; a profile without
    description and quantity columns yields nothing. All others are detected.
    """
    grid = _in_tables(grid)
    detected, given = grid, None
    if profiles is not None:
        saved = profiles.select(
            F.col("contractor").alias(contractor),
            F.coalesce("header_row", F.lit(0)).alias("header_row"),
            *[F.try_element_at("columns", F.lit(r)).alias(f"at_{r}") for r in GRID_WORDS],
        )
        # One row per contractor, written by hand: sent to the rows, which then need no search.
        given = grid.join(F.broadcast(with_columns(saved, ("desc", "qty"))), contractor).filter(F.col("row_no") > F.col("header_row"))
        detected = grid.join(F.broadcast(saved.select(contractor)), contractor, "left_anti")
    headers = claim_columns(clean_cells(find_headers(detected, breaks=True), "header"), GRID_WORDS)
    below = body(detected, with_columns(headers, ("desc", "qty")))
    if given is not None:
        below = below.unionByName(given)
    read = _read_invoice(below, _extra(grid), GRID_MARKS, breaks=True)
    ref = F.concat(F.lit("page "), F.col("page"), F.lit(" table "), F.col("table_no"), F.lit(" row "), F.col("line_no") + 1)
    return _invoice_lines(read, GRID_TOTALS, file_stem(file_name(F.col("file"))), ref, cumulative)


def dedupe_invoices(lines: DataFrame, scope: Sequence[str] = (), order: Sequence[str] = ("file", "page", "table_no", "line_no")) -> DataFrame:
    """Lines that repeat invoice, text, quantity and price (a file loaded twice) once.

    A minimum per group keeps the first one; Spark takes it before the shuffle as well,
    so any number of copies of a line costs one row per task.
    """
    key = ["invoice_id", "raw_desc", "qty", "unit_price"]
    rest = [c for c in lines.columns if c not in (*scope, *key)]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return lines.groupBy(*scope, *key).agg(first).select(*scope, *key, "first.*")


def invoice_batch(direct: DataFrame | None, members: DataFrame | None, scope: Sequence[str] = (), cumulative: bool = True) -> DataFrame:
    """Directly given files must be invoices; archive members that are not are skipped."""
    parts = []
    if direct is not None:
        parts.append(tabular_invoices(direct, strict=True, cumulative=cumulative))
    if members is not None:
        parts.append(tabular_invoices(members, strict=False, cumulative=cumulative))
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return dedupe_invoices(lines, scope)


def source_files(lines: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The files lines came from, with their line counts and first line."""
    return (
        lines.filter("coalesce(source_file, '') <> ''")
        .groupBy(*scope, "source_file")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))
    )


# --- manual edits ------------------------------------------------------------
def edited_asbuilt(edits: DataFrame, *, confirm: bool = True) -> DataFrame:
    """As-built lines from an edit grid: blank descriptions go, a blank code is none,
    confirming marks every line as confirmed."""
    desc = strip(F.coalesce(F.col("raw_desc"), F.lit("")))
    kept = edits.filter((desc != "") & (F.lower(desc) != "nan"))
    return (
        kept.withColumn("raw_desc", desc.alias("raw_desc"))
        .withColumn("qty", F.coalesce(F.col("qty").cast("double"), F.lit(0.0)))
        .withColumn("uom", parse_uom(F.col("uom")))
        .withColumn("code", blank_to_null(F.col("code")))
        .withColumn("confidence", F.lit("confirmed") if confirm else F.col("confidence"))
    )


def mappings_from_lines(lines: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Coded lines settle the crosswalk for their description; the last line counts."""
    return (
        lines.filter("code is not null")
        .groupBy(*scope, "raw_desc")
        .agg(F.max_by("code", "line_no").alias("mapped_code"))
        .withColumn("not_in_contract", F.lit(False))
    )
