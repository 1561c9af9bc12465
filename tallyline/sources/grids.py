"""Delimited files as rows of cells, with row numbers that survive splitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_COLUMNS = 64
# The cell texts that table readers take as missing, and the suffixes read.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SEPARATORS = {".csv": ",", ".tsv": "\t"}


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[name.rfind("."):].lower() if "." in name else ""


def read_grid(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    separator: str | None = None,
    multi_line: bool = False,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """``grid`` of csv or tsv files or folders. The separator follows the suffix unless
    given. Large files are split; ``multi_line`` allows line breaks in quoted cells at
    the price of one task per file. A row wider than ``max_columns`` fails the job
    rather than lose cells.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if separator is not None:
        return _read(spark, paths, separator, multi_line, max_columns)
    grids = None
    for suffix, sep in SEPARATORS.items():
        mine = [p for p in paths if _suffix(p) == suffix]
        if mine:
            one = _read(spark, mine, sep, multi_line, max_columns)
            grids = one if grids is None else grids.unionByName(one)
    unknown = [p for p in paths if _suffix(p) not in SEPARATORS]
    if unknown:
        raise ValueError(f"not a csv or tsv file: {unknown}")
    return grids


def read_folder(spark: SparkSession, folder: str, keys: Mapping[str, str], where: str | None = None, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """``grid`` of all csv and tsv files below a folder whose subfolders are named
    ``key=value``; the keys (name to type) are columns. ``where``, a condition on them, leaves
    out folders before any file is opened."""
    both = [_read(spark, [folder], sep, False, max_columns, keys, suffix, where) for suffix, sep in SEPARATORS.items()]
    return both[0].unionByName(both[1])


def _read(
    spark: SparkSession, paths: list[str], separator: str, multi_line: bool, width: int,
    keys: Mapping[str, str] | None = None, suffix: str | None = None, where: str | None = None,
) -> DataFrame:
    columns = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{c} string" for c in columns) + ", too_wide string" + "".join(f", {k} {kind}" for k, kind in (keys or {}).items())
    reader = spark.read if suffix is None else spark.read.option("pathGlobFilter", f"*{suffix}")
    raw = (
        reader.schema(schema)
        .option("columnNameOfCorruptRecord", "__corrupt")
        .option("sep", separator)
        .option("header", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxColumns", width + 16)
        .csv(paths)
    )
    cells = F.array(*[F.when(~F.coalesce(F.col(c), F.lit("")).isin(*MISSING), F.col(c)) for c in columns])
    checked = F.when(F.col("too_wide").isNotNull(), F.raise_error(F.lit(f"row with more than {width} cells"))).otherwise(cells)
    if where is not None:
        raw = raw.filter(where)
    rows = raw.select(
        *(keys or {}),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        checked.alias("cells"),
    )
    return number_rows(rows)


def number_rows(rows: DataFrame) -> DataFrame:
    """Row numbers per file from the row ids of its splits: a split starts where the
    splits before it end. Only one row per split is ever sorted."""
    splits = rows.groupBy("file", "block").agg(F.min("row_id").alias("first_id"), F.count("cells").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    width = F.size(F.col("cells"))
    last = F.array_max(F.transform(F.sequence(F.lit(1), width), lambda i: F.when(F.element_at("cells", i).isNotNull(), i).otherwise(0)))
    keys = [c for c in rows.columns if c not in ("file", "block", "row_id", "cells")]
    return rows.join(offsets, ["file", "block"]).select(
        *keys,
        "file",
        F.lit(1).alias("page"),
        F.lit(1).alias("table_no"),
        (F.col("offset") + F.col("row_id") - F.col("first_id")).cast("int").alias("row_no"),
        F.slice("cells", F.lit(1), last).alias("cells"),
    )
