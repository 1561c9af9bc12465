"""Zip archives of invoice files, expanded where Spark reads them: one task per archive."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources.grids import MISSING, SEPARATORS

_ROWS = 5_000


def read_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """``grid`` of the delimited members of all archives. Folders are skipped, inner
    paths dropped (the name is kept), other kinds of files left out. ``file`` is
    ``archive!/member number/name``, so equal names stay apart."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    members = raw.select("path", "content").mapInPandas(
        _expand, "file string, page int, table_no int, row_no int, cells array<string>"
    )
    gaps = F.transform("cells", lambda c: F.when(~c.isin(*MISSING), c))
    return members.withColumn("cells", gaps)


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for number, info in enumerate(archive.infolist()):
                    name = info.filename.rsplit("/", 1)[-1]
                    suffix = name[name.rfind("."):].lower() if "." in name else ""
                    if info.is_dir() or suffix not in SEPARATORS:
                        continue
                    with archive.open(info) as member:
                        yield from _rows(f"{path}!/{number}/{name}", member, SEPARATORS[suffix])


def _rows(file: str, member, separator: str) -> Iterator[pd.DataFrame]:
    text = io.TextIOWrapper(member, encoding="utf-8-sig", errors="replace", newline="")
    out: list[tuple] = []
    row_no = 0
    for cells in csv.reader(text, delimiter=separator):
        if not cells or cells == [""]:
            continue
        out.append((file, 1, 1, row_no, cells))
        row_no += 1
        if len(out) == _ROWS:
            yield _frame(out)
            out = []
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "page", "table_no", "row_no", "cells"])
