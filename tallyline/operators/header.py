"""Where the header of a sheet is and which column plays which role.

Sheets arrive as rows of cells, ``grid(file, page, table_no, row_no, cells)``. The
search is a minimum over the rows of each table, which Spark combines before the shuffle;
it ends in one row per table, and the rules run on arrays of header cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import strip

TABLE = ("file", "page", "table_no")

# The header words of each kind of sheet, and the order of the roles.
CONTRACT_WORDS = {
    "code": ("code", "item", "bid item", "item no", "item #", "ref"),
    "description": ("description", "desc", "unit description", "work item", "item description"),
    "uom": ("uom", "unit of measure", "u/m", "units", "measure", "unit"),
    "unit_price": ("unit price", "price", "rate", "unit cost", "cost"),
    "est_qty": ("est qty", "estimated qty", "estimated quantity", "est quantity", "qty", "quantity", "bid qty", "est. qty"),
}
TALLY_WORDS = {
    "desc": ("description", "desc", "unit", "item", "work"),
    "qty": ("qty", "quantity", "count", "total", "built"),
    "uom": ("uom", "unit of measure", "u/m", "measure"),
    "segment": ("segment", "seg", "route", "span", "sheet", "area"),
}
INVOICE_WORDS = {
    "desc": ("description", "desc", "unit", "item", "work"),
    "qty": ("qty", "quantity", "count", "units"),
    "price": ("unit price", "price", "rate", "unit cost"),
    "amount": ("amount", "extended", "total", "ext price", "line total"),
    "invoice": ("invoice", "invoice #", "invoice no", "inv", "invoice id"),
    "period": ("period", "date", "billing period", "pay app", "cycle"),
}
GRID_WORDS = {
    "amount": ("amount", "extended", "line total", "ext price", "total"),
    "price": ("unit price", "price", "rate", "unit cost"),
    "qty": ("qty", "quantity", "count", "units"),
    "invoice": ("invoice", "invoice #", "invoice no", "inv"),
    "period": ("period", "date", "billing period", "pay app", "cycle"),
    "desc": ("description", "desc", "item", "work", "unit"),
}


def _equals(words: Sequence[str]):
    return lambda c: c.isin(*words)


def _contains(words: Sequence[str]):
    def test(c: Column) -> Column:
        hit = c.contains(words[0])
        for w in words[1:]:
            hit = hit | c.contains(w)
        return hit

    return test


def _starts(words: Sequence[str]):
    def test(c: Column) -> Column:
        hit = c.startswith(words[0])
        for w in words[1:]:
            hit = hit | c.startswith(w)
        return hit

    return test


def header_cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))


def header_text(cells: Column, *, breaks: bool = False) -> Column:
    """A row as one text to search, with a mark between cells that no word contains. With
    ``breaks`` a line break inside a cell reads as a space."""
    text = F.lower(F.array_join(cells, "\u0001"))
    return F.replace(text, F.lit("\n"), F.lit(" ")) if breaks else text


def looks_like_header(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """Some cell has a word for the description and some cell one for the quantity."""
    return _contains(words["desc"])(text) & _contains(words["qty"])(text)


def find_headers(
    grid: DataFrame,
    words: Mapping[str, Sequence[str]] = GRID_WORDS,
    *,
    fall_back: bool = False,
    rows: int | None = None,
    keys: Sequence[str] = TABLE,
    breaks: bool = False,
) -> DataFrame:
    """One row per table: header_row and its cells. Without a hit the table is left out
    (see ``without_header``), or, with ``fall_back``, its first row is taken. All rows are
    searched; ``rows`` narrows that to the first so many. ``breaks``: line breaks inside
    cells read as spaces."""
    searched = grid if rows is None else grid.filter(F.col("row_no") < rows)
    searched = once(searched, [header_text(F.col("cells"), breaks=breaks).alias("text")])
    hit = looks_like_header(F.col("text"), words)
    if fall_back:  # one minimum: a hit comes before any other row
        pick = F.struct((~F.coalesce(hit, F.lit(False))).alias("other"), "row_no", "cells")
    else:  # only rows that read like a header are grouped, not whole sheets
        searched, pick = searched.filter(hit), F.struct("row_no", "cells")
    found = searched.groupBy(*keys).agg(F.min(pick).alias("pick"))
    return found.select(*keys, F.col("pick.row_no").alias("header_row"), F.col("pick.cells").alias("header"))


def without_header(
    grid: DataFrame, words: Mapping[str, Sequence[str]] = GRID_WORDS, *, rows: int | None = None, keys: Sequence[str] = TABLE
) -> DataFrame:
    """The tables in which no row reads like a header, with their number of rows."""
    hit = looks_like_header(F.col("text"), words)
    if rows is not None:
        hit = hit & (F.col("row_no") < rows)
    counted = once(grid, [header_text(F.col("cells")).alias("text")]).groupBy(*keys).agg(F.max(hit).alias("hit"), F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(~F.coalesce("hit", F.lit(False))).drop("hit")


def first_row_headers(grid: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Files whose first row is the header by definition."""
    return grid.filter("row_no = 0").select(*keys, F.lit(0).alias("header_row"), F.col("cells").alias("header"))


def once(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """More columns, each computed once per row. As plain columns, Spark would write what they
    stand for into every filter and column that uses them and compute it there again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def _first(flags: Column) -> Column:
    return F.nullif(F.array_position(flags, F.lit(True)).cast("int"), F.lit(0)) - 1


def match_columns(headers: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """Column of each role, equal word before contained word; roles may share a column."""
    at = []
    for role, listed in words.items():
        exact, loose = F.transform("low", _equals(listed)), F.transform("low", _contains(listed))
        at.append(F.coalesce(_first(exact), _first(loose)).alias(f"at_{role}"))
    return by_shape(headers, lambda shapes: once(shapes, at))


def claim_columns(headers: DataFrame, words: Mapping[str, Sequence[str]], *, prefixes: bool = False) -> DataFrame:
    """Column of each role when a column may serve only one. Roles claim in the order of
    ``words``: an equal word first, then (with ``prefixes``) one that starts the header,
    then one contained in it; among columns the leftmost free one."""
    tests = [_equals, _starts, _contains] if prefixes else [_equals, _contains]

    def wanted(listed: Sequence[str]) -> Column:
        """Column numbers a role would take, best first."""

        def places(test) -> Column:
            return F.transform("low", lambda c, i: F.when(test(c), i))

        return F.array_compact(F.concat(*[places(t(listed)) for t in tests]))

    def claim(taken: Column, choice: Column) -> Column:
        free = F.array_except(choice, taken)
        return F.array_append(taken, F.coalesce(F.try_element_at(free, F.lit(1)), F.lit(-1)))

    # One fold over the roles: what earlier roles took is the running state.
    choices = F.array(*[wanted(listed) for listed in words.values()])
    picks = F.aggregate(choices, F.array().cast("array<int>"), claim)
    at = [F.nullif(F.element_at("picks", n + 1), F.lit(-1)).alias(f"at_{role}") for n, role in enumerate(words)]
    return by_shape(headers, lambda shapes: once(shapes, [picks.alias("picks")]).select("low", *at))


def by_shape(headers: DataFrame, read) -> DataFrame:
    """Columns that depend on the texts of a header alone: each distinct header is read once and
    joined back (Spark broadcasts the headers read only if they turn out few)."""
    marked = headers.withColumn("low", header_cells(F.col("header")))
    shapes = read(marked.select("low").distinct()).withColumnRenamed("low", "__low")
    return marked.join(shapes, F.col("low") == F.col("__low")).drop("low", "__low")


def suggested_profile(grid: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Header row and column map to pre-fill a template; row 0 and no columns where
    nothing can be detected."""
    found = claim_columns(find_headers(grid, keys=keys), GRID_WORDS)
    roles = F.map_filter(F.create_map(*[x for r in GRID_WORDS for x in (F.lit(r), F.col(f"at_{r}"))]), lambda k, v: v.isNotNull())
    known = found.select(*keys, "header_row", roles.alias("columns"))
    return (
        grid.select(*keys)
        .distinct()
        .join(known, list(keys), "left")
        .select(*keys, F.coalesce("header_row", F.lit(0)).alias("header_row"), F.coalesce("columns", F.create_map().cast("map<string,int>")).alias("columns"))
    )


def require_columns(headers: DataFrame, roles: Sequence[str], what: str) -> DataFrame:
    """Fail with the name of a sheet that lacks one of the roles, when the sheet is read."""
    missing = None
    for r in roles:
        gap = F.col(f"at_{r}").isNull()
        missing = gap if missing is None else missing | gap
    text = F.concat(
        F.lit(f"{what}: columns {list(roles)} not all found in "), F.col("file"), F.lit(" ["),
        F.array_join("header", ", ", "null"), F.lit("]"),
    )
    return headers.withColumns({f"at_{r}": F.when(missing, F.raise_error(text).cast("int")).otherwise(F.col(f"at_{r}")) for r in roles})


def with_columns(headers: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Keep the sheets that have all of the roles."""
    for r in roles:
        headers = headers.filter(F.col(f"at_{r}").isNotNull())
    return headers


def cell(index: Column, cells: str = "cells") -> Column:
    """The cell at a 0-based index, null when the row is too short or has no such role."""
    return F.try_element_at(F.col(cells), index + 1)
