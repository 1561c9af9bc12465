"""Queries over sheets: header discovery, typed lines, grouping, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import feeds, header
from tallyline.plans import star
from tallyline.plans.checks import query, sql

ORDERED = """
ordered AS (SELECT l.*, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n,
    count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem l JOIN part ON l_partkey = p_partkey)"""

_LAYOUT = """CASE l_orderkey % 5 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} WHEN 3 THEN {d} ELSE {e} END"""


@query(
    "header_discovery",
    f"""WITH keys AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT 'inv_' || CAST(l_orderkey AS VARCHAR) || '.pdf' AS file, CAST(l_orderkey % 3 + 1 AS INTEGER) AS header_row,
  {_LAYOUT.format(a=4, b='NULL', c=0, d=3, e='NULL')} AS at_amount, {_LAYOUT.format(a=3, b=2, c='NULL', d=0, e='NULL')} AS at_price,
  {_LAYOUT.format(a=2, b=1, c=2, d=2, e='NULL')} AS at_qty, {_LAYOUT.format(a=0, b='NULL', c='NULL', d='NULL', e='NULL')} AS at_invoice,
  {_LAYOUT.format(a=5, b='NULL', c='NULL', d='NULL', e='NULL')} AS at_period, {_LAYOUT.format(a=1, b=0, c=1, d=1, e='NULL')} AS at_desc
FROM keys WHERE l_orderkey % 5 <> 4""",
)
def header_discovery(spark, sf_dir):
    found = header.claim_columns(header.find_headers(star.invoice_grid(spark, sf_dir)), header.GRID_WORDS)
    return found.drop("page", "table_no", "header")


@query(
    "suggested_profile",
    """SELECT 'inv_' || CAST(l_orderkey AS VARCHAR) || '.pdf' AS file, CAST(CASE WHEN l_orderkey % 5 = 4 THEN 0 ELSE l_orderkey % 3 + 1 END AS INTEGER) AS header_row,
  CAST(CASE l_orderkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS INTEGER) AS n_columns FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
)
def suggested_profile(spark, sf_dir):
    return header.suggested_profile(star.invoice_grid(spark, sf_dir)).select("file", "header_row", F.size("columns").alias("n_columns"))


@query(
    "contract_columns",
    """SELECT 'rates_' || replace(p_brand, '#', '') || '.csv' AS file,
  CASE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS at_code,
  CASE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS at_description,
  CASE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS at_uom,
  CASE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 3 END AS at_unit_price,
  CASE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 4 WHEN 1 THEN 4 ELSE NULL END AS at_est_qty
FROM (SELECT DISTINCT p_brand FROM part)""",
)
def contract_columns(spark, sf_dir):
    heads = header.first_row_headers(star.contract_grid(spark, sf_dir))
    return header.claim_columns(heads, header.CONTRACT_WORDS, prefixes=True).drop("page", "table_no", "header", "header_row")


@query(
    "bid_schedule",
    f"""WITH {sql.CONTRACT} SELECT code, description, uom, round(unit_price, 2) AS unit_price,
  CASE WHEN CAST(regexp_extract(code, '#(\\d+)\\.', 1) AS INTEGER) % 3 = 2 THEN 0.0 ELSE est_qty END AS est_qty FROM contract""",
)
def bid_schedule(spark, sf_dir):
    items = feeds.bid_schedule(star.contract_grid(spark, sf_dir))
    return items.select("code", "description", "uom", F.round("unit_price", 2).alias("unit_price"), "est_qty")


_LINES = """SELECT 'inv_' || CAST(l_orderkey AS VARCHAR) || '.pdf' AS source_file,
  CASE WHEN l_orderkey % 5 = 0 THEN 'INV-' ELSE 'inv_' END || CAST(l_orderkey AS VARCHAR) AS invoice_id, p_name AS raw_desc, l_quantity AS qty,
  round(l_extendedprice / l_quantity, 8) AS unit_price, round(l_extendedprice, 2) AS amount,
  CASE WHEN l_orderkey % 5 = 0 THEN '2025-06' END AS period,
  'page 1 table 1 row ' || CAST(l_orderkey % 3 + 2 + n AS VARCHAR) AS line_ref FROM ordered"""


def _shown(lines):
    return lines.select(
        "source_file", "invoice_id", "raw_desc", "qty", F.round("unit_price", 8).alias("unit_price"), F.round("amount", 2).alias("amount"), "period", "line_ref"
    )


@query("extracted_invoices", f"WITH {ORDERED} {_LINES} WHERE l_orderkey % 5 <> 4")
def extracted_invoices(spark, sf_dir):
    return _shown(feeds.extracted_invoices(star.invoice_grid(spark, sf_dir)))


@query(
    "template_projection",
    f"WITH {ORDERED} {_LINES} WHERE l_orderkey % 5 <> 3",
)
def template_projection(spark, sf_dir):
    """Contractors with a saved profile are read by it; an invalid one yields nothing."""
    grid = star.invoice_grid(spark, sf_dir)
    lines = feeds.extracted_invoices(grid, profiles=star.saved_profiles(spark, sf_dir))
    return _shown(lines)


@query(
    "invoice_dedupe",
    """SELECT invoice_id, raw_desc, qty, unit_price, CAST(min(copy) AS INTEGER) AS first_copy FROM (
  SELECT 'INV-' || CAST(l_orderkey % 97 AS VARCHAR) AS invoice_id, p_name AS raw_desc, l_quantity AS qty, p_size * 1.0 AS unit_price, l_linenumber AS copy
  FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL""",
)
def invoice_dedupe(spark, sf_dir):
    lines = star.order_lines(spark, sf_dir).select(
        F.concat(F.lit("INV-"), (F.col("l_orderkey") % 97).cast("string")).alias("invoice_id"),
        F.col("p_name").alias("raw_desc"),
        F.col("l_quantity").alias("qty"),
        F.col("p_size").cast("double").alias("unit_price"),
        F.col("l_linenumber").alias("first_copy"),
    )
    return feeds.dedupe_invoices(lines, order=("first_copy",))


_TALLY = f"""WITH {ORDERED}, tally AS (SELECT 'tally_' || CAST(l_orderkey AS VARCHAR) || '.csv' AS source_file, p_name AS text_key,
    CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name || '.' END AS raw_desc, l_quantity AS qty,
    CASE l_linenumber % 4 WHEN 0 THEN 'FT' WHEN 1 THEN 'EA' END AS uom,
    CASE WHEN l_orderkey % 2 = 0 THEN 'S' || CAST(l_suppkey % 3 AS VARCHAR) END AS segment, l_orderkey % 3 + 1 + n AS line_no FROM ordered)"""


@query("tally_lines", _TALLY + "SELECT source_file, raw_desc, qty, uom, segment, 'row ' || CAST(line_no + 1 AS VARCHAR) AS source_ref FROM tally")
def tally_lines(spark, sf_dir):
    lines = feeds.tally_lines(star.tally_grid(spark, sf_dir))
    return lines.select("source_file", "raw_desc", "qty", "uom", "segment", "source_ref")


@query(
    "tally_group",
    _TALLY + """SELECT source_file, text_key, arg_min(raw_desc, line_no) AS raw_desc, CAST(sum(CAST(qty AS DECIMAL(18,4))) AS DOUBLE) AS qty,
  arg_min(uom, line_no) FILTER (uom IS NOT NULL) AS uom, count(*) AS n_lines FROM tally GROUP BY source_file, text_key""",
)
def tally_group(spark, sf_dir):
    out = feeds.group_tally(feeds.tally_lines(star.tally_grid(spark, sf_dir)))
    return out.select(F.col("file").alias("source_file"), "text_key", "raw_desc", "qty", "uom", "n_lines")


@query(
    "tally_references",
    _TALLY + """SELECT source_file, text_key, CAST(0 AS BIGINT) AS part_no, string_agg('row ' || CAST(line_no + 1 AS VARCHAR), '; ' ORDER BY line_no) AS source_ref
  FROM tally GROUP BY source_file, text_key""",
)
def tally_references(spark, sf_dir):
    out = feeds.tally_references(feeds.tally_lines(star.tally_grid(spark, sf_dir)))
    return out.select(F.col("file").alias("source_file"), "text_key", "part_no", "source_ref")


@query(
    "tally_segments",
    _TALLY + "SELECT source_file, text_key, string_agg(DISTINCT segment, ', ' ORDER BY segment) AS segment FROM tally WHERE segment IS NOT NULL GROUP BY 1, 2",
)
def tally_segments(spark, sf_dir):
    segments = feeds.tally_segments(feeds.tally_lines(star.tally_grid(spark, sf_dir)))
    return feeds.tally_segment_text(segments).select(F.col("file").alias("source_file"), "text_key", "segment")


@query(
    "source_files",
    f"WITH {ORDERED} SELECT 'inv_' || CAST(l_orderkey AS VARCHAR) || '.pdf' AS source_file, count(*) AS n_lines, min(l_orderkey % 3 + 1 + n) AS first_line FROM ordered WHERE l_orderkey % 5 <> 4 GROUP BY 1",
)
def source_files(spark, sf_dir):
    return feeds.source_files(feeds.extracted_invoices(star.invoice_grid(spark, sf_dir)))
