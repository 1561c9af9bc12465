"""Queries over drawing comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.config import Matching
from tallyline.operators import annotations as ann
from tallyline.operators.crosswalk import LEVENSHTEIN
from tallyline.plans import star
from tallyline.plans.checks import query

SAID = """
said AS (SELECT 'book_' || CAST(l_suppkey AS VARCHAR) AS doc_id, l_linenumber AS page, (l_orderkey + l_linenumber) % 8 AS lay, l_orderkey,
    CAST(l_quantity AS INTEGER) * 7 + 100 AS v, l_linenumber AS k, CAST(l_quantity AS INTEGER) AS q, 1 + l_partkey % 3 AS ways,
    100 + l_partkey % 15 * 100 AS tail FROM lineitem)"""

BILLED = """
bracket AS (SELECT tail, (SELECT b FROM (SELECT unnest([150, 250, 350, 500, 750, 1000, 1250, 1500]) AS b) ORDER BY abs(b - tail), b LIMIT 1) AS b
  FROM (SELECT DISTINCT tail FROM said)),
entries AS (
  SELECT doc_id, 'afo_sl_288' AS item, v AS amount FROM said WHERE lay = 0
  UNION ALL SELECT doc_id, 'bond', 1 FROM said WHERE lay IN (0, 1)
  UNION ALL SELECT doc_id, 'afo_sl_48', v FROM said WHERE lay = 1
  UNION ALL SELECT doc_id, 'banding', k FROM said WHERE lay = 1
  UNION ALL SELECT doc_id, 'olash', v FROM said WHERE lay = 2
  UNION ALL SELECT doc_id, 'bfo_48_I', v FROM said WHERE lay = 3
  UNION ALL SELECT doc_id, 'bm60_1.25_DP', v FROM said WHERE lay = 4
  UNION ALL SELECT doc_id, 'bm60_1.25_DPD', v FROM said WHERE lay = 4 AND ways > 1
  UNION ALL SELECT doc_id, 'afo_sl_144', v FROM said WHERE lay = 5
  UNION ALL SELECT doc_id, 'down_guy', k FROM said WHERE lay = 5
  UNION ALL SELECT doc_id, 'anchor', k FROM said WHERE lay = 5
  UNION ALL SELECT doc_id, 'riser_guard', k FROM said WHERE lay = 6
  UNION ALL SELECT doc_id, 'handhole_30T', q FROM said WHERE lay = 6
  UNION ALL SELECT doc_id, 'mst_' || CAST(b AS VARCHAR), 1 FROM said JOIN bracket USING (tail) WHERE lay = 6
  UNION ALL SELECT doc_id, 'coil', 2 FROM said WHERE lay = 7 AND l_orderkey % 2 = 1),
billed AS (SELECT doc_id, item, CAST(sum(amount) AS DOUBLE) AS qty, count(*) AS n_records FROM entries GROUP BY ALL)"""


def split(spark, sf_dir):
    return ann.comments(star.comments(spark, sf_dir))


def quantities(spark, sf_dir):
    return ann.item_quantities(ann.of_each(star.comments(spark, sf_dir), lambda texts: ann.items(ann.token_events(texts))))


@query("annot_quantities", f"WITH {SAID}, {BILLED} SELECT doc_id, item, qty, n_records FROM billed")
def annot_quantities(spark, sf_dir):
    return quantities(spark, sf_dir)


@query(
    "annot_items",
    f"""WITH {SAID}, {BILLED} SELECT doc_id, item, CASE WHEN item LIKE 'mst%' OR item IN ('bond', 'banding', 'down_guy', 'anchor', 'riser_guard', 'handhole_30T', 'coil') THEN 'EA' ELSE 'FT' END AS uom,
  CASE item WHEN 'afo_sl_288' THEN 'AFO SL 288FOC' WHEN 'bond' THEN 'AFO.BOND' WHEN 'afo_sl_48' THEN 'AFO SL48FOC' WHEN 'banding' THEN 'AFO.BANDING'
   WHEN 'olash' THEN 'AFO.OLASH' WHEN 'bfo_48_I' THEN 'BFO.48.I' WHEN 'bm60_1.25_DP' THEN 'BM60-(1.25)DP' WHEN 'bm60_1.25_DPD' THEN 'BM60-(1.25)DPD Dual'
   WHEN 'afo_sl_144' THEN 'AFO SL 144FOC' WHEN 'down_guy' THEN 'AFO.GG' WHEN 'anchor' THEN 'AFO.GAA' WHEN 'riser_guard' THEN 'BM81'
   WHEN 'handhole_30T' THEN 'BHF-30T' WHEN 'coil' THEN 'AFO.S' ELSE 'MST ' || substr(item, 5) || '''' END AS rate_code FROM billed""",
)
def annot_items(spark, sf_dir):
    return ann.describe_items(quantities(spark, sf_dir)).select("doc_id", "item", "uom", "rate_code")


@query("annot_unresolved", f"WITH {SAID} SELECT doc_id, page, 'BDO' AS token, count(*) AS n FROM said WHERE lay = 6 GROUP BY ALL")
def annot_unresolved(spark, sf_dir):
    found = ann.of_each(star.comments(spark, sf_dir), lambda texts: ann.unresolved(ann.token_events(texts)))
    return found.groupBy("doc_id", "page", "token").agg(F.sum("copies").alias("n"))


@query(
    "annot_notes",
    f"""WITH {SAID} SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(['This pole on Page ' || CAST(k AS VARCHAR), '2/26']) AS token
  FROM said WHERE lay = 7 AND l_orderkey % 2 = 1) GROUP BY ALL""",
)
def annot_notes(spark, sf_dir):
    found = ann.of_each(star.comments(spark, sf_dir), lambda texts: ann.notes(ann.token_events(texts)))
    return found.groupBy("doc_id", "token").agg(F.sum("copies").alias("n"))


@query("annot_excluded", f"WITH {SAID} SELECT doc_id, count(*) AS n FROM said WHERE lay = 7 AND l_orderkey % 2 = 0 GROUP BY ALL")
def annot_excluded(spark, sf_dir):
    return ann.excluded_comments(split(spark, sf_dir)).groupBy("doc_id").agg(F.sum("copies").alias("n"))


@query(
    "annot_lines",
    f"""WITH {SAID}, {BILLED} SELECT doc_id, item, qty, CASE WHEN item = 'handhole_30T' AND EXISTS (SELECT 1 FROM part WHERE p_size = 30) THEN 'BHF-30T' END AS code,
  'annot:' || CAST(n_records AS VARCHAR) || CASE WHEN n_records = 1 THEN ' record' ELSE ' records' END AS source_ref FROM billed""",
)
def annot_lines(spark, sf_dir):
    """Lines matched by rate code; the vault contract knows one of the codes."""
    exact = Matching(scorer=LEVENSHTEIN, auto_score=100.0)
    lines = ann.asbuilt_lines(quantities(spark, sf_dir), star.vault_contract(spark, sf_dir), matching=exact)
    return lines.select("doc_id", "item", "qty", "code", "source_ref")


@query(
    "annot_warnings",
    f"""WITH {SAID} SELECT doc_id, count(*) AS n_records, count(*) FILTER (lay = 7 AND l_orderkey % 2 = 0) AS n_excluded, count(*) FILTER (lay = 6) AS n_unresolved FROM said GROUP BY doc_id""",
)
def annot_warnings(spark, sf_dir):
    return ann.record_counts_of_each(star.comments(spark, sf_dir))
