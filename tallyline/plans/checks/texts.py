"""Queries over descriptions: cleaning, parsing, the crosswalk and its registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.config import Matching
from tallyline.functions import numbers
from tallyline.functions.text import normalize, parse_uom
from tallyline.operators import crosswalk, history
from tallyline.plans import cycle, star
from tallyline.plans.checks import query, sql
from tallyline.schemas import CYCLE_KEYS

# Edit distance as scorer, with thresholds to match: SQL can compute it too.
BY_DISTANCE = Matching(scorer=crosswalk.LEVENSHTEIN, auto_score=70.0, suggest_score=55.0)


@query("normalize_desc", f"WITH {sql.DESCRIBED} SELECT p_partkey, {sql.normalize('raw_desc')} AS text_key FROM described")
def normalize_desc(spark, sf_dir):
    return star.described_parts(spark, sf_dir).select("p_partkey", normalize(F.col("raw_desc")).alias("text_key"))


@query(
    "uom_parse",
    """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'FT' WHEN 1 THEN 'EA' WHEN 2 THEN '100FT' WHEN 3 THEN 'LS' WHEN 4 THEN 'FT'
  WHEN 5 THEN '100FT' WHEN 6 THEN 'FT' WHEN 7 THEN NULL ELSE 'EA' END AS uom,
  CASE WHEN p_partkey % 9 IN (2, 5) THEN p_size * 100.0 ELSE p_size END AS base_qty,
  CASE p_partkey % 9 WHEN 0 THEN 'FT' WHEN 1 THEN 'EA' WHEN 2 THEN 'FT' WHEN 3 THEN 'LS' WHEN 4 THEN 'FT'
  WHEN 5 THEN 'FT' WHEN 6 THEN 'FT' WHEN 7 THEN NULL ELSE 'EA' END AS base_uom FROM part""",
)
def uom_parse(spark, sf_dir):
    from tallyline.functions.text import base_qty, base_uom

    spelled = F.expr(
        "element_at(array('LF', ' each', '100 ft', 'Lump Sum', 'Per Foot', 'mft', 'feet ', concat('widget', p_size), 'e'), cast(p_partkey % 9 + 1 as int))"
    )
    parsed = star.table(spark, sf_dir, "part").select("p_partkey", "p_size", parse_uom(spelled).alias("uom"))
    return parsed.select(
        "p_partkey", "uom", base_qty(F.col("p_size").cast("double"), F.col("uom")).alias("base_qty"), base_uom(F.col("uom")).alias("base_uom")
    )


@query(
    "number_parse",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE round(l_extendedprice, 2) END AS value, l_quantity AS qty FROM lineitem""",
)
def number_parse(spark, sf_dir):
    """Prices typed with signs, separators and blanks; two spellings are no numbers."""
    plain = "cast(cast(l_extendedprice as decimal(18,2)) as string)"
    grouped = "format_number(l_extendedprice, 2)"
    typed = F.expr(
        f"element_at(array('n/a', concat({plain}, 'd'), concat('$', {grouped}), concat(' ', {plain}, ' '), concat('$ ', {grouped}), "
        f"concat({plain}, '%'), concat('+', {plain})), cast(l_orderkey % 7 + 1 as int))"
    )
    return star.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(numbers.parse_number(typed), 2).alias("value"),
        numbers.parse_number(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".")), numbers.TALLY_MARKS).alias("qty"),
    )


@query(
    "derive_price_amount",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 4 WHEN 3 THEN 0.0 ELSE l_extendedprice / l_quantity END AS unit_price,
  CASE l_linenumber % 4 WHEN 3 THEN 0.0 WHEN 1 THEN round(l_quantity * (l_extendedprice / l_quantity), 4) ELSE l_extendedprice END AS amount FROM lineitem""",
)
def derive_price_amount(spark, sf_dir):
    price = F.expr("CASE WHEN l_linenumber % 4 IN (0, 1) THEN l_extendedprice / l_quantity END")
    amount = F.expr("CASE WHEN l_linenumber % 4 IN (0, 2) THEN l_extendedprice END")
    full_price = numbers.derive_price(F.col("l_quantity"), price, amount)
    full_amount = numbers.derive_amount(F.col("l_quantity"), full_price, amount)
    return star.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.coalesce(full_price, F.lit(0.0)).alias("unit_price"),
        F.round(F.coalesce(full_amount, F.lit(0.0)), 4).alias("amount"),
    )


# --- crosswalk ---------------------------------------------------------------
_RESOLVE = "WITH" + ",".join([sql.CONTRACT, sql.DESCRIBED, sql.RESOLVED])


def matched(spark: SparkSession, sf_dir: str, matching: Matching) -> DataFrame:
    return crosswalk.resolve(
        star.described_parts(spark, sf_dir), star.contract(spark, sf_dir), star.learned_aliases(spark, sf_dir), scope=(), matching=matching
    )


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk.settled(star.described_parts(spark, sf_dir), star.contract(spark, sf_dir), star.learned_aliases(spark, sf_dir), scope=())


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = crosswalk.fold_decisions(star.mapping_events(spark, sf_dir), scope=())
    return crosswalk.triage(matched(spark, sf_dir, BY_DISTANCE), decisions, (), BY_DISTANCE)


@query("alias_join", _RESOLVE + "SELECT raw_desc, code FROM resolved WHERE kind = 'alias'")
def alias_join(spark, sf_dir):
    return settled(spark, sf_dir).filter("alias_code is not null").select("raw_desc", F.col("alias_code").alias("code"))


@query("code_match", _RESOLVE + "SELECT raw_desc, code, score FROM resolved WHERE kind = 'code'")
def code_match(spark, sf_dir):
    found = settled(spark, sf_dir).filter("alias_code is null and hit is not null")
    return found.select("raw_desc", F.col("hit.code").alias("code"), F.lit(100.0).alias("score"))


@query(
    "fuzzy_topn",
    _RESOLVE + "SELECT text_key, CAST(rank AS INTEGER) AS rank, code, round(score, 6) AS score, field FROM scored WHERE rank <= 3",
)
def fuzzy_topn(spark, sf_dir):
    from tallyline.operators.rollup import join_null_safe

    texts = matched_open_texts(spark, sf_dir)
    found = crosswalk.score_candidates(texts, star.contract(spark, sf_dir), (), BY_DISTANCE)
    return found.select("text_key", "rank", "code", F.round("score", 6).alias("score"), "field")


def matched_open_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = star.described_parts(spark, sf_dir).select(normalize(F.col("raw_desc")).alias("text_key")).distinct()
    aliases = star.learned_aliases(spark, sf_dir).select(F.col("normalized_desc").alias("text_key"))
    codes = crosswalk.exact_codes(star.contract(spark, sf_dir), ())
    return texts.join(aliases, "text_key", "left_anti").join(codes, "text_key", "left_anti")


@query(
    "crosswalk_resolve",
    _RESOLVE + "SELECT raw_desc, text_key, code, round(score, 6) AS score, kind, suggested_code FROM resolved",
)
def crosswalk_resolve(spark, sf_dir):
    return matched(spark, sf_dir, BY_DISTANCE).select(
        "raw_desc", "text_key", "code", F.round("score", 6).alias("score"), "kind", crosswalk.suggestion(BY_DISTANCE).alias("suggested_code")
    )


@query("fuzzy_wratio")
def fuzzy_wratio(spark, sf_dir):
    """The default scorer. No SQL computes it; the tests compare it with a plain count
    over all pairs of a small fixture."""
    found = matched(spark, sf_dir, Matching())
    return found.select("raw_desc", "code", F.round("score", 6).alias("score"), "kind", F.transform("candidates", lambda c: c["code"]).cast("string").alias("candidates"))


_TRIAGE = "WITH" + ",".join([sql.CONTRACT, sql.DESCRIBED, sql.RESOLVED, sql.DECIDED])


@query("crosswalk_triage", _TRIAGE + "SELECT raw_desc, bucket, final_code, suggested_code FROM triaged")
def crosswalk_triage(spark, sf_dir):
    return triaged(spark, sf_dir).select("raw_desc", "bucket", "final_code", "suggested_code")


@query("review_queue", _TRIAGE + "SELECT raw_desc, round(score, 6) AS score, suggested_code FROM triaged WHERE bucket = 'review'")
def review_queue(spark, sf_dir):
    return crosswalk.review_queue(triaged(spark, sf_dir)).select("raw_desc", F.round("score", 6).alias("score"), "suggested_code")


@query(
    "mapping_decisions",
    f"WITH {sql.DESCRIBED}, {sql.DECIDED.split('triaged AS')[0].rstrip().rstrip(',')} SELECT raw_desc, mapped_code, not_in_contract FROM decisions",
)
def mapping_decisions(spark, sf_dir):
    return crosswalk.fold_decisions(star.mapping_events(spark, sf_dir), scope=())


@query(
    "apply_codes",
    _TRIAGE + "SELECT p_partkey, final_code AS code FROM described LEFT JOIN triaged USING (raw_desc)",
)
def apply_codes(spark, sf_dir):
    lines = star.described_parts(spark, sf_dir).withColumn("code", F.lit(None).cast("string"))
    return crosswalk.apply_codes(lines, triaged(spark, sf_dir), ()).select("p_partkey", "code")


@query(
    "distinct_descriptions",
    f"WITH {sql.LINES} SELECT project_id, raw_desc, count(*) FILTER (FALSE) + min(CASE WHEN l_returnflag <> 'R' THEN 0 ELSE 1 END) AS first_feed FROM lines GROUP BY project_id, raw_desc",
)
def distinct_descriptions(spark, sf_dir):
    feeds = [star.asbuilt(spark, sf_dir), star.invoices(spark, sf_dir)]
    out = crosswalk.distinct_descriptions(feeds, order=True)
    return out.select("project_id", "raw_desc", F.col("first_seen.feed").cast("bigint").alias("first_feed"))


@query(
    "recon_from_descriptions",
    "WITH" + ",".join([sql.CONTRACT, sql.DESCRIBED, sql.RESOLVED, sql.DECIDED])
    + """, told AS (SELECT r_name AS project_id, n_name AS contractor_id, CAST(year(l_shipdate) - 1994 AS INTEGER) AS cycle_no,
    t.final_code AS code, coalesce(t.final_code, '~' || lower(trim(d.raw_desc))) AS uk, l_returnflag, l_quantity AS qty, l_extendedprice AS amount,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN described d ON l_partkey = p_partkey JOIN triaged t USING (raw_desc) JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT project_id, contractor_id, cycle_no, uk, max(code) AS code, CAST(coalesce(sum(CAST(CASE WHEN l_returnflag <> 'R' THEN qty END AS DECIMAL(18,4))), 0) AS DOUBLE) AS built_qty,
    max(qty) AS billed_qty FROM told GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, contractor_id, cycle_no, uk
    ORDER BY qty DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount) AS rn FROM told) WHERE rn = 1)
SELECT b.project_id, b.contractor_id, b.cycle_no, b.code, b.built_qty, b.billed_qty, round(top.amount, 2) AS billed_amount,
  round(coalesce(b.built_qty * c.unit_price, 0), 2) AS expected_amount
FROM b JOIN top USING (project_id, contractor_id, cycle_no, uk) LEFT JOIN contract c ON c.code = b.code""",
)
def recon_from_descriptions(spark, sf_dir):
    """Uncoded lines under messy descriptions, matched and reconciled in one plan."""
    texts = star.described_parts(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), F.col("raw_desc").alias("messy"))

    def told(lines: DataFrame) -> DataFrame:
        return lines.withColumn("l_partkey", F.col("line_no.l_partkey")).join(texts, "l_partkey").withColumn("raw_desc", F.col("messy"))

    rows = cycle.reconcile_described(
        told(star.asbuilt(spark, sf_dir)),
        told(star.invoices(spark, sf_dir)),
        star.contract(spark, sf_dir),
        aliases=star.learned_aliases(spark, sf_dir),
        decisions=crosswalk.fold_decisions(star.mapping_events(spark, sf_dir), scope=()),
        matching=BY_DISTANCE,
    )
    return rows.select(*CYCLE_KEYS, "code", "built_qty", "billed_qty", F.round("billed_amount", 2).alias("billed_amount"), F.round("expected_amount", 2).alias("expected_amount"))


# --- registers ---------------------------------------------------------------
_CONFIRMED = """SELECT event_type || ' ' || CAST(user_id % 50 AS VARCHAR) AS normalized_desc, 'C' || CAST(event_id AS VARCHAR) AS code, ts AS confirmed_at,
  CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS batch FROM events"""


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(" "), (F.col("user_id") % 50).cast("string")).alias("normalized_desc"),
        F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("code"),
        F.col("ts").alias("confirmed_at"),
        (F.col("event_id") % 10 == 0).alias("new"),
    )


@query(
    "alias_upsert",
    f"""SELECT normalized_desc, code, confirmed_at FROM (SELECT *, row_number() OVER (PARTITION BY normalized_desc ORDER BY confirmed_at DESC, batch DESC, code DESC) AS rn
  FROM ({_CONFIRMED})) WHERE rn = 1""",
)
def alias_upsert(spark, sf_dir):
    log = confirmations(spark, sf_dir)
    return history.alias_upsert(log.filter("not new").drop("new"), log.filter("new").drop("new")).select("normalized_desc", "code", "confirmed_at")


@query(
    "alias_forget",
    f"""SELECT normalized_desc, max(confirmed_at) AS confirmed_at FROM ({_CONFIRMED}) WHERE normalized_desc NOT IN
  (SELECT event_type || ' ' || CAST(user_id % 50 AS VARCHAR) FROM events WHERE event_type = 'error') GROUP BY 1""",
)
def alias_forget(spark, sf_dir):
    log = confirmations(spark, sf_dir).drop("new")
    current = history.alias_upsert(log.filter(F.lit(False)), log)
    reopened = star.table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.concat("event_type", F.lit(" "), (F.col("user_id") % 50).cast("string")).alias("normalized_desc")
    )
    return history.alias_forget(current, reopened).select("normalized_desc", "confirmed_at")


@query(
    "alias_learning",
    f"""WITH {sql.DESCRIBED}, log AS (SELECT {sql.normalize('raw_desc')} AS normalized_desc, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'nic' ELSE 'reopen' END AS event,
    part_code AS code FROM described)
  SELECT normalized_desc, code FROM (SELECT *, row_number() OVER (PARTITION BY normalized_desc ORDER BY seq DESC) AS rn FROM log WHERE event <> 'nic') WHERE rn = 1 AND event = 'map'""",
)
def alias_learning(spark, sf_dir):
    learned, _ = crosswalk.decision_aliases(star.mapping_events(spark, sf_dir))
    return learned


@query(
    "template_profiles",
    """SELECT contractor, header_row FROM (SELECT 'U' || CAST(user_id AS VARCHAR) AS contractor, CAST(event_id % 7 AS INTEGER) AS header_row, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""",
)
def template_profiles(spark, sf_dir):
    log = star.table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("contractor"),
        (F.col("event_id") % 7).cast("int").alias("header_row"),
        F.struct("ts", "event_id").alias("updated_at"),
        (F.col("event_type") == "error").alias("deleted"),
    )
    return history.profiles(log).select("contractor", "header_row")


@query("register_contractors", "SELECT DISTINCT c_name AS name FROM customer WHERE c_name NOT IN (SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier)")
def register_contractors(spark, sf_dir):
    existing = star.table(spark, sf_dir, "supplier").select(F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"))
    names = star.table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.col("c_name")).alias("name"))
    return history.register(existing, names, "contractor_id").select("name")
