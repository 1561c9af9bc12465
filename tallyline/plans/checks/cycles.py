"""Queries over reconciled cycles, their totals, history and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.config import DISCRETE, Rules
from tallyline.functions.text import flag_rules
from tallyline.operators import history, review, totals
from tallyline.operators.reconcile import exposure_order, reconcile_activity
from tallyline.plans import star
from tallyline.plans.checks import query
from tallyline.plans.checks.sql import CYCLES, LINES, ROW, recon
from tallyline.plans.cycle import reconcile_series, reconcile_with_changes
from tallyline.schemas import CYCLE_KEYS


def rows_of(spark: SparkSession, sf_dir: str, mode: str = "cumulative") -> DataFrame:
    return reconcile_activity(star.activity(spark, sf_dir), star.contract(spark, sf_dir), rules=Rules(billing_mode=mode))


def series(spark: SparkSession, sf_dir: str, per_cycle_mode: bool = True) -> DataFrame:
    return reconcile_series(
        star.activity(spark, sf_dir), star.contract(spark, sf_dir), star.cycles(spark, sf_dir), per_cycle_mode=per_cycle_mode
    )


def shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        *CYCLE_KEYS, "code", "description", "uom", "built_qty", "billed_qty", "contract_price",
        F.round("billed_price", 8).alias("billed_price"), "est_qty",
        *[F.round(c, 2).alias(c) for c in ("billed_amount", "expected_amount", "variance")],
        "severity", flag_rules(F.col("flags")).alias("rules"), *more,
    )


@query("recon_cumulative", recon() + f"SELECT {ROW} FROM recon")
def recon_cumulative(spark, sf_dir):
    return shown(rows_of(spark, sf_dir))


@query("recon_discrete", recon("discrete") + f"SELECT {ROW} FROM recon")
def recon_discrete(spark, sf_dir):
    return shown(rows_of(spark, sf_dir, DISCRETE))


@query("recon_mixed_modes", recon("mixed", prior=True) + f"SELECT {ROW}, prior_billed_qty FROM recon")
def recon_mixed_modes(spark, sf_dir):
    return shown(series(spark, sf_dir), "prior_billed_qty")


@query(
    "recon_two_feeds",
    recon() + "SELECT project_id, contractor_id, cycle_no, row_key, built_qty, billed_qty, round(variance, 2) AS variance, severity FROM recon",
)
def recon_two_feeds(spark, sf_dir):
    """The same figures with the two feeds given as separate tables."""
    from tallyline.operators.reconcile import reconcile

    rows = reconcile(star.asbuilt(spark, sf_dir), star.invoices(spark, sf_dir), star.contract(spark, sf_dir))
    return rows.select(*CYCLE_KEYS, "row_key", "built_qty", "billed_qty", F.round("variance", 2).alias("variance"), "severity")


@query(
    "recon_with_change_orders",
    recon(
        contract="revised",
        extra="revised AS (SELECT code, description, uom, CASE WHEN uom = 'EA' THEN unit_price * 5 ELSE unit_price END AS unit_price, est_qty, uom = 'EA' AS is_change_order FROM contract)",
    )
    + f"SELECT {ROW}, coalesce((SELECT is_change_order FROM revised v WHERE v.code = recon.code), FALSE) AS is_change_order FROM recon",
)
def recon_with_change_orders(spark, sf_dir):
    items = star.contract(spark, sf_dir)
    return shown(reconcile_with_changes(star.activity(spark, sf_dir), items, star.change_orders(items)), "is_change_order")


@query(
    "recon_flags_by_rule",
    recon("mixed", prior=True)
    + """SELECT rule, count(*) AS n_rows, CAST(sum(CAST(round(variance, 2) AS DECIMAL(18,2))) AS DOUBLE) AS variance
  FROM (SELECT unnest(string_split(rules, ',')) AS rule, variance FROM recon WHERE rules <> '') GROUP BY rule""",
)
def recon_flags_by_rule(spark, sf_dir):
    rows = series(spark, sf_dir).select("variance", F.explode("flags.rule").alias("rule"))
    return rows.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.round("variance", 2).cast("decimal(18,2)")).cast("double").alias("variance")
    )


_TOTALS = """SELECT project_id, contractor_id, cycle_no, round(total_billed, 2) AS total_billed, round(total_expected, 2) AS total_expected,
  round(flagged, 2) AS flagged_over_billing, n_critical, n_warning, n_ok, n_units, retainage_pct,
  round(total_billed * retainage_pct / 100.0, 6) AS retainage_held,
  round(total_billed - flagged - total_billed * retainage_pct / 100.0, 6) AS net_recommended
  FROM (SELECT project_id, contractor_id, cycle_no,
    CAST(sum(CAST(billed_amount AS DECIMAL(28,8))) AS DOUBLE) AS total_billed,
    CAST(sum(CAST(expected_amount AS DECIMAL(28,8))) AS DOUBLE) AS total_expected,
    CAST(sum(CAST(CASE WHEN severity = 'critical' AND variance > 0 THEN variance ELSE 0 END AS DECIMAL(28,8))) AS DOUBLE) AS flagged,
    count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning,
    count(*) FILTER (severity IN ('ok', 'info')) AS n_ok, count(*) AS n_units
    FROM recon GROUP BY ALL) JOIN cycles USING (project_id, contractor_id, cycle_no)"""


def _rounded(df: DataFrame, columns, places: int = 2) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


@query("cycle_totals", recon("mixed", prior=True) + _TOTALS)
def cycle_totals(spark, sf_dir):
    out = totals.cycle_totals(series(spark, sf_dir), cycles=star.cycles(spark, sf_dir))
    out = _rounded(out, ["total_billed", "total_expected", "flagged_over_billing"])
    return _rounded(out, ["retainage_held", "net_recommended"], 6)


_WITHHELD = "CASE cycle_no % 4 WHEN 0 THEN NULL WHEN 1 THEN retainage_held WHEN 2 THEN retainage_held + 2500.5 ELSE retainage_held - 0.75 END"


@query(
    "retainage_check",
    recon()
    + f"""SELECT project_id, contractor_id, cycle_no, gross, retainage_pct, expected_retainage, actual_retainage,
  round(coalesce(actual_retainage - expected_retainage, 0), 2) AS retainage_variance,
  abs(coalesce(actual_retainage - expected_retainage, 0)) <= 1.0 AS retainage_ok
  FROM (SELECT *, {_WITHHELD} AS actual_retainage, retainage_held AS expected_retainage FROM (
    SELECT project_id, contractor_id, cycle_no, retainage_pct, gross, gross * (retainage_pct / 100.0) AS retainage_held
    FROM (SELECT project_id, contractor_id, cycle_no, CAST(sum(CAST(billed_amount AS DECIMAL(28,2))) AS DOUBLE) AS gross FROM recon GROUP BY ALL)
    JOIN cycles USING (project_id, contractor_id, cycle_no)))""",
)
def retainage_check(spark, sf_dir):
    gross = rows_of(spark, sf_dir).groupBy(*CYCLE_KEYS).agg(F.sum(F.col("billed_amount").cast("decimal(28,2)")).cast("double").alias("gross"))
    given = (
        gross.join(star.cycles(spark, sf_dir).select(*CYCLE_KEYS, "retainage_pct"), list(CYCLE_KEYS))
        .withColumn("retainage_held", F.col("gross") * (F.col("retainage_pct") / 100.0))
        .withColumn("actual_retainage", F.expr(_WITHHELD))
    )
    checked = totals.check_retainage(given, gross="gross")
    return checked.select(
        *CYCLE_KEYS, "gross", "retainage_pct", "expected_retainage", "actual_retainage",
        F.round("retainage_variance", 2).alias("retainage_variance"), "retainage_ok",
    )


@query(
    "severity_counts",
    recon("mixed", prior=True)
    + """SELECT project_id, contractor_id, cycle_no, count(*) AS n_all, count(*) FILTER (severity = 'critical') AS n_critical,
  count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity IN ('ok', 'info')) AS n_ok FROM recon GROUP BY ALL""",
)
def severity_counts(spark, sf_dir):
    return totals.severity_counts(series(spark, sf_dir))


@query(
    "flagged_topk",
    recon("mixed", prior=True)
    + """SELECT project_id, contractor_id, cycle_no, row_key, severity, round(variance, 2) AS variance FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, contractor_id, cycle_no
    ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, abs(round(variance, 2)) DESC, row_key) AS rn
  FROM recon WHERE severity IN ('critical', 'warning')) WHERE rn <= 18""",
)
def flagged_topk(spark, sf_dir):
    """Approval packet rows; ties resolved by row key so that SQL can follow."""
    from pyspark.sql import Window

    from tallyline.operators.reconcile import severity_rank

    order = Window.partitionBy(*CYCLE_KEYS).orderBy(
        severity_rank(F.col("severity")).desc(), F.abs(F.round("variance", 2)).desc(), "row_key"
    )
    return (
        review.flagged(series(spark, sf_dir))
        .withColumn("position", F.row_number().over(order))
        .filter("position <= 18")
        .select(*CYCLE_KEYS, "row_key", "severity", F.round("variance", 2).alias("variance"))
    )


@query(
    "flagged_report",
    recon("mixed", prior=True) + f"SELECT {ROW} FROM recon WHERE severity IN ('critical', 'warning')",
)
def flagged_report(spark, sf_dir):
    return shown(review.flagged(series(spark, sf_dir)))


@query("unmatched_report", recon() + f"SELECT {ROW} FROM recon WHERE code IS NULL OR contract_price IS NULL")
def unmatched_report(spark, sf_dir):
    return shown(review.unmatched(rows_of(spark, sf_dir)))


@query(
    "summary_metrics",
    recon("mixed", prior=True)
    + f", totals AS ({_TOTALS})"
    + """SELECT project_id, contractor_id, cycle_no, m.metric_no AS metric_no, m.metric AS metric, CAST(m.value AS DOUBLE) AS value FROM (
  SELECT project_id, contractor_id, cycle_no, unnest([
    {'metric_no': 1, 'metric': 'Billed this cycle (gross)', 'value': total_billed},
    {'metric_no': 2, 'metric': 'Expected (built × contract)', 'value': total_expected},
    {'metric_no': 3, 'metric': 'Flagged over-billing', 'value': flagged_over_billing},
    {'metric_no': 4, 'metric': 'Retainage held', 'value': retainage_held},
    {'metric_no': 5, 'metric': 'Net recommended', 'value': net_recommended},
    {'metric_no': 6, 'metric': 'Critical flags', 'value': n_critical},
    {'metric_no': 7, 'metric': 'Warnings', 'value': n_warning},
    {'metric_no': 8, 'metric': 'Reconciled / info', 'value': n_ok}]) AS m FROM totals)""",
)
def summary_metrics(spark, sf_dir):
    return totals.summary_metrics(cycle_totals(spark, sf_dir))


# --- history -----------------------------------------------------------------
_SUMMARY = recon("mixed", prior=True) + """, summaries AS (
  SELECT y.project_id, y.contractor_id, y.cycle_no, y.period_label, y.retainage_pct,
    coalesce(billed, 0) AS billed, coalesce(expected, 0) AS expected, coalesce(flagged, 0) AS flagged,
    coalesce(n_critical, 0) AS n_critical, coalesce(n_units, 0) AS n_units
  FROM cycles y LEFT JOIN (SELECT project_id, contractor_id, cycle_no,
    CAST(sum(CAST(round(billed_amount, 2) AS DECIMAL(28,2))) AS DOUBLE) AS billed,
    CAST(sum(CAST(round(expected_amount, 2) AS DECIMAL(28,2))) AS DOUBLE) AS expected,
    CAST(sum(CAST(CASE WHEN severity = 'critical' AND variance > 0 THEN round(variance, 2) ELSE 0 END AS DECIMAL(28,2))) AS DOUBLE) AS flagged,
    count(*) FILTER (severity = 'critical') AS n_critical, count(*) AS n_units
    FROM recon GROUP BY ALL) USING (project_id, contractor_id, cycle_no))
"""


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they are stored: money in cents."""
    return _rounded(series(spark, sf_dir), ["billed_amount", "expected_amount", "variance"])


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cycle_summaries(star.cycles(spark, sf_dir), saved(spark, sf_dir))


@query(
    "cycle_summaries",
    _SUMMARY + """SELECT project_id, contractor_id, cycle_no, period_label, billed, expected, flagged, n_critical, n_units,
  round(billed * retainage_pct / 100.0, 6) AS retainage, round(billed - flagged - billed * retainage_pct / 100.0, 6) AS net FROM summaries""",
)
def cycle_summaries(spark, sf_dir):
    return summaries(spark, sf_dir).select(
        *CYCLE_KEYS, "period_label", "billed", "expected", "flagged", "n_critical", "n_units",
        F.round("retainage", 6).alias("retainage"), F.round("net", 6).alias("net"),
    )


@query("trend", _SUMMARY + "SELECT project_id, contractor_id, cycle_no, period_label, expected AS built_value, billed AS billed_value FROM summaries")
def trend(spark, sf_dir):
    return history.trend(star.cycles(spark, sf_dir), saved(spark, sf_dir))


_STATS = _SUMMARY + """, links AS (SELECT r_name AS project_id, n_name AS contractor_id FROM nation JOIN region ON n_regionkey = r_regionkey),
stats AS (SELECT r_name AS project_id,
    coalesce(CASE WHEN r_regionkey % 4 = 3 THEN 'closed' WHEN r_regionkey % 4 <> 0 THEN 'Active' END, 'active') AS status,
    (SELECT count(DISTINCT contractor_id) FROM links k WHERE k.project_id = r_name) AS n_contractors,
    coalesce(n_cycles, 0) AS n_cycles, coalesce(s.billed, 0) AS billed, coalesce(s.built, 0) AS built,
    coalesce(s.flagged, 0) AS flagged, coalesce(l.latest_to_date, 0) AS latest_to_date, s.latest_period
  FROM region LEFT JOIN (SELECT project_id, count(*) AS n_cycles, CAST(sum(CAST(billed AS DECIMAL(28,2))) AS DOUBLE) AS billed,
      CAST(sum(CAST(expected AS DECIMAL(28,2))) AS DOUBLE) AS built, CAST(sum(CAST(flagged AS DECIMAL(28,2))) AS DOUBLE) AS flagged,
      max(period_label) AS latest_period FROM summaries GROUP BY 1) s ON s.project_id = r_name
  LEFT JOIN (SELECT project_id, CAST(sum(CAST(billed AS DECIMAL(28,2))) AS DOUBLE) AS latest_to_date FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, contractor_id ORDER BY cycle_no DESC) AS rn FROM summaries) WHERE rn = 1 GROUP BY 1) l
    ON l.project_id = r_name)
"""


def stats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.portfolio_stats(star.projects(spark, sf_dir), star.links(spark, sf_dir), summaries(spark, sf_dir))


@query(
    "portfolio_stats",
    _STATS + "SELECT project_id, status, n_contractors, n_cycles, billed, built, flagged, latest_to_date, latest_period FROM stats",
)
def portfolio_stats(spark, sf_dir):
    return stats_of(spark, sf_dir).drop("name")


@query(
    "portfolio_kpis",
    _STATS + """SELECT count(*) AS n_projects, count(*) FILTER (lower(status) = 'active') AS n_active,
  (SELECT count(DISTINCT contractor_id) FROM links) AS n_contractors, CAST(sum(n_cycles) AS BIGINT) AS n_cycles,
  CAST(sum(CAST(billed AS DECIMAL(28,2))) AS DOUBLE) AS billed, CAST(sum(CAST(built AS DECIMAL(28,2))) AS DOUBLE) AS built,
  CAST(sum(CAST(flagged AS DECIMAL(28,2))) AS DOUBLE) AS flagged FROM stats""",
)
def portfolio_kpis(spark, sf_dir):
    return history.portfolio_kpis(stats_of(spark, sf_dir), star.links(spark, sf_dir))


@query(
    "portfolio_rollup",
    _SUMMARY + """SELECT project_id, contractor_id, cycle_no, CAST(grouping(project_id) * 4 + grouping(contractor_id) * 2 + grouping(cycle_no) AS BIGINT) AS level,
  count(*) AS n_cycles, CAST(sum(CAST(billed AS DECIMAL(28,2))) AS DOUBLE) AS billed,
  CAST(sum(CAST(expected AS DECIMAL(28,2))) AS DOUBLE) AS built, CAST(sum(CAST(flagged AS DECIMAL(28,2))) AS DOUBLE) AS flagged
  FROM summaries GROUP BY ROLLUP (project_id, contractor_id, cycle_no)""",
)
def portfolio_rollup(spark, sf_dir):
    return history.portfolio_rollup(summaries(spark, sf_dir)).withColumn("level", F.col("level").cast("bigint"))


@query(
    "prior_asof",
    recon("mixed", prior=True)
    + """SELECT project_id, contractor_id, cycle_no, code, prior_billed_qty, billed_qty, billed_qty - prior_billed_qty AS current_period_qty
  FROM recon WHERE prior_billed_qty IS NOT NULL""",
)
def prior_asof(spark, sf_dir):
    return series(spark, sf_dir).filter("prior_billed_qty is not null").select(
        *CYCLE_KEYS, "code", "prior_billed_qty", "billed_qty", "current_period_qty"
    )


@query(
    "prior_from_saved",
    recon("cumulative")
    + """, numbered AS (SELECT project_id, cycle_no, lag(cycle_no) OVER (PARTITION BY project_id ORDER BY cycle_no) AS prior_no,
    lag(first_name) OVER (PARTITION BY project_id ORDER BY cycle_no) AS prior_name
  FROM (SELECT project_id, cycle_no, min(contractor_id) AS first_name FROM lines GROUP BY ALL))
SELECT n.project_id, n.cycle_no, r.code, r.billed_qty AS prior_billed_qty
FROM numbered n JOIN recon r ON r.project_id = n.project_id AND r.cycle_no = n.prior_no AND r.contractor_id = n.prior_name AND r.code IS NOT NULL""",
)
def prior_from_saved(spark, sf_dir):
    """A cycle without contractor compares with the latest earlier cycle of anyone."""
    cycles = star.cycles(spark, sf_dir)
    unnamed = cycles.withColumn("contractor_id", F.lit(None).cast("string")).distinct().select(*cycles.columns)
    both = cycles.unionByName(unnamed.dropDuplicates(list(CYCLE_KEYS)))
    seq = F.coalesce(F.col("contractor_id"), F.lit("~"))
    prior = history.prior_billed(rows_of(spark, sf_dir), both.withColumn("created_at", seq))
    return prior.filter("contractor_id is null").select("project_id", "cycle_no", "code", "prior_billed_qty")


@query(
    "prior_unnamed_in_place",
    recon("cumulative")
    + """, firsts AS (SELECT r_name AS project_id, min(n_name) AS f FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
  numbered AS (SELECT project_id, cycle_no, f, lag(cycle_no) OVER w AS prior_no, lag(coalesce(name, f)) OVER w AS prior_name
    FROM (SELECT project_id, cycle_no, f, min(contractor_id) FILTER (contractor_id <> f) AS name FROM lines JOIN firsts USING (project_id) GROUP BY ALL)
    WINDOW w AS (PARTITION BY project_id ORDER BY cycle_no))
SELECT t.project_id, t.cycle_no, t.code, p.billed_qty AS prior_billed_qty
FROM recon t JOIN numbered n ON t.project_id = n.project_id AND t.cycle_no = n.cycle_no AND t.contractor_id = n.f
JOIN recon p ON p.project_id = t.project_id AND p.cycle_no = n.prior_no AND p.contractor_id = n.prior_name AND p.code = t.code""",
)
def prior_unnamed_in_place(spark, sf_dir):
    """The first contractor of every project is left unnamed: its cycles compare with the
    latest earlier ones, those of the first of the named contractors in them."""
    first = star.links(spark, sf_dir).groupBy("project_id").agg(F.min("contractor_id").alias("__first"))

    def unnamed(df):
        joined = df.join(F.broadcast(first), "project_id")  # a row per project: a shuffle would put a whole project's lines into one task
        return joined.withColumn("contractor_id", F.when(F.col("contractor_id") != F.col("__first"), F.col("contractor_id"))).drop("__first")

    cycles = unnamed(star.cycles(spark, sf_dir)).withColumn("created_at", F.coalesce("contractor_id", F.lit("~")))
    rows = reconcile_series(unnamed(star.activity(spark, sf_dir)), star.contract(spark, sf_dir), cycles)
    return rows.filter("contractor_id is null and prior_billed_qty is not null").select("project_id", "cycle_no", "code", "prior_billed_qty")


@query(
    "cumulative_decrease",
    recon("mixed", prior=True)
    + """SELECT project_id, contractor_id, cycle_no, code, prior_billed_qty, billed_qty FROM recon WHERE contains(rules, 'cumulative_decrease')""",
)
def cumulative_decrease(spark, sf_dir):
    rows = series(spark, sf_dir).filter(F.exists("flags", lambda f: f["rule"] == "cumulative_decrease"))
    return rows.select(*CYCLE_KEYS, "code", "prior_billed_qty", "billed_qty")


@query(
    "next_cycle_no",
    f"WITH {LINES}, {CYCLES}"
    + """SELECT r_name AS project_id, n_name AS contractor_id, coalesce(max(cycle_no), 0) + 1 AS next_cycle_no
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN cycles ON project_id = r_name AND contractor_id = n_name GROUP BY ALL""",
)
def next_cycle_no(spark, sf_dir):
    return history.next_cycle_numbers(star.links(spark, sf_dir), star.cycles(spark, sf_dir))


@query(
    "cycles_by_contractor",
    f"WITH {LINES}, {CYCLES}"
    + """SELECT project_id, CASE WHEN cycle_no = 3 THEN '— Unattributed' ELSE contractor_id END AS contractor, cycle_no,
    CASE WHEN cycle_no = 3 THEN 1 ELSE 0 END AS group_no, TRUE AS has_cycles FROM cycles
  UNION ALL SELECT r_name, n_name, NULL, 0, FALSE FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE NOT EXISTS (SELECT 1 FROM cycles WHERE project_id = r_name AND contractor_id = n_name AND cycle_no <> 3)""",
)
def cycles_by_contractor(spark, sf_dir):
    cycles = star.cycles(spark, sf_dir).withColumn("contractor_id", F.when(F.col("cycle_no") != 3, F.col("contractor_id")))
    out = history.cycles_by_contractor(cycles, star.links(spark, sf_dir), star.contractors(spark, sf_dir))
    return out.select("project_id", "contractor", "cycle_no", "group_no", "has_cycles")


@query(
    "contractor_projects",
    """SELECT n_name AS contractor, r_name AS project FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def contractor_projects(spark, sf_dir):
    out = history.contractor_projects(star.contractors(spark, sf_dir), star.links(spark, sf_dir), star.projects(spark, sf_dir))
    return out.select(F.col("name").alias("contractor"), "project")


@query(
    "project_contractors",
    """SELECT r_name AS project_id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def project_contractors(spark, sf_dir):
    return history.project_contractors(star.links(spark, sf_dir), star.contractors(spark, sf_dir)).select("project_id", "name")


@query(
    "audit_latest",
    """SELECT ts, CAST(user_id AS VARCHAR) AS actor, event_type AS action, 'k=' || json_extract_string(props, '$.k') AS detail
  FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""",
)
def audit_latest(spark, sf_dir):
    log = star.audit_log(spark, sf_dir)
    return history.audit_trail(log, 200).select("ts", "actor", "action", history.detail_text(F.col("detail")).alias("detail"))


# --- review ------------------------------------------------------------------
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log from the order book: every order line touches its unit."""
    return star.decision_events(spark, sf_dir)


_EVENTS = """, decided AS (SELECT project_id, contractor_id, cycle_no, coalesce(code, raw_desc) AS row_key,
    row_number() OVER (PARTITION BY project_id, contractor_id, cycle_no, coalesce(code, raw_desc)
      ORDER BY l_orderkey, l_linenumber) AS seq,
    CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'hold' WHEN 2 THEN 'approve' ELSE 'note' END AS status,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN '' ELSE 'n' || CAST(l_orderkey AS VARCHAR) END AS note
  FROM lines WHERE l_returnflag = 'R'),
folded AS (SELECT e.project_id, e.contractor_id, e.cycle_no, e.row_key,
    arg_max(status, seq) FILTER (status IS NOT NULL) AS status,
    coalesce(arg_max(note, seq) FILTER (status IS NOT NULL AND note IS NOT NULL AND seq > coalesce(cleared, -1)), '') AS note
  FROM decided e JOIN (SELECT project_id, contractor_id, cycle_no, row_key, max(seq) FILTER (status IS NULL) AS cleared, max(seq) AS last_seq
      FROM decided GROUP BY ALL) m USING (project_id, contractor_id, cycle_no, row_key)
  WHERE m.cleared IS NULL OR m.cleared < m.last_seq GROUP BY ALL)
"""


@query("resolutions_fold", recon() + _EVENTS + "SELECT project_id, contractor_id, cycle_no, row_key, status, note FROM folded")
def resolutions_fold(spark, sf_dir):
    return review.fold_resolutions(decisions(spark, sf_dir)).select(*CYCLE_KEYS, "row_key", "status", "note")


@query(
    "open_criticals",
    recon() + _EVENTS + """SELECT project_id, contractor_id, cycle_no, row_key, round(variance, 2) AS variance FROM recon r
  WHERE severity = 'critical' AND NOT EXISTS (SELECT 1 FROM folded f WHERE f.project_id = r.project_id
    AND f.contractor_id = r.contractor_id AND f.cycle_no = r.cycle_no AND f.row_key = r.row_key)""",
)
def open_criticals(spark, sf_dir):
    out = review.open_criticals(rows_of(spark, sf_dir), review.fold_resolutions(decisions(spark, sf_dir)))
    return out.select(*CYCLE_KEYS, "row_key", F.round("variance", 2).alias("variance"))


@query(
    "review_progress",
    recon() + _EVENTS + """SELECT project_id, contractor_id, cycle_no, count(*) FILTER (severity IN ('critical', 'warning')) AS n_flagged,
  count(*) FILTER (severity IN ('critical', 'warning') AND status IS NOT NULL) AS n_reviewed,
  count(*) FILTER (severity = 'critical' AND status IS NULL) AS n_open_criticals
  FROM recon LEFT JOIN folded USING (project_id, contractor_id, cycle_no, row_key) GROUP BY ALL""",
)
def review_progress(spark, sf_dir):
    out = review.review_progress(rows_of(spark, sf_dir), review.fold_resolutions(decisions(spark, sf_dir)))
    return out.drop("n_decreases")


@query(
    "rows_with_resolutions",
    recon() + _EVENTS + """SELECT project_id, contractor_id, cycle_no, row_key, severity, status AS resolution, nullif(note, '') AS resolution_note
  FROM recon LEFT JOIN folded USING (project_id, contractor_id, cycle_no, row_key)""",
)
def rows_with_resolutions(spark, sf_dir):
    out = review.with_resolutions(rows_of(spark, sf_dir), review.fold_resolutions(decisions(spark, sf_dir)))
    return out.select(*CYCLE_KEYS, "row_key", "severity", "resolution", "resolution_note")


_GATES = recon() + _EVENTS + """, counted AS (SELECT y.project_id, y.contractor_id, y.cycle_no, (SELECT count(*) FROM contract) AS n_contract,
    coalesce(b.n_unconfirmed, 0) AS n_unconfirmed, coalesce(q.n_review, 0) AS n_review, coalesce(o.n_open, 0) AS n_open,
    coalesce(b.n_asbuilt, 0) AS n_asbuilt, coalesce(v.n_invoice, 0) AS n_invoice, coalesce(o.n_rows, 0) AS n_rows, coalesce(o.n_critical, 0) AS n_critical
  FROM cycles y
  LEFT JOIN (SELECT project_id, contractor_id, cycle_no, count(*) AS n_asbuilt, count(*) FILTER (l_orderkey IN (SELECT doc_id FROM labels WHERE quality = 0)) AS n_unconfirmed
     FROM lines WHERE l_returnflag <> 'R' GROUP BY ALL) b USING (project_id, contractor_id, cycle_no)
  LEFT JOIN (SELECT project_id, contractor_id, cycle_no, count(*) AS n_invoice FROM lines GROUP BY ALL) v USING (project_id, contractor_id, cycle_no)
  LEFT JOIN (SELECT project_id, contractor_id, cycle_no, count(DISTINCT raw_desc) AS n_review FROM lines WHERE code IS NULL GROUP BY ALL) q USING (project_id, contractor_id, cycle_no)
  LEFT JOIN (SELECT project_id, contractor_id, cycle_no, count(*) AS n_rows, count(*) FILTER (severity = 'critical') AS n_critical,
      count(*) FILTER (severity = 'critical' AND status IS NULL) AS n_open
     FROM recon LEFT JOIN folded USING (project_id, contractor_id, cycle_no, row_key) GROUP BY ALL) o USING (project_id, contractor_id, cycle_no))
"""


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asbuilt = star.asbuilt_with_confidence(spark, sf_dir)
    invoices = star.invoices(spark, sf_dir)
    to_review = invoices.filter("code is null").select(*CYCLE_KEYS, "raw_desc").distinct()
    return review.cycle_counts(
        star.cycles(spark, sf_dir),
        contract=star.contract(spark, sf_dir),
        asbuilt=asbuilt,
        invoices=invoices,
        review=to_review,
        rows=rows_of(spark, sf_dir),
        resolutions=review.fold_resolutions(decisions(spark, sf_dir)),
    )


@query(
    "gates",
    _GATES + """SELECT project_id, contractor_id, cycle_no, g.gate_no AS gate_no, g.gate AS gate, g.ok AS ok, g.detail AS detail FROM (
  SELECT project_id, contractor_id, cycle_no, unnest([
   {'gate_no': 1, 'gate': 'contract', 'ok': n_contract > 0, 'detail': CAST(n_contract AS VARCHAR) || ' contract units'},
   {'gate_no': 2, 'gate': 'confidence', 'ok': n_unconfirmed = 0, 'detail': CASE WHEN n_unconfirmed = 0 THEN 'All built quantities confirmed'
      ELSE CAST(n_unconfirmed AS VARCHAR) || ' extracted row(s) not yet confirmed by a human' END},
   {'gate_no': 3, 'gate': 'crosswalk', 'ok': n_review = 0, 'detail': CASE WHEN n_review = 0 THEN 'Every description is mapped'
      ELSE CAST(n_review AS VARCHAR) || ' description(s) still need review' END},
   {'gate_no': 4, 'gate': 'criticals', 'ok': n_open = 0, 'detail': CASE WHEN n_open = 0 THEN 'No critical items awaiting a decision'
      ELSE CAST(n_open AS VARCHAR) || ' critical item(s) need a hold or approve' END}]) AS g FROM counted)""",
)
def gates(spark, sf_dir):
    return review.gates(stage_counts(spark, sf_dir)).drop("label", "fix_step")


@query(
    "pipeline_progress",
    _GATES + """SELECT project_id, contractor_id, cycle_no, n_contract > 0 AS contract_done, n_asbuilt > 0 AS asbuilt_done, n_invoice > 0 AS invoices_done,
  n_review = 0 AS crosswalk_done, n_rows > 0 AS reconcile_done, n_contract, n_asbuilt, n_invoice, n_review, n_critical FROM counted""",
)
def pipeline_progress(spark, sf_dir):
    return review.progress(stage_counts(spark, sf_dir)).drop("n_mapped")


# The digest in SQL: each row's values spelled with their lengths, hashed, and added in four limbs.
_SPELLED = {"d": "CAST(CAST({c} AS DECIMAL(38,10)) AS VARCHAR)", "s": "CAST({c} AS VARCHAR)"}


def _digest(name: str, keys: str, columns: dict[str, str], source: str) -> str:
    texts = [_SPELLED[kind].format(c=c) for c, kind in columns.items()]
    spelled = " || ".join(f"coalesce(CAST(length({t}) AS VARCHAR) || ':' || {t}, '-')" for t in texts)
    limbs = ", ".join(f"sum(CAST(CAST('0x' || h[{16 * i + 1}:{16 * i + 16}] AS UBIGINT) AS HUGEINT)) AS l{i}" for i in range(4))
    return f"SELECT {keys}, {limbs}, count(*) AS n FROM (SELECT {keys}, sha256('{name}|' || {spelled}) AS h FROM ({source})) GROUP BY {keys}"


_TEXT = " || ".join(f"lpad(printf('%x', CAST(sum(l{i}) % 18446744073709551616 AS UBIGINT)), 16, '0')" for i in range(4))


@query(
    "input_fingerprint",
    f"WITH {LINES}, parts AS ("
    + _digest("asbuilt", "project_id, contractor_id, cycle_no", {"qty": "d", "raw_desc": "s", "uom": "s"}, "SELECT *, NULL AS uom FROM lines WHERE l_returnflag <> 'R'")
    + " UNION ALL "
    + _digest("invoices", "project_id, contractor_id, cycle_no", {"amount": "d", "invoice_id": "s", "qty": "d", "raw_desc": "s"}, "SELECT *, CAST(l_orderkey AS VARCHAR) AS invoice_id FROM lines")
    + f") SELECT project_id, contractor_id, cycle_no, {_TEXT} AS fingerprint, CAST(sum(n) AS BIGINT) AS n_inputs FROM parts GROUP BY ALL",
)
def input_fingerprint(spark, sf_dir):
    """The digest of every cycle's lines."""
    parts = {
        "asbuilt": star.asbuilt(spark, sf_dir).select(*CYCLE_KEYS, "raw_desc", "qty", "uom"),
        "invoices": star.invoices(spark, sf_dir).select(*CYCLE_KEYS, "invoice_id", "raw_desc", "qty", "amount"),
    }
    return review.fingerprint(parts)


@query(
    "approval_head",
    recon("mixed", prior=True) + f", totals AS ({_TOTALS})"
    + """SELECT project_id, contractor_id, cycle_no, net_recommended, flagged_over_billing, retainage_held, n_critical, n_warning, n_ok,
  n_critical + n_warning AS n_flagged, greatest(n_critical + n_warning - 18, 0) AS n_more FROM totals""",
)
def approval_head(spark, sf_dir):
    return review.approval_head(cycle_totals(spark, sf_dir))


@query(
    "export_state",
    _GATES + """SELECT project_id, contractor_id, cycle_no, n_blocking, CASE WHEN n_blocking > 0 AND cycle_no % 2 = 0 THEN 'paying the uncontested part' END AS reason,
  n_blocking > 0 AND cycle_no % 2 = 0 AS overridden, n_blocking > 0 AND cycle_no % 2 <> 0 AS locked
  FROM (SELECT project_id, contractor_id, cycle_no, CAST(CAST(n_contract = 0 AS INTEGER) + CAST(n_unconfirmed > 0 AS INTEGER) + CAST(n_review > 0 AS INTEGER) + CAST(n_open > 0 AS INTEGER) AS BIGINT) AS n_blocking FROM counted)""",
)
def export_state(spark, sf_dir):
    """Overrides with a reason for even cycles and a blank one, which is none, for odd."""
    given = star.cycles(spark, sf_dir).select(
        *CYCLE_KEYS,
        F.when(F.col("cycle_no") % 2 == 0, " paying the uncontested part ").otherwise(" ").alias("reason"),
        F.lit("me").alias("by"),
        F.lit("2025-07-01 10:00").alias("at"),
    )
    return review.export_state(review.gates(stage_counts(spark, sf_dir)), given).drop("override_by", "override_at")


@query(
    "confidence_kinds",
    f"WITH {LINES}" + """SELECT project_id, contractor_id, cycle_no, string_agg(DISTINCT confidence, ',' ORDER BY confidence) AS kinds FROM (
  SELECT *, CASE WHEN l_orderkey IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'annot' ELSE 'sum' END AS confidence
  FROM lines WHERE l_returnflag <> 'R') GROUP BY project_id, contractor_id, cycle_no""",
)
def confidence_kinds(spark, sf_dir):
    out = history.confidence_kinds(star.asbuilt_with_confidence(spark, sf_dir))
    return out.select(*CYCLE_KEYS, F.array_join("kinds", ",").alias("kinds"))
