import pytest
from pyspark.sql import functions as F

import golden
from tallyline.operators import contract as co
from tallyline.operators import history, review, totals
from tallyline.operators.reconcile import reconcile
from tallyline.plans.cycle import reconcile_with_changes
from tallyline.operators.rollup import activity
from tallyline.schemas import ALIAS, BILLING_CYCLE, CYCLE_KEYS, RECON_RESULT, RESOLUTION_EVENT

KEYS = "project_id string, contractor_id string, cycle_no int"


@pytest.fixture(scope="module")
def rows(spark):
    return reconcile(golden.asbuilt_df(spark), golden.invoice_df(spark), golden.contract_df(spark)).cache()


def saved(spark, entries):
    """(project, contractor, cycle, code, billed qty, billed amount, expected, variance, severity)"""
    full = [(p, c, n, code, code, "EA", 0.0, q, 1.0, 1.0, 0.0, b, e, v, s, [], None, None, None, None) for p, c, n, code, q, b, e, v, s in entries]
    return spark.createDataFrame(full, RECON_RESULT)


def cycles(spark, keys):
    return spark.createDataFrame([(*k, f"P{k[2]}", "cumulative", 10.0, 0.0, "saved", None) for k in keys], BILLING_CYCLE).withColumn("created_at", F.lit(None).cast("int"))


def test_totals(rows):
    t = totals.cycle_totals(rows).collect()[0]
    assert (t.total_billed, t.total_expected, t.flagged_over_billing) == (390010.0, 357792.0, 35408.0)
    assert (t.n_critical, t.n_warning, t.n_ok) == (3, 2, 3)
    assert t.retainage_held == pytest.approx(39001.0) and t.net_recommended == pytest.approx(315601.0)


def test_change_orders(spark):
    orders = golden.contract_df(spark, [("4.1", 'Directional bore 2"', "FT", 10.25, 6000.0), ("10.1", "Traffic", "EA", 650.0, 0.0)])
    act = activity(golden.asbuilt_df(spark), golden.invoice_df(spark))
    t = totals.cycle_totals(reconcile_with_changes(act, golden.contract_df(spark), orders)).collect()[0]
    assert (t.flagged_over_billing, t.n_critical) == (30773.0, 2)
    items = {r.code: r for r in co.apply_change_orders(golden.contract_df(spark), orders).collect()}
    assert len(items) == 12 and items["4.1"].is_change_order and not items["3.1"].is_change_order and items["10.1"].added_by_order == 1


@pytest.mark.parametrize(
    "actual, ok, message",
    [(None, True, "Contract retainage 10% → $10,000.00 withheld this cycle."), (10000.5, True, "Retainage matches contract (10%): $10,000.50 withheld."),
     (7500.0, False, "Retainage under-withheld by $2,500.00 — invoice withheld $7,500.00, contract 10% = $10,000.00."),
     (12000.0, False, "Retainage over-withheld by $2,000.00 — invoice withheld $12,000.00, contract 10% = $10,000.00.")])
def test_retainage(spark, actual, ok, message):
    df = spark.createDataFrame([(100000.0, 10.0, actual)], "total_billed double, retainage_pct double, actual_retainage double")
    r = totals.check_retainage(df).collect()[0]
    assert (r.retainage_ok, r.retainage_message) == (ok, message)


def test_prior_follows_the_contractor_and_skips_nothing(spark):
    results = saved(spark, [("P", "A", 1, "X", 100.0, 0.0, 0.0, 0.0, "ok"), ("P", "B", 1, "X", 40.0, 0.0, 0.0, 0.0, "ok"), ("P", "A", 2, "Y", 7.0, 0.0, 0.0, 0.0, "ok")])
    known = cycles(spark, [("P", "A", 1), ("P", "B", 1), ("P", "A", 2), ("P", "A", 3), ("P", "B", 5), ("P", None, 2)])
    got = {(r.contractor_id, r.cycle_no, r.code): r.prior_billed_qty for r in history.prior_billed(results, known).collect()}
    assert got == {("A", 2, "X"): 100.0, ("A", 3, "Y"): 7.0, ("B", 5, "X"): 40.0, (None, 2, "X"): 100.0}


@pytest.mark.parametrize("billed, period, warned", [(250.0, 150.0, False), (80.0, -20.0, True)])
def test_current_period_and_decrease(spark, billed, period, warned):
    prior = spark.createDataFrame([(*golden.KEY, "X", 100.0)], KEYS + ", code string, prior_billed_qty double")
    contract = golden.contract_df(spark, [("X", "x", "EA", 1.0, 0.0)])
    row = reconcile(golden.asbuilt_df(spark, [("X", billed)], uoms={"X": "EA"}), golden.invoice_df(spark, [("X", billed, 1.0)]), contract, prior=prior).collect()[0]
    assert row.current_period_qty == period and ("cumulative_decrease" in [f.rule for f in row.flags]) is warned


def test_trend_summaries_portfolio_and_next_number(spark):
    known = cycles(spark, [("P", "A", 1), ("P", "A", 2), ("P", None, 3)])
    results = saved(spark, [("P", "A", 1, "X", 1.0, 1000.0, 1000.0, 0.0, "ok"), ("P", "A", 2, "X", 1.0, 3000.0, 2500.0, 500.0, "critical")])
    t = {r.cycle_no: (r.built_value, r.billed_value) for r in history.trend(known, results).collect()}
    assert t == {1: (1000.0, 1000.0), 2: (2500.0, 3000.0), 3: (None, None)}
    summaries = history.cycle_summaries(known, results)
    assert {r.cycle_no: r.net for r in summaries.collect()} == {1: 900.0, 2: 2200.0, 3: 0.0}
    projects = spark.createDataFrame([("P", "P", None), ("Q", "Q", "closed")], "project_id string, name string, status string")
    links = spark.createDataFrame([("P", "A"), ("P", "B")], "project_id string, contractor_id string")
    stats = {r.project_id: r for r in history.portfolio_stats(projects, links, summaries).collect()}
    assert (stats["P"].n_cycles, stats["P"].billed, stats["P"].flagged, stats["P"].latest_period, stats["P"].latest_to_date) == (3, 4000.0, 500.0, "P3", 3000.0)
    assert (stats["Q"].n_cycles, stats["Q"].billed, stats["P"].status) == (0, 0.0, "active")
    kpi = history.portfolio_kpis(history.portfolio_stats(projects, links, summaries), links).collect()[0]
    assert (kpi.n_projects, kpi.n_active, kpi.n_contractors, kpi.n_cycles, kpi.billed) == (2, 1, 2, 3, 4000.0)
    assert {r.contractor_id: r.next_cycle_no for r in history.next_cycle_numbers(links, known).collect()} == {"A": 3, "B": 1}
    names = spark.createDataFrame([("A", "A"), ("B", "B")], "contractor_id string, name string")
    grouped = [(r.contractor, r.cycle_no, r.has_cycles) for r in history.cycles_by_contractor(known, links, names).orderBy("group_no", "contractor", "cycle_no").collect()]
    assert grouped == [("A", 1, True), ("A", 2, True), ("B", None, False), ("— Unattributed", 3, True)]
    page = history.project_overview("P", projects, links, names, known, results)
    assert [r.cycle_no for r in page["cycles"].collect()] == [1, 2, 3] and page["header"].collect()[0].built == 3500.0


def test_resolutions_keep_and_clear_notes(spark):
    log = [("a", 1, "hold", "first"), ("a", 2, "approve", None), ("b", 1, "hold", "x"), ("b", 2, "hold", ""), ("c", 1, "hold", "x"), ("c", 2, None, None),
           ("d", 1, "hold", "old"), ("d", 2, None, None), ("d", 3, "note", None)]
    events = spark.createDataFrame([(*golden.KEY, k, s, st, n, None, "t") for k, s, st, n in log], RESOLUTION_EVENT)
    got = {r.row_key: (r.status, r.note, r.by) for r in review.fold_resolutions(events).collect()}
    assert got == {"a": ("approve", "first", ""), "b": ("hold", "", ""), "d": ("note", "", "")}


def decide(spark, *keys):
    events = spark.createDataFrame([(*golden.KEY, k, 1, "hold", "why", "me", "t") for k in keys], RESOLUTION_EVENT)
    return review.fold_resolutions(events)


def test_gates_one_by_one(spark, rows):
    one = spark.createDataFrame([golden.KEY], KEYS)
    args = dict(contract=golden.contract_df(spark), asbuilt=golden.asbuilt_df(spark), invoices=golden.invoice_df(spark), rows=rows)
    everything = decide(spark, "3.1", "4.1", golden.TRAFFIC)

    def closed(**kw):
        counts = review.cycle_counts(one, **{**args, "resolutions": everything, **kw})
        return [r.gate for r in review.blocking(review.gates(counts)).collect()]

    assert closed() == []
    assert closed(contract=golden.contract_df(spark).limit(0)) == ["contract"]
    assert closed(asbuilt=golden.asbuilt_df(spark).withColumn("confidence", F.lit("annot"))) == ["confidence"]
    assert closed(review=one.withColumn("raw_desc", F.lit("?"))) == ["crosswalk"]
    assert closed(resolutions=decide(spark, "3.1", "4.1")) == ["criticals"]
    counts = review.cycle_counts(one, **args, resolutions=decide(spark, "3.1"))
    detail = {r.gate: r.detail for r in review.gates(counts).collect()}
    assert detail["criticals"] == "2 critical item(s) need a hold or approve" and detail["contract"] == "11 contract units"
    done = review.progress(counts).collect()[0]
    assert done.contract_done and done.crosswalk_done and done.reconcile_done and done.n_critical == 3


def test_packet_filters_and_progress(spark, rows):
    packet = review.approval_rows(rows, decide(spark, "3.1"), top=2).orderBy("position").collect()
    assert [(r.code, r.severity, r.resolution) for r in packet] == [("—", "CRITICAL", "OPEN"), ("3.1", "CRITICAL", "HOLD — why")]
    assert "; " in packet[1].finding
    head = review.approval_head(totals.cycle_totals(rows), top=2).collect()[0]
    assert (head.n_flagged, head.n_more) == (5, 3)
    assert [review.with_severity(rows, c).count() for c in ("all", "critical", "warning", "ok")] == [8, 3, 2, 3]
    p = review.review_progress(rows, decide(spark, "3.1", "5.1")).collect()[0]
    assert (p.n_flagged, p.n_reviewed, p.n_open_criticals, p.n_decreases) == (5, 2, 2, 0)


def test_fingerprint_changes_with_any_input_but_not_with_order(spark):
    def print_of(b):
        return review.fingerprint({"invoices": b.select(*CYCLE_KEYS, "raw_desc", "qty"), "built": golden.asbuilt_df(spark).select(*CYCLE_KEYS, "raw_desc", "qty")})

    b = golden.invoice_df(spark)
    same = print_of(b.orderBy(F.rand(1)).repartition(3))
    assert review.changed_cycles(print_of(b), same).count() == 0
    assert review.changed_cycles(print_of(b), print_of(b.withColumn("qty", F.when(F.col("line_no") == 3, 1.0).otherwise(F.col("qty"))))).count() == 1
    assert review.changed_cycles(print_of(b), print_of(b.unionByName(b.limit(1)))).count() == 1


def test_aliases_and_audit(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2025, 1, d)
    known = spark.createDataFrame([("bore", "4.1", None, None, at(1)), ("pole", "8.1", None, None, at(2))], ALIAS)
    new = spark.createDataFrame([("bore", "4.2", None, "me", at(3))], ALIAS)
    merged = history.alias_upsert(known, new)
    assert {(r.normalized_desc, r.code) for r in merged.collect()} == {("bore", "4.2"), ("pole", "8.1")}
    assert [r.code for r in history.alias_forget(merged, new).collect()] == ["8.1"]
    log = spark.createDataFrame([(at(1), 1, "a"), (at(2), 2, "b"), (at(2), 3, "c")], "ts timestamp, seq bigint, action string")
    assert [r.action for r in history.audit_trail(log, 2).collect()] == ["c", "b"]
