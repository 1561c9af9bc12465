import pytest
from pyspark.sql import functions as F

import golden
from tallyline.operators import history, review, totals
from tallyline.operators.reconcile import reconcile
from tallyline.schemas import BILLING_CYCLE, INVOICE_LINE, RESOLUTION_EVENT
from tallyline.sources.tables import Store, cycle_detail, flags_from_json, flags_to_json
from tallyline.streaming import intake


def cycles_df(spark, keys, label="Jul"):
    return spark.createDataFrame([(*k, label, "cumulative", 10.0, 0.0, "draft", None) for k in keys], BILLING_CYCLE)


def golden_rows(spark, key=golden.KEY, billed=golden.BILLED):
    return reconcile(golden.asbuilt_df(spark, key=key), golden.invoice_df(spark, billed, key=key), golden.contract_df(spark))


def test_saving_twice_gives_one_cycle_with_the_last_label(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    other = ("P1", None, 1)
    for label in ("Jun", "Jul"):
        rows = golden_rows(spark).unionByName(golden_rows(spark, other, golden.BILLED[:2]))
        store.save_snapshot(rows, golden.contract_df(spark), cycles_df(spark, [golden.KEY, other], label), actor="me")
    saved = store.cycles().collect()
    assert sorted((r.contractor_id or "", r.period_label) for r in saved) == [("", "Jul"), ("C1", "Jul")]
    assert store.results().count() == 8 + 7 + 0
    assert [r.code for r in store.cycle_results(*golden.KEY).collect()][:2] == [None, "3.1"]
    assert store.registered("contractor").count() == 1 and store.registered("project_contractor").count() == 1
    assert store.contract("P1").count() == 11
    assert store.audit().count() == 4
    # one cycle saved again leaves the other alone
    store.save_results(golden_rows(spark, other, golden.BILLED[:1]))
    assert store.cycle_results(*golden.KEY).count() == 8


def test_summary_and_detail_from_saved_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    log = spark.createDataFrame([(*golden.KEY, "3.1", 1, "hold", "ask", "me", "2025-07-01 10:00")], RESOLUTION_EVENT)
    decided = review.fold_resolutions(log)
    store.save_snapshot(golden_rows(spark), golden.contract_df(spark), cycles_df(spark, [golden.KEY]), decided)
    s = history.cycle_summaries(store.cycles(), store.results()).collect()[0]
    assert (s.billed, s.expected, s.flagged, s.n_critical) == (390010.0, 357792.0, 35408.0, 3)
    assert s.net == pytest.approx(315601.0) and s.retainage == pytest.approx(39001.0)
    back = {r.row_key: r for r in cycle_detail(store.results()).collect()}
    assert back["3.1"].flags[0].rule == "qty_over" and back["3.1"].qty_delta == 2580
    assert (back["3.1"].resolution, back["3.1"].resolution_note) == ("hold", "ask")
    text = store.results().select(flags_to_json(F.col("flags")).alias("j"), "flags")
    assert text.filter(flags_from_json(F.col("j")) == F.col("flags")).count() == 8


def test_reports_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = golden_rows(spark)
    store.write_reports(rows, totals.cycle_totals(rows))
    read = {n: spark.read.option("header", True).csv(store.path(f"reports/{n}")) for n in ("summary", "flagged", "detail", "unmatched")}
    assert {n: d.count() for n, d in read.items()} == {"summary": 8, "flagged": 5, "detail": 8, "unmatched": 1}


def test_stream_saves_the_same_cycles_as_a_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    inbox = str(tmp_path / "inbox")
    lines = golden.invoice_df(spark)
    lines.filter("line_no < 4").coalesce(1).write.mode("append").parquet(inbox)
    run = lambda: intake.keep_cycles_current(
        intake.invoice_stream(spark, inbox), store, golden.asbuilt_df(spark), golden.contract_df(spark),
        checkpoint=str(tmp_path / "progress"), available_now=True).awaitTermination(120)
    run()
    lines.coalesce(1).write.mode("append").parquet(inbox)  # the rest, and four lines again
    run()
    want = golden_rows(spark).select("code", "built_qty", "billed_qty", "variance", "severity").orderBy("code").collect()
    assert store.results().select("code", "built_qty", "billed_qty", "variance", "severity").orderBy("code").collect() == want


def test_many_batches_equal_one_and_fold_into_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    inbox = str(tmp_path / "inbox")
    lines = golden.invoice_df(spark).unionByName(golden.invoice_df(spark).withColumn("contractor_id", F.lit("C2")).filter("line_no < 6")).cache()
    built = golden.asbuilt_df(spark).unionByName(golden.asbuilt_df(spark, key=("P1", "C2", golden.KEY[2])))
    modes = lines.select("project_id", "contractor_id", "cycle_no").distinct().withColumn("billing_mode", F.when(F.col("contractor_id") == "C2", "discrete").otherwise("cumulative"))
    for i in range(6):  # each batch sends one line again
        lines.filter(f"line_no in ({i}, {i - 1}, {i + 6})").coalesce(1).write.mode("append").parquet(inbox)
        intake.keep_cycles_current(
            intake.invoice_stream(spark, inbox), store, built, golden.contract_df(spark), cycles=modes, batches_kept=2,
            checkpoint=str(tmp_path / "progress"), available_now=True).awaitTermination(120)
    want = reconcile(built, lines, golden.contract_df(spark), cycles=modes)
    shown = ["contractor_id", "code", "built_qty", "billed_qty", "billed_price", "variance", "severity"]
    assert sorted(map(repr, store.results().select(*shown).collect())) == sorted(map(repr, want.select(*shown).collect()))
    for name in (intake.LINES, intake.STATES):
        folders = [f for f in (tmp_path / "store" / name).rglob("batch_id=*") if f.is_dir()]
        assert 1 <= len(folders) <= 3, folders
    stored = store.batches(intake.LINES, INVOICE_LINE)
    assert stored.count() == lines.filter("line_no < 12").count()


def test_the_prior_is_read_from_the_prior_partitions_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for n in range(4):
        for project in ("P1", "P2"):
            store.save_results(golden_rows(spark, (project, "C1", n)))
    touched = spark.createDataFrame([("P1", "C1", 4, 9)], "project_id string, contractor_id string, cycle_no int, batch_id bigint")
    store.overwrite(touched, intake.TOUCHED)
    read = store.read(intake.TOUCHED, "project_id string, contractor_id string, cycle_no int, batch_id bigint").filter("batch_id = 9").drop("batch_id")
    prior = intake.prior_of(store, read, read, 9)
    rows = prior.collect()
    assert {(r.project_id, r.cycle_no) for r in rows} == {("P1", 4)} and len(rows) == 7
    assert "dynamicpruning" in prior._jdf.queryExecution().executedPlan().toString()


def test_decisions_survive_lines_that_arrive_later(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    inbox = str(tmp_path / "inbox")
    lines = golden.invoice_df(spark)
    log = spark.createDataFrame([(*golden.KEY, "3.1", 1, "hold", "ask", "me", "2025-07-01 10:00")], RESOLUTION_EVENT)
    store.save_results(golden_rows(spark), review.fold_resolutions(log))
    store.save_results(golden_rows(spark))  # a save without decisions keeps them
    lines.coalesce(1).write.mode("append").parquet(inbox)
    intake.keep_cycles_current(
        intake.invoice_stream(spark, inbox), store, golden.asbuilt_df(spark), golden.contract_df(spark),
        checkpoint=str(tmp_path / "progress"), available_now=True).awaitTermination(120)
    kept = {r.code: (r.resolution, r.resolution_note, r.resolved_by) for r in store.results().collect()}
    assert kept["3.1"] == ("hold", "ask", "me") and sum(v[0] is not None for v in kept.values()) == 1


def test_stream_follows_the_billing_mode_and_the_prior_cycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    inbox = str(tmp_path / "inbox")
    first = golden_rows(spark)
    store.save_results(first)
    later = golden.invoice_df(spark).withColumn("cycle_no", F.col("cycle_no") + 1)
    built = golden.asbuilt_df(spark).withColumn("cycle_no", F.col("cycle_no") + 1)
    cycles = later.select("project_id", "contractor_id", "cycle_no").distinct().withColumn("billing_mode", F.lit("cumulative"))
    later.coalesce(1).write.mode("append").parquet(inbox)
    before = first.select("code", F.col("billed_qty").alias("was")).filter("code is not null")
    intake.keep_cycles_current(
        intake.invoice_stream(spark, inbox), store, built, golden.contract_df(spark), cycles=cycles,
        checkpoint=str(tmp_path / "progress"), available_now=True).awaitTermination(120)
    number = later.first().cycle_no
    saved = store.results().filter(F.col("cycle_no") == number)
    assert saved.join(before, "code").filter("billed_qty = was").count() == before.count()
    assert {c.cycle_no for c in store.results().select("cycle_no").distinct().collect()} == {number - 1, number}


def test_stream_drops_repeats_within_the_horizon(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    golden.invoice_df(spark).coalesce(1).write.mode("append").parquet(inbox)
    golden.invoice_df(spark).coalesce(1).write.mode("append").parquet(inbox)
    q = intake.first_arrivals(intake.invoice_stream(spark, inbox)).writeStream.format("memory").queryName("firsts").option(
        "checkpointLocation", intake.checkpoint_folder(spark, "firsts", str(tmp_path / "progress"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 8


def test_the_checkpoint_folder_is_that_of_the_session(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        assert intake.checkpoint_folder(spark, "x") == f"{given.rstrip('/')}/x"
    else:
        with pytest.raises(ValueError):
            intake.checkpoint_folder(spark, "x")
    assert intake.checkpoint_folder(spark, "x", "/shared/") == "/shared/x"
