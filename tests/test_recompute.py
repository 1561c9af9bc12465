import pytest
from pyspark.sql import functions as F

import golden
from tallyline.operators import review
from tallyline.operators.reconcile import reconcile
from tallyline.plans.recompute import recompute, save_feed
from tallyline.schemas import CYCLE_KEYS
from tallyline.sources.tables import Store

KEYS = [("P1", "C1", 1), ("P1", None, 1), ("P2", "C1", 4)]
SHOWN = ("project_id", "contractor_id", "cycle_no", "code", "built_qty", "billed_qty", "variance", "severity")


def feeds(spark, keys=KEYS):
    built, billed = golden.asbuilt_df(spark, key=keys[0]), golden.invoice_df(spark, key=keys[0])
    for k in keys[1:]:
        built, billed = built.unionByName(golden.asbuilt_df(spark, key=k)), billed.unionByName(golden.invoice_df(spark, key=k))
    return built, billed


@pytest.fixture
def setting(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    built, billed = feeds(spark)
    save_feed(store, "asbuilt", built)
    save_feed(store, "invoices", billed)
    contract = golden.contract_df(spark)
    contract = contract.unionByName(contract.withColumn("project_id", F.lit("P2")))
    cycles = spark.createDataFrame([(*k, "cumulative", 10.0) for k in KEYS], "project_id string, contractor_id string, cycle_no int, billing_mode string, retainage_pct double")
    return store, contract, cycles, tmp_path / "store"


def spoil(folder):
    """Files that fail when they are opened."""
    n = 0
    for f in folder.rglob("*.parquet"):
        f.write_bytes(b"spoilt")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        n += 1
    assert n


def test_an_unchanged_run_reads_no_feed(spark, setting):
    store, contract, cycles, folder = setting
    assert recompute(store, contract, cycles) == 3
    built, billed = feeds(spark)
    want = sorted(map(repr, reconcile(built, billed, contract).select(*SHOWN).collect()))
    assert sorted(map(repr, store.results().select(*SHOWN).collect())) == want
    for name in ("asbuilt", "invoices"):
        spoil(folder / name)
    assert recompute(store, contract, cycles) == 0


def test_only_the_changed_cycle_is_opened(spark, setting):
    store, contract, cycles, folder = setting
    assert recompute(store, contract, cycles) == 3
    changed = golden.invoice_df(spark, key=KEYS[0]).withColumn("qty", F.when(F.col("line_no") == 1, F.col("qty") + 1).otherwise(F.col("qty")))
    save_feed(store, "invoices", changed)
    for name in ("asbuilt", "invoices"):
        spoil(folder / name / "project_id=P2")
        spoil(folder / name / "project_id=P1" / "contractor_id=__HIVE_DEFAULT_PARTITION__")
    assert recompute(store, contract, cycles) == 1
    want = reconcile(golden.asbuilt_df(spark, key=KEYS[0]), changed, contract).select(*SHOWN)
    assert sorted(map(repr, store.cycle_results(*KEYS[0]).select(*SHOWN).collect())) == sorted(map(repr, want.collect()))


def test_every_kind_of_input_counts(spark, setting):
    store, contract, cycles, _ = setting
    marks = {"marks": spark.createDataFrame([("P1", "flagging")], "project_id string, raw_desc string"), "aliases": spark.createDataFrame([("a", "1")], "text string, code string")}
    assert recompute(store, contract, cycles, marks) == 3
    assert recompute(store, contract, cycles, marks) == 0
    assert recompute(store, contract, cycles, marks | {"marks": marks["marks"].withColumn("raw_desc", F.lit("x"))}) == 2
    assert recompute(store, contract, cycles, marks | {"aliases": marks["aliases"].unionByName(marks["aliases"])}) == 3
    again = cycles.withColumn("retainage_pct", F.when(F.col("project_id") == "P2", 5.0).otherwise(F.col("retainage_pct")))
    recompute(store, contract, cycles, marks)
    assert recompute(store, contract, again, marks) == 1
    dearer = contract.withColumn("unit_price", F.when((F.col("project_id") == "P1") & (F.col("code") == "3.1"), 9.0).otherwise(F.col("unit_price")))
    assert recompute(store, dearer, again, marks) == 2


def test_a_later_cycle_is_due_when_its_prior_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    keys = [("P1", "C1", 1), ("P1", "C1", 2)]
    built, billed = feeds(spark, keys)
    save_feed(store, "asbuilt", built)
    save_feed(store, "invoices", billed)
    cycles = spark.createDataFrame([(*k, "cumulative") for k in keys], "project_id string, contractor_id string, cycle_no int, billing_mode string")
    runs = []
    while not runs or runs[-1]:
        runs.append(recompute(store, golden.contract_df(spark), cycles))
    assert runs == [2, 1, 0]


def test_digests_do_not_confuse_values(spark):
    one = spark.createDataFrame([("P", "C", 1, "a", None)], "project_id string, contractor_id string, cycle_no int, x string, y string")
    prints = {review.fingerprint({"p": one.withColumn("x", x).withColumn("y", y)}).first().fingerprint for x, y in [
        (F.lit("a"), F.lit(None).cast("string")), (F.lit(None).cast("string"), F.lit("a")), (F.lit("a"), F.lit("")), (F.lit("a-"), F.lit(None).cast("string")), (F.lit("1:a"), F.lit("-"))]}
    assert len(prints) == 5 and all(len(p) == 64 for p in prints)
    assert review.fingerprint({"p": one}).select(*CYCLE_KEYS).count() == 1
