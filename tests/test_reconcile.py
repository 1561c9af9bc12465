import pytest
from pyspark.sql import functions as F

import golden
from tallyline.config import Rules
from tallyline.operators.reconcile import in_exposure_order, reconcile
from tallyline.operators.rollup import joined_in_parts, references
from tallyline.schemas import ASBUILT_LINE, CONTRACT_ITEM, CYCLE_KEYS, INVOICE_LINE


@pytest.fixture(scope="module")
def rows(spark):
    out = reconcile(golden.asbuilt_df(spark), golden.invoice_df(spark), golden.contract_df(spark))
    return in_exposure_order(out).collect()


def by(rows, code):
    return next(r for r in rows if r.code == code)


def rules_of(row):
    return [f.rule for f in row.flags]


@pytest.mark.parametrize(
    "code, variance, rules, severity",
    [
        ("3.1", 4773.0, ["qty_over", "over_run"], "critical"),
        ("4.1", 4635.0, ["price_over", "over_run"], "critical"),
        (None, 26000.0, ["no_contract", "qty_over", "unmatched"], "critical"),
        ("5.1", 0.0, ["over_run"], "warning"),
        ("6.1", 0.0, ["over_run"], "warning"),
        ("9.1", -3190.0, ["under_billed"], "info"),
        ("4.2", 0.0, [], "ok"),
        ("8.1", 0.0, [], "ok"),
    ],
)
def test_golden_units(rows, code, variance, rules, severity):
    row = by(rows, code)
    assert row.variance == pytest.approx(variance)
    assert rules_of(row) == rules
    assert row.severity == severity


def test_units_without_activity_give_no_row(rows):
    assert len(rows) == 8
    assert not {"3.2", "5.2", "6.2", "7.1"} & {r.code for r in rows}


def test_order_is_severity_then_exposure(rows):
    assert [r.code for r in rows] == [None, "3.1", "4.1", "5.1", "6.1", "9.1", "4.2", "8.1"]


def test_messages(rows):
    assert by(rows, "3.1").flags[0].message == "Billed qty exceeds built by 2,580 FT (tolerance ±826.4)"
    assert by(rows, "4.1").flags[0].message == "Unit price $10.25 over contract $9.50 (+$0.75/unit)"
    assert by(rows, "5.1").flags[0].message == "Over-run vs bid estimate (+3 over 55)"
    assert by(rows, None).description == golden.TRAFFIC


def one(spark, built, billed, price=1.0, uom="FT", mode="cumulative", est=0.0, contract=True, rules=None):
    k = golden.KEY
    a = spark.createDataFrame(
        [(*k, i, "X", float(q), u, None, "X", None, None, "sum") for i, (q, u) in enumerate(built)], ASBUILT_LINE)
    b = spark.createDataFrame(
        [(*k, i, "I", "X", float(q), float(p), float(am), None, True, "X", None, None) for i, (q, p, am) in enumerate(billed)],
        INVOICE_LINE)
    c = spark.createDataFrame([("P1", "X", "x", uom, float(price), est, False, None, 0)] if contract else [], CONTRACT_ITEM)
    return reconcile(a, b, c, rules=rules or Rules(billing_mode=mode)).collect()[0]


@pytest.mark.parametrize(
    "uom, built, billed, over",
    [
        ("FT", 1000, 1040, False), ("FT", 1000, 1060, True), ("FT", 10000, 10150, False),
        ("FT", 10000, 10250, True), ("EA", 58, 59, True), ("EA", 58, 58, False), ("FT", 500, -50, False),
    ],
)
def test_tolerance(spark, uom, built, billed, over):
    row = one(spark, [(built, uom)], [(billed, 1.0, billed)], uom=uom)
    assert ("qty_over" in rules_of(row)) is over


def test_cumulative_takes_the_largest_line_and_discrete_the_sum(spark):
    billed = [(100, 2.0, 200), (250, 2.0, 500)]
    assert one(spark, [(250, "FT")], billed).billed_qty == 250
    row = one(spark, [(250, "FT")], billed, mode="discrete")
    assert (row.billed_qty, row.billed_price) == (350, 2.0)


def test_cumulative_tie_takes_the_first_line(spark):
    row = one(spark, [(10, "EA")], [(10, 3.0, 30), (10, 9.0, 90)], uom="EA")
    assert row.billed_price == 3.0


def test_zero_amount_falls_back_to_the_product_and_zero_qty_to_the_first_price(spark):
    assert one(spark, [(1, "EA")], [(4, 2.5, 0)], uom="EA").billed_amount == 10.0
    row = one(spark, [(1, "EA")], [(0, 7.0, 50)], uom="EA")
    assert (row.billed_price, row.billed_amount) == (7.0, 0.0)


def test_price_over_is_critical_inside_the_quantity_band(spark):
    row = one(spark, [(1000, "FT")], [(1010, 10.0, 10100)], price=9.5)
    assert row.severity == "critical" and "price_over" in rules_of(row)


def test_hundreds_of_feet(spark):
    row = one(spark, [(3, "100FT")], [(3, 40.0, 120)], price=40.0, uom="100FT")
    assert (row.built_qty, row.billed_qty, row.uom) == (300.0, 3.0, "FT")
    fixed = one(spark, [(3, "100FT")], [(3, 40.0, 120)], price=40.0, uom="100FT", rules=Rules(convert_billed_hundreds=True))
    assert (fixed.built_qty, fixed.billed_qty, fixed.contract_price) == (300.0, 300.0, 0.4)
    assert fixed.variance == pytest.approx(0.0)


def test_unmatched_descriptions_stay_apart(spark):
    k = golden.KEY
    b = spark.createDataFrame(
        [(*k, i, "I", d, 1.0, p, p, None, True, None, None, None) for i, (d, p) in enumerate([("Flagging", 26000.0), ("Standby ", 63345.0), ("standby", 63345.0)])],
        INVOICE_LINE)
    out = reconcile(golden.asbuilt_df(spark).limit(0), b, golden.contract_df(spark)).collect()
    assert sorted(r.billed_amount for r in out) == [26000.0, 63345.0]


def test_code_outside_the_contract_is_not_unmatched(spark):
    row = one(spark, [(1, "EA")], [(1, 5.0, 5)], contract=False)
    assert rules_of(row) == ["no_contract"] and row.contract_price is None and row.expected_amount == 0


def test_last_duplicate_contract_code_counts(spark):
    items = [("X", "old", "EA", 1.0, 0.0), ("X", "new", "EA", 2.0, 0.0)]
    out = reconcile(
        golden.asbuilt_df(spark, [("X", 1)], uoms={"X": "EA"}), golden.invoice_df(spark, [("X", 1, 2.0)]), golden.contract_df(spark, items))
    assert out.collect()[0].description == "new"


def test_partitioning_does_not_change_the_result(spark):
    a, b, c = golden.asbuilt_df(spark), golden.invoice_df(spark), golden.contract_df(spark)
    one_way = reconcile(a.repartition(1), b.repartition(7), c).orderBy("unit_key").collect()
    other = reconcile(a.orderBy(F.rand(3)), b.repartition(3, "qty"), c.repartition(5)).orderBy("unit_key").collect()
    assert one_way == other


def test_many_cycles_equal_one_at_a_time(spark):
    keys = [("P1", "C1", 1), ("P1", None, 1), ("P2", "C1", 3)]
    a = golden.asbuilt_df(spark, key=keys[0])
    b = golden.invoice_df(spark, key=keys[0])
    for k in keys[1:]:
        a = a.unionByName(golden.asbuilt_df(spark, golden.BUILT[:4], key=k))
        b = b.unionByName(golden.invoice_df(spark, golden.BILLED[:5], key=k))
    c = golden.contract_df(spark).unionByName(golden.contract_df(spark, project="P2"))
    together = reconcile(a, b, c)
    for p, con, n in keys:
        mine = (F.col("project_id") == p) & F.col("contractor_id").eqNullSafe(F.lit(con)) & (F.col("cycle_no") == n)
        alone = reconcile(a.filter(mine), b.filter(mine), c)
        assert alone.orderBy("unit_key").collect() == together.filter(mine).orderBy("unit_key").collect()


def test_mode_per_cycle(spark):
    a = golden.asbuilt_df(spark, [("X", 350)], uoms={"X": "FT"})
    b = golden.invoice_df(spark, [("X", 100, 1.0), ("X", 250, 1.0)])
    for key, mode, want in [(golden.KEY, "discrete", 350), (golden.KEY, "cumulative", 250)]:
        cycles = spark.createDataFrame([(*key, mode)], "project_id string, contractor_id string, cycle_no int, billing_mode string")
        assert reconcile(a, b, golden.contract_df(spark), cycles=cycles).collect()[0].billed_qty == want


def test_references_are_a_table_and_join_in_bounded_parts(spark):
    refs = references(golden.asbuilt_df(spark), golden.invoice_df(spark))
    mine = [r.reference for r in refs.filter("unit_key = '3.1'").orderBy("feed").collect()]
    assert mine == ["as-built: tally.csv · row 2", "invoice: inv.csv · line 1"]
    parts = joined_in_parts(refs.filter("feed = 0").withColumn("unit_key", F.lit("all")), [*CYCLE_KEYS, "unit_key"], "reference", "line_no", part_lines=3)
    got = [(r.part_no, r.n_texts) for r in parts.orderBy("part_no").collect()]
    assert got == [(0, 3), (1, 3), (2, 1)]
