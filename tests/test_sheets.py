import csv

import pytest
from pyspark.sql import functions as F

import golden
from tallyline.plans.sheets import reconcile_sheets
from test_crosswalk import INVOICE, TALLY

ALIASES = [("directional drilling 2 in", "4.1"), ("directional drilling 2 inch", "4.1")]


def write(folder, name, rows, sep=","):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, delimiter=sep).writerows(rows)


def lay_out(root, project="P1", contractor="C1", cycle=1):
    bid = [["Item No", "Description", "UOM", "Unit Price", "Est Qty"], ["", "Aerial", "", "", ""], *[[c, d, u, f"${p}", f"{e:,.0f}"] for c, d, u, p, e in golden.CONTRACT]]
    write(root / "contract" / f"project_id={project}", "bid.csv", bid)
    where = lambda kind: root / kind / f"project_id={project}" / f"contractor_id={contractor}" / f"cycle_no={cycle}"
    write(where("tally"), "tally.tsv", [["Field tally"], ["Description", "Qty", "UOM"], *[[d, f"{q:,}", u] for d, q, u in TALLY], ["Total", "99", ""]], "\t")
    lines = [["Invoice", "Description", "Qty", "Unit Price", "Amount"], *[["2025-06", d, q, p, ""] for d, q, p in INVOICE]]
    write(where("invoices"), "june.csv", lines)
    write(where("invoices"), "june_again.csv", lines)  # a file loaded twice
    return where


@pytest.fixture
def aliases(spark):
    return spark.createDataFrame(ALIASES, "normalized_desc string, code string")


def flagged(rows):
    over = F.sum(F.when((F.col("severity") == "critical") & (F.col("variance") > 0), F.col("variance")))
    return {(r.project_id, r.contractor_id, r.cycle_no): r.v for r in rows.groupBy("project_id", "contractor_id", "cycle_no").agg(over.alias("v")).collect()}


def test_folders_of_sheets_give_the_golden_figure(spark, tmp_path, aliases):
    lay_out(tmp_path)
    rows, bad = reconcile_sheets(spark, str(tmp_path), aliases=aliases)
    assert flagged(rows) == {golden.KEY: pytest.approx(35408)} and bad.count() == 0


def test_a_bad_sheet_is_a_row_beside_the_cycles(spark, tmp_path, aliases):
    where = lay_out(tmp_path)
    lay_out(tmp_path, "P2", "C9", 3)
    write(where("invoices"), "scan.csv", [["Photo", "Taken"], ["a.jpg", "Monday"]])
    write(where("tally"), "empty.tsv", [["nothing here"]], "\t")
    write(tmp_path / "contract" / "project_id=P2", "notes.csv", [["Code", "Description", "Price"], ["", "no items yet", ""]])
    write(tmp_path / "contract" / "project_id=P3", "other.csv", [["Item", "Text"], ["1", "x"]])
    (where("tally") / "photo.jpg").write_bytes(b"\x00\x01")
    rows, bad = reconcile_sheets(spark, str(tmp_path), aliases=aliases)
    assert flagged(rows) == {golden.KEY: pytest.approx(35408), ("P2", "C9", 3): pytest.approx(35408)}
    told = {(r.kind, r.project_id, r.contractor_id, r.cycle_no, r.file.rsplit("/", 1)[-1]): r.reason for r in bad.collect()}
    assert told == {
        ("invoices", "P1", "C1", 1, "scan.csv"): "no column for desc, qty",
        ("tally", "P1", "C1", 1, "empty.tsv"): "no column for desc, qty",
        ("contract", "P2", None, None, "notes.csv"): "no lines",
        ("contract", "P3", None, None, "other.csv"): "no column for unit_price",
    }


def test_cycles_that_are_not_asked_for_are_not_opened(spark, tmp_path, aliases):
    lay_out(tmp_path)
    lay_out(tmp_path, "P1", "C1", 2)
    for kind in ("tally", "invoices"):
        for f in (tmp_path / kind / "project_id=P1" / "contractor_id=C1" / "cycle_no=2").iterdir():
            f.write_text(",".join(["x"] * 200))  # too wide: fails when it is read
    rows, bad = reconcile_sheets(spark, str(tmp_path), where="cycle_no = 1", aliases=aliases)
    assert flagged(rows) == {golden.KEY: pytest.approx(35408)} and bad.count() == 0
    with pytest.raises(Exception):
        reconcile_sheets(spark, str(tmp_path), aliases=aliases)[0].collect()


def test_only_rows_that_read_like_a_header_are_grouped(spark):
    from tallyline.operators.header import find_headers

    grid = spark.createDataFrame([("f", 1, 1, 0, ["x", None]), ("f", 1, 1, 1, ["Item", "Qty"]), ("f", 1, 1, 2, ["item", "qty"]), ("g", 1, 1, 0, ["a"])],
                                 "file string, page int, table_no int, row_no int, cells array<string>")
    found = find_headers(grid)
    assert [tuple(r) for r in found.collect()] == [("f", 1, 1, 1, ["Item", "Qty"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("Aggregate"):]
