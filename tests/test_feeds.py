import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline.functions import numbers
from tallyline.functions.text import normalize, parse_uom
from tallyline.operators import feeds, header
from tallyline.schemas import GRID
from tallyline.sources.archives import read_archives
from tallyline.sources.grids import read_grid


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_normalize(spark):
    texts = ["  Place 144ct ADSS Aerial ", 'Directional Bore 2"', None, "  ", "HH 30x48 — Ped", "144 fiber U/G", "Câble 12 ct"]
    want = ["place 144count adss aerial", "directional bore 2 in", "", "", "handhole 30x48 pedestal", "144count u g", "câble 12count"]
    assert column(spark, texts, normalize) == want
    assert column(spark, want, normalize) == want


def test_units_and_numbers(spark):
    assert column(spark, ["LF", "each", "100FT", "lump sum", "widgets", None, " PER  Foot", "mft"], parse_uom) == ["FT", "EA", "100FT", "LS", None, None, "FT", "100FT"]
    texts = ["$1,234.50", " 12 ", "5%", "1e3", "1d", "nan", "", None, "-3.", ".5", "1_000", "x"]
    assert column(spark, texts, numbers.parse_number) == [1234.5, 12.0, 5.0, 1000.0, None, None, None, None, -3.0, 0.5, 1000.0, None]
    assert column(spark, ["$5", "1,5"], lambda c: numbers.parse_number(c, numbers.TALLY_MARKS)) == [None, 15.0]
    shown = column(spark, ["2580", "826.4", "1234567", "0", "0.00001234", "-41.5", "999999.5"], lambda c: numbers.significant(c.cast("double")))
    assert shown == ["2,580", "826.4", "1.23457e+06", "0", "1.234e-05", "-41.5", "1e+06"]


def grid(spark, tables):
    return spark.createDataFrame([(f, 1, 1, i, cells) for f, rows in tables.items() for i, cells in enumerate(rows)], GRID)


def test_bid_schedule_columns_and_rows(spark):
    g = grid(spark, {"rates.csv": [["CODE", "UNIT DESCRIPTION", "UNIT", "RATE"], ["A1", "Bore", "per foot", "$9.50"], ["A2", "Vault", None, "1,200"], ["Item", "x", "EA", "1"], ["A3", "no price", "EA", "tbd"], [None, "Subtotal", None, "5"]]})
    items = feeds.bid_schedule(g).orderBy("code").collect()
    assert [(i.code, i.description, i.uom, i.unit_price, i.est_qty) for i in items] == [("A1", "Bore", "FT", 9.5, 0.0), ("A2", "Vault", "EA", 1200.0, 0.0)]
    bad = feeds.bid_schedule(grid(spark, {"bad.csv": [["Code", "Note"], ["A", "b"]]}))  # no job runs before the rows are asked for
    with pytest.raises(Exception, match=r"not all found in bad.csv \[Code, Note\]"):
        bad.collect()
    none = feeds.bid_schedule(grid(spark, {"none.csv": [["Code", "Description", "Price"], ["A", "b", "n/a"]]}))
    with pytest.raises(Exception, match="zero items: none.csv"):
        none.collect()


def test_a_header_may_stand_in_any_row(spark):
    deep = [["note", str(i)] for i in range(39)] + [["Description", "Qty"], ["Bore", "5"]]
    g = grid(spark, {"deep.csv": deep, "without.csv": [["a", "b"], ["c", "d"]]})
    assert [(r.file, r.header_row) for r in header.find_headers(g).collect()] == [("deep.csv", 39)]
    assert header.find_headers(g, rows=15).count() == 0
    assert [(r.file, r.n_rows) for r in header.without_header(g).collect()] == [("without.csv", 2)]


def test_csv_files_to_tally_and_invoice(spark, tmp_path):
    (tmp_path / "tally.csv").write_text("Field book,,\n\nSegment,Description,Qty,UoM\nWF-02,144F Aerial,20800,FT\nWF-03,144F aerial,\"20,520\",FT\nX,Subtotal,0,\nX,\"Bore, 2\"\"\",5,NA\n")
    (tmp_path / "inv 1.tsv").write_text("Description\tQty\tAmount\nBore\t4\t$10\nTotal\t9\t9\n\t1\t1\nGrand Total\t2\t6\n")
    tally = feeds.tally_lines(read_grid(spark, str(tmp_path / "tally.csv")))
    got = tally.orderBy("line_no").collect()
    assert [(r.raw_desc, r.qty, r.uom, r.segment, r.source_ref) for r in got] == [
        ("144F Aerial", 20800.0, "FT", "WF-02", "row 3"), ("144F aerial", 20520.0, "FT", "WF-03", "row 4"), ('Bore, 2"', 5.0, None, "X", "row 6")]
    grouped = feeds.group_tally(tally).orderBy("line_no").collect()
    assert [(r.raw_desc, r.qty, r.n_lines) for r in grouped] == [("144F Aerial", 41320.0, 2), ('Bore, 2"', 5.0, 1)]
    inv = feeds.tabular_invoices(read_grid(spark, [str(tmp_path / "inv 1.tsv")])).orderBy("line_no").collect()
    assert [(r.invoice_id, r.raw_desc, r.unit_price, r.amount, r.source_file, r.line_ref) for r in inv] == [
        ("inv 1", "Bore", 2.5, 10.0, "inv 1.tsv", "line 1"), ("inv 1", "Grand Total", 3.0, 6.0, "inv 1.tsv", "line 4")]
    with pytest.raises(ValueError):
        read_grid(spark, str(tmp_path / "book.xlsx"))


def test_row_numbers_of_a_split_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("\n".join(f"r{i},{'x' * 40}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = read_grid(spark, str(tmp_path / "big.csv"))
        assert rows.filter(F.concat(F.lit("r"), "row_no") == F.element_at("cells", 1)).count() == 3000
        assert rows.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archives_skip_what_is_no_invoice_and_direct_files_raise(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("june/", "")
        z.writestr("june/inv.csv", "Description,Qty,Unit Price\nBore,4,2.5\nBore,4,2.5\n")
        z.writestr("june/readme.csv", "hello,world\n1,2\n")
        z.writestr("photo.jpg", b"\xff")
        z.writestr("inv.csv", "Item,Count,Rate\nVault,1,7\n")
    members = read_archives(spark, str(tmp_path))
    lines = feeds.invoice_batch(None, members).orderBy("raw_desc").collect()
    assert [(r.raw_desc, r.amount, r.source_file, r.invoice_id) for r in lines] == [("Bore", 10.0, "inv.csv", "inv"), ("Vault", 7.0, "inv.csv", "inv")]
    (tmp_path / "bad.csv").write_text("hello,world\n1,2\n")
    direct = feeds.invoice_batch(read_grid(spark, str(tmp_path / "bad.csv")), members)
    with pytest.raises(Exception, match="not all found in bad.csv|not all found in .*bad.csv"):
        direct.collect()


def test_profiles_read_what_cannot_be_detected(spark):
    g = grid(spark, {"scan.pdf": [["A", "B", "C"], ["Bore", "3", "$750"], ["Grand Total", "3", "750"], ["Vault", "1\n", None]]}).withColumn("contractor_id", F.lit("K"))
    assert feeds.extracted_invoices(g).count() == 0
    p = spark.createDataFrame([("K", 0, {"desc": 0, "qty": 1, "amount": 2})], "contractor string, header_row int, columns map<string,int>")
    got = feeds.extracted_invoices(g, profiles=p).orderBy("line_no").collect()
    assert [(r.raw_desc, r.unit_price, r.amount, r.line_ref) for r in got] == [("Bore", 250.0, 750.0, "page 1 table 1 row 2"), ("Vault", 0.0, 0.0, "page 1 table 1 row 4")]


def test_unit_price_is_never_the_description(spark):
    found = header.claim_columns(header.find_headers(grid(spark, {"t": [["Unit Price", "Unit", "Qty", "Total"]]})), header.GRID_WORDS).collect()[0]
    assert (found.at_price, found.at_desc, found.at_qty, found.at_amount) == (0, 1, 2, 3)


def test_dedupe_keeps_the_first(spark):
    rows = [("I", "Bore", 1.0, 2.0, i, f"f{i}") for i in range(5)] + [("I", "Bore", 2.0, 2.0, 9, "g")]
    df = spark.createDataFrame(rows, "invoice_id string, raw_desc string, qty double, unit_price double, line_no bigint, source_file string")
    assert sorted(r.source_file for r in feeds.dedupe_invoices(df, order=("line_no",)).collect()) == ["f0", "g"]


def test_edits(spark):
    edits = spark.createDataFrame([("A", " Bore ", 2.0, "lf", "annot"), ("", "Vault", None, "x", "annot"), (None, "nan", 1.0, None, "sum")],
                                  "code string, raw_desc string, qty double, uom string, confidence string")
    got = [(r.code, r.raw_desc, r.qty, r.uom, r.confidence) for r in feeds.edited_asbuilt(edits).collect()]
    assert got == [("A", "Bore", 2.0, "FT", "confirmed"), (None, "Vault", 0.0, None, "confirmed")]


def test_a_file_name_of_two_contractors_is_read_by_the_profile_of_one_only(spark):
    mine = grid(spark, {"scan.pdf": [["A", "B"], ["Bore", "3"]]}).withColumn("contractor_id", F.lit("K"))
    other = grid(spark, {"scan.pdf": [["Quan\ntity", " Work\nitem "], [" 4 ", "Vault\nlid"], ["x", "no number"]]}).withColumn("contractor_id", F.lit("L"))
    p = spark.createDataFrame([("K", 0, {"desc": 0, "qty": 1})], "contractor string, header_row int, columns map<string,int>")
    got = feeds.extracted_invoices(mine.unionByName(other.withColumn("cells", F.transform("cells", lambda c: F.replace(c, F.lit("Quan\ntity"), F.lit("Qty"))))), profiles=p)
    assert sorted((r.contractor_id, r.raw_desc, r.qty) for r in got.collect()) == [("K", "Bore", 3.0), ("L", "Vault lid", 4.0)]


def test_cells_are_read_and_headers_searched_once(spark):
    g = grid(spark, {"t.pdf": [["Item", "Qty"], ["Bore", "3"]], "u.csv": [["no", "header"], ["a", "1"]]}).withColumn("contractor_id", F.lit("K"))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(feeds.extracted_invoices(g)).count("RLIKE(") == 3  # quantity, price and amount
    found = header.find_headers(g, header.TALLY_WORDS, fall_back=True)
    assert plan(found).count("min(") == 1
    assert sorted((r.file, r.header_row, r.header[0]) for r in found.collect()) == [("t.pdf", 0, "Item"), ("u.csv", 0, "no")]


def test_file_names_are_decoded(spark):
    from tallyline.functions.text import file_name, file_stem

    names = ["/a/b%20c.csv", "x+y.csv", "a%zz.csv", None, "d/e/", "plain"]
    assert column(spark, names, file_name) == ["b c.csv", "x+y.csv", "a%zz.csv", None, "", "plain"]
    assert column(spark, ["a.b.csv", ".csv", "plain", "x."], file_stem) == ["a.b", ".csv", "plain", "x"]
