"""The star-schema tables read as domain tables.

A contract unit is a (brand, type) pair of ``part``; every line item is an invoice line
and, unless it was returned, an as-built line as well. Region is the project, the
supplier's nation the contractor, the ship year the cycle. ``lineitem`` has no unique
line number, so its six identifying columns serve as the line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.operators.rollup import BILLED, BUILT

FIRST_YEAR = 1994


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_code() -> Column:
    return F.concat("p_brand", F.lit("."), "p_type")


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pick = F.pmod(F.min("p_partkey"), F.lit(4))
    return (
        part.groupBy("p_brand", "p_type")
        .agg(
            F.min("p_name").alias("name"),
            F.when(pick == 1, "EA").when(pick == 2, "LS").otherwise("FT").alias("uom"),
            F.min("p_retailprice").alias("unit_price"),
            (F.sum("p_size") * 10).cast("double").alias("est_qty"),
            F.min("p_partkey").alias("line_no"),
        )
        .select(
            unit_code().alias("code"),
            F.concat_ws(" ", "name", F.lower("p_type")).alias("description"),
            "uom",
            "unit_price",
            "est_qty",
            F.lit(False).alias("is_change_order"),
            F.lit(None).cast("string").alias("effective_date"),
            "line_no",
        )
    )


def change_orders(items: DataFrame) -> DataFrame:
    return items.filter("uom = 'EA'").withColumn("unit_price", F.col("unit_price") * 5)


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier with the project and contractor it stands for."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("l_suppkey"),
            F.col("r_name").alias("project_id"),
            F.col("n_name").alias("contractor_id"),
        )
    )


def line_order() -> Column:
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with cycle keys, code, description and line order."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), unit_code().alias("part_code"), "p_name")
    # One small table after the other, so that each is weighed by its own size.
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("contractor_id"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("project_id"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, "l_partkey")
        .join(supplier, "l_suppkey")
        .join(nation, "s_nationkey")
        .join(region, "n_regionkey")
        .select(
            "project_id",
            "contractor_id",
            (F.year("l_shipdate") - FIRST_YEAR).alias("cycle_no"),
            F.when(F.pmod("l_partkey", F.lit(50)) != 0, F.col("part_code")).alias("code"),
            F.col("p_name").alias("raw_desc"),
            line_order().alias("line_no"),
            "l_orderkey",
            "l_returnflag",
            "l_quantity",
            "l_extendedprice",
        )
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds from one scan: every line bills, all but the returned ones were built."""
    built = F.col("l_returnflag") != "R"
    base = lines(spark, sf_dir)
    return base.select(
        "project_id",
        "contractor_id",
        "cycle_no",
        "code",
        "raw_desc",
        F.when(built, BUILT).otherwise(BILLED).alias("feed"),
        "line_no",
        F.when(built, F.col("l_quantity")).alias("built_qty"),
        F.lit(None).cast("string").alias("built_uom"),
        F.col("l_quantity").alias("billed_qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("amount"),
    )


def asbuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        lines(spark, sf_dir)
        .filter("l_returnflag <> 'R'")
        .select(
            "project_id", "contractor_id", "cycle_no", "line_no", "raw_desc",
            F.col("l_quantity").alias("qty"),
            F.lit(None).cast("string").alias("uom"),
            "code",
        )
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        "project_id", "contractor_id", "cycle_no", "line_no",
        F.col("l_orderkey").cast("string").alias("invoice_id"),
        "raw_desc",
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("amount"),
        "code",
    )


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region, nation and ship year, with mode and rate from the nation key."""
    who = parties(spark, sf_dir).join(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("contractor_id"), "n_nationkey"), "contractor_id"
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", (F.year("l_shipdate") - FIRST_YEAR).alias("cycle_no"))
        .distinct()
        .join(who, "l_suppkey")
        .select("project_id", "contractor_id", "cycle_no", "n_nationkey")
        .distinct()
        .select(
            "project_id",
            "contractor_id",
            "cycle_no",
            F.concat(F.lit("FY"), (F.col("cycle_no") + FIRST_YEAR).cast("string")).alias("period_label"),
            F.when(F.col("n_nationkey") % 2 == 0, "cumulative").otherwise("discrete").alias("billing_mode"),
            (5.0 + (F.col("n_nationkey") % 3) * 2.5).alias("retainage_pct"),
        )
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("project_id"),
        F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") % 4 == 3, "closed").when(F.col("r_regionkey") % 4 != 0, "Active").alias("status"),
    )


def contractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("contractor_id"), F.col("n_name").alias("name"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("project_id"), F.col("n_name").alias("contractor_id"))
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts",
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("actor"),
        F.col("event_type").alias("action"),
        F.from_json("props", "map<string,string>").alias("detail"),
    )


def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as a log of reviewer decisions on their unit."""
    return lines(spark, sf_dir).filter("l_returnflag = 'R'").select(
        "project_id",
        "contractor_id",
        "cycle_no",
        F.coalesce("code", "raw_desc").alias("row_key"),
        F.col("line_no").alias("seq"),
        F.expr(
            "CASE line_no.l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'hold' WHEN 2 THEN 'approve' ELSE 'note' END"
        ).alias("status"),
        F.expr(
            "CASE line_no.l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('n', line_no.l_orderkey) END"
        ).alias("note"),
        F.lit("").alias("by"),
        F.lit(None).cast("string").alias("at"),
    )


def asbuilt_with_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-built lines, some of them read from comments and not yet confirmed."""
    low = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("l_orderkey")).distinct()
    return (
        lines(spark, sf_dir)
        .filter("l_returnflag <> 'R'")
        .join(low.withColumn("confidence", F.lit("annot")), "l_orderkey", "left")
        .withColumn("confidence", F.coalesce("confidence", F.lit("sum")))
    )


def described_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under the messy descriptions a contractor might write, six ways of spelling."""
    return table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.upper("p_name"), F.lit("  "), "p_type"))
        .when(F.col("p_partkey") % 6 == 1, F.lower(F.regexp_replace(unit_code(), "[#.]", " - ")))
        .when(F.col("p_partkey") % 6 == 2, F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(' 12"')))
        .when(F.col("p_partkey") % 6 == 3, F.concat(F.lit("Dir. "), "p_name", F.lit(" "), (F.col("p_size") % 4 * 12 + 12).cast("string"), F.lit(" ct")))
        .when(F.col("p_partkey") % 6 == 4, F.concat(F.initcap("p_type"), F.lit(" / "), "p_name", F.lit(" hh")))
        .otherwise(F.col("p_name"))
        .alias("raw_desc"),
        "p_partkey",
        "p_name",
        unit_code().alias("part_code"),
    )


def learned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain part names as earlier jobs confirmed them."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_name").alias("normalized_desc"))
        .agg(F.min(unit_code()).alias("code"))
    )


def mapping_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on descriptions, one per part; of several on one text the last counts."""
    return described_parts(spark, sf_dir).select(
        "raw_desc",
        F.col("p_partkey").alias("seq"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'nic' ELSE 'reopen' END").alias("event"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN part_code END").alias("code"),
    )


# --- sheets ------------------------------------------------------------------
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered within their order, from 1, the last one marked."""
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumns(
        {"n": F.row_number().over(within), "last": F.lead("l_orderkey").over(within).isNull()}
    )


def _sheets(orders: DataFrame, file: Column, layouts: list[tuple[list[str], list[Column]]], total: list[str]) -> DataFrame:
    """One sheet per order: a title row, ``l_orderkey % 3`` blank rows, a header, the lines
    and a total row. The layout goes by ``l_orderkey`` modulo their number. The first line of
    an order brings the rows above it, the last one the total: one pass over the lines."""
    which = F.col("l_orderkey") % len(layouts)
    skip = (F.col("l_orderkey") % 3).cast("int")

    def pick(options: list[Column]) -> Column:  # only the cells of the row's own layout are written
        out = F.when(which == 0, options[0])
        for n, option in enumerate(options[1:], 1):
            out = out.when(which == n, option)
        return out

    first, last = F.col("n") == 1, F.col("last")
    part = F.explode(
        F.when(first & last, F.array(*map(F.lit, "thle"))).when(first, F.array(*map(F.lit, "thl"))).when(last, F.array(*map(F.lit, "le"))).otherwise(F.array(F.lit("l")))
    )
    rows = orders.select("*", part.alias("part"))
    what = F.col("part")
    row_no = F.when(what == "t", 0).when(what == "h", skip + 1).when(what == "l", skip + 1 + F.col("n")).otherwise(skip + 2 + F.col("n"))
    cells = (
        F.when(what == "t", F.array(F.lit("Pay application"), F.lit(None).cast("string")))
        .when(what == "h", pick([F.array(*[F.lit(h) for h in head]) for head, _ in layouts]))
        .when(what == "l", pick([F.array(*[c.cast("string") for c in row]) for _, row in layouts]))
        .otherwise(F.array(*[F.lit(t) for t in total]))
    )
    return rows.select(
        "l_orderkey", file.alias("file"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), row_no.cast("int").alias("row_no"), cells.alias("cells")
    )


def invoice_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an invoice table; the fifth layout has headers nobody can guess."""
    qty = F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"))
    amount = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")
    name, inv = F.col("p_name"), F.concat(F.lit("INV-"), F.col("l_orderkey"))
    layouts = [
        (["Invoice #", "Description", "Qty", "Unit Price", "Amount", "Billing Period"], [inv, name, qty, price, amount, F.lit("2025-06")]),
        (["Item", "Units", "Rate"], [name, qty, price]),
        (["Line Total", "Work Item", "Quantity"], [amount, F.concat(F.lit("  "), name), qty]),
        (["Unit Price", "Unit", "Count", "Total"], [price, name, qty, amount]),
        (["A", "B", "C"], [qty, name, amount]),
    ]
    file = F.concat(F.lit("inv_"), F.col("l_orderkey"), F.lit(".pdf"))
    return _sheets(order_lines(spark, sf_dir), file, layouts, ["Grand Total", "Grand Total", "Grand Total"]).withColumn(
        "contractor_id", F.concat(F.lit("K"), (F.col("l_orderkey") % 5).cast("string"))
    )


def tally_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a field tally, some without a header that could be found."""
    qty = F.format_number("l_quantity", 0)
    uom = F.element_at(F.array(*[F.lit(u) for u in ("LF", "each", "", "n.a.")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    seg = F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(".")))
    layouts = [
        (["Segment", "Description", "Qty Built", "UoM"], [seg, name, qty, uom]),
        (["Work done", "Total", "Measure"], [name, qty, uom]),
    ]
    file = F.concat(F.lit("tally_"), F.col("l_orderkey"), F.lit(".csv"))
    return _sheets(order_lines(spark, sf_dir), file, layouts, ["Grand Total", "Subtotal", "5"])


def contract_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract as one rate sheet per brand, headed in one of three ways."""
    items = contract(spark, sf_dir).withColumn("brand", F.substring_index("code", ".", 1))
    no = F.row_number().over(Window.partitionBy("brand").orderBy("code"))
    layout = (F.regexp_extract("brand", r"(\d+)$", 1).cast("int") % 3 + 1).cast("int")
    price = F.concat(F.lit("$"), F.format_number("unit_price", 2))
    qty, uom, code, text = F.format_number("est_qty", 0), F.lower("uom"), F.col("code"), F.col("description")
    heads = [
        ["CODE", "UNIT DESCRIPTION", "UNIT", "RATE", "Est. Qty"],
        ["Unit Cost", "Work Item", "Bid Item", "U/M", "Quantity (bid)"],
        ["Measure", "Ref", "Item description", "Price each", "notes"],
    ]
    rows = [[code, text, uom, price, qty], [price, text, code, uom, qty], [uom, code, text, price, F.lit("-")]]

    def pick(options):
        return F.element_at(F.array(*[F.array(*[c if isinstance(c, Column) else F.lit(c) for c in o]) for o in options]), layout)

    body = items.select("brand", no.cast("int").alias("row_no"), pick(rows).alias("cells"))
    head = items.select("brand").distinct().select("brand", F.lit(0).alias("row_no"), pick(heads).alias("cells"))
    gap = items.select("brand").distinct().select("brand", F.lit(1000).alias("row_no"), F.array(F.lit("Item"), F.lit("Subtotal"), F.lit("Subtotal"), F.lit("x")).alias("cells"))
    file = F.concat(F.lit("rates_"), F.replace(F.col("brand"), F.lit("#"), F.lit("")), F.lit(".csv"))
    return head.unionByName(body).unionByName(gap).select(file.alias("file"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), "row_no", "cells")


def saved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles per order layout: one good, one without a quantity column."""
    keys = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("k")).distinct()
    return keys.filter("k in (3, 4)").select(
        F.concat(F.lit("K"), F.col("k").cast("string")).alias("contractor"),
        F.lit(1).alias("header_row"),
        F.expr("CASE WHEN k = 4 THEN map('desc', 1, 'qty', 0, 'amount', 2) ELSE map('desc', 1, 'amount', 3) END").alias("columns"),
    )


# --- comments ----------------------------------------------------------------
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a drawing comment in one of eight shorthand layouts; the book
    is the supplier, the footage grows with the quantity."""
    v = F.col("l_quantity").cast("int") * 7 + 100
    k, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    ways = 1 + F.col("l_partkey") % 3
    tail = 100 + F.col("l_partkey") % 15 * 100
    layouts = [
        ("AFO 288F\r", 12000 + F.col("l_orderkey") % 500, "\r", v, "'\rAFO BOND\rAFO SL"),
        ("AFO 48 (F)\r19984\rAFO - ", v, "\r", k, "-AFO.BANDING\r1-AFO.BOND"),
        ("AFO.48 (F)\r23706\rAFO - ", v, "\rOLASH"),
        ("BFO.48.I (F)\nIn - 10478\nBFO - ", v, "\nPipe - 636"),
        ("BM60(", ways, '-1.25")\rBore=', v, "'"),
        ("AFO 144F\r11900\r", v, "'\rDG - ", k),
        (k, "-BM81\rBHF.30T=", q, "\rBDO\rHST 6-", tail),
        ("This pole on Page ", k, "\r2/26\rAFO.S - 2"),
    ]
    texts = [F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]) for parts in layouts]
    which = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8))
    text = F.when((which == 7) & (F.col("l_orderkey") % 2 == 0), F.concat(F.lit("Duplicate Page\r"), texts[0]))
    for i, layout in enumerate(texts):
        text = text.when(which == i, layout)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("book_"), F.col("l_suppkey").cast("string")).alias("doc_id"),
        F.col("l_linenumber").alias("page"),
        F.lit("FreeText").alias("subtype"),
        text.alias("text"),
    )


def vault_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract of tiered vaults, one per part size."""
    return (
        table(spark, sf_dir, "part")
        .select("p_size")
        .distinct()
        .select(
            F.concat(F.lit("BHF-"), F.col("p_size").cast("string"), F.lit("T")).alias("code"),
            F.concat(F.lit("tier vault "), F.col("p_size").cast("string")).alias("description"),
            F.col("p_size").cast("bigint").alias("line_no"),
        )
    )
