"""The hand-reconciled cycle: inputs and the figures they must give."""

from tallyline.schemas import ASBUILT_LINE, CONTRACT_ITEM, INVOICE_LINE

KEY = ("P1", "C1", 1)

CONTRACT = [
    ("3.1", "Place 144ct ADSS aerial fiber", "FT", 1.85, 42000.0),
    ("3.2", "Place 288ct ADSS aerial fiber", "FT", 2.60, 8500.0),
    ("4.1", 'Directional bore 2"', "FT", 9.50, 6000.0),
    ("4.2", "Trench / plow fiber", "FT", 4.25, 12000.0),
    ("5.1", "Handhole 30x48", "EA", 340.0, 55.0),
    ("5.2", "Fiber pedestal", "EA", 185.0, 120.0),
    ("6.1", "Fusion splice (per fiber)", "EA", 7.50, 9600.0),
    ("6.2", "Splice closure", "EA", 210.0, 48.0),
    ("7.1", "OTDR test (per fiber)", "EA", 4.0, 9600.0),
    ("8.1", "Pole make-ready", "EA", 95.0, 310.0),
    ("9.1", "Drop placement", "EA", 145.0, 400.0),
]
BUILT = [("3.1", 41320), ("4.1", 6180), ("4.2", 11240), ("5.1", 58), ("6.1", 9720), ("8.1", 298), ("9.1", 372)]
BILLED = [
    ("3.1", 43900, 1.85), ("4.1", 6180, 10.25), (None, 40, 650.0), ("5.1", 58, 340.0),
    ("4.2", 11240, 4.25), ("6.1", 9720, 7.50), ("8.1", 298, 95.0), ("9.1", 350, 145.0),
]
TRAFFIC = "Traffic control / flagging"


def contract_df(spark, items=CONTRACT, project="P1"):
    rows = [(project, c, d, u, p, e, False, None, i) for i, (c, d, u, p, e) in enumerate(items)]
    return spark.createDataFrame(rows, CONTRACT_ITEM)


def asbuilt_df(spark, lines=BUILT, key=KEY, uoms=None):
    uom = {c: u for c, _, u, _, _ in CONTRACT}
    rows = [
        (*key, i, code or desc_of(code), float(q), (uoms or uom).get(code), None, code, "tally.csv", f"row {i + 2}", "sum")
        for i, (code, q) in enumerate(lines)
    ]
    return spark.createDataFrame(rows, ASBUILT_LINE)


def desc_of(code):
    return code or TRAFFIC


def invoice_df(spark, lines=BILLED, key=KEY):
    rows = [
        (*key, i, "2025-06", desc_of(code), float(q), float(p), float(q * p), None, True, code, "inv.csv", f"line {i + 1}")
        for i, (code, q, p) in enumerate(lines)
    ]
    return spark.createDataFrame(rows, INVOICE_LINE)
