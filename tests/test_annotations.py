import pytest
from pyspark.sql import functions as F

from tallyline.operators import annotations as ann
from tallyline.schemas import ANNOTATION, CONTRACT_ITEM

# (comments, quantities that must come out), by rule
CASES = [
    # anchors
    (["AFO 288F|6288|410'|AFO BOND|AFO SL"], {"afo_sl_288": 410, "bond": 1}),
    (["BM60(2-1.25\")|Plow=636'"], {"bm60_2_1.25_P": 636}),
    # a cable code opens a segment, footage on it counts
    (["AFO 144F|9100|275'"], {"afo_sl_144": 275}),
    (["AFO 72 (F)|AFO - 188"], {"afo_sl_72": 188}),
    (["AFO 048F|AFO - 61"], {"afo_sl_48": 61}),
    (["AFO 31F|AFO - 90"], {"afo_sl": 90}),
    (["AFO 24F|AFO - 100|AFO 96F|AFO - 200"], {"afo_sl_24": 100, "afo_sl_96": 200}),
    (["AFO 48F|AFO 333"], {"afo_sl_48": 333}),
    (["AFO SL - 45'"], {"afo_sl": 45}),
    (["AFO 24F|80'|BFO 24F|90'"], {"afo_sl_24": 80, "bfo_24_I": 90}),
    # slack, risers, overlash, relash
    (["AFO 48F|AFO Coil - 80"], {"coil": 1}),
    (["AFO.S - 3", "AFO S - 55"], {"coil": 4}),
    (["AFO 24F|AFO 24 up pole - 30'"], {}),
    (["AFO 96F|AFO - 120|OLASH"], {"olash": 120}),
    (["AFO 96F|AFO - 120|AFO/OLASH - 77"], {"olash": 77}),
    (["AFO DELASH - 64'"], {"relash": 64}),
    # hardware, whatever the spelling and the place of the quantity
    (["2-AFO 6AA|AFO/66=3|AFO-BANDING|(2) AFO TRANS2|AFO EYE"], {"anchor": 2, "down_guy": 3, "banding": 1, "transfer": 2, "eye": 1}),
    (["BOND|3-AFO.BOND", "bond - 2"], {"bond": 6}),
    (["DG - 3"], {"down_guy": 3, "anchor": 3}),
    (["DG - 3|ANCHOR"], {"down_guy": 3, "anchor": 1}),
    (["DG - 3|1-AFO.GAA"], {"down_guy": 3, "anchor": 1}),
    # buried fiber, existing duct, stations from 1200 on
    (["BFO.72.IE (F)|BFO - 410"], {"bfo_72_IE": 410}),
    (["BFO 31F|BFO - 50"], {"bfo_I": 50}),
    (["BFO 96F|1199|1200"], {"bfo_96_I": 1199}),
    # conduit: pipes, size, feet, method; a bore of several pipes also bills its base
    (["BM60(3-2\")|Trench=90'"], {"bm60_3_2_T": 90}),
    (["BM60(2-1.25) TD - 70'"], {"bm60_2_1.25_TD": 70}),
    (["BM60(1)(4\") DP - 21'", "BM60 2\" PLOW 19'"], {"bm60_4_DP": 21, "bm60_1_2_P": 19}),
    (["BM60-(1.25)DP-75'"], {"bm60_1.25_DP": 75}),
    (["BM60(2-1.25\") DPD - 40'"], {"bm60_1.25_DPD": 40, "bm60_1.25_DP": 40}),
    (["BM60-(1.25)DP-40'|BM60-(1.25)DPD-40'"], {"bm60_1.25_DP": 40, "bm60_1.25_DPD": 40}),
    (["85' BM60-(2) DP"], {"bm60_2_DP": 85}),
    (["BM60(1.25) MB BORE - 33'"], {"bm60_1.25_MB": 33}),
    (["BM60-(1.25)DP-50'|Bore=8'"], {"bm60_1.25_DP": 58}),
    # tails by foot or by unit, snapped to a bracket
    (["RTD 88'", "BFO 48F|RTD 22'"], {"afo_rtd": 88, "bfo_rtd": 22}),
    (["HST 6-700|RTD 3480"], {"mst_750": 1, "mst_500": 1}),
    # structures and counted units
    (["BHF-17|2-BHF.30T|BHF(PH)(4)|24 x 36 x 24|BDO - S"], {"handhole_17": 1, "handhole_30T": 2, "handhole_PH": 4, "handhole_BHF-30T": 1, "pedestal_S": 1}),
    (["BD0M", "2-BDO (M)", "30x48", "BHF/PH"], {"pedestal_M": 3, "handhole_BHF-48T": 1, "handhole_PH": 1}),
    (["4-BM81|BM2=3|BM53|BM55A - 2|BM55|BMHD - 6|BM90 - 140'"], {"riser_guard": 4, "ground_rod": 3, "marker_post": 1, "locate_disk": 2, "locate_post": 1, "handdig": 6, "tracer_wire": 140}),
    (["TRAN2"], {"transfer": 1}),
    # what bills nothing
    (["AFO 48F|HEAD 300|TAIL - 4|AFO - 60"], {"afo_sl_48": 60}),
    (["5x5x5", "77'", "BDO-SC288", "PIPE - 90"], {}),
]


def frame(spark, docs):
    rows = [
        (doc, 1, i, "FreeText", "\r".join(p.strip() for p in text.split("|")), None, None, None)
        for doc, comments in docs.items() for i, text in enumerate(comments)
    ]
    return spark.createDataFrame(rows, ANNOTATION)


@pytest.fixture(scope="module")
def parsed(spark):
    split = ann.comments(frame(spark, {f"d{i:02}": c for i, (c, _) in enumerate(CASES)}))
    found = ann.describe_items(ann.item_quantities(ann.items(ann.token_events(split)))).collect()
    out = {}
    for r in found:
        out.setdefault(r.doc_id, {})[r.item] = r
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_quantities(parsed, i):
    comments, want = CASES[i]
    assert {k: r.qty for k, r in parsed.get(f"d{i:02}", {}).items()} == want, comments


def test_labels_units_and_rate_codes(parsed):
    seen = {k: (r.label, r.uom, r.rate_code) for d in parsed.values() for k, r in d.items()}
    assert seen["afo_sl_48"] == ("Strand & lash 48ct aerial fiber", "FT", "AFO SL48FOC")
    assert seen["afo_sl"][2] == "AFO SL- STRAND"
    assert seen["bfo_72_IE"] == ("Buried 72ct fiber in existing duct", "FT", "BFO.72.IE")
    assert seen["bm60_2_1.25_P"] == ('Conduit 2×1.25" — plow', "FT", "BM60(2)(1.25) P")
    assert seen["bm60_1.25_DPD"][2] == "BM60-(1.25)DPD Dual" and seen["bm60_4_DP"][2] == "BM60-(4)DP"
    assert seen["mst_500"] == ("500' MST (aerial/buried)", "EA", "MST 500'")
    assert seen["handhole_BHF-48T"] == ("Handhole/vault BHF-48T", "EA", "BHF-48T")
    assert seen["handhole_PH"] == ("Drop vault BHF-PH", "EA", "BHF-PH")
    assert seen["pedestal_M"][2] == "BDO(M)" and seen["coil"][1:] == ("EA", "AFO.S")


def test_exclusions_notes_and_review(spark):
    split = ann.comments(frame(spark, {
        "x": ["DID NOT BUILD, ROUTE MOVED", "AFO 72F|55626|302'|AFO SL"],
        "n": ["see this pole", "3/14", "two ports moved to the next span"],
        "r": ["BDO", "***SPLICE***", "  | "],
    })).cache()
    events = ann.token_events(split).cache()
    assert [r.text for r in ann.excluded_comments(split).collect()] == ["DID NOT BUILD, ROUTE MOVED"]
    assert sorted(r.token for r in ann.notes(events).collect()) == ["3/14", "see this pole", "two ports moved to the next span"]
    assert sorted(r.token for r in ann.unresolved(events).collect()) == ["***SPLICE***", "BDO"]
    counts = {r.doc_id: (r.n_records, r.n_excluded, r.n_unresolved) for r in ann.record_counts(split, events).collect()}
    assert counts == {"x": (2, 1, 0), "n": (3, 0, 0), "r": (2, 0, 2)}
    lines = ann.asbuilt_lines(ann.item_quantities(ann.items(events)))
    warned = {r.doc_id: r.warnings for r in ann.ingest_warnings(ann.record_counts(split, events), lines).collect()}
    assert len(warned["x"]) == 2 and warned["r"] == [
        "2 comment item(s) vary (conduit / pedestal / splice) and need manual entry — see the list below, then add them in the grid."]


def test_lines_match_the_contract(spark):
    items = ann.items(ann.token_events(ann.comments(frame(spark, {"a": ["AFO 288F|6288|410'|AFO BOND|AFO SL", "BFO 144F|18720|375'|BM53"]}))))
    qty = ann.item_quantities(items)
    codes = ["AFO SL 288FOC", "AFO.BOND", "BFO.144.I", "BM53"]
    contract = spark.createDataFrame([("P", c, f"{c} description", "FT", 1.0, 0.0, False, None, i) for i, c in enumerate(codes)], CONTRACT_ITEM).drop("project_id")
    got = {r.code: r for r in ann.asbuilt_lines(qty, contract).collect()}
    assert {c: got[c].qty for c in codes} == {"AFO SL 288FOC": 410, "AFO.BOND": 1, "BFO.144.I": 375, "BM53": 1}
    assert got["BM53"].confidence == "annot" and got["BM53"].source_ref == "annot:1 record"
    other = contract.limit(1).withColumn("code", F.lit("SOMETHING.ELSE")).withColumn("description", F.lit("SOMETHING.ELSE description"))
    assert {r.code for r in ann.asbuilt_lines(qty, other).collect()} == {None}
    assert {r.code for r in ann.asbuilt_lines(qty).collect()} == {None}


def test_a_text_is_read_once_for_all_comments_that_say_it(spark):
    said = ["AFO 48F\rAFO - 120'", "DG - 2\rwhat\r2/26", "Duplicate\rDG - 1", "  ", None]
    rows = [(f"d{i % 3}", i % 2, "FreeText" if i % 7 else "Ink", said[i % 5]) for i in range(60)]
    given = spark.createDataFrame(rows, "doc_id string, page int, subtype string, text string")
    split = ann.comments(given)
    want, got = (df.select("doc_id", "page", "item", "amount", "copies") for df in (ann.items(ann.token_events(split)), ann.of_each(given, lambda c: ann.items(ann.token_events(c)))))
    told = sorted(want.collect())
    assert told and sorted(got.collect()) == told


def below_groupings(plan):
    """What stands below the lowest groupings of a plan, as text."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    deeper = [x for child in below for x in below_groupings(child)]
    return deeper or ([below[0].toString()] if plan.nodeName() == "Aggregate" else [])


def test_no_row_is_split_before_equal_texts_are_one(spark):
    given = frame(spark, {"a": ["BDO|DG - 2", "BDO|DG - 2"]}).withColumn("text", F.concat("text", F.lit("\r"), F.col("page").cast("string")))
    for read in (ann.token_events, lambda texts: texts):
        rows = below_groupings(ann.of_each(given, read)._jdf.queryExecution().optimizedPlan())
        assert rows and not any("split(" in r or "isnotnull(" in r.lower() for r in rows)


def test_counts_of_each_text_are_those_of_its_comments(spark):
    said = ["BDO\rBDO\rDG - 2", "Duplicate\rBDO", "did not  build", "AFO 48F\rAFO - 120'", " \r ", None]
    rows = [(f"d{i % 4}" if i % 4 else None, i % 2, "FreeText" if i % 7 else "Ink", said[i % 6]) for i in range(90)]
    given = spark.createDataFrame(rows, "doc_id string, page int, subtype string, text string")
    split = ann.comments(given)
    for keys in (("doc_id",), ("doc_id", "page")):
        want, got = ann.record_counts(split, ann.token_events(split), keys), ann.record_counts_of_each(given, keys)
        told = set(want.collect())
        assert got.schema == want.schema and len(told) > 3 and set(got.collect()) == told
    assert {r.n_unresolved for r in told} != {0} and {r.n_excluded for r in told} != {0}
    plan = ann.record_counts_of_each(given)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # the texts' shapes, and the texts with their comments
