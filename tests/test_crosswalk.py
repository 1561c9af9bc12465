import random

import pytest
from pyspark.sql import functions as F

import golden
from tallyline.config import Matching
from tallyline.functions.similarity import Block, Items, lcs_length, pair_ratio
from tallyline.operators import crosswalk as xw
from tallyline.plans.cycle import reconcile_described
from tallyline.schemas import ASBUILT_LINE, INVOICE_LINE

ALIAS = "normalized_desc string, code string"


def resolve(spark, texts, contract=None, aliases=(), **kw):
    texts = spark.createDataFrame([("P1", t) for t in texts], "project_id string, raw_desc string")
    known = spark.createDataFrame(list(aliases), ALIAS)
    contract = golden.contract_df(spark) if contract is None else contract
    return {r.raw_desc: r for r in xw.resolve(texts, contract, known, matching=Matching(salts=2, **kw)).collect()}


def test_golden_texts(spark):
    got = resolve(
        spark,
        ["144F ADSS Aerial Place", "Directional Bore 2 inch", "Directional Drilling 2 inch", "Traffic Control / Flagging (day)", "Handhole 30x48", "hh special"],
        aliases=[("handhole special", "5.1")],
    )
    assert (got["hh special"].code, got["hh special"].kind, got["hh special"].score) == ("5.1", "alias", 100.0)
    assert (got["144F ADSS Aerial Place"].code, got["144F ADSS Aerial Place"].kind) == ("3.1", "auto")
    assert got["144F ADSS Aerial Place"].score == pytest.approx(95.0)
    assert got["Directional Bore 2 inch"].code == "4.1"
    drilling = got["Directional Drilling 2 inch"]
    assert (drilling.code, drilling.kind) == (None, "review") and drilling.candidates[0].code == "4.1" and drilling.score == pytest.approx(75.0)
    traffic = got["Traffic Control / Flagging (day)"]
    assert traffic.code is None and len(traffic.candidates) == 3 and traffic.score < 60


def test_codes_win_over_fuzzy_and_aliases_over_codes(spark):
    items = [("BHF-48", "Handhole vault", "EA", 1.0, 0.0), ("AFO.S", "Slack coil", "EA", 1.0, 0.0), ("AFO.SL", "Strand", "FT", 1.0, 0.0),
             ("H01-12R(144)", "Riser cable", "FT", 1.0, 0.0), ("BM81", "Riser Guard 10 ft galvanized with straps", "EA", 1.0, 0.0)]
    got = resolve(spark, ["bhf 48", "AFO.SL", "HO1-12R", "Riser Guard", "afo s"], golden.contract_df(spark, items), [("afo s", "BM81")])
    assert (got["bhf 48"].code, got["bhf 48"].kind, got["bhf 48"].candidates[0].field) == ("BHF-48", "code", "code")
    assert got["AFO.SL"].code == "AFO.SL"
    assert (got["HO1-12R"].candidates[0].code, got["HO1-12R"].candidates[0].field) == ("H01-12R(144)", "code")
    assert (got["Riser Guard"].code, got["Riser Guard"].score) == ("BM81", 90.0)
    assert (got["afo s"].code, got["afo s"].kind) == ("BM81", "alias")


def test_an_empty_contract_sends_everything_to_review(spark):
    got = resolve(spark, ["anything", ""], golden.contract_df(spark).limit(0))
    assert {(r.code, r.kind, r.score, len(r.candidates)) for r in got.values()} == {(None, "review", 0.0, 0)}


def naive_partial(a, b):
    """Windows as long as the shorter text, and shorter ones only at the two ends."""
    best = 0.0
    for s, t in ((a, b), (b, a)):
        if len(s) <= len(t):
            cuts = [(i, j) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if j - i <= len(s)]
            best = max([best] + [pair_ratio(s, t[i:j]) for i, j in cuts if j - i == len(s) or i == 0 or j == len(t)])
    return best


def naive_weighted(a, b):
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    sort = lambda w: " ".join(sorted(w))
    longer = max(len(a), len(b)) / min(len(a), len(b))
    both = sort(x & y)
    left, right = (both + " " + sort(x - y)).strip(), (both + " " + sort(y - x)).strip()
    sets = 100.0 if both and (not x - y or not y - x) else max(
        pair_ratio(left, right) if not both else 100.0 - 100.0 * (len(sort(x - y)) + len(sort(y - x)) - 2 * lcs_length(sort(x - y), sort(y - x))) / (len(left) + len(right)),
        pair_ratio(both, left) if both else 0, pair_ratio(both, right) if both else 0)
    tokens = max(pair_ratio(sort(a.split()), sort(b.split())), sets)
    if longer < 1.5:
        return max(pair_ratio(a, b), 0.95 * tokens)
    scale = 0.6 if longer > 8 else 0.9
    words = 100.0 if both else max(naive_partial(sort(a.split()), sort(b.split())), naive_partial(sort(x), sort(y)))
    return max(pair_ratio(a, b), scale * naive_partial(a, b), 0.95 * scale * words)


def test_block_scores_equal_a_plain_count():
    rng = random.Random(5)
    words = ["fiber", "bore", "2", "in", "handhole", "place", "count", "pole", "x", "directional", "guard"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [make(rng.randint(0, 9)) for _ in range(40)] + ["", "x", "p" * 80 + " bore", make(20)]
    block = Items(items)
    for key in [make(rng.randint(1, 8)) for _ in range(12)] + ["", "x", make(16)]:
        for got, item in zip(block.score(key, "WRatio"), items):
            assert got == pytest.approx(naive_weighted(key, item), abs=1e-9), (key, item)
        assert list(Block(items).common(key)) == [lcs_length(key, t) for t in items]


@pytest.mark.parametrize("scorer", ["WRatio", "ratio", "token_sort_ratio", "unheard of", xw.LEVENSHTEIN])
def test_candidates_do_not_depend_on_blocks_or_salts(spark, scorer):
    rng = random.Random(1)
    words = "red blue small large ring rod plate gear hh ped 12ct 2in".split()
    items = [(f"U-{i}", " ".join(rng.sample(words, 3)), "EA", 1.0, 0.0) for i in range(37)]
    texts = spark.createDataFrame([("P1", " ".join(rng.sample(words, 4))) for _ in range(25)], "project_id string, text_key string").distinct()
    contract = golden.contract_df(spark, items)
    def run(**kw):
        out = xw.score_candidates(texts, contract, matching=Matching(scorer=scorer, **kw))
        return out.select("text_key", "rank", "code", F.round("score", 9).alias("s"), "field").orderBy("text_key", "rank").collect()
    assert run(block_items=5, salts=3) == run(block_items=1000, salts=1)


def test_decisions_and_triage(spark):
    log = spark.createDataFrame(
        [("P1", "Flagging", 1, "nic", None), ("P1", "Odd bore", 1, "map", "4.1"), ("P1", "Gone", 1, "map", "3.1"), ("P1", "Gone", 2, "reopen", None),
         ("P1", "Back", 1, "nic", None), ("P1", "Back", 2, "map", "5.1")],
        "project_id string, raw_desc string, seq bigint, event string, code string")
    texts = spark.createDataFrame([("P1", t) for t in ["Flagging", "Odd bore", "Gone", "Back", "Handhole 30x48"]], "project_id string, raw_desc string")
    decided = xw.fold_decisions(log)
    out = {r.raw_desc: (r.bucket, r.final_code) for r in xw.triage(xw.resolve(texts, golden.contract_df(spark)), decided).collect()}
    assert out["Flagging"] == ("not in contract", None) and out["Odd bore"] == ("confirmed", "4.1")
    assert out["Gone"] == ("review", None) and out["Back"] == ("confirmed", "5.1") and out["Handhole 30x48"] == ("auto", "5.1")
    learn, forget = xw.decision_aliases(log)
    assert {(r.normalized_desc, r.code) for r in learn.collect()} == {("odd bore", "4.1"), ("back", "5.1")}
    assert [r.normalized_desc for r in forget.collect()] == ["gone"]


TALLY = [("144F Aerial Fiber (ADSS)", 20800, "FT"), ("144F Aerial Fiber (ADSS)", 20520, "FT"), ("Directional Bore 2 inch", 6180, "FT"),
         ("Trench / plow fiber", 11240, "FT"), ("Handhole 30x48", 58, "EA"), ("Fusion Splice per fiber", 9720, "EA"),
         ("Pole Make-Ready", 298, "EA"), ("Drop Placement", 372, "EA")]
INVOICE = [("144F ADSS Aerial Place", 43900, 1.85), ("Directional Drilling 2 inch", 6180, 10.25), ("Trench / plow fiber", 11240, 4.25),
           ("Handhole 30x48", 58, 340.0), ("Fusion splice (per fiber)", 9720, 7.5), ("Pole make-ready", 298, 95.0),
           ("Drop placement", 350, 145.0), ("Traffic Control / Flagging (day)", 40, 650.0)]


def test_raw_feeds_to_the_golden_figure(spark):
    a = spark.createDataFrame([(*golden.KEY, i, d, float(q), u, None, None, None, None, "sum") for i, (d, q, u) in enumerate(TALLY)], ASBUILT_LINE)
    b = spark.createDataFrame([(*golden.KEY, i, "2025-06", d, float(q), p, q * p, None, True, None, None, None) for i, (d, q, p) in enumerate(INVOICE)], INVOICE_LINE)
    confirmed = spark.createDataFrame([("directional drilling 2 in", "4.1"), ("directional drilling 2 inch", "4.1")], ALIAS)
    flagged = F.sum(F.when((F.col("severity") == "critical") & (F.col("variance") > 0), F.col("variance"))).alias("v")
    got = reconcile_described(a, b, golden.contract_df(spark), aliases=confirmed).agg(flagged).collect()[0].v
    assert got == pytest.approx(35408)
    assert reconcile_described(a, b, golden.contract_df(spark)).agg(flagged).collect()[0].v > 35408
