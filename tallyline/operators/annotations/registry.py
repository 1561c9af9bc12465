"""The items a comment can bill: keys, labels, units and rate codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single items as key, label, unit, rate code.
SINGLE = (
    ("afo_sl", "Aerial strand-only (no fiber)", "FT", "AFO SL- STRAND"),
    ("coil", "Slack coil / snow shoe", "EA", "AFO.S"),
    ("anchor", "Screw anchor with down guy", "EA", "AFO.GAA"),
    ("down_guy", "Down guy with guy guard", "EA", "AFO.GG"),
    ("bond", "Aerial bond", "EA", "AFO.BOND"),
    ("banding", "Metal banding on pole", "EA", "AFO.BANDING"),
    ("transfer", "Pole transfer (same pole)", "EA", "AFO.TRAN2"),
    ("eye", "Auxiliary eye", "EA", "AFO.EYE"),
    ("olash", "Overlash fiber", "FT", "AFO.OLASH"),
    ("relash", "Delash / relash", "FT", "AFO.RELASH"),
    ("riser_guard", "Riser guard (10')", "EA", "BM81"),
    ("marker_post", "Fiber marking post", "EA", "BM53"),
    ("locate_post", "Locate post", "EA", "BM55"),
    ("locate_disk", "3M locate disk/ball", "EA", "BM55A"),
    ("ground_rod", "Ground rod", "EA", "BM2"),
    ("tracer_wire", "Pull rope / tracer wire", "FT", "BM90"),
    ("handdig", "Hand dig", "FT", "BMHD"),
    ("afo_rtd", "Aerial MST/RTD tail", "FT", "AFO.RTD"),
    ("bfo_rtd", "Buried MST/RTD tail in conduit", "FT", "BFO.RTD.I"),
    ("handhole_PH", "Drop vault BHF-PH", "EA", "BHF-PH"),
)
# Rate codes of strand and lash by fiber count, counts of buried fiber,
# and the codes of hardware and counted units.
STRAND_CODES = {
    24: "AFO SL 24FOC",
    48: "AFO SL48FOC",
    72: "AFO SL 72FOC",
    96: "AFO SL 96FOC",
    144: "AFO SL 144FOC",
    288: "AFO SL 288FOC",
}
BURIED_COUNTS = (12, 24, 48, 72, 96, 144, 288)
AERIAL_HARDWARE = {
    "AFO.BOND": "bond",
    "AFO.BANDING": "banding",
    "AFO.GAA": "anchor",
    "AFO.GG": "down_guy",
    "AFO.TRAN2": "transfer",
    "AFO.EYE": "eye",
}
COUNTED_CODES = {
    "BM81": "riser_guard",
    "BM53": "marker_post",
    "BM55A": "locate_disk",
    "BM55": "locate_post",
    "BM2": "ground_rod",
    "BMHD": "handdig",
}
METHODS = {"P": "plow", "T": "open trench", "TD": "joint trench"}
# Key patterns of the item families.
_STRAND, _BURIED, _BURIED_OPEN, _TAIL = r"^afo_sl_(\d+)$", r"^bfo_(\d+)_(IE?)$", r"^bfo_(IE?)$", r"^mst_(\d+)$"
_BORE, _CONDUIT, _VAULT, _PEDESTAL = r"^bm60_([\d.]+)_(DPD|DP|MB)$", r"^bm60_(\d+)_([\d.]+)_(P|TD|T)$", r"^handhole_(.+)$", r"^pedestal_(.)$"


def strand_item(count: Column) -> Column:
    known = F.concat(F.lit("afo_sl_"), count.cast("string"))
    return F.when(count.isin(*STRAND_CODES), known).otherwise("afo_sl")


def _g(key: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(key, pattern, group)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _lookup(key: Column, column: int) -> Column:
    pairs = [x for row in SINGLE for x in (F.lit(row[0]), F.lit(row[column]))]
    return F.try_element_at(F.create_map(*pairs), key)


def label(key: Column) -> Column:
    duct = F.when(key.endswith("IE"), "existing duct").otherwise("conduit")
    size = _g(key, _BORE)
    kind = _g(key, _BORE, 2)
    bore = F.when(kind == "DPD", " — dual / multi-pipe adder").when(kind == "DP", " — single pipe, directional").otherwise(" — missile")
    methods = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])
    vault = F.regexp_replace(_g(key, _VAULT), "^BHF-", "")
    return (
        F.when(_lookup(key, 1).isNotNull(), _lookup(key, 1))
        .when(key.rlike(_STRAND), _text("Strand & lash ", _g(key, _STRAND), "ct aerial fiber"))
        .when(key.rlike(_BURIED), _text("Buried ", _g(key, _BURIED), "ct fiber in ", duct))
        .when(key.rlike(_BURIED_OPEN), _text("Buried fiber in ", duct, " (count TBD)"))
        .when(key.rlike(_TAIL), _text(_g(key, _TAIL), "' MST (aerial/buried)"))
        .when(key.rlike(_BORE), _text("Bore ", size, '"', bore))
        .when(key.rlike(_CONDUIT), _text("Conduit ", _g(key, _CONDUIT), "×", _g(key, _CONDUIT, 2), '" — ', F.try_element_at(methods, _g(key, _CONDUIT, 3))))
        .when(key.rlike(_VAULT), _text("Handhole/vault BHF-", vault))
        .when(key.rlike(_PEDESTAL), _text("Pedestal BDO(", _g(key, _PEDESTAL), ")"))
        .otherwise(key)
    )


def unit(key: Column) -> Column:
    each = key.rlike(_TAIL) | key.rlike(_VAULT) | key.rlike(_PEDESTAL)
    return F.coalesce(_lookup(key, 2), F.when(each, "EA").otherwise("FT"))


def rate_code(key: Column) -> Column:
    """The code on the rate sheet; null where the coordinator has to decide."""
    strand = F.create_map(*[x for count, code in STRAND_CODES.items() for x in (F.lit(str(count)), F.lit(code))])
    kind = _g(key, _BORE, 2)
    method = F.when(kind == "DPD", "DPD Dual").otherwise(kind)
    return (
        F.when(_lookup(key, 3).isNotNull(), _lookup(key, 3))
        .when(key.rlike(_STRAND), F.try_element_at(strand, _g(key, _STRAND)))
        .when(key.rlike(_BURIED), _text("BFO.", _g(key, _BURIED), ".", _g(key, _BURIED, 2)))
        .when(key.rlike(_TAIL), _text("MST ", _g(key, _TAIL), "'"))
        .when(key.rlike(_BORE), _text("BM60-(", _g(key, _BORE), ")", method))
        .when(key.rlike(_CONDUIT), _text("BM60(", _g(key, _CONDUIT), ")(", _g(key, _CONDUIT, 2), ") ", _g(key, _CONDUIT, 3)))
        .when(key.rlike(_VAULT), _text("BHF-", F.regexp_replace(_g(key, _VAULT), "^BHF-", "")))
        .when(key.rlike(_PEDESTAL), _text("BDO(", _g(key, _PEDESTAL), ")"))
    )
