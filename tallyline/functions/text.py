"""Text columns: cleaning, the crosswalk key, units, keys and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank space, the marks read as inches, the fiber-count
# spellings, the token abbreviations, the unit spellings and the key of unmatched lines.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
INCH_MARKS = "[\u2033\u201d\"']"  # ″ ” " '
FIBER_COUNT = r"(?U)\b(\d{2,4})\s*(?:f|ct|cnt|count|fiber|fibers|c)\b"
ABBREVIATIONS = {
    "adss": "adss",
    "ct": "count",
    "cnt": "count",
    "ug": "underground",
    "u/g": "underground",
    "mr": "makeready",
    "make-ready": "makeready",
    "makeready": "makeready",
    "lf": "ft",
    "ln": "ft",
    "ea": "ea",
    "each": "ea",
    "dir": "directional",
    "hh": "handhole",
    "ped": "pedestal",
    "otdr": "otdr",
    "ont": "ont",
    "nid": "nid",
}
UNIT_SPELLINGS = {
    "EA": "EA",
    "EACH": "EA",
    "E": "EA",
    "FT": "FT",
    "F": "FT",
    "LF": "FT",
    "FOOT": "FT",
    "FEET": "FT",
    "PERFOOT": "FT",
    "100FT": "100FT",
    "C_FT": "100FT",
    "CFT": "100FT",
    "MFT": "100FT",
    "LS": "LS",
    "LUMPSUM": "LS",
    "LUMP": "LS",
}
UNMATCHED_PREFIX = "\u0000unmatched\u0000"
NOT_DESCRIBED = "(unmatched)"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.trim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def normalize(c: Column) -> Column:
    """The crosswalk key of a description: lower case, inch marks and fiber counts spelt
    out, punctuation gone, abbreviations expanded token by token. Null becomes ''."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(s, INCH_MARKS, " in ")
    s = F.regexp_replace(s, FIBER_COUNT, "$1count")
    s = F.regexp_replace(s, r"(?U)[^\w\s]+", " ")
    words = F.split(strip(F.regexp_replace(s, r"(?U)\s+", " ")), " ")
    known = literal_map(ABBREVIATIONS)
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def parse_uom(c: Column) -> Column:
    """Unit of measure, or null when the spelling is not known."""
    return F.try_element_at(
        literal_map(UNIT_SPELLINGS), F.replace(F.upper(strip(c)), F.lit(" "), F.lit(""))
    )


def base_uom(uom: Column) -> Column:
    return F.when(uom == "100FT", F.lit("FT")).otherwise(uom)


def base_qty(qty: Column, uom: Column) -> Column:
    return F.when(uom == "100FT", qty * 100.0).otherwise(qty)


def unit_key(code: Column, raw_desc: Column) -> Column:
    """Lines with a code share a unit; lines without one stay apart by description."""
    return F.coalesce(code, F.concat(F.lit(UNMATCHED_PREFIX), F.lower(strip(raw_desc))))


def row_key(code: Column, description: Column) -> Column:
    """Identity of a reconciled row for reviewer decisions."""
    return F.coalesce(F.nullif(code, F.lit("")), description)


def source_reference(feed: str, file: Column, ref: Column) -> Column:
    """``feed: file · ref`` from whichever parts are there, or the bare feed name."""
    parts = F.concat_ws(" · ", F.nullif(file, F.lit("")), F.nullif(ref, F.lit("")))
    return F.when(parts != "", F.concat(F.lit(f"{feed}: "), parts)).otherwise(F.lit(feed))


def flag_messages(flags: Column, separator: str = " | ") -> Column:
    return F.array_join(F.transform(flags, lambda f: f["message"]), separator)


def flag_rules(flags: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(flags, lambda f: f["rule"]), separator)


def file_name(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    decoded = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.when(name.contains("%"), decoded).otherwise(name)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
