"""Number columns: parsing of typed-in cells, exact sums, derived prices, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import strip

# Marks each kind of sheet may write inside a number.
CONTRACT_MARKS = "$,%"
TALLY_MARKS = ","
INVOICE_MARKS = "$,"
GRID_MARKS = "$,%"

_NUMERAL = r"^[+-]?(\d+(_\d+)*\.?|(\d+(_\d+)*)?\.\d+(_\d+)*)([eE][+-]?\d+)?$"
_SUM_TYPE = "decimal(28,10)"


def parse_number(c: Column, marks: str = GRID_MARKS) -> Column:
    """A cell as DOUBLE, null when blank or no number."""
    return read_number(number_text(c, marks))


def number_text(c: Column, marks: str = GRID_MARKS) -> Column:
    """A cell without the marks and the white space around its number."""
    return strip(F.translate(c, marks, ""))


def read_number(text: Column) -> Column:
    """The pattern guards the cast: the JVM would also read ``1d``, ``1f`` or ``NaN``."""
    return F.when(text.rlike(_NUMERAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def exact_sum(c: Column) -> Column:
    """Sum that does not depend on the order of the rows (ten decimal places)."""
    return F.sum(c.cast(_SUM_TYPE)).cast("double")


def derive_price(qty: Column, price: Column, amount: Column) -> Column:
    return F.coalesce(price, F.when(qty != 0, amount / qty))


def derive_amount(qty: Column, price: Column, amount: Column) -> Column:
    return F.coalesce(amount, qty * price)


def _strip_zeros(s: Column) -> Column:
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def significant(c: Column, group: bool = True) -> Column:
    """Six significant digits, no trailing zeros, thousands grouped: 2,580 · 1.5 · 1.23457e+06."""
    sci = F.format_string("%.5e", c.cast("double"))
    exponent = F.substring_index(sci, "e", -1).cast("int")
    fixed = _strip_zeros(F.call_function("format_number", c.cast("double"), F.greatest(F.lit(5) - exponent, F.lit(0))))
    small = _strip_zeros(F.substring_index(sci, "e", 1))
    text = (
        F.when(c == 0, F.lit("0"))
        .when((exponent < -4) | (exponent >= 6), F.concat(small, F.lit("e"), F.substring_index(sci, "e", -1)))
        .otherwise(fixed)
    )
    return text if group else F.replace(text, F.lit(","), F.lit(""))


def money(c: Column) -> Column:
    return F.format_number(c, 2)


def nearest(value: Column, choices: tuple[int, ...]) -> Column:
    """The closest of a few fixed values; a tie goes to the smaller one."""
    options = F.array(*[F.struct(F.abs(value - F.lit(b)).alias("gap"), F.lit(b).alias("pick")) for b in choices])
    return F.array_min(options)["pick"]
