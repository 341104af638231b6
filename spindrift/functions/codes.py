"""Place codes as columns: canonical spelling, parts, and rules on raw fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.errors import InvalidPlaceCode

NORTHERN_PREFIX = "BT"
MAX_EASTING, MAX_NORTHING = 700_000, 1_300_000


def squeezed(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"(?U)[\s\x1c-\x1f]", ""))


def canonical(raw: Column) -> Column:
    """Upper case, one space before the last three characters; null unless 5 to 7 characters are left."""
    c = squeezed(raw)
    return F.when(F.length(c).between(5, 7), F.concat(F.substring(c, F.lit(1), F.length(c) - 3), F.lit(" "), F.right(c, F.lit(3))))


def canonical_text(raw: str) -> str:
    """The same of one code; raises without repeating it."""
    c = "".join(raw.split()).upper()
    if not 5 <= len(c) <= 7:
        raise InvalidPlaceCode("a place code has 5 to 7 characters besides white space")
    return f"{c[:-3]} {c[-3:]}"


def population_code(raw: Column) -> Column:
    """The canonical code, or that of the text without its last character (parts of a split code)."""
    return F.coalesce(canonical(raw), canonical(F.substring(raw, F.lit(1), F.greatest(F.length(raw) - 1, F.lit(0)))))


def blank(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit(""))) == ""


def missing(x: Column, floating: bool = False) -> Column:
    """Null or blank, and of floating columns NaN; 0, false and the text NaN are values."""
    text = F.regexp_replace(x.cast("string"), r"(?U)\s", "")
    return x.isNull() | (text == "") | (F.isnan(x) if floating else F.lit(False))


def is_northern(code: Column) -> Column:
    return code.startswith(NORTHERN_PREFIX)


def on_grid(x: Column, y: Column) -> Column:
    return (x > 0) & (x < MAX_EASTING) & (y > 0) & (y < MAX_NORTHING)


def outward(code: Column) -> Column:
    return F.split_part(code, F.lit(" "), F.lit(1))


def settlement(indicator: Column, country: Column) -> Column:
    """urban, rural or unclassified, by an indicator's first sign; northern countries have none."""
    first = F.substring(F.trim(indicator), 1, 1)
    kind = F.when(first.isin("1", "2"), "urban").when(first.rlike("^[0-9]$"), "rural").when(F.upper(first) == "U", "urban").otherwise("rural")
    return F.when(blank(indicator) | F.coalesce(country.startswith("N"), F.lit(False)), "unclassified").otherwise(kind)


def cell(x: Column, y: Column, size: int, columns: int, rows: int) -> tuple[Column, Column]:
    """Grid cell of a point, clipped to the grid."""
    clip = lambda v, n: F.least(F.greatest(F.floor(v / size), F.lit(0)), F.lit(n - 1))
    return clip(x, columns), clip(y, rows)
