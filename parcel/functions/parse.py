"""Text -> number / category column functions (built-in expressions only).

Every function maps ``Column -> Column`` so it stays inside whole-stage
codegen. ANSI mode is on in Spark 4, so parsing uses ``try_cast`` and
ratios ``try_divide``: a malformed value becomes NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's results.
# Missing-value sentinels in scraped text.
SENTINELS = ["N/A", ""]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullify_sentinels(c) -> Column:
    """SC-18: 'N/A', '' (after trim) and NULL all become NULL."""
    c = _col(c)
    return F.when(F.trim(c).isin(*SENTINELS), F.lit(None).cast("string")).otherwise(c)


def digits(c) -> Column:
    """All decimal digits of the text representation, in order."""
    return F.regexp_replace(_col(c).cast("string"), r"[^0-9]", "")


def parse_price(c) -> Column:
    """SC-1: keep digits -> bigint; no digits -> NULL ('€ 500.000' -> 500000)."""
    return digits(c).try_cast("bigint")


def parse_size(c) -> Column:
    """SC-2: same digits rule ('86 m²' -> 86, the superscript is not a digit)."""
    return digits(c).try_cast("bigint")


def to_int(c, numeric: bool = False) -> Column:
    """SC-3: numbers truncate, text keeps its digits (thousand separators vanish)."""
    c = _col(c)
    if numeric:
        return c.try_cast("bigint")
    return digits(c).try_cast("bigint")


def to_float_pct(c, numeric: bool = False) -> Column:
    """SC-4: percentage text -> fraction ('38%' -> 0.38)."""
    c = _col(c)
    if numeric:
        return c.cast("double") / F.lit(100.0)
    return digits(c).try_cast("double") / F.lit(100.0)


def to_float_currency(c) -> Column:
    """SC-5: keep [0-9.], merge every dot after the first, parse as double."""
    s = F.regexp_replace(F.trim(_col(c).cast("string")), r"[^0-9.]", "")
    first = F.instr(s, ".")
    merged = F.when(first > 0, F.concat(
        F.substring_index(s, ".", 1), F.lit("."),
        F.regexp_replace(F.substring(s, first + 1, 1 << 30), r"\.", ""))).otherwise(s)
    return merged.try_cast("double")


def parse_year(c) -> Column:
    """SC-6: 'Voor Y' -> Y-1, 'Na Y' -> Y+1, all digits -> Y, otherwise NULL."""
    c = _col(c).cast("string")
    last = F.element_at(F.split(F.trim(c), r"\s+"), -1).try_cast("bigint")
    return (F.when(c.startswith("Voor"), last - 1)
            .when(c.startswith("Na"), last + 1)
            .when(c.rlike(r"^[0-9]+$"), c.try_cast("bigint")))


POSTAL_RE = r"^([0-9]{4}\s?[A-Z]{2})\s*(.*)$"


def postal_code_clean(c) -> Column:
    """SC-7 (code part): upper/trim, anchored '\\d{4}\\s?[A-Z]{2}'; no match -> the text."""
    s = F.upper(F.trim(_col(c)))
    return F.when(s.rlike(POSTAL_RE), F.regexp_extract(s, POSTAL_RE, 1)).otherwise(s)


def postal_city(c) -> Column:
    """SC-7 (city part): rest after the code, NULL when empty or unmatched."""
    s = F.upper(F.trim(_col(c)))
    return F.when(s.rlike(POSTAL_RE), F.nullif(F.regexp_extract(s, POSTAL_RE, 2), F.lit("")))


def prefix(c, n: int) -> Column:
    """SC-14: first n characters (postal district = 3, PC4 = 4)."""
    return F.substring(_col(c).cast("string"), 1, n)


def to_float(c, numeric: bool = False) -> Column:
    """SC-8: keep [0-9.] and parse; malformed ('1.2.3', '.') -> NULL."""
    c = _col(c)
    if numeric:
        return c.cast("double")
    return F.regexp_replace(c.cast("string"), r"[^0-9.]", "").try_cast("double")


def extract_floor(c) -> Column:
    """SC-9: first integer; NULL, 'N/A', 'Begane grond' or no digits -> 0."""
    c = _col(c).cast("string")
    first = F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit("")).try_cast("int")
    return (F.when(c.isNull() | c.isin("N/A", "Begane grond"), F.lit(0))
            .otherwise(F.coalesce(first, F.lit(0))))


LEASE_RE = r"einddatum erfpacht: ([0-9]{2})-([0-9]{2})-([0-9]{4})"


def extract_lease_years(c, current_year: int = 2025) -> Column:
    """SC-10: years left on the lease (>= 0); freehold, blank or no date -> NULL."""
    c = _col(c).cast("string")
    year = F.nullif(F.regexp_extract(c, LEASE_RE, 3), F.lit("")).try_cast("int")
    blank = c.isNull() | (F.trim(c) == "") | c.contains("Volle eigendom")
    # greatest() skips NULLs: guard so a text without an end date stays NULL.
    return F.when(blank | year.isNull(), F.lit(None).cast("int")).otherwise(
        F.greatest(year - F.lit(current_year), F.lit(0)))


def simplify_roof(c) -> Column:
    """SC-11: roof text -> Flat/Saddle/Composite/Mansard/Other/Unknown."""
    c = _col(c).cast("string")
    return (F.when(c.isNull() | (c == "N/A"), "Unknown")
            .when(c.contains("Plat dak"), "Flat")
            .when(c.contains("Zadeldak"), "Saddle")
            .when(c.contains("Samengesteld dak"), "Composite")
            .when(c.contains("Mansarde"), "Mansard")
            .otherwise("Other"))


def simplify_ownership(c) -> Column:
    """SC-12: ownership text -> Full/Municipal/Leasehold/Other/Unknown."""
    c = _col(c).cast("string")
    return (F.when(c.isNull() | (F.trim(c) == ""), "Unknown")
            .when(c.contains("Volle eigendom"), "Full")
            .when(c.contains("Erfpacht") & c.contains("Gemeentelijk"), "Municipal")
            .when(c.contains("Erfpacht"), "Leasehold")
            .otherwise("Other"))


def simplify_location(c) -> Column:
    """SC-13: location text -> Central/Residential/OpenView/Park/Other/Unknown."""
    c = _col(c).cast("string")
    return (F.when(c.isNull(), "Unknown")
            .when(c.contains("centrum"), "Central")
            .when(c.contains("woonwijk"), "Residential")
            .when(c.contains("vrij uitzicht"), "OpenView")
            .when(c.contains("park"), "Park")
            .otherwise("Other"))


def presence_flag(c) -> Column:
    """SC-15: NULL or 'N/A' -> 0, anything else -> 1."""
    c = _col(c)
    return F.when(c.isNull() | (c.cast("string") == "N/A"), F.lit(0)).otherwise(F.lit(1))


def coerce_numeric(c) -> Column:
    """SC-16: text -> double, unparseable -> NULL."""
    return F.trim(_col(c).cast("string")).try_cast("double")


def param_number(c) -> Column:
    """SC-20: parameter text -> double (NULL when not a number)."""
    return F.trim(_col(c).cast("string")).try_cast("double")


def param_integral(c) -> Column:
    """SC-20: the integral form of a parameter value, NULL when it has a fraction."""
    x = param_number(c)
    return F.when(x == F.floor(x), x.try_cast("bigint"))


def safe_ratio(a, b) -> Column:
    """SC-19 / FE-11: a / b with zero or NULL denominators -> NULL (fill later)."""
    return F.try_divide(_col(a).cast("double"), F.nullif(_col(b).cast("double"), F.lit(0.0)))
