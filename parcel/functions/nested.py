"""Array / map / struct column functions (NE-*), higher-order built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcel.functions.parse import nullify_sentinels, to_float_pct, to_int, digits

# Fixed values that must match the reference's results.
# Outdoor-map source keys and their output column names (NE-5).
OUTDOOR_KEYS = {"Ligging": "location", "Tuin": "garden", "Achtertuin": "backyard",
                "Ligging tuin": "garden_location"}
# Neighbourhood-map source keys (NE-9).
NB_INHABITANTS = "Inhabitants in neighborhood"
NB_FAMILIES = "Families with children"
NB_PRICE_M2 = "Price per m² in neighborhood"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def facilities_list(c) -> Column:
    """NE-1: ' en ' -> ', ', split on ',', trim + lower, drop empties; NULL/N/A -> []."""
    text = nullify_sentinels(_col(c).cast("string"))
    items = F.transform(F.split(F.replace(text, F.lit(" en "), F.lit(", ")), ","),
                        lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.filter(items, lambda x: x != ""),
                      F.array().cast("array<string>"))


def indicator_name(item: str) -> str:
    """NE-3 column name for a vocabulary item: ``has_<item, spaces as _>``."""
    return "has_" + item.replace(" ", "_")


def indicator_item(name: str) -> str:
    """The item behind an indicator column's name (items have spaces, no underscores)."""
    return name.removeprefix("has_").replace("_", " ")


def outdoor_field(c, key: str) -> Column:
    """NE-5: one outdoor-map value; NULL, blank or 'N/A' -> NULL, otherwise trimmed."""
    return F.trim(nullify_sentinels(_col(c).getItem(key)))


def parcels_count(c) -> Column:
    """NE-6: number of parcel objects (non-array -> 0)."""
    return F.coalesce(F.size(_col(c)), F.lit(0)).cast("int")


def parcels_concat(c) -> Column:
    """NE-6: parcel names joined with '; ' (missing name -> '')."""
    return F.coalesce(
        F.array_join(F.transform(_col(c), lambda p: F.coalesce(p["parcel"], F.lit(""))), "; "),
        F.lit(""))


def first_or_empty(c) -> Column:
    """NE-7: first element of a list, '' when the list is missing or empty."""
    return F.coalesce(F.get(_col(c), 0), F.lit(""))


def join_or_empty(c, sep: str = "; ") -> Column:
    """NE-8: elements joined with ``sep``, '' when missing or empty."""
    return F.coalesce(F.array_join(_col(c), sep), F.lit(""))


def neighborhood_inhabitants(c) -> Column:
    """NE-9: inhabitants as an integer ('1.830' -> 1830)."""
    return to_int(_col(c).getItem(NB_INHABITANTS))


def neighborhood_families(c) -> Column:
    """NE-9: families-with-children share as a fraction ('38%' -> 0.38)."""
    return to_float_pct(_col(c).getItem(NB_FAMILIES))


def neighborhood_price_m2(c) -> Column:
    """NE-9: neighbourhood price per m² ('€ 5.990' -> 5990)."""
    return digits(_col(c).getItem(NB_PRICE_M2)).try_cast("double")


def first_non_null(*cols) -> Column:
    """NE-10: duplicate-column resolution, first non-NULL from left to right."""
    return F.coalesce(*[_col(c) for c in cols])
