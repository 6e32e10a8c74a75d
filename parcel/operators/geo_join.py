"""Geographic joins (JN-1..JN-3, WN-1, AG-1).

* The geocode cache is deduplicated with a grouped ``min`` over a struct
  (partial aggregation), not a window: an address that holds a third of all
  rows collapses map-side instead of landing in one task.
* The radius join is a grid-cell equi-join over distinct coordinates, one grid for each
  largest radius R of a type. The amenities are indexed once: every cell of size R lists what its
  3x3 neighbourhood holds, in chunks of CHUNK_POINTS where that is much. A point looks up its own
  cell, the exact haversine filter runs on the candidates, and counts are aggregated per coordinate
  before joining back. The index is a table that batches and micro-batches share.
  A cell with more than ``hot_rows`` points is cut into hash slices of points, each joined with
  its own copy of the cell's chunks; the table of such cells is bounded by construction (cells
  above N / MAX_HOT_CELLS points) and is the only broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.functions import geo as G
from parcel.sources.store import scratch_table

# Fixed values that must match the reference's results (amenity radii, km).
AMENITY_RADIUS_KM = {
    "school": [0.5, 1.0], "park": [0.5, 1.0], "supermarket": [0.5, 1.0],
    "hospital": [1.0, 2.0], "bus_stop": [0.5, 1.0], "tram_stop": [0.5, 1.0],
    "metro_stop": [0.5, 1.0], "light_rail_stop": [0.5, 1.0],
}
# 110 km per degree is deliberately below the true ~111.2: cells are never
# smaller than the radius, so the 3x3 neighbourhood always covers it.
KM_PER_DEGREE_LOWER = 110.0
# A join slice holds at most about this many points of one cell ...
HOT_CELL_ROWS = 200_000
# ... raised so that at most this many cells count as hot (broadcast bound).
MAX_HOT_CELLS = 10_000
# Amenities packed into one index row, about.
CHUNK_POINTS = 4_096
CELL = ["grid", "cy", "cx"]


def dedupe_geo_dim(geo: DataFrame, key: str = "address") -> DataFrame:
    """WN-1: one coordinate per address: smallest lat (NULLs last), then lon; NULL dropped."""
    best = F.min(F.struct(F.col("lat").isNull().alias("lat_null"), F.col("lat").alias("lat"),
                          F.col("lon").isNull().alias("lon_null"), F.col("lon").alias("lon")))
    return (geo.groupBy(key).agg(best.alias("b"))
            .select(key, F.col("b.lat").alias("lat"), F.col("b.lon").alias("lon"))
            .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))


def attach_coordinates(df: DataFrame, geo_dim: DataFrame, key: str = "address",
                       more: Sequence[str] = ()) -> DataFrame:
    """JN-1: left equi-join on the address (the planner picks broadcast only when small). ``more``
    names columns of ``geo_dim`` that come along."""
    base = df.drop("lat", "lon") if "lat" in df.columns else df
    return base.join(geo_dim.select(key, "lat", "lon", *more), key, "left")


def centroids(df: DataFrame, key: str) -> DataFrame:
    """AG-1: mean lat/lon per key over rows with both coordinates. Fit it on training rows."""
    return (df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()
                     & F.col(key).isNotNull())
            .groupBy(key).agg(F.avg("lat").alias(f"{key}_lat"), F.avg("lon").alias(f"{key}_lon")))


def fold_centroids(df: DataFrame, key: str, part: str, targets: Sequence) -> DataFrame:
    """``centroids`` of the rows of all parts but one, for each part in ``targets`` (None: of all
    rows), by one aggregation: (target, key, <key>_lat, <key>_lon)."""
    own = lambda c, t: F.col(c) if t is None else F.when(F.col(part) != t, F.col(c))
    sums = (df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(key).isNotNull())
            .groupBy(key).agg(*[f(own(c, t)).alias(f"{c}{j}") for j, t in enumerate(targets)
                                for f, c in ((F.avg, "lat"), (F.avg, "lon"))]))
    each = F.array(*[F.struct(F.lit(-1 if t is None else t).alias("target"), F.col(f"lat{j}").alias(f"{key}_lat"),
                              F.col(f"lon{j}").alias(f"{key}_lon")) for j, t in enumerate(targets)])
    return sums.select(key, F.inline(each)).where(F.col(f"{key}_lat").isNotNull())


def fill_coordinates(df: DataFrame, postal: DataFrame | None, neighbourhood: DataFrame | None,
                     postal_key: str = "postal_code_clean", nb_key: str = "neighborhood",
                     center=G.CITY_CENTER, more: dict[str, Column] | None = None) -> DataFrame:
    """JN-2: own coordinate -> postal centroid -> neighbourhood centroid -> city centre.

    ``lat_lon_missing`` flags rows that had no own coordinate (computed
    before filling; A-11). The coordinate pair is taken from one source, and so are the columns
    of ``more`` (name -> value at the city centre; the centroids' are named ``<key>_<name>``).
    """
    out = df.withColumn("lat_lon_missing",
                        (F.col("lat").isNull() | F.col("lon").isNull()).cast("int"))
    last = {"lat": F.lit(center[0]), "lon": F.lit(center[1]), **(more or {})}
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    new = {c: F.when(own, F.col(c)) for c in last}
    drop = []
    for key, table in ((postal_key, postal), (nb_key, neighbourhood)):
        if table is not None:
            out = out.join(table, key, "left")
            has = F.col(f"{key}_lat").isNotNull()
            new = {c: v.when(has, F.col(f"{key}_{c}")) for c, v in new.items()}
            drop += [f"{key}_{c}" for c in last]
    return out.withColumns({c: v.otherwise(last[c]) for c, v in new.items()}).drop(*drop)


def count_column(amenity: str, r_km: float) -> str:
    return f"count_{amenity}_within_{int(r_km * 1000)}m"


def build_amenity_index(amenities: DataFrame, radius_km: dict[str, Sequence[float]] = AMENITY_RADIUS_KM,
                        chunk: int = CHUNK_POINTS) -> tuple[DataFrame, dict]:
    """Cell index of amenities: (grid, cy, cx, points), where ``points`` packs what can lie within the
    grid's largest radius of a point in the cell, in chunks of about ``chunk`` for dense cells. There is
    one grid per largest radius of a type. The second result says how points find their cells."""
    types = list(radius_km)
    code = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("amenity_type")) - 1
    rows = (amenities.where(F.col("amenity_type").isin(types) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .groupBy(code.cast("int").alias("t"), "lat", "lon").agg(F.count(F.lit(1)).alias("n")))
    widest = amenities.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    largest = sorted({max(rs) for rs in radius_km.values()})
    # a point within reach of an amenity lies at most this far from the equator
    lat_max = min(widest + largest[-1] / KM_PER_DEGREE_LOWER, 89.0)
    spec = {"radius_km": {t: list(rs) for t, rs in radius_km.items()}, "lat_max": lat_max}
    near = [F.struct(F.lit(oy).alias("oy"), F.lit(ox).alias("ox")) for oy in (-1, 0, 1) for ox in (-1, 0, 1)]
    grid_of = F.array(*[F.lit(largest.index(max(radius_km[t]))) for t in types])
    placed = rows.withColumn("grid", F.get(grid_of, F.col("t"))).withColumn("o", F.explode(F.array(*near)))
    cy, cx = F.lit(None).cast("long"), F.lit(None).cast("long")
    for g, (dy, dx) in enumerate(_cell_sizes(spec)):
        cy = F.when(F.col("grid") == g, F.floor(F.col("lat") / dy) + F.col("o.oy")).otherwise(cy)
        cx = F.when(F.col("grid") == g, F.floor(F.col("lon") / dx) + F.col("o.ox")).otherwise(cx)
    placed = placed.select("grid", cy.alias("cy"), cx.alias("cx"), "t", "lat", "lon", "n")
    dense = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > chunk)
    part = F.pmod(F.xxhash64("t", "lat", "lon"), F.ceil(F.coalesce("_m", F.lit(1)) / chunk))
    index = placed.join(dense, CELL, "left").withColumn("_chunk", part).groupBy(*CELL, "_chunk").agg(
        F.collect_list(F.struct("t", "lat", "lon", "n")).alias("points"))
    return index.drop("_chunk"), spec


def _cell_sizes(spec: dict) -> list[tuple[float, float]]:
    """Cell height and width in degrees per grid."""
    narrow = math.cos(math.radians(spec["lat_max"]))
    return [(r / KM_PER_DEGREE_LOWER, r / (KM_PER_DEGREE_LOWER * narrow))
            for r in sorted({max(rs) for rs in spec["radius_km"].values()})]


def amenity_counts(points: DataFrame, index: DataFrame, spec: dict, bins: bool = True,
                   hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """JN-3 + GE-3 through a prebuilt index: ``points`` (lat, lon, ...) plus the number of amenities
    of each type within each radius (inclusive), 0 for points without coordinates and for types
    without amenities. Points look up their own cell only; nothing is replicated per batch."""
    cells = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).distinct().select(
            "p_lat", "p_lon", F.inline(F.array(*[F.struct(
                F.lit(g).alias("grid"), F.floor(F.col("p_lat") / dy).alias("cy"),
                F.floor(F.col("p_lon") / dx).alias("cx"))
                for g, (dy, dx) in enumerate(_cell_sizes(spec))])))
    cells = scratch_table(cells)
    limit = max(hot_rows, math.ceil(cells.count() / MAX_HOT_CELLS))
    # cells of very many points, at most MAX_HOT_CELLS of them, are joined in slices of points
    hot = F.broadcast(cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
                      .select(*CELL, F.ceil(F.col("_n") / limit).cast("int").alias("_slices")))
    slices = F.coalesce("_slices", F.lit(1))
    mine = cells.join(hot, CELL, "left").withColumn("_slice", F.pmod(F.xxhash64("p_lat", "p_lon"), slices).cast("int"))
    theirs = index.join(hot, CELL, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    near = mine.join(theirs, [*CELL, "_slice"]).select("p_lat", "p_lon", F.inline("points")).withColumn(
        "d_km", G.haversine_m("p_lat", "p_lon", "lat", "lon") / 1000.0)
    cols = [(i, t, r) for i, (t, rs) in enumerate(spec["radius_km"].items()) for r in rs]
    counts = near.groupBy("p_lat", "p_lon").agg(*[
        F.sum(F.when((F.col("t") == i) & (F.col("d_km") <= r), F.col("n")).otherwise(0)).cast("bigint")
        .alias(count_column(t, r)) for i, t, r in cols])
    names = [count_column(t, r) for _, t, r in cols]
    out = points.join(counts, (F.col("lat") == F.col("p_lat")) & (F.col("lon") == F.col("p_lon")), "left").drop(
        "p_lat", "p_lon").na.fill(0, names)
    return out.withColumns({f"{c}_bin_encoded": G.count_bin(F.col(c)) for c in names}) if bins else out


def counted_places(points: DataFrame, index: DataFrame, spec: dict) -> DataFrame:
    """The distinct places of ``points`` (lat, lon) with their amenity counts."""
    places = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct()
    return amenity_counts(places, index, spec, bins=False)


def radius_counts(points: DataFrame, amenities: DataFrame,
                  radius_km: dict[str, Sequence[float]] = AMENITY_RADIUS_KM, bins: bool = True,
                  hot_rows: int = HOT_CELL_ROWS, chunk: int = CHUNK_POINTS) -> DataFrame:
    """JN-3 + GE-3 in one call: index the amenities, count around the points."""
    index, spec = build_amenity_index(amenities, radius_km, chunk)
    return amenity_counts(points, scratch_table(index), spec, bins, hot_rows)
