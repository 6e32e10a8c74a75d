"""Listing-shaped relations derived from the driver tables.

The driver ships TPC-H-like tables, not listings, so every listing operator
runs on a deterministic view built from ``orders`` x ``customer`` x
``nation`` with integer arithmetic only (portable across engines). Every
raw field is text, exactly as a scraper would deliver it. Nested fields
(maps, arrays of structs) are built here so the flattening operators have
real nested input.

Scale: ``orders`` joins ``customer`` on the customer key (a shuffle join
chosen by the planner; AQE broadcasts customer only when its measured size
is under the threshold); ``nation`` has a fixed 25 rows, which the planner broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.sources.tables import table


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(key: Column, values: list, default=None) -> Column:
    """``case key when 0 then v0 when 1 then v1 ... else default``."""
    expr = None
    for i, v in enumerate(values):
        v = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d)


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings: one row per order, text fields as scraped, plus lat/lon."""
    o = table(spark, sf_dir, "orders", spread=True).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("o_orderkey")
    cu = F.col("c_custkey")
    m2 = F.lit(" m²")
    price = (F.when(k % 29 == 0, F.lit("Prijs op aanvraag"))
             .otherwise(F.concat(F.lit("€ "), _s(F.floor("o_totalprice")), F.lit(" k.k."))))
    size = F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(_s(20 + k % 180), m2))
    year = (F.when(k % 11 == 0, F.lit("Voor 1906")).when(k % 13 == 0, F.lit("Na 2020"))
            .otherwise(_s(1900 + k % 120)))
    postal = F.when(cu % 31 == 0, F.lit("onbekend")).otherwise(
        F.concat(_s(1000 + cu % 100), F.lit(" AB Amsterdam")))
    facilities = _case(k % 5, ["Lift, schuifpui en TV kabel", "N/A", None, "Sauna, lift",
                               "Zonnepanelen en airconditioning, , Lift"])
    energy = _case(k % 12, ["G", "F", "E", "D", "C", "B", "A", "A+", "A++", "A+++", "A++++"])
    lat = F.when(cu % 17 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(52.3) + (cu % 997).cast("double") / F.lit(9970.0))
    lon = F.when(cu % 17 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(4.77) + (cu % 991).cast("double") / F.lit(5505.0))
    contribution = F.when(k % 9 == 0, F.lit("N/A")).otherwise(
        F.concat(F.lit("€ "), _s(50 + k % 400), F.lit(" per maand")))
    storage = F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(_s(k % 15), m2))
    rooms = F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(_s(k % 8))
    located_on = _case(k % 6, ["Begane grond", "N/A", None],
                       F.concat(_s(k % 6 - 1), F.lit("e woonlaag")))
    ownership = F.when(k % 19 == 0, F.lit(None).cast("string")).otherwise(_case(k % 4, [
        "Volle eigendom",
        F.concat(F.lit("Erfpacht en Gemeentelijk eigendom, einddatum erfpacht: 01-09-"),
                 _s(2000 + k % 100)),
        F.concat(F.lit("Erfpacht, einddatum erfpacht: 15-03-"), _s(2030 + k % 70)),
    ], "Eigendom onbekend"))
    roof = _case(k % 7, ["Plat dak", "Zadeldak bedekt met pannen", "Samengesteld dak",
                         "Mansarde dak", "Lessenaardak", "N/A"])
    ligging = _case(cu % 7, ["In centrum", "In woonwijk", "Aan park", "Met vrij uitzicht",
                             "Aan water", "N/A", ""])
    tuin = _case(k % 4, ["Achtertuin", "Voortuin", "N/A"])
    achtertuin = F.when(k % 3 == 0, F.concat(_s(k % 60), m2))
    ligging_tuin = F.when(k % 2 == 0, F.concat(F.lit(" Gelegen op het "),
                                                _case(k % 8, ["zuiden", "noorden", "oosten",
                                                              "westen"], "zuidwesten")))
    outdoor = F.when(k % 10 == 9, F.lit(None)).otherwise(F.create_map(
        F.lit("Ligging"), ligging, F.lit("Tuin"), tuin,
        F.lit("Achtertuin"), achtertuin, F.lit("Ligging tuin"), ligging_tuin))
    parcel = lambda i: F.struct(
        F.concat(F.lit("AMSTERDAM K "), _s(cu), F.lit(f" G{i}")).alias("parcel"),
        F.concat(F.lit("https://kadaster.example/"), _s(k), F.lit(f"/{i}")).alias("link"))
    parcels = _case(k % 3, [F.array().cast("array<struct<parcel:string,link:string>>"),
                            F.array(parcel(1))], F.array(parcel(1), parcel(2)))
    charges = _case(k % 3, [F.array().cast("array<string>"), F.array(F.lit("Afkoopsom"))],
                    F.array(F.lit("Canon"), F.concat(F.lit("€ "), _s(k % 500))))
    neighborhood_details = F.when(cu % 13 == 0, F.lit(None)).otherwise(F.create_map(
        F.lit("Inhabitants in neighborhood"),
        F.concat(_s(1 + cu % 9), F.lit("."), F.lpad(_s(cu % 1000), 3, "0")),
        F.lit("Families with children"), F.concat(_s(cu % 60), F.lit("%")),
        F.lit("Price per m² in neighborhood"),
        F.concat(F.lit("€ "), _s(3 + cu % 7), F.lit("."), F.lpad(_s(cu % 1000), 3, "0"))))
    balcony = _case(k % 3, ["Balkon aanwezig", "N/A"])
    return j.select(
        k.alias("listing_id"),
        F.concat(F.lit("Straat "), _s(cu)).alias("address"),
        price.alias("price"),
        contribution.alias("contribution_vve"),
        size.alias("size"),
        storage.alias("external_storage"),
        year.alias("year_of_construction"),
        rooms.alias("nr_rooms"),
        _s(k % 3).alias("bathrooms"),
        _s(1 + k % 2).alias("toilets"),
        _s(k % 5).alias("bedrooms"),
        facilities.alias("facilities"),
        outdoor.alias("outdoor_features"),
        parcels.alias("cadastral_parcels"),
        F.when(ownership.isNull(), F.array().cast("array<string>"))
         .otherwise(F.array(ownership)).alias("ownership_situations"),
        charges.alias("charges"),
        postal.alias("postal_code"),
        neighborhood_details.alias("neighborhood_details"),
        roof.alias("roof_type"),
        F.col("o_orderstatus").alias("status"),
        energy.alias("energy_label"),
        located_on.alias("located_on"),
        balcony.alias("balcony"),
        F.col("n_name").alias("neighborhood"),
        lat.alias("lat"),
        lon.alias("lon"),
    )


AMENITY_TYPES = ["school", "park", "supermarket", "hospital", "bus_stop", "tram_stop",
                 "metro_stop", "light_rail_stop"]


def amenity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amenity points (amenity_id, amenity_type, lat, lon) derived from ``supplier``."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    types = F.array(*[F.lit(t) for t in AMENITY_TYPES])
    return s.select(
        k.alias("amenity_id"),
        F.element_at(types, (k % 8 + 1).cast("int")).alias("amenity_type"),
        (F.lit(52.3) + ((k * 37) % 1000).cast("double") / F.lit(10000.0)).alias("lat"),
        (F.lit(4.77) + ((k * 53) % 1000).cast("double") / F.lit(5555.0)).alias("lon"),
    )


def geo_dimension(listings: DataFrame) -> DataFrame:
    """Address -> coordinate observations (the geocode cache), one row per listing: an address
    has several, some without a coordinate; two postal districts and one neighbourhood have
    none at all."""
    street = F.substring_index("address", " ", -1).cast("long")
    k = F.col("listing_id")
    none = (street % 100).isin(7, 57) | (F.col("neighborhood") == F.lit("NATION_7")) | (k % 5 == 0)
    return listings.select(
        "address", F.when(~none, F.col("lat") + (k % 3) * F.lit(0.001)).alias("lat"),
        F.when(~none, F.col("lon") + (k % 2) * F.lit(0.002)).alias("lon"), "price", "neighborhood",
        "size")
