"""Listing ingestion and sinks (SRC-1..SRC-11).

A listing is a JSON object; the reader always uses an explicit schema (no
inference pass over the data) in PERMISSIVE mode, so a malformed record
becomes NULL fields plus a ``_corrupt_record`` text instead of a failed job.
Schema-safe loading (SRC-3/4) is one projection: every expected field,
defaults for missing ones, text for numbers, a lone string promoted to a
one-element list, a JSON list of facilities joined into text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcel.sources.store import scratch_table

S = T.StringType()
CORRUPT = "_corrupt_record"
PARCEL = T.StructType([T.StructField("parcel", S), T.StructField("link", S)])

# The raw listing fields (strict schema) plus the scraper-only keys.
LISTING_FIELDS: list[tuple[str, T.DataType]] = [
    ("price", S), ("contribution_vve", S), ("size", S), ("external_storage", S),
    ("year_of_construction", S), ("nr_rooms", S), ("bathrooms", S), ("toilets", S),
    ("bedrooms", S), ("facilities", S), ("outdoor_features", T.MapType(S, S)),
    ("cadastral_parcels", T.ArrayType(PARCEL)), ("ownership_situations", T.ArrayType(S)),
    ("charges", T.ArrayType(S)), ("postal_code", S),
    ("neighborhood_details", T.MapType(S, S)), ("address", S), ("roof_type", S),
    ("status", S), ("ownership_type", S), ("location", S), ("energy_label", S),
    ("located_on", S), ("backyard", S), ("balcony", S),
    ("neighborhood", S), ("living_area", S), ("contribution", S),
]
LISTING_RAW = T.StructType([T.StructField(n, t) for n, t in LISTING_FIELDS])
ENVELOPE = T.StructType([T.StructField("success", T.BooleanType()),
                         T.StructField("url", S),
                         T.StructField("data", LISTING_RAW),
                         T.StructField("error", S)])


def read_listings_json(spark: SparkSession, path: str | Sequence[str], multiline: bool = False,
                       extra: Sequence[T.StructField] = ()) -> DataFrame:
    """SRC-1 / SRC-2: listing JSON files (local or object-store path/glob), fixed schema.

    ``multiline=True`` reads one object per file (pretty-printed files); the
    default reads JSON lines. An empty prefix yields an empty frame. ``extra`` adds fields, such as
    an id. Text that is no listing object comes back whole in ``_corrupt_record``.
    """
    schema = T.StructType([*LISTING_RAW.fields, *extra, T.StructField(CORRUPT, S)])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("multiLine", multiline)
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_envelopes_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Scrape envelopes ``{success, url, data, error}`` as JSON."""
    return (spark.read.schema(ENVELOPE).option("mode", "PERMISSIVE")
            .option("multiLine", multiline).json(path))


def _text_list(c: Column) -> Column:
    """A JSON text that may hold a list of strings -> ', '-joined text (SRC-3)."""
    as_list = F.from_json(c, T.ArrayType(S))
    return F.when(F.trim(c).startswith("["), F.array_join(as_list, ", ")).otherwise(c)


def conform_listing(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """SRC-3 / SRC-4: every expected field present in fixed order, defaults for missing.

    Defaults: NULL for scalars, '' for facilities, empty map / list for nested.
    Extra columns are dropped, but the text of a record that could not be read stays
    (``errors.with_errors`` reports it). Works on any DataFrame (a JSON read, a table of
    manual inputs, a stream).
    """
    defaults = defaults or {}
    cols = []
    for name, dtype in LISTING_FIELDS:
        if name in df.columns:
            src = df.schema[name].dataType
            c = F.col(name)
            if isinstance(dtype, T.ArrayType) and isinstance(src, T.StringType):
                c = F.when(c.isNull(), F.lit(None)).otherwise(F.array(c))
            elif dtype == S and not isinstance(src, T.StringType):
                c = c.cast("string") if not isinstance(src, (T.ArrayType, T.MapType,
                                                              T.StructType)) \
                    else F.to_json(c)
            if name == "facilities":
                c = _text_list(c)
            c = c.cast(dtype)
        else:
            c = F.lit(defaults.get(name)).cast(dtype)
        if name == "facilities":
            c = F.coalesce(c, F.lit(""))
        elif isinstance(dtype, T.MapType):
            c = F.coalesce(c, F.create_map().cast(dtype))
        elif isinstance(dtype, T.ArrayType):
            c = F.coalesce(c, F.array().cast(dtype))
        cols.append(c.alias(name))
    keep = [F.col(k) for k in ("listing_id", "url", CORRUPT) if k in df.columns]
    return df.select(*keep, *cols)


def unwrap_envelope(df: DataFrame, data_col: str = "data", depth: int = 2) -> DataFrame:
    """SRC-5: listing fields from ``data`` (recursively, for doubly wrapped envelopes)
    falling back to same-named top-level fields."""
    out = df
    for _ in range(depth):
        if data_col not in out.columns:
            break
        dtype = out.schema[data_col].dataType
        if not isinstance(dtype, T.StructType):
            break
        inner = {f.name for f in dtype.fields}
        sel = []
        for name in set(inner) | {c for c in out.columns if c != data_col}:
            a = F.col(f"{data_col}.{name}") if name in inner else None
            b = F.col(name) if name in out.columns and name != data_col else None
            if a is not None and b is not None and \
                    out.schema[name].dataType == dtype[name].dataType:
                c = F.coalesce(a, b)
            else:
                c = a if a is not None else b
            sel.append(c.alias(name))
        out = out.select(*sel)
    return out


def read_csv_dimension(spark: SparkSession, path: str, schema: T.StructType,
                       keep: Sequence[str]) -> DataFrame:
    """SRC-6: CSV with header, explicit schema, only the recognised columns kept."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(*[c for c in keep if c in df.columns])


def write_dimension(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SRC-7: overwrite a dimension table (parquet or CSV with header)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def persist_pages(parsed: DataFrame, raw: DataFrame, out_dir: str, load_date: str) -> None:
    """SRC-8: parsed records as JSON and raw html as Parquet, partitioned by load date,
    both keyed by the same page id."""
    d = F.lit(load_date).cast("date").alias("load_date")
    parsed.withColumn("load_date", d).write.mode("append").partitionBy("load_date") \
        .json(f"{out_dir.rstrip('/')}/parsed_json")
    raw.withColumn("load_date", d).write.mode("append").partitionBy("load_date") \
        .parquet(f"{out_dir.rstrip('/')}/raw_html")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: a text file of URLs, trimmed, blank lines dropped."""
    return (spark.read.text(path).select(F.trim("value").alias("url"))
            .where(F.length("url") > 0))


def write_url_list(df: DataFrame, path: str, col: str = "url") -> None:
    """SRC-11: one URL per line."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def sitemap_locs(xml: Column) -> Column:
    """SRC-10: all ``<loc>`` values of a sitemap / sitemap-index document (namespaces
    stripped first so the XPath stays plain)."""
    plain = F.regexp_replace(xml, r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    return F.xpath(plain, F.lit("//loc/text()"))


def sitemap_pages(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """SRC-10: page URLs reachable from the root sitemaps. ``documents`` (url, xml) holds the fetched
    sitemaps, ``roots`` (url) where to start. An index names further sitemaps, which are followed
    until no new one turns up, so cycles end; every page comes out once. A frontier is anti-joined
    with what has been visited; documents are parsed once, before the first round."""
    locs = scratch_table(documents.select(
        F.col("url").alias("sitemap"), F.col("xml").contains("<sitemapindex").alias("is_index"),
        F.explode(sitemap_locs(F.col("xml"))).alias("url")).distinct())
    frontier = scratch_table(roots.select("url").distinct())
    visited = frontier
    while not frontier.isEmpty():
        children = locs.where("is_index").join(frontier.withColumnRenamed("url", "sitemap"), "sitemap", "left_semi")
        frontier = scratch_table(children.select("url").distinct().join(visited, "url", "left_anti"))
        visited = scratch_table(visited.union(frontier))
    return locs.where("not is_index").join(visited.withColumnRenamed("url", "sitemap"), "sitemap", "left_semi").select(
        "url").distinct()
