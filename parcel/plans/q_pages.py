"""Catalogue: page extraction, URL operators, sitemaps, free-text regexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcel.operators import pages as PG
from parcel.plans.oracle_base import with_listing
from parcel.sources.ingest import sitemap_locs, sitemap_pages
from parcel.sources.listings import listing_view
from parcel.sources.tables import table

LOAD_TS = "2025-01-01 00:00:00"


def _pages(spark, sf):
    # HTML tokenizing is the heaviest per-row work: spread the scan over all cores.
    return table(spark, sf, "pages", spread=True)


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """PG-1 (first-match text), PG-3-style list walk, element counts per page."""
    p = _pages(spark, sf).select("page_id", PG.html_elements(F.col("html")).alias("els"))
    e = F.col("els")
    nav = F.transform(PG.select_all(e, "nav li"), lambda x: x["text"])
    return p.select(
        "page_id",
        PG.select_text(e, "title").alias("title"),
        PG.select_text(e, "h1").alias("h1"),
        F.size(F.filter(e, lambda x: x["tag"] == "a")).alias("n_links"),
        F.size(F.filter(e, lambda x: x["tag"] == "p")).alias("n_paragraphs"),
        F.array_join(nav, "|").alias("nav_items"),
        PG.select_text(e, "footer").alias("footer"))


def page_listing_extract(spark: SparkSession, sf: str) -> DataFrame:
    """PG-1..PG-9: the listing extractor over every page (fields absent -> 'N/A')."""
    out = PG.extract_listing(_pages(spark, sf), keep=["page_id"])
    return out.select("page_id", "success", *PG.SCALAR_FIELDS,
                      F.size("cadastral_parcels").alias("n_parcels"),
                      F.size(F.map_filter("outdoor_features", lambda k, v: v.isNotNull()))
                      .alias("n_outdoor"))


def rendered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url, html): every listing as the page it would be scraped from, an absent field
    leaving no trace. One page in forty has no listing on it, one is cut off in markup."""
    v = listing_view(spark, sf)
    c = F.col
    tag = lambda before, value, after: F.coalesce(F.concat(
        F.lit(before), F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(after)), F.lit(""))
    pair = lambda label, value: tag(f"<dt>{label}</dt>\n<dd>", value, "</dd>")
    icon = lambda label, value: tag(
        f'<li class="flex"><span class="ml-1">{label}</span><span class="md:font-bold">', value, "</span></li>")
    box = lambda label, key: tag(
        f'<div class="flex justify-between border-b"><dt>{label}</dt><dd>', c("neighborhood_details")[key],
        "</dd></div>")
    labels = {"contribution_vve": "Bijdrage VvE", "year_of_construction": "Bouwjaar",
              "roof_type": "Soort dak", "external_storage": "Externe bergruimte",
              "balcony": "Balkon/dakterras", "located_on": "Gelegen op", "facilities": "Voorzieningen"}
    parcels = F.array_join(F.transform("cadastral_parcels", lambda p: F.concat(
        F.lit("<dt>"), p["parcel"], F.lit('</dt><dd>kaart <a href="'), p["link"], F.lit('">hier</a></dd>'))), "")
    section = lambda name, *parts: F.concat(
        F.lit(f'<div data-testid="category-{name}"><dl>'), *parts, F.lit("</dl></div>"))
    listed = lambda col, label: F.array_join(F.transform(
        col, lambda x: F.concat(F.lit(f"<dt>{label}</dt><dd>"), x, F.lit("</dd>"))), "")
    html = F.concat(
        F.lit('<html><body><div class="flex items-baseline">'),
        tag('<div class="bg-red-70 px-2">', c("status"), "</div>"), F.lit("</div>"),
        F.concat(F.lit('<h1 data-global-id="'), c("listing_id").cast("string"), F.lit('">')),
        tag('<span class="block font-bold">', c("address"), "</span>"),
        tag('<span class="text-neutral-40">', c("postal_code"), "</span>"),
        tag('<a href="/buurt">', c("neighborhood"), "</a></h1>"),
        tag('<div class="text-xl flex flex-col"><div class="flex gap-2 font-bold"><span> ', c("price"),
            "</span></div></div>"),
        F.lit("<ul>"), icon("Wonen", c("size")), icon("Slaapkamers", c("bedrooms")),
        icon("Energielabel", c("energy_label")), F.lit("</ul>"),
        box("Inwoners", "Inhabitants in neighborhood"),
        box("Gezin met kinderen", "Families with children"),
        box("Gem. vraagprijs / m²", "Price per m² in neighborhood"),
        F.lit("<dl>"), *[pair(label, c(k)) for k, label in labels.items()],
        pair("Aantal kamers", F.concat(c("nr_rooms"), F.lit(" kamers (1 slaapkamer)"))),
        pair("Aantal badkamers", F.concat(c("bathrooms"), F.lit(" badkamers en "), c("toilets"),
                                          F.when(c("toilets") == "1", F.lit(" apart toilet"))
                                          .otherwise(F.lit(" aparte toiletten")))),
        F.lit("</dl>"),
        section("cadastral", parcels, listed("ownership_situations", "Eigendomssituatie"),
                listed("charges", "Lasten")),
        section("buitenruimte", *[pair(f, c("outdoor_features")[f]) for f in PG.OUTDOOR["fields"]]),
        F.lit("</body></html>"))
    k = c("listing_id")
    html = F.when(k % 40 == 39, F.lit("<html><body><p>niets te zien</p></body></html>")).when(
        k % 40 == 38, F.lit("<html><p>afgebroken<![x[")).otherwise(html)
    return v.select(k.alias("page_id"), F.concat(F.lit("https://huis.example/koop/"), k).alias("url"),
                    html.alias("html"))


def rendered_listing_extract(spark: SparkSession, sf: str) -> DataFrame:
    """PG-1..PG-9: what the extractor finds on every rendered page."""
    out = PG.extract_listing(rendered_pages(spark, sf), keep=["page_id"])
    details, outside = F.col("neighborhood_details"), F.col("outdoor_features")
    return out.select(
        "page_id", "success", F.col("error").isNotNull().alias("failed"), *PG.SCALAR_FIELDS,
        F.array_join(F.transform("cadastral_parcels", lambda p: F.concat_ws("@", p["parcel"], p["link"])),
                     "; ").alias("parcels"),
        F.array_join("ownership_situations", "; ").alias("ownership"),
        F.array_join("charges", "; ").alias("charges"),
        *[details[key].alias(name) for key, name in (
            ("Inhabitants in neighborhood", "inhabitants"), ("Families with children", "families"),
            ("Price per m² in neighborhood", "price_m2"))],
        *[outside[f].alias("out_" + f.lower().replace(" ", "_")) for f in PG.OUTDOOR["fields"]])


def rendered_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """PG-10: kept and rejected pages by the all-N/A rule."""
    kept, rejected = PG.split_rejects(PG.extract_listing(rendered_pages(spark, sf), keep=["page_id"]))
    return kept.select("page_id", F.lit(False).alias("rejected")).unionByName(
        rejected.select("page_id", F.lit(True).alias("rejected")))


def all_na_reject(spark: SparkSession, sf: str) -> DataFrame:
    """PG-10: dead-letter rows whose every listing field is N/A."""
    out = PG.extract_listing(_pages(spark, sf), keep=["page_id"])
    _, rejected = PG.split_rejects(out)
    return rejected.select("page_id", "url")


def url_ids(spark: SparkSession, sf: str) -> DataFrame:
    """PG-11: md5(url)[:8] + load timestamp (passed in)."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", PG.page_id(F.col("url"), F.lit(LOAD_TS).cast("timestamp"))
                    .alias("record_id"))


def url_filters(spark: SparkSession, sf: str, pattern: str = "/en/", first: int | None = None) -> DataFrame:
    """PG-13: every URL with the pattern (or the first ones in URL order), its host's number of
    hits and the number of all hits."""
    p = table(spark, sf, "pages").select("page_id", "url")
    hits = PG.first_urls(p, F.col("url").contains(pattern)).withColumn("host", PG.url_host(F.col("url")))
    per_host = hits.groupBy("host").agg(F.count(F.lit(1)).alias("host_hits"))
    every = F.broadcast(hits.agg(F.count(F.lit(1)).alias("all_hits")))      # one row
    return PG.first_urls(hits.join(per_host, "host").join(every), F.lit(True), first).select(
        "page_id", "url", "host_hits", "all_hits")


def robots_filter(spark: SparkSession, sf: str) -> DataFrame:
    """PG-12: a rule table (host, disallow_prefix) derived per host; left anti on host
    plus path prefix."""
    p = table(spark, sf, "pages").select("page_id", "url")
    hosts = p.select(PG.url_host(F.col("url")).alias("host")).distinct()
    prefixes = F.array(F.lit("/fr/"),
                       F.when(F.col("host").startswith("blog."), F.lit("/en/8")))
    rules = (hosts.withColumn("disallow_prefix", F.explode(prefixes))
             .where(F.col("disallow_prefix").isNotNull()))
    return PG.robots_allowed(p, rules)


def rooms_regex(spark: SparkSession, sf: str) -> DataFrame:
    """PG-5 / PG-6 over whole document texts, two of three followed by a room description."""
    d = table(spark, sf, "documents", spread=True).select("doc_id", "text", "n_chars")
    k, n = F.col("doc_id"), F.col("n_chars")
    rooms = F.when(k % 3 != 0, F.concat(F.lit(" "), n % 9, F.lit(" kamers (" ), k % 5, F.lit(" slaapkamers)")))
    baths = F.when(k % 4 != 0, F.concat(F.lit(", "), n % 3, F.when(n % 3 == 1, F.lit(" Badkamer")).otherwise(
        F.lit(" badkamers"))))
    toilets = F.when(k % 5 == 0, F.concat(F.lit(" en "), k % 7, F.lit(" aparte toiletten"))).when(
        k % 5 == 1, F.lit(" en 1 apart toilet"))
    t = F.concat_ws("", "text", rooms, baths, toilets)
    return d.select("doc_id", PG.rooms(t).alias("nr_rooms"), PG.bathrooms(t).alias("bathrooms"),
                    PG.toilets(t).alias("toilets"))


def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-10: sitemap XML (one document per page URL) -> <loc> values."""
    p = table(spark, sf, "pages").select("page_id", "url")
    esc = F.replace(F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")),
                              F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'
                         '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'),
                   esc, F.lit("</loc></url></urlset>"))
    return p.select("page_id", F.explode(sitemap_locs(xml)).alias("loc"))


SITEMAP = "https://sitemaps.example/"
XMLNS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _sitemap_xml(kind: str, item: str, urls) -> Column:
    esc = F.transform(urls, lambda u: F.replace(F.replace(F.replace(
        u, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    body = F.array_join(F.transform(esc, lambda u: F.concat(F.lit(f"<{item}><loc>"), u, F.lit(f"</loc></{item}>"))), "")
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><{kind} {XMLNS}>'), body, F.lit(f"</{kind}>"))


def sitemap_index_urls(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-10: a root index names indexes, each names sitemaps of 100 pages and the root again; the
    frontier loop gives every page once."""
    numbered = table(spark, sf, "pages").select("url", F.floor(F.col("page_id") / 100).alias("part"))
    part = F.concat(F.lit(f"{SITEMAP}part/"), F.col("part").cast("string"))
    index = F.concat(F.lit(f"{SITEMAP}index/"), (F.col("part") % 7).cast("string"))
    parts = numbered.groupBy("part").agg(F.collect_list("url").alias("urls")).select(      # 100 pages each
        part.alias("url"), _sitemap_xml("urlset", "url", F.col("urls")).alias("xml"), index.alias("index"))
    indexes = parts.groupBy(F.col("index").alias("url")).agg(F.collect_list("url").alias("urls")).select(
        "url", _sitemap_xml("sitemapindex", "sitemap", F.array_append("urls", F.lit(f"{SITEMAP}root"))).alias("xml"))
    root = spark.range(1).select(F.lit(f"{SITEMAP}root").alias("url"), _sitemap_xml(
        "sitemapindex", "sitemap", F.array(*[F.lit(f"{SITEMAP}index/{k}") for k in range(7)])).alias("xml"))
    documents = parts.select("url", "xml").unionByName(indexes).unionByName(root)
    return sitemap_pages(documents, root.select("url"))


QUERIES = {
    "page_fields": page_fields,
    "page_listing_extract": page_listing_extract,
    "rendered_listing_extract": rendered_listing_extract,
    "rendered_rejects": rendered_rejects,
    "all_na_reject": all_na_reject,
    "url_ids": url_ids,
    "url_filters": url_filters,
    "robots_filter": robots_filter,
    "rooms_regex": rooms_regex,
    "sitemap_urls": sitemap_urls,
    "sitemap_index_urls": sitemap_index_urls,
}


def _unescape(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&amp;', '&')")


def _rendered_oracle() -> str:
    plain = ["price", "address", "postal_code", "neighborhood", "status", "size", "bedrooms",
             "energy_label", "contribution_vve", "year_of_construction", "roof_type",
             "external_storage", "balcony", "located_on", "facilities", "nr_rooms", "bathrooms", "toilets"]
    na = lambda c: f"CASE WHEN ok THEN coalesce({c}, 'N/A') ELSE 'N/A' END"
    some = lambda c: f"CASE WHEN ok THEN {c} END"
    nb = "cu % 13 <> 0"
    return with_listing(", Q AS (SELECT *, k % 40 < 38 AS ok FROM L)\n" + f"""
SELECT listing_id AS page_id, k % 40 <> 38 AS success, k % 40 = 38 AS failed,
  {", ".join(f"{na(c)} AS {c}" for c in plain)}, 'N/A' AS living_area,
  CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN '' ELSE
    concat('AMSTERDAM K ', cu, ' G1@https://kadaster.example/', k, '/1') END ||
    CASE WHEN k % 3 = 2 THEN concat('; AMSTERDAM K ', cu, ' G2@https://kadaster.example/', k, '/2')
    ELSE '' END ELSE '' END AS parcels,
  CASE WHEN ok THEN coalesce(ownership, '') ELSE '' END AS ownership,
  CASE WHEN ok THEN charges_joined ELSE '' END AS charges,
  CASE WHEN ok AND {nb} THEN concat(1 + cu % 9, '.', lpad(CAST(cu % 1000 AS VARCHAR), 3, '0'))
    ELSE 'N/A' END AS inhabitants,
  CASE WHEN ok AND {nb} THEN concat(cu % 60, '%') ELSE 'N/A' END AS families,
  CASE WHEN ok AND {nb} THEN concat('€ ', 3 + cu % 7, '.', lpad(CAST(cu % 1000 AS VARCHAR), 3, '0'))
    ELSE 'N/A' END AS price_m2,
  {some("od_ligging")} AS out_ligging, {some("od_tuin")} AS out_tuin,
  {some("od_achtertuin")} AS out_achtertuin, {some("trim(od_ligging_tuin)")} AS out_ligging_tuin
FROM Q""").replace("\n), Q AS", "\n),\nQ AS")


ORACLE = {
    "rendered_listing_extract": _rendered_oracle(),
    "rendered_rejects": with_listing("""
SELECT listing_id AS page_id, k % 40 >= 38 AS rejected FROM L"""),
    "page_fields": f"""
SELECT page_id,
  coalesce(nullif(trim({_unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}), ''), 'N/A')
    AS title,
  coalesce(nullif(trim({_unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}), ''), 'N/A') AS h1,
  CAST(len(regexp_extract_all(html, '<a[\\s>]')) AS INTEGER) AS n_links,
  CAST(len(regexp_extract_all(html, '<p[\\s>]')) AS INTEGER) AS n_paragraphs,
  array_to_string(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1),
    lambda x: {_unescape("trim(x)")}), '|') AS nav_items,
  coalesce(nullif(trim({_unescape("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")}), ''), 'N/A')
    AS footer
FROM pages""",
    "url_ids": """
SELECT page_id, substr(md5(url), 1, 8) || '_20250101_000000' AS record_id FROM pages""",
    "url_filters": """
SELECT page_id, url, count(*) OVER (PARTITION BY lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)))
    AS host_hits, count(*) OVER () AS all_hits FROM pages WHERE contains(url, '/en/')""",
    "sitemap_index_urls": "SELECT DISTINCT url FROM pages",
    "robots_filter": """
WITH P AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host,
                  regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url FROM P
WHERE NOT (starts_with(path, '/fr/') OR (starts_with(host, 'blog.') AND starts_with(path, '/en/8')))""",
    "rooms_regex": """
SELECT doc_id,
  coalesce(nullif(regexp_extract(lower(t), '(\\d+)\\s*kamers?', 1), ''), 'N/A') AS nr_rooms,
  coalesce(nullif(regexp_extract(lower(t), '(\\d+)\\s*badkamer(s)?', 1), ''), 'N/A') AS bathrooms,
  coalesce(nullif(regexp_extract(lower(t), '(\\d+)\\s*apart(e)? toilet(ten)?', 1), ''), 'N/A')
    AS toilets
FROM (SELECT doc_id, concat(text,
    CASE WHEN doc_id % 3 <> 0 THEN ' ' || n_chars % 9 || ' kamers (' || doc_id % 5 || ' slaapkamers)' END,
    CASE WHEN doc_id % 4 <> 0 THEN ', ' || n_chars % 3 || CASE WHEN n_chars % 3 = 1 THEN ' Badkamer'
      ELSE ' badkamers' END END,
    CASE doc_id % 5 WHEN 0 THEN ' en ' || doc_id % 7 || ' aparte toiletten'
      WHEN 1 THEN ' en 1 apart toilet' END) AS t FROM documents)""",
    "sitemap_urls": "SELECT page_id, url AS loc FROM pages",
    "all_na_reject": "SELECT page_id, url FROM pages",
}
