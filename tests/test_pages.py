"""Page extraction on an HTML fixture shaped by the selector config (FIXTURES F7)."""

from parcel.operators import pages as PG

PAGE = """<html><head><title>Huis</title></head><body>
<div class="flex items-baseline"><div class="bg-red-70 px-2">Verkocht</div></div>
<h1 data-global-id="123"><span class="block font-bold">Straat 1</span>
<span class="text-neutral-40">1012 AB Amsterdam</span><a href="/buurt">Centrum</a></h1>
<div class="text-xl flex flex-col"><div class="flex gap-2 font-bold"><span>€ 500.000 k.k.</span></div></div>
<ul>
 <li class="flex"><span class="ml-1">Wonen</span><span class="md:font-bold">86 m²</span></li>
 <li class="flex"><span class="ml-1">Slaapkamers</span><span class="md:font-bold">2</span></li>
 <li class="flex"><span class="ml-1">Energielabel</span><span class="md:font-bold">A</span></li>
 <li class="flex"><span class="ml-1">Energielabel</span><span class="md:font-bold">B</span></li>
</ul>
<div class="flex justify-between border-b"><dt>Inwoners</dt><dd>1.830</dd></div>
<div class="flex justify-between border-b"><dt>Gezin met kinderen</dt><dd>38%</dd></div>
<dl><dt>Bijdrage VvE</dt><dd>€ 150 per maand</dd>
<dt>Bouwjaar</dt><dd>1930</dd>
<dt>Aantal kamers</dt><dd>3 kamers (2 slaapkamers)</dd>
<dt>Aantal badkamers</dt><dd>1 badkamer en 1 apart toilet</dd>
<dt>Voorzieningen</dt><dd>Lift en TV kabel</dd></dl>
<div data-testid="category-cadastral"><dl>
<dt>AMSTERDAM K 1234</dt><dd><a href="https://kadaster.example/1">kaart</a></dd>
<dt>AMSTERDAM K 1234</dt><dd>dup</dd>
<dt>AMSTERDAM K 99</dt><dd>geen link</dd>
<dt>Eigendomssituatie</dt><dd>Volle eigendom</dd>
<dt>Lasten</dt><dd>Geen</dd></dl></div>
<div data-testid="category-buitenruimte"><dl><dt>Ligging</dt><dd>In woonwijk</dd>
<dt>Tuin</dt><dd>Achtertuin</dd></dl></div>
<script>var x = "<dt>Bouwjaar</dt>";</script>
</body></html>"""


def test_extract_listing_fixture(spark):
    df = spark.createDataFrame([(1, "https://example.nl/koop/1", PAGE),
                                (2, "https://example.nl/koop/2", "<html><p>leeg</p></html>")],
                               "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in PG.extract_listing(df, keep=["page_id"]).collect()}
    r = rows[1]
    assert r["price"] == "€ 500.000 k.k." and r["address"] == "Straat 1"
    assert r["postal_code"] == "1012 AB Amsterdam" and r["neighborhood"] == "Centrum"
    assert r["status"] == "Verkocht"
    assert (r["size"], r["bedrooms"], r["energy_label"]) == ("86 m²", "2", "B")
    assert r["neighborhood_details"]["Inhabitants in neighborhood"] == "1.830"
    assert r["neighborhood_details"]["Price per m² in neighborhood"] == "N/A"
    assert r["contribution_vve"] == "€ 150 per maand" and r["year_of_construction"] == "1930"
    assert (r["nr_rooms"], r["bathrooms"], r["toilets"]) == ("3", "1", "1")
    assert r["facilities"] == "Lift en TV kabel" and r["roof_type"] == "N/A"
    assert [(p["parcel"], p["link"]) for p in r["cadastral_parcels"]] == [
        ("AMSTERDAM K 1234", "https://kadaster.example/1"), ("AMSTERDAM K 99", None)]
    assert r["ownership_situations"] == ["Volle eigendom"] and r["charges"] == ["Geen"]
    assert r["outdoor_features"] == {"Ligging": "In woonwijk", "Tuin": "Achtertuin",
                                     "Achtertuin": None, "Ligging tuin": None}
    empty = rows[2]
    assert empty["price"] == "N/A" and empty["success"] is True
    kept, rejected = PG.split_rejects(PG.extract_listing(df, keep=["page_id"]))
    assert [x["page_id"] for x in rejected.collect()] == [2]
    assert [x["page_id"] for x in kept.collect()] == [1]


def test_robots_and_ids(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([("https://a.nl/koop/1",), ("https://a.nl/private/x",),
                                   ("https://b.nl/private/x",)], "url string")
    rules = spark.createDataFrame([("A.nl", "/private")], "host string, disallow_prefix string")
    assert [r["url"] for r in PG.robots_allowed(pages, rules).collect()] == \
        ["https://a.nl/koop/1", "https://b.nl/private/x"]
    rid = pages.select(PG.page_id(F.col("url"), F.lit("2025-02-03 04:05:06").cast("timestamp")))
    assert rid.first()[0].endswith("_20250203_040506") and len(rid.first()[0]) == 8 + 1 + 15


def _extract(spark, html):
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    return PG.extract_listing(df).first()


def test_first_matching_label_decides(spark):
    r = _extract(spark, "<dl><dt>Bouwjaar</dt><p>x</p></dl><dl><dt>Bouwjaar type</dt><dd>nieuw</dd>"
                        "<dt>Soort <b>dak</b></dt><dd>plat</dd><dt><span>Gelegen op</span></dt>"
                        "<dd>2e woonlaag</dd></dl>")
    assert r["year_of_construction"] == "N/A"       # the first label has no value
    assert r["roof_type"] == "N/A"                  # the label is not one text
    assert r["located_on"] == "2e woonlaag"


def test_a_list_item_counts_for_its_first_label(spark):
    r = _extract(spark, '<li class="flex"><span class="ml-1">Wonen slaapkamer</span>'
                        '<span class="md:font-bold">80</span></li>'
                        '<div class="flex justify-between border-b"><dt>Inwoners gezin met kinderen</dt>'
                        "<dd>7</dd></div>")
    assert (r["size"], r["bedrooms"]) == ("80", "N/A")
    assert r["neighborhood_details"]["Families with children"] == "N/A"
    assert r["neighborhood_details"]["Inhabitants in neighborhood"] == "7"


def test_parser_failure_is_reported(spark):
    r = _extract(spark, "<p>a</p><![oops[ x")
    assert r["success"] is False and "Error" in r["error"]
    assert _extract(spark, "<p>a</p>")["error"] is None
    assert _extract(spark, None)["error"] == "empty page"


def test_first_urls_keeps_all_without_a_cap(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(f"u{k}",) for k in range(150)], "url string")
    assert PG.first_urls(df, F.lit(True)).count() == 150
    assert [r.url for r in PG.first_urls(df, F.lit(True), 2).collect()] == ["u0", "u1"]


def test_url_filter_count_and_first_ones(spark):
    from parcel.plans.q_pages import url_filters
    from tests.conftest import SF_SMALL
    every = sorted(url_filters(spark, SF_SMALL).collect(), key=lambda r: r["url"])
    first = url_filters(spark, SF_SMALL, first=3).collect()
    assert {r["all_hits"] for r in every} == {len(every)} == {r["all_hits"] for r in first}
    assert sorted(first) == sorted(every[:3])
    assert url_filters(spark, SF_SMALL, "/nowhere/").count() == 0


def test_sitemap_cycles_end_and_dead_links_are_passed_over(spark):
    from parcel.sources.ingest import sitemap_pages
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    urls = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    docs = spark.createDataFrame([("r", index("a", "b", "r", "gone")), ("a", index("c", "r")), ("b", urls("p1", "p2")),
                                  ("c", urls("p2", "p3")), ("unlinked", urls("p9"))], "url string, xml string")
    got = [r["url"] for r in sitemap_pages(docs, docs.where("url = 'r'").select("url")).collect()]
    assert sorted(got) == ["p1", "p2", "p3"]
    assert sitemap_pages(docs, docs.where("false").select("url")).count() == 0


def test_elements_come_in_small_chunks_and_equal_each_page_alone(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(PG, "CHUNK_CHARS", 1000)
    page = '<div data-x="1" class="b a"><dl><dt>Wonen</dt><dd>30 <a href="/u">m</a></dd></dl><!-- c --></div>'
    html = [page * 400, None, "", "<p>tekst", page, "<html><p>af<![x["] * 60
    chunks = list(PG.element_chunks(iter([pa.array(html[:200]), pa.array(html[200:])])))
    assert len(chunks) > 60                                     # no chunk holds two of the long pages
    assert max(len(c.flatten()) for c in chunks) <= 5 * 400 + 30
    got = [[{**e, "attrs": dict(e["attrs"])} for e in els] for c in chunks for els in c.to_pylist()]
    assert got == [PG.tokenize(h) for h in html]


def test_rejects_read_written_records(spark):
    df = spark.createDataFrame([(1, "u1", "<p>niets</p>"), (2, "u2", "<dl><dt>Bouwjaar</dt><dd>1900</dd></dl>")],
                               "page_id long, url string, html string")
    sides = PG.split_rejects(PG.extract_listing(df, keep=["page_id"]))
    for side, ids in zip(sides, ([2], [1])):
        assert [r["page_id"] for r in side.select("page_id").collect()] == ids
        assert "EvalPython" not in side._jdf.queryExecution().toString()     # not extracted once more


def test_marked_elements_equal_a_search_of_all_elements():
    import re
    odd = ('<li class="a.flex">x</li><li data-z="q.flex.r" class="flex"><SPAN class=ml-1>a</SPAN></li><dt/><dd>1'
           '<dt data-n="1">Tuin<b>b</b><!-- c --></dt><script>"<dd>"</script><p><a href="/a?b&amp;c">d</a></p><dd>2'
           '<a href="/u">e</a><br><dt><i>Lasten</i></dt></dd><h1 data-global-id="7"><a>&amp;f</a></h1><p>')
    for page in (PAGE, odd, odd * 2 + PAGE + "<![x[", "los", "", None):
        els = PG.tokenize(page)
        wanted = {name: [e["id"] for e in els if (tag is None or e["tag"] == tag) and (
            selector is None or re.search(PG.selector_regex(selector), e["path"]))] for name, (selector, tag) in PG.SOUGHT.items()}
        ids = sorted({i for found in wanted.values() for i in found})
        n, found = PG.marked(page)
        assert n == len(els) and len(found) == len(ids)
        for place, (i, e) in enumerate(zip(ids, found)):
            assert (e["id"], e["text"], e["href"]) == (place, els[i]["text"], els[i]["href"])
            assert e["marks"] == sum(PG.BIT[name] for name in wanted if i in wanted[name])
            assert e["end"] == max([place, *(k for k, j in enumerate(ids) if f"/{i}/" in els[j]["anc"])])
            dds = [k for k, j in enumerate(ids) if j > i and els[j]["tag"] == "dd" and els[j]["parent"] == els[i]["parent"]]
            if els[i]["tag"] == "dt":
                assert (e["single"], e["dd"]) == (els[i]["single"], min(dds, default=None))


def test_elements_nobody_seeks_are_not_handed_on(spark):
    from pyspark.sql import functions as F
    noise = "".join(f'<div class="c{k}" data-k="{k}"><p>tekst {k}</p><svg><path></path></svg></div>' for k in range(2000))
    page = noise + "<dl><dt>Bouwjaar</dt>" + noise + "<dd>1930</dd></dl>" + noise
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    r = df.select(PG.marked_elements("html").alias("p")).select("p.n", F.size("p.els").alias("m")).first()
    assert (r["n"], r["m"]) == (3 * 8000 + 3, 2)
    assert _extract(spark, page)["year_of_construction"] == "1930"
    assert len(PG._Marked.tags) <= PG.KEPT and len(PG._Marked.paths) <= PG.KEPT
