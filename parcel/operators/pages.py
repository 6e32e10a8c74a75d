"""Page extraction over a ``pages(url, html)`` table (PG-1..PG-13, UD-4).

Python does one thing: an Arrow UDF tokenizes each page (stdlib
``html.parser``) into a flat element list, a few pages (CHUNK_CHARS of html) at a time.
``html_elements`` hands on all elements
(``array<struct<id, parent, tag, path, anc, text, href, attrs>>``); the listing extractor
takes ``marked_elements``: only the elements that one of its selectors matches, each
with a bit per selector, the end of its subtree and, for a ``dt``, its ``dd``. Every
extraction rule -- first match, sections, label matching, de-duplication -- is a Catalyst
higher-order expression over that array, so it runs column-wise inside the JVM and the
per-page work is spread over the cluster like any projection.

Selectors support the subset the reference's selector file uses: compound
selectors of ``tag``, ``.class`` and ``[attr]`` / ``[attr=value]`` joined by
descendant (space) or child (``>``) combinators. A selector compiles once on
the driver into a regular expression over each element's ``path``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcel.sources.store import scratch_table

# Fixed values that must match the reference's results (selector config).
SELECTORS = {
    "price": "div.flex.flex-col.text-xl div.flex.gap-2.font-bold span",
    "address": "h1[data-global-id] > span.block.font-bold",
    "postal_code": "h1[data-global-id] > span.text-neutral-40",
    "neighborhood": "h1[data-global-id] > a",
    "status": "div.flex.items-baseline > div.bg-red-70",
}
ICON_LIST = {"item": "li.flex", "label": "span.ml-1", "value": "span.md:font-bold",
             "labels": {"size": "wonen", "bedrooms": "slaapkamer",
                        "energy_label": "energielabel"}}
NEIGHBOURHOOD = {"container": "div.flex.justify-between.border-b",
                 "labels": {"Inhabitants in neighborhood": "inwoners",
                            "Families with children": "gezin met kinderen",
                            "Price per m² in neighborhood": "gem. vraagprijs / m²"}}
DL_LABELS = {"contribution_vve": "Bijdrage VvE", "year_of_construction": "Bouwjaar",
             "roof_type": "Soort dak", "living_area": "Wonen",
             "external_storage": "Externe bergruimte", "balcony": "Balkon/dakterras",
             "rooms_info": "Aantal kamers", "bathrooms_info": "Aantal badkamers",
             "located_on": "Gelegen op", "facilities": "Voorzieningen"}
CADASTRAL = {"section": "category-cadastral", "ownership": "Eigendomssituatie",
             "charges": "Lasten", "parcel_key": "AMSTERDAM"}
OUTDOOR = {"section": "category-buitenruimte",
           "fields": ["Ligging", "Tuin", "Achtertuin", "Ligging tuin"]}
ROOMS_RE = r"(\d+)\s*kamers?"
BATHROOMS_RE = r"(\d+)\s*badkamer(s)?"
TOILETS_RE = r"(\d+)\s*apart(e)? toilet(ten)?"
NA = "N/A"

ELEMENT = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("anc", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("single", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
ELEMENTS = T.ArrayType(ELEMENT)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "param", "source", "track", "wbr"}
_NO_TEXT = {"script", "style", "template"}
_TOKEN_SAFE = re.compile(r"[/\[\]=\s]")


def _token(tag: str, attrs: list) -> str:
    """Path segment: tag, sorted .classes, sorted [name=value] (values made path-safe)."""
    classes, rest = [], []
    for k, v in attrs:
        if k == "class":
            classes += [_TOKEN_SAFE.sub("_", c) for c in (v or "").split()]
        elif k not in ("style", "href", "src"):
            rest.append(f"[{k}={_TOKEN_SAFE.sub('_', v or '')}]")
    return tag + "".join("." + c for c in sorted(set(classes))) + "".join(sorted(rest))


class _Elements(HTMLParser):
    """Collects the elements of one page in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.stack: list[int] = []
        self.texts: list[list[str]] = []
        self.children: list[list] = []      # element ids and texts; None for a comment

    def add(self, element: dict) -> None:
        self.out.append(element)
        self.texts.append([])
        self.children.append([])

    def handle_starttag(self, tag, attrs):
        eid = len(self.out)
        token = _token(tag, attrs) if attrs else tag
        if self.stack:
            parent = self.stack[-1]
            above = self.out[parent]
            path, anc = f"{above['path']}/{token}", f"{above['anc']}{parent}/"
            self.children[parent].append(eid)
        else:
            parent, path, anc = -1, "/" + token, "/"
        self.add({"id": eid, "parent": parent, "tag": tag, "path": path, "anc": anc, "text": None,
                  "single": None, "href": dict(attrs).get("href") if attrs else None,
                  "attrs": {k: (v or "") for k, v in attrs if k != "class"}})
        if tag not in _VOID:
            self.stack.append(eid)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack:
            self.stack.pop()

    def handle_endtag(self, tag):
        stack = self.stack
        for i in range(len(stack) - 1, -1, -1):
            if self.out[stack[i]]["tag"] == tag:
                del stack[i:]
                return

    def handle_comment(self, data):
        if self.stack:
            self.children[self.stack[-1]].append(None)

    def handle_data(self, data):
        if not self.stack:
            return
        self.children[self.stack[-1]].append(data)
        s = data.strip()
        if not s or self.out[self.stack[-1]]["tag"] in _NO_TEXT:
            return
        for eid in self.stack:
            self.texts[eid].append(s)


def tokenize(html: str | None) -> list[dict]:
    """One page -> element dicts in document order (the per-row helper)."""
    p = _Elements()
    if html:
        try:
            p.feed(html)
            p.close()
        except Exception as err:  # noqa: BLE001 - the page is reported as failed
            p.add({"id": len(p.out), "parent": -1, "tag": ERROR_TAG, "path": "", "anc": "/",
                   "text": None, "single": None, "href": None, "attrs": {}})
            p.texts[-1] = [f"{type(err).__name__}: {err}"]
    for e in reversed(p.out):     # children come after their parents
        e["text"] = "".join(p.texts[e["id"]])
        own = p.children[e["id"]]
        own = _joined(own) if len(own) > 1 else own
        if len(own) == 1 and own[0] is not None:
            e["single"] = own[0] if isinstance(own[0], str) else p.out[own[0]]["single"]
    return p.out


ERROR_TAG = "#error"


def _joined(nodes: list) -> list:
    """Neighbouring pieces of text are one text."""
    out: list = []
    for n in nodes:
        if isinstance(n, str) and out and isinstance(out[-1], str):
            out[-1] += n
        else:
            out.append(n)
    return out


CHUNK_CHARS = 1 << 18       # html tokenized before its elements are handed on; a longer page goes alone


def _columns(pages: list[list[dict]]) -> pa.Array:
    """The element lists of a few pages as one Arrow array."""
    flat = list(chain.from_iterable(pages))
    ends = [0, *accumulate(map(len, pages))]
    columns = []
    for f in ELEMENT.fields[:-1]:
        values = list(map(itemgetter(f.name), flat))
        columns.append(pa.array(values, pa.int32() if f.dataType == T.IntegerType() else pa.string()))
    attrs = list(map(itemgetter("attrs"), flat))
    columns.append(pa.MapArray.from_arrays(
        pa.array([0, *accumulate(map(len, attrs))], pa.int32()),
        pa.array(list(chain.from_iterable(attrs)), pa.string()),
        pa.array([v for a in attrs for v in a.values()], pa.string())))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        columns, names=ELEMENT.names))


def element_chunks(batches: Iterator[pa.Array], read: Callable = tokenize, columns: Callable = _columns
                   ) -> Iterator[pa.Array]:
    """Element lists of all pages in order, CHUNK_CHARS of html at a time, so that Python never
    holds the elements of a whole batch."""
    for batch in batches:
        pages, chars = [], 0
        for html in batch:
            html = html.as_py()
            if pages and chars + len(html or "") > CHUNK_CHARS:
                yield columns(pages)
                pages, chars = [], 0
            pages.append(read(html))
            chars += len(html or "")
        yield columns(pages)


@F.arrow_udf(ELEMENTS)
def html_elements(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """UD-4 helper: html text -> flat element list."""
    return element_chunks(html)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------------------- selectors
_COMPOUND = re.compile(r"^([A-Za-z0-9_-]*)((?:\.[^.\[\]]+|\[[^\]]+\])*)$")


def _segment_regex(compound: str) -> tuple[str, str]:
    m = _COMPOUND.match(compound)
    if not m:
        raise ValueError(f"unsupported selector part {compound!r}")
    tag, quals = m.group(1) or r"[A-Za-z0-9_-]+", m.group(2)
    look = []
    for q in re.findall(r"\.[^.\[\]]+|\[[^\]]+\]", quals):
        if q.startswith("."):
            look.append(r"(?=[^/]*\." + re.escape(_TOKEN_SAFE.sub("_", q[1:])) + r"(?:[.\[]|/|$))")
        else:
            name, _, val = q[1:-1].partition("=")
            val = val.strip("'\"")
            look.append(r"(?=[^/]*\[" + re.escape(name) + "="
                        + (re.escape(_TOKEN_SAFE.sub("_", val)) if val else "[^\\]]*") + r"\])")
    return "/" + re.escape(tag) if m.group(1) else "/" + tag, "".join(look)


def selector_regex(selector: str) -> str:
    """Compile a CSS-like selector to a Java regex over element paths."""
    parts = re.split(r"\s*(>)\s*|\s+", selector.strip())
    parts = [p for p in parts if p]
    rx, combinator = "", " "
    for p in parts:
        if p == ">":
            combinator = ">"
            continue
        seg, look = _segment_regex(p)
        prefix = "" if combinator == ">" else r"(?:/[^/]+)*"
        rx += prefix + seg + look + r"(?:[.\[][^/]*)?"
        combinator = " "
    return "^" + rx + "$"


def select_all(els: Column, selector: str) -> Column:
    """All elements matching a selector, document order."""
    rx = selector_regex(selector)
    return F.filter(els, lambda e: e["path"].rlike(rx))


def select_text(els: Column, selector: str, default: str | None = NA) -> Column:
    """PG-1: stripped text of the first match, else ``default``."""
    first = F.try_element_at(select_all(els, selector), F.lit(1))
    return F.coalesce(first["text"], F.lit(default)) if default is not None else first["text"]


# ---------------------------------------------------------------------------- marked elements
#: What the extractor looks for: a selector, a tag, or both; an element has a bit for each it meets.
SOUGHT = {
    **{name: (selector, None) for name, selector in SELECTORS.items()},
    "item": (ICON_LIST["item"], None), "label": (ICON_LIST["label"], "span"), "value": (ICON_LIST["value"], "span"),
    "box": (NEIGHBOURHOOD["container"], None),
    "cadastral": (f"div[data-testid={CADASTRAL['section']}] dt", "dt"),
    "outdoor": (f"div[data-testid={OUTDOOR['section']}] dt", "dt"),
    "dt": (None, "dt"), "dd": (None, "dd"), "a": (None, "a"), "error": (None, ERROR_TAG)}
BIT = {name: 1 << k for k, name in enumerate(SOUGHT)}
#: ``end``: the last of the following elements that lie in this one; ``dd``: the next dd beside a dt.
MARKED_ELEMENT = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("dd", T.IntegerType()), T.StructField("marks", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("single", T.StringType()),
    T.StructField("href", T.StringType())])
#: ``n`` counts all elements of the page.
MARKED = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("els", T.ArrayType(MARKED_ELEMENT))])
KEPT = 1 << 14              # start tags and paths a worker remembers


@cache
def _sought() -> tuple[list, set[str], dict[str, bool], tuple[str, ...]]:
    """(bit, path pattern, tag) of all that is sought; the classes and attributes (and whether the
    attribute's value matters) that the selectors name; ``.class`` of each of these."""
    rules = [(BIT[n], re.compile(selector_regex(s)).search if s else None, tag) for n, (s, tag) in SOUGHT.items()]
    named = re.findall(r"\.[^.\[\]\s]+|\[[^\]]+\]", " ".join(s for s, _ in SOUGHT.values() if s))
    classes = {_TOKEN_SAFE.sub("_", q[1:]) for q in named if q[0] == "."}
    attrs: dict[str, bool] = {}
    for q in named:
        if q[0] == "[":
            name, _, value = q[1:-1].partition("=")
            attrs[name] = attrs.get(name, False) or bool(value)
    return rules, classes, attrs, tuple(f".{c}" for c in classes)


def _short_token(tag: str, attrs: list) -> str:
    """The path segment without classes and attributes that no selector can tell from others."""
    _, classes, named, dotted = _sought()
    kept = []
    for k, v in attrs:
        if k == "class":
            kept.append((k, " ".join(c for c in (v or "").split()
                                     if _TOKEN_SAFE.sub("_", c) in classes or "." in c or "[" in c)))
        elif named.get(k) or any(d in f"{k}={v}" for d in dotted) or "[" in f"{k}{v}":
            kept.append((k, v))
        elif k in named:
            kept.append((k, ""))
    return _token(tag, kept) if kept else tag


class _Marked(HTMLParser):
    """Collects those elements of one page that are sought, in document order."""
    tags: dict[str, tuple] = {}         # start tag as written -> tag, path segment, href
    paths: dict[tuple, int] = {}        # tag, path -> bits

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.n = 0
        self.out: list[dict] = []
        self.stack: list[tuple] = []            # tag, path, place in out (or -1), children, dts without a dd
        self.texts: list[list[str]] = []        # of the sought elements among the open ones
        self.top: list[int] = []

    def updatepos(self, i, j):          # lines are not counted
        return j

    def parse_starttag(self, i):
        return self.run(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self.run(super().parse_endtag(i))

    def run(self, i: int) -> int:
        """Reads on from ``i`` while there are texts, plain end tags and start tags seen before;
        the rest is the base class's."""
        if i < 0 or self.cdata_elem:
            return i
        raw, tags, match = self.rawdata, self.tags, _PLAIN.match
        while m := match(raw, i):
            text, closed, opened = m.groups()
            known = tags.get(opened)
            if closed is None and known is None:
                break
            if text:
                self.handle_data(unescape(text))
            if known is None:
                self.handle_endtag(closed)
            else:
                self.enter(*known)
            i = m.end()
        return i

    def handle_starttag(self, tag, attrs):
        known = (tag, "/" + (_short_token(tag, attrs) if attrs else tag), dict(attrs).get("href"))
        self.enter(*known)
        raw = self.get_starttag_text()[1:]
        if _START_TAG.fullmatch(raw) and tag not in _RAW:
            _remember(self.tags, raw, known)

    def handle_startendtag(self, tag, attrs):
        self.enter(tag, "/" + (_short_token(tag, attrs) if attrs else tag), dict(attrs).get("href"))
        if tag not in _VOID and self.stack:
            self.leave(len(self.stack) - 1)

    def enter(self, tag: str, token: str, href: str | None) -> None:
        above = self.stack[-1] if self.stack else None
        path = above[1] + token if above else token
        marks = self.paths.get((tag, path))
        if marks is None:
            marks = sum(bit for bit, match, own in _sought()[0]
                        if (own is None or own == tag) and (match is None or match(path)))
            _remember(self.paths, (tag, path), marks)
        self.n += 1
        children: list = []
        if above:
            above[3].append(children)
        place = -1
        if marks:
            place = len(self.out)
            waiting = above[4] if above else self.top
            if marks & BIT["dd"]:
                for k in waiting:
                    self.out[k]["dd"] = place
                waiting.clear()
            elif marks & BIT["dt"]:
                waiting.append(place)
            self.add(marks, children, href)
        if tag not in _VOID:
            self.stack.append((tag, path, place, children, []))
            if marks:
                self.texts.append(self.out[place]["text"])

    def add(self, marks: int, children: list, href: str | None) -> None:
        place = len(self.out)
        self.out.append({"id": place, "end": place, "dd": None, "marks": marks, "text": [], "single": children,
                         "href": href})

    def leave(self, depth: int) -> None:
        """The open elements from ``depth`` on end."""
        for _, _, place, _, _ in self.stack[depth:]:
            if place >= 0:
                self.out[place]["end"] = len(self.out) - 1
                self.texts.pop()
        del self.stack[depth:]

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.leave(k)
                return

    def handle_comment(self, data):
        if self.stack:
            self.stack[-1][3].append(None)

    def handle_data(self, data):
        if not self.stack:
            return
        tag, _, _, children, _ = self.stack[-1]
        children.append(data)
        if self.texts and tag not in _NO_TEXT and (s := data.strip()):
            for text in self.texts:
                text.append(s)


_PLAIN = re.compile(r"([^<]*)<(?:/([a-z][a-z0-9]*)>|([a-z][^<>]{0,1000}>))")
_START_TAG = re.compile(r'[a-z][a-z0-9]*(?:\s+[a-z-]+="[^"<>]{0,200}")*\s*>')
_RAW = {*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"}


def _remember(known: dict, key, value) -> None:
    if len(known) >= KEPT:
        known.clear()
    known[key] = value


def _single(children: list) -> str | None:
    """The text of an element that holds one text and nothing else, however deep."""
    own = _joined(children) if len(children) > 1 else children
    return None if len(own) != 1 or own[0] is None else own[0] if isinstance(own[0], str) else _single(own[0])


def marked(html: str | None) -> tuple[int, list[dict]]:
    """One page -> number of its elements, and those that are sought in document order."""
    p, failed = _Marked(), None
    if html:
        try:
            p.feed(html)
            p.close()
        except Exception as err:  # noqa: BLE001 - the page is reported as failed
            failed = f"{type(err).__name__}: {err}"
    p.leave(0)
    if failed is not None:
        p.n += 1
        p.add(BIT["error"], [], None)
        p.out[-1]["text"].append(failed)
    for e in p.out:
        e["text"] = "".join(e["text"])
        e["single"] = _single(e["single"]) if e["marks"] & BIT["dt"] else None
    return p.n, p.out


def _marked_columns(pages: list[tuple[int, list[dict]]]) -> pa.Array:
    """The sought elements of a few pages as one Arrow array."""
    flat = list(chain.from_iterable(els for _, els in pages))
    columns = [pa.array(list(map(itemgetter(f.name), flat)),
                        pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in MARKED_ELEMENT.fields]
    els = pa.ListArray.from_arrays(pa.array([0, *accumulate(len(found) for _, found in pages)], pa.int32()),
                                   pa.StructArray.from_arrays(columns, names=MARKED_ELEMENT.names))
    return pa.StructArray.from_arrays([pa.array([n for n, _ in pages], pa.int32()), els], names=MARKED.names)


@F.arrow_udf(MARKED)
def marked_elements(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """UD-4 helper: html text -> the elements that the extractor's selectors match."""
    return element_chunks(html, marked, _marked_columns)


def has(e: Column, name: str) -> Column:
    return e["marks"].bitwiseAND(F.lit(BIT[name])) != 0


def sought(els: Column, name: str) -> Column:
    """The elements of the page (or of a part of it) that meet ``SOUGHT[name]``, document order."""
    return F.filter(els, lambda e: has(e, name))


def first_text(els: Column, name: str) -> Column:
    """PG-1: stripped text of the first match, else NULL."""
    return F.try_element_at(sought(els, name), F.lit(1))["text"]


def inside(els: Column, box: Column) -> Column:
    """Those of ``els`` (all of the page) that lie in the element ``box``."""
    return F.slice(els, box["id"] + 2, box["end"] - box["id"])


def dt_dd_pairs(els: Column) -> Column:
    """PG-2/4/7/8: every ``dt`` with its next sibling ``dd`` (text, and first link where parcels
    stand) and the sections it lies in; those without a ``dd`` too."""
    def pair(dt):
        return let(F.get(els, dt["dd"]), lambda dd: F.struct(
            dt["marks"].alias("marks"), dt["text"].alias("dt"), dt["single"].alias("single"), dd["text"].alias("dd"),
            F.when(has(dt, "cadastral"), F.try_element_at(sought(inside(els, dd), "a"), F.lit(1))["href"])
            .alias("link"), dd.isNotNull().alias("has_dd")))
    return F.transform(sought(els, "dt"), pair)


def in_section(pairs: Column, name: str) -> Column:
    """The pairs inside ``div[data-testid=<section>]`` whose dt has a dd."""
    return F.filter(pairs, lambda p: has(p, name) & p["has_dd"])


def dd_by_label(pairs: Column, label: str, exact: bool = False, default: str = NA) -> Column:
    """PG-2: the first dt that is a single text equal to / containing ``label`` decides: its dd
    text, or ``default`` when it has no dd. ``pairs`` are those of all labels."""
    if exact:
        def cond(p):
            return F.coalesce(F.regexp_replace(p["single"], r"^\s+|\s+$", "") == label, F.lit(False))
    else:
        def cond(p):
            return F.coalesce(p["single"].contains(label), F.lit(False))
    return F.coalesce(F.try_element_at(F.filter(pairs, cond), F.lit(1))["dd"], F.lit(default))


def _first_label(label: Column, labels: dict[str, str]) -> Column:
    """Key of the first entry whose text the label contains; the others are not tried."""
    out = F.lit(None).cast("string")
    for key, needle in reversed(labels.items()):
        out = F.when(label.contains(needle), F.lit(key)).otherwise(out)
    return out


# One-argument lambdas only: Spark reads a two-argument lambda as (element, index).
def _dt_equals(label: str):
    return lambda p: p["dt"] == label


def icon_list(els: Column) -> Column:
    """PG-3: (label, value) spans inside ``li.flex`` items; the last match per label wins."""
    def lv(li):
        return let(inside(els, li), lambda own: _labelled(first_text(own, "label"), first_text(own, "value"),
                                                          ICON_LIST["labels"]))
    return let(F.transform(sought(els, "item"), lv), lambda p: F.struct(
        *[_last_value(p, name).alias(name) for name in ICON_LIST["labels"]]))


def _labelled(label: Column, value: Column, labels: dict[str, str]) -> Column:
    return let(F.lower(label), lambda low: F.struct(_first_label(low, labels).alias("key"), value.alias("value")))


def _last_value(pairs: Column, key: str) -> Column:
    """The value of the last pair with the key and a value, else N/A."""
    hits = F.filter(pairs, lambda p: (p["key"] == key) & p["value"].isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(NA))


def neighbourhood_details(els: Column) -> Column:
    """PG-4: 3-key map from ``dt``/``dd`` inside the neighbourhood containers, default N/A."""
    def pair(box):
        return let(inside(els, box), lambda own: _labelled(first_text(own, "dt"), first_text(own, "dd"),
                                                           NEIGHBOURHOOD["labels"]))
    keys = [F.lit(k) for k in NEIGHBOURHOOD["labels"]]
    return let(F.transform(sought(els, "box"), pair), lambda p: F.map_from_arrays(F.array(*keys), F.array(
        *[_last_value(p, k) for k in NEIGHBOURHOOD["labels"]])))


def rooms(text: Column) -> Column:
    """PG-5: room count from free text, else 'N/A'."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(text), ROOMS_RE, 1), F.lit("")), F.lit(NA))


def bathrooms(text: Column) -> Column:
    """PG-6: bathroom count."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(text), BATHROOMS_RE, 1), F.lit("")),
                      F.lit(NA))


def toilets(text: Column) -> Column:
    """PG-6: separate toilet count."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(text), TOILETS_RE, 1), F.lit("")),
                      F.lit(NA))


def cadastral(pairs: Column) -> Column:
    """PG-7: parcels (first-seen order, de-duplicated by label), ownership list, charges."""
    return let(in_section(pairs, "cadastral"), _cadastral)


def _cadastral(pairs: Column) -> Column:
    own = F.transform(F.filter(pairs, lambda p: p["dt"].contains(CADASTRAL["ownership"])),
                      lambda p: p["dd"])
    charges = F.transform(F.filter(pairs, lambda p: p["dt"].contains(CADASTRAL["charges"])),
                          lambda p: p["dd"])
    parcels = F.filter(pairs, lambda p: p["dt"].contains(CADASTRAL["parcel_key"])
                       & ~p["dt"].contains(CADASTRAL["ownership"])
                       & ~p["dt"].contains(CADASTRAL["charges"]))
    # De-duplicate by label, first-seen order (array_distinct keeps first occurrences).
    dedup = let(parcels, lambda found: F.transform(
        F.array_distinct(F.transform(found, lambda p: p["dt"])), lambda d: F.struct(
            d.alias("parcel"),
            F.try_element_at(F.filter(found, lambda p: p["dt"] == d), F.lit(1))["link"].alias("link"))))
    return F.struct(dedup.alias("cadastral_parcels"), own.alias("ownership_situations"),
                    charges.alias("charges"))


def outdoor(pairs: Column) -> Column:
    """PG-8: fixed outdoor labels -> map with NULL defaults (last match wins)."""
    return let(in_section(pairs, "outdoor"), lambda pairs: F.map_from_arrays(
        F.array(*[F.lit(f) for f in OUTDOOR["fields"]]),
        F.array(*[F.try_element_at(F.filter(pairs, _dt_equals(f)), F.lit(-1))["dd"] for f in OUTDOOR["fields"]])))


def extract_listing(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                    keep: Sequence[str] = ()) -> DataFrame:
    """PG-9: html -> raw listing fields + success/error; a field that fails is N/A, the
    row is kept (the whole extraction is column expressions over the element list)."""
    base = pages.select(*[F.col(k) for k in keep], F.col(url_col).alias("url"),
                        marked_elements(F.col(html_col)).alias("page"))
    # what several fields need is computed once, as a column of its own
    e, n = F.col("page.els"), F.col("page.n")
    base = base.select("*", dt_dd_pairs(e).alias("pairs"), icon_list(e).alias("icons"))
    pairs, icons = F.col("pairs"), F.col("icons")
    base = base.select("*", cadastral(pairs).alias("cad"), dd_by_label(pairs, DL_LABELS["rooms_info"]).alias("rooms_txt"),
                       dd_by_label(pairs, DL_LABELS["bathrooms_info"]).alias("bath_txt"))
    rooms_txt, bath_txt, cad = F.col("rooms_txt"), F.col("bath_txt"), F.col("cad")
    fields = {k: F.coalesce(first_text(e, k), F.lit(NA)) for k in SELECTORS}
    fields.update({"size": icons["size"], "bedrooms": icons["bedrooms"],
                   "energy_label": icons["energy_label"],
                   "neighborhood_details": neighbourhood_details(e)})
    for key in ("contribution_vve", "year_of_construction", "roof_type", "living_area",
                "external_storage", "balcony", "located_on", "facilities"):
        fields[key] = dd_by_label(pairs, DL_LABELS[key])
    fields["nr_rooms"] = F.when(rooms_txt == NA, F.lit(NA)).otherwise(rooms(rooms_txt))
    fields["bathrooms"] = F.when(bath_txt == NA, F.lit(NA)).otherwise(bathrooms(bath_txt))
    fields["toilets"] = F.when(bath_txt == NA, F.lit(NA)).otherwise(toilets(bath_txt))
    fields["cadastral_parcels"] = cad["cadastral_parcels"]
    fields["ownership_situations"] = cad["ownership_situations"]
    fields["charges"] = cad["charges"]
    fields["outdoor_features"] = outdoor(pairs)
    broken = first_text(e, "error")
    out = base.select(*[F.col(k) for k in keep], "url",
                      (broken.isNull() & (n > 0)).alias("success"),
                      F.coalesce(broken, F.when(n == 0, F.lit("empty page"))).alias("error"),
                      *[v.alias(k) for k, v in fields.items()])
    return out


SCALAR_FIELDS = ["price", "address", "postal_code", "neighborhood", "status", "size",
                 "bedrooms", "energy_label", "contribution_vve", "year_of_construction",
                 "roof_type", "living_area", "external_storage", "balcony", "located_on",
                 "facilities", "nr_rooms", "bathrooms", "toilets"]


def all_na(df: DataFrame, fields: Sequence[str] = SCALAR_FIELDS) -> Column:
    """PG-10: every scalar listing field is NULL or 'N/A' (the reject rule)."""
    arr = F.array(*[F.col(f).cast("string") for f in fields])
    return F.forall(arr, lambda x: x.isNull() | (x == NA))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PG-10: (kept, dead-letter) by the all-N/A rule. The records are written once: both sides
    read them, and the rule is not pushed below what made the fields."""
    marked = scratch_table(df.withColumn("_rejected", all_na(df)))
    return tuple(marked.where(F.col("_rejected") == side).drop("_rejected") for side in (False, True))


def page_id(url: Column, ts: Column) -> Column:
    """PG-11: md5(url)[:8] + '_' + yyyyMMdd_HHmmss of the load time (passed in)."""
    return F.concat_ws("_", F.substring(F.md5(url), 1, 8), F.date_format(ts, "yyyyMMdd_HHmmss"))


def first_urls(pages: DataFrame, predicate: Column, cap: int | None = None) -> DataFrame:
    """PG-13: the URLs that meet a predicate; ``cap`` keeps the first ones in URL order."""
    hits = pages.where(predicate)
    return hits if cap is None else hits.orderBy("url").limit(cap)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))


def robots_allowed(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """PG-12: drop URLs whose path starts with a disallowed prefix of their host.

    ``rules(host, disallow_prefix)`` joins on host (equi) with a prefix filter;
    left anti keeps allowed rows only.
    """
    p = pages.withColumns({"_host": url_host(F.col(url_col)), "_path": url_path(F.col(url_col))})
    r = rules.select(F.lower("host").alias("_rhost"), "disallow_prefix")
    cond = (F.col("_host") == F.col("_rhost")) & F.col("_path").startswith(F.col("disallow_prefix"))
    return p.join(r, cond, "left_anti").drop("_host", "_path")
