"""Portal pages as tables: listings, details and links.

Pages are parsed with the standard library inside Arrow batches; selectors are
tried in order, the first that finds anything wins, and fields without any hit
are counted by the caller (``operators.analytics.selector_misses``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import ident, records

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Selectors of the portal's layouts and its column order.
ROW_SELECTORS = ("table.standards-table tbody tr", "table.views-table tbody tr", "div.standard-listing div.standard-item", "table tbody tr")
TITLE_SELECTORS = ("h1.standard-title", "h1.page-title", "h1")
META_SELECTORS = ("table.standard-meta", "div.field-group table", "table")
REFERENCE_SELECTORS = ("div#normative-references", "div.normative-refs", "section[data-section='references']")
AMENDMENT_SELECTORS = ("div#amendments", "div.amendment-list", "ul.amendments")
COLUMNS = {"is_number": 0, "title": 1, "year": 2, "status": 3}
LINK_HINTS = ("compulsory", "registration", "crs")
FILE_PATTERN = r"\.(xlsx|xls|csv|pdf)$"


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        """Text of all pieces, each trimmed, without blanks between them."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n.strip())
            elif n.tag not in ("script", "style"):
                todo.extend(reversed(n.children))
        return "".join(out)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


#: Elements that a start tag closes, up to the nearest of the elements that hold them: end tags that may be left out.
_IMPLIED = {
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("thead", "tbody", "tfoot", "table")),
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",))),
}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_IMPLIED |= {tag: (("p",), ("td", "th", "li", "div", "section", "article", "table")) for tag in _BLOCKS}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close_implied(self, tag: str) -> None:
        closed, holders = _IMPLIED.get(tag, ((), ()))
        n, end = self.at, None
        while n is not None and n.tag not in holders:
            if n.tag in closed:
                end = n
            n = n.parent
        if end is not None:
            self.at = end.parent

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _fits(node: Node, step: str) -> bool:
    m = re.fullmatch(r"([a-z0-9]*)((?:[.#][\w-]+|\[[\w-]+='[^']*'\])*)", step)
    if m is None or (m[1] and node.tag != m[1]):
        return False
    for mark in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if mark[0] == "." and mark[1:] not in node.attrs.get("class", "").split():
            return False
        if mark[0] == "#" and node.attrs.get("id") != mark[1:]:
            return False
        if mark[0] == "[":
            name, value = mark[1:-1].split("=", 1)
            if node.attrs.get(name) != value.strip("'"):
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes of a descendant selector of tags with classes, id or attributes."""
    steps = selector.split()
    found = []
    for node in root.walk():
        if node.tag and _fits(node, steps[-1]):
            up, left = node.parent, len(steps) - 2
            while up is not None and left >= 0:
                left -= up.tag != "" and _fits(up, steps[left])
                up = up.parent
            if left < 0:
                found.append(node)
    return found


def select_first(root: Node, selectors: tuple[str, ...]) -> tuple[list[Node], int | None]:
    """Hits of the first selector that has any, and its place."""
    for n, s in enumerate(selectors):
        if hits := select(root, s):
            return hits, n
    return [], None


def probe(pages: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """(url, field, selector, nodes) per page of ``pages`` (url, html) and field: the first selector that finds something, null if none does."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url, html in zip(frame["url"], frame["html"], strict=True):
                root = parse(html)
                for field, selectors in fields.items():
                    hits, which = select_first(root, selectors)
                    out.append((url, field, None if which is None else selectors[which], len(hits)))
            yield pd.DataFrame(out, columns=["url", "field", "selector", "nodes"])

    return pages.select("url", "html").mapInPandas(run, "url string, field string, selector string, nodes long")


def probe_report(found: DataFrame, source: Column) -> DataFrame:
    """(source, field, selector, pages, nodes, passed) of ``probe``: per source and field each winning selector; passed if no page of the source lacks the field."""
    per = found.groupBy(source.alias("source"), "field", "selector").agg(F.count("*").alias("pages"), F.sum("nodes").alias("nodes"))
    lacking = per.filter("selector is null").select("source", "field", F.lit(False).alias("__whole"))
    return per.join(lacking, ["source", "field"], "left").withColumn("passed", F.coalesce("__whole", F.lit(True))).drop("__whole")


def _rows_in_batches(pages: DataFrame, schema: str, rows_of: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """``rows_of`` each page of ``pages``, page by page, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for page in batch.to_pylist() for row in rows_of(page)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return pages.mapInArrow(run, schema)


def _listed(page: dict) -> Iterator[tuple]:
    """The cells of each listed row: their texts and the first link of each."""
    found, which = select_first(parse(page["html"]), ROW_SELECTORS)
    for place, row in enumerate(found):
        held = (n for n in row.walk() if n.tag in ("td", "th"))
        cells = [{"text": c.text(), "href": next((a.attrs["href"] for a in c.walk() if a.tag == "a" and a.attrs.get("href")), None)} for c in held]
        yield page["url"], page["division"], place, [c | {"href": c["href"] and urljoin(page["url"] or "", c["href"])} for c in cells], which


def listing_rows(pages: DataFrame) -> DataFrame:
    """One row per standard listed on ``pages`` (url, html, division).

    Rows with too few cells or without a designator are left out; the year
    comes from the designator, else from its own cell.
    """
    raw = _rows_in_batches(pages.select("url", "html", "division"), "url string, division string, position int, cells array<struct<text:string,href:string>>, selector int", _listed)
    cell = {name: F.get("cells", F.lit(at)) for name, at in COLUMNS.items()}
    designator = cell["is_number"]["text"]
    whole = raw.filter(F.size("cells") > max(COLUMNS.values()))
    return whole.select(
        "url",
        "position",
        ident.canonical_key(designator).alias("is_number"),
        designator.alias("raw_designation"),
        cell["title"]["text"].alias("title"),
        F.coalesce(ident.designator_year(designator), records.year_of(cell["year"]["text"])).alias("year"),
        records.normalize_status(cell["status"]["text"]).alias("status"),
        "division",
        cell["is_number"]["href"].alias("source_url"),
        "selector",
    ).filter("is_number is not null")


#: What is read of a detail page: the texts that its selectors find, the cells of its first table of metadata, its headings and paragraphs.
_DETAIL = "url string, title string, meta_rows array<array<string>>, references_text string, amendments_text string, blocks array<string>"


def _detailed(page: dict) -> Iterator[tuple]:
    root = parse(page["html"])
    title, meta, cited, amended = (select_first(root, s)[0][:1] for s in (TITLE_SELECTORS, META_SELECTORS, REFERENCE_SELECTORS, AMENDMENT_SELECTORS))
    rows = [[c.text() for c in row.walk() if c.tag == "td"] for table in meta for row in table.walk() if row.tag == "tr"]
    yield page["url"], title[0].text() if title else None, rows, *("".join(n.text() for n in part) for part in (cited, amended)), [n.text() for n in root.walk() if n.tag in ("p", "h2", "h3")]


def _metadata(rows: Column) -> Column:
    """map of the rows with two cells, by the folded name in the first; of equal names the last row counts."""
    pairs = F.transform(F.filter(rows, lambda r: F.size(r) == 2), lambda r: F.struct(F.concat(F.lit("meta_"), F.rtrim(F.replace(F.lower(r[0]), F.lit(" "), F.lit("_")), F.lit(":"))).alias("key"), r[1].alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"])))


#: By rule a scope has so many characters at most.
SCOPE_LENGTH = 3_000


def detail_rows(pages: DataFrame, scope_length: int = SCOPE_LENGTH) -> DataFrame:
    """One row per detail page: title, two-column metadata, references, amendments and scope."""
    from ..functions import text as T

    raw = _rows_in_batches(pages.select("url", "html"), _DETAIL, _detailed)
    body = F.array_join(F.filter("blocks", lambda b: b != ""), "\n")
    return raw.select(
        "url",
        "title",
        _metadata(F.col("meta_rows")).alias("meta"),
        ident.extract_references(F.col("references_text")).alias("normative_references"),
        T.amendments(F.col("amendments_text")).alias("amendments"),
        F.nullif(F.substring(T.collapse(F.regexp_extract(body, r"(?is)(?:^|\n)\s*(?:1[.\s]+)?Scope\s*\n(.+?)(?=\n\s*\d[.\s]|\Z)", 1)), 1, scope_length), F.lit("")).alias("scope"),
    )


def anchors(html: Column) -> Column:
    """array<struct<href, label>> of the links in a page, by built-in functions."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    return F.transform(
        found,
        lambda a: F.struct(F.regexp_extract(a, r'(?is)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("label")),
    )


def discover_links(pages: DataFrame, key: str, pattern: str = FILE_PATTERN, hints: tuple[str, ...] = LINK_HINTS) -> DataFrame:
    """(key, href, label): first link whose target fits ``pattern`` and whose label or target has a hint."""
    wanted = F.filter(
        anchors(F.col("html")),
        lambda a: a["href"].rlike("(?i)" + pattern) & F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(a["label"]), h) | F.contains(F.lower(a["href"]), h)),
    )
    return pages.select(key, F.try_element_at(wanted, F.lit(1)).alias("a")).filter("a is not null").select(key, "a.href", "a.label")
