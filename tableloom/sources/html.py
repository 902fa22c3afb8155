"""Links and listing rows out of HTML pages held in a table column.

A page is one row, and its elements nest to any depth, so each page is walked once, inside the tasks, by a scanner for the
few tags that matter with a stack of those that are open; everything after that is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tableloom.operators.listing import first_per

# Form of a message id, and of a schema download link.
MESSAGE_ID = r"^[a-z]+\.[0-9]{3}\.[0-9]{3}\.[0-9]{2,3}$"
DOWNLOAD_PARTS = ("/message/", "/download")
MIN_CELLS = 3

# Comments, scripts and styles hold no markup of the page.
_HIDDEN = r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
_MARKUP = re.compile(rf"{_HIDDEN}|<[^>]*>", re.S | re.I)
_LINKS = re.compile(rf"{_HIDDEN}|<(?P<end>/?)(?P<name>a)(?=[\s/>])[^>]*>", re.S | re.I)
_TAGS = re.compile(rf"{_HIDDEN}|<(?P<end>/?)(?P<name>table|tr|td|th|div|span|a)(?=[\s/>])[^>]*>", re.S | re.I)
_HREF = re.compile(r"<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S | re.I)
_AREA = re.compile(r"\sclass=[\"'][^\"']*business-area", re.S | re.I)
_ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")
_WHITE = " \t\n\x0b\f\r"


def _character(entity: re.Match) -> str:
    """Numeric and named entities as characters, a fixed space as a plain one; unknown ones stay as they are."""
    decimal, hexadecimal, name = entity.groups()
    code = int(decimal) if decimal else int(hexadecimal, 16) if hexadecimal else 39 if name == "apos" else name2codepoint.get(name, 0)
    if code == 160:
        return " "
    return chr(code) if 1 <= code <= 0xD7FF or 0xE000 <= code <= 0x10FFFF else entity[0]


def _decoded(text: str) -> str:
    return _ENTITY.sub(_character, text) if "&" in text else text


def visible_text(html: str) -> str:
    """Text of an HTML fragment without tags, entities decoded, trimmed."""
    return _decoded(_MARKUP.sub("", html)).strip(_WHITE)


def href_of(tag: str) -> str:
    found = _HREF.match(tag)
    return _decoded(next(filter(None, found.groups()), "")) if found else ""


def links_of(page: str) -> Iterator[tuple[str, str]]:
    """``(address, what the link holds)``; a link ends at its end tag, or where the next one starts."""
    tag, start = None, 0
    for found in _LINKS.finditer(page):
        if not found["name"]:
            continue
        if tag:
            yield href_of(tag), page[start : found.start()]
        tag, start = (None if found["end"] else found[0]), found.end()
    if tag:
        yield href_of(tag), page[start:]


class _Open:
    """An element on the stack; a row has the cells below it, at any depth."""

    def __init__(self, name: str, start: int, is_row: bool, is_cell: bool):
        self.name, self.start, self.end = name, start, None
        self.is_row, self.is_cell, self.cells, self.download = is_row, is_cell, [], None


class Listing:
    """The rows of a page in document order, and its business area.

    Rows are ``tr`` and ``div`` elements of class ``views-row``; cells are ``td`` and ``span`` elements of class
    ``views-field`` anywhere below, so a row holds the cells of tables inside its cells, and these tables' rows are rows
    themselves. A cell ends where the next cell or row of its table starts, if not before; an end tag closes what is
    still open inside, but nothing around the table it stands in.
    """

    def __init__(self, page: str):
        self.rows: list[_Open] = []
        self.area: str | None = None
        self._open: list[_Open] = []
        self._areas = 0  # open elements of the business area
        area_start, self._page = None, page
        for found in _TAGS.finditer(page):
            if not found["name"]:
                continue
            name, tag = found["name"].lower(), found[0]
            if name == "a":
                if area_start is not None and self.area is None:
                    self.area = visible_text(page[area_start : found.start()])
                if not found["end"]:
                    if self._areas and self.area is None:
                        area_start = found.end()
                    self._link(href_of(tag))
            elif found["end"]:
                self._close(name, found.start())
            elif not tag.endswith("/>") or name not in ("div", "span"):
                self._start(name, tag, found)
        if area_start is not None and self.area is None:
            self.area = visible_text(page[area_start:])
        self._pop(0, len(page))

    def _link(self, href: str) -> None:
        if not all(part in href for part in DOWNLOAD_PARTS):
            return
        inside = False
        for element in reversed(self._open):  # every row around a cell around the link
            inside = inside or element.is_cell
            if element.is_row and inside and element.download is None:
                element.download = href

    def _start(self, name: str, tag: str, found: re.Match) -> None:
        if name == "tr":
            self._end_within(("tr",), ("table",), found.start())
        elif name in ("td", "th"):
            self._end_within(("td", "th"), ("table", "tr"), found.start())
        lower = tag.lower()
        is_row = name == "tr" or (name == "div" and re.search(r"\bviews-row\b", lower) is not None)
        is_cell = name == "td" or (name == "span" and re.search(r"\bviews-field\b", lower) is not None)
        element = _Open(name, found.end(), is_row, is_cell)
        if is_cell:
            for outer in self._open:
                if outer.is_row:
                    outer.cells.append(element)
        if is_row:
            self.rows.append(element)
        if name == "div" and _AREA.search(tag):
            element.name = "div "  # closes like a div, and ends the area
            self._areas += 1
        self._open.append(element)

    def _end_within(self, names: tuple[str, ...], bounds: tuple[str, ...], at: int) -> None:
        """Close the innermost of ``names``, unless one of ``bounds`` stands inside it."""
        for depth in range(len(self._open) - 1, -1, -1):
            own = self._open[depth].name.strip()
            if own in names:
                self._pop(depth, at)
                return
            if own in bounds:
                return

    def _close(self, name: str, at: int) -> None:
        bounds = {"table": (), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
        self._end_within((name,), bounds.get(name, ("table", "td", "th")), at)

    def _pop(self, depth: int, at: int) -> None:
        for element in self._open[depth:]:
            element.end = at
            self._areas -= element.name == "div "
        del self._open[depth:]

    def texts(self, row: _Open) -> list[str]:
        """What the first ``MIN_CELLS`` cells say."""
        return [visible_text(self._page[c.start : c.end]) for c in row.cells[:MIN_CELLS]]


def _walk(pages: DataFrame, page_id: str, html: str, fields: str, rows_of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """``page_id`` and ``fields`` of what ``rows_of`` finds on each page."""
    kind = pages.schema[page_id].dataType.simpleString()
    given = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))

    schema = StructType.fromDDL(f"page_id {kind}, {fields}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            at, found = [], []
            for row, page in enumerate(batch["html"].to_pylist()):
                made = list(rows_of(page)) if page else []
                at += [row] * len(made)
                found += made
            columns = [batch["page_id"].take(pa.array(at, pa.int32()))]
            columns += [pa.array([r[i] for r in found], f.type) for i, f in enumerate(list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return given.mapInArrow(run, schema)


def anchors(pages: DataFrame, page_id: str, html: str, token: str, id_pattern: str | None = None) -> DataFrame:
    """``(name, href[, id])`` of links whose address contains ``token``; the first per text wins.

    With ``id_pattern`` its first group is the id, and links without one are left out.
    """

    def named(page: str) -> Iterator[tuple[int, str, str]]:
        for at, (href, inner) in enumerate(links_of(page)):
            if token in href and (name := visible_text(inner)):
                yield at, name, href

    found = _walk(pages, page_id, html, "_at int, name string, href string", named)
    firsts = first_per(found, ["name"], ["page_id", "_at"])
    if id_pattern is None:
        return firsts.select("name", "href")
    found = firsts.select("name", "href", F.regexp_extract("href", id_pattern, 1).alias("id"))
    return found.where(F.col("id") != "")


def listing_rows(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Message rows of HTML tables and of ``views-row`` sections: page, id, name, organisation, area and download link.

    Rows with fewer than three cells or without a well-formed id are dropped.
    """
    id_form = re.compile(MESSAGE_ID)

    def messages(page: str) -> Iterator[tuple]:
        listing = Listing(page)
        for position, row in enumerate(listing.rows):
            if len(row.cells) >= MIN_CELLS:
                texts = listing.texts(row)
                if id_form.match(texts[0]) and "\n" not in texts[0]:
                    yield position, *texts, listing.area or "", row.download

    fields = "position int, message_id string, message_name string, submitting_org string, business_area string, xsd_url string"
    return _walk(pages, page_id, html, fields, messages)


def all_messages(*listings: DataFrame) -> DataFrame:
    """Listings of several pages as one, each (id, name) once, the earliest row winning."""
    rows = listings[0]
    for more in listings[1:]:
        rows = rows.unionByName(more)
    return first_per(rows, ["message_id", "message_name"], ["page_id", "position"])
