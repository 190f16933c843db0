"""Listing pages as rows: a table function over parsed HTML, called laterally for each page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "position int, id string, publication_number string, title string, url string, date string, source string"
#: Elements that have no end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# How a listing writes an entry's day, number and source in one line, and numbers alone.
_META = re.compile(r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})\s+-\s+(\S+)\s+-\s+(.*)", re.S)
_NUMBER = re.compile(r"[A-Z]{2}[0-9-]+")
_DAY = re.compile(r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})")


def _is(classes: list[str], name: str) -> bool:
    return any(c == name or c.endswith(f"-{name}") for c in classes)


class ListingParser(HTMLParser):
    """Collects the entries of a page. A stack of open elements says where each begins and ends, so nesting does not matter."""

    def __init__(self, entry: str):
        super().__init__(convert_charrefs=True)
        self.entry, self.open, self.entries = entry, [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        inside = next((x["entry"] for x in reversed(self.open) if x["entry"] is not None), None)
        if tag == "div" and _is(classes, self.entry):
            inside = {"id": given.get("id") or None, "number": None, "url": None, "datetime": None, "texts": {}}
            self.entries.append(inside)
        takes = None
        if inside is not None:
            inside["number"] = inside["number"] or given.get("data-number") or given.get("publication-number") or None
            inside["datetime"] = inside["datetime"] or given.get("datetime") or None
            if tag == "a" and given.get("href") and inside["url"] is None:
                inside["url"], takes = given["href"], "title"
            else:
                takes = next((k for k in ("date", "source") if _is(classes, k)), "meta" if tag == "div" and (_is(classes, "meta") or _is(classes, "col")) else "number" if tag == "span" else None)
            # the first element of a kind only
            takes = takes if takes not in inside["texts"] or takes == "number" else None
            if takes == "number":
                takes = f"number{sum(k.startswith('number') for k in inside['texts'])}"
            if takes:
                inside["texts"][takes] = ""
        if tag not in _VOID:
            self.open.append({"tag": tag, "entry": inside, "takes": takes})

    def handle_endtag(self, tag: str) -> None:
        if any(x["tag"] == tag for x in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        for x in self.open:
            if x["takes"]:
                x["entry"]["texts"][x["takes"]] += data


def _plain(text: str | None) -> str | None:
    return " ".join((text or "").split()) or None


def parse_listing(html: str | None, entry: str) -> Iterator[tuple]:
    """Position from 1, id, number, title and url of the first link, ISO date and source of each entry, null where it has none."""
    parser = ListingParser(entry)
    parser.feed(html or "")
    parser.close()
    for at, e in enumerate(parser.entries):
        texts = {k: _plain(v) for k, v in e["texts"].items()}
        said = _META.match(texts.get("meta") or "")
        spans = [v for k, v in texts.items() if k.startswith("number") and v and _NUMBER.fullmatch(v)]
        day = texts.get("date") or e["datetime"] or (said and said[1])
        yield at + 1, e["id"], e["number"] or (said and said[2]) or next(iter(spans), None), texts.get("title"), e["url"], _DAY.sub(r"\3-\2-\1", day) if day and _DAY.fullmatch(day) else day, texts.get("source") or (said and said[3].strip()) or None


@F.udtf(returnType=SCHEMA)
class ListingEntries:
    def eval(self, html: str, entry: str):
        yield from parse_listing(html, entry)


def listing_entries(pages: DataFrame, html: str = "html", entry: str = "entry") -> DataFrame:
    """One row for each entry of a listing page, the other columns beside it.

    An entry is a ``div`` with ``entry`` as a class, or as the end of one after a hyphen,
    up to its own end tag; an entry within one is an entry of its own. A page without
    entries, or a null one, has no row.
    """
    rows = pages.lateralJoin(ListingEntries(F.col(html).outer(), F.lit(entry)))
    return rows.drop(html)
