"""Links, tables, options and headings of HTML pages, in Arrow batches: Spark has no HTML parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ITEMS = "kind string, position int, attribute string, text string"


class _Reader(HTMLParser):
    """Collects (kind, attribute, text) of the elements asked for, in document order."""

    KINDS = {"a": "href", "option": "value", "td": "data-label", "th": "data-label", "title": "", "h1": "", "h2": "", "img": "alt"}

    def __init__(self, card: str):
        super().__init__(convert_charrefs=True)
        self.card, self.found, self.open, self.quiet = card, [], [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.quiet += 1
        kinds = ([tag] if tag in self.KINDS else []) + (["card"] if self.card and self.card in a.get("class", "").split() else [])
        for kind in kinds:
            item = [kind, a.get(self.KINDS.get(kind, "id"), ""), []]
            self.found.append(item)
            if tag not in VOID:
                self.open.append((tag, item))
        if tag not in VOID and not kinds and any(t == tag for t, _ in self.open):
            self.open.append((tag, None))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.quiet:
            for _, item in self.open:
                if item is not None:
                    item[2].append(data)


def items(html: str | None, card: str = "") -> list[tuple[str, int, str, str]]:
    """(kind, position, attribute, text) of a page; null or broken HTML gives what can be read."""
    r = _Reader(card)
    r.feed(html or "")
    r.close()
    return [(k, i, a, " ".join("".join(t).split())) for i, (k, a, t) in enumerate(r.found)]


def extract(pages: DataFrame, key: str, html: str = "html", card: str = "") -> DataFrame:
    """key and a row for each link, option, table cell, heading, image and card of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = [(k, *x) for k, h in zip(b.column(0).to_pylist()[lo : lo + 64], b.column(1).to_pylist()[lo : lo + 64], strict=True) for x in items(h, card)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (b.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], [key, "kind", "position", "attribute", "text"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, {ITEMS}")
