"""Practitioner cards of the sources that serve pages, one reader per page shape.

A reader gets a page's tree and yields cards: key, name, branch, credentials, detail link and entries
(day, time text or start and end). Names of classes and attributes belong to the pages and are fixed
values. Pages are read in Arrow batches, since Spark has no HTML parser; everything after that
(hints, repeats, sessions) is done on DataFrames in adapters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

from rosterlake.sources.dom import Node, tree

CARD = "card int, record string, name string, branch string, credentials string, detail string, entries array<struct<branch:string,day:string,time:string,start:string,end:string>>"
_ENTRY = pa.struct([(n, pa.string()) for n in ("branch", "day", "time", "start", "end")])
_ARROW = [("card", pa.int32()), *[(n, pa.string()) for n in ("record", "name", "branch", "credentials", "detail")], ("entries", pa.list_(_ENTRY))]
_RANGE = re.compile(r"\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}")


@dataclass
class Card:
    record: str
    name: str
    branch: str = ""
    credentials: str = ""
    detail: str = ""
    entries: list[dict] = field(default_factory=list)

    def add(self, day: str, time: str, branch: str | None = None) -> None:
        if day and time and time != "-":
            self.entries.append({"branch": branch, "day": day, "time": time})


def options(page: Node, select: str, skip: str) -> dict[str, str]:
    """slug -> name of a filter's options, without the one for everything."""
    box = page.one(select)
    found = {o["value"]: o.text() for o in box.all("option")} if box else {}
    return {k: v for k, v in found.items() if k and v and skip not in (k.lower(), v.lower())}


def columbia_asia(page: Node) -> Iterator[Card]:
    for c in page.all(".find-doctor-item"):
        link = c.said('a[href*="/doctor-appointment/"]', "href")
        special = [t for n in c.all(".find-doctor-info div") if (t := n.text()).lower() == "dermatology"]
        if link and c.said("h4"):
            yield Card(link.rstrip("/"), c.said("h4"), "", special[0] if special else "", link.rstrip("/"))


def columbia_asia_detail(page: Node) -> Iterator[Card]:
    told = [n.text() for n in page.all(".pt-doctor-info strong")]
    card = Card("", "", told[1] if len(told) > 1 else "", told[0] if told else "")
    table = page.one("table.table-schedule")
    for row in table.all("tbody tr") if table else ():
        cells = [n.text("\n") for n in row.all("td")]
        if len(cells) >= 2:
            for part in _RANGE.findall(cells[1]) or [cells[1]]:
                card.add(cells[0], part)
    yield card


def mayapada(page: Node) -> Iterator[Card]:
    seen = set()
    for link in page.all('#doctor_list a[href*="/find-doctor/detail/"]'):
        name, url = link.said("p"), link["href"]
        # wide and narrow screens hold the same card: one for each link
        if not name or url in seen:
            continue
        seen.add(url)
        around = link.parent
        while around.parent is not None and around.one("table.table") is None:
            around = around.parent
        cells = [[n.text() for n in row.all("td")] for row in around.all("table.table tr")]
        yield Card(url, name, next((x[1] for x in cells if len(x) > 1 and "hospital" in x[0].lower()), ""), "", url)


def mayapada_detail(page: Node) -> Iterator[Card]:
    """Times of every table of the page, a table for each branch. The listing's card names the record's branch."""
    card = Card("", "")
    for table in page.all("table"):
        head = table.one("thead th")
        for row in table.all("tbody tr") if head else ():
            cells = [x.text("") for x in row.all("th")]
            if len(cells) >= 2 and all(cells[:2]):
                card.entries.append({"branch": None, "day": cells[0], "time": cells[1]})
    yield card


def radjak(page: Node) -> Iterator[Card]:
    branches = list(options(page, 'select[name="unit"]', "all").values())
    for n, c in enumerate(page.all(".col-md-4.mb-4")):
        link, name, text = c.said('a[href*="/dokter/detail/"]', "href"), c.said("img[alt]", "alt"), c.text()
        if not link or not name:
            continue
        special = "Spesialis Kulit dan Kelamin"
        card = Card(f"{n}", name, next((b for b in branches if b in text), ""), special if special in text else "", link)
        for row in c.all(".row"):
            card.add(row.said(".col-md-4"), row.said(".col-md-8"))
        yield card


def sari_asih(page: Node) -> Iterator[Card]:
    branches = options(page, 'select[form-data="hospital"]', "semua cabang")
    by_name = {v.lower(): k for k, v in branches.items()}
    for c in page.all('[id^="dokter_"]'):
        name, found = c.said("h4"), {}
        for table in c.all("table.schedule_doctor"):
            slug = table.said("[data-hospital]", "data-hospital")
            for row in table.all("tbody tr") if slug else ():
                cells = [x.text() for x in row.all("td")]
                if len(cells) >= 2 and all(cells[:2]) and cells[1] != "-":
                    found.setdefault(slug, []).append(cells[:2])
        # without times, the badges tell the branches
        for badge in c.all(".badge") if not found else ():
            if slug := by_name.get(f"rs sari asih {badge.text()}".lower()):
                found.setdefault(slug, [])
        for slug, rows in found.items():
            card = Card(f"{c['id']}@{slug}", name, branches.get(slug, ""), name, c.said("a.text-link", "href"))
            for day, time in rows:
                card.add(day, time)
            yield card


def primaya(page: Node) -> Iterator[Card]:
    for c in page.all("div.item.asp_r_pagepost"):
        post = next((x.removeprefix("asp_r_pagepost_") for x in c["class"].split() if x.startswith("asp_r_pagepost_")), "")
        if post:
            yield Card(post, c.said(".doctor-card-name"), c.said(".doctor-card-location"), "", c.said(".doctor-card-name a", "href"))


def primaya_detail(page: Node) -> Iterator[Card]:
    """A branch for each block of times; a block without times still names its branch."""
    card = Card("", "")
    for block in page.all(".schedule-item"):
        branch = block.said(".schedule-hospital")
        rows = [(r.said(".schedule-day-label"), r.said(".schedule-day-time").split("(")[0].strip()) for r in block.all(".schedule-day-row")]
        for day, time in (rows or [(None, None)]) if branch else ():
            card.entries.append({"branch": branch, "day": day, "time": time})
    yield card


def bethsaida(page: Node) -> Iterator[Card]:
    for n, c in enumerate(page.all(".doctor-list-schedule")):
        name = c.said(".media-content b")
        if name.lower().startswith("dr"):
            card = Card(f"{n}", name, c.said(".media-figure__caption"), "", c.said('a[href*="/dokter/detaildokter/"]', "href"))
            for cell in c.all(".doctor-schedule table.doctor-schedule-table tbody tr td[data-label]"):
                card.add(cell["data-label"], cell.text(""))
            yield card


def emc(page: Node) -> Iterator[Card]:
    for n, c in enumerate(page.all(".doctor-list-schedule")):
        card = Card(f"{n}", c.said(".media-content b"), c.said(".media-figure__caption"), "", c.said('a[href*="/doctors/"]', "href"))
        for link in c.all('a.anchor-button[href*="/doctor-schedule"]'):
            q = {k: v[0] for k, v in parse_qs(urlparse(link["href"]).query).items()}
            if {"day", "start_time", "end_time"} <= q.keys():
                card.entries.append({"branch": None, "day": q["day"], "start": q["start_time"], "end": q["end_time"]})
        if card.name:
            yield card


def rs_premier(page: Node) -> Iterator[Card]:
    for c in page.all(".doctor-item"):
        key, name = c.said(".toggle-shcedule[data-id]", "data-id"), c.said("h6")
        if key and name:
            yield Card(key, name, "", name, c.said("a.button-outline", "href"))


def rs_premier_detail(page: Node) -> Iterator[Card]:
    card, table = Card("", ""), page.one("table.table-dekstop")
    heads = [n.text() for n in table.all("thead th")] if table else []
    for row in table.all("tbody tr") if table else ():
        for day, cell in zip(heads, row.all("td"), strict=False):
            for part in _RANGE.findall(cell.text()) or [cell.text()]:
                card.add(day, part)
    yield card


def eka(page: Node) -> Iterator[Card]:
    def said(c: Node, what: str) -> str:
        return c.said(f'[data-testid="{what}"]')

    for n, c in enumerate(page.all(".doctor-card") or page.all('[data-testid="link-profile-doctor"]')):
        place = said(c, "doctor-location")
        chosen = said(c, "selected-doctor-location") or ("" if "," in place else place)
        card = Card(f"{n}", said(c, "doctor-name"), chosen or place, place, c.said('[data-testid="link-profile-doctor"]', "href"))
        for day in c.all('[data-testid="doctor-schedule-day"]'):
            for time in day.parent.parent.all('[data-testid="doctor-schedule-times"]'):
                card.add(day.text(), time.text(), chosen or None)
        yield card


READERS: dict[str, Callable[[Node], Iterator[Card]]] = {f.__name__: f for f in (columbia_asia, columbia_asia_detail, mayapada, mayapada_detail, radjak, sari_asih, primaya, primaya_detail, bethsaida, emc, rs_premier, rs_premier_detail, eka)}


def read(pages: DataFrame, reader: str, html: str = "html") -> DataFrame:
    """The pages' other columns and a row for each card of each page."""
    kept = [c for c in pages.columns if c != html]
    frame = pages.select(*kept, html)
    schema = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                at, rows = [], []
                for i, h in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    for n, c in enumerate(READERS[reader](tree(h))):
                        at.append(i)
                        rows.append((n, c.record, c.name, c.branch, c.credentials, c.detail, c.entries))
                taken = b.take(pa.array(at, pa.int32()))
                columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], *(pa.array(list(c), t) for c, (_, t) in zip(columns, _ARROW, strict=True))], [*kept, *(n for n, _ in _ARROW)])

    return frame.mapInArrow(run, f"{schema}, {CARD}")
