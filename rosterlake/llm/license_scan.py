"""Licence scan: Dice coefficient over word bigrams of normalised text and licence templates.

Text is lower-cased (A-Z); everything but ASCII letters, digits and non-ASCII bytes becomes a space, and
what stands between spaces are words. Lines that begin like a copyright line (``copyright`` and
then ``c``, the copyright sign or a number) are left out of texts and templates alike. Units of a
text are its whole text, each of its lines, and, for a template of n words, every run of n words. A
unit's set holds its distinct word bigrams; Dice = 2 * shared / (unit + template).

For a threshold t a template of size m can only match units of size m*t/(2-t) to m*(2-t)/t that share
m*t/(2-t) bigrams or more. So a template is a candidate only if the whole text shares so many of its
bigrams; units are pruned by size before they are compared, and runs by the number of
template bigrams in them, which is moved along the text.

Every matching (document, template) pair is one row with the best unit's coefficient; best marks the
document's highest one.

Edge cases: null, empty and one-word texts have no bigrams and match nothing; a template of fewer
than two words is refused; ties of the best template go to the smaller name; repeated rows give a
row each; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._common import load, parts, ship

#: Wording of short licence notices and headers.
NOTICES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT-notice": "Released under the MIT License.",
}
#: Whole licence texts, a file each in the folder licenses.
WHOLE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Zlib")
THRESHOLD = 0.9
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() or b == 10 else 32 for b in range(256)).lower()
Words = list[bytes]


def templates() -> dict[str, str]:
    folder = resources.files("rosterlake.llm") / "licenses"
    return NOTICES | {name: (folder / f"{name}.txt").read_text() for name in WHOLE}


def text_lines(text: bytes) -> list[Words]:
    """Words of each line that has any and is no copyright line."""
    lines = (x.split() for x in text.translate(_KEEP).split(b"\n"))
    return [x for x in lines if x and not (x[0] == b"copyright" and len(x) > 1 and (x[1] in (b"c", "©".encode()) or x[1].isdigit()))]


def dice(own: int, shared: int, m: int) -> float:
    return 2 * shared / (own + m)


class Matcher:
    def __init__(self, known: dict[str, str], threshold: float = THRESHOLD):
        self.t, self.names = threshold, sorted(known)
        words = [list(chain.from_iterable(text_lines(known[k].encode()))) for k in self.names]
        self.n = [len(w) for w in words]
        self.sets = [set(zip(w, w[1:], strict=False)) for w in words]
        if not all(self.sets):
            raise ValueError("a template needs two words")
        self.where: dict[tuple[bytes, bytes], list[int]] = {}
        for k, s in enumerate(self.sets):
            for g in s:
                self.where.setdefault(g, []).append(k)
        self.starts = {a for a, _ in self.where}

    def least(self, k: int) -> float:
        """No unit with fewer shared bigrams matches template k."""
        return len(self.sets[k]) * self.t / (2 - self.t) - 1e-9

    def unit(self, own: set, k: int) -> float:
        """The unit's coefficient, 0 below the threshold."""
        m = len(self.sets[k])
        if not m * self.t / (2 - self.t) - 1e-9 <= len(own) <= m * (2 - self.t) / self.t + 1e-9:
            return 0.0
        shared = len(own & self.sets[k])
        return dice(len(own), shared, m) if 2 * shared >= self.t * (m + len(own)) else 0.0

    def runs(self, w: Words, at: list[int], k: int) -> float:
        """The best coefficient of all runs of the template's length; at: places of its bigrams."""
        n, m, known = self.n[k], len(self.sets[k]), self.sets[k]
        best, last = 0.0, None
        own: Counter = Counter()
        shared = 0
        # starts whose run holds enough of the template's bigrams lie near them
        first = max(0, at[0] - n + 2)
        for i in range(first, min(at[-1], len(w) - n) + 1):
            if bisect_right(at, i + n - 2) - bisect_left(at, i) < self.least(k):
                last = None
                continue
            if last is None:
                own = Counter(zip(w[i : i + n], w[i + 1 : i + n], strict=False))
                shared = sum(g in known for g in own)
            else:
                gone, come = (w[i - 1], w[i]), (w[i + n - 2], w[i + n - 1])
                own[gone] -= 1
                if not own[gone]:
                    del own[gone]
                    shared -= gone in known
                own[come] += 1
                shared += own[come] == 1 and come in known
            last = i
            if 2 * shared >= self.t * (m + len(own)):
                best = max(best, dice(len(own), shared, m))
        return best

    def __call__(self, text: bytes | None) -> dict[str, float]:
        """The text's templates with the coefficients of their best units."""
        lines = text_lines(text or b"")
        w = list(chain.from_iterable(lines))
        places: dict[int, list[int]] = {}
        if not self.starts.isdisjoint(w):
            for i, g in enumerate(zip(w, w[1:], strict=False)):
                for k in self.where.get(g, ()):
                    places.setdefault(k, []).append(i)
        found = {}
        whole: set | None = None
        for k, at in places.items():
            if len({(w[i], w[i + 1]) for i in at}) < self.least(k) and len(lines) == 1:
                continue
            if len(at) < self.least(k):
                continue
            whole = set(zip(w, w[1:], strict=False)) if whole is None else whole
            scores = [self.unit(whole, k)]
            if len(lines) > 1:
                scores += [self.unit(set(zip(x, x[1:], strict=False)), k) for x in lines if len(x) > self.least(k)]
            if len(w) > self.n[k]:
                scores.append(self.runs(w, at, k))
            if max(scores) > 0:
                found[self.names[k]] = max(scores)
        return found


def scan(docs: DataFrame, known: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, license, dice, best: a row per document and matching template."""
    ship(docs.sparkSession)
    known = dict(known or templates())
    Matcher(known, threshold)  # refuses templates that are too short, here and not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(known, threshold)
        for b in chain.from_iterable(parts(b, 1) for b in batches):
            out: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = match(t)
                best = min(found, key=lambda x: (-found[x], x), default=None)
                out += [(k, name, found[name], name == best) for name in sorted(found)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.bool_()), strict=True)], ["doc_id", "license", "dice", "best"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, license string, dice double, best boolean")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents", spread=True)).withColumn("dice", F.round("dice", 9))


def oracle() -> str:
    """The same definition in SQL: all units of all texts that could match, by joins."""
    rows = ", ".join(f"('{k}', '{b' '.join(chain.from_iterable(text_lines(v.encode()))).decode()}')" for k, v in sorted(templates().items()))
    return rf"""
WITH t AS (SELECT k, string_split(body, ' ') AS w FROM (VALUES {rows}) x(k, body)),
tg AS (SELECT DISTINCT k, len(w) AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t),
tm AS (SELECT k, n, count(*) AS m FROM tg GROUP BY 1, 2),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr FROM documents),
c AS (SELECT doc_id, nr, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) AS line FROM l),
kept AS (SELECT * FROM c WHERE line <> '' AND NOT regexp_matches(line, '^copyright (c|©|[0-9]+)( |$)')),
d AS (SELECT doc_id, count(*) AS lines, string_split(string_agg(line, ' ' ORDER BY nr), ' ') AS w FROM kept GROUP BY 1),
p AS (SELECT doc_id, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d),
hit AS (SELECT p.doc_id, tg.k, tg.n, p.i, p.g FROM p JOIN tg USING (g)),
cand AS (SELECT doc_id, k, n, m FROM hit JOIN tm USING (k, n) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT g) >= {THRESHOLD} * m / {2 - THRESHOLD} - 1e-9),
near AS (SELECT hit.doc_id, hit.k, hit.n, cand.m, hit.g, hit.i FROM hit JOIN cand USING (doc_id, k, n)),
s AS (SELECT doc_id, k, n, m, unnest(range(greatest(1, i - n + 2), least(i, len(w) - n + 1) + 1)) AS a, g FROM near JOIN d USING (doc_id) WHERE len(w) > n),
run AS (SELECT doc_id, k, n, m, a, count(DISTINCT g) AS shared FROM s GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT g) >= {THRESHOLD} * m / {2 - THRESHOLD} - 1e-9),
ran AS (SELECT doc_id, k, m, shared, len(list_distinct(list_transform(range(a, a + n - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS own FROM run JOIN d USING (doc_id)),
whole AS (SELECT doc_id, k, m, count(DISTINCT g) AS shared, (SELECT count(DISTINCT p.g) FROM p WHERE p.doc_id = near.doc_id) AS own FROM near GROUP BY 1, 2, 3),
lw AS (SELECT kept.doc_id, kept.nr, string_split(line, ' ') AS w FROM kept JOIN (SELECT DISTINCT doc_id FROM cand) USING (doc_id) JOIN d USING (doc_id) WHERE d.lines > 1),
lg AS (SELECT DISTINCT doc_id, nr, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM lw),
ln AS (SELECT doc_id, nr, count(*) AS own FROM lg GROUP BY 1, 2),
line AS (SELECT lg.doc_id, cand.k, cand.m, count(*) AS shared, any_value(ln.own) AS own FROM lg JOIN cand USING (doc_id) JOIN tg USING (k, g) JOIN ln USING (doc_id, nr) GROUP BY 1, 2, 3, lg.nr),
u AS (SELECT doc_id, k, m, shared, own FROM ran UNION ALL SELECT doc_id, k, m, shared, own FROM whole UNION ALL SELECT doc_id, k, m, shared, own FROM line),
best AS (SELECT doc_id, k, max(2 * shared::DOUBLE / (own + m)) AS v FROM u WHERE 2 * shared >= {THRESHOLD} * (m + own) GROUP BY 1, 2)
SELECT doc_id, k AS license, round(v, 9) AS dice, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, k) = 1 AS best FROM best
"""


ORACLE = oracle()
