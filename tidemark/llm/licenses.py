"""License scans: MinHash bands over overlapping windows, then exact containment.

A text's words (letter and digit runs, ASCII case folded) give shingles of two
words. Windows of 2h shingles start every h shingles, for each class h of
template length, so that a template of at most h + 1 shingles lies whole in
some window. Bands of one row each are enough in number that a window holding
the required share of a template's shingles meets one of its bands with
probability 1 - MISS at least. What the bands retrieve is decided by exact
containment: the share of the template's shingles that the window holds.

The long licences stand as whole texts in licence_texts/, read by the driver.
A document of fewer shingles than a template needs isn't looked at for it.

A document is scanned whole, in one row, so nothing is shuffled. Cases: null,
empty and shingle-free texts match nothing; repeated rows each give their
matches; two windows with equal containment report the first; an empty table gives
no rows; templates of one word are refused. Extra columns are ignored.
"""

from __future__ import annotations

import math
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bytewords import OTHER, windows, words
from tidemark.llm.common import bounded_batches, mixed, slabs, table, utf8_column

#: Notices by which works state their licence, and whole texts of short licences.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
    "mpl-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
#: The third condition makes the three-clause text.
TEMPLATES["bsd-3-text"] = TEMPLATES["bsd-2-text"].replace(
    "\nTHIS SOFTWARE IS", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS"
)
#: A window with the required share of a template goes unretrieved with this probability at most.
MISS = 1e-6
SLAB = 1 << 18
#: Classes from this many shingles on are looked for apart, in documents long enough for them.
LONG = 1024


def known_templates() -> dict[str, str]:
    """TEMPLATES, and the whole texts of the long licences."""
    folder = resources.files("tidemark.llm") / "licence_texts"
    long = {f"{f.name.removesuffix('.txt')}-text": f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    return {**TEMPLATES, **dict(sorted(long.items()))}


def shingles(data: np.ndarray, ends: np.ndarray):
    """doc and hash of each two-word shingle."""
    _, _, doc, h, kind = words(data, ends, coarse=False, fold=True)
    plain = kind != OTHER
    doc, h = doc[plain], h[plain]
    at, g = windows(h, doc, 2)
    return doc[at], g


class Classes:
    """Templates by window class, with their band values."""

    def __init__(self, templates: dict[str, str], containment: float):
        self.of: dict[int, list] = {}
        for name, text in templates.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            g = np.unique(shingles(raw, np.array([0, len(raw)]))[1])
            if not len(g):
                raise ValueError(f"template {name} has no shingle of two words")
            long = len(shingles(raw, np.array([0, len(raw)]))[1])
            half = 1 << max(2, math.ceil(math.log2(max(1, long - 1))))
            self.of.setdefault(half, []).append((name, g, math.ceil(containment * len(g) - 1e-9)))
        self.bands = {}
        for half, ts in self.of.items():
            alike = min(need / (2 * half + len(g) - need) for _, g, need in ts)
            self.bands[half] = math.ceil(math.log(MISS) / math.log(1 - alike))
        n = max(self.bands.values())
        self.keys = mixed(np.arange(1, n + 1, dtype=np.uint64))
        self.tiers = [t for t in ([h for h in self.of if h < LONG], [h for h in self.of if h >= LONG]) if t]
        self.least = {half: min(need for _, _, need in ts) for half, ts in self.of.items()}
        self.signs = {half: np.array([[(mixed(g ^ k) >> np.uint64(32)).min() for k in self.keys[: self.bands[half]]] for _, g, _ in ts], np.uint32) for half, ts in self.of.items()}


def matches(data: np.ndarray, ends: np.ndarray, c: Classes):
    """(doc, name, containment, first shingle) of each document and template, best window first."""
    doc, g = shingles(data, ends)
    best = {}
    for tier in c.tiers:
        able = np.bincount(doc, minlength=len(ends))[doc] >= min(c.least[half] for half in tier)
        if able.any():
            _windows_found(doc[able], g[able], c, tier, best)
    return [(d, name, n / of, where) for (d, name), (n, of, where) in sorted(best.items())]


def _windows_found(doc: np.ndarray, g: np.ndarray, c: Classes, tier: list[int], best: dict) -> None:
    """The best window of each document (whole in doc, g) and template of these classes, into best."""
    opening = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    inside = np.arange(len(g)) - np.repeat(opening, np.diff(np.append(opening, len(g))))
    blocks = {half: np.flatnonzero(inside % half == 0) for half in tier}
    found = {half: np.zeros((len(c.of[half]), len(b)), bool) for half, b in blocks.items()}
    for k, key in enumerate(c.keys[: max(c.bands[half] for half in tier)]):
        v = (mixed(g ^ key) >> np.uint64(32)).astype(np.uint32)
        for half, b in blocks.items():
            if k >= c.bands[half]:
                continue
            low = np.minimum.reduceat(v, b)
            win = low.copy()
            together = doc[b[1:]] == doc[b[:-1]]
            np.minimum(low[:-1], low[1:], out=win[:-1], where=together)
            for t, sign in enumerate(c.signs[half][:, k]):
                found[half][t] |= win == sign
    for half, b in blocks.items():
        for t, (name, own, need) in enumerate(c.of[half]):
            for i in np.flatnonzero(found[half][t]):
                lo = b[i]
                hi = min(lo + 2 * half, len(g))
                has = g[lo:hi][doc[lo:hi] == doc[lo]]
                if len(has) < need:
                    continue
                n = int(np.isin(own, has).sum())
                at = (int(doc[lo]), name)
                if n >= need and (at not in best or n > best[at][0]):
                    best[at] = (n, len(own), int(inside[lo]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """doc_id, license, containment, first_shingle (start of the best window) of every match."""
    bounded_batches(docs.sparkSession)
    templates = templates or known_templates()
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_shingle", pa.int64())])

    def run(batches):
        c = Classes(templates, containment)
        for b in batches:
            data, ends = utf8_column(b, "text")
            ids = b.column("doc_id").to_pylist()
            for first, last in slabs(ends, SLAB):
                rows = matches(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], c)
                yield pa.RecordBatch.from_pylist([{"doc_id": ids[first + d], "license": n, "containment": x, "first_shingle": s} for d, n, x, s in rows], schema)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, first_shingle long")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same windows and containment in DuckDB SQL, without the retrieval."""
    known = known_templates()
    c = Classes(known, 0.8)
    text = {name: t.replace("'", "''") for name, t in known.items()}
    rows = [f"('{name}', {half}, {need}, '{text[name]}')" for half, ts in c.of.items() for name, _, need in ts]
    grams = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    cut = "regexp_extract_all(lower({0}), '(?:[a-z]|[^\\x00-\\x7F])+|[0-9]+')"
    return f"""
WITH t AS (SELECT license, half, need, unnest(list_distinct({grams.format("k")})) AS g FROM (SELECT *, {cut.format("text")} AS k FROM (VALUES {", ".join(rows)}) v(license, half, need, text))),
size AS (SELECT license, count(*) AS size FROM t GROUP BY license),
d AS (SELECT row_number() OVER () AS rid, doc_id, {cut.format("coalesce(text, '')")} AS k FROM documents),
g AS (SELECT rid, doc_id, unnest({grams.format("k")}) AS g, unnest(range(0, len(k) - 1)) AS p FROM d WHERE len(k) > 1),
hit AS (SELECT rid, doc_id, license, half, need, t.g, unnest([p // half, p // half - 1]) AS b FROM g JOIN t ON g.g = t.g),
n AS (SELECT rid, doc_id, license, b * half AS first_shingle, count(DISTINCT g) AS n FROM hit WHERE b >= 0 GROUP BY rid, doc_id, license, b, half, need HAVING count(DISTINCT g) >= need)
SELECT doc_id, license, max(n) / CAST(any_value(size) AS DOUBLE) AS containment, CAST(arg_max(first_shingle, n * 1000000000 - first_shingle) AS BIGINT) AS first_shingle FROM n JOIN size USING (license) GROUP BY rid, doc_id, license
"""
