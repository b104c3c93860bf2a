"""Licence scan by canonical digests (operator 2).

Texts are brought to a canonical form: lower case, copyright lines dropped, equivalent spellings unified, punctuation and
white space reduced to single blanks. The SHA-256 of the whole canonical text is joined with the digests of known
licences, brought to the same form. DataFrame operations only, so that licences and documents take one path.

The known licences are the short texts here and the files of ``licenses`` (the name up to a ``~`` is the licence; several
files are forms of one text), each with and without its usual title lines. A text with words before or after a licence isn't
one. Lines that start with "copyright" are dropped, but for those that go on with a word of running text (holders, notice,
law and so on), which begin so only by their wrapping.

Null or empty texts, and texts that are empty in canonical form, have a null digest and no licence. Repeated rows are
told each; an empty table gives no rows; very long texts are taken whole. Of several known licences with one canonical form
the least name is given. Columns of the input named license or license_sha256 are replaced.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings taken as one (fixed values, after the SPDX licence list matching guidelines).
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("licence", "license"), ("modelled", "modeled"),
    ("noncommercial", "non commercial"), ("organisation", "organization"), ("owner", "holder"), ("practise", "practice"), ("programme", "program"),
    ("recognise", "recognize"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("https", "http"),
)

#: Known licences: public texts (fixed values).
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense-short": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}

#: Usual title lines above licences whose texts have none (fixed values).
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike 4.0 International",),
}

#: The steps of the canonical form: pattern, replacement. They read alike in Java's and RE2's pattern languages.
STEPS = (
    ("(^|\n)([ \t]*((//|#|\\*)+[ \t]*)?)copyright([ \t]+(holders?|owners?|notices?|laws?|licen[cs]es?|statements?|interests?|and|or|in|is|to|as|of)([^a-z]|$))", "$1$2_copyright$5"),
    ("(^|\n)[ \t]*((//|#|\\*)+[ \t]*)?(copyright|\\(c\\)|©)[^\n]*", "$1"),
    ("all rights reserved", " "),
    ("[^a-z0-9\u0080-\U0010ffff]+", " "),
)


def canonical(text: Column) -> Column:
    """The canonical form; null where nothing is left."""
    t = F.lower(text)
    for pattern, by in STEPS:
        t = F.regexp_replace(t, pattern, by)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.trim(t)
    return F.when(t != "", t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """Name and text of every known form of a licence."""
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    texts = [*KNOWN.items(), *((f.stem.split("~")[0], f.read_text("utf-8")) for f in files)]
    return texts + [(name, f"{title}\n\n{body}") for name, body in texts for title in TITLES.get(name, ())]


def known_digests(known: DataFrame) -> DataFrame:
    """known: license, text. One row a digest."""
    return known.select(digest(F.col("text")).alias("digest"), "license").where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with license_sha256 (of the canonical text) and license (null where unknown)."""
    spark = docs.sparkSession
    known = known if known is not None else spark.createDataFrame(known_texts(), "license string, text string")
    own = known_digests(known).select(F.col("digest").alias("_license_digest"), F.col("license").alias("_license_name"))
    made = docs.withColumn("_license_own", digest(F.col(text))).drop(*[c for c in ("license", "license_sha256") if c != text])
    joined = made.join(own, F.col("_license_own") == F.col("_license_digest"), "left").drop("_license_digest")
    return joined.withColumnsRenamed({"_license_own": "license_sha256", "_license_name": "license"})


def sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL. Digests of the known texts are made here, in plain Python, and stand in it as values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(c: str) -> str:
        t = f"lower({c})"
        for pattern, by in STEPS:
            t = f"regexp_replace({t}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
        for a, b in SPELLINGS:
            t = f"replace({t}, {quote(a)}, {quote(b)})"
        return f"nullif(trim({t}), '')"

    def plain(t: str) -> str:
        t = t.lower()
        for pattern, by in STEPS:
            t = re.sub(pattern, lambda m, by=by: re.sub(r"\$(\d)", lambda g: m[int(g[1])] or "", by), t)
        for a, b in SPELLINGS:
            t = t.replace(a, b)
        return t.strip()

    found: dict[str, str] = {}
    for name, t in known_texts():
        d = hashlib.sha256(plain(t).encode()).hexdigest()
        found[d] = min(found.get(d, name), name)
    rows = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in sorted(found.items()))
    return f"""with k(digest, license) as (values {rows}),
        d as (select doc_id, sha256({form('text')}) as license_sha256 from {table})
        select d.doc_id, d.license_sha256, k.license from d left join k on d.license_sha256 = k.digest"""
