"""License scans by canonical digests.

A text is brought to a canonical form (lower case, copyright lines dropped, quotes
unified, punctuation to single blanks, equivalent spellings to one) and its SHA-256
is joined to the digests of known licence texts. The same lookup is done for each line
that holds "licen": notices such as "Licensed under the Apache License, Version 2.0."
are texts of their own. Known texts number well under a hundred, so their table
is broadcast whatever the corpus holds.

Null and empty texts match nothing. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’“”", "abcdefghijklmnopqrstuvwxyz''\"\""
COPYRIGHT = r"^[^a-z0-9©(]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|all rights reserved|<year>|\[year\]|\[yyyy\])"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Equivalent spellings: the first becomes the second, as whole words.
EQUAL = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("whilst", "while"),
    ("http", "https"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("merchantability", "merchantibility"),
    ("noncommercial", "non commercial"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"),
    ("fulfil", "fulfill"), ("analogue", "analog"), ("wilful", "willful"), ("percent", "per cent"), ("and or", "andor"), ("v3", "version 3"), ("v2", "version 2"),
)

#: The same for texts with two blanks between words, where each word has its own on both sides.
WIDE = tuple((old.replace(" ", "  "), new.replace(" ", "  ")) for old, new in EQUAL)

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Public licence texts, without their copyright lines, and usual notices: (SPDX id, text).
KNOWN = (
    ("MIT", f"MIT License\n{_PERMIT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT", f"{_PERMIT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("ISC", f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS), ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD}{_BSD_AS_IS}"),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_AS_IS), ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD}{_BSD3}{_BSD_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License v3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)


def canonical_text(text: str) -> str:
    """The canonical form, in Python: for known texts and tests."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    text = "\n".join(x for x in text.split("\n") if not re.search(COPYRIGHT, x))
    text = f" {re.sub('[^a-z0-9' + chr(0x80) + '-' + chr(0x10FFFF) + ']+', '  ', text).strip(' ')} "
    for old, new in WIDE:
        text = text.replace(f" {old} ", f" {new} ")
    return text.replace("  ", " ").strip(" ")


def canonical(text: Column) -> Column:
    """The canonical form as a Spark expression."""
    text = F.translate(text, UPPER, LOWER)
    text = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(COPYRIGHT)), "\n")
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, PUNCTUATION, "  ")), F.lit(" "))
    for old, new in WIDE:
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def known_digests(licences=KNOWN) -> dict[str, str]:
    return {hashlib.sha256(canonical_text(text).encode()).hexdigest(): spdx for spdx, text in licences}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences=KNOWN) -> DataFrame:
    """(id, digest, license, notices) for every row: the whole text's licence or null, and its notices' ids, sorted, distinct. `licences`: (SPDX id, text) of all known texts."""
    digests = known_digests(licences)
    known = F.broadcast(df.sparkSession.createDataFrame(list(digests.items()), "qs_digest string, qs_spdx string"))
    names = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair])
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.lower(x).contains("licen"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.element_at(names, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())))
    digest = F.sha2(F.nullif(canonical(F.col(text_col)), F.lit("")), 256)
    rows = df.select(F.col(id_col), digest.alias("digest"), F.coalesce(found, F.array().cast("array<string>")).alias("notices"))
    rows = rows.join(known, rows.digest == known.qs_digest, "left")
    return rows.select(id_col, "digest", F.col("qs_spdx").alias("license"), F.array_join("notices", ",").alias("notices"))


def sql(name: str = "documents") -> str:
    """DuckDB SQL for the same columns."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        text = f"translate({text}, {quote(UPPER)}, {quote(LOWER)})"
        text = f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches(x, {quote(COPYRIGHT)})), chr(10))"
        text = f"(' ' || trim(regexp_replace({text}, {quote(PUNCTUATION)}, '  ', 'g'), ' ') || ' ')"
        for old, new in WIDE:
            text = f"replace({text}, ' {old} ', ' {new} ')"
        return f"trim(replace({text}, '  ', ' '), ' ')"

    rows = ", ".join(f"({quote(d)}, {quote(s)})" for d, s in known_digests().items())
    return f"""WITH known(digest, spdx) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS uid, doc_id, text, {form('text')} AS form FROM {name}),
l AS (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT uid, spdx FROM (SELECT uid, sha256({form('line')}) AS h FROM l WHERE contains(lower(line), 'licen')) JOIN known ON h = digest),
g AS (SELECT uid, string_agg(DISTINCT spdx, ',' ORDER BY spdx) AS notices FROM n GROUP BY uid)
SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, known.spdx AS license, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON CASE WHEN form <> '' THEN sha256(form) END = known.digest LEFT JOIN g USING (uid)"""
