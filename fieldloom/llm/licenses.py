"""License scans by canonical digests, in plain DataFrame functions.

A text is brought to a canonical form (ASCII lower case, copyright lines dropped, with or without a year and behind marks of
comments too, equivalent spellings made one, a title line before the text dropped, punctuation, marks of comments and white space
made single blanks) and hashed. The digests of whole texts are joined to a
table of known license digests (whole public licenses, kept as they are published in ``license_texts``, and customary
notices); the lines of a text that speak of a license are looked up the same way, each
as an entire text. The known table is small and of fixed size, so it is broadcast.

Null and empty texts have the digest of the empty text and match nothing.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What may stand before the words of a line: blanks and marks of comments.
LEAD = r"[ \t#/*;%-]*"
#: Lines that name holders: of a year or a place for one, or, after "copyright (c)" or ©, of anything.
COPYRIGHT = rf"(^|\n){LEAD}((copyright[ \t]*)?(\(c\)|©|copyright)[ \t]*[0-9<\[{{][^\n]*|(copyright[ \t]*\(c\)|©|copyright[ \t]*©)[^\n]*|all rights reserved\.?[ \t]*)"
#: A title on a line of its own before the text: a few words that end in "license".
TITLE = r"^[ \t\r\n#/*;%-]*(the )?([a-z0-9.,-]+ )?([a-z0-9.,-]+ )?([a-z0-9.,-]+ )?license( \([a-z0-9 .-]+\))?[ \t\r]*\n"
#: Equivalent spellings (fixed values).
SPELLINGS = [
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("acknowledgement", "acknowledgment"),
    ("https://", "http://"),
    ("&", " and "),
]
MARKS = r"[^\p{L}\p{N}]+"
NOTICE = r"(?i)licen[cs]e|copyleft|public domain|spdx"

#: Known texts (fixed values): short public license texts and customary notices.
SHORT: list[tuple[str, str]] = [
    ("MIT", """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """zlib License

Copyright (c) <year> <holder>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License

Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def whole_texts() -> list[tuple[str, str]]:
    """``(license, text)`` of the files in ``license_texts``, by name."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files]


KNOWN = SHORT + whole_texts()


def canonical(text: Column) -> Column:
    """Canonical form of a text."""
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT, "$1")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, TITLE, "")
    return F.trim(F.regexp_replace(t, MARKS, " "))


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    t = f"translate({text}, '{UPPER}', '{LOWER}')"
    t = f"regexp_replace({t}, '{COPYRIGHT}', '\\1', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace({t}, '{TITLE}', '')"
    return f"trim(regexp_replace({t}, '{MARKS}', ' ', 'g'))"


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, license)`` of known texts, one row per digest."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, body string")
    return rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, license, n_notices, notice_licenses)`` for every text.

    ``license`` is that of the entire text (null: none), ``notice_licenses`` the sorted distinct licenses of
    lines that are an entire known text. ``known`` is a fixed table of few rows.
    """
    table = F.map_from_entries(F.from_json(F.lit(_as_json(known)), "array<struct<digest:string,license:string>>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOTICE))
    notices = F.filter(F.transform(lines, lambda x: F.element_at(table, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.when(F.col("text").rlike(NOTICE), notices).otherwise(F.array().cast("array<string>")).alias("found"))
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notice_licenses"))


def _as_json(known: DataFrame) -> str:
    import json

    return json.dumps([r.asDict() for r in known.collect()])


def oracle_sql(documents: str = "documents") -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({canonical_sql('body')}) AS digest, min(license) AS license
  FROM (VALUES {values}) AS v(license, body) GROUP BY 1
), whole AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256({canonical_sql("coalesce(text, '')")}) AS digest FROM {documents}
), notices AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS found
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM whole) AS l
  JOIN known ON known.digest = sha256({canonical_sql('line')})
  WHERE regexp_matches(line, '{NOTICE}') GROUP BY doc_id
)
SELECT whole.doc_id, whole.digest, known.license, coalesce(notices.n, 0)::BIGINT AS n_notices, coalesce(notices.found, '') AS notice_licenses
FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)
"""
