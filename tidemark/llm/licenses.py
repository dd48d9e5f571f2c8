"""Licence texts and notices, found by the digest of their canonical form.

A text is made canonical by lower case, removal of copyright statements, one space for every run of characters other
than letters and digits, and one spelling for words that licences write in several ways. The digest of the
canonical form meets the digests of known texts in a hash join. Two kinds of whole texts are looked up:
each document, and each line of a document, for notices stand on lines of their own. The table of known
texts is a constant of this module, so its broadcast does not grow with the data; a document has one row however
many lines match.

A copyright statement is the word copyright with a sign, (c) or a year, or a sign or (c) with a year, or a line that begins with copyright and
says that all rights are reserved, up to the end of its holder, however long the list of holders: the words all rights reserved, the start of a known text, the end of a sentence or of the line. The start of a known text may stand on the next
line, as statements wrap too. All rights reserved goes also where it stands alone.

``sql`` states the rule that held before, by which whole lines went, and is left as it was: both agree where the only such lines hold
all rights reserved and nothing else.

Defined cases: a null text counts as empty; a text whose canonical form is empty matches nothing; repeated rows are
separate rows and ids may be null; an empty table gives no rows; other columns are not looked at. Letters are those
of ASCII: all others count as punctuation, as in the known texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Only for ``sql``, see above.
COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n]*(copyright|©|\(c\)|all rights reserved)[^\n]*$"
#: Spellings that count as equal in licence texts, replaced in this order.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("fulfilment", "fulfillment"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("whilst", "while"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"),
)
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. """ + _WARRANTY
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and
all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law. """ + _WARRANTY.replace(" OR COPYRIGHT HOLDERS", "") + """ For more
information, please refer to <https://unlicense.org>"""
#: Known licence texts and notices, by their public identifier.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("BSD-2-Clause", _BSD_1 + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_1 + _BSD_END),
    ("BSD-3-Clause", _BSD_1 + _BSD_3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_1 + _BSD_3 + _BSD_END),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("ISC", "ISC License\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _ISC + ". " + _ISC_END), ("0BSD", "BSD Zero Clause License\n" + _ISC + ". " + _ISC_END),
    ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def _starts() -> str:
    """The first three words of every known text as an expression for lower-case text."""
    spell = {"license": "licen[cs]e", "licensed": "licen[cs]ed"}
    first = {tuple(re.findall("[a-z0-9]+", text.lower())[:3]) for _, text in KNOWN}
    return "|".join(r"[^a-z0-9]+".join(spell.get(word, word) for word in words) + r"\b" for words in sorted(first))


_YEAR, _SIGN, _RESERVED = r"(?:19|20)\d\d\b", r"(?:\(c\)|©|&copy;)", r"all\s+rights\s+reserved\b\.?"
_OPENING = rf"(?:\bcopyright\b[ \t:]*(?:{_SIGN}|{_YEAR})|{_SIGN}\s*(?:copyright\b|{_YEAR})|^[^a-z0-9\n]*©|^[^a-z0-9\n]*copyright\b(?=[^\n]*{_RESERVED}))"
_SENTENCE = r"(?<=[^\W\d_]{2})(?<!\binc)(?<!\bltd)(?<!\bco)(?<!\bcorp)(?<!\bst)(?<!\bdr)(?<!\bjr)(?<!\bsr)\.(?=\s)"
_STOP = rf"(?:{_RESERVED}|(?=(?:{_starts()})))"
#: The holder ends in the same line, or in the next one before a sentence does, or with the line. Every quantifier is of one character class, so
#: the expression neither recurses over long lines or many lines nor needs a length limit.
_HOLDER = rf"(?:[^\n]*?(?:{_STOP}|{_SENTENCE})|[^\n]*+\n(?!\s*\n)(?>[^\n]*?(?=\.?\s*{_STOP}|{_SENTENCE}|$))\.?\s*{_STOP}|[^\n]*+)"
#: Statements, and lines right after a statement (where the last match ended) that begin with (c) alone.
STATEMENT = rf"(?mdU){_OPENING}{_HOLDER}|(?!\A)\G\s*\n[ \t]*\(c\)[^\n]*+"
RESERVED = r"(?md)(?:^|(?<=\.)\s)[^a-z0-9\n]*all\s+rights\s+reserved(?:\.|(?=[^a-z0-9\n]*$))"


def canonical(text: Column) -> Column:
    """The canonical form of a text, ``''`` if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), STATEMENT, " "), RESERVED, " ")
    text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    for spelling, common in SPELLINGS:
        text = F.replace(text, F.lit(spelling), F.lit(common))
    return text


def known(spark: SparkSession) -> DataFrame:
    """``digest, license`` of all known texts, one row per digest."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, canonical_sha256, license`` (of the whole document or null)``, notices`` (of its lines, sorted, joined by commas) and ``n_notices`` (lines that match).

    A document and its lines are looked up where they are read; of the lines only those that match are shuffled.
    """
    table = F.broadcast(known(docs.sparkSession))  # at most one row per entry of KNOWN, whatever the data
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.concat(F.array(text), F.split(text, "\n"))
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), units.alias("units"))
    rows = numbered.select("doc_id", "row", F.posexplode("units").alias("line", "unit"))
    looked_up = rows.select("row", "doc_id", "line", F.sha2(canonical(F.col("unit")), 256).alias("digest")).join(table, "digest", "left")
    whole, own = F.col("line") == 0, (F.col("line") > 0) & F.col("license").isNotNull()
    return looked_up.filter(whole | own).groupBy("row", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(whole, F.col("license"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(F.when(own, F.col("license")))), ",").alias("notices"),
        F.count(F.when(own, F.lit(1))).alias("n_notices"),
    ).drop("row")


def _canonical_sql(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE.replace('(?md)', '(?m)')}', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for spelling, common in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{common}')"
    return out


def sql() -> str:
    """The result of ``scan`` over ``documents``."""
    listed = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({_canonical_sql("t")}) AS digest, min(license) AS license FROM (VALUES {listed}) k(license, t) GROUP BY 1
), docs AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS line FROM documents
), notices AS (
  SELECT line, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
  FROM (SELECT line, unnest(string_split(t, chr(10))) AS unit FROM docs) JOIN known ON digest = sha256({_canonical_sql("unit")}) GROUP BY line
)
SELECT doc_id, sha256({_canonical_sql("t")}) AS canonical_sha256, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM docs LEFT JOIN known ON digest = sha256({_canonical_sql("t")}) LEFT JOIN notices USING (line)
"""
