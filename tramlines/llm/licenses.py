"""Licence scan by canonical digest: texts that are a known licence, whatever their dress.

A text is cut into lines, lower-cased, and each line canonicalised: a copyright line becomes empty,
runs of ASCII punctuation, white space and typographic marks become a space, and equivalent
spellings become one.  The SHA-256 digest of the joined lines is looked up in the table of known
digests by a hash join, and so is the digest of every single line, as short notices stand alone.

Only DataFrame functions are used.  The short known texts go through the same expressions, so digests
agree by construction; of long licences the table holds digests made by them.  The built-in table has under 100 rows and is broadcast; a table that the
caller gives is joined as the optimiser sees fit.

Edge cases: a null, empty or punctuation-only text has a null digest and matches nothing; a text of
any length is hashed whole; rows that repeat an id share the licences of their lines; known texts
with equal digests report the first name; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X

# Words that count as equal in licence texts (the second form is kept).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("centre", "center"), ("colour", "color"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("honour", "honor"), ("initialise", "initialize"), ("labour", "labor"), ("organisation", "organization"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("noncommercial", "non  commercial"),
    ("noninfringement", "non  infringement"), ("copyright  owner", "copyright  holder"), ("http", "https"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
"""
_ISC_END = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

_GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""

# Short licence texts, standard notices and one-line statements.
KNOWN: tuple[tuple[str, str], ...] = (
    ("0BSD", _0BSD + _ISC_END), ("Apache-2.0", _APACHE), ("BSD-2-Clause", _BSD_HEAD + _BSD_END), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("GPL-2.0-or-later", _GPL2), ("GPL-3.0-or-later", _GPL), ("ISC", _ISC + _ISC_END), ("MIT", _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "MIT License\n\n" + _MIT), ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)

# Canonical digests of complete licence texts as published, of their terms up to the
# closing line, and of their terms without it; tests compute them from the texts where a system has them.
FULL_TEXTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    ("Apache-2.0", "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859"),
    ("Apache-2.0", "2b4a3f34572f63637f58db72bdacad38516a1e1e6788b08931d0a0d5c0be33dd"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-2.0", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
)

# Patterns that Java and RE2 read alike.
COPYRIGHT = r"^[^a-z0-9]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*[0-9<\[{]|©)"
MARKS = "[\\x00-/:-`{-\\x7f ©«»‐-―‘-‟•…]+"


def _spelled(t: Column) -> Column:
    """`t` has two spaces between words and at both ends, so that neighbours are replaced independently."""
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return t


def _line(t: Column) -> Column:
    padded = F.concat(F.lit("  "), F.regexp_replace(t, MARKS, "  "), F.lit("  "))
    return F.when(t.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.regexp_replace(_spelled(padded), " +", " ")))


def canonical_lines(text: Column) -> Column:
    """The canonical form of every line that has one."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), _line), lambda t: t != "")


def _digest(t: Column) -> Column:
    return F.when(t != "", F.sha2(t, 256))


def _whole(lines: Column) -> Column:
    padded = F.concat(F.lit("  "), F.regexp_replace(F.array_join(lines, " "), " ", "  "), F.lit("  "))
    return F.trim(F.regexp_replace(_spelled(padded), " +", " "))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of the built-in licences, or of `texts` (license_id, text)."""
    given = spark.createDataFrame(list(KNOWN), "license_id string, text string") if texts is None else texts.select("license_id", "text")
    found = given.select(_digest(_whole(canonical_lines(F.col("text")))).alias("digest"), "license_id").where("digest is not null")
    if texts is None:
        found = found.unionByName(spark.createDataFrame(list(FULL_TEXTS), "license_id string, digest string"))
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id of the whole text (or null) and line_licenses, the comma-joined licences of its lines (or null)."""
    table = known_digests(docs.sparkSession) if known is None else known.select("digest", "license_id")
    table = F.broadcast(table) if known is None else table
    lines = X.documents_of(docs).select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    part = lambda whole, t: F.struct(F.lit(whole).alias("whole"), _digest(t).alias("digest"))
    parts = F.concat(F.array(part(True, _whole(F.col("lines")))), F.transform("lines", lambda t: part(False, t)))
    looked_up = lines.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.whole", "p.digest").join(table, "digest", "left")
    # One row for each text and for each line that is a licence: small, and written so that texts are canonicalised once.
    hits = X.written(looked_up.where("whole or license_id is not null"), "licenses")
    found = hits.where("not whole").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses"))
    return hits.where("whole").join(found, "doc_id", "left").select("doc_id", "digest", "license_id", "line_licenses")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan of table documents in DuckDB's SQL."""
    spelled = "%s"
    for old, new in SPELLINGS:
        spelled = f"replace({spelled}, ' {old} ', ' {new} ')"
    line = f"CASE WHEN regexp_matches(x, {_sql_text(COPYRIGHT)}) THEN '' ELSE trim(regexp_replace({spelled % f"'  ' || regexp_replace(x, {_sql_text(MARKS)}, '  ', 'g') || '  '"}, ' +', ' ', 'g')) END"
    lines = f"list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: {line}), lambda x: x <> '')"
    whole = f"trim(regexp_replace({spelled % "'  ' || replace(array_to_string(lines, ' '), ' ', '  ') || '  '"}, ' +', ' ', 'g'))"
    values = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)
    full = ", ".join(f"({_sql_text(i)}, {_sql_text(d)})" for i, d in FULL_TEXTS)
    return f"""
WITH given(license_id, text) AS (VALUES {values}),
known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256(whole) AS digest, license_id FROM (SELECT license_id, {whole} AS whole FROM (SELECT license_id, {lines} AS lines FROM given)) WHERE whole <> ''
          UNION ALL SELECT digest, license_id FROM (VALUES {full}) f(license_id, digest)) GROUP BY 1),
cut AS (SELECT doc_id, {lines} AS lines FROM documents),
texts AS (SELECT doc_id, CASE WHEN whole <> '' THEN sha256(whole) END AS digest FROM (SELECT doc_id, {whole} AS whole FROM cut)),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
          FROM (SELECT doc_id, sha256(line) AS digest FROM (SELECT doc_id, unnest(lines) AS line FROM cut)) JOIN known USING (digest) GROUP BY 1)
SELECT doc_id, digest, license_id, line_licenses FROM texts LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""
