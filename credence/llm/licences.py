"""Licence texts by canonical digest.

A text is brought to a canonical form (case, copyright lines, equivalent spellings,
punctuation and white space) and hashed; its digest is joined with the digests of known
licences. Only entire texts match. Known licences are a table like the documents, of
any size; a few are built in.

Defined results: null and empty texts have the digest of the empty form, which matches
no licence; a text of copyright lines alone has it too; repeated rows stay; licences
with equal digests join as the one with the least name; texts may have any length; an
empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as the same, the second standing for both.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisation", "capitalization"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("non-commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub-license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https://", "http://"),
]
COPYRIGHT_LINE = r"(?m)^[ \t*/#;.-]*(?:(?:copyright|portions copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]|<|\[|\{|by )|all rights reserved)[^\n]*$"
NOT_WORDS = r"[^\p{L}\p{N}]+"

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Licences that are known without a table.
KNOWN = [
    ("0BSD", f"{ISC_GRANT}.\n\n{ISC_WARRANTY}"),
    ("Apache-2.0-notice", APACHE_NOTICE),
    ("Apache-2.0-reference", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", f"{BSD_HEAD}\n{BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_HEAD}{BSD_THIRD}\n{BSD_WARRANTY}"),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_WARRANTY}"),
    ("MIT", f"{MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{MIT_WARRANTY}"),
    ("MIT-0", f"{MIT_GRANT}.\n\n{MIT_WARRANTY}"),
]


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words with single spaces between them.

    Spellings are replaced as whole words or phrases, never inside a longer word.
    """
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORDS, " ")), F.lit(" "))
    # Neighbours share the space between them, so it is doubled until all are replaced.
    out = F.replace(out, F.lit(" "), F.lit("  "))
    for one, two in SPELLINGS:
        out = F.replace(out, F.lit(_spaced(one)), F.lit(_spaced(two)))
    return F.trim(F.regexp_replace(out, " +", " "))


def _spaced(words: str) -> str:
    return f" {'  '.join(re.split('[^a-z]+', words.strip('/:')))} "


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest) of every row."""
    return df.select(key, F.sha2(canonical(F.col(text)), 256).alias("digest"))


def read_licences(spark, path: str) -> DataFrame:
    """(licence_id, text) of a folder of text files, one licence each, named by its id: the entire texts to look for."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("licence_id"), F.col("value").alias("text"))
    return files


def known_licences(spark, rows=KNOWN) -> DataFrame:
    return spark.createDataFrame(rows, "licence_id string, text string")


def scan(df: DataFrame, licences: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest, licence_id) of every row; licence_id is null where the text is no known licence's."""
    licences = known_licences(df.sparkSession) if licences is None else licences
    empty = F.sha2(F.lit(""), 256)
    known = digests(licences, "text", "licence_id").where(F.col("digest") != empty).groupBy("digest").agg(F.min("licence_id").alias("licence_id"))
    return digests(df, text, key).join(known, "digest", "left").select(key, "digest", "licence_id")


def _sql(value: str) -> str:
    out = f"regexp_replace(lower(coalesce({value}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    out = f"replace(' ' || trim(regexp_replace({out}, '{NOT_WORDS}', ' ', 'g')) || ' ', ' ', '  ')"
    for one, two in SPELLINGS:
        out = f"replace({out}, '{_spaced(one)}', '{_spaced(two)}')"
    return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"


def _known_sql() -> str:
    return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)


#: The same rows by DuckDB.
ORACLE = f"""
WITH known(licence_id, text) AS (VALUES {_known_sql()}),
k AS (SELECT {_sql("text")} AS digest, min(licence_id) AS licence_id FROM known GROUP BY 1),
d AS (SELECT doc_id, {_sql("text")} AS digest FROM documents)
SELECT doc_id, d.digest, licence_id FROM d LEFT JOIN k ON d.digest = k.digest AND d.digest <> sha256('')
"""
