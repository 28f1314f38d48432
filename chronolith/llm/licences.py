"""Licence scans: whole texts against known licences, by the digest of a canonical form.

The canonical form has A-Z lowered, copyright lines dropped, equivalent spellings made one, and everything
but ASCII letters, digits and characters beyond ASCII turned into single blanks. Texts are joined on the
digest; the join carries digests, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same in a licence (fixed values): the first is turned into the second.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("redistribution s", "redistributions"),
    ("whilst", "while"), ("per cent", "percent"), ("non infringement", "noninfringement"), ("copyright holder s", "copyright holders"),
)
#: Texts of short, widely used licences and notices, without their copyright lines (fixed values).
KNOWN = {
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
#: SHA-256 of the canonical form of long licences, of their whole published texts (fixed values).
DIGESTS = {
    "Apache-2.0": "6ab5deeb4b2c14f4681b97d03ec0d6cf046968b552bd6e2efe1721910b2e5e9e",
    "Artistic-1.0-Perl": "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86",
    "GFDL-1.3": "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
    "GPL-3.0": "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f",
    "LGPL-2.0": "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3",
    "LGPL-2.1": "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}
#: A line that only says who holds the copyright.
COPYRIGHT_LINE = r"(?m)^[\x20\t*#/;-]*(copyright|\(c\)|all rights reserved)[^\n]*$"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form of a text; that of null is empty."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), COPYRIGHT_LINE, "")
    # a word has blanks of its own on both sides while spellings change, so that neighbours do not share one
    out = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(out, BETWEEN, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def known(spark: SparkSession) -> DataFrame:
    """``license_id, text, canonical_sha256``: KNOWN by text and DIGESTS by digest; of a fixed size."""
    rows = [(k, v, None) for k, v in KNOWN.items()] + [(k, None, v) for k, v in DIGESTS.items()]
    return spark.createDataFrame(rows, "license_id string, text string, canonical_sha256 string")


def license_scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``doc_id, canonical_sha256, canonical_chars, license_id`` of every row; license_id null for texts that are no known licence.

    ``licenses`` has ``license_id`` and ``text``, or ``canonical_sha256`` where the text is null. Licences that share a
    canonical form go by the smallest license_id. A licence without a word is no licence, so null, empty and blank texts match
    none. Repeated rows each give a row; an empty table gives none. Other columns are not read.
    """
    of = known(docs.sparkSession) if licenses is None else licenses
    if "canonical_sha256" not in of.columns:
        of = of.withColumn("canonical_sha256", F.lit(None).cast("string"))
    form, digest = canonical(F.col("text")), F.sha2("__form", 256)
    of = of.select("license_id", F.col("canonical_sha256").alias("__given"), form.alias("__form"))
    of = of.select("license_id", F.when(F.col("__form") != "", digest).otherwise(F.col("__given")).alias("canonical_sha256")).where("canonical_sha256 is not null")
    of = of.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", form.alias("__form")).select("doc_id", digest.alias("canonical_sha256"), F.length("__form").cast("bigint").alias("canonical_chars"))
    return rows.join(of, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "canonical_chars", "license_id")


def variants(docs: DataFrame) -> DataFrame:
    """For each row a known licence by its id, printed in one of five ways, two of which are no licence any more.

    Upper case and other signs; below a copyright line; other spellings; a word more; the row's own text.
    """
    names = sorted(KNOWN)
    text = F.get(F.array(*(F.lit(KNOWN[n]) for n in names)), F.pmod(F.col("doc_id"), F.lit(len(names))).cast("int"))
    way = F.pmod(F.col("doc_id"), F.lit(5))
    out = (
        F.when(way == 0, F.replace(F.upper(text), F.lit("."), F.lit(" *\n")))
        .when(way == 1, F.concat(F.lit("# Copyright (c) 2020 A. Author\n\n"), text))
        .when(way == 2, F.replace(F.replace(text, F.lit("sublicense"), F.lit("sublicence")), F.lit("acknowledgment"), F.lit("acknowledgement")))
        .when(way == 3, F.concat(text, F.lit(" "), F.col("doc_id").cast("string")))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", out.alias("text"))


def _form(text: str) -> str:
    out = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
    out = f"(' ' || replace(trim(regexp_replace({out}, '{BETWEEN}', ' ', 'g')), ' ', '  ') || ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{_spaced(old)}', '{_spaced(new)}')"
    return f"trim(replace({out}, '  ', ' '))"


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for license_scan over a table of documents."""
    quoted = lambda t: t.replace("'", "''")
    values = ", ".join(f"('{k}', '{quoted(v)}')" for k, v in KNOWN.items())
    given = ", ".join(f"('{v}', '{k}')" for k, v in DIGESTS.items())
    return (
        f"WITH d AS (SELECT doc_id, {_form('text')} AS f FROM {source}), k(license_id, text) AS (VALUES {values}), g(s, license_id) AS (VALUES {given}), "
        f"l AS (SELECT s, min(license_id) AS license_id FROM (SELECT sha256({_form('text')}) AS s, license_id FROM k UNION ALL SELECT * FROM g) GROUP BY 1) "
        "SELECT doc_id, sha256(f) AS canonical_sha256, length(f)::BIGINT AS canonical_chars, license_id FROM d LEFT JOIN l ON sha256(f) = l.s"
    )


def variants_oracle() -> str:
    quoted = lambda t: t.replace("'", "''")
    texts = ", ".join(f"'{quoted(KNOWN[n])}'" for n in sorted(KNOWN))
    return oracle(
        "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(upper(t), '.', ' *' || chr(10)) WHEN 1 THEN '# Copyright (c) 2020 A. Author' || chr(10) || chr(10) || t "
        "WHEN 2 THEN replace(replace(t, 'sublicense', 'sublicence'), 'acknowledgment', 'acknowledgement') WHEN 3 THEN t || ' ' || doc_id ELSE text END AS text "
        f"FROM (SELECT *, ([{texts}])[doc_id % {len(KNOWN)} + 1] AS t FROM documents))"
    )
