"""Licence scans by canonical digests, with SQL functions alone.

A text is made canonical (lower case; lines that only state a copyright go; hyphens and apostrophes go; other
punctuation and white space become one space; equivalent spellings become one) and digested with SHA-256; the
digest of the entire text is looked up, by a hash join, among those of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that the public SPDX matching guidelines treat as equal (written here without hyphens).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
_NO_NAME = "notice|holder|owner|law|and\\b|or\\b|licen[cs]e|in\\b|of\\b|the\\b|to\\b|is\\b|are\\b|as\\b|statement|interest"  # go on a sentence
COPYRIGHT_LINE = (  # a line that only states a copyright: with a sign, a year or a name of up to six words
    r"(^|\n)[ \t*#/;>-]*(copyright[ \t]*(\(c\)|©|:|[0-9<\[{])[^\n]*|copyright\b[^\n]*\b(19|20)[0-9]{2}\b[^\n]*"
    rf"|copyright[ \t]+(?!{_NO_NAME})[^\s]+([ \t]+[^\s]+){{0,5}}[ \t]*(?=\r?\n|$)|\(c\)[ \t]*[0-9][^\n]*|©[^\n]*|all rights reserved[^\n]*)"
)
TITLE = r"^\s*([^\s]+[ \t]+){0,6}[(]?licen[sc]e[^\n.]{0,30}(\n|$)"  # a first line such as 'The MIT License (MIT)'
JOINED = "[-'’‘‐‑]"
PARTED = r"[^\p{L}\p{M}\p{N}]+"

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Texts of public licences, without their copyright lines; more can be given as a table.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": f"{_GRANT}.\n{_NO_WARRANTY}",
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_NO_WARRANTY}",
    "BSD-2-Clause": _BSD.format(third=""),
    "BSD-3-Clause": _BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
    "Unlicense": _UNLICENSE,
    "Zlib": _ZLIB,
}
#: SHA-256 of the canonical form of long public licences' whole texts, as published.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "d0b9e561e6c56b6611f4078777946e478f6885643bbaa39c40cfc5b111a2e41f",
    "Artistic-1.0-Perl": "473d8ad8f083152801354b6dd385aafa5ff791b803c9f6c4c6ad09f6d01e74a8",
    "CC0-1.0": "85ecef89c0122e868b86bc7a79554a2fb3820f078c8a08fff28ee2c887322762",
    "GFDL-1.2": "bbe93f50c9fc268dff9c29319717169112e97f62be4e7a2ac9cc4d3554bbb5fa",
    "GFDL-1.3": "3ff9025d659b3da77ef436eeb5b13b63153d88f7ab9aaa4c69d8155d1ae0d326",
    "GPL-1.0": "bf4ebfad247484bcd2ceda25c63548fabd201c4ee6851bbd8408edb348e3f48c",
    "GPL-2.0": "865c7367a13ac088ebc4204b67121492167c5770c2915640af2af38a4edff1b5",
    "GPL-3.0": "df9ec7ddb4f14331c9f494001c0e31f800acfaca4d277528f70fc2f3cf646b80",
    "LGPL-2.0": "65be38a585d52715da38cff08cea08bbe01d4a005bf6e7ab21f893a0c40d5692",
    "LGPL-2.1": "8b15419a59274968b73bc39025ba6b6d1f459cd91f42777dcd5f5c822154646a",
    "LGPL-3.0": "afd8fd4ebe1467dadad8a10a317007d0065fb2f1faa401e9741b50c0aba3c381",
    "MPL-1.1": "ead14b448d478c2041a6c19aa40af24d1b82da1ab969dac5fd5f13202d29d4a1",
    "MPL-2.0": "f1c838fa76ded33f2bad796af519718b10d7bef6f297d39765773da8f68a2dbd",
}


def canonical(text: str = "text") -> Column:
    """The canonical form of a column's whole text; a null counts as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(F.regexp_replace(out, TITLE, " "), JOINED, "")
    out = F.trim(F.regexp_replace(out, PARTED, " "))
    wide = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word has blanks of its own
    for old, new in SPELLINGS.items():
        wide = F.replace(wide, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    spelt = F.trim(F.replace(wide, F.lit("  "), F.lit(" ")))
    return F.when(out.rlike(rf"\b({'|'.join(SPELLINGS)})\b"), spelt).otherwise(out)  # few texts hold any


def known_table(spark, known: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of known licences given as texts, or of those built in; of equal digests, the first name stays."""
    rows = spark.createDataFrame(list((KNOWN if known is None else known).items()), "license_id string, text string")
    digests = rows.select("license_id", F.sha2(canonical(), 256).alias("digest"))
    if known is None:
        digests = digests.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license_id string, digest string"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, license_id): the SHA-256 of each whole text in canonical form and the licence it is, or null.

    Null, empty and blank texts share the digest of the empty text and match nothing. Rows come through one to
    one, with null or repeated ids too; extra columns take no part. `known`: (digest, license_id); of rows with one
    digest, the first name counts; its side is broadcast only if the planner sees that it is small."""
    listed = known.groupBy("digest").agg(F.min("license_id").alias("license_id")) if known is not None else known_table(docs.sparkSession)
    rows = docs.select(F.col(id_), canonical(text).alias("c")).select(id_, F.sha2("c", 256).alias("digest"), (F.col("c") == "").alias("blank"))
    found = rows.join(listed.select(F.col("digest").alias("d"), "license_id"), (F.col("digest") == F.col("d")) & ~F.col("blank"), "left")
    return found.select(id_, "digest", "license_id")


def variants(items: DataFrame, id_: str = "item_id") -> DataFrame:
    """(id, text): for each item one of the licences given as texts, by its id, dressed up in one of the ways that the
    canonical form undoes, or with a word more, which it does not."""
    names = list(KNOWN)
    of = F.element_at(F.array(*map(F.lit, KNOWN.values())), F.pmod(F.col(id_), F.lit(len(names))).cast("int") + 1)
    way = F.pmod(F.floor(F.col(id_) / len(names)), F.lit(7))
    dressed = (
        F.when(way == 0, of)
        .when(way == 1, F.concat(F.lit("MIT License\n\nCopyright (c) 2020 A. Person\n\n"), of))
        .when(way == 2, F.concat(F.lit("Copyright Jane Doe 2020\n"), F.replace(F.upper(of), F.lit(","), F.lit(" ,"))))
        .when(way == 3, F.regexp_replace(F.regexp_replace(of, '"([^"]*)"', "“$1”"), r"\blicense\b", "licence"))
        .when(way == 4, F.concat(F.lit("# Copyright Jane Doe\n# (c) 1999 others\n"), F.replace(of, F.lit("\n"), F.lit("\r\n  "))))
        .when(way == 5, F.concat(of, F.lit("\nAll rights reserved.")))
        .otherwise(F.concat(of, F.lit(" and more")))
    )
    return items.select(id_, dressed.alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_words(text: str) -> str:
    """DuckDB SQL for the words of the canonical form, line by line and word by word (the operator works on whole
    strings): lines that state a copyright or a title go, words are looked up in a map."""
    names = _NO_NAME.replace("\\b", "")
    stated = (
        r"regexp_matches(l, '^[ \t*#/;>-]*(copyright[ \t]*(\(c\)|©|:|[0-9<\[{])|\(c\)[ \t]*[0-9]|©|all rights reserved)') or regexp_matches(l, '^[ \t*#/;>-]*copyright\b.*\b(19|20)[0-9]{2}\b')"
        rf" or (regexp_matches(l, '^[ \t*#/;>-]*copyright[ \t]+[^\s]+([ \t]+[^\s]+){{0,5}}[ \t]*\r?$') and not regexp_matches(l, '^[ \t*#/;>-]*copyright[ \t]+({names})'))"
    )
    lines = f"list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: not ({stated}))"
    full = f"list_filter({lines}, lambda l: not regexp_matches(l, '^\\s*$'))"
    body = f"(case when regexp_matches(coalesce({full}[1], ''), '^\\s*([^\\s]+[ \\t]+){{0,6}}[(]?licen[sc]e[^.]{{0,30}}$') then {full}[2:] else {full} end)"
    words = f"list_filter(regexp_split_to_array(regexp_replace(array_to_string({body}, chr(10)), '[-''’‘‐‑]', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"
    one = {k: v for k, v in SPELLINGS.items() if " " not in k}
    table = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in one.items()) + "}"
    spelt = f"array_to_string(list_transform({words}, lambda w: coalesce({table}[w], w)), ' ')"
    for old, new in ((k, v) for k, v in SPELLINGS.items() if " " in k):
        spelt = f"regexp_replace({spelt}, '\\b{old}\\b', '{new}', 'g')"
    return spelt


def sql() -> str:
    texts = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN.items())
    digests = ", ".join(f"({_quoted(name)}, {_quoted(digest)})" for name, digest in DIGESTS.items())
    return f"""
with known as (select digest, min(license_id) as license_id from (
  select license_id, sha256({_sql_words('text')}) as digest from (values {texts}) as k(license_id, text) union all select * from (values {digests}) as h(license_id, digest)) group by 1),
docs as (select doc_id, {_sql_words('text')} as c from documents)
select doc_id, sha256(c) as digest, license_id from docs left join known on sha256(c) = known.digest and c <> ''
"""


def variants_sql(id_: str = "item_id", source: str = "benchmark") -> str:
    """Which licence each row of `variants` is, by how it was made."""
    n = len(KNOWN)
    names = ", ".join(map(_quoted, KNOWN))
    return f"select {id_}, case when ({id_} // {n}) % 7 = 6 then null else ([{names}])[{id_} % {n} + 1] end as license_id from {source}"
