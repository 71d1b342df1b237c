"""License scans by canonical digests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import ascii_lower

#: Spellings that count as equal, as words of a canonical text.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("favour", "favor"),
    ("authorisation", "authorization"), ("organisation", "organization"), ("recognise", "recognize"), ("whilst", "while"), ("fulfil", "fulfill"),
    ("https", "http"), ("the software is provided by the author as is", "the software is provided as is"), ("version 2 0", "version 2"), ("version 3 0", "version 3"), ("4 0 international", "4 0"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def _texts() -> list[tuple[str, str, str]]:
    """The whole texts of the package's folder, with and without what follows their terms."""
    out = []
    for name, id_, kind in (("Apache-2.0", "Apache-2.0", "permissive"), ("CC0-1.0", "CC0-1.0", "permissive"), ("GPL-2", "GPL-2.0", "copyleft"), ("GPL-3", "GPL-3.0", "copyleft"), ("LGPL-2.1", "LGPL-2.1", "copyleft"), ("LGPL-3", "LGPL-3.0", "copyleft"), ("MPL-2.0", "MPL-2.0", "copyleft")):
        t = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")
        terms, end, _ = t.partition("END OF TERMS AND CONDITIONS")
        out += [(id_, kind, t)] + ([(id_, kind, terms), (id_, kind, terms + end)] if end else [])
    return out


def _headers() -> list[tuple[str, str, str]]:
    """The standard headers: their first paragraph, and all of it."""
    out = [("Apache-2.0", "permissive", _APACHE), ("Apache-2.0", "permissive", f"{_APACHE}\nhttp://www.apache.org/licenses/LICENSE-2.0\n{_APACHE_END}")]
    out += [("MPL-2.0", "copyleft", _MPL), *(("MPL-2.0", "copyleft", f"{_MPL} If a copy of the MPL was not distributed with this file, You can obtain one at {u}") for u in ("http://mozilla.org/MPL/2.0/.", "http://www.mozilla.org/MPL/2.0/."))]
    for id_, name, version in (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")):
        for what in ("program", "library", "file", "software"):
            for term in (f"either version {version} of the License, or (at your option) any later version.", f"version {version} of the License.", f"version {version}."):
                first = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, {term}"
                rest = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."
                got = f"You should have received a copy of the GNU {name} Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
                out += [(id_, "copyleft", t) for t in (first, f"{first} {rest}", f"{first} {rest} {got}")]
    return out


def _names() -> list[tuple[str, str, str]]:
    """(id, kind, name) of every licence as notices call it."""
    out = [("MIT", "permissive", n) for n in ("the MIT License", "MIT", "MIT License")] + [("ISC", "permissive", n) for n in ("the ISC License", "ISC")] + [("Zlib", "permissive", n) for n in ("the zlib License", "Zlib")]
    out += [("Unlicense", "permissive", n) for n in ("the Unlicense", "Unlicense")] + [("CC0-1.0", "permissive", n) for n in ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal")]
    out += [("Apache-2.0", "permissive", n) for n in ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "Apache License 2.0")]
    out += [(f"BSD-{n}-Clause", "permissive", f"{a}BSD {n}-Clause{b}") for n in "23" for a, b in (("the ", " License"), ("", ""), ("", " License"))]
    out += [("MPL-2.0", "copyleft", n) for n in ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0", "MPL-2.0", "the MPL 2.0")]
    for id_, name, short, version in (("GPL-2.0", "General", "GPL", "2"), ("GPL-3.0", "General", "GPL", "3"), ("LGPL-2.1", "Lesser General", "LGPL", "2.1"), ("LGPL-3.0", "Lesser General", "LGPL", "3"), ("AGPL-3.0", "Affero General", "AGPL", "3")):
        dotted = version if "." in version else version + ".0"
        for n in (f"the GNU {name} Public License, version {version}", f"the GNU {name} Public License v{dotted}", f"the GNU {name} Public License v{version}", f"the GNU {short}, version {version}", f"{short}-{dotted}", f"the {short}-{dotted}", f"the {short}v{version}", f"{short}v{version}"):
            out += [(id_, "copyleft", n + end) for end in ("", " only", " or later", " or any later version", ", or (at your option) any later version")]
    for parts, kind in (("BY", "permissive"), ("BY-SA", "copyleft"), ("BY-NC", "restricted"), ("BY-NC-SA", "restricted"), ("BY-ND", "restricted"), ("BY-NC-ND", "restricted")):
        long = "-".join({"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}[x] for x in parts.split("-"))
        out += [(f"CC-{parts}-4.0", kind, n) for n in (f"CC {parts} 4.0", f"CC {parts} 4.0 International", f"a Creative Commons {long} 4.0 International License", f"the Creative Commons {long} 4.0 International License")]
    return out


#: How notices begin.
PHRASES = ("Licensed under", "Released under", "Distributed under", "Available under", *(f"This {w} is {v} under" for w in ("work", "software", "project", "program", "library") for v in ("licensed", "released", "distributed")))

#: Licence id, kind and a known text, whole licences and the notices that refer to one.
KNOWN = (
    ("MIT", "permissive", _MIT), ("MIT", "permissive", "MIT License\n" + _MIT),
    ("ISC", "permissive", _ISC), ("ISC", "permissive", "ISC License\n" + _ISC),
    ("BSD-2-Clause", "permissive", "\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_END))),
    ("BSD-3-Clause", "permissive", "\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END))),
    ("Zlib", "permissive", _ZLIB),
    ("Unlicense", "permissive", _UNLICENSE), *_texts(), *_headers(),
    *((i, k, f"{phrase} {name}.") for i, k, name in _names() for phrase in PHRASES),
)

#: What makes a line a copyright line, from its first letter, digit, sign (c) or bracket.
COPYRIGHT = r"\n[\x00-\x09\x0B-\x27\x29-\x2F\x3A-\x60\x7B-\x7F]*(?:copyright (?:notice )?(?:\(c\)|[0-9©])|\(c\) |©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
_VARIANT = "|".join(a for a, _ in SPELLINGS)


def _apart(words: str) -> str:
    return words.replace(" ", "  ")


def canonical_lines(text: Column) -> Column:
    """The text with A-Z lower-cased, copyright lines emptied and each run of other signs made a blank."""
    t = F.concat(F.lit("\n"), ascii_lower(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(t, COPYRIGHT, "\n"), PUNCTUATION, " ")


def respelled(t: Column) -> Column:
    """Equal spellings made one; only texts with a variant pay for it. Each word
    has blanks of its own on both sides meanwhile, so neighbours do not share one."""
    out = F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {_apart(a)} "), F.lit(f" {_apart(b)} "))
    return F.when(t.rlike(_VARIANT), F.trim(F.replace(out, F.lit("  "), F.lit(" ")))).otherwise(t)


def unit(lines: Column) -> Column:
    """One canonical unit: line ends and runs of blanks are one blank."""
    return respelled(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    """(digest, license, kind, length) of known texts; as many rows as ``known``."""
    k = spark.createDataFrame(list(known), "license string, kind string, text string").withColumn("lines", canonical_lines(F.col("text"))).withColumn("u", unit(F.col("lines")))
    return k.select(F.sha2("u", 256).alias("digest"), "license", "kind", F.length("u").alias("length")).dropDuplicates(["digest"])


def license_scan(docs: DataFrame, known: tuple[tuple[str, str, str], ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which known licence texts a document is or holds.

    Whole texts are made canonical (case, punctuation, copyright lines, equal
    spellings) and their digests joined to those of the known texts: the whole
    document, each of its paragraphs (between empty lines) and each of its
    lines. A unit whose length no known text has cannot be equal to one and is
    not hashed. The known table is a constant of this module, so its broadcast
    does not grow with the data.

    Returns per row: doc_id, whole_license (the document is that text and no
    more, else null), licenses (sorted, comma-joined, of any unit), n_notices
    (lines that are known notices), restricted (any licence of a kind other
    than permissive). Null and empty texts hold none. Repeated and null ids get
    a row each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    digests = known_digests(spark, known)
    lengths = sorted(r[0] for r in digests.select("length").distinct().collect())  # of the constant table
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("c"))
    fits = lambda u: F.length(u).isin(lengths)
    paragraphs = F.split(F.regexp_replace("c", r"\n ?\n[ \n]*", "\x0b"), "\x0b")
    named = lambda what, a: F.transform(F.filter(a, fits), lambda u: F.struct(F.lit(what).alias("what"), u.alias("u")))
    rows = rows.select("row", "doc_id", F.array(unit(F.col("c"))).alias("whole"), F.transform(paragraphs, unit).alias("paragraphs"), F.transform(F.split("c", "\n"), lambda x: respelled(F.trim(x))).alias("lines"))
    rows = rows.select("row", "doc_id", F.explode_outer(F.concat(named("whole", F.col("whole")), named("paragraph", F.col("paragraphs")), named("line", F.col("lines")))).alias("x"))
    rows = rows.select("row", "doc_id", "x.what", F.sha2("x.u", 256).alias("digest")).join(F.broadcast(digests.drop("length")), "digest", "left")
    out = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("what") == "whole", F.col("license"))).alias("whole_license"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.count(F.when(F.col("what") == "line", F.col("license"))).alias("n_notices"),
        F.coalesce(F.max(F.col("kind") != "permissive"), F.lit(False)).alias("restricted"),
    )
    return out.drop("row")
