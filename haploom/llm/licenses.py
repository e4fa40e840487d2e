"""License scans: canonical digests of entire texts, looked up by a hash join.

A text is brought into a canonical form (ASCII letters lower-cased, copyright
lines left out, equivalent spellings made one, punctuation and runs of blanks
turned into one space) and its digest is joined with the digests of known
licences and notices, made the same way. A document's whole text, each of its
lines, and each run of up to ``RUN`` paragraphs count as an entire text, so a
licence file, a licence under a title or among other text, and a notice inside
a document are found. Only DataFrame functions are used; the digests are a
fixed broadcast table. Whole texts are known of the short licences; those of
many pages (GPL, MPL, Creative Commons) are known by their notices.

Defined cases: null and empty texts match nothing; texts may be of any length;
a unit that is repeated counts once; rows with null or repeated ids are scanned
one by one; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, literal_rows

#: Spellings that count as the same, first one replaced by the second; whole words, after lower-casing.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("acknowledgment", "acknowledgement"),
    ("authorization", "authorisation"), ("merchantability", "merchantability"), ("non infringement", "noninfringement"), ("copyright holder s", "copyright holders"), ("per cent", "percent"),
    ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("v 3", "version 3"), ("v3", "version 3"),
]

#: Licence texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
TEXTS = [
    ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("0BSD", _ISC.replace(" provided that the above copyright notice and this permission notice appear in all copies", "").replace("granted,.", "granted.")),
    ("GPL-3.0", _GPL.format(name="General Public License", version="3")), ("GPL-2.0", _GPL.format(name="General Public License", version="2").replace("software: you", "software; you")),
    ("LGPL-3.0", _GPL.format(name="Lesser General Public License", version="3")), ("AGPL-3.0", _GPL.format(name="Affero General Public License", version="3")), ("MPL-2.0", _MPL),
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("Apache-2.0", _APACHE),
]
#: Most paragraphs of a run; runs of more than one have this many characters at least, as the known ones do.
RUN, RUN_CHARS = 6, 400
#: What stands between paragraphs.
GAP = r"\n[ \t\r]*\n"
#: Licences by the names that notices give them.
NAMES = [
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache-2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("Unlicense", "Unlicense"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC0-1.0", "CC0 1.0"),
]
#: What a notice says before the name.
LEADS = ["", "Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under", "Distributed under the", "This work is licensed under", "This work is licensed under the", "This software is licensed under the", "SPDX-License-Identifier:"]
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


def known() -> list[tuple[str, str]]:
    """(licence, text) of all known texts and notices."""
    return TEXTS + [(key, f"{lead} {name}".strip()) for lead in LEADS for key, name in NAMES]


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; empty if nothing is left."""
    low = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _COPYRIGHT, " ")
    out = F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for was, now in SPELLINGS:
        if was != now:
            out = F.replace(out, F.lit(f" {was} "), F.lit(f" {now} "))
    return F.btrim(out)


def digests(spark: SparkSession) -> DataFrame:
    """license, digest of every known text; a few hundred rows."""
    rows = literal_rows(spark, ["license", "known"], known())
    return rows.select(F.md5(canonical(F.col("known"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def _units(text: Column) -> Column:
    """The parts of a text that count as entire texts, each once."""

    def runs(paragraphs: Column) -> Column:
        n = F.size(paragraphs)
        each = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(RUN))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(k.alias("k"), F.array_join(F.slice(paragraphs, i, k), "\n\n").alias("t"))))
        long = F.filter(F.flatten(each), lambda r: (r["k"] == 1) | (F.length(r["t"]) >= RUN_CHARS))
        return F.when(n > 1, F.transform(long, lambda r: r["t"])).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(text), F.split(text, "\n"), let(F.split(text, GAP), runs)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, whole (licence whose text the document is, or null), licenses (sorted, of whole text, lines and runs of paragraphs), n_licenses of every row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(t).alias("_t"), t.alias("_text"))
    units = rows.select("doc_id", "_t", F.explode(_units(F.col("_text"))).alias("unit"))
    coded = units.select("doc_id", "_t", (F.md5("unit") == F.col("_t")).alias("entire"), F.md5(canonical(F.col("unit"))).alias("digest"))
    matched = coded.join(F.broadcast(digests(docs.sparkSession)), "digest")  # a few hundred digests
    # rows that are alike in id and text match alike, so a pair of these is enough to find them
    found = matched.groupBy("doc_id", "_t").agg(F.max(F.when(F.col("entire"), F.col("license"))).alias("whole"), F.sort_array(F.collect_set("license")).alias("licenses"))
    ids = rows.select("doc_id", "_t")
    out = ids.join(found, ids["doc_id"].eqNullSafe(found["doc_id"]) & (ids["_t"] == found["_t"]), "left")
    return out.select(ids["doc_id"], "whole", F.concat_ws(",", "licenses").alias("licenses"), F.greatest(F.size(F.coalesce("licenses", F.array())), F.lit(0)).cast("long").alias("n_licenses"))
