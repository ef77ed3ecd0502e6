r"""Licence scan by canonical digest lookup (operator 4, native).

A text is brought to a canonical form -- ASCII case folded, copyright lines and
lines that only name a licence taken out, punctuation and white space to single spaces, equivalent spellings
made one -- and its SHA-256 is hash-joined to the digests of known licences,
which are made by the same expression.  Entire texts are looked up, and every
line as a text of its own (notices such as "Released under the MIT License.").

The list of known texts is fixed in this module, so it has a proven bound and
is broadcast; a longer list of the caller's is joined by shuffle when it has
over BROADCAST_ROWS rows.

Result: one row per document: doc_id, digest (null for a null text),
license_id of the entire text (null if unknown), notices (sorted array of the
ids of known lines, empty if none).  A line that only names a licence ("MIT
License") is empty in canonical form and no notice.  Edge cases: null text gives null, null and
an empty array; an empty text has the digest of the empty string; repeated rows
each give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, row_key

BROADCAST_ROWS = 10_000

# SPDX identifiers whose one-line tags are known.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 MS-PL OFL-1.1 PostgreSQL Unlicense WTFPL Zlib"
).split()

# Paragraphs that several licences share.
_MIT_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(kind: str, version: str) -> str:
    """The notice that files under a GNU licence carry."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, {version}.\n\n"
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.\n\n"
        f"You should have received a copy of the GNU {kind} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


# Public licence texts and notices, by SPDX identifier.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n' + _BSD_DISCLAIMER),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n' + _MIT_DISCLAIMER),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'),
    ("GPL-2.0-or-later", _gnu("General", "either version 2 of the License, or (at your option) any later version")),
    ("GPL-2.0-only", _gnu("General", "version 2 of the License")),
    ("GPL-3.0-or-later", _gnu("General", "either version 3 of the License, or (at your option) any later version")),
    ("GPL-3.0-only", _gnu("General", "version 3 of the License")),
    ("LGPL-2.1-or-later", _gnu("Lesser General", "either version 2.1 of the License, or (at your option) any later version")),
    ("LGPL-3.0-or-later", _gnu("Lesser General", "either version 3 of the License, or (at your option) any later version")),
    ("AGPL-3.0-or-later", _gnu("Affero General", "either version 3 of the License, or (at your option) any later version")),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
    ("EPL-2.0", 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/'),
    ("WTFPL", 'TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
)

# Spellings that licence matching treats as one (after punctuation is gone).
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("fulfilment", "fulfillment"),
    ("recognised", "recognized"),
    ("redistribute s", "redistributes"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]|©)[^\n]*$|^[ \t]*copyright[ \t][^\n]*(19|20)[0-9]{2}[^\n]*$|^[ \t]*all rights reserved[. \t]*$"
#: A line that is nothing but the name of a licence.
TITLE_LINE = r"(?m)^[ \t#*=-]*(the[ \t]+)?(mit|mit no attribution|expat|isc|bsd|zlib|zlib/libpng|boost software|simplified bsd|new bsd|revised bsd|modified bsd|free public|bsd zero clause|zero-clause bsd|[023][ -]clause bsd|bsd[ -][023][ -]clause)([ \t]+\"?[a-z0-9-]*\"?)?[ \t]+licen[cs]e([ \t]*[-,]?[ \t]*(v|version[ \t]*)?[0-9.]+)?([ \t]*\([a-z0-9 ./-]*\))?[ \t]*:?[ \t#*=-]*$"
#: ASCII control, space and punctuation (capitals are folded by then), and common typographic marks.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F ©«»‐-‧‰-⁞]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.regexp_replace(t, TITLE_LINE, "")
    t = F.trim(F.regexp_replace(t, GAPS, " "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id) of a table (license_id, text); the smallest id when two texts agree."""
    return licenses.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    spark = docs.sparkSession
    small = licenses is None or licenses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = known_digests(licenses if licenses is not None else spark.createDataFrame(list(KNOWN), "license_id string, text string"))
    known = F.broadcast(known) if small else known
    base = require(docs, "doc_id", "text")
    whole = base.select("doc_id", *row_key(), digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    lines = base.select(*row_key(), F.explode(F.split("text", "\n")).alias("line")).select("_id", "_th", digest(F.col("line")).alias("digest"))
    hits = lines.join(known, "digest").groupBy("_id", "_th").agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
    return whole.join(hits, ["_id", "_th"], "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def query(spark, sf_dir: str) -> DataFrame:
    """notices as one string, ids separated by commas, so that the row compares with SQL."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    t = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    t = f"regexp_replace({t}, {_literal(COPYRIGHT_LINE)}, '', 'g')"
    t = f"regexp_replace({t}, {_literal(TITLE_LINE)}, '', 'g')"
    t = f"trim(regexp_replace({t}, {_literal(GAPS)}, ' ', 'g'), ' ')"
    for old, new in SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    return t


ORACLE = f"""with known as (select digest, min(license_id) license_id from (select sha256({_canonical_sql("text")}) digest, license_id
  from (values {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in KNOWN)}) k(license_id, text)) group by digest),
numbered as materialized (select row_number() over () n, doc_id, text from documents),
lines as (select distinct n, sha256({_canonical_sql("line")}) digest from (select n, unnest(string_split(text, chr(10))) line from numbered)),
hits as (select n, string_agg(distinct license_id, ',' order by license_id) notices from lines join known using (digest) group by n),
whole as (select n, doc_id, case when text is not null then sha256({_canonical_sql("text")}) end digest from numbered)
select doc_id, digest, license_id, coalesce(notices, '') as notices from whole left join known using (digest) left join hits using (n)"""
