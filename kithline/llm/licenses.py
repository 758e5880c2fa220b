"""Licence scan by canonical digests: normalise, hash, look up.

A text's canonical form folds case, drops copyright lines, replaces equivalent
spellings, turns punctuation into blanks and closes up white space; its digest is
the SHA-256 of that. Whole texts are hash-joined to the digests of known licences.
Each line's digest is also looked up among the known one-line notices, so that a
document that only states its licence is reported too. Everything is a column
expression of one projection; the known digests are a fixed table of this module.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Lines that state a copyright (with a sign, a year or a place for one) or reserve all rights are dropped;
# a line that merely begins with the word, as wrapped licence texts have them, is not ...
COPYRIGHT = r"(?m)^[^a-z0-9\n(©]*(?:(?:portions )?copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\]|\{yyyy\})[^\n]*|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4})[^\n]*|all rights reserved[ \t]*[.]?[ \t]*)$"
# ... spellings that count as equal ...
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("noncommercial", "non commercial"), ("non-commercial", "non commercial"), ("merchantibility", "merchantability"), ("http://", "https://"))
# ... and what is left of punctuation and white space becomes one blank.
BETWEEN = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f ‐-‟•…]+"

_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: The notice of the GNU licences: which one, and from which version on.
_GNU = """This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""


def _gnu(spdx: str, name: str, version: str, what: str = "program") -> tuple:
    return tuple((f"{spdx}-{version if '.' in version else version + '.0'}-or-later", _GNU.format(what=what, sep=a, sep2=b, name=name, version=version)) for a, b in ((":", ","), (";", ";")))


#: Whole licences, file headers that stand for one, and one-line notices, by SPDX identifier.
LICENCES = (
    ("MIT", "MIT License\nCopyright (c) holder\n" + _GRANT + _WARRANTY), ("MIT", "The MIT License (MIT)\n" + _GRANT + _WARRANTY), ("MIT", _GRANT + _WARRANTY),
    ("ISC", "ISC License\n" + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")), ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", "BSD Zero Clause License\n" + _ISC.format("")), ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD.format("")), ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD.format(_THIRD)), ("BSD-3-Clause", _BSD.format(_THIRD)),
    ("MIT-0", "MIT No Attribution\n" + _GRANT.partition(", subject to")[0] + "." + _WARRANTY), ("MIT-0", _GRANT.partition(", subject to")[0] + "." + _WARRANTY),
    ("Zlib", "zlib License\n" + _ZLIB), ("Zlib", "The zlib/libpng License\n" + _ZLIB), ("Zlib", _ZLIB), ("BSL-1.0", _BOOST), ("WTFPL", _WTFPL),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"), ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"), ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
    *_gnu("GPL", "General Public License", "2"), *_gnu("GPL", "General Public License", "3"), *_gnu("AGPL", "Affero General Public License", "3"),
    *_gnu("LGPL", "Lesser General Public License", "2.1", "library"), *_gnu("LGPL", "Lesser General Public License", "3", "library"), *_gnu("LGPL", "Lesser General Public License", "3"),
)
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"), ("LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("ISC", "SPDX-License-Identifier: ISC"), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for given, same in SPELLINGS:
        out = F.replace(out, F.lit(given), F.lit(same))
    return F.trim(F.regexp_replace(out, BETWEEN, " "))


def digest_of(text: str) -> str:
    """The digest of one known text, by the rules of canonical()."""
    out = re.sub(COPYRIGHT, "", text.lower())
    for given, same in SPELLINGS:
        out = out.replace(given, same)
    return hashlib.sha256(re.sub(BETWEEN, " ", out).strip(" ").encode()).hexdigest()


def scan(docs: DataFrame, licences: tuple = LICENCES, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text) and notices (of its lines) for each row of docs (doc_id, text).

    Null and empty texts have the digest of the empty text, no licence and no notices.
    notices are distinct identifiers in order, joined by commas. Repeated rows each give one
    row, an empty table none. licences and notices are short constant tables, so their digests
    are broadcast; licences that are too long for this module (whole GNU, Apache and Creative
    Commons texts) can be given as further entries of licences.
    """
    spark = docs.sparkSession
    known = {digest_of(t): name for name, t in reversed(licences)}
    by_line = {digest_of(t): name for name, t in reversed(notices)}
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in known.items()) + " AS t(text_digest, license_id)")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("licen[cs]e|licensed"))
    digests = F.transform(marked, lambda x: F.sha2(canonical(x), 256))
    names = F.create_map(*[F.lit(x) for pair in by_line.items() for x in pair])
    found = F.array_sort(F.array_distinct(F.filter(F.transform(digests, lambda d: names[d]), lambda n: n.isNotNull())))
    rows = docs.select(F.col("doc_id").cast("long"), F.sha2(canonical(text), 256).alias("text_digest"), F.array_join(found, ",").alias("notices"))
    return rows.join(F.broadcast(table), "text_digest", "left").select("doc_id", "text_digest", "license_id", "notices")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's canonical digest, and the licence that it is or names."""
    return scan(common.text_sources(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    between = BETWEEN.replace(r" ", " ").replace(r"‐-‟", "‐-‟").replace(r"•", "•").replace(r"…", "…")

    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), {q(COPYRIGHT)}, '', 'g')"
        for given, same in SPELLINGS:
            out = f"replace({out}, {q(given)}, {q(same)})"
        return f"sha256(trim(regexp_replace({out}, {q(between)}, ' ', 'g')))"

    values = lambda rows: ", ".join(f"({q(digest_of(t))}, {q(n)})" for n, t in {digest_of(t): (n, t) for n, t in reversed(rows)}.values())
    return f"""WITH known(d, name) AS (VALUES {values(LICENCES)}), notes(d, name) AS (VALUES {values(NOTICES)}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
    found AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM lines JOIN notes ON {form('line')} = d
              WHERE regexp_matches(lower(line), 'licen[cs]e|licensed') GROUP BY r)
    SELECT doc_id, {form('text')} AS text_digest, known.name AS license_id, coalesce(found.notices, '') AS notices
    FROM docs LEFT JOIN known ON known.d = {form('text')} LEFT JOIN found ON found.r = docs.r"""
