"""License scans by canonical digest lookup.

Texts are brought to a canonical form: copyright lines go, letters are lower case, punctuation is white space, and
equivalent spellings become one. Entire texts then meet the known licenses in a hash join on the SHA-256 of that form.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as equal, as whole words of a canonical text.
EQUAL = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"), ("unauthorised", "unauthorized"),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("http", "https"), ("while", "whilst"), ("wilful", "willful"), ("fulfil", "fulfill"),
)
#: What follows "copyright" in the body of a license, where a wrapped line may begin with it; other capitalised words are holders.
NOT_HOLDERS = (
    "act", "and", "claim", "claims", "disclaimer", "for", "grant", "holder", "holders", "in", "infringement", "interest", "interests", "is", "law", "laws", "licence", "license", "licensed", "licenses",
    "notice", "notices", "of", "on", "or", "owner", "owners", "patent", "protection", "right", "rights", "statement", "statements", "status", "to", "treaty",
)


def _other_word(words: set[str], first: bool = True) -> str:
    """A pattern of the words, capitalised ones if first, that are none of words; without lookahead, which SQL engines lack."""
    heads = {w[0] for w in words if w}
    rest = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in heads)
    letter = lambda c: f"(?-i:{c.upper()})" if first else c
    ways = [letter(f"[{rest}]") + "[a-z]*"] + [letter(h) + _other_word({w[1:] for w in words if w[:1] == h}, False) for h in sorted(heads)]
    return "(?:" + "|".join(ways + ([] if first or "" in words else [""])) + ")"


#: Lines of copyright with a sign, a year or a holder, and of rights reserved.
COPYRIGHT_LINE = (
    r"(?im)^[ \t#*/;<>!-]*(copyright[ \t:,]*(\(c\)|©|&copy;|[12][0-9]{3})|copyright[ \t:,]+(by[ \t]+)?(" + _other_word(set(NOT_HOLDERS)) + r"\b|[^\x00-\x7F])"
    r"|\(c\)[ \t]*(copyright|©|[12][0-9]{3})|\(c\)[ \t]+(?-i:[A-Z][a-z]+[ \t]+[A-Z])|©|all rights reserved)[^\n]*$"
)
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‘’“”«»–—•©]+"

_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE '
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MAY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n{}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n'
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
    "specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_NOT_NAMED = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We "
    "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    'software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
    '"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n'
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
    "works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE '
    "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
_WTFPL = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and "
    "changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."
)
_MIT_0 = _GRANT[: _GRANT.index(", subject to")] + ".\n\n" + _AS_IS
_NCSA = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.\n\n"
    "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.\n\n"
    "* Neither the names of the copyright holders, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE '
    "CONTRIBUTORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS WITH "
    "THE SOFTWARE."
)
_POSTGRES = (
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the "
    "following two paragraphs appear in all copies.\n\nIN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE "
    "USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\n\nTHE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED "
    'TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, '
    "ENHANCEMENTS, OR MODIFICATIONS."
)
_ADVERTISED = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors.\n\n"
    "4. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
)
#: Full texts, each a file named by its license.
_FULL = tuple((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
#: Known texts and the license that each stands for; a title line, where usual, is a text of its own.
KNOWN = (
    ("MIT", _GRANT + _AS_IS), ("MIT", "MIT License\n\n" + _GRANT + _AS_IS), ("MIT", "The MIT License (MIT)\n\n" + _GRANT + _AS_IS), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _MAY.format(", provided that the above copyright notice and this permission notice appear in all copies")), ("ISC", "ISC License\n\n" + _MAY.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _MAY.format("")), ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(_NOT_NAMED)), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD.format("")), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD.format(_NOT_NAMED)),
    *_FULL, ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE.replace("https://unlicense.org", "https://unlicense.org/")),
    ("Zlib", _ZLIB), ("BSL-1.0", _BOOST), ("WTFPL", _WTFPL), ("MIT-0", _MIT_0), ("MIT-0", "MIT No Attribution\n\n" + _MIT_0), ("NCSA", _NCSA), ("PostgreSQL", _POSTGRES),
    ("BSD-4-Clause", _BSD.format(_ADVERTISED)), ("BSD-1-Clause", _BSD.format("").replace("\n\n2. " + _BSD.split("2. ")[1].split("\n\n")[0], "")),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0-or-later", _GPL),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null text: empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(COPYRIGHT_LINE), F.lit(" "))
    out = F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # two spaces between words, so that each has its own on both sides and neighbours are spelt anew alike
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, F.lit(PUNCTUATION), F.lit("  "))), F.lit(" "))
    for spelling, same in EQUAL:
        out = F.replace(out, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, digest (SHA-256 of the canonical text, hex), license_id (null: none) and matched of every row of docs.

    docs has doc_id and text; other columns are not read. A text matches if the whole of it is a known license but for
    case, punctuation, white space, copyright lines and spelling. Null text is empty, which no license is; rows without
    doc_id and repeated rows are scanned like any other. Empty table: no rows."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, t) for k, t in known], "license_id string, text string")
    table = table.groupBy(digest(F.col("text")).alias("known_digest")).agg(F.min("license_id").alias("license_id"))
    scanned = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    # the known licenses are a constant of this module or an argument, not data
    found = scanned.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left")
    return found.select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("matched"))


def _sql_canonical(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(coalesce({text}, ''), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"translate({out}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || trim(regexp_replace({out}, {quote(PUNCTUATION)}, '  ', 'g'), ' ') || ' '"
    for spelling, same in EQUAL:
        out = f"replace({out}, {quote(f' {spelling} '.replace(' ', '  ')[1:-1])}, {quote(f' {same} '.replace(' ', '  ')[1:-1])})"
    return f"trim(replace({out}, '  ', ' '), ' ')"


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in known)
    return f"""
WITH known AS (
  SELECT sha256({_sql_canonical("text")}) AS known_digest, min(license_id) AS license_id
  FROM (VALUES {rows}) k(license_id, text) GROUP BY 1),
scanned AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents)
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS matched FROM scanned LEFT JOIN known ON digest = known_digest"""
