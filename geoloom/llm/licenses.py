"""Operator 3: licence texts by canonical digest, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
    "an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
    "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
    "source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
    "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
    "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
    "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
    'processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
    "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)
#: Public licence texts and one-line notices, as (identifier, text).
KNOWN = [
    ("MIT", "MIT License\nCopyright (c) <year> <holder>\n" + _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT", _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT-0", "MIT No Attribution\nCopyright <year> <holder>\n" + _MIT_GRANT + ". " + _WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\nCopyright (c) <year>, <holder>\n" + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\nCopyright (c) <year>, <holder>\n" + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("ISC", "ISC License\nCopyright (c) <year> <holder>\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", "Zero-Clause BSD\n" + _ISC_GRANT + ". " + _ISC_TAIL),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
#: Equivalent spellings, as (pattern, replacement), applied in this order to lower-case words.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("sub licensed?", "sublicense"), ("https", "http"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("v ([0-9])", "version $1"), ("copyright owner", "copyright holder"), ("while", "whilst"), ("per cent", "percent"),
]
#: Digests of the canonical form of long public licence texts, whole and without what follows their terms.
DIGESTS = [
    ("Apache-2.0", "6a1f09caf01d65bc2eaa25d854370727"),
    ("Apache-2.0", "fb673350de4110089e1d8b9ff2cc0512"),
    ("Apache-2.0", "188ed10006586d2e05be23eba7459733"),
    ("Artistic-1.0-Perl", "0613963bdb69735cec2c53962deebf27"),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2", "0f3d5a7ed94c8559c9b55e2e3ce5961f"),
    ("GFDL-1.3", "2f442789be137a7ec4a46e377f4502ac"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-1.0", "21fa8693acc5194a648fe02e11f65a72"),
    ("GPL-1.0", "dbf3c47f5a8f127e58d08cabc1ebb916"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-2.0", "f2c06efe640b4a281cbe5337cdde80ab"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-3.0", "b79359b5e391fd47146ff34ae3db7ec0"),
    ("GPL-3.0", "17e434cc6db7003444b088cb4cc81e91"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),
    ("LGPL-2.0", "583f5e49dfd6aaf1f892858ff2692f3b"),
    ("LGPL-2.0", "e88c95e37d976c0ab32e2c1e580acdb6"),
    ("LGPL-2.0", "f66ba6fa07c35f474f2a404b21822d03"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "4ed6600fcf5321eb9dcd2181cde18632"),
    ("MPL-2.0", "bba58d76f66dd9d890110b970536045e"),
]
#: A copyright line has a mark, a year or a place for one, as wrapped licence texts have lines that begin with the word.
_YEAR = "[<\\[{(]?(?:[0-9]{4}|year|yyyy)"
COPYRIGHT_LINE = (
    f"(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright[ \\t]*(?:\\(c\\)|©|{_YEAR})|(?:\\(c\\)|©)[ \\t]*(?:copyright|{_YEAR})"
    "|all rights reserved[^\\p{L}\\p{N}\\n]*$)[^\\n]*$"
)
#: Lines without any of these stems can't be known ones, so their digests aren't needed.
STEM = "licen[cs]e|permission|redistribution|copyright|warranty|public domain"
if lost := [i for i, t in KNOWN if not re.search(STEM, t.lower())]:
    raise ValueError(f"texts without a stem: {lost}")


def canonical(text: Column) -> Column:
    """Lower case, copyright lines dropped, all but letters and digits as single spaces, equivalent spellings unified."""
    found = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    # two spaces between words, so that every word has its own on either side
    found = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(found, "[^\\p{L}\\p{N}]+", " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for pattern, word in SPELLINGS:
        old, new = (f" {x.replace(' ', '  ')} " for x in (pattern, word))
        found = F.regexp_replace(found, old, new) if set(pattern) & set("?([") else F.replace(found, F.lit(old), F.lit(new))
    return F.trim(F.replace(found, F.lit("  "), F.lit(" ")))


def known_digests(spark, more: list[tuple[str, str]] = ()) -> DataFrame:
    """``(_digest, license)`` of the fixed list and of ``more`` ``(identifier, text)``; distinct."""
    table = spark.createDataFrame([(t, i) for i, t in [*KNOWN, *more]], "text string, license string")
    fixed = spark.createDataFrame([(d, i) for i, d in DIGESTS], "_digest string, license string")
    return table.select(F.md5(canonical(F.col("text"))).alias("_digest"), "license").unionByName(fixed).distinct()


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: list[tuple[str, str]] = ()) -> DataFrame:
    """``docs`` -> ``(id, text_digest, license, line_licenses)``.

    ``license`` is the licence whose canonical digest the entire text has, else null; ``line_licenses`` lists, in
    order, the licences of which an entire line has the digest (texts that are a notice inside a document).  The
    known digests are a fixed list, which ``more`` pairs of identifier and text extend (texts whose lines are to be found
    must hold one of the words in ``STEM``), so the join is a broadcast hash join and nothing is shuffled, however hot a
    text is; the lines of a row stay in its row.  Null and empty texts have the digest of the empty text and
    no licence; repeated and null ids keep their rows; an empty table stays empty; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    known = known_digests(spark, more)
    pairs = [F.lit(x) for r in known.orderBy("_digest").collect() for x in (r["_digest"], r["license"])]  # the fixed list
    table = F.create_map(*pairs)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda l: F.rlike(F.lower(l), F.lit(STEM)))
    rows = docs.select(F.col(id_col), F.md5(canonical(text)).alias("_digest"), F.transform(lines, lambda l: F.md5(canonical(l))).alias("_lines"))
    joined = rows.join(F.broadcast(known), "_digest", "left")
    hits = F.array_sort(F.array_distinct(F.filter(F.transform("_lines", lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())))
    return joined.select(id_col, F.col("_digest").alias("text_digest"), "license", hits.alias("line_licenses"))
