"""Licence scans: texts in canonical form, digested and joined with the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, as published.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_0 = _GRANT.replace(
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.", "."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not "
    "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not "
    "be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_BSL = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization "
    'obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including "
    "the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
    "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    'generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    'under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
LICENCES = {
    "MIT": "MIT License\nCopyright (c) <year> <copyright holders>\n" + _GRANT,
    "ISC": "ISC License\nCopyright (c) <year> <owner>\nPermission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC,
    "0BSD": "Copyright (c) <year> <owner>\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted. " + _ISC,
    "BSD-2-Clause": "BSD 2-Clause License\nCopyright (c) <year>, <owner>\n" + _BSD + _BSD_END,
    "BSD-3-Clause": "BSD 3-Clause License\nCopyright (c) <year>, <owner>\n" + _BSD + _NAMES + _BSD_END,
    "MIT-0": "MIT No Attribution\nCopyright <year> <owner>\n" + _MIT_0,
    "Zlib": "zlib License\nCopyright (c) <year> <owner>\n" + _ZLIB,
    "BSL-1.0": _BSL,
    "Unlicense": _UNLICENSE,
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
}
#: Spellings that count as the same, as regular expressions on lower-case text, in the order of use.
SPELLINGS = [
    ("licence", "license"), ("sub[ -]license", "sublicense"), ("non[ -]infringement", "noninfringement"), ("organisation", "organization"),
    ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("https://", "http://"), ("copyright owner", "copyright holder"),
]
#: Lines that begin like this (after marks of a comment) name an owner and are left out.
COPYRIGHT_LINE = r"(^|\n)[^0-9a-z\n©]*(copyright|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, and one space for all that is neither letter nor digit."""
    out = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r"), F.lit("\n")), COPYRIGHT_LINE, "\n")
    for pattern, same in SPELLINGS:
        out = F.regexp_replace(out, pattern, same)
    return F.trim(F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def known(spark: SparkSession) -> DataFrame:
    """The licence list as a table: ``licence``, ``text``."""
    rows = [*LICENCES.items(), *((name, text) for name, texts in NOTICES.items() for text in texts)]
    return spark.createDataFrame(rows, "licence string, text string")


def digests(licences: DataFrame) -> DataFrame:
    """``digest``, ``licence``: one row per digest; of licences with the same canonical text the first name counts."""
    form = licences.select("licence", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest`` of each whole text in canonical form, the ``licence`` it is, and the ``notices`` that are lines of it.

    Every whole text and every whole line is looked up, nothing is matched in part; equal lines of a text are digested
    once. Null counts as empty; texts and lines that are empty in canonical form match nothing.
    ``notices`` holds distinct names in order, joined by commas (empty if none). Texts are not shuffled.
    """
    ours = digests(licences)
    form = canonical(F.col(text_col))
    lines = F.array_distinct(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    found = docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.when(form != "", F.sha2(form, 256)).alias("digest"),
        F.transform(lines, lambda x: F.sha2(canonical(x), 256)).alias("_lines"),
    )
    whole = found.join(ours, "digest", "left")
    line = found.select("_row", F.explode("_lines").alias("digest")).join(ours, "digest").groupBy("_row").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")
    )
    return whole.join(line, "_row", "left").select(F.col("_id").alias(id_col), "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))
