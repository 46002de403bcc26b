"""License scans.

A text is brought into a canonical form (case, punctuation, copyright lines and
equivalent spellings removed) and the digest of its whole form is looked up, by
a hash join, among the digests of the known licences' forms. The same lookup is
made for each whole line. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, aside

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: (licence, whole text or notice). Each pair is one known text.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("ISC", _ISC + _ISC_END),
    ("ISC", "ISC License\n" + _ISC + _ISC_END),
    ("0BSD", _ISC.split(", provided")[0] + ".\n" + _ISC_END),
    ("0BSD", "BSD Zero Clause License\n" + _ISC.split(", provided")[0] + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD2 + _BSD3 + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL3),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Released under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
)
#: Spellings that count as one, applied to lower-cased words in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("noncommercial", "non commercial"),
    ("acknowledgement", "acknowledgment"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("organisation", "organization"),
    ("realise", "realize"), ("whilst", "while"), ("per cent", "percent"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("http", "https"), ("analyse", "analyze"), ("favour", "favor"),
)
#: A line whose first word is one of these is a copyright line.
_COPYRIGHT = r"(?md)^[\x20\t*#/;-]*(?:copyright[\x20\t]*(?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*$"
#: A line that names a holder after the word alone, or a place for the year; looked for where a text with such lines is not known as it is.
_HOLDER = r"(?md)^[\x20\t*#/;-]*(?:Copyright|COPYRIGHT):?[\x20\t]+(?:by[\x20\t]+)?(?!(?i:holders?|owners?|notices?|laws?|licen[cs]es?|statements?|terms?|protection|interests?|rights?)\b)[<\[{\p{Lu}][^\n]{0,100}$"
#: What the SQL counterpart asks of a line before it looks it up; `scan` looks up every line.
MARK = r"(?i)licen[cs]e"


#: (licence, digest) of whole texts that are too long to be written out here: as published, and up to the end of the terms.
FULL = (
    ("Apache-2.0", "769c7564f2af1e01d336559ded9f3ccc"),
    ("Apache-2.0", "dd62a2e03b5b94cddd1a8c2f4c29d452"),
    ("Apache-2.0", "9912651bdb8b98757189af7c36da6e85"),
    ("GPL-1.0", "9a6d41337fa0145d93e534071bfae3f8"),
    ("GPL-1.0", "78f3b35da3d393ee93ecfeb7d20907e6"),
    ("GPL-2.0", "8e4925da11f68cc625b11b0a628fdcc5"),
    ("GPL-2.0", "42f2f51f3e726d001525877e3528c3d0"),
    ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),
    ("AGPL-3.0", "c5066c040b5587299b104ff08c2ea9db"),
    ("AGPL-3.0", "29ef0b2e6f2f60075b8d5b36ee6d82e9"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "b7edc06df79bc44a04f12befb8111960"),
    ("MPL-2.0", "a27e119cd87d765a971af4667b2bf9b1"),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2", "c969fdb4b731dadf7173c1ffbe49a117"),
    ("GFDL-1.3", "eb6b86c0fad89753a5a36c484fa0ada2"),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, runs of anything but letters and digits as one space, SPELLINGS. Null stays null."""
    t = F.regexp_replace(ascii_lower(text), _COPYRIGHT, "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for other, one in SPELLINGS:
        t = F.replace(t, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """(_digest, _licence) of the known texts, FULL included where the list is KNOWN; as many rows as they have distinct forms. Of two licences with one form the first by name counts."""
    if not texts:
        return spark.createDataFrame([], "_digest string, _licence string")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in texts]))
    one = spark.range(1, numPartitions=1)
    found = one.select(rows.alias("r")).select(digest(F.col("r.t")).alias("_digest"), F.col("r.n").alias("n"))
    if texts is KNOWN:
        full = F.explode(F.array(*[F.struct(F.lit(d).alias("_digest"), F.lit(n).alias("n")) for n, d in FULL]))
        found = found.union(one.select(full.alias("r")).select("r._digest", "r.n"))
    return found.groupBy("_digest").agg(F.min("n").alias("_licence"))


def scan(docs: DataFrame, text_col: str = "text", texts=KNOWN) -> DataFrame:
    """Every row with `digest` (of its whole text), `licence` (whose text it is, else null) and `notices` (sorted distinct licences of its whole lines, comma-joined).

    The table of known texts is fixed, so it is broadcast; a text is looked up
    once, whatever its length, and texts are never grouped, so hot texts do no
    harm. A null text has null digest; null and empty texts match nothing. Very
    long texts are looked up whole; repeated rows get a row each, an empty table
    gives an empty result. Columns named digest, licence or notices are replaced,
    others pass through whatever their names.
    """
    spark = docs.sparkSession
    docs, back = aside(docs.drop("digest", "licence", "notices"), "_digest", "_licence")
    text_col = {old: new for new, old in back.items()}.get(text_col, text_col)
    table = F.broadcast(known(spark, texts))
    out = docs.withColumn("digest", digest(F.col(text_col))).join(table, F.col("digest") == F.col("_digest"), "left").withColumnRenamed("_licence", "licence").drop("_digest")
    forms = F.transform(F.filter(F.split(F.col(text_col), "\n"), lambda s: s != ""), lambda s: digest(s))
    pairs = {r["_digest"]: r["_licence"] for r in known(spark, texts).collect()}  # one row for each known text
    names = F.create_map(*[F.lit(x) for kv in sorted((pairs or {"": ""}).items()) for x in kv])
    found = F.array_sort(F.array_distinct(F.filter(F.transform(forms, lambda d: F.try_element_at(names, d)), lambda n: n.isNotNull())))
    bare = F.when(F.col("licence").isNull() & F.col(text_col).rlike(_HOLDER), digest(F.regexp_replace(F.col(text_col), _HOLDER, "")))
    out = out.withColumn("licence", F.coalesce("licence", F.try_element_at(names, bare)))
    return out.withColumn("notices", F.coalesce(F.array_join(found, ","), F.lit(""))).withColumnsRenamed(back)
