"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a document are hashed and joined with the k-grams of the license templates: pairs for the
contract's short phrases, four words for notices and full license texts. A gram at word i of the document and word j of a
template votes for the diagonal i - j, where the template would start. Votes are counted for each (document, template,
diagonal); neighbouring diagonals, up to ``slack`` words apart, merge into one span, so that inserted or missing words do
not break a match. A span is verified by the words that its grams cover: a phrase needs all of them in their places, other
templates the share ``least``, on a span about as long as the template. Equal hashes are checked word by word in the join.

The templates are a parameter; their grams are broadcast because their number is fixed by it (some two thousand), whatever
the corpus. Grams whose hash is no template's are dropped before the rows of a document are multiplied.

A null text counts as empty and gets no label; repeated rows get equal results; an empty table gives an empty one;
other columns are dropped. Rows are keyed by doc_id and text while votes are counted, so that equal rows vote once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases and their labels, as the contract has them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of common public license texts and notices.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "this software is released under the terms of the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Public license texts, whole but for titles and names of holders.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def template_grams(phrases: dict[str, str], notices: list[tuple[str, str]], k: int) -> list[tuple]:
    """(template, label, whether all words must match, its words, words in a gram, place of the gram, gram) of all rolling grams."""
    rows = []
    for number, (label, text, exact) in enumerate([(label, text, True) for text, label in phrases.items()] + [(*n, False) for n in notices]):
        words = re.findall("[a-z0-9]+", text.lower())
        size = 2 if exact else k
        rows += [(number, label, exact, len(words), size, j, " ".join(words[j : j + size])) for j in range(len(words) - size + 1)]
    return rows


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES + TEXTS, slack: int = 2, least: float = 0.8, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the verified spans of every document.

    score is the greatest share of a template's words found in one span; spans holds label, start, end (words from 0).
    Phrases need two words, notices ``k``.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("_text"), words_of(F.col("text")).alias("_words"))
    template = spark.createDataFrame(template_grams(phrases, notices, k), "tid int, label string, exact boolean, t_words int, size int, j int, gram string")
    template = template.withColumn("h", F.xxhash64(*(F.get(F.split("gram", " "), i) for i in range(k))))
    known = [r["h"] for r in template.select("h").distinct().collect()]  # bounded by the templates
    word = lambda i, n: F.get("_words", i + n)
    rolled = F.transform(F.sequence(F.lit(0), F.size("_words") - 2), lambda i: F.struct(i.alias("i"), *(F.xxhash64(*(word(i, n) for n in range(size)), *[F.lit(None).cast("string")] * (k - size)).alias(f"h{size}") for size in (2, k))))
    found = F.filter(rolled, lambda g: g["h2"].isin(known) | g[f"h{k}"].isin(known))
    grams = own.filter(F.size("_words") > 1).select("doc_id", "_text", "_words", F.explode(found).alias("g"))
    grams = grams.select("doc_id", "_text", "_words", F.col("g.i").alias("i"), F.explode(F.array("g.h2", f"g.h{k}")).alias("h"))
    same = F.array_join(F.slice("_words", F.col("i") + 1, F.col("size")), " ") == F.col("gram")
    votes = grams.join(F.broadcast(template), "h").filter(same).drop("_words")
    key = ["doc_id", "_text", "tid", "label", "exact", "t_words", "size"]
    votes = votes.select(*key, "j", "i", (F.col("i") - F.col("j")).alias("diagonal"))
    lines = votes.groupBy(*key, "diagonal").agg(F.collect_set("j").alias("js"), F.min("i").alias("from"), F.max("i").alias("to"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    starts = F.when(apart.isNull() | (apart > F.when(F.col("exact"), 0).otherwise(slack)), 1).otherwise(0)
    spans = (
        lines.withColumn("starts", starts)
        .withColumn("span", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.min("from").alias("start"), (F.max("to") + F.col("size")).alias("end"), F.min("diagonal").alias("place"))
        .withColumn("share", F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("size") - 1))))) / F.col("t_words"))
    )
    length = F.col("end") - F.col("start")
    good = F.when(F.col("exact"), F.size("js") == F.col("t_words") - 1).otherwise((F.col("share") >= least) & (length <= 1.25 * F.col("t_words") + slack))
    base, label = good & F.col("exact"), F.when(good, F.col("label"))
    found = spans.groupBy("doc_id", "_text").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("place"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("place"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.max(F.when(length <= 1.25 * F.col("t_words") + slack, F.col("share"))).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("start", "end", "label")))).alias("spans"),
    )
    rows = own.select("doc_id", "_text", F.size("_words").cast("long").alias("n_words"))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r._text") == F.col("f._text")), "left")
    return joined.select(
        "r.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )


#: The base part as DuckDB SQL: places of the phrases, word by word.
BASE_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents
), p as (select * from (values (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) as p(phrase, label)
), hits as (
  select doc_id, label, i - 1 as place from d, p, lateral (select unnest(range(1, len(w) - len(phrase) + 2)) as i) where w[i : i + len(phrase) - 1] = phrase
), g as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from hits group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels from d left join g using (doc_id)
"""
