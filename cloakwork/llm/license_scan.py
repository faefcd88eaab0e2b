"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Texts and templates are lower-cased over A-Z and cut into words; a segment (a line, a paragraph of several lines, a text of
several paragraphs, a run of consecutive lines) matches a template if 2 * shared / (own + template's) distinct bigrams is
at least ``percent`` / 100.
A segment can only reach that if its number of bigrams lies within (percent / (200 - percent)) of the template's, so
segments outside the bounds of all templates are dropped before any bigram is formed, and a template is a candidate only
within its own bounds.

Before any segment is cut into words it must contain an anchor: words are chosen so that a segment without any of them lacks
too many bigrams of each template to reach the threshold. So the choice loses nothing, and most texts cost one search.

Runs of two or more lines find what is laid out otherwise than the segments: blank lines inside a licence, code or prose
directly around it. Of a template's runs that match, the best is taken (then the shortest, then the first), and again
among those that overlap none taken; a run that overlaps a line, paragraph or text that matches the same template counts as
found there. Runs are searched only in texts that hold enough of a template's bigrams. A line at either end that adds no
shared bigram never raises the coefficient, so a run starts at a line with one, and it is followed only until it has too
many bigrams; that loses nothing.

Shared bigrams of the other segments are counted by looking each bigram up in the broadcast bigrams of the templates (a fixed set whose size is
counted; more than ``most_bigrams`` are looked up in blocks, with the same result), so no segment is paired with a template with which it shares nothing. One scan; what is exchanged is a row for
each document and the counts of hits.

Defined results: null and empty texts and segments of fewer than two words match nothing; rows repeated in documents are
reported once for each repetition; equal scores go to the more specific level (line, paragraph, text, then run), then to
the template's name. A run's place is its first line. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.arrays import blocks, running_max, running_sum
from cloakwork.functions.arrays import let as _let
from cloakwork.functions.arrays import record as _record
from cloakwork.functions.spans import greedy
from cloakwork.llm.common import ascii_lower, text_key
from cloakwork.llm.decontaminate import WORD, words_of
from cloakwork.model import CANDIDATES

#: Wording of public licences and of common notices.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Reserved-line": "All rights reserved.",
    "SPDX-Apache-2.0-line": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-3-Clause-line": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-3.0-line": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-MIT-line": "SPDX-License-Identifier: MIT",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

LEVELS = ["line", "paragraph", "text", "run"]
MOST_BIGRAMS = 500_000
PARAGRAPHS = r"\n[ \t]*\n[ \t\n\f\r]*"


def _bigrams(words: Column) -> Column:
    """Distinct hashes of neighbouring words; empty for fewer than two words."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(pairs)


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """name, size, bigram: one row for each distinct bigram of each template."""
    rows = spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "name string, text string")
    return rows.select("name", _bigrams(words_of(F.col("text"))).alias("b")).select("name", F.size("b").alias("size"), F.explode("b").alias("bigram"))


def _positions(body: Column) -> Column:
    """All pairs of neighbouring words in order: first's word index in the text's pairs, of its line; hash; lines and paragraphs of both words; line of the last equal pair before."""
    newlines = lambda c: F.size(F.split(c, "\n", -1)) - 1
    steps = F.zip_with(F.split(body, PARAGRAPHS, -1), F.regexp_extract_all(body, F.lit(PARAGRAPHS), F.lit(0)), lambda p, gap: _record(part=p, n=newlines(p) + newlines(F.coalesce(gap, F.lit("")))))

    def words(steps: Column) -> Column:
        bases = F.concat(F.array(F.lit(0)), running_sum(F.transform(steps, lambda x: x["n"])))
        of_line = lambda line, place, p: F.transform(words_of(line), lambda w, i: _record(w=w, line=place, p=p, i=i))
        return _let(bases, lambda at: F.flatten(F.transform(steps, lambda x, p: F.flatten(F.transform(F.split(x["part"], "\n", -1), lambda line, i: of_line(line, F.get(at, p) + i, p))))))

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        each = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: _record(h=F.xxhash64(x["w"], y["w"]), a=x["line"], b=y["line"], pa=x["p"], pb=y["p"], i=x["i"]))
        return F.transform(each, lambda x, k: _record(h=x["h"], k=k, line_k=k - x["i"], **{c: x[c] for c in ("a", "b", "pa", "pb")}))

    def linked(s: Column) -> Column:
        before = lambda x, j: F.when(F.get(s, j - 1)["h"] == x["h"], F.get(s, j - 1)["a"]).otherwise(-1)
        return F.transform(s, lambda x, j: _record(**{c: x[c] for c in ("k", "line_k", "h", "a", "b", "pa", "pb")}, last=before(x, j)))

    return F.sort_array(_let(F.sort_array(_let(_let(steps, words), pairs)), linked))


RUN = "array<struct<name:string,dice:double,start:int,end:int,pa:int,pb:int>>"


def _runs(body: Column, known: list, percent: int) -> Column:
    """Runs of two or more lines that match, with their paragraphs; known has (name, size, bigrams). A run's last line may be one that adds nothing."""
    # One string each, which is folded to one literal.
    longs = lambda b: F.split(F.lit(",".join(map(str, b))), ",").cast("array<bigint>")
    need, most = lambda size: -(-size * percent // (200 - percent)), lambda size: size * (200 - percent) // percent
    templates = F.array(*[_record(name=F.lit(name), size=F.lit(size), need=F.lit(need(size)), most=F.lit(most(size)), b=longs(b)) for name, size, b in known])
    every = longs(sorted({x for _, _, b in known for x in b}))
    none = F.array().cast(RUN)

    def of_start(t: Column, marked: Column, index: Column, s: Column) -> Column:
        fresh = lambda v: F.filter(v, lambda x: x["last"] < s["a"])
        near = fresh(F.slice(marked, s["line_k"] + 1, (t["most"] + 1) * 4))

        def further() -> Column:
            """From the blocks that have a pair not seen since the start; each gives at least one, so most + 1 of them are enough."""
            block = F.floor(s["line_k"] / F.size(F.get(index, 0)["v"])).cast("int")
            own = F.filter(F.get(index, block)["v"], lambda x: (x["k"] >= s["line_k"]) & (x["last"] < s["a"]))
            later = F.slice(F.filter(F.slice(index, block + 2, F.size(index)), lambda b: b["low"] < s["a"]), F.lit(1), t["most"] + 1)
            return F.concat(own, F.flatten(F.transform(later, lambda b: fresh(b["v"]))))

        # Few pairs of a text are repeated, so a short stretch mostly has enough, or reaches the end.
        enough = lambda x: (F.size(x) > t["most"]) | (s["line_k"] + (t["most"] + 1) * 4 >= F.size(marked))
        own = F.slice(_let(near, lambda x: F.when(enough(x), x).otherwise(further())), F.lit(1), t["most"] + 1)
        ended = lambda o: F.zip_with(o, F.slice(o, F.lit(2), t["most"] + 1), lambda x, y: _record(b=x["b"], pb=x["pb"], hit=x["hit"], ends=F.coalesce(y["b"] != x["b"], F.lit(True))))

        def step(acc: Column, x: Column) -> Column:
            own, shared = acc["own"] + 1, acc["shared"] + x["hit"].cast("int")
            good = x["ends"] & (x["b"] > s["a"]) & (shared * 200 >= (own + t["size"]) * percent)
            dice = F.round(shared * 2 / (own + t["size"]), 6)
            run = _record(name=t["name"], dice=dice, start=s["a"], end=x["b"], pa=s["pa"], pb=x["pb"])
            return _record(own=own, shared=shared, out=F.when(good, F.concat(acc["out"], F.array(run).cast(RUN))).otherwise(acc["out"]))

        return F.aggregate(_let(own, ended), _record(own=F.lit(0), shared=F.lit(0), out=none), step, lambda acc: acc["out"])

    def of_template(t: Column, positions: Column) -> Column:
        marked = F.transform(positions, lambda x: _record(**{c: x[c] for c in ("k", "line_k", "a", "b", "pa", "pb", "last")}, hit=F.array_contains(t["b"], x["h"])))
        hits = lambda m: F.transform(F.filter(m, lambda x: x["hit"]), lambda x: _record(a=x["a"], line_k=x["line_k"], pa=x["pa"]))
        starts = lambda m: _let(hits(m), lambda h: F.filter(h, lambda x, i: (i == 0) | (F.get(h, i - 1)["a"] != x["a"])))
        index = lambda m: F.transform(blocks(m), lambda v: _record(low=F.array_min(F.transform(v, lambda x: x["last"])), v=v))
        return _let(marked, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(index(m), lambda b: F.flatten(F.transform(starts(m), lambda s: of_start(t, m, b, s))))))

    if not known:
        return none
    common = F.array_intersect(_let(words_of(body), _bigrams), every)
    likely = _let(common, lambda c: F.filter(templates, lambda t: F.size(F.array_intersect(c, t["b"])) >= t["need"]))
    found = lambda ts: _let(_positions(body), lambda p: F.flatten(F.transform(ts, lambda t: of_template(t, p))))
    return _let(likely, lambda ts: F.when(F.size(ts) > 0, found(ts)).otherwise(none))


def _without(runs: Column, matches: Column, level: int, first: str, last: str) -> Column:
    """The runs in whose [first, last] no match of the level and their template has its place.

    Places and runs are put in one order, runs by where they end; the last place before tells.
    """
    run = "struct<name:string,dice:double,start:int,end:int,pa:int,pb:int>"
    places = F.transform(F.filter(matches, lambda m: m["level"] == level), lambda m: _record(name=m["template"], at=m["place"], run=F.lit(None).cast(run)))
    asked = F.transform(runs, lambda r: _record(name=r["name"], at=r[last], run=r))

    def free(both: Column) -> Column:
        before = running_max(F.transform(both, lambda x: F.when(x["run"].isNull(), _record(name=x["name"], at=x["at"]))))
        inside = lambda x, seen: F.coalesce((seen["name"] == x["name"]) & (seen["at"] >= x["run"][first]), F.lit(False))
        return F.filter(F.zip_with(both, before, lambda x, seen: F.when(~inside(x, seen), x["run"])), lambda r: r.isNotNull())

    return _let(places, lambda at: F.when(F.size(at) == 0, runs).otherwise(_let(F.sort_array(F.concat(at, asked)), free)))


def _chosen(found: DataFrame) -> DataFrame:
    """``runs`` become those to report beside the matches ``m`` of the other segments, as matches.

    Step by step, since expressions nested deeper than a hundred levels aren't analysed.
    """
    some = lambda df, value: df.withColumn("runs", F.when(F.size("runs") > 0, value))
    texts = F.transform(F.filter("m", lambda m: m["level"] == 2), lambda m: m["template"])
    beside = some(found, _let(texts, lambda t: F.filter("runs", lambda r: ~F.array_contains(t, r["name"]))))
    beside = some(beside, _without(F.col("runs"), F.col("m"), 0, "start", "end"))
    beside = some(beside, _without(F.col("runs"), F.col("m"), 1, "pa", "pb"))
    ordered = some(beside, F.sort_array(F.transform("runs", lambda r: _record(order=-r["dice"], n=r["end"] - r["start"], start=r["start"], end=r["end"], name=r["name"], dice=r["dice"]))))
    candidates = F.transform("runs", lambda r, i: _record(start=r["start"], end=r["end"] + 1, value=F.lit(""), entity_type=r["name"], ord=i)).cast(CANDIDATES)
    each = F.transform(F.array_distinct(F.transform("runs", lambda r: r["name"])), lambda name: F.filter("__cand", lambda c: c["entity_type"] == name))
    parted = ordered.withColumn("__cand", F.when(F.size("runs") > 0, candidates)).withColumn("__cand", F.when(F.size("runs") > 0, each))
    taken = some(parted, F.transform(F.flatten(F.transform("__cand", lambda v: greedy(v, "priority"))), lambda c: F.get("runs", c["ord"]))).drop("__cand")
    return some(taken, F.transform("runs", lambda r: _record(order=r["order"], level=F.lit(3), template=r["name"], place=r["start"], dice=r["dice"])))


#: Longer anchors are looked for inside words too, which is faster; shorter ones only as words.
SHORT = 3
#: Words that are no good anchors.
COMMON = "a all an and any are as at be by for from if in is it may not of on or that the this to with you".split()


def anchors(templates: dict[str, str], percent: int) -> list[str]:
    """Words of which every segment that reaches the threshold with some template has at least one.

    A match shares at least size * percent / (200 - percent) of a template's bigrams, so it can't avoid all of any larger
    rest; words are taken, those that cover most first, until the bigrams they are in are more than that rest.
    """
    chosen: list[str] = []
    for _, text in sorted(templates.items()):
        lowered = "".join(c.lower() if c.isascii() else c for c in text)
        words = re.findall(WORD, lowered)
        pairs = set(zip(words, words[1:]))
        if not pairs:
            continue
        rest = len(pairs) - -(-len(pairs) * percent // (200 - percent))
        within = lambda p: any(c in w if len(c) > SHORT else c == w for c in chosen for w in p)
        covered = {p for p in pairs if within(p)}
        while len(covered) <= rest:
            gain = {w: sum(w in p for p in pairs - covered) for w in words}
            best = max(sorted(gain), key=lambda w: gain[w] * (0.01 if w in COMMON else len(w)))
            chosen.append(best)
            covered = {p for p in pairs if within(p)}
    return chosen


def _blocks(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Names of templates in blocks of at most ``most`` bigrams, or of one template; at least one block."""
    out, left = [[]], most
    for name, size in sorted(sizes.items()):
        if size > left and out[-1]:
            out.append([])
            left = most
        out[-1].append(name)
        left -= size
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", doc_id: str = "doc_id", percent: int = 80, most_bigrams: int = MOST_BIGRAMS) -> DataFrame:
    """One row per row of docs: doc_id, matches (array of template, dice, level, place; best first)."""
    spark = docs.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates)
    low, high = known.agg(F.min("size"), F.max("size")).first()
    by_name = [(r["name"], r["size"], r["b"]) for r in known.groupBy("name", "size").agg(F.collect_set("bigram").alias("b")).orderBy("name").collect()]
    low, high = (low or 1) * percent / (200 - percent), (high or 0) * (200 - percent) / percent
    body = F.coalesce(F.col(text), F.lit(""))
    # Places are counted in the text as it is; lower case has the same lines.
    lines, paragraphs = F.split(F.col("body"), "\n", -1), F.split(F.col("body"), PARAGRAPHS, -1)
    segment = "array<struct<level:int,place:int,body:string>>"
    numbered = lambda parts, level: F.transform(parts, lambda x, i: F.struct(F.lit(level).alias("level"), i.alias("place"), x.alias("body"))).cast(segment)
    # A bigram has at least three characters and a blank, so sizes in characters bound sizes in bigrams from above.
    needed = anchors(TEMPLATES if templates is None else templates, percent)
    lowered = ascii_lower(body)

    def anchored(c: Column) -> Column:
        found = F.lit(False)
        for w in (w for w in needed if len(w) > SHORT):
            found = found | F.contains(c, F.lit(w))
        if short := [w for w in needed if len(w) <= SHORT]:
            edge = r"[0-9a-z\x{80}-\x{10FFFF}]"
            found = found | c.rlike(f"(?<!{edge})(?:{'|'.join(short)})(?!{edge})")
        return found

    plausible = lambda parts: F.filter(parts, lambda s: (F.length(s["body"]) >= 2 * low + 1) & anchored(s["body"]))
    none = F.array().cast(segment)
    segments = F.concat(
        F.array(F.struct(F.lit(-1).alias("level"), F.lit(-1).alias("place"), F.lit("").alias("body"))).cast(segment),
        F.when(F.col("any"), plausible(numbered(lines, 0))).otherwise(none),
        F.when(F.col("any"), plausible(F.filter(numbered(paragraphs, 1), lambda s: F.contains(s["body"], F.lit("\n"))))).otherwise(none),
        F.when(F.col("any") & F.col("body").rlike(PARAGRAPHS), numbered(F.array(F.col("body")), 2)).otherwise(none),
    )
    searched = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("__key"), lowered.alias("body"))
    searched = searched.select("*", anchored(F.col("body")).alias("any"))
    runs = F.when(F.col("any") & F.contains("body", F.lit("\n")), _runs(F.col("body"), by_name, percent))
    cut = searched.select("doc_id", "__key", runs.alias("runs"), F.explode(segments).alias("s"))
    worded = cut.select("doc_id", "__key", F.when(F.col("s.level") == -1, F.col("runs")).alias("runs"), "s.level", "s.place", words_of(F.col("s.body")).alias("w"))
    sized = worded.select("doc_id", "__key", "runs", "level", "place", _bigrams(F.col("w")).alias("b"))
    # The bounds stand inside the generator: a filter would be pushed below and cut the words again.
    within = F.when(F.col("level") == -1, F.array(F.lit(0).cast("bigint"))).when(F.size("b").between(low, high), F.col("b"))
    each = sized.select("doc_id", "__key", "runs", "level", "place", F.size("b").alias("own"), F.explode(within).alias("bigram"))
    bounded = (F.col("own") * (200 - percent) >= F.col("size") * percent) & (F.col("size") * (200 - percent) >= F.col("own") * percent)
    hit = None
    for i, names in enumerate(_blocks({name: size for name, size, _ in by_name}, most_bigrams)):
        side = known.where(F.col("name").isin(names)).select(F.col("bigram").alias("tb"), "name", "size")
        one = each if i == 0 else each.where("level >= 0")  # a document's own row comes once
        one = one.join(F.broadcast(side), (F.col("bigram") == F.col("tb")) & (F.col("level") >= 0) & bounded, "left").where((F.col("level") == -1) | F.col("name").isNotNull())
        hit = one if hit is None else hit.unionByName(one)
    # A document's rows come from one task, so partial aggregation does nearly all of the work. Sets hold at most a
    # template's bigrams, and make repeated rows count once.
    counted = hit.groupBy("doc_id", "__key", "level", "place", "own", "name", "size").agg(F.count("*").alias("rows"), F.size(F.collect_set("bigram")).alias("shared"), F.first("runs", ignorenulls=True).alias("runs"))
    found = (F.col("level") >= 0) & (F.col("shared") * 200 >= (F.col("own") + F.col("size")) * percent)
    dice = F.round(F.col("shared") * 2 / (F.col("own") + F.col("size")), 6)
    one = counted.groupBy("doc_id", "__key").agg(
        F.sum(F.when(F.col("level") == -1, F.col("rows")).otherwise(0)).alias("copies"),
        F.collect_set(F.when(found, F.struct((-dice).alias("order"), "level", F.col("name").alias("template"), "place", dice.alias("dice")))).alias("m"),
        F.first("runs", ignorenulls=True).alias("runs"),
    )
    every = F.when(F.size("runs") > 0, F.concat("m", "runs")).otherwise(F.col("m"))
    out = _chosen(one).select("doc_id", "copies", F.array_sort(every).alias("matches"))
    return out.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"), "matches").drop("__copy")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, license (best template), dice, n_matches and matches (template:level:place, best first)."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    best = F.get("matches", 0)
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["template"], F.get(names, m["level"]), m["place"].cast("string"))), ",")
    return scanned.select("doc_id", best["template"].alias("license"), best["dice"].alias("dice"), F.size("matches").cast("bigint").alias("n_matches"), listed.alias("matches"))
