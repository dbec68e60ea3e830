"""Licence scans: normalised text against licence templates by the Dice
coefficient of their word bigrams. DataFrame functions only.

The segments of a text are its lines, its paragraphs (between blank lines) and
the whole. Normalising lower-cases A-Z and turns every run of other characters
than a-z and 0-9 into one space. A segment with n distinct bigrams can reach a
coefficient t with a template of m only if m * t / (2 - t) <= n <= m * (2 - t) / t;
these bounds prune the templates. By the same bound a match holds most of its
template's bigrams: one pass over all texts joins their pairs of words with the
templates (broadcast: this module's list or the caller's, of bounded size), and
only texts with enough of them are split into segments, whose bigrams are counted.

A notice inside a longer line, or wrapped over lines among others, is no segment.
The stretches of the text that begin and end with a pair of a template and are
within its bounds are windows; of those that overlap, the one with the most pairs
in common less those that either side lacks counts, unless a segment tells the
same. A pair that the template lacks counts at each of its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.llm.common import cut, small

DICE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Short public licence notices.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _gnu(name: str, what: str, versions: str) -> str:
    return f"This {what} is free software{':' if '3' in versions else ';'} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{',' if '3' in versions else ';'} either {versions} of the License, or (at your option) any later version."


_BSD_LEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Standard headers and paragraphs of licence texts; what follows the slash tells those of one licence apart.
STANDARD = {
    "AGPL-3.0/header": _gnu("Affero General Public License", "program", "version 3"),
    "AGPL-3.0/preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "Apache-2.0/conditions": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/grant": "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "BSD-2-Clause/conditions": f"{_BSD_LEAD} 1. {_BSD_1} 2. {_BSD_2}",
    "BSD-3-Clause/conditions": f"{_BSD_LEAD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3}",
    "BSD-3-Clause/endorsement": _BSD_3,
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "GPL-2.0/only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0/preamble": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "GPL-3.0/header": _gnu("General Public License", "program", "version 3"),
    "GPL-3.0/preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "ISC/disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.0/header": _gnu("Library General Public License", "library", "version 2"),
    "LGPL-3.0/header": _gnu("Lesser General Public License", "library", "version 3"),
    "LGPL-3.0/text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT/disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib/grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
STANDARD |= {f"CC-{k}-4.0/notice": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC.items() if k != "BY"}
STANDARD |= {f"CC-{k}-4.0/short": f"Licensed under CC {k} 4.0." for k in _CC if k not in ("BY-NC", "BY-SA")}
STANDARD |= {f"CC-{k}-3.0/notice": f"This work is licensed under a Creative Commons {v} 3.0 Unported License." for k, v in _CC.items()}


def all_bigrams(text: Column) -> Column:
    """The pairs of neighbouring words of the normalised text, in order."""
    words = F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(text: Column) -> Column:
    return F.array_distinct(all_bigrams(text))


def possible(docs: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """doc_id, text (64-bit hash of it) of the texts (doc_id, body) that hold at
    least m * t / (2 - t) distinct bigrams of some template; no other text can
    hold a match. One pass: pairs of words meet the broadcast templates, and what
    is left is counted."""
    words = docs.select("doc_id", F.xxhash64("body").alias("text"), F.array_remove(F.split("body", "[^A-Za-z0-9]+"), "").alias("w"))
    pairs = words.select("doc_id", "text", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p"))
    rows = pairs.select("doc_id", "text", F.lower(F.concat("p.a", F.lit(" "), "p.b")).alias("bigram"))
    hits = rows.join(F.broadcast(known.select("license", "m", "bigram")), "bigram").groupBy("doc_id", "text", "license", "m").agg(F.size(F.collect_set("bigram")).alias("shared"))
    return hits.where(F.col("shared") * (2 - t) >= F.col("m") * t - 1e-9).select("doc_id", "text").distinct()


def templates(spark: SparkSession, given: dict[str, str]) -> DataFrame:
    """license, m (distinct bigrams), size (all of them), bigram."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in sorted(given.items())])
    one = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", all_bigrams(F.col("t.body")).alias("all")).withColumn("b", F.array_distinct("all"))
    return one.select("license", F.size("b").alias("m"), F.size("all").alias("size"), F.explode("b").alias("bigram"))


def windows(likely: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """doc_id, license, dice, pairs (sorted) of the best windows of the texts."""
    rows = likely.select("doc_id", F.xxhash64("body").alias("text"), F.posexplode(all_bigrams(F.col("body"))).alias("pos", "bigram"))
    hits = rows.join(F.broadcast(known), "bigram").withColumn("reach", F.ceil(F.col("size") * (2 - t) / t).cast("int"))
    # A window that starts in a block ends in it or the next.
    block = F.floor(F.col("pos") / F.col("reach"))
    place = ["doc_id", "text", "license", "m", "reach", "block"]
    dealt = hits.withColumn("block", F.explode(F.array(block, block - 1)))
    blocks = dealt.groupBy(*place).agg(F.sort_array(F.collect_set(F.struct("pos", "bigram"))).alias("hits"))
    blocks = blocks.where(F.size(F.array_distinct("hits.bigram")) * (2 - t) >= F.col("m") * t - 1e-9)
    last = lambda h: F.coalesce(F.array_max(F.transform(F.filter("hits", lambda g: (g["bigram"] == h["bigram"]) & (g["pos"] < h["pos"])), lambda g: g["pos"])), F.lit(-1))
    blocks = blocks.withColumn("steps", F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), last(h).alias("last"))))

    def from_start(s: Column) -> Column:
        def step(a: Column, h: Column) -> Column:
            new = (h["last"] < s["pos"]).cast("int")
            shared, again = a["shared"] + new, a["again"] + 1 - new
            n = h["pos"] - s["pos"] + 1 - again
            dice = 2 * shared / (n + F.col("m"))
            now = F.struct((3 * shared - n - F.col("m")).alias("gain"), dice.alias("dice"), (-s["pos"]).alias("start"), h["pos"].alias("end"))
            return F.struct(shared.alias("shared"), again.alias("again"), F.when(dice >= t, F.greatest(a["best"], now)).otherwise(a["best"]).alias("best"))

        none = F.lit(None).cast("struct<gain:int,dice:double,start:int,end:int>")
        begin = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("again"), none.alias("best"))
        within = F.filter("steps", lambda h: (h["pos"] >= s["pos"]) & (h["pos"] < s["pos"] + F.col("reach")))
        return F.aggregate(within, begin, step, lambda a: a["best"])

    starts = F.filter("steps", lambda s: F.floor(s["pos"] / F.col("reach")) == F.col("block"))
    found = blocks.withColumn("best", F.array_max(F.transform(starts, from_start))).where(F.col("best").isNotNull())
    inside = F.filter("hits", lambda h: (h["pos"] >= -F.col("best.start")) & (h["pos"] <= F.col("best.end")))
    found = found.select("doc_id", "text", F.struct(F.col("best.gain").alias("gain"), F.col("best.dice").alias("dice"), F.col("best.start").alias("start"), F.col("best.end").alias("end"), "license", F.array_sort(F.array_distinct(F.transform(inside, lambda h: h["bigram"]))).alias("pairs")).alias("w"))
    ranked = found.groupBy("doc_id", "text").agg(F.sort_array(F.collect_list("w"), asc=False).alias("all"))
    apart = lambda a, w: F.forall(a, lambda v: (v["end"] < -w["start"]) | (w["end"] < -v["start"]))
    kept = ranked.select("doc_id", F.explode(F.aggregate("all", F.filter("all", lambda w: F.lit(False)), lambda a, w: F.when(apart(a, w), F.concat(a, F.array(w))).otherwise(a))).alias("w"))
    return kept.select("doc_id", "w.license", "w.dice", "w.pairs").groupBy("doc_id", "license", "pairs").agg(F.max("dice").alias("dice"))


def scan(docs: DataFrame, given: dict[str, str] | None = None, dice: float = DICE, text: str = "text") -> DataFrame:
    """doc_id, license, n_segments (distinct segments, and windows that no segment
    tells, whose best template this is; the first name of equals), dice (the best, to 6 digits).

    A document without a match, a null or empty text, a text of one word and a
    row without doc_id give no row; rows of one doc_id are one document. A name
    in `given` is told up to its first slash. Without `given`, the templates are
    TEMPLATES and STANDARD.
    """
    given = TEMPLATES | STANDARD if given is None else given
    if not given:
        raise ValueError("no licence templates")
    t = float(dice)
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.array_distinct(F.concat(F.split("body", "\n"), F.split("body", "\n[ \t\r]*\n"), F.array("body")))
    known = templates(docs.sparkSession, given)
    told = docs.where(F.col("doc_id").isNotNull()).select("doc_id", body.alias("body"))
    hit = cut(possible(told, known, t), "licence-texts")
    likely = told.join(small(hit), (told["doc_id"] == hit["doc_id"]) & (F.xxhash64("body") == hit["text"]), "left_semi").withColumn("parts", parts)
    segments = likely.select("doc_id", F.explode("parts").alias("segment"))
    sized = segments.select("doc_id", F.xxhash64("segment").alias("segment"), bigrams(F.col("segment")).alias("b")).withColumn("n", F.size("b"))
    rows = sized.select("doc_id", "segment", "n", F.explode("b").alias("bigram"))
    near = (F.col("n") * (2 - t) >= F.col("m") * t) & (F.col("n") * t <= F.col("m") * (2 - t))
    shared = rows.join(F.broadcast(known), (rows["bigram"] == known["bigram"]) & near).groupBy("doc_id", "segment", "license", "n", "m")
    scored = shared.agg(F.collect_set(rows["bigram"]).alias("pairs")).withColumn("shared", F.size("pairs")).withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("m"))).where(F.col("dice") >= t)
    scored = cut(scored.select("doc_id", "segment", "license", "dice", "pairs"), "licences")
    best = scored.groupBy("doc_id", "segment").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"))
    found = best.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"))
    told = scored.groupBy("doc_id", "license").agg(F.collect_set("pairs").alias("told"))
    more = windows(likely, known, t).join(told, ["doc_id", "license"], "left")
    more = more.where(~F.exists(F.coalesce("told", F.array()), lambda b: F.size(F.array_except("pairs", b)) == 0))
    found = found.unionByName(more.select("doc_id", "license", "dice")).withColumn("license", F.substring_index("license", "/", 1))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_segments"), F.round(F.max("dice"), 6).alias("dice"))
