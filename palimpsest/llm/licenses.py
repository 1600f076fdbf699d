"""Licence scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

The units compared are the lines of a text, its paragraphs, the whole text, and stretches: runs of words anywhere in the
text, across lines and paragraphs, that start and end with a bigram of the template. All are in lower case, with letters and
digits as words. Of a template, only those bigrams' positions are looked at, so a text without a licence costs one pass over
its words. A stretch within a line that fits the template's bounds itself isn't compared: that line stands for it.

A unit of n bigrams can reach a coefficient of t only with templates of n * t / (2 - t) to n * (2 - t) / t bigrams;
others are never compared, and lines and paragraphs outside all templates' bounds aren't split as units. Nor are units compared too few of
whose bigrams any template has. Bigrams are hashed and count as often as they are there. All of it is built-in functions within each row: no shuffle, and memory follows one row.
"""

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.85

_AS_IS = 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.'
_BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details."

#: (SPDX name, text) of full licences and of the notices that stand for them.
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("BSD-2-Clause", f"{_BSD_CLAUSES} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-or-later", _GNU.format(2)),
    ("GPL-3.0-or-later", _GNU.format(3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LicenseRef-All-rights-reserved", "All rights reserved."),
)


def read_templates(spark, path: str, most_bytes: int = 4 << 20) -> list[tuple[str, str]]:
    """(name, text) of a folder's licence files, for scan(): the name is the file's, without .txt; whole licences among them.

    Templates are literals of the plan, so more than most_bytes of them are an error.
    """
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"{size} bytes of licence templates are over {most_bytes}")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").collect()
    return sorted((r.name.removesuffix(".txt"), bytes(r.content).decode("utf-8", "replace")) for r in rows)


def words_of(text: str) -> list[str]:
    """The words of a template, as normalised() makes them of a column."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _normalised(text: str) -> Column:
    return F.regexp_replace(F.lower(common.text_or_empty(text)), r"[^\p{L}\p{N}\n]+", " ")


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """df with matches: array of (license, score, unit, line), best first; `line` counts from 1 and is null for paragraphs and texts.

    Of each unit, the best template is reported, if it reaches the threshold; between equal ones, the first by name. A
    null or empty text has no matches, nor has a unit of a single word. Of stretches that share words, the one with the best
    score is reported (then the longest, then the first by name), and none within a reported unit; their line is that of the
    first word. A column of df called matches is replaced.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = [(name, list(zip(w, w[1:], strict=False))) for name, t in templates if len(w := words_of(t)) > 1]
    fits = lambda n: reduce(lambda a, b: a | b, [n.between(F.lit(low * k), F.lit(high * k)) for k in sorted({len(b) for _, b in known})])
    hashed = df.sparkSession.range(1).select(*[F.array(*[F.xxhash64(F.lit(x), F.lit(y)) for x, y in b]) for _, b in known]).first()
    longs = lambda values: F.array(*[F.lit(v) for v in values])
    given = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), longs(b).alias("b"), longs(sorted(set(b))).alias("kinds")) for (name, _), b in zip(known, hashed, strict=True)])
    every = sorted({v for b in hashed for v in b})

    flat = lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))  # noqa: E731  one less than words
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  f(x), with x evaluated once
    own = common.free_name(df, "own_text")
    lines = F.transform(F.split(F.col(own), "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), (i + 1).alias("line"), F.lit(None).cast("int").alias("at"), F.trim(x).alias("text")))
    longer = lambda kind, x, i: F.struct(F.lit(kind).alias("unit"), F.lit(None).cast("int").alias("line"), i.alias("at"), flat(x).alias("text"))
    none = F.array().cast("array<struct<unit:string,line:int,at:int,text:string>>")
    parts = F.split(F.col(own), "\n *\n[ \n]*")
    paragraphs = F.when((F.size(parts) > 1), F.transform(parts, lambda x, i: longer("paragraph", x, i))).otherwise(none)
    whole = F.when(F.contains(F.col(own), F.lit("\n")), F.array(longer("text", F.col(own), F.lit(None).cast("int")))).otherwise(none)
    units = F.filter(F.concat(lines, paragraphs, whole), lambda u: F.exists(F.array(spaces(u["text"])), fits))

    def hashes(x: Column) -> Column:
        pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
        return let(F.split(x, " "), pairs)

    def bigrams(u: Column) -> Column:
        return F.struct(u["unit"].alias("unit"), u["line"].alias("line"), u["at"].alias("at"), hashes(u["text"]).alias("b"))

    def may_reach(x: Column) -> Column:
        """A unit of n bigrams shares threshold / 2 * (n + low * n) of them with a template at least."""
        return F.size(F.filter(x["b"], lambda g: g.isin(every))) >= threshold / 2 * (1 + low) * F.size(x["b"])

    def dice(t: Column, x: Column) -> Column:
        times = lambda values, g: F.size(F.filter(values, lambda y: y == g))
        shared = F.aggregate(F.array_intersect(t["kinds"], x["b"]), F.lit(0), lambda acc, g: acc + F.least(times(x["b"], g), times(t["b"], g)))
        return 2 * shared / (t["n"] + F.size(x["b"]))

    def best(x: Column) -> Column:
        n = F.size(x["b"])
        near = F.filter(given, lambda t: t["n"].between(low * n, high * n))
        scored = F.transform(near, lambda t: F.struct(dice(t, x).alias("score"), t["name"].alias("license")))
        first = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["license"] < b["license"], -1).otherwise(1)
        top = F.get(F.array_sort(scored, first), 0)
        return F.struct(top["license"].alias("license"), top["score"].alias("score"), x["unit"].alias("unit"), x["line"].alias("line"), x["at"].alias("at"))

    hits, seen, fixed = (own + x for x in ("_hits", "_seen", "_fixed"))

    def runs(t: Column) -> Column:
        """Of each bigram of the template that may start a stretch, the best stretch (first, last: bigrams) that reaches the threshold."""
        longest, least = F.floor(high * t["n"] + 1e-9).cast("int"), F.ceil(threshold / 2 * (1 + low) * t["n"] - 1e-9).cast("int")
        nothing = F.array().cast("array<struct<license:string,score:double,first:int,last:int>>")

        def starts(own_hits: Column) -> Column:
            """Where enough hits for a stretch follow within the length of one."""
            some = F.transform(own_hits, lambda h, i: F.when(F.get(own_hits, i + least - 1)["p"] < h["p"] + longest, h["p"]))
            return F.filter(some, lambda p: p.isNotNull())

        def with_before(h: Column, i: Column, near: Column) -> Column:
            """A hit counts in stretches that start after `before`: the hit by which the template's count of it is used up."""
            times = F.size(F.filter(t["b"], lambda y: y == h["g"]))
            earlier = F.filter(F.slice(near, F.greatest(i - longest, F.lit(0)) + 1, F.least(i, longest)), lambda e: e["g"] == h["g"])
            return F.struct(h["p"].alias("p"), let(earlier, lambda e: F.coalesce(F.get(e, F.size(e) - times)["p"], F.lit(-1))).alias("before"))

        def from_(ready: Column, h: Column, i: Column) -> Column:
            counted = F.filter(F.slice(ready, i + 1, longest), lambda x: (x["p"] < h["p"] + longest) & (x["before"] < h["p"]))
            ends = F.transform(counted, lambda x, j: F.struct((2.0 * (j + 1) / (t["n"] + x["p"] - h["p"] + 1)).alias("score"), x["p"].alias("last")))
            reached = F.filter(ends, lambda x: (x["score"] >= threshold) & ~_same_line(h["p"], x["last"], t["n"]))
            as_run = lambda top: F.struct(t["name"].alias("license"), top["score"].alias("score"), h["p"].alias("first"), top["last"].alias("last"))
            return let(F.array_max(reached), as_run)

        def all_from(own_hits: Column, at: Column) -> Column:
            near = F.filter(own_hits, lambda h: F.exists(at, lambda p: h["p"].between(p, p + longest)))
            ready = let(near, lambda v: F.transform(v, lambda h, i: with_before(h, i, v)))
            # No stretch starts where there aren't enough hits.
            made = let(ready, lambda r: F.transform(r, lambda h, i: F.when(F.array_contains(at, h["p"]), from_(r, h, i))))
            return F.filter(made, lambda m: m["score"].isNotNull())

        either = lambda v: let(starts(v), lambda at: F.when(F.size(at) > 0, all_from(v, at)).otherwise(nothing))
        return let(F.filter(F.col(hits), lambda h: F.array_contains(t["kinds"], h["g"])), lambda v: F.when(F.size(v) >= least, either(v)).otherwise(nothing))

    def _same_line(first: Column, last: Column, n: Column) -> Column:
        at = F.get(F.col(seen), first)
        return (at == F.get(F.col(seen), last + 1)) & (F.get(F.col(own + "_sizes"), at) - 1 <= high * n)

    def apart(made: Column) -> Column:
        order_ = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["last"] - a["first"] > b["last"] - b["first"], -1).when(a["last"] - a["first"] < b["last"] - b["first"], 1).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(a["first"] - b["first"])
        meets = lambda kept, m: F.exists(kept, lambda k: (k["first"] <= m["last"] + 1) & (m["first"] <= k["last"] + 1))
        start = F.array().cast("array<struct<license:string,score:double,first:int,last:int>>")
        return F.aggregate(F.array_sort(made, order_), start, lambda kept, m: F.when(meets(kept, m), kept).otherwise(F.concat(kept, F.array(m))))

    def inside(m: Column) -> Column:
        """Whether a reported unit has all of the stretch."""
        line, part = F.get(F.col(seen), m["first"]), F.get(F.col(own + "_parts"), m["first"])
        one_line, one_part = line == F.get(F.col(seen), m["last"] + 1), part == F.get(F.col(own + "_parts"), m["last"] + 1)
        return F.exists(F.col(fixed), lambda u: (u["unit"] == "text") | (u["unit"] == "line") & one_line & (u["line"] == line + 1) | (u["unit"] == "paragraph") & one_part & (u["at"] == part))

    count = lambda x: F.when(F.length(F.trim(x)) > 0, spaces(F.trim(x)) + 1).otherwise(0)
    spread = lambda sizes: F.flatten(F.transform(sizes, lambda n, i: F.array_repeat(i, n)))
    found = F.filter(F.transform(F.filter(F.transform(units, bigrams), may_reach), best), lambda m: m["score"] >= threshold)
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["line"].isNotNull() & b["line"].isNotNull(), a["line"] - b["line"]).when(a["line"].isNotNull(), -1).when(b["line"].isNotNull(), 1).otherwise(0)
    positions = F.filter(F.transform(hashes(flat(F.col(own))), lambda g, i: F.when(g.isin(every), F.struct(i.alias("p"), g.alias("g")))), lambda h: h.isNotNull())
    scanned = df.drop("matches").withColumn(own, _normalised(text)).withColumn(fixed, found).withColumn(hits, positions)
    # Where each word is, only for texts that have enough bigrams for some stretch.
    enough = F.size(hits) >= min(math.ceil(threshold / 2 * (1 + low) * len(b) - 1e-9) for _, b in known) if known else F.lit(False)
    nowhere = F.array().cast("array<int>")
    scanned = scanned.withColumn(own + "_sizes", F.when(enough, F.transform(F.split(F.col(own), "\n"), count)).otherwise(nowhere))
    scanned = scanned.withColumn(seen, spread(F.col(own + "_sizes"))).withColumn(own + "_parts", F.when(enough, spread(F.transform(parts, lambda x: count(flat(x))))).otherwise(nowhere))
    made = F.filter(F.flatten(F.transform(given, runs)), lambda m: ~inside(m))
    stretches = F.transform(apart(made), lambda m: F.struct(m["license"].alias("license"), m["score"].alias("score"), F.lit("stretch").alias("unit"), (F.get(F.col(seen), m["first"]) + 1).alias("line")))
    units_ = F.transform(fixed, lambda m: F.struct(m["license"].alias("license"), m["score"].alias("score"), m["unit"].alias("unit"), m["line"].alias("line")))
    every_one = F.concat(units_, F.when(enough, stretches).otherwise(F.array().cast("array<struct<license:string,score:double,unit:string,line:int>>")))
    return scanned.withColumn("matches", F.array_sort(every_one, order)).drop(own, fixed, hits, seen, own + "_sizes", own + "_parts")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    top = F.get("matches", 0)
    return found.select("doc_id", top["license"].alias("license"), F.round(top["score"], 6).alias("score"), F.size("matches").cast("long").alias("n_matches"), F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["unit"], m["line"].cast("string"))), ";").alias("where_found"))
