"""License scans: sparse TF-IDF cosines of notices to templates, then licences inherited from the nearest ancestor directory, in DataFrame functions alone."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

#: The wording of well-known licence notices (SPDX identifier, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.0."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
]
#: A notice holds one of these, lower-cased.
CUES = ["licens", "licenc", "copyright", "rights reserved", "public domain", "permission is hereby granted", "permission to use", "permission is granted", "redistribution and use", "subject to the terms", "under the terms", "cc by", "cc0", "creative commons", "gnu gpl", "as-is", "unencumbered"]
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT = _PERMIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
_LGPL2 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
#: Standard headers, and titles and texts of licence files (SPDX identifier, text), for joined lines.
BLOCK_TEMPLATES = [
    ("GPL-3.0", _GPL.format("", 3)), ("GPL-2.0", _GPL.format("", 2)), ("LGPL-3.0", _GPL.format("Lesser ", 3)), ("AGPL-3.0", _GPL.format("Affero ", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MIT", "The MIT License (MIT)"), ("MIT", _PERMIT), ("MIT", _MIT), ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("Apache-2.0", _APACHE), ("ISC", _ISC), ("ISC", "ISC License"), ("Zlib", _ZLIB), ("Zlib", "zlib License"), ("Unlicense", _UNLICENSE), ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("LGPL-2.1", _LGPL2), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("EPL-2.0", _EPL), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
#: Words of names that a notice must hold if its template does.
NAMES = ["apache", "mit", "gnu", "lesser", "affero", "mozilla", "isc", "zlib", "boost", "eclipse", "endorse"]
#: Words that a notice must not hold if its template does not, by the beginning of the licence's name.
APART = {"GPL": ["lesser", "affero"], "LGPL": ["affero"], "AGPL": ["lesser"], "BSD-2-Clause": ["neither", "endorse"]}
#: Licences that count only beside no other, the least telling first.
VAGUE = ["All-Rights-Reserved", "BSD"]
#: A sentence or block that denies a licence gives none.
DENIAL = r"(?:\bnot|n't)\s+(?:be\s+|been\s+|yet\s+)?(?:licen[sc]ed|released|distributed|available|offered|covered|published)\s+(?:under|by)\b"
_ID = r"[A-Za-z0-9]+(?:[.:-][A-Za-z0-9]+)*[+]?"
_WITH = r"[ \t]+WITH[ \t]+" + _ID
#: An SPDX tag with its expression, and what is not a licence in an expression.
TAG = r"(?i:spdx-license-identifier):[ \t]*([(]*" + _ID + r"[)]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[(]*" + _ID + r"[)]*)*)"
#: Words that a text must have in it to be searched; each cue holds one, however its lines are wrapped.
_HINTS = ["licens", "licenc", "copyright", "rights", "domain", "permission", "redistribution", "terms", "cc by", "cc0", "commons", "gnu", "as-is", "unencumbered"]
#: Comment marks at the beginning and at the end of a line.
_MARKS, _LAST_MARKS = r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)", r"[ \t\r]*(?:\*+/|-->)?[ \t\r]*$"
THRESHOLD = 0.7
LICENSE_NAMES = ["license", "license.txt", "license.md", "licence", "licence.txt", "copying", "copying.txt"]


def _has(c: Column, words: list[str]) -> Column:
    return functools.reduce(operator.or_, [F.contains(c, F.lit(x)) for x in words])


def _tokens(c: Column) -> Column:
    """Words of letters, digits and inner dots or hyphens, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def needs(notice: str) -> list[str]:
    """The words of a template without which nothing is a copy of it: names, the kind of a Creative Commons licence, and versions."""
    low = notice.lower()
    words = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", low)
    versions = re.findall(r"(?:version|v[.]|- v|public license|cc0|by(?:-[a-z]+)*) ([0-9]+(?:[.][0-9]+)*)", low)
    return sorted({w for w in words if w in NAMES or w == "cc0" or re.fullmatch("by(-[a-z]+)+", w)} | {v for v in versions if v in words})


def bars(license: str) -> list[str]:
    return sorted({w for start, words in APART.items() if license.startswith(start) for w in words})


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, block, notice, needs, bars); templates of blocks come after those of sentences."""
    rows = [(i, x, i >= len(TEMPLATES), text, needs(text), bars(x)) for i, (x, text) in enumerate(TEMPLATES + BLOCK_TEMPLATES)]
    return spark.createDataFrame(rows, "template int, license string, block boolean, notice string, needs array<string>, bars array<string>")


def notices(files: DataFrame) -> DataFrame:
    """(file_id, block, at, token, tf): the words of each sentence, and of each block, with a cue and without a denial.

    Blocks are paragraphs, the comment at the head of a file and the whole file, lines joined and comment marks stripped.
    """
    lines = F.split("text", "\n")
    stripped = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _MARKS, ""), _LAST_MARKS, "")))
    ends = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(_MARKS + r"|^\s*$"))), False).cast("int")
    parted = files.where(_has(F.lower("text"), _HINTS)).select("file_id", "text", stripped.alias("lines"), ends.alias("ends"))
    head, whole = F.array_join(F.slice("lines", F.lit(1), F.greatest(F.col("ends") - 1, F.lit(0))), " "), F.array_join("lines", " ")
    blocks = F.concat(F.split(F.array_join("lines", "\n"), r"\n\n+"), F.array(head, whole))
    marked = lambda pieces, block: F.transform(pieces, lambda x, i: F.struct(F.lit(block).alias("block"), i.alias("at"), x.alias("piece")))
    pieces = parted.select("file_id", F.explode(F.concat(marked(F.split("text", r"\n|(?<=[.;!?])\s+"), False), marked(blocks, True))).alias("p")).select("file_id", "p.*")
    low = F.lower(F.when(F.col("block"), F.regexp_replace("piece", r"\s+", " ")).otherwise(F.col("piece")))
    found = pieces.where(_has(low, CUES) & ~low.rlike(DENIAL))
    return found.select("file_id", "block", "at", F.explode(_tokens(F.col("piece"))).alias("token")).groupBy("file_id", "block", "at", "token").agg(F.count("*").alias("tf"))


def match_notices(files: DataFrame) -> DataFrame:
    """(file_id, block, at, best) of each notice that has a template of at least THRESHOLD, all of whose needs and none of whose bars it holds.

    best is (sure, explained, cosine, order, license): the template that explains most of the notice's words, ties by cosine, then
    the earlier; vague licences come after all others.
    """
    words, known = durable(notices(files), "notices"), templates(files.sparkSession)
    # Document frequencies over all sentences, or all blocks, of all files.
    df = words.groupBy("block", "token").agg(F.count("*").alias("df"))
    total = words.select("file_id", "block", "at").distinct().groupBy("block").agg(F.count("*").alias("n"))
    idf = lambda n, d: F.log((n + 1.0) / (d + 1.0)) + 1.0
    weighed = words.join(df, ["block", "token"]).join(F.broadcast(total), "block").select("file_id", "block", "at", "token", "tf", (F.col("tf") * idf(F.col("n"), F.col("df"))).alias("w"))
    norms = weighed.groupBy("file_id", "block", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # The templates are a fixed table of some thousand words; what a template bars is in it with no weight.
    own = known.select("template", "license", "block", "needs", F.explode(_tokens(F.col("notice"))).alias("token")).groupBy("template", "license", "block", "needs", "token").agg(F.count("*").alias("ttf"))
    barred = known.select("template", "license", "block", "needs", F.explode("bars").alias("token"), F.lit(0).cast("long").alias("ttf"))
    base = own.unionByName(barred).join(df, ["block", "token"], "left").join(F.broadcast(total), "block")
    base = base.withColumn("tw", F.col("ttf") * idf(F.col("n"), F.coalesce("df", F.lit(0)))).withColumn("tnorm", F.sqrt(F.sum(F.col("tw") * F.col("tw")).over(W.partitionBy("template"))))
    base = base.select("template", "license", "block", "token", "ttf", "tw", "tnorm", F.size("needs").alias("needs"), F.array_contains("needs", F.col("token")).cast("int").alias("need"))
    dots = weighed.join(F.broadcast(base), ["block", "token"]).groupBy("file_id", "block", "at", "template", "license", "tnorm", "needs").agg(
        F.sum(F.col("w") * F.col("tw")).alias("dot"), F.sum(F.least("tf", "ttf")).alias("explained"), F.sum("need").alias("met"), F.max((F.col("ttf") == 0).cast("int")).alias("barred")
    )
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("cosine")
    scored = dots.where("met = needs AND barred = 0").join(norms, ["file_id", "block", "at"]).select("file_id", "block", "at", "license", "template", "explained", cosine).where(F.col("cosine") >= THRESHOLD)
    sure = F.coalesce(F.nullif(F.array_position(F.lit(VAGUE), F.col("license")), F.lit(0)), F.lit(len(VAGUE) + 1)).alias("sure")
    return scored.groupBy("file_id", "block", "at").agg(F.max(F.struct(sure, "explained", "cosine", (-F.col("template")).alias("order"), "license")).alias("best"))


def tags(files: DataFrame) -> DataFrame:
    """(file_id, expression, listed) of files with SPDX tags: the first tag's expression, and the licences of all, exceptions left out."""
    found = files.where(F.contains(F.lower("text"), F.lit("spdx-license-identifier"))).select("file_id", F.regexp_extract_all("text", F.lit(TAG), F.lit(1)).alias("found"))
    one = found.groupBy("file_id").agg(F.max("found").alias("found")).where(F.size("found") > 0)
    ids = F.flatten(F.transform("found", lambda x: F.regexp_extract_all(F.regexp_replace(x, _WITH, ""), F.lit(_ID), F.lit(0))))
    return one.select("file_id", F.col("found")[0].alias("expression"), F.array_sort(F.array_distinct(F.filter(ids, lambda x: ~x.isin("AND", "OR")))).alias("listed"))


def match_files(files: DataFrame) -> DataFrame:
    """(file_id, license, cosine, licenses): what an SPDX tag says (cosine 1), else the best match of a file's notices and all that they name; vague licences are listed only alone."""
    best = match_notices(files).groupBy("file_id").agg(F.max("best").alias("b"), F.collect_set("best.license").alias("all"))
    surer = F.filter("all", lambda x: ~x.isin(VAGUE))
    matched = best.select("file_id", "b.license", "b.cosine", F.array_sort(F.when(F.size(surer) > 0, surer).otherwise(F.array("b.license"))).alias("licenses"))
    both = matched.join(tags(files), "file_id", "full")
    return both.select("file_id", F.coalesce("expression", "license").alias("license"), F.when(F.col("expression").isNotNull(), 1.0).otherwise(F.col("cosine")).alias("cosine"), F.coalesce("listed", "licenses").alias("licenses"))


def scan(files: DataFrame) -> DataFrame:
    """(file_id, path, own_license, cosine, inherited_license, inherited_from, license, licenses) of every row of files (file_id, path, text).

    A file with a notice has its own licence; any other has that of the licence file (see LICENSE_NAMES) in the nearest directory
    at or above its own. Of two licence files in one directory the one of higher cosine counts, then that of the later identifier.
    A licence is that of the template that explains most words (see match_notices()); an SPDX expression is taken as it stands. licenses lists
    all that the own or inherited texts name. Notices that deny a licence give none, nor do those that lack a template's version or name. Texts of any length are searched whole. Null text: no notice. Null path: no directory, so nothing inherited. Rows without file_id go; repeated rows each have a result; an empty table gives an empty one. Other columns are not read.
    """
    base = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("file_id IS NOT NULL")
    own = durable(match_files(base.select("file_id", "text")), "licensed-files").select(F.col("file_id").alias("_of"), F.col("license").alias("own_license"), "cosine", F.col("licenses").alias("own_licenses"))
    placed = base.select("file_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.lower(F.regexp_extract("path", "([^/]*)$", 1)).alias("name"))
    named = placed.join(own, placed["file_id"] == own["_of"], "left").drop("_of")
    by_dir = named.where(F.col("name").isin(LICENSE_NAMES) & F.col("own_license").isNotNull()).groupBy("dir").agg(F.max(F.struct("cosine", "own_license", "own_licenses")).alias("found"))
    # One row for each directory, exploded into its ancestors (its depth bounds them), meets the directories that have a licence.
    dirs = placed.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))).alias("ancestor"))
    nearest = above.join(by_dir.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy(F.col("dir").alias("_dir")).agg(F.max_by("found", F.length("ancestor")).alias("found"), F.max_by("ancestor", F.length("ancestor")).alias("inherited_from"))
    joined = named.join(nearest, named["dir"] == nearest["_dir"], "left")
    own_or = lambda own: F.coalesce(own, "found." + own)
    return joined.select("file_id", "path", "own_license", "cosine", F.col("found.own_license").alias("inherited_license"), "inherited_from", own_or("own_license").alias("license"), own_or("own_licenses").alias("licenses"))
