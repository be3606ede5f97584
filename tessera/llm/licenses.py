"""Licence scan: TF-IDF cosine of headers, licence files, lines and sentences to templates, then inheritance by directory.

The whole units of a file are its header (the comments it begins with, as one
text) and, where its name is a licence name (``LICENSE``, ``COPYING``, ``NOTICE``, ``UNLICENSE``, any suffix), its whole text.
The parts are the paragraphs of these, and every line and its sentences.  Terms are ``[a-z0-9]+`` after lower-casing, so comment marks
are no terms.  The vocabulary is the templates' terms, with
idf = ln((1 + N) / (1 + df)) + 1 over all N files; any other term counts with
the largest idf there is, ln(1 + N) + 1, so unrelated words push the cosine down.  A file's
licence is the template of its best whole unit at ``THRESHOLD`` or above, else
of its best part: BSD texts share clauses, which only the whole tells apart.
Short licences have their full text as a template, long ones their title and
their standard header.

Only units that can reach the threshold are scored.  With C a set of terms,
a unit whose known terms all lie in C has a cosine of at most |t restricted
to C| / |t| with template t (Cauchy-Schwarz).  The commonest terms form C as
long as that bound stays below the threshold for every template; the rest are
the signal terms, and a unit without one is left out exactly.

A file without a licence of its own takes that of the licence file in its
nearest ancestor directory, its own included, that has one (the best by score,
then path).  Paths are joined to directories; only the join keys of a file's
ancestors are enumerated.

Cases: null and empty texts have no licence of their own; a null path has no
ancestors and gives nothing; equal scores go to the licence name first in
order; repeated rows are scored each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own

THRESHOLD = 0.6

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by "
        "the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_GNU_REST = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the "
             "GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. ")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
              "this software without specific prior written permission. ")
_BSD_REST = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
             "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
             "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
             "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
             "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
             "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

# fixed values: the notices by which files commonly name these public licences, their standard headers, titles and short texts
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *[(lic, text.format(name, version)) for lic, name, version in (
        ("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("LGPL-3.0", "Lesser General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("AGPL-3.0", "Affero General Public License", "3")) for text in (_GNU, _GNU + _GNU_REST)],
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("BSD-2-Clause", _BSD + _BSD_REST),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_REST),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
            "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
            "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
# the comments at the start of a text, after a first #! line
HEADER = (r"^(?:#![^\n]*\n)?\s*+(?:(?:/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\(\*[\s\S]*?\*\)|\{-[\s\S]*?-\}|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''"
          r"|(?://|#|--|;|%|!|(?i:dnl|rem)\b)[^\n]*)\s*+)++")
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"
SENTENCE = r"(?<=[.;:!?])\s+(?=[A-Z])"


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def _template_terms() -> list[tuple[int, str, str, int]]:
    import re
    from collections import Counter
    return [(k, name, t, n) for k, (name, text) in enumerate(TEMPLATES) for t, n in sorted(Counter(re.findall("[a-z0-9]+", text.lower())).items())]


def _signal(idf: dict[str, float], threshold: float) -> list[str]:
    """The template terms that remain when the commonest are set aside, see above."""
    by: dict[int, dict[str, float]] = {}
    for k, _, t, n in _template_terms():
        by.setdefault(k, {})[t] = (n * idf[t]) ** 2
    aside: set[str] = set()
    for t in sorted(idf, key=lambda t: (idf[t], t)):
        if all(math.sqrt(sum(v for x, v in w.items() if x in aside or x == t) / sum(w.values())) < threshold * 0.999 for w in by.values()):
            aside.add(t)
    return sorted(set(idf) - aside)


def scan(files: DataFrame, file_id: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id, path, license, score, origin (own / inherited / none), from_path``."""
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    f = own(files, file_id, path, text).toDF("doc_id", "path", "text")
    terms = _template_terms()
    vocabulary = sorted({t for _, _, t, _ in terms})
    words = F.array(*[F.lit(t) for t in vocabulary])
    seen = f.select(F.array_intersect(words, terms_of(F.coalesce("text", F.lit("")))).alias("known"))
    # one count per template term: a fixed number of rows
    stats = seen.select(F.explode(F.concat("known", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    df = {r["term"]: r["df"] for r in stats}
    n = df.pop("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    unknown = math.log(1 + n) + 1
    templates = {}
    for k, name, t, c in terms:
        templates.setdefault(k, (name, {}))[1][t] = c * idf[t]

    by_letter: dict[str, list[str]] = {}
    for t in _signal(idf, threshold):
        by_letter.setdefault(t[0], []).append(t[1:])
    signal = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items())
    pattern = F.lit(f"(?<![a-z0-9])(?:{signal})(?![a-z0-9])")
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    is_file = name.rlike(LICENCE_FILE)
    none = F.array().cast("array<string>")
    header = F.regexp_replace(F.regexp_extract("text", HEADER, 0), r"(?im)^[ \t]*(?:dnl|rem)\b", "")
    whole = F.filter(F.concat(F.array(header), F.when(is_file, F.array("text")).otherwise(none)), lambda x: x != "")
    # written, so that nothing below is computed for the files that the signal terms leave out
    files_left = scratch.write(f.where(F.regexp_like(F.lower("text"), pattern)), "candidates")
    units = files_left.select("doc_id", "path", "text", whole.alias("whole"))
    lines = F.concat(F.flatten(F.transform("whole", lambda x: F.split(x, PARAGRAPH))), F.split("text", "\n"))
    lines = F.filter(lines, lambda x: F.regexp_like(F.lower(x), pattern))
    parts = F.array_distinct(F.concat(lines, F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE)))))
    tag = lambda xs, k: F.transform(xs, lambda x: F.struct(F.lit(k).alias("part"), x.alias("unit")))
    units = units.select("doc_id", "path", F.explode(F.concat(tag(F.array_distinct("whole"), 0), tag(parts, 1))).alias("u")).select("doc_id", "path", "u.part", "u.unit")
    units = units.where(F.regexp_like(F.lower("unit"), pattern)).select("doc_id", "path", "part", "unit", F.md5("unit").alias("key"))
    units = scratch.write(units, "units")
    # equal units are scored once: a notice that a third of all files carry is one row
    terms_in = units.select("key", "unit").dropDuplicates(["key"]).select("key", F.explode(terms_of(F.col("unit"))).alias("t"))
    # both tables are fixed by the templates: (term, idf) and (term, template, weight)
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "t string, idf double"))
    fixed = [(t, k, lic, w, math.sqrt(sum(x * x for x in vec.values()))) for k, (lic, vec) in templates.items() for t, w in vec.items()]
    fixed = F.broadcast(spark.createDataFrame(fixed, "t string, template int, license string, tw double, size double"))
    tf = terms_in.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n")).join(known, "t", "left").withColumn("w", F.col("n") * F.col("idf"))
    norm = tf.groupBy("key").agg(F.sqrt(F.sum(F.coalesce(F.col("w") * F.col("w"), F.col("n") * F.lit(unknown ** 2)))).alias("norm"))
    dots = tf.where("idf is not null").join(fixed, "t").groupBy("key", "template", "license", "size").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias("score")
    top = dots.join(norm, "key").select("key", "license", score).where(F.col("score") >= threshold) \
        .groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("top"))
    own_licence = units.select("doc_id", "path", "part", "key").join(top, "key").groupBy("doc_id", "path").agg(F.min(F.struct("part", "top.low", "top.license")).alias("own"))
    own_licence = scratch.write(own_licence.select("doc_id", "path", F.col("own.license").alias("license"), (-F.col("own.low")).alias("score")), "own")

    # inheritance: licence directories, one licence each, joined to every file's ancestors
    folder = F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    given = own_licence.where(is_file & F.col("path").isNotNull()).groupBy(folder.alias("dir")).agg(
        F.min(F.struct((-F.col("score")).alias("low"), "path", "license")).alias("g")).select("dir", F.struct("g.path", "g.license").alias("g"))
    rows = f.select("doc_id", "path").join(own_licence.select(F.col("doc_id").alias("o_id"), F.col("path").alias("o_path"), "license", "score"),
                                           F.col("doc_id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path")), "left").drop("o_id", "o_path")
    rows = scratch.write(rows, "rows")
    dirs = rows.where("license is null and path is not null").select(folder.alias("at")).distinct()
    parts = F.split("at", "/")
    above = dirs.select("at", F.explode(F.concat(F.array(F.lit(0)), F.when(F.col("at") != "", F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")))).alias("depth")) \
        .select("at", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("dir"))
    near = above.join(given, "dir").groupBy("at").agg(F.max(F.struct("depth", "g")).alias("m")).select("at", F.col("m.g").alias("g"))
    out = rows.withColumn("dir", F.when(F.col("license").isNull(), folder)).join(near, F.col("dir") == F.col("at"), "left")
    return out.select(
        "doc_id", "path", F.coalesce("license", "g.license").alias("license"), "score",
        F.when(F.col("license").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("g.path")).alias("from_path"))
