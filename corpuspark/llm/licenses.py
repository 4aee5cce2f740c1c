"""Licence scans, with DataFrame functions only.

A text is compared with licence templates - notices as they stand in files, of one sentence to the whole of the short licences - by the
Dice coefficient of the sets of word bigrams after normalisation (lower case, letters and digits only). Dice >= t bounds the sizes (the
smaller set has at least t / (2 - t) of the larger) and the overlap, so a match holds at least one of a template's few first rare
bigrams. A text that holds none of all templates' is done. Any other is cut into units: its lines, paragraphs, sentences (wherever they
begin and however they are wrapped) and the whole. Candidates come from an equi-join of units and templates on the rare bigrams, are
pruned by the size bounds, and only then are sets intersected. Long licences are found by the notices that they contain.

Defined results: one row for each row of documents, whatever its id; null and empty texts, units of fewer than two words and texts
without a match have no licence, similarity 0 and no matches; units of any length count, by their distinct bigrams; ties go to the
alphabetically first licence; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspark.llm.common import table, text_or_empty

THRESHOLD = 0.8
# Public licence notices and their identifiers.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def normalise(text: Column) -> Column:
    """Lower case; everything but letters, digits and line ends is one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def bigrams(unit: str) -> Column:
    """The distinct pairs of adjacent words of the normalised column."""
    words = f"split(trim(BOTH ' \n' FROM {unit}), '[ \\\\n]+')"
    return F.expr(f"transform(array({words}), w -> CASE WHEN size(w) > 1 THEN array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))) ELSE array() END)[0]")


def template_table(spark: SparkSession, threshold: float = THRESHOLD) -> DataFrame:
    """(template, licence, grams, least, most, probe): one row for each probing bigram of each template. A few hundred rows."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, licence string, notice string")
    rows = rows.withColumn("norm", normalise(F.col("notice"))).withColumn("grams", bigrams("norm"))
    low, size = threshold / (2 - threshold), F.size("grams")
    common = rows.select("template", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    ranked = (
        rows.select("template", F.explode("grams").alias("g")).join(common, "g").groupBy("template").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("r"))
    )
    probes = F.slice("r", F.lit(1), size - F.ceil(size * low).cast("int") + 1)
    return (
        rows.join(ranked, "template")
        .select(
            "template",
            "licence",
            "grams",
            F.ceil(size * low).cast("int").alias("least"),
            F.floor(size / low).cast("int").alias("most"),
            F.explode(probes).alias("p"),
        )
        .select("template", "licence", "grams", "least", "most", F.col("p.g").alias("probe"))
    )


def _sets() -> list[list[str]]:
    """Each template's distinct bigrams."""
    out = []
    for _, text in TEMPLATES:
        w = re.sub(r"[\W_]+", " ", text.lower()).split()
        out.append(list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))))
    return out


def most_bigrams(threshold: float = THRESHOLD) -> int:
    """Distinct bigrams that a unit can have to match any template."""
    return int(max(map(len, _sets())) * (2 - threshold) / threshold)


def units(text: Column, norm: Column) -> Column:
    """The distinct normalised lines, paragraphs, sentences and the whole of a text."""
    lines = F.split(norm, "\n")
    paragraphs = F.filter(F.split(norm, r"\n *\n[ \n]*"), lambda p: F.instr(p, "\n") > 0)
    ends = F.split(F.regexp_replace(F.lower(text), r"([.!?;:])[ \t\n]+", "$1\u0001"), "\u0001")
    sentences = F.transform(ends, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " "))
    return F.array_distinct(F.concat(lines, paragraphs, sentences, F.array(norm)))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, licence (the best), dice, licences (all, sorted, joined by commas), n_matches. The only shuffle is of
    one small row for each row of docs."""
    probes = F.broadcast(template_table(docs.sparkSession, threshold))  # some hundred rows, fixed by TEMPLATES
    most = most_bigrams(threshold)
    probe_list = F.array(*(F.lit(g) for g in _probe_values(threshold)))
    norm = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"), normalise(text_or_empty()).alias("norm"))
    suspect = norm.select("doc_id", "row", "text", "norm", F.arrays_overlap(bigrams("norm"), probe_list).alias("suspect"))
    cut = suspect.select("doc_id", "row", F.posexplode_outer(F.when(F.col("suspect"), units(F.col("text"), F.col("norm")))).alias("no", "unit"))
    own = cut.select("doc_id", "row", "no", F.when(F.col("unit").isNotNull(), bigrams("unit")).alias("own"))
    own = own.withColumn("own", F.when(F.size("own").between(1, most), F.col("own")))
    probed = own.select("doc_id", "row", "no", "own", F.explode_outer(F.array_intersect("own", probe_list)).alias("at"))
    pairs = probed.join(probes, (F.col("at") == F.col("probe")) & F.size("own").between(F.col("least"), F.col("most")), "left")
    dice = F.round(2 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.size("grams")), 6)
    found = pairs.select("doc_id", "row", "no", "licence", dice.alias("dice")).withColumn("hit", F.col("dice") >= threshold)
    names = sorted({n for n, _ in TEMPLATES})
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("licence"))
    hit = lambda c: F.when(F.col("hit"), c)
    of_row = found.groupBy("row", "doc_id").agg(
        F.max_by(F.struct("licence", "dice"), hit(F.struct(F.col("dice"), -rank))).alias("best"),
        F.collect_set(hit(F.struct("no", "licence"))).alias("matches"),
    )
    licences = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.licence))), ",")
    return of_row.select(
        "doc_id",
        F.col("best.licence").alias("licence"),
        F.coalesce("best.dice", F.lit(0.0)).alias("dice"),
        licences.alias("licences"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def _probe_values(threshold: float) -> list[str]:
    """The probing bigrams of all templates, as in ``template_table``."""
    sets = _sets()
    n: dict[str, int] = {}
    for s in sets:
        for g in s:
            n[g] = n.get(g, 0) + 1
    low = threshold / (2 - threshold)
    found = set()
    for s in sets:
        found.update(sorted(s, key=lambda g: (n[g], g))[: len(s) - ceil(len(s) * low) + 1])
    return sorted(found)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_licenses": op6_licenses}
_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
_GRAMS = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
_VALUES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
ORACLE_SQL = {
    "op6_licenses": f"""
WITH templates AS (
  SELECT template, licence, {_GRAMS} AS grams
  FROM (SELECT template, licence, string_split_regex(trim({_NORM.format("notice")}, ' ' || chr(10)), '[ \\n]+') AS w
        FROM (VALUES {_VALUES}) AS t(template, licence, notice))
), norm AS (SELECT doc_id, coalesce(text, '') AS text, {_NORM.format("coalesce(text, '')")} AS norm FROM documents
), units AS (
  SELECT DISTINCT doc_id, unnest(list_concat(list_concat(string_split(norm, chr(10)),
    list_filter(string_split_regex(norm, '\\n *\\n[ \\n]*'), lambda p: contains(p, chr(10)))), list_concat([norm],
    list_transform(string_split(regexp_replace(lower(text), '([.!?;:])[ \\t\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_NORM.format("x")})))) AS unit FROM norm
), own AS (
  SELECT doc_id, unit, {_GRAMS} AS own FROM (SELECT *, string_split_regex(trim(unit, ' ' || chr(10)), '[ \\n]+') AS w FROM units) WHERE len(w) >= 2
), pairs AS (
  SELECT DISTINCT doc_id, unit, licence, round(2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)), 6) AS dice
  FROM own JOIN templates ON len(own) BETWEEN ceil(len(grams) * {THRESHOLD} / {2 - THRESHOLD}) AND floor(len(grams) * {2 - THRESHOLD} / {THRESHOLD})
), found AS (
  SELECT doc_id, first(licence ORDER BY dice DESC, licence) AS licence, first(dice ORDER BY dice DESC, licence) AS dice,
    list_aggregate(list_sort(list_distinct(list(licence))), 'string_agg', ',') AS licences, count(*) AS n_matches
  FROM pairs WHERE dice >= {THRESHOLD} GROUP BY doc_id
)
SELECT d.doc_id, licence, coalesce(dice, 0.0) AS dice, coalesce(licences, '') AS licences, coalesce(n_matches, 0) AS n_matches
FROM documents d LEFT JOIN found USING (doc_id)"""
}
