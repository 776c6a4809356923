"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs (lines) are bags of word n-grams, of those that the training statements have. A
sparse multinomial logistic regression is fitted on sentences of public licences, on generated
statements (forms x names x versions x spellings) and, for the unknown class, on every paragraph of the
corpus: equal bags are one row with their number as weight. It is scored as a join of n-grams with
the non-zero coefficients. The least probability of a hit is set on held-out paragraphs, and a hit
counts when the paragraph also shares enough n-grams with a template of the predicted family.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versetide.session import broadcast_if_small, scratch_path, settle, spread

#: Paragraphs of public licences, by family. They are cut into sentences as documents are.
TEXTS = {
    "apache": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ),
    "cc": (
        "You are free to share, copy and redistribute the material in any medium or format and to adapt, remix, transform, and build upon the material",
        "You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0.",
    ),
    "reserved": (
        "All rights reserved", "All rights are reserved by the author", "Copyright (c) the authors. All rights reserved worldwide",
        "All content is copyright of the publisher and may not be reproduced without permission",
        "No part of this publication may be reproduced, stored in a retrieval system or transmitted in any form without the prior written permission of the publisher",
        "Unauthorized copying of this file is strictly prohibited", "Proprietary and confidential",
    ),
}
#: Ways to name a licence. Each name is combined with each ending and both spellings.
NAMES = {
    "apache": (("Apache License", "Apache Software License"), ("", " 2.0", ", Version 2.0", " v2", " v2.0", " version 2")),
    "bsd": (("BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "3-Clause BSD License", "2-Clause BSD License",
             "New BSD License", "Simplified BSD License", "Modified BSD License", "BSD-style License"), ("",)),
    "cc": (("CC BY", "CC BY-SA", "CC BY-NC", "CC BY-ND", "CC BY-NC-SA", "CC BY-NC-ND", "CC-BY", "CC-BY-SA", "Creative Commons Attribution License",
            "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-NonCommercial", "Creative Commons License"),
           ("", " 4.0", " 3.0", " 4.0 International License")),
    "gpl": (("GNU General Public License", "GNU GPL", "GPL", "GNU Lesser General Public License", "LGPL", "GNU Affero General Public License", "AGPL"),
            ("", " v2", " v3", ", version 2", " version 3", " v3 or later", ", version 2 or later")),
    "mit": (("MIT License", "MIT/X11 License", "MIT-style License", "Expat License"), ("",)),
    "mpl": (("Mozilla Public License", "MPL"), ("", " 2.0", ", version 2.0", ", v. 2.0", " v2")),
}
#: Identifiers, which stand alone or before the word licence.
IDENTIFIERS = {
    "apache": ("Apache-2.0", "Apache 2.0"), "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "cc": ("CC0", "CC0 1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"),
    "gpl": ("GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "AGPLv3", "AGPL-3.0"),
    "mit": ("MIT",), "mpl": ("MPL-2.0", "MPL 2.0"),
}
#: Statements that take a name. Tests hold other ones out.
FORMS = (
    "{}", "Licensed under {}", "Licensed under the {}", "This file is licensed under the {}", "License: {}", "SPDX-License-Identifier: {}",
    "Distributed under the terms of the {}", "Available under {}", "This project uses the {}", "The code is under the {}, see LICENSE",
)
#: Statements that look alike but name no licence; fixed values too, for the unknown class.
LOOKALIKES = (
    "A driving license is issued under the rules of the public road office",
    "The general public may use the work of the foundation",
    "Version 2.0 of the file is available under the old name",
    "He was released under the terms of the court, free of charge",
    "Permission to park is granted to any person with a copy of this letter",
    "The source is in the attribution file and the forms are in the office",
    "All seats are reserved", "All rights of way", "Licensed driver wanted",
)
#: Paragraphs of ``sampled`` and their bytes, at most.
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
#: Bytes of a paragraph, roughly, to find how many of them to look at for the sample.
LINE_BYTES = 100
#: Weight of all unknown paragraphs together, at most; each counts alike, and as one at most.
UNKNOWN_WEIGHT = 10_000
#: Weight of a statement.
TOLD_WEIGHT = 2.0
#: Share of held-out unknown paragraphs that may pass, and least probability in any case.
PASSING = 0.0005
LEAST = 0.5
#: The least probability is a multiple of one in STEPS.
STEPS = 10_000
#: Least share of a template's, or the paragraph's, n-grams that confirms a prediction.
CONFIRM = 0.5
#: Weight, in statements, of each name behind paragraphs, and how many of their known n-grams stand before it.
CONTEXTS = 4
CONTEXT = 8
#: Share of the corpus' paragraphs that may have an n-gram that marks licences, at most; FEW may in any case.
RARE = 0.001
FEW = 20
UNKNOWN = "unknown"


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits, dots between digits and hyphens."""
    return F.filter(
        F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)"), lambda w: w != ""
    )


def grams(words: Column) -> Column:
    """Words and pairs of neighbours, each once."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.array_distinct(F.concat(words, pairs))


def known_grams(words: Column, vocabulary: list[str]) -> Column:
    """``grams`` that are in ``vocabulary``, in their order; other pairs are not put together."""
    single, pairs = [g for g in vocabulary if " " not in g], [g for g in vocabulary if " " in g]
    inside = sorted({w for g in pairs for w in g.split(" ")})
    listed = F.zip_with(
        words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
        lambda a, b: F.when(a.isin(inside) & b.isin(inside), F.concat_ws(" ", a, b)),
    )
    known = F.filter(words, lambda w: w.isin(sorted({*single, *inside})))
    found = F.concat(F.filter(known, lambda w: w.isin(single)), F.filter(listed, lambda g: g.isin(pairs)))
    # most paragraphs have no two known words, which a pair is of
    return F.array_distinct(F.when(F.size(known) < 2, F.filter(known, lambda w: w.isin(single))).otherwise(found))


def paragraphs(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` without the text, a row for each line with a word: ``paragraph`` (from 0) and its n-grams.

    A line that holds a statement and other sentences is matched sentence by
    sentence: paragraphs are lines cut after a full stop and a space.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\n|(?<=[.!?])\x20+(?=\p{Lu})")
    return documents.select("*", F.posexplode(lines).alias("paragraph", "_line")).drop(text)


def _has(column: str, listed: list[str]) -> Column:
    """Whether the array has one of ``listed``, which are of word characters only. As text, which is quick to put together."""
    return F.expr(f"exists({column}, x -> x IN ({', '.join(map(repr, listed))}))") if listed else F.lit(False)


def _likeness(template: Column) -> Column:
    """Share of the n-grams in common, of the shorter of the paragraph, which has ``n_grams``, and the template."""
    return F.size(F.array_intersect("grams", template)) / F.least("n_grams", F.size(template))


def statements(names: dict[str, list[str]], forms: tuple[str, ...]) -> list[tuple[str, str]]:
    """(family, statement): every name in every form."""
    return [(family, form.format(name)) for family, all_of in names.items() for name in all_of for form in forms]


def licence_names() -> dict[str, list[str]]:
    """The ways to name a licence, by family: names with endings, and identifiers, in both spellings."""
    names = {}
    for family, (heads, endings) in NAMES.items():
        long = [f"{h}{e}" for h in heads for e in endings] + [f"{i} License" for i in IDENTIFIERS[family]]
        spelled = dict.fromkeys(long + [n.replace("License", "Licence") for n in long])
        names[family] = [*spelled, *IDENTIFIERS[family]]
    return names


def _table(spark: SparkSession, rows: list[tuple[str, str]], name: str) -> DataFrame:
    """Fixed statements as written rows of family, words and n-grams, cut as documents are."""
    path = scratch_path(spark, name)
    spark.createDataFrame(rows, "family string, line string").coalesce(1).write.parquet(path)
    lines = paragraphs(spark.read.parquet(path), "line").select("family", tokens(F.col("_line")).alias("words"))
    return settle(lines.where(F.size("words") > 0).select("family", "words", grams(F.col("words")).alias("grams")).distinct(), name)


def template_table(spark: SparkSession) -> DataFrame:
    """What confirms a prediction: sentences of the licences' texts, and their names.

    An identifier that is a word of other languages stands behind ``under`` or ``license``.
    """
    heads = {family: [*dict.fromkeys(x.replace("License", w) for x in NAMES[family][0] for w in ("License", "Licence")), *IDENTIFIERS[family]] for family in NAMES}
    named = [
        (family, form.format(name)) for family, all_of in heads.items() for name in all_of
        for form in (("under {}", "License: {}", "{} licensed", "SPDX-License-Identifier: {}") if name == "MIT" else ("{}",))
    ]
    texts = [(family, t) for family, all_of in TEXTS.items() for t in all_of]
    return _table(spark, texts + named, "licence-templates")


def _made(spark: SparkSession) -> DataFrame:
    """Labelled paragraphs: sentences as they are and with a word left out, and names in forms."""
    texts = [(family, t) for family, all_of in TEXTS.items() for t in all_of] + [(UNKNOWN, t) for t in LOOKALIKES]
    rows = _table(spark, texts, "licence-texts")
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.concat(
        F.slice("words", F.lit(1), k), F.slice("words", k + 2, F.size("words"))
    ))
    made = F.concat(F.array("words"), F.when(F.size("words") > 4, cut).otherwise(F.array("words")))
    sentences = rows.select("family", F.explode(made).alias("words")).select("family", grams(F.col("words")).alias("grams"))
    names = licence_names()
    short = statements(IDENTIFIERS, ("{} licensed", "{}-licensed code", "{} licensed software", "The project is {} licensed", "Released under {}"))
    told = [x for x in statements(names, FORMS) if x[1] != "MIT"] + short
    return sentences.unionByName(_table(spark, told, "licence-names").select("family", "grams"))


def _in_context(unknown: DataFrame, many: int) -> DataFrame:
    """Labelled paragraphs with a weight: a name behind the first known n-grams of each of ``many`` paragraphs, so words around a name count little."""
    spark = unknown.sparkSession
    names = [(family, name) for family, all_of in licence_names().items() for name in all_of if name != "MIT"]
    path = scratch_path(spark, "licence-listed")
    spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "id long, family string, line string").coalesce(1).write.parquet(path)
    listed = spark.read.parquet(path).select("id", "family", grams(tokens(F.col("line"))).alias("name"))
    dealt = unknown.select(F.pmod(F.shiftright("order", 1), F.lit(len(names))).alias("id"), F.slice("grams", 1, CONTEXT).alias("before"))
    met = dealt.groupBy("id", "before").agg(F.count("*").alias("n")).join(F.broadcast(listed), "id")
    weight = F.col("n") * (TOLD_WEIGHT * min(1.0, CONTEXTS * len(names) / max(1, many)))
    return met.select("family", F.array_distinct(F.concat("before", "name")).alias("grams"), weight.alias("weight"))


def sampled(lines: DataFrame, text_bytes: int) -> DataFrame:
    """``line, order``: SAMPLE distinct whole paragraphs in the order of a hash, within SAMPLE_BYTES.

    A paragraph that the bytes left have no room for is passed over. Written. For a look
    at the paragraphs of a corpus; ``fit`` reads them all.
    """
    # about four times as many paragraphs as needed, of LINE_BYTES on average
    low = min(1.0, 4 * SAMPLE / max(1.0, text_bytes / LINE_BYTES))
    hashed = lines.select(F.col("_line").alias("line"), F.xxhash64("_line").alias("order")).where(F.length("line") > 0)
    taken = settle(hashed.where(F.col("order") <= F.lit(min((1 << 63) - 1, int((low - 0.5) * (1 << 64))))), "licence-taken")
    sizes = taken.groupBy("order").agg(F.max(F.octet_length("line")).alias("n")).orderBy("order").limit(SAMPLE).collect()
    room, over, last = SAMPLE_BYTES, [], None
    for r in sizes:  # SAMPLE pairs of numbers
        last = r["order"]
        if r["n"] > room:
            over.append(last)
        else:
            room -= r["n"]
    chosen = taken.where(F.col("order") <= F.lit(last)) if sizes else taken.limit(0)
    return settle((chosen.where(~F.col("order").isin(over)) if over else chosen).dropDuplicates(["order"]), "licence-chosen")


@dataclass
class Scanner:
    """A fitted classifier: coefficients, classes, intercepts, least probability of a hit, templates and marks."""

    table: DataFrame  # gram, c_<class>
    classes: list[str]
    start: dict[str, float]
    least: float
    templates: Column  # array of (family, grams)
    marks: list[str]
    confirmed: DataFrame  # the paragraphs that a template confirms, with their known grams and n_grams


def _heads(templates: list[list[str]], counts: dict[str, int]) -> list[str]:
    """N-grams of which a paragraph has one if it has CONFIRM of a template: of each, the rarest ones that may not all be missing."""
    out = set()
    for listed in templates:
        needed = math.ceil(CONFIRM * len(listed))
        out |= set(sorted(listed, key=lambda g: (counts.get(g, 0), -len(g), g))[: len(listed) - needed + 1])
    return sorted(out)


def _counted(bags: DataFrame, number: Column, listed: list[str]) -> dict[str, int]:
    """How many paragraphs have each n-gram of ``listed``, which is of fixed values."""
    each = bags.select(F.explode("grams").alias("gram"), number.alias("n")).where(F.col("gram").isin(listed))
    return {r["gram"]: r["n"] for r in each.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def _alike(lines: DataFrame, templates: Column, listed: list[list[str]]) -> DataFrame:
    """``grams, n_grams`` of the paragraphs of which a template has enough, each once.

    Either they have one of ``_heads``, or the n-grams of templates are CONFIRM of
    their own; all templates are compared with these only.
    """
    every = sorted({g for t in listed for g in t})
    heads = _heads(listed, _counted(lines, F.lit(1), every))
    shared = F.size(F.filter("grams", lambda g: g.isin(every)))
    near = lines.where(F.col("n_grams").isNotNull()).where(_has("grams", heads) | (shared >= CONFIRM * F.col("n_grams")))
    return settle(
        near.select("grams", "n_grams").distinct().where(F.exists(templates, lambda t: _likeness(t["grams"]) >= CONFIRM)), "licence-alike"
    )


def least_probability(found: DataFrame, of: int) -> float:
    """Smallest multiple of one in STEPS that at most PASSING of ``of`` paragraphs reach; ``probability, n`` are those of equal ones."""
    steps = found.groupBy(F.floor(F.col("probability") * STEPS).alias("step")).agg(F.sum("n").alias("n"))
    room = PASSING * of
    for r in steps.orderBy(F.desc("step")).collect():  # STEPS rows and one at most
        room -= r["n"]
        if room < 0:
            return min(1.0, (r["step"] + 1) / STEPS)
    return 0.0


def fit(documents: DataFrame, text: str, lines: DataFrame) -> Scanner:
    """Fit and calibrate the classifier on ``lines``, the ``paragraphs`` of ``documents``.

    The unknown class is every different paragraph, half of them held out for the
    least probability. Those that a template would confirm are left out: they
    would be licences with the wrong label.
    """
    spark = lines.sparkSession
    families = sorted(TEXTS)
    known = template_table(spark)
    listed = known.select("family", "grams").collect()  # fixed values
    templates = F.from_json(F.lit(json.dumps([r.asDict() for r in listed])), "array<struct<family string, grams array<string>>>")
    of_templates = [r["grams"] for r in listed]
    every = sorted({g for t in of_templates for g in t})
    made = _made(spark)
    vocabulary = sorted({*every, *(r["gram"] for r in made.select(F.explode("grams").alias("gram")).distinct().collect())})  # fixed values

    # one pass over the texts; the number of all n-grams is needed of those only that a template may confirm
    words = lines.where(F.length("_line") > 0).withColumn("words", tokens(F.col("_line")))
    cut = words.withColumn("grams", known_grams(F.col("words"), vocabulary))
    shared = F.size(F.filter("grams", lambda g: g.isin(every)))
    near = (F.size("grams") > 0) & (_has("grams", _heads(of_templates, {})) | (shared >= CONFIRM * F.size(F.array_distinct("words"))))
    cut = settle(cut.select(
        *(c for c in lines.columns if c != "_line"), F.when(F.size("words") > 0, F.xxhash64("_line")).alias("order"), "grams",
        F.when(near, F.size(grams(F.col("words")))).alias("n_grams"),
    ), "licence-lines")
    alike = _alike(cut, templates, of_templates)
    alike = broadcast_if_small(alike, 1024)
    unlike = cut.where(F.col("order").isNotNull()).join(alike, ["grams", "n_grams"], "left_anti").select("order", "grams")
    unknown = settle(unlike.distinct(), "licence-unknown")
    held = F.pmod("order", F.lit(2)) == 0
    bags = settle(unknown.groupBy(held.alias("held"), "grams").agg(F.count("*").alias("n")), "licence-bags")
    many = {r["held"]: r["n"] for r in bags.groupBy("held").agg(F.sum("n").alias("n")).collect()}
    counts = _counted(bags, F.col("n"), every)
    most = max(FEW, RARE * sum(many.values()))
    rare = [g for g in every if counts.get(g, 0) <= most]

    trained = many.get(False, 0)
    weight = F.col("n") * min(1.0, UNKNOWN_WEIGHT / max(1, trained))
    rows = spread(
        made.withColumn("weight", F.lit(TOLD_WEIGHT)).unionByName(_in_context(unknown.where(~held), trained))
        .unionByName(bags.where("NOT held").select(F.lit(UNKNOWN).alias("family"), "grams", weight.alias("weight")))
        .withColumn("label", F.array_position(F.array(*map(F.lit, [*families, UNKNOWN])), F.col("family")) - 1.0),
        "licence-rows",
    )
    bagged = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    model = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", maxIter=30, regParam=0.002,
        elasticNetParam=0.5,
    ).fit(bagged.transform(rows).select("features", "label", "weight"))
    matrix = model.coefficientMatrix.toArray()
    classes = [*families, UNKNOWN][: matrix.shape[0]]
    coefficients = [
        (vocabulary[j], *(float(x) for x in matrix[:, j])) for j in range(len(vocabulary)) if abs(matrix[:, j]).max() > 1e-9
    ]
    path = scratch_path(spark, "licence-coefficients")
    names = ", ".join(["gram string", *(f"c_{c} double" for c in classes)])
    spark.createDataFrame(coefficients, names).coalesce(1).write.parquet(path)
    table = spark.read.schema(names).parquet(path)
    start = {c: float(x) for c, x in zip(classes, model.interceptVector.toArray())}
    numbered = bags.where("held").select(F.monotonically_increasing_id().alias("id"), "grams", "n")
    high = least_probability(scored(numbered, ["id", "n"], table, classes, start), many.get(True, 0))
    at = classes.index(UNKNOWN)
    for_licence = {g for g, *c in coefficients if max(c[:at] + c[at + 1:]) > c[at]}
    marks = [g for g in rare if g in for_licence]
    return Scanner(table, classes, start, max(LEAST, high), templates, marks, cut.join(alike, ["grams", "n_grams"], "left_semi"))


def scored(rows: DataFrame, key: list[str], table: DataFrame, classes: list[str], start: dict[str, float]) -> DataFrame:
    """``key, family, probability``: the likeliest family of each row that has a known n-gram, unknown aside."""
    met = rows.select(*key, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")  # n-grams of the statements
    total = met.groupBy(*key).agg(*(F.sum(f"c_{c}").alias(f"s_{c}") for c in classes))
    logit = {c: F.col(f"s_{c}") + F.lit(start[c]) for c in classes}
    top = F.greatest(*logit.values())
    norm = sum((F.exp(x - top) for x in logit.values()), F.lit(0.0))
    best = F.array_max(F.array(*(F.struct((F.exp(x - top) / norm).alias("p"), F.lit(c).alias("family")) for c, x in logit.items() if c != UNKNOWN)))
    return total.select(*key, best.alias("best")).select(*key, F.col("best.family").alias("family"), F.col("best.p").alias("probability"))


def find_licences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, paragraph, family, probability, likeness``: each licence statement.

    A paragraph is a hit when the likeliest family reaches the calibrated probability and one
    of its templates confirms it: ``likeness`` is the larger share of n-grams
    that the two have in common, CONFIRM at least, and the paragraph has a mark: an n-gram of the
    templates that is rare in the corpus and speaks for a licence. Of equally likely families the
    last by name counts. All other paragraphs are of the unknown class and have no row.
    Null and empty texts have no paragraphs; rows that are equal in key and text give
    one set of hits, other columns are ignored.
    """
    rows = documents.select(F.struct(F.col(key).alias("k")).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    lines = paragraphs(rows, "_text")
    scan = fit(rows, "_text", lines)
    ready = settle(scan.confirmed.where(_has("grams", scan.marks)), "licence-marked")
    found = scored(ready, ["_key", "_hash", "paragraph"], scan.table, scan.classes, scan.start).where(F.col("probability") >= scan.least)
    likeness = F.aggregate(
        scan.templates, F.lit(0.0),
        lambda best, t: F.when(t["family"] == F.col("family"), F.greatest(best, _likeness(t["grams"]))).otherwise(best),
    )
    return (
        found.join(ready.dropDuplicates(["_key", "_hash", "paragraph"]), ["_key", "_hash", "paragraph"])
        .withColumn("likeness", F.round(likeness, 4)).where(F.col("likeness") >= CONFIRM)
        .select(F.col("_key.k").alias(key), "paragraph", "family", F.round("probability", 4).alias("probability"), "likeness")
    )


def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence statements of every document."""
    return find_licences(spark.read.parquet(f"{folder}/documents.parquet"))
