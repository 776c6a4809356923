import math

import pytest
from pyspark.sql import functions as F

from versetide.llm import licenses as L

PROSE = [f"The {a} of the {b} went with {c} through the old town, and the {b} said nothing of {a}."
         for a in ("man", "king", "road", "house", "word") for b in ("tree", "field", "boat", "horse") for c in ("care", "haste", "grace", "song")]
# none of these is a form of the training set
HELD_OUT = (
    "Released under the {}.", "This work is licensed under the {}.", "Code is available under the {}.", "Published under {}",
    "You may redistribute this software under the terms of the {}.", "This package is covered by the {}", "Please see the {} for details.",
    "The whole library is offered under the {} to everybody", "Copyright 2020 Jane Doe, {}", "It comes with the {}",
)
SENTENCES = [
    ("mit", "MIT licensed."), ("gpl", "You may redistribute this software under the terms of the GPL v3."),
    ("apache", "Code is available under the Apache-2.0 licence."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("apache", "each Contributor hereby grants to You a perpetual, worldwide, royalty-free copyright license to reproduce the Work"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice and this list of conditions"),
    ("mpl", "This Source Code Form is subject to the Mozilla Public License, v. 2.0"),
    ("reserved", "© Jane Doe 2021. All rights reserved."), ("cc", "You must give appropriate credit and indicate if changes were made"),
]
# the bare identifier is a word of other languages
TOLD = [x for x in L.statements(L.licence_names(), HELD_OUT) if " MIT" not in x[1] or "MIT Licen" in x[1] or "MIT/" in x[1] or "MIT-" in x[1]]
NAMED, SAID, LONG, CORPUS = 10_000, 30_000, 40_000, 50_000  # ids of the rows with these statements


@pytest.fixture(scope="module")
def found(spark):
    prose = PROSE
    rows = [(i, f"{t}\n{prose[-i]}", 1) for i, t in enumerate(prose)]
    rows += [
        (1000, f"{prose[0]}\nReleased under the MIT License.\n{prose[1]}", 0), (1001, "Licensed under the Apache License, Version 2.0.", 0),
        (1002, "© Someone 2020. All rights reserved.", 0), (1003, "This work is licensed under the GNU General Public License, version 3.", 0),
        (1004, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", 0), (1005, "LICENSED UNDER THE BSD 3-CLAUSE LICENSE", 0),
        (1006, None, 0), (1007, "", 0), (1008, "The general public went to the free concert under the open sky.", 0),
        (1009, "My driving license was released by the office.", 0), (None, "Released under the MIT License.", 0),
        (1010, "Released under the MIT License.", 0), (1010, "Released under the MIT License.", 0),
    ]
    rows += [(NAMED + i, t, 0) for i, (_, t) in enumerate(TOLD)] + [(SAID + i, t, 0) for i, (_, t) in enumerate(SENTENCES)]
    rows += [(LONG, " ".join(PROSE) * 100 + "\n" + "word " * 200_000 + "\nReleased under the MIT License.", 0)]
    corpus = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows += [(CORPUS + i, t, 0) for i, t in enumerate(corpus)]
    # columns that clash with names of the result and of its steps
    docs = spark.createDataFrame(rows, "doc_id long, text string, family int").selectExpr("*", "1 AS paragraph", "'x' AS _line", "0.5 AS probability")
    return [(r.doc_id, r.paragraph, r.family) for r in L.find_licences(docs).collect()]


def test_families(found):
    assert sorted(x for x in found if x[0] is not None and x[0] < NAMED) == [
        (1000, 1, "mit"), (1001, 0, "apache"), (1002, 1, "reserved"), (1003, 0, "gpl"), (1004, 0, "cc"), (1004, 1, "mit"), (1005, 0, "bsd"),
        (1010, 0, "mit"),
    ]


def test_a_row_without_key_is_found(found):
    assert found.count((None, 0, "mit")) == 1


def test_empty_table(spark):
    assert L.find_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_on_forms_that_are_not_trained(found):
    assert not {t.rstrip('.') for _, t in TOLD} & {t for _, t in L.statements(L.licence_names(), L.FORMS)}
    hits = {(i - NAMED, family) for i, _, family in found if i is not None and NAMED <= i < SAID}
    recall = {
        family: sum((i, family) in hits for i, (f, _) in enumerate(TOLD) if f == family) / sum(f == family for f, _ in TOLD)
        for family in L.NAMES
    }
    assert min(recall.values()) >= 0.9, recall
    wrong = [(TOLD[i], family) for i, family in hits if TOLD[i][0] != family]
    assert len(wrong) <= len(TOLD) / 50, wrong


def test_statements_and_sentences(found):
    hits = {(i - SAID, family) for i, _, family in found if i is not None and SAID <= i < LONG}
    assert [(f, t) for i, (f, t) in enumerate(SENTENCES) if (i, f) not in hits] == []


def test_very_long_text(found):
    assert [x[2] for x in found if x[0] == LONG] == ["mit"]


def test_scores_equal_a_plain_sum(spark):
    docs = spark.createDataFrame([(i, f"{t}\n{PROSE[i]}") for i, (_, t) in enumerate(SENTENCES)], "doc_id long, text string")
    lines = L.paragraphs(docs, "text")
    scan = L.fit(docs, "text", lines)
    ready = lines.select("doc_id", "paragraph", L.grams(L.tokens(F.col("_line"))).alias("grams"))
    found = {(r.doc_id, r.paragraph): r for r in L.scored(ready, ["doc_id", "paragraph"], scan.table, scan.classes, scan.start).collect()}
    weights = {r["gram"]: r for r in scan.table.collect()}
    for r in ready.collect():
        known = [weights[g] for g in r.grams if g in weights]
        if not known:
            assert (r.doc_id, r.paragraph) not in found
            continue
        logit = {c: scan.start[c] + sum(w[f"c_{c}"] for w in known) for c in scan.classes}
        norm = sum(math.exp(x) for x in logit.values())
        p, family = max((math.exp(x) / norm, c) for c, x in logit.items() if c != L.UNKNOWN)
        got = found.pop((r.doc_id, r.paragraph))
        assert got.family == family and abs(got.probability - p) < 1e-9
    assert not found


def test_sample_takes_whole_paragraphs_within_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_BYTES", 5000)
    texts = ["x" * 4000, "y" * 6000, *("z" * 100 + str(i) for i in range(20))]
    lines = spark.createDataFrame([(t,) for t in texts * 2], "_line string")
    got = [r.line for r in L.sampled(lines, 1).collect()]
    assert len(got) == len(set(got)) and set(got) <= set(texts) and "y" * 6000 not in got
    assert sum(map(len, got)) <= 5000 and len(got) >= 10


def test_every_paragraph_is_counted(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 2)
    texts = [f"The {i}th of them {t[4:]}" for i in range(5) for t in PROSE] + [f"They spoke of noninfringement on day {i} in the garden" for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scan = L.fit(docs, "text", L.paragraphs(docs, "text"))
    assert "noninfringement" not in scan.marks and "irrevocable" in scan.marks


def test_least_probability_is_exact(spark):
    rows = [(i / 977, 1 + i % 7) for i in range(977)]
    found = spark.createDataFrame(rows, "probability double, n long").repartition(3)
    for of in (10**3, 10**5, 10**6, 2 * 10**7):
        got = L.least_probability(found, of)
        passing = lambda least: sum(n for p, n in rows if p >= least)
        assert passing(got) <= L.PASSING * of and (got == 0 or passing(got - 1 / L.STEPS) > L.PASSING * of)
    assert L.least_probability(found.limit(0), 0) == 0


def test_known_grams_are_those_of_grams(spark):
    words = F.array(*map(F.lit, "by the gpl the gpl by by the".split()))
    row = spark.range(1).select(words.alias("w")).select(
        L.known_grams(F.col("w"), ["by", "gpl", "the gpl", "by the", "gpl x"]).alias("known"), L.grams(F.col("w")).alias("all")
    ).first()
    assert row.known == [g for g in row.all if g in ("by", "gpl", "the gpl", "by the")]
