import random

import numpy as np
import pytest

from versetide.llm import decontaminate as D


def best(equal):
    return max((j - i for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)
                if sum(equal[i:j]) * 100 >= D.LEAST * (j - i)), default=0)


def test_best_overlap_is_the_longest():
    rng = random.Random(1)
    for _ in range(500):
        equal = np.array([rng.random() < rng.choice([0.3, 0.7, 0.9]) for _ in range(rng.randrange(1, 30))])
        start, length, same = D.best_overlap(equal)
        assert length == best(equal.tolist()) and same == equal[start : start + length].sum()


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, leaks string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: {x["item"]: x for x in r.leaks} for r in D.with_leaks(d, b).collect()}


@pytest.fixture(scope="module")
def rng():
    return random.Random(4)


def test_planted_passages(spark, rng, monkeypatch):
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([15, 20, 30, 59, 400, 6, 3, 1])] + [(90, None), (91, ""), (92, "...")]
    def changed(t, k):
        w = t.split()
        for at in rng.sample(range(len(w)), k):
            w[at] = "changed"
        return " ".join(w)
    docs, expected = [], {}
    for i, t in items[:5]:
        for k, body in enumerate((t, t.upper().replace(" ", ",  "), changed(t, len(t.split()) // 10), " ".join(t.split()[1:-1]))):
            key = i * 10 + k
            docs.append((key, f"{text(40)}. {body}! {text(40)}", "x"))
            if len(body.split()) >= D.MIN_WORDS:
                expected[key] = i
    docs += [(200, text(3000), ""), (201, None, ""), (202, "", ""), (203, items[5][1] + " and " + items[6][1], ""), (206, items[6][1] + "!", ""), (207, items[7][1], ""),
             (204, " ".join(items[3][1].split()[:9]), ""), (205, changed(items[3][1], 25), "")]
    for blocks in (D.BLOCK_WORDS, 60):
        monkeypatch.setattr(D, "BLOCK_WORDS", blocks)
        got = leaks(spark, docs, items)
        assert len(got) == len(docs)
        for key, _, _ in docs:
            if key in expected:
                assert expected[key] in got[key], key
                assert got[key][expected[key]]["first_word"] in range(38, 43)
        assert not got[200] and not got[201] and not got[202] and not got[204] and not got[205]
        assert set(got[203]) == {5} and set(got[206]) == {6} and set(got[207]) == {7}


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, "a b c")]) == {}
    assert leaks(spark, [(1, "a b c", "")], []) == {1: {}}


def test_repeated_rows_and_ties(spark, rng):
    t = " ".join(f"u{k}" for k in range(20))
    d = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    b = spark.createDataFrame([(5, t), (6, t), (None, t)], "item_id long, text string")
    got = [sorted(x["item"] for x in r.leaks) for r in D.with_leaks(d, b).collect()]
    assert got == [[-1, 5, 6], [-1, 5, 6]]


def test_short_items_with_any_word_changed(spark):
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in (5, 6, 7)}
    texts, expected = [], []
    for n, words in items.items():
        for k in range(n):
            changed = [*words[:k], "other", *words[k + 1 :]]
            expected.append((len(texts), n, 3, n, n - 1))
            texts.append("in front of " + " ".join(changed) + " and behind it")
        texts.append(" ".join(["other", "more", *words[2:]]))  # two words of seven are too many
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = [
        (r.doc_id, x.item, x.first_word, x.words, x.equal_words) for r in D.with_leaks(docs, bench).collect() for x in r.leaks
    ]
    assert sorted(got) == sorted(expected)
