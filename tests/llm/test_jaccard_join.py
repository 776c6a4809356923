import random

import numpy as np
import pytest

from versetide.llm import jaccard_join as J


def brute(rows):
    """Component of each row by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 85 * len(sets[i] | sets[k]):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, len(s), least[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets)))


def family(rng, words, copies, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = f"x{rng.randrange(10**6)}"
            elif kind == 1:
                w = w[: max(1, len(w) - rng.randrange(1, 4))]
            else:
                w.append(f"y{rng.randrange(10**6)}")
        yield " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "one two", "a b c d", "A b\tc d", "a b c d e"]
    for words in [*range(4, 40), 60, 90, 150, 400]:
        texts += family(rng, words, 8, max(1, words // 12))
    texts += family(rng, 60, 120, 4)  # many near copies of one text
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} {t}" for t in family(rng, 50, 30, 40)]
    rng.shuffle(texts)
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in J.jaccard_components(docs).collect())
    assert got == brute(rows)


def test_chunked_comparison_of_one_hub(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 7)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 80, 90, 14)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in J.jaccard_components(docs).collect()) == brute(rows)


def test_repeated_rows_nulls_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 9), (1, text, 8), (None, text, 7), (2, None, 6), (2, None, 6), (3, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(J.jaccard_components(docs).collect(), key=str)
    assert len(got) == 6
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {
        (1, 27, 1), (None, 27, 1), (2, 0, 2), (3, 0, 3)
    }


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_beside_short_ones(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**9)}" for _ in range(200_000)]
    other = long[:5000] + ["z"] + long[5001:]
    rows = [(7, " ".join(long)), (4, " ".join(other)), (5, "short text of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == {7: 4, 4: 4, 5: 5}


def test_lists_that_cross_batches():
    import pyarrow as pa

    rows = [(1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2), (4, 3), (5, 1), (6, 1)]
    for size in (1, 2, 3, 9):
        parts = [pa.RecordBatch.from_pylist([{"key": k, "set": s} for k, s in rows[i : i + size]]) for i in range(0, 9, size)]
        kept = [(r["key"], r["set"]) for b in J._long_lists(iter(parts)) for r in b.to_pylist()]
        assert kept == [(1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (6, 1)]


def test_components_of_another_width_and_share_equal_all_pairs(spark):
    rng = random.Random(5)
    texts = ["a b c d", "A b c d", "a b c d e"]
    for words in [*range(5, 40, 2), 60, 90, 150, 400]:
        texts += family(rng, words, 8, max(1, words // 12))
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]) and root[i] != root[k]:
                a, b = sorted((root[i], root[k]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in J.jaccard_components(docs, least=80, width=5).collect())
    assert got == [(i, len(s), root[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("least", [80, 85])
def test_sets_of_all_sizes_do_without_the_common_list(least):
    plan, rng = J.Plan(least), np.random.default_rng(3)
    for n in [*range(plan.light, 120), 200, 406, 700, 1500, 3000]:
        keys = J.set_keys(rng.integers(0, 1 << 63, n).astype(np.uint64), plan)
        assert keys.min() > 1 << 20 and len(keys) < 5 * n, n
