import re
from collections import Counter

from versetide.llm import quality as Q


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", "  \n\t", "one", "a b c a b c", "a b a b a b a b", "x\ny\nx\n \n\nx", "é ñ # ** $5 <b>", "a\x0bb\x0cc\rd\te",
    "non breaking thin", "w " * 500, "line one\r\nline one\r\n", "a b c d a b c", "🙂 🙂 🙂 🙂",
]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in Q.text_features(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), text


def test_verdict(spark):
    good = [" ".join(f"w{(i * 7 + k * k) % 90}" for k in range(80)) for i in range(30)]
    bad = [" ".join(f"w{(i * 7 + k * k) % 90}##" for k in range(80)) for i in range(10)]
    rows = list(enumerate(good + bad + ["w1 w2", "w1 w2 w3 " * 60, None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(30)] * 3 + [(None,), (9999,)], "doc_id long")
    got = {r.doc_id: r for r in Q.judge_quality(docs, trusted).collect()}
    assert all(got[i].kept for i in range(30))
    assert not any(got[i].kept or got[i].base_failed for i in range(30, 40))
    assert all(got[i].base_failed and not got[i].kept for i in (40, 41, 42))


def test_repeated_rows_no_labels_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = Q.judge_quality(docs, none).collect()
    assert [r.kept for r in got] == [True] * 3
    assert Q.judge_quality(docs.limit(0), none).count() == 0
