import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from versetide.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
PATHS = alignment.vocabularies()
TEXTS = [
    None, "", " ", "a", "Hello world", "hello  world\n\nagain", "naïve Café — 日本語 🙂", "<|endoftext|> <s> </s> <unk>", "<0x41>", "ﬁne ①",
    "tab\tand\x00null", " leading", "trailing ", "▁ piece mark", "é combined", "Ünïcödé " * 30, "the quick brown fox " * 40, "x" * 3000, "\r\n　wide",
]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens_of(text):
    """Ids and byte lengths by the libraries, written out plainly."""
    import sentencepiece

    left = tokenizers.Tokenizer.from_file(PATHS[0])
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    if not text:
        return None
    a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
    a_bytes = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    return a, b, [len(x) for x in a_bytes], [len(x) for x in b_bytes]


def brute(texts):
    docs = []
    for text in texts:
        found = tokens_of(text)
        if found is None:
            docs.append((0, 0, [], []))
            continue
        a, b, la, lb = found
        ea, eb = np.cumsum(la).tolist(), np.cumsum(lb).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        links = [(a[p], b[q]) for p in range(len(a)) for q in range(len(b)) if ea[p] - la[p] < eb[q] and eb[q] - lb[q] < ea[p]]
        docs.append((len(a), len(b), groups, links))
    held = Counter(pair for *_, links in docs for pair in set(links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for n_a, n_b, groups, links in docs
    ]


@pytest.mark.parametrize("sent_bytes", [alignment.SENT_BYTES, 0])
def test_equals_brute_force(spark, sent_bytes):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(3, "a", 0, 0), (3, "a", 0, 0), (None, "Hello world", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs int, n_a int").repartition(3)
    got = alignment.link_digests(docs, PATHS, sent_bytes=sent_bytes).collect()
    expected = [(r[0], *e) for r, e in zip(rows, brute([r[1] for r in rows]))]
    assert sorted(map(str, ((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got))) == sorted(map(str, expected))


def test_runs_and_irregular_groups():
    rng = random.Random(9)
    for _ in range(300):
        total = rng.choice([1, 2, 5, 40, 400])
        thin = rng.random()
        left, right = (sorted({e for e in range(1, total) if rng.random() < d} | {total}) for d in (rng.random(), thin))
        if rng.random() < 0.5:  # mostly one to one
            right = [e for e in left if rng.random() < 0.95 or e == total]
        a_ends, b_ends, a_links, b_links = alignment.align(left, right)
        both = sorted(set(left) & set(right))
        assert [left[k - 1] for k in a_ends] == both == [right[k - 1] for k in b_ends]
        starts = [0, *left[:-1]], [0, *right[:-1]]
        expected = [(p, q) for p in range(len(left)) for q in range(len(right)) if starts[0][p] < right[q] and starts[1][q] < left[p]]
        assert sorted(zip(a_links, b_links)) == expected


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "Hello wonderful world"), (2, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in alignment.aligned(docs, PATHS, keep=("doc_id",)).collect()}
    a, b, la, lb = tokens_of("Hello wonderful world")
    assert rows[1]["a_ids"] == a and rows[1]["b_ids"] == b
    assert np.cumsum(la)[np.array(rows[1]["a_ends"]) - 1].tolist() == np.cumsum(lb)[np.array(rows[1]["b_ends"]) - 1].tolist()
    assert rows[2]["a_ids"] == rows[2]["b_ends"] == []


def test_very_long_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "Ein Satz mit Wörtern. " * 40_000)], "doc_id bigint, text string")
    row = alignment.link_digests(docs, PATHS).collect()[0]
    assert row["n_groups"] > 100_000 and row["count_sum"] == row["n_links"]
    assert alignment.link_digests(docs.limit(0), PATHS).collect() == []


def test_counts_are_handed_out_in_bounded_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "PAIRS_HELD", 8)
    rng = random.Random(1)
    lists = [sorted(rng.sample(range(40), rng.randint(0, 12))) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 7], pa.list_(pa.int64()))], ["pairs"]) for i in range(0, 60, 7)]
    out = list(alignment._adder(batches))
    assert len(out) > 1
    total = Counter()
    for batch in out:
        for p, n in zip(batch.column("pair").to_pylist(), batch.column("texts").to_pylist()):
            total[p] += n
    assert total == Counter(x for row in lists for x in row)
