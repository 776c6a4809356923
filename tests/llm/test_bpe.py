import random

import numpy as np
import pytest

from versetide.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.vocabulary()


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def tricky(rng, n):
    pieces = ["a", " b", "  ", "\n", "\n\n ", "'s", "'ll", "é", " ñandú", "日本", "🙂", "<|endoftext|>", "<|endof", "text|>", "123", " 4", "--", "\t",
              " ", " x", "The", " the", " quick", "ß", "\r\n", "\x00", "́"]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_encoder_and_decoder_equal_the_library(library):
    rng = random.Random(3)
    code = bpe.codec(PATH)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 400] * 12:
        text = tricky(rng, n)
        expected = library.encode(text, add_special_tokens=False).ids
        got = code.encode(text.encode())
        assert got.tolist() == expected
        assert code.decode(got) == library.decode(expected, skip_special_tokens=False)


def test_every_character_is_split_alike(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    code = bpe.codec(PATH)
    for start in range(0, len(points), 5000):
        text = "".join(f"a{c}1 {c}b" for c in points[start : start + 5000])
        assert code.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_assembly_from_chunks_equals_whole(library):
    rng = random.Random(8)
    code = bpe.codec(PATH)
    for trial in range(300):
        text = tricky(rng, 60) if trial % 2 else " ".join(rng.choice(["word", "Tree", "x1", "it's", "né", "", "\n"]) for _ in range(80))
        row = text.encode()
        starts = [i for i in range(1, len(row)) if row[i] & 0xC0 != 0x80]
        cut = np.array([0, *sorted(rng.sample(starts, min(len(starts), rng.randrange(6)))), len(row)])
        known = {k: code.encode(row[cut[k] : cut[k + 1]]) for k in range(len(cut) - 1) if rng.random() < 0.6}
        assert bpe.assemble(row, cut, known, code).tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta's", "1999", "état", "<|endoftext|>"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(2500))
    texts = [None, "", "x", "x", passage, passage, "intro " + passage, passage + " end", "a" + passage[3000:], tricky(rng, 500), "no spaces" * 900]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(4, passage, 0), (5, "other text", 0), (None, passage, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), r.decoded) for r in bpe.encode(docs, PATH).collect())
    expected = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((-1 if key is None else key, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)
    pieces = bpe.shared_chunks(docs.where("doc_id >= 6"), PATH, "doc_id", "text").collect()
    assert {6, 7, 8} <= {r["_key"] for r in pieces}  # chunks are shared although the texts begin differently


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
