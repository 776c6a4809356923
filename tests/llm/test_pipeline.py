import random

import pytest

import corpus_pipeline as P
from versetide.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(1)
    words = {lang: ["".join(rng.choice(sounds) for _ in range(rng.randrange(2, 5))) for _ in range(300)]
             for lang, sounds in (("en", ["th", "er", "wh", "ou"]), ("fr", ["é", "eau", "oi", "qu"]))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    item = text("en", 30)
    rows = [(i, text(("en", "fr")[i % 2], 120), ("en", "fr")[i % 2], "s") for i in range(40)]
    near = rows[4][1].split()
    near[50] = "changed"
    key = "0123456789abcdef" * 2
    rows += [
        (40, rows[3][1], "fr", "s"), (41, " ".join(near), "en", "s"), (42, "### *** 123 !!!", "en", "s"), (43, None, "en", "s"),
        (44, text("en", 60) + " " + item + " " + text("en", 60), "en", "s"),
        (45, text("en", 60) + f' token = "{key}" ' + text("en", 60), "en", "s"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {r[0]: r for r in rows}, key


def test_decisions_take_effect(spark, folder):
    path, rows, key = folder
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    got = {r.doc_id: r for r in P.run(spark, path).collect()}
    # 40 and 41 copy 3 and 4; 42 and 43 have no letters; 44 holds a test item
    assert set(got) == set(range(40)) | {45}
    for i, r in got.items():
        text = rows[i][1].replace(f'token = "{key}', "[secret]") if i == 45 else rows[i][1]
        expected = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(expected) and list(memoryview(bytes(r.ids)).cast("I")) == expected


def test_stages_return_the_columns_of_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, path).schema.simpleString() == docs.schema.simpleString(), name


def test_an_empty_table_passes_all_stages(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, path).count() == 0


@pytest.mark.parametrize("copy, shared, union", [
    (lambda w: w[:100] + [f"y{i}" for i in range(22)], 96, 118),
    (lambda w: w[:100] + [f"y{i}" for i in range(24)], 96, 120),
    (lambda w: w[:100] + [f"y{i}" for i in range(25)], 96, 121),
    (lambda w: [f"y{i}" if i % 45 == 20 else x for i, x in enumerate(w)], 361, 451),
    (lambda w: [f"y{i}" if i % 40 == 20 else x for i, x in enumerate(w)], 356, 456),
])
def test_near_copies_share_four_fifths_of_their_runs_of_five_words(spark, folder, copy, shared, union):
    path, _, _ = folder
    long = [f"w{i}" for i in range(410)]
    changed = copy(long)
    base = long if len(changed) == 410 else long[:100]
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, changed))
    assert (len(a & b), len(a | b)) == (shared, union)
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in ((7, base), (9, changed))], COLUMNS)
    got = {r.doc_id for r in dict(P.STAGES)["near_copies"](spark, docs, path).collect()}
    assert got == ({7} if 5 * shared >= 4 * union else {7, 9})
