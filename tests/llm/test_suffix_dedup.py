import random

import numpy as np
import pyarrow as pa
import pytest

from versetide.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            gram = data[p : p + 50]
            first[gram] = min(first.get(gram, key), key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < key:
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((key, len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out)


def result(docs):
    return sorted((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in S.remove_repeats(docs).collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "short", text(3), "a" * 200, "a" * 300, "ab" * 120, "ba" * 120]
    passages = [text(n) for n in (8, 9, 10, 11, 12, 20, 60, 200)]
    passages += [p.encode()[: 49 + k].decode(errors="ignore") for k, p in enumerate(passages[3:] * 2)]
    for _ in range(150):
        texts.append(" ".join(rng.choice([text(rng.randrange(30)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))))
    texts += [t for t in texts if t and rng.random() < 0.2]
    for t in list(texts[20:60]):  # one byte differs
        k = rng.randrange(len(t) or 1)
        texts.append(t[:k] + "Z" + t[k + 1 :])
    rng.shuffle(texts)
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(docs) == brute(rows)


def test_long_texts_in_pieces_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(S, "SORT_ROWS", 40)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(docs) == brute(rows)


def test_pieces_cover_every_window(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 300)
    part = pa.RecordBatch.from_pydict({"text": ["x" * 1234]})
    seen = set()
    for data, bounds, start in S._pieces(part, "text", 50):
        first, last, *_ = S.stretches(data, bounds)
        for a, b in zip(first, last):
            seen |= set(range(start + a, start + b + 1))
    assert seen == set(range(1234 - 49))


def test_one_text_longer_than_a_piece(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(S.PIECE + 100_000))
    rows = [(9, long), (2, "intro " + long[1000:5000] + " middle " + long[S.PIECE - 300 : S.PIECE + 300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes - len(r.kept), len(r.spans)) for r in S.remove_repeats(docs).collect()}
    assert got[2] == (0, 0) and got[9][1] == 2 and 4600 <= got[9][0] < 4610


def test_repeated_rows_equal_keys_and_clashing_columns(spark):
    text = "the same words again and again, " * 4
    rows = [(1, text, 0), (1, text, 0), (2, text, 0), (2, text + "more", 0), (None, text, 0), (None, text, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r.doc_id or 99), len(r.kept)) for r in S.remove_repeats(docs).collect())
    assert got == [(1, len(text)), (1, len(text)), (2, 0), (2, 4), (99, 0), (99, 0)]


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_ranks_spread_over_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 10**6)
    monkeypatch.setattr(S, "SPREAD", 3)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs) == brute(rows)


def test_rounds_refine_ranks_until_past_or_unique(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(400)
    rows = [(k, k, text(100) + passage + text(100)) for k in range(6)] + [(9, 9, text(600))]
    docs = spark.createDataFrame(rows, "_doc long, _h1 long, _text string")
    positions = docs.mapInArrow(S._positions("_text"), "rank long, doc long, row long, at long")
    none = spark.createDataFrame([], "rank long, hot boolean")
    stretched, left = S.doubled(positions, 1000, none)
    assert len(left) >= 3 and left == sorted(left, reverse=True) and left[-1] == 0
    found = stretched.collect()
    assert {r.doc for r in found} == set(range(6))  # the text of its own closed in the sort of prefixes
    ways = {}
    for r in found:
        ways.setdefault(r.longer, set()).add(r.doc)
    shared = [w for w, docs in ways.items() if docs == set(range(6))]
    assert len(shared) > 15  # inside the passage all go on alike
    # at its ends the choice of positions depends on what is around it; equal ways are equal bytes all the same
    assert any(len(docs) < 6 for docs in ways.values())
    stretch, of = {}, {k: t for k, _, t in rows}
    for r in found:
        place, before, after = r.at >> 12, (r.at >> 6) & 63, r.at & 63
        part = of[r.doc][place - before : place + after]
        assert len(part) == before + after >= S.LENGTH
        stretch.setdefault((r.rank, r.longer), set()).add(part)
        if 1 < len(ways[r.longer]) < 6:
            assert place - before < 200 or place + after > 400
    assert all(len(parts) == 1 for parts in stretch.values())


def cut(rows, names, rng):
    """Sorted rows as batches of a few rows each."""
    at = 0
    while at < len(rows):
        size = rng.randrange(1, 6)
        part = rows[at : at + size]
        yield pa.RecordBatch.from_pydict({n: [r[k] for r in part] for k, n in enumerate(names)})
        at += size


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_groups_go_on_over_batches(monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    for seed in range(150):
        rng = random.Random(seed)
        rows = sorted((rng.randrange(4), rng.randrange(2), rng.randrange(3)) for _ in range(rng.randrange(1, 40)))
        rows = [(rank, longer, doc, k, False) for k, (rank, longer, doc) in enumerate(rows)]
        names = ["rank", "longer", "doc", "at", "hot"]
        docs, ways, first = {}, {}, {}
        for rank, longer, doc, _, _ in rows:
            docs.setdefault(rank, set()).add(doc)
            ways.setdefault(rank, set()).add(longer)
            first[rank, longer] = min(first.get((rank, longer), 9), doc)
        kinds = [(r["at"], r["kind"]) for b in S._rerank(cut(rows, names, rng)) for r in b.to_pylist()]
        repeats = {at for at, kind in kinds if kind == S.REPEAT}
        apart = {at for at, kind in kinds if kind == S.APART}
        assert repeats == {at for rank, longer, doc, at, _ in rows if doc > first[rank, longer]}
        needed = {at for rank, longer, doc, at, _ in rows if doc == first[rank, longer] and len(ways[rank]) > 1}
        assert needed <= apart and not apart & repeats  # beyond HELD rows more may be looked at, never fewer
        assert held < 1000 or apart == needed

        by_doc = sorted(rows, key=lambda r: (r[0], r[2]))
        marked = [(at, bool(s)) for part, several in S._shared(cut(by_doc, names, rng)) for at, s in zip(part["at"], several)]
        assert sorted(at for at, _ in marked) == list(range(len(rows)))
        open_ = {at for at, s in marked if s}
        wanted = {at for rank, _, _, at, _ in rows if len(docs[rank]) > 1}
        assert wanted <= open_ and (held < 1000 or open_ == wanted)

        texts = sorted((rng.randrange(3), rng.randrange(2)) for _ in range(rng.randrange(1, 40)))
        runs = [list(zip(r["doc"], r["row"])) for r in S._by_text(cut(texts, ["doc", "row"], rng))]
        assert [x for run in runs for x in run] == texts
        assert all(not set(a) & set(b) for k, a in enumerate(runs) for b in runs[k + 1 :])


@pytest.mark.parametrize("packed", [7, 1 << 20])
def test_blocks_hold_every_row_of_their_bucket(monkeypatch, packed):
    monkeypatch.setattr(S, "PACKED", packed)
    rng = np.random.default_rng(6)
    parts = []
    for n in (5, 0, 40, 1):
        rows = {c: rng.integers(-(2**63), 2**63 - 1, n) for c in ("doc", "row", "at")}
        parts += [(S.REPEAT, rows, S._named(rows["doc"])), (S.GONE, {"doc": rows["doc"], "rank": rows["at"]}, S._named(rows["doc"]))]
    blocks = [b for batch in S._pack(iter(parts), 4) for b in batch.to_pylist()]
    assert all(b["n"] > 0 and len(b["block"]) == 8 * b["n"] * len(S._COLUMNS[b["kind"]]) for b in blocks)
    blocks.sort(key=lambda b: b["bucket"])
    kind = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("block", pa.binary())])
    batches = [pa.RecordBatch.from_pylist(blocks[a : a + 3], kind) for a in range(0, len(blocks), 3)]
    found, docs = {S.REPEAT: [], S.GONE: []}, []
    for held in S._unpack(batches):
        docs.append({d for rows in held.values() for d in rows["doc"].tolist()})
        for k, rows in held.items():
            found[k] += list(zip(*(rows[c].tolist() for c in S._COLUMNS[k])))
    for k in found:
        assert sorted(found[k]) == sorted(r for of, rows, _ in parts if of == k for r in zip(*(rows[c].tolist() for c in S._COLUMNS[k])))
    assert 1 < len(docs) <= 4 and sum(map(len, docs)) == len(set().union(*docs))  # a document is in one bucket


def test_rows_of_positions_move_as_blocks(spark, monkeypatch):
    """The time of the job was Spark's sorts of one row for each position."""
    sorted_ = []
    plain = S._by_bucket
    monkeypatch.setattr(S, "_by_bucket", lambda blocks, expected: sorted_.append((blocks.count(), expected)) or plain(blocks, expected))
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(3000)
    rows = [(k, text(20_000) + passage + text(20_000)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(docs) == brute(rows)
    blocks, expected = sorted_[0]  # the first sort is of all positions
    assert expected > 20_000 and blocks < expected / 100
