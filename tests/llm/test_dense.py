"""Dense families of near copies, whole and cut into blocks; texts whose ids are null or repeated."""

import random

import pytest

from tests.llm.test_operators import brute_components

jaccard_join = pytest.importorskip("tessellar.llm.jaccard_join")


@pytest.mark.parametrize("block", [1000, 50])
def test_dense_family(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng, texts = random.Random(1), {}
    v = ["w%d" % i for i in range(500)]
    base = [rng.choice(v) for _ in range(200)]
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(2, 6)):
            w[rng.randrange(len(w))] = rng.choice(v)
        texts[i] = " ".join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(frame, jaccard_join.Join(3, 90)).collect()}
    assert got == brute_components(texts, 3, 90)


def test_links_through_rows_without_an_id(spark):
    base = ["w%d" % i for i in range(200)]
    near = lambda *at: " ".join("z%d" % i if i in at else w for i, w in enumerate(base))
    # 9 - null - 4: the ends link only through the row without an id; two nulls link with each other alone
    chain = [near(), near(30, 60), near(30, 60, 90, 120)]
    rows = [(9, chain[0]), (None, chain[1]), (4, chain[2]), (7, "a b c d"), (7, "e f g h"), (8, "e f g h"), (None, "p q r s"), (None, "p q r s"), (None, None), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard_join.Join(3, 95)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in chain]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) >= 0.94 and share(sets[0], sets[2]) < 0.90
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(frame, jaccard_join.Join(3, 92)).collect()), key=str)
    assert got == sorted([(9, 198, 4), (None, 198, 4), (4, 198, 4), (7, 2, 7), (7, 2, 7), (8, 2, 7), (None, 2, None), (None, 2, None), (None, 0, None), (5, 0, 5)], key=str)
    groups = {r.component for r in jaccard_join.grouped(frame, join).filter("n_shingles = 2").collect()}
    assert len(groups) == 3


def test_words_hashed_in_bulk(monkeypatch):
    texts = [b"", b" ", b"a", b"A b", b"x y z x y z", b"long" * 200 + b" tail", b"\t1\n2\x0b3\x0c4\r5 ", "é ü é".encode(), b"one two three four", None, b"two three four", b"word " * 500]
    whole = [s.tolist() for s in jaccard_join.Shingler(3)(texts)]
    monkeypatch.setattr(jaccard_join, "PIECE", 7)
    assert [s.tolist() for s in jaccard_join.Shingler(3)(texts)] == whole == [s.tolist() for t in texts for s in jaccard_join.Shingler(3)([t])]
    assert [len(s) for s in whole] == [0, 0, 1, 1, 3, 1, 3, 1, 2, 0, 1, 1]
    assert whole[10][0] in whole[8] and len({tuple(s) for s in whole if s}) == len([s for s in whole if s])
