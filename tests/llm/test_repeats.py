"""Repeated passages against a brute-force version."""

import random

import numpy as np
import pytest

pytest.importorskip("tessellar.llm.queries")
from tessellar.llm import repeats

SCHEMA = "doc_id long, text string, kept string, mark string, lo string, spans string"


def brute(rows, size=20):
    """rows: (id, text), no two alike in both; ids that repeat must not share windows between their texts."""
    texts = [(i, (t or "").encode().split()) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    seen, out = set(), []
    for i, words in texts:
        gone = set()
        for a in range(len(words) - size + 1):
            window = tuple(words[a : a + size])
            if window in seen:
                gone.update(range(a, a + size))
            seen.add(window)
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=repr)


def dropped(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in repeats.drop_repeats(frame).collect()), key=repr)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    passages = [prose(rng, rng.randint(20, 70)) for _ in range(6)]
    rows = []
    for i in range(250):
        parts = [prose(rng, rng.randint(0, 40)) for _ in range(3)]
        rows.append((i * 3 - 40, rng.choice([" ", "\n", "\t ", " \x0b\x0c\r\n"]).join(x for p in parts for x in (p, rng.choice([*passages, ""])))))
    rows += [(2000 + i, rows[i][1]) for i in range(40)] + [(3000, "a " * 90), (3001, "a " * 30), (3002, "a b " * 40), (3003, None), (3004, ""), (3005, "  é x " * 30)]
    want = brute(rows)
    assert dropped(spark, rows) == want and sum(r[2] for r in want) > 3000


def test_a_passage_in_every_text_is_hot(spark):
    """More than LEAST_HOT super-k-mers of one minimiser, all with other surroundings."""
    rng = random.Random(6)
    line = prose(rng, 30)
    rows = [(i, f"{prose(rng, 15, 10**6)} {line} {prose(rng, 15, 10**6)}") for i in range(700)]
    assert dropped(spark, rows, 4) == brute(rows)


def test_hot_windows_travel_alone():
    rng = random.Random(7)
    text = repeats.Text((prose(rng, 200) + "\n" + prose(rng, 10) + "\n" + prose(rng, 25) + "\n").encode())
    p = repeats.Repeats()
    first, count, key = repeats.super_kmers(text, np.empty(0, np.uint64), p)
    assert count.sum() == 181 + 0 + 6 and len(set(key)) == len(first)
    hot = np.sort(key[count > 1][:3])
    first2, count2, key2 = repeats.super_kmers(text, hot, p)
    assert count2.sum() == count.sum() and len(first2) == len(first) + sum(n - 1 for n, k in zip(count, key) if k in hot)
    assert not set(key2) & set(hot)
    # runs of one minimiser are cut, and windows of one text lie where they lay
    same = repeats.Text(("a " * 2000 + "a\n").encode())
    assert repeats.super_kmers(same, np.empty(0, np.uint64), p)[1].max() == repeats.LONGEST


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    """All windows get one hash: the comparison of words alone decides."""
    monkeypatch.setattr(repeats.Text, "hashes", lambda self, first, last: np.zeros(len(first), np.uint64))
    text = repeats.Text(b"a b c d\na b c e\nb c d\n")
    at = text.windows(3)
    found = repeats.earliest(text, at * 10, at, 3)
    assert [bytes(text.raw[text.starts[a] : text.ends[a + 2]]) for a, r in zip(at, found) if r] == [b"a b c", b"b c d"]


def test_very_long_text_in_segments(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(repeats.SEGMENT + 3000)]
    edge = words[repeats.SEGMENT - 30 : repeats.SEGMENT + 30]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *edge, "y"])), (0, " ".join(edge[10:45])), (3, " ".join(words[100:150] + words[-40:]))]
    assert dropped(spark, rows) == brute(rows)


def test_ids_rows_and_empty_tables(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 30) for _ in range(3))
    got = dropped(spark, [(None, a), (7, a), (7, a), (None, b), (5, b), (9, c), (9, c)])
    # rows alike in id and text are one document; a null id comes last
    assert got == sorted([(None, 30, 30, ""), (7, 30, 0, a), (7, 30, 0, a), (None, 30, 30, ""), (5, 30, 0, b), (9, 30, 0, c), (9, 30, 0, c)], key=repr)
    twice = dropped(spark, [(1, f"{a} x"), (1, f"y {a}")])
    assert sorted(r[2] for r in twice) == [0, 30]
    assert dropped(spark, [], 1) == []
