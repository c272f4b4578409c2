"""The network against a naive convolution and numerical gradients; the positive-unlabelled risk against its definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

quality_net = pytest.importorskip("tessellar.llm.quality_net")
from tessellar.llm import pitman_yor, tokens, toxicity  # noqa: E402
from tessellar.llm.queries import vocabulary  # noqa: E402


def naive(net, text):
    """Every window of every chunk by loops: the text padded to whole half chunks, the last window of the text left out."""
    w, s, half = quality_net.WIDTH, quality_net.STRIDE, quality_net.HALF
    n = -(-(len(text) + w) // half)
    data = text.ljust(n * half, b"\0")
    chunks = []
    for c in range(n):
        best = np.zeros(quality_net.FILTERS)
        for at in range(c * half, min((c + 2) * half, n * half), s):
            if at + w > n * half:
                continue
            x = np.concatenate([net.embed[data[at + k]] for k in range(w)]).astype(np.float64)
            best = np.maximum(best, x @ net.filters + net.bias)
        chunks.append(best)
    features = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)])
    return 1 / (1 + np.exp(-(features @ net.out + net.offset[0])))


def test_convolution_equals_loops():
    rng = random.Random(3)
    net = quality_net.Net.fresh(1)
    net.out *= 10
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (0, 1, 7, 500, 504, 505, 512, 1024, 3000)]
    got = quality_net.scores(net, texts)
    assert np.allclose(got, [naive(net, t) for t in texts], atol=1e-5)
    assert np.allclose(got, [quality_net.scores(net, [t])[0] for t in texts], atol=1e-6)


def test_gradients_equal_differences():
    rng = random.Random(4)
    net = quality_net.Net.fresh(2)
    texts, labels = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (900, 1500, 20)], np.array([1.0, 0.0, 1.0])

    def loss():
        p = np.clip(quality_net.scores(net, texts), 1e-9, 1 - 1e-9)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for values, gradient in zip([net.embed, net.filters, net.bias, net.out, net.offset], quality_net._gradients(net, texts, labels), strict=True):
        flat, g = values.reshape(-1), np.asarray(gradient).reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(g[i], rel=0.08, abs=2e-4)


def test_no_labels_and_empty_texts():
    net = quality_net.Net.fresh(1)
    assert len(quality_net.scores(net, [])) == 0 and 0 <= quality_net.scores(net, [b""])[0] <= 1 and quality_net.scores(None, [b"x"]).tolist() == [0.5]


def risk(z_p, z_u, prior):
    log = lambda z: np.logaddexp(0, -z)
    return prior * log(z_p).mean(), log(-z_u).mean() - prior * log(-z_p).mean()


def test_positive_unlabelled_learning_beats_taking_all_unlabelled_as_clean():
    rng = random.Random(6)
    bad = [b"vile", b"nasty", b"foul"]
    text = lambda toxic: b" ".join([rng.choice(bad) if toxic and rng.random() < 0.06 else b"w%d" % rng.randrange(800) for _ in range(80)])
    positive, unlabelled = [text(True) for _ in range(150)], [text(i % 4 == 0) for i in range(800)]
    weights, offset = toxicity.fit(positive, unlabelled, 0.25)
    z = lambda group: np.array([sum(weights.get(x, 0.0) for x in toxicity.features(t)) + offset for t in group])
    # the cut that fit() chooses moves the offset alone; the weights are judged at the offset where the risk is least
    least = min(a + max(b, 0) for a, b in (risk(z(positive) - c, z(unlabelled) - c, 0.25) for c in np.linspace(-10, 10, 81)))
    empty = risk(np.full(150, np.log(1 / 3)), np.full(800, np.log(1 / 3)), 0.25)
    assert least < 0.5 * sum(empty)
    border = np.log(toxicity.CUT / (1 - toxicity.CUT))
    held = [text(True) for _ in range(200)], [text(False) for _ in range(200)]
    assert (z(held[0]) >= border).mean() >= 0.9 and (z(held[1]) >= border).mean() <= 0.03
    assert {b"vile", b"nasty", b"foul"} <= set(weights)


def test_texts_are_cut_only_where_the_pattern_cuts(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", " ", "  ", "\n", "word's", "é", "12345", "!", "\t", "日本"]) for _ in range(400)) for _ in range(20)]
    encoder = tokens.UnitEncoder(*vocabulary())
    whole = [encoder.one(t) for t in texts]
    monkeypatch.setattr(tokens, "PIECE", 5)
    assert all("".join(tokens.pieces(t)) == t for t in texts) and [encoder.one(t) for t in texts] == whole


def test_restaurants_seat_as_many_as_the_rule_expects():
    rng = np.random.default_rng(5)
    for customers, opens in ((10, 2.0), (60, 5.0), (500, 3.0)):
        simple = []
        for _ in range(400):
            tables = 1
            for i in range(1, customers):
                tables += rng.random() < opens / (opens + i - 0.5 * tables)
            simple.append(tables)
        got = pitman_yor.seat(np.full(4000, customers), np.full(4000, opens), 0.5, lambda i: 1 - rng.random(4000))
        assert got.mean() == pytest.approx(np.mean(simple), rel=0.06)


def test_packing_routes_by_vocabulary(spark, monkeypatch):
    from tessellar.llm import packing

    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    rng = random.Random(12)
    topics = [["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(150)] for _ in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(200))) for i in range(200)] + [(500, rows_text) for rows_text in ["the very same row"] * 150]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect()
    shards = {}
    for r in pieces:
        shards.setdefault(r.sequence_id >> 32, []).append(r)
    # documents of one topic meet, equal rows are cut into several shards, and nothing is lost
    mixed = sum(len({r.doc_id % 4 for r in s if r.doc_id < 200}) > 1 for s in shards.values())
    assert mixed <= len(shards) // 3 and sum(any(r.doc_id == 500 for r in s) for s in shards.values()) >= 3
    assert sum(r.length for r in pieces if r.doc_id == 500) == 150 * next(r.doc_tokens for r in pieces if r.doc_id == 500)
    assert max(len({(r.doc_id, r.start) for r in s}) for s in shards.values()) < 200


def test_tree_halves_its_sample():
    from tessellar.llm import packing

    sample = np.random.default_rng(1).standard_normal((1000, packing.DIMS)).astype(np.float32)
    sizes = np.bincount(packing.leaves(sample, packing.tree(sample, 4)), minlength=16)
    assert sizes.min() >= 60 and sizes.max() <= 65 and packing.leaves(sample[:0], packing.tree(sample, 2)).size == 0
    same = np.ones((50, packing.DIMS), np.float32)
    assert len(set(packing.leaves(same, packing.tree(same, 3)))) == 1


def test_a_source_full_of_junk_does_not_set_its_own_limit(spark):
    from tessellar.llm import quality_rules

    rng = random.Random(21)
    text = lambda junk: " ".join("w%d" % rng.randrange(10**6) + (" ###" if junk else "") for _ in range(80))
    rows = [(i, text(False), "en", "plain") for i in range(600)] + [(1000 + i, text(i % 10 < 7), "en", "junk") for i in range(150)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(600)) and all(kept[1000 + i] == (i % 10 >= 7) for i in range(150))


def test_words_of_many_blocks_and_buckets(spark, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    from tessellar.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(bpe, "BUCKET_CHARS", 30_000)
    monkeypatch.setattr(bpe, "WORDS_A_ROW", 100)
    monkeypatch.setattr(bpe, "WORD_ROWS", 3)
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("mine").alias("_bpe_block"), F.lit("also mine").alias("_bpe_0"))
    odd = spark.createDataFrame([(-1, None, "mine", "also mine"), (-2, "", "mine", "also mine"), (-3, "x" * 300 + " " + "é" * 200, "mine", "also mine"), (-3, " lead", "mine", "also mine")], docs.schema)
    every = docs.unionByName(odd).repartition(3)
    rows = bpe.decode(bpe.encode(every, ranks, P.PATTERN), ranks).collect()
    assert len(rows) == docs.count() + 4 and all(r["_bpe_block"] == "mine" and r["_bpe_0"] == "also mine" for r in rows)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == r.id_list == own.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")


def test_scoring_takes_little_memory():
    import tracemalloc

    net, texts = quality_net.Net.fresh(1), [b"some words in a row " * 100] * 256
    quality_net.scores(net, texts[:1])
    tracemalloc.start()
    quality_net.scores(net, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6e6  # every worker keeps what one batch took
