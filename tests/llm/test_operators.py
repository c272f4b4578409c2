"""Brute-force comparisons and edge cases of the training-data operators, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

pytest.importorskip("tessellar.llm.queries")
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellar.llm import bpe, hilbert_ann, jaccard_join, packing, pii, pitman_yor, quality_net, quality_rules, tokens, toxicity
from tessellar.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, n_words string, kept string"
ODD = ["", " ", "\n\n", "x", "  two  spaces \t and\ttabs ", "é日本語 🎉 word's we'll", "a" * 500 + " " + "z9" * 300, "<|endoftext|> is text", "one two three"]


def long_text(seed, n=4000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*ODD, None, long_text(1), long_text(2, 300), long_text(2, 300)]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows += [(3, "x", "en", "s", 1, "a", "b", "c", "d"), (None, "a null id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def test_bpe_round_trip_and_tiktoken(spark, docs, empty):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(empty, ranks, P.PATTERN).count() == 0


def test_heap_merge_equals_tiktoken():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(200):
        w = "".join(rng.choice("abcdethious é") for _ in range(rng.randint(1, 300)))
        assert bpe.merge(w.encode(), ranks) == own.encode_ordinary(w)


def test_packing_covers_every_token(docs, empty):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, vocabulary()).collect()
    sequences, got = {}, Counter()
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        got[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    whole = [r for r in pieces if r.doc_id == 10]
    ids = b"".join(bytes(r.ids) for r in sorted(whole, key=lambda r: r.start))
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(long_text(1), add_special_tokens=False).ids + [1]
    assert packing.pack(empty, vocabulary()).count() == 0


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(i * 500, i * 500 + 500, 4000) for i in range(4)]
    documents = [rng.choice(topics[i % 4], 700).astype("<u4") for i in range(40)]
    by = {}
    for i, _, _, sequence, _ in packing.pack_shard(documents, packing.Packer()):
        by.setdefault(sequence, set()).add(i % 4)
    assert sum(len(x) == 1 for x in by.values()) >= 10


def test_token_attribution_against_offsets(docs, empty):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for rule in ("first", "last"):
        for r in tokens.attribute(docs.filter("doc_id <> 3"), vocabulary(), rule=rule).collect():
            spans = library.encode(text[r.doc_id] or "", add_special_tokens=False).offsets
            k = [s[0] if rule == "first" else max(s[1] - 1, s[0]) for s in spans]
            assert r.n_tokens == sum(r.start <= x < r.end for x in k)
    assert tokens.attribute(empty, vocabulary()).count() == 0
    gap = tokens.attribute(docs.filter("doc_id = 8"), vocabulary(), bounds=lambda t: [("head", 0, 3)]).collect()
    assert {(r.section, r.n_tokens) for r in gap} == {("head", 1), (None, 2)}
    with pytest.raises(ValueError):
        tokens.attribute(docs, vocabulary(), rule="middle")


def brute_components(texts, width, percent):
    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, width, percent):
    rng, texts = random.Random(width), {}
    vocabulary_ = ["w%d" % i for i in range(400)]
    passage = [rng.choice(vocabulary_) for _ in range(60)]
    for family in range(12):
        base = [rng.choice(vocabulary_) for _ in range(rng.randint(5, 160))]
        for copy in range(rng.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary_)
            texts[len(texts)] = " ".join(w + (passage if family % 3 == 0 else []))
    for t in [None, "", "one", "One", "one two", "x y z", "X Y Z"]:
        texts[len(texts)] = t
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(frame, jaccard_join.Join(width, percent)).collect()}
    assert got == brute_components(texts, width, percent)


def test_jaccard_join_edge_tables(spark, docs, empty):
    assert jaccard_join.link(empty).count() == 0
    assert jaccard_join.link(docs).count() == docs.count()


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, rng.integers(3, 600), dtype=np.uint64))
        sets.append(base)
        sets.append(np.unique(np.concatenate([base[: int(len(base) * 0.97)], rng.integers(0, 2**63, 2, dtype=np.uint64)])))
    leaves = [jaccard_join.Leaf(b"%03d" % i, len(s), jaccard_join.bitmap(s), b"%03d" % i) for i, s in enumerate(sets)]
    root = jaccard_join.tree(leaves)
    found = {tuple(sorted(p)) for p in jaccard_join.traverse(root, root, 90)}
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(np.intersect1d(a, sets[j]))
            if 100 * k >= 90 * (len(a) + len(sets[j]) - k):
                assert (b"%03d" % j, b"%03d" % i) in found
    assert len(found) < 200


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[50:120] = x[50]
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(600)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 4), (904, [None] + [1.0] * 15)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert_ann.search(frame, F.col("id") % 20 == 0).collect()
    hits = total = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        score = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:20]
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in mine)
        hits, total = hits + len(set(want) & {r.vec_id for r in mine}), total + 20
    assert hits >= 0.9 * total
    copies = [r.vec_id for r in sorted((r for r in got if r.query_id == 60), key=lambda r: r.rank)]
    assert copies == [*range(50, 60), *range(61, 71)]
    few = hilbert_ann.search(frame.limit(5), F.col("id") == 0).collect()
    assert len(few) == 4
    assert hilbert_ann.search(frame.filter("vec_id > 800 and vec_id < 903"), F.lit(True)).count() == 0


def test_hilbert_reach_is_never_below_its_fraction():
    p = hilbert_ann.Curves()
    assert all(hilbert_ann.reach_of(n, p) >= p.reach * n for n in (1, 23, 24, 35, 59, 1000)) and hilbert_ann.reach_of(24, p) == 2


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(i, j) for i in range(16) for j in range(16)])
    order = cells[np.argsort(hilbert_ann.hilbert(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_base_spans(spark, docs, empty):
    texts = ["a.b@c.d_e@f.g x@y@z.w.. a@b.c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "é🎉 4111 1111 1111 1111 4111-1111-1111-1111", "+1 (988) 555-2485, +49.30.1234567- x", "@" * 5 + "a@-.-", "5" * 3000 + " " + "1 " * 3000 + "a@b" + ".c" * 3000]
    rng = random.Random(9)
    texts += ["".join(rng.choice("a1.@+- 4é()") for _ in range(80)) for _ in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = pii.trees(spark)
    for r in pii.find(frame, model).collect():
        assert [(x.kind, x.start, x.end) for x in r.base] == brute_spans(r.text), r.text[:90]
        assert r.found[: len(r.base)] == r.base
    assert pii.find(docs, model).count() == docs.count()
    assert pii.redact(empty, model).count() == 0


def test_redaction(spark):
    rows = [(0, "mail a@b.cd now 4111 1111 1111 1111."), (1, None), (2, 'x token = "76ce86d4952db1ee140095c8f6e334d186126d15" y'), (3, "clean 12 text")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), pii.trees(spark)).collect()}
    assert out[0] == "mail [EMAIL] now [CARD]." and out[1] is None and out[3] == "clean 12 text"
    assert "76ce" not in out[2] and out[2].startswith('x token = "[')


def test_quality_rules_metrics(docs, empty):
    for r in quality_rules.quality_rules(docs).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_follow_the_group(spark):
    rng = random.Random(2)
    text = lambda sign: " ".join("w%d" % rng.randrange(10**6) + (" " + sign if rng.random() < 0.9 else "") for _ in range(80))
    rows = [(i, text("") if i % 2 else text("#"), "en", "plain" if i % 2 else "code") for i in range(600)] + [(1000, text("#"), "en", "plain")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(1000) and all(kept.values())


def test_pitman_yor_base_and_gain(spark, docs, empty):
    rng = random.Random(6)
    pool = ["the", "of", "and", *["".join(rng.choice(["an", "ti", "re", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]]
    texts = {i: " ".join(rng.choice(pool[:20] if rng.random() < 0.6 else pool) for _ in range(120)) for i in range(200)}
    got = pitman_yor.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    count = Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 10:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    gain = 0.0
    for r in got:
        w = [*words(texts[r.doc_id]), None]
        base = sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(w), sum(count[x] > 0 for x in w)) and abs(r.base_score - base) < 1e-6
        gain += (r.score - r.base_score) if r.held_out else 0
    assert gain > -1
    assert {r.n_tokens for r in pitman_yor.score(docs).filter("doc_id = 9").collect()} == {1}
    assert pitman_yor.score(empty).count() == 0


def test_pitman_yor_perplexity(spark):
    rows = [(i, "the cat sat on the mat " * (i % 3 + 1)) for i in range(30)] + [(40, None), (41, "quite unheard words")]
    got = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) and r.perplexity > 1 for r in got.values())
    assert got[41].perplexity > got[2].perplexity


def test_pitman_yor_strength_of_all_contexts(spark):
    """One context of many may decide, wherever it lies, since none is left out."""
    rng = np.random.default_rng(3)
    p, d = pitman_yor.Sampler(), 0.6
    pairs = [(int(c), 1.0, int(c) + 3, 4.0, 0.001) for c in rng.integers(2, 9, 300)]
    pairs += [(900, 600.0, 100_000, 9000.0, 0.009)] * 60
    contexts = [(c + 3, 3, 4.0) for c, *_ in pairs[:300]] + [(100_000, 40, 9000.0)]

    def brute(pairs, contexts):
        out = []
        for s in p.context_strengths:
            x = sum(n * (math.log(s + d * (t - 1)) - math.log(c - 1 + s)) for c, n, t in contexts)
            for c, t, sat, tables, parent in pairs:
                others = min(t, c - 1)
                x += c * math.log((c - 1 - d * others + (s + d * (tables - t + others)) * parent) / (sat - 1 + s))
            out.append(x)
        return out

    def chosen(pairs, contexts):
        sums = [[float(x) for x in pitman_yor.left_out(*(np.array(x, float) for x in zip(*part, strict=True)), d, p)] for part in (pairs[::2], pairs[1::2]) if part]
        assert np.allclose(np.sum(sums, 0), brute(pairs, []))
        seated = spark.createDataFrame([(x,) for x in sums] + [(None,)], "l array<double>")
        return pitman_yor.choose_strength(seated, spark.createDataFrame(contexts, "c long, n_u long, tables double"), d, p)

    best = lambda *x: p.context_strengths[int(np.argmax(brute(*x)))]
    assert chosen(pairs, contexts) == best(pairs, contexts) != best(pairs[:300], contexts[:300]) == chosen(pairs[:300], contexts[:300])
    nothing = spark.createDataFrame([], "l array<double>"), spark.createDataFrame([], "c long, n_u long, tables double")
    assert pitman_yor.choose_strength(*nothing, d, p) == p.context_strengths[-1]


def test_pitman_yor_pairs_travel_packed():
    rng = random.Random(4)
    blocks = [[(" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(0, 30))).encode(), rng.random() < 0.2) for _ in range(6)] for _ in range(4)]
    counts, n_u, n_w, seen = Counter(), Counter(), Counter(), [set() for _ in blocks]
    for held, block in zip(seen, blocks, strict=True):
        for text, held_out in block:
            words = [pitman_yor.key_of(w) for w in (b"", *text.split(), b"")]
            held.update(zip(words, words[1:], strict=False))
            counts.update({} if held_out else Counter(zip(words, words[1:], strict=False)))
    n_u.update(u for (u, _), c in counts.items() if c == 1)
    n_w.update(w for (_, w), c in counts.items() if c == 1)
    packed = [pitman_yor._pairs(pa.table({"text": pa.array([t for t, _ in b], pa.binary()), "held_out": [h for _, h in b], "block": pa.array([i] * len(b), pa.int32())}), 3) for i, b in enumerate(blocks)]
    sent = pa.concat_tables(packed)
    assert sent.num_rows <= 3 * len(blocks)  # and not one for each pair
    many, begun, ended, back = {}, Counter(), Counter(), [0] * len(blocks)
    for bucket in range(3):
        part = sent.filter(pc.equal(sent.column("bucket"), bucket))
        out = pitman_yor._joined(part)
        kind = lambda k, out=out: out.filter(pc.equal(out.column("kind"), k))
        many |= {(r["u"], r["w"]): r["c"] for r in kind(0).to_pylist()}
        for r in kind(1).to_pylist():
            begun[r["u"]] += r["n_u"]
            ended[r["u"]] += r["n_w"]
        seated = kind(0).append_column("t_kept", pa.array([4.0] * kind(0).num_rows))
        told = {r["block"]: np.frombuffer(r["p"], np.float64) for r in pitman_yor._values(kind(2), seated, 0.25, 4).to_pylist()}
        for r in part.to_pylist():
            pairs = zip(np.frombuffer(r["u"], np.int64).tolist(), np.frombuffer(r["w"], np.int64).tolist(), strict=True)
            assert told[r["block"]].tolist() == [max(counts[x] - 0.25, 0.0) for x in pairs]
            back[r["block"]] += len(told[r["block"]])
    assert many == {x: c for x, c in counts.items() if c > 1} and any(c == 1 for c in counts.values())
    assert +begun == +n_u and +ended == +n_w and back == [len(x) for x in seen]


def test_pitman_yor_seats_by_size():
    rng = np.random.default_rng(3)
    c, key = rng.integers(0, 300, 500) // rng.integers(1, 100, 500), rng.integers(0, 2**63, 500).astype(np.uint64)
    opens = rng.random(500) + 0.1
    assert (pitman_yor.seat_by_key(c, opens, 0.5, key) == pitman_yor.seat(c, opens, 0.5, pitman_yor._uniform(key))).all()


def test_pitman_yor_weighs_word_order(spark):
    rng = random.Random(16)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    follows = {w: rng.sample(pool, 2) for w in pool}
    texts = []
    for _ in range(150):
        t = [rng.choice(pool)]
        for _ in range(79):
            t.append(rng.choice(follows[t[-1]]))
        texts.append(t)
    ids = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(i, " ".join(t)) for i, t in zip(ids, texts[:10], strict=False)] + [(i, " ".join(rng.sample(t, 80))) for i, t in zip(ids[10:], texts[:10], strict=False)]
    got = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for a, b in zip(ids[:10], ids[10:], strict=True):
        assert abs(got[a].base_score - got[b].base_score) < 1e-6 and got[a].score > got[b].score + 20


def test_byte_restaurants_are_a_distribution():
    words_ = [b"tion", b"ing", b"the", b"ation"] * 5
    byte, restaurant, _ = pitman_yor.spelling(words_)
    key, n = np.unique(restaurant * 256 + byte, return_counts=True)
    model = pitman_yor.sample(key >> 8, key & 255, n, pitman_yor.Sampler())
    assert np.allclose((10.0 ** model.log10.astype(float)).sum(1), 1, atol=1e-4)
    assert model([b"tion"])[0] > model([b"qzxv"])[0]


def test_quality_net_learns_and_scores_alone(spark, docs, empty):
    rng = random.Random(8)
    good = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(40, 1500))) for _ in range(120)]
    rows = [(i, t if i % 2 else t.upper() + "!!") for i, t in enumerate(good)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    net = quality_net.train(frame, labels, F.col("doc_id") < 80)
    out = {r.doc_id: r.score for r in quality_net.classify(frame, net).collect()}
    assert sum((out[i] >= 0.5) == bool(i % 2) for i in range(80, 120)) >= 38
    texts = [t.encode() for _, t in rows]
    assert np.allclose(quality_net.scores(net, texts), [quality_net.scores(net, [t])[0] for t in texts], atol=1e-5)
    scored = quality_net.classify(docs, net).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality_net.classify(empty, net).count() == 0
    assert quality_net.train(empty, labels.limit(0), F.lit(True)) is None and quality_net.classify(docs, None).filter("score = 0.5").count() == docs.count()


def test_toxicity_from_positives_and_unlabelled(spark, docs, empty):
    rng = random.Random(5)
    text = lambda bad: " ".join(["w%d" % rng.randrange(3000) for _ in range(90)] + (["vile", "vile", "nasty", "nasty"] if bad else []))
    rows = [(i, text(i % 8 == 0)) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels, F.lit(True))
    out = {r.doc_id: r.score for r in toxicity.classify(frame, model).collect()}
    assert sum(out[i] >= 0.7 for i in range(400, 800, 8)) >= 45 and sum(out[i] >= 0.7 for i in range(400, 800) if i % 8) <= 4
    assert toxicity.classify(docs, model).count() == docs.count() and toxicity.classify(empty, model).count() == 0
    assert toxicity.train(frame, labels.limit(0), F.lit(True)) is None and toxicity.classify(docs, None).filter("score = 0").count() == docs.count()


def test_toxicity_of_long_texts():
    rng = random.Random(15)
    bad = [b"vile%d" % i for i in range(8)]
    text = lambda n, toxic: b" ".join(bad[rng.randrange(8)] if toxic and rng.random() < 0.02 else b"w%d" % rng.randrange(3000) for _ in range(n))
    size = lambda i: 3000 if i % 4 == 0 else 200
    weights, offset = toxicity.fit([text(size(i), True) for i in range(80)], [text(size(i), i % 8 == 1) for i in range(400)], 0.125)
    score = lambda t: sum(weights.get(x, 0.0) for x in toxicity.features(t)) + offset
    border = np.log(toxicity.CUT / (1 - toxicity.CUT))
    assert sum(score(text(5000, True)) >= border for _ in range(20)) >= 19 and sum(score(text(5000, False)) >= border for _ in range(20)) <= 1
    # one use in 5,000 words is a feature, and a dense passage counts wherever it stands
    filler = [b"w%d" % i for i in range(5000)]
    assert b"insult" in toxicity.features(b" ".join([*filler, b"insult"]))
    assert toxicity.features(b"insult x insult y insult") <= toxicity.features(b" ".join([*filler, b"insult x insult y insult"]))


def test_digests_of_the_queries(spark):
    from tessellar.llm.queries import QUERIES

    assert {re.match(r"op(\d+)_", k).group(1) for k in QUERIES} == {str(i) for i in range(1, 11)}
    rows = QUERIES["op8_byte_level_bpe"](spark, "/root/testdata/sf0.001").limit(3).collect()
    assert all(len(r.ids_sha256) == 64 and len(r.decoded_sha256) == 64 for r in rows)
    assert hashlib.sha256(b"").hexdigest() not in {r.ids_sha256 for r in rows}
