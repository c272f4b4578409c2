"""Pages, lines, chunks and retrieval against plain Python, uploads, streams."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessellar.functions import text
from tessellar.operators import curate, search, store
from tessellar.sources import files, uploads


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(expression.alias("x")).first().x


def estimate(t):
    a, l = len(re.findall("[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]", t)), len(re.findall("[A-Za-z]", t))
    share = a / (a + l) if a + l else 0
    return int(len(t) / max(2.6 * share + 4 * (1 - share), 1)) + 1 if t else 0


def brute_chunks(t, budget, overlap, least):
    """Runs of lines first, texts afterwards, by index arithmetic."""
    lines = [x.strip() for x in t.splitlines() if x.strip()]
    if len(t.strip()) < least:
        return []
    cost = [estimate(x) for x in lines]
    head = [x.startswith("#") or (len(x) <= 70 and len(x.split()) <= 8 and not re.search("[.،؟!:?]$", x)) for x in lines]
    runs, lo, title = [], 0, ""
    for i, x in enumerate(lines):
        used = sum(cost[lo:i])
        name = re.sub("^[# ]+", "", x).strip()
        if head[i] and used > 0.4 * budget:
            runs.append((lo, i, title))
            lo, title = i, name
        elif used + cost[i] > budget and lo < i:
            runs.append((lo, i, title))
            lo = next(k for k in range(lo, i + 1) if sum(cost[k:i]) <= overlap)
        elif head[i] and lo == i:
            title = name
    runs.append((lo, len(lines), title))
    out = []
    for a, b, s in runs:
        body = "\n".join(lines[a:b])
        if len(body) < least and out and estimate(out[-1][0]) + estimate(body) <= budget:
            out[-1] = (out[-1][0] + "\n" + body, out[-1][1])
        else:
            out.append((body, s))
    return out


def test_chunks_against_plain_python(spark):
    rng, texts = random.Random(4), ["", None, "short", "one line " * 200, "\n\n # Title \n" + "x " * 300]
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            lines.append("# Heading %d" % i if kind < 0.08 else "Plan %d" % rng.randrange(9) if kind < 0.16 else " ".join(rng.choice(["word", "longer", "باقة", "x", "الإنترنت"]) for _ in range(rng.randint(1, 60))) + rng.choice(["", ".", ":"]))
        texts.append(rng.choice(["\n", "\r\n", "\n \n"]).join(lines))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for budget, overlap, least in ((450, 60, 120), (60, 20, 40)):
        got = {}
        for r in curate.chunk(frame, budget, overlap, least).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_no, r.text, r.section or ""))
        for i, t in enumerate(texts):
            assert [(x, s) for _, x, s in sorted(got.get(i, []))] == brute_chunks(t or "", budget, overlap, least), i


def test_chunks_of_a_long_text_in_time_that_grows_with_its_lines(spark):
    rng = random.Random(6)
    t = "\n".join(f"# Part {i}" if rng.random() < 0.1 else " ".join(["word"] * rng.randint(1, 40)) + "." for i in range(20_000))
    frame = spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")
    curate.chunk(frame.limit(0)).count()
    begun = time.perf_counter()
    got = [(r.text, r.section or "") for r in curate.chunk(frame).orderBy("doc_id", "chunk_no").collect()]
    assert time.perf_counter() - begun < 20
    assert got == brute_chunks(t, 450, 60, 120)
    assert curate.chunk(frame.filter("doc_id = 2"), least=0).count() == 0


def test_crawl_rules(spark):
    hosts = ["www.example.com"]
    ok = lambda u, **k: one(spark, curate.is_crawlable(F.col("u"), hosts, **k), u=u)
    assert ok("https://example.com/faq") and ok("http://WWW.example.com/faq") and not ok("https://my.example.com/faq") and not ok("ftp://example.com/")
    assert not ok("https://example.com/a.PDF?x=1") and not ok("https://example.com/a.css") and not ok("https://example.com/login") and not ok("https://example.com/x?p_p_id=1") and not ok("https://example.com/o/x")
    assert ok("https://example.com/museum") and not ok("https://example.com/museum", skip_parts=("/museum",))
    html = "<a href='/faq/'>f</a><a class=x href=b/c>g</a><a href=\"../d?q=1#z\">h</a><a href=\"mailto:x@y\">m</a><a href=\"https://other.org/\">o</a><a href=\"#top\">t</a><a href=\"//example.com/e\">e</a>"
    pages = spark.createDataFrame([(1, "https://www.example.com/p/q/", html)], "page_id int, url string, html string")
    assert sorted(r.target for r in curate.links(pages, hosts).collect()) == ["https://example.com/e", "https://example.com/faq", "https://example.com/p/d", "https://example.com/p/q/b/c"]
    assert curate.links(pages).count() == 5


def test_pages(spark):
    html = "<html><head><title>Plans - part | Site</title></head><body><div role='navigation'><p>menu</p></div><p class=\"x breadcrumb\">a > b</p><p class=\"cookies\">kept</p><header>h</header><h1>One</h1><p>Two &amp; three</p></body></html>"
    assert one(spark, curate.title(F.col("h"), "Site"), h=html) == "Plans - part" and one(spark, curate.title(F.col("h")), h=html) == "Plans - part | Site"
    assert [x for x in one(spark, curate.main_text(F.col("h")), h=html).split("\n") if x.strip()] == ["kept", "One", "Two & three"]


def test_boilerplate(spark):
    rows = [(i, f"common line\nunique {i} line\nall rights reserved" + ("\nrare line" if i == 3 else "")) for i in range(10)] + [(3, "the same id")]
    got = sorted((r.doc_id, r.text) for r in curate.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 11 and got[0] == (0, "unique 0 line") and (3, "the same id") in got and (3, "unique 3 line\nrare line") in got
    single = curate.drop_boilerplate(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert single.text == "common line\nunique 0 line"


def bm25(query, documents, classic):
    n, average = len(documents), max(sum(map(len, documents)) / max(len(documents), 1), 1e-9)
    df = Counter(t for d in documents for t in set(d))
    raw = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / max(len(raw), 1)
    idf = {t: (floor if raw[t] < 0 else raw[t]) if classic else math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    terms = query if classic else list(dict.fromkeys(query))
    return [sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / average)) for t in terms if t in idf) for d in documents]


def test_bm25_index_and_session_scores(spark, tmp_path):
    rng = random.Random(2)
    documents = [[rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 30))] for _ in range(40)] + [["شحن", "aa"]]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(documents)], "doc_id long, text string")
    queries = [["aa", "bb", "bb", "zz"], ["cc"], [], ["شحن"]]
    asked = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(queries)], "query_id long, text string")
    search.Index.build(frame, str(tmp_path / "i"))
    index = search.Index.open(spark, str(tmp_path / "i"))
    for classic in (False, True):
        got = {(r.query_id, r.doc_id): r.score for r in index.scores(asked, classic=classic).collect()}
        want = {(q, i): s for q, terms in enumerate(queries) for i, s in enumerate(bm25(terms, documents, classic)) if s > 0}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    tokens = spark.createDataFrame([(queries[0], documents), (queries[0], [])], "q array<string>, d array<array<string>>")
    one, none = tokens.select(search.bm25_scores(F.col("q"), F.col("d")).alias("x")).collect()
    assert one.x == pytest.approx(bm25(queries[0], documents, False)) and none.x == []
    # a question in its natural form finds the stemmed noun
    assert [r.doc_id for r in index.scores(spark.createDataFrame([(0, "الشحن")], "query_id long, text string")).collect()] == [40]


def test_four_lists_are_fused(spark):
    ranks = lambda *x: spark.createDataFrame([(1, c, r, s) for c, r, s in x], "query_id int, chunk_id string, rank int, score double")
    got = {r.chunk_id: r for r in search.retrieve(ranks(("a", 1, 0.9), ("b", 2, 0.8)), ranks(("b", 1, 5.0), ("c", 2, 4.0)), ranks(("b", 1, 0.7)), ranks(("d", 1, 2.0))).collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61 + 1.15 / 61) and got["b"].dense_score == 0.7 and got["b"].bm25_rank == 0 and got["b"].rank == 1
    assert got["c"].dense_score is None and got["c"].bm25_rank == 1 and got["a"].bm25_rank is None and got["d"].rank == 2


def test_rerank_and_diversify(spark):
    rows = spark.createDataFrame([(1, "red car", "a blue car", 1, "u", "shared"), (1, "red car", "the red car", 2, "u", "shared"), (1, "red car", "none", 3, "u", "shared"), (1, "red car", "red", 4, "u", "user_doc")], "query_id int, question string, text string, rank int, source string, kind string")
    assert [(r.text, r.rerank_score) for r in search.rerank(rows, 2).orderBy("rank").collect()] == [("the red car", 1.0), ("a blue car", 0.5)]
    assert [r.text for r in search.rerank(rows, 2, None).orderBy("rank").collect()] == ["a blue car", "the red car"]
    assert [r.rank for r in search.diversify(rows, "source", 2, F.col("kind") == "user_doc", "query_id").orderBy("rank").collect()] == [1, 2, 4]


def test_text_helpers(spark):
    assert one(spark, text.normalize(F.col("t"), nfkc=True), t="ﬁne ①") == "fine 1"
    assert one(spark, text.truncate_at(F.col("t"), ["<end>", "\n\n"]), t=" a b <end> c") == "a b" and one(spark, text.answer_language(F.col("t")), t="mixed") == "ar"
    table = spark.createDataFrame([([["a", "b"], ["1"]],), ([],)], "r array<array<string>>").select(text.table_markdown(F.col("r")).alias("x")).collect()
    assert [r.x for r in table] == ["| a | b |\n| --- | --- |\n| 1 |  |", ""]
    assert [(h.item, h.n) for h in one(spark, text.histogram(F.split("t", " ")), t="b a b")] == [("a", 1), ("b", 2)]
    long = "word " * 60
    assert one(spark, text.snippet(F.col("t")), t=long) == (long[:220].rsplit(" ", 1)[0] + "…") and one(spark, text.snippet(F.col("t")), t=" a  b ") == "a b"


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([("u", "t", "x", None)], files.CLEAN)
    files.write_clean(docs, str(tmp_path / "clean"))
    assert files.read_clean(spark, str(tmp_path / "clean")).first().language == "unknown"
    with pytest.raises(FileNotFoundError):
        files.read_jsonl(spark, str(tmp_path / "none"), "a int")
    (tmp_path / "g.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "g.jsonl"), "a int").count() == 2
    files.write_report(spark.createDataFrame([("é",)], "a string"), str(tmp_path / "report"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "report").glob("part*"))  # an empty partition has a file too
    names = spark.createDataFrame([("../../etc/passwd",), ("a\x00b.txt",), ("..",), ("C:\\x\\y.md",), (" ",)], "n string")
    assert [r.x for r in names.select(files.safe_name(F.col("n")).alias("x")).collect()] == ["passwd", "ab.txt", "upload.bin", "y.md", "upload.bin"]
    assert names.select(files.inside("/data/s1", F.col("n")).alias("x")).first().x == "/data/s1/passwd"
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("cp1256")),), (bytearray("نص".encode("cp1256")),)], "b binary")
    assert [r.x for r in raw.select(files.decode_text(F.col("b")).alias("x")).collect()] == ["é", "é", "نص"]


def test_uploads_end_to_end(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    body = "\n".join(f"Line {i} of the customer's bill with an amount of {i} pounds." for i in range(30))
    for name, content in {"bill.txt": body, "empty.md": "  ", "a.exe": "x", "zero.txt": "", "tiny.txt": "hi", "scan.png": "img"}.items():
        (folder / name).write_text(content)
    chunks = store.Chunks(spark, str(tmp_path / "store"))
    found = files.uploads(spark, str(folder))
    reader = lambda f: f.select("path", F.explode(F.array(F.lit(2), F.lit(1))).alias("page")).withColumn("text", F.concat(F.lit(body), F.col("page").cast("string")))
    got = {r.doc_name: r for r in uploads.ingest(found, "s1", chunks, {"png": reader}).collect()}
    assert got["bill.txt"].chunks >= 1 and got["bill.txt"].problem is None and got["bill.txt"].language == "en" and got["scan.png"].pages == 2
    assert {k: r.problem for k, r in got.items() if r.problem} == {"empty.md": "no readable text", "a.exe": "type", "zero.txt": "empty", "tiny.txt": "no indexable content"}
    assert chunks.session_size("s1") == got["bill.txt"].chunks + got["scan.png"].chunks and {r.session_id for r in chunks.own.read().collect()} == {"s1"}
    with pytest.raises(store.ScopeError):
        uploads.ingest(found, "", chunks)
    pick = spark.createDataFrame([("short", "a longer recognised text"), ("x" * 60, "y" * 99), ("short", None), (None, "z")], "a string, b string")
    assert [r.x for r in pick.select(uploads.longer_text(F.col("a"), F.col("b")).alias("x")).collect()] == ["a longer recognised text", "x" * 60, "short", "z"]


def test_boxes_in_reading_order(spark):
    box = lambda x, y, h=10.0: [[x, y], [x + 20, y], [x + 20, y + h], [x, y + h]]
    rows = [("p", box(50.0, 100.0), "world", 0.9), ("p", box(0.0, 102.0), " hello ", 0.9), ("p", box(0.0, 130.0), "below", 0.9), ("p", box(0.0, 10.0), "noise", 0.2), ("p", box(0.0, 5.0), "", 0.9), ("q", box(0.0, 0.0), "alone", 0.4)]
    got = {r.page: r.text for r in uploads.reading_order(spark.createDataFrame(rows, "page string, box array<array<double>>, text string, confidence double"), "page").collect()}
    assert got == {"p": "hello world\nbelow", "q": "alone"}


def run(query, spark, tmp_path, name, mode="append"):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_session_state_on_a_stream(spark, tmp_path):
    from tessellar.streaming import state

    rows = [("s1", 1, "2024-01-01 00:00:00", True, False, 0.1), ("s1", 2, "2024-01-01 00:01:00", True, True, 0.7), ("s1", 3, "2024-01-01 00:02:00", False, True, 0.9), ("s2", 1, "2024-01-01 00:02:00", False, False, 0.0), ("s3", 1, "2024-01-01 09:00:00", False, False, 0.0)]
    frame = spark.createDataFrame(rows, "session_id string, turn_no long, ts string, low_confidence boolean, repeated boolean, score double").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, part in enumerate(("ts < '2024-01-01 05:00:00'", "ts > '2024-01-01 05:00:00'")):
        frame.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(state.session_states(stream), spark, tmp_path, "states")
    turns = {(r.session_id, r.turn_no): (r.low_before, r.repeat_before, r.low_streak, r.repeat_streak, r.escalate) for r in got if r.event == "turn"}
    assert turns["s1", 1] == (0, 0, 1, 0, False) and turns["s1", 2] == (1, 0, 2, 1, True) and turns["s1", 3] == (2, 1, 0, 2, False)
    assert {r.session_id for r in got if r.event == "expired"} == {"s1", "s2"}


def test_expired_sessions_are_cleaned_up(spark, tmp_path):
    from tessellar.streaming import state

    chunks, seen = store.Chunks(spark, str(tmp_path)), []
    chunks.add_own(spark.createDataFrame([("a", "x", "", "", "en", store.OWN, "s1", "f", 1, None)], store.CHUNK), "s1")

    def bad(_):
        raise RuntimeError("hook")

    batch = spark.createDataFrame([("s1", "expired"), ("s2", "turn")], "session_id string, event string")
    failed = state.clean_up(batch, chunks, [bad, seen.append])(batch, 0)
    assert chunks.session_size("s1") == 0 and seen == ["s1"] and failed == ["s1: hook"]


def test_streams_of_metrics_and_traces(spark, tmp_path):
    from tessellar.streaming import events as live
    from tessellar.streaming import state

    rows = [(0, 1, "2024-01-01 00:10:00", "click", 1.0), (0, 1, "2024-01-01 00:50:00", "click", 3.0), (0, 2, "2024-01-01 08:00:00", "view", 5.0), (1, 2, "2024-01-01 09:00:00", "buy", 5.0), (2, 1, "2024-01-01 00:20:00", "click", 100.0), (3, 3, "2024-01-01 20:00:00", "view", 7.0)]
    frame = spark.createDataFrame(rows, "file int, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(4):  # the third file's event is later than the watermark allows
        frame.filter(F.col("file") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = {(str(r.started)[11:13], r.event_type): (r.n, r.mean_value) for r in run(live.live_metrics(read()), spark, tmp_path, "metrics_live")}
    assert got["00", "click"] == (2, 2.0) and got["08", "view"] == (1, 5.0)
    ids = run(state.adopt_sessions(read()), spark, tmp_path, "adopted")
    assert len({r.session_id for r in ids}) == len(ids) >= 1
    (tmp_path / "turns").mkdir()
    turns = spark.readStream.schema("question string").json(str(tmp_path / "turns"))
    (tmp_path / "turns" / "a.json").write_text('{"question": "call 01012345678"}\n')
    counted = []
    state.emit(turns, str(tmp_path / "trace"), lambda b: counted.append(b.count()), str(tmp_path / "cpe")).trigger(availableNow=True).start().awaitTermination(120)
    state.trace(turns, str(tmp_path / "trace2"), str(tmp_path / "cpt")).trigger(availableNow=True).start().awaitTermination(120)
    for place in ("trace", "trace2"):
        assert [r.question for r in spark.read.schema("question string").json(str(tmp_path / place)).collect()] == ["call <PII_PHONE_1>"]
    assert counted == [1]
