"""Intent repair, citations, fallbacks, measures against plain Python, checks of evaluation sets."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessellar.functions import fixed
from tessellar.operators import answers, insights, metrics

PASSAGES = "array<struct<title:string,url:string,doc_name:string,page:int,text:string>>"
P = [("Page 1", "https://x.org/1", None, None, "Passage one."), ("", "https://x.org/2", None, None, "word " * 80), (None, None, "bill.pdf", 3, " Passage three. ")]


def intent(spark, message, raw):
    return spark.createDataFrame([(message, raw)], "m string, r string").select(answers.detect_intent(F.col("m"), F.col("r")).alias("x")).first().x


def told(name, sure=None, **more):
    return json.dumps({"intent": name} | ({} if sure is None else {"confidence": sure}) | more)


#: How a model may dress its object; none of it may change what is read.
DRESS = {"bare": "%s", "spaced": "\n  %s \n", "fence": "```\n%s\n```", "named fence": "```json\n%s\n```", "before": "My choice is %s", "after": "%s\nNothing else fits."}
#: Outputs without an object that could be read.
JUNK = {"prose": "balance, surely", "open": '{"intent": "human_handoff"', "list": '["human_handoff", 0.9]', "number": "42", "word": "true", "blank": " ", "no fields": "{}", "failed": None}


@pytest.mark.parametrize("dress", DRESS)
@pytest.mark.parametrize("quote", ['"', "'"])
def test_an_object_is_found_in_any_dress(spark, dress, quote):
    got = intent(spark, "what do I owe", DRESS[dress] % told("check_bill_balance", 0.75, slots={}).replace('"', quote))
    assert got.intent == "check_bill_balance" and got.confidence == pytest.approx(0.75)


@pytest.mark.parametrize("junk", JUNK)
def test_no_object_never_acts(spark, junk):
    got = intent(spark, "what do I owe", JUNK[junk])
    assert (got.intent, got.confidence, got.slots) == ("answer_question", 0.0, {})


@pytest.mark.parametrize("name,sure,want,read", [
    ("create_support_ticket", fixed.LEAST_ACTION, "create_support_ticket", fixed.LEAST_ACTION), ("create_support_ticket", fixed.LEAST_ACTION - 0.01, "answer_question", fixed.LEAST_ACTION - 0.01), ("out_of_scope", 0.01, "out_of_scope", 0.01),
    ("answer_question", 12, "answer_question", 1.0), ("answer_question", -3, "answer_question", 0.0), ("answer_question", "high", "answer_question", 0.0), ("answer_question", None, "answer_question", 0.0),
    (" OUT-of scope ", 0.5, "out_of_scope", 0.5), ("handoff", 0.5, "human_handoff", 0.5), ("the_human_handoff_intent", 0.5, "human_handoff", 0.5), ("bill_balance", 0.99, "answer_question", 0.99), ("weather", 0.9, "answer_question", 0.9), (None, 0.9, "answer_question", 0.9),
])
def test_names_and_confidence_are_repaired_to_the_safe_side(spark, name, sure, want, read):
    got = intent(spark, "hello there", told(name, sure))
    assert got.intent == want and got.confidence == pytest.approx(read)


@pytest.mark.parametrize("message,want,sure", [("\t\n", "out_of_scope", 1.0), (None, "out_of_scope", 1.0), ("connect with an agent please, live agent", "human_handoff", 0.99)])
def test_some_messages_need_no_model(spark, message, want, sure):
    got = intent(spark, message, told("create_support_ticket", 1.0))
    assert (got.intent, got.confidence) == (want, sure)


def test_slots(spark):
    asked = {"body": "line " * 700, "msisdn": "+20 (0)111 222", "customer_id": "  c7 ", "subject": None, "description": "", "balance": "9", "sql": "x"}
    got = intent(spark, "open a case", told("create_support_ticket", 0.8, slots=asked)).slots
    assert got == {"body": ("line " * 700).strip()[:2000], "msisdn": "200111222", "customer_id": "c7"}
    masked = intent(spark, "q", told("check_bill_balance", 0.8, slots={"msisdn": " <PII_PHONE_3>"})).slots
    assert masked == {"msisdn": "<PII_PHONE_3>"} and intent(spark, "q", told("check_bill_balance", 0.8, slots={"msisdn": "mine"})).slots == {"msisdn": "mine"}


@pytest.mark.parametrize("text,clean,markers,urls", [
    ("The plan costs 300 [1] and includes data [3].", "The plan costs 300 [1] and includes data [2].", ["[1]", "[2]"], ["https://x.org/1", None]),
    ("Real [3] but  invented [9] .", "Real [1] but invented .", ["[1]"], [None]), ("Only [9].", "Only [9].", [], []), ("none", "none", [], []), ("[2][2][1] $1 \\", "[2][2][1] $1 \\", ["[1]", "[2]"], ["https://x.org/1", "https://x.org/2"]),
])
def test_citations(spark, text, clean, markers, urls):
    got = spark.createDataFrame([(text, P)], f"t string, p {PASSAGES}").select(answers.extract_citations(F.col("t"), F.col("p")).alias("x")).first().x
    assert got.text == clean and [c.marker for c in got.citations] == markers and [c.url for c in got.citations] == urls
    assert all(len(c.snippet) <= 221 for c in got.citations)


def test_passages_fallback_and_refusal(spark):
    frame = spark.createDataFrame([("a", P, 0.9, "en"), ("b", P, 0.1, "en"), ("c", [], 0.9, "en")], f"question string, passages {PASSAGES}, confidence double, language string")
    shown = frame.select(answers.format_passages(F.col("passages")).alias("x")).first().x
    assert shown.startswith("[1] (page: Page 1)\nPassage one.\n\n[2] (page: https://x.org/2)\nword") and shown.endswith("[3] (customer document: bill.pdf, page 3)\nPassage three.")
    notices = {"no_context": "nothing found", "model_down": "closest passages:"}
    got = {r.question: r for r in answers.answer(frame, None, notices).collect()}
    assert got["a"].text.startswith("closest passages:\n\n[1] Passage one.\n[2] word") and len(got["a"].citations) == 3 and got["a"].resolution == "answered"
    assert got["b"].text == got["c"].text == "nothing found" and got["b"].resolution == "refused" and not got["c"].grounded
    told = {r.question: r for r in answers.answer(frame, lambda p: F.when(p.isNotNull(), F.lit("See [2].")), notices).collect()}
    assert told["a"].text == "See [1]." and told["a"].citations[0].url == "https://x.org/2" and told["b"].resolution == "refused"
    silent = answers.answer(frame, lambda p: F.lit("  "), notices).filter("question = 'a'").first()
    assert silent.text == "nothing found" and silent.resolution == "no_answer"


def test_sources_and_unmasking(spark):
    frame = spark.createDataFrame([("See [1].", [("[1]", "bill <PII_PHONE_1>", None, "b.pdf", 2, "s <PII_PHONE_1>")], {"<PII_PHONE_1>": "0101"}), ("none", [], {})], "t string, c array<struct<marker:string,title:string,url:string,doc_name:string,page:int,snippet:string>>, m map<string,string>")
    one, two = frame.select(answers.with_sources(F.col("t"), answers.unmask_citations(F.col("c"), F.col("m"))).alias("x"), answers.unmask_citations(F.col("c"), F.col("m")).alias("c")).collect()
    assert one.x == "See [1].\n\nSources:\n[1] bill 0101 — b.pdf (p.2)" and one.c[0].snippet == "s 0101" and two.x == "none"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 10, 14, 20, 60, 100, 137, 4000])
def test_nearest_rank_by_brackets(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(n)]
    frame = spark.createDataFrame([("g", v) for v in values] + [(None, v + 1) for v in values] + [("g", None)], "k string, v double")
    got = {r.k: r for r in insights.percentile_table(frame, ["k"], "v", [5, 50, 95]).collect()}
    assert set(got) == ({"g", None} if n else set())
    for k, shift in (("g", 0), (None, 1)) if n else ():
        ordered = sorted(v + shift for v in values)
        for p in (5, 50, 95):
            at = min(max(round(p / 100 * n + 0.5), 1), n)
            assert getattr(got[k], f"p{p}") == ordered[at - 1] and got[k].n == n


def test_empty_summary(spark):
    kinds = {"executed": "boolean", "grounded": "boolean", "handed_off": "boolean", "blocked": "boolean", "input_mode": "string", "total_ms": "double"}
    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", " + ", ".join(f"{s} double" for s in metrics.fixed.STAGES)
    r = metrics.summary(spark.createDataFrame([], schema)).first()
    assert r.turns == r.grounded_rate == r.p95_total_ms == r.actions_refused == 0 and r.avg_asr_ms is None


def test_report_and_evaluation_tables(spark):
    one = {"turns": 2, "voice_turns": 1, "text_turns": 1, "grounded_rate": 0.5, "escalation_rate": 0.0, "blocked_turns": 0, "actions_executed": 1, "actions_refused": 0, "avg_total_ms": 12.3, "p95_total_ms": 20.0}
    report = metrics.markdown(one, {"intent": [("answer_question", 2)], "language": [("en", 2)]}, ["why?"])
    assert "| grounded rate | 50.0% |" in report and "| answer_question | 2 |" in report and report.endswith("- why?") and metrics.markdown({"turns": 0}, {}, []) == "No turns."
    ranked = lambda *x: spark.createDataFrame([(i, r) for i, r in enumerate(x)], "query int, hit_rank int")
    table = metrics.compare_models({"a": ranked(1, None), "b": ranked(2, 1)}, {"a": True}).collect()
    assert [(r.model, r.commercial, r.recall, r.mrr) for r in table] == [("b", False, 1.0, 0.75), ("a", True, 0.5, 0.5)]
    timed = spark.createDataFrame([("en", 1, 3.0), ("en", None, 4.0), ("ar", 2, 9.0)], "language string, hit_rank int, ms double")
    got = {r.language: (r.recall, r.mrr, r.median_latency_ms) for r in insights.recall_mrr(timed, ["language"], "ms").collect()}
    assert got[None] == (0.667, 0.5, 4.0) and got["en"] == (0.5, 0.5, statistics.median([3.0, 4.0]))
    urls = spark.createDataFrame([("https://x.org/plans/a", ["/plans"]), ("https://x.org/b", ["/plans", "/c"])], "u string, e array<string>")
    assert [r.x for r in urls.select(metrics.any_fragment(F.col("u"), F.col("e")).alias("x")).collect()] == [True, False]
    assert {(r.outcome, r.n) for r in metrics.crawl_stats(spark.createDataFrame([("fetched",), ("fetched",), ("failed",)], "outcome string")).collect()} == {("fetched", 2), ("failed", 1)}


def test_manifest_and_licences(spark):
    items = spark.createDataFrame([(1, "a.wav", "hi", "en", "clean"), (2, "b.wav", " ", "arz", "noisy"), (3, None, "x", None, "silence"), (4, "d.wav", None, "en", "silence")], "item int, audio string, reference string, dialect string, condition string")
    files = spark.createDataFrame([("a.wav",), ("b.wav",)], "audio string")
    got = {(r.item, r.problem) for r in metrics.manifest_problems(items, files).collect()}
    assert got == {(2, "b.wav: empty reference transcript"), (3, "entry 3: missing field 'audio'"), (3, "entry 3: missing field 'dialect'"), (4, "d.wav: missing field 'reference'"), (4, "d.wav: file not found")}
    assert {(r.kind, r.value) for r in metrics.uncovered(items).collect()} == {("dialect", "ar")}
    models, licences = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "model string"), spark.createDataFrame([("a", "mit"), ("b", "cc-by-nc"), ("c", "unverified")], "model string, licence string")
    assert {r.model for r in metrics.unlicensed(models, licences, ["mit"], ["c"]).collect()} == {"b", "d"}


def test_session_counts_with_speech(spark):
    turns = spark.createDataFrame([("s", "voice", 0.5, True, "answered", False, False, True), ("s", "text", None, False, "refused", True, False, None)], "session_id string, input_mode string, asr_confidence double, grounded boolean, resolution string, blocked boolean, handed_off boolean, executed boolean")
    speech = spark.createDataFrame([("s", True, False), ("t", False, True)], "session_id string, filtered boolean, clarified boolean")
    got = {r.session_id: r for r in metrics.session_metrics(turns, speech).collect()}
    assert (got["s"].turns, got["s"].mean_asr_confidence, got["s"].refused, got["s"].filtered, got["t"].turns, got["t"].clarified) == (2, 0.5, 1, 1, 0, 1)
    empty = metrics.registry(turns).first()
    assert (empty.sessions_tracked, empty.wer_n, empty.wer_mean) == (1, 0, None)
