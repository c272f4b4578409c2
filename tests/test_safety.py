"""Numbered masking against a sequential rewrite in Python, its seed, passages, storage, transcripts."""

import re

import pytest
from pyspark.sql import functions as F

from tessellar.functions import fixed, safety
from tessellar.operators import conversation, store

TEXTS = [
    "call 01012345678 or a@b.com", "id 29001011234567 end", "pay 4111 1111 1111 1111 now, 4111111111111112 not", "account 01012345678", "acct: 1234567 and again acct: 1234567", "01012345678 ... again 01012345678, 01198765432",
    "the plan costs 300 EGP and includes 200 GB", "", None, "IBAN EG380019000500000000263180002 x@y.org x@y.org z@y.org", "رقمي 01198765432 لو سمحت", "landline 0227402000", "order reference 1234567890123 shipped", "$1 \\ a@b.com $0",
]


def luhn(value):
    digits = [int(c) for c in re.sub(r"\D", "", value)][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def brute(text, seed=()):
    """One kind after another, by scanning; values are numbered as they come."""
    held = dict(seed)
    text = text or ""
    for label, pattern in fixed.PERSONAL:
        out, at = [], 0
        for m in re.finditer(pattern, text):
            v = m.group(0)
            out.append(text[at : m.start()])
            at = m.end()
            if label == "CARD" and not luhn(v):
                out.append(v)
                continue
            if v not in held.values():
                n = 1 + max((int(k.rsplit("_", 1)[1][:-1]) for k in held if k.startswith(f"<PII_{label}_")), default=0)
                held[f"<PII_{label}_{n}>"] = v
            out.append(next(k for k, x in held.items() if x == v))
        text = "".join(out) + text[at:]
    return text, held


def test_masking_numbers_values_in_order(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    seed = F.create_map(F.lit("<PII_PHONE_4>"), F.lit("01198765432"))
    rows = frame.select("i", safety.masked(F.col("t")).alias("m"), safety.masked(F.col("t"), seed).alias("s")).collect()
    for r in rows:
        assert (r.m.text, r.m.mapping) == brute(TEXTS[r.i])
        assert (r.s.text, r.s.mapping) == brute(TEXTS[r.i], {"<PII_PHONE_4>": "01198765432"})


def test_phone_is_masked_before_account(spark):
    got = spark.createDataFrame([("account 01012345678",)], "t string").select(safety.mask(F.col("t")).alias("x"), safety.kinds_found(safety.masked(F.col("t"))["mapping"]).alias("k")).first()
    assert got.x == "account <PII_PHONE_1>" and got.k == ["PHONE"]


def test_unmask_restores(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS if t], "t string")
    out = frame.select("t", safety.masked(F.col("t")).alias("m")).select("t", safety.unmask(F.col("m.text"), F.col("m.mapping")).alias("u"), safety.contains_placeholder(F.col("m.text")).alias("c"), F.size("m.mapping").alias("n")).collect()
    assert all(r.t == r.u and r.c == (r.n > 0) for r in out)


def test_passages_share_one_numbering(spark):
    rows = [(1, 2, "user_doc", "second 01198765432 and 01012345678", "bill-01198765432.pdf"), (1, 1, "user_doc", "first 01012345678", None), (1, 3, "shared", "call 0227402000", None), (2, 1, "user_doc", "x", "y")]
    frame = spark.createDataFrame(rows, "q int, rank int, kind string, text string, doc_name string")
    got = {(r.q, r.rank): r for r in safety.masked_passages(frame, "q", "rank", F.col("kind") == "user_doc", ["text", "doc_name"]).collect()}
    assert got[1, 1].text == "first <PII_PHONE_1>" and got[1, 2].text == "second <PII_PHONE_2> and <PII_PHONE_1>" and got[1, 2].doc_name == "bill-<PII_PHONE_2>.pdf"
    assert got[1, 3].text == "call 0227402000" and got[1, 1].doc_name is None and got[2, 1].mapping == {}
    assert got[1, 3].mapping == {"<PII_PHONE_1>": "01012345678", "<PII_PHONE_2>": "01198765432"} and got[1, 3].kind == "shared"


def test_stored_turns_hold_no_personal_data(spark):
    schema = "question string, transcript string, entities map<string,string>, citations array<struct<marker:string,title:string,snippet:string,doc_name:string>>, action struct<executed:boolean,result:map<string,string>>"
    p = "01012345678"
    frame = spark.createDataFrame([(f"call {p}", None, {"msisdn": p, "subject": "Outage"}, [("[1]", "t", f"line {p}", f"{p}.pdf")], (True, {"plan": "x", "balance": "213.5"})), (None, f"my {p}", {}, [], None)], schema)
    one, two = store.stored_turns(frame).collect()
    assert p not in str(one) + str(two) and "213.5" not in str(one) and one.entities["subject"] == "Outage"
    assert one.action.executed and one.action.result == {"redacted": "true", "fields": "balance,plan"} and two.action is None and two.question is None


@pytest.mark.parametrize("raw,text,bad", [(" please check my bill ", "please check my bill", False), ("thanks for watching", "", True), (None, "", False), ("  ", "", False), ("no no no no no no", "", True), ("x", "", True), ("...", "", True), ("this is a longer talk about translation, thanks for watching over it all", None, False), ("call me call me call me call me", "", True)])
def test_transcripts(spark, raw, text, bad):
    got = spark.createDataFrame([(raw,)], "t string").select(safety.transcript(F.col("t")).alias("x")).first().x
    assert got.spurious is bad and got.text == (raw if text is None else text)


def test_speech_confidence(spark):
    frame = spark.createDataFrame([([(0.0, 1.0, 0.0), (1.0, 1.0, -50.0)],), ([],)], "s array<struct<start:double,end:double,avg_logprob:double>>")
    assert [r.x for r in frame.select(safety.speech_confidence(F.col("s")).alias("x")).collect()] == [0.99, 0.0]
    heard = spark.createDataFrame([("a", 0.45), ("a", 0.44), (" ", 0.9)], "t string, c double")
    assert [r.x for r in heard.select(safety.needs_clarification(F.col("t"), F.col("c")).alias("x")).collect()] == [False, True, True]


@pytest.mark.parametrize("text,score", [("I want a human", 1.0), ("give me the manager page", 0.0), ("عايز اكلم موظف", 1.0), ("الخدمة بطيئة", 0.2), ("thanks a lot", 0.0), ("useless and terrible and awful", 0.4), ("DAMN!!", 0.25)])
def test_frustration(spark, text, score):
    no = F.lit(False)
    got = spark.createDataFrame([(text,)], "t string").select(conversation.frustration(F.col("t"), no, F.lit(0), no, F.lit(0), F.lit(True)).alias("x")).first().x
    assert got == pytest.approx(score)
