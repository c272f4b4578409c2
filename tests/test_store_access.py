"""Scoped tables of chunks, account resolution, the permission ladder, actions and audit."""

import pytest
from pyspark.sql import functions as F

from tessellar.operators import access, curate, handoff, search, store

CUSTOMERS = [("c1", "0101", "A", "p", 213.5, "2026-10-05"), ("c2", "0119", "B", "q", -42.0, "2026-09-28"), ("c3", "0120", "C", "q", 0.0, None)]
GRANTS = [("s1", "c1", "billing:read"), ("s1", "c1", "tickets:write"), ("s2", "c1", "billing:read"), ("s2", "c2", "billing:read"), ("s3", "c3", "tickets:write")]


def chunk(id_, text="x", kind=store.OWN, session="s1"):
    return (id_, text, "", "", "en", kind, session, "f.txt", 1, None)


def test_chunks_stay_in_their_session(spark, tmp_path):
    chunks = store.Chunks(spark, str(tmp_path))
    frame = lambda *rows: spark.createDataFrame(list(rows), store.CHUNK)
    chunks.add_own(frame(chunk("a"), chunk("b")), "s1")
    chunks.add_own(frame(chunk("c", session="s2")), "s2")
    chunks.add_own(frame(chunk("a", "new")), "s1")
    assert {(r.chunk_id, r.text, r.score, r.dense_score) for r in chunks.of_session("s1").collect()} == {("a", "new", 0.0, None), ("b", "x", 0.0, None)}
    for bad in (lambda: chunks.add_own(frame(chunk("d", session="s2")), "s1"), lambda: chunks.add_own(frame(chunk("d", kind=store.SHARED)), "s1"), lambda: chunks.add_shared(frame(chunk("d"))), lambda: chunks.of_session(""), lambda: chunks.delete_session(" "), lambda: chunks.session_size(None)):
        with pytest.raises(store.ScopeError):
            bad()
    assert chunks.delete_session("s1") == 2 and chunks.session_size("s1") == 0 and chunks.session_size("s2") == 1 and chunks.delete_session("none") == 0
    chunks.add_shared(frame(chunk("k", kind=store.SHARED, session=None)))
    assert chunks.shared_size() == 1 and [r.chunk_id for r in chunks.by_ids(spark.createDataFrame([("k",), ("zz",)], "chunk_id string")).collect()] == ["k"]
    chunks.reset_shared()
    assert chunks.shared_size() == 0 and chunks.session_size("s2") == 1


def test_tables_and_keys(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "customers"), store.CUSTOMERS)
    rows = spark.createDataFrame(CUSTOMERS, store.CUSTOMERS)
    table.insert_absent(rows, ["customer_id"])
    table.insert_absent(rows.withColumn("plan", F.lit("other")), ["customer_id"])
    assert {r.plan for r in table.read().collect()} == {"p", "q"} and table.read().count() == 3
    assert store.repeated(table.read(), store.KEYS["customers"]).count() == 0
    assert store.repeated(rows.union(rows.limit(1)), store.KEYS["customers"]).count() == 2
    assert '"a":"é","b":null' in store.json_lines(spark.createDataFrame([("é", None)], "a string, b string")).first().line


def test_permission_ladder(spark):
    ask = [
        (1, "s1", "answer_question", {}), (2, "", "check_bill_balance", {}), (3, "s1", "check_bill_balance", {}), (4, "s2", "check_bill_balance", {}), (5, "s2", "check_bill_balance", {"customer_id": "c2"}), (6, "s1", "check_bill_balance", {"customer_id": "c2"}),
        (7, "s1", "check_bill_balance", {"msisdn": " 0101 "}), (8, "s1", "check_bill_balance", {"msisdn": "0119"}), (9, "s3", "check_bill_balance", {}), (10, "s3", "create_support_ticket", {"description": "slow"}), (11, None, "create_support_ticket", {}), (12, "s3", "create_support_ticket", {"subject": "x" * 300}),
    ]
    requests = spark.createDataFrame(ask, "request_id int, session_id string, intent string, slots map<string,string>")
    customers, grants = spark.createDataFrame(CUSTOMERS, store.CUSTOMERS), spark.createDataFrame(GRANTS, store.PERMISSIONS)
    decided = access.decide(requests, grants, customers).cache()
    got = {r.request_id: (r.allowed, r.resolved, r.reason) for r in decided.collect()}
    nobody = "could not resolve the account this request refers to"
    assert got[1] == (True, None, "") and got[2] == (False, None, "no session") and got[3] == (True, "c1", "") and got[4] == (False, None, nobody)
    assert got[5] == (True, "c2", "") and got[6] == (False, None, nobody) and got[7] == (True, "c1", "") and got[8] == (False, None, nobody)
    assert got[9] == (False, "c3", "session is not authorised for billing:read on this account") and got[10][0] and got[11] == (False, None, "no session")
    at = F.lit("2026-01-01")
    done = {r.request_id: (r.executed, r.result) for r in access.execute(decided, customers, at).collect()}
    assert done[5][1]["status"] == "due" and done[5][1]["amount_due"] == "42.0" and done[3][1]["status"] == "settled" and not done[1][0] and not done[9][0]
    tickets = {r.request_id: r for r in access.ticket_rows(decided, at).collect()}
    assert set(tickets) == {10, 12} and (tickets[10].subject, tickets[10].body) == ("Customer support request", "slow") and len(tickets[12].subject) == len(tickets[12].body) == 200
    log = access.audit(decided, at)
    assert log.count() == 11 and store.repeated(log.withColumn("session_id", F.coalesce("session_id", F.lit(""))), [["audit_id"]]).count() == 0
    assert [r.allowed for r in access.audit_trail(log, "s3").collect()].count(1) == 2
    held = access.has_permission(spark.createDataFrame([("s1", "c1", "billing:read"), ("s1", "", "billing:read"), ("s3", "c1", "billing:read")], store.PERMISSIONS), grants)
    assert held.count() == 1


def test_index_documents(spark, tmp_path):
    chunks = store.Chunks(spark, str(tmp_path))
    text = "\n".join(f"A sentence number {i} that tells something about plans." for i in range(40))
    pages = spark.createDataFrame([(text, "Plans", "https://x.org/p", "en", None, None, None)], "text string, title string, url string, language string, session_id string, doc_name string, page int")
    made = store.index_documents(pages, chunks, search.stub_embedding, 16, reset=True)
    rows = made.collect()
    assert chunks.shared_size() == len(rows) >= 2 and all(len(r.embedding) == 16 and r.text.startswith("Plans\n") for r in rows)
    with pytest.raises(store.ScopeError):
        store.index_documents(pages, chunks, search.stub_embedding, 17)
    with pytest.raises(ValueError):
        store.index_documents(pages.withColumn("text", F.lit("short")), chunks, search.stub_embedding, 16)
    with pytest.raises(Exception, match="vector length"):
        curate.check_dimension(made, "embedding", 3).collect()


def test_chunk_ids_differ_by_session(spark):
    text = "A line of text that is long enough to be a chunk on its own, because it goes on and on and on until there are many characters in it."
    page = lambda s, d: (text, "bill.pdf", "", "en", s, d, 1)
    rows = spark.createDataFrame([page("s1", "bill.pdf"), page("s2", "bill.pdf"), page("s1", "bill.pdf")], "text string, title string, url string, language string, session_id string, doc_name string, page int")
    ids = [r.chunk_id for r in curate.chunk_rows(rows, store.OWN).collect()]
    assert len(ids) == 3 and len(set(ids)) == 2


def test_handoff_queue(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} 01012345678") for i in range(30)], "conv_id long, turn long, role string, text string")
    first = spark.createDataFrame([(1, 25, "anger")], "conv_id long, turn long, reason string")
    t = handoff.open_tickets(first, turns, F.lit("2026-01-01 06:59:00").cast("timestamp")).first()
    assert len(t.transcript) == 20 and t.transcript[-1].content == "turn 25 <PII_PHONE_1>" and t.agent_available is False
    told = spark.range(1).select(handoff.message(F.lit("HO-1"), F.lit(True), F.lit(False)).alias("a"), handoff.message(F.lit("HO-1"), F.lit(False), F.lit(True)).alias("b")).first()
    assert "HO-1" in told.a and "HO-1" in told.b and told.a != told.b
