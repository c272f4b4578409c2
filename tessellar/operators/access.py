"""Who may do what: resolution of the account a request means, permission ladder, actions, tickets and the audit of every decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import insights


def is_action(intent: Column) -> Column:
    return intent.isin(*fixed.ACTION_SCOPES)


def customers_of(grants: DataFrame) -> DataFrame:
    """(session_id, customer_id): the distinct accounts of each session."""
    return grants.select("session_id", "customer_id").distinct()


def has_permission(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """The requests (session_id, customer_id, scope) that hold a grant; a blank field never does."""
    keys = ["session_id", "customer_id", "scope"]
    filled = [F.coalesce(F.col(k), F.lit("")) != "" for k in keys]
    return requests.filter(filled[0] & filled[1] & filled[2]).join(grants.select(*keys).distinct(), keys, "left_semi")


def resolve(requests: DataFrame, grants: DataFrame, customers: DataFrame) -> DataFrame:
    """requests (request_id, session_id, intent, slots: map) with `resolved`: the account meant, or null.

    A customer_id in the slots is a claim, a number is looked up; both count only if the session holds a grant on that
    account. Without either it is the session's account, if it has exactly one.
    """
    asked = requests.withColumns({"_claim": F.nullif(F.col("slots")["customer_id"], F.lit("")), "_number": F.nullif(F.trim(F.col("slots")["msisdn"]), F.lit(""))})
    known = customers.select(F.col("msisdn").alias("_number"), F.col("customer_id").alias("_by_number"))
    held = customers_of(grants)
    only = held.groupBy("session_id").agg(F.count("*").alias("_n"), F.min("customer_id").alias("_only"))
    out = asked.join(known, "_number", "left").withColumn("_target", F.when(F.col("_claim").isNotNull(), F.col("_claim")).when(F.col("_number").isNotNull(), F.col("_by_number")))
    out = out.join(held.select("session_id", F.col("customer_id").alias("_target"), F.lit(True).alias("_granted")), ["session_id", "_target"], "left").join(only, "session_id", "left")
    explicit = F.col("_claim").isNotNull() | F.col("_number").isNotNull()
    found = F.when(explicit, F.when(F.col("_granted"), F.col("_target"))).when(F.col("_n") == 1, F.col("_only"))
    return out.select(*[F.col(c) for c in requests.columns], found.alias("resolved"))


def decide(requests: DataFrame, grants: DataFrame, customers: DataFrame, scopes: dict[str, str] | None = None) -> DataFrame:
    """requests with `resolved`, `allowed` and `reason`.

    What is no action is allowed. Then: a session, a scope for the intent, an account, and a grant of that scope on it. A missing
    grant and a foreign account read alike, so that no answer tells which accounts exist.
    """
    scopes = fixed.ACTION_SCOPES if scopes is None else scopes
    scope = F.create_map(*[F.lit(x) for kv in scopes.items() for x in kv])
    out = resolve(requests, grants, customers).withColumn("_scope", scope[F.col("intent")])
    granted = grants.select("session_id", F.col("customer_id").alias("resolved"), F.col("scope").alias("_scope")).distinct().withColumn("_ok", F.lit(True))
    out = out.join(granted, ["session_id", "resolved", "_scope"], "left")
    action, blank = is_action(F.col("intent")), F.coalesce("session_id", F.lit("")) == ""
    reason = (
        F.when(~action, "").when(blank, fixed.NO_SESSION).when(F.col("_scope").isNull(), F.concat(F.lit(fixed.NO_SCOPE), "intent"))
        .when(F.col("resolved").isNull(), fixed.NO_ACCOUNT)
        .when(F.col("_ok").isNull(), F.concat(F.lit(fixed.NO_GRANT[0]), F.col("_scope"), F.lit(fixed.NO_GRANT[1]))).otherwise("")
    )
    allowed = ~action | (~blank & F.col("_ok").isNotNull())
    account = F.when(action & ~blank & F.col("_scope").isNotNull(), F.col("resolved"))
    return out.select(*[F.col(c) for c in requests.columns], account.alias("resolved"), allowed.alias("allowed"), reason.alias("reason"))


def audit(decisions: DataFrame, at: Column) -> DataFrame:
    """One audit row for each decision on an action, refusals included."""
    id_ = F.substring(F.sha2(F.concat_ws("|", "session_id", F.col("request_id").cast("string"), "intent"), 256), 1, 32)
    return decisions.filter(is_action(F.col("intent"))).select(id_.alias("audit_id"), "session_id", "intent", F.col("allowed").cast("int").alias("allowed"), "reason", at.cast("string").alias("created_at"))


def ticket_rows(decisions: DataFrame, at: Column) -> DataFrame:
    """The tickets that allowed requests open: subject of at most 200 characters, body of at most 2,000, the description or the subject in its place."""
    slot = lambda k: F.nullif(F.col("slots")[k], F.lit(""))
    subject = F.substring(F.trim(F.coalesce(slot("subject"), F.lit(fixed.TICKET_SUBJECT))), 1, 200)
    body = F.nullif(F.substring(F.trim(F.coalesce(slot("body"), slot("description"), F.lit(""))), 1, 2000), F.lit(""))
    id_ = F.concat(F.lit("TKT-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "session_id", F.col("request_id").cast("string")), 256), 1, 10)))
    rows = decisions.filter((F.col("intent") == "create_support_ticket") & F.col("allowed") & F.col("resolved").isNotNull())
    return rows.select(id_.alias("ticket_id"), F.col("resolved").alias("customer_id"), "session_id", subject.alias("subject"), F.coalesce(body, subject).alias("body"), F.lit("open").alias("status"), at.cast("string").alias("created_at"), "request_id")


def bill_rows(decisions: DataFrame, customers: DataFrame) -> DataFrame:
    """What allowed requests for a balance read: the sign is resolved here."""
    rows = decisions.filter((F.col("intent") == "check_bill_balance") & F.col("allowed") & F.col("resolved").isNotNull())
    status, amount = insights.balance_status(F.col("balance"))
    out = rows.join(customers.select(F.col("customer_id").alias("resolved"), "plan", "balance", "bill_due_date"), "resolved")
    return out.select("request_id", "plan", F.round("balance", 2).alias("balance"), "bill_due_date", status.alias("status"), amount.alias("amount_due"))


#: Actions by intent: from decisions, customers and a time to (request_id, result).
HANDLERS: dict[str, Callable[[DataFrame, DataFrame, Column], DataFrame]] = {
    "check_bill_balance": lambda decisions, customers, at: bill_rows(decisions, customers).select("request_id", F.create_map(F.lit("plan"), "plan", F.lit("status"), "status", F.lit("amount_due"), F.col("amount_due").cast("string"), F.lit("bill_due_date"), "bill_due_date").alias("result")),
    "create_support_ticket": lambda decisions, customers, at: ticket_rows(decisions, at).select("request_id", F.create_map(F.lit("ticket_id"), "ticket_id", F.lit("status"), "status").alias("result")),
}


def execute(decisions: DataFrame, customers: DataFrame, at: Column, handlers: dict | None = None) -> DataFrame:
    """decisions with `executed` and `result`: allowed actions run by their intent's handler; without one, or without a row from it, nothing is executed."""
    results = None
    for handler in (HANDLERS if handlers is None else handlers).values():
        part = handler(decisions, customers, at)
        results = part if results is None else results.unionByName(part)
    out = decisions.join(results, "request_id", "left") if results is not None else decisions.withColumn("result", F.lit(None).cast("map<string,string>"))
    return out.withColumn("executed", F.col("result").isNotNull())


def tickets_for(tickets: DataFrame, customer_id: str) -> DataFrame:
    return tickets.filter(F.col("customer_id") == customer_id).orderBy(F.desc("created_at"))


def audit_trail(log: DataFrame, session_id: str) -> DataFrame:
    return log.filter(F.col("session_id") == session_id).orderBy("created_at")
