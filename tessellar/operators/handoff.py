"""Tickets for human agents: a masked transcript of the last messages, hours of service, the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safety
from . import conversation


def last_messages(turns: DataFrame, n: int = 6, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with `messages`: the last n (role, content) of any role up to this one."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)
    return turns.withColumn("messages", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w))


def open_tickets(escalated: DataFrame, turns: DataFrame, at: Column, n: int = 20) -> DataFrame:
    """(ticket_id, session_id, reason, transcript, agent_available) for escalated turns (conv_id, turn, reason): the transcript is masked as it enters the queue."""
    talk = last_messages(turns, n).select("conv_id", "turn", "messages")
    rows = escalated.join(talk, ["conv_id", "turn"])
    hidden = F.transform("messages", lambda m: m.withField("content", F.coalesce(safety.mask(m["content"]), F.lit(""))))
    id_ = F.concat(F.lit("HO-"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256), 1, 8)))
    return rows.select(id_.alias("ticket_id"), F.col("conv_id").alias("session_id"), "reason", hidden.alias("transcript"), conversation.agent_available(at).alias("agent_available"))


def message(ticket_id: Column, available: Column, arabic: Column) -> Column:
    """What a customer is told at the transfer, by language and hours of service."""
    now = F.when(arabic, F.concat(F.lit("نحولك الآن إلى زميل. رقم المرجع "), ticket_id)).otherwise(F.concat(F.lit("You are being transferred to a colleague. Your reference is "), ticket_id, F.lit(".")))
    later = F.when(arabic, F.concat(F.lit("سجلنا طلبك برقم "), ticket_id, F.lit(" وسنتواصل معك في ساعات العمل"))).otherwise(F.concat(F.lit("Your request is logged as "), ticket_id, F.lit("; a colleague will answer between 09:00 and 22:00.")))
    return F.when(available, now).otherwise(later)
