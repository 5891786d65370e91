"""Chat sessions: bounded history, its text form, expiry and clearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEPT = 10

# How history names the speakers, and the two prompts.
SPEAKERS = {"user": "用户", "other": "助手"}
WITH_HISTORY = "这是一个多轮对话，请根据对话历史和当前问题提供回答。\n\n对话历史：\n{conversation_history}\n\n当前问题：\n{current_question}\n\n相关文档信息：\n{document_info}\n\n请保持对话的连贯性，提供准确和有用的回答。\n"
WITHOUT_HISTORY = "基于以下检索到的相关信息，请回答用户的问题。请确保答案准确、完整，并引用相关的文档内容。\n\n用户问题：\n{question}\n\n检索到的相关信息：\n{retrieved_info}\n\n请提供一个结构化的回答，包括：\n1. 直接回答\n2. 支持证据\n3. 相关文档引用\n"


def last_messages(messages: DataFrame, key: str, order: str, most: int = KEPT) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", F.lit(SPEAKERS["user"])).otherwise(F.lit(SPEAKERS["other"])), F.lit(": "), text)


def formatted(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Per session the lines of its (bounded) history, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line(F.col("role"), F.col("text")).alias("l"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("history"))


def recent(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    keys = ["session_id", "title", "status", "session_created"]
    own = messages.groupBy("session_id").agg(F.count("message_id").alias("n"), F.max("created_at").alias("last"))
    out = sessions.join(own, "session_id", "left").select(*keys, F.coalesce("n", F.lit(0)).alias("message_count"), F.col("last").alias("last_message_time"))
    return out.orderBy(F.desc_nulls_last("last_message_time"), "session_id")


def expire(sessions: DataFrame, messages: DataFrame, now: Column, hours: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions after, messages left, sessions closed): active sessions without an update for so many hours are closed, their messages go."""
    old = (F.col("status") == "active") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(0), hours))
    closed = sessions.filter(old).select("session_id")
    return sessions.withColumn("status", F.when(old, F.lit("closed")).otherwise(F.col("status"))), messages.join(closed, "session_id", "left_anti"), closed


def clear(messages: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    return messages.join(sessions.select(key), key, "left_anti")


def prompt(question: str, document_info: str, history: str = "") -> str:
    if history:
        return WITH_HISTORY.format(conversation_history=history, current_question=question, document_info=document_info)
    return WITHOUT_HISTORY.format(question=question, retrieved_info=document_info)
