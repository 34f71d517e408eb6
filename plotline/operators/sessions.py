"""Chat-session tables: one row per session holding its message array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.arrays import append_message, drop_role, has_role, message, prepend_if_missing


def with_system_prompt(sessions: DataFrame, prompt: str, role: str = "system") -> DataFrame:
    """Insert a system message at position 0 of every session that has none."""
    return sessions.withColumn("messages", prepend_if_missing(
        F.coalesce("messages", F.array().cast(sessions.schema["messages"].dataType)),
        message(role, prompt), role))


def flag_system(sessions: DataFrame, role: str = "system") -> DataFrame:
    return sessions.select("id", has_role("messages", role).alias("has_system"),
                           F.size("messages").alias("n_messages"))


def append_turn(sessions: DataFrame, user_text: str, reply_text: str) -> DataFrame:
    """Add a user message then an assistant reply to every session."""
    m = append_message(append_message("messages", message("user", user_text)),
                       message("assistant", reply_text))
    return sessions.withColumn("messages", m)


def explode_messages(sessions: DataFrame, hide_role: str | None = "system") -> DataFrame:
    """One row per message (conv_id, pos, role, text), optionally without one role."""
    msgs = drop_role("messages", hide_role) if hide_role else F.col("messages")
    return (sessions.select(F.col("id").alias("conv_id"), F.posexplode(msgs).alias("pos", "m"))
            .select("conv_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("text")))


def latest_session(sessions: DataFrame) -> DataFrame:
    """The newest session (by created_at, ties: largest id) as one row."""
    return sessions.agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("_l")) \
        .select("_l.id", "_l.created_at")


def session_messages(sessions: DataFrame, session_id) -> DataFrame:
    """Messages of one session; an unknown id gives one row with an empty array."""
    spark = sessions.sparkSession
    want = spark.range(1).select(F.lit(session_id).cast(sessions.schema["id"].dataType).alias("id"))
    t = sessions.schema["messages"].dataType
    return (want.join(sessions.select("id", "messages"), "id", "left")
            .select("id", F.coalesce("messages", F.array().cast(t)).alias("messages")))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Insert-or-replace by key: every new row, plus the old rows whose key is not new."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))
