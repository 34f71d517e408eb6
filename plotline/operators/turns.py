"""Chat sessions in long form: one row per message (conv_id, turn, role, text).

The same operations as ``sessions.py`` without building a per-session array, so a
session with an unbounded number of messages never has to fit in one row or one
task: every result below is a grouped aggregate (partial aggregation before the
shuffle) or a row-level filter/union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flags(turns: DataFrame, role: str = "system") -> DataFrame:
    """Per session: has a message of ``role``; message count."""
    return turns.groupBy(F.col("conv_id").alias("id")).agg(
        F.max((F.col("role") == role).cast("int")).cast("boolean").alias("has_system"),
        F.count(F.lit(1)).cast("int").alias("n_messages"))


def with_system_prompt(turns: DataFrame, prompt: str, role: str = "system") -> DataFrame:
    """Add a ``role`` message before the first turn of every session without one."""
    s = turns.groupBy("conv_id").agg(F.max((F.col("role") == role).cast("int")).alias("_has"),
                                     F.min("turn").alias("_first"))
    added = s.where(F.col("_has") == 0).select(
        "conv_id", (F.col("_first") - 1).alias("turn"), F.lit(role).alias("role"), F.lit(prompt).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(added)


def append_turn(turns: DataFrame, ids: DataFrame, user_text: str, reply_text: str) -> DataFrame:
    """For the sessions in ``ids`` (column conv_id): their turns plus a user message and
    an assistant reply after the last turn."""
    sel = turns.join(ids.select("conv_id").distinct(), "conv_id", "left_semi")
    last = sel.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    new = last.select("conv_id", F.explode(F.array(
        F.struct((F.col("_last") + 1).alias("turn"), F.lit("user").alias("role"), F.lit(user_text).alias("text")),
        F.struct((F.col("_last") + 2).alias("turn"), F.lit("assistant").alias("role"),
                 F.lit(reply_text).alias("text")))).alias("_m")).select("conv_id", "_m.*")
    return sel.select("conv_id", "turn", "role", "text").unionByName(new)


def session_messages(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The turns of the sessions in ``ids`` (column conv_id); an unknown id gives none."""
    return turns.join(ids.select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", "role", "text")


def append_replies(turns: DataFrame, replies: DataFrame) -> DataFrame:
    """For the sessions in ``replies`` (conv_id, question, reply, metadata; one row a
    session): their turns plus the question as a user message and the reply, with its
    ``metadata`` (a variant, NULL where the service sent none), as an assistant message.
    A session without turns begins with the question at turn 0.  Turns have the columns
    conv_id, turn, role, text, metadata; where ``turns`` has no metadata it is NULL."""
    meta = F.col("metadata") if "metadata" in turns.columns else F.lit(None).cast("variant").alias("metadata")
    sel = turns.join(replies.select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", "role", "text", meta)
    last = sel.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    at = F.coalesce("_last", F.lit(-1).cast(turns.schema["turn"].dataType))
    both = F.array(
        F.struct((at + 1).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text"),
                 F.lit(None).cast("variant").alias("metadata")),
        F.struct((at + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text"),
                 F.col("metadata")))
    new = replies.join(last, "conv_id", "left").select("conv_id", F.explode(both).alias("_m")).select("conv_id", "_m.*")
    return sel.unionByName(new.withColumn("turn", F.col("turn").cast(turns.schema["turn"].dataType)))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace whole sessions: every turn of ``new`` plus the turns of old sessions
    that ``new`` does not contain."""
    return new.unionByName(old.join(new.select("conv_id").distinct(), "conv_id", "left_anti"))


def summary(turns: DataFrame) -> DataFrame:
    """Per session: message count, first and last message (by turn)."""
    m = F.struct("role", "text")
    return (turns.groupBy(F.col("conv_id").alias("id"))
            .agg(F.count(F.lit(1)).cast("int").alias("n_messages"),
                 F.min_by(m, "turn").alias("_first"), F.max_by(m, "turn").alias("_last"))
            .select("id", "n_messages", F.col("_first.role").alias("first_role"),
                    F.col("_first.text").alias("first_content"), F.col("_last.role").alias("last_role"),
                    F.col("_last.text").alias("last_content")))


def latest(sessions_meta: DataFrame) -> DataFrame:
    """Newest session by created_at (ties: largest id), one row."""
    return sessions_meta.agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("_l")) \
        .select("_l.id", "_l.created_at")


def explode(turns: DataFrame, hide_role: str | None = "system", bucket: int = 10_000) -> DataFrame:
    """Messages in display order (conv_id, pos, role, text), optionally without one
    role.  ``pos`` is the 0-based rank of the turn within its session, computed
    without sorting a whole session in one task: turns are cut into ranges of
    ``bucket`` turn numbers, a running offset per (session, range) comes from the
    small per-range count table, and row numbers run only within a range."""
    from pyspark.sql import Window
    t = turns.where(F.col("role") != hide_role) if hide_role else turns
    t = t.withColumn("_b", F.floor(F.col("turn") / F.lit(bucket)))
    counts = t.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("conv_id", "_b").orderBy("turn")
    return (t.join(offsets, ["conv_id", "_b"])
            .select("conv_id", (F.col("_off") + F.row_number().over(within) - 1).cast("bigint").alias("pos"),
                    "role", "text"))
