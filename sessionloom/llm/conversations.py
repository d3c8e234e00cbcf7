"""Conversations rebuilt from message rows.

The rows are an event log: a record may be delivered again, edited, deleted or
tried again. Each record folds to its last version, the versions to turns of a
user or an assistant. The turns of a session are put in order and validated,
and of answers that follow one another to one parent the last one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.operators import hierarchy, ordering

# How logs spell the speakers, and event types that are no messages.
USER = ["user", "human", "customer", "end_user", "enduser", "prompter"]
ASSISTANT = ["assistant", "ai", "model", "bot", "agent", "gpt", "chatbot"]
USER_EVENTS = ["user", "user.message", "turn.prompt", "user_message", "human"]
ASSISTANT_EVENTS = ["assistant", "assistant.message", "assistant_message", "agent_message", "ai"]
NO_MESSAGE = r"(?i)reason|think|tool|function|system|session|meta|title|usage|token"
DELETED = r"(?i)(^|[._])(delete|deleted|retract|retracted|tombstone)$"


def speaker(event_type: Column, role: Column) -> Column:
    """user, assistant or null; the role decides, and the event type where there is none."""
    r, e = F.lower(F.trim(role)), F.lower(F.trim(event_type))
    by_role = F.when(r.isin(USER), "user").when(r.isin(ASSISTANT), "assistant")
    by_event = F.when(e.isin(USER_EVENTS), "user").when(e.isin(ASSISTANT_EVENTS), "assistant")
    return F.when(e.rlike(NO_MESSAGE), F.lit(None)).otherwise(F.when(F.coalesce(r, F.lit("")) != "", by_role).otherwise(by_event))


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x{FEFF}\x{200B}]")


def fold(lines: DataFrame) -> DataFrame:
    """The last version of each (session_id, id), without deleted records; no contents are moved.

    Columns: session_id, record, id, parent_id, line_id, seq, event_timestamp,
    speaker, is_blank. Versions follow received_at, then line_id: an edit is a
    later row of the same id, a deletion one whose event type says so. A row
    without an id is a record of its own, one without a session is left out.
    The result is written down, since turns and links both come from it.
    """
    runtime.require_columns(lines, "session_id", "id", "parent_id", "line_id", "seq", "received_at", "event_type", "msg_role", "msg_content", "event_timestamp")
    said = {"speaker": speaker(F.col("event_type"), F.col("msg_role")), "is_blank": blank(F.col("msg_content")), "gone": F.coalesce(F.col("event_type").rlike(DELETED), F.lit(False))}
    key = F.coalesce(F.col("id"), F.concat(F.lit("\x1fline "), F.col("line_id").cast("string")))
    version = F.struct(F.col("received_at"), F.col("line_id"))
    held = F.struct("id", "parent_id", "line_id", "seq", "event_timestamp", *said)
    last = lines.where("session_id is not null").withColumns(said).groupBy("session_id", key.alias("record")).agg(F.max(F.struct(version.alias("v"), held.alias("h"))).alias("m"))
    return runtime.materialise(last.select("session_id", "record", "m.h.*").where("not gone").drop("gone"), "log")


def messages(log: DataFrame) -> DataFrame:
    """Final turns of a folded log, unordered."""
    return log.where("speaker is not null and not is_blank").drop("is_blank")


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` (session_id, seq, line_id, instant) with ``place`` and ``block``.

    The order is that of the instants. A turn without one stands right after the
    turn before it by seq; turns without a seq come first, by line_id.
    """
    numbered = turns.withColumns({"seq": F.coalesce(F.col("seq"), F.lit(-1)), "micros": F.unix_micros("instant")})
    numbered = ordering.cut_by_range(numbered, "session_id", ["seq", "line_id"], "at")
    placed = ordering.with_previous(numbered, "session_id", ["seq", "line_id"], "micros", "before", F.col("at"))
    placed = placed.withColumn("place", F.coalesce("micros", "before", F.lit(-(1 << 62)))).drop("micros", "before", "at")
    return ordering.cut_by_range(placed, "session_id", ["place", "seq", "line_id"], "block")


_ORDER = ["place", "seq", "line_id"]


def faults(sessions: DataFrame, log: DataFrame, ordered: DataFrame, group_rows: int = hierarchy.GROUP_ROWS) -> DataFrame:
    """(session_id, fault) of the sessions to drop; a session may have several faults.

    broken: a parent_id of the folded ``log`` names no record left in the
    session, or the links run in a circle. empty: no turns. no_reply: a user's
    turn is followed by another of the user, or by none. ``ordered`` is the
    result of ``in_order``; whether answers were tried again makes no
    difference. Sessions that ``sessions`` lacks have no faults; null ones are
    left out.
    """
    known = sessions.where("session_id is not null").select("session_id").distinct()
    links = hierarchy.nested_sets(log, "session_id", "record", "parent_id", "seq", group_rows=group_rows)
    broken = links.where("link in ('orphan', 'cycle', 'below-cycle')").select(F.col("grp").alias("session_id"), F.lit("broken").alias("fault"))
    empty = known.join(ordered.select("session_id").distinct(), "session_id", "left_anti").select("session_id", F.lit("empty").alias("fault"))
    after = ordering.with_previous(ordered, "session_id", _ORDER, "speaker", "last_speaker", F.col("block"))
    twice = after.where("speaker = 'user' and last_speaker = 'user'").select("session_id")
    ends = ordered.groupBy("session_id").agg(F.max_by("speaker", F.struct(*_ORDER)).alias("last")).where("last = 'user'").select("session_id")
    unanswered = twice.unionByName(ends).select("session_id", F.lit("no_reply").alias("fault"))
    return broken.unionByName(empty).unionByName(unanswered).distinct().join(known, "session_id", "left_semi")


def without_retries(ordered: DataFrame) -> DataFrame:
    """``ordered`` without answers that the next turn replaces: an answer of the assistant to the same parent."""
    back = {f"__{c}": -F.col(c) for c in _ORDER}
    answered = F.when(F.col("speaker") == "assistant", F.coalesce("parent_id", F.lit(""))).otherwise("")
    marked = ordered.withColumns({**back, "__to": answered})
    following = ordering.with_previous(marked, "session_id", list(back), "__to", "__next", -F.col("block"))
    return following.where((F.col("__to") == "") | ~F.coalesce(F.col("__to") == F.col("__next"), F.lit(False))).drop(*back, "__to", "__next")


def conversations(lines: DataFrame, ordered: DataFrame, dropped: DataFrame) -> DataFrame:
    """The turns of the sessions without faults: session_id, turn_no, id, speaker, instant, content.

    Contents move once, and only those of possible turns.
    """
    kept = without_retries(ordered.join(dropped.select("session_id").distinct(), "session_id", "left_anti"))
    numbered = ordering.with_position(kept, "session_id", _ORDER, "turn_no", F.col("block"))
    said = lines.where(speaker(F.col("event_type"), F.col("msg_role")).isNotNull() & ~blank(F.col("msg_content")))
    texts = said.select("line_id", F.col("msg_content").alias("content")).dropDuplicates(["line_id"])
    return numbered.join(texts, "line_id").select("session_id", "turn_no", "id", "speaker", "instant", "content")
