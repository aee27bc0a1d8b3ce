"""Rebuilding conversations from message rows.

Messages are read (roles in any usual spelling, times in any of the notations), repeated deliveries are merged, and each
conversation is checked as a sequence of turns. Nothing here holds a whole conversation in one task: order is established
within hours of a conversation, and hours are joined by what stands first and last in them.

Clocks. A reply cannot precede what it answers, nor follow the next question. Each pair of such messages bounds the offset between
the clocks of its two senders. The users' clocks are the reference, and one assistant serves a workspace, so all conversations
of a workspace bound one offset. What most of them allow is an interval; the least-squares correction is its point next to zero,
or, where the bounds contradict each other, the point that violates both least. Times are corrected by it, and conversations whose turns
are in an impossible order all the same are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir

#: Spellings of roles in exports of chats, by the role they mean.
ROLES = {
    "user": ("user", "human", "customer", "client", "prompter", "person", "end_user", "usr"),
    "assistant": ("assistant", "ai", "bot", "model", "chatbot", "agent", "gpt", "chatgpt", "asst"),
    "system": ("system", "sys", "developer"),
}
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
HOUR_MS = 3_600_000
#: Pairs from which the clock of a sender is estimated; with fewer it is taken to be right.
LEAST_PAIRS = 20
#: In place of the bound that a last reply does not have.
NEVER_MS = 1 << 50


def read_role(c: Column) -> Column:
    """user, assistant or system; null for anything else, null and blank included."""
    said = F.lower(F.regexp_replace(c, EDGE_SPACE, ""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, names in ROLES.items():
        out = out.when(said.isin(*names), role)
    return out


def read_time(c: Column) -> Column:
    """Milliseconds since 1970 of a time as text: ISO with or without offset (none is UTC), or the number itself; null if unreadable.

    The session's time zone has no part in it, and dates that don't exist are unreadable.
    """
    said = F.regexp_replace(c, EDGE_SPACE, "")
    iso = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?) ?([Zz]|[+-]\d{2}(?::?\d{2})?)?$"
    day, clock, zone = (F.regexp_extract(said, iso, i) for i in (1, 2, 3))
    zone = F.when(zone.isin("", "Z", "z"), "+00:00").when(F.length(zone) == 3, F.concat(zone, F.lit(":00"))).when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    full = F.concat(day, F.lit("T"), F.regexp_replace(clock, ",", "."), zone).try_cast("timestamp")
    number = F.when(said.rlike(r"^\d{11,15}$"), said.try_cast("bigint"))
    return F.when(said.rlike(iso), F.unix_millis(full)).otherwise(number)


def is_present(c: Column) -> Column:
    """Whether a text holds anything but white space (no-break spaces are white space); false for null."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def read_messages(messages: DataFrame, with_text: bool = False) -> DataFrame:
    """``conversation_id, role, request_id, content_hash, at`` (and ``content``): one row per message, at its earliest time.

    Rows without conversation_id or with blank content are left out; rows that agree in the four columns (nulls agree) are one
    message. ``role`` and ``at`` are null where they can't be read. Of merged rows' texts the least is kept. Rows are merged map-side
    first, so a conversation that holds a third of all rows is spread over tasks by its messages' hashes.
    """
    rows = messages.where(F.col("conversation_id").isNotNull() & is_present(F.col("content_summary"))).select(
        "conversation_id", read_role(F.col("role")).alias("role"), "request_id", "content_hash", read_time(F.col("created_at")).alias("at"), *([F.col("content_summary").alias("content")] if with_text else [])
    )
    return rows.groupBy("conversation_id", "role", "request_id", "content_hash").agg(F.min("at").alias("at"), *([F.min("content").alias("content")] if with_text else []))


def pair_bounds(turns: DataFrame) -> DataFrame:
    """``conversation_id, low, high``: between what an offset added to a reply's time must lie, one row for each pair; high is null for a last one.

    ``turns`` as from read_messages. A pair is the user's and the assistant's message of one request. The reply must not precede the question
    (low) nor follow the user's next message (high), which is found among the starts of the conversation's requests in order of the user's clock.
    Turns without role, time or request give no bound.
    """
    usable = turns.where(F.col("at").isNotNull() & F.col("role").isin("user", "assistant") & F.col("request_id").isNotNull())
    asked = usable.groupBy("conversation_id", "request_id").agg(F.min(F.when(F.col("role") == "user", F.col("at"))).alias("u"), F.min(F.when(F.col("role") == "assistant", F.col("at"))).alias("a"))
    hours = asked.where(F.col("u").isNotNull()).withColumn("h", F.floor(F.col("u") / HOUR_MS))
    firsts = hours.groupBy("conversation_id", "h").agg(F.min("u").alias("first"))
    later = firsts.withColumn("after", F.lead("first").over(W.partitionBy("conversation_id").orderBy("h"))).select("conversation_id", "h", "after")
    within = hours.withColumn("next", F.lead("u").over(W.partitionBy("conversation_id", "h").orderBy("u", "request_id")))
    bounds = within.join(later, ["conversation_id", "h"]).withColumn("next", F.coalesce("next", "after"))
    return bounds.where(F.col("a").isNotNull()).select("conversation_id", (F.col("u") - F.col("a")).alias("low"), (F.col("next") - F.col("a")).alias("high"))


def clock_offsets(turns: DataFrame) -> DataFrame:
    """``conversation_id, pairs, low_ms, high_ms, offset_ms, feasible``: the offset that one conversation's own pairs ask for.

    It is the least (the clocks being taken as shared unless the bounds say otherwise) that meets all bounds: 0 clamped to the interval from
    the greatest low to the least high. If that is empty the constraints are infeasible, and offset is null. Conversations without pairs do not appear.
    """
    out = pair_bounds(turns).groupBy("conversation_id").agg(F.count("*").alias("pairs"), F.max("low").alias("low_ms"), F.min("high").alias("high_ms"))
    feasible = F.col("high_ms").isNull() | (F.col("low_ms") <= F.col("high_ms"))
    offset = F.greatest(F.col("low_ms"), F.least(F.lit(0).cast("bigint"), F.coalesce("high_ms", F.lit(0).cast("bigint"))))
    return out.withColumn("feasible", feasible).withColumn("offset_ms", F.when(feasible, offset))


def _senders(conversations: DataFrame, sender: str) -> DataFrame:
    name = F.min(F.col(sender).cast("string")) if sender in conversations.columns else F.min(F.lit(None).cast("string"))
    return conversations.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("conversation_id")).agg(name.alias("sender"))


def sender_offsets(turns: DataFrame, conversations: DataFrame, sender: str = "workspace_id", least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """``sender, pairs, low_ms, high_ms, offset_ms``: what must be added to the times of each assistant, one for each value of ``sender``.

    low and high are medians over all pairs of the sender's conversations: half the pairs allow no less, half no more. A conversation that is
    out of order by itself is thus outvoted, and a clock that is wrong shows in most. Between them the least-squares offset is 0 clamped to the
    interval; if they contradict each other, their mean. Unknown conversations and those without a sender share one. Medians are exact up
    to 10,000 distinct values and within 1/10,000 of the rank beyond; they are taken map-side first, so one sender may hold any share of the rows.
    """
    b = pair_bounds(turns).join(_senders(conversations, sender), "conversation_id", "left")
    half = lambda c: F.percentile_approx(c, 0.5, 10_000)
    g = b.groupBy("sender").agg(F.count("*").alias("pairs"), half("low").alias("low_ms"), half(F.coalesce("high", F.lit(NEVER_MS))).alias("high_ms"))
    zero = F.lit(0).cast("bigint")
    offset = F.when(F.col("pairs") < least_pairs, zero).when(F.col("low_ms") <= F.col("high_ms"), F.greatest(F.col("low_ms"), F.least(zero, F.col("high_ms")))).otherwise(F.floor((F.col("low_ms") + F.col("high_ms")) / 2))
    return g.withColumn("offset_ms", offset)


def correct(turns: DataFrame, conversations: DataFrame, sender: str = "workspace_id", least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """``turns`` with the assistants' times corrected by sender_offsets().

    The offsets that are not zero are made first and written; as a rule there are none, and the turns are passed on without being joined.
    """
    checkpoint_dir(turns.sparkSession)
    off = sender_offsets(turns, conversations, sender, least_pairs).where("offset_ms <> 0").select("sender", "offset_ms").checkpoint()
    if off.isEmpty():
        return turns
    here = turns.join(_senders(conversations, sender), "conversation_id", "left").withColumnRenamed("sender", "__s")
    moved = F.col("at") + F.when(F.col("role") == "assistant", F.coalesce("offset_ms", F.lit(0))).otherwise(0)
    return here.join(off, F.col("__s").eqNullSafe(F.col("sender")), "left").withColumn("at", moved).drop("__s", "sender", "offset_ms")


def sequence_flags(turns: DataFrame) -> DataFrame:
    """One row per conversation: whether it has turns, is out of order, or lacks a reply.

    ``turns`` as from read_messages. Turns (without those of system) are ordered by time, user before assistant at equal times.
    Infeasible is a first turn of assistant or two of assistant in a row. Each hour of a conversation is ordered for itself;
    the hours are then chained by their first and last roles.
    """
    turn = F.coalesce(F.col("role") != "system", F.lit(True))
    bad = F.col("role").isNull() | F.col("at").isNull()
    # Unreadable turns have no place in time; they are counted in an hour of their own.
    t = turns.select("conversation_id", "role", "at", turn.alias("turn"), bad.alias("bad"), F.when(~bad & turn, F.floor(F.col("at") / HOUR_MS)).alias("h"))
    placed = F.col("h").isNotNull()
    lag = F.lag("role").over(W.partitionBy("conversation_id", "h").orderBy("at", F.desc("role")))
    hours = t.withColumn("before", F.when(placed, lag)).groupBy("conversation_id", "h").agg(
        F.max("turn").alias("turn"), F.max("bad").alias("bad"),
        F.min(F.when(placed, F.struct("at", F.col("role") != "user", "role")))["role"].alias("first"),
        F.max(F.when(placed, F.struct("at", F.col("role") != "user", "role")))["role"].alias("last"),
        F.max((F.col("role") == "assistant") & (F.col("before") == "assistant")).alias("aa"),
        F.max((F.col("role") == "user") & (F.col("before") == "user")).alias("uu"),
    )
    chain = W.partitionBy("conversation_id").orderBy(F.col("h").asc_nulls_first())
    prev, nxt = F.lag("last").over(chain), F.lead("first").over(chain)
    no = F.lit(False)
    joined = hours.withColumns({"prev": prev, "nxt": nxt})
    return joined.groupBy("conversation_id").agg(
        F.max("turn").alias("has_turn"),
        F.max("bad").alias("unreadable"),
        F.max(F.coalesce("aa", no) | F.coalesce((F.col("first") == "assistant") & (F.col("prev").isNull() | (F.col("prev") == "assistant")), no)).alias("infeasible"),
        F.max(F.coalesce("uu", no) | F.coalesce((F.col("last") == "user") & (F.col("nxt").isNull() | (F.col("nxt") == "user")), no)).alias("unanswered"),
    )


def rejected(messages: DataFrame, conversations: DataFrame, sender: str = "workspace_id", least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """``conversation_id, reason``: the conversations to drop, each with the first reason that applies.

    ``empty``: no turn besides those of system. ``broken``: unknown in conversations, a role or time that can't be read, or turns in an
    order that no reply-before constraint allows at the senders' clocks. ``no_reply``: a user's turn that nobody answers. Null ids never appear;
    repeated rows of either table change nothing; ids known to one table only are judged like the rest.
    """
    turns = read_messages(messages)
    return _rejected(messages, conversations, correct(turns, conversations, sender, least_pairs))


def _rejected(messages: DataFrame, conversations: DataFrame, turns: DataFrame) -> DataFrame:
    known = conversations.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).distinct().withColumn("known", F.lit(True))
    # Ids of messages whose rows are all blank are conversations too.
    ids = messages.where(F.col("conversation_id").isNotNull()).select("conversation_id").distinct()
    flags = ids.join(sequence_flags(turns), "conversation_id", "left").join(known, "conversation_id", "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~yes("has_turn"), "empty").when(~yes("known") | yes("unreadable") | yes("infeasible"), "broken").when(yes("unanswered"), "no_reply")
    return flags.select("conversation_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def assemble(messages: DataFrame, conversations: DataFrame, sender: str = "workspace_id", least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """``conversation_id, turn, role, at, content``: the turns of the conversations that are kept, numbered from 1 in order of time.

    System messages are turns here; at equal times system comes before user and user before assistant, then by request and hash. Turns
    are numbered within hours and shifted by the turns of the hours before, so that no task sorts a whole conversation.
    """
    turns = correct(read_messages(messages, with_text=True), conversations, sender, least_pairs)
    keep = turns.join(_rejected(messages, conversations, turns), "conversation_id", "left_anti").withColumn("h", F.floor(F.col("at") / HOUR_MS))
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    numbered = keep.withColumn("n", F.row_number().over(W.partitionBy("conversation_id", "h").orderBy("at", rank, "request_id", "content_hash")))
    hours = keep.groupBy("conversation_id", "h").agg(F.count("*").alias("k"))
    before = hours.withColumn("shift", F.coalesce(F.sum("k").over(W.partitionBy("conversation_id").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    return numbered.join(before, ["conversation_id", "h"]).select("conversation_id", (F.col("n") + F.col("shift")).alias("turn"), "role", F.timestamp_millis("at").alias("at"), "content")
