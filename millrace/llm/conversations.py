"""Rebuilding ordered conversations from single message rows.

Rows are sessionized by their channel (``session_id``), sorted by ``seq`` or, without it, by
``created_at`` with the question first on a tie, and spelled-out roles are mapped to the two
speakers. Sessions that are empty, broken or lack a reply are reported and dropped. Within a
kept session a new part begins after an inactivity gap longer than a threshold calibrated on the
gaps of all kept sessions. ``dropped`` doesn't split at gaps: a session is what its channel says, and a late answer still answers.

Rows without a channel are sessionized by their participant (``by_participant``): sorted by time, split at calibrated gaps, roles that
aren't named are inferred from alternation and content, and sessions without a reply to a question are dropped.

Neighbours are compared inside *chunks* of a session (1,024 sequence numbers or one hour),
and only one small row per chunk is compared across them, so a session that holds a third of
all rows is spread over as many tasks as it has chunks.

Defined results: a message id counts once (of rows that differ the smallest is taken); rows with a
null id count as messages of their own; null or blank ``session_id`` is ignored; a session with
some but not all numbers null is broken; a null ``user_id`` names nobody and so is not another
user; an empty messages table makes every session ``empty``. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import fold
from millrace.plans.session import materialize

#: Spellings of the speakers, folded.
USER_ROLES = ("user", "human", "customer", "client", "patient", "question", "nguoi dung", "khach", "khach hang", "utilisateur")
ASSISTANT_ROLES = ("assistant", "ai", "bot", "chatbot", "model", "gpt", "agent", "answer", "tro ly", "assistante")
SYSTEM_ROLES = ("system", "sys", "developer", "he thong", "systeme")

#: Sequence numbers and seconds of a chunk.
CHUNK_SEQ, CHUNK_S = 1024, 3600

#: White space, separators, control and format characters, and letters that show nothing.
INVISIBLE = r"[\s\p{Z}\p{C}ᅟᅠ⠀ㅤﾠ︀-️͏]"


def visible(text: Column) -> Column:
    """Whether a text shows anything at all; null does not."""
    return F.coalesce(F.length(F.regexp_replace(text, INVISIBLE, "")) > 0, F.lit(False))


def role_of(role: Column) -> Column:
    """``user``, ``assistant``, ``system``, or null for a role that names no speaker."""
    plain = F.trim(F.regexp_replace(fold(role), r"[^a-z]+", " "))
    return (
        F.when(plain.isin(*USER_ROLES), "user").when(plain.isin(*ASSISTANT_ROLES), "assistant").when(plain.isin(*SYSTEM_ROLES), "system")
    )


def _messages(messages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per message id of a session with what the rules need, plus the columns in ``keep``."""
    spoken = messages.select(
        F.col("id").alias("id"),
        F.col("session_id").alias("session_id"),
        F.col("user_id").alias("user_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("created_at").alias("created_at"),
        role_of(F.col("role")).alias("speaker"),
        visible(F.col("content")).alias("shown"),
        *[F.col(c).alias(c) for c in keep],
    ).filter(F.length(F.regexp_replace("session_id", INVISIBLE, "")) > 0)
    rest = [c for c in spoken.columns if c != "id"]
    own = spoken.filter("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("m")).select("id", "m.*")
    return own.unionByName(spoken.filter("id is null"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds the chunk and the sort key of each row."""
    first = F.when(F.col("speaker") == "system", 0).when(F.col("speaker") == "user", 1).when(F.col("speaker") == "assistant", 2).otherwise(3)
    at = F.col("created_at").cast("timestamp").cast("double")
    letter = lambda n: F.ascii(F.substring(F.coalesce("id", F.lit("")), n, 1)).cast("bigint")
    return rows.withColumns(
        {
            # rows with neither are in the order of role and id, so their stretches are those of an id's first characters
            "chunk": F.coalesce(F.floor(F.col("seq") / CHUNK_SEQ), F.floor(at / CHUNK_S), F.lit(1 << 50) + first * F.lit(1 << 44) + letter(1) * F.lit(1 << 22) + letter(2)),
            "key": F.struct(
                F.coalesce(F.col("seq"), F.lit(1 << 60)).alias("s"), F.coalesce(at, F.lit(1e15)).alias("t"), first.alias("r"), F.col("id").alias("i")
            ),
        }
    )


def _turn() -> Column:
    return F.when(F.coalesce(F.col("speaker"), F.lit("?")) != "system", F.struct(F.coalesce("speaker", F.lit("?")).alias("speaker"), F.col("shown").alias("shown")))


def dropped(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, reason``: the sessions to drop, with the first reason that applies."""
    rows = _numbered(_messages(messages, []))
    cell = W.partitionBy("session_id", "chunk").orderBy("key")
    back, ahead = cell.rowsBetween(W.unboundedPreceding, -1), cell.rowsBetween(1, W.unboundedFollowing)
    turn = _turn()
    near = rows.withColumns(
        {
            "turn": turn,
            "before": F.last(turn, ignorenulls=True).over(back),
            "after": F.first(turn, ignorenulls=True).over(ahead),
            "seq_before": F.lag("seq").over(cell),
        }
    )
    spoken = F.col("turn").isNotNull()
    chunks = near.groupBy("session_id", "chunk").agg(
        F.bool_or(spoken & F.col("shown")).alias("any_shown"),
        F.bool_or(F.col("speaker").isNull()).alias("no_speaker"),
        F.bool_or(spoken & (F.col("speaker") == "user") & ~F.col("shown")).alias("blank_question"),
        F.bool_or((F.col("speaker") == "assistant") & F.col("before").isNotNull() & (F.col("before.speaker") != "user")).alias("loose_answer"),
        F.bool_or((F.col("speaker") == "user") & F.col("after").isNotNull() & ~((F.col("after.speaker") == "assistant") & F.col("after.shown"))).alias("unanswered"),
        F.bool_or(F.col("seq_before").isNotNull() & (F.col("seq") != F.col("seq_before") + 1)).alias("gap"),
        F.count("seq").alias("seqs"),
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("seq_first"),
        F.max("seq").alias("seq_last"),
        F.min_by("turn", F.when(spoken, F.col("key"))).alias("first"),
        F.max_by("turn", F.when(spoken, F.col("key"))).alias("last"),
        F.min(F.when(spoken, F.col("user_id"))).alias("user_low"),
        F.max(F.when(spoken, F.col("user_id"))).alias("user_high"),
    )
    line = W.partitionBy("session_id").orderBy("chunk")
    edges = chunks.withColumns(
        {
            "before": F.last("last", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)),
            "after": F.first("first", ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing)),
            "seq_before": F.lag("seq_last").over(line),
        }
    )
    answered = F.coalesce((F.col("after.speaker") == "assistant") & F.col("after.shown"), F.lit(False))
    heard = edges.groupBy("session_id").agg(
        F.bool_or("any_shown").alias("any_shown"),
        F.bool_or(
            F.col("no_speaker")
            | F.coalesce("blank_question", F.lit(False))
            | F.coalesce("loose_answer", F.lit(False))
            | F.coalesce("gap", F.lit(False))
            | F.coalesce((F.col("first.speaker") == "assistant") & (F.coalesce(F.col("before.speaker"), F.lit("")) != "user"), F.lit(False))
            | F.coalesce(F.col("seq_first") != F.col("seq_before") + 1, F.lit(False))
        ).alias("broken"),
        F.bool_or(F.coalesce("unanswered", F.lit(False)) | F.coalesce((F.col("last.speaker") == "user") & ~answered, F.lit(False))).alias("unanswered"),
        (F.sum("seqs") > 0).alias("numbered"),
        (F.sum("seqs") == F.sum("n")).alias("all_numbered"),
        F.min("seq_first").alias("seq_first"),
        F.min("user_low").alias("user_low"),
        F.max("user_high").alias("user_high"),
    )
    known = (
        sessions.filter(F.length(F.regexp_replace("id", INVISIBLE, "")) > 0)
        .groupBy(F.col("id").alias("session_id"))
        .agg(F.min("user_id").alias("owner_low"), F.max("user_id").alias("owner_high"), F.lit(True).alias("stored"))
    )
    both = known.join(heard, "session_id", "full_outer")
    stranger = (F.col("user_low") < F.col("owner_low")) | (F.col("user_high") > F.col("owner_high"))
    broken = (
        F.col("stored").isNull()
        | F.coalesce(stranger, F.lit(False))
        | F.col("broken")
        | (F.col("numbered") & (~F.col("all_numbered") | (F.col("seq_first") != 1)))
    )
    reason = F.when(~F.coalesce("any_shown", F.lit(False)), "empty").when(broken, "broken").when(F.col("unanswered"), "missing_reply")
    return both.select("session_id", reason.alias("reason")).filter("reason is not null")


def conversations(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, part, turn, role, content, created_at`` of the sessions that are kept.

    ``turn`` counts a session's turns from 1. ``part`` counts the stretches between inactivity gaps;
    a gap is unusual when the logarithm of its seconds is above the third quartile by three
    interquartile ranges, measured over all sessions.
    """
    bad = dropped(messages, sessions).select("session_id")
    rows = _messages(messages, ["content"]).filter(F.col("speaker").isin("user", "assistant"))
    kept = _numbered(rows.join(bad, "session_id", "left_anti"))
    return _parts(kept).select(
        "session_id", F.col("part").cast("bigint").alias("part"), F.col("turn").cast("bigint").alias("turn"), F.col("speaker").alias("role"), "content", "created_at"
    )


def _parts(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``_numbered``) with ``turn``, their number in the session, and ``part``, the number of the stretch between gaps."""
    cell = W.partitionBy("session_id", "chunk").orderBy("key")
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    # null without a row before, so that the last row of the chunk before counts
    wait = lambda now, then: F.when(seconds(now) >= seconds(then), seconds(now) - seconds(then)).when(seconds(now) < seconds(then), 0.0)
    inside = rows.withColumns({"at_chunk": F.row_number().over(cell), "then": F.lag("created_at").over(cell)})
    chunks = inside.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min_by("created_at", "key").alias("head"), F.max_by("created_at", "key").alias("tail"))
    line = W.partitionBy("session_id").orderBy("chunk")
    offsets = chunks.select(
        "session_id",
        "chunk",
        F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("tail").over(line).alias("tail"),
    )
    joined = inside.join(offsets, ["session_id", "chunk"]).withColumns(
        {"turn": F.col("before") + F.col("at_chunk"), "gap": F.log1p(F.coalesce(wait("created_at", "then"), wait("created_at", "tail")))}
    )
    # read for the quartiles, the sums and the result
    joined = materialize(joined.drop("at_chunk", "then", "before", "tail"), "turns")
    spread = joined.agg(F.percentile_approx("gap", F.array(F.lit(0.25), F.lit(0.75)), 1000).alias("q"))
    limit = spread.select((F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])).alias("limit"))
    # one row, so the join below is a broadcast of one number
    marked = joined.join(F.broadcast(limit)).withColumn("opens", F.coalesce((F.col("gap") > F.col("limit")).cast("int"), F.lit(0)))
    sums = marked.groupBy("session_id", "chunk").agg(F.sum("opens").alias("opened"))
    earlier = sums.select("session_id", "chunk", F.coalesce(F.sum("opened").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("opened_before"))
    part = F.lit(1) + F.col("opened_before") + F.sum("opens").over(cell.rowsBetween(W.unboundedPreceding, 0))
    return marked.join(earlier, ["session_id", "chunk"]).withColumn("part", part).drop("opens", "opened_before", "limit", "gap")


#: How a question looks, folded.
_ASKING = r"\?\s*$|^(?:what|how|can|could|is|are|does|do|should|which|when|where|why|who|quel|quelle|quels|combien|comment|est ce|puis je|peut on|cho (?:em|toi|minh) hoi|co (?:duoc|nen)|lam sao|bao nhieu)\b"


def inferred(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``_numbered``) with ``speaker`` also where the role names none: it alternates with the row before, else with the one after; where neither is named its content tells.

    Of the chunks before and after one small row each is looked at.
    """
    cell, line = W.partitionBy("session_id", "chunk").orderBy("key"), W.partitionBy("session_id").orderBy("chunk")
    earlier = line.rowsBetween(W.unboundedPreceding, -1)
    other = lambda c: F.when(c == "user", "assistant").when(c == "assistant", "user")
    said = F.when(F.col("speaker") != "system", F.col("speaker"))
    before, since = F.last(said, ignorenulls=True).over(cell.rowsBetween(W.unboundedPreceding, -1)), F.count(said).over(cell.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumns({"_before": before, "_run": since, "_next": F.lead(said).over(cell), "_at": F.row_number().over(cell)})
    named = said.isNotNull()
    chunks = marked.groupBy("session_id", "chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(said, "key").alias("_head"),
        F.max_by(said, F.when(named, F.col("key"))).alias("_last"),
        F.max(F.when(named, F.col("_at"))).alias("_named_at"),
    )
    placed = chunks.withColumn("_rows", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    edges = placed.select(
        "session_id",
        "chunk",
        "_n",
        F.last("_last", ignorenulls=True).over(earlier).alias("_said"),
        F.lead("_head").over(line).alias("_after"),
        # rows of earlier chunks since the last that is named
        (F.col("_rows") - F.coalesce(F.max(F.col("_rows") + F.col("_named_at")).over(earlier), F.lit(0))).alias("_carried"),
    )
    # of several unnamed rows in a row every second is the same speaker's
    nth = F.row_number().over(W.partitionBy("session_id", "chunk", "_run").orderBy("key"))
    known = marked.withColumn("_nth", nth).join(edges, ["session_id", "chunk"])
    last, place = F.coalesce("_before", "_said"), F.col("_nth") + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)
    turned = F.when(place % 2 == 1, other(last)).otherwise(last)
    follows = F.when(F.col("_at") == F.col("_n"), F.col("_after")).otherwise(F.col("_next"))
    content = F.when(fold(F.coalesce("content", F.lit(""))).rlike(_ASKING), "user").otherwise("assistant")
    return known.withColumn("speaker", F.coalesce("speaker", turned, other(follows), content)).select(*rows.columns)


def by_participant(messages: DataFrame) -> DataFrame:
    """``session_id, turn, role, content, created_at`` of conversations among the rows that have no channel but a ``user_id``.

    ``session_id`` is the participant and the number of the stretch between gaps; conversations without an answer right after a question are dropped.
    """
    loose = messages.filter(F.coalesce(F.length(F.regexp_replace("session_id", INVISIBLE, "")), F.lit(0)) == 0).filter("user_id is not null")
    # what has no channel has no numbering either
    rows = _messages(loose.withColumns({"session_id": F.col("user_id"), "seq": F.lit(None).cast("bigint")}), ["content"]).filter(F.coalesce("speaker", F.lit("")) != "system")
    rows = _parts(inferred(_numbered(rows.filter("shown"))))
    cell = W.partitionBy("session_id", "chunk").orderBy("key")
    line = W.partitionBy("session_id").orderBy("chunk")
    tails = rows.groupBy("session_id", "chunk").agg(F.max_by(F.struct("speaker", "part"), "key").alias("tail"))
    # the first row of a chunk follows the last one of the chunk before
    rows = rows.join(tails.select("session_id", "chunk", F.lag("tail").over(line).alias("_tail")), ["session_id", "chunk"])
    then = F.coalesce(F.lag(F.struct("speaker", "part")).over(cell), F.col("_tail"))
    replies = (F.col("speaker") == "assistant") & (then["speaker"] == "user") & (then["part"] == F.col("part"))
    kept = rows.withColumn("replies", replies).groupBy("session_id", "part").agg(F.bool_or("replies").alias("replied"), F.min("turn").alias("first")).filter("replied")
    return rows.join(kept, ["session_id", "part"]).select(
        F.concat_ws("#", "session_id", F.col("part").cast("string")).alias("session_id"), (F.col("turn") - F.col("first") + 1).cast("bigint").alias("turn"), F.col("speaker").alias("role"), "content", "created_at"
    )
