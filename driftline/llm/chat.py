"""Whole dialogues rendered from every speaker's side.

Every participant of a conversation in turn becomes the assistant, the others are users under their
names, and the spans of the assistant's words are the ones to learn from. Messages are put in order
by ranges, so that a dialogue of any length is rendered in segments of ``SEGMENT`` messages by as many
tasks as it needs: each segment has a row for every speaker of the whole conversation, tells where in
the whole rendering it begins, and carries the opening instructions. Put together by ``segment``, the
texts of a speaker are the whole dialogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ranks import ranked
from driftline.session import cut_lineage

SEGMENT = 64
#: Segments whose lengths are added up together, before those sums are; tasks that share a conversation.
TOGETHER, SALTS = 64, 16
#: Instructions are not spoken by a participant; they are rendered as what they are.
FIXED = ("system",)
END = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"


def named(role: Column) -> Column:
    """A speaker's name that can't end or nest a marker."""
    return F.coalesce(F.regexp_replace(role, r"[<|>\n]", "_"), F.lit("unknown"))


def spoken(text: Column) -> Column:
    """Words in which no marker can begin; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _headed(role: Column, fixed: Sequence[str]) -> Column:
    """The line in front of a message that isn't the assistant's."""
    user = F.concat(F.lit("<|user:"), role, F.lit("|>\n"))
    return F.when(role.isin(*fixed), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(user)


def _with_conversation(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``more`` has for their conversation, spread over salts."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = more.withColumnRenamed("conv_id", "_conv").withColumn("_salt", salt)
    left = rows.withColumn("_own", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int"))
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_own") == F.col("_salt"))).drop(
        "_conv", "_salt", "_own")


def _segments(messages: DataFrame, segment: int) -> DataFrame:
    """``conv_id, segment, messages, n_rows``: the messages of a conversation in order, ``segment`` to a row."""
    places = ranked(messages, "conv_id", "turn", "role", "text", label="chat-messages").numbered("place")
    first = places.groupBy("conv_id").agg(F.min("place").alias("first"))
    # Any spread will do here: the place in the whole table stands for the segment.
    spread = _with_conversation(places.withColumn("segment", F.floor(F.col("place") / segment)), first)
    numbered = spread.withColumn("segment", F.floor((F.col("place") - F.col("first")) / segment))
    return numbered.groupBy("conv_id", "segment").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "role", "text"))),
            lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")),
        ).alias("messages"),
        F.sum("copies").alias("n_rows"),
    )


def _speakers(messages: DataFrame, segments: DataFrame, fixed: Sequence[str]) -> DataFrame:
    """``conv_id, speaker, opening``: all who speak in a conversation, and the instructions it begins with."""
    given = F.filter("messages", lambda m: m["role"].isin(*fixed))
    opening = F.array_join(F.transform(given, lambda m: F.concat(_headed(m["role"], fixed), m["text"], F.lit(END))), "")
    openings = segments.where("segment = 0").select("conv_id", opening.alias("opening"))
    roles = messages.where(~F.col("role").isin(*fixed)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
    return openings.join(roles.distinct(), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def _offsets(sides: DataFrame) -> DataFrame:
    """Sides with the characters in front of them: sums inside groups of segments, then of the groups."""
    group = F.floor(F.col("segment") / TOGETHER)
    rows = sides.withColumn("group", group)
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "speaker", "group").orderBy("segment").rowsBetween(*before)
    groups = rows.groupBy("conv_id", "speaker", "group").agg(F.sum("length").alias("length"))
    among = Window.partitionBy("conv_id", "speaker").orderBy("group").rowsBetween(*before)
    starts = groups.select(
        F.col("conv_id").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("group").alias("_group"),
        F.coalesce(F.sum("length").over(among), F.lit(0)).alias("start"))
    same = (F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("speaker").eqNullSafe(F.col("_speaker"))
            & (F.col("group") == F.col("_group")))
    placed = rows.withColumn("inner", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(starts, same)
    return placed.select(
        "conv_id", "segment", "speaker", "opening", (F.col("start") + F.col("inner")).cast("long").alias("offset"))


def rotate(
    conversations: DataFrame, segment: int = SEGMENT, fixed: Sequence[str] = FIXED,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row for each speaker of a conversation and each of its segments.

    Returns ``conv_id, speaker, segment, offset, n_messages, n_rows, opening, text, spans, n_learn``.
    Segments are ``segment`` messages long, but for the last; ``offset`` is the length of the
    speaker's texts before it. ``opening`` repeats the instructions among the first segment's
    messages for all segments after it. ``spans`` are ``[start, stop)`` in characters of ``text``
    that the speaker says, end markers included, and ``n_learn`` is their total length. A speaker
    who is silent in a segment has a row without spans for it.

    Exactly repeated rows are one message, counted in ``n_rows``. Messages of one turn are ordered
    by role and text. A null conv_id is a conversation of its own, a null turn comes before turn 0, a
    null role is the speaker ``unknown``, and a null text is empty. A conversation without speakers
    (instructions only) gives rows with a null speaker and nothing to learn. An empty table gives no
    rows. Other columns are left out. The lengths of ``TOGETHER`` segments are added up before one
    task adds up those of a speaker's dialogue.
    """
    messages = cut_lineage(
        conversations.select(
            F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
            named(F.col(role)).alias("role"), spoken(F.col(text)).alias("text"),
        )
        .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")),
        "chat-distinct",
    )
    segments = cut_lineage(_segments(messages, segment), "chat-segments")
    # The length of a segment from each side, before anything is rendered.
    plain = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(
        F.concat(_headed(m["role"], fixed), m["text"], F.lit(END))))
    lengths = segments.select("conv_id", "segment", plain.alias("plain"), F.transform("messages", lambda m: m["role"]).alias("roles"))
    sides = _with_conversation(lengths, _speakers(messages, segments, fixed))
    own = F.size(F.filter("roles", lambda r: r == F.col("speaker")))
    shorter = F.length(_headed(F.col("speaker"), fixed)) - len(ASSISTANT)
    length = F.col("plain") - F.coalesce(own * shorter, F.lit(0))
    placed = _offsets(sides.select("conv_id", "segment", "speaker", "opening", length.alias("length")))
    rows = segments.withColumnsRenamed({"conv_id": "_conv", "segment": "_segment"}).join(
        placed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment")))
    mine = lambda m: F.coalesce(m["role"] == F.col("speaker"), F.lit(False))
    rendered = rows.withColumn("pieces", F.transform(
        "messages", lambda m: F.struct(
            F.when(mine(m), F.lit(ASSISTANT)).otherwise(_headed(m["role"], fixed)).alias("head"),
            F.concat(m["text"], F.lit(END)).alias("body"), mine(m).alias("learn"),
        )
    ))
    # Running lengths over the pieces give the spans.
    walked = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["learn"], F.concat(done["spans"], F.array(F.struct(
                (done["at"] + F.length(p["head"])).alias("start"),
                (done["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop"),
            )))).otherwise(done["spans"]).alias("spans"),
        ),
    )["spans"]
    return rendered.withColumn("spans", walked).select(
        "conv_id", "speaker", F.col("segment").cast("long").alias("segment"), "offset",
        F.size("pieces").cast("long").alias("n_messages"), "n_rows",
        F.when(F.col("segment") > 0, F.col("opening")).otherwise(F.lit("")).alias("opening"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), "spans",
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]).cast("long").alias("n_learn"),
    )
