"""Chat formatting by perspective rotation.

Each conversation is rendered once for each of its participants: that speaker's turns are
the assistant's, all other speakers are users with a name, and the loss mask covers the
assistant's text and its end mark.  Only DataFrame functions are used.

A rendering is returned in chunks of PART_TURNS turns, so that no row, buffer or join key grows
with the longest conversation.  Chunks are one dialogue: joined in order they are its whole
rendering, and spans and offsets count from its beginning.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties and repeated
rows have one order; a null role speaks as ``unknown``; a null text is empty; rows with a
null conv_id form one conversation; speakers in ``context_roles`` keep their role and get
no perspective of their own, so a conversation of such turns alone yields no row; an empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
STRETCH = 1024  # turn numbers that are put in order together
PART_TURNS = 4096  # turns of a chunk


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seq): turns numbered from 1 in each conversation.

    A stretch of turn numbers is sorted by itself, and its turns count on from those of the
    stretches before it, so the longest conversation is dealt over as many tasks as it has
    stretches.  Turns of one number (or of none) are in one stretch, put in order by role and
    text in Spark's external sort.  A struct key makes nulls equal, for the join as for the grouping.
    """
    key = F.struct("conv_id", F.floor(F.col("turn") / STRETCH).alias("stretch"))
    turns = conversations.select("conv_id", "turn", "role", "text", key.alias("key"))
    earlier = Window.partitionBy("key.conv_id").orderBy(F.col("key.stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("key").agg(F.count("*").alias("n")).select("key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    nth = turns.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return nth.join(counts, "key").select("conv_id", "turn", "role", "text", (F.col("nth") + F.col("before")).alias("seq"))


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS, context_roles: Sequence[str] = ("system",)) -> DataFrame:
    """(conv_id, perspective, part, first_turn, offset, n_turns, rendered, mask, spans, loss_chars).

    ``mask`` has one 0 or 1 a turn; ``spans`` lists the masked code-point ranges of the whole
    dialogue as ``start-end`` joined by commas; a chunk's first turn is the dialogue's
    ``first_turn``-th and begins ``offset`` code points into it.  Turns meet perspectives by
    conversation and part; what lies before a part is known from counts and lengths alone.
    """
    key = F.struct("conv_id").alias("conv")
    turns = numbered(conversations).select(
        key, "seq", F.floor((F.col("seq") - 1) / part_turns).cast("long").alias("part"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("said"),
    )
    as_context = F.col("speaker").isin(*context_roles)
    other = F.when(as_context, F.col("speaker")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    said = turns.groupBy("conv", "part", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("said")).alias("chars"))
    width = F.col("chars") + F.col("n") * (len(OPEN) + 1 + len(CLOSE) + F.length(other))
    parts = said.groupBy("conv", "part").agg(F.sum(width).alias("width"))
    people = said.where(~as_context).select("conv", F.col("speaker").alias("perspective")).distinct()
    own = said.select("conv", "part", F.col("speaker").alias("perspective"), "n")
    pairs = parts.join(people, "conv").join(own, ["conv", "part", "perspective"], "left")
    size = F.col("width") + F.coalesce("n", F.lit(0)) * (len("assistant") - len("user name=") - F.length("perspective"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.select("conv", "part", "perspective", F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("offset"))

    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("assistant")).otherwise(other)
    told = turns.join(pairs, ["conv", "part"]).select(
        "conv", "perspective", "part", "offset", "seq", own.cast("int").alias("own"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("lead"), F.concat("said", F.lit(CLOSE)).alias("body"),
    )
    run = Window.partitionBy("conv", "perspective", "part").orderBy("seq")
    told = told.withColumn("end", F.col("offset") + F.sum(F.length("lead") + F.length("body")).over(run)).withColumn("start", F.col("end") - F.length("body"))
    rows = F.sort_array(F.collect_list(F.struct("seq", F.concat("lead", "body").alias("segment"), "own", "start", "end")))
    made = told.groupBy("conv", "perspective", "part").agg(F.min("offset").alias("offset"), rows.alias("r"))
    masked = F.filter("r", lambda x: x.own == 1)
    return made.select(
        "conv.conv_id", "perspective", "part", (F.col("part") * part_turns + 1).alias("first_turn"), "offset", F.size("r").cast("long").alias("n_turns"),
        F.array_join(F.col("r.segment"), "").alias("rendered"),
        F.array_join(F.transform("r", lambda x: x.own.cast("string")), "").alias("mask"),
        F.array_join(F.transform(masked, lambda x: F.concat_ws("-", x.start.cast("string"), x.end.cast("string"))), ",").alias("spans"),
        F.aggregate(masked, F.lit(0).cast("long"), lambda a, x: a + x.end - x.start).alias("loss_chars"),
    )
