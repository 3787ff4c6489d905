"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

Every participant of a conversation gets the dialogue from its own seat: its turns are the
assistant's and are learned, the turns of others are those of named users and are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import stored

#: Markers around a turn.
START, END = "<|im_start|>", "<|im_end|>"
#: Speakers that take no seat; their turns are instructions in every perspective.
SYSTEM_ROLES = ("system",)
#: Turns of a perspective that one window numbers; longer ones are numbered in stretches.
LONG = 4096


def _running(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``position`` and ``char_start`` where a dialogue fits in one window."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.sum(F.length("rendered")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("position", F.row_number().over(w) - 1).withColumn("char_start", F.coalesce(before, F.lit(0)))


def _running_long(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same in stretches: rows are range-partitioned in dialogue order (a serial number splits
    even equal rows), numbered within each stretch, then moved by what the stretches before hold.
    They are written with their stretch once: a second range exchange would draw other bounds."""
    ranged = rows.withColumn("serial", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "serial").withColumn("stretch", F.spark_partition_id())
    ranged = stored(ranged, "stretches")
    sums = ranged.groupBy(*keys, "stretch").agg(F.count("*").alias("n"), F.sum(F.length("rendered")).alias("chars"))
    w = W.partitionBy(*keys).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "stretch", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("chars").over(w), F.lit(0)).alias("chars"))
    inner = _running(ranged, [*keys, "stretch"], [*order, "serial"])
    on = F.col("l.stretch") == F.col("r.stretch")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    kept = [F.col(f"l.{c}") for c in rows.columns]
    return inner.alias("l").join(sums.alias("r"), on).select(*kept, (F.col("l.position") + F.col("r.n")).alias("position"), (F.col("l.char_start") + F.col("r.chars")).alias("char_start"))


def speaker_name(role: Column) -> Column:
    """A name that cannot break the markup: white space and angle brackets become ``_``; a null or
    empty role is ``unknown``."""
    clean = F.regexp_replace(F.trim(F.coalesce(role, F.lit(""))), r"[\s<>|]+", "_")
    return F.when(clean == "", "unknown").otherwise(clean)


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system_roles: tuple[str, ...] = SYSTEM_ROLES, long: int = LONG) -> DataFrame:
    """Rows ``(conv_id, perspective, position, turn, speaker, chat_role, rendered, char_start,
    loss_start, loss_end)``: one for each turn in each perspective.

    A perspective's rows, by position, are its dialogue; ``rendered`` laid end to end is its text,
    ``char_start`` a turn's place in it, and characters ``loss_start``..``loss_end`` (of the whole
    dialogue, end exclusive) are learned: the words and end marker of the perspective's own turns,
    nothing elsewhere (both null). A turn is a row of its own, so a dialogue of any length stays dealt.

    Order is by turn, then role, then text; null turns come first, repeated rows are turns of
    their own. Null texts are empty; a null or empty role is the speaker ``unknown``; null conv_ids
    are one conversation. Dialogues of any number of turns are numbered alike, long ones in stretches
    that many tasks share, and very long texts are kept whole. System roles take no seat; a conversation of system turns alone has no
    participant and gives no rows. An empty table gives no rows; other columns are not read.
    """
    said = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), speaker_name(F.col(role)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    counts = stored(said.groupBy("conv_id", "speaker").agg(F.count("*").alias("n")), "seats")
    seats = counts.withColumn("turns", F.sum("n").over(W.partitionBy("conv_id"))).filter(~F.col("speaker").isin(*system_roles))
    seats = seats.select(F.col("conv_id").alias("seat_conv"), F.col("speaker").alias("perspective"), "turns")
    any_long = not seats.filter(F.col("turns") > long).isEmpty()
    dealt = said.join(seats, F.col("conv_id").eqNullSafe(F.col("seat_conv"))).drop("seat_conv")
    own = F.col("speaker") == F.col("perspective")
    chat_role = F.when(F.col("speaker").isin(*system_roles), "system").when(own, "assistant").otherwise("user")
    header = F.concat(F.lit(START), F.col("chat_role"), F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    rows = dealt.withColumn("chat_role", chat_role).withColumn("head", F.length(header)).withColumn("rendered", F.concat(header, F.col("said"), F.lit(f"{END}\n")))
    keys, order = ["conv_id", "perspective"], ["turn", "speaker", "said"]
    # turns are read for long dialogues once more only where there are any
    numbered = _running(rows.filter(F.col("turns") <= long), keys, order)
    if any_long:
        numbered = numbered.unionByName(_running_long(rows.filter(F.col("turns") > long), keys, order))
    learned = F.col("chat_role") == "assistant"
    return numbered.select(
        "conv_id", "perspective", "position", "turn", "speaker", "chat_role", "rendered", "char_start",
        F.when(learned, F.col("char_start") + F.col("head")).alias("loss_start"),
        F.when(learned, F.col("char_start") + F.length("rendered") - 1).alias("loss_end"),
    )
