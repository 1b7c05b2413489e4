"""Time core: turn merging, absorption, speech islands, alignment and speaker statistics.

Sequential rules are window formulations; with a ``width`` they go over chunks of a
meeting (``scans``), so that one very long meeting is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.text import n_words
from colloquy.operators.scans import BEFORE, CHUNK, SO_FAR, Chunks



def word_axis(turns: DataFrame, key: str = "conv_id", order: str = "turn", speaker: str = "role") -> DataFrame:
    """Turn-ordered text on an integer axis: a turn starts after all words before it."""
    w = turns.withColumn("n", n_words(F.col("text")).cast("long"))
    end = F.sum("n").over(W.partitionBy(key).orderBy(order).rowsBetween(*SO_FAR))
    return w.select(F.col(key).alias("meeting_id"), F.col(order).alias("seg_no"), F.col(speaker).alias("speaker"), (end - F.col("n")).alias("start"), end.alias("end"), "text")


def merge_turns(turns: DataFrame, gap, start: str = "start", end: str = "end", width=None) -> DataFrame:
    """Join a speaker's turns that follow each other with at most ``gap`` between.

    A run of one speaker is found first; within it a turn begins anew if it starts
    more than ``gap`` after the running largest end. With a ``width`` a meeting is
    folded in chunks of that much of the axis.
    """
    c = Chunks("meeting_id", [start, end, "turn_no"], width)
    t = c.cut(turns).withColumn("_prev", F.lag(F.struct("speaker")).over(c.window()))
    changed = F.col("_prev").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("_prev.speaker"))
    t = t.withColumn("_run", F.sum(F.when(changed, 1).otherwise(0)).over(c.window().rowsBetween(*SO_FAR)))
    who = F.struct("speaker")
    says = [F.min_by(who, c.place()).alias("first"), F.max_by(who, c.place()).alias("last"), F.max(F.struct("_run", F.col(end).alias("end"))).alias("tail")]

    def carry(chunks: DataFrame, w) -> DataFrame:
        s = chunks.withColumn("_goes_on", F.coalesce(F.col("first") == F.lag("last").over(w), F.lit(False)))
        # the last run of a chunk began before it if the whole chunk is one run that goes on
        s = s.withColumn("_chain", F.sum(F.when(F.col("_goes_on") & (F.col("tail._run") == 0), 0).otherwise(1)).over(w))
        s = s.withColumn("_reach", F.max("tail.end").over(W.partitionBy("meeting_id", "_chain").orderBy(CHUNK)))
        return s.withColumn("_carried", F.when(F.col("_goes_on"), F.lag("_reach").over(w)))

    t = c.carried(t, says, carry, ["_carried"])
    reach = F.greatest(F.max(end).over(c.window("_run").rowsBetween(*BEFORE)), F.when(F.col("_run") == 0, F.col("_carried")))
    t = t.withColumn("_reach", reach)
    out = c.islands(
        t, F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), "turn_no",
        [F.first("speaker").alias("speaker"), F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_turns")],
        [F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_turns").alias("n_turns")],
    )
    return out.select("meeting_id", "turn_no", "speaker", "start", "end", "n_turns")


def absorb_micro_turns(turns: DataFrame, shorter_than, width: int | None = None) -> DataFrame:
    """Swallow short turns between two turns of one speaker, together with the second.

    Of consecutive candidates the odd ones absorb (the absorbed successor can't), so
    a chunk of ``width`` turn numbers has to know how many candidates it follows on.
    """
    c = Chunks("meeting_id", ["turn_no"], width)
    who, w = F.struct("speaker"), c.window()
    t = c.cut(turns).withColumn("_prev", F.lag(who).over(w)).withColumn("_next", F.lead(who).over(w))
    beside = lambda chunks, w: chunks.withColumn("_left", F.lag("last").over(w)).withColumn("_right", F.lead("first").over(w))
    t = c.carried(t, [F.min_by(who, "turn_no").alias("first"), F.max_by(who, "turn_no").alias("last")], beside, ["_left", "_right"])
    same = F.coalesce("_prev", "_left")["speaker"] == F.coalesce("_next", "_right")["speaker"]
    t = t.withColumn("_cand", F.coalesce((F.col("end") - F.col("start") < shorter_than) & same, F.lit(False)))
    t = t.withColumn("_run", F.sum(F.when(F.col("_cand"), 0).otherwise(1)).over(w.rowsBetween(*SO_FAR)))
    t = t.withColumn("_place", F.when(F.col("_cand"), F.row_number().over(c.window("_run", "_cand"))).otherwise(0))

    def carry(chunks: DataFrame, w) -> DataFrame:
        # candidates at the end of a chunk go on through chunks of nothing else
        s = chunks.withColumn("_chain", F.sum(F.when(F.col("tail._run") == 0, 0).otherwise(1)).over(w))
        s = s.withColumn("_open", F.sum("tail._place").over(W.partitionBy("meeting_id", "_chain").orderBy(CHUNK)))
        return s.withColumn("_carried", F.lag("_open").over(w))

    t = c.carried(t, [F.max(F.struct("_run", "_place")).alias("tail")], carry, ["_carried"])
    before = F.coalesce("_carried", F.lit(0))
    t = t.withColumn("_absorbs", F.col("_cand") & ((F.col("_place") + F.when(F.col("_run") == 0, before).otherwise(0)) % 2 == 1))
    t = t.withColumn("_gone", F.col("_absorbs") | F.coalesce(F.lag("_absorbs").over(w), before % 2 == 1))
    return c.islands(
        t, ~F.col("_gone"), "_kept",
        [F.min("turn_no").alias("a"), F.max("turn_no").alias("b"), F.min_by("speaker", "turn_no").alias("speaker"), F.min_by("start", "turn_no").alias("start"), F.max_by("end", "turn_no").alias("end")],
        [F.min_by("speaker", "a").alias("speaker"), F.min_by("start", "a").alias("start"), F.max_by("end", "b").alias("end")],
    ).withColumnRenamed("_kept", "turn_no")


def group_adjacent(items: DataFrame, order: str = "seg_no", width: int | None = None) -> DataFrame:
    """One row for each run of items of one speaker; texts in order, joined by a space. Chunks are ``width`` of ``order`` wide."""
    c = Chunks("meeting_id", [order], width)
    who = F.struct("speaker")
    t = c.cut(items).withColumn("_prev", F.lag(who).over(c.window()))
    t = c.carried(t, [F.max_by(who, order).alias("last")], lambda chunks, w: chunks.withColumn("_left", F.lag("last").over(w)), ["_left"])
    t = t.withColumn("_before", F.coalesce("_prev", "_left")).withColumn("_new", F.col("_before").isNull() | ~F.col("speaker").eqNullSafe(F.col("_before.speaker")))
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "texts"))), lambda s: s["texts"]))
    return c.islands(
        t.drop("_before"), F.col("_new"), "island",
        [F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(order).alias("at"),
         F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]).alias("texts")],
        [F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(said, " ").alias("text")],
    )


def speech_islands(frames: DataFrame, pad: int, least: int = 0, by: str = "clip_id", width: int | None = None) -> DataFrame:
    """Hysteresis over speech frames (clip_id, frame, n_frames): silence of ``pad`` frames ends an interval.

    The start is moved back by ``pad``; a clip's last interval may end early. Chunks
    are ``width`` frames wide.
    """
    c = Chunks(by, ["frame"], width)
    t = c.cut(frames).withColumn("_prev", F.lag("frame").over(c.window()))
    t = c.carried(t, [F.max("frame").alias("last")], lambda chunks, w: chunks.withColumn("_left", F.lag("last").over(w)), ["_left"])
    t = t.withColumn("_new", F.coalesce(F.col("frame") - F.coalesce("_prev", "_left") > pad, F.lit(True)))
    out = c.islands(
        t, F.col("_new"), "island",
        [F.min("frame").alias("a"), F.max("frame").alias("b"), F.max("n_frames").alias("n")],
        [F.min("a").alias("a"), F.max("b").alias("b"), F.max("n").alias("n")],
    )
    out = out.select(by, "island", F.greatest(F.lit(0), F.col("a") - pad).alias("first_frame"), F.least(F.col("b") + pad, F.col("n")).alias("end_frame"))
    return out.where(F.col("end_frame") - F.col("first_frame") >= least)


def sliding_windows(intervals: DataFrame, size: int, step: int) -> DataFrame:
    """(…, w_start, w_end): starts below end - size/2; a short interval is one window."""
    starts = F.when(F.col("end") - F.col("start") <= size, F.array("start")).otherwise(F.sequence(F.col("start"), F.col("end") - size // 2 - 1, F.lit(step).cast("long")))
    w = intervals.withColumn("w_start", F.explode(starts))
    return w.withColumn("w_end", F.least(F.col("w_start") + size, F.col("end")))


def overlaps(segments: DataFrame, turns: DataFrame, bucket: int | None = None) -> DataFrame:
    """Interval join: (meeting_id, seg_no, turn_no, speaker, overlap), overlap > 0.

    With ``bucket`` both sides are dealt into time buckets of that width, so that
    one very long meeting is many join keys; a pair counts in its first common bucket.
    """
    s = segments.select("meeting_id", "seg_no", F.col("start").alias("s0"), F.col("end").alias("s1"))
    t = turns.select("meeting_id", "turn_no", "speaker", F.col("start").alias("t0"), F.col("end").alias("t1"))
    meet = [s["meeting_id"] == t["meeting_id"], F.col("s0") < F.col("t1"), F.col("t0") < F.col("s1")]
    if bucket:
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
        s, t = s.withColumn("sb", cells("s0", "s1")), t.withColumn("tb", cells("t0", "t1"))
        meet += [F.col("sb") == F.col("tb"), F.col("sb") == F.floor(F.greatest("s0", "t0") / bucket)]
    both = s.join(t, meet)
    return both.select(s["meeting_id"], "seg_no", "turn_no", "speaker", (F.least("s1", "t1") - F.greatest("s0", "t0")).alias("overlap"))


def dominant_speaker(pairs: DataFrame) -> DataFrame:
    """Speaker with the largest summed overlap; ties go to the earliest turn."""
    by = pairs.groupBy("meeting_id", "seg_no", "speaker").agg(F.sum("overlap").alias("overlap"), F.min("turn_no").alias("first_turn"))
    rank = F.row_number().over(W.partitionBy("meeting_id", "seg_no").orderBy(F.desc("overlap"), "first_turn"))
    return by.withColumn("_r", rank).where("_r = 1").drop("_r")


def nearest_speaker(segments: DataFrame, turns: DataFrame, width: int | None = None) -> DataFrame:
    """For segments: the turn whose edge is nearest; ties go to the first turn.

    An edge of a turn meets the other edge of the segment, so the nearest is one of
    four: the last end before the segment's start and the first after it, and the
    same of starts and the segment's end. One ordered pass over a meeting's edges, in
    chunks of ``width`` on the axis, finds them all; segments and turns are never paired.
    """
    seg_kind = segments.schema["seg_no"].dataType

    def edges(edge: str, at: str, pair: int) -> DataFrame:
        """Turns' edges and the segments' other edges, of one of the two pairings."""
        t = turns.groupBy("meeting_id", F.col(edge).alias("at")).agg(F.min(F.struct("turn_no", "speaker")).alias("t"))
        t = t.select("meeting_id", "at", F.lit(0).alias("kind"), F.struct("at", "t.turn_no", "t.speaker").alias("t"), F.lit(None).cast(seg_kind).alias("seg_no"), F.lit(pair).alias("pair"))
        return t.unionByName(segments.select("meeting_id", F.col(at).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(t.schema["t"].dataType).alias("t"), "seg_no", F.lit(pair).alias("pair")))

    both = edges("end", "start", 0).unionByName(edges("start", "end", 1)).withColumn("_seq", F.struct("meeting_id", "pair"))
    c = Chunks("_seq", ["at", "kind"], width)
    w, cut = c.window(), c.cut(both)
    t = cut.withColumn("_a", F.last("t", ignorenulls=True).over(w.rowsBetween(*SO_FAR))).withColumn("_b", F.first("t", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    none = F.col("kind") == 0
    says = [F.max_by(F.when(none, F.col("t")), F.when(none, c.place())).alias("last"), F.min_by(F.when(none, F.col("t")), F.when(none, c.place())).alias("first")]

    def carry(chunks: DataFrame, w) -> DataFrame:
        s = chunks.withColumn("_left", F.last("last", ignorenulls=True).over(w.rowsBetween(*BEFORE)))
        return s.withColumn("_right", F.first("first", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))

    t = c.carried(t, says, carry, ["_left", "_right"]).where("kind = 1")
    near = F.transform(F.filter(F.array(F.coalesce("_a", "_left"), F.coalesce("_b", "_right")), lambda x: x.isNotNull()), lambda x: F.struct(F.abs(F.col("at") - x["at"]).alias("gap"), x["turn_no"].alias("turn_no"), x["speaker"].alias("speaker")))
    found = t.groupBy("meeting_id", "seg_no").agg(F.min(F.array_min(near)).alias("b")).where("b IS NOT NULL")
    return found.select("meeting_id", "seg_no", F.col("b.speaker").alias("speaker"), F.col("b.gap").alias("gap"))


def align(segments: DataFrame, turns: DataFrame, bucket: int = 1000) -> DataFrame:
    """Segments with text get a speaker (overlap, else nearest, else Speaker 1); runs are joined.

    ``bucket`` is the width of the time buckets, in units of the axis, that the
    overlap join deals a meeting into.
    """
    s = segments.where(F.trim("text") != "").drop("speaker")
    by_overlap = dominant_speaker(overlaps(s, turns, bucket)).select("meeting_id", "seg_no", "speaker")
    rest = s.join(by_overlap, ["meeting_id", "seg_no"], "left_anti")
    found = by_overlap.unionByName(nearest_speaker(rest, turns).select("meeting_id", "seg_no", "speaker"))
    return group_adjacent(s.join(found, ["meeting_id", "seg_no"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("Speaker 1"))))


def speaker_statistics(turns: DataFrame, units: int | None = None, duration: Column | None = None) -> DataFrame:
    """Per meeting and speaker: time, turns, words, share of the summed speech in percent.

    The time is rounded to one place before its share is taken, and is summed in
    whole ``units`` a second where these are given. Without any speech the shares
    are of ``duration`` (of the recording), else of 1.
    """
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    time = F.sum(length) if units is None else F.sum(length) / units
    by = turns.groupBy("meeting_id", "speaker").agg(time.alias("time"), F.count("*").alias("n_turns"), F.sum(n_words(F.col("text"))).alias("n_words"), F.min("seg_no").alias("first_turn"))
    total = F.sum(F.col("time") if units is None else F.round(F.col("time") * units).cast("long")).over(W.partitionBy("meeting_id")) / (units or 1)
    whole = F.when(total > 0, total).otherwise(F.coalesce(duration, F.lit(1.0)) if duration is not None else F.lit(1.0))
    return by.withColumn("share", F.bround(F.bround("time", 1) * 100 / whole, 1))


def meeting_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("meeting_id").agg(F.count_distinct("speaker").alias("n_speakers"), F.sum("time").alias("total_time"), F.sum("n_words").alias("total_words"))


def relabel(items: DataFrame, label: str, order: str, by: str = "meeting_id") -> DataFrame:
    """Labels become 0, 1, ... in the order of their first appearance."""
    first = F.min(order).over(W.partitionBy(by, label))
    return items.withColumn("_f", first).withColumn("label", F.dense_rank().over(W.partitionBy(by).orderBy("_f")) - 1).drop("_f")
