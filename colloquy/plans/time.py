"""Time core queries: conversations on a word axis, events as speaker turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import turns as U
from colloquy.plans.registry import query
from colloquy.sources.tables import segments, speaker_turns, table

NW = r"len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> ''))"
SEG = f"""n AS (SELECT conv_id AS meeting_id, turn AS seg_no, role AS speaker, text, {NW}::BIGINT AS n FROM conversations),
seg AS (SELECT meeting_id, seg_no, speaker, text, n, (sum(n) OVER w - n)::BIGINT AS "start", (sum(n) OVER w)::BIGINT AS "end" FROM n WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_no))"""
#: Turns of the same axis, cut elsewhere: from a third of a segment to a third of the next.
TURNS = """tn AS (SELECT meeting_id, seg_no AS turn_no, 'T' || (seg_no % 3) AS speaker, "start" + n // 3 AS "start", "end" + n // 3 AS "end" FROM seg WHERE seg_no % 4 <> 3)"""
EV = """t AS (SELECT strftime(ts, '%Y-%m-%d') AS meeting_id, event_id AS turn_no, epoch_us(ts) // 10000 AS "start", epoch_us(ts) // 10000 + round(greatest(value, 0) * 400)::BIGINT AS "end", 'Speaker ' || (user_id % 3 + 1) AS speaker FROM events)"""
MERGED = EV + """, c AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS ch FROM t WINDOW w AS (PARTITION BY meeting_id ORDER BY "start", "end", turn_no)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY meeting_id ORDER BY "start", "end", turn_no ROWS UNBOUNDED PRECEDING) AS run FROM c),
m AS (SELECT *, max("end") OVER (PARTITION BY meeting_id, run ORDER BY "start", "end", turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 8000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY "start", "end", turn_no ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m),
merged AS (SELECT meeting_id, island AS turn_no, speaker, min("start") AS "start", max("end") AS "end", count(*) AS n_turns FROM i GROUP BY ALL)"""


def turns_of(seg):
    n = F.col("end") - F.col("start")
    third = F.floor(n / 3)
    return seg.where("seg_no % 4 <> 3").select("meeting_id", F.col("seg_no").alias("turn_no"), F.concat(F.lit("T"), (F.col("seg_no") % 3).cast("string")).alias("speaker"), (F.col("start") + third).alias("start"), (F.col("end") + third).alias("end"))


def events_turns(spark, d):
    return speaker_turns(spark, d).withColumnsRenamed({"start_cs": "start", "end_cs": "end"})


@query("w12_word_axis", f'WITH {SEG} SELECT meeting_id, seg_no, "start", "end" FROM seg')
def w12(spark, d):
    return segments(spark, d).select("meeting_id", "seg_no", "start", "end")


@query("w1_turn_merge", f"WITH {MERGED} SELECT * FROM merged")
def w1(spark, d):
    return U.merge_turns(events_turns(spark, d), 8000)


MICRO = f"""WITH {MERGED}, c2 AS (SELECT *, coalesce("end" - "start" < 3000 AND lag(speaker) OVER w = lead(speaker) OVER w, false) AS cand FROM merged WINDOW w AS (PARTITION BY meeting_id ORDER BY turn_no)),
r2 AS (SELECT *, sum(CASE WHEN cand THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS run FROM c2),
a2 AS (SELECT *, cand AND row_number() OVER (PARTITION BY meeting_id, run, cand ORDER BY turn_no) % 2 = 1 AS absorbs FROM r2),
g2 AS (SELECT *, absorbs OR coalesce(lag(absorbs) OVER (PARTITION BY meeting_id ORDER BY turn_no), false) AS gone FROM a2),
k2 AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING)::BIGINT AS kept FROM g2)
SELECT meeting_id, kept AS turn_no, arg_min(speaker, k2.turn_no) AS speaker, arg_min("start", k2.turn_no) AS "start", arg_max("end", k2.turn_no) AS "end" FROM k2 GROUP BY meeting_id, kept"""


@query("w2_micro_turns", MICRO)
def w2(spark, d):
    return U.absorb_micro_turns(U.merge_turns(events_turns(spark, d), 8000), 3000)


@query("w1_w2_in_chunks", MICRO)
def w2_chunks(spark, d):
    """The same for meetings of any length: chunks of an hour, then of 50 turns, that hand on their state."""
    return U.absorb_micro_turns(U.merge_turns(events_turns(spark, d), 8000, width=360_000), 3000, width=50)


@query(
    "w3_adjacent_groups",
    f"""WITH {SEG}, c AS (SELECT *, CASE WHEN seg_no % 5 < 2 THEN 'x' ELSE speaker END AS sp FROM seg), b AS (SELECT *, CASE WHEN sp = lag(sp) OVER w THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_no)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY meeting_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM b)
SELECT meeting_id, island, any_value(sp) AS speaker, min("start") AS "start", max("end") AS "end", string_agg(text, ' ' ORDER BY seg_no) AS text FROM i GROUP BY meeting_id, island""",
)
def w3(spark, d):
    return U.group_adjacent(segments(spark, d).withColumn("speaker", F.when(F.col("seg_no") % 5 < 2, "x").otherwise(F.col("speaker"))))


#: Every line is a frame: a clip is 100 orders of 20 frames each, so clips grow with the table.
FRAMES = "f AS (SELECT l_orderkey // 100 AS clip_id, ((l_orderkey % 100) * 20 + l_linenumber * 2)::BIGINT AS frame, 2000::BIGINT AS n_frames FROM lineitem GROUP BY ALL)"


def all_speech_frames(spark, d):
    order = F.col("l_orderkey")
    frame = (order % 100 * 20 + F.col("l_linenumber") * 2).cast("long")
    return table(spark, d, "lineitem").select(F.floor(order / 100).alias("clip_id"), frame.alias("frame"), F.lit(2000).cast("long").alias("n_frames")).distinct()


VAD = f"""WITH {FRAMES}, g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip_id ORDER BY frame) <= 10 THEN 0 ELSE 1 END AS nw FROM f),
i AS (SELECT *, sum(nw) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g),
v AS (SELECT clip_id, island, greatest(0, min(frame) - 10) AS first_frame, least(max(frame) + 10, 2000) AS end_frame FROM i GROUP BY ALL)"""


@query("w4_speech_islands", VAD + " SELECT * FROM v")
def w4(spark, d):
    return U.speech_islands(all_speech_frames(spark, d), 10)


@query(
    "w5_sliding_windows",
    VAD + """, w AS (SELECT clip_id, island, end_frame, unnest(CASE WHEN end_frame - first_frame <= 20 THEN [first_frame] ELSE range(first_frame, end_frame - 10, 10) END) AS w_start FROM v)
SELECT clip_id, island, w_start, least(w_start + 20, end_frame) AS w_end FROM w""",
)
def w5(spark, d):
    v = U.speech_islands(all_speech_frames(spark, d), 10).withColumnsRenamed({"first_frame": "start", "end_frame": "end"})
    return U.sliding_windows(v, 20, 10).select("clip_id", "island", "w_start", "w_end")


OVER = f"""WITH {SEG}, {TURNS}, p AS (SELECT s.meeting_id, s.seg_no, t.turn_no, t.speaker, least(s."end", t."end") - greatest(s."start", t."start") AS overlap
FROM seg s JOIN tn t ON s.meeting_id = t.meeting_id AND s."start" < t."end" AND t."start" < s."end")"""


@query("j1_interval_overlap", OVER + " SELECT * FROM p")
def j1(spark, d):
    s = segments(spark, d)
    return U.overlaps(s, turns_of(s))


@query("j1_interval_overlap_bucketed", OVER + " SELECT * FROM p")
def j1_bucketed(spark, d):
    s = segments(spark, d)
    return U.overlaps(s, turns_of(s), bucket=500)


DOM = OVER + """, b AS (SELECT meeting_id, seg_no, speaker, sum(overlap)::BIGINT AS overlap, min(turn_no) AS first_turn FROM p GROUP BY ALL),
dom AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY meeting_id, seg_no ORDER BY overlap DESC, first_turn) = 1)"""


@query("j2_dominant_speaker", DOM + " SELECT * FROM dom")
def j2(spark, d):
    s = segments(spark, d)
    return U.dominant_speaker(U.overlaps(s, turns_of(s)))


NEAR = DOM + """, rest AS (SELECT * FROM seg s WHERE NOT EXISTS (SELECT 1 FROM dom d WHERE d.meeting_id = s.meeting_id AND d.seg_no = s.seg_no)),
nr AS (SELECT r.meeting_id, r.seg_no, t.speaker, least(abs(r."start" - t."end"), abs(r."end" - t."start")) AS gap FROM rest r JOIN tn t ON t.meeting_id = r.meeting_id
QUALIFY row_number() OVER (PARTITION BY r.meeting_id, r.seg_no ORDER BY least(abs(r."start" - t."end"), abs(r."end" - t."start")), t.turn_no) = 1)"""


#: Turns of half of the segments, so that there are segments without an overlap.
SPARSE_NEAR = NEAR.replace("WHERE seg_no % 4 <> 3)", "WHERE seg_no % 4 < 2)")


def sparse_turns(seg):
    return turns_of(seg).where("turn_no % 4 < 2")


@query("j3_nearest_speaker", SPARSE_NEAR + " SELECT * FROM nr")
def j3(spark, d):
    """All segments without an overlap."""
    s = segments(spark, d)
    t = sparse_turns(s)
    return U.nearest_speaker(s.join(U.overlaps(s, t).select("meeting_id", "seg_no").distinct(), ["meeting_id", "seg_no"], "left_anti"), t)


@query(
    "x9_alignment",
    NEAR + """, a AS (SELECT s.*, coalesce(d.speaker, nr.speaker, 'Speaker 1') AS sp FROM seg s LEFT JOIN dom d USING (meeting_id, seg_no) LEFT JOIN nr USING (meeting_id, seg_no) WHERE trim(s.text) <> ''),
c AS (SELECT *, CASE WHEN sp = lag(sp) OVER (PARTITION BY meeting_id ORDER BY seg_no) THEN 0 ELSE 1 END AS ch FROM a),
i AS (SELECT *, sum(ch) OVER (PARTITION BY meeting_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c)
SELECT meeting_id, island, any_value(sp) AS speaker, min("start") AS "start", max("end") AS "end", string_agg(text, ' ' ORDER BY seg_no) AS text FROM i GROUP BY meeting_id, island""",
)
def x9(spark, d):
    s = segments(spark, d)
    return U.align(s, turns_of(s))


STATS = f"""WITH {SEG}, st AS (SELECT meeting_id, speaker, sum(greatest(0, "end" - "start"))::BIGINT AS time, count(*) AS n_turns, sum(n)::BIGINT AS n_words, min(seg_no) AS first_turn FROM seg GROUP BY ALL)"""


@query("a1_a2_speaker_statistics", STATS + " SELECT *, CASE WHEN sum(time) OVER w > 0 THEN round_even(time * 100 / sum(time) OVER w, 1) ELSE 0 END AS share FROM st WINDOW w AS (PARTITION BY meeting_id)")
def a1(spark, d):
    return U.speaker_statistics(segments(spark, d))


@query("a3_a14_meeting_totals", STATS + " SELECT meeting_id, count(DISTINCT speaker) AS n_speakers, sum(time)::BIGINT AS total_time, sum(n_words)::BIGINT AS total_words FROM st GROUP BY 1")
def a3(spark, d):
    return U.meeting_totals(U.speaker_statistics(segments(spark, d)))


@query("w7_x22_relabel", "WITH f AS (SELECT *, strftime(ts, '%Y-%m-%d') AS m, min(event_id) OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id) AS f FROM events) SELECT event_id, (dense_rank() OVER (PARTITION BY m ORDER BY f) - 1)::INT AS label FROM f")
def w7(spark, d):
    e = table(spark, d, "events").withColumn("meeting_id", F.date_format("ts", "yyyy-MM-dd"))
    return U.relabel(e, "user_id", "event_id").select("event_id", "label")


@query(
    "f6_k6_transcript_rendering",
    f"""WITH {SEG} SELECT meeting_id, string_agg('[' || printf('%02d:%02d:%02d', "start" // 3600, "start" % 3600 // 60, "start" % 60) || ' - ' || printf('%02d:%02d:%02d', "end" // 3600, "end" % 3600 // 60, "end" % 60) || '] ' || speaker || ':' || chr(10) || text, chr(10) ORDER BY seg_no) AS body FROM seg GROUP BY 1""",
)
def f6(spark, d):
    line = F.concat(T.span(F.col("start").cast("double"), F.col("end").cast("double")), F.lit(" "), "speaker", F.lit(":\n"), "text")
    x = F.array_sort(F.collect_list(F.struct("seg_no", line.alias("line"))))
    return segments(spark, d).groupBy("meeting_id").agg(F.array_join(F.transform(x, lambda s: s["line"]), "\n").alias("body"))
