"""Queries that have to read all rows of their tables."""

from colloquy.plans import registry, time
from colloquy.sources.tables import segments, table

SF = "/root/testdata/sf0.001"


def test_every_order_has_its_date_parsed(spark):
    got = registry.QUERIES["f33_date_parsing"](spark, SF)
    assert got.count() == table(spark, SF, "orders").count()
    assert got.where("bad AND id % 5 <> 4 OR NOT bad AND id % 5 = 4").count() == 0


def test_every_line_is_a_frame(spark):
    lines = table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber").distinct().count()
    assert time.all_speech_frames(spark, SF).count() == lines


def test_segments_without_overlap_get_the_nearest_speaker(spark):
    s = segments(spark, SF)
    t = time.sparse_turns(s)
    rows, turns = s.collect(), t.collect()
    want = {}
    for x in rows:
        own = [y for y in turns if y.meeting_id == x.meeting_id]
        if own and not any(x.start < y.end and y.start < x.end for y in own):
            want[x.meeting_id, x.seg_no] = min((min(abs(x.start - y.end), abs(x.end - y.start)), y.turn_no, y.speaker) for y in own)[::2]
    got = {(r.meeting_id, r.seg_no): (r.gap, r.speaker) for r in registry.QUERIES["j3_nearest_speaker"](spark, SF).collect()}
    assert got == want
    assert len(got) > 0
