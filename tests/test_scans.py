"""Sequential rules in chunks of any width against the rules one row after the other."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import turns as U


def merged(rows, gap):
    out = []
    for who, a, b, _ in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        if out and out[-1][0] == who and a <= out[-1][2] + gap:
            out[-1][2], out[-1][3] = max(out[-1][2], b), out[-1][3] + 1
        else:
            out.append([who, a, b, 1])
    return [tuple(x) for x in out]


def absorbed(rows, limit):
    out, i = [], 0
    while i < len(rows):
        who, a, b = rows[i]
        if 0 < i < len(rows) - 1 and out and b - a < limit and out[-1][0] == rows[i + 1][0]:
            out[-1][2] = rows[i + 1][2]
            i += 2
        else:
            out.append([who, a, b])
            i += 1
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def meetings():
    """Few speakers and mostly short turns, so runs and candidates go on across many chunks."""
    rng, out = random.Random(8), {}
    for m in range(40):
        at, rows = 0, []
        for i in range(rng.choice([0, 1, 2, 3, 40, 150])):
            at += rng.choice([0, 0, 1, 2, 9])
            rows.append((rng.choice("AAB" if m % 3 else "AB"), at, at + rng.choice([0, 1, 2, 20 if m % 4 == 0 else 3]), i))
        out[m] = rows
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 50, 10_000])
def test_turn_merge(spark, meetings, width):
    df = spark.createDataFrame([(m, i, who, a, b) for m, rows in meetings.items() for who, a, b, i in rows], "meeting_id int, turn_no int, speaker string, start int, end int")
    got = {}
    for r in sorted(U.merge_turns(df, 2, width=width).collect(), key=lambda r: (r.meeting_id, r.turn_no)):
        got.setdefault(r.meeting_id, []).append((r.speaker, r.start, r.end, r.n_turns))
        assert r.turn_no == len(got[r.meeting_id])
    assert got == {m: merged(rows, 2) for m, rows in meetings.items() if rows}


@pytest.mark.parametrize("width", [1, 2, 5, 64, None])
def test_micro_turns(spark, meetings, width):
    plain = {m: [x[:3] for x in merged(rows, 0)] for m, rows in meetings.items() if rows}
    df = spark.createDataFrame([(m, i + 1, *t) for m, ts in plain.items() for i, t in enumerate(ts)], "meeting_id int, turn_no int, speaker string, start int, end int")
    got = {}
    for r in sorted(U.absorb_micro_turns(df, 4, width).collect(), key=lambda r: (r.meeting_id, r.turn_no)):
        got.setdefault(r.meeting_id, []).append((r.speaker, r.start, r.end))
    assert got == {m: absorbed(ts, 4) for m, ts in plain.items()}


@pytest.mark.parametrize("width", [1, 4, None])
def test_adjacent_groups(spark, meetings, width):
    df = spark.createDataFrame([(m, i, who if i % 7 else None, a, b, f"t{i}") for m, rows in meetings.items() for who, a, b, i in rows], "meeting_id int, seg_no int, speaker string, start int, end int, text string")
    want = {}
    for m, rows in meetings.items():
        for who, a, b, i in rows:
            who, groups = (who if i % 7 else None), want.setdefault(m, [])
            if groups and groups[-1][0] == who:
                groups[-1] = (who, min(groups[-1][1], a), max(groups[-1][2], b), f"{groups[-1][3]} t{i}")
            else:
                groups.append((who, a, b, f"t{i}"))
    got = {}
    for r in sorted(U.group_adjacent(df, width=width).collect(), key=lambda r: (r.meeting_id, r.island)):
        got.setdefault(r.meeting_id, []).append((r.speaker, r.start, r.end, r.text))
    assert got == {m: g for m, g in want.items() if g}


@pytest.mark.parametrize("width", [1, 5, 64])
def test_islands_of_frames(spark, width):
    rng = random.Random(2)
    clips = {c: sorted(rng.sample(range(400), rng.randint(1, 200))) for c in range(20)}
    df = spark.createDataFrame([(c, f, 400) for c, fs in clips.items() for f in fs], "clip_id int, frame int, n_frames int")
    want = set()
    for c, fs in clips.items():
        spans = []
        for f in fs:
            if spans and f - spans[-1][1] <= 6:
                spans[-1][1] = f
            else:
                spans.append([f, f])
        want |= {(c, k + 1, max(0, a - 6), min(b + 6, 400)) for k, (a, b) in enumerate(spans)}
    assert {tuple(r) for r in U.speech_islands(df, 6, width=width).select("clip_id", "island", "first_frame", "end_frame").collect()} == want


@pytest.mark.parametrize("width", [1, 13, 1000])
def test_nearest_speaker(spark, width):
    rng = random.Random(3)
    seg, turn = [], []
    for m in range(12):
        seg += [(m, i, a := rng.randrange(500), a + rng.randrange(9)) for i in range(30)]
        turn += [(m, i, a := rng.randrange(500) if m % 2 else 250, a + rng.randrange(9), f"s{i % 3}") for i in range(rng.choice([0, 1, 4, 25]))]
    s, t = spark.createDataFrame(seg, "meeting_id int, seg_no int, start int, end int"), spark.createDataFrame(turn, "meeting_id int, turn_no int, start int, end int, speaker string")
    want = {}
    for m, i, a, b in seg:
        near = [(min(abs(a - d), abs(b - c)), n, who) for k, n, c, d, who in turn if k == m]
        if near:
            want[m, i] = min(near)[::2]
    assert {(r.meeting_id, r.seg_no): (r.gap, r.speaker) for r in U.nearest_speaker(s, t, width).collect()} == want


def test_one_long_meeting_is_many_tasks(spark):
    """A meeting of 400,000 turns: no window sees more than a chunk, and the numbers are those of the plain rule."""
    n = 400_000
    df = spark.range(n).select(F.lit("m").alias("meeting_id"), F.col("id").alias("turn_no"), F.concat(F.lit("S"), (F.col("id") / 3 % 2).cast("int").cast("string")).alias("speaker"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"))
    out = U.merge_turns(df, 5, width=100_000)
    # three turns a run, all within the gap
    assert out.selectExpr("count(*)", "min(n_turns)", "max(n_turns)", "max(turn_no)", "sum(end - start)").first() == (n // 3 + 1, 1, 3, n // 3 + 1, (n // 3) * 28 + 8)
    chunk = U.Chunks("meeting_id", ["start"], 100_000)
    assert chunk.cut(df).select("_chunk").distinct().count() == 40
