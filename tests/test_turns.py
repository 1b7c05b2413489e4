"""Window forms against plain sequential definitions on seeded random turns."""

import random

from colloquy.operators import turns as U


def merged(turns, gap):
    out = []
    for start, end, speaker in turns:
        if out and out[-1][2] == speaker and start <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, speaker])
    return [tuple(t) for t in out]


def absorbed(turns, short):
    out, i = [], 0
    while i < len(turns):
        start, end, speaker = turns[i]
        if out and i + 1 < len(turns) and end - start < short and out[-1][2] == turns[i + 1][2] == (turns[i - 1][2]):
            out[-1] = (out[-1][0], turns[i + 1][1], out[-1][2])
            i += 2
        else:
            out.append((start, end, speaker))
            i += 1
    return out


def test_merge_and_absorb(spark):
    rng, rows, want_m, want_a = random.Random(11), [], {}, {}
    for m in range(150):
        t, turns = 0, []
        for _ in range(rng.randint(1, 12)):
            start = t + rng.randint(0, 12)
            end = start + rng.randint(1, 14)
            turns.append((start, end, rng.choice("ab")))
            t = start
        turns = sorted(set(turns))
        rows += [(str(m), k, s, e, sp) for k, (s, e, sp) in enumerate(turns)]
        want_m[str(m)] = merged(turns, 4)
    got = {}
    df = U.merge_turns(spark.createDataFrame(rows, "meeting_id string, turn_no long, start long, end long, speaker string"), 4)
    for r in df.orderBy("meeting_id", "turn_no").collect():
        got.setdefault(r.meeting_id, []).append((r.start, r.end, r.speaker))
    assert got == want_m
    for m, turns in want_m.items():
        want_a[m] = absorbed(turns, 6)
    got = {}
    for r in U.absorb_micro_turns(df, 6).orderBy("meeting_id", "turn_no").collect():
        got.setdefault(r.meeting_id, []).append((r.start, r.end, r.speaker))
    assert got == want_a


def test_alignment_prefers_the_larger_overlap(spark):
    seg = spark.createDataFrame([("m", 0, 50, 80, "hello")], "meeting_id string, seg_no int, start long, end long, text string")
    turns = spark.createDataFrame([("m", 0, "S1", 50, 60), ("m", 1, "S2", 55, 80)], "meeting_id string, turn_no int, speaker string, start long, end long")
    assert U.align(seg, turns).first()["speaker"] == "S2"
    assert U.align(seg, turns.limit(0)).first()["speaker"] == "Speaker 1"
