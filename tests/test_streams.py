"""Streams against their batch forms: several batches, late rows, restarts, state that goes."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions import vectors as V
from colloquy.operators import clustering as C
from colloquy.plans import registry
from colloquy.streaming import events as E
from colloquy.streaming import speakers
from colloquy.streaming.speakers import clustered

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)
WINDOW = "meeting_id string, idx long, ts timestamp, embedding array<double>"


def test_stream_of_the_table_equals_the_batch(spark):
    want = {(r.meeting_id, r.idx): r.speaker_id for r in registry.QUERIES["x6_sequential_clustering"](spark, SF).collect()}
    got = {(r.meeting_id, r.idx): r.speaker_id for r in registry.QUERIES["x6_stream_clustering"](spark, SF).collect()}
    assert got == want and len(set(want.values())) > 3


@pytest.fixture(scope="module")
def voices():
    """Three meetings of windows a second apart around a few centroids: (meeting, idx, second, unit vector)."""
    rng, out = np.random.default_rng(5), []
    for m in range(3):
        centres = C.units(rng.normal(0, 1, (4, 8)))
        for i in range(90):
            v = C.units((centres[rng.integers(0, 4)] + rng.normal(0, 0.12, 8))[None])[0]
            out.append((f"m{m}", i, i, v))
    return out


def labels(rows):
    return {(r.meeting_id, r.idx): r.speaker_id for r in rows.collect()}


def put(spark, folder, rows):
    df = spark.createDataFrame([(m, i, T0 + datetime.timedelta(seconds=s), [float(x) for x in v]) for m, i, s, v in rows], WINDOW)
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    raw = spark.readStream.schema(WINDOW).option("maxFilesPerTrigger", 1).parquet(folder)
    return clustered(raw, late="30 seconds", idle_seconds=600)


END = ("end", 0, 100_000, np.ones(8) / 8**0.5)


def test_late_windows_wait_and_a_restart_goes_on(spark, voices, tmp_path):
    want = {}
    for m in ("m0", "m1", "m2"):
        mine = [v for v in voices if v[0] == m]
        want |= {(m, i): int(k) for (_, i, _, _), k in zip(mine, C.sequential(np.array([v for *_, v in mine])), strict=True)}
    rng, folder, out = np.random.default_rng(1), str(tmp_path / "in"), str(tmp_path / "out")
    # within 30 seconds windows come in any order, across batches too
    order = sorted(voices, key=lambda v: v[2] + rng.uniform(0, 25))
    for k in range(0, 150, 30):
        put(spark, folder, order[k : k + 30])
    first = E.appended(stream(spark, folder), out)
    assert 0 < first.rows.count() < 150 and first.late() == 0
    seen = labels(first.rows)
    for k in range(150, 270, 60):
        put(spark, folder, order[k : k + 60])
    put(spark, folder, [END])
    second = E.appended(stream(spark, folder), out)  # from the checkpoint
    got = labels(second.rows.where("meeting_id <> 'end'"))
    assert got == want and seen.items() <= got.items()
    assert len(set(want.values())) >= 4
    # only the last window's meeting is left: the others were idle for longer than 600 seconds
    assert second.batches[-1][2] <= 4


def events(spark, rows):
    return spark.createDataFrame([(T0 + datetime.timedelta(minutes=m), k, float(v)) for m, k, v in rows], "ts timestamp, event_type string, value double")


def test_windows_are_written_once_and_late_rows_are_counted(spark, tmp_path):
    schema, folder = "ts timestamp, event_type string, value double", str(tmp_path / "in")
    batches = [[(m, "a", 1) for m in range(k * 120, k * 120 + 120)] for k in range(8)]
    batches[3] += [(5, "a", 100), (7, "b", 100)]  # hours late
    batches[2] += [(239 - 3, "a", 1)]  # late, but not too late
    for b in batches:
        events(spark, b).coalesce(1).write.mode("append").parquet(folder)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = E.appended(E.windowed(raw, "1 hour"), str(tmp_path / "out"))
    kept = events(spark, [r for b in batches for r in b if r[2] < 100])
    closed = E.windowed(kept, "1 hour").where(F.col("w_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(T0 + datetime.timedelta(minutes=959 - 10)))
    assert sorted(map(tuple, run.rows.collect())) == sorted(map(tuple, closed.collect())) and run.rows.count() == 15
    assert run.late() == 2
    assert max(b[2] for b in run.batches) <= 4  # open windows alone, however long the stream
    again = E.appended(E.windowed(raw, "1 hour"), str(tmp_path / "out"))
    assert again.rows.count() == 15 and again.late() == 0  # nothing new, nothing twice


def test_staged_batches_are_in_order(spark, tmp_path):
    rows = events(spark, [(m % 97, "a", m) for m in range(97)])
    out = E.staged(rows, str(tmp_path / "s"), parts=4)
    assert out.isStreaming
    files = sorted((tmp_path / "s").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 4
    highs = [spark.read.parquet(str(f)).agg(F.min("ts"), F.max("ts")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(highs, highs[1:], strict=False))
    assert E.staged(rows.limit(0), str(tmp_path / "none")).isStreaming


def test_parts_are_written_by_many_tasks_and_taken_whole(spark, tmp_path):
    # a third of the rows has one instant, so that parts differ in size
    rows = events(spark, [(60 if m % 3 else m, "a", m) for m in range(960)] + [(3000, "a", 0)]).repartition(6)
    run = E.fed(rows, lambda e: E.windowed(e, "1 hour"), str(tmp_path / "f"))
    assert len(list((tmp_path / "f" / "in").glob("*.parquet"))) > 8  # four of them if one task wrote a part
    want = E.windowed(rows.where("ts < '2024-01-02 12:00:00'"), "1 hour").collect()
    assert sorted(map(tuple, run.rows.collect())) == sorted(map(tuple, want)) and len(want) == 16
    assert run.late() == 0 and sum(b[1] for b in run.batches) == 961


def test_a_meeting_waits_for_one_timer(voices):
    class Handle:
        def __init__(self):
            self.timers = set()

        def registerTimer(self, ms):  # noqa: N802
            self.timers.add(ms)

    class State:
        def __init__(self):
            self.held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = put = lambda self, v: setattr(self, "held", v)
        appendList = lambda self, v: setattr(self, "held", [*(self.held or []), *v])  # noqa: E731, N815
        clear = lambda self: setattr(self, "held", None)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    own, handle = [v for v in voices if v[0] == "m0"], Handle()
    it = speakers.Speakers(0.8, 0.2, 600_000)
    it.handle, it.waiting, it.centroids, it.last = handle, State(), State(), State()
    got, calls = {}, 0
    for now, low in ((0, 0), (20_000, 30), (40_000, 60), (300_000, 90), (2_000_000, 90)):
        part = own[low : low + 30]
        if part:
            frame = pd.DataFrame({"ms": [s * 1000 for _, _, s, _ in part], "idx": [i for _, i, _, _ in part], "embedding": [v for *_, v in part]})
            assert list(it.handleInputRows(("m0",), iter([frame]), None)) == []
        while due := [t for t in sorted(handle.timers) if t <= now]:
            handle.timers.discard(due[0])
            calls += 1
            for out in it.handleExpiredTimer(("m0",), Now(now), None):
                got |= dict(zip(out["idx"], out["speaker_id"], strict=True))
        assert set(got) == {i for _, i, s, _ in own[: low + 30] if s * 1000 <= now}
    assert [got[i] for _, i, _, _ in own] == list(C.sequential(np.array([v for *_, v in own])))
    assert calls <= 10  # one for each of 90 windows before
    assert it.last.held is it.waiting.held is it.centroids.held is None


def test_the_length_of_a_vector_is_computed_once(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(V.unit(F.col("v")).alias("u"))
    assert [r.u for r in v.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1  # not in the function that each component goes through
