"""Recordings: headers, chunks, energies, windows and turns, against the rules one after the other."""

import os
import subprocess
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import clustering as C
from colloquy.operators import diarisation
from colloquy.plans import registry
from colloquy.sources import media

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tones(rng, spans, rate=16_000):
    """Two voices (tones) in ``spans`` of (voice or None, seconds)."""
    parts = []
    for v, sec in spans:
        t = np.arange(int(sec * rate)) / rate
        parts.append(np.zeros(len(t)) if v is None else 6000 * np.sin(2 * np.pi * (300 if v == 0 else 5000) * t) + rng.normal(0, 20, len(t)))
    return np.concatenate(parts).astype(np.int16)


def recorded(spark, folder, clips):
    for name, content in clips.items():
        (folder / name).write_bytes(content)
    return media.recordings(media.wav_files(spark, f"file://{folder}"))


def stereo(left, right, rate):
    import io

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.stack([left, right], 1).astype("<i2").tobytes())
    return out.getvalue()


def test_planted_voices(spark, tmp_path):
    rng = np.random.default_rng(1)
    spans = [(0, 18), (None, 2), (1, 18), (None, 2), (0, 18)]  # the second voice stands across a chunk's end
    clips = {"two.wav": media.encode_wav(tones(rng, spans)), "silent.wav": media.encode_wav(np.zeros(48_000, np.int16)), "none.wav": media.encode_wav(np.zeros(0, np.int16)), "bad.wav": b"xx"}
    audio = recorded(spark, tmp_path, clips)
    lengths = {r.name: (r.n_frames, r.duration) for r in audio.collect()}
    assert lengths == {"two.wav": (928_000, 58.0), "silent.wav": (48_000, 3.0), "none.wav": (0, 0.0), "bad.wav": (0, 0.0)}
    turns = {}
    for r in sorted(diarisation.diarised(audio).collect(), key=lambda r: (r.meeting_id, r.start)):
        turns.setdefault(r.meeting_id, []).append((r.speaker, r.start, r.end))
    assert turns["silent.wav"] == [("Speaker 1", 0.0, 3.0)] and set(turns) == {"two.wav", "silent.wav"}
    assert [t[0] for t in turns["two.wav"]] == ["Speaker 1", "Speaker 2", "Speaker 1"]
    for (_, a, b), (c, d) in zip(turns["two.wav"], [(0, 18), (20, 38), (40, 58)], strict=True):
        assert abs(a - c) < 0.6 and abs(b - d) < 0.6


def test_the_reason_of_a_fallback_is_logged(spark, tmp_path, caplog):
    audio = recorded(spark, tmp_path, {"a.wav": media.encode_wav(np.zeros(48_000, np.int16))})
    assert diarisation.with_fallback(audio, lambda _: 1 / 0).count() == 1
    assert "division by zero" in caplog.text


def test_headers_and_chunks(spark, tmp_path):
    rng = np.random.default_rng(3)
    left = rng.integers(-32768, 32767, 8000 * 65 + 7)
    whole = media.encode_wav(left[:999])
    extra = whole[:12] + b"LIST" + (5).to_bytes(4, "little") + b"hello\0" + whole[12:]  # a chunk of odd length before
    clips = {"st.wav": stereo(left, -left // 2, 8000), "cut.wav": whole[: 44 + 2 * 500 + 1], "list.wav": extra, "u8.wav": whole[:34] + b"\x08\0" + whole[36:], "head.wav": whole[:40]}
    audio = recorded(spark, tmp_path, clips)
    got = {r.name: (r.rate, r.channels, r.n_frames) for r in audio.collect()}
    assert got == {"st.wav": (8000, 2, len(left)), "cut.wav": (16_000, 1, 500), "list.wav": (16_000, 1, 999), "u8.wav": (None, None, 0), "head.wav": (None, None, 0)}
    chunks = media.pcm_chunks(audio).collect()
    assert max(len(r.samples) for r in chunks) == 240_000 and len([r for r in chunks if r.name == "st.wav"]) == 3
    for name, want in (("st.wav", left), ("cut.wav", left[:500]), ("list.wav", left[:999])):
        assert np.concatenate([r.samples for r in sorted(chunks, key=lambda r: r.first) if r.name == name]).tolist() == want.tolist()
    assert media.pcm_chunks(audio).select(media.normalised(F.array(F.lit(-32768).cast("short"), F.lit(0).cast("short"), F.lit(16384).cast("short"))).alias("x")).first().x == [-1.0, 0.0, 0.5]
    x = left[: len(left) // 160 * 160].astype(np.int64).reshape(-1, 160)
    energies = {r.frame: r.rms for r in media.frame_energies(audio, frame_ms=20).where("name = 'st.wav'").collect()}
    assert energies == {i: float(np.sqrt((v * v).sum() / 160)) for i, v in enumerate(x)}
    assert media.frame_energies(audio.limit(0)).count() == 0


def sequential_turns(x, rate, voice):
    """One recording's turns, rule after rule on lists."""
    if not len(x):
        return []
    size, pad = int(rate * 0.03), 10
    n = len(x) // size
    speech = [np.sqrt((x[i * size : (i + 1) * size].astype(float) ** 2).mean()) > 200 for i in range(n)]
    spans, start, quiet = [], None, 0
    for i, s in enumerate(speech):
        if s:
            start, quiet = max(0, i - pad) if start is None else start, 0
        elif start is not None:
            quiet += 1
            if quiet >= pad:
                spans.append((start * size, i * size))
                start, quiet = None, 0
    spans += [(start * size, n * size)] if start is not None else []
    windows, vectors = [], []
    for a, b in spans or [(0, len(x))]:
        if b - a < int(0.5 * rate):
            continue
        for s in [a] if b - a <= 2 * rate else range(a, b - rate, rate):
            e = min(s + 2 * rate, b)
            v = voice(x[s:e], rate)
            if np.linalg.norm(v) > 0:
                windows.append((s / rate, e / rate))
                vectors.append(v.astype(np.float32))
    whole = [("Speaker 1", 0.0, round(len(x) / rate, 2))]
    if not windows:
        return whole
    order = sorted(range(len(windows)), key=lambda i: windows[i])
    labels = C.cluster(np.array([vectors[i] for i in order]))
    merged = []
    for i, who in zip(order, labels, strict=True):
        s, e = windows[i]
        if merged and merged[-1][0] == who and s <= merged[-1][2] + 0.8:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([who, s, e])
    merged = [[f"Speaker {w + 1}", round(s, 2), round(e, 2)] for w, s, e in merged]
    out, i = [], 0
    while i < len(merged):
        if out and i + 1 < len(merged) and merged[i][2] - merged[i][1] < 0.6 and out[-1][0] == merged[i + 1][0]:
            out[-1][2] = merged[i + 1][2]
            i += 2
        else:
            out.append(list(merged[i]))
            i += 1
    return [tuple(t) for t in out]


def test_query_equals_the_rules_one_after_the_other(spark):
    from colloquy.plans.composites import made_recording

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in sorted(registry.QUERIES["x8_local_diarisation"](spark, sf).collect(), key=lambda r: (r.meeting_id, r.turn_no)):
        got.setdefault(r.meeting_id, []).append((r.speaker, r.start, r.end))
    keys = [r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()]
    want = {f"s{k}.wav": sequential_turns(made_recording(k).astype(np.int16), 16_000, diarisation.spectrum_voice) for k in keys}
    assert got == {k: v for k, v in want.items() if v}


LONG = """
import sys, resource
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from colloquy.operators import diarisation
from colloquy.sources import media
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
audio = media.recordings(media.wav_files(spark, "file://{folder}"))
e = media.frame_energies(audio).selectExpr("count(*)", "count_if(speech)", "max(frame)").first()
w = diarisation.speech_windows(audio)
v = diarisation.voice_vectors(audio, w).selectExpr("count(*)", "max(end)").first()
worker = max(int(x) for x in spark.sparkContext.parallelize(range(4), 4).map(lambda _: __import__("resource").getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024).collect())
print("RESULT", *e, *v, worker)
"""


@pytest.mark.parametrize("minutes", [1, 120])
def test_two_hours_in_one_gigabyte(tmp_path, minutes):
    """Half a minute of tone in each minute; the heap is the same for one minute and for two hours."""
    rate, folder = 16_000, tmp_path / "wavs"
    folder.mkdir()
    minute = np.concatenate([(4000 * np.sin(np.arange(30 * rate) * 0.3)).astype("<i2"), np.zeros(30 * rate, "<i2")]).tobytes()
    with wave.open(str(folder / "long.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        for _ in range(minutes):
            f.writeframesraw(minute)
    code = LONG.format(root=ROOT, folder=folder)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": ROOT})
    line = [x for x in done.stdout.splitlines() if x.startswith("RESULT")]
    assert line, done.stderr[-2000:]
    frames, speech, last, n, end, worker = line[0].split()[1:]
    assert (int(frames), int(speech), int(last)) == (2000 * minutes, 1000 * minutes, 2000 * minutes - 1)
    # a minute's speech of 30 seconds and the pad after it (and before it, but for the first): starts a second apart
    assert int(n) == 30 + 30 * (minutes - 1) and round(float(end), 6) == round(60 * minutes - 29.73, 6)
    assert int(worker) < 400  # MB of a Python worker
