"""Who speaks when in a recording: speech islands, windows, voice vectors, clusters, turns."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.clustering import cluster_meetings
from colloquy.operators.turns import absorb_micro_turns, merge_turns, relabel, speech_islands
from colloquy.sources.media import frame_energies, frame_size, over_ranges
from colloquy.sources.store import written

LOG = logging.getLogger(__name__)
Voice = Callable[[np.ndarray, int], np.ndarray]
PAD_FRAMES = 10
WINDOW_SEC, STEP_SEC, LEAST_SPEECH_SEC, LEAST_CLIP_SEC = 2, 1, 0.5, 0.1
GAP_SEC, MICRO_SEC = 0.8, 0.6


def spectrum_voice(samples: np.ndarray, rate: int) -> np.ndarray:
    """Stand-in for a voice encoder: unit vector of the mean power in 32 bands."""
    power = np.abs(np.fft.rfft(samples.astype(float) / 32768)) ** 2
    bands = np.array([p.sum() for p in np.array_split(power, 32)])
    n = np.linalg.norm(bands)
    return bands / n if n else bands


def speech_windows(audio: DataFrame) -> DataFrame:
    """(name, idx, start, end): sample ranges of the windows of recordings' speech, numbered by time.

    A recording without a speech frame is one interval; speech of less than
    ``LEAST_SPEECH_SEC`` is left out.
    """
    a = audio.where("n_frames > 0").select("name", "rate", "n_frames", frame_size().alias("size"))
    n = F.floor(F.col("n_frames") / F.col("size")).cast("long")
    frames = frame_energies(audio).where("speech").join(a.select("name", n.alias("n")), "name").select(F.col("name").alias("clip_id"), "frame", F.col("n").alias("n_frames"))
    found = speech_islands(frames, PAD_FRAMES).select(F.col("clip_id").alias("name"), "first_frame", "end_frame")
    j = a.join(found, "name", "left")
    start, end = F.coalesce(F.col("first_frame") * F.col("size"), F.lit(0)).cast("long"), F.least(F.coalesce(F.col("end_frame") * F.col("size"), F.col("n_frames")), F.col("n_frames")).cast("long")
    j = j.select("name", "rate", start.alias("start"), end.alias("end"))
    j = j.where(F.col("end") - F.col("start") >= (F.col("rate") * LEAST_SPEECH_SEC).cast("int"))
    wide, step = F.col("rate") * WINDOW_SEC, F.col("rate") * STEP_SEC
    starts = F.when(F.col("end") - F.col("start") <= wide, F.array("start")).otherwise(F.sequence(F.col("start"), F.col("end") - F.floor(wide / 2) - 1, step.cast("long")))
    w = j.withColumn("w_start", F.explode(starts)).withColumn("w_end", F.least(F.col("w_start") + wide, F.col("end")))
    # neighbouring intervals may overlap, so ties in the start go by the end
    idx = F.row_number().over(W.partitionBy("name").orderBy("w_start", "w_end")) - 1
    return w.select("name", idx.cast("long").alias("idx"), F.col("w_start").alias("start"), F.col("w_end").alias("end"))


def voice_vectors(audio: DataFrame, windows: DataFrame, voice: Voice = spectrum_voice) -> DataFrame:
    """(meeting_id, idx, start, end, embedding): windows without a voice vector (too short, or silent) are left out.

    Each window's samples are read by themselves, wherever the chunks of a recording end.
    """

    def each(row: dict, x: np.ndarray) -> pa.RecordBatch | None:
        rate = row["rate"]
        v = np.asarray(voice(x, rate), float) if len(x) >= LEAST_CLIP_SEC * rate else np.zeros(1)
        if not np.linalg.norm(v) > 0:
            return None
        made = [pa.array([row["name"]]), pa.array([row["idx"]]), pa.array([row["first"] / rate]), pa.array([(row["first"] + row["n"]) / rate]), pa.array([v.astype(np.float32)], pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(made, names=["meeting_id", "idx", "start", "end", "embedding"])

    ranges = audio.select("name", "path", "rate", "channels", "data_at").join(windows, "name").select("*", F.col("start").alias("first"), (F.col("end") - F.col("start")).alias("n")).drop("start", "end")
    return over_ranges(ranges, each, "meeting_id string, idx long, start double, end double, embedding array<float>")


def smoothed(turns: DataFrame) -> DataFrame:
    """Turns (meeting_id, turn_no, speaker, start, end in seconds) merged, rounded, and freed of micro-turns."""
    merged = merge_turns(turns, GAP_SEC).withColumn("start", F.bround("start", 2)).withColumn("end", F.bround("end", 2))
    return absorb_micro_turns(merged.select("meeting_id", "turn_no", "speaker", "start", "end"), MICRO_SEC)


def diarised(audio: DataFrame, voice: Voice = spectrum_voice, k: int | None = None) -> DataFrame:
    """(meeting_id, turn_no, speaker, start, end) of recordings; one without a voice is one turn of Speaker 1.

    An empty recording has no turn. Windows and vectors are written to the shared
    folder once, so no file is read again for what follows from them.
    """
    windows = written(speech_windows(audio), "speech-windows")
    vectors = written(voice_vectors(audio, windows, voice), "voice-vectors")
    labels = cluster_meetings(vectors, k)
    labelled = vectors.select("meeting_id", "idx", "start", "end").join(labels, ["meeting_id", "idx"])
    turns = labelled.select("meeting_id", F.col("idx").alias("turn_no"), F.concat(F.lit("Speaker "), (F.col("speaker_id") + 1).cast("string")).alias("speaker"), "start", "end")
    found = smoothed(turns)
    rest = audio.where("n_frames > 0").join(found.select(F.col("meeting_id").alias("name")).distinct(), "name", "left_anti")
    alone = rest.select(F.col("name").alias("meeting_id"), F.lit(1).cast("long").alias("turn_no"), F.lit("Speaker 1").alias("speaker"), F.lit(0.0).alias("start"), F.bround("duration", 2).alias("end"))
    return found.select("meeting_id", "turn_no", "speaker", "start", "end").unionByName(alone)


def external_turns(labelled: DataFrame, order: str = "turn_no") -> DataFrame:
    """Turns of another diariser (meeting_id, turn_no, label, start, end): its labels become speakers in order of appearance."""
    t = relabel(labelled.withColumn("start", F.bround("start", 2)).withColumn("end", F.bround("end", 2)), "label", order)
    return smoothed(t.select("meeting_id", "turn_no", F.concat(F.lit("Speaker "), (F.col("label") + 1).cast("string")).alias("speaker"), "start", "end"))


def with_fallback(audio: DataFrame, diarise: Callable[[DataFrame], DataFrame], voice: Voice = spectrum_voice, k: int | None = None) -> DataFrame:
    """What another diariser gives for ``audio``; if it can't be had or gives nothing, the local one's turns, and the reason is logged."""
    reason: object = "no turns"
    try:
        got = external_turns(diarise(audio))
        if not got.isEmpty():
            return got
    except Exception as e:  # whatever the other one raises
        reason = e
    LOG.warning("the other diariser isn't used: %s", reason)
    return diarised(audio, voice, k)
