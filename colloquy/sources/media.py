"""WAV files as PCM: headers, chunks of bounded length, frame energies.

No row holds a recording. ``recordings`` reads the headers alone; everything else
asks for ranges of frames, which the executors read from the files by offset, so
that memory doesn't grow with a recording and one long recording is many tasks.
Files lie in a store that pyarrow opens by URI (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.shipping import ship
from colloquy.sources.store import written

FRAME_MS = 30
#: Root mean square of 16-bit samples above which a frame counts as speech.
SPEECH_RMS = 200.0
#: Energy frames of a chunk: 30 seconds.
CHUNK_FRAMES = 1000
#: PCM bytes that a task reads.
TASK_BYTES = 128 << 20
#: Fixed values of the WAVE format: plain and extensible PCM.
PCM_FORMATS = (1, 0xFFFE)

#: A range of a recording's frames: where the file has them.
RANGE = ("path", "rate", "channels", "data_at", "first", "n")
Each = Callable[[dict, np.ndarray], pa.RecordBatch | None]


def encode_wav(samples: np.ndarray, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of a folder's WAV files, from metadata alone; ``name`` is the last part of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def opened(path: str):
    """A file for random access."""
    from pyarrow import fs

    at, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return at.open_input_file(inner)


def header(f) -> tuple[int, int, int, int]:
    """(rate, channels, offset of the samples, frames) of an open WAV file; anything but 16-bit PCM is an error.

    A file that ends before its header says has the frames that are there.
    """
    size = f.size()
    mark, _, kind = struct.unpack("<4sI4s", f.read(12))
    if (mark, kind) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if tag not in PCM_FORMATS or bits != 16 or not channels or not rate:
                raise ValueError("not 16-bit PCM")
            form = rate, channels
        elif name == b"data" and form:
            return *form, at + 8, min(n, size - at - 8) // (2 * form[1])
        at += 8 + n + n % 2
    raise ValueError("no samples")


def recordings(files: DataFrame) -> DataFrame:
    """(name, path, rate, channels, data_at, n_frames, duration) from the headers; what isn't a WAV file has no frames and duration 0.0.

    The headers are read once and kept as a table.
    """
    ship(files.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                try:
                    with opened(path) as f:
                        rows.append(header(f))
                except (ValueError, struct.error, OSError):
                    rows.append((None, None, None, 0))
            rate, channels, at, n = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("path"), rate, channels, at, n], names=["name", "path", "rate", "channels", "data_at", "n_frames"])

    found = written(files.select("name", "path").mapInArrow(task, "name string, path string, rate int, channels int, data_at long, n_frames long"), "recordings")
    return found.withColumn("duration", F.when(F.col("n_frames") > 0, F.col("n_frames") / F.col("rate")).otherwise(F.lit(0.0)))


def frame_size(frame_ms: int = FRAME_MS) -> Column:
    """Samples of an energy frame."""
    return (F.col("rate") * frame_ms / 1000).cast("int")


def over_ranges(ranges: DataFrame, each: Each, fields: str) -> DataFrame:
    """What ``each`` makes of every range's samples (int16, the first channel).

    ``ranges`` has the columns of ``RANGE`` and any others, which ``each`` gets as a
    dict. Ranges are dealt out by place, some ``TASK_BYTES`` a task; within a task they
    come file by file in order, and one range is held at a time.
    """
    spark = ranges.sparkSession
    ship(spark)
    size = ranges.agg(F.sum(F.col("n") * F.col("channels") * 2)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            for row in b.to_pylist():
                if row["path"] != path:
                    if f is not None:
                        f.close()
                    path, f = row["path"], opened(row["path"])
                wide = 2 * row["channels"]
                f.seek(row["data_at"] + row["first"] * wide)
                made = each(row, np.frombuffer(f.read(row["n"] * wide), "<i2")[:: row["channels"]])
                if made is not None and made.num_rows:
                    yield made
        if f is not None:
            f.close()

    return ranges.repartition(tasks, "path", "first", "n").sortWithinPartitions("path", "first").mapInArrow(task, fields)


def chunk_ranges(audio: DataFrame, frames: int = CHUNK_FRAMES, frame_ms: int = FRAME_MS) -> DataFrame:
    """Ranges of ``frames`` energy frames each; the last is shorter."""
    wide = (frame_size(frame_ms=frame_ms) * frames).cast("long")
    a = audio.where("n_frames > 0").select("name", "path", "rate", "channels", "data_at", "n_frames", wide.alias("wide"))
    a = a.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_frames") - 1) / F.col("wide")))).alias("k"))
    first = F.col("k") * F.col("wide")
    return a.select("name", "path", "rate", "channels", "data_at", first.alias("first"), F.least(F.col("wide"), F.col("n_frames") - first).alias("n"))


def pcm_chunks(audio: DataFrame, frames: int = CHUNK_FRAMES) -> DataFrame:
    """(name, rate, first, samples): int16 samples of recordings, some seconds a row."""

    def each(row: dict, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([row["rate"]], pa.int32()), pa.array([row["first"]]), pa.array([x], pa.list_(pa.int16()))], names=["name", "rate", "first", "samples"])

    return over_ranges(chunk_ranges(audio, frames), each, "name string, rate int, first long, samples array<short>")


def normalised(samples: Column) -> Column:
    """Samples in [-1, 1)."""
    return F.transform(samples, lambda x: x.cast("float") / F.lit(32768.0).cast("float"))


def frame_energies(audio: DataFrame, frame_ms: int = FRAME_MS, at_least: float = SPEECH_RMS) -> DataFrame:
    """(name, frame, rms, speech) of the whole frames of recordings, a chunk at a time; the sums of squares are integers."""

    def each(row: dict, x: np.ndarray) -> pa.RecordBatch:
        size = int(row["rate"] * frame_ms / 1000)
        x = x[: len(x) // size * size].astype(np.int64).reshape(-1, size)
        rms = np.sqrt((x * x).sum(1) / size)
        frame = row["first"] // size + np.arange(len(x))
        return pa.RecordBatch.from_arrays([pa.array([row["name"]] * len(x), pa.string()), pa.array(frame), pa.array(rms), pa.array(rms > at_least)], names=["name", "frame", "rms", "speech"])

    ranges = chunk_ranges(audio.where(frame_size(frame_ms=frame_ms) > 0), frame_ms=frame_ms)
    return over_ranges(ranges, each, "name string, frame long, rms double, speech boolean")
