"""Boundaries to language and embedding models: retries, failover, batches, map-reduce and repair loops.

A model is a plain function that is passed in: ``generate(prompt) -> text`` and
``embed(texts) -> vectors``. It runs on the executors, in Arrow batches; where none
is given, ``hashed_vectors`` stands in, which needs no network. A task that is
repeated asks again; nothing but a finished task's rows counts.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators.documents import llm_chunks
from colloquy.operators.records import checked
from colloquy.sources.tables import fill_prompt

Generate = Callable[[str], str]
Embed = Callable[[list[str]], list[list[float]]]
ATTEMPTS, DELAYS = 3, (1.0, 2.0, 4.0)
BATCH = 100
MOST_TOKENS, CHUNK_TOKENS, LEAST_WORDS, FIXES = 150_000, 6000, 3, 2
SUMMARISE = "Summarise this part of a meeting:\n{chunk}"
MERGE = "Merge these summaries:\n{summaries}"
EXTRACT = "Extract the meeting's record as JSON:\n{transcript}"
REPAIR = "This JSON is not valid.\n{raw_output}\nError: {error_message}\nReturn valid JSON."


class ModelError(RuntimeError):
    """All attempts with all keys failed."""


def key_pool(env: Mapping[str, str], listed: str, numbered: Sequence[str]) -> list[str]:
    """Keys in order without repeats: those of the comma-separated variable, then the single ones."""
    every = [*env.get(listed, "").split(","), *(env.get(name) or "" for name in numbered)]
    return list(dict.fromkeys(k.strip() for k in every if k.strip()))


def with_retries(calls: Sequence[Callable[[], object]], attempts: int = ATTEMPTS, delays: Sequence[float] = DELAYS, sleep: Callable[[float], None] = time.sleep):
    """Result of the first call (one for each key) that succeeds or gives something; each is tried ``attempts`` times."""
    last: Exception | None = None
    for call in calls:
        for attempt in range(attempts):
            try:
                if got := call():
                    return got
                raise ModelError("the model returned nothing")
            except Exception as e:  # whatever a client raises
                last = e
                if attempt + 1 < attempts:
                    sleep(delays[min(attempt, len(delays) - 1)])
    raise ModelError(f"failed with all {len(calls)} keys: {last}") from last


def timed(run: Callable[[], object]) -> tuple[object, float]:
    """(result, milliseconds)."""
    began = time.perf_counter()
    return run(), (time.perf_counter() - began) * 1000


def hashed_vectors(texts: list[str], size: int = 16) -> list[list[float]]:
    """Deterministic vectors from the bytes of the SHA-256: equal texts, equal vectors."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:size]] for t in texts]


def embedded(rows: DataFrame, embed: Embed = hashed_vectors, text: str = "text", skip: str | None = None, batch: int = BATCH, delays: Sequence[float] = DELAYS) -> DataFrame:
    """Adds ``embedding``: null where the text is blank or the column ``skip`` is true, never at another place.

    At most ``batch`` texts go to the model at once, and a task's Python holds no more vectors.
    """
    out = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, embedding array<double>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = b.column(text).to_pylist()
                skipped = b.column(skip).to_pylist() if skip is not None else [False] * len(texts)
                wanted = [i for i, t in enumerate(texts) if t is not None and t.strip() != "" and not skipped[i]]
                vectors = [None] * len(texts)
                if wanted:
                    part = [texts[i] for i in wanted]
                    for i, v in zip(wanted, with_retries([lambda part=part: embed(part)], delays=delays), strict=False):
                        vectors[i] = v
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

    return rows.mapInArrow(task, out)


def _generated(df: DataFrame, prompt, generate: Generate, name: str, delays: Sequence[float]) -> DataFrame:
    ask = lambda p: None if p is None else with_retries([lambda: generate(p)], delays=delays)
    return df.withColumn(name, F.pandas_udf(lambda s: s.map(ask, na_action="ignore"), "string")(prompt))


def _filled(template: str, name: str, value):
    fill_prompt(template, **{name: ""})  # a template with other placeholders is an error
    return F.replace(F.lit(template), F.lit("{" + name + "}"), value)


def condensed(docs: DataFrame, generate: Generate, key: str = "doc_id", most_tokens: int = CHUNK_TOKENS, summarise: str = SUMMARISE, merge: str = MERGE, delays: Sequence[float] = DELAYS) -> DataFrame:
    """(key, working): long texts as the merged summaries of their chunks, in order; short ones as they are."""
    d = docs.select(key, "text")
    is_long = T.tokens_by_words(F.col("text")) > most_tokens
    chunks = d.where(is_long).select(key, F.posexplode(llm_chunks(F.col("text"), most_tokens)).alias("pos", "chunk"))
    parts = _generated(chunks, _filled(summarise, "chunk", F.col("chunk")), generate, "said", delays)
    section = F.concat(F.lit("[Section "), (F.col("pos") + 1).cast("string"), F.lit("]:\n"), "said")
    joined = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", section.alias("s")))).alias("x"))
    joined = joined.select(key, F.array_join(F.transform("x", lambda s: s["s"]), "\n\n---\n\n").alias("sections"))
    merged = _generated(joined, _filled(merge, "summaries", F.col("sections")), generate, "working", delays)
    return d.where(~is_long).select(key, F.col("text").alias("working")).unionByName(merged.select(key, "working"))


def input_fault(text: str | None, least_words: int = LEAST_WORDS, most_tokens: int = MOST_TOKENS) -> str | None:
    words = len((text or "").split())
    if not words:
        return "Transcript is empty or contains only whitespace."
    if words < least_words:
        return f"Transcript is too short ({words} words). A minimum of {least_words} words is required."
    if int(words * 1.3) > most_tokens:
        return f"Transcript exceeds maximum allowed input size: {int(words * 1.3)} estimated tokens (limit: {most_tokens})."
    return None


def extracted(docs: DataFrame, generate: Generate, key: str = "doc_id", fixes: int = FIXES, prompt: str = EXTRACT, repair: str = REPAIR, most_tokens: int = CHUNK_TOKENS, delays: Sequence[float] = DELAYS) -> DataFrame:
    """(key, record, calls, error): the record as JSON after at most ``fixes`` repairs; else the reason why there is none.

    Inputs that a model needn't see are refused before any call, a document's
    failure doesn't end the others.
    """
    guard = F.pandas_udf(lambda s: s.map(input_fault), "string")
    judged = docs.select(key, "text").withColumn("refused", guard(F.coalesce("text", F.lit(""))))
    work = condensed(judged.where("refused IS NULL"), generate, key, most_tokens, delays=delays)
    kind = dict(docs.dtypes)[key]

    def one(text: str) -> tuple[str | None, int, str | None]:
        asked, calls = fill_prompt(prompt, transcript=text), 0
        try:
            while True:
                raw = with_retries([lambda: generate(asked)], delays=delays)
                calls += 1
                record, fault = checked(raw)
                if record is not None:
                    return json.dumps(record, sort_keys=True), calls, None
                if calls > fixes:
                    return None, calls, f"Failed to extract a valid record after {fixes} repairs. {fault}"
                asked = fill_prompt(repair, raw_output=raw, error_message=fault)
        except ModelError as e:
            return None, calls, str(e)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(t) for t in f["working"]]
            yield pd.DataFrame({key: f[key].tolist(), "record": [g[0] for g in got], "calls": [g[1] for g in got], "error": [g[2] for g in got]})

    out = work.mapInPandas(task, f"{key} {kind}, record string, calls int, error string")
    refused = judged.where("refused IS NOT NULL").select(key, F.lit(None).cast("string").alias("record"), F.lit(0).alias("calls"), F.col("refused").alias("error"))
    return out.unionByName(refused)
