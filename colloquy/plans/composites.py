"""Composites: inserts, files, recordings, indexing, answers, model loops, endpoints."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import diarisation, indexing, models, records, requests
from colloquy.operators import documents as D
from colloquy.operators import people as P
from colloquy.operators import search as S
from colloquy.operators import turns as U
from colloquy.plans import vector
from colloquy.plans.registry import query
from colloquy.plans.text import CLEAN, SENTS, TOPIC_SQL, TOPICS, WORDS, docs
from colloquy.plans.time import MERGED, events_turns
from colloquy.shipping import ship
from colloquy.sources import media, store
from colloquy.sources.tables import file_listing, recording_pairs, speaker_turns, table
from colloquy.sources.vector_table import VectorTable

NO_WAIT = (0.0, 0.0, 0.0)


def short_hash(prompt: str) -> str:
    """Stand-in for a language model: what it says depends on the whole prompt."""
    return hashlib.sha256(prompt.encode()).hexdigest()[:12]


# ---- inserts and files


@query(
    "k1_insert_meetings",
    "SELECT 'c' || c_custkey AS id, 1::BIGINT AS n_participants, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_items, c_mktsegment AS summary FROM customer",
)
def k1(spark, d):
    """Customers as meetings with their orders as items, in two inserts."""
    items = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("task"), F.lit("Unassigned").alias("assignee"), F.lit(None).cast("string").alias("deadline"), F.lit("Medium").alias("priority"), F.lit("Not Started").alias("status"))).alias("action_items")
    )
    c = table(spark, d, "customer").join(items, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", F.lit("t").alias("transcript"), F.col("c_mktsegment").alias("summary"), F.array().cast("array<string>").alias("key_points"), F.array().cast("array<string>").alias("decisions"),
        F.array(F.struct(F.col("c_name").alias("name"), F.lit(False).alias("is_unknown_assignee"))).alias("participants"), "action_items",
    )
    folder = store.scratch(spark, "meetings")
    for part in (0, 1):
        store.insert_meetings(rows.where(F.col("c_custkey") % 2 == part).drop("c_custkey"), folder)
    kids = [store.stored(spark, folder, t).groupBy(F.col("meeting_id").alias("id")).agg(F.count("*").alias(n)) for t, n in (("participants", "n_participants"), ("action_items", "n_items"))]
    out = store.stored(spark, folder, "meetings").join(kids[0], "id", "left").join(kids[1], "id", "left")
    return out.select("id", F.coalesce("n_participants", F.lit(0)).cast("long").alias("n_participants"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "summary")


#: Each part's words against the next one's; DuckDB's edit distance is over bytes, so a word becomes one ASCII character.
PART_PAIRS = r"""pr AS (SELECT a.p_partkey AS id, a.p_size AS size, a.p_retailprice AS price, a.p_name || ' ' || a.p_type AS reference, b.p_name || CASE b.p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || b.p_type ELSE ' ' || b.p_type || ' more' END AS hypothesis
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
wp AS (SELECT *, string_split(lower(reference), ' ') AS r, string_split(lower(hypothesis), ' ') AS h FROM pr),
voc AS (SELECT list_sort(list_distinct(flatten(list(list_concat(r, h))))) AS v FROM wp),
ed AS (SELECT wp.*, levenshtein(array_to_string(list_transform(r, lambda w: chr(33 + list_position(v, w)::INT)), ''), array_to_string(list_transform(h, lambda w: chr(33 + list_position(v, w)::INT)), '')) AS edits FROM wp, voc),
we AS (SELECT *, edits / len(r) AS w FROM ed)"""


def part_pairs(spark, d):
    p = table(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n2"), F.col("p_type").alias("t2"), (F.col("p_size") % 3).alias("k"))
    said = F.when(F.col("k") == 0, F.col("n2")).when(F.col("k") == 1, F.concat("n2", F.lit(" "), "t2")).otherwise(F.concat("n2", F.lit(" "), "t2", F.lit(" more")))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.concat("p_name", F.lit(" "), "p_type").alias("reference"), said.alias("hypothesis"))


#: A cell holds its counts in one number: cost, substitutions, deletions, insertions, three digits each. Cells are filled row by row.
EDITS = f"""{PART_PAIRS.replace('wp AS', 'wp AS MATERIALIZED')},
cell AS (SELECT id, r, h, 0 AS x, [0::BIGINT] AS c FROM wp UNION ALL
  SELECT id, r, h, x + 1, list_append(c, CASE WHEN i = 0 THEN ins WHEN j = 0 THEN del WHEN keep // 1000000000 <= least(del // 1000000000, ins // 1000000000) THEN keep WHEN del // 1000000000 <= ins // 1000000000 THEN del ELSE ins END)
  FROM (SELECT *, c[x + 1] + 1000000001 AS ins, CASE WHEN i > 0 THEN c[x + 1 - len(h)] + 1000001000 END AS del, CASE WHEN i > 0 AND j > 0 THEN c[x - len(h)] + CASE WHEN r[i] = h[j] THEN 0 ELSE 1001000000 END END AS keep
    FROM (SELECT *, ((x + 1) // (len(h) + 1))::INT AS i, ((x + 1) % (len(h) + 1))::INT AS j FROM cell WHERE x + 1 < (len(r) + 1) * (len(h) + 1)))),
done AS (SELECT id, c[-1] AS e FROM cell WHERE x + 1 = (len(r) + 1) * (len(h) + 1))"""


@query(
    "f21_word_errors_of_parts",
    f"WITH RECURSIVE {EDITS} SELECT id, len(r)::INT AS ref_words, len(h)::INT AS hyp_words, edits::INT AS edits, (e // 1000000 % 1000)::INT AS substitutions, (e // 1000 % 1000)::INT AS deletions, (e % 1000)::INT AS insertions, round_even(w, 4) AS wer, round_even(greatest(0, (1 - w) * 100), 2) AS accuracy, (1 - w) * 100 >= 90 AS passed FROM we JOIN done USING (id)",
)
def f21_parts(spark, d):
    """All three counts, by the rule of ties that ``edit_counts`` states."""
    return D.word_error_rate(part_pairs(spark, d)).select("id", "ref_words", "hyp_words", "edits", "substitutions", "deletions", "insertions", "wer", "accuracy", "passed")


@query(
    "f32_script_word_errors",
    f"WITH {PART_PAIRS} SELECT id, round_even(w, 4) AS wer FROM we",
)
def f32(spark, d):
    """The quick variant: case alone is folded."""
    return D.word_error_rate(part_pairs(spark, d), normal=False).select("id", "wer")


@query(
    "x20_k4_evaluation_csv",
    f"""WITH {PART_PAIRS} SELECT 'rec' || id AS recording, CASE WHEN size % 7 = 0 THEN 1.0 ELSE round_even(w, 4) END AS wer, CASE WHEN size % 7 = 0 THEN 0.0 ELSE round_even(greatest(0, (1 - w) * 100), 2) END AS accuracy_pct,
CASE WHEN size % 7 = 0 THEN 'ERROR' WHEN (1 - w) * 100 >= 90 THEN 'PASS' ELSE 'FAIL' END AS pass_fail, CASE WHEN size % 7 = 0 THEN 'no audio' ELSE '' END AS notes, CASE WHEN size % 7 = 0 THEN 0 ELSE len(r) END::INT AS ref_words FROM we""",
)
def x20_csv(spark, d):
    """Evaluation rows, failed runs among them, written as CSV with a header and read back."""
    return evaluated(spark, d).select("recording", "wer", "accuracy_pct", "pass_fail", F.coalesce("notes", F.lit("")).alias("notes"), "ref_words")


@query(
    "x20_a11_evaluation_rollup",
    f"""WITH {PART_PAIRS}, v AS (SELECT CASE WHEN size % 7 = 0 THEN 'ERROR' WHEN (1 - w) * 100 >= 90 THEN 'PASS' ELSE 'FAIL' END AS pass_fail, CASE WHEN size % 7 = 0 THEN 0.0 ELSE round_even(greatest(0, (1 - w) * 100), 2) END AS accuracy FROM we)
SELECT count(*) AS n, count(*) FILTER (pass_fail = 'PASS') AS n_passed, round(avg(accuracy), 3) AS mean_accuracy FROM v""",
)
def x20_rollup(spark, d):
    """Runs, passed runs and mean accuracy of the evaluation's CSV, failed runs counted in."""
    return D.rollup(evaluated(spark, d))


def evaluated(spark, d):
    failed = F.col("size") % 7 == 0
    runs = part_pairs(spark, d).select(F.concat(F.lit("rec"), F.col("id").cast("string")).alias("recording"), (F.col("price") / 10).alias("duration_sec"), "reference", F.when(~failed, F.col("hypothesis")).alias("hypothesis"), F.when(failed, "no audio").alias("error"))
    folder = store.scratch(spark, "evaluation")
    store.write_evaluation(D.evaluation(runs), folder)
    return store.read_evaluation(spark, folder)


@query("k5_s14_transcript_files", "SELECT 'conv' || conv_id || '_20240101_transcript.txt' AS name, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS body_hash FROM conversations GROUP BY conv_id")
def k5(spark, d):
    """A file for each conversation, written and read back."""
    line = F.concat("role", F.lit(": "), "text")
    x = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(x, lambda s: s["l"]), "\n").alias("body"))
    folder = store.scratch(spark, "transcripts")
    store.write_transcripts(rows.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("stem"), "body"), folder, "20240101")
    return store.read_transcripts(spark, folder).select("name", T.content_hash(F.col("text")).alias("body_hash"))


@query("s10_test_cases", "SELECT p_name || ' ' || p_partkey AS reference, lower(p_brand) || chr(10) || '\"' || p_type AS hypothesis FROM part")
def s10(spark, d):
    """Test cases as files of one JSON array each, over several lines and of a hundred cases, read back."""
    folder = store.scratch(spark, "cases")
    case = F.to_json(F.struct(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("reference"), F.concat(F.lower("p_brand"), F.lit('\n"'), "p_type").alias("hypothesis")))
    files = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("k")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(case), ",\n"), F.lit("\n]")).alias("body"))
    store.write_files(files.select(F.concat(F.lit("cases"), F.col("k").cast("string"), F.lit(".json")).alias("name"), F.encode("body", "UTF-8").alias("content")), folder)
    return store.read_cases(spark, folder)


# ---- recordings: a supplier's samples keep one loudness for 0.3 seconds, alternating in sign; every twentieth is 40 seconds long

SAMPLES = """x AS (SELECT k, i, CASE WHEN i % 2 = 1 THEN loud ELSE -loud END AS x FROM (SELECT *, (i // 4800 * 97 + k * 31) % 600 AS loud FROM
  (SELECT s_suppkey AS k, unnest(range(0, CASE WHEN s_suppkey % 20 = 0 THEN 640000 ELSE 4800 * (s_suppkey % 5 + 1) + s_suppkey % 480 END)) AS i FROM supplier)))"""


def made_recording(key: int) -> np.ndarray:
    i = np.arange(640_000 if key % 20 == 0 else 4800 * (key % 5 + 1) + key % 480)
    loud = (i // 4800 * 97 + key * 31) % 600
    return np.where(i % 2 == 1, loud, -loud)


def recording_keys(spark, d):
    """(k): the suppliers' keys and -1, dealt out: a table of some MB is one partition, whose recordings one task would write."""
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("k")))
    return keys.repartition(4 * spark.sparkContext.defaultParallelism, "k")


def wavs(spark, d):
    """(path, name, length) of a WAV file for each supplier, and one file that isn't WAV; written to and listed from a folder."""
    folder = store.scratch(spark, "recordings")
    ship(spark)

    def task(batches):
        import pyarrow as pa
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(folder)
        at.create_dir(root, recursive=True)
        for b in batches:
            for key in b.column("k").to_pylist():
                with at.open_output_stream(f"{root}/{'bad' if key < 0 else f's{key}'}.wav") as f:
                    f.write(b"no samples here" if key < 0 else media.encode_wav(made_recording(key)))
            yield pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64())})

    recording_keys(spark, d).mapInArrow(task, "k long").write.format("noop").mode("overwrite").save()
    return media.wav_files(spark, folder)


@query(
    "s7_f34_wav_decoding",
    f"WITH {SAMPLES} SELECT 's' || k || '.wav' AS name, count(*) AS n_frames, round(count(*) / 16000, 9) AS duration, sum(x * (i % 3))::BIGINT AS mark FROM x GROUP BY k UNION ALL SELECT 'bad.wav', 0, 0, 0",
)
def s7(spark, d):
    """Headers and, chunk by chunk, all samples: their sum under weights that depend on the place."""
    audio = media.recordings(wavs(spark, d))
    mark = F.aggregate(F.transform("samples", lambda x, i: x.cast("long") * ((i + F.col("first")) % 3)), F.lit(0).cast("long"), lambda s, x: s + x)
    marks = media.pcm_chunks(audio).select("name", mark.alias("mark")).groupBy("name").agg(F.sum("mark").alias("mark"))
    return audio.join(marks, "name", "left").select("name", "n_frames", F.round("duration", 9).alias("duration"), F.coalesce("mark", F.lit(0).cast("long")).alias("mark"))


@query(
    "w6_frame_energy",
    f"WITH {SAMPLES}, n AS (SELECT k, count(*) // 480 AS frames FROM x GROUP BY 1), e AS (SELECT k, i // 480 AS frame, sqrt(sum(x * x) / 480) AS rms FROM x JOIN n USING (k) WHERE i // 480 < frames GROUP BY ALL) SELECT 's' || k || '.wav' AS name, frame, round(rms, 6) AS rms, rms > 200 AS speech FROM e",
)
def w6(spark, d):
    return media.frame_energies(media.recordings(wavs(spark, d))).select("name", "frame", F.round("rms", 6).alias("rms"), "speech")


@query("x8_local_diarisation")
def x8(spark, d):
    """Turns of the recordings; the voice encoder is the stand-in, so SQL has no twin (tests compare planted voices and the sequential rules)."""
    return diarisation.diarised(media.recordings(wavs(spark, d)))


LABELLED = MERGED.replace("""epoch_us(ts) // 10000 AS "start", epoch_us(ts) // 10000 + round(greatest(value, 0) * 400)::BIGINT AS "end", 'Speaker ' || (user_id % 3 + 1) AS speaker FROM events)""", """(epoch_us(ts) // 10000) / 100.0::DOUBLE AS "start", (epoch_us(ts) // 10000 + round(greatest(value, 0) * 400)::BIGINT) / 100.0::DOUBLE AS "end", 'Speaker ' || (user_id % 3 + 1) AS label FROM events),
first AS (SELECT meeting_id, label, min(turn_no) AS f FROM t0 GROUP BY ALL), named AS (SELECT meeting_id, label, 'Speaker ' || row_number() OVER (PARTITION BY meeting_id ORDER BY f) AS speaker FROM first),
t AS (SELECT t0.meeting_id, turn_no, "start", "end", speaker FROM t0 JOIN named USING (meeting_id, label))""").replace("t AS (SELECT strftime", "t0 AS (SELECT strftime", 1).replace("+ 8000", "+ 0.8::DOUBLE")


@query(
    "x22_external_turns",
    f"""WITH {LABELLED}, c2 AS (SELECT *, coalesce("end" - "start" < 0.6::DOUBLE AND lag(speaker) OVER w = lead(speaker) OVER w, false) AS cand FROM merged WINDOW w AS (PARTITION BY meeting_id ORDER BY turn_no)),
r2 AS (SELECT *, sum(CASE WHEN cand THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS run FROM c2),
a2 AS (SELECT *, cand AND row_number() OVER (PARTITION BY meeting_id, run, cand ORDER BY turn_no) % 2 = 1 AS absorbs FROM r2),
g2 AS (SELECT *, absorbs OR coalesce(lag(absorbs) OVER (PARTITION BY meeting_id ORDER BY turn_no), false) AS gone FROM a2),
k2 AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING)::BIGINT AS kept FROM g2)
SELECT meeting_id, kept AS turn_no, arg_min(speaker, k2.turn_no) AS speaker, round(arg_min("start", k2.turn_no), 2) AS "start", round(arg_max("end", k2.turn_no), 2) AS "end" FROM k2 GROUP BY meeting_id, kept""",
)
def x22(spark, d):
    """Another diariser's labels become speakers in order of appearance, then turns are merged and smoothed."""
    t = speaker_turns(spark, d).select("meeting_id", "turn_no", F.col("speaker").alias("label"), (F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end"))
    return diarisation.external_turns(t).withColumn("start", F.round("start", 2)).withColumn("end", F.round("end", 2)).select("meeting_id", "turn_no", "speaker", "start", "end")


@query(
    "a2_percentages_of_seconds",
    """WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS meeting_id, user_id % 3 + 1 AS speaker, round(greatest(value, 0) * 400)::BIGINT AS cs FROM events), s AS (SELECT meeting_id, 'Speaker ' || speaker AS speaker, sum(cs)::BIGINT AS cs FROM t GROUP BY ALL)
SELECT meeting_id, speaker, round_even(cs / 100, 1) AS time, round_even(round_even(cs / 100, 1) * 100 / (sum(cs) OVER (PARTITION BY meeting_id) / 100), 1) AS share FROM s""",
)
def a2(spark, d):
    """Shares of the time that was rounded first, on an axis of centiseconds."""
    t = events_turns(spark, d).withColumn("text", F.lit("")).withColumn("seg_no", F.col("turn_no"))
    return U.speaker_statistics(t, units=100).select("meeting_id", "speaker", F.bround("time", 1).alias("time"), "share")


# ---- indexing: a conversation is a meeting whose turns are its decisions


def conversation_meetings(spark, d):
    x = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(x, lambda s: s["text"]).alias("decisions"))
    empty = F.lit("")
    return c.select(F.col("conv_id").cast("string").alias("meeting_id"), empty.alias("transcript"), empty.alias("summary"), "decisions", F.array().cast("array<string>").alias("tasks"))


def a_third(spark, d) -> VectorTable:
    """The index before: every third chunk, stored."""
    kept = VectorTable(spark, store.scratch(spark, "vectors"), buckets=8)
    kept.upsert(store.written(models.embedded(D.chunk_meetings(conversation_meetings(spark, d)).where("chunk_index % 3 = 0"), delays=NO_WAIT), "third"))
    return kept


INDEXED = """c AS (SELECT conv_id::VARCHAR AS meeting_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index, text, sha256(text) AS h FROM conversations),
o AS (SELECT DISTINCT meeting_id, h FROM c WHERE chunk_index % 3 = 0 AND trim(text) <> ''), n AS (SELECT c.*, o.h IS NOT NULL AS known FROM c LEFT JOIN o USING (meeting_id, h) WHERE trim(text) <> '')"""


@query("x11_incremental_index", f"WITH {INDEXED} SELECT meeting_id, count(*) FILTER (NOT known) AS indexed, count(*) FILTER (known) AS skipped, count(*) FILTER (NOT known) > 0 AS processed, count(*) AS in_index FROM n GROUP BY 1")
def x11_index(spark, d):
    kept = a_third(spark, d)
    result = indexing.index_into(kept, conversation_meetings(spark, d), delays=NO_WAIT)
    stored = kept.rows().where(F.size("embedding") == 16).groupBy("meeting_id").agg(F.count("*").alias("in_index"))
    return result.join(stored, "meeting_id", "left").select("meeting_id", "indexed", "skipped", "processed", "in_index")


def refusing(texts: list[str]) -> list[list[float]]:
    """An embedder that fails on some texts."""
    if any(len(t) % 97 == 0 for t in texts):
        raise ValueError("refused")
    return models.hashed_vectors(texts)


@query("x12_index_errors", f"WITH {INDEXED} SELECT meeting_id, coalesce(bool_or(NOT known AND length(text) % 97 = 0), false) AS failed, CASE WHEN bool_or(NOT known AND length(text) % 97 = 0) THEN 0 ELSE count(*) FILTER (NOT known) END::BIGINT AS indexed FROM n GROUP BY 1")
def x12(spark, d):
    """The error of one meeting leaves the others alone."""
    result = indexing.index_into(a_third(spark, d), conversation_meetings(spark, d), refusing, batch=1000, delays=NO_WAIT)
    return result.select("meeting_id", F.coalesce(F.col("error").contains("refused"), F.lit(False)).alias("failed"), "indexed")


@query("x13_reindex", f"WITH {INDEXED}, k AS (SELECT * FROM n WHERE meeting_id = '3' OR chunk_index % 3 = 0) SELECT meeting_id, chunk_index, round(('0x' || substr(h, 1, 2))::INT / 255, 9) AS e1, (SELECT count(*)::INT FROM n WHERE meeting_id = '3' AND chunk_index % 3 = 0) AS deleted FROM k")
def x13(spark, d):
    """All vectors of meeting 3 go and are made anew; the others stay."""
    kept = a_third(spark, d)
    _, deleted = indexing.reindex_into(kept, conversation_meetings(spark, d), "3", delays=NO_WAIT)
    return kept.rows().select("meeting_id", "chunk_index", F.round(F.col("embedding")[0], 9).alias("e1"), F.lit(deleted).alias("deleted"))


@query(
    "k2_k3_vector_table",
    """SELECT 'm' || vec_id % 200 || '__summary__' || vec_id AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 'new' ELSE 'old' END AS text, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END, 6) AS e1, (SELECT count(*)::INT FROM embeddings WHERE vec_id % 200 = 3) AS deleted FROM embeddings WHERE vec_id % 200 <> 3""",
)
def k2_k3(spark, d):
    """A stored table of all vectors: upsert, upsert of every seventh again, delete of one meeting, rows of the last version."""
    meeting = F.concat(F.lit("m"), (F.col("vec_id") % 200).cast("string"))
    e = table(spark, d, "embeddings").select(
        F.concat_ws("__", meeting, F.lit("summary"), F.col("vec_id").cast("string")).alias("chunk_id"), meeting.alias("meeting_id"), F.lit("summary").alias("source_type"), F.col("vec_id").cast("int").alias("chunk_index"),
        F.lit("old").alias("text"), F.sha2(F.lit("old"), 256).alias("content_hash"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    kept = VectorTable(spark, store.scratch(spark, "vectors"), buckets=8)
    kept.upsert(e)
    kept.upsert(e.where("chunk_index % 7 = 0").withColumn("text", F.lit("new")).withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    deleted = kept.delete_meeting("m3")
    return kept.rows().select("chunk_id", "text", F.round(F.col("embedding")[0], 6).alias("e1"), F.lit(deleted).alias("deleted"))


# ---- models


@query("x18_batch_embeddings", "SELECT doc_id, CASE WHEN lang = 'fr' OR trim(text) = '' THEN NULL ELSE round(('0x' || substr(sha256(text), 1, 2))::INT / 255, 9) END AS e1, CASE WHEN lang = 'fr' OR trim(text) = '' THEN NULL ELSE round(('0x' || substr(sha256(text), 31, 2))::INT / 255, 9) END AS e16 FROM documents")
def x18(spark, d):
    """Vectors of documents, null at those that are blank or skipped."""
    rows = table(spark, d, "documents").select("doc_id", "text", (F.col("lang") == "fr").alias("known"))
    e = models.embedded(rows, skip="known", delays=NO_WAIT)
    return e.select("doc_id", F.round(F.get("embedding", F.lit(0)), 9).alias("e1"), F.round(F.get("embedding", F.lit(15)), 9).alias("e16"))


@query(
    "x16_map_reduce_summaries",
    r"""WITH RECURSIVE u0 AS (SELECT doc_id, text, list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) WHEN contains(text, chr(10)) THEN string_split(text, chr(10))
  ELSE string_split(regexp_replace(text, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) END, lambda p: trim(p)), lambda p: p <> '') AS us, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> '')) AS nw FROM documents),
u AS (SELECT doc_id, us, nw, list_transform(us, lambda x: len(list_filter(regexp_split_to_array(x, '[\s\p{Z}]+'), lambda w: w <> ''))) AS ns FROM u0),
f AS (SELECT doc_id, 1 AS i, ns[1] AS n, 1 AS chunk FROM u WHERE len(us) > 0 AND floor(nw * 1.3) > 200
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN floor((n + ns[i + 1]) * 1.3) <= 200 THEN n + ns[i + 1] ELSE ns[i + 1] END, CASE WHEN floor((n + ns[i + 1]) * 1.3) <= 200 THEN chunk ELSE chunk + 1 END FROM f JOIN u USING (doc_id) WHERE i < len(ns)),
c AS (SELECT doc_id, chunk, array_to_string(u.us[min(i):max(i)], chr(10) || chr(10)) AS t FROM f JOIN u USING (doc_id) GROUP BY doc_id, chunk, u.us),
s AS (SELECT doc_id, string_agg('[Section ' || chunk || ']:' || chr(10) || left(sha256('Summarise this part of a meeting:' || chr(10) || t), 12), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk) AS x FROM c GROUP BY 1)
SELECT doc_id, sha256(left(sha256('Merge these summaries:' || chr(10) || x), 12)) AS working FROM s UNION ALL SELECT doc_id, sha256(text) FROM u0 WHERE floor(nw * 1.3) <= 200""",
)
def x16(spark, d):
    """Long texts as the merged summaries of their chunks, with a stand-in for the model."""
    return models.condensed(docs(spark, d), short_hash, most_tokens=200, delays=NO_WAIT).select("doc_id", T.content_hash(F.col("working")).alias("working"))


def record_writer(prompt: str) -> str:
    """Stand-in that writes records: of five orders one is fenced, one valid at the second try, one at the third, one never."""
    key = int(re.search(r"order (\d+)", prompt)[1])
    tries = (re.search(r"\{order \d+((?: repaired)*)", prompt) or [""] * 2)[1].count("repaired")
    good = json.dumps({"summary": f"order {key}", "action_items": []})
    if key % 5 == 1:
        return f"```json\n{good}\n```"
    needed = {2: 1, 3: 2, 4: 9}.get(key % 5, 0)
    return good if tries >= needed else f"{{order {key}{' repaired' * (tries + 1)}"


@query(
    "x17_extraction",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 4 THEN NULL ELSE 'order ' || o_orderkey END AS summary,
CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 5 = 2 THEN 2 WHEN o_orderkey % 5 >= 3 THEN 3 ELSE 1 END AS calls, CASE WHEN o_orderkey % 11 = 0 THEN 'refused' WHEN o_orderkey % 5 = 4 THEN 'failed' ELSE 'ok' END AS outcome FROM orders""",
)
def x17(spark, d):
    """Records of all orders: repairs of bad JSON, inputs that are refused, failures that stay with their row."""
    key = F.col("o_orderkey").cast("string")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 11 == 0, "short").otherwise(F.concat(F.lit("order "), key, F.lit(" was placed today"))).alias("text"))
    e = models.extracted(o, record_writer, delays=NO_WAIT)
    outcome = F.when(F.col("error").isNull(), "ok").when(F.col("error").contains("too short"), "refused").when(F.col("error").contains("after 2 repairs"), "failed")
    return e.select("doc_id", F.get_json_object("record", "$.summary").alias("summary"), "calls", outcome.alias("outcome"))


@query(
    "x15_answer",
    f"""WITH {vector.FOUND}, r AS (SELECT *, row_number() OVER (ORDER BY greatest(0, least(1, sim)) DESC, 1 - sim, vec_id) AS k FROM found),
c AS (SELECT string_agg('[Excerpt ' || k || ' | Meeting: ' || meeting_id || ' | Type: ' || source_type || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS x, list(meeting_id ORDER BY k) AS ms FROM r)
SELECT left(sha256('Context:' || chr(10) || x || chr(10) || 'Question: why?'), 12) AS answer, (SELECT string_agg(m::VARCHAR, ',' ORDER BY p) FROM (SELECT m, min(p) AS p FROM (SELECT unnest(ms) AS m, generate_subscripts(ms, 1) AS p) GROUP BY m)) AS meeting_ids FROM c
UNION ALL SELECT '{S.NOTHING_FOUND}', ''""",
)
def x15_answer(spark, d):
    """An answer with its sources, and one about nothing, for which no model is asked."""
    index, q = vector.as_index(spark, d).withColumn("meeting_id", F.col("meeting_id").cast("string")), vector.query_vector(spark, d)
    found = S.search(index, q, 40, F.col("source_type") == "type1")
    said = [S.answer(f, "why?", short_hash, "Context:\n{context}\nQuestion: {question}") for f in (found, found.where("false"))]
    return said[0].unionByName(said[1]).select("answer", F.array_join("meeting_ids", ",").alias("meeting_ids"))


# ---- records, roles, topics


@query(
    "f26_record_faults",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'LLM response is empty.' WHEN list_aggregate(list_filter(fs, lambda f: f <> ''), 'count') = 0 THEN 'ok'
  ELSE 'Schema validation failed with the following error(s):' || chr(10) || array_to_string(list_filter(fs, lambda f: f <> ''), chr(10)) END AS message
FROM (SELECT o_orderkey, [CASE WHEN o_orderkey % 7 = 0 THEN 'Missing required field ''summary''.' ELSE '' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Field ''action_items -> 0 -> priority'': Expected one of ''High'', ''Medium'' or ''Low'', but received ''' || o_orderpriority || '''.' ELSE '' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Extra forbidden field ''owner'' is present and not allowed.' ELSE '' END] AS fs FROM orders)""",
)
def f26_faults(spark, d):
    """A message for every fault of a record, in the order of the fields."""
    k = F.col("o_orderkey")
    item = F.concat(F.lit('{"task":"t","assignee":"a","priority":"'), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("High"), F.lit('"}'))
    raw = F.concat(F.lit("{"), F.when(k % 7 == 0, "").otherwise('"summary":"s",'), F.when(k % 5 == 0, '"owner":1,').otherwise(""), F.lit('"action_items":['), item, F.lit("]}"))
    o = table(spark, d, "orders").select(k.alias("id"), F.when(k % 13 == 0, " ").otherwise(raw).alias("raw"))
    return o.select("id", F.coalesce(records.fault_message(F.col("raw")), F.lit("ok")).alias("message"))


@query("f29_spoken_by", "SELECT conv_id, role, lower(string_agg(t, ' ' ORDER BY turn)) AS spoken FROM (SELECT conv_id, role, turn, replace(trim(text), chr(10), ' ') AS t FROM conversations) WHERE t <> '' GROUP BY 1, 2")
def f29(spark, d):
    """Each role's words out of the rendered transcript."""
    c = table(spark, d, "conversations").withColumn("t", F.replace(F.trim("text"), F.lit("\n"), F.lit(" "))).where("t <> ''")
    x = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "t").alias("l"))))
    t = c.groupBy("conv_id").agg(F.array_join(F.transform(x, lambda s: s["l"]), "\n").alias("body"), F.sort_array(F.collect_set("role")).alias("roles"))
    return t.select("conv_id", "body", F.explode("roles").alias("role")).select("conv_id", "role", records.spoken_by(F.col("body"), F.col("role")).alias("spoken"))


@query("f35_created_at", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS created_at FROM orders")
def f35(spark, d):
    at = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.iso_or_blank(at).alias("created_at"))


#: RE2's word boundary knows ASCII letters alone; other letters become one of these before a pattern with boundaries is matched.
ASCII = r"regexp_replace(sentence, '[^\x00-\x7F\p{P}\p{S}\p{Z}]', 'q', 'g')"
GROUPS = (
    TOPIC_SQL.replace("FROM sents)", rf"FROM sents WHERE len(list_filter(regexp_split_to_array(sentence, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '')) >= 4 AND NOT regexp_matches(lower(trim({ASCII})), '{T.SMALL_TALK.replace(chr(39), chr(39) * 2)}') AND lower(trim(sentence)) NOT IN ({', '.join(repr(p) for p in T.PLEASANTRIES)}))", 1)
    + f""", p AS (SELECT doc_id, topic, {CLEAN.format('sentence')} AS point, min(pos) AS pos FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY pos) AS rank FROM p QUALIFY rank <= 3),
g AS (SELECT doc_id, topic, min(pos) AS pos FROM r GROUP BY ALL), n AS (SELECT doc_id, count(topic) AS n FROM g GROUP BY 1),
o AS (SELECT g.doc_id, g.topic, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.topic IS NULL, g.pos) - 1 AS place FROM g JOIN n USING (doc_id) WHERE g.topic IS NOT NULL OR n.n < 2)"""
)


@query("x19_f11_topic_groups", GROUPS + " SELECT o.doc_id, o.place::INT AS place, coalesce(o.topic, 'General Discussion & Collaboration') AS topic, (r.rank - 1)::INT AS rank, r.point FROM o JOIN r ON r.doc_id = o.doc_id AND r.topic IS NOT DISTINCT FROM o.topic")
def x19_groups(spark, d):
    """The summary's topic groups, with the group of what has no topic where fewer than two topics matched."""
    return D.grouped_points(docs(spark, d), TOPICS)


EVERY_KEY = [w for ws in D.MEETING_TOPICS.values() for w in ws]
KEYS = "[" + ", ".join(f"'{w}'" for w in EVERY_KEY) + "]"
HITS = [f"len(list_intersect(ws, [{', '.join(repr(w) for w in ws)}]))" for ws in D.MEETING_TOPICS.values()]


@query(
    "f10_meeting_topics",
    f"WITH s AS (SELECT o_orderkey AS id, {KEYS} AS k FROM orders), t AS (SELECT id, 'We spoke about ' || k[id % {len(EVERY_KEY)} + 1] || ', ' || k[id * 7 % {len(EVERY_KEY)} + 1] || ' and ' || k[id * 11 % {len(EVERY_KEY)} + 1] || CASE WHEN id % 9 = 0 THEN 'x' ELSE '' END AS sentence FROM s), "
    + "w AS (SELECT id, list_distinct(regexp_extract_all(lower(sentence), '[a-z]+')) AS ws FROM t), h AS (SELECT id, "
    + ", ".join(f"{h} AS h{i}" for i, h in enumerate(HITS))
    + " FROM w) SELECT id, CASE WHEN greatest(h0, h1, h2, h3, h4, h5) = 0 THEN NULL "
    + " ".join(f"WHEN h{i} = greatest(h0, h1, h2, h3, h4, h5) THEN '{t}'" for i, t in enumerate(D.MEETING_TOPICS))
    + " END AS topic FROM h",
)
def f10_topics(spark, d):
    """The six topics of meetings, on a sentence of three keywords for each order."""
    keys, n, k = F.array(*[F.lit(w) for w in EVERY_KEY]), len(EVERY_KEY), F.col("o_orderkey")
    at = lambda m: F.get(keys, (k * m % n).cast("int"))
    s = F.concat(F.lit("We spoke about "), at(1), F.lit(", "), at(7), F.lit(" and "), at(11), F.when(k % 9 == 0, "x").otherwise(""))
    return table(spark, d, "orders").select(k.alias("id"), D.topic_of(s, D.MEETING_TOPICS).alias("topic"))


PATTERN = {name: p.replace("'", "''") for name, p in (("talk", T.SMALL_TALK), ("action", T.ACTION), ("deadline", T.DEADLINE))}
FOUR = "len(list_filter(regexp_split_to_array({0}, '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')) >= 4"
TALK = f"(regexp_matches(lower(trim({ASCII})), '{PATTERN['talk']}') OR lower(trim(sentence)) IN ({', '.join(repr(p) for p in T.PLEASANTRIES)}))"
#: Orders as sentences, beside those of the documents, so that the predicates have something to find.
ALL_SENTENCES = f"""{SENTS}, s AS (SELECT doc_id, pos, sentence FROM sents UNION ALL SELECT -o_orderkey - 1, 0, CASE o_orderkey % 6 WHEN 0 THEN 'Good morning, how are you?' WHEN 1 THEN 'We will send order ' || o_orderkey || ' by Friday' WHEN 2 THEN 'Thanks'
  WHEN 3 THEN 'The review is due on day ' || o_orderkey WHEN 4 THEN 'Order ' || o_orderkey || ' went well for all of us' ELSE 'confirm it' END FROM orders)"""


@query(
    "p5_p8_predicates_of_all_sentences",
    f"WITH {ALL_SENTENCES} SELECT doc_id, pos, {TALK} AS small_talk, {FOUR.format('sentence')} AND NOT {TALK} AS substantive, regexp_matches({ASCII}, '{PATTERN['action']}', 'i') AND {FOUR.format('sentence')} AS action, regexp_matches({ASCII}, '{PATTERN['deadline']}', 'i') AS deadline FROM s",
)
def p5_all(spark, d):
    k = F.col("o_orderkey")
    said = F.when(k % 6 == 0, "Good morning, how are you?").when(k % 6 == 1, F.concat(F.lit("We will send order "), k.cast("string"), F.lit(" by Friday"))).when(k % 6 == 2, "Thanks")
    said = said.when(k % 6 == 3, F.concat(F.lit("The review is due on day "), k.cast("string"))).when(k % 6 == 4, F.concat(F.lit("Order "), k.cast("string"), F.lit(" went well for all of us"))).otherwise("confirm it")
    rows = D.sentence_rows(docs(spark, d), substantive=False).unionByName(table(spark, d, "orders").select((-k - 1).alias("doc_id"), F.lit(0).alias("pos"), said.alias("sentence")))
    s = F.col("sentence")
    return rows.select("doc_id", "pos", T.is_small_talk(s).alias("small_talk"), T.is_substantive(s).alias("substantive"), T.is_action(s).alias("action"), T.has_deadline(s).alias("deadline"))


# ---- endpoints


@query(
    "x21_meeting_list",
    "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_items, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey DESC LIMIT 50 OFFSET 10",
)
def x21_list(spark, d):
    """A page of meetings, newest first, with their counts and the total."""
    S.check_page(50, 10)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    page = c.orderBy(F.desc("id")).offset(10).limit(50)
    kids = table(spark, d, "orders").join(F.broadcast(page.select(F.col("id").alias("o_custkey"))), "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_items"))
    total = c.agg(F.count("*").alias("total"))
    return page.join(kids, "id", "left").join(F.broadcast(total)).select("id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "total")


@query(
    "x21_meeting_detail",
    "SELECT c_custkey AS id, c_name AS name, (SELECT coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') FROM orders WHERE o_custkey = c_custkey) AS items FROM customer WHERE c_custkey = 7",
)
def x21_detail(spark, d):
    """One meeting with its items; no row if there is none."""
    items = table(spark, d, "orders").where("o_custkey = 7").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("items"))
    return table(spark, d, "customer").where("c_custkey = 7").join(F.broadcast(items)).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "items")


@query("x21_health", "SELECT 'ok' AS status, (SELECT count(*) FROM orders) AS meetings, (SELECT count(*) FROM embeddings) AS vectors")
def x21_health(spark, d):
    m = table(spark, d, "orders").agg(F.count("*").alias("meetings"))
    return m.join(F.broadcast(table(spark, d, "embeddings").agg(F.count("*").alias("vectors")))).select(F.lit("ok").alias("status"), "meetings", "vectors")


@query("x24_search_latency", "SELECT r + 1 AS request, 'search' AS name, (SELECT least(5, count(*)) FROM embeddings) AS n_results, true AS in_order, 20 AS n FROM range(20) t(r)")
def x24(spark, d):
    """Twenty requests with five questions; their times are in a table, of which least, mean and largest come."""
    index, kept = vector.as_index(spark, d), requests.Latencies(spark, store.scratch(spark, "latencies"))
    asked = [list(r["embedding"]) for r in index.orderBy("vec_id").limit(5).select("embedding").collect()]
    for k in range(20):
        kept.run("search", S.search(index, asked[k % len(asked)], 5))
    times = kept.table()
    stats = requests.latency_stats(times).select("name", F.col("n").cast("int").alias("n"), ((F.col("low") > 0) & (F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high"))).alias("in_order"))
    return times.join(F.broadcast(stats), "name").select("request", "name", F.col("rows").alias("n_results"), "in_order", "n")


@query(
    "k8_page_envelope",
    """WITH p AS (SELECT c_custkey AS id, coalesce(n, 0) AS action_items_count, c_mktsegment AS summary FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY c_custkey DESC LIMIT 30 OFFSET 7)
SELECT to_json({'meetings': (SELECT list({'id': id, 'summary': summary, 'action_items_count': action_items_count} ORDER BY id DESC) FROM p), 'total': (SELECT count(*) FROM customer), 'limit': 30, 'offset': 7})::VARCHAR AS body""",
)
def k8_page(spark, d):
    """A page of meetings with its envelope."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("summary"), F.coalesce("n", F.lit(0)).cast("long").alias("action_items_count"))
    return requests.page(rows, [F.desc("id")], 30, 7)


@query(
    "k7_item_lines",
    """WITH i AS (SELECT o_orderkey AS id, 'order ' || o_orderkey AS task, 'Customer ' || o_custkey AS assignee, CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline, o_orderpriority AS priority, o_orderstatus AS status FROM orders),
w AS (SELECT greatest(4, max(length(task)))::INT AS t, greatest(8, max(length(assignee)))::INT AS a, greatest(8, max(length(deadline)))::INT AS d, greatest(8, max(length(priority)))::INT AS p, greatest(6, max(length(status)))::INT AS s FROM i)
SELECT 2 AS line_no, id, rpad(task, t, ' ') || ' | ' || rpad(assignee, a, ' ') || ' | ' || rpad(deadline, d, ' ') || ' | ' || rpad(priority, p, ' ') || ' | ' || rpad(status, s, ' ') AS line FROM i, w
UNION ALL SELECT 0, NULL, rpad('Task', t, ' ') || ' | ' || rpad('Assignee', a, ' ') || ' | ' || rpad('Deadline', d, ' ') || ' | ' || rpad('Priority', p, ' ') || ' | ' || rpad('Status', s, ' ') FROM w
UNION ALL SELECT 1, NULL, repeat('-', t) || '-+-' || repeat('-', a) || '-+-' || repeat('-', d) || '-+-' || repeat('-', p) || '-+-' || repeat('-', s) FROM w""",
)
def k7_lines(spark, d):
    """The item table: a header, a rule and a line for each item, all columns padded."""
    items = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("task"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("assignee"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("deadline"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )
    return requests.text_table(items, "id", {"task": "Task", "assignee": "Assignee", "deadline": "Deadline", "priority": "Priority", "status": "Status"})


# ---- files as they are listed

SUFFIXES = [".mp4", ".WAV", "", ".exe", ".mp3", ".mkv", ".mov", ".ogg"]
PROBES = ['{"streams":[{"codec_type":"video"},{"codec_type":"audio"}]}', '{"streams":[{"codec_type":"audio"}]}', '{"streams":[]}', '{"streams":[{"codec_type":"video"}]}', "not json"]
SIZES = [10, 1024, 4096, 2048, 1023, 2048]


def picked_sql(key: str, values: list) -> str:
    return f"(list_value({', '.join(repr(v) for v in values)}))[{key} % {len(values)} + 1]"


def picked(key, values: list):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


PROBLEM = """CASE WHEN suffix = '' THEN 'no suffix' WHEN lower(suffix) NOT IN ('.mp4', '.mkv', '.mov', '.avi', '.webm', '.mp3', '.wav', '.m4a', '.ogg', '.flac') THEN 'unsupported suffix' WHEN size < 1024 THEN 'too small' WHEN size > 524288000 THEN 'too large'
WHEN probe NOT LIKE '%codec%' THEN 'no streams' WHEN probe NOT LIKE '%audio%' THEN 'no audio' ELSE 'ok' END"""


@query(
    "p1_s13_media_checks",
    f"SELECT 'm' || k || suffix AS name, size, {PROBLEM} AS problem FROM (SELECT s_suppkey AS k, {picked_sql('s_suppkey', SUFFIXES)} AS suffix, {picked_sql('s_suppkey', SIZES)}::BIGINT AS size, {picked_sql('s_suppkey', PROBES)} AS probe FROM supplier)",
)
def p1_files(spark, d):
    """Files as a folder's listing has them, checked with what a probe said of each."""
    k = F.col("s_suppkey")
    made = table(spark, d, "supplier").select(F.concat(F.lit("m"), k.cast("string"), picked(k, SUFFIXES)).alias("name"), picked(k, SIZES).alias("size"), picked(k, PROBES).alias("probe"))
    folder = store.scratch(spark, "media")
    store.write_files(made.select("name", F.encode(F.expr("repeat('x', size)"), "UTF-8").alias("content")), folder)
    found = file_listing(spark, folder).select("name", F.col("length").alias("size")).join(made.select("name", "probe"), "name", "left")
    return found.select("name", "size", F.coalesce(P.file_problem(F.col("name"), F.col("size"), F.col("probe")), F.lit("ok")).alias("problem"))


@query(
    "p1_media_checks_of_orders",
    f"SELECT k AS id, {PROBLEM} AS problem FROM (SELECT o_orderkey AS k, {picked_sql('o_orderkey', SUFFIXES)} AS suffix, CASE o_orderkey % 9 WHEN 0 THEN 1023 WHEN 1 THEN 1024 WHEN 2 THEN 524288000 WHEN 3 THEN 524288001 ELSE (o_totalprice * 1500)::BIGINT END AS size, {picked_sql('o_orderkey', PROBES)} AS probe FROM orders)",
)
def p1_orders(spark, d):
    """The same checks over the metadata of as many files as there are orders, of sizes on both sides of the bounds."""
    k = F.col("o_orderkey")
    size = F.when(k % 9 == 0, 1023).when(k % 9 == 1, 1024).when(k % 9 == 2, 524288000).when(k % 9 == 3, 524288001).otherwise(F.round(F.col("o_totalprice") * 1500)).cast("long")
    o = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("f"), k.cast("string"), picked(k, SUFFIXES)).alias("name"), size.alias("size"), picked(k, PROBES).alias("probe"))
    return o.select("id", F.coalesce(P.file_problem(F.col("name"), F.col("size"), F.col("probe")), F.lit("ok")).alias("problem"))


@query(
    "s8_j11_recording_pairs",
    """WITH f AS (SELECT CASE WHEN s_suppkey % 10 = 7 THEN '.' ELSE '' END || 'r' || s_suppkey AS stem, CASE s_suppkey % 3 WHEN 0 THEN '.MP3' WHEN 1 THEN '.wav' ELSE '.mp4' END AS kind, s_suppkey % 4 <> 1 AS has FROM supplier)
SELECT stem, stem || kind AS recording, stem || '.txt' AS reference FROM f WHERE has AND kind <> '.mp4' AND stem NOT LIKE '.%'""",
)
def s8(spark, d):
    """Recordings with references of the same stem, found in a folder's listing."""
    k = F.col("s_suppkey")
    stem = F.concat(F.when(k % 10 == 7, ".").otherwise(""), F.lit("r"), k.cast("string"))
    kinds = F.array(F.when(k % 3 == 0, ".MP3").when(k % 3 == 1, ".wav").otherwise(".mp4"), F.when(k % 4 != 1, ".txt"))
    names = table(spark, d, "supplier").select(stem.alias("stem"), F.explode(F.array_compact(kinds)).alias("kind")).select(F.concat("stem", "kind").alias("name"))
    folder = store.scratch(spark, "pairs")
    store.write_files(names.withColumn("content", F.encode("name", "UTF-8")), folder)
    return recording_pairs(file_listing(spark, folder), [".wav", ".mp3"], [".txt"])
