"""Model loops, indexing, inserts, recordings and chunking against plain Python on small rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import indexing, models, records
from colloquy.operators import documents as D
from colloquy.operators import people as P
from colloquy.operators import search as S
from colloquy.sources import store

MEETING = "meeting_id string, transcript string, summary string, decisions array<string>, tasks array<string>"


def test_key_pool():
    env = {"KEYS": " a, b,,a", "KEY": "c", "KEY_1": "b", "KEY_2": "  "}
    assert models.key_pool(env, "KEYS", ["KEY", "KEY_1", "KEY_2", "KEY_3"]) == ["a", "b", "c"]
    assert models.key_pool({}, "KEYS", ["KEY"]) == []


def test_retries_wait_longer_each_time_and_then_take_the_next_key():
    waits, calls = [], []

    def failing(k):
        calls.append(k)
        if k < 2 or calls.count(2) < 2:
            raise TimeoutError("slow")
        return "done"

    assert models.with_retries([lambda k=k: failing(k) for k in (0, 1, 2)], sleep=waits.append) == "done"
    assert calls == [0, 0, 0, 1, 1, 1, 2, 2] and waits == [1.0, 2.0, 1.0, 2.0, 1.0]
    with pytest.raises(models.ModelError, match="slow"):
        models.with_retries([lambda: failing(0)], sleep=lambda _: None)
    with pytest.raises(models.ModelError):
        models.with_retries([lambda: ""], sleep=lambda _: None)


def test_embeddings_keep_their_places_and_batches_their_size(spark, tmp_path):
    def embed(texts):
        if len(texts) > 3:
            raise ValueError("too many")
        return models.hashed_vectors(texts)

    rows = [(i, [f"t{i}", "", " ", None, "skip me"][i % 5], i % 5 == 4) for i in range(40)]
    out = models.embedded(spark.createDataFrame(rows, "id int, text string, known boolean"), embed, skip="known", batch=3, delays=(0, 0)).collect()
    assert [(r.id, r.embedding) for r in sorted(out)] == [(i, [x for x in models.hashed_vectors([t])[0]] if i % 5 == 0 else None) for i, t, _ in rows]


def test_extraction_refuses_repairs_and_gives_up(spark):
    def generate(prompt):
        if "alpha" in prompt:
            return '{"summary": "fine"}'
        if "beta" in prompt:
            return "```json\n{\"summary\": \"beta\"}\n```" if "not valid" in prompt else "beta, not JSON"
        if "gamma" in prompt:
            return '{"summary": "gamma", "extra": 1}'
        raise TimeoutError("slow")

    rows = [(0, "alpha one two"), (1, "beta one two"), (2, "gamma one two"), (3, "delta one two"), (4, None), (5, "  "), (6, "two words"), (7, "w " * 120_000)]
    got = {r.doc_id: r for r in models.extracted(spark.createDataFrame(rows, "doc_id int, text string"), generate, delays=(0, 0)).collect()}
    assert '"summary": "fine"' in got[0].record and got[0].calls == 1 and got[1].calls == 2 and got[1].error is None
    assert got[2].calls == 3 and "Extra forbidden field 'extra'" in got[2].error and "slow" in got[3].error
    assert [got[i].calls for i in (4, 5, 6, 7)] == [0] * 4
    assert "empty" in got[4].error and "empty" in got[5].error and "too short (2 words)" in got[6].error and "156000 estimated tokens" in got[7].error


def test_record_faults():
    assert records.checked('{"summary":"s","action_items":[{"task":"t","assignee":"a"}]}')[0]["action_items"] == [{"deadline": None, "priority": "Medium", "status": "Not Started", "task": "t", "assignee": "a"}]
    assert "received 'Critical'" in records.checked('{"summary":"s","action_items":[{"task":"t","assignee":"a","priority":"Critical"}]}')[1]
    assert "line 1, column 1" in records.checked("nothing")[1] and "received list" in records.checked("[]")[1] and records.checked(None)[1] == "LLM response is empty."


def test_index_errors_and_reindexing(spark):
    rows = [("a", "", "a summary here", ["d one", " ", "d two"], ["task"]), ("b", "", "", ["bad"], []), ("c", None, None, None, None), ("d", "", "", ["x"], ["x"])]
    meetings = spark.createDataFrame(rows, MEETING)

    def embed(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return models.hashed_vectors(texts)

    empty = spark.createDataFrame([], indexing.INDEX)
    index, result = indexing.index_meetings(meetings, empty, embed, delays=(0, 0))
    index = spark.createDataFrame(index.collect(), indexing.INDEX)
    got = {r.meeting_id: (r.indexed, r.skipped, r.processed, r.error is not None) for r in result.collect()}
    assert got == {"a": (4, 0, True, False), "b": (0, 0, False, True), "d": (2, 0, True, False)}
    assert {(r.source_type, r.chunk_index) for r in index.where("meeting_id = 'a'").collect()} == {("summary", 0), ("decision", 0), ("decision", 2), ("action_item", 0)}
    again = {r.meeting_id: (r.indexed, r.skipped) for r in indexing.index_meetings(meetings, index, embed, delays=(0, 0))[1].collect()}
    assert again == {"a": (0, 4), "b": (0, 0), "d": (0, 2)}
    new, result, deleted = indexing.reindex_meeting(meetings, index, "a", embed, delays=(0, 0))
    assert deleted == 4 and new.count() == 6 and [r.indexed for r in result.collect()] == [4]


def test_insert_meetings(spark, tmp_path):
    folder = f"file://{tmp_path}"
    kind = "id string, transcript string, summary string, key_points array<string>, decisions array<string>, participants array<struct<name:string,is_unknown_assignee:boolean>>, action_items array<struct<task:string,assignee:string,deadline:string,priority:string,status:string>>"
    row = lambda i: (i, "t", "s", ["k"], [], [("Ann", False)], [("do", "Ann", None, "High", "Not Started")])
    df = lambda *ids: spark.createDataFrame([row(i) for i in ids], kind)
    assert store.stored(spark, folder, "meetings") is None
    made = {r.id for r in store.insert_meetings(df("a", None), folder).collect()}
    assert "a" in made and len(made) == 2
    for ids in (("b", "a"), ("c", "c")):
        with pytest.raises(ValueError, match="duplicate"):
            store.insert_meetings(df(*ids), folder)
    assert {r.id for r in store.stored(spark, folder, "meetings").collect()} == made
    assert store.stored(spark, folder, "participants").count() == 2 == store.stored(spark, folder, "action_items").count()
    assert not list((tmp_path / "_aside").iterdir()) and len(list((tmp_path / "participants").iterdir())) == 1


def plain_chunks(text, most=300, overlap=50):
    est = lambda t: max(len(t) // 4, len(t.split()))
    text = (text or "").strip()
    if not text:
        return []
    if est(text) <= most:
        return [text]
    units = []
    for turn in re.split(r"(?=\n[A-Za-z0-9 _\-]+:|\n\[[^\]]+\])", text):
        turn = turn.strip()
        if not turn:
            continue
        if est(turn) <= 150:
            units.append(turn)
            continue
        for para in filter(None, (p.strip() for p in re.split(r"\n{2,}", turn))):
            units += [para] if est(para) <= 100 else [s.strip() for s in re.split(r"(?<=[.!?])\s+", para) if s.strip()]
    done, parts = [], []
    for u in units:
        if est("\n\n".join([*parts, u])) <= most or not parts:
            parts.append(u)
            continue
        done.append("\n\n".join(parts))
        keep, size = [], 0
        for p in reversed(parts):
            if size + est(p) > overlap:
                break
            keep.insert(0, p)
            size += est(p)
        parts = [*keep, u]
    return done + ["\n\n".join(parts)] if parts else done


def test_embedding_chunks_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "  ", "short one."]
    for k in range(60):
        lines = []
        for _ in range(rng.integers(1, 40)):
            words = " ".join(f"{'w' * rng.integers(1, 9)}{'.' if rng.random() < 0.15 else ''}" for _ in range(rng.integers(1, 60)))
            lines.append((f"Ann {k}: " if rng.random() < 0.4 else "[00:01] " if rng.random() < 0.1 else "") + words + ("\n" if rng.random() < 0.2 else ""))
        texts.append("\n".join(lines))
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", D.embedding_chunks(F.col("text")).alias("c")).collect()
    for r in got:
        assert r.c == plain_chunks(texts[r.id]), r.id
    assert max(len(r.c) for r in got) > 5


def test_word_edits_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def script(a, b):
        """One pair, cell by cell, with the rule of ties."""
        cells = {(0, 0): (0, 0, 0, 0)}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = []
                if i and j:
                    c, s, d, n = cells[i - 1, j - 1]
                    ways.append((c, s, d, n) if a[i - 1] == b[j - 1] else (c + 1, s + 1, d, n))
                if i:
                    c, s, d, n = cells[i - 1, j]
                    ways.append((c + 1, s, d + 1, n))
                if j:
                    c, s, d, n = cells[i, j - 1]
                    ways.append((c + 1, s, d, n + 1))
                if ways:
                    cells[i, j] = min(ways, key=lambda w: w[0])  # the first of equals
        return cells[len(a), len(b)][1:]

    pairs = [tuple(["abcd"[i] for i in rng.integers(0, 4, rng.integers(0, 12))] for _ in "ab") for _ in range(300)]
    pairs += [([], []), (list("abc"), list("axc")), ([], list("ab")), (list("ab"), []), (["x"] * 300, ["y"] * 5), (["é", "日本"] * 40, ["日本"] * 60)]
    lists = [pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1)]
    for cells in (1, 50, 1 << 19):
        monkeypatch.setattr(D, "EDIT_CELLS", cells)
        got = D.edit_counts(*lists)
        for (a, b), found in zip(pairs, got.tolist(), strict=True):
            assert tuple(found) == script(a, b) and sum(found) == distance(a, b)
    assert D.edit_counts(lists[0].slice(3, 0), lists[1].slice(3, 0)).shape == (0, 3)
    assert D.edit_counts(lists[0].slice(5, 9), lists[1].slice(5, 9)).tolist() == got[5:14].tolist()


def test_speakers_words_out_of_a_transcript(spark):
    t = "Ann: I am here\nDr. Bob Jones: The budget\nis fine\nAnn: See you (soon)\nspeaker 1: one\nSpeaker 2: two"
    rows = spark.createDataFrame([(t, n) for n in ("Ann", "Dr. Bob Jones", "Zed", "Speaker 1", "a.c")], "t string, n string")
    got = {r.n: r.s for r in rows.select("n", records.spoken_by(F.col("t"), F.col("n")).alias("s")).collect()}
    # a label of two words doesn't end the passage before it
    assert got == {"Ann": "i am here\ndr. bob jones: the budget\nis fine see you (soon)\nspeaker 1: one\nspeaker 2: two", "Dr. Bob Jones": "the budget\nis fine", "Zed": "", "Speaker 1": "one\nspeaker 2: two", "a.c": ""}


def test_requests_and_tokens():
    for bad in (("", 5), (" ", 5), ("q", 0), ("q", 51)):
        with pytest.raises(ValueError):
            S.check_request(*bad)
    with pytest.raises(ValueError):
        S.check_request("q", 21, most=20)
    with pytest.raises(ValueError):
        S.check_request("q", 5, source_type="mail")
    S.check_request("q", 50, source_type="decision")
    for bad in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError):
            S.check_page(*bad)
    S.check_page(500, 0)
    assert S.authorised("t", "t") and not S.authorised("t", "u") and not S.authorised(None, "t") and not S.authorised("", "")
    assert P.VIDEO | P.AUDIO >= {".mp4", ".flac"} and len(P.VIDEO | P.AUDIO) == 10


def test_shares_without_speech(spark):
    from colloquy.operators.turns import speaker_statistics

    t = spark.createDataFrame([("m", 0, "A", 5.0, 5.0, "hi"), ("n", 0, "A", 0.0, 1.26, "x"), ("n", 1, "B", 1.26, 4.0, "y z")], "meeting_id string, seg_no int, speaker string, start double, end double, text string")
    got = {(r.meeting_id, r.speaker): (r.share, r.n_words) for r in speaker_statistics(t, duration=F.lit(60.0)).collect()}
    assert got == {("m", "A"): (0.0, 1), ("n", "A"): (32.5, 1), ("n", "B"): (67.5, 2)}


def test_meeting_topics(spark):
    lines = ["The budget and the cost of it", "We test the database code", "Nothing of the kind"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(lines)), "i int, s string").orderBy("i").select(D.topic_of(F.col("s"), D.MEETING_TOPICS).alias("t")).collect()]
    assert got == ["Budget & Financials", "Technical Architecture & Development", None]
    out = D.summary(spark.createDataFrame([(1, "The budget and the cost of it. Nothing of the kind today."), (2, " ")], "doc_id int, text string")).collect()
    by = {r.doc_id: [g.topic for g in r.topic_groups] for r in out}
    assert by == {1: ["Budget & Financials", "General Discussion & Collaboration"], 2: []}
