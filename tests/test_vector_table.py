"""Stored vectors and inserts: versions, two writers at once, and a model that is asked once."""

import threading
from pathlib import Path

import pytest

from colloquy.operators import indexing, models
from colloquy.sources import commits, store
from colloquy.sources.vector_table import FIELDS, VectorTable

MEETING = "meeting_id string, transcript string, summary string, decisions array<string>, tasks array<string>"


def rows(spark, *some):
    return spark.createDataFrame([(f"{m}__summary__{i}", m, "summary", i, t, f"h{t}", [float(i), 1.0]) for m, i, t in some], FIELDS)


def texts(df):
    return {r.chunk_id: r.text for r in df.collect()}


def test_upsert_delete_and_versions(spark, tmp_path):
    kept = VectorTable(spark, f"file://{tmp_path}", buckets=4)
    assert kept.count() == 0 and texts(kept.rows("a")) == {}
    kept.upsert(rows(spark, *[(m, i, "one") for m in "abcdef" for i in range(3)]))
    before = kept.rows()
    kept.upsert(rows(spark, ("a", 0, "two"), ("a", 9, "two"), ("g", 0, "two")))
    assert len(texts(before)) == 18 and set(texts(before).values()) == {"one"}  # a version stays as it was
    now = texts(kept.rows())
    assert len(now) == 20 and now["a__summary__0"] == "two" == now["g__summary__0"] and now["a__summary__1"] == "one"
    assert kept.count("a") == 4 and {r.content_hash for r in kept.hashes("a").collect()} == {"hone", "htwo"}
    assert kept.delete_meeting("a") == 4 and kept.delete_meeting("a") == 0 and kept.delete_meeting("nobody") == 0
    assert kept.count() == 16 and kept.log.latest()[0] == 3
    kept.upsert(rows(spark).limit(0))
    assert kept.log.latest()[0] == 3  # nothing, no version
    assert VectorTable(spark, f"file://{tmp_path}", buckets=99).buckets == 4
    for m in "bcdefg":
        kept.delete_meeting(m)
    assert kept.count() == 0 and kept.rows(version=2).count() == 20
    assert kept.vacuum(keep=1) > 0 and kept.count() == 0 and not list((tmp_path / "data").iterdir())


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = VectorTable(spark, f"file://{tmp_path}", buckets=16)
    kept.upsert(rows(spark, *[(f"m{k}", 0, "one") for k in range(60)]))
    first = kept.log.latest()[1]["at"]
    kept.upsert(rows(spark, ("m7", 0, "two")))
    second = kept.log.latest()[1]["at"]
    assert len(first) == len(second) > 10 and sum(first[b] != second[b] for b in first) == 1


def test_of_rows_with_one_id_the_last_stays(spark, tmp_path):
    kept = VectorTable(spark, f"file://{tmp_path}")
    twice = rows(spark, ("a", 0, "x"), ("a", 0, "y"), (None, 1, "z"), (None, 1, "z")).withColumn("at", __import__("pyspark").sql.functions.expr("if(text = 'x', 2, 1)"))
    kept.upsert(twice)
    assert texts(kept.rows()) == {"a__summary__0": "y", "None__summary__1": "z"}
    kept.upsert(twice, order="at")
    assert texts(kept.rows("a")) == {"a__summary__0": "x"}


def test_two_writers_of_one_bucket(spark, tmp_path):
    folder = f"file://{tmp_path}"
    VectorTable(spark, folder, buckets=1).upsert(rows(spark, ("a", 0, "one")))
    faults = []

    def write(k):
        try:
            VectorTable(spark, folder).upsert(rows(spark, *[(f"w{k}", i, "one") for i in range(5)], ("a", 0, f"by {k}")))
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    kept = VectorTable(spark, folder)
    assert not faults and kept.count() == 16 and kept.log.latest()[0] == 4
    assert texts(kept.rows("a"))["a__summary__0"].startswith("by ")


def test_a_number_is_given_once(spark, tmp_path):
    log, won = commits.Log(spark, f"file://{tmp_path}"), []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if log.commit(1, {"by": k}) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.latest() == (1, {"by": won[0]}) and [p.name for p in (tmp_path / "_log").iterdir() if not p.name.startswith(".")] == ["0000000001.json"]


def test_two_inserts_of_one_id(spark, tmp_path):
    folder = f"file://{tmp_path}"
    kind = "id string, transcript string, summary string, key_points array<string>, decisions array<string>, participants array<struct<name:string,is_unknown_assignee:boolean>>, action_items array<struct<task:string,assignee:string,deadline:string,priority:string,status:string>>"
    made = lambda *ids: spark.createDataFrame([(i, "t", "s", [], [], [(f"p{i}", False)], []) for i in ids], kind)
    outcome = []

    def insert(*ids):
        try:
            store.insert_meetings(made(*ids), folder)
            outcome.append("in")
        except ValueError as e:
            outcome.append(str(e))

    threads = [threading.Thread(target=insert, args=ids) for ids in (("x", "a"), ("x", "b"), ("c",))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome) == ["duplicate meeting id x", "in", "in"]
    ids = {r.id for r in store.stored(spark, folder, "meetings").collect()}
    assert "x" in ids and "c" in ids and len(ids) == 3
    assert {r.meeting_id for r in store.stored(spark, folder, "participants").collect()} == ids
    assert len(list((tmp_path / "participants").iterdir())) == 2  # the refused insert left nothing


def test_each_new_chunk_goes_to_the_model_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def embed(batch):
        for t in batch:
            with open(asked / f"{t}.log", "a") as f:
                f.write("x")
        return models.hashed_vectors(batch)

    meetings = spark.createDataFrame([(f"m{k}", "", "", [f"d{k}x{i}" for i in range(10)], []) for k in range(10)], MEETING)
    kept = VectorTable(spark, f"file://{tmp_path}/t", buckets=4)
    result = indexing.index_into(kept, meetings, embed, delays=(0, 0))
    assert kept.count() == 100 and {(r.indexed, r.skipped) for r in result.collect()} == {(10, 0)}
    new, result = indexing.index_meetings(meetings, kept.rows().limit(0), embed, delays=(0, 0))
    assert new.count() == 100 and result.count() == 10
    assert {len(p.read_text()) for p in asked.iterdir()} == {2} and len(list(asked.iterdir())) == 100
    again = indexing.index_into(kept, meetings, embed, delays=(0, 0))
    assert {(r.indexed, r.skipped) for r in again.collect()} == {(0, 10)} and {len(p.read_text()) for p in asked.iterdir()} == {2}


def test_counts_of_a_flaky_model_equal_what_is_stored(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.write_text("")

    def embed(batch):
        with open(calls, "a") as f:
            f.write("x")
        if len(Path(calls).read_text()) % 3 == 0:  # not the same at every call
            raise ValueError("busy")
        return models.hashed_vectors(batch)

    meetings = spark.createDataFrame([(f"m{k}", "", "", [f"d{k} {i}" for i in range(k + 1)], []) for k in range(12)], MEETING).coalesce(1)
    kept = VectorTable(spark, f"file://{tmp_path}/t", buckets=4)
    result = {r.meeting_id: r for r in indexing.index_into(kept, meetings, embed, delays=(0,)).collect()}
    stored = {r.meeting_id: r.n for r in kept.rows().groupBy("meeting_id").agg(__import__("pyspark").sql.functions.count("*").alias("n")).collect()}
    assert {m: r.indexed for m, r in result.items() if r.indexed} == stored
    assert all((r.error is None) == (m in stored) for m, r in result.items())


def test_reindexing_a_stored_meeting(spark, tmp_path):
    meetings = spark.createDataFrame([(m, "", "", ["x", "y"], []) for m in "ab"], MEETING)
    kept = VectorTable(spark, f"file://{tmp_path}", buckets=2)
    indexing.index_into(kept, meetings)
    shorter = spark.createDataFrame([("a", "", "", ["z"], [])], MEETING)
    result, deleted = indexing.reindex_into(kept, shorter, "a")
    assert deleted == 2 and [r.indexed for r in result.collect()] == [1]
    assert texts(kept.rows()) == {"a__decision__0": "z", "b__decision__0": "x", "b__decision__1": "y"}
