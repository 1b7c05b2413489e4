"""The summary composite on short texts."""

import threading

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import documents as D
from colloquy.plans import registry

TOPICS = {"Money": ["budget", "cost"], "People": ["team", "hiring"]}


def test_composite_leaves_small_talk_out(spark):
    rows = [
        (1, "Hello everyone, how are you doing today? We will prepare the budget report by Friday. The hiring plan looks good now. We will prepare the budget report by Friday. Nothing else was said here. ok"),
        (2, "ok. Thanks"),
        (3, "Everything went very well yesterday\nThe cost was quite high"),
        (4, None),
    ]
    got = {r.doc_id: r for r in D.summary(spark.createDataFrame(rows, "doc_id long, text string"), TOPICS).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert [(g.topic, g.points) for g in r.topic_groups] == [("Money", ["We will prepare the budget report by Friday."]), ("People", ["The hiring plan looks good now."])]
    assert r.action_items == ["We will prepare the budget report by Friday."] and r.deadlines == r.action_items
    assert (r.n_words, r.n_sentences, r.read_min, r.talk_min) == (35, 4, 1, 1) and "Hello" not in r.overview
    assert [(g.topic, g.points) for g in got[3].topic_groups] == [("Money", ["The cost was quite high."]), ("General Discussion & Collaboration", ["Everything went very well yesterday."])]
    for i in (2, 4):
        assert got[i].overview is None and got[i].topic_groups == got[i].action_items == got[i].deadlines == [] and (got[i].n_words, got[i].n_sentences, got[i].read_min) == (0, 0, 0)


def test_a_sentences_words_are_split_once(spark):
    docs = spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")
    plan = D.summary(docs, TOPICS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1  # for scores and topics


def test_small_talk_is_looked_for_at_one_word_boundary():
    assert T.SMALL_TALK.count(r"\b") == T.ACTION.count(r"\b") == 2  # not one for each phrase


def test_sentences_and_their_least_words(spark):
    texts = ["  One two. \r\n three \n four! five six \n \n. x ", " \n ", "", None, "a b c", " a b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s, r.four) for r in df.select("i", T.sentences(F.col("t")).alias("s"), T.has_words(F.col("t"), 4).alias("four")).collect()}
    assert got[0] == (["One two.", "three", "four!", "five six", ".", "x"], True)
    assert [got[i] for i in range(1, 6)] == [([], False), ([], False), (None, None), (["a b c"], False), (["a b c d"], True)]
    assert all(got[i][1] == r.n for i, r in enumerate(df.orderBy("i").select((T.n_words(F.col("t")) >= 4).alias("n")).collect()) if texts[i] is not None)


def test_topic_groups_clean_a_sentence_at_one_place_and_score_none(spark):
    plan = registry.QUERIES["x19_f11_topic_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and "MapInArrow" not in plan


@pytest.mark.parametrize("form", ["rows", "summary"])
def test_topic_groups_of_a_long_text(spark, form):
    """Linear in the sentences: a square of 6,000 would take minutes."""
    said = ["the team has number {}.", "number {} is a cost.", "number {} has no topic here."]
    docs = spark.createDataFrame([(1, " ".join(said[i % 3].format(i) for i in range(6000))), (2, None), (3, "number one has no topic. the team has one cost")], "doc_id long, text string")
    if form == "rows":
        df = D.grouped_points(docs, TOPICS)
    else:
        g = D.summary(docs, TOPICS).select("doc_id", F.posexplode("topic_groups").alias("place", "g"))
        df = g.select("doc_id", "place", "g.topic", F.posexplode("g.points").alias("rank", "point"))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    got = sorted(tuple(r) for r in df.collect())
    stop.cancel()
    long = [(1, 0, "People", k, f"The team has number {3 * k}.") for k in range(3)] + [(1, 1, "Money", k, f"Number {3 * k + 1} is a cost.") for k in range(3)]
    assert got == [*long, (3, 0, "Money", 0, "The team has one cost."), (3, 1, D.OTHERS, 0, "Number one has no topic.")]
