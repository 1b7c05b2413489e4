"""Bounds and batches of the corpus operators."""

from colloquy.llm import language_id


def test_no_language_is_left_out_of_a_bounded_sample(spark):
    rows = [(i, f"{chr(97 + i // 40 % 26)}{chr(97 + i // 40 // 26)}og word{i % 7}", f"l{i // 40:02d}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)  # ordered by language
    for most in (100, 400):
        assert language_id.train(docs, most=most).langs == [f"l{i:02d}" for i in range(40)]


def test_ids_that_repeat_dont_exceed_the_bound(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(language_id, "fit", lambda langs, texts: sizes.append(len(langs)))
    docs = spark.createDataFrame([(None, "a few words", f"l{i % 3}") for i in range(900)], "doc_id long, text string, lang string")
    language_id.train(docs, most=90)
    assert sizes[0] <= 90
