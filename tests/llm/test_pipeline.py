"""The pipeline's stages on small documents, against what is left by hand."""

import corpus_pipeline
import public_tokenizers
import sentencepiece

WORDS = {"en": "the and with from house river people water garden", "de": "der und mit von haus fluss leute wasser garten"}


def test_stages_keep_what_they_should(spark, tmp_path):
    item = "seven green lanterns hang above the quiet harbour tonight while sailors sleep below deck until morning comes again"
    shared = "this line stands in more than one of the documents"
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[(i * 7 + j * (1 + i // 9)) % 9] + ("" if j % 3 else chr(97 + i % 26) + chr(97 + i // 26)) for j in range(40)), lang))
    rows += [(100, "123 456 ... 789", "en"), (101, f"{shared}\nfirst document about a river", "en"), (102, f"{shared}s\nsecond document about a garden", "en"), (103, f"some people say {item}", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    known = corpus_pipeline.language_stage(spark, docs, d)
    assert {r.doc_id for r in known.collect()} == {r[0] for r in rows} - {100}
    lines = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, docs.where("doc_id > 100"), d).collect()}
    assert lines[101].text == rows[61][1] and lines[102].text == "second document about a garden"
    assert lines[102].n_chars == len(lines[102].text)
    twice = docs.where("doc_id = 7").union(docs.where("doc_id = 7").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars")).union(docs.where("doc_id = 101"))
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, twice, d).collect()} == {7, 101}
    clean = corpus_pipeline.decontamination_stage(spark, docs, d)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {103}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.encoding_stage(spark, docs.where("doc_id > 99"), d).collect():
        assert list(r.ids) == sp.encode(dict(x[:2] for x in rows)[r.doc_id]) + [2]


def test_only_letterless_texts_are_unknown(spark):
    docs = spark.createDataFrame([(i, WORDS["en" if i % 2 else "de"] + f" w{i}", "en" if i % 2 else "de") for i in range(80)] + [(99, "12 ..", "en")], "doc_id long, text string, lang string")
    from colloquy.llm import language_id

    for r in language_id.identify(docs, language_id.train(docs)).collect():
        assert r.lang_pred == ("und" if r.doc_id == 99 else "en" if r.doc_id % 2 else "de")


def lines_of(n, lang, seed):
    w = WORDS[lang].split()
    return " ".join(w[(seed * 7 + j * (1 + seed // 9)) % 9] + ("" if j % 3 else chr(97 + seed % 26) + chr(97 + seed // 26)) for j in range(n))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _line_doc long, _line_row string, _line_gone string, line_doc int, LINE_GONE int, gone_doc string, gone_key int, text_key int, kept string"


def test_every_stage_on_null_ids_clashing_columns_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(0, "seven green lanterns hang above the quiet harbour tonight"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i if i % 4 else None, lines_of(40, "en" if i % 2 else "de", i) + f"\nthis line stands in all {i % 2} of them", "en" if i % 2 else "de") for i in range(60)]
    rows += [(None, None, None), (None, "", "en"), (5, rows[5][1], "en"), (None, "they say seven green lanterns hang above the quiet harbour tonight and more words", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", None, 1, "r", "g", 1, 2, "d", 3, 4, "k") for i, t, x in rows], CLASHING)
    for none in (False, True):
        now = docs.limit(0) if none else docs
        for name, stage in corpus_pipeline.STAGES:
            at = f"{tmp_path}/{none}-{name}"
            stage(spark, now, str(tmp_path)).write.parquet(at)
            now, before = spark.read.parquet(at), now
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns, name
            assert none or 50 < now.count() <= before.count(), name
        assert now.columns == ["doc_id", "ids", "decoded"]
        assert now.count() == 0 if none else now.where("doc_id IS NULL").count() > 10
        assert none or not [r for r in now.collect() if "lanterns" in r.decoded]


def test_a_run_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    from colloquy.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name.split("-")[:2] for p in (tmp_path / "shared").iterdir()] == [["stage", "sentencepiece"]]
    assert out.columns == ["doc_id", "ids", "decoded"] and 100 < out.count() < 200
    assert [p for p in common._KEPT if "/shared/" in p] == [f"file://{next((tmp_path / 'shared').iterdir())}"]
