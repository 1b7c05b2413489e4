"""Byte-pair encoding by a queue, against the tokenizers library."""

import hashlib
import json
import random

import pyarrow as pa
import pytest

from colloquy.llm import bpe_queue

FIELDS = "doc_id long, text string, ids string, decoded int, lang string"


def path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path())


def texts():
    rng = random.Random(11)
    odd = ["", " ", "\n\n", "It's we'll I'D 'S", "x" * 30_000, "Straße ΣΑΣ İstanbul ﬁ 日本語テキスト 😀👍🏽", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|endoftext", "é é ≠ ≠   z\t\r\nq", "1234 ½ ²³ a1b2", "...!!! ?a.b,c", "\x00\x01\x7f", "ab" * 4000 + "</w>"]
    letters = "aabcdeehilnorstu  .,'’<|>éßΣ日0१\n\t-_A"
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2500)]


def test_equals_the_library(library):
    mine, all_texts = bpe_queue.QueueCoder(path()), texts()
    ids, at = mine.encode(pa.array(all_texts))
    plain = mine.decode(ids, at).to_pylist()
    for i, t in enumerate(all_texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want, t
        assert plain[i] == library.decode(want, skip_special_tokens=False)
        assert mine.chunk_ids(t) == want, t  # a text as a whole


def test_the_model_isnt_asked(monkeypatch):
    mine = bpe_queue.QueueCoder(path())
    real, mine.tokenizer = mine.tokenizer, None
    mine.tokenizer = type("Steps", (), {"normalizer": real.normalizer, "pre_tokenizer": real.pre_tokenizer})
    assert len(mine.encode(pa.array(["Unusual wordings, e.g. détours"]))[0])


def test_queue_on_small_vocabularies(tmp_path):
    """Random merges without an end-of-word mark, where stale entries and several ways to one symbol are common."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    for case in range(40):
        symbols, merges = list("abc"), []
        while len(merges) < 25:
            a, b = rng.choice(symbols), rng.choice(symbols)
            if len(a + b) < 9 and [a, b] not in merges:
                merges.append([a, b])
                symbols.append(a + b)
        vocab = {s: i for i, s in enumerate(dict.fromkeys(symbols))}
        file = tmp_path / f"{case}.json"
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
        file.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}))
        library, mine = Tokenizer.from_file(str(file)), bpe_queue.QueueCoder(str(file))
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(60)]
        ids, at = mine.encode(pa.array(words))
        for i, w in enumerate(words):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(w, add_special_tokens=False).ids, (w, merges)


def test_other_kinds_of_tokenizers_are_errors():
    with pytest.raises(ValueError):
        bpe_queue.QueueCoder(path("byte_bpe_50k.json"))  # has a decoder of its own


def test_documents(spark, library, monkeypatch):
    rows = [(i, t, "x", 1, "en") for i, t in enumerate(texts()[:60])] + [(None, None, None, None, None), (3, None, "x", 1, None), (None, "again", "", 0, ""), (3, "again", "", 0, "")]
    docs = spark.createDataFrame(rows, FIELDS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), library.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), r.decoded) for r in bpe_queue.encode_documents(docs, path()).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe_queue.encode_documents(docs.limit(0), path()).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe_queue.op13_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == want
