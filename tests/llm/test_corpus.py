"""Corpus operators: awkward rows, and brute force where SQL can't say it."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import decontamination, exact_dedup, language_id, licenses, line_dedup, ngram_join, sentencepiece_rounds, sharding, token_frames, warc
from colloquy.llm.warc import one_each

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, size string, block string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen. " * 400
TEXTS = [None, "", "  ", "a", "Under the MIT License", "x y", LONG, LONG, "q" * 5000, "line one is a rather long line of text\nshort\nline one is a rather long line of texts", "é̂ 日本 😀 <0x0A>\t\r\n z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", None, "k", 1, "z", "b") for i, t in enumerate(TEXTS)] + [(None, None, None, None, None, None, None, None, None), (6, LONG, "en", "s", 1, "k", 1, "z", "b")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "three four five six seven eight nine"), (1, None), (2, ""), (3, "too short"), (0, "three four five six seven eight nine")], "item_id long, text string")


def test_awkward_and_empty_tables(spark, docs, items):
    n = docs.count()
    runs = {
        "op4": lambda d: exact_dedup.DigestIndex(spark, buckets=4).ingest(d),
        "op5": lambda d: sharding.shard(d, 3, ranges_per_shard=4),
        "op6": lambda d: language_id.identify(d, language_id.train(d)),
        "op8": lambda d: sentencepiece_rounds.encode_documents(d, model()),
        "op9": licenses.scan_licenses,
        "op2": ngram_join.near_duplicates,
    }
    for name, run in runs.items():
        assert run(docs).count() == n, name
        assert run(docs.limit(0)).count() == 0, name
    assert line_dedup.line_classes(docs).count() > 0
    assert line_dedup.line_classes(docs.limit(0)).count() == 0
    found = decontamination.contained_items(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(6, 0), (7, 0)}
    assert decontamination.contained_items(docs, items.limit(0)).count() == 0
    assert decontamination.contained_items(docs.limit(0), items).count() == 0
    files = token_frames.write_tokens(docs.limit(0), words(), 1)
    assert token_frames.read_tokens(one_each(files)).count() == 0


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_sentencepiece_equals_the_library():
    import sentencepiece

    sp, mine, rng = sentencepiece.SentencePieceProcessor(model_file=model()), sentencepiece_rounds.coder(model()), random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab th e\n.éß日z ▁0") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t) + [2]
        assert mine.decode(ids) == sp.decode(sp.encode(t) + [2])


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(words())
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = sorted(map(tuple, token_frames.read_tokens(one_each(token_frames.write_tokens(unique, words(), 1))).collect()))
    start, want = 0, []
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in unique.collect()):
        ids = tk.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_word_memo_equals_the_library():
    from tokenizers import Tokenizer

    tk, memo, rng = Tokenizer.from_file(words()), token_frames.WordMemo(words()), random.Random(4)
    texts = ["", "İ x a\u0301 \u0301b Ǆ ﬁ ª ʰ ㅎㅏ がㄱ ǈ ß ᾳ", "İ. A.b,c a.'s", "<|ENDOFTEXT|> <|endoftext|>.; b!!c ?d", "x" * 5000 + ". y"]
    texts += ["".join(rng.choice("abTH e\n.,'sé̂ßİ日!\t \x1c12<|endoftext|>") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    accents = "aeiouéèêöüßñçåø\u0301\u0308İıſǅ한がабв"
    texts += [" ".join("".join(rng.choice(accents) for _ in range(rng.randint(1, 7))) for _ in range(9)) for _ in range(400)]
    for start in range(0, len(texts), 100):  # slices of an array, and a memo that earlier slices have filled
        part = pa.array(texts).slice(start, 100)
        ids, at = memo.encode(part)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == [e.ids for e in tk.encode_batch(part.to_pylist(), add_special_tokens=False)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é"), (2, "u", "<p>é"), (3, None, None), (4, "u\r\nx", ""), (9, "u", "other" * 3000)], "page_id long, url string, html string")
    files = warc.archive_pages(pages)
    got = {r.page_id: r for r in warc.read_indexed(one_each(files)).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 9: ("response", None)}
    assert got[1].payload_digest == warc.payload_digest("<p>é".encode()) and got[1].payload_bytes == 5
    assert got[9].payload_bytes == 15000
    assert warc.read_indexed(one_each(warc.archive_pages(pages.limit(0)))).count() == 0


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "same text" * 20 if i % 3 == 0 else "w" * rng.randint(0, 400)) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    by = out.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"), u=("slot", "nunique"))
    assert len(out) == 6000 and len(by) == 8
    assert by.b.max() < 1.05 * by.b.mean() and by.b.min() > 0.95 * by.b.mean()
    assert (by.n == by.top + 1).all() and (by.n == by.u).all()


def test_shards_column_by_column(spark):
    """Sizes, checksums and slots against plain Python; small groups whole, a heavy one spread, though its ids are equal."""
    rng = random.Random(12)
    rows = [(rng.choice([None, i]), f"group {rng.randrange(900)} é") for i in range(3000)] + [(None, None)] * 40 + [(7, "a heavy text " * 3)] * 2000 + [(1, "x" * 9000)]
    rng.shuffle(rows)
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6, ranges_per_shard=8).collect()
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key((r.doc_id, r["size"], r.text_crc32)) for r in out) == sorted(key((i, size(t), crc(t))) for i, t in rows)
    by, groups = {}, {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    total = sum(size(t) for _, t in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 6) < 0.1 * total / 6 + 9008
    assert all(len(s) == 1 for c, s in groups.items() if c != crc("a heavy text " * 3))
    assert len(groups[crc("a heavy text " * 3)]) > 1


def test_rows_that_repeat_an_id_lose_only_their_own_lines(spark):
    rows = [(1, "the very first line of them all\nunique to the first row of this"), (2, "the very first line of them all\nonly here in document two"), (2, "another row with the same id\nits unique second line, kept"), (None, "the very first line of them all\nno id here"), (None, None), (3, "")]
    out = [tuple(r) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()]
    assert sorted(out, key=str) == sorted([(1, "unique to the first row of this"), (2, "only here in document two"), rows[2], rows[3], rows[4], rows[5]], key=str)


def test_lines_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: line_dedup.F.pmod(line_dedup.F.xxhash64(line), line_dedup.F.lit(5)))
    rows = [(i, f"{chr(97 + i % 23) * 25} {i % 23}") for i in range(60)]
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_doc) for r in got} == {(i, i % 23) for i, _ in rows}


@pytest.mark.parametrize("large", [128, 2])
def test_edit_join_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(line_dedup, "LARGE", large)  # beyond it a second shared segment is asked for
    rng = random.Random(6)

    def edited(s, k):
        s = list(s)
        for _ in range(k):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], ["x"], [s[i], "y"]])
        return "".join(s)

    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(20, 40))).strip().ljust(22, "z") for _ in range(60)]
    lines = sorted({edited(b, rng.randint(0, 4)).strip() for b in base for _ in range(12)})
    near = {(a, b) for a in lines for b in lines if a < b and min(len(a), len(b)) >= 20 and distance(a, b) <= 2}
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        root[find(a)] = find(b)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.class_doc for r in line_dedup.line_classes(docs).collect()}
    least = {}
    for i, t in enumerate(lines):
        least.setdefault(find(t), []).append(i)
    want = {i: min(v) for v in least.values() for i in v}
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_jaccard_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 7)
    rng, rows = random.Random(8), []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(15):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(120)] = f"n{rng.randrange(99)}"
            rows.append((len(rows), " ".join(t)))
    got = {r.doc_id: (r.n_links, r.n_copies) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(116)) for i, t in rows}
    different = set(sets.values())
    for i, s in sets.items():
        links = sum(1 for o in different if o != s and len(o & s) >= 0.8 * len(o | s))
        assert got[i] == (links, sum(o == s for o in sets.values()))


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(None, a), (None, a), (None, a), (5, a), (7, a), (9, b), (9, a + " more"), (None, "alone in the world"), (None, "alone in the  world"), (None, None), (3, None)]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies, r.kept) for r in out), key=str)
    alone = sorted(r.kept for r in out if r.n_copies == 2)
    assert alone == [False, True]
    assert [x for x in got if x[3] != 2] == sorted([(None, 5, 1, 5, False)] * 3 + [(5, 5, 1, 5, True), (7, 5, 1, 5, False), (9, 9, 0, 1, True), (9, 5, 1, 1, False), (None, None, 0, 1, True), (3, 3, 0, 1, True)], key=str)


def test_pairs_are_owned_by_their_least_shared_band():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 3, (40, 6)), rng.integers(0, 3, (30, 6))
    every = sum(ngram_join.owned(left, right, b).astype(int) for b in range(6))
    assert (every == (left[:, None, :] == right[None, :, :]).any(2)).all()


@pytest.mark.parametrize(
    ("text", "labels"),
    [("This work is now released under the MIT License.", ["mit"]), ("Licensed under the Apache License, Version 2.0.", ["apache-2"]), ("licensed under GNU General Public License, version 3", ["gpl-3"]), ("licensed under the GNU public license version 3", []), ("cc-by-nc", ["cc-by-nc"])],
)
def test_license_automata(text, labels):
    out = licenses.scan(text, licenses.compiled(licenses.TEMPLATES), [(p.encode().split(), x) for p, x in licenses.BASE])
    assert out[5] == labels


def test_license_base_equals_regex():
    text = "Under the  MIT-License under the mit license, K apache license version 2.0"
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = licenses.scan(text, [], [(p.encode().split(), x) for p, x in licenses.BASE])
    assert out[0] == len(found) and out[1:4] == (3, 0, 9) and out[4] == ["apache-2", "mit"]


def test_digest_index_across_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    a = spark.createDataFrame([(5, "x  y"), (6, "z")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x\ty"), (7, "new"), (8, "new")], "doc_id long, text string")
    index.ingest(a).count()
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(b).collect()}
    assert got == {1: (5, False), 7: (7, True), 8: (7, False)}
    assert index.rows().count() == 3
    other = exact_dedup.DigestIndex(spark, path=index.path, buckets=4)  # as another session would
    other.attach()
    c = spark.createDataFrame([(0, "x y"), (None, "new"), (9, "z"), (2, None), (None, "")], "doc_id long, text string")
    assert sorted(other.ingest(c).select("doc_id", "keep_id").na.fill(-1).collect()) == [(-1, 2), (-1, 7), (0, 5), (2, 2), (9, 6)]
    plan = index.rows().join(other.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan.split("== Physical Plan ==")[1]
    rows = sorted(map(tuple, index.rows().collect()))
    index.compact()
    assert sorted(map(tuple, index.rows().collect())) == rows and len(rows) == 4
    files = index.rows().select("_metadata.file_path").distinct().count()
    assert files <= index.buckets


def test_batches_of_one_index_equal_one_batch(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, rng.randrange(500)]), rng.choice([None, "", "a b", "a  b", f"t{rng.randrange(60)}"])) for _ in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    low, size = {}, {}
    for i, t in rows:
        t = " ".join((t or "").split(" ")) if not t or "  " not in t else "a b"
        size[t] = size.get(t, 0) + 1
        low[t] = min([x for x in (low.get(t), i) if x is not None], default=None)
    for batches in (1, 3):
        got = exact_dedup.deduplicated(docs, batches).collect()
        assert len(got) == len(rows)
        want = {hashlib.sha256(t.encode()).hexdigest(): (low[t], n) for t, n in size.items()}
        assert {(bytes(r.digest).hex(), r.keep_id, r.group_size) for r in got} == {(h, *x) for h, x in want.items()}
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_many_lines_of_one_template(spark, monkeypatch):
    """Lines that differ in a number and in letters, in more than one place, among few enough to compare all."""
    monkeypatch.setattr(line_dedup, "LARGE", 8)
    rng = random.Random(8)
    made = {f"{a}the meeting of room {b}{'' if rng.random() < 0.8 else chr(0xFDD0)} is moved to {c} o'clock" for a in ("", "x", "\U0001f600") for b in range(0, 40000, 4001) for c in ("five", "six")}
    made |= {"aaaaaaaa" * 3 + "".join(rng.choice("aab") for _ in range(rng.randrange(1, 8))) for _ in range(20)}
    lines = sorted(made)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(lines)):
        for i in range(j):
            if find(i) != find(j) and distance(lines[i], lines[j]) <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_doc for r in line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(lines))}


def test_rows_of_a_template_grow_with_its_lines(spark, monkeypatch):
    """Twice the lines of one template, about twice the pairs that are verified."""
    made = []
    verified = line_dedup.verified
    monkeypatch.setattr(line_dedup, "LARGE", 16)
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, lines, edits: made.append(pairs.count()) or verified(pairs, lines, edits))
    sizes = []
    for n in (250, 500):
        made.clear()
        lines = [(i, f"the meeting of room {i:05} is moved to five o'clock") for i in range(n)]
        assert line_dedup.line_classes(spark.createDataFrame(lines, "doc_id long, text string")).count() == n
        sizes.append(sum(made))
    assert 0 < sizes[1] < 3 * sizes[0]


def test_few_lines_of_large_keys_are_compared_at_once(spark, monkeypatch):
    """Lines of large keys are split again only where comparing them would take more than a share of all lines."""
    rounds, buckets_of = [], line_dedup.buckets_of
    monkeypatch.setattr(line_dedup, "LARGE", 16)
    monkeypatch.setattr(line_dedup, "buckets_of", lambda keys: rounds.append(1) or buckets_of(keys))
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    words = [word() for _ in range(40)]
    copies = [" ".join([*words[:k], word(), *words[k + 1 :]]) for k in range(40)]
    lines = [" ".join(words), " ".join(words)[:-1] + "z", *copies, copies[5] + "y", *[" ".join(word() for _ in range(5)) for _ in range(2500)]]
    got = {r.doc_id: r.class_doc for r in line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: {1: 0, 42: 7}.get(i, i) for i in range(len(lines))}
    assert len(rounds) == 1
