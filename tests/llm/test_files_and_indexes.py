"""Token files read at random and damaged, the digest index between sessions, pages without ids."""

import io
import struct

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import exact_dedup, token_frames, warc
from colloquy.llm.warc import one_each


def packed(docs, frame_bytes, monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_BYTES", frame_bytes)
    sink = io.BytesIO()
    w = token_frames.FrameWriter(sink, wide=False)
    for i, ids in enumerate(docs):
        w.add(i, np.array(ids, np.uint32))
    w.close()
    return sink.getvalue()


@pytest.fixture
def docs():
    rng = np.random.default_rng(2)
    return [rng.integers(0, 60_000, n).tolist() for n in [0, 1, 5, 300, 40, 2000, 7, 7, 0, 90]]


def test_a_document_is_read_without_the_other_frames(docs, monkeypatch):
    raw = packed(docs, 400, monkeypatch)
    r, unpacked = token_frames.FrameReader(pa.BufferReader(raw)), []
    assert len(r.frames) == 4  # several data frames, and the table of documents
    real = r.frame
    monkeypatch.setattr(r, "frame", lambda k: unpacked.append(k) or real(k))
    for i in (9, 3, 5, 2):
        unpacked.clear()
        assert r.tokens(i).tolist() == docs[i]
        assert unpacked == [r.docs[i]["frame"]]
    assert [r.tokens(i).tolist() for i in range(len(docs))] == docs


def test_damage_is_found_in_its_frame_alone(docs, monkeypatch):
    raw = bytearray(packed(docs, 400, monkeypatch))
    whole = token_frames.FrameReader(pa.BufferReader(bytes(raw)))
    hurt = int(whole.docs[5]["frame"])
    raw[whole.at[hurt] + whole.frames[hurt][0] // 2] ^= 0x40
    r = token_frames.FrameReader(pa.BufferReader(bytes(raw)))
    with pytest.raises(Exception, match="(?i)checksum|corrupt|decompress"):
        r.tokens(5)
    assert r.tokens(9).tolist() == docs[9]
    # plain bytes that were changed along with their own frame's checksum differ from the table's
    import zstandard

    other = zstandard.ZstdCompressor(write_checksum=True).compress(b"\0" * whole.frames[0][1])
    swapped = other + bytes(raw[whole.at[1] :])
    n = len(whole.frames)
    table = len(swapped) - 9 - 12 * n
    swapped = swapped[:table] + struct.pack("<I", len(other)) + swapped[table + 4 :]
    with pytest.raises(ValueError, match="checksum of frame 0"):
        token_frames.FrameReader(pa.BufferReader(swapped)).frame(0)
    with pytest.raises(ValueError, match="no seek table"):
        token_frames.FrameReader(pa.BufferReader(bytes(raw[:-3])))


def test_an_index_says_itself_what_it_has(spark):
    texts = lambda a, b: spark.createDataFrame([(i, f"text {i % 40}") for i in range(a, b)], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, buckets=8)
    index.ingest(texts(0, 30)).count()
    other = exact_dedup.DigestIndex(spark, path=index.path)  # as another session would
    other.attach()
    assert other.buckets == index.buckets == 8 and other.rows().count() == 30
    index.compact()
    assert index.buckets == 4 and index.rows().count() == 30
    assert other.rows().count() == 30  # the rows that it reads are still there
    with pytest.raises(RuntimeError, match="another session"):
        other.compact()
    other.attach()
    assert other.buckets == 4 and other.data == index.data
    got = {r.doc_id: r.keep_id for r in other.ingest(texts(30, 60)).collect()}
    assert got == {i: i if i < 40 else i - 40 for i in range(30, 60)}
    index.vacuum()
    assert index.rows().count() == 40 == other.rows().count()
    index.drop()


def test_equal_rows_without_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, "same text")] * 500 + [(3, "same text")] * 20 + [(None, None), (4, "x")], "doc_id long, text string")
    got = [tuple(r) for r in exact_dedup.deduplicated(docs).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 520, False)] * 500 + [(3, 3, 520, True)] * 20 + [(None, None, 1, True), (4, 4, 1, True)], key=str)


def test_pages_without_ids_and_with_one_id(spark):
    rows = [(None, "u", "<p>same</p>")] * 30 + [(7, "u", "<p>same</p>")] * 10 + [(7, "u", "other"), (None, None, None), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_indexed(one_each(warc.archive_pages(pages))).collect()), key=str)
    want = [(None, 11, "revisit", 7)] * 30 + [(7, 11, "response", None)] * 10 + [(7, 5, "response", None), (None, 0, "response", None), (None, 5, "response", None)]
    assert got == sorted(want, key=str)
