"""Token files of independent zstandard frames with a trailing seek table.

File layout: data frames (each with whole documents, with a content checksum),
one frame with the document table, then the skippable seek-table frame of the
public zstd seekable format: for each frame its packed size, its plain size and
the low 32 bits of the XXH64 of its plain bytes; then the number of frames, a
descriptor byte and the magic number. A reader takes the seek table from the end
of the file, then the document table, and unpacks only the frames of the
documents that it wants, each of which is checked against its checksum.

Token ids are little-endian unsigned 16-bit integers where the vocabulary (with
the end id) allows that, else 32-bit. A document that is larger than a frame
makes one frame of its own.

Defined results: null text is the empty text, which has the end id alone; a null
``doc_id`` sorts before all others; rows that repeat a ``doc_id`` are separate
documents in an order of their own text; an empty table gives no files and no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import filesystem, fresh_path, ship, table, text_or_empty, written
from colloquy.llm.warc import one_each

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Plain bytes after which a data frame is closed.
FRAME_BYTES = 1 << 19
#: Bytes of text that are split and encoded together.
SLICE_BYTES = 1 << 23
#: Places where a text can be split without changing its tokens, besides white space.
MARK = r"([A-Za-z])([.,;:!?&$*#%])"
#: Words whose ids a worker remembers.
MEMO_WORDS = 600_000
#: Words of letters alone that go to the tokenizer as one text.
JOINED = 500
FILE_FIELDS = "part int, path string, docs long, tokens long"
DOC_FIELDS = "doc_id long, start long, n_tokens long, ids_crc32 long"
DOC_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8")])


def splits_at_space(settings: dict) -> bool:
    """Whether a tokenizer folds case and white space, and then takes runs of letters, digits or marks alone."""
    steps = (settings.get("normalizer") or {}).get("normalizers", [])
    before = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = before[0]
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
        and split["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and [(x["type"], x.get("use_regex")) for x in before[1:]] == [("ByteLevel", False)]
        and not before[1]["add_prefix_space"]
        and settings["model"].get("dropout") is None
    )


class WordMemo:
    """Exact encoding by white-space separated chunks, with a memo of chunks.

    The tokenizer drops white space and no token spans it, so a text's ids are
    those of its chunks in turn. A mark after an ASCII letter always begins
    another token, so it is a chunk of its own too. A slice of texts is split at
    once, each of its distinct chunks is looked up once, and the ids are put
    together by one gather. The memo is cleared when it is full.

    All this follows from the tokenizer's settings, which are looked at when the
    file is read; where they differ, whole texts go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.by_chunks = splits_at_space(settings)
        suffix, vocabulary = settings["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        #: Whether a token ends a word, where the vocabulary says so.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.place, self.pool, self.starts = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encoded(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the chunks in another order; their ids in turn; how many each has).

        A chunk of letters is one word for the tokenizer, so many of them go as one
        text, which is cut after each token that ends a word; if that doesn't give as
        many words as there are chunks, each goes alone.
        """
        letters = [c for c in chunks if c.isalpha()]
        texts = [" ".join(letters[i : i + JOINED]) for i in range(0, len(letters), JOINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(letters):
            letters, ids, last = [], ids[:0], last[:0]
        others = [c for c in chunks if not (letters and c.isalpha())]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else []
        n = np.concatenate([np.diff(last, prepend=-1), np.fromiter(map(len, made), np.int64, len(made))])
        return letters + others, np.concatenate([ids, np.fromiter(chain.from_iterable(made), np.uint32)]), n

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Each chunk's place in the memo; those that it lacks go to the tokenizer together."""
        if len(self.place) > MEMO_WORDS or self.pool.size > 10 * MEMO_WORDS:
            self._clear()
        new = [c for c in chunks if c not in self.place]
        if new:
            new, ids, n = self._encoded(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
            self.pool = np.concatenate([self.pool, ids])
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, offsets of the texts' first ids and the end)."""
        import pyarrow.compute as pc

        if not self.by_chunks:
            made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *made]), np.cumsum([0, *map(len, made)])
        spaced = pc.replace_substring_regex(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), MARK, r"\1 \2")
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        # a special token's name in capitals is ordinary text and must stay so
        lower = pc.if_else(pc.match_substring(coded.dictionary, "<|"), coded.dictionary, pc.ascii_lower(coded.dictionary))
        places = self._places(lower.unique().to_pylist())[pc.index_in(lower, lower.unique()).to_numpy()]
        codes = places[coded.indices.to_numpy()]
        first = self.starts[codes]
        n = self.starts[codes + 1] - first
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    import pyarrow.compute as pc

    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    yield start, len(texts)


_ENCODERS: dict[str, WordMemo] = {}


def encoder(path: str) -> WordMemo:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path] = WordMemo(path)
    return _ENCODERS[path]


class FrameWriter:
    """Writes one token file; holds one open frame and the document table."""

    def __init__(self, sink, wide: bool, level: int = 3):
        import zstandard

        self.sink, self.kind = sink, np.dtype("<u4" if wide else "<u2")
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open, self.size, self.frames, self.docs, self.tokens = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.size, len(ids)))
        raw = np.asarray(ids, self.kind).tobytes()
        self.open.append(raw)
        self.size += len(raw)
        self.tokens += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        self._frame(b"".join(self.open))
        self.open, self.size = [], 0

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.open:
            self._flush()
        self._frame(bytes([self.kind.itemsize]) + np.array(self.docs, DOC_ENTRY).tobytes())
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        tail = entries + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(tail)) + tail)


class FrameReader:
    """Random access by document; unpacks and checks only the frames asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        source.seek(size - 9 - 12 * n)
        self.frames = list(struct.iter_unpack("<III", source.read(12 * n)))
        self.at = [0, *np.cumsum([f[0] for f in self.frames]).tolist()]
        raw = self.frame(n - 1)
        self.kind, self.docs, self.last = np.dtype("<u4" if raw[0] == 4 else "<u2"), np.frombuffer(raw, DOC_ENTRY, offset=1), (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, plain, check = self.frames[k]
        self.source.seek(self.at[k])
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {k} differs")
        return raw

    def tokens(self, i: int) -> np.ndarray:
        d = self.docs[i]
        if self.last[0] != d["frame"]:
            self.last = (int(d["frame"]), self.frame(int(d["frame"])))
        return np.frombuffer(self.last[1], self.kind, int(d["n_tokens"]), int(d["offset"]))


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode and write ``docs`` in ascending ``doc_id``; returns (part, path, docs, tokens, start).

    Range partitioning by ``doc_id`` gives each task one range and one file; the
    sampling for it reads the ids alone. ``start`` is the number of ids in all
    files before, from a running sum over one row for each file.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "tokens")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = dealt.repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, w, n, path, part = encoder(tokenizer_path), None, 0, "", TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows and w is None:
                fs, root = filesystem(folder)
                fs.create_dir(root, recursive=True)
                path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex[:8]}.zst"
                w = FrameWriter(fs.open_output_stream(filesystem(path)[1], compression=None), max(enc.tokenizer.get_vocab_size() - 1, end_id) > 0xFFFF)
            ids_of, texts = b.column("doc_id").to_pylist(), b.column("text")
            for start, end in slices(texts, SLICE_BYTES) if b.num_rows else ():
                ids, at = enc.encode(texts.slice(start, end - start))
                for i, doc_id in enumerate(ids_of[start:end]):
                    w.add(doc_id, np.append(ids[at[i] : at[i + 1]], end_id))
                n += end - start
        if w is not None:
            w.close()
            w.sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([w.tokens], pa.int64())], names=["part", "path", "docs", "tokens"])

    return placed(written(dealt.mapInArrow(task, FILE_FIELDS), "token-files"))


def placed(files: DataFrame) -> DataFrame:
    """Adds ``start``: ids in all files before. A row a file, so one running sum is small."""
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    r = FrameReader(f)
                    crc = [zlib.crc32(r.tokens(i).astype("<u4").tobytes()) for i in range(len(r.docs))]
                    n = r.docs["n_tokens"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.docs["doc_id"].astype(np.int64), mask=r.docs["null"].astype(bool)), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.select("path", "start").mapInArrow(task, DOC_FIELDS)


def op3_token_frames(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(one_each(written(files, "token-places")))
