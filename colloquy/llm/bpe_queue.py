"""Byte-pair encoding by a queue of merge ranks, and decoding.

A word's symbols are a doubly linked list over flat arrays. A heap holds (rank,
place, symbol made) of its pairs; the least one is merged, its neighbours' new
pairs join the heap, and entries whose symbol is gone or whose pair has changed
are skipped when they come up. A word of n symbols takes O(n log n), so a run of a
million letters is an ordinary word. Texts are cut into chunks as in
``token_frames.WordMemo``, whose memo is used too; the tokenizer's own normalising
and splitting steps make a chunk's words, its model isn't asked.

Decoding puts the vocabulary's strings together; the tokenizer file has no decoder
step, so they stand with a space between them, as the library gives them.

Defined results: null text is the empty text, which has no ids and decodes to the
empty text; names of special tokens in a text are those tokens; rows that repeat
give equal rows; null ``doc_id`` stays null; an empty table gives no rows; other
columns are ignored. A tokenizer whose file asks for more than this (dropout, an
unknown token, prefixes, byte fallback, special tokens that are normalised or take
white space along, another decoder) is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ship, spread, table
from colloquy.llm.sentencepiece_rounds import gathered
from colloquy.llm.token_frames import WordMemo, slices

#: Bytes of text that are encoded and decoded together.
SLICE_BYTES = 1 << 21
RESULT = "doc_id long, ids array<int>, decoded string"
#: What a model's settings must say.
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


class Merges:
    """Symbols and ranked pairs of a byte-pair model."""

    def __init__(self, model: dict):
        if any(model.get(k) != v for k, v in PLAIN_MODEL.items()):
            raise ValueError("not a plain byte-pair model")
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner, self.final = ids, {c: ids[c + end] for c in ids if len(c) == 1 and c + end in ids}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}

    def encode(self, word: str) -> list[int]:
        """Ids of one word; a character that the vocabulary lacks is an error."""
        ids = [self.inner[c] for c in word[:-1]]
        ids.append(self.final[word[-1]])
        made, n = self.made.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, m[1]) for i in range(n - 1) if (m := made((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, new = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or (m := made((ids[i], ids[j]))) is None or m[1] != new:
                continue  # stale
            ids[i], ids[j] = new, -1
            h, k = before[i], after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if m := made((new, ids[k])):
                    heappush(queue, (m[0], i, m[1]))
            if h >= 0 and (m := made((ids[h], new))):
                heappush(queue, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]


class QueueCoder(WordMemo):
    """``WordMemo`` whose chunks are encoded by ``Merges``, and that decodes."""

    def __init__(self, path: str):
        super().__init__(path)
        settings = json.loads(self.tokenizer.to_str())
        special = settings.get("added_tokens") or []
        if settings.get("decoder") or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special tokens or a decoder that this coder doesn't know")
        self.merges = Merges(settings["model"])
        self.special = {t["content"]: t["id"] for t in special}
        self.cut = re.compile(f"({'|'.join(map(re.escape, self.special))})") if special else None
        names = {i: w for w, i in self.tokenizer.get_vocab().items()}
        plain = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.plain, self.plain_starts = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])

    def words(self, text: str) -> list[str]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text] * bool(text)

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of any text; plain lower-case letters are a word as they are."""
        if self.by_chunks and chunk.isascii() and chunk.isalpha() and chunk.islower():
            return self.merges.encode(chunk)
        out = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += chain.from_iterable(map(self.merges.encode, self.words(part)))
        return out

    def _encoded(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        made = list(map(self.chunk_ids, chunks))
        n = np.fromiter(map(len, made), np.int64, len(made))
        return chunks, np.fromiter(chain.from_iterable(made), np.uint32, int(n.sum())), n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.by_chunks:
            return super().encode(texts)
        made = [np.array(self.chunk_ids(t), np.uint32) for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.cumsum([0, *map(len, made)])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of the runs of ids that begin and end there."""
        raw, at = gathered(self.plain, self.plain_starts, ids.astype(np.int64))
        raw, at = raw.tobytes(), at[ends].tolist()
        return pa.array([raw[a : max(a, b - 1)].decode() for a, b in zip(at, at[1:], strict=False)], pa.string())


_CODERS: dict[str, QueueCoder] = {}


def coder(path: str) -> QueueCoder:
    if path not in _CODERS:
        _CODERS[path] = QueueCoder(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; one narrow map, no shuffle."""
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer_path)
        for b in batches:
            texts = b.column("text")
            for start, end in slices(texts, SLICE_BYTES) if b.num_rows else ():
                ids, at = c.encode(texts.slice(start, end - start))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, end - start), lists, c.decode(ids, at)], names=["doc_id", "ids", "decoded"])

    return spread(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "coalesce(CAST(text AS string), '') AS text")).mapInArrow(task, RESULT)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
