"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All distinct words of a batch are one flat numpy array of symbols. A round finds
the least pair rank of each word (segmented minimum), merges that pair in every
word at once and compacts the array; words without a mergeable pair leave. Where
no piece can rank before the one just made (``safe``), all its non-overlapping
leftmost places are merged in one round, else the leftmost place alone: so the
order of merges is that of the library. A word starts at a run of space symbols;
no piece has one after another character, which is checked when a model is read.

Defined results: null text is the empty text, whose only id is the end id; ids of
repeated rows repeat; other columns are ignored; very long words are ordinary
words (they take more rounds, not more memory than their symbols need).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ship, spread, table

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Words whose ids a worker remembers; texts that are encoded together.
MEMO_WORDS = 200_000
TEXTS = 256
#: Characters of text after which a group of texts is closed.
GROUP_CHARS = 2_000_000
RESULT = "doc_id long, ids array<int>, decoded string"


class Model:
    """Merge table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(pieces[i][3:5], 16)] = i
        if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in normal) or not self.bytes.all():
            raise ValueError("not a model with words and byte fallback")
        self.end_id = sp.eos_id()
        symbols = dict.fromkeys(pieces[i] for i in normal)
        symbols.update(dict.fromkeys(c for i in normal for c in pieces[i]))
        number = {s: k for k, s in enumerate(symbols)}
        self.size = len(number) + 1  # the last symbol: any other character
        self.id_of = np.full(self.size, -1, np.int32)
        score = np.full(self.size, -np.inf)
        for i in normal:
            self.id_of[number[pieces[i]]], score[number[pieces[i]]] = i, sp.get_score(i)
        of_score, rank = np.unique(-score, return_inverse=True)
        shared = np.bincount(rank, minlength=len(of_score))[rank] > 1
        keys, made = [], []
        for i in normal:
            p = pieces[i]
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    keys.append(number[p[:k]] * self.size + number[p[k:]])
                    made.append(number[p])
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.rank = rank.astype(np.int32)[self.made]
        least = np.full(self.size, NEVER, np.int32)
        np.minimum.at(least, self.keys // self.size, self.rank)
        np.minimum.at(least, self.keys % self.size, self.rank)
        self.safe = (least > rank) & ~shared
        self.symbol_of = np.full(0x110000, self.size - 1, np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = k
        # isolated line feeds are words of their own
        self.alone = "" if any("\n" in pieces[i] and len(pieces[i]) > 1 for i in normal) else "\n"
        self.word = re.compile(f"{SPACE}*[^{SPACE}{self.alone}]+|{SPACE}+|{self.alone or '$'}")
        plain = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.plain, self.plain_starts = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of pairs; ``NEVER`` where they don't merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER).astype(np.int32), self.made[at]


def merge_rounds(m: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all words in turn, how many each has)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym, char, word = m.symbol_of[chars], chars.copy(), np.repeat(np.arange(len(words)), lens)
    last = np.append(word[1:] != word[:-1], True)
    rank, made = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
    inner = np.flatnonzero(~last)
    rank[inner], made[inner] = m.pairs(sym[inner], sym[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(sym)))
        low = np.minimum.reduceat(rank, starts)
        if (low == NEVER).any():
            over = np.repeat(low == NEVER, sizes)
            done.append((word[over], sym[over], char[over]))
            sym, char, word, rank, made = (x[~over] for x in (sym, char, word, rank, made))
            sizes, low = sizes[low != NEVER], low[low != NEVER]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(low, sizes))
        # leftmost places first: of a run of overlapping places every other one
        run = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
        place = np.arange(len(hit))
        take = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
        first = np.append(True, word[hit[1:]] != word[hit[:-1]])
        take &= m.safe[made[hit]] | first
        unsafe = np.repeat(np.add.reduceat(~m.safe[made[hit]], np.flatnonzero(first)) > 0, np.diff(np.append(np.flatnonzero(first), len(hit))))
        at = hit[take & (first | ~unsafe)]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        at = moved[at]
        sym, char, word, rank, made = (x[keep] for x in (sym, char, word, rank, made))
        touched = np.zeros(len(sym), bool)
        touched[at] = touched[np.maximum(at, 1) - 1] = True
        again = np.flatnonzero(touched)
        inner = again[again < len(sym) - 1]
        rank[again] = NEVER
        inner = inner[word[inner] == word[inner + 1]]
        rank[inner], made[inner] = m.pairs(sym[inner], sym[inner + 1])
    if not done:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word, sym, char = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    word, sym, char = word[order], sym[order], char[order]
    ids = m.id_of[sym]
    if (ids < 0).any():
        word, ids = fall_back(m, word, ids, char)
    return ids, np.bincount(word, minlength=len(words))


def fall_back(m: Model, word: np.ndarray, ids: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become the pieces of their UTF-8 bytes."""
    bad = ids < 0
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in char[bad].tolist()]
    n = np.ones(len(ids), np.int64)
    n[bad] = [len(b) for b in raw]
    out, word = np.repeat(ids, n), np.repeat(word, n)
    out[np.repeat(bad, n)] = m.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    return word, out


def gathered(pool: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``pool`` numbered ``at`` in turn; where each begins, and the end)."""
    first = starts[at]
    n = starts[at + 1] - first
    ends = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends


class Coder:
    """Encodes and decodes whole texts, with a memo of words that is cleared when full.

    The pieces of all known words are one array; a group of texts is split, each of
    its words looked up, and the ids put together by one gather; their bytes by
    another.
    """

    def __init__(self, path: str):
        self.model = Model(path)
        self._clear()

    def _clear(self) -> None:
        # no word is the end of a text
        self.place = {None: 0}
        self.pool, self.starts = np.array([self.model.end_id], np.int32), np.array([0, 1])

    def _learn(self, words: set[str]) -> None:
        if len(self.place) > MEMO_WORDS:
            self._clear()
        new = list(words.difference(self.place))
        if not new:
            return
        ids, n = merge_rounds(self.model, new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
        self.pool = np.concatenate([self.pool, ids])

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids of all texts in turn, each with its end; offsets of the texts' ids; the texts that the ids decode to)."""
        m = self.model
        split = [m.word.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        self._learn(set().union(*split))
        for words in split:
            words.append(None)
        lens = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(lens.sum()))
        ids, ends = gathered(self.pool, self.starts, at)
        ends = ends[np.concatenate([[0], np.cumsum(lens)])]
        return ids, ends, self.plain(ids, ends)

    def plain(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of the runs of ids that end there."""
        raw, at = gathered(self.model.plain, self.model.plain_starts, ids)
        raw, at = raw.tobytes(), at[ends].tolist()
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, at, _ = self.coded(texts)
        return np.split(ids, at[1:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        return self.plain(ids, np.array([0, len(ids)]))[0]


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts): few enough at a time to bound memory."""
    start, chars, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t.as_py() or "")
        chars += len(held[-1])
        if len(held) == TEXTS or chars >= GROUP_CHARS:
            yield start, held
            start, chars, held = i + 1, 0, []
    if held:
        yield start, held


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; one narrow map, no shuffle."""
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path)
        for b in batches:
            for start, texts in groups(b.column("text")):
                ids, at, plain = c.coded(texts)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(texts)), lists, pa.array(plain, pa.string())], names=["doc_id", "ids", "decoded"])

    return spread(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")).mapInArrow(task, RESULT)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
