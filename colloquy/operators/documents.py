"""Chunking, incremental indexing, summaries and word error rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.sources.tables import spread


def packed(units: Column, most: int, sep: str = "\n\n") -> Column:
    """Greedy packing: a chunk grows while its word estimate stays within ``most``.

    The fold is over the units' word counts and keeps where chunks begin; each
    chunk is then joined once.
    """
    counts = F.transform(units, T.n_words)
    state = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(s: Column, n: Column) -> Column:
        at = s["at"] + 1
        fits = (s["n"] == 0) | (((s["n"] + n) * F.lit(1.3)).cast("int") <= most)
        return F.when(fits, F.struct(s["starts"].alias("starts"), (s["n"] + n).alias("n"), at.alias("at"))).otherwise(
            F.struct(F.array_append(s["starts"], at).alias("starts"), n.alias("n"), at.alias("at"))
        )

    starts = F.aggregate(counts, state, step, lambda s: s["starts"])
    return F.when(F.size(units) == 0, F.array().cast("array<string>")).otherwise(
        F.element_at(
            F.transform(
                F.array(F.struct(units.alias("u"), starts.alias("s"))),
                lambda b: F.transform(b["s"], lambda x, i: F.array_join(F.slice(b["u"], x, F.when(i + 1 < F.size(b["s"]), F.get(b["s"], i + 1)).otherwise(F.size(b["u"]) + 1) - x), sep)),
            ),
            1,
        )
    )


def llm_units(text: Column) -> Column:
    """Paragraphs, else lines, else sentences."""
    parts = F.when(F.contains(text, F.lit("\n\n")), F.split(text, "\n\n")).when(F.contains(text, F.lit("\n")), F.split(text, "\n")).otherwise(F.split(text, r"(?<=[.!?])(?U)\s+"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def llm_chunks(text: Column, most: int) -> Column:
    return F.when(T.tokens_by_words(text) <= most, F.array(F.trim(text))).otherwise(packed(llm_units(text), most))


def embedding_units(text: Column) -> Column:
    """Speaker turns; large ones by paragraph, large paragraphs by sentence."""
    stripped = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    full = lambda a: F.filter(F.transform(a, stripped), lambda p: p != "")
    by_sentence = lambda p: F.when(T.tokens_by_length(p) > 100, full(F.split(p, r"(?<=[.!?])(?U)\s+"))).otherwise(F.array(p))
    by_paragraph = lambda s: F.when(T.tokens_by_length(s) > 150, F.flatten(F.transform(full(F.split(s, r"\n{2,}")), by_sentence))).otherwise(F.array(s))
    return F.flatten(F.transform(full(F.split(text, r"(?=\n[A-Za-z0-9 _\-]+:|\n\[[^\]]+\])")), by_paragraph))


def embedding_chunks(text: Column, most: int = 300, overlap: int = 50) -> Column:
    """Packing with carried-over trailing units of at most ``overlap`` tokens.

    The fold is over the units' (characters, words), from which the estimate of a
    joined text follows; it keeps each chunk's first unit and last, and the texts
    are joined once at the end. Only the carried units are looked at again.
    """
    none = F.array().cast("array<string>")
    estimate = lambda chars, words: F.greatest(F.floor(chars / 4).cast("int"), words)

    def carried(sizes: Column, start: Column, last: Column) -> Column:
        """First unit of the longest tail of start..last within ``overlap`` tokens; last + 1 if there is none."""
        state = F.struct(F.lit(0).alias("size"), (last + 1).alias("first"), F.lit(True).alias("open"))

        def back(s: Column, i: Column) -> Column:
            u = F.element_at(sizes, i)
            size = s["size"] + estimate(u["c"], u["w"])
            return F.when(s["open"] & (size <= overlap), F.struct(size.alias("size"), i.alias("first"), F.lit(True).alias("open"))).otherwise(
                F.struct(s["size"].alias("size"), s["first"].alias("first"), F.lit(False).alias("open"))
            )

        # a tail holds a unit of one token at least for each token, so it has no more than ``overlap`` units
        tail = F.sequence(last, F.greatest(start, last - overlap), F.lit(-1))
        return F.aggregate(tail, state, back, lambda s: s["first"])

    def chunks(units: Column) -> Column:
        sized = F.transform(units, lambda u: F.struct(F.char_length(u).alias("c"), T.n_words(u).alias("w")))
        return bound(F.struct(units.alias("u"), sized.alias("z")), folded)

    def folded(b: Column) -> Column:
        state = F.struct(F.lit(1).alias("start"), F.lit(0).alias("c"), F.lit(0).alias("w"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))

        def step(s: Column, i: Column) -> Column:
            u = F.element_at(b["z"], i)
            empty = s["start"] == i
            c, w = F.when(empty, u["c"]).otherwise(s["c"] + 2 + u["c"]), s["w"] + u["w"]
            full = F.struct(s["start"].alias("start"), c.alias("c"), w.alias("w"), s["done"].alias("done"))

            def cut(start: Column) -> Column:
                kept = F.slice(b["z"], start, i - start + 1)
                chars = F.aggregate(kept, F.lit(-2), lambda t, x: t + x["c"] + 2)
                words = F.aggregate(kept, F.lit(0), lambda t, x: t + x["w"])
                return F.struct(start.alias("start"), chars.alias("c"), words.alias("w"), F.array_append(s["done"], F.struct(s["start"].alias("a"), (i - 1).alias("b"))).alias("done"))

            return F.when(empty | (estimate(c, w) <= most), full).otherwise(bound(carried(b["z"], s["start"], i - 1), cut))

        n = F.size(b["u"])
        spans = F.aggregate(F.sequence(F.lit(1), n), state, step, lambda s: F.array_append(s["done"], F.struct(s["start"].alias("a"), n.alias("b"))))
        return F.transform(spans, lambda x: F.array_join(F.slice(b["u"], x["a"], x["b"] - x["a"] + 1), "\n\n"))

    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    units = embedding_units(text)
    return F.when(F.coalesce(whole, F.lit("")) == "", none).when(T.tokens_by_length(whole) <= most, F.array(whole)).otherwise(chunks(units))


def chunk_meetings(meetings: DataFrame, most: int = 300, overlap: int = 50) -> DataFrame:
    """Chunks of all four source types; texts are packed, decisions and tasks are one each."""

    def rows(source: str, chunks: Column) -> DataFrame:
        return meetings.select("meeting_id", F.lit(source).alias("source_type"), F.posexplode(chunks).alias("chunk_index", "text"))

    out = rows("transcript", embedding_chunks(F.col("transcript"), most, overlap))
    for source, col in (("summary", embedding_chunks(F.col("summary"), most, overlap)), ("decision", F.col("decisions")), ("action_item", F.col("tasks"))):
        out = out.unionByName(rows(source, col))
    out = out.where(F.trim("text") != "")
    return out.withColumn("content_hash", T.content_hash(F.col("text"))).withColumn("chunk_id", F.concat_ws("__", "meeting_id", "source_type", F.col("chunk_index").cast("string")))


def not_indexed(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """New or changed chunks of each meeting; equal texts within one batch all stay."""
    return chunks.join(index.select("meeting_id", "content_hash").distinct(), ["meeting_id", "content_hash"], "left_anti")


def upsert(index: DataFrame, fresh: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """``index`` with the ``fresh`` rows in place of those of their keys; of fresh rows with one key the last by ``order`` stays, else that of the greatest hash."""
    rest = F.xxhash64(*[c for c, t in fresh.dtypes if not t.startswith("map")])
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order) if order else F.desc(rest), F.desc(rest)))
    once = fresh.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return index.join(once.select(key), key, "left_anti").unionByName(once)


def delete_meeting(index: DataFrame, meeting_id: str) -> DataFrame:
    return index.where(~F.col("meeting_id").eqNullSafe(F.lit(meeting_id)))


def index_counts(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Per meeting: chunks indexed and skipped."""
    known = index.select("meeting_id", "content_hash", F.lit(True).alias("known")).distinct()
    j = chunks.join(known, ["meeting_id", "content_hash"], "left")
    return j.groupBy("meeting_id").agg(F.count_if(F.col("known").isNull()).alias("indexed"), F.count_if(F.col("known").isNotNull()).alias("skipped"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, where a lambda reads it more often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def placed_sentences(text: Column, substantive: bool = True) -> Column:
    """Array of (pos, sentence) of one text."""
    every = F.transform(T.sentences(text), lambda s, i: F.struct(i.alias("pos"), s.alias("sentence")))
    return F.filter(every, lambda x: T.is_substantive(x["sentence"])) if substantive else every


def sentence_rows(docs: DataFrame, key: str = "doc_id", substantive: bool = True) -> DataFrame:
    return docs.select(key, F.explode(placed_sentences(F.col("text"), substantive)).alias("x")).select(key, "x.pos", "x.sentence")


def scores_of(words: pa.ListArray) -> list[np.ndarray]:
    """Scores of the sentences (arrays of words) of each text: tf/max tf * ln((N+1)/(df+1)) over word occurrences, by length ** 0.3; no word: 0."""
    sents = words.flatten()
    flat = sents.flatten()
    per_doc, per_sent = np.diff(words.offsets.to_numpy()), np.diff(sents.offsets.to_numpy())
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    sent = np.repeat(np.arange(len(per_sent)), per_sent)
    score = np.zeros(len(per_sent))
    if len(flat):
        _, code = np.unique(flat.to_numpy(), return_inverse=True)
        size = code.max() + 1
        term, at, tf = np.unique(doc_of[sent] * size + code, return_inverse=True, return_counts=True)
        once = np.unique(sent * size + code)
        df = np.bincount(np.searchsorted(term, doc_of[once // size] * size + once % size), minlength=len(term))
        top = np.zeros(len(per_doc), np.int64)
        np.maximum.at(top, term // size, tf)
        weight = tf / top[term // size] * np.log((per_doc[term // size] + 1) / (df + 1))
        summed = np.bincount(sent, weights=weight[at], minlength=len(per_sent))
        score = np.divide(summed, per_sent**0.3, out=score, where=per_sent > 0)
    return np.split(score, np.cumsum(per_doc)[:-1]) if len(per_doc) else []


def scored_sentences(docs: DataFrame, key: str = "doc_id", substantive: bool = True, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, ss): each text's sentences as an array of (pos, sentence, score); given ``topics``, an array of the sentences' topics as well.

    A score lives within one text, so this is one map without a shuffle by word:
    words are split on the JVM, counted in Arrow batches. A sentence's words are split
    once, for its score and its topic.
    """
    d = spread(docs).select(F.col(key), placed_sentences(F.col("text"), substantive).alias("ss"))
    d = d.withColumn("ss", F.coalesce("ss", F.array().cast("array<struct<pos:int,sentence:string>>")))
    # words count only as equal or not, so they travel as 64-bit hashes
    d = d.withColumn("said", F.transform("ss", lambda x: T.letter_words(x["sentence"])))
    more = ["topics"] if topics else []
    d = d.select(key, "ss", F.transform("said", lambda ws: F.transform(T.scoring(ws), lambda w: F.xxhash64(w))).alias("words"), *[F.transform("said", lambda ws: topic_among(ws, topics)).alias(n) for n in more])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pa.array(x) for x in scores_of(b.column("words"))]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            scores = pa.ListArray.from_arrays(offsets, pa.concat_arrays([pa.array([], pa.float64()), *found]))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("ss"), scores, *[b.column(n) for n in more]], names=[key, "ss", "scores", *more])

    out = d.mapInArrow(task, f"`{key}` {dict(docs.dtypes)[key]}, ss array<struct<pos:int,sentence:string>>, scores array<double>" + "".join(f", {n} array<string>" for n in more))
    return out.select(key, F.zip_with("ss", "scores", lambda x, y: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"), y.alias("score"))).alias("ss"), *more)


def overview(ss: Column, k: int = 3) -> Column:
    """The best sentences (ties: earlier) in document order; null if there is none."""
    ranked = F.array_sort(F.transform(ss, lambda x: F.struct((-F.round(x["score"], 9)).alias("r"), x["pos"].alias("pos"), x["sentence"].alias("sentence"))))
    best = F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"))))
    return F.when(F.size(ss) > 0, F.array_join(F.transform(best, lambda x: T.clean_sentence(x["sentence"])), " "))


def first_distinct(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The first ``k`` different values of each key, by position."""
    once = rows.groupBy(key, value).agg(F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("pos"))).where(F.col("rank") <= k)


# The topics of meetings with their keywords.
MEETING_TOPICS = {
    "Project Planning & Roadmap": "project plan roadmap kickoff milestone phase agenda scope objective timeline schedule deliverable goals".split(),
    "Design & User Interface": "design ui ux interface wireframe prototype layout look feel colors buttons screen frontend style".split(),
    "Budget & Financials": "budget cost price expense financial fund money dollar allocation estimate pricing resources".split(),
    "Technical Architecture & Development": "code database backend api server architecture system module data software hardware tool integration infrastructure".split(),
    "Testing, Quality & Review": "test testing qa review feedback bug issue verify validation performance check assessment evaluation".split(),
    "Marketing & Client Requirements": "market marketing client customer user requirement sales presentation demo release launch competitor".split(),
}
#: The group of what has no topic.
OTHERS = "General Discussion & Collaboration"


def topic_among(words: Column, topics: dict[str, list[str]]) -> Column:
    """The topic that shares most keywords with the words; the first wins ties; else null."""

    def best(ws: Column) -> Column:
        hits = F.array(*[F.size(F.array_intersect(ws, F.array(*[F.lit(k) for k in ks]))) for ks in topics.values()])
        names = F.array(*[F.lit(t) for t in topics])
        return F.when(F.size(ws) > 0, bound(hits, lambda h: F.when(F.array_max(h) > 0, F.get(names, (F.array_position(h, F.array_max(h)) - 1).cast("int")))))

    every = F.array(*[F.lit(k) for k in sorted({k for ks in topics.values() for k in ks})])
    return bound(F.array_intersect(words, every), best)


def topic_of(sentence: Column, topics: dict[str, list[str]]) -> Column:
    return topic_among(T.letter_words(sentence), topics)


def topic_groups(points: Column, others: str, k: int = 3) -> Column:
    """Array of (topic, points) of (topic, point) in order: topics by their first point, ``k`` different points each.

    What has no topic is the last group, and only if fewer than two topics matched.
    """

    def grouped(ps: Column) -> Column:
        of = lambda same: F.slice(F.array_distinct(F.transform(F.filter(ps, same), lambda x: x["point"])), 1, k)
        group = lambda t: F.struct(t.alias("topic"), of(lambda x: x["topic"] == t).alias("points"))
        rest = F.array(F.struct(F.lit(others).alias("topic"), of(lambda x: x["topic"].isNull()).alias("points")))
        left = lambda names: (F.size(names) < 2) & F.exists(ps, lambda x: x["topic"].isNull())
        names = F.array_distinct(F.filter(F.transform(ps, lambda x: x["topic"]), lambda t: t.isNotNull()))
        return bound(names, lambda ns: F.when(left(ns), F.concat(F.transform(ns, group), rest)).otherwise(F.transform(ns, group)))

    return bound(points, grouped)


def topic_point(sentence: Column, topic: Column) -> Column:
    return F.struct(topic.alias("topic"), T.clean_sentence(sentence).alias("point"))


def grouped_points(docs: DataFrame, topics: dict[str, list[str]] = MEETING_TOPICS, key: str = "doc_id", others: str = OTHERS) -> DataFrame:
    """(key, place, topic, rank, point): the topic groups of ``summary`` as rows, without the rest of it; nothing is scored."""
    points = F.transform(placed_sentences(F.col("text")), lambda x: topic_point(x["sentence"], topic_of(x["sentence"], topics)))
    row = lambda g, place: lambda p, rank: F.struct(place.alias("place"), g["topic"].alias("topic"), rank.alias("rank"), p.alias("point"))
    rows = F.flatten(F.transform(topic_groups(points, others), lambda g, i: F.transform(g["points"], row(g, i))))
    # not a column of its own: Spark would first look whether it is empty, and compute it again for that
    return spread(docs).select(key, F.inline(rows))


def summary(docs: DataFrame, topics: dict[str, list[str]] = MEETING_TOPICS, key: str = "doc_id", others: str = OTHERS) -> DataFrame:
    """Overview, topic groups, action items, deadlines and counts of the substantive sentences of each text.

    Topics come in order of their first sentence; what has none is a group only if
    fewer than two topics matched. A text without a substantive sentence has no
    overview and empty lists. Each text is split once, and all parts are array
    functions in its row: no shuffle.
    """
    words = docs.select(F.struct(F.col(key), T.n_words(F.coalesce("text", F.lit(""))).alias("n_words")).alias(key), "text")
    s = scored_sentences(words, key, topics=topics).select(f"{key}.{key}", f"{key}.n_words", "ss", "topics")
    # no array is read by place in another: Spark may put the array's expression there, and compute it once a sentence
    points = F.zip_with("ss", "topics", lambda x, t: topic_point(x["sentence"], t))
    listed = lambda test, k: F.slice(F.array_distinct(F.transform(F.filter("ss", lambda x: test(x["sentence"])), lambda x: T.clean_sentence(x["sentence"]))), 1, k)
    none = F.size("ss") == 0
    minutes = lambda per: F.when(none, 0).otherwise(F.ceil(F.col("n_words") / per)).cast("int")
    return s.select(
        key, F.when(none, 0).otherwise(F.col("n_words")).alias("n_words"), overview(F.col("ss")).alias("overview"),
        topic_groups(points, others).alias("topic_groups"), listed(T.is_action, 8).alias("action_items"), listed(T.has_deadline, 6).alias("deadlines"),
        F.size("ss").cast("long").alias("n_sentences"), minutes(180).alias("read_min"), minutes(130).alias("talk_min"),
    )


#: Cells of a diagonal that are computed together.
EDIT_CELLS = 1 << 19


def edit_counts(refs: pa.ListArray, hyps: pa.ListArray) -> np.ndarray:
    """(pairs, 3) substitutions, deletions and insertions of a shortest word edit script of each pair.

    Pairs of like length are one program: the cells of one antidiagonal depend on the
    two before it alone, so all pairs' diagonals are one numpy step. What is padded
    lies beyond a pair's last cell and is never looked at. Of equally short scripts the
    one that keeps or replaces is preferred, then the one that deletes, then the one that inserts.
    """
    n, m = (x.value_lengths().to_numpy().astype(np.int64) for x in (refs, hyps))
    codes = pa.chunked_array([refs.flatten(), hyps.flatten()]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n) - n, n.sum() + np.cumsum(m) - m
    out, order = np.zeros((len(n), 3), np.int64), np.lexsort((m, n))
    at = 0
    while at < len(order):
        high = n[order[at:]] + 1  # ascending: the last of a slice is its widest
        fits = np.flatnonzero(high * np.arange(1, len(high) + 1) > EDIT_CELLS)
        end = at + max(1, fits[0] if len(fits) else len(high))
        some = order[at:end]
        padded = [np.where(np.arange(max(1, k[some].max())) < k[some, None], codes[np.minimum(s[some, None] + np.arange(max(1, k[some].max())), len(codes) - 1)] if len(codes) else 0, -1) for k, s in zip((n, m), starts, strict=True)]
        out[some] = edit_diagonals(*padded, n[some], m[some])
        at = end
    return out


def edit_diagonals(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit counts of rows of word numbers ``a`` and ``b``, padded beyond the lengths ``n`` and ``m``."""
    pairs, wide, tall = len(n), int(n.max()), int(m.max())
    far = np.iinfo(np.int32).max // 2
    # rows: cost, substitutions, deletions, insertions; column i: the cell of i reference words on the diagonal
    before, last = np.full((4, pairs, wide + 1), far, np.int32), np.full((4, pairs, wide + 1), far, np.int32)
    last[:, :, 0] = 0
    out = np.zeros((pairs, 3), np.int64)
    total = n + m
    for d in range(1, wide + tall + 1):
        now = np.full((4, pairs, wide + 1), far, np.int32)
        if d <= tall:  # no reference word: all inserted
            now[:, :, 0] = np.array([d, 0, 0, d])[:, None]
        if d <= wide:  # no word of the other: all deleted
            now[:, :, d] = np.array([d, 0, d, 0])[:, None]
        low, high = max(1, d - tall), min(wide, d - 1)
        if low <= high:
            i = np.arange(low, high + 1)
            differ = (a[:, i - 1] != b[:, d - i - 1]).astype(np.int32)
            keep, gone, new = before[:, :, low - 1 : high].copy(), last[:, :, low - 1 : high].copy(), last[:, :, low : high + 1].copy()
            keep[:2] += differ
            gone[[0, 2]] += 1
            new[[0, 3]] += 1
            now[:, :, low : high + 1] = np.where(keep[0] <= np.minimum(gone[0], new[0]), keep, np.where(gone[0] <= new[0], gone, new))
        ended = np.flatnonzero(total == d)
        out[ended] = now[1:, ended, n[ended]].T
        before, last = last, now
    return out


def edit_struct(ref: Column, hyp: Column) -> Column:
    """(s, d, i) for two arrays of words, in Arrow batches."""

    def task(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        found = edit_counts(refs, hyps).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["s", "d", "i"])

    return F.arrow_udf(task, "s int, d int, i int")(ref, hyp)


def word_error_rate(pairs: DataFrame, ref: str = "reference", hyp: str = "hypothesis", passes: float = 90.0, normal: bool = True) -> DataFrame:
    """Adds ref_words, hyp_words, substitutions, deletions, insertions, edits, wer (4 places), accuracy (2 places) and passed.

    ``normal=False`` only folds case, as a quick script would, and leaves punctuation in place.
    """
    fold = T.transcript_normal if normal else F.lower
    r, h = (T.words(fold(F.coalesce(F.col(c), F.lit("")))) for c in (ref, hyp))
    p = spread(pairs).withColumn("_r", r).withColumn("_h", h).withColumn("ref_words", F.size("_r")).withColumn("hyp_words", F.size("_h"))
    p = p.withColumn("_e", edit_struct(F.col("_r"), F.col("_h")))
    p = p.withColumn("substitutions", F.col("_e.s")).withColumn("deletions", F.col("_e.d")).withColumn("insertions", F.col("_e.i")).withColumn("edits", F.col("_e.s") + F.col("_e.d") + F.col("_e.i"))
    wer = F.when((F.col("ref_words") == 0) & (F.col("hyp_words") == 0), 0.0).when(F.col("ref_words") == 0, 1.0).otherwise(F.col("edits") / F.col("ref_words"))
    acc = F.greatest(F.lit(0.0), (1 - F.col("_w")) * 100)
    return p.withColumn("_w", wer).withColumn("wer", F.bround("_w", 4)).withColumn("accuracy", F.bround(acc, 2)).withColumn("passed", acc >= passes).drop("_r", "_h", "_w", "_e")


def evaluation(runs: DataFrame, model: str = "base") -> DataFrame:
    """The evaluation's rows for (recording, duration_sec, reference, hypothesis, error).

    A run that failed (``error``, or no hypothesis) is an ERROR row with a word
    error rate of 1 and no counts; it doesn't end the others.
    """
    bad = F.col("error").isNotNull() | F.col("hypothesis").isNull() | F.col("reference").isNull()
    w = word_error_rate(runs.withColumn("_bad", bad))
    ok = lambda c, other: F.when(F.col("_bad"), F.lit(other)).otherwise(c)
    verdict = F.when(F.col("_bad"), "ERROR").when(F.col("passed"), "PASS").otherwise("FAIL")
    return w.select(
        "recording", F.lit(model).alias("model"), ok(F.bround("duration_sec", 1), 0.0).alias("duration_sec"),
        *[ok(F.col(c), 0).alias(n) for c, n in (("ref_words", "ref_words"), ("hyp_words", "gen_words"), ("substitutions", "substitutions"), ("deletions", "deletions"), ("insertions", "insertions"))],
        ok(F.col("wer"), 1.0).alias("wer"), ok(F.col("accuracy"), 0.0).alias("accuracy_pct"), verdict.alias("pass_fail"),
        F.when(F.col("_bad"), F.coalesce("error", F.lit("no transcript"))).otherwise("").alias("notes"),
    )


def rollup(evaluated: DataFrame) -> DataFrame:
    """Runs, passed runs and the mean accuracy of all runs of an evaluation."""
    return evaluated.agg(F.count("*").alias("n"), F.count_if(F.col("pass_fail") == "PASS").alias("n_passed"), F.round(F.avg("accuracy_pct"), 3).alias("mean_accuracy"))
