"""Text core: normalising, sentences, scoring, summaries, chunking and word error rate."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import documents as D
from colloquy.plans.registry import query
from colloquy.sources.tables import spread, table

WORDS = r"list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '')"
#: DuckDB rows of sentences: RE2 has no look-behind, so ends are marked first.
SENTS = r"""raw AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM documents),
tr AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))), lambda p: p <> '') AS ss FROM raw),
sents AS (SELECT doc_id, unnest(range(0, len(ss)))::INT AS pos, unnest(ss) AS sentence FROM tr)"""
CLEAN = "upper(substr({0}, 1, 1)) || substr(CASE WHEN regexp_matches({0}, '[.!?]$') THEN {0} ELSE {0} || '.' END, 2)"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
LETTERS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"
SWORDS = rf"list_filter({LETTERS.format('sentence')}, lambda w: length(w) > 2 AND w NOT IN ({STOPS}))"
# Keyword sets with words of the test corpus, so that topics have members.
TOPICS = {"First": ["the", "that", "this"], "Second": ["and", "for", "with"], "Third": ["que", "les", "der", "las"]}

def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("f1_transcript_normal", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+', ' ', 'g')) AS normal FROM documents")
def f1(spark, d):
    return docs(spark, d).select("doc_id", T.transcript_normal(F.col("text")).alias("normal"))


@query("p3_p4_token_estimates", f"SELECT doc_id, floor(len({WORDS}) * 1.3)::INT AS by_words, greatest(length(text) // 4, len({WORDS}))::INT AS by_length FROM documents")
def p3(spark, d):
    return docs(spark, d).select("doc_id", T.tokens_by_words(F.col("text")).alias("by_words"), T.tokens_by_length(F.col("text")).alias("by_length"))


@query("p2_input_guard", f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN len({WORDS}) < 3 THEN 'too short' WHEN floor(len({WORDS}) * 1.3) > 2000 THEN 'too long' ELSE 'ok' END AS verdict FROM documents")
def p2(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.when(F.trim(t) == "", "blank").when(T.n_words(t) < 3, "too short").when(T.tokens_by_words(t) > 2000, "too long").otherwise("ok").alias("verdict"))


@query("f7_f8_sentences", f"WITH {SENTS} SELECT doc_id, pos, {CLEAN.format('sentence')} AS clean FROM sents")
def f7(spark, d):
    return D.sentence_rows(docs(spark, d), substantive=False).select("doc_id", "pos", T.clean_sentence(F.col("sentence")).alias("clean"))


@query("f9_scoring_words", f"WITH {SENTS} SELECT doc_id, pos, len({SWORDS})::INT AS n FROM sents")
def f9(spark, d):
    return D.sentence_rows(docs(spark, d), substantive=False).select("doc_id", "pos", F.size(T.scoring_words(F.col("sentence"))).alias("n"))


TERMS = f"""WITH {SENTS}, w AS (SELECT doc_id, pos, unnest({SWORDS}) AS word FROM sents),
per AS (SELECT doc_id, pos, word, count(*) AS c FROM w GROUP BY ALL), terms AS (SELECT doc_id, word, sum(c) AS tf, count(*) AS df FROM per GROUP BY ALL)"""


@query("a4_term_frequencies", TERMS + " SELECT doc_id, word, tf::BIGINT AS tf, df::BIGINT AS df FROM terms")
def a4(spark, d):
    # texts are shuffled once, and not their words twice: both groupings are within a document
    s = D.sentence_rows(docs(spark, d).repartition("doc_id"), substantive=False)
    per = s.select("doc_id", "pos", F.explode(T.scoring_words(F.col("sentence"))).alias("word")).groupBy("doc_id", "pos", "word").agg(F.count("*").alias("c"))
    return per.groupBy("doc_id", "word").agg(F.sum("c").alias("tf"), F.count("*").alias("df"))


SCORES = TERMS + """, doc AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY 1), top AS (SELECT doc_id, max(tf) AS top FROM terms GROUP BY 1),
sc AS (SELECT doc_id, pos, sum(c * tf / top * ln((n + 1) / (df + 1))) / pow(sum(c), 0.3) AS score FROM per JOIN terms USING (doc_id, word) JOIN doc USING (doc_id) JOIN top USING (doc_id) GROUP BY 1, 2),
scored AS (SELECT doc_id, pos, sentence, coalesce(score, 0) AS score FROM sents LEFT JOIN sc USING (doc_id, pos))"""


@query("a5_sentence_scores", SCORES + " SELECT doc_id, pos, round(score, 6) AS score FROM scored")
def a5(spark, d):
    s = D.scored_sentences(docs(spark, d), substantive=False).select("doc_id", F.explode("ss").alias("x"))
    return s.select("doc_id", "x.pos", F.round("x.score", 6).alias("score"))


@query(
    "o3_x19_overview",
    SCORES + f", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS k FROM scored) SELECT doc_id, string_agg({CLEAN.format('sentence')}, ' ' ORDER BY pos) AS overview FROM r WHERE k <= 3 GROUP BY doc_id",
)
def o3(spark, d):
    return D.scored_sentences(docs(spark, d), substantive=False).select("doc_id", D.overview(F.col("ss")).alias("overview")).where("overview IS NOT NULL")


@query("x19_summary")
def x19(spark, d):
    """The composite, on sentences without small talk."""
    return D.summary(docs(spark, d), TOPICS)


@query("a7_document_stats", f"WITH {SENTS}, n AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY 1) SELECT doc_id, len({WORDS})::INT AS n_words, coalesce(n, 0)::BIGINT AS n_sentences, greatest(1, ceil(len({WORDS}) / 180))::INT AS read_min, greatest(1, ceil(len({WORDS}) / 130))::INT AS talk_min FROM documents LEFT JOIN n USING (doc_id)")
def a7(spark, d):
    n = T.n_words(F.col("text"))
    s = F.size(T.sentences(F.col("text"))).cast("long")
    up = lambda k: F.greatest(F.lit(1), F.ceil(n / k).cast("int"))
    return docs(spark, d).select("doc_id", n.alias("n_words"), s.alias("n_sentences"), up(180).alias("read_min"), up(130).alias("talk_min"))


TOPIC_SQL = (
    f"WITH {SENTS}, k AS (SELECT *, list_distinct({LETTERS.format('sentence')}) AS ws FROM sents), h AS (SELECT doc_id, pos, sentence, "
    + ", ".join(f"len(list_intersect(ws, {v})) AS h{i}" for i, v in enumerate(TOPICS.values()))
    + " FROM k), t AS (SELECT doc_id, pos, sentence, CASE WHEN greatest(h0, h1, h2) = 0 THEN NULL WHEN h0 >= h1 AND h0 >= h2 THEN 'First' WHEN h1 >= h2 THEN 'Second' ELSE 'Third' END AS topic FROM h)"
)


@query("f10_topics", TOPIC_SQL + " SELECT doc_id, pos, topic FROM t")
def f10(spark, d):
    return D.sentence_rows(docs(spark, d), substantive=False).select("doc_id", "pos", D.topic_of(F.col("sentence"), TOPICS).alias("topic"))


@query(
    "a6_o4_topic_points",
    TOPIC_SQL + f", p AS (SELECT doc_id, topic, {CLEAN.format('sentence')} AS point, min(pos) AS pos FROM t WHERE topic IS NOT NULL GROUP BY ALL) SELECT doc_id, topic, point, row_number() OVER (PARTITION BY doc_id, topic ORDER BY pos) AS rank FROM p QUALIFY rank <= 3",
)
def a6(spark, d):
    s = D.sentence_rows(docs(spark, d), substantive=False)
    s = s.select("doc_id", "pos", D.topic_of(F.col("sentence"), TOPICS).alias("topic"), T.clean_sentence(F.col("sentence")).alias("point")).where("topic IS NOT NULL")
    once = s.groupBy("doc_id", "topic", "point").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy("doc_id", "topic").orderBy("pos"))
    return once.withColumn("rank", rank.cast("long")).where("rank <= 3").select("doc_id", "topic", "point", "rank")


@query("w9_first_occurrences", f"WITH {SENTS}, o AS (SELECT doc_id, sentence, min(pos) AS pos FROM sents GROUP BY ALL) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM o QUALIFY rank <= 8")
def w9(spark, d):
    out = D.first_distinct(D.sentence_rows(docs(spark, d), substantive=False), "doc_id", "sentence", 8)
    return out.select("doc_id", "pos", F.col("rank").cast("long").alias("rank"))


@query("u2_keyword_overlap", f"SELECT doc_id, len(list_intersect(['the', 'and', 'que', 'la'], {LETTERS.format('text')}))::INT AS shared FROM documents")
def u2(spark, d):
    keys = F.array(*[F.lit(k) for k in ("the", "and", "que", "la")])
    return docs(spark, d).select("doc_id", F.size(F.array_intersect(keys, T.letter_words(F.col("text")))).alias("shared"))


@query("f14_o8_hash_and_caps", "SELECT doc_id, sha256(text) AS content_hash, CASE WHEN length(text) > 800 THEN left(text, 800) || '...' ELSE text END AS short FROM documents")
def f14(spark, d):
    return docs(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.shortened(F.col("text"), 800).alias("short"))


@query(
    "f2_f4_times",
    """WITH s AS (SELECT event_id AS id, greatest(0, round_even(value * 60, 0))::BIGINT AS s FROM events)
SELECT id, printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS clock, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' END AS duration FROM s""",
)
def f2(spark, d):
    s = F.col("value") * 60
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.clock(s).alias("clock"), T.duration(s).alias("duration"))


@query("f30_html_and_bands", """SELECT page_id, replace(replace(replace(replace(replace(left(html, 600), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe, CASE WHEN (page_id % 10) / 10 >= 0.7 THEN 'high' WHEN (page_id % 10) / 10 >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM pages""")
def f30(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escaped(F.substring("html", 1, 600)).alias("safe"), T.score_band(F.col("page_id") % 10 / 10).alias("band"))


@query(
    "w10_f13_llm_packing",
    r"""WITH RECURSIVE u0 AS (SELECT doc_id, text, list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) WHEN contains(text, chr(10)) THEN string_split(text, chr(10))
  ELSE string_split(regexp_replace(text, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) END, lambda p: trim(p)), lambda p: p <> '') AS us FROM documents),
u AS (SELECT doc_id, us, list_transform(us, lambda x: len(list_filter(regexp_split_to_array(x, '[\s\p{Z}]+'), lambda w: w <> ''))) AS ns FROM u0),
f AS (SELECT doc_id, 1 AS i, ns[1] AS n, 1 AS chunk FROM u WHERE len(us) > 0
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN floor((n + ns[i + 1]) * 1.3) <= 200 THEN n + ns[i + 1] ELSE ns[i + 1] END, CASE WHEN floor((n + ns[i + 1]) * 1.3) <= 200 THEN chunk ELSE chunk + 1 END FROM f JOIN u USING (doc_id) WHERE i < len(ns))
SELECT doc_id, (chunk - 1)::INT AS chunk_no, max(n)::INT AS n_words FROM f GROUP BY ALL""",
)
def w10(spark, d):
    chunks = D.packed(D.llm_units(F.col("text")), 200)
    return spread(docs(spark, d)).select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", T.n_words(F.col("chunk")).alias("n_words"))


@query("w11_x10_embedding_chunks")
def w11(spark, d):
    c = spread(docs(spark, d)).select("doc_id", F.posexplode(D.embedding_chunks(F.col("text"))).alias("chunk_index", "text"))
    return c.select("doc_id", "chunk_index", T.tokens_by_length(F.col("text")).alias("tokens"), T.content_hash(F.col("text")).alias("content_hash"))


@query("x11_a12_index_counts", "SELECT lang AS meeting_id, count(*) FILTER (sha256(text) NOT IN (SELECT sha256(text) FROM documents x WHERE x.doc_id < 500 AND x.lang = documents.lang)) AS indexed, count(*) FILTER (sha256(text) IN (SELECT sha256(text) FROM documents x WHERE x.doc_id < 500 AND x.lang = documents.lang)) AS skipped FROM documents GROUP BY 1")
def x11(spark, d):
    c = table(spark, d, "documents").select(F.col("lang").alias("meeting_id"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    return D.index_counts(c, c.where("doc_id < 500"))


#: Empty texts on either side, equal ones, and ones that differ in a word or two.
EDGES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ', ' || p_type END AS r, CASE WHEN p_partkey % 3 = 0 THEN ' ' WHEN p_partkey % 7 = 0 THEN p_name ELSE upper(p_name) || ' ' || p_type || '!' END AS h FROM part"


@query(
    "f21_f22_word_error_rate",
    f"""WITH e AS ({EDGES}), w AS (SELECT id, CASE WHEN trim(r) = '' THEN 0 ELSE 3 END AS rn, CASE WHEN trim(h) = '' THEN 0 WHEN id % 7 = 0 THEN 2 ELSE 3 END AS hn FROM e),
x AS (SELECT *, abs(rn - hn) AS edits, CASE WHEN rn = 0 AND hn = 0 THEN 0 WHEN rn = 0 THEN 1 ELSE abs(rn - hn) / rn END AS w FROM w)
SELECT id, edits::INT AS edits, round_even(w, 4) AS wer, round_even(greatest(0, (1 - w) * 100), 2) AS accuracy, (1 - w) * 100 >= 90 AS passed FROM x""",
)
def f21(spark, d):
    """The edges of the word error rate: nothing on either side or on one, and equality but for case and marks."""
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    ref = F.when(k % 5 == 0, "").otherwise(F.concat(name, F.lit(", "), kind))
    hyp = F.when(k % 3 == 0, " ").when(k % 7 == 0, name).otherwise(F.concat(F.upper(name), F.lit(" "), kind, F.lit("!")))
    pairs = table(spark, d, "part").select(k.alias("id"), ref.alias("reference"), hyp.alias("hypothesis"))
    return D.word_error_rate(pairs).select("id", "edits", "wer", "accuracy", "passed")
