"""Vector core queries over the embeddings table; labels are source types and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import vectors as V
from colloquy.operators import clustering as C
from colloquy.operators import inverted as I
from colloquy.operators import search as S
from colloquy.plans.registry import query
from colloquy.sources.store import scratch
from colloquy.sources.tables import spread, table
from colloquy.streaming import events as E
from colloquy.streaming.speakers import clustered

QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SIM = f"list_cosine_similarity(embedding::DOUBLE[], {QV})"


def embeddings(spark, d):
    return table(spark, d, "embeddings")


def query_vector(spark, d) -> list[float]:
    """The request's vector, as a service would get it from its model."""
    return list(embeddings(spark, d).where("vec_id = 0").first()["embedding"])


def as_index(spark, d):
    e = embeddings(spark, d)
    return e.select("vec_id", F.col("vec_id").alias("chunk_id"), "embedding", "label", (F.col("vec_id") % 200).alias("meeting_id"), F.concat(F.lit("type"), (F.col("label") % 4).cast("string")).alias("source_type"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))


@query("f16_cosine", f"SELECT vec_id, round({SIM}, 6) AS sim FROM embeddings")
def f16(spark, d):
    return embeddings(spark, d).select("vec_id", F.round(V.cosine(F.col("embedding"), V.literal(query_vector(spark, d))), 6).alias("sim"))


@query("f18_unit_vectors", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS sq, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS u1 FROM embeddings")
def f18(spark, d):
    e = F.col("embedding")
    return embeddings(spark, d).select("vec_id", F.round(V.dot(e, e), 4).alias("sq"), F.round(V.unit(e)[0], 6).alias("u1"))


@query("o1_f17_top_k", f"SELECT vec_id, round(greatest(0, least(1, {SIM})), 6) AS relevance FROM embeddings ORDER BY 1 - {SIM}, vec_id LIMIT 25")
def o1(spark, d):
    return S.top_k(embeddings(spark, d), query_vector(spark, d), 25, id_col="vec_id").select("vec_id", F.round("relevance", 6).alias("relevance"))


FOUND = f"""found AS (SELECT vec_id, vec_id % 200 AS meeting_id, 'type' || (label % 4) AS source_type, 'text ' || vec_id AS text, {SIM} AS sim FROM embeddings WHERE label % 4 = 1 ORDER BY 1 - {SIM}, vec_id LIMIT 40)"""


@query(
    "x14_semantic_search",
    f"WITH {FOUND} SELECT vec_id, f.meeting_id, round(greatest(0, least(1, sim)), 6) AS relevance FROM found f LEFT JOIN orders ON o_orderkey = f.meeting_id WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1995-01-01'",
)
def x14(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").alias("created_at"))
    import datetime

    found = S.search(as_index(spark, d), query_vector(spark, d), 40, F.col("source_type") == "type1", o, date_from=datetime.datetime(1995, 1, 1))
    return found.select("vec_id", "meeting_id", F.round("relevance", 6).alias("relevance"))


@query(
    "x15_a13_f19_context",
    f"""WITH {FOUND}, r AS (SELECT *, row_number() OVER (ORDER BY greatest(0, least(1, sim)) DESC, 1 - sim, vec_id) AS k FROM found)
SELECT string_agg('[Excerpt ' || k || ' | Meeting: ' || meeting_id || ' | Type: ' || source_type || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS context, count(*)::INT AS n_sources FROM r""",
)
def x15(spark, d):
    found = S.search(as_index(spark, d).withColumn("meeting_id", F.col("meeting_id").cast("string")), query_vector(spark, d), 40, F.col("source_type") == "type1")
    return S.context(found).select("context", "n_sources")


CENT = """p AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM {0}),
m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY ALL), c0 AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
cent AS (SELECT label, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM c0)"""


@query("a8_centroids", f"WITH {CENT.format('embeddings')} SELECT label, round(v[1], 6) AS c1, round(v[64], 6) AS c64 FROM cent")
def a8(spark, d):
    return S.centroids(embeddings(spark, d)).select("label", F.round(F.col("centroid")[0], 6).alias("c1"), F.round(F.col("centroid")[63], 6).alias("c64"))


@query("a9_cluster_sizes", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n FROM n WHERE n >= 45 OR ((SELECT max(n) FROM n) < 45 AND label = (SELECT arg_max(label, n) FROM n))")
def a9(spark, d):
    return S.cluster_sizes(embeddings(spark, d), 45)


NEAREST = "SELECT e.vec_id, cent.label, round(list_cosine_similarity(e.embedding::DOUBLE[], cent.v), 6) AS similarity FROM {0} e, cent QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], cent.v) DESC, cent.label) = 1"


@query("j10_nearest_centroid", f"WITH {CENT.format('embeddings')} {NEAREST.format('embeddings')}")
def j10(spark, d):
    e = embeddings(spark, d)
    return S.nearest_centroid(e, S.centroids(e)).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(
    "x5_prune_satellites",
    f"WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), st AS (SELECT * FROM embeddings WHERE label IN (SELECT label FROM n WHERE n >= 55)), mv AS (SELECT * FROM embeddings WHERE label NOT IN (SELECT label FROM n WHERE n >= 55)), {CENT.format('st')}, q AS ({NEAREST.format('mv')}) SELECT vec_id, label FROM st UNION ALL SELECT vec_id, label FROM q",
)
def x5(spark, d):
    return S.prune_satellites(embeddings(spark, d), 55)


J9 = "SELECT q.vec_id AS q_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) <= {0}"


@query("j9_vector_join", J9.format(3))
def j9(spark, d):
    """Every row whose id is divisible by 50 against all vectors, in blocks."""
    e = embeddings(spark, d).select("vec_id", "embedding")
    return S.nearest_vectors(e.where("vec_id % 50 = 0"), e, 3)


@query("j9_inverted_file_exact", J9.format(10))
def j9_inverted_exact(spark, d):
    """The same by an inverted file: the nearest cells, then all others that may hold one as near."""
    e = embeddings(spark, d).select("vec_id", "embedding")
    return I.built(e).nearest(e.where("vec_id % 50 = 0"), 10, exact=True)


@query("j9_inverted_file")
def j9_inverted(spark, d):
    """The same in the nearest cells alone; a test holds the recall against the whole scan."""
    e = embeddings(spark, d).select("vec_id", "embedding")
    return I.built(e).nearest(e.where("vec_id % 50 = 0"), 10)


FILTERED = SIM.replace("vec_id = 0", "vec_id = 7")


@query("o1_inverted_file_filtered", f"SELECT vec_id, round(greatest(0, least(1, {FILTERED})), 6) AS relevance FROM embeddings WHERE label % 4 = 1 AND vec_id % 200 < 3 ORDER BY 1 - {FILTERED}, vec_id LIMIT 500")
def o1_inverted(spark, d):
    """One request with filters so narrow that all cells are looked at."""
    e = as_index(spark, d)
    q = list(e.where("vec_id = 7").first()["embedding"])
    found = I.built(e).search(q, 500, (F.col("source_type") == "type1") & (F.col("meeting_id") < 3))
    return found.select("vec_id", F.round("relevance", 6).alias("relevance"))


def meeting_windows(spark, d, rows: int):
    """The vectors as windows of meetings of ``rows`` each, so meetings grow in number with the table."""
    v = F.col("vec_id")
    return embeddings(spark, d).select(F.floor(v / rows).cast("string").alias("meeting_id"), v.alias("idx"), F.timestamp_seconds(v + 1_700_000_000).alias("ts"), "embedding")


@query("x3_x4_x7_cluster_pipeline")
def x7(spark, d):
    return C.cluster_meetings(meeting_windows(spark, d, 100).select("meeting_id", "idx", "embedding"))


@query("x6_sequential_clustering")
def x6(spark, d):
    def one(pdf):
        pdf = pdf.sort_values("idx")
        return pdf[["meeting_id", "idx"]].assign(speaker_id=C.sequential(C.units(np.array(pdf["embedding"].tolist(), float)), ONLINE))

    return meeting_windows(spark, d, 100).drop("ts").groupBy("meeting_id").applyInPandas(one, "meeting_id string, idx long, speaker_id int")


#: Random vectors are far apart: with the default threshold each would be a speaker.
ONLINE = 0.15


@query("x6_stream_clustering")
def x6_stream(spark, d):
    """The same as a stream of four batches; a window long after all others moves the watermark past them. A test holds it against x6."""
    w = spread(meeting_windows(spark, d, 100)).withColumn("embedding", V.unit(F.col("embedding")))
    last = w.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("").alias("meeting_id"), F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("array<double>").alias("embedding"))
    rows = w.unionByName(last.select(w.columns)).where("ts IS NOT NULL")
    kept = lambda stream: stream.where("embedding IS NOT NULL OR idx = -1").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<double>")))
    return E.fed(rows, lambda stream: clustered(kept(stream), ONLINE), scratch(spark, "speakers")).rows.where("idx >= 0")


@query("p13_usable_vectors", "SELECT vec_id FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0")
def p13(spark, d):
    return embeddings(spark, d).where(V.norm(F.col("embedding")) > 0).select("vec_id")
