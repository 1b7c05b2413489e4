"""Relational core: repository scans, paging, file checks, index maintenance and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators import documents as D
from colloquy.plans.registry import query
from colloquy.sources.store import scratch
from colloquy.sources.tables import table
from colloquy.streaming import events as E

CHILDREN = """
SELECT c.c_custkey AS id, c.c_name AS name, coalesce(o.n, 0)::BIGINT AS n_items, coalesce(o.total, 0)::DOUBLE AS total
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
"""


@query("s1_meetings_with_children", CHILDREN)
def s1(spark, d):
    """Parents with their children, aggregated before the join so nothing fans out."""
    kids = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = table(spark, d, "customer")
    j = c.join(kids, c.c_custkey == kids.o_custkey, "left")
    return j.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("total", F.lit(0.0)).alias("total")).orderBy(F.desc("id"))


@query("s2_meeting_by_id", "SELECT o_orderkey AS id, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 100")
def s2(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 100").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")


@query("s3_meetings_since", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def s3(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") > F.to_timestamp(F.lit("1998-01-01 00:00:00")))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), "id")


@query("s4_count_meetings", "SELECT count(*) AS n FROM orders")
def s4(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


@query("s5_meeting_ids", "SELECT o_orderkey AS id FROM orders")
def s5(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))


@query("s6_children_by_key", "SELECT l_orderkey AS meeting_id, l_linenumber AS item_no, l_quantity AS quantity FROM lineitem WHERE l_orderkey = 7")
def s6(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey = 7").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("item_no"), F.col("l_quantity").alias("quantity"))


@query("s11_indexed_hashes", "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE lang = 'fr'")
def s11(spark, d):
    return table(spark, d, "documents").where("lang = 'fr'").select(F.sha2("text", 256).alias("content_hash")).distinct()


@query("s12_collection_counts", "SELECT lang, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM documents GROUP BY lang")
def s12(spark, d):
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))


@query("p9_metadata_filters", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'")
def p9(spark, d):
    return table(spark, d, "documents").where((F.col("lang") == "en") & (F.col("source") == "src3")).select("doc_id")


@query("p11_date_window", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate IS NULL OR o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-31'")
def p11(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").where(at.isNull() | at.between(F.to_timestamp(F.lit("1995-03-01")), F.to_timestamp(F.lit("1995-03-31")))).select(F.col("o_orderkey").alias("id"))


@query(
    "j5_result_lookup",
    "SELECT l_orderkey, l_linenumber, o_orderdate AS created_at FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
)
def j5(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("created_at"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "created_at")


@query("a10_child_counts", "SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a10(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(n, o.id == n.l_orderkey, "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("a15_latency_stats", "SELECT event_type, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY 1")
def a15(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"))


@query("o5_newest_first", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 50")
def o5(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return top.select(F.col("o_orderkey").alias("id"), F.row_number().over(W.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("rank"))


@query("o6_page_with_total", "SELECT c_custkey AS id, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def o6(spark, d):
    c = table(spark, d, "customer")
    total = c.agg(F.count("*").alias("total"))
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select(F.col("c_custkey").alias("id")).join(F.broadcast(total))


@query("u1_union_sources", "SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def u1(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name")))


@query("u5_j7_not_indexed", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def u5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("m").alias("meeting_id"), F.sha2("text", 256).alias("content_hash"))
    return D.not_indexed(docs, docs.where("doc_id % 2 = 0")).select("doc_id")


@query("k2_upsert", "SELECT doc_id, CASE WHEN doc_id < 100 THEN 1 ELSE 0 END AS version FROM documents")
def k2(spark, d):
    ids = table(spark, d, "documents").select("doc_id")
    return D.upsert(ids.withColumn("version", F.lit(0)), ids.where("doc_id < 100").withColumn("version", F.lit(1)), "doc_id")


@query("k3_delete_meeting", "SELECT l_orderkey AS meeting_id, l_linenumber, (SELECT count(*) FROM lineitem WHERE l_orderkey = 3) AS deleted FROM lineitem WHERE l_orderkey <> 3")
def k3(spark, d):
    """What is left, beside the number of rows that went (``k2_k3_vector_table`` does it to a stored table)."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), "l_linenumber")
    return D.delete_meeting(rows, 3).join(F.broadcast(rows.where("meeting_id = 3").agg(F.count("*").alias("deleted"))))


@query("k7_item_table", "SELECT rpad(p_name, (SELECT max(length(p_name)) FROM part)::INT, ' ') || ' | ' || p_brand AS line FROM part")
def k7(spark, d):
    p = table(spark, d, "part")
    width = p.agg(F.max(F.length("p_name")).alias("w"))  # one row
    return p.join(F.broadcast(width)).select(F.concat(F.rpad("p_name", F.col("w"), F.lit(" ")), F.lit(" | "), "p_brand").alias("line"))


@query("k8_json_rows", "SELECT to_json({'id': n_nationkey, 'name': n_name})::VARCHAR AS body FROM nation")
def k8(spark, d):
    return table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("body"))


@query("f15_chunk_ids", "SELECT conv_id::VARCHAR || '__transcript__' || turn::VARCHAR AS chunk_id, sha256(text) AS content_hash FROM conversations")
def f15(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("__", F.col("conv_id").cast("string"), F.lit("transcript"), F.col("turn").cast("string")).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))


#: ISO strings of all orders: naive, of another zone, of UTC, days alone; and what isn't a date.
ISO_STRINGS = {0: "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", 1: "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00'", 2: "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z'", 3: "strftime(o_orderdate, '%Y-%m-%d')", 4: "o_orderpriority"}


@query(
    "f33_date_parsing",
    f"SELECT o_orderkey AS id, CASE o_orderkey % 5 {' '.join(f'WHEN {k} THEN {v}' for k, v in ISO_STRINGS.items())} END AS iso, CASE o_orderkey % 5 WHEN 1 THEN o_orderdate - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', o_orderdate) WHEN 4 THEN NULL ELSE o_orderdate END AS parsed, o_orderkey % 5 = 4 AS bad FROM orders",
)
def f33(spark, d):
    """Strings of all orders are parsed; what has no zone is UTC."""
    k = F.col("o_orderkey") % 5
    day, time = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(k == 0, time).when(k == 1, F.concat(time, F.lit("+02:00"))).when(k == 2, F.concat(time, F.lit("Z"))).when(k == 3, day).otherwise(F.col("o_orderpriority"))
    parsed = F.try_to_timestamp("iso")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), iso.alias("iso")).select("id", "iso", parsed.alias("parsed"), parsed.isNull().alias("bad"))


TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL '30 minutes' AS s_end, count(*) AS n FROM s GROUP BY user_id, k"""


@query("x_stream_tumbling", TUMBLING)
def tumbling(spark, d):
    return E.windowed(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("x_stream_sessions", SESSIONS)
def sessions(spark, d):
    return E.sessions(table(spark, d, "events"), "30 minutes")


#: Windows that the watermark has passed when all events are in.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def live(spark, d, through):
    """What ``through`` makes of the events as a stream: they come in four parts, in order."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.fed(e, through, scratch(spark, "stream")).rows


@query("x_stream_tumbling_live", f"SELECT * FROM ({TUMBLING}) WHERE w_start + INTERVAL 1 HOUR <= {CLOSED}")
def tumbling_live(spark, d):
    """The same windows, read as a stream and written once each."""
    return live(spark, d, lambda e: E.windowed(e, "1 hour")).withColumn("total", F.round("total", 4))


@query("x_stream_sessions_live", f"SELECT * FROM ({SESSIONS}) WHERE s_end <= {CLOSED}")
def sessions_live(spark, d):
    """The same sessions, read as a stream and written once each."""
    return live(spark, d, lambda e: E.sessions(e, "30 minutes"))


SLIDING = "SELECT w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest(range(time_bucket(INTERVAL '15 minutes', ts) - INTERVAL 45 MINUTE, ts + INTERVAL 1 MICROSECOND, INTERVAL 15 MINUTE)) AS w_start FROM events) GROUP BY 1, 2"


@query("x_stream_sliding", SLIDING)
def sliding(spark, d):
    return E.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "15 minutes").withColumn("total", F.round("total", 4))


@query("x_stream_sliding_live", f"SELECT * FROM ({SLIDING}) WHERE w_start + INTERVAL 1 HOUR <= {CLOSED}")
def sliding_live(spark, d):
    return live(spark, d, lambda e: E.windowed(e, "1 hour", "15 minutes")).withColumn("total", F.round("total", 4))
