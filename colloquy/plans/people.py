"""People and structured records, of parts, customers, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import people as P
from colloquy.operators import prefixes as X
from colloquy.operators import records as R
from colloquy.plans.registry import query
from colloquy.sources.tables import fill_prompt, table

#: Names of parts as people: written as transcripts write them, by the part's number.
RAW = """CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN upper(p_name) || ' (Host):' WHEN 3 THEN 'Speaker ' || p_size || ':' WHEN 4 THEN 'speaker ' || p_name
WHEN 5 THEN left(p_name, 1) || '. ' || split_part(p_name, ' ', 2) WHEN 6 THEN chr(9) || '"' || p_name || '",' || chr(10) WHEN 7 THEN CASE WHEN p_size % 2 = 0 THEN '  ' END ELSE p_brand || ' (co-host)' END"""


def name_sql(raw: str) -> str:
    """Normal form of a raw name."""
    word = "CASE WHEN length(w) = 1 OR length(w) = 2 AND ends_with(w, '.') THEN upper(w) WHEN upper(w) = w AND lower(w) <> w AND length(w) <= 3 THEN w ELSE upper(w[1]) || lower(w[2:]) END"
    bare = f"trim(regexp_replace(trim(trim({raw}, ' ' || chr(9) || chr(10)), ':\"''-,'), '\\s*\\((?:Host|Co-host|Presenter|Speaker|Guest|Admin|Moderator)\\)', '', 'gi'), ' ')"
    speaker = f"regexp_extract({bare}, '(?i)^speaker\\s+(\\d+|[A-Z]):?', 1)"
    return f"CASE WHEN trim(coalesce({raw}, '')) = '' THEN 'Unknown' WHEN {speaker} <> '' THEN 'Speaker ' || {speaker} ELSE array_to_string(list_transform(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w <> ''), lambda w: {word}), ' ') END"


def raw_names(spark, d):
    """(p_partkey, raw)."""
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    raw = (
        F.when(k == 0, name).when(k == 1, F.concat(F.lit("  "), name, F.lit(" "))).when(k == 2, F.concat(F.upper(name), F.lit(" (Host):"))).when(k == 3, F.concat(F.lit("Speaker "), F.col("p_size").cast("string"), F.lit(":")))
        .when(k == 4, F.concat(F.lit("speaker "), name)).when(k == 5, F.concat(F.substring(name, 1, 1), F.lit(". "), F.split_part(name, F.lit(" "), F.lit(2)))).when(k == 6, F.concat(F.lit('\t"'), name, F.lit('",\n')))
        .when(k == 7, F.when(F.col("p_size") % 2 == 0, "  ")).otherwise(F.concat("p_brand", F.lit(" (co-host)")))
    )
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"))


@query("f23_names", f"SELECT p_partkey AS id, {name_sql('raw')} AS name FROM (SELECT p_partkey, {RAW} AS raw FROM part)")
def f23(spark, d):
    return raw_names(spark, d).select(F.col("p_partkey").alias("id"), P.normal_name(F.col("raw")).alias("name"))


#: Meetings of eight parts: whole names, first names alone, second names alone, in capitals and with badges.
SAID = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN upper(p_name) WHEN 3 THEN p_name || ' (Host)' ELSE split_part(p_name, ' ', 2) END"
DISTINCT = f"""raw AS (SELECT p_partkey // 8 AS meeting_id, p_partkey AS pos, {SAID} AS raw FROM part WHERE p_partkey % 8 < 5),
nm AS (SELECT meeting_id, pos, {name_sql('raw')} AS name FROM raw), fo AS (SELECT *, lower(name) AS low FROM nm WHERE name <> 'Unknown' QUALIFY row_number() OVER (PARTITION BY meeting_id, lower(name) ORDER BY pos) = 1),
dr AS (SELECT *, name NOT LIKE '% %' AND EXISTS (SELECT 1 FROM fo o WHERE o.meeting_id = fo.meeting_id AND o.name LIKE '% %' AND split_part(o.low, ' ', 1) = fo.low) AS dropped FROM fo),
dn AS (SELECT meeting_id, pos, name FROM dr QUALIFY NOT dropped OR bool_and(dropped) OVER (PARTITION BY meeting_id))"""


def said_names(spark, d):
    """(meeting_id, pos, name) of everybody, as it was said."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    part = lambda i: F.split_part(name, F.lit(" "), F.lit(i))
    said = F.when(k == 0, name).when(k == 1, part(1)).when(k == 2, F.upper(name)).when(k == 3, F.concat(name, F.lit(" (Host)"))).otherwise(part(2))
    return table(spark, d, "part").select(F.floor(F.col("p_partkey") / 8).cast("long").alias("meeting_id"), F.col("p_partkey").alias("pos"), said.alias("name"))


@query("x1_j8_distinct_names", f"WITH {DISTINCT} SELECT * FROM dn")
def x1(spark, d):
    """Participants of each meeting, without first names that a longer name has."""
    return P.distinct_names(said_names(spark, d).where("pos % 8 < 5"))


@query(
    "x2_j6_reconcile",
    f"""WITH {DISTINCT}, kn AS (SELECT meeting_id, list(name ORDER BY pos) AS known FROM dn GROUP BY 1),
wa AS (SELECT p_partkey // 8 AS meeting_id, p_partkey AS pos, CASE WHEN p_size % 7 = 0 THEN 'TBD' WHEN p_size % 7 = 1 THEN NULL WHEN p_size % 7 = 2 THEN left(p_name, 3) ELSE {SAID} END AS raw FROM part WHERE p_partkey % 8 >= 5),
ww AS (SELECT meeting_id, list({name_sql('raw')} ORDER BY pos) AS wanted FROM wa WHERE raw IS NOT NULL AND lower(trim(raw)) NOT IN ('', 'unassigned', 'none', 'tbd', 'unknown') GROUP BY 1),
al AS (SELECT coalesce(kn.meeting_id, ww.meeting_id) AS meeting_id, coalesce(known, []) AS known, coalesce(wanted, []) AS wanted FROM kn FULL JOIN ww ON kn.meeting_id = ww.meeting_id),
fu AS (SELECT meeting_id, len(known) AS n, list_reduce(list_transform(wanted, lambda w: [w]), lambda s, w: CASE WHEN len(list_filter(s, lambda k: starts_with(lower(k), lower(w[1])))) > 0 THEN s ELSE list_append(s, w[1]) END, known) AS every FROM al)
SELECT meeting_id, unnest(every) AS name, unnest(range(1, len(every) + 1)) > n AS is_unknown_assignee FROM fu""",
)
def x2(spark, d):
    """Participants, then the assignees whom no name before them covers, in order."""
    n = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") % 7).alias("k"), F.substring("p_name", 1, 3).alias("short"))
    said = said_names(spark, d).where("pos % 8 >= 5").join(n, "pos")
    assignee = F.when(F.col("k") == 0, "TBD").when(F.col("k") == 1, None).when(F.col("k") == 2, F.col("short")).otherwise(F.col("name"))
    return P.reconcile(said_names(spark, d).where("pos % 8 < 5"), said.select("meeting_id", "pos", assignee.alias("assignee")))


@query("j6_prefix_join", "SELECT left(low, i::INT) AS prefix, count(*) AS n FROM (SELECT lower(c_name) AS low, unnest(range(1, length(c_name) + 1)) AS i FROM customer) GROUP BY 1")
def j6(spark, d):
    """All customers' names against all their prefixes."""
    n = table(spark, d, "customer").select(F.lower("c_name").alias("name"))
    p = n.select(F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i"), "name").select(F.substr("name", F.lit(1), F.col("i")).alias("prefix"))
    return X.prefix_counts(n, p)


@query("j6_prefix_pairs", "SELECT DISTINCT p.p_name AS assignee, n.c AS participant FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS p_name FROM part) p JOIN (SELECT DISTINCT p_name AS c FROM part) n ON starts_with(n.c, p.p_name)")
def j6_pairs(spark, d):
    """First names and the whole names that they begin."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    p = n.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("prefix"))
    return X.prefix_pairs(n, p).select(F.col("prefix").alias("assignee"), F.col("name").alias("participant"))


@query(
    "j12_role_lookup",
    """WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ':' WHEN 1 THEN c_mktsegment ELSE c_name END AS name FROM customer),
r AS (SELECT DISTINCT c_mktsegment AS name, 'Head of ' || lower(c_mktsegment) AS role FROM customer WHERE c_mktsegment < 'M' UNION ALL SELECT DISTINCT c_mktsegment || ':', 'Voice' FROM customer WHERE c_mktsegment >= 'H')
SELECT id, n.name, coalesce(a.role, b.role, 'Team Member / Coworker') AS role FROM n LEFT JOIN r a ON a.name = n.name LEFT JOIN r b ON b.name = trim(n.name, ':')""",
)
def j12(spark, d):
    c, seg = table(spark, d, "customer"), F.col("c_mktsegment")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(seg, F.lit(":"))).when(F.col("c_custkey") % 3 == 1, seg).otherwise(F.col("c_name"))
    heads = c.where(seg < "M").select(seg.alias("name"), F.concat(F.lit("Head of "), F.lower(seg)).alias("role")).distinct()
    voices = c.where(seg >= "H").select(F.concat(seg, F.lit(":")).alias("name"), F.lit("Voice").alias("role")).distinct()
    return P.looked_up_roles(c.select(F.col("c_custkey").alias("id"), name.alias("name")), heads.unionByName(voices)).select("id", "name", "role")


@query("f24_action_items", "SELECT o_orderkey AS id, trim(o_orderpriority) AS task, 'Unassigned' AS assignee, NULL::VARCHAR AS deadline, CASE split_part(o_orderpriority, '-', 2) WHEN 'HIGH' THEN 'High' WHEN 'LOW' THEN 'Low' ELSE 'Medium' END AS priority, coalesce(nullif(trim(o_orderstatus), ''), 'Not Started') AS status FROM orders")
def f24(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), F.lit(" ").alias("assignee"), F.lit(None).cast("string").alias("deadline"), F.initcap(F.lower(F.split("o_orderpriority", "-")[1])).alias("priority"), F.col("o_orderstatus").alias("status")
    )
    return P.normal_item(o)


@query(
    "f25_f26_validation",
    """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 1 THEN 'extra field' WHEN 2 THEN 'bad priority' WHEN 3 THEN 'missing summary' WHEN 4 THEN 'not JSON' ELSE 'ok' END AS problem, CASE o_orderkey % 6 WHEN 0 THEN 'order ' || o_orderkey WHEN 5 THEN o_orderpriority END AS summary FROM orders""",
)
def f26(spark, d):
    """Models' answers about all orders: fenced, with extra fields, bad priorities, without a summary, not JSON, with spaces around."""
    k, key = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('```json\n{"summary":"order '), key, F.lit('","action_items":[{"task":"t","priority":"High"}]}\n```'))).when(k == 1, F.concat(F.lit('{"summary":"s","extra":'), key, F.lit("}")))
        .when(k == 2, F.lit('{"summary":"s","action_items":[{"task":"t","priority":"Critical"}]}')).when(k == 3, F.lit('{"key_points":[]}')).when(k == 4, F.concat(F.lit("no json in "), key))
        .otherwise(F.concat(F.lit('  {"summary":"'), "o_orderpriority", F.lit('"}  ')))
    )
    v = P.validated(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")))
    return v.select("id", F.coalesce("problem", F.lit("ok")).alias("problem"), F.when(F.col("problem").isNull(), F.col("record.summary")).alias("summary"))


@query("f27_json_columns", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def f27(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


#: Lists as their column has them: none, empty, and with quotes and line feeds in them.
LISTS = """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["' || o_orderpriority || '","say \\"' || o_orderstatus || '\\"\\n"]' ELSE '["' || o_orderkey || '"]' END"""


@query(
    "f27_json_lists",
    f"SELECT o_orderkey AS id, len(x)::INT AS n, x[1] AS first, x[2] AS second, CASE WHEN len(x) = 0 THEN '[]' ELSE to_json(x)::VARCHAR END AS encoded FROM (SELECT o_orderkey, coalesce(from_json({LISTS}, '[\"VARCHAR\"]'), []) AS x FROM orders)",
)
def f27_lists(spark, d):
    """Lists of all orders out of their JSON column, null as no entries, and back into it."""
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    raw = F.when(k == 0, None).when(k == 1, "[]").when(k == 2, F.concat(F.lit('["'), "o_orderpriority", F.lit('","say \\"'), "o_orderstatus", F.lit('\\"\\n"]'))).otherwise(F.concat(F.lit('["'), key, F.lit('"]')))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), R.decoded_list(raw).alias("x"))
    return x.select("id", F.size("x").alias("n"), F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"), R.encoded_list(F.col("x")).alias("encoded"))


@query("f28_roles_of_conversations", "SELECT conv_id, role, CASE WHEN t LIKE '%manager%' OR t LIKE '%pm%' THEN 'Project Manager' WHEN t LIKE '%lead%' THEN 'Team Leader' WHEN t LIKE '%design%' OR t LIKE '%casing%' OR t LIKE '%cad%' THEN 'Product Designer' WHEN t LIKE '%developer%' OR t LIKE '%database%' OR t LIKE '%frontend%' THEN 'Software Engineer' WHEN t LIKE '%marketing%' OR t LIKE '%sales%' THEN 'Marketing Specialist' ELSE 'Team Member / Coworker' END AS job FROM (SELECT conv_id, role, lower(string_agg(text, ' ')) AS t FROM conversations GROUP BY 1, 2)")
def f28_conversations(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.collect_list("text"), " ").alias("t"))
    return c.select("conv_id", "role", P.role_of(F.col("t")).alias("job"))


@query(
    "f31_summary_issues",
    """SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN trim(coalesce(s, '')) = '' THEN 'summary is blank' END, CASE WHEN coalesce(len(k), 0) = 0 THEN 'no key points' END], lambda x: x IS NOT NULL), ';') AS issues
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS s, CASE WHEN doc_id % 2 = 0 THEN [] WHEN doc_id % 5 = 0 THEN NULL ELSE [lang] END AS k FROM documents)""",
)
def f31(spark, d):
    i = F.col("doc_id")
    summary = F.when(i % 3 == 0, " ").when(i % 7 == 0, None).otherwise(F.col("text"))
    points = F.when(i % 2 == 0, F.array().cast("array<string>")).when(i % 5 == 0, None).otherwise(F.array("lang"))
    return table(spark, d, "documents").select(i.alias("id"), F.array_join(P.summary_issues(summary, points), ";").alias("issues"))


@query(
    "u4_ordered_union",
    """WITH every AS (SELECT conv_id, 0 AS part, turn AS pos, role AS name FROM conversations UNION ALL SELECT conv_id, 1, c_custkey, c_mktsegment FROM (SELECT DISTINCT conv_id FROM conversations) JOIN customer ON c_custkey % 500 = conv_id
  UNION ALL SELECT conv_id, 1, -1, 'user' FROM (SELECT DISTINCT conv_id FROM conversations)),
firsts AS (SELECT conv_id, name, min({'part': part, 'pos': pos}) AS first_at FROM every GROUP BY ALL) SELECT conv_id AS meeting_id, string_agg(name, ',' ORDER BY first_at) AS names FROM firsts GROUP BY 1""",
)
def u4(spark, d):
    """Speakers of each conversation in order, then the listed participants who didn't speak."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("long").alias("pos"), F.col("role").alias("name"))
    ids = c.select("meeting_id").distinct()
    guests = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("pos"), F.col("c_mktsegment").alias("name"))
    listed = ids.join(guests, F.col("pos") % 500 == F.col("meeting_id")).select("meeting_id", "pos", "name").unionByName(ids.select("meeting_id", F.lit(-1).cast("long").alias("pos"), F.lit("user").alias("name")))
    return P.everybody(c, listed).select("meeting_id", F.array_join("names", ",").alias("names"))


@query("s9_f20_prompt_fill", "SELECT n_nationkey AS id, 'Context: ' || n_name || ' Question: who?' AS prompt FROM nation")
def s9(spark, d):
    filled = fill_prompt("Context: {context} Question: {question}", context="{context}", question="who?")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.replace(F.lit(filled), F.lit("{context}"), F.col("n_name")).alias("prompt"))


@query("w8_f5_labels", "SELECT c_custkey AS id, 'Speaker ' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS label FROM customer")
def w8(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Speaker "), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).cast("string")).alias("label"))


@query("f3_durations_of_turns", "SELECT conv_id, turn, CASE WHEN length(text) < 60 THEN length(text) || 's' ELSE (length(text) // 60) || 'm ' || lpad((length(text) % 60)::VARCHAR, 2, '0') || 's' END AS duration FROM conversations")
def f3(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.duration(F.char_length("text").cast("double")).alias("duration"))
