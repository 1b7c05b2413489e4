"""Participants, assignees, action items and structured meeting records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Badges taken out of names, assignees that name nobody, roles by keyword.
BADGES = "Host|Co-host|Presenter|Speaker|Guest|Admin|Moderator"
NOBODY = ["", "unassigned", "none", "tbd", "unknown"]
# Suffixes of recordings.
VIDEO = {".mp4", ".mkv", ".mov", ".avi", ".webm"}
AUDIO = {".mp3", ".wav", ".m4a", ".ogg", ".flac"}
ROLES = [
    ("Project Manager", ["manager", "pm"]),
    ("Team Leader", ["lead", "leader"]),
    ("Product Designer", ["design", "casing", "cad"]),
    ("Software Engineer", ["developer", "database", "frontend"]),
    ("Marketing Specialist", ["marketing", "sales"]),
]
NO_ROLE = "Team Member / Coworker"
RECORD = (
    "summary string, key_points array<string>, decisions array<string>, participants array<string>, "
    "action_items array<struct<task:string,assignee:string,deadline:string,priority:string,status:string>>"
)


def stripped(text: Column) -> Column:
    """Without the white space of any kind around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_name(name: Column) -> Column:
    bare = F.regexp_replace(stripped(name), "^[:\"',\\-]+|[:\"',\\-]+$", "")
    bare = stripped(F.regexp_replace(bare, rf"(?iU)\s*\((?:{BADGES})\)", ""))
    speaker = F.regexp_extract(bare, r"(?iU)^Speaker\s+(\d+|[A-Z]):?", 1)

    def cased(w: Column) -> Column:
        short = (F.length(w) == 1) | ((F.length(w) == 2) & w.endswith("."))
        acronym = (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= 3)
        return F.when(short, F.upper(w)).when(acronym, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    joined = F.array_join(F.transform(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""), cased), " ")
    known = F.when(speaker != "", F.concat(F.lit("Speaker "), speaker)).when(joined == "", "Unknown").otherwise(joined)
    return F.when(stripped(F.coalesce(name, F.lit(""))) == "", "Unknown").otherwise(known)


def distinct_names(names: DataFrame, by: str = "meeting_id") -> DataFrame:
    """(by, pos, name): first of each name, without one-word names that begin a longer one.

    If that leaves nobody in a meeting, the list before the last step stays.
    """
    n = names.select(by, "pos", normal_name(F.col("name")).alias("name")).where("name <> 'Unknown'").withColumn("low", F.lower("name"))
    n = n.withColumn("_r", F.row_number().over(W.partitionBy(by, "low").orderBy("pos"))).where("_r = 1").drop("_r")
    longer = n.where("name LIKE '% %'").select(by, F.split("low", " ")[0].alias("low")).distinct().withColumn("dropped", F.lit(True))
    n = n.join(longer, [by, "low"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)) & ~F.col("name").contains(" "))
    return n.withColumn("_any", F.max(~F.col("dropped")).over(W.partitionBy(by))).where("NOT dropped OR NOT _any").select(by, "pos", "name")


def reconcile(names: DataFrame, assignees: DataFrame, by: str = "meeting_id") -> DataFrame:
    """(by, name, is_unknown_assignee): participants, then assignees that match none before them, in order.

    Order matters (an appended name can cover a later one), so the assignees of a
    meeting are one fold over an array with the known names as its state.
    """
    known = distinct_names(names, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("known"))
    a = assignees.where(~F.lower(F.trim("assignee")).isin(NOBODY) & F.col("assignee").isNotNull())
    a = a.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", normal_name(F.col("assignee")).alias("name")))), lambda s: s["name"]).alias("wanted"))
    none = F.array().cast("array<string>")
    j = known.join(a, by, "full").select(by, F.coalesce("known", none).alias("known"), F.coalesce("wanted", none).alias("wanted"))
    full = F.aggregate("wanted", F.col("known"), lambda s, w: F.when(F.exists(s, lambda k: F.startswith(F.lower(k), F.lower(w))), s).otherwise(F.array_append(s, w)))
    return j.withColumn("every", full).select(by, F.posexplode("every").alias("pos", "name"), F.size("known").alias("n")).select(by, "name", (F.col("pos") >= F.col("n")).alias("is_unknown_assignee"))


def looked_up_roles(names: DataFrame, roles: DataFrame) -> DataFrame:
    """``names`` (name, ...) with ``role``: that of the name, else that of the name without colons around it, else the default.

    ``roles`` (name, role) has each name once.
    """
    r = roles.select(F.col("name").alias("_as_is"), F.col("role").alias("_role"))
    bare = roles.select(F.col("name").alias("_bare"), F.col("role").alias("_bare_role"))
    j = names.join(r, F.col("name") == F.col("_as_is"), "left").join(bare, F.regexp_replace("name", "^:+|:+$", "") == F.col("_bare"), "left")
    return j.withColumn("role", F.coalesce("_role", "_bare_role", F.lit(NO_ROLE))).drop("_as_is", "_role", "_bare", "_bare_role")


def everybody(spoke: DataFrame, listed: DataFrame, by: str = "meeting_id") -> DataFrame:
    """(by, names): those who ``spoke`` (by, pos, name) in order, then those ``listed`` (by, pos, name) who didn't, each once."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"])
    j = spoke.groupBy(by).agg(in_order.alias("_a")).join(listed.groupBy(by).agg(in_order.alias("_b")), by, "full")
    none = F.array().cast("array<string>")
    return j.select(by, F.array_union(F.coalesce("_a", none), F.coalesce("_b", none)).alias("names"))


def role_of(spoken: Column) -> Column:
    """Role by the first keyword set with a substring in what the speaker said."""
    low = F.lower(spoken)
    out = None
    for role, keys in ROLES:
        hit = low.contains(keys[0])
        for k in keys[1:]:
            hit |= low.contains(k)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise(NO_ROLE)


def normal_item(items: DataFrame) -> DataFrame:
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    return items.select(
        *[c for c in items.columns if c not in ("task", "assignee", "deadline", "priority", "status")],
        F.trim("task").alias("task"), blank("assignee", "Unassigned").alias("assignee"), F.trim("deadline").alias("deadline"),
        F.when(F.col("priority").isin("High", "Medium", "Low"), F.col("priority")).otherwise("Medium").alias("priority"), blank("status", "Not Started").alias("status"),
    )


def fenced_json(raw: Column) -> Column:
    """What stands in a code fence, else the text itself, trimmed."""
    inner = F.regexp_extract(raw, r"(?i)```(?:json)?\s*([\s\S]*?)\s*```", 1)
    return F.when(raw.rlike(r"```(?:json)?\s*[\s\S]*?```"), F.trim(inner)).otherwise(F.trim(raw))


def validated(outputs: DataFrame) -> DataFrame:
    """Adds ``record`` and ``problem`` (null: valid): not JSON, missing, extra or bad values."""
    j = outputs.withColumn("_j", fenced_json(F.col("raw"))).withColumn("record", F.from_json("_j", RECORD)).withColumn("_k", F.json_object_keys("_j"))
    fields = F.array(*[F.lit(x) for x in ("summary", "key_points", "decisions", "participants", "action_items")])
    bad = F.exists(F.coalesce("record.action_items", F.array().cast("array<struct<task:string,assignee:string,deadline:string,priority:string,status:string>>")), lambda i: i["priority"].isNotNull() & ~i["priority"].isin("High", "Medium", "Low"))
    problem = (
        F.when(F.col("_k").isNull(), "not JSON")
        .when(~F.array_contains("_k", "summary") | F.col("record.summary").isNull(), "missing summary")
        .when(F.size(F.array_except("_k", fields)) > 0, "extra field")
        .when(bad, "bad priority")
    )
    return j.withColumn("problem", problem).drop("_j", "_k")


def summary_issues(summary: Column, key_points: Column) -> Column:
    return F.array_compact(F.array(F.when(F.trim(F.coalesce(summary, F.lit(""))) == "", "summary is blank"), F.when(F.coalesce(F.size(key_points), F.lit(0)) == 0, "no key points")))


def file_problem(name: Column, size: Column, probe: Column) -> Column:
    """First failing check of a media file, null if all pass."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kinds = sorted(VIDEO | AUDIO)
    streams = F.from_json(probe, "streams array<struct<codec_type:string>>")["streams"]
    return (
        F.when(suffix == "", "no suffix").when(~suffix.isin(kinds), "unsupported suffix")
        .when(size < 1024, "too small").when(size > 500 * 1024 * 1024, "too large")
        .when(F.coalesce(F.size(streams), F.lit(0)) <= 0, "no streams")
        .when(~F.exists(streams, lambda s: s["codec_type"] == "audio"), "no audio")
    )
