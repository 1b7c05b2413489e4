"""Checking structured meeting records, field by field, with a message for each fault."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITIES = ("High", "Medium", "Low")
#: Kind of each field, and whether it must be there.
ITEM = {"task": ("text", True), "assignee": ("text", True), "deadline": ("text or null", False), "priority": ("priority", False), "status": ("text", False)}
RECORD = {"summary": ("text", True), "key_points": ("texts", False), "decisions": ("texts", False), "action_items": ("items", False), "participants": ("texts", False)}
FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)\s*```", re.IGNORECASE)


def _faults(value: dict, fields: dict, at: tuple) -> list[str]:
    out = []
    for name, (kind, needed) in fields.items():
        here = (*at, name)
        if name in value:
            out += _kind_faults(value[name], kind, here)
        elif needed:
            out.append(f"Missing required field '{_path(here)}'.")
    return out + [f"Extra forbidden field '{_path((*at, name))}' is present and not allowed." for name in value if name not in fields]


def _path(at: tuple) -> str:
    return " -> ".join(map(str, at))


def _wrong(at: tuple, what: str, value) -> list[str]:
    got = "." if value is None else f" (received {value!r})."
    return [f"Field '{_path(at)}': Input should be a valid {what}{got}"]


def _kind_faults(value, kind: str, at: tuple) -> list[str]:
    if kind == "priority":
        if value in PRIORITIES:
            return []
        return [f"Field '{_path(at)}': Expected one of 'High', 'Medium' or 'Low', but received {value!r}."]
    if kind == "text or null" and value is None:
        return []
    if kind.startswith("text") and kind != "texts":
        return [] if isinstance(value, str) else _wrong(at, "string", value)
    if not isinstance(value, list):
        return _wrong(at, "list", value)
    if kind == "texts":
        return [m for i, v in enumerate(value) for m in ([] if isinstance(v, str) else _wrong((*at, i), "string", v))]
    return [m for i, v in enumerate(value) for m in (_faults(v, ITEM, (*at, i)) if isinstance(v, dict) else _wrong((*at, i), "dictionary", v))]


def checked(raw: str | None) -> tuple[dict | None, str | None]:
    """(record with defaults filled in, None) or (None, message)."""
    if not raw or not raw.strip():
        return None, "LLM response is empty."
    text = raw.strip()
    fenced = FENCE.search(text)
    text = fenced.group(1).strip() if fenced else text
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        return None, f"Invalid JSON syntax at line {e.lineno}, column {e.colno}: {e.msg}. Raw text excerpt: {text[:200]!r}"
    if not isinstance(data, dict):
        return None, f"Expected root JSON object (dict), but received {type(data).__name__}."
    faults = _faults(data, RECORD, ())
    if faults:
        return None, "Schema validation failed with the following error(s):\n" + "\n".join(faults)
    items = [{"deadline": None, "priority": "Medium", "status": "Not Started", **i} for i in data.get("action_items", [])]
    return {"key_points": [], "decisions": [], "participants": [], **data, "action_items": items}, None


def fault_message(raw: Column) -> Column:
    """Message of a record's faults, null if it is valid. Error texts are Python's, so this is an Arrow-fed function."""
    return F.pandas_udf(lambda s: s.map(lambda x: checked(x)[1]), "string")(raw)


def spoken_by(transcript: Column, speaker: Column) -> Column:
    """What a transcript of ``Name: text`` lines gives to a speaker, lower-cased and joined by spaces.

    A passage ends at the next line that begins with one word and a colon, so a
    label of several words doesn't end the one before it.
    """
    name = F.regexp_replace(speaker, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    rule = F.concat(F.lit(r"(?is)(?:^|\n)\s*"), name, F.lit(r"\s*:\s*(.+?)(?=(?:\n\s*\S+\s*:)|\z)"))
    return F.lower(F.array_join(F.regexp_extract_all(transcript, rule, 1), " "))


def decoded_list(column: Column) -> Column:
    """The strings of a JSON array column; null, blank and what isn't an array are an empty list."""
    return F.coalesce(F.from_json(F.nullif(F.trim(column), F.lit("")), "array<string>"), F.array().cast("array<string>"))


def encoded_list(strings: Column) -> Column:
    """The JSON array of a list of strings; null is an empty one."""
    return F.to_json(F.coalesce(strings, F.array().cast("array<string>")))
