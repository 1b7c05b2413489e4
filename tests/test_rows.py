"""Rules on rows written out here: predicates, names, roles, word errors, records, prefixes, requests."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import documents as D
from colloquy.operators import people as P
from colloquy.operators import prefixes as X
from colloquy.operators import records as R
from colloquy.operators import requests


def test_sentence_predicates(spark):
    lines = {
        "Hello everyone, how are you doing today?": (True, False, False, False), "ok": (False, False, False, False), "We will prepare the budget report by Friday": (False, True, True, True), "Can you hear me?": (True, False, False, False),
        "the client review is due on Monday morning.": (False, True, True, True), "Thanks": (True, False, False, False), "She must send the design within 3 days.": (False, True, True, True), "will do": (False, False, False, False), "Good progress was made on the database": (False, True, False, False),
    }
    s = F.col("s")
    got = spark.createDataFrame([(x,) for x in lines], "s string").select("s", T.is_small_talk(s), T.is_substantive(s), T.is_action(s), T.has_deadline(s))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == lines


def test_names(spark):
    raw = {"ravi": "Ravi", "  ravi k  ": "Ravi K", "Alice Smith (Host):": "Alice Smith", "Speaker 2:": "Speaker 2", "Dr. Bob Jones (Presenter)": "Dr. Bob Jones", "": "Unknown", "JD": "JD", "j. doe": "J. Doe", "MARIA LOPEZ": "Maria Lopez"}
    raw |= {"\tann\n": "Ann", " eve lee ": "Eve Lee", " \t ": "Unknown", "'quoted', ": "Quoted", "bob (co-host)": "Bob"}
    got = {r.raw: r.n for r in spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", P.normal_name(F.col("raw")).alias("n")).collect()}
    assert got == raw


def test_distinct_names_and_assignees(spark):
    people = [("m1", i, n) for i, n in enumerate(["ravi", "Ravi K", "RAVI", "Alice Smith", "alice smith (Host)"])] + [("m2", 0, "Alice"), ("m2", 1, "Bob"), ("m2", 2, "charlie"), ("m3", 0, "Zed")]
    tasks = [("m2", 0, "Bob"), ("m2", 1, "Charlie"), ("m2", 2, "Eve"), ("m2", 3, "tbd"), ("m2", 4, "Ev"), ("m3", 0, "Z"), ("m3", 1, " ")]
    names, assignees = spark.createDataFrame(people, "meeting_id string, pos int, name string"), spark.createDataFrame(tasks, "meeting_id string, pos int, assignee string")
    assert {tuple(r) for r in P.distinct_names(names).collect()} == {("m1", 1, "Ravi K"), ("m1", 3, "Alice Smith"), ("m2", 0, "Alice"), ("m2", 1, "Bob"), ("m2", 2, "Charlie"), ("m3", 0, "Zed")}
    want = {("m1", "Ravi K", False), ("m1", "Alice Smith", False), ("m2", "Alice", False), ("m2", "Bob", False), ("m2", "Charlie", False), ("m2", "Eve", True), ("m3", "Zed", False)}
    assert {tuple(r) for r in P.reconcile(names, assignees).collect()} == want


def test_roles(spark):
    said = {"As the manager I decide": "Project Manager", "our developpment plan": "Project Manager", "I lead the team": "Team Leader", "casing and cad work": "Product Designer", "the database is slow": "Software Engineer", "sales are up": "Marketing Specialist", "nothing": "Team Member / Coworker"}
    assert {r.t: r.role for r in spark.createDataFrame([(x,) for x in said], "t string").select("t", P.role_of(F.col("t")).alias("role")).collect()} == said


def test_word_error_rates(spark):
    pairs = [
        (1, "the quick brown fox jumps over dogs", "The quick, brown fox jumps over dogs!", 0, 0.0, 100.0, True), (2, "one two three four five", "one two six four five", 1, 0.2, 80.0, False), (3, "one two three four five six", "one two three four five", 1, 0.1667, 83.33, False),
        (4, "one two three four five", "one two three four five six", 1, 0.2, 80.0, False), (6, "", "some words", 2, 1.0, 0.0, False), (7, "", "", 0, 0.0, 100.0, True), (8, "three little words", "", 3, 1.0, 0.0, False), (9, "a b c d e f g h i", "z y x w v u t s r", 9, 1.0, 0.0, False), (10, None, None, 0, 0.0, 100.0, True),
    ]
    df = spark.createDataFrame([p[:3] for p in pairs], "id int, reference string, hypothesis string")
    got = D.word_error_rate(df).select("id", "edits", "wer", "accuracy", "passed").collect()
    assert {tuple(r) for r in got} == {(p[0], *p[3:]) for p in pairs}
    assert D.word_error_rate(df.limit(0)).count() == 0


def test_records(spark):
    outputs = {'```json\n{"summary":"ok","action_items":[{"task":"t","priority":"High"}]}\n```': None, '{"summary":"s","extra":1}': "extra field", '{"summary":"s","action_items":[{"task":"t","priority":"Critical"}]}': "bad priority", '{"key_points":[]}': "missing summary", "no json here": "not JSON", '  {"summary":"s"}  ': None}
    assert {r.raw: r.problem for r in P.validated(spark.createDataFrame([(x,) for x in outputs], "raw string")).collect()} == outputs
    lists = {None: [], "": [], " ": [], "[]": [], '["a","b \\"c\\""]': ["a", 'b "c"'], "not a list": []}
    got = {r.s: r.x for r in spark.createDataFrame([(x,) for x in lists], "s string").select("s", R.decoded_list(F.col("s")).alias("x")).collect()}
    assert got == lists
    assert [r.x for r in spark.createDataFrame([(["a", 'b"'],), (None,), ([],)], "s array<string>").select(R.encoded_list(F.col("s")).alias("x")).collect()] == ['["a","b\\""]', "[]", "[]"]


def test_prefixes_against_all_pairs(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("aabé\U0001f600") for _ in range(rng.randint(0, 6))) for _ in range(300)] + [None, "a\U0010ffffb", "zz"]
    prefixes = [n[: rng.randint(0, 4)] for n in names if n is not None] + ["", "q", None, "a\U0010ffff", "zzz"]
    n, p = spark.createDataFrame([(x,) for x in names], "name string").repartition(5), spark.createDataFrame([(x,) for x in prefixes], "prefix string").repartition(3)
    want = {q: [x for x in names if x is not None and x.startswith(q)] for q in prefixes if q is not None}
    assert {r.prefix: r.n for r in X.prefix_counts(n, p).collect()} == {q: len(v) for q, v in want.items()}
    pairs = X.prefix_pairs(n, p)
    assert sorted(map(tuple, pairs.collect())) == sorted((q, x) for q, v in want.items() for x in v)
    for plan in (pairs, X.prefix_counts(n, p)):
        text = plan._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert X.prefix_pairs(n.limit(0), p).count() == 0 == X.prefix_counts(n, p.limit(0)).count()


def test_requests_leave_their_times(spark, tmp_path):
    kept = requests.Latencies(spark, f"file://{tmp_path}/times", group=2)
    assert kept.table().count() == 0
    assert len(kept.run("ten", spark.range(10))) == 10
    assert kept.run("count", spark.range(7), lambda df: df.count()) == 7
    with pytest.raises(ZeroDivisionError):
        kept.run("bad", spark.range(3), lambda df: 1 / 0)
    got = {r.request: (r.name, r.rows) for r in kept.table().collect()}
    assert got == {1: ("ten", 10), 2: ("count", 7), 3: ("bad", None)}
    stats = {r.name: r for r in requests.latency_stats(kept.table()).collect()}
    assert stats["ten"].n == 1 and 0 < stats["ten"].low == stats["ten"].mean == stats["ten"].high


def test_pages_and_text_tables(spark):
    rows = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "id int, summary string")
    body = lambda *a: requests.page(rows, [F.desc("id")], *a).first().body
    assert body(2, 1) == '{"meetings":[{"id":3,"summary":"s3"},{"id":2,"summary":"s2"}],"total":5,"limit":2,"offset":1}'
    assert body(2, 9) == '{"meetings":[],"total":5,"limit":2,"offset":9}'
    with pytest.raises(ValueError):
        body(0, 0)
    items = spark.createDataFrame([(1, "a long task", None), (2, None, "Ann")], "id int, task string, who string")
    lines = [r.line for r in requests.text_table(items, "id", {"task": "Task", "who": "Assignee"}).orderBy("line_no", "id").collect()]
    assert lines == ["Task        | Assignee", "------------+---------", "a long task | N/A     ", "N/A         | Ann     "]
