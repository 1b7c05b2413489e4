"""Line deduplication by a segment-partition edit join. DataFrame and SQL functions only.

Equal lines are one row first. A line is split into threshold + 1 even segments;
lines within the threshold share at least one segment at a place that the
length difference and the segment's rank allow, so segments are indexed under
(length, rank, content) and each line probes the indexes of its own and of
slightly shorter lengths. Lines that share a key are verified by a banded edit
distance; of a key that several lines share, blocks of lines are compared inside one
expression, which returns one edge for each line and not the pairs. A key that more
than ``LARGE`` lines share doesn't say enough: what is left of these lines without
the shared segment is within the threshold too, so it is split again, and only
lines that share a second segment there are compared. That is asked for only where
comparing the lines of such keys would take more than ``LARGE`` / 2 comparisons for
each line of the input.

A line's class is its connected component of links; the first line of a class (by
document id, then place) is kept, all others go. Lines shorter than ``min_chars``
only match equal lines, blank lines are never touched.

A line goes by a 64-bit hash, which a second one guards: where two different lines
share the first, their ids are made anew of both.

Defined results: null and empty texts have one blank line; a null ``doc_id`` sorts
first; rows that repeat a ``doc_id`` are told apart by the hash of their text (the
smaller one is first), so equal rows share their decisions and others don't; an
empty table gives no rows; other columns are ignored; white space around a line
doesn't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import all_salts, components, fewer_than, salted, table, text_or_empty, unused, written

SALTS = 16
EDITS = 2
MIN_CHARS = 20
#: Lines of one key beyond which another shared segment is asked for.
LARGE = 128
#: Lines of one key that are compared in one row with those of another block.
BLOCK = 128
#: Characters of what is left of the lines of a large key up to which edited forms link them.
SHORT = 20
#: Times the rows of the first round of large keys up to which their lines are split again.
GROWTH = 64
#: Characters that text hasn't: two that the lines don't use stand for a segment that was taken out, and for any one character.
NO_TEXT = [chr(i) for i in range(0xFDD0, 0xFDF0)]
#: Rows (of 8 to 16 bytes) up to which a table of keys or ids is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def row_key() -> Column:
    return F.xxhash64("text")


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def distinct_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a line's ``id``, one row for each different line with its first place, count and text).

    The least and the largest second hash of an id differ only if two lines share
    it (of 10 billion lines, about three pairs); the loop then runs once more.
    """
    ids = rows.select("doc_id", "row", "line_no", line_hash(F.col("line")).alias("id"), F.xxhash64(F.lit(5), "line").alias("guard"), F.char_length("line").alias("len"), "line")
    for _ in range(8):
        distinct = ids.groupBy("id").agg(
            F.min(F.struct("doc_id", "row", "line_no")).alias("first"), F.count("*").alias("n_copies"), F.first("line").alias("line"), F.first("len").alias("len"), F.min("guard").alias("low"), F.max("guard").alias("high")
        )
        distinct = written(distinct, "lines")
        shared = distinct.where("low <> high").select("id", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return ids, distinct.select("id", "first", "n_copies", "line", "len")
        shared = F.broadcast(written(shared, "line-shared")) if fewer_than(shared, BROADCAST_ROWS) else shared
        ids = ids.join(shared, "id", "left").withColumn("id", F.when(F.col("shared"), F.xxhash64("guard", "id")).otherwise(F.col("id"))).drop("shared")
    raise RuntimeError("line ids did not settle")


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line): trimmed lines of whole texts, from 0; ``row`` is the text's hash."""
    lines = F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("line_no", "line")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), lines).withColumn("line", F.trim(F.col("line"), F.lit(" \t\r\f\x0b")))


def segment(length: Column, rank: int, edits: int) -> tuple[Column, Column]:
    """(start from 1, length) of a segment; the last ones are longer by one if need be."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    first_long = parts - longer
    start = base * rank + F.greatest(F.lit(0), F.lit(rank) - first_long) + 1
    return start, base + F.when(F.lit(rank) >= first_long, 1).otherwise(0)


def windows(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, rank, shift) that a probe has to look at (multi-match-aware)."""
    return [
        (d, r, s)
        for d in range(edits + 1)
        for r in range(edits + 1)
        for s in range(max(-r, d - (edits - r)), min(r, d + (edits - r)) + 1)
    ]


def places(edits: int) -> list[tuple[int, int, int]]:
    """``windows`` in the order of a line's keys: its own segments first (edits + 1 of them), then what else it probes.

    A probe of the line's own length without a shift is one of its own segments.
    """
    shifts = windows(edits)
    own = [w for w in shifts if w[0] == 0 and w[2] == 0]
    return own + [w for w in shifts if w not in own]


def line_keys(edits: int, min_chars: int, scope: Column | None = None) -> Column:
    """Keys of a line (columns ``line`` and ``len``), null where a place doesn't fit; lines of different ``scope`` share none."""
    keys = []
    for d, r, s in places(edits):
        length = F.col("len") - d
        start, n = segment(length, r, edits)
        ok = (start + s >= 1) & (start + s + n - 1 <= F.col("len")) & (length >= min_chars)
        within = [] if scope is None else [scope]
        keys.append(F.when(ok, F.xxhash64(*within, length, F.lit(r), F.substring("line", start + s, n))))
    return F.array(*keys)


def without_segment(edits: int, mark: str) -> Column:
    """What is left of ``line`` with ``mark`` for the segment of the key at ``place``."""
    left = None
    for k, (d, r, s) in enumerate(places(edits)):
        start, n = segment(F.col("len") - d, r, edits)
        rest = F.concat(F.substring("line", F.lit(1), start + s - 1), F.lit(mark), F.substr("line", start + s + n))
        left = F.when(F.col("place") == k, rest) if left is None else left.when(F.col("place") == k, rest)
    return left


def near(x: Column, y: Column, edits: int) -> Column:
    """Banded edit distance at most ``edits`` (the built-in gives -1 beyond the band)."""
    return F.levenshtein(x, y, edits) >= 0


def sketch(line: Column) -> Column:
    """64 parities of the counts of character pairs (and of the last character)."""
    chars = F.split(line, "")
    bit = lambda x, y: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x, y), F.lit(64)))
    return F.aggregate(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def may_be_near(x: Column, y: Column, edits: int) -> Column:
    """Necessary for ``near``: an edit removes two pairs and adds two at most, so it turns four bits at most."""
    return F.bit_count(x.bitwiseXOR(y)) <= 4 * edits


def forest(block: Column, edits: int) -> Column:
    """For an array of (id, sketch, line): one edge (id, least id of its component within the block).

    ``near`` is evaluated for each two lines of the block inside one expression; a
    fold over the lines then joins the labels that each line touches, so nothing
    but one row for each line leaves it.
    """
    n = F.size(block)
    touched = F.transform(
        block,
        lambda x, i: F.filter(
            F.sequence(i + 1, n),
            lambda j: (j == i + 1) | (may_be_near(x["sketch"], F.element_at(block, j)["sketch"], edits) & near(x["line"], F.element_at(block, j)["line"], edits)),
        ),
    )

    def join(labels: Column, own: Column) -> Column:
        met = F.array_distinct(F.transform(own, lambda j: F.element_at(labels, j)))
        # the one-element arrays bind their values, which are then evaluated once
        joined = F.element_at(
            F.transform(
                F.array(F.struct(met.alias("met"), F.array_min(met).alias("least"))),
                lambda b: F.transform(labels, lambda x: F.when(F.array_contains(b["met"], x), b["least"]).otherwise(x)),
            ),
            1,
        )
        return F.when(F.size(own) == 1, labels).otherwise(joined)

    labels = F.aggregate(touched, F.sequence(F.lit(1), n), join)
    edges = lambda ls: F.transform(ls, lambda x, i: F.struct(F.element_at(block, i + 1)["id"].alias("a"), F.element_at(block, x)["id"].alias("b")))
    return F.element_at(F.transform(F.array(labels), edges), 1)


def key_rows(hashed: DataFrame, edits: int) -> DataFrame:
    """(id, within, key, place, indexed) of the rows (id, within, keys)."""
    keys = hashed.select("id", "within", F.posexplode("keys").alias("place", "key")).where("key IS NOT NULL")
    return keys.withColumn("indexed", F.col("place") <= edits)


def buckets_of(keys: DataFrame) -> DataFrame:
    """(key, n, a, b) of the keys that two lines share, one of them as an index."""
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.max("indexed").alias("indexed"))
    return written(buckets.where("n > 1 AND indexed AND a <> b").drop("indexed"), "line-buckets")


def sent_along(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fewer_than(df, BROADCAST_ROWS) else df


def bucket_links(keys: DataFrame, buckets: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): links between lines of a bucket, as many as connect what is linked.

    Buckets of two lines give that pair. The lines of one with more are dealt into
    blocks of about ``BLOCK`` and each two blocks are one row that holds their
    lines; it gives one edge for each line, however many links it has.
    """
    pairs = written(buckets.where("n = 2").select("a", "b").distinct(), "line-pairs")
    large = buckets.where("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = written(keys.join(sent_along(large), "key").select("key", "id", "blocks").distinct(), "line-members")
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).distinct(), "line-ids")
    used = lines.select("id", "line").join(sent_along(ids), "id", "left_semi")
    used = written(used.select("id", sketch(F.col("line")).alias("sketch"), "line"), "line-texts")
    found = verified(pairs, used, edits)
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(used, "id")
    grouped = dealt.groupBy("key", "i", "j").agg(F.collect_list(F.struct("id", "sketch", "line")).alias("block"))
    rooted = grouped.select(F.explode(forest(F.col("block"), edits)).alias("e")).select("e.a", "e.b").where("a <> b")
    return found.unionByName(rooted)


def same_start(x: Column, y: Column) -> Column:
    """Characters that two texts begin with alike, by halving."""
    state = F.struct(F.lit(0).alias("low"), F.least(F.char_length(x), F.char_length(y)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.ceil((s["low"] + s["high"]) / 2).cast("int")
        same = F.substring(x, F.lit(1), mid) == F.substring(y, F.lit(1), mid)
        return F.when(same, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (mid - 1).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), state, lambda s, i: F.when(s["low"] < s["high"], halve(s, i)).otherwise(s), lambda s: s["low"])


def without_shared_ends(rests: DataFrame) -> DataFrame:
    """(id, key, line, len, longest): ``rests`` (id, key, line) without what all of a key begin and end with; edit distances stay.

    Texts between the least and the greatest of a set begin as these two do.
    """
    back = F.reverse("line")
    ends = rests.groupBy("key").agg(
        F.min("line").alias("low"), F.max("line").alias("high"), F.min(back).alias("back_low"), F.max(back).alias("back_high"),
        F.min(F.char_length("line")).alias("least"), F.max(F.char_length("line")).alias("longest"),
    )
    ends = ends.select("key", same_start(F.col("low"), F.col("high")).alias("head"), same_start(F.col("back_low"), F.col("back_high")).alias("tail"), "least", "longest")
    ends = ends.withColumn("tail", F.least(F.col("tail"), F.col("least") - F.col("head"))).withColumn("longest", F.col("longest") - F.col("head") - F.col("tail"))
    cut = rests.join(sent_along(written(ends, "line-ends")), "key")
    line = F.substring("line", F.col("head") + 1, F.char_length("line") - F.col("head") - F.col("tail"))
    return cut.select("id", "key", line.alias("line"), "longest").withColumn("len", F.char_length("line"))


def edited_forms(mark: str, anything: str) -> Column:
    """Array of (form, hub): forms of ``line`` that only texts within two edits of a hub have; marks are never edited.

    Two replaced characters, or up to one deleted: all texts of the form are within
    two edits of each other. One replaced and one deleted, or two deleted: the longer
    texts are within two edits of the shorter ones that have the form with the
    deletions left out, and those are the hubs.
    """
    line = F.col("line")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.col("len"), F.lit(1))), lambda i: (i <= F.col("len")) & (F.substring(line, i, F.lit(1)) != mark))
    put = lambda text, i: F.overlay(text, F.lit(anything), i, F.lit(1))
    cut = lambda text, i: F.overlay(text, F.lit(""), i, F.lit(1))
    twice = lambda one, other, which: F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: which(i, j)), lambda j: other(one(line, i), j))))
    form = lambda kind, hub: lambda x: F.struct(F.xxhash64("key", F.lit(kind), x).alias("form"), F.lit(hub).alias("hub"))
    once = lambda one: F.transform(places, lambda i: one(line, i))
    before = lambda i, j: j < i
    forms = [
        F.transform(twice(put, put, before), form(0, True)), F.transform(once(put), form(1, True)), F.transform(once(cut), form(2, True)), F.array(form(2, True)(line)),
        F.transform(twice(put, cut, lambda i, j: i != j), form(3, False)), F.transform(once(put), form(3, True)),
        F.transform(twice(cut, cut, before), form(4, False)), F.array(form(4, True)(line)),
    ]
    return F.array_distinct(F.concat(*forms))


def links_by_form(rests: DataFrame, mark: str, anything: str) -> DataFrame:
    """(a, b): a line and the least hub of each of its forms, for ``rests`` (id, key, line, len)."""
    forms = written(rests.select("id", F.explode(edited_forms(mark, anything)).alias("f")).select("id", "f.form", "f.hub"), "line-forms")
    hubs = forms.groupBy("form").agg(F.min(F.when(F.col("hub"), F.col("id"))).alias("hub_id"), F.min("id").alias("low"), F.max("id").alias("high"))
    hubs = hubs.where("low <> high AND hub_id IS NOT NULL").select("form", "hub_id")
    return forms.join(hubs, "form").where("id <> hub_id").select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b")).distinct()


def verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The ``pairs`` (a, b) that are within the threshold."""
    both = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.where(near(F.col("x"), F.col("y"), edits)).select("a", "b")


def not_in(lines: DataFrame) -> tuple[str, str]:
    """Two characters that no line has."""
    used = lines.agg(*[F.max(F.contains("line", F.lit(c))).alias(str(i)) for i, c in enumerate(NO_TEXT)]).first()
    free = [c for c, there in zip(NO_TEXT, used, strict=True) if not there]
    if len(free) < 2:
        raise ValueError("lines use all characters that are none")
    return free[0], free[1]


def compared_up_to(buckets: DataFrame, budget: int) -> tuple[int, int, bool]:
    """(lines of a key up to which its lines are compared, what is left of ``budget``, whether larger keys remain).

    Up to ``LARGE`` lines are always compared; of larger keys the smaller ones first, while the squares of their lines fit the budget.
    """
    steps = buckets.where(F.col("n") > LARGE).groupBy(F.floor(F.log2("n")).alias("step")).agg(F.max("n").alias("most"), F.sum(F.col("n") * F.col("n")).alias("work"))
    most, steps = LARGE, sorted(steps.collect())
    for i, s in enumerate(steps):
        if s.work > budget:
            return most, budget, True
        most, budget = s.most, budget - s.work
    return most, budget, False


def union_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def linked_lines(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(a, b): links between different lines (id, line, len), as many as connect what is linked.

    The rounds only find out which lines share which keys; lines are compared once, after the last round.
    """
    long_lines = lines.where(F.col("len") >= min_chars)
    rests, scope, stand_ins = long_lines.select("id", F.lit(0).cast("long").alias("within"), "line", "len"), None, None
    budget = long_lines.count() * LARGE // 2
    all_keys, all_buckets, all_short = [], [], []
    n_first = n_rests = 0
    while True:
        # written as one array a line: the hashes are read twice below, and cost more to compute than to read
        keys = key_rows(written(rests.select("id", "within", line_keys(edits, 0 if scope else min_chars, scope and F.col(scope)).alias("keys")), "line-keys"), edits)
        buckets = buckets_of(keys)
        # forms are made for two edits, and lines that repeat themselves have ever more keys: there, blocks are compared, however many
        if scope is None or edits == EDITS and n_rests <= GROWTH * n_first:
            most, budget, larger = compared_up_to(buckets, budget)
        else:
            most, larger = 1 << 62, False
        all_keys.append(keys)
        all_buckets.append(buckets.where(F.col("n") <= most))
        if not larger:
            break
        stand_ins = stand_ins or not_in(long_lines)
        large = buckets.where(F.col("n") > most).select("key")
        wide = written(keys.join(sent_along(large), "key").select("id", "within", "key", "place"), "line-wide")
        left = rests.join(wide, ["id", "within"]).select("id", "key", without_segment(edits, stand_ins[0]).alias("line")).distinct()
        left = written(without_shared_ends(written(left, "line-left")), "line-rests")
        short = F.lit(edits == EDITS) & (F.col("longest") <= SHORT)
        n_rests, n_short = left.agg(F.count("*"), F.count_if(short)).first()
        n_first = n_first or n_rests
        if n_short:
            all_short.append(left.where(short))
        if n_short == n_rests:
            break
        rests, scope = left.where(~short).select("id", F.col("key").alias("within"), "line", "len"), "within"
    out = bucket_links(union_of(all_keys), union_of(all_buckets), long_lines, edits)
    if all_short:
        out = out.unionByName(verified(written(links_by_form(union_of(all_short), *stand_ins), "line-formed"), long_lines, edits))
    return out


def classes_of_rows(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """A row for each line: doc_id, row, line_no, lead (the place of the class's first line), n_copies, kept."""
    ids, distinct = distinct_lines(split_lines(docs).where("line <> ''"))
    links = written(linked_lines(distinct, edits, min_chars), "line-links")
    classes = components(links)
    of_line = distinct.select("id", "first", "n_copies").join(classes.withColumnRenamed("node", "id"), "id", "left")
    of_line = written(of_line.select("id", "first", "n_copies", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("linked")), "line-roots")
    firsts = of_line.groupBy("root").agg(F.min("first").alias("lead"))
    settled = of_line.join(firsts, "root").where("n_copies > 1 OR linked")
    right = settled.select("id", "lead", "n_copies", F.lit(True).alias("met"), all_salts(SALTS).alias("salt"))
    place = F.struct("doc_id", "row", "line_no")
    every = ids.select("doc_id", "row", "line_no", "id", salted(place, SALTS).alias("salt"))
    out = every.join(right, ["id", "salt"], "left").withColumn("lead", F.when(F.col("met"), F.col("lead")).otherwise(place))
    kept = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.row") == F.col("row")) & (F.col("lead.line_no") == F.col("line_no"))
    return out.select("doc_id", "row", "line_no", "lead", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), kept.alias("kept"))


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line: doc_id, line_no, class_doc, class_line, n_copies, kept."""
    out = classes_of_rows(docs, edits, min_chars)
    return out.select("doc_id", "line_no", F.col("lead.doc_id").alias("class_doc"), F.col("lead.line_no").alias("class_line"), "n_copies", "kept")


def without_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that aren't kept taken out of ``text``.

    A document that loses all its lines (every one stands elsewhere) goes.
    """
    doc, row, lost = unused(["line_doc", "line_row", "line_gone"], docs.columns)
    gone = classes_of_rows(docs, edits, min_chars).where("NOT kept").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(lost))
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(row)), "left").withColumn("text", text)
    kept = out.where(F.col(lost).isNull() | (F.trim("text") != ""))
    return kept.select(*docs.columns)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
t AS (SELECT doc_id, line_no::INT AS line_no, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM r),
o AS (SELECT * FROM t WHERE line <> ''),
d AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS first, count(*) AS n_copies, length(line) AS n, row_number() OVER (ORDER BY line) AS id FROM o GROUP BY line),
p AS (SELECT a.id AS x, b.id AS y FROM d a JOIN d b ON a.n >= 20 AND b.n >= 20 AND b.n BETWEEN a.n AND a.n + 2 AND a.id <> b.id AND (b.n > a.n OR a.id < b.id)
  WHERE levenshtein(a.line, b.line) <= 2),
q AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT id AS node, id AS other FROM d UNION SELECT reach.node, q.y FROM reach JOIN q ON q.x = reach.other),
c AS (SELECT node, min(first) AS lead FROM reach JOIN d ON d.id = reach.other GROUP BY node)
SELECT o.doc_id, o.line_no, c.lead.d AS class_doc, c.lead.l AS class_line, d.n_copies,
  c.lead.d = o.doc_id AND c.lead.l = o.line_no AS kept
FROM o JOIN d ON d.line = o.line JOIN c ON c.node = d.id
"""
