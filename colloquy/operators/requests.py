"""Requests and their answers: latencies as a table, pages in an envelope, items as lines of text."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

FIELDS = "request long, name string, rows long, began timestamp, ms double"


class Latencies:
    """Runs requests one after the other and keeps (request, name, rows, began, ms) of each in a table.

    The rows are counted by the plan itself (``DataFrame.observe``), whatever the
    request does with them. Entries are appended in groups; ``table`` writes what waits.
    """

    def __init__(self, spark: SparkSession, folder: str, group: int = 100):
        self.spark, self.folder, self.group, self.waiting, self.n = spark, folder, group, [], 0

    def run(self, name: str, answer: DataFrame, take=DataFrame.collect) -> list[Row]:
        """``take(answer)``, with its time noted; a failed request has a null number of rows and raises."""
        import datetime

        seen, began, at = Observation(), datetime.datetime.now(), time.perf_counter()
        rows = None
        try:
            out = take(answer.observe(seen, F.count(F.lit(1)).alias("rows")))
            rows = seen.get["rows"]
            return out
        finally:
            self.n += 1
            self.waiting.append((self.n, name, rows, began, (time.perf_counter() - at) * 1000))
            if len(self.waiting) >= self.group:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.spark.createDataFrame(self.waiting, FIELDS).coalesce(1).write.mode("append").parquet(self.folder)
            self.waiting = []

    def table(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(FIELDS).parquet(self.folder) if self.n else self.spark.createDataFrame([], FIELDS)


def latency_stats(latencies: DataFrame) -> DataFrame:
    """Number of requests and least, mean and largest time of each kind of request."""
    return latencies.groupBy("name").agg(F.count("*").alias("n"), F.min("ms").alias("low"), F.avg("ms").alias("mean"), F.max("ms").alias("high"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, name: str = "meetings") -> DataFrame:
    """One row ``body``: a JSON page of ``rows`` in ``order``, with the total before paging, the limit and the offset.

    A page has ``limit`` rows at most, so it fits in a row.
    """
    from colloquy.operators.search import check_page

    check_page(limit, offset)
    from pyspark.sql import Window as W

    fields = F.struct(*rows.columns)
    some = rows.orderBy(*order).offset(offset).limit(limit).withColumn("_at", F.row_number().over(W.orderBy(*order)))
    packed = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", fields.alias("row")))), lambda s: s["row"]).alias(name))
    whole = packed.join(F.broadcast(rows.agg(F.count("*").alias("total"))))
    return whole.select(F.to_json(F.struct(name, "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))).alias("body"))


def text_table(rows: DataFrame, key: str, headers: dict[str, str], missing: str = "N/A") -> DataFrame:
    """(key, line): rows as lines of columns that are as wide as their widest value; the header and a rule have no key.

    ``headers`` gives each column's heading; nulls are ``missing``. ``line_no`` orders
    the header (0), the rule (1) and the rows (2, then by key).
    """
    shown = rows.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in headers])
    widths = shown.agg(*[F.greatest(F.coalesce(F.max(F.char_length(c)), F.lit(0)), F.lit(len(h))).alias(f"w_{c}") for c, h in headers.items()])  # one row
    wide = lambda c: F.col(f"w_{c}")
    body = shown.join(F.broadcast(widths)).select(F.lit(2).alias("line_no"), key, F.concat_ws(" | ", *[F.rpad(c, wide(c), F.lit(" ")) for c in headers]).alias("line"))
    none = F.lit(None).cast(dict(rows.dtypes)[key]).alias(key)
    head = widths.select(F.lit(0).alias("line_no"), none, F.concat_ws(" | ", *[F.rpad(F.lit(h), wide(c), F.lit(" ")) for c, h in headers.items()]).alias("line"))
    rule = widths.select(F.lit(1).alias("line_no"), none, F.concat_ws("-+-", *[F.rpad(F.lit("-"), wide(c), F.lit("-")) for c in headers]).alias("line"))
    return head.unionByName(rule).unionByName(body)
