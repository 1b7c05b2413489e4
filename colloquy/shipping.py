"""The package itself as an archive for executors that don't have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application.

    Executors needn't have it installed: Spark's own file server carries the
    archive, so it also reaches executors that start later.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), f"colloquy_{uuid.uuid4().hex[:8]}"), "zip", os.path.dirname(home), "colloquy")
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)
