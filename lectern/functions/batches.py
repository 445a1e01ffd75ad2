"""Bounds on what the JVM and Python hold of a table at once."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows of text or signals in an Arrow batch, and about its bytes, unless one row has more.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Has the session send at most so many rows and bytes to Python at once: texts and signals are long, and both sides hold a
    batch whole."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        known = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if not known or not 0 < int(known[1]) <= most:
            spark.conf.set(name, str(most))
