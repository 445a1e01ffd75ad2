"""Preparation as a stream: units arrive, each answer is stored under its content key, nothing is asked twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import artifact
from ..operators.edits import EDIT
from ..plans import prepare


#: Leading hex digits of a key that name its part of the store.
PREFIX = 2


def store_misses(batch: DataFrame, folder: str, provider: str, number: int = 0) -> None:
    """Answers what the store below folder lacks and appends it. A batch that is run again finds its own answers.

    The store lies in parts by the beginning of the key, and only those that the batch asks for are read.
    """
    spark = batch.sparkSession
    once = prepare.requests(batch, provider).filter("kind = 'prose'").dropDuplicates(["cache_key"])
    parts = [r[0] for r in once.select(F.left("cache_key", F.lit(PREFIX))).distinct().collect()]  # at most 256
    known = stored(spark, folder, parts)
    misses = once if known is None else artifact.resumed(once, known)[1]
    done = prepare.answered(misses, provider).withColumns({"part": F.left("cache_key", F.lit(PREFIX)), "written": F.lit(number).cast("long")})
    done.select("cache_key", *prepare.CACHED, "issues", "written", "part").write.mode("append").partitionBy("part").parquet(folder)


def stored(spark: SparkSession, folder: str, parts: list[str] | None = None) -> DataFrame | None:
    """The store so far, the last answer of each key; None before the first one. With parts, only these are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.option("basePath", folder).schema(STORED).parquet(folder)
    rows = rows if parts is None else rows.filter(F.col("part").isin(parts))
    return artifact.latest(rows.drop("part"), "written").drop("written")


STORED = f"cache_key string, prepared_text string, edits array<{EDIT}>, warnings array<string>, provider string, model string, issues array<string>, written long, part string"


def start(units: DataFrame, folder: str, checkpoint: str, provider: str = "rules", available_now: bool = True) -> StreamingQuery:
    """units: a streaming table of units with title. Progress and restarts are Spark's, from the checkpoint folder."""
    writer = units.filter("kind = 'prose'").writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, number: store_misses(batch, folder, provider, number))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def without_repeats(lines: DataFrame, order: str, line: str) -> DataFrame:
    """A log without lines that equal the one before them. The log of one pull is small and ordered as a whole."""
    from pyspark.sql import Window

    before = F.lag(line).over(Window.partitionBy("model").orderBy(order))
    return lines.withColumn("_b", before).filter(~F.col(line).eqNullSafe(F.col("_b"))).drop("_b")
