"""Sinks: JSON lines, one file a step or report, and bundles that are written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContentConflict(RuntimeError):
    """A file that is there already has another content."""


def append_events(events: DataFrame, path: str) -> None:
    """One compact JSON line an event; what is there stays."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """ts, type, entry, file and line of every event, in any order; a blank line is skipped.

    A malformed line, or one without ts or type, is an error that names its file and line.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "entry")).filter("trim(entry) <> ''")
    found = F.from_json("entry", "ts string, type string")
    at = F.concat(F.lit("bad event in "), F.col("file"), F.lit(" at line "), (F.col("line") + 1).cast("string"))
    checked = lines.withColumn("e", F.when(found["ts"].isNotNull() & found["type"].isNotNull(), found).otherwise(F.raise_error(at).cast("struct<ts: string, type: string>")))
    return checked.select("e.ts", "e.type", "entry", "file", (F.col("line") + 1).alias("line"))


def stored_files(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """keys and content of the files below root; no rows if there are none."""
    try:
        return spark.read.option("basePath", root).text(root, wholetext=True).select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("value").alias("content"))
    except AnalysisException:
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", content string")


def materialize(files: DataFrame, root: str, keys: Sequence[str]) -> int:
    """Writes content to one folder for each key below root and returns how many files are new.

    A file that is there with the same content is left alone; with another content nothing is written at all and
    ContentConflict names the first such key. keys must name columns whose values differ from file to file.
    """
    spark = files.sparkSession
    wanted = files.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("content").cast("string").alias("content"))
    there = stored_files(spark, root, keys).withColumnRenamed("content", "_there").withColumn("_there", F.regexp_replace("_there", "\n$", ""))
    both = wanted.join(there, list(keys), "left")
    differs = F.col("_there").isNotNull() & (F.regexp_replace("content", "\n$", "") != F.col("_there"))
    if bad := both.filter(differs).orderBy(*keys).first():
        raise ContentConflict("/".join(bad[k] for k in keys))
    new = both.filter(F.col("_there").isNull()).select(*keys, F.col("content").alias("value"))
    n = new.count()
    if n:
        new.write.mode("append").partitionBy(*keys).text(root)
    return n
