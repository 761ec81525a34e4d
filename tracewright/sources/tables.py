"""Readers of the tables and logs, with declared schemas, and keyed sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_files(spark: SparkSession, root: str, extensions: Sequence[str], skipped: Sequence[str] = (".git", "node_modules", "build", "dist", "vendor")) -> DataFrame:
    """path, size, sha256, is_test of the wanted files below root, without skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split(F.col("path"), "/")
    wanted = F.lower(F.element_at(F.split("path", "\\."), -1)).isin([e.lower().lstrip(".") for e in extensions])
    kept = files.filter(wanted & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skipped])))
    return kept.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lower(F.element_at(parts, -1)).rlike("(^|[._-])tests?([._-]|$)").alias("is_test"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: a malformed line is an error, a blank line is skipped."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def new_rows(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The incoming rows to insert: of each key the first in the order, unless the key exists."""
    first = incoming.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
    return first.join(existing.select(*key).distinct(), list(key), "left_anti")


def conflicts(existing: DataFrame, incoming: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The keys of immutable rows that come again with another payload."""
    side = lambda df, n: df.select(*key, F.sha2(F.to_json(F.struct(*payload)), 256).alias(n))
    return side(existing, "_a").join(side(incoming, "_b"), list(key)).filter("_a <> _b").select(*key).distinct()


def put_content(df: DataFrame, content: str) -> DataFrame:
    """Content-addressed rows: digest, shard (first two hex digits, to partition by), content; each content once."""
    keyed = df.select(F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256)).alias("digest"), F.col(content).alias("content"))
    return keyed.dropDuplicates(["digest"]).withColumn("shard", F.substring("digest", 8, 2))
