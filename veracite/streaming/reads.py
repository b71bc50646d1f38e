"""Signals over a stream of reads: an extension, since every signal is a projection of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import RuleSet
from ..operators.signals import RAW_READS, with_signals


def stream_signals(spark: SparkSession, path: str, rules: RuleSet | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Reads that arrive as Parquet files under ``path`` (raw reads plus ``claims``), with their signals."""
    source = spark.readStream.schema(f"{RAW_READS}, claims array<string>").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return with_signals(source, rules)
