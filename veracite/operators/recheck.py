"""Rechecking: the same claims against the live source and against what was archived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from . import archive
from .assemble import judge
from .rules import RuleSet
from .signals import with_signals


def check(reads: DataFrame, citations: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Verdicts of raw reads; ``citations`` has (url, claims). Both arms of a recheck go through here."""
    own = [c for c in reads.columns if c != "claims"]
    return judge(with_signals(reads.select(*own).join(citations.select("url", "claims"), "url"), rules))


def recheck(live_reads: DataFrame, citations: DataFrame, entries: DataFrame | None, blobs: DataFrame | None, tool_version: str, rules: RuleSet | None = None, rules_hash: Column | None = None, pdf_version: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(drift rows, live results). Without a readable archive every citation has no baseline. Nothing is written.

    ``citations`` has one row a URL; ``entries`` and ``blobs`` as in the archive store; only entries that were supported are replayed.
    """
    spark = live_reads.sparkSession
    live = checkpointed(check(live_reads, citations, rules))
    if entries is None or blobs is None:
        none = "key string, url string, archived_at string, verdict string, claims_hash string, tool_version string, local_rules_hash string, reads array<struct<rung:string,status:int,final_url:string,hash:string,pdftotext_version:string>>"
        entries = spark.createDataFrame([], none)
        replayed = spark.createDataFrame([], "url string, verdict string")
    else:
        supported = entries.where("verdict = 'supported'").join(citations.select("url"), "url", "left_semi")
        replayed = check(archive.replay(supported, blobs), citations, rules)
    return archive.compare(live, entries, replayed, tool_version, rules_hash, pdf_version), live


def recorded(source: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A read source whose reads are hashed as they would be archived."""
    return lambda citations: source(citations).withColumn("hash", F.sha2("raw_body", 256))
