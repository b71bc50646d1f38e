"""Sinks and stores: evidence, archives with their blobs, and header dumps.

Paths go to Spark's readers and writers alone, so any store that Spark knows
will do. An archive is a folder of versions; a version is written whole and named
by a pointer table afterwards, so a reader never sees half of one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import FORMAT_VERSION, merge

EVIDENCE_FIELDS = ("url", "verdict", "rungs_attempted", "rungs_available", "ladder_truncated", "missed", "evidence", "retrieved_at", "redirected_to")


def evidence_rows(judged: DataFrame, now: Column) -> DataFrame:
    """Results as they are stored: passages and time for supported and unsupported, missed claims for unsupported alone."""
    shown = F.col("verdict").isin("supported", "unsupported")
    rows = judged.withColumn("retrieved_at", F.when(shown, now)).withColumn("missed", F.when(F.col("verdict") == "unsupported", F.col("missed")))
    return rows.select(*[c for c in EVIDENCE_FIELDS if c in rows.columns])


def write_evidence(rows: DataFrame, path: str) -> None:
    rows.withColumn("version", F.lit(FORMAT_VERSION)).write.mode("overwrite").parquet(path)


def there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none; an unreadable one raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored results; none where the file is absent."""
    found = there(spark, path)
    return spark.createDataFrame([], schema) if found is None else found.where(F.col("version") == FORMAT_VERSION).drop("version")


def read_archive(spark: SparkSession, path: str) -> tuple[str, DataFrame | None]:
    """("absent", None), ("ok", entries), or (why it is unreadable, None)."""
    pointer = there(spark, f"{path}/current")
    if pointer is None:
        return "absent", None
    named = pointer.first()
    entries = there(spark, f"{path}/{named['folder']}") if named else None
    if entries is None:
        return f"unreadable: {path} names no index that is there", None
    if "version" not in entries.columns or not entries.where(~F.col("version").eqNullSafe(FORMAT_VERSION)).isEmpty():
        return f"unreadable: {path} has another format version", None
    return "ok", entries


def read_blobs(spark: SparkSession, path: str) -> DataFrame | None:
    return there(spark, f"{path}/blobs")


def write_archive(spark: SparkSession, path: str, staged: DataFrame, blobs: DataFrame) -> None:
    """Merge staged entries into the archive: new bodies first, then the index, then the pointer.

    No staged entries change nothing; an unreadable archive is never written over.
    """
    state, old = read_archive(spark, path)
    if state.startswith("unreadable"):
        raise ValueError(f"{state}; it is left as it is")
    if staged.isEmpty():
        return
    known = read_blobs(spark, path)
    fresh = blobs if known is None else blobs.join(known.select("hash"), "hash", "left_anti")
    fresh.write.mode("append").partitionBy("prefix").parquet(f"{path}/blobs")
    number = 1 if old is None else int(spark.read.parquet(f"{path}/current").first()["folder"].rpartition("-")[2]) + 1
    merged = staged if old is None else merge(old, staged.select(old.columns))
    merged.orderBy("key").write.parquet(f"{path}/index-{number}")
    spark.createDataFrame([(f"index-{number}",)], "folder string").write.mode("overwrite").parquet(f"{path}/current")


def parse_header_dump(dump: Column) -> Column:
    """Headers of the last block that is not an interim (1xx) answer, names in lower case, the last value of a name."""
    blocks = F.split(F.regexp_replace(dump, "\\r\\n", "\n"), "\n\n")
    final = F.element_at(F.filter(blocks, lambda b: b.rlike(r"^HTTP/[0-9.]+ [0-9]+") & ~b.rlike(r"^HTTP/[0-9.]+ 1[0-9][0-9]")), -1)
    lines = F.filter(F.split(final, "\n"), lambda x: x.rlike(r"^[^\s:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["k"] == p["k"]))
    return F.map_from_entries(last)


def measured_anew(todo: DataFrame, path: str, key: str = "url") -> DataFrame:
    """The rows whose key is not yet in the measurements at ``path``."""
    done = there(todo.sparkSession, path)
    return todo if done is None else todo.join(done.select(key), key, "left_anti")


def measure(todo: DataFrame, path: str, of, key: str = "url") -> None:
    """Append what ``of`` makes of the rows that have no measurement yet; a run that was stopped goes on where it was."""
    of(measured_anew(todo, path, key)).write.mode("append").parquet(path)
