"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

__all__ = ["bounded_batches", "checkpointed", "fold_of", "map_texts", "sliced", "table", "labelled_ids", "training_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, unless the session names a size: texts may be long."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fn: Callable[[Iterator[tuple[list, list]]], Iterator[dict[str, list]]],
    schema: str,
) -> DataFrame:
    """Apply ``fn`` to batches of (ids, texts) on the executors.

    ``fn`` gets an iterator of (ids, texts) and yields column dicts. Null texts
    arrive as empty strings. Only the two columns leave the scan.
    """
    bounded_batches(df.sparkSession)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[list, list]]:
            for batch in sliced(batches):
                yield batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]

        for columns in fn(pairs()):
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names}, schema=target)

    target = _arrow_schema(df.sparkSession, schema)
    return source.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def fold_of(id_col: str, folds: int):
    """crc32 of the id's decimal text modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def labelled_ids(labels: DataFrame, label_col: str, held_out, id_col: str = "doc_id") -> DataFrame:
    """(_id, _label) of every labelled row outside the held-out fold; a document labelled more than once takes its largest label."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
    )
    return known.where("_label in (0, 1)")


def training_rows(
    documents: DataFrame,
    labels: DataFrame,
    label_col: str,
    held_out,
    per_class: int,
    max_chars: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A bounded, deterministic sample of labelled rows outside the held-out fold.

    At most ``per_class`` rows of each label, those with the smallest hash of
    the id, among texts of at most ``max_chars`` characters. A document labelled
    more than once takes its largest label.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(2 * per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.where(F.length("_text") <= max_chars).join(F.broadcast(chosen), "_id")
    parts = [joined.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id", "_text").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])
