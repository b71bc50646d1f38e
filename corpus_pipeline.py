"""A corpus pipeline of five stages over ``documents``.

toxicity -> line dedup -> SimHash near-dedup -> substring dedup -> packing. Every
stage but the last returns the columns of documents; the last returns the pieces
of the packed sequences. A null text stays null until packing, where it is empty.
Texts that lose all their lines or words stay as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracite.llm import lines, packing, simhash, substrings, toxicity
from veracite.llm.common import checkpointed, fold_of, table
from veracite.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject the documents that the classifier, trained on the labelled rows of the input tables, finds toxic."""
    labels = table(spark, sf_dir, "labels")
    net = toxicity.fit(table(spark, sf_dir, "documents"), labels, held_out=fold_of("doc_id", 3) == 1)
    return toxicity.keep_clean(docs.select(*COLUMNS), net)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every line with an equal or near line before it."""
    return _documents(lines.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of texts that share 0.8 or more of their five-word shingles.

    Rows without an id cannot be told apart by it and stay, and so do rows with a null text, of which nothing is
    known. Texts without words are exact copies of each other. Rows repeated with one id and text leave one
    row. Of rows with one id and different texts each stands for its own group.
    """
    known = docs.where("doc_id is not null and text is not null")
    groups = simhash.wide_groups(docs.where("text is not null"), words=5, similarity=0.8)
    kept = groups.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    hashed = known.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    named = hashed.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null or text is null")).select(*COLUMNS)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 35 words or more that stand at several places."""
    return _documents(substrings.dedup(docs, window=35, with_text=True, carry=("lang", "source")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokenized texts into sequences of 2048."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", dedup_substrings),
    ("packing", pack),
]

#: SQL cannot express the classifier, the tokenizer or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; what each keeps is checkpointed to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
