"""Harvest from end to end: which claims could a document make of its sources, and what became of each candidate.

Sources are the readable reads of the cited URLs. Every region of a source is scanned
against the document's prose on its own; the spans of a source's regions are united,
filtered and reported per URL. A proposal is what was copied, not what was meant: the
draft of a claims file says so, and a draft that somebody has edited is never replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import checkpointed
from ..sources.stores import there
from ..thresholds import THRESHOLDS
from .footnotes import claim_floor_message
from .harvest import drop_contained, filter_spans, scan_sources, scanned_pairs
from .rules import RuleSet

TOOL = "veracite"
# Fixed value: the sentence that a draft's note ends with.
DRAFT_SENTENCE = "every claim below is unconfirmed; harvest proposes what was copied, not what was meant"
NOTE = rf"^{TOOL} \S+ harvest draft, [0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\. {DRAFT_SENTENCE}\z"


def source_regions(scan: DataFrame, judged_reads: DataFrame) -> DataFrame:
    """(doc_id, key, rung, region_id, region, norm_region) of the readable reads of each readable source."""
    readable = scan.where("status = 'readable'").select("doc_id", "key", "url")
    reads = judged_reads.where("attempted and readable").select("url", "rung", "rung_ord", F.posexplode("regions").alias("region_ord", "region"))
    found = readable.join(reads, "url")
    return found.select("doc_id", "key", "rung", F.xxhash64("doc_id", "key", "rung_ord", "region_ord").alias("region_id"), "region", text.norm(F.col("region")).alias("norm_region"))


def harvest(prose: DataFrame, footnotes: DataFrame, claims: DataFrame, judged_reads: DataFrame, rules: RuleSet | None = None, seed: int = THRESHOLDS.harvest_seed_chars) -> tuple[DataFrame, DataFrame]:
    """(proposals, scan). One proposal per readable source of a document, whether or not anything is proposed.

    ``prose`` (doc_id, prose), ``claims`` (doc_id, key, claims, na_reason), ``judged_reads`` has signals and
    ``attempted``. Proposals are (doc_id, key, n, url, redirected_to, rungs, claims, drops, floor_messages, notes).
    """
    # each of these is read by several branches
    reads = checkpointed(judged_reads.where("attempted").select("url", "rung", "rung_ord", "attempted", "readable", "landed", F.when(F.col("readable"), F.col("regions")).alias("regions")))
    claims = checkpointed(claims)
    scan = checkpointed(scan_sources(footnotes, claims, reads))
    regions = checkpointed(source_regions(scan, reads))
    pairs = regions.join(prose, "doc_id").select("doc_id", "key", F.col("doc_id").alias("draft_id"), F.col("prose").alias("draft"), F.col("region_id").alias("source_id"), F.col("region").alias("source"))
    scanned = scanned_pairs(pairs, seed).withColumnsRenamed({"source_id": "region_id"}).drop("draft_id")
    owned = checkpointed(scanned.join(regions.select("doc_id", "key", "region_id"), "region_id"))
    order = F.struct("region_id", "span_ord")
    candidates = checkpointed(drop_contained(owned.where("span is not null").withColumn("_order", order), ["doc_id", "key"], "_order").select("doc_id", "key", "span"))
    labelled = filter_spans(candidates, regions, claims.where("claims is not null"), rules)
    kinds = ("floor", "frequency", "rules", "claimed")
    by_source = labelled.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.when(F.col("label") == "kept", F.col("span")))).alias("claims"),
        F.struct(*[F.count_if(F.col("label") == k).alias(k) for k in kinds]).alias("drops"),
        F.sort_array(F.collect_set(F.when(F.col("label") == "floor", claim_floor_message(F.col("key"), F.col("span"))))).alias("floor_messages"),
    )
    notes = owned.where("note is not null").groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("note")).alias("notes"))
    rungs = regions.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("rung")).alias("rungs"))
    readable = scan.where("status = 'readable'").select("doc_id", "key", "n", "url", "redirected_to")
    whole = readable.join(rungs, ["doc_id", "key"], "left").join(by_source, ["doc_id", "key"], "left").join(notes, ["doc_id", "key"], "left")
    none = F.array().cast("array<string>")
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in kinds])
    filled = {c: F.coalesce(c, none) for c in ("rungs", "claims", "floor_messages", "notes")} | {"drops": F.coalesce("drops", zero)}
    return whole.withColumns(filled).select("doc_id", "key", "n", "url", "redirected_to", "rungs", "claims", "drops", "floor_messages", "notes"), scan


def totals(proposals: DataFrame, scan: DataFrame) -> DataFrame:
    """One row per document: proposed claims, URLs by status, and whether the frequency filter had nothing to compare with."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    by_doc = scan.groupBy("doc_id").agg(status("readable"), status("unreachable"), status("skipped"))
    proposed = proposals.groupBy("doc_id").agg(F.sum(F.size("claims")).alias("proposals"))
    joined = by_doc.join(proposed, "doc_id", "left").withColumn("proposals", F.coalesce("proposals", F.lit(0).cast("long")))
    return joined.withColumn("frequency_vacuous", F.col("readable") < 2)


def draft_note(version: Column, date: Column) -> Column:
    return F.concat(F.lit(f"{TOOL} "), version, F.lit(" harvest draft, "), date, F.lit(f". {DRAFT_SENTENCE}"))


def is_harvest_note(note: Column) -> Column:
    """Whether a note is one that a draft was written with, of any version and date."""
    return F.coalesce(note.rlike(NOTE), F.lit(False))


def draft_files(proposals: DataFrame, version: str, date: str) -> DataFrame:
    """(doc_id, draft_json): a claims file with its note first; sources without claims are left out, keys are the first spelling cited."""
    entry = F.concat(F.substring(F.to_json(F.array("url")), F.lit(2), F.length(F.to_json(F.array("url"))) - 2), F.lit(":"), F.to_json("claims"))
    some = proposals.where(F.size("claims") > 0).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("entry")))), lambda e: e["entry"]).alias("entries"))
    every = proposals.select("doc_id").distinct().join(some, "doc_id", "left")
    note = F.to_json(F.struct(draft_note(F.lit(version), F.lit(date)).alias("_note")))
    rest = F.array_join(F.coalesce("entries", F.array().cast("array<string>")), ",")
    head = F.substring(note, F.lit(1), F.length(note) - 1)
    return every.select("doc_id", F.concat(head, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit(","), rest)), F.lit("}")).alias("draft_json"))


def in_the_way(drafts: DataFrame) -> DataFrame:
    """(doc_id, reason) of the stored drafts that are not as they were written; a null reason is never returned."""
    note = F.try_variant_get(F.try_parse_json("draft_json"), "$._note", "string")
    broken = F.try_parse_json("draft_json").isNull()
    reason = F.when(broken, "exists and is not a harvest draft (it is not JSON)").when(~is_harvest_note(note), 'exists and its "_note" is missing or edited')
    return drafts.select("doc_id", reason.alias("reason")).where("reason is not null")


def write_drafts(spark: SparkSession, drafts: DataFrame, path: str) -> None:
    """Store drafts; refused as a whole if a stored draft of one of the documents has been edited."""
    stored = there(spark, path)
    if stored is not None:
        edited = in_the_way(stored.join(drafts.select("doc_id"), "doc_id", "left_semi")).limit(5).collect()
        if edited:
            raise ValueError(f"{path}: " + "; ".join(f"{r['doc_id']} {r['reason']}" for r in edited) + "; rename or delete it and run again")
    drafts.select("doc_id", "draft_json").write.mode("overwrite").parquet(path)
