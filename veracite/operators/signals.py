"""Signals of each read: text regions, matches, vetoes and the single-read verdict.

``reads`` rows are (url, rung, rung_ord, status, headers, final_url, raw_body,
body_kind); claims arrive as an array column. Everything is a projection, so a
table of reads of any size takes one pass and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, text, url
from ..functions.bind import let
from ..thresholds import THRESHOLDS
from .rules import RuleSet, path_rule, rule_field, signature_rule

RAW_READS = (
    "url string, rung string, rung_ord int, status int, headers map<string,string>, final_url string, raw_body string, body_kind string"
)


def header_values(headers: Column, name: str) -> Column:
    """Every value of a header, whatever the case of its name."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.transform(entries, lambda e: e["value"]), F.array().cast("array<string>"))


def challenge_header(headers: Column) -> Column:
    return F.exists(header_values(headers, "cf-mitigated"), lambda v: F.coalesce(F.contains(F.lower(v), F.lit("challenge")), F.lit(False)))


def non_textual(headers: Column) -> Column:
    return F.exists(header_values(headers, "content-type"), lambda v: ~F.coalesce(extract.is_textual(v), F.lit(True)))


def gone(status: Column) -> Column:
    return F.coalesce(status.isin(404, 410), F.lit(False))


def verdict(total: Column, matched: Column, blocked: Column, readable: Column) -> Column:
    """An accusation needs proof that a document was read; a full match is its own proof."""
    return (
        F.when(total == 0, "unclaimed").when(blocked, "unreachable").when(matched == total, "supported").when(readable, "unsupported").otherwise("unreachable")
    )


def with_signals(reads: DataFrame, rules: RuleSet | None = None, claims_col: str = "claims", label_col: str | None = None) -> DataFrame:
    """Add regions, text, prose_chars, matched and missed claims, the five vetoes, blocked, readable and verdict."""
    rules = rules or RuleSet()
    landed = F.when(F.coalesce(F.col("final_url"), F.lit("")) == "", F.col("url")).otherwise(F.col("final_url"))
    body = F.coalesce(F.col("raw_body"), F.lit(""))
    claims = F.coalesce(F.col(claims_col), F.array().cast("array<string>"))
    step = reads.withColumns({"landed": landed, "claims": claims, "regions": extract.regions(body, F.col("body_kind"))})
    step = step.withColumns({"text": F.array_join("regions", " "), "norm_regions": F.transform("regions", text.norm), "norm_claims": F.transform("claims", text.norm)})
    # bound, or a filter on what follows would bring the normalization of all regions into the test of each claim
    hits = let(F.col("norm_regions"), lambda regions: F.transform("norm_claims", lambda c: F.exists(regions, lambda r: F.contains(r, c))))
    step = step.withColumns({"hits": hits, "prose_chars": text.utf16_length(F.col("text"))})
    pick = lambda keep: F.transform(F.filter(F.arrays_zip("claims", "hits"), lambda p: p["hits"] == keep), lambda p: p["claims"])
    step = step.withColumns(
        {
            "matched_claims": pick(True),
            "missed_claims": pick(False),
            "total": F.size("claims"),
            "path_rule": path_rule(F.col("landed"), rules),
            "signature_rule": signature_rule(F.col("norm_regions"), rules),
            "challenge_header": challenge_header(F.col("headers")),
            "document_gone": gone(F.col("status")),
            "not_text": non_textual(F.col("headers")) | extract.looks_binary(body),
            "head_markers": extract.head_markers(body),
            "slug_label_overlap": text.slug_label_overlap(F.col("text"), url.pathname(F.col("landed")), F.col(label_col) if label_col else F.lit("")),
        }
    )
    step = step.withColumns(
        {
            "matched": F.size("matched_claims"),
            "challenge_path": F.col("path_rule").isNotNull(),
            "challenge_signature": F.col("signature_rule").isNotNull() & (F.col("prose_chars") < THRESHOLDS.max_challenge_chars),
            "fired_note": F.coalesce(rule_field(rules.paths, F.col("path_rule"), "note"), rule_field(rules.signatures, F.col("signature_rule"), "note")),
            "fired_confirmed": F.coalesce(
                rule_field(rules.paths, F.col("path_rule"), "last_confirmed"), rule_field(rules.signatures, F.col("signature_rule"), "last_confirmed")
            ),
        }
    )
    vetoes = F.col("challenge_header") | F.col("challenge_path") | F.col("challenge_signature") | F.col("document_gone") | F.col("not_text")
    step = step.withColumn("blocked", vetoes)
    step = step.withColumn("readable", ~F.col("blocked") & (F.col("prose_chars") >= THRESHOLDS.min_prose_chars))
    return step.withColumn("verdict", verdict(F.col("total"), F.col("matched"), F.col("blocked"), F.col("readable"))).drop("hits")
