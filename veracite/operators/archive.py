"""Archives of supported citations, their replay, and drift between two checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import claims_hash
from ..functions.url import normalize_url
from .ladder import read_ord

FORMAT_VERSION = 1


def without_set_cookie(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: F.lower(k) != "set-cookie")


def blobs(reads: DataFrame) -> DataFrame:
    """(hash, prefix, body) of distinct bodies; ``prefix`` partitions the files."""
    hashed = reads.select(F.sha2("raw_body", 256).alias("hash"), F.col("raw_body").alias("body")).dropDuplicates(["hash"])
    return hashed.select("hash", F.substring("hash", 1, 2).alias("prefix"), "body")


def entries(reads: DataFrame, results: DataFrame, tool_version: str, archived_at: Column, local_rules_hash: Column | None = None, pdf_version: Column | None = None) -> DataFrame:
    """One archive row per supported citation: its attempted reads in order, with body hashes.

    ``reads`` has ``attempted``, and ``read_ord`` where a rung read a URL several times;
    ``results`` has url, claims and verdict. Results that name their ``reads_attempted`` are
    archived with those: further rungs climbed for the verdict are among them. Headers are in
    the order of the reads.
    """
    pdf_version = pdf_version if pdf_version is not None else F.lit(None).cast("string")
    read = F.struct(
        "rung_ord", "rung", "status", "final_url", F.sha2("raw_body", 256).alias("hash"),
        F.when(F.col("rung") == "pdftotext", pdf_version).alias("pdftotext_version"),
    )
    supported = results.where("verdict = 'supported'")
    taken = reads.where("attempted")
    if "reads_attempted" in results.columns:
        ordered = reads.withColumn("read_ord", read_ord(reads).cast("long"))
        taken = ordered.join(supported.select("url", "reads_attempted"), "url").where("array_contains(reads_attempted, struct(rung, read_ord))")
    # maps cannot be sorted, their entries can
    kept = taken.select("url", F.struct("rung_ord", read_ord(taken).alias("read_ord"), read.alias("read"), F.map_entries(without_set_cookie(F.col("headers"))).alias("headers")).alias("r"))
    by_url = kept.groupBy("url").agg(F.sort_array(F.collect_list("r")).alias("ordered"))
    return by_url.join(supported.select("url", "claims", "verdict"), "url").select(
        normalize_url(F.col("url")).alias("key"),
        "url",
        archived_at.alias("archived_at"),
        "verdict",
        claims_hash(F.col("claims")).alias("claims_hash"),
        F.lit(tool_version).alias("tool_version"),
        (local_rules_hash if local_rules_hash is not None else F.lit(None).cast("string")).alias("local_rules_hash"),
        F.transform("ordered", lambda o: o["read"]).alias("reads"),
        F.transform("ordered", lambda o: F.struct(o["rung_ord"].alias("rung_ord"), F.map_from_entries(o["headers"]).alias("headers"))).alias("headers"),
        F.lit(FORMAT_VERSION).alias("version"),
    )


def material(entry: str) -> Column:
    """What makes two entries the same: not when they were archived and not the headers."""
    field = lambda c: F.col(f"{entry}.{c}")
    reads = F.transform(field("reads"), lambda r: F.struct(r["rung"], r["status"], r["final_url"], r["hash"], r["pdftotext_version"]))
    return F.struct(field("claims_hash"), field("tool_version"), field("local_rules_hash"), reads)


def _spelling(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Add what pairs rows of one key in two sets: the URL where both hold it, else the rank among the rest of the key.

    One key may stand for several URLs, spelled differently, each with a row of its own.
    """
    both = others.select("url", F.lit(True).alias("_both")).distinct()
    marked = rows.join(both, "url", "left").withColumn("_both", F.coalesce("_both", F.lit(False))).select(*rows.columns, "_both")
    rank = F.row_number().over(Window.partitionBy("key", "_both").orderBy("url"))
    return marked.withColumn("_spelling", F.when(F.col("_both"), F.col("url")).otherwise(rank.cast("string"))).drop("_both")


def merge(old: DataFrame, staged: DataFrame) -> DataFrame:
    """The new index: staged rows replace old ones of their key unless they are materially equal; others stay."""
    o, s = _spelling(old, staged).alias("o"), _spelling(staged, old).alias("s")
    joined = o.join(s, (F.col("o.key") == F.col("s.key")) & (F.col("o._spelling") == F.col("s._spelling")), "full_outer")
    same = material("o").eqNullSafe(material("s"))
    keep_old = F.col("s.key").isNull() | (F.col("o.key").isNotNull() & same)
    return joined.select(*[F.when(keep_old, F.col(f"o.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in old.columns])


def replay(archive: DataFrame, blob_table: DataFrame) -> DataFrame:
    """Raw reads as archived; a missing body gives the empty response. The n-th read of a rung has the n-th headers of it."""
    reads = archive.select("url", "reads", "headers", F.posexplode("reads").alias("read_ord", "r"))
    alike = lambda entries: F.filter(entries, lambda e: e["rung_ord"] == F.col("r.rung_ord"))
    own = F.get(alike(F.col("headers")), F.size(alike(F.slice("reads", F.lit(1), F.col("read_ord")))))
    reads = reads.select("url", F.col("read_ord").cast("long").alias("read_ord"), "r", own["headers"].alias("own"))
    joined = reads.join(blob_table.select("hash", "body"), reads["r.hash"] == blob_table["hash"], "left")
    there = F.col("body").isNotNull()
    return joined.select(
        "url", "r.rung", "r.rung_ord", "read_ord",
        F.when(there, F.col("r.status")).otherwise(F.lit(0)).alias("status"),
        F.when(there, F.col("own")).otherwise(F.create_map().cast("map<string,string>")).alias("headers"),
        F.when(there, F.col("r.final_url")).otherwise(F.lit("")).alias("final_url"),
        F.coalesce("body", F.lit("")).alias("raw_body"),
        F.when(F.col("r.rung") == "pdftotext", "text").otherwise("html").alias("body_kind"),
    )


def confounds(claims_now: Column, pdf_version: Column, rules_hash: Column) -> Column:
    """Named reasons why a difference may not be the source's: ``archive`` columns against the present."""
    recorded = F.filter(F.transform("reads", lambda r: r["pdftotext_version"]), lambda v: v.isNotNull())
    differing = F.get(F.filter(recorded, lambda v: ~v.eqNullSafe(pdf_version)), 0)
    found = F.array(
        F.when(F.col("claims_hash") != claims_now, F.concat(F.lit("the claims for this URL changed since "), F.col("archived_at").cast("string"))),
        F.when(differing.isNotNull(), F.concat(F.lit("pdftotext here is "), F.coalesce(pdf_version, F.lit("not installed")), F.lit(" and was "), differing, F.lit(" when this was archived"))),
        F.when(~F.col("local_rules_hash").eqNullSafe(rules_hash), F.lit("the local --rules file differs from the one recorded")),
    )
    return F.filter(found, lambda c: c.isNotNull())


def drift_category(recorded: Column, live: Column, replayed: Column, live_gone: Column, n_confounds: Column) -> Column:
    """Why a live check differs from its archive, in order of precedence."""
    held = replayed.eqNullSafe(F.lit("supported"))
    return (
        F.when(~recorded.eqNullSafe(F.lit("supported")), "noBaseline")
        .when(live_gone, "gone")
        .when(n_confounds > 0, "confounded")
        .when(live == "unreachable", "unreachable")
        .when(live == "unclaimed", "unclaimed")
        .when(live == "supported", F.when(held, "clean").otherwise("pipelineDrift"))
        .when(held, "sourceDrift")
        .otherwise("pipelineDrift")
    )


def compare(live: DataFrame, archive: DataFrame, replayed: DataFrame, tool_version: str, rules_hash: Column | None = None, pdf_version: Column | None = None) -> DataFrame:
    """One drift row per live citation; ``live`` and ``replayed`` are judged results.

    A citation meets the entry of its URL; where there is none, one of its key whose URL is not cited any more.
    """
    none = F.lit(None).cast("string")
    rules_hash, pdf_version = rules_hash if rules_hash is not None else none, pdf_version if pdf_version is not None else none
    now = live.select("url", normalize_url(F.col("url")).alias("key"), F.col("verdict").alias("live"), F.col("missed").alias("live_missed"), "statuses", claims_hash(F.col("claims")).alias("now_hash"))
    past = archive.select("key", F.col("url").alias("past_url"), "archived_at", F.col("verdict").alias("recorded"), "claims_hash", F.col("tool_version").alias("archived_tool"), "local_rules_hash", "reads")
    again = replayed.select(F.col("url").alias("past_url"), F.col("verdict").alias("archived"))
    known = archive.select("key", "url").distinct()
    same = known.join(now.select("url"), "url", "left_semi").select("url", F.col("url").alias("past_url"))
    left = known.join(now.select("url"), "url", "left_anti").groupBy("key").agg(F.min("url").alias("past_url"))
    respelled = now.join(known.select("url"), "url", "left_anti").select("key", "url").join(left, "key").select("url", "past_url")
    pairs = same.unionByName(respelled)
    joined = now.join(pairs, "url", "left").join(past.drop("key"), "past_url", "left").join(again, "past_url", "left")
    gone = (F.col("live") == "unreachable") & F.exists("statuses", lambda s: s.isin(404, 410))
    baseline = F.col("recorded").eqNullSafe(F.lit("supported"))
    step = joined.withColumns(
        {
            "live_gone": F.coalesce(gone, F.lit(False)),
            "confounds": F.when(baseline, confounds(F.col("now_hash"), pdf_version, rules_hash)).otherwise(F.array().cast("array<string>")),
            "bundled_version_changed": F.coalesce(F.col("archived_tool") != tool_version, F.lit(False)),
        }
    )
    step = step.withColumn("category", drift_category(F.col("recorded"), F.col("live"), F.col("archived"), F.col("live_gone"), F.size("confounds")))
    missed = F.when(F.col("category") == "sourceDrift", F.col("live_missed")).otherwise(F.array().cast("array<string>"))
    shown = F.when(F.col("category").isin("gone", "confounded"), F.col("confounds")).otherwise(F.array().cast("array<string>"))
    return step.select("url", "key", "category", "live", "archived", "recorded", "archived_at", shown.alias("confounds"), "live_gone", "bundled_version_changed", missed.alias("missed"))


def recheck_exit(drift: DataFrame, fail_on_gone: bool = False) -> DataFrame:
    """Tally and exit code: 1 for source drift (and gone, if opted in) before 2 for pipeline drift."""
    names = ("clean", "sourceDrift", "pipelineDrift", "gone", "unreachable", "noBaseline", "confounded", "unclaimed")
    tally = drift.agg(*[F.count_if(F.col("category") == n).alias(n) for n in names])
    one = (F.col("sourceDrift") > 0) | ((F.col("gone") > 0) & F.lit(fail_on_gone))
    return tally.withColumn("exit_code", F.when(one, 1).when(F.col("pipelineDrift") > 0, 2).otherwise(0))
