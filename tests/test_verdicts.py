"""End-to-end verdicts over stub reads, without a network."""

import pytest
from pyspark.sql import functions as F

from veracite.operators import archive, assemble
from veracite.operators.recheck import recheck
from veracite.plans import analytics
from veracite.operators.ladder import attempted
from veracite.operators.rules import RuleSet, load_rules
from veracite.operators.signals import with_signals

DOC = "The committee published its annual statement on the matter. " * 120
STUB1, STUB2 = "The first claim stands in this short page here.", "The second claim stands in that short page there."
C1, C2, ABSENT = "first claim stands in this", "second claim stands in that", "nothing on any page says this"
HIT = "committee published its annual statement"


def read(url, rung, body, status=200, headers=None, final=""):
    return (url, rung, {"node": 0, "curl": 1, "pdftotext": 2}[rung], status, headers or {}, final, body, "text" if rung == "pdftotext" else "html")


WALL = {"CF-Mitigated": "challenge"}
CASES = {
    "https://a.com/first": ([HIT], [("node", DOC, 200, None, "")], "supported"),
    "https://a.com/wall-then-read": ([HIT, ABSENT], [("node", DOC, 200, WALL, ""), ("curl", DOC, 200, None, "")], "unsupported"),
    "https://a.com/gone-then-read": ([HIT, ABSENT], [("node", DOC, 404, None, ""), ("curl", DOC, 200, None, "")], "unsupported"),
    "https://a.com/two-short": ([C1, C2], [("node", STUB1, 200, None, ""), ("curl", STUB2, 200, None, "")], "supported"),
    "https://a.com/two-vetoed": ([HIT], [("node", DOC, 200, WALL, ""), ("curl", DOC, 404, None, "")], "unreachable"),
    "https://a.com/moved": ([ABSENT], [("node", DOC, 200, None, "https://a.com/")], "unreachable"),
    "https://a.com/escalates": ([HIT, C2], [("node", DOC, 200, None, ""), ("curl", STUB2, 200, None, "")], "supported"),
    "https://a.com/none": ([], [("node", DOC, 200, None, "")], "unclaimed"),
    "https://a.com/report.pdf": ([HIT], [("node", "binary", 200, None, ""), ("pdftotext", DOC, 0, None, "")], "supported"),
    "https://a.com/typed": ([HIT], [("node", "x", 200, {"content-type": "application/pdf"}, ""), ("pdftotext", DOC, 0, None, ""), ("curl", DOC, 200, None, "")], "supported"),
}


@pytest.fixture(scope="module")
def reads(spark):
    rows = [(*read(u, rung, body, status, headers, final), claims) for u, (claims, rs, _) in CASES.items() for rung, body, status, headers, final in rs]
    schema = "url string, rung string, rung_ord int, status int, headers map<string,string>, final_url string, raw_body string, body_kind string, claims array<string>"
    return with_signals(spark.createDataFrame(rows, schema)).persist()


def test_verdicts(reads):
    got = {r["url"]: r for r in assemble.judge(reads).collect()}
    assert {u: r["verdict"] for u, r in got.items()} == {u: want for u, (_, _, want) in CASES.items()}
    assert got["https://a.com/escalates"]["escalated"] and got["https://a.com/moved"]["redirected_to"] == "https://a.com/"
    assert got["https://a.com/typed"]["rungs_attempted"] == ["node", "pdftotext"]
    assert all(r["missed"] for r in got.values() if r["verdict"] == "unsupported")


def test_reachability_agrees_with_check(reads):
    reach = {r["url"]: r for r in assemble.reachability(attempted(reads)).collect()}
    judged = {r["url"]: r["verdict"] for r in assemble.judge(reads).collect()}
    for u, r in reach.items():
        if not r["readable"]:
            assert judged[u] != "unsupported"
    assert reach["https://a.com/two-vetoed"]["reason"] == "the origin says the document is gone (404/410)"


def test_evidence_shows_the_claim(reads):
    shown = assemble.with_evidence(assemble.judge(reads), reads).where("evidence is not null").collect()
    assert {r["url"] for r in shown} >= {"https://a.com/first", "https://a.com/two-short"}
    for r in shown:
        for e in r["evidence"]:
            assert e["excerpt"] is None or any(c in e["excerpt"] for c in e["claims"])


def test_a_run_counts_orphans_and_broken_rows(spark):
    results = spark.createDataFrame([("supported", 1), ("unreachable", 0)], "verdict string, status int")
    lost = spark.createDataFrame([(1, "k")], "doc_id long, key string")
    exit_of = lambda **given: assemble.run_exit(results, **given).first()
    assert exit_of()["exit_code"] == 0 and exit_of(orphaned=lost)["orphaned"] == 1 and exit_of(orphaned=lost)["exit_code"] == 0
    assert exit_of(orphaned=lost, fail_on_orphaned=True)["exit_code"] == 1 and exit_of(fail_on_unreachable=True)["exit_code"] == 1
    assert exit_of(infrastructure=F.col("status") == 0, fail_on_unreachable=True)["exit_code"] == 2


def test_recheck_against_an_archive_and_without_one(spark, reads):
    citations = reads.select("url", "claims").distinct()
    raw = reads.select("url", "rung", "rung_ord", "status", "headers", "final_url", "raw_body", "body_kind")
    entries = archive.entries(attempted(reads), assemble.judge(reads), "1.0", F.lit("2026-01-01"))
    gone = raw.withColumn("raw_body", F.when(F.col("url").endswith("/first"), F.lit(DOC.replace("committee", "council"))).otherwise(F.col("raw_body")))
    drift, live = recheck(gone, citations, entries, archive.blobs(raw), "1.0")
    got = {r["url"]: r["category"] for r in drift.collect()}
    assert got["https://a.com/first"] == "sourceDrift" and got["https://a.com/two-short"] == "clean" and got["https://a.com/moved"] == "noBaseline"
    assert {r["url"]: r["verdict"] for r in live.collect()}["https://a.com/first"] == "unsupported"
    drift, _ = recheck(raw, citations, None, None, "1.0")
    assert {r["category"] for r in drift.collect()} == {"noBaseline"}


def test_movement_of_verdicts(spark):
    schema = "url string, verdict string, rungs_attempted array<string>"
    before = spark.createDataFrame([("a", "supported", ["node"]), ("b", "unreachable", ["node"]), ("c", "unsupported", ["node"])], schema)
    after = spark.createDataFrame([("a", "supported", ["node"]), ("b", "supported", ["node", "curl"]), ("c", "supported", ["node"])], schema)
    moved = analytics.moved_rows(before, after)
    assert analytics.movement_summary(moved).first().asDict() == {"urls": 3, "moved": 2, "rungs_changed": 1, "same_rungs": 1}
    for wrong in (analytics.moved_rows(before, after.limit(2)), analytics.moved_rows(before.limit(0), after.limit(0))):
        with pytest.raises(Exception, match="only one result set|no rows"):
            analytics.movement_summary(wrong).collect()


def test_spans_per_pair_count_pairs_without_any(spark):
    pairs = spark.createDataFrame([(1, "the old harbour wall was rebuilt in stone", 7, "they say the old harbour wall was rebuilt"), (1, "the old harbour wall was rebuilt in stone", 8, "nothing alike here")], "draft_id long, draft string, source_id long, source string")
    rows = {r["seed"]: r for r in analytics.seed_sweep(pairs, (8, 21, 60)).collect()}
    assert (rows[21]["pairs"], rows[21]["mean"], rows[21]["most"], rows[21]["most_above"]) == (2, 0.5, 1, 1) and rows[60]["most"] == 0


def test_drift_table(spark):
    rows = [
        (None, "supported", None, False, 0, "noBaseline"),
        ("unsupported", "supported", None, False, 0, "noBaseline"),
        ("supported", "unreachable", "supported", True, 1, "gone"),
        ("supported", "unsupported", "supported", False, 1, "confounded"),
        ("supported", "unreachable", "supported", False, 0, "unreachable"),
        ("supported", "unclaimed", "supported", False, 0, "unclaimed"),
        ("supported", "supported", "supported", False, 0, "clean"),
        ("supported", "supported", "unsupported", False, 0, "pipelineDrift"),
        ("supported", "unsupported", "supported", False, 0, "sourceDrift"),
        ("supported", "unsupported", "unreachable", False, 0, "pipelineDrift"),
    ]
    df = spark.createDataFrame(rows, "rec string, live string, rep string, gone boolean, n int, want string")
    got = df.select("want", archive.drift_category(F.col("rec"), F.col("live"), F.col("rep"), F.col("gone"), F.col("n")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_rules_are_additive_and_checked():
    more = load_rules('{"signatures": [{"pattern": "my wall", "lastConfirmed": "2026-01-01", "note": "n"}], "hosts": []}')
    assert len(more.signatures) == len(RuleSet().signatures) + 1
    for bad in ('{"paths": [{"pattern": "x", "note": "n"}]}', '{"paths": [{"pattern": "(", "lastConfirmed": "2026-01-01", "note": "n"}]}'):
        with pytest.raises(ValueError):
            load_rules(bad)
