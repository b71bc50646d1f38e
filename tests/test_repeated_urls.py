"""Pages that share a URL, and URLs that share a key: one row a URL, as the SQL says, its open ties settled by the page's number."""

import duckdb
import pytest

from veracite.queries import ORACLE, QUERIES

TIES = (("order by rung_ord rows", "order by rung_ord, page_id rows"), ("else -prose_chars end), rung_ord", "else -prose_chars end), rung_ord, page_id"))
# (URL number, words of the body): readable pages have 900 words, others 60
PAGES = [(k // 2 if k % 9 else k // 2 + 1, 900 + 7 * k if k % 4 else 60 + k) for k in range(60)]


def url(k):
    return f"https://e{k // 2}.example.com/en/{k // 2}" + ("?utm_source=feed" if k % 2 else "")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeated"))
    rows = [(k, url(u), "<html><body><p>" + " ".join(f"w{k}x{i}" for i in range(n)) + "</p></body></html>") for k, (u, n) in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ("drift_category", "recheck_exit", "archive_blobs", "archive_merge", "assemble_verdict", "evidence_located", "reachability", "ladder_attempts", "missed_claims", "verdict_movement", "movement_summary"))
def test_a_url_of_several_pages(spark, sf_dir, name):
    sql = ORACLE[name]
    for left_open, settled in TIES:
        sql = sql.replace(left_open, settled)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet/*.parquet')")
    want = con.execute(sql).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_a_key_spelled_anew_replaces_its_row(spark):
    from veracite.operators.archive import merge

    schema = "key string, url string, archived_at string, claims_hash string, tool_version string, local_rules_hash string, reads array<struct<rung:string,status:int,final_url:string,hash:string,pdftotext_version:string>>"
    row = lambda url, at, claims: ("k", url, at, claims, "1", None, [("node", 200, "k", "h", None)])
    old = spark.createDataFrame([row("k?a", "day1", "c"), row("k?b", "day1", "c")], schema)
    both = merge(old, spark.createDataFrame([row("k?a", "day2", "d"), row("k?b", "day2", "c")], schema))
    assert sorted((r["url"], r["archived_at"]) for r in both.collect()) == [("k?a", "day2"), ("k?b", "day1")]
    anew = merge(old.where("url = 'k?a'"), spark.createDataFrame([row("k?c", "day2", "d")], schema))
    assert [(r["url"], r["archived_at"]) for r in anew.collect()] == [("k?c", "day2")]


def test_reads_climbed_for_the_verdict_are_archived(spark):
    from pyspark.sql import functions as F

    from veracite.operators import archive, assemble
    from veracite.operators.ladder import attempted
    from veracite.operators.recheck import recheck
    from veracite.operators.signals import with_signals

    doc, stub = "The committee published its annual statement on the matter. " * 120, "The second claim stands in that short page there."
    claims = ["committee published its annual statement", "second claim stands in that"]
    raw = spark.createDataFrame(
        [("https://a.com/x", rung, k, 200, {}, "", body, "html") for k, (rung, body) in enumerate((("node", doc), ("curl", stub)))],
        "url string, rung string, rung_ord int, status int, headers map<string,string>, final_url string, raw_body string, body_kind string",
    )
    citations = spark.createDataFrame([("https://a.com/x", claims)], "url string, claims array<string>")
    reads = with_signals(raw.join(citations, "url"))
    entries = archive.entries(attempted(reads), assemble.judge(reads), "1.0", F.lit("2026-01-01"))
    assert [r["rung"] for r in entries.first()["reads"]] == ["node", "curl"]
    assert recheck(raw, citations, entries, archive.blobs(raw), "1.0")[0].first()["category"] == "clean"
