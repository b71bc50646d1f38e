"""Harvest from end to end on stub reads, drafts of claims files, and read sources."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from veracite.operators import footnotes, proposals
from veracite.operators.ladder import attempted
from veracite.operators.rules import Rule, RuleSet
from veracite.operators.signals import with_signals
from veracite.sources import fetch

FILL = "Filler sentences about nothing in particular stand on this page. " * 90
OWN = "seven lighthouses were repainted in a single summer"
SHARED = "the ferry company answered none of our letters"
CLAIMED = "an engineer from the port explained the delay"
MARKDOWN = "[^1]: Port, <https://p.org/a>\n\n[^2]: Ferry, <https://f.org/b?utm_source=x>\n\n[^3]: Gone, <https://g.org/c>\n\n[^4]: Wall, <https://w.org/d>"


@pytest.fixture(scope="module")
def harvested(spark):
    prose = f"We heard that {OWN}, and that {SHARED}. Later {CLAIMED}; accept all cookies on this site."
    pages = {
        "https://p.org/a": f"<p>{FILL}</p><p>It is said {OWN}.</p><p>{CLAIMED}. {SHARED}! accept all cookies on this site</p><meta name='description' content='{OWN} as well'>",
        "https://f.org/b?utm_source=x": f"<p>{FILL} {SHARED}</p>",
        "https://g.org/c": "<p>short</p>",
    }
    rows = [(u, "node", 0, 200, {}, u, html, "html", []) for u, html in pages.items()]
    reads = spark.createDataFrame(rows, "url string, rung string, rung_ord int, status int, headers map<string,string>, final_url string, raw_body string, body_kind string, claims array<string>")
    notes = footnotes.parse_footnotes(spark.createDataFrame([(1, MARKDOWN)], "doc_id long, markdown string"))
    files = spark.createDataFrame([(1, json.dumps({"https://p.org/a": [CLAIMED], "https://w.org/d": {"notApplicable": "paywalled"}}))], "doc_id long, claims_json string")
    rules = RuleSet(boilerplate=(Rule("accept all cookies", "2026-01-01", "banner"),))
    judged = attempted(with_signals(reads))
    return proposals.harvest(spark.createDataFrame([(1, prose)], "doc_id long, prose string"), notes, footnotes.parse_claims(files), judged, rules)


def test_proposals(harvested):
    found, scan = harvested
    got = {r["url"]: r for r in found.collect()}
    assert set(got) == {"https://p.org/a", "https://f.org/b?utm_source=x"}
    port, ferry = got["https://p.org/a"], got["https://f.org/b?utm_source=x"]
    assert port["claims"] == [OWN] and port["rungs"] == ["node"] and port["drops"].asDict() == {"floor": 0, "frequency": 1, "rules": 1, "claimed": 1}
    assert ferry["claims"] == [] and ferry["drops"]["frequency"] == 1 and ferry["key"] == "https://f.org/b"
    row = proposals.totals(found, scan).first().asDict()
    assert row == {"doc_id": 1, "readable": 2, "unreachable": 1, "skipped": 1, "proposals": 1, "frequency_vacuous": False}


def test_drafts_are_not_written_over_once_edited(spark, harvested, tmp_path):
    files = proposals.draft_files(harvested[0], "1.2", "2026-05-06")
    draft = json.loads(files.first()["draft_json"])
    assert list(draft)[0] == "_note" and draft["https://p.org/a"] == [OWN] and len(draft) == 2
    path = str(tmp_path / "drafts")
    proposals.write_drafts(spark, files, path)
    proposals.write_drafts(spark, proposals.draft_files(harvested[0], "1.3", "2026-05-07"), path)  # untouched: replaced
    assert "2026-05-07" in spark.read.parquet(path).first()["draft_json"]
    for text in (json.dumps(draft | {"_note": "mine"}), "{", json.dumps({"a": 1})):
        spark.createDataFrame([(1, text)], "doc_id long, draft_json string").write.mode("overwrite").parquet(path)
        with pytest.raises(ValueError, match="rename or delete"):
            proposals.write_drafts(spark, files, path)


class Page(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        if self.path == "/old":
            self.send_response(302)
            self.send_header("Location", "/new")
            self.end_headers()
            return
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("X-Agent", self.headers["User-Agent"])
        self.end_headers()
        self.wfile.write(b"caf\xc3\xa9 " + self.path.encode())

    def log_message(self, *_):
        pass


def test_live_source_reads_a_local_server(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asked = spark.createDataFrame([(f"{base}/old",), (f"{base}/gone",), ("http://127.0.0.1:9/closed",), ("nonsense",)], "url string")
    rungs = tuple(r for r in fetch.available_rungs() if r != "pdftotext")
    rows = {(r["url"], r["rung"]): r for r in fetch.build(rungs=rungs, timeout=5)(asked).collect()}
    server.shutdown()
    for rung in rungs:
        moved, gone, closed = rows[f"{base}/old", rung], rows[f"{base}/gone", rung], rows["http://127.0.0.1:9/closed", rung]
        assert (moved["status"], moved["final_url"], moved["raw_body"]) == (200, f"{base}/new", "café /new") and moved["headers"]["x-agent"].startswith("Mozilla")
        assert gone["status"] == 404 and closed["status"] == 0 and closed["raw_body"] == ""
    assert rows["nonsense", "node"]["status"] == 0
    table = fetch.of_table(spark.createDataFrame([("a", 1), ("b", 2)], "url string, x int"))
    assert fetch.build(table) is table and table(asked.select(F.lit("a").alias("url"))).count() == 1


def test_header_blocks():
    assert fetch.header_block("HTTP/1.1 301 Moved\r\nA: 1\r\n\r\nHTTP/1.1 100 Continue\r\n\r\nHTTP/2 200\r\nContent-Type: text/html\r\nB: 2: 3\r\n\r\n") == {"content-type": "text/html", "b": "2: 3"}
    assert fetch.header_block("") == {}
