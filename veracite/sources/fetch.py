"""Read sources: anything that turns citations (url, user_agent) into raw reads.

A source is a callable from a DataFrame with ``url`` to raw reads, one row a rung. A given
table, an archive's replay and the live rungs are sources alike. The live rungs run on the
executors, a few rows a batch, and never fail a job: a read that fails has no status, no
headers and an empty body.
"""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import RuleSet, user_agent_for
from ..operators.signals import RAW_READS

ReadSource = Callable[[DataFrame], DataFrame]

TIMEOUT_SECONDS = 20
MOST_BYTES = 64 << 20  # of one answer
RUNGS = ("node", "curl", "pdftotext")
EMPTY = {"status": 0, "headers": {}, "final_url": "", "raw_body": ""}


def http_read(url: str, agent: str, timeout: float = TIMEOUT_SECONDS) -> dict:
    """One HTTP read, redirects followed; an error status is an answer like any other."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "*/*"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return _answer(answer, answer.status)
    except urllib.error.HTTPError as error:
        return _answer(error, error.code)
    except (OSError, ValueError):
        return EMPTY


def _answer(answer, status: int) -> dict:
    headers = {k.lower(): v for k, v in answer.headers.items()}
    charset = answer.headers.get_content_charset() or "utf-8"
    body = answer.read(MOST_BYTES)
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return {"status": status, "headers": headers, "final_url": answer.geturl(), "raw_body": text}


def header_block(dump: str) -> dict[str, str]:
    """The headers of the last block of a dump that is no interim answer, names in lower case."""
    blocks = [b for b in dump.replace("\r\n", "\n").split("\n\n") if re.match(r"HTTP/[0-9.]+ (?!1[0-9][0-9])[0-9]", b)]
    pairs = (line.split(":", 1) for line in (blocks[-1].split("\n")[1:] if blocks else ()) if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def curl_read(url: str, agent: str, timeout: float = TIMEOUT_SECONDS) -> dict:
    with tempfile.TemporaryDirectory() as folder:  # a task's own scratch, gone before the row is returned
        body, head = Path(folder, "body"), Path(folder, "head")
        command = ["curl", "--silent", "--location", "--compressed", "--max-time", str(timeout), "--user-agent", agent, "--dump-header", head, "--output", body, "--write-out", "%{http_code} %{url_effective}", "--", url]
        try:
            said = subprocess.run(command, capture_output=True, text=True, timeout=2 * timeout, check=True).stdout
        except (OSError, subprocess.SubprocessError):
            return EMPTY
        status, _, final = said.partition(" ")
        text = body.read_bytes()[:MOST_BYTES].decode("utf-8", "replace") if body.exists() else ""
        return {"status": int(status or 0), "headers": header_block(head.read_text("latin-1")) if head.exists() else {}, "final_url": final, "raw_body": text}


def pdf_read(url: str, agent: str, timeout: float = TIMEOUT_SECONDS) -> dict:
    """The text of a PDF; such a read has no status and no headers of its own."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            document = answer.read(MOST_BYTES)
        text = subprocess.run(["pdftotext", "-layout", "-enc", "UTF-8", "-", "-"], input=document, capture_output=True, timeout=4 * timeout, check=True).stdout
    except (OSError, ValueError, subprocess.SubprocessError):
        return EMPTY
    return EMPTY | {"final_url": url, "raw_body": text.decode("utf-8", "replace")}


READERS = {"node": http_read, "curl": curl_read, "pdftotext": pdf_read}


def available_rungs() -> tuple[str, ...]:
    """The rungs that this machine can climb."""
    return tuple(r for r in RUNGS if r == "node" or shutil.which(r))


def pdf_version() -> str | None:
    """The first line that pdftotext says of itself, with the encoding it is run with; None where it is missing."""
    try:
        said = subprocess.run(["pdftotext", "-v"], capture_output=True, text=True, timeout=TIMEOUT_SECONDS)
    except (OSError, subprocess.SubprocessError):
        return None
    lines = [line.strip() for line in (said.stderr + "\n" + said.stdout).split("\n") if line.strip()]
    return f"{lines[0]} (-enc UTF-8)" if lines else None


def live(rungs: tuple[str, ...] | None = None, rules: RuleSet | None = None, identity: str | None = None, timeout: float = TIMEOUT_SECONDS) -> ReadSource:
    """Reads of every rung at hand, fetched where the rows are; user agents follow the host rules."""
    chosen = available_rungs() if rungs is None else rungs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url, agent in zip(batch["url"], batch["user_agent"], strict=True):
                rows = [{"url": url, "rung": r, "rung_ord": RUNGS.index(r), "body_kind": "text" if r == "pdftotext" else "html"} | READERS[r](url, agent, timeout) for r in chosen]
                yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", RAW_READS).split(",")])

    def read(citations: DataFrame) -> DataFrame:
        asked = citations.select("url", user_agent_for(F.col("url"), rules or RuleSet(), identity).alias("user_agent")).distinct()
        return asked.mapInPandas(run, RAW_READS)

    return read


def of_table(reads: DataFrame) -> ReadSource:
    """The reads of a given table for the URLs asked for."""
    return lambda citations: reads.join(citations.select("url").distinct(), "url", "left_semi")


def build(source: ReadSource | None = None, **options) -> ReadSource:
    """The given source untouched, else the live one."""
    return source if source is not None else live(**options)
