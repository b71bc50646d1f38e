"""Challenge, path, host and boilerplate rules: small ordered lists, extended by local ones, never shortened."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.url import host_of


@dataclass(frozen=True)
class Rule:
    pattern: str  # in Java syntax
    last_confirmed: str
    note: str


@dataclass(frozen=True)
class HostRule:
    host: str
    last_confirmed: str
    note: str
    user_agent: str | None = None
    requires_identity: bool = False


# Wordings of bot walls, tested on normalized regions in this order.
SIGNATURES = (
    Rule(r"verif(y|ying|ication)[\s\S]{0,20}human", "2026-09-06", "managed challenge"),
    Rule(r"enable javascript[\s\S]{0,30}(continue|proceed)", "2026-09-06", "noscript line"),
    Rule(r"(please )?enable js(?![A-Za-z0-9_])", "2026-09-06", "JavaScript abbreviated"),
    Rule(r"(are|re) you a robot|not a robot", "2026-09-06", "robot question"),
    Rule(r"checking your browser before accessing", "2023-01-01", "retired wording, still served"),
    Rule(r"just a moment", "2026-09-06", "interstitial title"),
    Rule(r"press (and|&) hold", "2026-09-06", "press and hold"),
    Rule(r"making sure you're not a robot|we just need to make sure", "2026-09-06", "robot check at 200"),
    Rule(r"proof[- ]of[- ]work|anubis", "2026-09-06", "proof of work"),
    Rule(r"unusual traffic from your computer network", "2026-09-06", "sorry page"),
    Rule(r"request unsuccessful.{0,40}incapsula", "2026-09-06", "request refused"),
    Rule(r"vercel security checkpoint", "2026-09-06", "security checkpoint"),
    Rule(r"javascript is disabled in your browser", "2026-09-11", "disabled-script shell"),
    Rule(r"enable javascript and then reload", "2026-09-11", "shell with reload"),
    Rule(r"enable javascript to run this app", "2026-09-11", "stock app shell"),
    Rule(r"please turn javascript on", "2026-09-11", "imperative shell"),
)

# Redirect targets that mean a challenge, tested on the final URL.
PATHS = (
    Rule(r"/cdn-cgi/challenge-platform/", "2026-09-06", "challenge platform"),
    Rule(r"/sorry/index", "2026-09-06", "sorry redirect"),
    Rule(r"/(captcha|challenge|px-captcha)(/|\z|\?)", "2026-09-06", "captcha paths"),
    Rule(r"^https?://consent\.[^/?#]+([/?#]|\z)", "2026-09-11", "consent host"),
)

# Hosts with a fetch rule; rules add an attempt or a header, never skip one.
HOSTS = (
    HostRule("sec.gov", "2026-09-06", "needs a declared identity", requires_identity=True),
    HostRule("bloomberg.com", "2026-08-24", "hard-blocked; reported only"),
)

BROWSER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36"


@dataclass(frozen=True)
class RuleSet:
    signatures: tuple[Rule, ...] = SIGNATURES
    paths: tuple[Rule, ...] = PATHS
    hosts: tuple[HostRule, ...] = HOSTS
    boilerplate: tuple[Rule, ...] = field(default_factory=tuple)


def load_rules(text: str | None = None) -> RuleSet:
    """Bundled rules plus those of a JSON text; every local rule needs a date, a note and a valid pattern."""
    if text is None:
        return RuleSet()
    raw = json.loads(text)

    def dated(entry: dict) -> dict:
        if not isinstance(entry.get("note"), str) or not entry["note"].strip():
            raise ValueError(f"rule without a note: {entry}")
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", str(entry.get("lastConfirmed", ""))):
            raise ValueError(f"rule without a YYYY-MM-DD lastConfirmed: {entry}")
        return {"last_confirmed": entry["lastConfirmed"], "note": entry["note"]}

    def pattern(entry: dict) -> Rule:
        common = dated(entry)
        try:
            re.compile(entry["pattern"])
        except (KeyError, TypeError, re.error) as e:
            raise ValueError(f"rule with an invalid pattern: {entry}") from e
        return Rule(pattern=re.sub(r"(?<!\\)\$", r"\\z", entry["pattern"]), **common)

    def host(entry: dict) -> HostRule:
        if not isinstance(entry.get("host"), str) or not entry["host"]:
            raise ValueError(f"host rule without a host: {entry}")
        return HostRule(host=entry["host"].lower(), user_agent=entry.get("userAgent"), requires_identity=bool(entry.get("requiresIdentity", False)), **dated(entry))

    return RuleSet(
        SIGNATURES + tuple(pattern(e) for e in raw.get("signatures", ())),
        PATHS + tuple(pattern(e) for e in raw.get("paths", ())),
        HOSTS + tuple(host(e) for e in raw.get("hosts", ())),
        tuple(pattern(e) for e in raw.get("boilerplate", ())),
    )


def rules_frame(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """All rules as a table (kind, rule_ord, pattern, last_confirmed, note)."""
    rows = [(kind, i, r.pattern, r.last_confirmed, r.note) for kind in ("signatures", "paths", "boilerplate") for i, r in enumerate(getattr(rules, kind))]
    rows += [("hosts", i, r.host, r.last_confirmed, r.note) for i, r in enumerate(rules.hosts)]
    return spark.createDataFrame(rows, "kind string, rule_ord int, pattern string, last_confirmed string, note string")


def first_rule(rules: tuple[Rule, ...], test) -> Column:
    """Number of the first rule in order for which ``test(pattern)`` holds, null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(test(r.pattern), F.lit(i)) for i, r in enumerate(rules)])


def rule_field(rules: tuple, number: Column, name: str) -> Column:
    if not rules:
        return F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(getattr(r, name)) for r in rules]), number)


def signature_rule(norm_regions: Column, rules: RuleSet) -> Column:
    """First signature, in rule order, that any single region matches."""
    return let(norm_regions, lambda regions: first_rule(rules.signatures, lambda p: F.exists(regions, lambda r: r.rlike(p))))


def flat_signature_rule(norm_regions: Column, rules: RuleSet) -> Column:
    """First signature that the regions match as one text; it may match across two of them."""
    return let(F.array_join(norm_regions, " "), lambda joined: first_rule(rules.signatures, lambda p: joined.rlike(p)))


def path_rule(final_url: Column, rules: RuleSet) -> Column:
    return first_rule(rules.paths, lambda p: final_url.rlike(p))


def host_rule(url: Column, rules: RuleSet) -> Column:
    host = host_of(url)
    return F.coalesce(*[F.when((host == r.host) | host.endswith(f".{r.host}"), F.lit(i)) for i, r in enumerate(rules.hosts)], F.lit(None).cast("int"))


def user_agent_for(url: Column, rules: RuleSet, identity: str | None = None) -> Column:
    """Identity where the host asks for one, else the rule's agent, else the browser's."""
    number = host_rule(url, rules)
    choices = [identity or BROWSER_AGENT if r.requires_identity else r.user_agent or BROWSER_AGENT for r in rules.hosts]
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in choices]), number), F.lit(BROWSER_AGENT))


def rule_age_days(last_confirmed: Column, now: Column) -> Column:
    millis = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.to_timestamp(last_confirmed))
    return F.floor(millis / 86_400_000 + 0.5).cast("long")
