"""Pieces of DuckDB SQL that restate the column functions, for the checks of the registered queries."""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def rx(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace(chr(39), chr(39) * 2)}', 'g')"


def norm(x: str) -> str:
    out = f"lower({x})"
    for pattern, to in (
        (r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", ""), (r"[\x{2018}\x{2019}]", "'"), (r"[\x{201C}\x{201D}]", '"'),
        (r"[\x{2010}-\x{2015}\x{2212}]", "-"), (r"\x{A0}", " "), (rf"([0-9]){WS}*billion", r"\1bn"), (rf"([0-9]){WS}*bn\b", r"\1bn"),
        (rf"([0-9]){WS}*million", r"\1mn"), (rf"([0-9]){WS}*mn\b", r"\1mn"), (",", ""), (rf"{WS}+", " "), (r" +([.;:!?%)\]}])", r"\1"), (r"([(\[{]) +", r"\1"),
    ):
        out = rx(out, pattern, to)
    return f"trim({out})"


def collapse(x: str) -> str:
    return f"trim({rx(x, WS + '+', ' ')})"


def finish(x: str) -> str:
    """The named entities that the pages hold; amp last."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">")):
        x = f"replace({x}, '&{name};', '{char}')"
    return collapse(f"replace({x}, '&amp;', '&')")


def body(html: str) -> str:
    stripped = rx(rx(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return finish(rx(stripped, "<[^>]*>", " "))


PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]*@)?([^/?#@:\s]+)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{PARTS}', {group})"


def path(url: str) -> str:
    return f"(case when {part(url, 5)} = '' then '/' else {part(url, 5)} end)"


def normalize_url(url: str) -> str:
    pairs = f"string_split(substr({part(url, 6)}, 2), '&')"
    tracked = "regexp_matches(split_part(p, '=', 1), '(?i)^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|s_cid)$')"
    kept = f"[case when contains(p, '=') then p else p || '=' end for p in {pairs} if p <> '' and not {tracked}]"
    dropped = f"len([p for p in {pairs} if {tracked}]) > 0"
    search = f"(case when {dropped} then (case when len({kept}) = 0 then '' else '?' || array_to_string({kept}, '&') end) else {part(url, 6)} end)"
    host = f"lower({part(url, 1)}) || '://' || {part(url, 2)} || lower({part(url, 3)}) || (case when {part(url, 4)} = '' then '' else ':' || {part(url, 4)} end)"
    bare = f"{path(url)} = '/' and {search} = '' and {part(url, 7)} = ''"
    return f"(case when {bare} then {host} else {host} || {path(url)} || {search} || {part(url, 7)} end)"


def norm_path(url: str) -> str:
    short = rx(f"lower(url_decode(replace({path(url)}, '+', '%2B')))", "/+$", "")
    return f"(case when {short} = '' then '/' else {short} end)"


def moved_away(cited: str, landed: str) -> str:
    pc, pl = norm_path(cited), norm_path(landed)
    return f"(case when {pl} = '/' then {pc} <> '/' or (length({part(cited, 6)}) > 1 and length({part(landed, 6)}) <= 1) else starts_with({pc}, {pl} || '/') end)"


SIGNATURES = (
    r"verif(y|ying|ication)(?s:.{0,20})human", r"enable javascript(?s:.{0,30})(continue|proceed)", r"(please )?enable js\b", r"(are|re) you a robot|not a robot",
    r"checking your browser before accessing", r"just a moment", r"press (and|&) hold", r"making sure you're not a robot|we just need to make sure",
    r"proof[- ]of[- ]work|anubis", r"unusual traffic from your computer network", r"request unsuccessful.{0,40}incapsula", r"vercel security checkpoint",
    r"javascript is disabled in your browser", r"enable javascript and then reload", r"enable javascript to run this app", r"please turn javascript on",
)


def signature_rule(normed: str) -> str:
    cases = " ".join(f"when regexp_matches({normed}, '{p.replace(chr(39), chr(39) * 2)}') then {i}" for i, p in enumerate(SIGNATURES))
    return f"(case {cases} end)"


PATHS = (r"/cdn-cgi/challenge-platform/", r"/sorry/index", r"/(captcha|challenge|px-captcha)(/|$|\?)", r"^https?://consent\.[^/?#]+([/?#]|$)")


def path_rule(url: str) -> str:
    cases = " ".join(f"when regexp_matches({url}, '{p}') then {i}" for i, p in enumerate(PATHS))
    return f"cast(case {cases} end as int)"


PAGES = f"""
p0 as (select page_id, url, html, {body("html")} as body from pages),
p1 as (select *, string_split(body, ' ') as w from p0),
page as (select page_id, url, html, body, list_filter([
    case when len(w) >= 60 then array_to_string(w[51:60], ' ') end, case when len(w) >= 210 then array_to_string(w[201:210], ' ') end,
    case when len(w) >= 410 then array_to_string(w[401:410], ' ') end,
    case when page_id % 3 = 1 then 'no page says this sentence about number ' || page_id end], lambda c: c is not null) as claims from p1)"""

READS = f"""{PAGES},
r0 as (
  select page_id, url, claims, 'node' as rung, 0 as rung_ord, case when page_id % 7 = 0 then 404 else 200 end as status,
    page_id % 7 = 1 as challenge_header, page_id % 7 = 3 as not_text,
    case when page_id % 11 = 0 then regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' else url end as landed,
    case when page_id % 7 = 2 then 'Just a moment...' else body end as text from page
  union all
  select page_id, url, claims, 'curl', 1, 200, false, false, url, body from page),
r1 as (select *, length(text) as prose_chars, {norm("text")} as normed from r0),
r2 as (select *, {signature_rule("normed")} as signature_rule, [c for c in claims if contains(normed, {norm("c")})] as matched_claims from r1),
r3 as (select *, signature_rule is not null and prose_chars < 800 as challenge_signature, status in (404, 410) as document_gone,
    cast(len(claims) as int) as total, cast(len(matched_claims) as int) as matched from r2),
r4 as (select *, challenge_header or challenge_signature or document_gone or not_text as blocked from r3),
r5 as (select *, not blocked and prose_chars >= 4500 as readable from r4),
reads as (select *, case when total = 0 then 'unclaimed' when blocked then 'unreachable' when matched = total then 'supported'
    when readable then 'unsupported' else 'unreachable' end as verdict from r5)"""

CLIMBED = f"""{READS},
climbed as (select *, coalesce(max(readable::int) over (partition by url order by rung_ord rows between unbounded preceding and 1 preceding), 0) = 0 as attempted from reads)"""


def assembled(source: str, name: str) -> str:
    """One row per URL from the rows of ``source``: winner, union of located claims, judged, verdict."""
    moved = moved_away("url", "landed")
    rank = f"""order by (case when verdict = 'supported' then 0 when readable and not {moved} then 1 when readable then 2 else 3 end),
        (case when verdict = 'supported' then 0 else -prose_chars end), rung_ord"""
    return f"""
{name}_won as (select *, row_number() over (partition by url {rank}) as k from {source}),
{name}_loc as (select url, list_distinct(flatten(list(case when blocked then []::varchar[] else matched_claims end))) as located, list(rung order by rung_ord) as rungs,
    list(status order by rung_ord) as statuses from {source} group by url),
{name}_j as (select w.page_id, w.url, w.claims, w.rung as won_rung, w.landed, l.rungs, l.statuses, w.blocked, w.readable, [c for c in w.claims if not list_contains(l.located, c)] as missed_all
    from {name}_won w join {name}_loc l using (url) where k = 1),
{name}_k as (select *, case when len(claims) = 0 then 'unclaimed' when blocked then 'unreachable' when len(missed_all) = 0 then 'supported'
    when readable then 'unsupported' else 'unreachable' end as judged, {moved} as moved from {name}_j),
{name} as (select *, case when judged = 'unsupported' and moved then 'unreachable' else judged end as verdict from {name}_k)"""


JUDGED = f"""{CLIMBED},
taken as (select * from climbed where attempted),{assembled("taken", "one")},
more as (select r.* from reads r where url in (select url from one where judged = 'unsupported' and len(rungs) < 2)),{assembled("more", "two")},
judged as (select *, false as escalated from one where not (judged = 'unsupported' and len(rungs) < 2) union all select *, true from two)"""
