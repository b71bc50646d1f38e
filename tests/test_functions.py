"""Unit vectors of the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from veracite import flags
from veracite.functions import excerpt, extract, text, url
from veracite.operators.footnotes import blank_fences, parse_claims, parse_footnotes, trim_url
from veracite.operators.harvest import Draft, contains_join, drop_contained, maximal
from veracite.operators.rules import RuleSet, rule_age_days, user_agent_for


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_norm(spark):
    cases = {
        "12,500,031": "12500031",
        "EUR 3.25 billion": "eur 3.25bn",
        "some 7 million trees": "some 7mn trees",
        "Boeing" + chr(0x2013) + "Airbus": "boeing-airbus",
        "Oslo," + chr(0x200C) + " Norway": "oslo norway",
        "nobody came !": "nobody came!",
        "{ x ( y [ z": "{x (y [z",
        "2. 9 lives": "2. 9 lives",
        chr(0x2009) + "p" + chr(0xFEFF) + " " + chr(0x2003) + "q": "p q",
        "8 mnx": "8 mnx",
    }
    for raw, want in cases.items():
        assert one(spark, text.norm(F.col("t")), t=raw) == want
        assert excerpt.norm(raw) == want


def test_utf16_length_counts_code_units(spark):
    assert one(spark, text.utf16_length(F.col("t")), t="a" + chr(0x1F4C8)) == 3


def test_body_and_entities(spark):
    cases = {
        "<td>left</td><td>right</td>": "left right",
        "they&#x27;d": "they'd",
        "&#1114112;": "&#1114112;",
        "&amp;#x27;": "&#x27;",
        "&nosuchentity;": "&nosuchentity;",
        "&#38;amp;": "&",
        "&#x26;#39;": "'",
        "&#xD800;": "&#xD800;",
        "<script>x</script>a<style>b</style>": "a",
        "&Prime;&prime;": chr(0x2033) + chr(0x2032),
    }
    for raw, want in cases.items():
        assert one(spark, extract.body_text(F.col("t")), t=raw) == want


def test_descriptions(spark):
    nine = "".join(f'<meta name="description" content="d{i}">' * 2 for i in range(9))
    assert one(spark, extract.html_regions(F.col("t")), t=nine) == [f"d{i}" for i in range(8)]
    inert = '<!-- <meta name="description" content="a"> <template><meta name="description" content="b">'
    assert one(spark, extract.html_regions(F.col("t")), t="x" + inert)[1:] == []
    quoted = """<meta name='author' property="og:description" content="a > b">"""
    assert one(spark, extract.html_regions(F.col("t")), t=quoted)[-1] == "a > b"
    assert one(spark, extract.description_values(F.col("t")), t='<a title="x <meta name="description" content="late">') == []


def test_looks_binary(spark):
    assert one(spark, extract.looks_binary(F.col("t")), t=chr(1) * 2 + "a" * 98) is True
    assert one(spark, extract.looks_binary(F.col("t")), t=chr(1) + "a" * 199) is False
    assert one(spark, extract.looks_binary(F.col("t")), t="") is False


def test_normalize_url(spark):
    cases = {
        "HTTPS://Example.COM/Path/To": "https://example.com/Path/To",
        "https://example.com/": "https://example.com",
        "https://example.com/a/": "https://example.com/a/",
        "https://e.com/a?utm_source=x&id=7&utm_medium=y": "https://e.com/a?id=7",
        "http://e.com:80/a#f": "http://e.com/a#f",
        "not a url": "not a url",
    }
    for raw, want in cases.items():
        assert one(spark, url.normalize_url(F.col("t")), t=raw) == want


def test_moved_away(spark):
    cases = [
        ("https://k.org/archive/may/7", "https://m.org/", True),
        ("https://k.org/booklist/7", "https://k.org/book", False),
        ("https://k.org/book/7", "https://k.org/book/", True),
        ("https://k.org/?id=7", "https://k.org/", True),
        ("https://k.org/?id=7", "https://k.org/?theme=dark", False),
        ("https://a.com/x%zz", "https://a.com/x%zz", False),
        ("https://a.com/x", "", False),
    ]
    for cited, landed, want in cases:
        assert one(spark, url.moved_away(F.col("a"), F.col("b")), a=cited, b=landed) is want


def test_footnotes(spark):
    rows = [
        ("[^1]: (see https://example.com/x)", "https://example.com/x"),
        ("[^1]: https://en.org/wiki/Mercury_(planet).", "https://en.org/wiki/Mercury_(planet)"),
        ("[^1]: none\nhttps://example.com/y", None),
        ("[^1]: cont\r\n  https://example.com/z", "https://example.com/z"),
        ("[^1]: https://bare.org/a <https://angle.org/b>", "https://angle.org/b"),
    ]
    df = spark.createDataFrame([(i, md) for i, (md, _) in enumerate(rows)], "doc_id long, markdown string")
    got = {r["doc_id"]: r["url"] for r in parse_footnotes(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_fences_close_on_their_own_kind():
    assert blank_fences("````\n```\nx\n````\ny") == "\n\n\n\ny"
    assert blank_fences("~~~\na\n```\nb\n~~~\nc") == "\n\n\n\n\nc"


def test_excerpts():
    body = "Intro words stand here. The total was $6.5bn in all of 2024, they said. More text follows now."
    assert excerpt.excerpt(body, "total was $6.5bn in all") == chr(0x2026) + "The total was $6.5bn in all of 2024, they said." + chr(0x2026)
    assert excerpt.excerpt(body, "not in there at all") is None
    assert excerpt.excerpt("", "x") is None


def test_evidence_is_merged_in_order(spark):
    shown = [("a", "one two three", "n"), ("b", chr(0x2026) + "two three", "n"), ("c", None, "n"), ("d", "zero one two three four", "m"), ("e", "five six", "m"), ("f", None, "m")]
    df = spark.createDataFrame([(shown,)], "shown array<struct<claim:string,excerpt:string,rung:string>>")
    merged = df.select(excerpt.merged_evidence(F.col("shown")).alias("m")).first()["m"]
    assert [m["claims"] for m in merged] == [["a", "b", "d"], ["c"], ["e"], ["f"]]
    assert merged[0]["excerpt"] == "zero one two three four" and merged[0]["rung"] == "n" and merged[1]["excerpt"] is None


def test_spans_snap_to_words():
    spans, _ = Draft("forty wooden boats sailed off.", 12).spans("then forty wooden boa-ting trips")
    assert spans == ["forty wooden"]
    assert Draft("short", 21).spans("short") == ([], [])
    assert Draft("a cost of 7 billion euros was named", 9).spans("a cost of 6 billion euros was named")[1] == ['NOT A BUG, a norm() boundary: verbatim in the source, but normalized differently there: "billion euros was named"']


def test_maximal_spans():
    assert maximal(["x y z", "b c", "a b c d", "a b c d", ",", "A  B"]) == ["x y z", "a b c d"]


def test_drop_contained(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(["x y z", "b c", "a b c d", "a b c d", ",", "z"])] + [(1, 0, "b c")], "g long, o long, span string")
    assert [(r["g"], r["span"]) for r in drop_contained(df, ["g"], "o").orderBy("g", "o").collect()] == [(0, "x y z"), (0, "a b c d"), (1, "b c")]


@pytest.mark.parametrize("hold", [None, True, False])
def test_contains_join_finds_every_needle(spark, hold):
    """Needles of any length, empty ones included, against plain containment; nulls take no part."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 4)))
    hay = [(g, i, " ".join(word() for _ in range(r.randrange(30)))) for g in range(2) for i in range(25)] + [(0, 90, None), (0, 91, "")]
    needles = []
    for k in range(120):
        g, _, t = r.choice(hay[:50])
        a = r.randrange(len(t) + 1)
        needles.append((g, k, t[a : a + r.randrange(25)]))
    needles += [(0, 500, ""), (0, 501, None), (1, 502, "tiny"), (1, 503, "a b c d e")]
    found = contains_join(spark.createDataFrame(hay, "g long, h long, t string"), spark.createDataFrame(needles, "g long, n long, s string"), "h", "t", "n", "s", ("g",), hold=hold)
    want = {(g, h, n) for g, h, t in hay for g2, n, s in needles if g == g2 and t is not None and s is not None and s in t}
    got = [tuple(x) for x in found.select("g", "h", "n").collect()]
    assert set(got) == want and len(got) == len(want)


def test_urls_are_trimmed_to_the_end(spark):
    """Against the rule taken one character at a time."""

    def plain(u):
        while True:
            v = u.rstrip(".,;:!?")
            if v.endswith(")") and v.count(")") > v.count("("):
                v = v[:-1]
            if v == u:
                return u
            u = v

    r = random.Random(7)
    urls = ["https://a.com/x" + ").)" * 9, "https://a.com/(x)" + ".)" * 20, "https://a.com/x", "https://a.com/(((x))))).,"]
    urls += ["https://a.com/" + "".join(r.choice("ab().,;:!?") for _ in range(r.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [x["t"] for x in df.select(trim_url(F.col("u")).alias("t")).collect()] == [plain(u) for u in urls]


def test_claims_files_of_every_shape(spark):
    files = [
        (0, '{"_note": 1, "https://a.com/x": ["a phrase that is long enough"], "https://b.com/": {"notApplicable": "paywalled"}}'),
        (1, "not json"), (2, '["a list"]'), (3, '{"https://a.com/": [1234567890123456789]}'), (4, '{"https://a.com/": ["long enough to be one", 5]}'),
        (5, '{"https://a.com/": [], "https://c.com/p": "text"}'), (6, '{"https://a.com/x": ["long enough to be one"], "https://a.com/x?utm_source=q": ["long enough to be one"]}'),
        (7, '{"https://u:p@a.com/x": ["short"]}'), (8, None), (9, '{"https://d.com/x": {"notApplicable": 5}}'),
    ]
    rows = parse_claims(spark.createDataFrame(files, "doc_id long, claims_json string")).collect()
    by = {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append(x)
    assert [x["problem"] for x in by[0]] == [None, None] and {x["na_reason"] for x in by[0]} == {None, "paywalled"}
    assert len(by[1]) == len(by[2]) == 1 and "not a JSON object" in by[1][0]["problem"] and by[2][0]["key"] is None
    assert all("expected a non-empty array" in x["problem"] for k in (3, 4, 5, 9) for x in by[k]) and len(by[5]) == 2
    assert all("same URL" in x["problem"] for x in by[6]) and len(by[6]) == 2
    assert by[7][0]["credentials"] and "under the 16-character floor" in by[7][0]["problem"] and 8 not in by


def test_flags_and_paths():
    assert flags.unknown_flag(["doc.md", "--json", "--nope"]) == "--nope" and flags.unknown_flag(["--help"]) is None
    assert flags.failing(["--allow-unclaimed"]) == {"fail_on_unreachable": False, "fail_on_unclaimed": False}
    assert [flags.beside(d, "claims.json") for d in ("notes/a.b.md", "notes/plain")] == ["notes/a.b.claims.json", "notes/plain.claims.json"]


def test_agents_and_ages_of_rules(spark):
    rules = RuleSet()
    agent = user_agent_for(F.col("u"), rules, "app me@example.org")
    assert one(spark, agent, u="https://www.sec.gov/x") == "app me@example.org" and one(spark, agent, u="https://notsec.gov/x") == one(spark, agent, u="broken")
    assert one(spark, rule_age_days(F.col("d"), F.lit("2026-03-01 00:00:00")), d="2026-02-01") == 28
