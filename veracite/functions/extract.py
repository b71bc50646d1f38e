"""HTML to text regions as column expressions.

The body and each distinct description are separate regions, so that a claim
cannot match across their seam. Entities are decoded in single passes by
splitting at the entity pattern and joining the pieces with decoded matches.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..thresholds import MAX_DESCRIPTION_REGIONS, THRESHOLDS
from .bind import let
from .text import WS, collapse_ws, trim_ws

# Named entities and their code points. ``amp`` is decoded last, apart.
ENTITIES = {
    "lt": 0x3C, "gt": 0x3E, "quot": 0x22, "apos": 0x27,
    "le": 0x2264, "ge": 0x2265, "ne": 0x2260,
    "nbsp": 0xA0, "ensp": 0x2002, "emsp": 0x2003, "thinsp": 0x2009, "shy": 0xAD,
    "ndash": 0x2013, "mdash": 0x2014, "minus": 0x2212,
    "lsquo": 0x2018, "rsquo": 0x2019, "sbquo": 0x201A,
    "ldquo": 0x201C, "rdquo": 0x201D, "bdquo": 0x201E,
    "laquo": 0xAB, "raquo": 0xBB, "lsaquo": 0x2039, "rsaquo": 0x203A,
    "iexcl": 0xA1, "iquest": 0xBF,
    "hellip": 0x2026, "prime": 0x2032, "Prime": 0x2033, "bull": 0x2022, "middot": 0xB7,
    "dagger": 0x2020, "Dagger": 0x2021, "permil": 0x2030, "sect": 0xA7, "para": 0xB6,
    "copy": 0xA9, "reg": 0xAE, "trade": 0x2122,
    "deg": 0xB0, "plusmn": 0xB1, "micro": 0xB5, "times": 0xD7, "divide": 0xF7,
    "sup2": 0xB2, "sup3": 0xB3, "frac12": 0xBD, "frac14": 0xBC, "frac34": 0xBE,
    "pound": 0xA3, "euro": 0x20AC, "yen": 0xA5, "cent": 0xA2,
    "aacute": 0xE1, "Aacute": 0xC1, "eacute": 0xE9, "Eacute": 0xC9,
    "iacute": 0xED, "Iacute": 0xCD, "oacute": 0xF3, "Oacute": 0xD3, "uacute": 0xFA, "Uacute": 0xDA,
    "agrave": 0xE0, "Agrave": 0xC0, "egrave": 0xE8, "Egrave": 0xC8,
    "ugrave": 0xF9, "Ugrave": 0xD9, "ograve": 0xF2, "Ograve": 0xD2,
    "acirc": 0xE2, "Acirc": 0xC2, "ecirc": 0xEA, "Ecirc": 0xCA,
    "icirc": 0xEE, "Icirc": 0xCE, "ocirc": 0xF4, "Ocirc": 0xD4, "ucirc": 0xFB, "Ucirc": 0xDB,
    "auml": 0xE4, "Auml": 0xC4, "euml": 0xEB, "Euml": 0xCB,
    "iuml": 0xEF, "Iuml": 0xCF, "ouml": 0xF6, "Ouml": 0xD6, "uuml": 0xFC, "Uuml": 0xDC,
    "ntilde": 0xF1, "Ntilde": 0xD1, "ccedil": 0xE7, "Ccedil": 0xC7, "szlig": 0xDF,
    "aelig": 0xE6, "AElig": 0xC6, "oslash": 0xF8, "Oslash": 0xD8,
    "aring": 0xE5, "Aring": 0xC5, "oelig": 0x153, "OElig": 0x152,
    "alpha": 0x3B1, "beta": 0x3B2, "gamma": 0x3B3, "delta": 0x3B4, "epsilon": 0x3B5,
    "theta": 0x3B8, "kappa": 0x3BA, "lambda": 0x3BB, "mu": 0x3BC, "nu": 0x3BD,
    "pi": 0x3C0, "rho": 0x3C1, "sigma": 0x3C3, "tau": 0x3C4, "phi": 0x3C6, "chi": 0x3C7,
    "psi": 0x3C8, "omega": 0x3C9,
    "Delta": 0x394, "Theta": 0x398, "Lambda": 0x39B, "Pi": 0x3A0, "Sigma": 0x3A3, "Phi": 0x3A6, "Omega": 0x3A9,
}

DESCRIPTION_NAMES = ("description", "og:description", "twitter:description")
TAG = r"""\G[^<]*+(<[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>)"""
ATTRIBUTE = rf"""([a-zA-Z_:][-a-zA-Z0-9_:.]*){WS}*={WS}*(["'])([\s\S]*?)\2"""
HEAD_MARKER = (
    r"""(?i)<meta[^>]+property=["']og:type["'][^>]+content=["']article["']|"@type"\s*:\s*"(NewsArticle|Article|Report)"|"datePublished\""""
)


def _replace_matches(pattern: str, decode, text: Column) -> Column:
    """Replace every match in one pass; ``decode`` maps the whole match to its replacement. ``text`` must be a bound value."""
    parts = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), decode)
    joined = F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _character(code: Column, raw: Column) -> Column:
    """The character of a code point; ``raw`` out of range or for a lone surrogate, which a string cannot hold."""
    valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    hexed = F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0)).cast("long")), 8, "0")
    return F.when(valid, F.decode(F.unhex(hexed), "UTF-32")).otherwise(raw)


def _number(digits: Column, base: int) -> Column:
    """Value of a digit string, or one out of range where it has more digits than any code point."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) > 7, F.lit(0x110000)).otherwise(F.conv(short, base, 10).cast("long"))


def _known(raw: Column) -> Column:
    table = F.create_map(*[x for name, code in ENTITIES.items() for x in (F.lit(f"&{name};"), F.lit(chr(code)))])
    return F.coalesce(F.try_element_at(table, raw), raw)


ENTITY_STEPS = (
    ("&[a-zA-Z][a-zA-Z0-9]{1,31};", lambda m: _known(m)),
    ("&#[xX][0-9a-fA-F]+;", lambda m: _character(_number(F.regexp_extract(m, "([0-9a-fA-F]+);", 1), 16), m)),
    ("&#[0-9]+;", lambda m: _character(_number(F.regexp_extract(m, "([0-9]+);", 1), 10), m)),
)


def decoded(text: Column) -> Column:
    """Entities decoded in passes (named, hexadecimal, decimal, then ``&amp;``); each pass sees a bound value."""
    out = text
    for step in ENTITY_STEPS:
        out = let(out, partial(_replace_matches, *step))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def finish(text: Column) -> Column:
    """Decode entities where there are any, collapse and trim white space."""
    return collapse_ws(let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t)))


def strip_code(html: Column) -> Column:
    """Script and style elements to one space each; a missing closer leaves the text."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", " "), r"(?i)<style[\s\S]*?</style>", " ")


def body_text(html: Column) -> Column:
    return finish(F.regexp_replace(strip_code(html), "<[^>]*>", " "))


def _inert_stripped(html: Column) -> Column:
    """For descriptions: also unterminated script, style, comment and template elements."""
    out = strip_code(html)
    for opening, closing in (("<script(?![A-Za-z0-9_])", "</script>"), ("<style(?![A-Za-z0-9_])", "</style>"), ("<!--", "-->"), ("<template(?![A-Za-z0-9_])", "</template>")):
        out = F.regexp_replace(out, rf"(?i){opening}[\s\S]*?(?:{closing}|\z)", " ")
    return out


def tags(html: Column) -> Column:
    """Tags with quoted attribute values respected; scanning stops at an unterminated tag."""
    return F.regexp_extract_all(html, F.lit(TAG), F.lit(1))


def attribute(attributes: Column, *names: str) -> Column:
    """Value of the first attribute of one of these names, null where there is none."""
    return F.get(F.filter(attributes, lambda p: p["n"].isin(*names)), 0)["v"]


def attributes(tag: Column) -> Column:
    """The (name in lower case, value) pairs of a tag."""
    inner = tag.substr(F.lit(2), F.length(tag) - 2)
    names = F.transform(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    return F.arrays_zip(names.alias("n"), F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(3)).alias("v"))


def description_values(html: Column) -> Column:
    """Distinct raw description contents in document order, at most eight."""
    metas = F.filter(tags(_inert_stripped(html)), lambda t: t.rlike(r"(?i)^<meta(?![A-Za-z0-9_])"))

    def described(pairs: Column) -> Column:
        named = lambda a: F.coalesce(F.lower(trim_ws(attribute(pairs, a))).isin(*DESCRIPTION_NAMES), F.lit(False))
        return F.when(named("name") | named("property"), trim_ws(attribute(pairs, "content")))

    values = F.filter(F.transform(F.transform(metas, attributes), described), lambda v: v.isNotNull() & (v != ""))
    return F.slice(F.array_distinct(values), 1, MAX_DESCRIPTION_REGIONS)


def html_regions(html: Column) -> Column:
    """Body first, then descriptions; empty regions are left out, so a place is not a label."""
    described = F.when(html.rlike("(?i)<meta"), F.transform(description_values(html), finish)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(F.array(body_text(html)), described), lambda r: r != "")


def plain_regions(text: Column) -> Column:
    return F.filter(F.array(collapse_ws(text)), lambda r: r != "")


def regions(raw_body: Column, body_kind: Column) -> Column:
    return F.when(body_kind == "text", plain_regions(raw_body)).otherwise(html_regions(raw_body))


def looks_binary(raw_body: Column) -> Column:
    def dense(sample: Column) -> Column:
        bad = F.length(sample) - F.length(F.regexp_replace(sample, r"[\x{FFFD}\x00-\x08\x0E-\x1F]", ""))
        return F.when(F.length(sample) > 0, bad / F.length(sample) > THRESHOLDS.max_binary_density).otherwise(F.lit(False))

    return let(F.substring(raw_body, 1, THRESHOLDS.binary_sample_code_points), dense)


def head_markers(raw_body: Column) -> Column:
    return raw_body.rlike(HEAD_MARKER)


def is_textual(content_type: Column) -> Column:
    kind = F.lower(trim_ws(F.substring_index(content_type, ";", 1)))
    return (
        (kind == "") | kind.startswith("text/") | kind.isin("application/xhtml+xml", "application/xml", "application/json")
        | kind.endswith("+xml") | kind.endswith("+json")
    )
