"""Text normalization and matching as column expressions.

``norm`` folds renderings of the same words together; matching is containment of
normalized text. All functions keep nulls and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

#: White space as ECMAScript regular expressions define it; Java's \s is ASCII only.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: (pattern, replacement) in order; magnitudes are folded before commas are deleted.
NORM_STEPS = (
    (r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", ""),
    (r"[\x{2018}\x{2019}]", "'"),
    (r"[\x{201C}\x{201D}]", '"'),
    (r"[\x{2010}-\x{2015}\x{2212}]", "-"),
    (r"\x{A0}", " "),
    (rf"([0-9]){WS}*billion", "$1bn"),
    (rf"([0-9]){WS}*bn(?![A-Za-z0-9_])", "$1bn"),
    (rf"([0-9]){WS}*million", "$1mn"),
    (rf"([0-9]){WS}*mn(?![A-Za-z0-9_])", "$1mn"),
    (r",", ""),
    (rf"{WS}+", " "),
    (r" +([.;:!?%)\]}])", "$1"),
    (r"([(\[{]) +", "$1"),
)


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def collapse_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, rf"{WS}+", " "))


def norm(text: Column) -> Column:
    out = F.lower(text)
    for pattern, replacement in NORM_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def phrase_found(norm_haystack: Column, norm_phrase: Column) -> Column:
    """Containment of normalized texts; the empty phrase is found everywhere."""
    return F.contains(norm_haystack, norm_phrase)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, the unit of the prose thresholds."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def below_claim_floor(claim: Column, floor: int) -> Column:
    return utf16_length(norm(claim)) < floor


def claims_hash(claims: Column) -> Column:
    """SHA-256 of the sorted normalized claims joined by newlines."""
    return F.sha2(F.array_join(F.array_sort(F.transform(claims, norm)), "\n"), 256)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


# Words that carry no evidence in a path or label.
STOPWORDS = (
    "the a an and or of to in for on at by with from is are was were be as it that this "
    "html http https www com org net index page"
).split()


def content_words(text: Column) -> Column:
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS) & ~w.rlike(r"^[0-9]+\z")))


def slug_label_overlap(text: Column, path: Column, label: Column) -> Column:
    """Share of the content words of path and label that the text holds; 0 where there are none."""

    def share(words: Column) -> Column:
        hits = let(F.lower(text), lambda body: F.size(F.filter(words, lambda w: F.contains(body, w))))
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words))

    return let(content_words(F.concat_ws(" ", path, label)), share)
