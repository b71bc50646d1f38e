"""Footnotes, claims files and their join.

Documents are Markdown rows; footnote definitions become rows with their first
external URL. Claims files are JSON rows; their keys join on the normalized URL.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bind import let
from ..functions.text import below_claim_floor, norm, trim_ws, utf16_length
from ..functions.url import has_credentials, normalize_url
from ..thresholds import THRESHOLDS

DEFINITION = r"(?md)^\[\^([^\]]+)\]:[ \t]*(.*(?:\n[ \t]+\S.*)*+)"
LINKS = (r"<(https?://[^>\s]+)>", r"\]\((https?://[^\s]+)\)", r"(https?://[^\s<>\]]+)")  # angle, Markdown, bare
# a fenced block: its opening line, the lines up to a run of the same character at least as long, and that line, if any
FENCED = re.compile(r"^[^\S\n]*(`{3,}|~{3,})[^\n]*+(?:\n(?![^\S\n]*\1)[^\n]*+)*+(?:\n[^\n]*+)?", re.M)


def blank_fences(text: str) -> str:
    """The text with each line of fenced code empty; the number of lines stays."""
    return FENCED.sub(lambda block: "\n" * block[0].count("\n"), text)


@F.pandas_udf(T.StringType())
def _blank_fences(text: pd.Series) -> pd.Series:
    return text.map(blank_fences, na_action="ignore")


def unfenced(markdown: Column) -> Column:
    """LF line ends; only texts with a fence visit Python."""
    lf = F.regexp_replace(markdown, "\\r\\n?", "\n")
    return F.when(lf.rlike("(?md)^\\s*(`{3,}|~{3,})"), _blank_fences(lf)).otherwise(lf)


def trim_url(url: Column) -> Column:
    """Strip trailing punctuation and closing parentheses that nothing opens, as far as both go.

    Of the parentheses in the trailing run as many go as the URL has closing ones too
    many; what stays of the run ends with the last parenthesis that stays.
    """
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))

    def trimmed(tail: Column) -> Column:
        inside = count(tail, ")")
        kept = F.least(inside, F.greatest(F.lit(0), inside - (count(url, ")") - count(url, "("))))
        end = let(kept, lambda k: F.when(k > 0, F.concat(F.call_function("substring_index", tail, F.lit(")"), k), F.lit(")"))).otherwise(F.lit("")))
        return F.concat(F.substring(url, F.lit(1), F.length(url) - F.length(tail)), end)

    return let(F.regexp_extract(url, r"([.,;:!?)]*)\z", 1), trimmed)


def first_url(text: Column) -> Column:
    """The first angle link, else Markdown link, else bare link of a text; null if there is none."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in LINKS])
    return let(found, trim_url)


def parse_footnotes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """(id, n, url, label) per definition, numbered from 1."""
    plain = documents.select(F.col(id_col), unfenced(F.col(text_col)).alias("_text"))
    found = plain.select(id_col, F.posexplode(F.regexp_extract_all("_text", F.lit(DEFINITION), F.lit(2))).alias("pos", "raw"))
    labelled = found.select(id_col, (F.col("pos") + 1).alias("n"), trim_ws(F.col("raw")).alias("label"))
    return labelled.withColumn("url", first_url(F.col("label"))).select(id_col, "n", "url", "label")


def prose(documents: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """(id, prose): the text without fenced code and footnote definitions."""
    return documents.select(F.col(id_col), F.regexp_replace(unfenced(F.col(text_col)), DEFINITION, "").alias("prose"))


def claim_floor_message(where: Column, claim: Column) -> Column:
    quoted = F.regexp_extract(F.to_json(F.struct(claim.alias("c"))), r'^\{"c":([\s\S]*)\}\z', 1)
    return F.concat(
        where, F.lit(": "), quoted, F.lit(" is "), utf16_length(norm(claim)).cast("string"),
        F.lit(f" characters once normalized, under the {THRESHOLDS.min_claim_chars}-character floor; extend it to take in the surrounding words"),
    )


def validate_claims(claims: DataFrame, id_col: str, claims_col: str = "claims") -> DataFrame:
    """(id, index, claim, reason, message) of every claim that would be refused; a null claim is not a string."""
    each = claims.select(F.col(id_col), F.posexplode(claims_col).alias("index", "claim"))
    where = F.concat(F.lit("claim at index "), F.col("index").cast("string"))
    short = below_claim_floor(F.col("claim"), THRESHOLDS.min_claim_chars)
    reason = F.when(F.col("claim").isNull(), "not-a-string").when(short, "below-floor")
    message = F.when(F.col("claim").isNull(), F.concat(where, F.lit(" is not a string"))).otherwise(claim_floor_message(where, F.col("claim")))
    return each.withColumn("reason", reason).where("reason is not null").withColumn("message", message)


def parse_claims(files: DataFrame, id_col: str = "doc_id", json_col: str = "claims_json") -> DataFrame:
    """(id, authored, key, claims, na_reason, problem, credentials) per entry of each claims file.

    Keys that start with ``_`` are notes. ``problem`` names a collision, a claim
    below the floor or a value of another shape; ``refuse_problems`` raises on one. A
    file that is no JSON object gives one row with a problem and no key. A null file has no rows.
    """
    parsed = files.where(F.col(json_col).isNotNull()).select(F.col(id_col), F.try_parse_json(json_col).alias("_file"))
    parsed = parsed.withColumn("_object", F.coalesce(F.schema_of_variant("_file").startswith("OBJECT"), F.lit(False)))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("authored", "string"), ("key", "string"), ("claims", "array<string>"), ("na_reason", "string"))]
    broken = parsed.where(~F.col("_object")).select(id_col, *none, F.lit("the claims file is not a JSON object").alias("problem"), F.lit(False).alias("credentials"))
    # the members by name; each keeps its JSON type
    whole = parsed.where("_object")
    members = whole.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("_file").outer())).select(id_col, F.col("key").alias("authored"), F.col("value").alias("_value"))
    entries = members.where(~F.startswith("authored", F.lit("_")))
    kind = F.schema_of_variant("_value")
    reason = F.try_variant_get("_value", "$.notApplicable", "string")
    given = F.schema_of_variant(F.try_variant_get("_value", "$.notApplicable", "variant")) == "STRING"
    step = entries.withColumns(
        {
            "key": normalize_url(F.col("authored")),
            "claims": F.when(kind == "ARRAY<STRING>", F.try_variant_get("_value", "$", "array<string>")),
            "na_reason": F.when(kind.startswith("OBJECT") & given, reason),
        }
    )
    same = step.groupBy(id_col, "key").agg(F.count("*").alias("same"))
    short = F.get(F.filter("claims", lambda c: below_claim_floor(c, THRESHOLDS.min_claim_chars)), 0)
    problem = (
        F.when(F.col("same") > 1, "normalizes to the same URL as another key")
        .when(F.col("claims").isNull() & F.col("na_reason").isNull(), 'expected a non-empty array of phrases or {"notApplicable": "<reason>"}')
        .when(short.isNotNull(), claim_floor_message(F.col("authored"), short))
    )
    checked = step.join(same, [id_col, "key"]).select(id_col, "authored", "key", "claims", "na_reason", problem.alias("problem"), has_credentials(F.col("authored")).alias("credentials"))
    return checked.unionByName(broken)


def refuse_problems(parsed: DataFrame) -> DataFrame:
    """The entries, failing the job at the first problem."""
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.coalesce("authored", F.lit("claims file")), F.lit(": "), "problem"))).otherwise(F.lit(True))
    return parsed.withColumn("_ok", checked.cast("boolean")).where("_ok").drop("_ok", "problem")


def join_claims(footnotes: DataFrame, claims: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Footnotes with their claims: status is checkable, notApplicable (with reason) or unclaimed."""
    keyed = footnotes.withColumn("key", normalize_url(F.col("url")))
    joined = keyed.join(claims.select(id_col, "key", "claims", "na_reason"), [id_col, "key"], "left")
    status = F.when(F.col("url").isNull(), "notApplicable").when(F.col("claims").isNotNull(), "checkable").when(F.col("na_reason").isNotNull(), "notApplicable").otherwise("unclaimed")
    reason = F.when(F.col("url").isNull(), F.lit("no external source")).otherwise(F.col("na_reason"))
    return joined.select(id_col, "n", "url", "label", "key", status.alias("status"), "claims", reason.alias("reason"))


def orphaned_claims(footnotes: DataFrame, claims: DataFrame, id_col: str = "doc_id") -> DataFrame:
    cited = footnotes.where("url is not null").select(id_col, normalize_url(F.col("url")).alias("key"))
    return claims.select(id_col, "key").join(cited, [id_col, "key"], "left_anti")
