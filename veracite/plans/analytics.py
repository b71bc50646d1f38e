"""Calibration aggregates over reads, claims and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm, utf16_length
from ..functions.url import moved_away, pathname
from ..operators.harvest import mine_spans
from ..operators.ladder import read_ord
from ..operators.rules import RuleSet, flat_signature_rule, signature_rule
from ..thresholds import MAX_DESCRIPTION_REGIONS, THRESHOLDS

BANDS = ((10, "1-10"), (20, "11-20"), (30, "21-30"), (40, "31-40"), (60, "41-60"))
FLOORS = (8, 12, 16, 20, 25, 30, 40)
MARGIN, MOST = 200, 120_000


def populations(frame: DataFrame, kind_col: str, prose_col: str = "prose_chars") -> DataFrame:
    """Least and most prose of each kind, kinds in order of their least."""
    return frame.groupBy(kind_col).agg(F.min(prose_col).alias("least"), F.max(prose_col).alias("most"), F.count("*").alias("n")).orderBy("least", kind_col)


def floor_sweep(bounds: DataFrame) -> DataFrame:
    """How many whole floors keep a margin above the largest challenge and below the smallest document.

    ``bounds`` is one row (challenge, document). The floors form one range, so
    its ends are computed rather than tried.
    """
    low = F.greatest(F.lit(1), F.ceil(F.col("challenge") + MARGIN))
    high = F.least(F.lit(MOST), F.floor(F.col("document") - MARGIN))
    ends = bounds.select(low.cast("long").alias("lowest"), high.cast("long").alias("highest"))
    some = F.col("highest") >= F.col("lowest")
    return ends.select(
        F.when(some, F.col("highest") - F.col("lowest") + 1).otherwise(F.lit(0)).alias("n"), F.when(some, F.col("lowest")).alias("lowest"), F.when(some, F.col("highest")).alias("highest")
    )


def length_bands(lengths: DataFrame) -> DataFrame:
    band = F.coalesce(*[F.when(F.col("n") <= top, name) for top, name in BANDS], F.lit("61+"))
    return lengths.groupBy(band.alias("band")).agg(F.count("*").alias("claims"))


def refused_at(lengths: DataFrame) -> DataFrame:
    each = lengths.select(F.explode(F.array(*[F.lit(f) for f in FLOORS])).alias("floor"), "n")
    return each.groupBy("floor").agg(F.count_if(F.col("n") < F.col("floor")).alias("refused"))


def gain_distribution(frame: DataFrame) -> DataFrame:
    gain = F.col("after") - F.col("before")
    return frame.agg(F.count("*").alias("pages"), F.count_if(gain > 0).alias("gained"), F.median(gain).alias("median_gain"), F.max(gain).alias("most"))


def redirect_census(reads: DataFrame) -> DataFrame:
    """Where the judged read of each URL landed: the first readable one, else the last attempted."""
    order = Window.partitionBy("url").orderBy(F.desc("readable"), F.when(F.col("readable"), F.col("rung_ord")).otherwise(-F.col("rung_ord")), read_ord(reads))
    judged = reads.where("attempted").withColumn("_k", F.row_number().over(order)).where("_k = 1")
    kind = F.when(pathname(F.col("url")) == pathname(F.col("landed")), "same page").when(moved_away(F.col("url"), F.col("landed")), "moved away").otherwise("redirected")
    return judged.groupBy(kind.alias("kind")).agg(F.count("*").alias("urls"))


def verdict_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    joined = before.select("url", F.col("verdict").alias("before")).join(after.select("url", F.col("verdict").alias("after")), "url")
    return joined.groupBy("before", "after").agg(F.count("*").alias("urls"))


def moved_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, before, after, moved, reason) of two result sets (url, verdict, rungs_attempted); both must hold the same URLs, and some.

    The reason tells whether other rungs were climbed or the same reads were judged otherwise.
    """
    side = lambda frame, name: frame.select("url", F.col("verdict").alias(name), F.col("rungs_attempted").alias(f"{name}_rungs"))
    joined = side(before, "before").join(side(after, "after"), "url", "full_outer")
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    other = F.when(F.col("before_rungs") == F.col("after_rungs"), "same rungs").otherwise("rungs changed")
    unpaired = F.col("before").isNull() | F.col("after").isNull()
    moved = F.when(unpaired, F.raise_error(F.concat(F.lit("only one result set has "), F.col("url")))).otherwise(changed).cast("boolean")
    return joined.select("url", "before", "after", moved.alias("moved"), F.when(changed, other).alias("reason"))


def movement_summary(moved: DataFrame) -> DataFrame:
    """Rows, moved rows and moved rows by reason; no rows at all fail the job, as they would prove nothing."""
    out = moved.agg(F.count("*").alias("urls"), F.count_if("moved").alias("moved"), F.count_if(F.col("reason") == "rungs changed").alias("rungs_changed"), F.count_if(F.col("reason") == "same rungs").alias("same_rungs"))
    checked = F.when(F.col("urls") == 0, F.raise_error(F.lit("no rows to compare"))).otherwise(F.col("urls")).cast("long")
    return out.withColumn("urls", checked)


def spans_per_pair(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean and most spans per (draft, source) pair, all of them and those above the claim floor; pairs without a span count as none."""
    above = utf16_length(norm(F.col("span"))) >= THRESHOLDS.min_claim_chars
    per = spans.groupBy("draft_id", "source_id").agg(F.count("*").alias("spans"), F.count_if(above).alias("above"))
    every = pairs.select("draft_id", "source_id").distinct().join(per, ["draft_id", "source_id"], "left").na.fill(0, ["spans", "above"])
    return every.agg(F.count("*").alias("pairs"), F.avg("spans").alias("mean"), F.max("spans").alias("most"), F.avg("above").alias("mean_above"), F.max("above").alias("most_above"))


def seed_sweep(pairs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``spans_per_pair`` for each seed length, one row each; ``pairs`` as for ``mine_spans``."""
    rows = [spans_per_pair(mine_spans(pairs, n), pairs).select(F.lit(n).alias("seed"), "*") for n in lengths]
    return reduce(DataFrame.unionByName, rows)


def span_frequency(spans: DataFrame) -> DataFrame:
    """(span, pairs) of the distinct normalized spans above the floor, the most frequent first."""
    normed = spans.select(norm(F.col("span")).alias("span")).where(utf16_length(F.col("span")) >= THRESHOLDS.min_claim_chars)
    return normed.groupBy("span").agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "span")


def region_census(reads: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """How many reads have so many regions, how many of them more than a page may have, and where the signature differs between regions and their join."""
    rules = rules or RuleSet()
    flat, each = flat_signature_rule(F.col("norm_regions"), rules), signature_rule(F.col("norm_regions"), rules)
    rows = reads.select(F.size("regions").alias("regions"), (~flat.eqNullSafe(each)).alias("differs"))
    over = F.col("regions") > 1 + MAX_DESCRIPTION_REGIONS
    return rows.groupBy("regions").agg(F.count("*").alias("reads"), F.count_if(over).alias("over_cap"), F.count_if("differs").alias("signature_differs"))
