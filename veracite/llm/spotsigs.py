"""SpotSigs document fingerprints, in DataFrame functions only.

A signature is an anchor (a very common word) with the chain of the next
``CHAIN`` content words after it; anchors themselves are never part of a chain.
Where none of the last ``FEW`` content words follows an anchor, the word before counts
as one, so that lists and very short texts have fingerprints too; as only the words
just before decide, an edit changes no signatures far from it. A document's fingerprint is the set of its signatures' 64-bit hashes, written as
sorted hexadecimal numbers. Likeness is the Jaccard coefficient of two sets.

``near_duplicates`` compares sets by length partitions: with likeness at least t
the smaller set has at least t times the larger one's size, so only the same or
the next partition can match. Within them sets meet on their rarest signatures (a set
shares one of its n - ceil(t n) + 1 rarest with any match), and pairs whose sizes
rule out t are pruned before the sets are compared. Equal sets are folded first.

``with_neighbours`` puts each document beside the next one in id order without
gathering the table in one task: quantiles of the ids, and even steps between them, cut
it into buckets, and the first rows of each bucket are repeated at the end of the one
before. At most ``COARSE * STEPS`` buckets bound what is collected and broadcast; a large
bucket spills, as the window holds its rows in sorted order.

Cases: null and empty texts are equal texts; a text without any signature has
its own hash as only signature, so it is like equal texts alone; documents with one id follow
each other by the hash of their texts; a null id comes first; the only
document of a table is its own next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from .common import checkpointed

CHAIN = 2
FEW = 8
BUCKET_ROWS = 1500
COARSE, STEPS = 1024, 64

# Very common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist man mit nach nicht noch nur oder sein sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette comme dans de du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos era esta este fue ha hay las lo los más me mi muy no nos o para pero por porque se si sin sobre son su sus también una y ya"
).split()


def _common(word: Column) -> Column:
    return word.isin(*sorted(set(ANCHORS)))


def _spots(words: Column) -> Column:
    """The content words, each with the word before it (null at the start) and whether that is an anchor."""

    def spot(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1))
        return F.when(~_common(w) & (w != ""), F.struct(w.alias("w"), before.alias("before"), F.coalesce(_common(before), F.lit(False)).alias("anchored")))

    return F.filter(F.transform(words, spot), lambda s: s.isNotNull())


def _chosen(content: Column) -> Column:
    """The chains that are anchored, or lie in a stretch without anchors."""

    def chain(s: Column, i: Column) -> Column:
        hashed = F.xxhash64(s["before"], *[F.get(content, i + k)["w"] for k in range(CHAIN)])
        last = F.slice(content, F.greatest(i - (FEW - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(FEW)))
        counts = s["anchored"] | ~F.exists(last, lambda t: t["anchored"])
        return F.when((i + (CHAIN - 1) < F.size(content)) & counts, hashed)

    return F.array_sort(F.array_distinct(F.filter(F.transform(content, chain), lambda c: c.isNotNull())))


def signatures(text: Column) -> Column:
    """Sorted set of signature hashes (longs) of a text column; never null or empty."""
    own = F.xxhash64(F.lit("whole"), text)
    found = let(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda words: let(_spots(words), _chosen))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(own)))


def text_form(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two sets; 0 without comparing them where their sizes rule out ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    return F.when(small < large * F.lit(least), F.lit(0.0)).otherwise(exact)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, signatures) per input row."""
    return documents.select(F.col(id_col), signatures(F.coalesce(text_col, F.lit(""))).alias("signatures"))


def near_duplicates(prints: DataFrame, likeness_at_least: float = 0.8, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(membership of every row in a class of equal sets, pairs of classes of at least this likeness).

    Membership is (id, class_id), the class named by its smallest id; pairs are (left_id, right_id, likeness), left below right.
    """
    t = likeness_at_least
    classes = checkpointed(prints.groupBy("signatures").agg(F.min(id_col).alias("class_id")))
    membership = prints.join(classes, "signatures").select(id_col, "class_id")
    sets = classes.select("class_id", "signatures", F.size("signatures").alias("n")).where("class_id is not null")
    sized = sets.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0) / F.log(F.lit(t)) + 1e-9).cast("int"))
    rarity = sets.select("class_id", F.explode("signatures").alias("signature"))
    frequency = rarity.groupBy("signature").agg(F.count("*").alias("f"))
    ordered = rarity.join(frequency, "signature").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("f", "signature"))).alias("rare"))
    prefix = F.slice("rare", F.lit(1), (F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).cast("int"))
    index = sized.join(ordered, "class_id").select("class_id", "n", "part", F.explode(prefix).alias("r")).select("class_id", "n", "part", F.col("r.signature").alias("signature"))
    lower = index.withColumn("meets", F.explode(F.array("part", F.col("part") + 1)))
    a, b = lower.alias("a"), index.alias("b")
    found = a.join(
        b,
        (F.col("a.signature") == F.col("b.signature")) & (F.col("a.meets") == F.col("b.part")) & (F.col("a.class_id") != F.col("b.class_id"))
        & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * t),
    )
    pairs = found.select(F.least("a.class_id", "b.class_id").alias("left_id"), F.greatest("a.class_id", "b.class_id").alias("right_id")).distinct()
    named = lambda side: sets.select(F.col("class_id").alias(f"{side}_id"), F.col("signatures").alias(f"{side}_set"))
    compared = pairs.join(named("left"), "left_id").join(named("right"), "right_id")
    scored = compared.select("left_id", "right_id", likeness(F.col("left_set"), F.col("right_set"), t).alias("likeness"))
    return membership, scored.where(F.col("likeness") >= t)


def _bucket(key: Column, bounds: list[int], top: int, steps: int) -> Column:
    """Number of the bucket: binary search in rising lower bounds, then even steps up to the next bound. It rises with the key."""
    reach = 1 << max(len(bounds) - 1, 0).bit_length()
    lows = F.array(*[F.lit(float(b)) for b in [*bounds, top]])
    deeper = lambda at, step: F.when((at + step < len(bounds)) & (F.get(lows, at + step) <= key.cast("double")), at + step).otherwise(at)
    cell = F.aggregate(F.array(*[F.lit(reach >> k) for k in range(reach.bit_length())]), F.lit(0), deeper)

    def number(c: Column) -> Column:
        low, high = F.get(lows, c), F.get(lows, c + 1)
        share = F.when(high > low, (key.cast("double") - low) / (high - low)).otherwise(F.lit(0.0))
        return c * steps + F.least(F.greatest(F.floor(share * steps), F.lit(0)), F.lit(steps - 1)).cast("int")

    return let(cell, number)


def with_neighbours(rows: DataFrame, carried: list[str], id_col: str = "doc_id", tie_col: str = "tie") -> DataFrame:
    """Each row with ``next_<column>`` of the next row by (id, tie) for the carried columns; the last one's next is the first."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    extent = rows.agg(F.count("*").alias("n"), F.min(id_col).cast("long").alias("low"), F.max(id_col).cast("long").alias("high")).first()
    buckets = min(COARSE * STEPS, max(1, -(-extent["n"] // BUCKET_ROWS)))
    cells = min(COARSE, buckets)
    bounds = [extent["low"] or 0]
    if cells > 1:
        cuts = rows.agg(F.percentile_approx(key, [k / cells for k in range(1, cells)], 100 * cells).alias("q")).first()["q"]
        bounds = sorted({*bounds, *(c for c in cuts if c > bounds[0])})
    bucketed = rows.withColumn("_key", key).withColumn("_bucket", _bucket(F.col("_key"), bounds, extent["high"] or 0, -(-buckets // cells)))
    firsts = sorted((r["_bucket"], r["first"]) for r in bucketed.groupBy("_bucket").agg(F.min("_key").alias("first")).collect())  # one row a bucket
    halo = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    repeats = F.broadcast(rows.sparkSession.createDataFrame(halo, "_key long, _before int"))
    spread = bucketed.join(repeats, "_key", "left").withColumn("_copy", F.explode(F.when(F.col("_before").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    placed = spread.withColumn("_bucket", F.when(F.col("_copy"), F.col("_before")).otherwise(F.col("_bucket")))
    order = Window.partitionBy("_bucket").orderBy("_copy", "_key", tie_col)
    following = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return following.where(~F.col("_copy")).drop("_key", "_bucket", "_copy", "_before")


def edited_likeness(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Fingerprint each text and its edited text: the last 1/``share`` replaced by the start of the next document.

    One row (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per input row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("tie"), signatures(F.col("text")).alias("set"))
    both = with_neighbours(rows, ["text", "set"], "id")
    n = F.length("text")
    k = F.floor(n / share).cast("int")
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - cast(floor(length(text) / {share}) as int))"), F.substring(F.col("next_text"), F.lit(1), k))
    out = both.select("id", n.cast("long").alias("n_chars"), "set", "next_set", edited.alias("edited"))
    out = out.select("*", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_set"))
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        text_form(F.col("set")).alias("fingerprint"),
        text_form(F.col("edited_set")).alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("set"), F.col("next_set")).alias("near_next"),
    )
