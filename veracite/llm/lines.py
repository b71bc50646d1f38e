"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is the text between newlines; its words are the runs without ASCII white
space. Two lines are duplicates if their word sequences are equal or, for lines
of at least ``min_words`` words, differ by one inserted, deleted or replaced
word. A line goes if an equal or near line stands earlier, in the order (id, line
number); whether that earlier line itself goes does not matter. Blank lines stay.

Each distinct line emits the hash of its words and of every variant with one
word deleted. Equal variants meet in an aggregate that keeps the earliest line
for each (variant, deleted place): lines that share a variant at one place, or of
which one is the variant itself, are within one edit, so the minimum stands for
all pairs and no group is expanded. The pair of line and earliest line is then
verified by comparing their words. Only lines that share their leading or
trailing half with a different line emit variants: one edit leaves one of the
halves unchanged. Halves are cut for a line's length and for the next one, so
that lines of neighbouring lengths agree.

The texts are split into words once; what is kept of a line is its hashes.

Cases: null texts stay null and have no lines; empty texts have one blank line;
a null id comes before all others; of rows with one id each is compared with the
rows of smaller ids and with itself, near lines also with each other; an empty
table gives an empty result; extra columns of the input pass through ``dedup``
unless they bear the names ``n_lines`` or ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

MIN_WORDS = 5
SALT = 7


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def single_spaced(text: Column) -> Column:
    """Runs of white space other than newlines become one space; most texts pass untouched."""
    odd = F.contains(text, F.lit("  "))
    for mark in "\t\x0b\f\r":
        odd = odd | F.contains(text, F.lit(mark))
    return F.when(odd, F.regexp_replace(text, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(text)


def clean_lines(text: Column) -> Column:
    return F.split(single_spaced(text), "\n")


def _half(side: int, line: Column, words: Column) -> Column:
    """Hash of the first (0) or last (1) ``words`` words of a line."""
    return F.xxhash64(F.lit(side), words, F.call_function("substring_index", line, F.lit(" "), words if side == 0 else -words))


def hashed_lines(documents: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(row, doc, line_no, h1, h2, p0, s0, p1, s1) of the lines that hold words.

    p and s are the hashes of the halves as cut for n (0) and for n + 1 words (1), null where they are no others or the line is short.
    """
    texts = documents.where(F.col(text_col).isNotNull()).select(
        row_key(id_col, text_col).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), clean_lines(F.col(text_col)).alias("lines")
    )
    lines = texts.select("row", "doc", F.posexplode("lines").alias("line_no", "line")).select("row", "doc", "line_no", F.trim("line").alias("line")).where("line <> ''")
    lines = lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    n, line = F.col("n"), F.col("line")
    long_enough = n >= max(min_words - 1, 3)
    first, second = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    halves = [F.when(long_enough & (F.lit(True) if cut is first else second != first), _half(side, line, cut)).alias(name) for name, side, cut in (("p0", 0, first), ("s0", 1, first), ("p1", 0, second), ("s1", 1, second))]
    return lines.select("row", "doc", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(SALT), "line").alias("h2"), *halves)


def places_of(lines: DataFrame) -> DataFrame:
    """The columns that joins on (h1, h2) shuffle; alike everywhere, so that the shuffle is done once."""
    return lines.select("row", "doc", "line_no", "h1", "h2")


HOT_LINES = 1024
HOT_COUNT = 64


def joined_by_line(places: DataFrame, facts: DataFrame, hot: DataFrame, hot_facts: DataFrame, on: tuple[str, ...] = ("h1", "h2")) -> DataFrame:
    """Places joined with the facts (one row a line) of their lines. ``hot`` are the most frequent lines and ``hot_facts``
    the facts of those that have any: every task knows them, so these lines gather nowhere."""
    keys = list(on)
    often = places.join(F.broadcast(hot_facts), keys)
    seldom = places.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts, keys)
    return often.unionByName(seldom)


def repeated_lines(lines: DataFrame, several: DataFrame, hot: DataFrame) -> DataFrame:
    """(row, line_no) of the lines that stand in a row of a smaller id too, or earlier in their own row."""
    met = joined_by_line(places_of(lines), several.select("h1", "h2", "least"), hot, hot.select("h1", "h2", "least"))
    later = met.where("doc > least").select("row", "line_no")
    own = met.where("doc = least").groupBy("row", "h1", "h2").agg(F.array_sort(F.collect_set("line_no")).alias("at")).where("size(at) > 1")
    return later.unionByName(own.select("row", F.explode(F.slice("at", F.lit(2), F.size("at"))).alias("line_no")))


def candidates(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc, line_no, row) of the first place of each distinct line that shares a half with a different line."""
    halves = lines.select("h1", F.explode(F.array("p0", "s0", "p1", "s1")).alias("half")).where("half is not null")
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    wanted = checkpointed(halves.join(shared, "half", "left_semi").select("h1").distinct())
    places = joined_by_line(places_of(lines), wanted, hot, hot.select("h1").distinct().join(wanted, "h1", "left_semi"), ("h1",))
    return places.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line_no", "row")).alias("at")).select("at.*")


SLOTS = 1 << 24  # bits of the row filter: 2 MB whatever the input


def probably_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``row`` may be in ``wanted``: a broadcast bitmap of fixed size drops most others before a shuffle."""
    slot = F.pmod(F.col("row"), F.lit(SLOTS)) + 1
    marked = wanted.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_at", F.bitmap_bit_position(slot))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)) % 2 == 1
    return placed.join(F.broadcast(marked), "_bucket").where(is_set).drop("_bucket", "_at", "_bits")


def variants(texts: DataFrame) -> DataFrame:
    """(no, i, v): for each line its hash (i = 0) and that of each variant without its i-th word.

    The hash of a word sequence is the exclusive or of its words' hashes with
    their places, so all variants of a line take linear time.
    """
    words = texts.select("no", F.posexplode("words").alias("at", "word"))
    words = words.select("no", "at", F.xxhash64("word", "at").alias("here"), F.xxhash64("word", F.col("at") - 1).alias("shifted"))
    order = Window.partitionBy("no").orderBy("at")
    until, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("no")
    xor = lambda c, w: F.bit_xor(c).over(w)
    seen = words.select("no", "at", "here", xor("here", until).alias("a"), xor("shifted", until).alias("b"), xor("here", whole).alias("all_a"), xor("shifted", whole).alias("all_b"))
    before, after = F.col("a").bitwiseXOR(F.col("here")), F.col("b").bitwiseXOR(F.col("all_b"))
    both = F.when(F.col("at") == 0, F.array(F.struct(F.lit(0).alias("i"), F.col("all_a").alias("v")), F.struct(F.lit(1).alias("i"), before.bitwiseXOR(after).alias("v"))))
    one = F.array(F.struct((F.col("at") + 1).alias("i"), before.bitwiseXOR(after).alias("v")))
    return seen.select("no", F.explode(F.coalesce(both, one)).alias("k")).select("no", "k.i", "k.v")


def near_lines(documents: DataFrame, places: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(h1, h2) of the distinct lines at ``places`` that have an earlier near line."""
    wanted = checkpointed(places.groupBy("row", "doc").agg(F.collect_set("line_no").alias("line_nos")))
    source = documents.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    chosen = probably_in(source, wanted).join(wanted, "row").select("row", "doc", "line_nos", clean_lines(F.col("text")).alias("lines"))
    lines = chosen.select("row", "doc", F.explode("line_nos").alias("line_no"), "lines").select("row", "doc", "line_no", F.trim(F.get("lines", F.col("line_no"))).alias("line"))
    texts = lines.select("doc", "line_no", "row", "line", F.split("line", " ").alias("words")).where(F.size("words") >= min_words).distinct()
    texts = checkpointed(texts.orderBy("doc", "line_no", "row").select(F.monotonically_increasing_id().alias("no"), "line", "words"))  # numbers in order

    every = variants(texts)
    common = every.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    keys = checkpointed(every.join(common, "v", "left_semi"))
    # a replaced word: the same variant at the same place; an inserted or deleted word: one line is the other's variant
    leads = keys.groupBy("v", "i").agg(F.min("no").alias("lead"))
    whole = leads.where("i = 0").select("v", F.col("lead").alias("whole"))
    shorter = leads.where("i > 0").groupBy("v").agg(F.min(F.struct("lead", "i")).alias("s"))
    pair = lambda lead, i: F.struct(lead.alias("lead"), i.cast("int").alias("lead_i"))
    replaced = leads.where("i > 0").join(whole, "v", "left").select("v", "i", F.array(pair(F.col("lead"), F.col("i")), pair(F.col("whole"), F.lit(0))).alias("leads"))
    deleted = whole.join(shorter, "v").select("v", F.lit(0).alias("i"), F.array(pair(F.col("s.lead"), F.col("s.i"))).alias("leads"))
    met = keys.join(replaced.unionByName(deleted), ["v", "i"]).select("no", "i", F.explode("leads").alias("l")).select("no", "i", "l.lead", "l.lead_i")
    pairs = met.where("lead < no").distinct()
    pairs = pairs.join(texts.select("no", "line", F.col("words").alias("a")), "no").join(texts.select(F.col("no").alias("lead"), F.col("words").alias("b")), "lead")

    def without(w: str, i: str) -> Column:
        return F.when(F.col(i) == 0, F.col(w)).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(F.col(i) - 1, F.lit(0))), F.slice(w, F.col(i) + 1, F.size(w))))

    true_pairs = pairs.where(without("a", "i") == without("b", "lead_i"))
    return true_pairs.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(SALT), "line").alias("h2")).distinct()


def removals(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, gone array) of the rows that lose lines: the rising line numbers, from 0; ``row`` is ``row_key``."""
    lines = checkpointed(hashed_lines(documents, id_col, text_col, min_words))
    several = checkpointed(lines.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("c")).where("c > 1"))
    hot = checkpointed(several.where(F.col("c") >= HOT_COUNT).orderBy(F.desc("c"), "h1", "h2").limit(HOT_LINES))
    near = checkpointed(near_lines(documents, checkpointed(candidates(lines, hot)), id_col, text_col, min_words))
    # one after another: a plan of all parts at once is a burden on the driver
    repeated = checkpointed(repeated_lines(lines, several, hot))
    altered = checkpointed(joined_by_line(places_of(lines), near, hot, hot.select("h1", "h2").join(near, ["h1", "h2"], "left_semi")).select("row", "line_no"))
    return checkpointed(repeated.unionByName(altered).groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("gone")))


def line_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row (id, n_lines, n_removed, removed_lines) per input row; line numbers count from 0."""
    gone = removals(documents, id_col, text_col, min_words)
    rows = documents.select(F.col(id_col), row_key(id_col, text_col).alias("row"), _line_total(F.col(text_col)).alias("n_lines"))
    none = F.array().cast("array<int>")
    return rows.join(gone, "row", "left").select(id_col, "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce("gone", none).alias("removed_lines"))


def _line_total(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their duplicate lines removed, and columns n_lines, n_removed."""
    gone = removals(documents, id_col, text_col, min_words)
    kept = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    docs = documents.select(F.struct(*kept).alias("all"), row_key(id_col, text_col).alias("row"))
    joined = docs.join(gone, "row", "left").select("all.*", F.struct("gone", _line_total(F.col(f"all.{text_col}")).alias("total")).alias("n_lines"))
    left = F.filter(F.split(text_col, "\n"), lambda line, i: ~F.array_contains(F.col("n_lines.gone"), i))
    text = F.when(F.col("n_lines.gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in kept]
    return joined.select(*columns, F.col("n_lines.total").alias("n_lines"), F.coalesce(F.size("n_lines.gone"), F.lit(0)).alias("n_removed"))
