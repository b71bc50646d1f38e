"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint bit is the majority of that bit over the hashes of a text's word
shingles. A fingerprint is split into blocks; two fingerprints that differ in at
most d bits share all blocks but d, so joining on every choice of the remaining
blocks finds each close pair; the Hamming distance is verified in the join.

``groups`` (64 bits) is exact. Equal fingerprints are first folded into one
node. Buckets above ``cap`` members don't join pairwise: their members are
linked through the points of their radius-1 balls, two fingerprints being within
2 bits exactly if the balls meet; at most 65 fingerprints meet in a point, so
the work is linear in the members.

``wide_groups`` (many words of 64 bits) finds texts of a shingle similarity of
at least ``similarity``. Its fingerprints are majorities over the distinct shingles;
the expected share of differing bits of two texts with Jaccard similarity J is
acos(2J / (1 + J)) / pi. Each block of ``block_bits`` bits is one join key; a pair at 0.8
shares one of the 96 blocks of 16 bits with a chance above 0.999. Texts of few shingles, whose bits
differ more often, also meet on their smallest shingle hashes, of which two such texts
share one for certain. Pairs that meet are sifted by the Hamming distance of ``CHECKS``
words of their fingerprints, at four deviations above the mean, and then decided by the
exact Jaccard similarity of their shingle hashes.

A member of a bucket is first compared with the first one near it only, and of all its
buckets' first ones with the smallest. Pairs that are in one component by then need no link; all others that met are compared next, so
a group of many near copies is linked by few comparisons, and the components
are those of all pairs.

Cases: null and empty texts have the fingerprint zero and are linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows are
one node; rows with a null id link others like any row but never name a component;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, sliced
from .graph import components

SEED = 42
LANES = np.uint64(0x0101010101010101)
PART = 1 << 18
CHECKS = 6
FEW_SHINGLES = 20


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, in bounded parts. A-Z are lower-cased, words split at ASCII white space."""
    from xxhash import xxh64_intdigest

    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return
    if len(tokens) < words:
        yield np.array([xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
        return
    total = len(tokens) - words + 1
    for lo in range(0, total, PART):
        n = min(PART, total - lo)
        part = tokens[lo : lo + n + words - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False))
        yield np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: byte lanes are summed 255 hashes at a time."""
    pad = -len(h) % 255
    if pad:
        h = np.concatenate([h, np.zeros(pad, np.uint64)])
    out = np.zeros(64, np.int64)
    for k in range(8):
        lanes = ((h >> np.uint64(k)) & LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        out[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """An independent hash for each further word of a wide fingerprint; word 0 is the hash itself."""
    if word == 0:
        return h
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str, words: int, size: int = 1) -> tuple[np.ndarray, int]:
    """(fingerprint as ``size`` unsigned words, number of shingles)."""
    counts = np.zeros((size, 64), np.int64)
    total = 0
    for h in shingle_hashes(text, words):
        total += len(h)
        for j in range(size):
            counts[j] += bit_counts(mixed(h, j))
    bits = (counts * 2 > total).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel(), total


def fingerprints(documents: DataFrame, words: int, size: int = 1, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row (id, fp array of longs, n_shingles) per input row."""

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        for ids, texts in batches:
            got = [fingerprint(t, words, size) for t in texts]
            yield {id_col: ids, "fp": [f.view(np.int64) for f, _ in got], "n_shingles": [n for _, n in got]}

    return map_texts(documents, id_col, text_col, run, f"{id_col} {id_type}, fp array<long>, n_shingles long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int = 5, distance: int = 2) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks of a 64-bit fingerprint."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def links(nodes: DataFrame, distance: int = 2, blocks: int = 5, cap: int = 64) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``nodes`` (fp long) that differ in at most ``distance`` (1 or 2) bits.

    All verified pairs of the buckets up to ``cap``; for larger ones links that connect the same nodes.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    masks = block_masks(blocks, distance)
    keys = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("block", "bits"))
    large = keys.groupBy("block", "bits").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("block", "bits")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    small = keys.join(large, ["block", "bits"], "left_anti")
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(
        b,
        (F.col("a.block") == F.col("b.block")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp")) & near(F.col("a.fp"), F.col("b.fp")),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowded = keys.join(large, ["block", "bits"], "left_semi").select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)]]
    ball = crowded.select("fp", F.explode(F.array(*flips)).alias("point"))
    first = ball.groupBy("point").agg(F.min("fp").alias("lead"), F.count("*").alias("n")).where("n > 1")
    met = ball.join(first, "point").where(near(F.col("fp"), F.col("lead")))
    return pairs.unionByName(met.select(F.col("fp").alias("u"), F.col("lead").alias("v")) if distance == 2 else _ball_one(crowded))


def _ball_one(crowded: DataFrame) -> DataFrame:
    """Links at distance 1: a fingerprint and its neighbour with one bit cleared."""
    cleared = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(~(1 << k) & (2**64 - 1)))) for k in range(64)])).alias("v")).where("v <> fp")
    return cleared.join(crowded.select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("u"), "v")


def groups(documents: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row (id, fingerprint, component_id) per input row; components of links at ``distance`` bits.

    Nodes are fingerprints, whatever ids hold them, so rows without an id link others too; a component is
    named by the smallest id in it, null where it has none.
    """
    prints = checkpointed(fingerprints(documents, words, 1, id_col, text_col, id_type).select(id_col, F.col("fp")[0].alias("fp")))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("rep")))
    roots = checkpointed(components(links(nodes, distance)))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "component_id"), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def allowed_bits(similarity: float, bits: int, few: bool = False) -> int:
    """Most differing bits of two shingle sets of this Jaccard similarity: the mean, a quarter more where shingles are few, and four deviations."""
    rate = (1.25 if few else 1.0) * math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * rate + 4 * math.sqrt(bits * rate * (1 - rate)))


def distinct_shingles(text: str, words: int) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; it names the node of all texts with this set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def majorities(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The wide fingerprints (texts x ``size``) of several sets of hashes; the bits of all are counted at once.

    Byte lanes are summed over stretches of at most 255 hashes, then over the stretches of a set.
    """
    out = np.zeros((len(sets), size), np.int64)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return out
    lengths = np.array([len(sets[k]) for k in some])
    stretches = -(-lengths // 255)
    ends = np.cumsum(lengths)
    within = np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    starts = np.repeat(ends - lengths, stretches) + 255 * within
    firsts = np.cumsum(stretches) - stretches
    every = np.concatenate([sets[k] for k in some])
    for j in range(size):
        h = mixed(every, j)
        counts = np.empty((len(some), 64), np.int64)
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, starts).view(np.uint8).reshape(-1, 8)
            counts[:, k::8] = np.add.reduceat(lanes, firsts, axis=0, dtype=np.int64)
        out[some, j] = np.packbits(counts * 2 > lengths[:, None], axis=1, bitorder="little").view("<i8").ravel()
    return out


def wide_prints(documents: DataFrame, words: int, similarity: float, size: int, id_col: str, text_col: str, id_type: str) -> DataFrame:
    """One row (id, text_hash, node, fp array of longs, low array of longs) per input row.

    ``text_hash`` is the XXH64 of the text, ``low`` the smallest hashes of a small set.
    """

    def low(shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        return shingles[: n - math.ceil(similarity * n - 1e-9) + 1 if 0 < n <= FEW_SHINGLES else 0].view(np.int64)

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        for ids, texts in batches:
            for lo in range(0, len(texts), 64):
                sets = [distinct_shingles(t, words) for t in texts[lo : lo + 64]]
                hashes = np.array([text_hash(t) for t in texts[lo : lo + 64]], np.int64)
                yield {id_col: ids[lo : lo + 64], "text_hash": hashes, "node": [set_name(s) for s in sets], "fp": list(majorities(sets, size)), "low": [low(s) for s in sets]}

    return map_texts(documents, id_col, text_col, run, f"{id_col} {id_type}, text_hash long, node long, fp array<long>, low array<long>")


def text_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(text.encode("utf-8", "replace"), SEED)).view(np.int64))


def block_picks(bits: int, block_bits: int) -> np.ndarray:
    """The bits of each block, shuffled; blocks don't overlap."""
    blocks = bits // block_bits
    return np.random.default_rng(SEED).permutation(bits)[: blocks * block_bits].reshape(blocks, block_bits)


def check_names(size: int) -> list[str]:
    return [f"c{k}" for k in range(min(CHECKS, size))]


def block_keys(nodes: DataFrame, size: int, block_bits: int) -> DataFrame:
    """(key, node, c0, c1, ...) per node and block, and per smallest hash of a small set; the lowest check bit tells that a set is small."""
    picks = block_picks(size * 64, block_bits)
    powers = (1 << np.arange(block_bits)).astype(np.int32)
    tops = np.arange(len(picks), dtype=np.int64) << block_bits
    names = ["key", "node", *check_names(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            n = batch.num_rows
            if not n:
                continue
            fp = batch.column("fp").flatten().to_numpy().reshape(n, size)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little").astype(np.int32)
            values = np.stack([bits[:, p] @ powers for p in picks], axis=1) + tops
            lows = batch.column("low")
            few = lows.value_lengths().to_numpy()
            more = lows.flatten().to_numpy() & np.int64((1 << 62) - 1) | np.int64(1 << 62)
            which = np.concatenate([np.repeat(np.arange(n), len(picks)), np.repeat(np.arange(n), few)])
            checks = fp[:, : len(names) - 2].copy()
            checks[:, 0] = checks[:, 0] & ~np.int64(1) | (few > 0)
            columns = [np.concatenate([values.ravel(), more]), batch.column("node").to_numpy()[which], *checks[which].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return nodes.select("node", "fp", "low").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def bucket_leads(key: np.ndarray, node: np.ndarray, checks: list[np.ndarray], similarity: float, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, lead) of the members, sorted by key, that are near another of their bucket: its first row, and the first row near the member.

    Of a bucket above ``cap`` all members, each with one of its leads near it.
    """
    n = len(key)
    words = [c.view(np.uint64) for c in checks]  # bits of signed numbers are counted without the sign
    small = (words[0] & np.uint64(1)).astype(bool)
    tight, loose = (allowed_bits(similarity, 64 * len(words), few) for few in (False, True))

    def near(i, j):
        differ = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in words)
        return differ <= np.where(small[i] | small[j], loose, tight)

    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [n]]))
    first, met = np.repeat(starts, sizes), np.repeat(sizes > cap, sizes)
    lead = np.arange(n)
    i, d = np.flatnonzero(~met), 1
    while True:
        i = i[i + d < n]
        i = i[first[i] == first[i + d]]
        if not len(i):
            break
        close = i[near(i, i + d)]
        met[close] = met[close + d] = True
        lead[close + d] = close  # a larger d comes later: the earliest stays
        d += 1
    for k in np.flatnonzero(sizes > cap):
        rest = np.arange(starts[k], starts[k] + sizes[k])
        while len(rest):
            close = near(rest, rest[0])
            lead[rest[close]] = rest[0]
            rest = rest[1:][~close[1:]]
    rows = np.flatnonzero(met)
    return rows, node[first[rows]], node[lead[rows]]


def meetings(keys: DataFrame, similarity: float, cap: int) -> DataFrame:
    """(key, first, lead, node, c0, c1, ...) of the members of buckets that are near another one."""
    checks = keys.columns[2:]
    names = ["key", "first", "lead", "node", *checks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (2 + len(checks))

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            rows, first, lead = bucket_leads(cols[0], cols[1], cols[2:], similarity, cap)
            out = [cols[0][rows], first, lead, *(c[rows] for c in cols[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        waiting = []  # batches since the last whole bucket
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            waiting.append(cols)
            if len(held[0]) and cols[0][-1] == held[0][0]:
                continue
            cols = [np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held, waiting = [c[cut:] for c in cols], []
            if cut:
                yield found([c[:cut] for c in cols])
        cols = [np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)]
        if len(cols[0]):
            yield found(cols)

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (node, text) whose text has the node's set; an id may have other texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles = distinct_shingles(text or "", words)
                if set_name(shingles) == node:
                    nodes.append(node)
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least this Jaccard similarity."""
    named = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
    both = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(named("u"), "u").join(named("v"), "v")
    shared, total = F.size(F.array_intersect("u_set", "v_set")), F.size("u_set") + F.size("v_set")
    return both.where(shared / (total - shared) >= similarity).select("u", "v")


def unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends are not in one component yet."""
    named = lambda side: roots.select(F.col("node").alias(side), F.col("component").alias(f"{side}_root"))
    both = pairs.join(named("u"), "u", "left").join(named("v"), "v", "left")
    return both.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def wide_components(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the nodes that are similar to another; see the module's text."""
    pairs = checkpointed(met.where("lead <> node").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct())
    links, roots = None, None
    for few in (True, False):
        # first each node with the first lead it met alone: most of a group is linked by so many comparisons as it has members
        asked = pairs.groupBy("v").agg(F.min("u").alias("u")) if few else unlinked(pairs, roots)
        found = checkpointed(similar(asked, sets, similarity))
        links = found if links is None else links.unionByName(found)
        roots = checkpointed(components(links))
    named = lambda side: roots.select(F.col("node").alias(side), F.col("component").alias(f"{side}_root"))
    rows = met.join(named("node"), "node", "left").join(named("first"), "first", "left")
    checks = met.columns[4:]
    placed = checkpointed(rows.select("key", "node", *checks, F.coalesce("node_root", "node").alias("root"), F.coalesce("first_root", "first").alias("first_root")))
    a, b = placed.where("root <> first_root").alias("a"), placed.alias("b")
    differ = reduce(add, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in checks])
    few = (F.col("a.c0").bitwiseOR(F.col("b.c0"))).bitwiseAND(F.lit(1)) == 1
    tight, loose = (allowed_bits(similarity, 64 * len(checks), few) for few in (False, True))
    near = differ <= F.when(few, loose).otherwise(tight)
    once = (F.col("b.root") == F.col("b.first_root")) | (F.col("a.node") < F.col("b.node"))  # of two that both ask, the smaller asks
    others = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & near)
    more = checkpointed(similar(others.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), sets, similarity))
    return checkpointed(components(links.unionByName(more))) if more.take(1) else roots


def wide_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8, size: int = 24, block_bits: int = 16, cap: int = 64, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row (id, text_hash, root, component_id) per input row; components of texts of at least ``similarity``.

    ``text_hash`` is Spark's xxhash64 of the text with the seed 42. ``root`` names the component, also where ids repeat with other
    texts or are null; ``component_id`` is its smallest id.
    """
    prints = checkpointed(wide_prints(documents, words, similarity, size, id_col, text_col, id_type))
    nodes = checkpointed(prints.groupBy("node").agg(F.min(id_col).alias("rep"), F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"), F.first("low").alias("low")))
    met = checkpointed(meetings(block_keys(nodes, size, block_bits), similarity, 8 * cap))
    wanted = met.select("node").distinct().join(nodes.select("node", "text_hash"), "node")
    texts = documents.select(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text")).join(wanted, "text_hash")
    roots = wide_components(met, checkpointed(shingle_sets(texts, words)), similarity)
    named = nodes.join(roots, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.select(id_col, "text_hash", "node").join(named.select("node", "root").join(names, "root"), "node", "left").select(id_col, "text_hash", "root", "component_id")
