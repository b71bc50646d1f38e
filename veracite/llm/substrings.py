"""Substring dedup: words covered by a passage that also stands elsewhere go.

Words are the runs without ASCII white space. A window is ``window`` consecutive
words of one document. A word is removed if a window that covers it starts at
any other place too, in the same document or another.

Plan. Texts that stand twice lose every window; one row of each such text goes on
in the name of all. (1) Each text yields its anchors: the minimal hash of ``ANCHOR``
consecutive words in each window. Equal windows have equal anchors, so only windows
whose anchor occurs twice can repeat. (2) The windows around one anchor form a passage
of fewer than two windows' words. Passages go to reference shards by their anchor; a
shard's passages are indexed by suffix automata of a bounded number of words, each of
whole anchors, and streamed through their automaton. The matching statistics give the
state of each window's words, and the window repeats if that state stands for two
places. (3) The most frequent anchors, at most ``HOT_ANCHORS``, give a broadcast
shard: in two documents each the first ``HOT_PASSAGES`` different passages around them. Texts are streamed
through its automaton near their frequent anchors; a match of ``window`` words or more
shows a window that stands in the reference document too. Such windows need no
shuffle, so a passage that a third of all documents share is not gathered anywhere; for
the reference document itself each task reports once that it saw the window. (4) What
is left of the anchors that occur more than ``HOT_COUNT`` times would not fit an
automaton; these windows are told apart by 128-bit hashes of their words, counted in a
partial aggregate. (5) The words under all found windows, maximal spans of at least
``window`` words, are removed.

An automaton over all of a corpus streamed with the corpus is quadratic; routing by
anchor brings together the places that can match and nothing else.

Rows are told apart by the MD5 of id and text. The text is shuffled once, by that key,
and reused.

Cases: null and empty texts have no words; texts shorter than a window lose
nothing; repeated rows are places elsewhere, so they lose all words if they are
long enough; a null id is an id like any other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, sliced

WINDOW = 35
ANCHOR = 12
HOT_ANCHORS = 256
HOT_PASSAGES = 3
HOT_COUNT = 1024  # places of an anchor that one automaton holds
HOT_COPIES, HOT_TEXTS = 64, 1024
SHARD_WORDS = 1 << 16
PART = 1 << 18  # windows handled at once
POSITION_BITS = np.uint64(20)
BASE = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """A polynomial hash of each ``k`` consecutive entries, by doubling."""
    n = len(h) - k + 1
    out, done, size, power = None, 0, 1, h
    while True:
        if k & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        size *= 2
        if size > k:
            return mixed(out)
        power = power[: len(power) - size // 2] * np.uint64(pow(base, size // 2, 1 << 64)) + power[size // 2 :]


def window_keys(words: list[bytes], h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window: rolling hashes of two independent word hashes, with two bases."""
    from xxhash import xxh64_intdigest

    other = np.fromiter((xxh64_intdigest(w, 7) for w in words), np.uint64, len(words))
    return rolling(h, window).view(np.int64), rolling(other, window, BASE ^ 0x5851F42D4C957F2C).view(np.int64)


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    size, out = 1, h
    while size * 2 <= k:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - k + 1], out[k - size :][: len(h) - k + 1])


def anchors(h: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first window, anchor place of each window, anchor value of each window) in bounded parts."""
    width = min(ANCHOR, window)
    total = len(h) - window + 1
    for lo in range(0, total, PART):
        part = h[lo : lo + PART + window - 1]
        grams = rolling(part, width)
        keyed = (grams >> POSITION_BITS << POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(keyed, window - width + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        yield lo, place + lo, grams[place]


class Automaton:
    """Suffix automaton over the words of passages, with matching statistics."""

    def __init__(self, passages: list[tuple[object, int, list[bytes]]]) -> None:
        """Passages are (row key, first word's place, words)."""
        self.following: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        self.vocabulary: dict[bytes, int] = {}
        self.row: list[object] = []
        self.place: list[int] = []
        last = 0
        for k, (row, start, words) in enumerate(passages):
            for i, w in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                self.row.append(row)
                self.place.append(start + i)
            last = self._extend(last, -1 - k)  # a separator of its own
            self.row.append(None)
            self.place.append(-1)

    def _extend(self, last: int, symbol: int) -> int:
        following, link, length, end = self.following, self.link, self.length, self.end
        new = len(length)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(length[last])
        p = last
        while p != -1 and symbol not in following[p]:
            following[p][symbol] = new
            p = link[p]
        if p != -1:
            q = following[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p != -1 and following[p].get(symbol) == q:
                    following[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def matches(self, words: list[bytes], least: int) -> Iterator[tuple[int, int]]:
        """(last place in ``words``, last place in the reference) of each match of ``least`` words or more."""
        following, link, length = self.following, self.link, self.length
        number = self.vocabulary.get
        node = matched = 0
        for i, w in enumerate(words):
            c = number(w)
            if c is None:
                node = matched = 0
                continue
            while node and c not in following[node]:
                node = link[node]
                matched = length[node]
            if c in following[node]:
                node = following[node][c]
                matched += 1
            if matched >= least:
                yield i, self.end[node]

    def several(self, weights: list[int]) -> np.ndarray:
        """For each state whether its words stand at two places: two states end there, or passages that count twice."""
        out = np.zeros(len(self.length), bool)
        links = np.array(self.link)
        out[links[links >= 0]] = True  # a longer string that ends alike, besides the state's own
        counted = np.array(weights) > 1
        own = np.array(self.end)  # place in the stream of passages
        return out | (own >= 0) & counted[own]

    def repeated(self, words: list[bytes], window: int, several: np.ndarray) -> list[int]:
        """The starts of the windows of an indexed passage whose words stand at two places."""
        following, link, length = self.following, self.link, self.length
        number = self.vocabulary
        node, out = 0, []
        for i, w in enumerate(words):
            node = following[node][number[w]]
            while length[link[node]] >= window:
                node = link[node]
            if i >= window - 1 and several[node]:
                out.append(i - window + 1)
        return out


def _rows(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    values = column.values.to_numpy(zero_copy_only=False)  # of the whole parent; the offsets point into it
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory of those done goes back to the system, as two workers share an executor with its JVM."""
    for k, batch in enumerate(sliced(batches)):
        yield batch
        if k % 4 == 3:
            pa.default_memory_pool().release_unused()


def _long_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int64), pa.int64()).cast(kind))


def runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of consecutive numbers in a rising array."""
    if not len(starts):
        return starts, starts
    heads = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return starts[heads], np.diff(np.concatenate([heads, [len(starts)]]))


def text_anchors(rows: DataFrame, window: int) -> DataFrame:
    """(row, anchors): each place's anchor value once, so a value may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _released(batches):
            keys, found = [], []
            for key, text in zip(_rows(batch, "row"), _rows(batch, "text"), strict=True):
                words = words_of(text or "")
                if len(words) < window:
                    continue
                h = word_hashes(words)
                values = []
                before = -1
                for _, place, value in anchors(h, window):
                    fresh = np.concatenate([[place[0] != before], place[1:] != place[:-1]])
                    values.append(value[fresh])
                    before = place[-1]
                keys.append(key)
                found.append(np.concatenate(values).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _long_lists(found, pa.int64())], names=["row", "anchors"])

    return rows.select("row", "text").mapInArrow(run, "row binary, anchors array<long>")


def reference_passages(rows: DataFrame, hot: DataFrame, window: int) -> list[tuple[bytes, int, list[bytes]]]:
    """The first different passages around each frequent anchor in the rows named with it: fewer than two windows' words each."""
    wanted = F.broadcast(hot.groupBy("row").agg(F.collect_list("anchor").alias("anchors")))
    schema = pa.schema([("row", pa.binary()), ("place", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple[bytes, int, str]] = []
            for key, text, own in zip(_rows(batch, "row"), _rows(batch, "text"), _lists(batch, "anchors"), strict=True):
                words = words_of(text)
                seen: dict[int, set[bytes]] = {v: set() for v in own.tolist()}
                for lo, place, value in anchors(word_hashes(words), window):
                    for first, count, v in stretches(place, value, np.array([v for v, known in seen.items() if len(known) < HOT_PASSAGES], np.int64)):
                        passage = b" ".join(words[lo + first : lo + first + count + window - 1])
                        if len(seen[v]) < HOT_PASSAGES and passage not in seen[v]:
                            seen[v].add(passage)
                            out.append((key, lo + first, passage.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(schema.names)}, schema=schema)

    found = rows.join(wanted, "row").select("row", "text", "anchors").mapInArrow(run, "row binary, place long, words string").distinct().collect()
    return sorted((bytes(r["row"]), r["place"], words_of(r["words"])) for r in found)


def stretches(place: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first window, number of windows, anchor value) of the runs of windows around one anchor place, of the wanted values."""
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    counts = np.diff(np.concatenate([heads, [len(place)]]))
    values = value[heads].view(np.int64)
    good = np.isin(values, wanted)
    yield from zip(heads[good].tolist(), counts[good].tolist(), values[good].tolist(), strict=True)


_held: dict[str, Automaton] = {}


def held_reference(shared) -> tuple[Automaton, np.ndarray]:
    """The automaton of the broadcast passages, built once in each worker, and the frequent anchors.

    The driver sends passages alone: an automaton takes some fifty times their memory.
    """
    token, found, frequent = shared.value
    if token not in _held:
        _held.clear()
        _held[token] = Automaton(found)
    return _held[token], frequent


def covered(starts: np.ndarray, total: int, window: int) -> np.ndarray:
    """Which of ``total`` words lie under a window that starts at one of ``starts``."""
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + window, total), -1)
    return np.cumsum(depth[:-1]) > 0


def settled_by(reference: Automaton, frequent: np.ndarray, key: bytes, words: list[bytes], h: np.ndarray, window: int) -> dict[int, int]:
    """Windows of one row that the reference holds at another place: start to the match's last place in the reference."""
    near = np.concatenate([lo + np.flatnonzero(np.isin(v.view(np.int64), frequent)) for lo, _, v in anchors(h, window)])
    out: dict[int, int] = {}
    for first, count in zip(*runs_of(near), strict=True):
        for i, end in reference.matches(words[first : first + count + window - 1], window):
            start = int(first) + i - window + 1
            if reference.row[end] != key or reference.place[end] != start + window - 1:
                out[start] = end
    return out


def passages(joined: DataFrame, window: int) -> DataFrame:
    """(anchor, row, first, words) of the passages around the anchors in ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _released(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, text, own in zip(_rows(batch, "row"), _rows(batch, "text"), _lists(batch, "anchors"), strict=True):
                if not len(own):
                    continue
                words = words_of(text)
                for lo, place, value in anchors(word_hashes(words), window):
                    for first, count, v in stretches(place, value, own):
                        at = lo + first
                        for column, x in zip(out, (v, key, at, b" ".join(words[at : at + count + window - 1])), strict=True):
                            column.append(x)
            arrays = [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "row", "first", "words"])

    # all columns stay, needed here or not, so that the shuffle of the texts is the last step's own and is reused
    return joined.mapInArrow(run, "anchor long, row binary, first int, words binary")


def repeated_in_shards(found: DataFrame, window: int) -> DataFrame:
    """(row, starts) of the windows that repeat among the passages of their anchor."""

    def settle(group: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
        places: dict[bytes, list[tuple[bytes, int]]] = {}
        for _, row, first, words in group:
            places.setdefault(words, []).append((row, first))
        texts = [w.split() for w in places]
        index = Automaton([(None, 0, words) for words in texts])
        weights = [min(len(at), 2) for at, words in zip(places.values(), texts, strict=True) for _ in range(len(words) + 1)]
        several = index.several(weights)
        rows, starts = [], []
        for at, words in zip(places.values(), texts, strict=True):
            hits = np.array(index.repeated(words, window, several), np.int64)
            if len(hits):
                rows.extend(row for row, _ in at)
                starts.extend(hits + first for _, first in at)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), _long_lists(starts, pa.int32())], names=["row", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, bytes, int, bytes]] = []
        size = 0
        for batch in _released(batches):
            for passage in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if size >= SHARD_WORDS and passage[0] != group[-1][0]:
                    yield settle(group)
                    group, size = [], 0
                group.append(passage)
                size += passage[3].count(b" ") + 1
        if group:
            yield settle(group)

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "row binary, starts array<int>")


def crowded_windows(joined: DataFrame, shared, window: int) -> DataFrame:
    """(row, w1, w2, start) as arrays of the windows around the anchors in ``crowded`` that the broadcast automaton does not settle.

    Rows without a key report, once per task, the windows of the reference that the task settled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference, frequent = held_reference(shared)
        told: set[int] = set()
        for batch in _released(batches):
            keys: list[bytes | None] = []
            first, second, starts = [], [], []
            reports: list[tuple[int, int]] = []
            for key, text, own in zip(_rows(batch, "row"), _rows(batch, "text"), _lists(batch, "crowded"), strict=True):
                words = words_of(text)
                h = word_hashes(words)
                at = np.concatenate([lo + np.flatnonzero(np.isin(v.view(np.int64), own)) for lo, _, v in anchors(h, window)])
                w1, w2 = window_keys(words, h, window)
                if len(np.intersect1d(own, frequent)):
                    done = settled_by(reference, frequent, key, words, h, window)
                    at = np.setdiff1d(at, np.array(list(done), np.int64), assume_unique=True)
                    for start, end in done.items():
                        if end not in told:
                            told.add(end)
                            reports.append((int(w1[start]), int(w2[start])))
                if len(at):
                    keys.append(key)
                    first.append(w1[at])
                    second.append(w2[at])
                    starts.append(at)
            if reports:
                keys.append(None)
                first.append(np.array([r[0] for r in reports], np.int64))
                second.append(np.array([r[1] for r in reports], np.int64))
                starts.append(np.full(len(reports), -1))
            arrays = [pa.array(keys, pa.binary()), _long_lists(first, pa.int64()), _long_lists(second, pa.int64()), _long_lists(starts, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "w1", "w2", "start"])

    return joined.mapInArrow(run, "row binary, w1 array<long>, w2 array<long>, start array<int>")


def row_key(id_col: str, text_col: str):
    text = F.col(text_col).cast("string")
    whole = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.when(text.isNull(), F.lit("/")).otherwise(F.lit(":")), F.coalesce(text, F.lit("")))
    # not nullable, or an inner join filters its side, which then has a shuffle of the text of its own
    return F.coalesce(F.unhex(F.md5(whole)), F.lit(b"").cast("binary"))


def copied_rows(rows: DataFrame) -> DataFrame:
    """(row, rep) of the rows whose text stands twice, with one row of each such text.

    The texts with most copies are known to every task, so that none gathers its rows in one.
    """
    texts = rows.select("row", F.unhex(F.md5(F.col("text"))).alias("t")).where("t is not null")
    copies = checkpointed(texts.groupBy("t").agg(F.count("*").alias("c"), F.min("row").alias("rep")).where("c > 1"))
    most = F.broadcast(copies.where(F.col("c") >= HOT_COPIES).orderBy(F.desc("c"), "t").limit(HOT_TEXTS).select("t", "rep"))
    often = texts.join(most, "t")
    seldom = texts.join(most.select("t"), "t", "left_anti").join(copies.join(most.select("t"), "t", "left_anti").select("t", "rep"), "t")
    return often.unionByName(seldom).select("row", "rep").distinct()


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, id_type: str = "long", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, n_words, n_removed, kept_sha256) per input row.

    ``with_text`` adds ``text``: the text itself if it lost nothing, else its kept
    words joined by spaces. The columns named in ``carry`` pass through.
    """
    extra = {f"_c{k}": c for k, c in enumerate(carry)}
    bounded_batches(documents.sparkSession)
    rows = documents.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for k, c in extra.items()])
    copied = checkpointed(copied_rows(rows))
    spare = copied.where("row <> rep").select("row")
    found = checkpointed(text_anchors(rows, window).join(spare, "row", "left_anti").dropDuplicates(["row"]))
    single = found.select("row", F.explode("anchors").alias("anchor"))
    counts = checkpointed(single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    frequent = counts.where(F.col("n") > HOT_COUNT).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).select("anchor")
    hot_rows = single.join(F.broadcast(frequent), "anchor").groupBy("anchor").agg(F.min("row").alias("row"), F.max("row").alias("other")).collect()  # at most HOT_ANCHORS
    spark = documents.sparkSession
    bounded = spark.createDataFrame(sorted({(r["anchor"], bytes(r[c])) for r in hot_rows for c in ("row", "other")}), "anchor long, row binary")
    # the most frequent anchors are known by now and need no shuffle, so none of them gathers its rows in one task
    top = F.broadcast(bounded.select("anchor").distinct())
    rest = single.join(top, "anchor", "left_anti").join(counts, "anchor").select("row", "anchor", (F.col("n") > HOT_COUNT).alias("hot"))
    each = rest.unionByName(single.join(top, "anchor", "left_semi").select("row", "anchor", F.lit(True).alias("hot")))
    pick = lambda hot: F.collect_set(F.when(F.col("hot") == hot, F.col("anchor")))
    repeated = checkpointed(each.groupBy("row").agg(pick(False).alias("anchors"), pick(True).alias("crowded")))
    found_passages = reference_passages(rows, bounded, window) if hot_rows else []
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, found_passages, np.array([r["anchor"] for r in hot_rows], np.int64)))

    text = rows.repartition("row")
    whole_copies = copied.select("row", F.lit(True).alias("copied")).distinct()
    settled = repeated_in_shards(passages(text.join(repeated.select("row", "anchors"), "row"), window), window)
    crowded = crowded_windows(text.join(repeated.where("size(crowded) > 0").select("row", "crowded"), "row"), shared, window)
    pending = crowded.select("row", F.explode(F.arrays_zip("w1", "w2", "start")).alias("w")).select("row", "w.w1", "w.w2", "w.start")
    twice = pending.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    counted = pending.where("row is not null").join(twice, ["w1", "w2"], "left_semi").select("row", F.array("start").alias("starts"))
    starts = settled.unionByName(counted).groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    kinds = dict(rows.dtypes)
    schema = f"{id_col} {id_type}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text + "".join(f", {k} {kinds[k]}" for k in extra)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference, frequent = held_reference(shared)
        for batch in _released(batches):
            cols: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "text": []}
            columns = (_rows(batch, "row"), _rows(batch, "text"), _rows(batch, "copied"), _lists(batch, "starts"), _lists(batch, "crowded"))
            for key, body, copied_row, own, marks in zip(*columns, strict=True):
                words = words_of(body or "")
                kept = words
                if copied_row:
                    own, marks = np.arange(max(len(words) - window + 1, 0)), marks[:0]
                own = own.astype(np.int64)
                if len(np.intersect1d(marks, frequent)):
                    done = settled_by(reference, frequent, key, words, word_hashes(words), window)
                    own = np.union1d(own, np.array(list(done), np.int64))
                if len(own):
                    gone = covered(own, len(words), window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                cols["n_words"].append(len(words))
                cols["n_removed"].append(len(words) - len(kept))
                cols["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    cols["text"].append(None if body is None else body if len(kept) == len(words) else joined.decode("utf-8", "replace"))
            arrays = [batch.column(batch.schema.get_field_index("id")), pa.array(cols["n_words"], pa.int64()), pa.array(cols["n_removed"], pa.int64()), pa.array(cols["kept_sha256"], pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols["text"], pa.string()))
                names.append("text")
            for k in extra:
                arrays.append(batch.column(batch.schema.get_field_index(k)))
                names.append(k)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    whole = text.join(repeated.select("row", "crowded"), "row", "left").join(starts, "row", "left").join(whole_copies, "row", "left")
    whole = whole.select("row", "id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), none("starts", "int"), none("crowded", "long"), *extra)
    return whole.mapInArrow(finish, schema).withColumnsRenamed(extra)
