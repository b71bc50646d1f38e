"""SentencePiece encoding and decoding by suffix-array matching.

Distinct units of a batch (a run of word-start marks with the text after it; no
piece crosses units) are concatenated and indexed by a suffix array over the
longest piece's length. Every vocabulary piece is looked up by binary search,
which gives all its occurrences as a range. The occurrences are edges (start,
length, piece), sorted by position. Relaxation then joins neighbouring spans
along the edges: for a BPE model, in each round every unit takes its best-scored
edge that spans exactly two neighbouring symbols, leftmost first, until none is
left, which gives the ids of the SentencePiece library. Symbols without a piece
fall back to bytes. Long units are relaxed with a heap instead of rounds.

Decoding joins the pieces' bytes, turns word-start marks into spaces and drops
the mark that encoding put in front.

Cases: null and empty texts give no ids and decode to the empty text; the
literal mark U+2581 in a text decodes to a space, as in the library; repeated
rows give equal ids; an empty table gives an empty result; extra input columns
are ignored. Texts of any length are encoded whole; a chunk of at most
``CHUNK`` characters of units is indexed at a time. A unit longer than ``TILE``, as in
texts without spaces, is cut first at places that no occurrence of a piece spans.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CHUNK = 1 << 20
TILE = 1 << 18
CACHE_UNITS = 1 << 19
LONG_UNIT = 48


class Model:
    """Vocabulary of a SentencePiece BPE model file: pieces, ranks, byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.surface: list[bytes] = []
        normal: list[tuple[float, int, str]] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                if not sp.is_unknown(i):
                    normal.append((-sp.get_score(i), i, piece))
        normal.sort()
        self.ids = np.array([i for _, i, _ in normal], np.int64)  # by rank
        self.longest = max(len(p) for _, _, p in normal)
        if any(MARK in p.lstrip(MARK) for _, _, p in normal):
            raise ValueError("pieces must not hold a word-start mark after other characters")
        alphabet = sorted({ord(c) for _, _, p in normal for c in p})
        self.alphabet = np.array(alphabet, np.int64)
        self.number = np.zeros(alphabet[-1] + 2, np.uint16)  # the last entry stands for all that come after
        self.number[self.alphabet] = np.arange(1, len(alphabet) + 1)
        self.words = -(-self.longest // 4)
        lengths = np.array([len(p) for _, _, p in normal])
        codes = np.zeros((len(normal), self.words * 4), np.uint16)
        flat = np.array([ord(c) for _, _, p in normal for c in p], np.int64)
        rows = np.repeat(np.arange(len(normal)), lengths)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[rows, cols] = np.searchsorted(self.alphabet, flat) + 1
        self.lengths = lengths
        pairs = codes[:, :-1].astype(np.int64) << 16 | codes[:, 1:]
        self.pairs = np.unique(pairs[codes[:, 1:] > 0])  # neighbours within some piece
        self.low = self._keys(codes)
        codes[cols_after(lengths, codes.shape[1])] = 0xFFFF
        self.high = self._keys(codes)

    @staticmethod
    def _keys(codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes.astype(">u2")).view(f"S{codes.shape[1] * 2}").ravel()

    def dense(self, chars: np.ndarray) -> np.ndarray:
        """Character numbers from 1 in code point order; 0 for what is in no piece."""
        return self.number[np.minimum(chars, len(self.number) - 1)]

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start * longest + length - 1 of every occurrence of every piece, rising; its rank)."""
        n, width = len(text), self.words * 4
        padded = np.concatenate([text, np.zeros(width, np.uint16)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)[:n]
        big = np.ascontiguousarray(windows).astype(">u2")
        suffixes = suffix_array(big.view(">u8")[:, 0].astype(np.uint64), width)
        keys = big.view(f"S{width * 2}").ravel()[suffixes]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        count = hi - lo
        rank = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        bits = len(self.ids).bit_length()
        both = (suffixes[inside] * self.longest + self.lengths[rank] - 1 << bits) | rank
        both.sort()  # plain numbers sort several times faster than an order of them
        return both >> bits, both & (1 << bits) - 1

    def parts(self, units: list[str]) -> tuple[list[str], list[int]]:
        """The units cut between characters that are neighbours in no piece, so that the parts are encoded alone; where each unit's parts begin."""
        joined = "\0".join(units)
        code = self.dense(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)).astype(np.int64)
        lengths = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        code[ends[:-1]] = 0  # separators stand beside no character of a piece
        pair = code[:-1] << 16 | code[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        cut = np.flatnonzero(np.concatenate([[True], self.pairs[at] != pair, [True]]))
        apart = np.zeros(len(code) + 1, bool)
        apart[ends] = True
        real = ~apart[cut[:-1]]
        first, last = cut[:-1][real], cut[1:][real]
        bounds = np.searchsorted(first, np.append(ends - lengths, len(code)))
        return [joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], bounds.tolist()


def suffix_array(heads: np.ndarray, width: int) -> np.ndarray:
    """Places in the order of the ``width`` characters from each on, by doubling; ``heads`` holds the first four of each."""
    order, size = np.argsort(heads), 4
    while size < width:
        rising = heads[order]
        rank = np.zeros(len(heads) + size, np.uint64)  # 0: after the end
        rank[order] = np.cumsum(np.concatenate([[True], rising[1:] != rising[:-1]]))[: len(heads)]
        heads = rank[: len(heads)] << np.uint64(32) | rank[size:]
        order, size = np.argsort(heads), size * 2
    return order


def cols_after(lengths: np.ndarray, width: int) -> np.ndarray:
    return np.arange(width)[None, :] >= lengths[:, None]


NO_EDGE = np.iinfo(np.int64).max


def units_of(text: str) -> list[str]:
    """The units of a text, each without its first mark, which every unit has: the text gets one in front."""
    units = text.split(" ")
    if MARK not in text and all(units):
        return units
    return [u[1:] for u in UNITS.findall(MARK + text.replace(" ", MARK))] if text else []


class Encoder:
    """Encodes texts; remembers a bounded number of units and of their parts, in two generations: those seen lately stay."""

    def __init__(self, path: str) -> None:
        self.model = model(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        units = [units_of(t) for t in texts]
        found = [[*map(self.known.get, text)] for text in units]
        fresh = dict.fromkeys(u for text, got in zip(units, found, strict=True) for u, b in zip(text, got, strict=True) if b is None)
        if len(self.known) + len(fresh) > CACHE_UNITS // 2:
            self.known, self.older = {}, self.known
        for u in fresh:
            fresh[u] = self.older.get(u)
        new = [u for u, b in fresh.items() if b is None]
        cut = {u: self._independent(MARK + u) for u in new if len(u) >= TILE}
        short = [u for u in new if u not in cut]
        whole = [*dict.fromkeys(p for own in cut.values() for p in own)]
        flat, bounds = self.model.parts([MARK + u for u in short]) if short else ([], [0])
        coded = self._parts_coded(flat, whole)
        for u, lo, hi in zip(short, bounds, bounds[1:], strict=False):
            fresh[u] = coded[flat[lo]] if hi == lo + 1 else b"".join([coded[p] for p in flat[lo:hi]])
        self.known.update((u, b) for u, b in fresh.items() if u not in cut)  # long units are not remembered
        fresh.update((u, b"".join(map(coded.__getitem__, own))) for u, own in cut.items())
        return [b"".join([fresh[u] if b is None else b for u, b in zip(text, got, strict=True)]) for text, got in zip(units, found, strict=True)]

    def _parts_coded(self, parts: list[str], whole: list[str]) -> dict[str, bytes]:
        """The ids of parts of units, which are remembered, and of parts of long units, which are not."""
        out = dict.fromkeys(parts)
        if len(self.known_parts) + len(out) > CACHE_UNITS // 2:
            self.known_parts, self.older_parts = {}, self.known_parts
        for p in out:
            out[p] = self.known_parts.get(p) or self.older_parts.get(p)
        new = [p for p, b in out.items() if b is None]
        out.update(zip(new, self._coded(new), strict=True))
        self.known_parts.update(out)
        out.update(zip(whole, self._coded(whole), strict=True))
        return out

    def _coded(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, indexed a chunk at a time."""
        out: list[bytes] = []
        chunk: list[str] = []
        size = 0
        for unit in units:
            if chunk and size + len(unit) >= CHUNK:
                out.extend(self._relaxed(chunk))
                chunk, size = [], 0
            chunk.append(unit)
            size += len(unit) + 1
        return out + self._relaxed(chunk) if chunk else out

    def _independent(self, unit: str) -> list[str]:
        """A long unit cut where no occurrence of any piece spans the cut, so that its parts are encoded alone.

        The index covers a tile at a time and the characters that its last pieces need; a tile without such a place grows.
        """
        m, parts, at, size = self.model, [], 0, TILE
        while len(unit) - at > size:
            chars = np.frombuffer(unit[at : at + size + m.longest].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            spots, _ = m.edges(m.dense(chars))
            start, length = spots // m.longest, spots % m.longest + 1
            spans = np.bincount(start + 1, minlength=len(chars) + 2) - np.bincount(start + length, minlength=len(chars) + 2)
            free = np.flatnonzero(np.cumsum(spans)[1 : size + 1] == 0) + 1
            if len(free):
                parts.append(unit[at : at + int(free[-1])])
                at, size = at + int(free[-1]), TILE
            else:
                size *= 2
        return [*parts, unit[at:]]

    def _relaxed(self, units: list[str]) -> list[bytes]:
        m = self.model
        chars = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(u) for u in units])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = m.dense(chars)
        text[(starts + lengths)[:-1]] = 0  # separators match no piece
        spots, ranks = m.edges(text)

        def rank_of(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            length = stop - start
            want = start * m.longest + length - 1
            at = np.minimum(np.searchsorted(spots, want), max(len(spots) - 1, 0))
            found = (length <= m.longest) & (spots[at] == want) if len(spots) else np.zeros(len(want), bool)
            return np.where(found, ranks[at] if len(spots) else 0, NO_EDGE)

        stops = np.zeros(len(chars) + 1, np.int64)  # end of the symbol that starts here; 0: none starts
        whole = np.arange(len(chars))
        stops[:-1] = whole + 1
        stops[(starts + lengths)[:-1]] = 0
        short = np.flatnonzero((lengths <= LONG_UNIT) & (lengths > 1))
        self._rounds(stops, starts[short], (starts + lengths)[short], rank_of)
        for u in np.flatnonzero(lengths > LONG_UNIT):
            self._heap(stops, int(starts[u]), int(starts[u] + lengths[u]), rank_of)
        first = np.flatnonzero(stops[:-1])
        rank = rank_of(first, stops[first])
        ids = np.where(rank == NO_EDGE, -1, m.ids[np.where(rank == NO_EDGE, 0, rank)])
        bounds = np.searchsorted(first, np.append(starts, len(chars))).tolist()
        raw = ids.astype("<u4").tobytes()
        coded = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in set((np.searchsorted(starts, first[ids < 0], "right") - 1).tolist()):
            out: list[int] = []
            for i in range(bounds[k], bounds[k + 1]):
                if ids[i] >= 0:
                    out.append(int(ids[i]))
                else:
                    out.extend(m.byte_ids[b] for b in chr(chars[first[i]]).encode("utf-8", "replace"))
            coded[k] = np.array(out, "<u4").tobytes()
        return coded

    @staticmethod
    def _rounds(stops: np.ndarray, begin: np.ndarray, end: np.ndarray, rank_of) -> None:
        """All units at once; in a round each unit joins its best neighbouring pair, leftmost on ties."""
        if not len(begin):
            return
        sizes = end - begin
        left = np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        unit = np.repeat(np.arange(len(begin)), sizes)
        rank = np.full(len(left), NO_EDGE)
        inner = stops[left] < end[unit]
        rank[inner] = rank_of(left[inner], stops[stops[left[inner]]])
        while len(left):
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            counts = np.diff(np.concatenate([heads, [len(unit)]]))
            live = best != NO_EDGE
            if not live.all():  # finished units leave
                keep = np.repeat(live, counts)
                left, unit, rank, best, counts = left[keep], unit[keep], rank[keep], best[live], counts[live]
                if not len(left):
                    return
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            hit = hit[np.concatenate([[True], unit[hit][1:] != unit[hit][:-1]])]
            joined = left[hit]
            middle = stops[joined]
            stops[joined] = stops[middle]
            stops[middle] = 0
            gone = np.zeros(len(left), bool)
            gone[hit + 1] = True  # the right symbol of each joined pair
            touched = np.zeros(len(left), bool)
            touched[hit] = True
            before = hit - 1
            before = before[(before >= 0) & (unit[np.maximum(before, 0)] == unit[hit])]
            touched[before] = True
            left, unit, rank, touched = left[~gone], unit[~gone], rank[~gone], touched[~gone]
            again = np.flatnonzero(touched)
            inner = stops[left[again]] < end[unit[again]]
            rank[again] = NO_EDGE
            again = again[inner]
            rank[again] = rank_of(left[again], stops[stops[left[again]]])

    @staticmethod
    def _heap(stops: np.ndarray, begin: int, end: int, rank_of) -> None:
        """One long unit: a heap of ranks and starts in one number each; an entry is stale if the pair at its start has another rank now."""
        size = end - begin
        stop = [*range(1, size + 1)]  # ends of the symbols, as seen from the unit's start
        before = [*range(-1, size)]  # starts of the symbols that end here
        left = np.arange(begin, end - 1)
        rank = rank_of(left, left + 2)
        now = np.append(rank, NO_EDGE)  # rank of the pair that starts here
        good = np.flatnonzero(rank != NO_EDGE)
        heap = (rank[good] * size + good).tolist()
        heapq.heapify(heap)
        while heap:
            r, s = divmod(heapq.heappop(heap), size)
            if now[s] != r:
                continue
            middle = stop[s]
            last = stop[middle]
            stop[s], before[last], now[middle] = last, s, NO_EDGE
            stop[middle] = 0
            pairs = [(s, stop[last])] if last < size else []
            pairs += [(before[s], last)] if s else []
            now[s] = NO_EDGE
            if pairs:
                found = rank_of(np.array([begin + a for a, _ in pairs]), np.array([begin + c for _, c in pairs]))
                for fresh, (a, _) in zip(found.tolist(), pairs, strict=True):
                    now[a] = fresh
                    if fresh != NO_EDGE:
                        heapq.heappush(heap, fresh * size + a)
        stops[begin:end] = np.where(np.array(stop) > 0, np.array(stop) + begin, 0)


@lru_cache(maxsize=1)
def model(path: str) -> Model:
    return Model(path)


def decode(m: Model, ids: np.ndarray) -> str:
    """The text of a list of ids; ill-formed bytes become U+FFFD."""
    text = b"".join(map(m.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that units are remembered between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


GROUP_CHARS = 1 << 22


def groups(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of a bounded number of characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def encode_documents(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row (id, ids) per input row."""

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        enc = encoder(model_path)
        for keys, texts in batches:
            for part in groups(texts):
                ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in enc.encode(texts[part])]
                yield {id_col: keys[part], "ids": ids}

    return map_texts(documents, id_col, text_col, run, f"{id_col} {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", id_type: str = "long") -> DataFrame:
    """One row (id, text) per input row of ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = [decode(m, np.asarray(v or [], np.int64)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"{id_col} {id_type}, text string")


def digest_documents(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """Encode and decode each text; one row (id, n_ids, ids_crc32, decoded_sha256, round_trip) per input row."""

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        enc = encoder(model_path)
        for keys, texts in batches:
            for part in groups(texts):
                coded = enc.encode(texts[part])
                back = [decode(enc.model, np.frombuffer(b, "<u4")) for b in coded]
                yield {
                    id_col: keys[part],
                    "n_ids": [len(b) // 4 for b in coded],
                    "ids_crc32": [zlib.crc32(b) for b in coded],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                    "round_trip": [a.replace(MARK, " ") == b for a, b in zip(texts[part], back, strict=True)],
                }

    return map_texts(documents, id_col, text_col, run, f"{id_col} {id_type}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
