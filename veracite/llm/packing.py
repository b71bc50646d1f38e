"""Order-preserving packing of tokenized documents into fixed-length windows.

Each partition streams its documents in their order. Token positions at document
ends, sentence ends and, inside longer sentences, every ``stride`` tokens are
possible window cuts. A dynamic program chooses the cuts that minimise padding
plus a penalty for each cut inside a document (less at a sentence end). The cost
of ending a window at cut j after a window ended at cut i is
``window - (p_j - p_i) + penalty_j``, so the best i is the minimum of
``cost_i + p_i`` over the cuts at most ``window`` tokens back: a monotone queue
gives it in constant time. A window whose length is a power of two needs no
padding; these transitions are looked up directly.

The program runs over blocks of whole documents of about ``block`` tokens, which
bounds its memory; a document longer than a block is packed over several blocks.
Window ids are unique: the partition's number in the high bits, a running number
in the low ones.

Cases: a null or empty text gives only its end token; repeated rows are packed
as often as they occur; an empty table gives an empty result; extra input
columns are ignored. Every token lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_texts

WINDOW = 2048
BLOCK = 1 << 18
STRIDE = 64
SENTENCE_PENALTY = 24.0
CUT_PENALTY = 96.0
END_ID = 1


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE encoder for a tokenizers file, with the file's own ids and pattern.

    The vocabulary is read from ``path``; the merge loop runs in tiktoken, which
    yields the ids of the tokenizers library several times faster (tests hold the two together).
    Texts are split at the file's added tokens, which keep the file's ids.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in byte_symbols().items()}
    added = spec.get("added_tokens", ())
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens must match as they stand")
    special = {t["content"]: t["id"] for t in added}
    ids = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    order = sorted(ids.values())
    if order != list(range(len(order))):
        raise ValueError("the vocabulary's ids must be its merge ranks")
    enc = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens=special)
    ends = np.zeros(max([*order, END_ID, *special.values()]) + 1, bool)
    for token, i in ids.items():
        ends[i] = b"\n" in token or token.rstrip()[-1:] in (b".", b"!", b"?")
    return enc, ends


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE files: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cut_points(ids: np.ndarray, stops: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(positions after which documents in a row may be cut, penalty of each); ``stops`` are the documents' ends, which are free."""
    final = ends[ids]
    final[stops - 1] = True
    marks = np.flatnonzero(final) + 1
    gaps = np.diff(marks, prepend=0)
    parts = (gaps - 1) // stride + 1  # a long sentence may also be cut every ``stride`` tokens
    at_mark = np.cumsum(parts) - 1
    points = np.repeat(marks - gaps, parts) + stride * (np.arange(parts.sum()) - np.repeat(at_mark + 1 - parts, parts) + 1)
    points[at_mark] = marks
    penalty = np.full(len(points), CUT_PENALTY)
    penalty[at_mark] = SENTENCE_PENALTY
    penalty[np.searchsorted(points, stops)] = 0.0
    return points, penalty


def free_steps(pos: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(from, to): the pairs of cuts a power of two apart, sorted by the second; such windows need no padding."""
    origin, target = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(window.bit_length()):
        want = pos - (1 << k)
        at = np.searchsorted(pos, want)
        hit = np.flatnonzero(pos[at] == want)  # ``at`` is never past the end, as ``want`` lies below
        origin.append(at[hit])
        target.append(hit)
    origin, target = np.concatenate(origin), np.concatenate(target)
    order = np.argsort(target, kind="stable")
    return origin[order].tolist(), target[order].tolist()


def best_cuts(points, penalty, window: int = WINDOW) -> list[int]:
    """Indices into ``points`` (rising, from above 0) of the window ends, the last point included.

    Neighbouring points must lie at most ``window`` apart, the first at most ``window`` from 0.
    """
    places = np.concatenate([[0], np.asarray(points, np.int64)])
    pos, fees = places.tolist(), list(map(float, penalty))
    origin, target = free_steps(places, window)
    target.append(-1)
    n = len(fees)
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    key = [0.0] * (n + 1)  # cost + position
    queue: deque[int] = deque([0])  # cuts with rising keys
    f = 0
    for j in range(1, n + 1):
        p = pos[j]
        while pos[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - p
        while target[f] == j:
            k = origin[f]
            if cost[k] < best:
                best, i = cost[k], k
            f += 1
        best += fees[j - 1]
        cost[j], back[j], key[j] = best, i, best + p
        while queue and key[queue[-1]] >= best + p:
            queue.pop()
        queue.append(j)
    out, j = [], n
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def pack_stream(documents: Iterator[tuple[object, np.ndarray]], ends: np.ndarray, window: int = WINDOW, block: int = BLOCK, stride: int = STRIDE) -> Iterator[tuple]:
    """Yield (doc id, start, length, crc32 of ids, document's tokens, window number, offset) in order."""
    number = 0
    pending: list[tuple[object, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple]:
        nonlocal number
        points, penalty = cut_points(np.concatenate([ids for _, ids in pending]), np.cumsum([len(ids) for _, ids in pending]), ends, min(stride, window))
        bounds = points[best_cuts(points, penalty, window)].tolist()
        w, opened, base = 0, 0, 0  # current window, where it opened, where the document starts
        for doc, ids in pending:
            at, n = 0, len(ids)
            raw = ids.astype("<u4")
            while at < n:
                stop = min(n, bounds[w] - base)
                yield doc, at, stop - at, zlib.crc32(raw[at:stop].tobytes()), n, number, base + at - opened
                at = stop
                if base + at == bounds[w]:
                    opened = bounds[w]
                    w, number = w + 1, number + 1
            base += n

    for doc, ids in documents:
        pending.append((doc, ids))
        size += len(ids)
        if size >= block:
            yield from flush()
            pending, size = [], 0
    if pending:
        yield from flush()


PIECE_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long", rows: int = 4096) -> DataFrame:
    """One row per piece of a document in a window; no shuffle, documents stay in their partition."""

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        enc, ends = encoder(tokenizer_path)
        part = TaskContext.get().partitionId() << 40

        def tokenized() -> Iterator[tuple[object, np.ndarray]]:
            for ids, texts in batches:
                for doc, text in zip(ids, texts, strict=True):
                    yield doc, np.append(enc.encode_to_numpy(text, allowed_special="all"), np.uint32(end_id))

        out: list[tuple] = []
        for piece in pack_stream(tokenized(), ends, window):
            out.append(piece)
            if len(out) >= rows:
                yield columns(out, part)
                out = []
        yield columns(out, part)

    def columns(out: list[tuple], part: int) -> dict:
        cols = list(zip(*out, strict=True)) or [()] * 7
        named = {id_col: list(cols[0])} | {n: list(c) for n, c in zip(PIECE_COLUMNS, cols[1:], strict=True)}
        named["sequence_id"] = [part + s for s in named["sequence_id"]]
        return named

    schema = f"{id_col} {id_type}, " + ", ".join(f"{n} long" for n in PIECE_COLUMNS)
    return map_texts(documents, id_col, text_col, run, schema)
