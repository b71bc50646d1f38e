"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over byte symbols whose pieces may end with the
word-end mark, itself one symbol. Every node has a failure link: the node
reached after popping the longest matching pieces off the front of its string,
with the number of pieces popped. A word's last piece need not carry the
word-end mark, which is free when it is left over. Scanning a word symbol by symbol, following
failure links when no child fits, adds up the pieces of the greedy
longest-match-first segmentation in linear time without building any piece.

Words are split and lower-cased as the vocabulary's tokenizer does. Distinct
words of a batch are counted once.

Cases: null and empty texts count 0; repeated rows get equal counts; an empty
table gives an empty result; extra input columns are ignored. A symbol that no
piece starts with counts as one unknown piece.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts
from .packing import byte_symbols

END_MARK = "</w>"
END = 256  # the word-end mark as a symbol
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_WORDS = 1 << 19


class LongestMatch:
    """Trie with failure links and popped-piece counts; the ``free`` symbol costs nothing as a piece of its own."""

    def __init__(self, pieces: list[tuple[int, ...]], free: int | None = None) -> None:
        if {s for piece in pieces for s in piece} != {piece[0] for piece in pieces if len(piece) == 1}:
            raise ValueError("every symbol of a piece must itself be a piece")
        self.children: list[dict[int, int]] = [{}]
        terminal = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                following = self.children[node].get(symbol)
                if following is None:
                    following = len(terminal)
                    self.children[node][symbol] = following
                    self.children.append({})
                    terminal.append(False)
                node = following
            terminal[node] = True
        none = -1
        self.fail = [none] * len(terminal)
        self.popped = [0] * len(terminal)
        level = [0]
        while level:  # by depth, so that a parent's links are known
            below = []
            for parent in level:
                for symbol, node in self.children[parent].items():
                    below.append(node)
                    if terminal[node]:
                        self.fail[node], self.popped[node] = 0, int(symbol != free or parent != 0)
                        continue
                    pops, z = self.popped[parent], self.fail[parent]
                    while z != none and symbol not in self.children[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z != none:
                        self.fail[node], self.popped[node] = self.children[z][symbol], pops
            level = below

    def count(self, symbols: list[int]) -> int:
        """Pieces of the greedy segmentation; an unmatched symbol is an unknown piece of its own."""
        children, fail, popped = self.children, self.fail, self.popped
        node, total, i, n = 0, 0, 0, len(symbols)
        while i < n or node:
            following = children[node].get(symbols[i]) if i < n else None
            if following is not None:
                node = following
                i += 1
            elif node:
                total += popped[node]
                node = fail[node]
            else:
                total += 1  # unknown symbol
                i += 1
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """From a tokenizers BPE file with word ends; every byte symbol is a piece, alone and at a word's end."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to_byte = {c: b for b, c in byte_symbols().items()}
    pieces = [(b,) for b in range(256)] + [(b, END) for b in range(256)] + [(END,)]
    for piece in vocab:
        ends = piece.endswith(END_MARK) and len(piece) > len(END_MARK)
        body = piece[: -len(END_MARK)] if ends else piece
        if all(c in to_byte for c in body):
            pieces.append(tuple(to_byte[c] for c in body) + (END,) * ends)
    return LongestMatch(pieces, free=END)


@lru_cache(maxsize=1)
def word_pattern():
    import regex

    return regex.compile(WORD_PATTERN)


def words_of(text: str) -> list[str]:
    return word_pattern().findall(unicodedata.normalize("NFC", text).lower())


class Counter:
    """Counts texts, remembering the counts of a bounded number of distinct words."""

    def __init__(self, path: str) -> None:
        self.match = automaton(path)
        self.known: dict[str, int] = {}

    def text(self, text: str) -> int:
        words = words_of(text)
        known = self.known
        for word in set(words):
            if word in known:
                continue
            if len(known) >= CACHE_WORDS:
                known.clear()
                return self.plain(words)
            known[word] = self.match.count([*word.encode("utf-8", "replace"), END])
        return sum(map(known.__getitem__, words))

    def plain(self, words: list[str]) -> int:
        distinct = {w: self.match.count([*w.encode("utf-8", "replace"), END]) for w in set(words)}
        return sum(map(distinct.__getitem__, words))


def count_tokens(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row (id, n_tokens) per input row; no shuffle."""

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        counter = Counter(vocabulary_path)
        for ids, texts in batches:
            yield {id_col: ids, "n_tokens": [counter.text(t) for t in texts]}

    return map_texts(documents, id_col, text_col, run, f"{id_col} {id_type}, n_tokens long")
