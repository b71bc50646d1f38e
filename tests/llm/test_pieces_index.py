"""The piece encoder indexes a unit once while it keeps coming, and its index is in order."""

import random

import numpy as np
import sentencepiece

from veracite.llm import pieces
from veracite.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def test_units_that_keep_coming_are_indexed_once(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 64)
    indexed = []
    edges = pieces.Model.edges
    monkeypatch.setattr(pieces.Model, "edges", lambda self, text: indexed.append("".join(chr(self.alphabet[c - 1]) if c else " " for c in text.tolist())) or edges(self, text))
    encoder, sp = pieces.Encoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for k in range(40):  # 400 units of their own and one of all
        texts = [" ".join([f"w{k}x{j}" for j in range(10)] + ["everywhere"]), "everywhere", ""]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [sp.encode(t) for t in texts]
        assert len(encoder.known) <= 64
    assert sum(t.count("everywhere") for t in indexed) == 1


def test_units_of_odd_texts():
    r = random.Random(4)
    mark = pieces.MARK
    odd = ["", " ", "  ", mark, " a", "a ", "a  b", f"{mark}a", f"a{mark}b c", "a\nb\tc", f" {mark} ", "é日 \U0001f600x", "a\0b c"]
    odd += ["".join(r.choice(f"ab  {mark}\n日") for _ in range(r.randrange(1, 12))) for _ in range(500)]
    for t in odd:
        assert [mark + u for u in pieces.units_of(t)] == (pieces.UNITS.findall(mark + t.replace(" ", mark)) if t else [])
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in pieces.Encoder(PATH).encode(odd)] == [sp.encode(t) for t in odd]


def test_suffixes_are_sorted_and_all_pieces_are_found():
    r = np.random.default_rng(8)
    m = pieces.model(PATH)
    for alphabet, n in ((2, 300), (30, 1000), (len(m.alphabet), 1000), (1, 50), (2, 1)):
        text = r.integers(0, alphabet + 1, n).astype(np.uint16)
        width = m.words * 4
        padded = np.concatenate([text, np.zeros(width, np.uint16)])
        windows = [tuple(padded[i : i + width]) for i in range(n)]
        heads = np.array([int.from_bytes(padded[i : i + 4].astype(">u2").tobytes()) for i in range(n)], np.uint64)
        order = pieces.suffix_array(heads, width)
        assert sorted(order.tolist()) == list(range(n)) and [windows[i] for i in order] == sorted(windows)
    text = "▁the▁sea,▁the▁sea▁and▁日本ing\0▁singing"
    spots, ranks = m.edges(m.dense(np.array([*map(ord, text)])))
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    named = {sp.id_to_piece(int(i)): k for k, i in enumerate(m.ids)}
    want = [(i * m.longest + n - 1, named[text[i : i + n]]) for i in range(len(text)) for n in range(1, m.longest + 1) if i + n <= len(text) and text[i : i + n] in named]
    assert list(zip(spots.tolist(), ranks.tolist(), strict=True)) == want


def test_parts_of_units_are_those_that_no_piece_joins():
    m = pieces.model(PATH)
    units = ["▁the", "▁sea,\nand", "▁a\0b", "▁日\U0001f600x", "x"]
    parts, bounds = m.parts(units)
    assert ["".join(parts[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)] == units and all(parts)
    joined = {p[i : i + 2] for p in map(sentencepiece.SentencePieceProcessor(model_file=PATH).id_to_piece, m.ids.tolist()) for i in range(len(p) - 1)}
    for a, b in zip(bounds, bounds[1:], strict=False):
        assert not any(left[-1] + right[0] in joined for left, right in zip(parts[a:b], parts[a + 1 : b], strict=False))
        assert all(p[i : i + 2] in joined for p in parts[a:b] for i in range(len(p) - 1))
