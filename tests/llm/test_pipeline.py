"""The pipeline's stages on a small fixture, each against what it should do with it."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from veracite.llm.queries import tokenizer_path


def words(n, seed):
    r = random.Random(seed)
    return [f"v{r.randrange(500)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        w = words(80, i)
        bad = i % 5 == 0
        if bad:
            w[r.randrange(80)] = r.choice(["nastyone", "nastytwo"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    passage, line = " ".join(words(60, 900)), " ".join(words(25, 901))
    one = words(200, 902)
    rows += [
        (400, " ".join(one), "en", "s", 0), (401, " ".join(one), "en", "s", 0), (402, " ".join([*one[:100], "edited", *one[101:]]), "en", "s", 0),
        (403, " ".join(words(50, 903)) + " " + passage + " " + " ".join(words(50, 904)), "en", "s", 0),
        (404, " ".join(words(70, 905)) + " " + passage + " " + " ".join(words(40, 906)), "en", "s", 0),
        (405, " ".join(words(90, 907)) + "\n" + line, "en", "s", 0), (406, line + "\n" + " ".join(words(90, 908)), "en", "s", 0),
        (407, " ".join(words(90, 909)) + " nastyone", "en", "s", 0), (408, None, None, None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    toxic = {i for i in range(0, 300, 5)} | {407}
    gone = set(range(300)) | set(range(400, 409))
    gone -= set(seen["toxicity"])
    assert len(toxic - gone) <= 3 and len(gone - toxic) <= 3
    assert "\n" in seen["toxicity"][405]["text"]
    # 401 equals 400 line by line, and 402 is within one word of it
    assert seen["line dedup"][401]["text"] == "" and seen["line dedup"][402]["text"] == ""
    assert seen["line dedup"][406]["text"].count("\n") == 0 and seen["line dedup"][405]["text"].count("\n") == 1
    near = seen["SimHash near-dedup"]
    assert 400 in near and 401 in near and 402 not in near and 408 in near  # the texts without words are one group; a null text is none
    parts = seen["substring dedup"]
    assert all(len(parts[d]["text"].split()) == n for d, n in ((403, 100), (404, 110)))
    assert parts[400]["text"] == near[400]["text"] and parts[400]["n_chars"] == len(near[400]["text"])
    assert set(seen["packing"]) == set(parts)


def near(a, b):
    """Whether two lines of five words or more differ by one inserted, deleted or replaced word."""
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    cut = [long[:i] + long[i + 1 :] for i in range(len(long))]
    return any(c == short for c in cut) if len(long) > len(short) else any(c == short[:i] + short[i + 1 :] for i, c in enumerate(cut))


def plain_run(texts, toxic):
    """The stages one after another, each by comparing everything with everything."""
    texts = {d: t for d, t in texts.items() if not toxic(t or "")}
    earlier, kept = [], {}
    for d, t in sorted(texts.items()):
        left = []
        for line in t.split("\n") if t is not None else []:
            w = line.split()
            if not w or not any(w == e or near(w, e) for e in earlier):
                left.append(line)
            if w:
                earlier.append(w)
        kept[d] = None if t is None else "\n".join(left)
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for d, w in ((d, t.lower().split()) for d, t in kept.items() if t is not None)}
    root = {d: d for d in shingles}
    for a in sorted(shingles):
        for b in sorted(shingles):
            x, y = shingles[a], shingles[b]
            if a < b and (x == y or len(x & y) >= 0.8 * len(x | y)):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    kept = {d: t for d, t in kept.items() if t is None or root[d] == d}
    count = collections.Counter(tuple(w[i : i + 35]) for w in ((t or "").split() for t in kept.values()) for i in range(len(w) - 34))
    for d, t in kept.items():
        w = (t or "").split()
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        if gone:
            kept[d] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return kept


def test_run_equals_a_plain_run(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = plain_run({d: t for d, t in texts.items() if d in clean}, lambda t: False)
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = collections.defaultdict(list)
    for r in got.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(kept)
    for d, t in kept.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc in sorted(pieces[d]):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), d
            at += length
        assert at == len(ids)


def test_near_copies_of_repeated_ids(spark):
    """An id with two texts: the near copy of another row goes, the distinct text stays."""
    one, other = " ".join(words(80, 920)), " ".join(words(80, 921))
    rows = [(1, one, "en", "s", 0), (2, one + " end", "en", "s", 0), (2, other, "en", "s", 0), (2, other, "en", "s", 0), (None, one, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([(0, one), (1, one), (2, other)])
