"""Each operator against brute force on small tables with nulls, ties, repeats and odd texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veracite.llm import ann, graph, lines, packing, pieces, quality, simhash, spotsigs, substrings, token_counts, toxicity
from veracite.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, _bucket string, h1 long, fp string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = words(90, 1)
    near = base[:40] + ["changed"] + base[41:]
    line = " ".join(words(20, 2))
    out = [
        " ".join(base), " ".join(base), " ".join(near), " ".join(words(60, 3) + base[10:60] + words(60, 4)), "", None, " \t\n ", "one", "ONE", "a b",
        line + "\n" + line + "\n\n" + " ".join(line.split()[:-1]), line.replace("w1", "x1", 1) + "\nshort line", "short line\n tab\tline here now ok", "x" * 5000,
        "the " * 300, " ".join(words(3000, 5)), "été " + chr(0x1F4C8) + " " + chr(0x2581) + " naïve " + chr(0xA0) + "end.", " ".join(["same"] * 120),
    ]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "r", "w", "b", 1, "f") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark, docs):
    """Repeated rows and null ids on top."""
    extra = spark.createDataFrame([(None, "null id words go here and there", None, None, None, None, None, None, None, None), (None, None, *[None] * 8)], SCHEMA)
    return docs.unionByName(docs.where("doc_id < 3")).unionByName(extra)


def small_models():
    """A quality and a toxicity model, each trained on a few texts."""
    r = random.Random(8)
    texts, good, bad = [], [], []
    for i in range(160):
        w = words(40, 1000 + i)
        bad.append(int(i % 3 == 0))
        good.append(int(i % 2 == 0))
        if bad[-1]:
            w[r.randrange(40)] = "nastyone"
        texts.append(" ".join(w) if good[-1] else "!! ".join(w).upper())
    x = np.array([quality.features(t) for t in texts])
    return quality.fit_pairs(x, np.array(good)), toxicity.train(texts, np.array(bad))


QUALITY, TOXICITY = small_models()

RUNS = {
    "quality": lambda d: quality.score(d, QUALITY),
    "toxicity": lambda d: toxicity.score(d, TOXICITY),
    "no quality model": lambda d: quality.score(d, None),
    "no toxicity model": lambda d: toxicity.score(d, None),
    "keep_clean": lambda d: toxicity.keep_clean(d, None),
    "substrings": lambda d: substrings.dedup(d, with_text=True, carry=("lang", "row")),
    "simhash": lambda d: simhash.groups(d),
    "wide": lambda d: simhash.wide_groups(d, size=4, block_bits=16),
    "packing": lambda d: packing.pack(d, tokenizer_path("byte_bpe_50k.json")),
    "pieces": lambda d: pieces.digest_documents(d, tokenizer_path("piece_bpe_32k.model")),
    "spotsigs": lambda d: spotsigs.edited_likeness(d),
    "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path("word_bpe_49k.json")),
    "lines": lambda d: lines.line_counts(d),
    "lines_dedup": lambda d: lines.dedup(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_awkward_rows_give_one_row_each(name, awkward):
    got = RUNS[name](awkward).collect()
    if name in ("quality", "toxicity"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got) and len({r["score"] for r in got}) > 3
    if name == "packing":
        assert sum(r["start"] == 0 for r in got) == awkward.count()
    else:
        assert len(got) == awkward.count()
    by_id = collections.defaultdict(set)
    for r in got:
        if name not in ("packing", "spotsigs"):
            by_id[r["doc_id"]].add(tuple(v if not isinstance(v, list) else tuple(v) for k, v in sorted(r.asDict().items())))
    assert all(len(v) == 1 for k, v in by_id.items() if k is not None)


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(name, docs):
    assert RUNS[name](docs.where("doc_id < 0")).count() == 0


def removed_by_windows(texts, window=35):
    """(words, gone) of each text: words under a window that starts at several places."""
    split = {d: (t or "").encode().split() for d, t in texts.items()}
    count = collections.Counter(tuple(w[i : i + window]) for w in split.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[d] = w, gone
    return out


def assert_removed(got, texts):
    for d, (w, gone) in removed_by_windows(texts).items():
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()), d


@pytest.mark.parametrize("hot_anchors", [0, 3, 512])
@pytest.mark.parametrize("hot_count", [1, 4, 1024])
def test_substrings_match_brute_force(spark, docs, texts, monkeypatch, hot_count, hot_anchors):
    """With every repeated anchor in the shards, in the broadcast automaton, or told apart by hashes."""
    monkeypatch.setattr(substrings, "HOT_COUNT", hot_count)
    monkeypatch.setattr(substrings, "HOT_ANCHORS", hot_anchors)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    if hot_count == 4:  # a passage that many texts share among words of their own
        shared = words(50, 77)
        more = {100 + k: " ".join(words(30 + k, 500 + k) + shared[k % 5 :] + words(40, 600 + k)) for k in range(20)}
        texts = {**texts, **more}
        docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    assert_removed({r["doc_id"]: r for r in substrings.dedup(docs).collect()}, texts)


def test_substrings_of_long_repetitive_texts(spark, monkeypatch):
    """One word 60,000 times, a short cycle, and seams of the parts; the broadcast shard stays small."""
    monkeypatch.setattr(substrings, "PART", 1 << 10)
    held = []
    passages = substrings.reference_passages
    monkeypatch.setattr(substrings, "reference_passages", lambda *given: held.extend(passages(*given)) or held)
    lone = [f"u{k}" for k in range(5000)]
    texts = {0: "same " * 60_000, 1: "a b c " * 2000, 2: " ".join(lone), 3: " ".join([*lone[1000:1100], "x", *lone[2040:2090], "same"]), 4: "b c a " * 15}
    assert_removed({r["doc_id"]: r for r in substrings.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}, texts)
    assert held and sum(len(words) for _, _, words in held) < 1000


def test_automaton_matching_statistics():
    passages = [(1, 0, [b"a", b"b", b"c", b"a", b"b", b"d"]), (2, 5, [b"b", b"d", b"x"])]
    auto = substrings.Automaton(passages)
    several = auto.several([1] * 11)
    assert auto.repeated(passages[0][2], 2, several) == [0, 3, 4] and auto.repeated(passages[1][2], 2, several) == [0]
    assert auto.repeated(passages[1][2], 2, auto.several([1] * 7 + [2] * 4)) == [0, 1]
    stream = [b"z", b"a", b"b", b"d", b"x", b"a", b"b", b"c", b"a"]
    flat = [w for _, _, p in passages for w in [*p, None]]
    for least in (2, 3, 4):
        got = {i for i, _ in auto.matches(stream, least)}
        want = {i for i in range(least - 1, len(stream)) if any(flat[k : k + least] == stream[i - least + 1 : i + 1] for k in range(len(flat)))}
        assert got == want
    for i, end in auto.matches(stream, 2):
        assert flat[end] == stream[i] and flat[end - 1] == stream[i - 1]


def prints(texts, k=3):
    out = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        out[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def closure(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(docs, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.groups(docs).collect()}
    fp = prints(texts)
    root = closure(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert got == {d: (f"{fp[d]:016x}", root[d]) for d in fp}


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("cap", [2, 64])
def test_simhash_links_of_crowded_buckets(spark, cap, distance):
    r = random.Random(cap)
    centre = r.getrandbits(63)
    values = {centre ^ sum(1 << b for b in r.sample(range(63), r.randrange(4))) for _ in range(150)} | {r.getrandbits(63) for _ in range(20)}
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["node"]: r["component"] for r in graph.components(simhash.links(nodes, distance, cap=cap)).collect()}
    assert {v: got.get(v, v) for v in values} == closure(sorted(values), lambda a, b: (a ^ b).bit_count() <= distance)


def test_simhash_rows_without_an_id_link_others(spark, monkeypatch):
    """Fingerprints 0 - 3 (of a null id only) - 15: one component."""
    marks = {"a": 0, "b": 3, "c": 15, "d": 255 << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.replace({k: str(v) for k, v in marks.items()}, subset="text").select("doc_id", F.array(F.col("text").cast("long")).alias("fp")))
    docs = spark.createDataFrame([(5, "a"), (None, "b"), (9, "c"), (None, "d"), (None, "a")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, int(r["fingerprint"], 16), r["component_id"] or 0) for r in simhash.groups(docs).collect())
    assert got == [(0, 0, 5), (0, 3, 5), (0, 255 << 40, 0), (5, 0, 5), (9, 15, 5)]


def test_wide_groups_find_similar_texts(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.wide_groups(docs).collect()}
    assert got[1] == got[0] == 0 and got[2] == 0 and got[3] == 3 and got[15] == 15


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 60)] + [(3, 3), (None, 4), (70, 71), (71, 70)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {100, 5, 70} and got[140] == 100 and got[59] == 5 and 3 not in got


def test_lines_match_brute_force(docs, texts):
    rows = {r["doc_id"]: r for r in lines.line_counts(docs).collect()}
    kept_text = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    earlier = []
    for d, t in texts.items():
        gone = []
        for k, raw in enumerate((t or "").split("\n") if t is not None else []):
            w = [x for x in re.split("[ \t\x0b\f\r]+", raw) if x]
            if not w:
                continue
            near = lambda a, b: min(len(a), len(b)) >= 5 and (
                any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a))) if len(a) == len(b)
                else abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b))))
            )
            if any(w == e or near(w, e) for e in earlier):
                gone.append(k)
            earlier.append(w)
        assert rows[d]["removed_lines"] == gone, d
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert kept_text[d] == want


def test_packing_keeps_every_token(docs, texts):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    rows = packing.pack(docs, path).collect()
    ids = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
        ids[r["doc_id"]] += piece
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(ids) == want
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_cuts_are_optimal():
    r = random.Random(9)
    for _ in range(60):
        points = sorted(r.sample(range(1, 60), r.randrange(1, 14)))
        points = [p for p in points if p] + [60]
        cost = [r.choice([0.0, 2.0, 9.0]) for _ in points]
        if max(b - a for a, b in zip([0, *points], points, strict=False)) > 16:
            continue

        def total(cuts):
            at = out = 0
            for c in cuts:
                used = points[c] - at
                out += cost[c] + (0 if used & (used - 1) == 0 else 16 - used)
                at = points[c]
            return out

        best = {0: 0.0}
        for j, p in enumerate(points):
            best[p] = min(v + cost[j] + (0 if (p - q) & (p - q - 1) == 0 else 16 - (p - q)) for q, v in best.items() if p - q <= 16)
        assert total(packing.best_cuts(points, cost, 16)) == pytest.approx(best[60])


def test_pieces_match_the_library(docs, texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode_documents(docs, path)
    for r in encoded.collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]] or "")
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, path).collect()}
    assert back == {d: (t or "").replace(chr(0x2581), " ") for d, t in texts.items()}


def test_token_counts_match_greedy(docs, texts):
    import json

    path = tokenizer_path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocab = set(json.load(f)["model"]["vocab"])
    symbols = packing.byte_symbols()

    def greedy(word):
        s, i, n = [symbols[b] for b in word.encode()], 0, 0
        while i < len(s):
            i = next(j for j in range(len(s), i, -1) if j == i + 1 or (j == len(s) and "".join(s[i:j]) + "</w>" in vocab) or "".join(s[i:j]) in vocab)
            n += 1
        return n

    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {d: sum(map(greedy, token_counts.words_of(t or ""))) for d, t in texts.items()}


def test_spotsigs_match_brute_force(docs, texts):
    common = set(spotsigs.ANCHORS)

    def signatures(t):
        w = re.split(r"[\W_]+", t.lower())
        content = [(x, w[i - 1] if i else None) for i, x in enumerate(w) if x and x not in common]
        chains = [(b, *[content[i + k][0] for k in range(spotsigs.CHAIN)]) for i, (_, b) in enumerate(content) if i + spotsigs.CHAIN <= len(content)]
        anchored = {c for c in chains if c[0] in common}
        return (anchored if len(anchored) >= spotsigs.FEW else set(chains)) or {("whole", t)}

    got = {r["doc_id"]: r for r in spotsigs.edited_likeness(docs).collect()}
    ids = sorted(texts)
    like = lambda a, b: len(a & b) / len(a | b)
    for k, d in enumerate(ids):
        t, following = texts[d] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(signatures(t), signatures(edited))) and r["near_next"] == pytest.approx(like(signatures(t), signatures(following)))


def test_spotsigs_next_documents_over_bucket_seams(spark, monkeypatch):
    """Thousands of rows, gaps between the ids, repeated and null ones: each row's next is the next by id, then by the text's hash."""
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 40)
    monkeypatch.setattr(spotsigs, "COARSE", 8)
    r = random.Random(6)
    ids = [None, None, -5, *sorted(r.sample(range(100), 60)), *range(1000, 3000), *[5000] * 90, *range(10**12, 10**12 + 50), 2**62]
    rows = [(i, f"the c{k} d{k} " + "x" * (k % 9)) for k, i in enumerate(ids)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5).withColumn("tie", F.xxhash64("text"))
    ordered = sorted(df.collect(), key=lambda x: (-(2**63) if x["id"] is None else x["id"], x["tie"]))
    want = {x["text"]: ordered[(k + 1) % len(ordered)]["text"] for k, x in enumerate(ordered)}
    got = {x["text"]: x["next_text"] for x in spotsigs.with_neighbours(df, ["text"], "id").collect()}
    assert got == want and len(want) == len(rows)


def test_spotsigs_near_duplicates(docs):
    membership, pairs = spotsigs.near_duplicates(spotsigs.fingerprints(docs), 0.8)
    classes = {r["doc_id"]: r["class_id"] for r in membership.collect()}
    assert classes[1] == classes[0] == 0
    assert (0, 2) in {(r["left_id"], r["right_id"]) for r in pairs.collect()}


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (920, [0.0] * 24), (940, [float("nan")] * 24), (960, [1.0]), (980, [None] * 24), (None, [1.0] * 24), (3, [float(v) for v in x[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=300, query_block=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores)[:10])
        hits += len(best & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 11)) and q not in {v for _, v, _ in found}
        assert all(s == pytest.approx(scores[v]) for _, v, s in found)
    assert hits / (10 * len(got)) >= 0.9
    assert ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, k=10).count() == 2
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_classifiers_learn(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = words(60, i)
        bad = r.random() < 0.4
        if bad:
            w[r.randrange(60)] = r.choice(["nastyone", "nastytwo", "vileword"])
        junk = r.random() < 0.4
        text = " ".join(x.upper() + "!!" if junk else x for x in w)
        rows.append((i, text))
        labels.append((i, int(not junk), int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 4 == 0
    truth = {i: (q, t) for i, q, t in labels}
    good = {row["doc_id"]: row["predicted"] for row in quality.score(docs, quality.fit(docs, known, held)).collect()}
    toxic = {row["doc_id"]: row["predicted"] for row in toxicity.score(docs, toxicity.fit(docs, known, held)).collect()}
    fold = [i for i in truth if i % 4 == 0]
    assert np.mean([good[i] == truth[i][0] for i in fold]) > 0.95
    assert np.mean([toxic[i] == truth[i][1] for i in fold]) > 0.9
    assert quality.fit(docs, known.where("quality = 1"), held) is None and toxicity.fit(docs, known.where("doc_id < 0"), held) is None


def test_wide_groups_find_every_pair_of_the_stated_similarity(spark):
    """Pairs from 0.76 to 0.90, large and very small texts, against the exact Jaccard similarity."""
    r = random.Random(17)
    texts = {}
    for k in range(600):
        n = r.choice([8, 9, 10, 14, 24, 80, 274])
        base = [f"p{k}x{i}" for i in range(n)]
        shared, goal = n - 4, r.uniform(0.76, 0.90)
        other = list(base)
        cut = min(round(shared * (1 - goal)), shared - 1)
        other = base[:-cut] if cut and k % 2 else [*base[: n - cut // 2], *[f"q{k}x{i}" for i in range(cut // 2)]]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in ((d, t.split()) for d, t in texts.items())}
    want = {2 * k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(600)}
    assert sum(0.8 <= j < 0.83 for j in want.values()) > 50 and sum(j < 0.8 for j in want.values()) > 50
    got = {x["doc_id"]: x["component_id"] for x in simhash.wide_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {d: got[d + 1] == got[d] == d for d in want} == {d: j >= 0.8 for d, j in want.items()}


@pytest.mark.parametrize("cap", [1, 64])
def test_wide_groups_of_many_near_copies_match_brute_force(spark, cap):
    r = random.Random(23)
    base = words(120, 31)
    texts = {}
    for d in range(90):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(120)] = f"e{r.randrange(10**6)}"
        texts[d] = " ".join(w)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in texts.items())}
    root = closure(list(texts), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    got = {x["doc_id"]: x["component_id"] for x in simhash.wide_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), cap=cap).collect()}
    assert got == root and len(set(root.values())) > 1


def test_packing_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = {0: "a <|endoftext|> b", 1: "<|endoftext|>", 2: "x.<|endoftext|><|endoftext|>\n y<|endoftext|", 3: "A<|ENDOFTEXT|> <|endoftext|>  two\n\n  <|endoftext|>z"}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path).collect()
    for d, t in texts.items():
        want = [*tok.encode(t, add_special_tokens=False).ids, 1]
        pieces_of = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces_of) == len(want) and 50256 in want
        for r in pieces_of:
            piece = want[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(want)


def test_spotsigs_count_of_anchors_does_not_change_the_kind_of_set(spark):
    """Few anchors in a long text, and an edited end with many: what stands before the edit stays alike."""
    start = [f"s{i}" for i in range(150)]
    start[20:20] = ["the"]
    end = " ".join(f"the e{i} f{i}" for i in range(40))
    texts = {0: " ".join(start), 1: " ".join(start) + " " + end}
    got = {r["doc_id"]: set(r["signatures"]) for r in spotsigs.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(got[0]) > 100 and len(got[0] - got[1]) <= 2
    assert len(got[1] - got[0]) <= 45


def test_ann_ties_repeats_and_dimensions(spark):
    """Equal scores go to smaller ids; one id with two vectors is two rows; vectors meet those of their dimension."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[5]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[40].tolist()), (20, x[20].tolist())]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    distinct = [(i, tuple(v)) for i, v in rows[:301]]
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=64, query_block=4, probe=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    for q in (0, 20, 100, 120, 1000, 1020):
        pool = distinct if q < 1000 else [(i, tuple(v)) for i, v in rows[302:]]
        want = []
        for own in [v for v in pool if v[0] == q]:
            others = [(round(-float(np.dot(own[1], v)), 9), i) for i, v in pool if (i, v) != own]
            want += [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(others)[:20])]
        assert sorted(got[q]) == sorted(want), q


def test_ann_visits_few_cells_where_vectors_have_structure(spark):
    """Clusters far apart: the fitted reach leads each query to a part of the cells, and recall stays."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 10
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    reach = ann.fitted_reach(x, 5, len(x), 10)
    visited = [len(ann.cells_within(m, reach)) for m in ann.margins(x[:200], 5)]
    assert np.mean(visited) < 12
    hits, found = 0, ann.nearest(rows, F.col("vec_id") % 20 == 0, k=10, shard_rows=63).collect()
    for r in found:
        scores = x @ x[r["query_id"]]
        scores[r["query_id"]] = -np.inf
        hits += scores[r["vec_id"]] >= np.sort(scores)[-10]
    assert len(found) == 1000 and hits >= 900


def test_lines_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx", 7, "r", "g"), (2, "x\na b c d e", 8, "r", "g"), (3, None, 9, None, None)], "doc_id long, text string, _row long, row string, _gone string")
    got = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    assert got[2]["text"] == "" and got[1]["text"] == "a b c d e\nx" and got[3]["text"] is None
    assert [got[k]["_row"] for k in (1, 2, 3)] == [7, 8, 9] and got[1]["_gone"] == "g" and got[2]["n_removed"] == 2


def test_lines_that_very_many_texts_share(spark, monkeypatch):
    """The same result whether a frequent line is known to every task or not."""
    line, other = " ".join(words(12, 5)), " ".join(words(9, 6))
    rows = [(k, f"{line}\nown {k} words stand here\n{line if k % 2 else other}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = sorted(map(tuple, lines.line_counts(docs).collect()), key=str)
    monkeypatch.setattr(lines, "HOT_LINES", 0)
    assert known == sorted(map(tuple, lines.line_counts(docs).collect()), key=str)
    assert sum(r[2] for r in known) > 400


def test_pieces_of_texts_without_spaces(spark, monkeypatch):
    """Units longer than a tile are cut where no piece spans the cut; a text of one repeated character has few such places."""
    import sentencepiece

    monkeypatch.setattr(pieces, "TILE", 100)
    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(12)
    texts = ["".join(r.choice("abcdefgh日本語中文,.") for _ in range(n)) for n in (99, 100, 101, 2500)] + ["a" * 1500, "日" * 400 + " end"]
    coded = pieces.Encoder(path).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in coded] == [sp.encode(t) for t in texts]


def test_parts_and_blocks_join_without_a_seam(monkeypatch):
    """Bounded parts give what one part gives: shingles, anchors, word chunks of the network, packed blocks."""
    text = " ".join(words(700, 40))
    whole = np.concatenate(list(simhash.shingle_hashes(text, 3)))
    w = [x.encode() for x in text.split()]
    h = substrings.word_hashes(w)
    anchors = [np.concatenate(c) for c in zip(*[(p, v) for _, p, v in substrings.anchors(h, 35)])]  # noqa: B905
    scores = toxicity.score_texts(TOXICITY, [text, "nastyone " + text, text + " nastyone", "short"])
    monkeypatch.setattr(simhash, "PART", 64)
    monkeypatch.setattr(substrings, "PART", 64)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 50)
    assert (np.concatenate(list(simhash.shingle_hashes(text, 3))) == whole).all()
    parts = [np.concatenate(c) for c in zip(*[(p, v) for _, p, v in substrings.anchors(h, 35)])]  # noqa: B905
    assert all((a == b).all() for a, b in zip(anchors, parts, strict=True))
    assert np.allclose(toxicity.score_texts(TOXICITY, [text, "nastyone " + text, text + " nastyone", "short"]), scores, atol=1e-5)
    r = np.random.default_rng(2)
    ids = [r.integers(2, 50, n).astype(np.int64) for n in (3, 900, 1, 40, 5000)]
    ends = np.zeros(64, bool)
    ends[::7] = True
    for block in (64, 1 << 18):
        pieces_of = list(packing.pack_stream(enumerate(ids), ends, window=64, block=block, stride=16))
        assert all(sum(p[2] for p in pieces_of if p[0] == d) == len(x) for d, x in enumerate(ids))
        offsets = collections.defaultdict(int)
        for _, _, n, _, _, number, offset in pieces_of:
            assert offsets[number] == offset
            offsets[number] += n
        assert max(offsets.values()) <= 64


def test_scores_equal_a_plain_computation():
    """The network's chunked, shared products against one window at a time; the ranking's score against its formula."""
    texts = ["w1 w2 nastyone w3", "", "w5", " ".join(words(60, 3))]
    net = TOXICITY
    widths = [(w, sum(toxicity.WIDTHS[:i]) * toxicity.FILTERS) for i, w in enumerate(toxicity.WIDTHS)]
    for text, score in zip(texts, toxicity.score_texts(net, texts), strict=True):
        tokens = toxicity.words_of(text)
        x = np.array([np.concatenate([net.tables[t][i] for t, i in enumerate(toxicity.word_ids(w))]) for w in tokens] + [np.zeros(toxicity.TABLES * toxicity.DIM)] * toxicity.PAD)
        pooled = []
        for width, at in widths:
            for f in range(toxicity.FILTERS):
                starts = range(len(tokens) + toxicity.PAD)
                pooled.append(max(sum(x[i + j] @ net.filters[:, at + j * toxicity.FILTERS + f] for j in range(width) if i + j < len(x)) for i in starts))
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        votes = [sum(w.decode() in toxicity.FUNCTION_WORDS[lang] for w in tokens) for lang in toxicity.FUNCTION_WORDS]
        lang = int(np.argmax(votes)) if max(votes) else len(votes)
        assert score == pytest.approx(1 / (1 + np.exp(-(z - net.thresholds[lang] + np.log(0.7 / 0.3)))), abs=1e-4)
    for text in texts:
        x = quality.features(text)
        z = float((x - QUALITY.mean) / QUALITY.scale @ QUALITY.weights) - QUALITY.threshold
        assert QUALITY.score(x) == pytest.approx(1 / (1 + np.exp(-z) * 0.3 / 0.7))
