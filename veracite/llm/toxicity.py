"""Toxicity scores from a small convolutional text classifier trained in numpy.

Words (lower-cased, split at white space and ASCII punctuation) are embedded by
hashing: one table is indexed by the whole word, others by its first four and
five characters, so inflected forms share evidence. Filters of widths 1, 2 and 3
slide over the whole text, each is max-pooled and a logistic layer combines the
pooled values. Thresholds are calibrated by language; the language is guessed
from function words in the text itself. The score column is shifted so that the
threshold of the guessed language lies at 0.7.

Cases: null, empty and wordless texts get the pooled values of padding, hence a
low score; repeated rows get equal scores; an empty table gives an empty result;
without labels of both kinds every score is 0.0. Extra input columns are
ignored. At most ``per_class`` labelled rows of each kind, of texts of at most
``max_chars`` characters, are used for fitting; every row is scored whole.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, checkpointed, map_texts, sliced, training_rows

PER_CLASS = 5000
MAX_CHARS = 20_000
BUCKETS = 1 << 16
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
TABLES = 3
CHUNK_WORDS = 1 << 16

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is it that was for on with as be at by this are from or an not have".split(),
    "de": "der die und das den von zu mit ist im nicht ein eine auf für dem des sich auch als wie".split(),
    "fr": "le la les et des du un une est dans que qui pour pas sur au avec ce il elle par".split(),
    "es": "el los las y en que del un una es por con no para su al lo como más se".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
VOTES = {
    w.encode(): [i for i, lang in enumerate(FUNCTION_WORDS) if w in FUNCTION_WORDS[lang]]
    for words in FUNCTION_WORDS.values()
    for w in words
}
SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(SEPARATORS).split()


def word_ids(word: bytes) -> tuple[int, int, int]:
    text = word.decode("utf-8", "replace")
    return tuple(
        zlib.crc32(part.encode(), salt) % (BUCKETS - 1) + 1  # row 0 is padding
        for salt, part in ((1, text), (2, text[:4]), (3, text[:5]))
    )


def index_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(position of each word in the list of distinct words, words per document, distinct words)."""
    seen: dict[bytes, int] = {}
    flat = [seen.setdefault(w, len(seen)) for d in docs for w in d]
    return np.array(flat, np.int64), np.array([len(d) for d in docs], np.int64), list(seen)


@dataclass
class Network:
    tables: np.ndarray  # TABLES x BUCKETS x DIM
    filters: np.ndarray  # (TABLES * DIM) x (sum of WIDTHS * FILTERS)
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def project(self, ids: np.ndarray) -> np.ndarray:
        """All filter columns' products with each word: n x (sum of WIDTHS * FILTERS).

        Summed in double precision, so that a word's values do not depend on the words it comes with.
        """
        return np.concatenate([self.tables[t][ids[:, t]] for t in range(TABLES)], axis=1).astype(np.float64) @ self.filters.astype(np.float64)


def _convolve(z: np.ndarray) -> np.ndarray:
    """Filter values at each start position; the last positions of narrow input see padding."""
    n, at, out = len(z), 0, []
    for width in WIDTHS:
        acc = z[:, at : at + FILTERS].copy()
        for j in range(1, width):
            cols = slice(at + j * FILTERS, at + (j + 1) * FILTERS)
            acc[: n - j] += z[j:, cols]
        at += width * FILTERS
        out.append(acc)
    return np.concatenate(out, axis=1)


PAD = max(WIDTHS)  # padding words between documents, so that no filter spans two


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each padded document and the places of the words in the padded stream."""
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)])
    places = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return starts, places


def pooled(net: Network, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(max-pooled filter values per document, language index per document), in bounded memory."""
    best = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    votes = np.zeros((len(docs), len(FUNCTION_WORDS)))
    group: list[tuple[int, list[bytes], bool]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        flat, lengths, distinct = index_words([d for _, d, _ in group])
        z_distinct = np.zeros((len(distinct) + 1, net.filters.shape[1]), np.float32)
        vote_distinct = np.zeros((len(distinct), len(FUNCTION_WORDS)), np.float32)
        if distinct:
            z_distinct[1:] = net.project(np.array([word_ids(w) for w in distinct]))
            for i, w in enumerate(distinct):
                for lang in VOTES.get(w, ()):
                    vote_distinct[i, lang] += 1
        starts, places = _layout(lengths)
        stream = np.zeros(starts[-1], np.int64)
        stream[places] = flat + 1
        values = _convolve(z_distinct[stream])
        counted = np.ones(len(flat), bool)
        for row, (_, part, last) in enumerate(group):
            # filters start at the words and once in the padding; what starts in the overlap belongs to the next chunk
            values[starts[row] + (len(part) + 1 if last else CHUNK_WORDS) : starts[row + 1]] = -np.inf
            if not last:
                ahead = lengths[: row + 1].sum()
                counted[ahead - lengths[row] + CHUNK_WORDS : ahead] = False
        top = np.maximum.reduceat(values, starts[:-1], axis=0)
        for row, (doc, _, _) in enumerate(group):
            np.maximum(best[doc], top[row], out=best[doc])
        owner = np.repeat([doc for doc, _, _ in group], lengths)[counted]
        for lang in range(len(FUNCTION_WORDS)):
            if len(flat):
                votes[:, lang] += np.bincount(owner, weights=vote_distinct[flat[counted], lang], minlength=len(docs))
        group, size = [], 0

    for doc, words in enumerate(docs):
        for lo in range(0, max(len(words), 1), CHUNK_WORDS):  # chunks overlap by the widest filter
            part = words[lo : lo + CHUNK_WORDS + PAD - 1]
            group.append((doc, part, lo + CHUNK_WORDS >= len(words)))
            size += len(part)
            if size >= CHUNK_WORDS:
                flush()
    flush()
    lang = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS))
    return np.maximum(best + net.bias, 0), lang


def logits(net: Network, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if not docs:
        return np.zeros(0), np.zeros(0, int)
    p, lang = pooled(net, docs)
    return (p * net.out).sum(axis=1) + net.out_bias, lang


def _initial(docs: list[list[bytes]], y: np.ndarray, rng: np.random.Generator) -> Network:
    """The first coordinate of each embedding starts as its bucket's smoothed log-odds."""
    tables = rng.normal(0, 0.05, (TABLES, BUCKETS, DIM)).astype(np.float32)
    counts = np.zeros((2, TABLES, BUCKETS))
    for d, label in zip(docs, y, strict=True):
        ids = np.array([word_ids(w) for w in set(d)]).reshape(-1, TABLES)
        for t in range(TABLES):
            counts[label, t, np.unique(ids[:, t])] += 1
    size = np.maximum(np.bincount(y, minlength=2), 1)[:, None, None]
    odds = np.log((counts[1] + 0.3) / (size[1] + 1)) - np.log((counts[0] + 0.3) / (size[0] + 1))
    odds *= np.minimum(1.0, counts.sum(0) / 5)
    tables[:, :, 0] += np.clip(odds, -4, 4)
    tables[:, 0] = 0
    columns = sum(WIDTHS) * FILTERS
    filters = rng.normal(0, 0.15, (TABLES * DIM, columns)).astype(np.float32)
    filters[[t * DIM for t in range(TABLES)]] += np.abs(rng.normal(0.2, 0.15, (TABLES, columns))).astype(np.float32)
    k = len(WIDTHS) * FILTERS
    return Network(tables, filters, np.full(k, -0.5, np.float32), np.abs(rng.normal(0.2, 0.1, k)).astype(np.float32), -2.0)


def train(texts: list[str], labels: np.ndarray, seed: int = 5, batch: int = 64) -> Network | None:
    """Adagrad on the logistic loss, gradients flow through the max-pooled windows."""
    y = np.asarray(labels, int)
    if len(y) == 0 or y.min() == y.max():
        return None
    docs = [words_of(t) for t in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    held = order[: len(order) // 5]  # for the thresholds alone
    train_rows = order[len(order) // 5 :] if len(order) >= 20 else order
    held = held if len(order) >= 20 else order
    net = _initial([docs[i] for i in train_rows], y[train_rows], rng)
    held_docs = [docs[i] for i in held]
    flat, lengths, distinct = index_words(docs)
    del docs
    of_word = np.array([word_ids(w) for w in distinct], np.int32).reshape(-1, TABLES)
    del distinct
    places = np.split(flat.astype(np.int32), np.cumsum(lengths)[:-1])
    ids = [of_word[p] for p in places]
    del flat, places
    g_tables = np.full((TABLES, BUCKETS), 1e-2, np.float32)
    g_filters, g_bias, g_out, g_ob = np.full_like(net.filters, 1e-2), np.full_like(net.bias, 1e-2), np.full_like(net.out, 1e-2), 1e-2
    widths = np.repeat(WIDTHS, FILTERS)
    base = np.repeat(np.cumsum([0, *WIDTHS[:-1]]) * FILTERS, FILTERS) + np.tile(np.arange(FILTERS), len(WIDTHS))
    rate = 0.05
    for _ in range(EPOCHS):
        rng.shuffle(train_rows)
        for lo in range(0, len(train_rows), batch):
            rows = train_rows[lo : lo + batch]
            lengths = np.array([len(ids[i]) for i in rows])
            starts, places = _layout(lengths)
            stream = np.zeros((starts[-1], TABLES), np.int64)
            if len(places):
                stream[places] = np.concatenate([ids[i] for i in rows])
            x = np.concatenate([net.tables[t][stream[:, t]] for t in range(TABLES)], axis=1)
            values = _convolve(x @ net.filters)
            where = np.stack([values[a : a + n + 1].argmax(axis=0) + a for a, n in zip(starts[:-1], lengths, strict=True)])
            raw = np.take_along_axis(values, where, axis=0) + net.bias
            p = np.maximum(raw, 0)
            err = (1 / (1 + np.exp(-np.clip(p @ net.out + net.out_bias, -30, 30))) - y[rows]) / len(rows)
            d_raw = (err[:, None] * net.out) * (raw > 0)
            d_out, d_ob = p.T @ err, err.sum()
            d_filters = np.zeros_like(net.filters)
            for k in range(len(widths)):
                live = np.flatnonzero(d_raw[:, k])
                if not len(live):
                    continue
                for j in range(widths[k]):
                    col, at = base[k] + j * FILTERS, where[live, k] + j
                    ok = at < len(stream)
                    at, g = at[ok], d_raw[live[ok], k]
                    d_filters[:, col] += x[at].T @ g
                    for t in range(TABLES):
                        grad = g[:, None] * net.filters[t * DIM : (t + 1) * DIM, col]
                        rows_t = stream[at, t]
                        np.add.at(g_tables[t], rows_t, (grad**2).mean(axis=1))
                        np.add.at(net.tables[t], rows_t, -0.5 * rate * grad / np.sqrt(g_tables[t][rows_t])[:, None])
            net.tables[:, 0] = 0
            for value, grad, g in ((net.filters, d_filters, g_filters), (net.bias, d_raw.sum(axis=0), g_bias), (net.out, d_out, g_out)):
                g += grad**2
                value -= rate * grad / np.sqrt(g)
            g_ob += d_ob**2
            net.out_bias -= rate * d_ob / np.sqrt(g_ob)
    net.thresholds = _thresholds(net, held_docs, y[held])
    return net


def _thresholds(net: Network, docs: list[list[bytes]], y: np.ndarray, least: int = 40) -> np.ndarray:
    """Per language, the middle of the cuts with most right decisions; the common cut where rows are few."""
    z, lang = logits(net, docs)

    def cut(z: np.ndarray, y: np.ndarray) -> float:
        s = np.unique(z)
        mids = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
        pos, neg = np.sort(z[y == 1]), np.sort(z[y == 0])
        right = (len(pos) - np.searchsorted(pos, mids)) / max(len(pos), 1) + 4 * np.searchsorted(neg, mids) / max(len(neg), 1)
        best = np.flatnonzero(right >= right.max() - 1e-12)
        return float((mids[best[0]] + mids[best[-1]]) / 2)

    common = cut(z, y)
    out = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        own = lang == k
        if own.sum() >= least and 0 < y[own].sum() < own.sum():
            out[k] = cut(z[own], y[own])
    return out


def fit(documents: DataFrame, labels: DataFrame, held_out, label_col: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Network | None:
    """Train on a bounded labelled sample; ``held_out`` is a column expression on ``labels``."""
    rows = checkpointed(training_rows(documents, labels, label_col, held_out, per_class, max_chars).select("_id", "_label", "_text"))

    def run(batches):
        got = pd.concat(list(batches))
        got = got[got["_text"].notna()].sort_values(["_id", "_text"])
        yield pd.DataFrame({"net": [pickle.dumps(train(got["_text"].tolist(), got["_label"].to_numpy()))]})

    # the sample is bounded, so one task holds it; the driver gets the weights alone
    trained = rows.coalesce(1).mapInPandas(run, "net binary").collect() if not rows.isEmpty() else []
    return pickle.loads(bytes(trained[0]["net"])) if trained else None


def score(documents: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row (id, score, predicted) per input row, over whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        for ids, texts in batches:
            s = score_texts(shared.value, texts)
            yield {id_col: ids, "score": s.tolist(), "predicted": (s >= 0.7).astype(int).tolist()}

    return map_texts(documents, id_col, text_col, run, f"{id_col} {id_type}, score double, predicted int")


def keep_clean(documents: DataFrame, net: Network | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns, in one pass and without a shuffle."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(score_texts(shared.value, texts) < threshold))

    return documents.mapInArrow(run, documents.schema)


def score_texts(net: Network | None, texts: list[str]) -> np.ndarray:
    if net is None:
        return np.zeros(len(texts))
    out = np.zeros(len(texts))
    for lo in range(0, len(texts), 64):
        z, lang = logits(net, [words_of(t) for t in texts[lo : lo + 64]])
        out[lo : lo + 64] = 1 / (1 + np.exp(-np.clip(z - net.thresholds[lang] + np.log(0.7 / 0.3), -50, 50)))
    return out
