"""Approximate nearest neighbours by a hash-prefix forest.

Rows lie in cells by the signs of inner products with a few random directions, and in
shards of a bounded number of rows within a cell. Each shard holds a forest: for every
tree the rows' long hash strings (signs of inner products with random directions, most
significant first) as a sorted array. A query descends in every tree to the longest
prefix that it shares with rows, which is a place in the sorted array; then all trees
ascend together, one prefix bit at a time, and everything that shares the shorter prefix
in any tree becomes a candidate, until ``probe`` of the shard's rows are candidates.
Candidates are ranked by their exact inner product in double precision. Shards answer
their best ``k``; the best of all shards are the result.

A query goes to the cells whose prefixes it comes close to: those where the query's
inner products with the directions whose signs differ add up to at most ``reach``. The
reach is fitted on at most ``SAMPLE`` rows, so that the cells of ``REACHED`` of their
nearest neighbours are visited. As neighbours in a sample are farther than in the table,
it errs to the safe side. A query that finds fewer than ``k`` rows in its cells goes to all of them. Each of the
``FITTED`` most frequent dimensions has cells of its own; a rarer one is one cell. Where vectors have structure few cells are visited; directions
without any, as in the test tables, need most cells and a large ``probe``, whatever the
index: see the README for measured recall.

Queries reach a cell in blocks of at most about ``query_block``; a task holds one shard and one
block. Directions are drawn from a seed, so every task has the same.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part; vectors are compared with those of their own dimension; rows repeated with one id
and vector count once, rows of one id with other vectors are rows of their own, as
candidates and as queries; a null id takes no part; with fewer candidates than ``k``
all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TREES = 96
BITS = 32
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
PROBE = 0.35
SAMPLE, SAMPLE_QUERIES, REACHED = 2048, 256, 0.99
FITTED = 4


@lru_cache(maxsize=4)
def directions(dim: int, count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, count)).astype(np.float32)


def hash_strings(x: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """rows x trees hash strings as integers, the first direction in the top bit."""
    out = np.empty((len(x), trees), np.uint32)
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.uint32)
    for lo in range(0, len(x), 1024):
        signs = (x[lo : lo + 1024].astype(np.float32) @ directions(x.shape[1], trees * bits)) >= 0
        out[lo : lo + 1024] = signs.reshape(-1, trees, bits) @ weights
    return out


class Forest:
    """Sorted arrays of hash strings of one shard."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.x, self.trees, self.bits = x, trees, bits
        strings = hash_strings(x, trees, bits)
        self.order = np.argsort(strings, axis=0, kind="stable").T.astype(np.int32)  # trees x rows
        self.sorted = np.take_along_axis(strings, self.order.T, axis=0).T.copy()

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the range of rows that share the query's first ``depth`` bits."""
        shift = (self.bits - depth).astype(np.uint64)[:, None]
        low = strings.astype(np.uint64) >> shift << shift
        high = low + (np.uint64(1) << shift)
        lo, hi = np.empty(strings.shape, np.int64), np.empty(strings.shape, np.int64)
        for t in range(self.trees):
            lo[:, t] = np.searchsorted(self.sorted[t], low[:, t], "left")
            hi[:, t] = np.searchsorted(self.sorted[t], high[:, t], "left")
        return lo, hi

    def candidates(self, strings: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query's strings (queries x trees) the rows met when the trees have ascended far enough."""
        q, n = len(strings), len(self.x)
        # no depth with fewer entries, repeats between trees included, than wanted rows can do: ascend to the deepest other by halving
        low, high = np.zeros(q, np.int64), np.full(q, self.bits)
        while (low < high).any():
            middle = (low + high + 1) // 2
            lo, hi = self.ranges(strings, middle)
            enough = (hi - lo).sum(axis=1) >= min(least, n)
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        lo, hi = self.ranges(strings, low)
        for i in range(q):
            depth, a, b = int(low[i]), lo[i], hi[i]
            while True:
                seen = np.zeros(n, bool)
                for t in range(self.trees):
                    seen[self.order[t, a[t] : b[t]]] = True
                if depth == 0 or np.count_nonzero(seen) >= least:
                    break
                depth -= 1
                wider = self.ranges(strings[i : i + 1], np.array([depth]))
                a, b = wider[0][0], wider[1][0]
            yield np.flatnonzero(seen)

    def search(self, queries: np.ndarray, ids: np.ndarray, marks: np.ndarray, own: np.ndarray, own_marks: np.ndarray, k: int, probe: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, inner products) of the best ``k``, ties to smaller ids; a query's own row is left out."""
        least = max(int(np.ceil(probe * len(self.x))), min(len(self.x), 4 * k))
        for start in range(0, len(queries), 256):
            block = queries[start : start + 256]
            strings = hash_strings(block, self.trees, self.bits)
            for i, found in enumerate(self.candidates(strings, least)):
                found = found[(ids[found] != own[start + i]) | (marks[found] != own_marks[start + i])]
                score = self.x[found] @ block[i]
                best = np.lexsort((ids[found], -score))[:k]
                yield start + i, ids[found[best]], score[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, mark, dim, x array<double>) of the rows that take part; ``mark`` tells rows of one id apart."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    return rows.where(finite).select("vec_id", F.xxhash64("x").alias("mark"), F.size("x").alias("dim"), "x").dropDuplicates(["vec_id", "mark", "x"])


def margins(x: np.ndarray, bits: int) -> np.ndarray:
    """Inner products of the vectors, at length one, with the directions of the cells."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ directions(x.shape[1], bits, 23)


def codes(m: np.ndarray) -> np.ndarray:
    return (m >= 0) @ (1 << np.arange(m.shape[1], dtype=np.int64))


def fitted_reach(x: np.ndarray, bits: int, total: int, k: int) -> float:
    """The reach within which lie the cells of ``REACHED`` of the sample's nearest pairs."""
    asked = x[:SAMPLE_QUERIES]
    if bits == 0 or len(x) < 2:
        return float("inf")
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    nearest = np.argsort(-score, axis=1)[:, : max(1, min(k, len(x) - 1, round(k * len(x) / total)))]
    mine, all_codes = margins(asked, bits), margins(x, bits) >= 0
    differ = all_codes[nearest] != (mine >= 0)[:, None, :]
    return float(np.quantile((differ * np.abs(mine)[:, None, :]).sum(axis=2), REACHED))


def cells_within(m: np.ndarray, reach: float) -> list[int]:
    """The cells of one query: its own and those of other signs whose margins add up to at most ``reach``."""
    order = np.argsort(np.abs(m))
    found = [(int(codes(m[None, :])[0]), 0.0)]
    for b in order.tolist():
        step = abs(float(m[b]))
        if step > reach:
            break
        found += [(code ^ (1 << b), spent + step) for code, spent in found if spent + step <= reach]
    return [code for code, _ in found]


@dataclass(frozen=True)
class Cells:
    """For each dimension with cells the number of their bits and the reach."""

    bits: dict[int, int]
    reach: dict[int, float]

    def of_rows(self, x: np.ndarray) -> list[list[int]]:
        dim = x.shape[1]
        return [[c] for c in codes(margins(x, self.bits[dim])).tolist()] if dim in self.bits else [[0]] * len(x)

    def of_queries(self, x: np.ndarray) -> list[list[int]]:
        dim = x.shape[1]
        return [cells_within(m, self.reach[dim]) for m in margins(x, self.bits[dim])] if dim in self.bits else [[0]] * len(x)


def fitted_cells(rows: DataFrame, k: int, shard_rows: int) -> tuple[Cells, int]:
    """The cells of the most frequent dimensions, fitted on a sample of each, and the number of rows."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits, reach = {}, {}
    for r in counts.where(F.col("n") > shard_rows).orderBy(F.desc("n"), "dim").limit(FITTED).collect():
        sample = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id", "mark").limit(SAMPLE).collect()
        bits[r["dim"]] = int(np.ceil(np.log2(r["n"] / shard_rows)))
        reach[r["dim"]] = fitted_reach(np.array([s["x"] for s in sample]), bits[r["dim"]], r["n"], k)
    return Cells(bits, reach), total


def placed(rows: DataFrame, cells: Cells, asks: bool) -> DataFrame:
    """The rows with their ``cell``; queries once for each cell within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            found: list[list[int]] = [[]] * len(dims)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = batch.column("x").take(pa.array(own)).flatten().to_numpy().reshape(-1, int(dim))
                for i, c in zip(own.tolist(), cells.of_queries(x) if asks else cells.of_rows(x), strict=True):
                    found[i] = c
            again = batch.take(pa.array(np.repeat(np.arange(len(dims)), [len(c) for c in found])))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array([c for cs in found for c in cs], pa.int64())], names=["vec_id", "mark", "dim", "x", "cell"])

    return rows.select("vec_id", "mark", "dim", "x").mapInArrow(run, "vec_id long, mark long, dim int, x array<double>, cell long")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probe: float = PROBE, trees: int = TREES, bits: int = BITS, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows found for each row where ``is_query`` (a condition on ``vec_id``) holds.

    One row (query_id, rank, vec_id, score) per query and neighbour.
    """
    rows = checkpointed(usable(vectors, id_col, vector_col))
    cells, total = fitted_cells(rows, k, shard_rows)
    held, queries = placed(rows, cells, False), rows.where(is_query)
    best = lambda asked: searched(held, asked, k, probe, trees, bits, shard_rows, query_block)
    found = best(placed(queries, cells, True))
    if cells.bits:  # a query may have met fewer rows than there are
        found = checkpointed(found)
        enough = found.where(F.col("rank") == min(k, max(total - 1, 0))).select("query_id", "mark")
        short = checkpointed(queries.join(enough.withColumnRenamed("query_id", "vec_id"), ["vec_id", "mark"], "left_anti").where(F.col("dim").isin(*cells.bits)))
        if not short.isEmpty():
            everywhere = best(placed(short, Cells(cells.bits, dict.fromkeys(cells.bits, float("inf"))), True))
            found = found.join(short.select(F.col("vec_id").alias("query_id"), "mark"), ["query_id", "mark"], "left_anti").unionByName(everywhere)
    return found.select("query_id", "rank", "vec_id", "score")


def searched(held: DataFrame, asked: DataFrame, k: int, probe: float, trees: int, bits: int, shard_rows: int, query_block: int) -> DataFrame:
    """(query_id, mark, rank, vec_id, score): the best of all shards of the cells where a query asks."""
    by = ["dim", "cell"]
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    shards = held.groupBy(*by).agg(F.count("*").alias("n")).select(*by, parts("n", shard_rows).alias("shards"))
    blocks = asked.groupBy(*by).agg(F.count("*").alias("n")).select(*by, parts("n", query_block).alias("blocks"))
    plan = checkpointed(shards.join(blocks, by))
    slot = lambda n: F.pmod(F.xxhash64("vec_id", "mark"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = (*by, "shard", "block", "asks", "vec_id", "mark", "x")
    held = held.join(plan, by).withColumn("shard", slot("shards")).withColumn("block", each("blocks")).withColumn("asks", F.lit(False)).select(*columns)
    asked = asked.join(plan, by).withColumn("block", slot("blocks")).withColumn("shard", each("shards")).withColumn("asks", F.lit(True)).select(*columns)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "mark"])
        ask, hold = group[group["asks"]], group[~group["asks"]]
        out: dict[str, list] = {"query_id": [], "mark": [], "vec_id": [], "score": []}
        if len(ask) and len(hold):
            ids, marks, own, own_marks = (side[c].to_numpy() for side in (hold, ask) for c in ("vec_id", "mark"))
            forest = Forest(np.stack(hold["x"].to_numpy()), trees, bits)
            for i, found, score in forest.search(np.stack(ask["x"].to_numpy()), ids, marks, own, own_marks, k, probe):
                out["query_id"].append(np.full(len(found), own[i]))
                out["mark"].append(np.full(len(found), own_marks[i]))
                out["vec_id"].append(found)
                out["score"].append(score)
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, "float64" if n == "score" else "int64") for n, v in out.items()})

    answers = held.unionByName(asked).groupBy(*by, "shard", "block").applyInPandas(answer, "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "mark", "rank", "vec_id", "score")
