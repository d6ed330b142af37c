"""Nearest neighbours by inner product with an inverted multi-index.

Both halves of the vectors have a codebook of their own (k-means on a bounded sample, more centroids for larger tables);
a vector's cell is the pair of its nearest centroids. A query visits cells by the sum of both halves' distances (negative
inner products with the centroids), taken from a heap, and the entries of visited cells are reranked by inner products
in double precision. How far it goes is measured, not set: on the sample, the share of entries that must be visited to
hold ``recall`` of the true neighbours; evenly spread vectors need most of the table, clustered ones little.

The index is dealt by cells: neighbouring cells share a part, and a cell too large for one is split over several. Each
part is shuffled once, and a query goes only to the parts that hold cells it visits; within a part, queries stream past
its entries, so memory depends on neither the number of queries nor that of vectors.

Vectors that are null, zero or hold null or non-finite components take no part. Inner products are defined between
vectors of one length only, so each length has an index and candidates of its own. Ties go to the smaller vec_id; scores
are exactly rounded sums. With k candidates or fewer all are returned. Repeated vec_ids are entries of their own, but a
query's own id is no candidate; queries that share an id have lists of their own, and equal ones share theirs. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, materialize

#: Centroids of a codebook: CENTROIDS times the fourth root of the number of vectors, within these bounds.
CENTROIDS, LEAST, MOST = 3.0, 16, 256
SAMPLE_ROWS = 20_000
#: Vectors of the sample that serve as queries when the share to visit is measured.
TRIALS = 512
#: Share of the true neighbours that the cells visited are to hold, on the sample.
RECALL = 0.95
#: Entries of a part, about.
PART = 16_384

RESULT = "query_id long, rank int, vec_id long, score double"


def usable(table: DataFrame) -> DataFrame:
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return columns(table, "vec_id", "embedding").where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select("vec_id", v.cast("array<double>").alias("embedding"))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centers.T - (centers**2).sum(1) / 2).argmax(1)
        for j in range(k):
            if (near == j).any():
                centers[j] = x[near == j].mean(0)
    return centers


class MultiIndex:
    """Codebooks of both halves; cells are numbered first * len(second) + second."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.half, self.first, self.second = half, kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)

    @property
    def size(self) -> int:
        return len(self.first) * len(self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        pick = lambda part, c: (part @ c.T - (c**2).sum(1) / 2).argmax(1)
        return pick(x[:, : self.half], self.first) * len(self.second) + pick(x[:, self.half :], self.second)

    def visits(self, q: np.ndarray, counts: list[int], wanted: int) -> list[int]:
        """Cells in the order of summed distance until they hold ``wanted`` entries."""
        a, b = -(self.first @ q[: self.half]), -(self.second @ q[self.half :])
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i].tolist(), b[j].tolist()
        i, j = i.tolist(), j.tolist()
        heap, out, held, wide = [(a[0] + b[0], 0, 0)], [], 0, len(b)
        while heap and held < wanted:
            _, x, y = heapq.heappop(heap)
            cell = i[x] * wide + j[y]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            if y + 1 < wide:
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if y == 0 and x + 1 < len(a):
                heapq.heappush(heap, (a[x + 1] + b[0], x + 1, 0))
        return out

    def share(self, ids: np.ndarray, x: np.ndarray, total: int, k: int, recall: float) -> float:
        """The share of entries to visit, so that this part of the sample's true neighbours is among them.

        In a sample of ``total`` vectors, as many of a query's nearest count as would be left of its k."""
        near = min(max(1, round(k * len(x) / max(1, total))), len(x) - 1)
        if near < 1:
            return 1.0
        cell = self.cells(x)
        counts = np.bincount(cell, minlength=self.size)
        needs = []
        for q, own in zip(x[:TRIALS], ids[:TRIALS], strict=True):
            scores = np.where(ids == own, -np.inf, x @ q)
            far = -(self.first @ q[: self.half])[:, None] - (self.second @ q[self.half :])[None, :]
            order = np.argsort(far.ravel(), kind="stable")
            upto = np.empty(self.size, np.int64)
            upto[order] = np.cumsum(counts[order])
            needs.append(upto[cell[np.argpartition(-scores, near - 1)[:near]]])
        return float(np.quantile(np.concatenate(needs), recall, method="higher")) / len(x)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy().reshape(len(col), -1)


class Part:
    """The entries of one part by cell, and exact answers from them."""

    def __init__(self, table: pa.Table):
        cell, x = table["cell"].to_numpy(), _matrix(table["embedding"])
        order = np.argsort(cell, kind="stable")
        self.ids, self.x = table["vec_id"].to_numpy()[order], x[order]
        self.cells, first = np.unique(cell[order], return_index=True)
        self.edges = np.append(first, len(order)).tolist()
        self.at = {c: k for k, c in enumerate(self.cells.tolist())}
        _, self.same = np.unique(self.x, axis=0, return_inverse=True)
        self.same = self.same.ravel()
        self.longest = float(np.sqrt((self.x**2).sum(1).max())) if len(order) else 0.0

    def answer(self, ids: np.ndarray, x: np.ndarray, cells: list[list[int]], k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """Of each query (its number) the best k entries of the visited cells: exact score and vec_id."""
        scores = np.full((len(ids), len(self.ids)), -np.inf)
        visitors: dict[int, list[int]] = {}
        for r, mine in enumerate(cells):
            for c in mine:
                visitors.setdefault(c, []).append(r)
        for c, who in visitors.items():
            a, b = self.edges[self.at[c]], self.edges[self.at[c] + 1]
            scores[who, a:b] = x[who] @ self.x[a:b].T
        for r, row in enumerate(scores):
            row[self.ids == ids[r]] = -np.inf
            top = min(k, len(row))
            least = np.partition(row, len(row) - top)[len(row) - top]
            # what rounding may have put behind the last is settled by exact sums
            margin = 4 * x.shape[1] * np.finfo(float).eps * float(np.sqrt((x[r] ** 2).sum())) * self.longest
            close = np.flatnonzero((row >= least - margin) & (row > -np.inf))
            exact: dict[int, float] = {}
            for p in close:
                if self.same[p] not in exact:
                    exact[self.same[p]] = math.fsum((self.x[p] * x[r]).tolist())
            found = sorted((-exact[self.same[p]], int(self.ids[p])) for p in close)
            yield r, [(-s, name) for s, name in found[:k]]


def nearest(table: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the rows of (vec_id, embedding) for which is_query holds."""
    good = usable(table)
    lengths = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row a length of vectors
    if not lengths:
        return table.sparkSession.createDataFrame([], RESULT)
    each = [_nearest(good.where(F.size("embedding") == d), n, is_query, k, recall, sample_rows) for d, n in lengths]
    return reduce(DataFrame.unionByName, each)


def _nearest(good: DataFrame, total: int, is_query: Column, k: int, recall: float, sample_rows: int) -> DataFrame:
    spark = good.sparkSession
    h = F.xxhash64("vec_id", "embedding")
    few = F.shiftrightunsigned(h, 32) < min(1 << 32, max(1, (1 << 32) * 4 * sample_rows // total))  # what goes to the driver doesn't grow
    sample = good.where(few).orderBy(h, "vec_id").limit(sample_rows).toArrow()
    if not len(sample):
        sample = good.limit(sample_rows).toArrow()
    ids, x = sample["vec_id"].to_numpy(zero_copy_only=False), _matrix(sample["embedding"])
    index = MultiIndex(x, min(MOST, max(LEAST, math.ceil(CENTROIDS * total**0.25))))
    wanted = max(k + 1, math.ceil(index.share(ids, x, total, k, recall) * total))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(_matrix(batch.column("embedding"))).astype(np.int32))], names=["vec_id", "embedding", "cell"])

    entries = materialize(good.mapInArrow(assign, "vec_id long, embedding array<double>, cell int"), "entries")
    counts = [0] * index.size
    for cell, n in entries.groupBy("cell").count().collect():  # at most a row a cell, of which there are MOST ** 2
        counts[cell] = n
    # neighbouring cells fill a part; a cell too large for one has several of its own
    first, wide, part, held = [], [], 0, 0
    for n in counts:
        if held and held + n > PART:
            part, held = part + 1, 0
        first.append(part)
        wide.append(max(1, -(-n // PART)))
        held += n
        if n > PART:
            part, held = part + wide[-1], 0
    parts = part + 1
    places = spark.createDataFrame([(c, first[c], wide[c]) for c in range(index.size) if counts[c]], "cell int, first int, wide int")
    dealt = (F.col("first") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("wide"))).cast("int")
    mine = entries.join(F.broadcast(places), "cell").select(dealt.alias("part"), F.lit(0).alias("kind"), "vec_id", "embedding", "cell", F.lit(None).cast("array<int>").alias("cells"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every part that holds cells it visits, with these cells."""
        for batch in batches:
            rows: list[tuple[int, int, list[int]]] = []
            for r, q in enumerate(_matrix(batch.column("embedding")) if batch.num_rows else []):
                to: dict[int, list[int]] = {}
                for c in index.visits(q, counts, wanted):
                    for p in range(first[c], first[c] + wide[c]):
                        to.setdefault(p, []).append(c)
                rows += [(p, r, cells) for p, cells in to.items()]
            for z in range(0, len(rows), 4096):
                some = rows[z : z + 4096]
                own = batch.take(pa.array([r for _, r, _ in some], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in some], pa.int32()), pa.array([1] * len(some), pa.int32()), own.column("vec_id"), own.column("embedding"), pa.nulls(len(some), pa.int32()), pa.array([c for _, _, c in some], pa.list_(pa.int32()))],
                    names=["part", "kind", "vec_id", "embedding", "cell", "cells"],
                )

    schema = "part int, kind int, vec_id long, embedding array<double>, cell int, cells array<int>"
    asked = entries.where(is_query).select("vec_id", "embedding").dropDuplicates().mapInArrow(route, schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, entries_of, part = -1, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            p, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cut = (np.flatnonzero((p[1:] != p[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
            for s, e in zip([0, *cut], [*cut, len(p)], strict=True):
                if p[s] != number:
                    number, entries_of, part = p[s], [], None
                if not kind[s]:
                    entries_of.append(batch.slice(s, e - s))
                    continue
                if part is None:
                    part, entries_of = Part(pa.Table.from_batches(entries_of)), []
                for z in range(s, e, 64):
                    some = batch.slice(z, min(64, e - z))
                    ids, x = some.column("vec_id").to_numpy(), _matrix(some.column("embedding"))
                    out = [(r, name, score) for r, best in part.answer(ids, x, some.column("cells").to_pylist(), k) for score, name in best]
                    own = some.take(pa.array([o[0] for o in out], pa.int64()))
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("embedding"), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "asked", "vec_id", "score"])

    both = mine.unionByName(asked).repartition(min(parts, 4096), "part").sortWithinPartitions("part", "kind")
    found = both.mapInArrow(search, "query_id long, asked array<double>, vec_id long, score double")
    found = found.select("query_id", F.xxhash64("asked").alias("asked"), "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
