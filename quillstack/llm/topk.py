"""Exact top-k inner products by MaxScore.

Vectors are documents, dimensions terms: a shard keeps for each dimension the postings of all its candidates and
the range of their values. What a dimension can add to a query's score beyond its least value in the shard is
the dimension's bound. With the k-th best score known so far as threshold, the dimensions of the largest bounds
are essential: as many as it takes until the bounds of the others no longer reach the threshold by themselves.
The postings of the essential dimensions are traversed for all candidates; of the others, candidate by candidate,
only those that the remaining bounds can still lift to the threshold are probed. The best of all shards are merged
per query.

The threshold of a query is the k-th best of a bounded sample of candidates. Candidates are dropped only if they are
strictly below, so ties are kept and the result is exact.

Candidates are read once, and each of them is in one shard. Queries, with their thresholds, are a written table in
the shared folder, which tasks read block by block; vectors are never replicated or gathered, and a task gives k
rows for a query and shard at most.

Cases: vectors that are null, or hold a null or a non-finite component (scaling included), take no part; shorter
vectors are filled up with zeros; scores beyond 2^51 are added up in whole numbers, and those beyond a long count as
the nearest long; ties go to the smaller id; rows that repeat are candidates each, and queries of one id are one
query (its least vector); the query's own id is no candidate; null ids take no part; with fewer than k candidates all
are returned; empty tables give no rows. Other columns of the tables are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.common import Staged, located, small_batches, stage, table

K, EVERY, SCALE = 5, 50, 256
#: Candidates of a shard, queries worked on at a time, candidates that give the first thresholds.
SHARD, QUERY_BLOCK, SAMPLE = 1 << 16, 64, 4096
#: Whole numbers up to four times this are exact in floating point, and so are sums of bounds.
EXACT = 2.0**51
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def whole_products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in Python integers, held within the range of a long."""
    numbers = [int(x) for x in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, numbers, strict=True)), LEAST), MOST) for row in c], dtype=object)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest (score, id), ties to the smaller id."""
    if len(scores) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    return sorted(((int(s), int(i)) for s, i in zip(scores, ids, strict=True)), key=lambda x: (-x[0], x[1]))[:k]


class Shard:
    """Candidates by dimension: row d of `postings` has the values of all candidates in dimension d."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.postings = ids, np.ascontiguousarray(vectors.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)
        self.largest = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))

    def search(self, own: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the k best of this shard, or fewer if the others are below its threshold."""
        width = len(self.postings)
        if queries.shape[1] > width:
            queries = queries[:, :width]  # these candidates have zeros there
        elif queries.shape[1] < width:
            queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        with np.errstate(all="ignore"):
            yield from self._search(own, queries, thresholds, k, width)

    def _search(self, own: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int, width: int) -> Iterator[list[tuple[int, int]]]:
        least, bound = np.minimum(queries * self.low, queries * self.high), np.abs(queries) * (self.high - self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        sorted_bounds = np.take_along_axis(bound, order, axis=1)
        left = np.zeros((len(queries), width + 1))  # what the dimensions from here on can add to their least values
        left[:, :width] = np.cumsum(sorted_bounds[:, ::-1], axis=1)[:, ::-1]
        needed = thresholds - least.sum(axis=1)
        essential = np.maximum((left >= needed[:, None]).sum(axis=1), 1).clip(max=width) if width else np.zeros(len(queries), int)
        chosen = np.zeros_like(queries)
        for i, e in enumerate(essential):
            chosen[i, order[i, :e]] = queries[i, order[i, :e]]
        # beyond that, and with infinities on the way, sums are not exact
        safe = np.abs(queries).max(axis=1, initial=0) * self.largest * max(width, 1) < EXACT
        sums = np.where(safe[:, None], chosen, 0) @ self.postings
        for i, q in enumerate(queries):
            if not safe[i]:  # bounds mean nothing
                other = np.flatnonzero(self.ids != own[i])
                yield best(self.ids[other], whole_products(self.postings[:, other].T, q), k)
                continue
            rest = least[i][order[i]][::-1].cumsum()[::-1] if width else np.zeros(0)
            lift = left[i] + np.append(rest, 0)  # the most that the dimensions from here on can give
            e = int(essential[i])
            alive = np.flatnonzero((sums[i] + lift[e] >= thresholds[i]) & (self.ids != own[i]))
            score = sums[i][alive]
            for place in range(e, width):
                d = order[i, place]
                score = score + q[d] * self.postings[d, alive]
                compete = score + lift[place + 1] >= thresholds[i]
                if not compete.all():
                    alive, score = alive[compete], score[compete]
            yield best(self.ids[alive], score, k)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """(vec_id, v) in shards of up to SHARD candidates."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            part = batch.slice(at, SHARD)
            if n and n + part.num_rows > SHARD:
                yield _shard(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]) -> Shard:
    rows = pa.Table.from_batches(held)
    return Shard(rows["vec_id"].to_numpy(), matrix(rows["v"]))


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(SCALE * component), as whole doubles, of all vectors that take part."""
    scaled = lambda x: F.lit(SCALE) * x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(scaled(x)) | (F.abs(scaled(x)) == F.lit(float("inf")))
    floor = lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    whole = vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{embedding}`").isNotNull() & ~F.exists(f"`{embedding}`", bad))
    return whole.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(f"`{embedding}`", floor).alias("v"))


def with_thresholds(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """queries (vec_id, v) with a column threshold: the k-th best score among a bounded sample of candidates,
    or less than any score if that is not known exactly."""
    # of rows that repeat, as of others, a hash decides; a sample of any kind gives right results
    rows = candidates.orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE).toArrow()
    sample = Shard(rows["vec_id"].to_numpy(), matrix(rows["v"])) if rows.num_rows else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows if sample else 0, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                own, q = part.column("vec_id").to_numpy(), matrix(part.column("v"))
                for top in sample.search(own, q, np.full(len(own), -np.inf), k):
                    found.append(float(top[-1][0]) if len(top) == k and abs(top[-1][0]) < EXACT else -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found or [-np.inf] * batch.num_rows, pa.float64())], names=["vec_id", "v", "threshold"])

    return queries.mapInArrow(score, "vec_id bigint, v array<double>, threshold double")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """queries, candidates (vec_id, v) -> query_id, rank, vec_id, score."""
    spark = queries.sparkSession
    small_batches(spark)
    whole = F.col("v").cast("array<double>").alias("v")
    candidates = stage(candidates.select("vec_id", whole))
    held = Staged(with_thresholds(queries.select("vec_id", whole).groupBy("vec_id").agg(F.min("v").alias("v")), candidates, k))
    where = held.path
    n = candidates.count()
    tasks = max(-(-n // SHARD), min(-(-n // (SHARD // 32)), spark.sparkContext.defaultParallelism), 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = located(where)
        for shard in shards(batches):
            blocks = pa.dataset.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1)
            for block in blocks:
                own, thresholds = block.column("vec_id").to_numpy(), block.column("threshold").to_numpy()
                found = list(shard.search(own, matrix(block.column("v")), thresholds, k)) if len(own) else []
                columns = [(int(o), i, s) for o, top in zip(own, found, strict=True) for s, i in top]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*columns, strict=True) if columns else ([], [], []))], names=["query_id", "vec_id", "score"])

    found = candidates.repartition(tasks).mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)
