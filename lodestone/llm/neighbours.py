"""Nearest neighbours by cosine: anisotropic product quantisation, four-bit table scans, exact reranking.

A unit vector is cut into subspaces of two dimensions, and each part stands for one of 16 codewords, four
bits. What counts for a largest inner product is that scores of near vectors are right, so the residual
parallel to a vector costs more than what is orthogonal to it, by a weight that follows from the
score from which on errors matter. Codes are chosen by coordinate descent on that loss, and codewords
are its least-squares solutions. Blocks of the index meet blocks of the queries: each query's table
of 16 products a subspace is summed over the codes of all vectors of the block, and the best of
that scan are scored exactly on the vectors themselves. Each block has its own candidates, so
what is found doesn't get worse as the number of blocks grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, written

#: Queries are the rows whose vec_id this divides; how many neighbours each gets.
DIVISOR, NEAREST = 50, 5
#: Dimensions of a subspace, and its codewords: four bits.
WIDTH, CODES = 2, 16
#: Distinct vectors that codewords are fitted on at most, and numbers in them; every vector is indexed.
SAMPLE, SAMPLE_NUMBERS = 8192, 1 << 22
#: The cosine from which on scores must be right, and rounds of the fit: plain ones, then weighted ones.
THRESHOLD, PLAIN, WEIGHTED, SWEEPS = 0.2, 6, 6, 2
#: Distinct vectors of a block of the index, queries of a block, queries scanned at once, and candidates a query and block.
BLOCK, QUERIES, AT_ONCE, RERANK = 4096, 4096, 64, 192


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v holds doubles, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))])
            x = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # nulls are NaN, -0.0 is 0.0
            bad, some = (np.concatenate([[0], np.cumsum(y)]) for y in (~np.isfinite(x), x != 0))
            good = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            v = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends * 8), pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), v], ["vec_id", "v"]).filter(pa.array(good))

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null").mapInArrow(run, "vec_id long, v binary")


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors as rows of ``size`` numbers, shorter ones with zeros behind."""
    values = column.to_pylist()
    if all(len(x) == 8 * size for x in values):
        return np.frombuffer(b"".join(values), "<f8").reshape(-1, size)
    return np.frombuffer(b"".join(x.ljust(8 * size, b"\0") for x in values), "<f8").reshape(-1, size)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component where squares could leave the range of doubles."""
    top = np.abs(x).max(axis=1, initial=0, keepdims=True)
    return np.where((top > 1e70) | (top < 1e-70), x / np.where(top > 0, top, 1), x)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantiser:
    """Codewords of each subspace, and how a residual along a vector is weighed against one across."""

    def __init__(self, x: np.ndarray, threshold: float = THRESHOLD, seed: int = 7) -> None:
        """Fit on unit rows; their number of dimensions is a multiple of WIDTH."""
        n, d = x.shape
        self.parts = d // WIDTH
        self.weight = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        parts = x.reshape(n, self.parts, WIDTH)
        self.words = np.stack([parts[rng.choice(n, CODES, replace=n < CODES), m] for m in range(self.parts)])
        for k in range(PLAIN + WEIGHTED):
            codes = self.codes(x, SWEEPS if k >= PLAIN else 0)
            self.update(parts, codes, self.weight if k >= PLAIN else 1.0)

    def along(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What each part's residual has along its own vector."""
        chosen = self.words[np.arange(self.parts), codes]
        return ((parts - chosen) * parts).sum(axis=2)

    def codes(self, x: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """Nearest codewords, then each part's best given the others, a few times over."""
        parts = x.reshape(len(x), self.parts, WIDTH)
        cost = np.empty((self.parts, len(x), CODES))
        along = np.empty((self.parts, len(x), CODES))
        for m in range(self.parts):
            left = parts[:, m, None, :] - self.words[m]
            cost[m], along[m] = (left * left).sum(axis=2), (left * parts[:, m, None, :]).sum(axis=2)
        codes = cost.argmin(axis=2).T.copy()
        rows = np.arange(len(x))
        total = along[np.arange(self.parts)[:, None], rows, codes.T].sum(axis=0)
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = total - along[m, rows, codes[:, m]]
                codes[:, m] = (cost[m] + (self.weight - 1) * (rest[:, None] + along[m]) ** 2).argmin(axis=1)
                total = rest + along[m, rows, codes[:, m]]
        return codes.astype(np.uint8)

    def update(self, parts: np.ndarray, codes: np.ndarray, weight: float) -> None:
        """The codewords with the least loss for these codes, one subspace after another."""
        along = self.along(parts, codes)
        total = along.sum(axis=1)
        for m in range(self.parts):
            y = parts[:, m]
            target = total - along[:, m] + (y * y).sum(axis=1)
            for c in range(CODES):
                at = codes[:, m] == c
                if at.any():
                    left = at.sum() * np.eye(WIDTH) + (weight - 1) * y[at].T @ y[at]
                    self.words[m, c] = np.linalg.solve(left, y[at].sum(axis=0) + (weight - 1) * y[at].T @ target[at])
            total -= along[:, m]
            along[:, m] = ((y - self.words[m, codes[:, m]]) * y).sum(axis=1)
            total += along[:, m]

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes in a byte."""
        codes = np.concatenate([self.codes(x[i : i + 1024]) for i in range(0, len(x), 1024)]) if len(x) else np.zeros((0, self.parts), np.uint8)
        if self.parts % 2:
            codes = np.concatenate([codes, np.zeros((len(x), 1), np.uint8)], axis=1)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """By query and byte of a code: the products of all 256 pairs of codewords, from the tables of 16."""
        t = np.einsum("qmw,mcw->qmc", q.reshape(len(q), self.parts, WIDTH), self.words)
        if self.parts % 2:
            t = np.concatenate([t, np.zeros((len(q), 1, CODES))], axis=1)
        both = t[:, 1::2, :, None] + t[:, 0::2, None, :]
        return both.reshape(len(q), -1, CODES * CODES).astype(np.float32)


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Sums of the tables over the codes: queries by vectors."""
    out = np.zeros((len(tables), len(packed)), np.float32)
    for j in range(packed.shape[1]):
        out += np.take(tables[:, j], packed[:, j], axis=1)
    return out


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of q with its own rows of x; every pair's sums have one order, so equal pairs get equal scores."""
    dot = (q[:, None, :] * x).sum(axis=2)
    return np.clip(dot / np.sqrt((q * q).sum(axis=1)[:, None] * (x * x).sum(axis=2)), -1.0, 1.0)


def nearest(rows: pa.Table, queries: pa.Table, model: Quantiser, size: int, nearest: int, rerank: int) -> pa.Table:
    """The best rows of a block for each query of a block: q, vec_id, score."""
    x, far = scaled(matrix(rows["v"], size)), np.iinfo(np.int64).max
    packed = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
    ids = np.full((len(x), nearest + 1), far)
    for k, found in enumerate(rows["ids"].to_pylist()):
        ids[k, : len(found)] = found
    all_q, q_ids, names = scaled(matrix(queries["v"], size)), queries["query_id"].to_numpy(), queries["q"].to_numpy()
    out = []
    for at in range(0, len(all_q), AT_ONCE):
        q, own_id = all_q[at : at + AT_ONCE], q_ids[at : at + AT_ONCE]
        found = scan(model.tables(unit(q)), packed)
        best = np.argpartition(-found, rerank, axis=1)[:, :rerank] if len(x) > rerank else np.tile(np.arange(len(x)), (len(q), 1))
        score = cosines(q, x[best])
        # of distinct vectors one more than is asked for, as the query's own may have no other row
        top = np.lexsort((ids[best, 0], -score), axis=1)[:, : nearest + 1]
        best, score = (np.take_along_axis(y, top, axis=1) for y in (best, score))
        members = ids[best]
        own = (x[best] == q[:, None, :]).all(axis=2)[:, :, None] & (members == own_id[:, None, None])
        own &= np.cumsum(own, axis=2) == 1  # one row of the same id and vector is the query's
        members = np.where(own, far, members).reshape(len(q), -1)
        score = np.repeat(score, nearest + 1, axis=1)
        top = np.lexsort((members, np.where(members == far, np.inf, -score)), axis=1)[:, :nearest]
        members, score = (np.take_along_axis(y, top, axis=1) for y in (members, score))
        row, column = np.nonzero(members != far)
        out.append((names[at : at + AT_ONCE][row], members[row, column], score[row, column]))
    q, vec_id, score = (np.concatenate(y) for y in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"q": q, "vec_id": vec_id, "score": score})


def neighbours(rows: DataFrame, divisor: int = DIVISOR, nearest_n: int = NEAREST, block: int = BLOCK, per_block: int = QUERIES, rerank: int = RERANK) -> DataFrame:
    """The nearest rows of each query, nearest first: query_id, rank (from 1), vec_id, score (cosine).

    Queries are the rows whose vec_id ``divisor`` divides, candidates all rows but the query's own;
    a query with fewer candidates gets them all, ties go to the smaller vec_id. Rows whose vector is
    null, empty or zero, or holds a null or what isn't finite, take no part, nor do rows without a
    vec_id, as no result could name them. Shorter vectors count as having zeros behind. Equal
    vectors are indexed once with the ``nearest_n + 1`` smallest of their ids, as no further one can
    be in a result. Repeated rows are candidates each, and queries each, with results of their
    own. An empty table gives no rows; further columns are not read.
    """
    spark, k = rows.sparkSession, nearest_n
    here = written(vectors(rows))
    smallest = Window.partitionBy("v").orderBy("vec_id")
    few = here.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1)
    distinct = written(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    queries = staged(here.where(F.col("vec_id") % divisor == 0).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("times")).withColumn("q", F.monotonically_increasing_id()))
    n, longest = distinct.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    many = queries.count()
    if not n or not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = -(-longest // (8 * WIDTH)) * WIDTH
    # nine tenths of the bound by a hash, so that no task sends more than its share to the driver
    most = max(CODES, min(SAMPLE, SAMPLE_NUMBERS // size))
    some = distinct if n <= most else distinct.where(F.pmod(F.xxhash64("v"), F.lit(10 * n)) < 9 * most)
    sample = sorted(r.v for r in some.select("v").limit(most).collect())
    model = Quantiser(unit(matrix(pa.array(sample, pa.binary()), size)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.packed(unit(matrix(batch.column(0), size))) if batch.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["v", "ids", "codes"])

    across, down = -(-n // block), -(-many // per_block)
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = distinct.mapInArrow(encode, "v binary, ids array<long>, codes binary").withColumn("i", F.pmod(F.xxhash64("v"), F.lit(across)).cast("int")).withColumn("j", to_all(down))
    asked = queries.select("q", "query_id", "v", F.pmod(F.xxhash64("q"), F.lit(down)).cast("int").alias("j")).withColumn("i", to_all(across))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest(left, right, model, size, k, rerank)

    cells = indexed.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(meet, "q long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(queries.select("q", "query_id", "times"), "q")
    return named.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """DuckDB SQL: all pairs by exact cosine."""
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {DIVISOR} = 0)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEAREST}"""
