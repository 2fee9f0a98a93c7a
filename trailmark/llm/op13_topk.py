"""Exact top-k search by inner product over norm-sorted vectors.

The vectors are dealt by range of length, longest first, into groups of blocks. An
orthogonal rotation, the right singular vectors of all of them (from their Gram
matrix, summed block by block), puts most of a product into the first components. A
query's threshold is first its k-th score among the longest vectors of all. A task
holds one group and some queries: block after block it drops the queries whose
length times the block's largest cannot reach their threshold, adds up the first
rotated components, bounds the rest by Cauchy-Schwarz with the residual lengths, and
takes the exact product of integers only of vectors that may still enter. Nothing is
approximate: a pair is pruned only if its bound is below the threshold by more than
the rounding of floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, parts, table
from .op11_vector_codes import finite, integers

K = 10
SCALE = 1024
#: Integer components are held to this magnitude: products of up to 8192 components fit 64 bits.
MOST = 1 << 24
#: Vectors of a block, of a group, queries that meet a group at once, and longest vectors that give the first thresholds.
BLOCK = 2048
GROUP = 32_768
QUERIES = 2048
HEAD = 2048
#: Shares of the rotated components after which the bound is tried, and the share of pairs below which those left are scored one by one.
STEPS = (0.25, 0.5, 0.75)
FEW = 0.1


def _blocks(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of length: the task's number is the group's."""
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        n = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                x = integers(some.column("v"), dim, scale, MOST)
                ids = some.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["g", "o", "ids", "x"])
                n += 1

    return run


def _read(ids: bytes, x: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(x, np.int32).reshape(-1, dim).astype(np.float64)


def gram(blocks: DataFrame, dim: int) -> np.ndarray:
    """Sum of x xᵀ over all vectors: a matrix of the dimension's size a task, merged up a tree."""

    def add(acc: np.ndarray, row) -> np.ndarray:
        x = np.frombuffer(row[0], np.int32).reshape(-1, dim).astype(np.float64)
        return acc + x.T @ x

    return blocks.select("x").rdd.treeAggregate(np.zeros((dim, dim)), add, lambda a, b: a + b)


def rotation(total: np.ndarray) -> np.ndarray:
    """Right singular vectors of the data, strongest first, as columns."""
    return np.linalg.svd(total)[0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers, exactly; int64."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max()) < 2.0**51:
        return (a @ b.T).astype(np.int64)  # every partial sum is a whole number that a float holds
    return a.astype(np.int64) @ b.astype(np.int64).T


def pair_products(a: np.ndarray, b: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Inner products of whole numbers row by row, exactly; int64."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), at_once):
        x, y = a[i : i + at_once], b[i : i + at_once]
        if np.sqrt((x * x).sum(1).max()) * np.sqrt((y * y).sum(1).max()) < 2.0**51:
            out[i : i + at_once] = np.einsum("ij,ij->i", x, y).astype(np.int64)
        else:
            out[i : i + at_once] = np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))
    return out


class Best:
    """The ``k`` best scores of some queries so far, ties to smaller ids; ``floor`` is what a score must reach to count."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (row, candidate) of the queries ``rows``; -1 << 63 stands for none."""
        none = np.iinfo(np.int64).min
        if scores.shape[1] > self.k:
            # What is below this block's own k-th score cannot be among the best.
            self.floor[rows] = np.maximum(self.floor[rows], np.partition(scores, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((scores >= self.floor[rows][:, None]) & (scores != none))
        if not len(r):
            return
        row, score, id_ = np.append(self.row, rows[r]), np.append(self.score, scores[r, c]), np.append(self.id, ids[c])
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        head = np.append(True, row[1:] != row[:-1])
        place = np.arange(len(row)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        keep = place < self.k
        self.row, self.score, self.id = row[keep], score[keep], id_[keep]
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])


def search(best: Best, queries: tuple[np.ndarray, np.ndarray], turned: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, steps: tuple[float, ...] = STEPS) -> tuple[int, int]:
    """Offer a block's vectors to the queries it may matter to; pairs given and pairs whose exact product was taken."""
    qid, q = queries
    none = np.iinfo(np.int64).min
    size, longest = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1).max())
    # Half covers scores being whole, the rest the rounding of sums.
    slack = 0.5 + 1e-9 * size * longest
    floor = best.floor.astype(np.float64)
    live = np.flatnonzero(size * longest >= floor - slack)
    if not len(live):
        return len(q) * len(x), 0
    cols = np.arange(len(x))
    y, dim, done = x @ turn, x.shape[1], 0
    part = np.zeros((len(live), len(x)))
    may = np.ones(part.shape, bool)
    for share in steps:
        to = max(done, int(dim * share))
        part += turned[live, done:to] @ y[cols, done:to].T
        rest = np.sqrt((turned[live, to:] ** 2).sum(1))[:, None] * np.sqrt((y[cols, to:] ** 2).sum(1))[None]
        may &= part + rest >= (floor - slack)[live][:, None]
        rows, done = may.any(1), to
        keep = may[rows].any(0)
        live, cols = live[rows], cols[keep]
        part, may = part[rows][:, keep], may[rows][:, keep]
        if not len(live):
            return len(q) * len(x), 0
    if may.mean() < FEW:
        r, c = np.nonzero(may)
        scores = np.full(may.shape, none)
        scores[r, c] = pair_products(q[live[r]], x[cols[c]])
        taken = len(r)
    else:
        scores = products(q[live], x[cols])
        taken = scores.size
    scores[qid[live][:, None] == ids[cols][None]] = none
    best.offer(live, scores, ids[cols])
    return len(q) * len(x), taken


def top_k(vectors: DataFrame, query: DataFrame, vector: str = "embedding", id_: str = "vec_id", k: int = K, scale: int = SCALE, group: int = GROUP) -> DataFrame:
    """``query_id, rank, id, score``: for each row of ``query`` the ``k`` rows of ``vectors`` of largest inner product of floor(scale * x).

    Equal scores go to the smaller id; a row of the query's own id is no candidate
    to it. Where there are fewer candidates, all are given. Vectors that are null or
    empty or hold a null or a component that is not finite take no part, nor do
    those of null id or of another length than that of least id; components are held
    to ``MOST``. A repeated row is a candidate each time, and a query id that is
    repeated asks with its first vector. Empty tables give no rows. Only the two
    named columns are read, so others may have any name.
    """
    spark = vectors.sparkSession
    kept = lambda df: finite(df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null"), "v")
    schema = "query_id long, rank int, id long, score long"
    size = kept(vectors).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.size("v"), "id").alias("dim")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    dim = size["dim"]
    whole = lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-MOST)), F.lit(MOST)).cast("double")
    length = F.aggregate(F.transform("v", lambda x: whole(x) * whole(x)), F.lit(0.0), lambda a, b: a + b)
    rows = kept(vectors).where(F.size("v") == dim).withColumn("l", length)
    # Ties of length are dealt by id, so copies of one vector fill as many groups as they need.
    dealt = rows.repartitionByRange(max(parts(vectors), -(-size["n"] // group)), F.desc("l"), "id").sortWithinPartitions(F.desc("l"), "id").select("id", "v")
    blocks = cut(dealt.mapInArrow(_blocks(dim, scale), "g int, o int, ids binary, x binary"))
    turn = rotation(gram(blocks, dim))
    head = [_read(r["ids"], r["x"], dim) for r in blocks.orderBy("g", "o").limit(-(-HEAD // BLOCK)).collect()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with their thresholds among the longest vectors."""
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                qid = some.column("id").to_numpy()
                x = integers(some.column("v"), dim, scale, MOST)
                best = Best(len(qid), k, np.full(len(qid), np.iinfo(np.int64).min))
                q = x.astype(np.float64)
                for ids, c in head:
                    search(best, (qid, q), q @ turn, ids, c, turn)
                floor = np.full(len(qid), np.iinfo(np.int64).min)
                full = np.flatnonzero(np.bincount(best.row, minlength=len(qid)) == k)
                floor[full] = best.floor[full]
                yield pa.RecordBatch.from_arrays([pa.array([int(qid[0])]), *(pa.array([a.tobytes()], pa.binary()) for a in (qid.astype(np.int64), x, floor.astype(np.int64)))], names=["s", "qids", "q", "floor"])

    one = Window.partitionBy("id").orderBy("v")
    asked = kept(query).where(F.size("v") == dim).withColumn("n", F.row_number().over(one)).where("n = 1").select("id", "v")
    asked = cut(asked.mapInArrow(ask, "s long, qids binary, q binary, floor binary"))
    last = blocks.agg(F.max("g")).first()[0]

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        found = []
        for r in right.to_pylist():
            qid, q = _read(r["qids"], r["q"], dim)
            best = Best(len(qid), k, np.frombuffer(r["floor"], np.int64))
            turned = q @ turn
            for b in sorted(left.select(["o", "ids", "x"]).to_pylist(), key=lambda b: b["o"]):
                ids, x = _read(b["ids"], b["x"], dim)
                search(best, (qid, q), turned, ids, x, turn)
            found.append(pa.Table.from_arrays([pa.array(qid[best.row]), pa.array(best.id), pa.array(best.score)], names=names))
        return pa.concat_tables(found) if found else pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=names)

    # Each task: one group of vectors, one block of queries, both of bounded size.
    q = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(last))))
    c = blocks.join(q.select("g", "s"), "g").toDF("g", "o", "ids", "x", "s")
    found = c.groupBy("g", "s").cogroup(q.groupBy("g", "s")).applyInArrow(answer, "query_id long, id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for those whose id is divisible by 100; see ``top_k``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0)).withColumnRenamed("id", "vec_id")


OP13_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10"""
