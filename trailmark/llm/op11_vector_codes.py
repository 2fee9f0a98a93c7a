"""Vector code compression: product codes whose codebooks are fitted in exact integers.

Vectors become integers, are cut into equal consecutive parts and kept as columnar
blocks: a block holds some thousand vectors, component after component, as the bytes
of a NumPy array. A fitting round is one ``treeAggregate`` over the RDD of blocks:
distances to a codebook's entries accumulate dimension by dimension, ``np.add.at``
adds the parts to int64 sum and count tensors of the codebooks' size, and the tensors
merge up a reduction tree. So a round sends the driver a few tensors, whatever the
input's size, and the codebooks travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, meet, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integer components are held to this magnitude, so that squared distances of parts of up to 8192 components and vectors of as many fit 64 bits.
MOST = 1 << 24
#: Vectors of one block.
BLOCK = 4096


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null, not empty, and without null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(column: pa.Array, dim: int, scale: int, most: int) -> np.ndarray:
    """Rows of floor(scale * x), held to ``most``; int32."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(flat * scale), -most, most).astype(np.int32)


def _blocks(parts: int, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = np.zeros((some.num_rows, -(-dim // parts) * parts), np.int32)
                x[:, :dim] = integers(some.column("v"), dim, scale, MOST)
                ids, labels = some.column("id"), some.column("label")
                one = [pa.array([x.T.tobytes()], pa.binary()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels))]
                yield pa.RecordBatch.from_arrays(one, names=["block", "ids", "labels"])

    return run


def columnar(vectors: DataFrame, vector: str, id_: str, label: str | None, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Written blocks (block, ids, labels) of the rows that take part, and the components of a part.

    The dimension is that of the vector of least id; vectors of another length take no
    part. Where it is no multiple of ``parts``, zeros fill it up.
    """
    kept = finite(vectors.select(F.col(id_).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).cast("array<double>").alias("v")), "v")
    first = kept.select(F.size("v").alias("n"), "id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    dim = first[0]["n"] if first else 0
    kinds = dict(kept.dtypes)
    blocks = kept.where(F.size("v") == dim).mapInArrow(_blocks(parts, dim, scale), f"block binary, ids array<{kinds['id']}>, labels array<{kinds['label']}>")
    return cut(blocks), -(-dim // parts)


def unpack(block: bytes, parts: int, width: int) -> np.ndarray:
    """A block as int64 (part, component, vector)."""
    return np.frombuffer(block, np.int32).reshape(parts, width, -1).astype(np.int64)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every part of a block the nearest entry and its squared distance; ties to the lower entry."""
    parts, width, n = x.shape
    code, least = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    for p in range(parts):
        far = np.zeros((books.shape[1], n), np.int64)
        for d in range(width):
            gap = x[p, d] - books[p, :, d, None]
            far += gap * gap
        code[p] = far.argmin(axis=0)
        least[p] = far[code[p], np.arange(n)]
    return code, least


def fit(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS, depth: int = 2) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` of assigning all parts and taking floored means; unused entries stay."""
    parts, entries, width = books.shape
    rdd = blocks.select("block").rdd
    for _ in range(rounds if books.size else 0):
        now = books

        def add(acc: tuple[np.ndarray, np.ndarray], row, now=now) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = acc
            x = unpack(row[0], parts, width)
            code, _ = nearest(x, now)
            part = np.broadcast_to(np.arange(parts)[:, None], code.shape)
            np.add.at(sums, (part, code), x.transpose(0, 2, 1))
            np.add.at(counts, (part, code), 1)
            return sums, counts

        def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return a[0] + b[0], a[1] + b[1]

        sums, counts = rdd.treeAggregate((np.zeros_like(books), np.zeros((parts, entries), np.int64)), add, merge, depth)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def seed(blocks: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks of the parts of the ``entries`` smallest ids (nulls last, ties by components); fewer where there are fewer."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids"), strict=True):
                x = unpack(block, parts, width).reshape(parts * width, -1).T
                order = np.argsort(ids.values.to_numpy(zero_copy_only=False), kind="stable") if not ids.values.null_count else np.arange(len(x))
                # Ties of the last place stay in, so that the order by components decides among them.
                if not ids.values.null_count and len(x) > entries:
                    named = ids.values.to_numpy(zero_copy_only=False)
                    order = np.flatnonzero(named <= named[order[entries - 1]])
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(order)), pa.array(x[order].astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["id", "x"])

    kind = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]
    rows = blocks.select("block", "ids").mapInArrow(least, f"id {kind}, x array<long>").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
    flat = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), parts, width)
    return flat.transpose(1, 0, 2).copy()


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code`` (a byte a part) and ``error`` (squared distances summed over parts) of every vector."""
    parts, _, width = books.shape
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, labels in zip(batch.column("block").to_pylist(), batch.column("ids"), batch.column("labels"), strict=True):
                code, least = nearest(unpack(block, parts, width), books)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), code.shape[1], [None, pa.py_buffer(code.T.astype(np.uint8).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, codes, pa.array(least.sum(axis=0))], names=["id", "label", "code", "error"])

    of = lambda c: kinds[c].removeprefix("array<")[:-1]
    return blocks.mapInArrow(run, f"id {of('ids')}, label {of('labels')}, code binary, error long")


def decode(code: bytes, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, k] for p, k in enumerate(code)])


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The codes of all vectors that take part (id, label, code, error) and the codebooks (part, entry, component).

    A vector that is null or empty, or holds a null or a component that is not
    finite, takes no part, nor does one of another length than that of least id.
    Components are floor(scale * x), held to ``MOST``. Rows of null ids are coded;
    as seeds they come last. Repeated rows are coded each and count each; equal
    distances go to the lower entry. Fewer rows than ``entries`` give as many
    entries; without rows there are no codes and no entries. Only the three named
    columns are read, so others may have any name.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    blocks, width = columnar(vectors, vector, id_, label, parts, scale)
    books = fit(blocks, seed(blocks, width, parts, entries), rounds)
    return encode(blocks, books), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and errors of their label for all embeddings; see ``compress``."""
    found, books = compress(table(spark, sf_dir, "embeddings"))
    coded = cut(found)
    # A label's error is one number; null labels are one label.
    named = coded.withColumn("k", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label")))
    sums = cut(named.groupBy("k").agg(F.sum("error").alias("label_error")))
    out = meet(named, sums, "k", sums.count(), "id")
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds of fitting, one after another; distances as exact integers."""
    gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS (SELECT k.vec_id, label, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM k, range(8) t(part))",
        "b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 16)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(entry, (g, entry)) AS entry, min(g) AS g FROM (SELECT vec_id, label, part, x, entry, {gap}::BIGINT AS g FROM p JOIN b{i} USING (part)) GROUP BY ALL)")
        if i < ROUNDS:
            steps.append(f"m{i} AS (SELECT part, entry, list(m ORDER BY place) AS c FROM (SELECT part, entry, place, floor(sum(y) / count(*))::BIGINT AS m FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (part, entry))")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS})")
    steps.append(f"r AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(g)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r, s"


OP11_SQL = _sql()
