"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A *partial partition* is a tuple of ``k`` heaps with their byte sums. Two are
combined oppositely ordered, the largest heap of one on the smallest of the
other, always those of largest spread first. Groups are spread over cells by hash, as
many as leave a cell a bounded number; each cell combines its groups down to one
partial partition, and cells are combined the same way, ``FAN`` at a time, up a
tree. Equal texts are one group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_place, cut, table, text_key

FAN = 512
CELL_GROUPS = 20_000


def difference(sizes: list[list[int]], k: int) -> tuple[list[int], np.ndarray]:
    """Combine partial partitions (``k`` sums each) into one.

    Returns its sums and, for each given one, the final heap of each of its own
    heaps. Ties go by the order given.
    """
    heap, kids = [], []
    for i, s in enumerate(sizes):
        order = sorted(range(k), key=lambda j: (-s[j], j))
        kids.append((None, order))
        top = [s[j] for j in order]
        heap.append((top[-1] - top[0], i, top))
    heapq.heapify(heap)
    # A node lists its children with, for each place of a child, the place it takes in the node.
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        place = [0] * k
        for to, j in enumerate(order):
            place[j] = to
        kids.append(((a, place), (b, place[::-1])))
        top = [sums[j] for j in order]
        heapq.heappush(heap, (top[-1] - top[0], len(kids) - 1, top))
    final = np.zeros((len(sizes), k), np.int64)
    if not heap:
        return [0] * k, final
    stack = [(heap[0][1], list(range(k)))]
    while stack:
        node, to = stack.pop()
        left, right = kids[node]
        if left is None:
            for rank, j in enumerate(right):
                final[node, j] = to[rank]
        else:
            for kid, place in (left, right):
                stack.append((kid, [to[p] for p in place]))
    return heap[0][2], final


def _in_cell(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's rows follow one another; a row for each group says in which of the cell's heaps it is."""
        held: list[pa.RecordBatch] = []
        last = None

        def solve() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            size = t.column("bytes").to_pylist()
            _, final = difference([[s] + [0] * (k - 1) for s in size], k)
            return pa.RecordBatch.from_arrays([t.column("cell").chunk(0), t.column("group").chunk(0), t.column("bytes").chunk(0), pa.array(final[:, 0].astype(np.int32))], names=["cell", "group", "bytes", "heap"])

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            if not len(cell):
                continue
            head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for i, j in zip(head, np.append(head[1:], len(cell)), strict=True):
                if held and cell[i] != last:
                    yield solve()
                    held = []
                held.append(batch.slice(int(i), int(j - i)))
                last = cell[i]
        if held:
            yield solve()

    return run


def _combine(k: int):
    """Cells of one node of the tree: for each cell's heaps the heaps of the node, with their bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="cell", columns="heap", values="bytes").reindex(columns=range(k)).fillna(0).sort_index()
        sizes = wide.to_numpy().astype(np.int64)
        _, final = difference(sizes.tolist(), k)
        n = len(wide)
        return pd.DataFrame({"cell": np.repeat(wide.index.to_numpy(), k).astype(np.int32), "heap": np.tile(np.arange(k, dtype=np.int32), n), "node": np.int32(pdf["node"].iloc[0]), "to": final.reshape(-1).astype(np.int32), "bytes": sizes.reshape(-1)})

    return run


def karmarkar_karp(groups: DataFrame, shards: int, cells: int | None = None, fan: int = FAN) -> DataFrame:
    """``group, shard`` for ``groups`` (group, bytes), sums as equal as differencing makes them.

    Groups are unique. By default there are ``fan`` cells, or more if a cell would
    hold over ``CELL_GROUPS`` groups; ``fan`` partial partitions are combined at
    once. A group larger than a fair share fills a shard by itself and the others
    share the rest. No groups, no rows.
    """
    groups = cut(groups.select("group", F.col("bytes").cast("long").alias("bytes")))
    if cells is None:
        cells = max(fan, -(-groups.count() // CELL_GROUPS))
    spread = groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int"))
    n = max(2, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(groups.dtypes)["group"]
    n = max(min(n, cells), cells // 64)
    placed = cut(spread.repartition(n, "cell").sortWithinPartitions("cell", F.desc("bytes"), "group").mapInArrow(_in_cell(shards), f"cell int, group {kind}, bytes long, heap int"))
    sums = placed.groupBy("cell", "heap").agg(F.sum("bytes").alias("bytes"))
    way = None
    while True:
        nodes = -(-cells // fan)
        step = cut(sums.withColumn("node", F.pmod("cell", F.lit(nodes)).cast("int")).groupBy("node").applyInPandas(_combine(shards), "cell int, heap int, node int, to int, bytes long"))
        up = step.select("cell", "heap", "node", "to")
        way = up if way is None else way.join(up.select(F.col("cell").alias("node"), F.col("heap").alias("to"), F.col("node").alias("node2"), F.col("to").alias("to2")), ["node", "to"]).select("cell", "heap", F.col("node2").alias("node"), F.col("to2").alias("to"))
        if nodes == 1:
            break
        sums, cells = step.groupBy(F.col("node").alias("cell"), F.col("to").alias("heap")).agg(F.sum("bytes").alias("bytes")), nodes
    return placed.join(way.select("cell", "heap", F.col("to").alias("shard")), ["cell", "heap"]).select("group", "shard")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", cells: int | None = None, numbers: int | None = None) -> DataFrame:
    """Every row of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    The size is the text's UTF-8 bytes plus 1; a null text has no bytes and is a
    group with the empty one. All rows of one text share a shard. Slots count
    each shard's rows from 0 without gaps, in ``numbers`` runs (by default 256, more
    beyond 100 million rows) fixed by hashes of id and text, each ordered by id and
    text. Law is ``bytes``; grown_shard null.
    A long text is a group like any other; equal rows take neighbouring slots; an
    empty table gives no rows. Columns with the names of the results are replaced,
    others may have any name.
    """
    numbers = numbers or max(256, docs.count() // 400_000)
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows, at, kept = by_place(docs, (text, doc_id), set(new))
    text, doc_id = at[text], at[doc_id]
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = rows.withColumns({"__key": F.substring(text_key(F.col(text).cast("string")), 1, 16), "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body)})
    groups = rows.groupBy("__key").agg(F.sum("size").alias("bytes")).select(F.col("__key").alias("group"), "bytes")
    to = karmarkar_karp(groups, shards, cells)
    placed = rows.join(to.withColumnRenamed("group", "__key"), "__key")
    run = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), "__key"), F.lit(numbers)).cast("int")
    placed = placed.withColumn("__run", run)
    sizes = placed.groupBy("shard", "__run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("shard", "__run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    order = Window.partitionBy("shard", "__run").orderBy(F.col(doc_id).cast("string"), "__key")
    out = placed.withColumn("__at", F.row_number().over(order)).join(offset, ["shard", "__run"]).withColumns({"slot": F.col("__from") + F.col("__at") - 1, "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.select(*[at[c] for c in kept], *new).toDF(*kept, *new)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes.

    A null text is empty and of size 1; see ``shard_documents``.
    """
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
