"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased. Documents and benchmark items
that share a seed, ``seed`` consecutive tokens, are joined; in each pair the
longest common runs of tokens are marked one after another, never overlapping,
found by running Karp-Rabin hashes of ever shorter lengths down to ``seed``. An
item is leaked by a document if the tiles cover ``coverage`` of it, in whatever
order they stand.

A pair is tiled only if the item's tokens under shared seeds, whose places are kept and
merged, reach the coverage. Seeds that many items have, as of a prompt, lead a
document only to items that they alone could cover enough of.

Seeds of the benchmark are kept as bits of a table of fixed size, so documents
send on only what may be shared: their tokens under possible seeds, with breaks
between separate stretches. Every tile consists of seeds, so nothing is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .common import cut, table

BITS = 1 << 24
_POW = vec.Powers(vec.BASE)
#: ASCII bytes that are no letters or digits end a token; other bytes never do.
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Token hashes of texts, their remainders, and the first token of each (with a last entry)."""
    buf, offs = vec.flat(pa.array([None if t is None else t.lower() for t in column.to_pylist()], pa.string()))
    plain = np.where(_BREAK[buf], np.uint8(0x20), buf)
    starts, ends, first = vec.words(plain, offs)
    word = vec.FIELD.words(plain, starts, ends)
    return vec.Field.join(word), word, first


def seeds_at(word: list[np.ndarray], at: np.ndarray, k: int) -> np.ndarray:
    return vec.Field.join([g[at] for g in vec.FIELD.grams(word, k)])


def _seeds(k: int, name: str):
    """Of each text its distinct seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, word, first = tokens(batch.column("text"))
            at, doc = vec.windows(first, k)
            seed = seeds_at(word, at, k)
            n = np.diff(first)
            cut = np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))).astype(np.int32)
            tok = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(n), pa.ListArray.from_arrays(pa.array(cut), pa.array(seed.view(np.int64))), tok], names=[name, "n", "seeds", "tokens"])

    return run


def _suspects(k: int, sent):
    """Documents with a possible seed: its seeds, and the tokens under seeds with a break (0) between stretches."""
    bits: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not bits:
            table_ = np.zeros(BITS // 8, np.uint8)
            for bucket, data in sent.value:
                table_[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(data, np.uint8)
            bits.append(table_)
        for part, _, _ in vec.slices(batches, "text"):
            h, word, first = tokens(part.column("text"))
            at, doc = vec.windows(first, k)
            if not len(at):
                continue
            seed = seeds_at(word, at, k)
            cell = (seed % np.uint64(BITS)).astype(np.int64)
            hit = np.flatnonzero((bits[0][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            cover = vec.marked(at[hit], np.full(len(hit), k), len(h))
            place = np.flatnonzero(cover)
            owner = np.searchsorted(first, place, side="right") - 1
            # A break stands before each stretch that does not follow the token before it.
            fresh = np.append(True, (np.diff(place) > 1) | (np.diff(owner) > 0))
            to = np.arange(len(place)) + np.cumsum(fresh)
            out = np.zeros(len(place) + int(fresh.sum()), np.uint64)
            out[to] = h[place]
            with_break = np.repeat(owner, 1 + fresh.astype(np.int64))
            docs = np.unique(owner)
            cut = np.append(0, np.cumsum(np.bincount(with_break, minlength=part.num_rows)[docs])).astype(np.int32)
            who = doc[hit]
            seed_cut = np.append(0, np.cumsum(np.bincount(who, minlength=part.num_rows)[docs])).astype(np.int32)
            rows = pa.array(docs)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(rows), part.column("th").take(rows), pa.ListArray.from_arrays(pa.array(seed_cut), pa.array(seed[hit].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(out.view(np.int64)))],
                names=["doc", "th", "seeds", "stretches"],
            )
        vec.release()

    return run


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length), longest first; a 0 in the text matches nothing.

    Running Karp-Rabin: hashes of the current search length over unmarked tokens
    of both sides are compared and hits extended. A hit of more than twice the
    search length restarts the search at its length; else hits are marked, long
    ones first and earliest of equals, what is left of an occluded one among them,
    and the length is halved. So every tile is a longest match of what was free.
    Only places where a run begins are compared, so a periodic text of p tokens and
    item of q make p + q runs and not p * q.
    """
    text, item = np.asarray(text).view(np.uint64), np.asarray(item).view(np.uint64)
    free_t, free_i = text != 0, np.ones(len(item), bool)
    roll_t, roll_i = vec.Rolling(text, _POW), vec.Rolling(item, _POW)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), 32))

    def open_runs(free: np.ndarray, s: int) -> np.ndarray:
        if len(free) < s:
            return np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(free))
        return np.flatnonzero(total[s:] - total[:-s] == s)

    def before(x: np.ndarray, free: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The token before each place; 0 where there is none that is free."""
        return np.where((at > 0) & free[at - 1], x[at - 1], np.uint64(0))

    while True:
        at_i, at_t = open_runs(free_i, length), open_runs(free_t, length)
        found: list[tuple[int, int, int]] = []
        longest = 0
        if len(at_i) and len(at_t):
            # Item places by hash and by the token before: a run begins where those before differ or are not free.
            where: dict[int, dict[int, list[int]]] = {}
            for j, h, w in zip(at_i.tolist(), roll_i.of(at_i, at_i + length).tolist(), before(item, free_i, at_i).tolist(), strict=True):
                where.setdefault(h, {}).setdefault(w, []).append(j)
            for p, h, w in zip(at_t.tolist(), roll_t.of(at_t, at_t + length).tolist(), before(text, free_t, at_t).tolist(), strict=True):
                for q in (q for x, places in where.get(h, {}).items() if x != w or not w for q in places):
                    most = min(len(text) - p, len(item) - q)
                    apart = (text[p : p + most] != item[q : q + most]) | ~free_t[p : p + most] | ~free_i[q : q + most]
                    n = int(apart.argmax()) if apart.any() else most
                    if n >= length:  # a hash may lie
                        found.append((-n, p, q))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        heapq.heapify(found)
        while found:
            n, p, q = heapq.heappop(found)
            both = free_t[p : p - n] & free_i[q : q - n]
            if both.all():
                free_t[p : p - n] = False
                free_i[q : q - n] = False
                tiles.append((p, q, -n))
                continue
            # What is left of an occluded match takes its place among the others.
            edge = np.flatnonzero(np.diff(np.concatenate(([0], both.astype(np.int8), [0]))))
            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if j - i >= length:
                    heapq.heappush(found, (i - j, p + i, q + i))
        if length == least:
            return tiles
        length = max(least, length // 2)


def _cover(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, longest = [], []
            stretches, items = batch.column("stretches"), batch.column("tokens")
            for i in range(batch.num_rows):
                tiles = tile(stretches[i].values.to_numpy(), items[i].values.to_numpy(), k)
                covered.append(sum(t[2] for t in tiles))
                longest.append(max((t[2] for t in tiles), default=0))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), batch.column("item"), batch.column("n"), pa.array(covered, pa.int64()), pa.array(longest, pa.int64())], names=["doc", "th", "item", "n", "covered", "longest"])

    return run


def _covered(places: Column, k: int) -> Column:
    """How many places runs of ``k`` from each of ``places`` cover together."""
    p = F.array_sort(F.array_distinct(places))
    gaps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(k)))
    return F.when(F.size(p) > 0, F.aggregate(gaps, F.lit(k), lambda s, g: s + g)).otherwise(0)


def candidates(docs: DataFrame, benchmark: DataFrame, text: str, doc_id: str, seed: int, coverage: float, common: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (who, item, n, tokens) to be tiled, and what documents with a possible seed sent (who, seeds, stretches)."""
    spark = docs.sparkSession
    # Inside, an item is its id and the hash of its text, which meet in joins when the id is null too.
    item = F.struct("item_id", F.xxhash64(F.col("text").cast("string")).alias("h")).alias("item")
    item_kind = f"struct<item_id: {dict(benchmark.dtypes)['item_id']}, h: bigint>"
    items = benchmark.select(item, F.col("text").cast("string").alias("text")).mapInArrow(_seeds(seed, "item"), f"item {item_kind}, n long, seeds array<long>, tokens array<long>")
    placed = items.select("item", "n", F.posexplode("seeds").alias("pos", "seed"))
    by_seed = placed.groupBy("item", "n", "seed").agg(F.collect_list("pos").alias("places"))
    # Seeds of many items, such as a prompt's, join documents only to items that such seeds alone could cover enough of; the others need a seed of their own as well.
    usual = by_seed.groupBy("seed").agg((F.count(F.lit(1)) > common).alias("common"))
    by_seed = cut(by_seed.join(usual, "seed"))
    prompts = by_seed.groupBy("item", "n").agg(F.flatten(F.collect_list(F.when(F.col("common"), F.col("places")))).alias("shared"))
    own = F.coalesce(_covered(F.col("shared"), seed), F.lit(0)) >= F.col("n") * F.lit(coverage)
    prompts = prompts.select("item", own.alias("whole"), F.when(own, F.array().cast("array<int>")).otherwise(F.col("shared")).alias("shared"))
    joining = by_seed.join(prompts.select("item", "whole"), "item").where("whole or not common").select("seed", "item", "places")
    # Unsigned remainder of the 64-bit seed, as cells of bitmaps of 32768 bits: at most BITS bits in all.
    cell = placed.select((F.col("seed").bitwiseAND(BITS - 1)).alias("cell"))
    bits = cell.groupBy(F.expr("bitmap_bucket_number(cell + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias("bits")).collect()
    sent = spark.sparkContext.broadcast([(int(r[0]), bytes(r[1])) for r in bits])
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    # A document is its id and hash as one value, which meet in joins when the id is null too.
    found = cut(rows.mapInArrow(_suspects(seed, sent), f"doc {kind}, th long, seeds array<long>, stretches array<long>").select(F.struct("doc", "th").alias("who"), "seeds", "stretches"))
    shared = found.select("who", F.explode(F.array_distinct("seeds")).alias("seed")).join(joining, "seed").groupBy("who", "item").agg(F.flatten(F.collect_list("places")).alias("places"))
    # A tile consists of seeds that both have, so tiles cover no token of the item that is under none of them.
    most = _covered(F.concat("places", "shared"), seed)
    pairs = shared.join(items.select("item", "n", "tokens"), "item").join(prompts, "item").where(most >= F.col("n") * F.lit(coverage)).select("who", "item", "n", "tokens")
    return pairs, found


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 5, coverage: float = 0.5, common: int = 16) -> DataFrame:
    """``doc_id, th, item_id, n_tokens, covered, coverage, longest`` for each document and item that share a seed and reach ``coverage``.

    ``benchmark`` has item_id and text; an item of fewer than ``seed`` tokens, a
    null text and an empty one match nothing. Null ids, of items too, stay null; ``th`` is the
    hash of the document's text, so rows of one id are told apart by their text,
    and equal rows give equal rows once. Texts of any length are read whole. Of
    other columns none is read. No items or no documents, no rows. ``common`` is from how
    many items on a seed is taken as a prompt's; it changes what is compared and no row.
    """
    pairs, found = candidates(docs, benchmark, text, doc_id, seed, coverage, common)
    texts = found.groupBy("who").agg(F.first("stretches").alias("stretches"))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema["who"].dataType}
    judged = pairs.join(texts, "who").select("who.doc", "who.th", "item", "n", "tokens", "stretches").mapInArrow(_cover(seed), f"doc {kinds['doc']}, th long, item {dict(pairs.dtypes)['item']}, n long, covered long, longest long")
    share = F.col("covered") / F.col("n")
    return judged.where(share >= coverage).select(F.col("doc").alias("doc_id"), "th", "item.item_id", F.col("n").alias("n_tokens"), "covered", share.alias("coverage"), "longest")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contaminated document with the benchmark items it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_tokens", "covered", "coverage", "longest", F.lit(True).alias("contaminated"))
