"""Removal of long repeated byte strings with suffix arrays built in shards.

Any two equal strings of ``min_bytes`` have equal minimisers (their leftmost
least gram), so every start of such a string is filed under the hash of its
minimiser. A *context* is a maximal run of starts with one minimiser, together
with the bytes they cover: a few hundred bytes. Equal contexts are counted by
their hash before any bytes move; different contexts under one minimiser meet
in a shard, where a suffix array (induced sorting) and permuted common prefixes
tell which of their starts have an equal elsewhere. Equal texts are one text
from the beginning.

A minimiser with more than ``hot_contexts`` different contexts leaves the shards:
its windows are counted by hash with partial sums, which is exact too and puts
no bound on the size of one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .common import cut, drop_cut, parts, table, text_key
from .suffix import permuted_lcp, suffix_array

GRAM = 160


def _contexts(buf: np.ndarray, offs: np.ndarray, m: int, gram: int):
    """Runs of window starts by minimiser: text, start, count, minimiser hash, two hashes of the covered bytes."""
    w = m - gram + 1
    # What files starts together may collide; what calls their bytes equal is 124 bits over a prime field.
    roll = vec.Rolling(buf, _POW)
    least = vec.sliding_argmin(roll.grams(gram), w)
    count = np.maximum(np.diff(offs) - m + 1, 0)
    valid = np.zeros(len(buf) + 1, np.int64)
    np.add.at(valid, offs[:-1], (count > 0).astype(np.int64))
    np.add.at(valid, offs[:-1] + count, -(count > 0).astype(np.int64))
    ok = np.cumsum(valid[: len(least)]) > 0
    tag = np.where(ok, least, -1)
    first = vec.runs(tag)
    if len(offs) > 2 and len(tag):
        first = np.union1d(first, offs[1:-1][offs[1:-1] < len(tag)])
    n = np.diff(np.append(first, len(tag)))
    keep = tag[first] >= 0 if len(first) else np.zeros(0, bool)
    first, n = first[keep], n[keep]
    at = least[first] if len(first) else first
    anchor = roll.of(at, at + gram)
    end = first + n - 1 + m
    doc = np.searchsorted(offs, first, side="right") - 1
    return doc, first - offs[doc], n, anchor, _join(buf, first, end, vec.Field.FIRST), _join(buf, first, end, vec.Field.SECOND)


def _join(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: tuple[int, int]) -> np.ndarray:
    return vec.Field.join(vec.FIELD.spans(buf, start, end, which))


_POW = vec.Powers(vec.BASE)
_CONTEXT = "anchor long, bytes long, bytes2 long, key binary, start int, n int"


def _find(m: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offs = vec.flat(batch.column("text"))
            # A text of any length is cut into parts that share m - 1 bytes, so that each start is in one.
            for text, s, e in vec.pieces(offs, m - 1):
                buf, lead = whole[s[0] : e[-1]], np.append(s, e[-1]) - s[0]
                doc, start, n, anchor, one, two = _contexts(buf, lead, m, gram)
                if len(doc):
                    at = (s - offs[text])[doc] + start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("key").take(pa.array(text[doc])), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                        names=["anchor", "bytes", "bytes2", "key", "start", "n"],
                    )
        vec.release()

    return run


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole minimiser groups: contexts that occur twice as hits, and, where some context is the only one of its kind, one of each kind to compare.

    A group of several contexts that all occur twice is settled by its counts.
    """
    for t in vec.whole_groups(batches, "anchor"):
        anchor, kind, two = (t.column(c).to_numpy() for c in ("anchor", "bytes", "bytes2"))
        order = np.lexsort((two, kind, anchor))
        a, k, k2 = anchor[order], kind[order], two[order]
        group = np.append(True, a[1:] != a[:-1])
        fresh = group | np.append(True, (k[1:] != k[:-1]) | (k2[1:] != k2[:-1]))
        which = np.cumsum(fresh) - 1
        times = np.bincount(which)
        head = np.flatnonzero(fresh)
        of = np.cumsum(group)[head] - 1
        kinds, lone = np.bincount(of), np.bincount(of, weights=times == 1)
        hits, ask = order[times[which] > 1], order[head[((kinds > 1) & (lone > 0))[of]]]
        rows = pa.array(np.concatenate((hits, ask)))
        yield pa.RecordBatch.from_arrays(
            [*(t.column(c).chunk(0).take(rows) for c in ("key", "anchor", "start", "n")), pa.array(np.append(np.zeros(len(hits), np.int32), kinds[of][((kinds > 1) & (lone > 0))[of]].astype(np.int32)))], names=["key", "anchor", "start", "n", "contexts"]
        )


def _take_bytes(m: int):
    """Cut the listed contexts out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in vec.slices(batches, "text"):
            got = batch.column("need")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(got.offsets.to_numpy()))
            item = got.flatten()
            start, n = item.field("start").to_numpy(), item.field("n").to_numpy()
            view = memoryview(buf)
            data = pa.array([bytes(view[offs[r] + s : offs[r] + s + c - 1 + m]) for r, s, c in zip(rows, start, n, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([item.field("anchor"), batch.column("key").take(pa.array(rows)), item.field("start"), item.field("n"), data], names=["anchor", "key", "start", "n", "data"])

    return run


def repeated_starts(buf: np.ndarray, offs: np.ndarray, m: int) -> np.ndarray:
    """Starts of strings of m bytes that start at two places of these contexts, by suffix array and common prefixes."""
    sizes = np.diff(offs)
    t = np.zeros(len(buf) + len(sizes), np.uint16)
    at = np.arange(len(buf)) + np.repeat(np.arange(len(sizes)), sizes)
    t[at] = buf.astype(np.uint16) + 1
    ends = offs[1:] + np.arange(len(sizes))
    sa = suffix_array(t, 257)
    phi, lcp = permuted_lcp(t, sa, m)
    room = np.repeat(ends, sizes + 1) - np.arange(len(t))
    hit = (lcp >= m) & (room >= m) & (phi >= 0)
    hit &= room[np.maximum(phi, 0)] >= m
    both = hit.copy()
    both[phi[hit]] = True
    return np.flatnonzero(both[at])


def _shards(m: int, limit: int):
    """One suffix array for each few megabytes of whole minimiser groups."""

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        if not t.num_rows:
            return
        buf, offs = vec.flat(t.column("data").combine_chunks() if not isinstance(t.column("data"), pa.ChunkedArray) else t.column("data").chunk(0))
        hits = repeated_starts(buf, offs, m)
        doc = np.searchsorted(offs, hits, side="right") - 1
        rel = hits - offs[doc]
        first = vec.runs(rel - np.arange(len(rel)) + doc * (1 << 32))
        if len(first):
            n = np.diff(np.append(first, len(rel)))
            start = t.column("start").to_numpy()[doc[first]] + rel[first]
            yield pa.RecordBatch.from_arrays([t.column("key").chunk(0).take(pa.array(doc[first])), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            _, offs = vec.flat(batch.column("data"))
            heads = vec.runs(anchors)
            for i, j in zip(heads, np.append(heads[1:], len(anchors)), strict=True):
                if size >= limit and anchors[i] != last:
                    yield from flush(held)
                    held, size = [], 0
                    vec.release()
                held.append(batch.slice(int(i), int(j - i)))
                size += int(offs[j] - offs[i])
                last = anchors[i]
        if held:
            yield from flush(held)
        vec.release()

    return run


def _hash_windows(m: int):
    """Each window of a context as two hashes, equal ones of one batch once, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in vec.slices(batches, "data"):
            count = np.diff(offs) - m + 1
            doc = np.repeat(np.arange(len(count)), count)
            rel = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            s = offs[doc] + rel
            start = part.column("start").to_numpy()[doc] + rel
            yield pa.RecordBatch.from_arrays([pa.array(_join(buf, s, s + m, vec.Field.FIRST).view(np.int64)), pa.array(_join(buf, s, s + m, vec.Field.SECOND).view(np.int64)), part.column("key").take(pa.array(doc)), pa.array(start.astype(np.int32))], names=["w1", "w2", "key", "start"])

    return run


def _apply(m: int, keep: bool):
    """Cover the repeated starts of each text and digest what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in vec.slices(batches, "text"):
            copies = batch.column("copies").to_numpy()
            got = batch.column("hits")
            at = np.concatenate(([0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(got).to_numpy(zero_copy_only=False)).astype(np.int64))))
            item = got.flatten()
            start, n = item.field("start").to_numpy(), item.field("n").to_numpy()
            removed, spans, digest, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = buf[offs[i] : offs[i + 1]]
                s, c = start[at[i] : at[i + 1]], n[at[i] : at[i + 1]]
                if copies[i] > 1 and len(text) >= m:
                    s, c = np.zeros(1, np.int64), np.array([len(text) - m + 1])
                i0, j0 = vec.spans(s.astype(np.int64), c + np.int64(m - 1))
                view = memoryview(text)
                left = b"".join([view[x:y] for x, y in zip([0, *j0.tolist()], [*i0.tolist(), len(text)], strict=True)])
                removed.append(len(text) - len(left))
                spans.append(len(i0))
                digest.append(hashlib.sha256(left).hexdigest())
                if keep:
                    kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if keep else [])],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])],
            )
        vec.release()

    return run


def _key(text: Column) -> Column:
    return F.substring(text_key(text), 1, 16).alias("key")


def suffix_dedup(docs: DataFrame, text: str = "text", min_bytes: int = 400, gram: int = GRAM, shard_bytes: int = 1 << 19, hot_contexts: int = 2000, hot_rows: int = 50_000, keep_bytes: bool = True) -> DataFrame:
    """Remaining bytes of every different text of ``docs``.

    Every byte covered by a string of ``min_bytes`` bytes that also starts
    anywhere else, in the same text or another, is removed; overlapping
    occurrences count and all strings are judged on the input. Texts that
    several rows share occur as often as they have rows. Null is the empty
    text, which is never changed; neither is a text shorter than ``min_bytes``.
    Texts of any length are searched whole, in parts that overlap. Ids play no
    part, so null and equal ones are fine; other columns are not read.
    An empty table gives no rows. Returns key (128 bits of the text's SHA-256), n_bytes,
    n_removed, n_spans, kept_sha256 and, if
    ``keep_bytes``, kept (the bytes).
    """
    one = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(_key(one), one.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    n = parts(docs)
    found = cut(texts.mapInArrow(_find(min_bytes, gram), _CONTEXT))
    # A minimiser of very many rows, told by one row in 64, is counted with partial sums, not gathered; which way it goes changes no result.
    often = found.where(F.pmod(F.xxhash64("key", "start"), F.lit(64)) == 0).groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") * 64 > hot_rows).select("anchor")
    often = cut(often)
    sorted_out = found.join(often, "anchor", "left_anti").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_sort_out, "key binary, anchor long, start int, n int, contexts int")
    crowd = found.join(often, "anchor", "left_semi")
    kinds = crowd.groupBy("anchor", "bytes", "bytes2").agg(F.min(F.struct("key", "start", "n")).alias("one"), F.count(F.lit(1)).alias("times"))
    copied = crowd.join(kinds.where("times > 1").select("anchor", "bytes", "bytes2"), ["anchor", "bytes", "bytes2"], "left_semi").select("key", "anchor", "start", "n", F.lit(0).alias("contexts"))
    lone = kinds.groupBy("anchor").agg(F.count(F.lit(1)).cast("int").alias("contexts"), F.min("times").alias("least")).where("contexts > 1 and least = 1")
    asked = kinds.join(lone, "anchor").select("one.key", "anchor", "one.start", "one.n", "contexts")
    settled = cut(sorted_out.unionByName(copied).unionByName(asked))
    drop_cut(docs.sparkSession, found)
    whole = settled.where("contexts = 0").select("key", "start", "n")
    compared = settled.where("contexts > 0")

    def bytes_of(some: DataFrame) -> DataFrame:
        need = some.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("need"))
        return texts.join(need, "key").mapInArrow(_take_bytes(min_bytes), "anchor long, key binary, start int, n int, data binary")

    sharded = bytes_of(compared.where(F.col("contexts") <= hot_contexts)).repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_shards(min_bytes, shard_bytes), "key binary, start int, n int")
    windows = bytes_of(compared.where(F.col("contexts") > hot_contexts)).mapInArrow(_hash_windows(min_bytes), "w1 long, w2 long, key binary, start int")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    hot = windows.join(twice, ["w1", "w2"], "left_semi").select("key", "start", F.lit(1).alias("n"))
    hits = whole.unionByName(sharded).unionByName(hot).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    return texts.join(hits, "key", "left").select("key", "text", "copies", F.coalesce("hits", F.array().cast("array<struct<start:int,n:int>>")).alias("hits")).mapInArrow(_apply(min_bytes, keep_bytes), "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the removal of its repeated 400-byte strings leaves."""
    docs = table(spark, sf_dir, "documents")
    left = suffix_dedup(docs, keep_bytes=False)
    return docs.select("doc_id", _key(F.col("text").cast("string"))).join(left, "key", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
