"""Removal of repeated word windows behind a count-min prefilter.

Texts are dealt into chunks by the hash of their text. Pass one: each chunk
counts its windows of ``size`` words in a count-min sketch of its own and sends
each block of the sketch the cells it filled; a block adds what all chunks sent
and answers each of them, one bit a cell, which cells count twice or more. An
estimate is never too low, so no repeated window is lost. Pass two: each chunk
sends only windows that the sketch estimates repeated, once each with the least
document that has it there, to the bucket of the window's hash; a bucket finds,
exactly, the least document of all and answers one bit a window, whether it is
another chunk's. Pass three applies the answers to the texts.

The sketch is sized from the input, and neither it nor anything else is
gathered in one place: cells and windows are tested where their block lives. A
chunk sends a window once however many of its documents hold it, so a window
that is everywhere costs its bucket one entry a chunk. Windows are told apart by
124 bits of two independent hashes over a prime field.

Blocks become more with the input, the rows a chunk sends do not: it addresses
them by the first ``HOP`` bits of a block's number only. Where there are more
blocks, rows of as many chunks with one address meet in a task, which merges them
and sends them on by ``HOP`` bits more, and so on down to blocks; answers come back
the same way. So rows grow in proportion to the input, as does what a task holds
of them not at all, and hops are as many as the logarithm of the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .common import cut, parts, table, text_key

DEPTH = 2
CHUNK_BYTES = 8 << 20
BLOCK = 1 << 24
_SALTS = [np.uint64(r * 0x632BE59BD9B4E019 % 2**64) for r in range(DEPTH)]
_TEXTS = "chunk int, key binary, doc_id long, text string"
_SENT = "chunk int, block int, body binary"
#: Bits of a hop: a chunk sends at most 2**HOP rows of cells, or of windows, however many blocks there are.
HOP = 10


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of one text in a task the first keeps the text; a later one stays without it, if its id is less."""
    least: dict[bytes, int] = {}
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
        if len(least) > 200_000:
            least.clear()
        keep, bare = [], np.zeros(batch.num_rows, bool)
        for i, (k, d) in enumerate(zip(keys, ids, strict=True)):
            had = least.get(k)
            if had is None or d < had:
                bare[i] = had is not None
                least[k] = d
                keep.append(i)
        out = batch.take(pa.array(keep, pa.int64()))
        if bare.any():
            text = pa.compute.if_else(pa.array(bare[keep]), pa.scalar(None, pa.string()), out.column("text"))
            out = out.set_column(out.schema.get_field_index("text"), "text", text)
        yield out


class Chunk:
    """The different texts of a chunk, each with the least id of its rows, and their windows."""

    def __init__(self, rows: pa.Table, size: int):
        ids = rows.column("doc_id").to_numpy()
        key = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint64).reshape(-1, 2)
        bare = rows.column("text").is_null().to_numpy()
        order = np.lexsort((bare, key[:, 1], key[:, 0]))
        k = key[order]
        head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1))) if len(k) else np.zeros(0, np.int64)
        self.doc_id = np.minimum.reduceat(ids[order], head) if len(head) else ids[:0]
        pick = pa.array(order[head])
        self.key = rows.column("key").take(pick).combine_chunks()
        self.buf, self.offs = vec.flat(_one(rows.column("text").take(pick)))
        self.starts, self.ends, self.first = vec.words(self.buf, self.offs)
        self.at, doc = vec.windows(self.first, size)
        self.doc, self.size = self.doc_id[doc] if len(doc) else np.zeros(0, np.int64), size
        self.text_of = doc

    def group(self, second: bool) -> None:
        """Sort the windows: ``lead`` is each different one's first place in ``order``, ``a`` (and ``b``) its hashes, ``least`` its least document, ``many`` whether it has others."""
        which = vec.Field.FIRST + vec.Field.SECOND if second else vec.Field.FIRST
        word = vec.FIELD.words(self.buf, self.starts, self.ends, which)
        gram = [g[self.at] for g in vec.FIELD.grams(word, self.size, which)]
        a = vec.Field.join(gram[:2])
        b = vec.Field.join(gram[2:]) if second else None
        order = np.argsort(a)
        s = a[order]
        fresh = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        if second:
            t = b[order]
            if len(s) and (~fresh[1:] & (t[1:] != t[:-1])).any():
                # Two windows agree in the first hash.
                order = np.lexsort((b, a))
                s, t = a[order], b[order]
                fresh = np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))
            self.b = t[fresh]
        self.order, self.lead, self.a = order, np.flatnonzero(fresh), s[fresh]
        self.fresh = fresh
        doc = self.doc[order]
        self.least = np.minimum.reduceat(doc, self.lead) if len(doc) else doc
        self.many = (np.maximum.reduceat(doc, self.lead) if len(doc) else doc) > self.least

    def cells(self, row: int, width: int) -> np.ndarray:
        """The cell of each different window in a row of the sketch."""
        return (vec.mix(self.a + _SALTS[row]) >> np.uint64(64 - width)).astype(np.int64)


def _one(column: pa.ChunkedArray) -> pa.Array:
    got = column.combine_chunks()
    return got if not isinstance(got, pa.ChunkedArray) else got.chunk(0) if got.num_chunks else pa.array([], column.type)


_GAPS = ("<u2", "<u4", "<u8")


def _pack(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Ascending cells as their gaps, with a bit each."""
    gap = np.diff(cells, prepend=0)
    most = int(gap.max())
    kind = 0 if most < 1 << 16 else 1 if most < 1 << 32 else 2
    return bytes([kind]) + np.packbits(twice).tobytes() + gap.astype(_GAPS[kind]).tobytes()


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind, rest = body[0], len(body) - 1
    n = rest * 8 // (1 + (16 << kind))
    bits = (n + 7) // 8
    twice = np.unpackbits(np.frombuffer(body, np.uint8, bits, 1), count=n)
    return np.cumsum(np.frombuffer(body, _GAPS[kind], n, 1 + bits), dtype=np.int64), twice


def _sent(chunk: int, block: list[int], body: list[bytes]) -> pa.Table:
    return pa.table([pa.array(np.full(len(block), chunk, np.int32)), pa.array(block, pa.int32()), pa.array(body, pa.binary())], names=["chunk", "block", "body"])


def _number(rows: pa.Table, name: str = "chunk") -> int:
    return rows.column(name)[0].as_py()


def hops(bits: int, hop: int = HOP) -> list[int]:
    """How many leading bits of a block's number a row's address has, at each hop on the way to the block."""
    return [*range(hop, bits, hop), bits]


def _count(size: int, width: int, address: int):
    """Pass one: the cells a chunk fills, by the first ``address`` bits of their place in the sketch, with a bit for those filled twice."""
    low = width + (DEPTH - 1).bit_length() - address

    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(rows, size)
        c.group(False)
        names, bodies = [], []
        for r in range(DEPTH):
            cell = c.cells(r, width) + (r << width)
            order = np.argsort(cell)
            s = cell[order]
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
            twice = np.add.reduceat(c.many[order].astype(np.int64) + 1, head) > 1 if len(s) else head
            s = s[head]
            for i, j in zip(*vec.stretches(s >> low), strict=True):
                names.append(int(s[i]) >> low)
                bodies.append(_pack(s[i:j] & ((1 << low) - 1), twice[i:j]))
        vec.release()
        return _sent(_number(rows), names, bodies)

    return run


def _together(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The cells of each row, and those of all rows with whether they count twice."""
    each = [_unpack(body.as_py()) for body in rows.column("body")]
    cells, times = np.concatenate([c for c, _ in each]), np.concatenate([t for _, t in each]).astype(np.int64) + 1
    all_, of = np.unique(cells, return_inverse=True)
    return [c for c, _ in each], all_, np.bincount(of, weights=times, minlength=len(all_)) > 1


def _merge(hop: int, before: int, after: int, rest: int):
    """A hop of pass one: the cells of up to 2**``hop`` senders become one sender's, addressed by ``after`` bits instead of ``before``; ``rest`` bits of a place are not in the address yet."""
    low = rest - (after - before)

    def run(rows: pa.Table) -> pa.Table:
        _, cells, twice = _together(rows)
        group = _number(rows, "block")
        names, bodies = [], []
        for i, j in zip(*vec.stretches(cells >> low), strict=True):
            names.append((group << (after - before)) + (int(cells[i]) >> low))
            bodies.append(_pack(cells[i:j] & ((1 << low) - 1), twice[i:j]))
        return _sent(_number(rows) >> hop, names, bodies)

    return run


def _expand(before: int, after: int, rest: int):
    """The same hop back: of what was answered to all senders together, each one's bits."""
    low = rest - (after - before)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent(0, [], [])
        each, cells, _ = _together(rows)
        group, got = _number(rows, "block"), _answers(answers)
        bits = np.zeros(len(cells), np.uint8)
        for i, j in zip(*vec.stretches(cells >> low), strict=True):
            bits[i:j] = np.unpackbits(got[(group << (after - before)) + (int(cells[i]) >> low)], count=j - i)
        return pa.table([rows.column("chunk"), rows.column("block"), pa.array([np.packbits(bits[np.searchsorted(cells, c)]).tobytes() for c in each], pa.binary())], names=["chunk", "block", "body"])

    return run


def _add(block: int):
    """A block of the sketch: add all chunks' cells, answer each with the bits of those that reach two."""

    def run(rows: pa.Table) -> pa.Table:
        count = np.zeros(block, np.uint8)
        bodies = rows.column("body")
        for body in bodies:
            cells, twice = _unpack(body.as_py())
            count[cells] = np.minimum(count[cells] + 1 + twice, 2)
        answer = [np.packbits(count[_unpack(body.as_py())[0]] > 1).tobytes() for body in bodies]
        return pa.table([rows.column("chunk"), rows.column("block"), pa.array(answer, pa.binary())], names=["chunk", "block", "body"])

    return run


def _answers(rows: pa.Table) -> dict[int, np.ndarray]:
    return {b: np.frombuffer(x, np.uint8) for b, x in zip(rows.column("block").to_pylist(), rows.column("body").to_pylist(), strict=True)}


def _estimated(c: Chunk, bits: dict[int, np.ndarray], width: int, address: int) -> np.ndarray:
    """Which different windows of a chunk the sketch estimates repeated."""
    low = width + (DEPTH - 1).bit_length() - address
    hit = np.ones(len(c.a), bool)
    for r in range(DEPTH):
        got, back = np.unique(c.cells(r, width) + (r << width), return_inverse=True)
        mask = np.zeros(len(got), bool)
        for i, j in zip(*vec.stretches(got >> low), strict=True):
            mask[i:j] = np.unpackbits(bits[int(got[i]) >> low], count=j - i)
        hit &= mask[back]
    return hit


def _buckets(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading bits, first and last of the slices of ascending hashes."""
    of = (a >> np.uint64(64 - bits)).astype(np.int64)
    i, j = vec.stretches(of)
    return of[i], i, j


def _ask(size: int, width: int, address: int, bits: int):
    """Pass two: windows estimated repeated, by their first ``bits``, as hashes and the least document of the chunk."""

    def run(texts: pa.Table, sketch: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _sent(0, [], [])
        c = Chunk(texts, size)
        c.group(True)
        hit = np.flatnonzero(_estimated(c, _answers(sketch), width, address))
        code = np.stack((c.a[hit].view(np.int64), c.b[hit].view(np.int64), c.least[hit]), axis=1)
        name, i, j = _buckets(c.a[hit], bits)
        vec.release()
        return _sent(_number(texts), name.tolist(), [code[x:y].tobytes() for x, y in zip(i, j, strict=True)])

    return run


def _asked(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Bodies, their windows (hashes and document, in order), the order of hashes and each one's first place in it."""
    bodies = rows.column("body").to_pylist()
    code = np.frombuffer(b"".join(bodies), np.int64).reshape(-1, 3)
    a, b = code[:, 0].view(np.uint64), code[:, 1]
    order = np.lexsort((b, a))
    fresh = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    return bodies, code, order, fresh


def _later(bodies: list[bytes], code: np.ndarray, order: np.ndarray, fresh: np.ndarray, more: np.ndarray | None = None) -> list[bytes]:
    """Of each body's windows whether another has a lesser document, one bit each; ``more`` tells it of those that are elsewhere."""
    doc = code[order, 2]
    of = np.cumsum(fresh) - 1
    later = np.zeros(len(code), bool)
    later[order] = doc > np.minimum.reduceat(doc, np.flatnonzero(fresh))[of]
    if more is not None:
        later[order] |= more[of]
    cut = np.append(0, np.cumsum([len(x) // 24 for x in bodies]))
    return [np.packbits(later[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _settle(rows: pa.Table) -> pa.Table:
    """A bucket: of each window whether another chunk has a lesser document."""
    return pa.table([rows.column("chunk"), rows.column("block"), pa.array(_later(*_asked(rows)), pa.binary())], names=["chunk", "block", "body"])


def _merge_asked(hop: int, after: int):
    """A hop of pass two: each window of up to 2**``hop`` senders once, with the least of their documents."""

    def run(rows: pa.Table) -> pa.Table:
        _, code, order, fresh = _asked(rows)
        one = code[order][fresh]
        one[:, 2] = np.minimum.reduceat(code[order, 2], np.flatnonzero(fresh))
        name, i, j = _buckets(one[:, 0].view(np.uint64), after)
        return _sent(_number(rows) >> hop, name.tolist(), [one[x:y].tobytes() for x, y in zip(i, j, strict=True)])

    return run


def _expand_asked(after: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent(0, [], [])
        bodies, code, order, fresh = _asked(rows)
        a, got = code[order, 0][fresh].view(np.uint64), _answers(answers)
        more = np.zeros(len(a), bool)
        for name, i, j in zip(*_buckets(a, after), strict=True):
            more[i:j] = np.unpackbits(got[int(name)], count=j - i)
        return pa.table([rows.column("chunk"), rows.column("block"), pa.array(_later(bodies, code, order, fresh, more), pa.binary())], names=["chunk", "block", "body"])

    return run


_LEFT = "key binary, first_id long, n_words long, n_removed long, kept_sha256 string"


def _apply(size: int, width: int, address: int, bits: int, keep: bool):
    """Pass three: cover the windows of lesser documents, digest the words left."""
    names = ["key", "first_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep else [])]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep else [])]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        c = Chunk(texts, size)
        c.group(True)
        exact = answers.column("exact").to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(_estimated(c, _answers(answers.filter(pa.array(~exact))), width, address))
        other = _answers(answers.filter(pa.array(exact)))
        elsewhere = np.zeros(len(c.a), bool)
        for name, i, j in zip(*_buckets(c.a[hit], bits), strict=True):
            elsewhere[hit[i:j]] = np.unpackbits(other[int(name)], count=j - i)
        of = np.cumsum(c.fresh) - 1
        gone = np.zeros(len(c.at), bool)
        gone[c.order] = elsewhere[of] | (c.doc[c.order] > c.least[of])
        at = c.at[gone]
        s, e = vec.spans(at, np.full(len(at), size))
        marks = np.zeros(len(c.starts) + 1, np.int8)
        marks[s] += 1
        marks[e] -= 1
        cover = np.cumsum(marks[:-1], dtype=np.int8) > 0
        n, removed = np.diff(c.first), np.diff(np.append(0, np.cumsum(cover, dtype=np.int64))[c.first])
        digest, kept = [], []
        view = memoryview(c.buf)
        for i in range(len(n)):
            mine = slice(c.first[i], c.first[i + 1])
            left = ~cover[mine]
            text = b" ".join([view[x:y] for x, y in zip(c.starts[mine][left].tolist(), c.ends[mine][left].tolist(), strict=True)])
            digest.append(hashlib.sha256(text).hexdigest())
            if keep:
                kept.append(text)
        vec.release()
        return pa.table([c.key, pa.array(c.doc_id), pa.array(n), pa.array(removed), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if keep else [])], names=names)

    return run


def _key(text: Column) -> Column:
    return F.substring(text_key(text), 1, 16).alias("key")


def window_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 13, chunk_bytes: int = CHUNK_BYTES, width: int | None = None, keep: bool = True, hop: int = HOP) -> DataFrame:
    """Words of every different text of ``docs`` that no window shared with an earlier document covers.

    A window is ``size`` consecutive words of one document; it goes wherever its
    word sequence also starts in a document with a smaller ``doc_id``. A null id
    counts as larger than any other, equal ids as one document. Of rows with the
    same text, all but those of the least id lose every word (texts under
    ``size`` words have no window and lose none). Null is the empty text; a very
    long text is a chunk of its own weight and is processed whole. Other columns
    are not read, so their names cannot clash.
    Returns key (128 bits of the text's SHA-256), first_id (the least id with that text),
    n_words, n_removed, kept_sha256 and, if ``keep``, kept (bytes, words joined by
    one space); an empty table gives no rows. A row of the sketch has
    2**``width`` cells, by default four or more a window of the input.
    """
    top = F.lit(2**63 - 1)
    one = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = parts(docs)
    total = docs.agg(F.sum(F.octet_length(one))).first()[0] or 0
    chunks = max(n, -(-total // chunk_bytes))
    # Partitions grow with the input too, so that a task has a few chunks however many there are.
    n = max(n, -(-chunks // 4))
    if width is None:
        width = max(10, int(4 * total / 6).bit_length())
    # Enough blocks and buckets for every task, and none larger than BLOCK cells.
    bits = min(max((n - 1).bit_length(), width - (BLOCK.bit_length() - 1), 1), width)
    last = width + (DEPTH - 1).bit_length()
    way, asked_way = hops(bits + last - width, hop), hops(bits, hop)
    block = 1 << (width - bits)
    rows = docs.select(_key(one), F.coalesce(F.col(doc_id).cast("long"), top).alias("doc_id"), one.alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int").alias("chunk"), "key", "doc_id", "text")
    texts = rows.mapInArrow(_combine, _TEXTS).repartition(n, "chunk")

    def by(sent: DataFrame, key: str) -> DataFrame:
        return sent.repartition(n, key)

    def there_and_back(sent: DataFrame, way: list[int], merge, settle, expand) -> DataFrame:
        """What blocks answer to the rows ``sent`` by the first bits of ``way``."""
        node = lambda sender, address: (F.col(sender).cast("long") * (1 << 32) + address).alias("node")
        stages = []
        for before, after in zip(way[:-1], way[1:], strict=True):
            sent = cut(sent)
            stages.append((sent, before, after))
            met = by(sent.withColumn("sender", F.shiftright("chunk", hop)).select("*", node("sender", F.col("block"))).drop("sender"), "node")
            sent = met.groupBy("node").applyInArrow(merge(before, after), _SENT)
        back = by(sent, "block").groupBy("block").applyInArrow(settle, _SENT)
        for sent, before, after in reversed(stages):
            given = by(sent.withColumn("sender", F.shiftright("chunk", hop)).select("*", node("sender", F.col("block"))).drop("sender"), "node")
            answers = by(back.select("*", node("chunk", F.shiftright("block", after - before))), "node")
            back = given.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(expand(before, after), _SENT)
        return back

    counted = texts.groupBy("chunk").applyInArrow(_count(size, width, way[0]), _SENT)
    sketch = there_and_back(counted, way, lambda i, j: _merge(hop, i, j, last - i), _add(block), lambda i, j: _expand(i, j, last - i))
    asked = texts.groupBy("chunk").cogroup(by(sketch, "chunk").groupBy("chunk")).applyInArrow(_ask(size, width, way[0], asked_way[0]), _SENT)
    settled = there_and_back(asked, asked_way, lambda i, j: _merge_asked(hop, j), _settle, lambda i, j: _expand_asked(j))
    answers = by(sketch.withColumn("exact", F.lit(False)).unionByName(settled.withColumn("exact", F.lit(True))), "chunk")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_apply(size, width, way[0], asked_way[0], keep), _LEFT + ", kept binary" * keep)


def op8_countmin_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the removal of 13-word windows of earlier documents leaves.

    Null texts are empty, null ids later than all others, copies after the least
    id lose all words; see ``window_dedup``.
    """
    return window_dedup_rows(table(spark, sf_dir, "documents"), keep=False)


def window_dedup_rows(docs: DataFrame, size: int = 13, keep: bool = True, **options) -> DataFrame:
    """``window_dedup`` by row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if ``keep``, kept."""
    top = F.lit(2**63 - 1)
    rows = docs.select("doc_id", _key(F.col("text").cast("string")))
    left = window_dedup(docs, size=size, keep=keep, **options)
    copy = (F.coalesce(F.col("doc_id").cast("long"), top) > F.col("first_id")) & (F.col("n_words") >= size)
    return rows.join(left, "key").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep else []),
    )


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(ws, i, i + 12), ' ')) AS first_id FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM v WHERE first_id < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM w)
SELECT w.doc_id, any_value(len(w.ws)) AS n_words, count(gone.k) AS n_removed,
  sha256(coalesce(string_agg(word.x, ' ' ORDER BY word.k) FILTER (gone.k IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN word ON word.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY w.doc_id
"""
