"""Near-duplicate classes by DartMinHash signatures, banding and exact verification.

Texts become sets of five-word shingles; equal sets are one set from the start.
Signatures of ``bands * rows`` coordinates are cut into bands, and sets that agree
in a band point to the least set there: a star, not all pairs. The components of
these stars, *families*, hold every pair that agrees in any band. Inside a family
the exact similarity decides: sets linked at ``similarity`` or more, directly or
through others, form a class. At 0.8, 24 bands of 4 rows miss a pair with
probability (1 - 0.8**4)**24, 3 in a million, and not if another path links it.

Bands also join sets that are much less alike, so texts of one template could be
one family. A family above ``refine`` sets is therefore cut once more, without
losing a pair: two sets as similar as asked share one of the first shingles of
each, those that remain when a share of ``similarity`` is cut off the end, in
whatever order both are sorted. The order puts shingles that many of the family
have last, so a template's text joins nothing; families are then the components
of shared first shingles.

A family above ``family_limit`` sets is cut into blocks; every two of its blocks
meet in a task of their own, so no task grows with it and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .common import cut, drop_cut, meet, parts, table
from .dart import signatures
from .graph import components


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document, their document, and how often each occurs in it; a text of under k words has one shingle of all its words."""
    starts, ends, first = vec.words(buf, offs)
    word = vec.FIELD.words(buf, starts, ends)
    at, doc = vec.windows(first, k)
    n = np.diff(first)
    short = [np.flatnonzero(n == i) for i in range(1, k)]
    h = np.concatenate([vec.Field.join([g[at] for g in vec.FIELD.grams(word, k)]), *(vec.Field.join(vec.FIELD.at(word, first[d], i + 1)) for i, d in enumerate(short))])
    doc = np.concatenate((doc, *short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[head], doc[head], np.diff(np.append(head, len(h)))


def set_keys(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's weighted set; zero for an empty one."""
    out = np.zeros((2, n), np.uint64)
    head = vec.runs(doc)
    if len(head):
        x = vec.mix(h + weight.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        out[0, doc[head]] = vec.mix(np.add.reduceat(x, head))
        out[1, doc[head]] = vec.mix(np.add.reduceat(vec.mix(x ^ np.uint64(0x1234567)), head))
    return out[0].view(np.int64), out[1].view(np.int64)


def _sign(k: int, bands: int, rows: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in vec.slices(batches, "text"):
            n = part.num_rows
            h, doc, times = shingle_sets(buf, offs, k)
            weight = times if weighted else np.ones(len(times), np.int64)
            k1, k2 = set_keys(h, doc, weight, n)
            sig = signatures(h, weight.astype(float), doc, n, bands * rows).reshape(n, bands, rows)
            key = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                key = vec.mix(key + sig[:, :, r])
            key = vec.mix(key + np.arange(bands, dtype=np.uint64))
            size = np.bincount(doc, minlength=n)
            cut_ = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut_), pa.array(key[size > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("th"), pa.array(k1), pa.array(k2), pa.array(size), lists], names=["rid", "th", "k1", "k2", "shingles", "bands"])

    return run


def _sets(k: int, weighted: bool):
    """Shingle sets of the texts asked for; a text whose set is another (an equal hash) is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in vec.slices(batches, "text"):
            h, doc, times = shingle_sets(buf, offs, k)
            weight = times if weighted else np.ones(len(times), np.int64)
            k1, k2 = set_keys(h, doc, weight, part.num_rows)
            right = (part.column("k1").to_numpy() == k1) & (part.column("k2").to_numpy() == k2)
            cut_ = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [part.column("block"), part.column("k1"), part.column("k2"), pa.ListArray.from_arrays(pa.array(cut_), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(cut_), pa.array(weight.astype(np.int32)))], names=["block", "k1", "k2", "h", "w"]
            )
            yield out.filter(pa.array(right))

    return run


def first_shingles(h: np.ndarray, w: np.ndarray, usual: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set (with counts ``w``) of which it shares one with every set of ``similarity`` or more; those among ``usual`` come last, others by hash.

    Two such sets share at least ``similarity`` of either's total, so no more than
    the rest of it, less one, can come before the first that both have.
    """
    order = np.lexsort((h, np.isin(h, usual)))
    total = int(w.sum())
    most = total - int(np.ceil(similarity * total - 1e-9)) + 1
    before = np.cumsum(w[order]) - w[order]
    return h[order[before < most]]


def _first(similarity: float):
    """First shingles of sets, put together where they are: rows (block, key, u) with the least set of a batch that has the shingle, and rows (block, u, v) that link the batch's other sets to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.array(batch.column("block").to_pylist(), object)
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            sets = zip(batch.column("h"), batch.column("w"), batch.column("usual"), strict=True)
            first = [first_shingles(h.values.to_numpy(), w.values.to_numpy(), u.values.to_numpy() if u.is_valid else np.zeros(0, np.int64), similarity) for h, w, u in sets]
            for name in dict.fromkeys(block):
                rows = np.flatnonzero(block == name)
                rows = rows[np.lexsort((k2[rows], k1[rows]))]
                owner = np.repeat(np.arange(len(rows)), [len(first[i]) for i in rows])
                key = np.concatenate([first[i] for i in rows])
                keys, of = np.unique(key, return_inverse=True)
                least = np.full(len(keys), len(rows))
                np.minimum.at(least, of, owner)
                link = np.unique(np.stack((owner, least[of]), 1), axis=0)
                link = link[link[:, 0] != link[:, 1]]
                n, m = len(keys), len(link)
                u = rows[np.concatenate((least, link[:, 0]))]
                v = rows[link[:, 1]]
                blank = lambda size, t: pa.nulls(size, t)
                cols = [
                    pa.array([name] * (n + m), pa.string()), pa.concat_arrays([pa.array(keys), blank(m, pa.int64())]), pa.array(k1[u]), pa.array(k2[u]),
                    pa.concat_arrays([blank(n, pa.int64()), pa.array(k1[v])]), pa.concat_arrays([blank(n, pa.int64()), pa.array(k2[v])]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "key", "u1", "u2", "v1", "v2"])

    return run


def refined(families: DataFrame, texts: DataFrame, shingle: int, similarity: float, weighted: bool, limit: int, sample: int = 64) -> DataFrame:
    """``families`` (node, label, size, rep) with those above ``limit`` sets cut into components of sets that share a first shingle; a set that shares none goes.

    What many of a family have is told from about ``sample`` of its sets; whatever
    the sample, no pair is lost.
    """
    large = families.where(F.col("size") > limit).select("node", F.concat_ws(":", F.hex("label.k1"), F.hex("label.k2")).alias("block"), "size", "rep.rid", "rep.th")
    if large.isEmpty():
        return families
    need = large.select("rid", "th", "node.k1", "node.k2", "block")
    sets = cut(texts.join(need.hint("merge"), ["rid", "th"]).select("block", "k1", "k2", "text").mapInArrow(_sets(shingle, weighted), "block string, k1 long, k2 long, h array<long>, w array<int>"))
    share = F.least(F.lit(2.0**64) * sample / F.col("size") - F.lit(2.0**63), F.lit(2.0**62)).cast("long")
    drawn = sets.join(large.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "size"), ["k1", "k2"]).where(F.xxhash64("k1", "k2") <= share)
    usual = drawn.select("block", F.explode("h").alias("h")).groupBy("block", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sample // 8)
    usual = cut(usual.groupBy("block").agg(F.collect_list("h").alias("usual")))
    blocks = usual.count()
    known = meet(sets, usual, "block", blocks, "k1", 1000)
    rest = sets.join(F.broadcast(usual.select("block")) if blocks <= 1000 else usual.select("block"), "block", "left_anti").withColumn("usual", F.lit(None).cast("array<long>"))
    kind = "block string, key long, u1 long, u2 long, v1 long, v2 long"
    made = known.select("block", "k1", "k2", "h", "w", "usual").unionByName(rest.select("block", "k1", "k2", "h", "w", "usual")).mapInArrow(_first(similarity), kind)
    pair = lambda c: F.struct(F.col(f"{c}1").alias("k1"), F.col(f"{c}2").alias("k2"))
    made = cut(made.select("block", "key", pair("u").alias("node"), F.when(F.col("v1").isNotNull(), pair("v")).alias("v")))
    slots = made.where("key is not null").select("block", "key", "node")
    bucket = slots.groupBy("block", "key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("times")).where("times > 1").select("block", "key", "v")
    across = slots.join(bucket, ["block", "key"]).where("node != v").select(F.col("node").alias("u"), "v")
    edges = across.unionByName(made.where("key is null").select(F.col("node").alias("u"), "v")).distinct()
    parts_ = components(edges)
    # The shingles are as large as the texts: they go as soon as the components are written.
    drop_cut(families.sparkSession, sets, made, usual)
    sizes = parts_.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    small = families.where(F.col("size") <= limit)
    again = families.where(F.col("size") > limit).select("node", "rep").join(parts_, "node").join(sizes, "label").select("node", "label", "size", "rep")
    return small.select("node", "label", "size", "rep").unionByName(again)


def link_classes(h: np.ndarray, w: np.ndarray, cut_: np.ndarray, similarity: float) -> np.ndarray:
    """Least index of the class of each set: sets are linked at ``similarity``, by a search that compares a set only with those not reached yet."""
    n = len(cut_) - 1
    size = np.add.reduceat(np.append(w, 0), cut_[:-1]) * (np.diff(cut_) > 0)
    owner = np.repeat(np.arange(n), np.diff(cut_))
    _, code = np.unique(h, return_inverse=True)
    order = np.argsort(code, kind="stable")
    label = np.full(n, -1)
    left = n

    def postings():
        keep = order[label[owner[order]] < 0]
        return owner[keep], w[keep], np.searchsorted(code[keep], np.arange(code.max() + 2)) if len(code) else np.zeros(1, np.int64)

    who, how, at = postings()
    built = n
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        left -= 1
        queue = [root]
        while queue and left:
            x = queue.pop()
            mine = slice(cut_[x], cut_[x + 1])
            c, wx = code[mine], w[mine]
            n_at = at[c + 1] - at[c]
            idx = np.repeat(at[c] - (np.cumsum(n_at) - n_at), n_at) + np.arange(int(n_at.sum()))
            y = who[idx]
            both = np.bincount(y, weights=np.minimum(how[idx], np.repeat(wx, n_at)), minlength=n)
            near = np.flatnonzero((both >= similarity * (size + size[x] - both) - 1e-9) & (label < 0) & (both > 0))
            label[near] = root
            left -= len(near)
            queue.extend(near.tolist())
            if left * 2 < built:
                who, how, at = postings()
                built = max(left, 1)
    return label


def _families(similarity: float):
    """One class search for each block, whose rows follow one another."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
        lists, weights = t.column("h").chunk(0), t.column("w").chunk(0)
        cut_ = lists.offsets.to_numpy().astype(np.int64)
        label = link_classes(lists.flatten().to_numpy(), weights.flatten().to_numpy().astype(np.int64), cut_ - cut_[0], similarity)
        return pa.RecordBatch.from_arrays([t.column("block").chunk(0), pa.array(k1), pa.array(k2), pa.array(k1[label]), pa.array(k2[label])], names=["block", "k1", "k2", "c1", "c2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.array(batch.column("block").to_pylist(), object)
            head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for i, j in zip(head, np.append(head[1:], len(block)), strict=True):
                if held and block[i] != last:
                    yield solve(held)
                    held = []
                held.append(batch.slice(int(i), int(j - i)))
                last = block[i]
        if held:
            yield solve(held)

    return run


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 4, weighted: bool = False, family_limit: int = 5000, refine: int = 50) -> DataFrame:
    """``doc_id, th, class_id, n_shingles, class_size, first`` for every row of ``docs``.

    Two texts are linked where the Jaccard similarity of their sets of
    ``shingle`` words is ``similarity`` or more (``weighted``: of their counts); a
    class is what links join and ``class_id`` its least ``doc_id``. Texts with
    the same shingles are always one class. A text of one to ``shingle - 1``
    words is one shingle. A text without words, or null, is a class by itself:
    its ``class_id`` is its own ``doc_id``. Null ids sort first. Several rows
    with one id each get their class. ``th`` is the hash of the text; ``first``
    marks the rows of the class's least id and, among its texts, least hash. An
    empty table gives no rows.
    """
    none = -(2**63)
    one = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows_ = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(none)).alias("rid"), F.xxhash64(one).alias("th"), one.alias("text"))
    signed = cut(rows_.mapInArrow(_sign(shingle, bands, rows, weighted), "rid long, th long, k1 long, k2 long, shingles long, bands array<long>"))
    reps = signed.where("shingles > 0").groupBy("k1", "k2").agg(F.min(F.struct("rid", "th")).alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    node = F.struct("k1", "k2").alias("node")
    slots = reps.select(node, F.posexplode("bands").alias("band", "key"))
    bucket = slots.groupBy("band", "key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("times")).where("times > 1").select("band", "key", "v")
    edges = slots.join(bucket, ["band", "key"]).where("node != v").select(F.col("node").alias("u"), "v").distinct()
    families = components(edges)
    size = families.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    placed = families.join(size, "label").join(reps.select(node, "rep"), "node").select("node", "label", "size", "rep")
    told = cut(placed)
    placed = cut(refined(told, rows_, shingle, similarity, weighted, refine))
    drop_cut(docs.sparkSession, told)
    placed = placed.withColumn("n_blocks", F.ceil(F.col("size") / family_limit).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    # Block pairs (i, j), i <= j, of a large family: a set goes to each pair with its own block.
    meets = F.when(F.col("n_blocks") <= 1, F.array(F.lit("0"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.concat_ws("-", F.least(own, j), F.greatest(own, j))))
    need = placed.select("rep.rid", "rep.th", "node.k1", "node.k2", F.explode(meets).alias("pair"), "label").select("rid", "th", "k1", "k2", F.concat_ws(":", F.hex("label.k1"), F.hex("label.k2"), "pair").alias("block"))
    # Texts meet what is asked of them by shuffle at every size, as neither side has a bound.
    sets = rows_.join(need.hint("merge"), ["rid", "th"]).select("block", "k1", "k2", "text").mapInArrow(_sets(shingle, weighted), "block string, k1 long, k2 long, h array<long>, w array<int>")
    found = cut(sets.repartition(parts(docs), "block").sortWithinPartitions("block").mapInArrow(_families(similarity), "block string, k1 long, k2 long, c1 long, c2 long"))
    links = found.where("c1 != k1 or c2 != k2").select(node, F.struct(F.col("c1").alias("k1"), F.col("c2").alias("k2")).alias("label"))
    if not found.where("block like '%-%'").isEmpty():
        links = components(links.select(F.col("node").alias("u"), F.col("label").alias("v")))
    classes = reps.select(node, "rep", "copies").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("rep").alias("head"), F.sum("copies").alias("class_size"))
    by_set = classes.join(least, "label").select("node.k1", "node.k2", "head", "class_size")
    seen = F.when(F.col("rid") != none, F.col("rid"))
    head = F.when(F.col("head.rid") != none, F.col("head.rid"))
    return (
        signed.where("shingles > 0")
        .join(by_set, ["k1", "k2"])
        .select(seen.alias("doc_id"), "th", head.alias("class_id"), F.col("shingles").alias("n_shingles"), "class_size", ((F.col("head.rid") == F.col("rid")) & (F.col("head.th") == F.col("th"))).alias("first"))
        .union(signed.where("shingles = 0").select(seen, "th", seen, F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(True)))
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates, shingles weighted by how often a text has them.

    Null texts and texts without words are classes of their own; see
    ``near_duplicates``.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), weighted=True).drop("th", "first")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g, count(*) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n, sum(k) AS total FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.k, b.k)) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared >= 0.8 * (a.total + b.total - shared) - 1e-9),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, min(r.y) AS class_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, count(DISTINCT r.y) AS class_size
FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""
