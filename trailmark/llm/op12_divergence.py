"""Source divergence audit: how the sources of a language differ in what words they use.

Terms are counted where the texts are. The counts, a row for each language, source
and term, are sorted by language and term over the tasks; each task encodes its
stretch in chunks: a chunk is the sorted array of its kept terms, ids are places in it
(``searchsorted``), and a source's counts are a dense vector (``bincount`` of ids).
Stretches follow one another, so ids keep the UTF-8 order of terms through chunks,
tasks and all: ties between terms are ties between numbers. Divergences are sums over
chunks of whole-number terms, so they don't depend on how the chunks were cut.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, meet, parts, table

LEAST_DOCS = 10
TOP = 10
ONE = 1_000_000_000
#: Terms that a counting task holds before it passes them on, rows of counts in a chunk, and cells of its dense vectors.
HELD = 400_000
ROWS = 65_536
CELLS = 1 << 20
#: Bytes of a text that are cut into words at once.
PIECE = 4 << 20

_LOWER = bytes(32 if b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = frozenset(b for b in range(256) if _LOWER[b] == 32)


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of whole terms."""
    at = 0
    while len(text) - at > PIECE:
        to = at + PIECE
        while to < len(text) and text[to] not in _SPACE:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of each term by language and source."""
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    times: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in times.items():
            terms = list(n)
            in_docs = docs[lang, source]
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                same = lambda v, k=len(some): pa.array([v], pa.string()).take(pa.array(np.zeros(k, np.int32)))
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(some, pa.binary()).cast(pa.string()), pa.array([in_docs[t] for t in some], pa.int64()), pa.array([n[t] for t in some], pa.int64())], names=["lang", "source", "term", "docs", "n"])
        docs.clear()
        times.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            own: set[bytes] = set()
            for piece in pieces(text):
                found = piece.translate(_LOWER).split()
                times[lang, source].update(found)
                own.update(found)
            docs[lang, source].update(own)
        if sum(map(len, times.values())) > HELD:
            yield from give()
    yield from give()


def _encode(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of language, term, source; whole terms are encoded, the last one waits for the next batch."""
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        seen = 0
        held: list[pa.RecordBatch] = []

        def chunk(lang: str, terms: np.ndarray, sources: np.ndarray, docs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal seen
            head = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
            known = terms[head][np.add.reduceat(docs, head) >= least_docs]
            names, of = np.unique(sources, return_inverse=True)
            step = max(1, CELLS // len(names))
            for at in range(0, len(known), step):
                kept = known[at : at + step]
                ids = np.minimum(np.searchsorted(kept, terms), len(kept) - 1)
                is_in = kept[ids] == terms
                some = np.unique(of[is_in])
                dense = [np.bincount(ids[own], weights=n[own], minlength=len(kept)).astype(np.int64) for s in some for own in [is_in & (of == s)]]
                groups = [{"source": names[s], "n": int(v.sum()), "counts": v.tobytes()} for s, v in zip(some, dense, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([first + seen], pa.int64()), pa.array([[t.decode() for t in kept]], pa.list_(pa.string())), pa.array([groups], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64()), ("counts", pa.binary())])))],
                    names=["lang", "first", "terms", "groups"],
                )
                seen += len(kept)

        def encode(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            lang = np.array(t.column("lang").to_pylist(), object)
            terms = np.array(t.column("term").cast(pa.binary()).to_pylist(), object)
            sources = np.array(t.column("source").to_pylist(), object)
            docs, n = t.column("docs").to_numpy(), t.column("n").to_numpy()
            new = np.append(True, (lang[1:] != lang[:-1]) | (terms[1:] != terms[:-1]))
            end = len(terms) if last else int(np.flatnonzero(new)[-1])
            if end < len(terms):
                held.extend(t.slice(end).to_batches())
            starts = np.flatnonzero(np.append(True, lang[1:end] != lang[: end - 1])) if end else np.zeros(0, int)
            for lo, hi in zip(starts, np.append(starts[1:], end), strict=True):
                yield from chunk(lang[lo], terms[lo:hi], sources[lo:hi], docs[lo:hi], n[lo:hi])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from encode(False)
        if held:
            yield from encode(True)

    return run


def share(count: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 v)), three digits after three so that nothing leaves 64 bits."""
    of = total + 2 * v
    rest = count.astype(np.int64) + 2
    out, rest = rest // of, rest % of
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _compare(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums for pairs of sources, and each chunk's best terms of each source."""
        sums: dict[str, tuple[list[str], np.ndarray]] = {}

        def rows(part: str, lang: list, source: list, item: list, id_: list, value: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([part] * len(lang), pa.string()), pa.array(item, pa.string()), pa.array(id_, pa.int64()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "id", "value"])

        def give() -> Iterator[pa.RecordBatch]:
            for lang, (names, total) in sums.items():
                for i in range(len(names) - 1):
                    k = len(names) - i - 1
                    yield rows("pair", [lang] * k, [names[i]] * k, names[i + 1 :], [None] * k, total[i, i + 1 :].tolist())
            sums.clear()

        for batch in batches:
            for c in batch.to_pylist():
                names, v = c["sources"], len(c["terms"])
                place = {s: i for i, s in enumerate(names)}
                count = np.zeros((len(names), v), np.int64)
                for g in c["groups"]:
                    count[place[g["source"]]] = np.frombuffer(g["counts"], np.int64)
                p = np.stack([share(x, n, c["v"]) for x, n in zip(count, c["totals"], strict=True)])
                q = share(count.sum(0), c["total"], c["v"])
                if c["lang"] not in sums:
                    sums[c["lang"]] = names, np.zeros((len(names), len(names)), np.int64)
                total = sums[c["lang"]][1]
                block = max(1, CELLS // v)
                for i in range(len(names) - 1):
                    for j in range(i + 1, len(names), block):
                        total[i, j : j + block] += divergence(p[i], p[j : j + block]).sum(1)
                for i, s in enumerate(names):
                    may = np.flatnonzero((count[i] > 0) & (p[i] > q))
                    value = divergence(p[i][may], q[may])
                    best = np.lexsort((may, -value))[:top]
                    k = len(best)
                    if k:
                        yield rows("term", [c["lang"]] * k, [s] * k, [c["terms"][t] for t in may[best]], (c["first"] + may[best]).tolist(), value[best].tolist())
                if sum(t.size for _, t in sums.values()) > 4 * CELLS:
                    yield from give()
        yield from give()

    return run


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) there is.

    Part ``pair``: every other source of the language and how far it is, all ranks.
    Part ``term``: the ``top`` kept terms that the source uses most above its
    language. A term is kept in a language if ``least_docs`` of its documents hold
    it. Null text, language and source are empty strings; a source without terms
    has pairs and no terms; a language without kept terms has pairs of value 0.
    Repeated rows count each; ties go to the item that is first in UTF-8. Texts are
    counted whole, in pieces; an empty table gives no rows. Only the three named
    columns are read, so others may have any name.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    counted = given.mapInArrow(_count, "lang string, source string, term string, docs long, n long")
    counts = cut(counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    ordered = counts.repartitionByRange(parts(docs), "lang", "term").sortWithinPartitions("lang", "term", "source")
    kind = "lang string, first long, terms array<string>, groups array<struct<source:string,n:long,counts:binary>>"
    chunks = cut(ordered.mapInArrow(_encode(least_docs), kind))
    # Of each language: its sources in order with their totals, and its number of terms.
    totals = chunks.select("lang", F.explode("groups").alias("g")).groupBy("lang", F.col("g.source").alias("source")).agg(F.sum("g.n").alias("n"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    groups = cut(given.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"), F.sum("n").alias("total"))
    known = cut(listed.join(sizes, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("totals"), "total", F.coalesce("v", F.lit(0)).alias("v")))
    found = cut(meet(chunks, known, "lang", groups.count(), "first").select("lang", "first", "terms", "groups", "sources", "totals", "total", "v").mapInArrow(_compare(top), "lang string, source string, part string, item string, id long, value long"))
    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = known.where("v = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).where("source < item")
    both = half.unionByName(bare).select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), "value")
    pairs = both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id"))).where(F.col("rank") <= top)
    return pairs.unionByName(terms.drop("id"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; see ``source_divergence``."""
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, (1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p FROM x JOIN v USING (lang)),
y AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY ALL),
q AS (SELECT lang, term, (1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q FROM y JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value, (row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source))::INTEGER AS rank FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM t QUALIFY rank <= 10"""
