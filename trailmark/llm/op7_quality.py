"""Quality rules as a short-circuit cascade ordered by rejection per cost.

On a bounded sample every rule runs on every text, which gives its cost a byte,
beyond the signals that are owed for all texts anyway, and its selectivity. Rules are then tried in order of rejections per cost, each
only on texts no earlier rule rejected. The order changes the time, never the
verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .common import by_place, table

SAMPLE_ROWS = 512
SYMBOLS = b"#*$%&|<>"
RUN = 8
_LUT = np.zeros(256, bool)
_LUT[list(SYMBOLS)] = True


def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of items by (document, hash), and where a new pair begins in it."""
    order = np.lexsort((h, doc))
    k, d = h[order], doc[order]
    return order, np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.zeros(0, bool)


class Signals:
    """Counts of a slice of texts, each computed when first asked for."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[self.offs])

    @cached_property
    def words(self):
        return vec.words(self.buf, self.offs)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._per_text(~vec.separators(self.buf) & ((self.buf & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(_LUT[self.buf])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its lines with a word, and those among them equal to an earlier one."""
        feeds = np.flatnonzero(self.buf == 10)
        # Every line feed ends a line and begins the next, every text begins one and ends one; in order they pair up.
        starts = np.sort(np.append(self.offs[:-1], feeds + 1))
        ends = np.sort(np.append(self.offs[1:], feeds))
        # Empty lines have no word.
        first = np.searchsorted(self.words[0], starts)
        full = np.flatnonzero((ends > starts) & (first < np.searchsorted(self.words[0], ends)))
        starts, ends = starts[full], ends[full]
        doc = np.searchsorted(self.offs, starts, side="right") - 1
        order, head = _repeats(vec.Field.join(vec.FIELD.words(self.buf, starts, ends)), doc)
        return np.bincount(doc, minlength=self.n), np.bincount(doc[order[~head]], minlength=self.n)

    @cached_property
    def word_hashes(self) -> list[np.ndarray]:
        return vec.FIELD.words(self.buf, self.words[0], self.words[1])

    @cached_property
    def n_cut_lines(self) -> np.ndarray:
        """Lines with a word that end in three full stops, before any white space."""
        starts, ends, first = self.words
        stop = self.buf == 0x2E
        three = np.zeros(len(self.buf) + 1, bool)
        three[3:] = stop[2:] & stop[1:-1] & stop[:-2]
        feed = np.append(0, np.cumsum(self.buf == 10))
        last = np.ones(len(starts), bool)
        if len(starts):
            # The last word of its line: the next one lies behind a line feed or in another text.
            last[:-1] = feed[starts[1:]] > feed[ends[:-1]]
            last[first[1:][np.diff(first) > 0] - 1] = True
        hit = last & three[ends] & (ends - starts >= 3)
        return np.diff(np.append(0, np.cumsum(hit, dtype=np.int64))[first])

    @cached_property
    def longest_word(self) -> np.ndarray:
        """Code points of each text's longest word."""
        starts, ends, first = self.words
        points = np.append(0, np.cumsum((self.buf & 0xC0) != 0x80, dtype=np.int64))
        out = np.zeros(self.n, np.int64)
        np.maximum.at(out, np.repeat(np.arange(self.n), np.diff(first)), points[ends] - points[starts])
        return out

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self.words
        at, doc = vec.windows(first, RUN)
        if not len(at):
            return np.zeros(self.n, np.int64)
        order, head = _repeats(vec.Field.join([g[at] for g in vec.FIELD.grams(self.word_hashes, RUN)]), doc)
        group = np.cumsum(head) - 1
        twice = order[np.bincount(group)[group] > 1]
        cover = vec.marked(at[twice], np.full(len(twice), RUN), len(starts))
        return np.diff(np.append(0, np.cumsum(cover, dtype=np.int64))[first])


Rule = tuple[str, Callable[[Signals], np.ndarray]]
#: The query's base rules, fixed by its contract, and the method's own: those of the last two need signals that only texts still in the running pay for.
BASE: list[Rule] = [
    ("few_words", lambda s: s.n_words < 20),
    ("repeated_words", lambda s: 100 * s.n_repeat_words > 30 * s.n_words),
]
OWN: list[Rule] = [
    ("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    ("duplicate_lines", lambda s: 100 * s.n_dup_lines > 30 * s.lines[0]),
    ("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words)),
    ("cut_lines", lambda s: 100 * s.n_cut_lines > 30 * s.lines[0]),
    ("endless_word", lambda s: s.longest_word > 1000),
]


def _measure(rules: list[Rule], asked: tuple[str, ...]):
    """Of each rule, alone and on every text of a task: seconds, bytes, texts, texts rejected.

    The ``asked`` signals are owed for every text whatever the order, so a rule
    that looks at them only costs next to nothing; what else it needs it pays for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, bad, texts, size = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0, 0
        for part, buf, offs in vec.slices(batches, "text"):
            texts, size = texts + part.num_rows, size + len(buf)
            every = Signals(buf, offs)
            for c in asked:
                getattr(every, c)
            for i, (_, rule) in enumerate(rules):
                began = time.process_time()
                bad[i] += int(rule(_View(every, np.arange(part.num_rows), asked)).sum())
                took[i] += time.process_time() - began
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules), dtype=np.int32)), pa.array(took), pa.array(np.full(len(rules), size)), pa.array(np.full(len(rules), texts)), pa.array(bad)], names=["rule", "seconds", "bytes", "texts", "rejected"])

    return run


def measure(sample: DataFrame, rules: list[Rule], asked: tuple[str, ...] = ()) -> list[tuple[str, float, float]]:
    """Of each rule its CPU seconds a byte beyond the ``asked`` signals and the share of texts it rejects, measured where the texts are: only these figures come back."""
    got = sample.mapInArrow(_measure(rules, asked), "rule int, seconds double, bytes long, texts long, rejected long")
    rows = got.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "bytes", "texts", "rejected")]).collect()
    by = {r["rule"]: r for r in rows}
    return [(name, by[i]["seconds"] / max(by[i]["bytes"], 1), by[i]["rejected"] / max(by[i]["texts"], 1)) for i, (name, _) in enumerate(rules) if i in by and by[i]["texts"]]


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, asked: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejections per cost, most first, from about ``sample_rows`` rows chosen by hash; without any as given.

    Costs are those that a cascade which owes the ``asked`` signals anyway has to pay.

    Costs are measured times, so reruns may order rules of like merit otherwise.
    """
    n = docs.count()
    # Long texts are no rarer in the sample than among all rows, and stay with their tasks.
    most = min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, sample_rows / max(n, 1))))
    few = docs.where(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c in (text, "doc_id")]) <= most).select(F.col(f"`{text}`").cast("string").alias("text"))
    gain = {name: share / max(cost, 1e-15) for name, cost, share in measure(few, rules, asked)}
    return sorted(rules, key=lambda r: -gain.get(r[0], 0.0))


def _subset(buf: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offs)[which]
    cut = np.append(0, np.cumsum(n))
    return buf[np.repeat(offs[which] - cut[:-1], n) + np.arange(cut[-1])], cut


def _cascade(rules: list[Rule], extra: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in vec.slices(batches, "text"):
            every = Signals(buf, offs) if extra else None
            left = np.arange(part.num_rows)
            verdict = np.full(part.num_rows, None, object)
            now = _View(every, left, extra) if every else Signals(buf, offs)
            for name, rule in rules:
                bad = rule(now)
                if bad.any():
                    verdict[left[bad]] = name
                    left = left[~bad]
                    if not len(left):
                        break
                    now = Signals(*_subset(now.buf, now.offs, np.flatnonzero(~bad))) if every is None else _View(every, left, extra)
            keep = [i for i, c in enumerate(part.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *(pa.array(getattr(every, c).astype(np.int64)) for c in extra), pa.array(verdict.tolist(), pa.string())], names=[*(part.schema.names[i] for i in keep), *extra, "rejected_by"])

    return run


class _View:
    """Signals of the texts still in the running: the asked ones as computed for all, others from these texts alone, when first needed."""

    def __init__(self, every: Signals, rows: np.ndarray, asked: tuple[str, ...]):
        self.every, self.rows, self.asked = every, rows, (*asked, "lines") if "n_dup_lines" in asked else asked

    @cached_property
    def own(self) -> Signals:
        return Signals(*_subset(self.every.buf, self.every.offs, self.rows))

    def __getattr__(self, name: str):
        if name not in self.asked:
            return getattr(self.own, name)
        got = getattr(self.every, name)
        return tuple(x[self.rows] for x in got) if isinstance(got, tuple) else got[self.rows]


def cascade(docs: DataFrame, rules: list[Rule], text: str = "text", signals: tuple[str, ...] = ()) -> DataFrame:
    """Every column of ``docs`` but the text, the asked signals, and rejected_by: the first rule in order that rejects the text, or null.

    A null text is empty and has no words. Signals are computed for every text
    that is asked for them; whatever else a rule needs it computes of the texts
    that reach it, and no later rule runs on a rejected one. ``rejected_by`` follows the
    order given, whether it is null does not. Texts of any length are read whole;
    equal rows get equal verdicts; an empty table gives no rows. Columns with the
    names of the results are replaced, others may have any name.
    """
    rows, at, kept = by_place(docs, (text,), {*signals, "rejected_by"})
    kept = [c for c in kept if c != text]
    given = rows.select(*[at[c] for c in kept], F.col(at[text]).cast("string").alias("text"))
    fields = [f"{c} {t}" for c, t in given.drop("text").dtypes] + [f"{c} long" for c in signals] + ["rejected_by string"]
    return given.mapInArrow(_cascade(rules, signals), ", ".join(fields)).toDF(*kept, *signals, "rejected_by")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts, the base verdict and the cascade's.

    Null texts have no words and fail; see ``cascade``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rules = order_rules(docs, BASE + OWN, asked=counts)
    judged = cascade(docs, rules, signals=counts)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *counts, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (regexp_matches(line, '[.][.][.][\x20\x09-\x0D]*$')) AS n_cut_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
marks AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(words, i, i + 7)) AS times FROM spots),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM marks WHERE times > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_cut_lines, 0) AS n_cut_lines,
    coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word
  FROM w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN covered r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_cut_lines > 30 * n_lines OR longest_word > 1000) AS kept
FROM c
"""
