"""Language identification by compression with per-language dictionaries.

A text, lower-cased and with one space for whatever is not a letter, is encoded
once with each language's zstandard dictionary (raw content:
text of that language); the dictionary that makes it smallest names the
language. Where the runner-up is nearly as small the answer is marked rejected.
A long text is encoded in consecutive chunks, each from the dictionary anew, and
the sizes are summed: so its end counts as its beginning does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_place, table

SAMPLE_TEXTS = 400
DICT_BYTES = 64 << 10
LONG = 64
MARGIN = 0.002
#: Small tables, as each text starts from a copy of them; greedy parsing tells languages apart better than the fast ones.
CODER = {"window_log": 18, "hash_log": 14, "chain_log": 14, "search_log": 3, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY}
#: Bytes encoded from one start of a dictionary; with the dictionary well under the window of 2^18.
CHUNK = 16 << 10
HELD_OUT = 2
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def held_out(doc_id):
    """Whether crc32 of the id as text leaves remainder 2 by 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def learn(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries from (lang, text): a bounded sample of each language.

    At most ``sample_texts`` different texts a language, those of least hash, are
    taken whole one after another until they give ``dict_bytes`` bytes, those of
    over a ``LONG``th of that after all others; what the last one has beyond that
    is not needed. Null languages and null texts teach
    nothing. Languages with more rows come first.
    """
    # Shorter texts first, so that many of them and not one long one fill a dictionary.
    order = Window.partitionBy("lang").orderBy(F.col("size") > dict_bytes // LONG, "h")
    some = labelled.where("lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", "text", F.xxhash64("text").alias("h"))
    # Rows and different texts of each language; copies of a text are one, however many they are.
    texts = some.groupBy("lang", "h").count().groupBy("lang").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("texts"))
    rows = sorted(((r["lang"], r["rows"], r["texts"]) for r in texts.collect()), key=lambda x: (-x[1], x[0]))
    if not rows:
        return {}
    factor = 4
    while True:
        # Hashes below a limit by language leave a few times the sample, however many texts there are.
        limit = {k: min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, factor * sample_texts / n))) for k, _, n in rows}
        most = F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])
        few = some.where(F.col("h") <= most[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
        clean = few.withColumn("text", F.regexp_replace("text", r"[^\p{L}\p{M}]+", " ")).withColumn("size", F.octet_length("text"))
        ranked = clean.withColumns({"n": F.row_number().over(order), "before": F.sum("size").over(order) - F.col("size")})
        # A text that begins behind a full dictionary adds nothing, and no more than a dictionary of one is sent to the driver.
        top = ranked.where((F.col("n") <= sample_texts) & (F.col("before") < dict_bytes)).select("lang", "n", F.substring("text", 1, dict_bytes).alias("text"), (F.col("before") + F.col("size")).alias("bytes")).collect()
        have, full = Counter(r["lang"] for r in top), {r["lang"] for r in top if r["bytes"] >= dict_bytes}
        if all(k in full or have[k] >= min(n, sample_texts) for k, _, n in rows):
            break
        factor *= 4
    out = {k: bytearray() for k, *_ in rows}
    for lang, _, text, _ in sorted(map(tuple, top)):
        if len(own := out[lang]) < dict_bytes:
            own += letters(text)
    return {k: bytes(v[:dict_bytes]) for k, v in out.items()}


def _predict(dicts: dict[str, bytes], margin: float, keep_text: bool):
    names = list(dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **CODER)
        coders = []
        for k in names:
            words = zstandard.ZstdCompressionDict(dicts[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            coders.append(zstandard.ZstdCompressor(dict_data=words, compression_params=params))
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            lang, score, reject = [], [], []
            for t in texts:
                if not names or t is None or not _LETTER.search(t):
                    lang.append("und")
                    score.append(0.0)
                    reject.append(True)
                    continue
                data = letters(t)
                chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
                sizes = np.array([sum(len(c.compress(x)) for x in chunks) for c in coders])
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                gap = (int(rest.min()) - int(sizes[best])) / int(rest.min()) if len(rest) else 1.0
                lang.append(names[best])
                score.append(float(gap))
                reject.append(len(rest) > 0 and gap < margin)
            names_ = [n for n in batch.schema.names if keep_text or n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names_), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], names=[*names_, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dicts: dict[str, bytes], text: str = "text", margin: float = MARGIN, keep_text: bool = False) -> DataFrame:
    """Every column of ``docs``, the text only if ``keep_text``, with lang_pred, score and rejected.

    The score is the runner-up's size less the smallest, as a share of the
    runner-up's; under ``margin`` the row is rejected. Equal sizes go to the first
    language of ``dicts`` and score 0. A null text, or one without a letter, is ``und``
    with score 0, rejected; so is every text if no language was learned. Long
    texts are encoded to their end; equal texts get equal answers; an empty table
    gives no rows. Columns of ``docs`` with the names of the results are replaced, others may have any name.
    """
    rows, at, kept = by_place(docs, (text,), {"lang_pred", "score", "rejected"})
    body = rows[at[text]].cast("string").alias("__text")
    given = rows.select(*[at[c] for c in kept if c != text], body)
    out = given if keep_text else given.drop("__text")
    fields = ", ".join(f"{c} {t}" for c, t in out.dtypes)
    found = given.mapInArrow(_predict(dicts, margin, keep_text), f"{fields + ', ' if fields else ''}lang_pred string, score double, rejected boolean")
    back = {n: c for c, n in at.items()} | {"__text": text}
    return found.toDF(*[back.get(c, c) for c in found.columns])


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those not held out.

    Null texts and texts without letters are ``und``; see ``identify``.
    """
    docs = table(spark, sf_dir, "documents")
    dicts = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), dicts)
