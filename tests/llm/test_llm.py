"""The operators of trailmark.llm against brute force, and on awkward inputs."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("trailmark.llm")

from trailmark.llm import op1_suffix_dedup as op1  # noqa: E402
from trailmark.llm import op2_near_dedup as op2  # noqa: E402
from trailmark.llm import op3_chat as op3  # noqa: E402
from trailmark.llm import op4_langid as op4  # noqa: E402
from trailmark.llm import op5_sharding as op5  # noqa: E402
from trailmark.llm import op6_mixing as op6  # noqa: E402
from trailmark.llm import op7_quality as op7  # noqa: E402
from trailmark.llm import op8_countmin_dedup as op8  # noqa: E402
from trailmark.llm import op9_url_filter as op9  # noqa: E402
from trailmark.llm import op10_decontaminate as op10  # noqa: E402
from trailmark.llm.dart import signatures  # noqa: E402
from trailmark.llm.graph import components  # noqa: E402
from trailmark.llm.suffix import permuted_lcp, suffix_array  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = {"width": 12}


def words(t):
    return WORDS.findall(t or "")


def corpus(seed=0, n=60):
    """Texts with exact copies, near copies, shared passages, repeats inside a text, and awkward ones."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgäéñ"), int(rng.integers(1, 8)))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab, k))
    passage = say(120)
    texts = [say(int(rng.integers(1, 260))) for _ in range(n)]
    for i in range(8):
        texts.append(texts[i])
        w = texts[i + 8].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        texts.append(say(40) + "\n" + passage + " " + say(30))
    texts += [passage + "\n" + passage, "x" * 1500, None, "", "   ", "\n", "one", "...", say(30000)]
    return [(i, t) for i, t in enumerate(texts)]


AWKWARD = [(None, None), (None, "a b"), (None, "a b"), (7, ""), (7, ""), (7, "same words again " * 20), (7, "same words again " * 20), (8, None), (9, "z" * 5000), (-3, "éé \x00 �")]


def frame(spark, rows, extra=True):
    """Documents with columns that clash with the operators' own names."""
    full = [(i, t, ["en", "fr", None][k % 3], ["s1", "s2", "s3", None][k % 4], len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("key", "size", "th", "n", "shard", "slot", "score", "rejected", "copies", "taken", "target", "host", "seed", "group"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def by_row(got, *columns):
    return Counter(tuple(r[c] for c in columns) for r in got.collect())


# suffix arrays


@pytest.mark.parametrize("k", [1, 2, 5, 300])
def test_suffix_array(k):
    rng = np.random.default_rng(k)
    for n in (1, 2, 3, 50, 700):
        t = rng.integers(0, k, n)
        for s in (t, np.tile(t, 3)):
            sa = suffix_array(s, k)
            ref = sorted(range(len(s)), key=lambda i: tuple(s[i:]))
            assert list(sa) == ref
            phi, lcp = permuted_lcp(s, sa, 400)
            for a, b in zip(ref, ref[1:], strict=False):
                same = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(s[a:], s[b:], strict=False)))
                assert phi[b] == a and lcp[b] == same


def brute_bytes(texts, m):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + m] for t in data for i in range(len(t) - m + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - m + 1):
            if seen[t[i : i + m]] > 1:
                gone[i : i + m] = b"\1" * m
        left = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_rows": 64, "hot_contexts": 1}, {"shard_bytes": 3000}])
def test_op1_brute(spark, options):
    rows = corpus() + AWKWARD
    df = frame(spark, rows)
    got = df.select("doc_id", op1._key(F.col("text"))).join(op1.suffix_dedup(df, min_bytes=400, **options), "key")
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 400), strict=True))
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op1_long_texts_and_collisions(spark, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(op1.vec.pieces, "__defaults__", (3000,))
    long = bytes(rng.integers(97, 123, 40_000).astype(np.uint8)).decode()
    one, two = thue_morse(2048)
    rows = [(1, long), (2, long[5000:21_000] + "é" + long[100:700]), (3, long[::-1]), (4, one), (5, two), (6, "lead " + two[:500])]
    got = frame(spark, rows).select("doc_id", op1._key(F.col("text"))).join(op1.suffix_dedup(frame(spark, rows)), "key")
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 400), strict=True))
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def brute_classes(rows, k=5, least=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= least * len(sets[i] | sets[j]) - 1e-9:
            up[max(top(i), top(j))] = min(top(i), top(j))
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[top(i)].append(rows[i][0])
    low = lambda ids: None if None in ids else min(ids)
    return Counter((rows[i][0], low(classes[top(i)])) for i in range(len(rows)))


def test_op1_strings_that_collide_are_apart():
    """Two random strings that differ everywhere, by a pattern that cancels in hashes modulo a power of two."""
    rng = np.random.default_rng(19)
    sign = np.array([1, -1])[[bin(i).count("1") % 2 for i in range(2048)]]
    a = rng.integers(100, 150, 2048)
    b = a + sign
    c = np.concatenate((a[:700], b[700:1100], a[1100:1600]))
    buf = np.concatenate((a, b, c)).astype(np.uint8)
    offs = np.array([0, 2048, 4096, 4096 + len(c)])
    got = op1.repeated_starts(buf, offs, 400)
    data = buf.tobytes()
    places = [i for x, y in zip(offs, offs[1:], strict=False) for i in range(x, y - 399)]
    seen = Counter(data[i : i + 400] for i in places)
    assert got.tolist() == [i for i in places if seen[data[i : i + 400]] > 1]
    sa = suffix_array(buf.astype(np.int64), 256)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("limit", [5000, 2])
def test_op2_brute(spark, limit):
    rows = corpus(1) + AWKWARD
    got = op2.near_duplicates(frame(spark, rows), family_limit=limit)
    assert by_row(got, "doc_id", "class_id") == brute_classes(rows)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for n in (3, 40, 900):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        wa = rng.uniform(0.2, 3, n)
        wb = wa * rng.uniform(0.5, 1.5, n)
        s = signatures(np.concatenate((a, a)), np.concatenate((wa, wb)), np.repeat([0, 1], n), 2, 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    real = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in real}


def test_op3_round_trip(spark):
    bad = ["<|im_end|>", "<\\|im_start|>a\nb", "", None, "\\n", "<|", "a<\\\\|b", "<|im_end|>\n<|im_start|>user\nhi"]
    rows = [(c, t, ["user", "assistant", "a\\nb\n<|x"][t % 3], bad[(c + t) % len(bad)]) for c in range(4) for t in range(9)] + [(None, None, None, None), (5, 1, "assistant", "dup"), (5, 1, "assistant", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op3.chat_digest(df).collect()}
    for c in {r[0] for r in rows if r[0] is not None}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op3_tree_paths(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 3, 2, 5.0), ("t", 4, 2, 0.0), ("t", 5, 4, 0.0), ("t", 6, 5, None), ("t", 7, 1, 9.0), ("u", 1, 99, 0.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    found = defaultdict(list)
    for r in op3.paths(nodes).orderBy("place").collect():
        found[r.tree, r.rank].append(r.node)
    assert found == {("t", 1): [1, 7], ("t", 2): [1, 2, 3], ("t", 3): [1, 2, 4, 5, 6], ("u", 1): [1]}
    talk = nodes.withColumn("role", F.when(F.col("node") % 2 == 0, "assistant").otherwise("user")).withColumn("text", F.concat(F.lit("é<|n"), "node"))
    one = op3.chat_format(talk, best=1).where("tree = 't'").first()
    spans = [one.formatted[s.start : s.start + s.length] for s in one.loss_spans]
    assert one.loss_turns == [False, False] and spans == []
    two = op3.chat_format(talk).where("tree = 't' and rank = 2").first()
    assert [two.formatted[s.start : s.start + s.length] for s in two.loss_spans] == ["é<\\|n2"]


def test_op3_null_conversation_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op3.chat_digest(empty).count() == 0


def test_op3_null_conversation_is_one(spark):
    turns = [(None, 1, "user", "hi"), (None, 2, "assistant", "yes"), (None, 3, None, None), (0, 1, "user", "other")]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(None if c is None else str(c) if kind == "string" else c, *r) for c, *r in turns], f"conv_id {kind}, turn long, role string, text string")
        got = {r.conv_id: r for r in op3.chat_digest(df).collect()}
        assert len(got) == 2 and got[None].n_turns == 3 and got[None].loss_chars == 3
        assert got[None].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyes\n\n\n").hexdigest()
    # A null tree with branches, walked over several segments.
    nodes = spark.createDataFrame([(None, 1, None, 0.0), (None, 2, 1, 5.0), (None, 3, 1, 0.0), (None, 4, 3, 0.0), ("u", 1, None, 0.0)], "tree string, node long, parent long, score double")
    assert by_row(op3.paths(nodes), "tree", "rank", "place", "node") == Counter([(None, 1, 0, 1), (None, 1, 1, 2), (None, 2, 0, 1), (None, 2, 1, 3), (None, 2, 2, 4), ("u", 1, 0, 1)])


def plain_tiles(text, item, least):
    """Greedy string tiling word by word: the longest free match, earliest in the text and then in the item, again and again."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and free_t[p + n] and free_i[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return sum(t[2] for t in out)
        out.append((p, q, n))
        free_t[p : p + n] = [False] * n
        free_i[q : q + n] = [False] * n


def test_op10_tiles_of_periodic_texts():
    rng = np.random.default_rng(21)
    for period in (1, 2, 3, 7):
        unit = rng.integers(1, 9, period)
        for extra in (0, 1):
            text = np.concatenate((np.tile(unit, 40)[:90], rng.integers(1, 9, 10 * extra), np.tile(unit, 9)))
            item = np.concatenate((rng.integers(1, 9, 5 * extra), np.tile(unit, 20)[:31]))
            assert sum(t[2] for t in op10.tile(text, item, 5)) == plain_tiles(text.tolist(), item.tolist(), 5)
    began = time.perf_counter()
    assert sum(t[2] for t in op10.tile(np.tile([1, 2], 8000), np.tile([1, 2], 800), 5)) == 1600
    assert time.perf_counter() - began < 2


def test_op10_shared_prompts(spark):
    """Documents that share a prompt only with many items are tiled with none of them, and nothing is lost by it."""
    rng = np.random.default_rng(22)
    say = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 50_000, k))
    prompt = "answer the next question with one of four letters"
    items = [(i, f"{prompt} {say(32)}") for i in range(60)] + [(100, prompt), (101, prompt + " now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{say(20)} {prompt} {say(20)}") for i in range(80)] + [(500, f"{say(5)} {items[7][1]} {say(5)}"), (501, " ".join(items[9][1].split()[20:]))]
    docs = frame(spark, rows)
    pairs, _ = op10.candidates(docs, bench, "text", "doc_id", 5, 0.5, 16)
    assert pairs.count() == 81 * 2 + 2
    want = Counter([(i, k) for i in [*range(80), 500] for k in (100, 101)] + [(500, 7), (501, 9)])
    assert by_row(op10.leaks(docs, bench), "doc_id", "item_id") == want == by_row(op10.leaks(docs, bench, common=10**6), "doc_id", "item_id")


def test_op10_items_without_id_leak(spark):
    item = [" ".join(f"{k}{i}" for i in range(9)) for k in "pqr"]
    bench = spark.createDataFrame([(None, item[0]), (None, item[1]), (3, item[2])], "item_id long, text string")
    docs = frame(spark, [(1, "so " + item[0]), (2, item[1] + " and " + item[2]), (3, "clean")])
    assert by_row(op10.leaks(docs, bench), "doc_id", "item_id", "covered") == Counter([(1, None, 9), (2, None, 9), (2, 3, 9)])


def test_op4_held_out_accuracy(spark, data):
    got = op4.op4_langid(spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    ids = {r.doc_id: r.held_out for r in got.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in ids.items())
    right = got.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9


def test_op4_awkward(spark):
    df = frame(spark, AWKWARD + [(1, "12 34 !!")])
    got = op4.identify(df, op4.learn(df.select("lang", "text")))
    assert got.count() == len(AWKWARD) + 1 and set(df.columns) - {"text"} <= set(got.columns)
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert {None, 7, 8, 1} >= und and 1 in und and 8 in und
    assert {r.lang_pred for r in op4.identify(df, {}).collect()} == {"und"}


def test_op4_brute(spark):
    """Languages and scores from plain compression of every text."""
    import zstandard

    rng = np.random.default_rng(18)
    vocab = {k: ["".join(rng.choice(list(abc), int(rng.integers(2, 7)))) for _ in range(300)] for k, abc in {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}.items()}
    say = lambda k, n: " ".join(rng.choice(vocab[k], n))
    labelled = [(k, say(k, 40) + " 12, Ab!") for k in vocab for _ in range(30)] + [(None, "x"), ("aa", None)]
    df = spark.createDataFrame(labelled, "lang string, text string")
    dicts = op4.learn(df, sample_texts=20, dict_bytes=3000)
    assert {len(v) for v in dicts.values()} == {3000}
    # Whole texts stand in the dictionaries, up to the last.
    whole = {op4.letters(t) for _, t in labelled if t}
    for v in dicts.values():
        assert sum(v.count(w) for w in whole) >= 10
    texts = [say(k, int(n)) for k in vocab for n in (1, 5, 50, 9000)] + [None, "", "123 !", say("aa", 30) + say("bb", 30)]
    got = {r.i: r for r in op4.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), dicts).collect()}
    params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **op4.CODER)
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        data = re.sub(r"[^a-z]+", " ", t.lower()).encode()
        sizes = {}
        for k, v in dicts.items():
            coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[k] = sum(len(coder.compress(data[a : a + op4.CHUNK])) for a in range(0, len(data), op4.CHUNK))
        one, two = sorted(sizes.values())[:2]
        assert sizes[got[i].lang_pred] == one and got[i].score == pytest.approx((two - one) / two) and got[i].rejected == ((two - one) / two < op4.MARGIN)


def test_long_texts_pass_whole(spark):
    """One text of 3 MB through the operators that have no such test of their own."""
    text = " ".join(f"word{i % 5000} x{i}" for i in range(220_000))
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = op3.chat_digest(turns).first()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    df = frame(spark, [(1, text), (2, "short text"), (3, text)])
    assert {r.doc_id: r["size"] for r in op6.mix(df).collect()} == {1: 440_000, 2: 2, 3: 440_000}
    got = {r.doc_id: r for r in op8.window_dedup_rows(df).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 440_000


def test_op4_long_texts_count_to_their_end(spark):
    rng = np.random.default_rng(5)
    # Many words of a vocabulary without much repetition, as the dictionaries' share of a text is what counts.
    vocab = {k: ["".join(rng.choice(list(abc), int(rng.integers(2, 9)))) for _ in range(3000)] for k, abc in {"aa": "abcdefghijkl", "bb": "ghijklmnopqr"}.items()}
    say = lambda k, n: " ".join(rng.choice(vocab[k], n))
    dicts = {k: say(k, 12_000).encode()[: op4.DICT_BYTES] for k in vocab}
    one, two = say("aa", 400_000), say("aa", 60_000) + " " + say("bb", 400_000)
    got = {r.id: r for r in op4.identify(spark.createDataFrame([(1, one), (2, two)], "id int, text string"), dicts).collect()}
    assert got[1].lang_pred == "aa" and not got[1].rejected
    assert got[2].lang_pred == "bb" and not got[2].rejected


def test_op4_copies_leave_the_sample_whole(spark):
    rows = spark.range(40_000).select(F.lit("aa").alias("lang"), F.concat(F.lit("word "), F.translate((F.col("id") % 40).cast("string"), "0123456789", "abcdefghij")).alias("text"))
    few = spark.createDataFrame([("bb", "other words"), ("bb", "other words"), ("bb", "more")], "lang string, text string")
    got = op4.learn(rows.unionByName(few), sample_texts=10, dict_bytes=1000)
    assert list(got) == ["aa", "bb"] and got["bb"].count(b"words") == 1 and b"more" in got["bb"]
    assert got["aa"].count(b"word ") == 10


def test_op5_law(spark):
    rows = corpus(2, 300) + AWKWARD
    got = op5.shard_documents(frame(spark, rows), cells=16).collect()
    assert len(got) == len(rows)
    shard_of, sums, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        body = (r.text or "").encode()
        assert r["size"] == len(body) + 1 and r.text_crc32 == zlib.crc32(body) and r.law == "bytes" and r.grown_shard is None
        shard_of[r.text or ""].add(r.shard)
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(sums.values())[:-1]
    assert max(rest) - min(rest) <= 0.02 * max(rest)


def test_op5_tree_of_cells(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 5000, 3000)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "group long, bytes long")
    got = {r.group: r.shard for r in op5.karmarkar_karp(groups, 8, cells=70, fan=4).collect()}
    sums = Counter()
    for i, s in enumerate(sizes):
        sums[got[i]] += s
    assert len(got) == 3000 and len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 1e-4 * min(sums.values())


def test_op5_differencing():
    sums, final = op5.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]], 2)
    assert sorted(sums) == [14, 16] and [sum(s for s, f in zip((8, 7, 6, 5, 4), final[:, 0], strict=True) if f == h) for h in (0, 1)] == sums


def test_op6_targets_and_rounding(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40))) for i in range(900)] + AWKWARD
    df = frame(spark, rows)
    got = op6.mix(df).collect()
    again = op6.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(words(r.text)) and 0 <= r.taken <= 3 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    want, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            open_.discard(s)
    want |= {s: left * weight[s] / w for s in open_}
    for s in names:
        assert target[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], abs=40)
    assert all(r.source_size == size[r.source] for r in got)


def test_op6_expectation(spark):
    """Over many seeds a row is taken as often as its probability says."""
    rows = spark.createDataFrame([(1, i, 1 + i % 9, 0.3) for i in range(200)], "group long, id long, size long, p double")
    hits = sum(op6.pivotal(rows, seed=s).agg(F.sum("copy")).first()[0] for s in range(5))
    assert hits / 1000 == pytest.approx(0.3, abs=0.05)


def test_op6_large_rows_settle_against_small_ones(spark):
    """A source with one row of two thirds of the small ones' words misses its mass by no more than a small row; where both ways are open expectations stay."""
    rng = np.random.default_rng(25)
    rows, mass = [], {}
    for g in range(60):
        p = float(rng.uniform(0.3, 0.7))
        sizes = [3800, *map(int, rng.integers(40, 160, 56))] if g % 2 else [900, 700, *map(int, rng.integers(20, 90, 150))]
        rows += [(g, 1000 * g + i, s, p) for i, s in enumerate(sizes)]
        mass[g] = p * sum(sizes)
    df = spark.createDataFrame(rows, "group long, id long, size long, p double").cache()
    size = {r[1]: r[2] for r in rows}
    both_ways = {r[1] for r in rows if r[2] == 3800 and 0.45 < r[3] < 0.55}
    large, seeds = Counter(), range(6)
    for seed in seeds:
        got = op6.pivotal(df, seed=seed).collect()
        taken = Counter()
        for r in got:
            taken[r["group"]] += r["copy"] * size[r["id"]]
            large[seed] += r["copy"] if r["id"] in both_ways else 0
        assert len(got) == len(rows)
        assert all(abs(taken[g] - mass[g]) <= 80 for g in mass)
    wanted = sum(r[3] for r in rows if r[1] in both_ways)
    assert len(both_ways) > 3 and sum(large.values()) / len(seeds) == pytest.approx(wanted, rel=0.3)


def brute_quality(t):
    w = words(t)
    n = len(w)
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    spots = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = {k for i in range(n - 7) if spots[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(hit) > 30 * n
    ends = sum(x.rstrip(" \t\n\v\f\r").endswith("...") for x in lines)
    own = 10 * symbols > n or 100 * dup > 30 * len(lines) or chars < 2 * n or chars > 15 * n or 100 * ends > 30 * len(lines) or max(map(len, w), default=0) > 1000
    return (n, chars, symbols, dup, len(hit), failed, not (failed or own))


def test_op7_brute(spark, data):
    rows = corpus(3) + AWKWARD + [(99, "a\nb\na\n\n a\na"), (98, "# $ % words " * 9), (97, "many different words " + " ".join(f"w{i}" for i in range(30)) + "... \nand so on...\nend"), (96, " ".join(f"w{i}" for i in range(30)) + " " + "é" * 1001)]
    df = frame(spark, rows)
    rules = op7.order_rules(df, op7.BASE + op7.OWN)
    assert sorted(r[0] for r in rules) == sorted(r[0] for r in op7.BASE + op7.OWN)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = op7.cascade(df, rules, signals=counts)
    want = Counter((i, *brute_quality(t)[:5], brute_quality(t)[6]) for i, t in rows)
    assert by_row(got.withColumn("kept", F.col("rejected_by").isNull()), "doc_id", *counts, "kept") == want
    short = op7.cascade(df, rules[::-1])
    assert short.where("rejected_by is null").count() == sum(brute_quality(t)[6] for _, t in rows)


def test_op7_rejected_texts_are_spared(spark):
    """A rule sees only texts that no earlier rule rejected, also where counts are asked for all."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, "few" if i % 3 else " ".join(f"w{i}" for i in range(40))) for i in range(90)]

    def spy(s):
        seen.add(len(s.longest_word))
        return s.longest_word > 1000

    op7.cascade(frame(spark, rows), [op7.BASE[0], ("spy", spy)], signals=("n_words",)).collect()
    assert seen.value == 30


def test_op7_order_pays_least(spark, monkeypatch):
    """Rules that look at counts which are owed anyway come first, and the measured order computes less than its reverse."""
    rng = np.random.default_rng(26)
    texts = ["# " * 40 + "x" * int(rng.integers(1, 30)) for _ in range(120)] + [" ".join(f"w{i}" for i in rng.integers(0, 500, 60)) + "..." * (k % 2) for k in range(120)]
    docs = frame(spark, list(enumerate(texts)))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rules = op7.order_rules(docs, op7.BASE + op7.OWN, asked=counts)
    names = [n for n, _ in rules]
    # Both reject texts of this sample; the one costs a look at owed counts, the other words and lines anew.
    assert names.index("symbols") < names.index("cut_lines")
    paid = Counter()
    for name in ("n_cut_lines", "longest_word"):
        real = getattr(op7.Signals, name).func

        def counted(self, real=real):
            paid["bytes"] += len(self.buf)
            return real(self)

        prop = op7.cached_property(counted)
        prop.__set_name__(op7.Signals, name)
        monkeypatch.setattr(op7.Signals, name, prop)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    spent, verdicts = [], []
    for order in (rules, rules[::-1]):
        paid.clear()
        verdicts.append([v is None for b in op7._cascade(order, counts)(iter([batch])) for v in b.column("rejected_by").to_pylist()])
        spent.append(paid["bytes"])
    assert verdicts[0] == verdicts[1] and spent[0] < 0.75 * spent[1]


def test_op7_texts_that_begin_with_a_line_feed(spark):
    texts = ["\nfoo\nfoo", "foo\nfoo", "\n\nfoo\n\nfoo\n", "", "\n", "\n\n", "x\n", "\nx", "foo\n", "\nfoo", None, "\na\nb\na\n", "\n \n "]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    got = op7.cascade(frame(spark, rows).coalesce(1), op7.BASE, signals=("n_dup_lines",))
    assert {r.doc_id: r.n_dup_lines for r in got.collect()} == {i: brute_quality(t)[3] for i, t in rows}
    assert brute_quality(texts[0])[3] == 1


def brute_windows(rows, k=13):
    top = 2**63
    ids = [top if i is None else i for i, _ in rows]
    first = {}
    for i, (_, t) in zip(ids, rows, strict=True):
        w = words(t)
        for j in range(len(w) - k + 1):
            first[tuple(w[j : j + k])] = min(i, first.get(tuple(w[j : j + k]), top + 1))
    out = Counter()
    for i, (name, t) in zip(ids, rows, strict=True):
        w = words(t)
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for x in range(j, j + k)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[name, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"width": 10}, {"chunk_bytes": 2000, "width": 22}])
def test_op8_brute(spark, options):
    """Also with a sketch so full that it filters nothing, and with many chunks."""
    rows = corpus(4) + AWKWARD
    got = op8.window_dedup_rows(frame(spark, rows), **options)
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows)


def thue_morse(n):
    """A string and its complement, which collide in any polynomial modulo a power of two."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_op2_templates_do_not_make_families(spark, monkeypatch):
    """3,000 texts of 60 common and 45 own words are 0.38 alike; near copies among them are found, and only those meet."""
    rng = np.random.default_rng(23)
    common = " ".join(f"c{i}" for i in range(60))
    own = lambda: " ".join(f"w{i}" for i in rng.integers(0, 10**9, 45))
    texts = [f"{common} {own()}" for _ in range(3000)]
    near = {}
    for i in range(0, 300, 3):
        w = texts[i].split()
        w[-1] = "other"
        near[3000 + i] = i
        texts.append((3000 + i, " ".join(w)))
    rows = [(i, t) if isinstance(t, str) else t for i, t in enumerate(texts)]
    sizes = []
    real = op2.refined

    def spy(families, *args):
        out = real(families, *args)
        sizes.append((families.agg(F.max("size")).first()[0], out.agg(F.max("size")).first()[0]))
        return out

    monkeypatch.setattr(op2, "refined", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for weighted in (False, True):
        got = {r.doc_id: (r.class_id, r.class_size) for r in op2.near_duplicates(docs, weighted=weighted).collect()}
        # A family little over the limit, of which all are looked at.
        some = docs.where("doc_id < 55").count()
        assert op2.near_duplicates(docs.where("doc_id < 55"), weighted=weighted, bands=60, rows=2).where("class_size = 1").count() == some
        assert all(got[i] == (near.get(i, i), 2 if i in near or i + 3000 in near else 1) for i, _ in rows)
    assert all(before > 50 and (after or 0) <= 10 for before, after in sizes) and max(sizes)[0] > 2000 and len(sizes) == 4


def test_op2_first_shingles():
    """Sets as alike as asked share a first shingle, whatever is taken for usual."""
    rng = np.random.default_rng(24)
    for _ in range(300):
        h = np.unique(rng.integers(0, 10**6, int(rng.integers(1, 40))))
        w = rng.integers(1, 4, len(h))
        keep = rng.random(len(h)) < 0.93
        g = np.concatenate((h[keep], 10**6 + np.arange(int(rng.integers(0, 3)))))
        v = np.concatenate((w[keep], np.ones(len(g) - int(keep.sum()), int)))
        both = int(np.minimum(w[keep], v[: int(keep.sum())]).sum())
        usual = h[rng.random(len(h)) < 0.5]
        a, b = (op2.first_shingles(*x, usual, 0.8) for x in ((h, w), (g, v)))
        if len(g) and both >= 0.8 * (w.sum() + v.sum() - both) - 1e-9:
            assert np.isin(a, b).any()


@pytest.mark.parametrize("hop", [1, 2, 3])
def test_op8_hops(spark, hop):
    rows = corpus(3) + AWKWARD
    got = op8.window_dedup_rows(frame(spark, rows), chunk_bytes=9000, hop=hop, width=14)
    want = op8.window_dedup_rows(frame(spark, rows))
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    assert by_row(got, *columns) == by_row(want, *columns)


def test_op8_rows_grow_with_the_input(spark, monkeypatch):
    """At each hop a chunk accounts for no more rows than a hop has addresses, however many chunks and blocks there are."""
    docs = spark.createDataFrame(corpus(5, n=120), "doc_id long, text string").cache()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sent = {}
    for size in (20_000, 10_000, 5_000):
        seen = []

        def count(df, seen=seen):
            seen.append(df.count())
            return df

        monkeypatch.setattr(op8, "cut", count)
        op8.window_dedup(docs, chunk_bytes=size, hop=2)
        chunks = -(-total // size)
        assert all(0 < n <= 8 * chunks + 64 for n in seen)
        sent[size] = sum(seen), len(seen)
    # Twice the chunks: twice the rows a hop, and at most two hops more.
    for one, two in ((20_000, 10_000), (10_000, 5_000)):
        assert sent[two][1] <= sent[one][1] + 2 and sent[two][0] / sent[two][1] <= 2.2 * sent[one][0] / sent[one][1]


def test_op8_words_that_collide_modulo_powers_of_two(spark):
    one, two = thue_morse(2048)
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {one} more")]
    got = op8.window_dedup_rows(frame(spark, rows))
    assert by_row(got, "doc_id", "n_removed") == Counter([(1, 0), (2, 0), (3, 13)])


def test_op9_rules_and_graph(spark):
    link = lambda *h: "".join(f'<a href="https://{x}/p">' for x in h)
    rows = [
        (1, "http://WWW.Example.com/en/1?x", link("good.org")),
        (2, "http://example.com/en/2#t", link("mid.org")),
        (3, "https://shop.example.com/de", link("good.org", "friend.org")),
        (4, "http://a.net/fr/1", None),
        (5, "http://bad.org/x", link("a.net")),
        (6, "http://good.org/", link("friend.org")),
        (7, "http://far.org", ""),
        (8, None, "x"),
        (9, "no scheme", None),
        (10, "http://notcom/", link("bad.org")),
        (11, "ftp://x.com", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op9.filter_urls(df).collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("example.com", "/en/2", "example.com/en/", "block"),
        3: ("shop.example.com", "/de", "com/", "allow"),
        4: ("a.net", "/fr/1", "net/fr/", "block"),
        5: ("bad.org", "/x", None, "block"),
        6: ("good.org", "/", None, "allow"),
        7: ("far.org", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("notcom", "/", None, "block"),
        11: ("x.com", "", None, "allow"),  # an empty path does not start with /
    }


def brute_urls(rows, rounds=12, damping=0.85):
    """Verdicts by plain loops over pages and a dense PageRank."""
    judged = []
    for i, url, html in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), h + p, v) for v, h, p in op9.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((i, host, path, *(max(fit)[1:] if fit else (None, None)), html or ""))
    links, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    for _, host, _, _, verdict, html in judged:
        for to in {re.sub(r"^.*@|:\d*$", "", x).lower() for x in re.findall(op9.LINK, html)}:
            if host and to and to != host:
                links[host, to] += 1
        if verdict and host:
            seeds[verdict][host] += 1
    hosts = sorted({h for e in links for h in e} | {h for c in seeds.values() for h in c})
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), w in links.items():
        m[at[b], at[a]] = w
    score = {}
    for kind, graph in (("allow", m), ("block", m.T)):
        out = graph.sum(axis=0)
        step = graph / np.where(out > 0, out, 1)
        base = np.array([seeds[kind][h] for h in hosts], float)
        base /= max(base.sum(), 1)
        x = base
        for _ in range(rounds):
            x = (1 - damping) * base + damping * step @ x
        score[kind] = x
    bad = {h for h, k in at.items() if score["block"][k] > 1e-15 and score["block"][k] >= score["allow"][k]}
    return {i: (host, path, rule, verdict or ("block" if host in bad else "allow")) for i, host, path, rule, verdict, _ in judged}


def test_op9_brute_over_a_graph(spark):
    rng = np.random.default_rng(8)
    hosts = ["example.com", "www.example.com", "a.net", "b.net"] + [f"h{i}.org" for i in range(30)]
    paths = ["/en/", "/es/x", "/fr/", "/de/", "", "?q", "/en"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}", "".join(f'<a href="https://{h}/z">' for h in rng.choice(hosts, int(rng.integers(0, 4))))) for i in range(160)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op9.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_urls(rows)
    assert got == want
    graph = Counter(v for _, _, rule, v in want.values() if rule is None)
    assert graph["block"] > 5 and graph["allow"] > 5


def test_op9_pagerank(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0)]
    got = {r.host: r.score for r in op9.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 2.0)], "host string, weight double"), rounds=9).collect()}
    x = np.array([1.0, 0, 0])
    m = np.array([[0, 1 / 3, 1], [1, 0, 0], [0, 2 / 3, 0]])
    for _ in range(9):
        x = 0.15 * np.array([1.0, 0, 0]) + 0.85 * m @ x
    assert [got[h] for h in "abc"] == pytest.approx(list(x))


def test_op10_tiles():
    item = np.arange(1, 31, dtype=np.int64)
    text = np.concatenate(([0], item[15:], [0], item[:15], [0], item[3:9]))
    assert sorted(t[1:] for t in op10.tile(text, item, 5)) == [(0, 15), (15, 15)]
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(1, 4, 40), rng.integers(1, 4, 25)
        tiles = op10.tile(a.astype(np.int64), b.astype(np.int64), 4)
        used_a, used_b = np.zeros(40, bool), np.zeros(25, bool)
        for p, q, n in tiles:
            assert n >= 4 and (a[p : p + n] == b[q : q + n]).all() and not used_a[p : p + n].any() and not used_b[q : q + n].any()
            used_a[p : p + n] = used_b[q : q + n] = True
        for p in range(37):
            for q in range(22):
                assert used_a[p : p + 4].any() or used_b[q : q + 4].any() or (a[p : p + 4] != b[q : q + 4]).any()


def brute_tiles(text, item, least):
    """Mark the longest match of unmarked tokens, the earliest of equals, until none is long enough."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and free_t[p + n] and free_i[q + n] and text[p + n] == item[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return sorted(out)
        out.append((p, q, n))
        free_t[p : p + n] = [False] * n
        free_i[q : q + n] = [False] * n


def test_op10_tiles_are_the_longest_ones():
    rng = np.random.default_rng(16)
    for _ in range(80):
        a, b = rng.integers(1, 4, int(rng.integers(1, 50))), rng.integers(1, 4, int(rng.integers(1, 30)))
        least = int(rng.integers(2, 5))
        assert sorted(op10.tile(a.astype(np.int64), b.astype(np.int64), least)) == brute_tiles(a.tolist(), b.tolist(), least)


def test_op10_brute(spark):
    """Documents made of shuffled pieces of items, common seeds and noise, one of them very long."""
    rng = np.random.default_rng(17)
    vocab = [f"v{i}" for i in range(60)]
    items = [[str(x) for x in rng.choice(vocab, int(rng.integers(4, 60)))] for _ in range(12)]
    docs = []
    for i in range(50):
        w = [str(x) for x in rng.choice(vocab, 15)]
        for _ in range(int(rng.integers(0, 5))):
            it = items[int(rng.integers(0, 12))]
            a = int(rng.integers(0, len(it)))
            w += it[a : a + int(rng.integers(3, 40))] + [str(x) for x in rng.choice(vocab, 2)]
        docs.append((i, w))
    docs.append((50, [str(x) for x in rng.choice(vocab, 20_000)] + items[3]))
    bench = spark.createDataFrame([(k, "; ".join(it).upper()) for k, it in enumerate(items)], "item_id long, text string")
    got = by_row(op10.leaks(frame(spark, [(i, " ".join(w)) for i, w in docs]), bench), "doc_id", "item_id", "covered")
    want = Counter()
    for i, w in docs[:50]:
        for k, it in enumerate(items):
            covered = sum(n for _, _, n in brute_tiles(w, it, 5))
            if len(it) >= 5 and covered >= 0.5 * len(it):
                want[i, k, covered] += 1
    assert Counter({k: n for k, n in got.items() if k[0] < 50}) == want
    assert any(k[:2] == (50, 3) and k[2] == len(items[3]) for k in got)


def test_op10_reordered_passages_leak(spark):
    w = [f"tok{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, "short one"), (4, " ".join(f"Other{i}" for i in range(30)))], "item_id long, text string")
    rows = [(1, "lead " + " ".join(w[20:]).upper() + ", then; " + " ".join(w[:20])), (2, " ".join(w[:10])), (3, "short one"), *AWKWARD, (5, " ".join(f"other{i}!" for i in range(30)))]
    got = by_row(op10.leaks(frame(spark, rows), bench), "doc_id", "item_id", "covered")
    assert got == Counter({(1, 1, 40): 1, (5, 4, 30): 1})


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op1.suffix_dedup(none).count() == 0
    assert op2.near_duplicates(none).count() == 0
    assert op4.identify(none, op4.learn(none.select("lang", "text"))).count() == 0
    assert op5.shard_documents(none).count() == 0
    assert op6.mix(none).count() == 0
    assert op7.cascade(none, op7.order_rules(none, op7.BASE)).count() == 0
    assert op8.window_dedup_rows(none, **SMALL).count() == 0
    assert op9.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert op10.leaks(none, bench).count() == 0 and op10.leaks(frame(spark, AWKWARD), bench).count() == 0


ANY_NAMES = ("__key", "__run", "__at", "__from", "__d", "__t", "__k", "__e", "__text", "__r", "__salt", "id", "group", "blocked", "trust", "key", "bytes", "cell", "heap", "to", "rid", "th", "node", "label", "band", "item", "seed", "who", "chunk", "block", "c0", "c1", "c2", "source_size", "n", "rate", "copy", "text.with.dot", "Score", "host", "verdict")


@pytest.mark.parametrize("operator", ["identify", "shard_documents", "mix", "cascade", "filter_urls", "language", "near_dedup", "decontaminate", "mixing", "sharding"])
def test_columns_of_any_name_come_back(spark, data, operator):
    """Whatever given columns are called, they come back as they were; only names of results are replaced."""
    results = {"identify": ["lang_pred", "score", "rejected"], "shard_documents": ["size", "text_crc32", "law", "shard", "slot", "grown_shard"], "mix": ["size", "source_size", "target", "copies", "taken"], "cascade": ["n_words", "rejected_by"], "filter_urls": ["host", "path", "rule", "verdict", "by"]}
    results["sharding"] = results["shard_documents"]
    say = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{say} {i} and more words of the kind {i * 7}", "en", f"s{i % 2}", f"http://h{i}.net/es/{i}", "<a href='http://x.com'>") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, html string")
    for c in ANY_NAMES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")))
    calls = {
        "identify": lambda: op4.identify(docs, {"en": b"word and more", "fr": b"mot et plus"}, keep_text=True),
        "shard_documents": lambda: op5.shard_documents(docs),
        "mix": lambda: op6.mix(docs),
        "cascade": lambda: op7.cascade(docs.withColumnRenamed("text", "body").withColumn("text", F.lit("none")), op7.BASE, text="body", signals=("n_words",)),
        "filter_urls": lambda: op9.filter_urls(docs),
    }
    import corpus_pipeline as p

    got = calls[operator]() if operator in calls else dict(p.STAGES)[operator](spark, docs, data)
    new = results.get(operator, [])
    low = {c.lower() for c in new}
    assert [c for c in got.columns if c in new] == new
    stay = [c for c in docs.columns if c.lower() not in low and not (operator == "cascade" and c == "text")]
    assert set(got.columns) == {*stay, *new} | ({"text"} if operator == "cascade" else set())
    for r in got.select(*[F.col(f"`{c}`") for c in stay]).collect():
        for c in ANY_NAMES:
            if c in stay:
                assert r[c] == f"{c}-{r['doc_id']}"
    assert got.count() > 0 or operator in ("language",)


def test_pipeline_columns_stay(spark, data):
    """Columns named like the operators' own come back as they were, from every stage; repeated rows and an empty table pass."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    own = ("score", "rejected", "lang_pred", "size", "copies", "taken", "target", "th", "first", "d", "t", "h", "n", "copy", "c1", "row", "__d", "__t", "__text")
    for c in own:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    docs = docs.unionByName(docs.where("doc_id < 5"))
    for name, stage in p.STAGES[:-1]:
        docs = p.cut(stage(spark, docs, data))
        bad = docs.where(" or ".join(f"`{c}` != concat('{c}', doc_id)" for c in own)).count()
        assert bad == 0 and docs.count() > 0, name
        assert stage(spark, docs.where("false"), data).count() == 0


def test_pipeline_stages(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    names = [n for n, _ in p.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "mixing", "sharding"]
    rows = {}
    for name, stage in p.STAGES:
        out = p.cut(stage(spark, docs, data))
        if name != "sharding":
            assert out.columns == docs.columns
        rows[name] = [(r.doc_id, r.text) for r in out.collect()]
        if name == "near_dedup":
            given = [(r.doc_id, r.text) for r in docs.collect()]
            assert Counter(i for i, _ in rows[name]) == Counter({c for _, c in brute_classes(given)})
        if name == "decontaminate":
            bench = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            kept = [" ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) for _, t in rows[name]]
            assert not any(" ".join(b) in t for b in bench for t in kept)
        docs = out
    assert set(rows["mixing"]) <= set(rows["decontaminate"]) <= set(rows["near_dedup"]) <= set(rows["language"])
    assert Counter(rows["sharding"]) == Counter(rows["mixing"])
