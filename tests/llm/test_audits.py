"""Vector codes, source divergence and exact top-k search against plain loops, and on awkward inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("trailmark.llm")

from trailmark.llm import op11_vector_codes as op11  # noqa: E402
from trailmark.llm import op12_divergence as op12  # noqa: E402
from trailmark.llm import op13_topk as op13  # noqa: E402

CLASH = ("id", "v", "x", "g", "s", "o", "n", "l", "k", "block", "ids", "labels", "code", "error", "score", "rank", "query_id", "value", "item", "part", "term", "docs", "first", "terms", "groups", "total", "sources")


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def some_vectors(n=400, dim=16, seed=0, copies=120):
    """Vectors about a few centres, a third of all copies of one, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(5, dim))[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    x[n - copies :] = x[3]
    rows = [(i, x[i].tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    bad = [(1000, None, 1), (1001, [None] * dim, 1), (1002, [float("nan")] * dim, 2), (1003, [float("inf")] + [0.0] * (dim - 1), 2), (1004, [], 2), (1100, [1.0], 1)]
    return rows + bad, x


def vectors_frame(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5))


def brute_codes(x, ids, parts, entries, rounds, scale=4096):
    """Plain Lloyd rounds in Python's own integers."""
    whole = [[[int(np.floor(float(c) * scale)) for c in p] for p in np.array_split(v, parts)] for v in x]
    order = sorted(range(len(x)), key=lambda i: (ids[i], sum(whole[i], [])))
    books = [[whole[i][p] for i in order[:entries]] for p in range(parts)]

    def assign():
        dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
        return [[min((dist(w[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for w in whole]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            own = defaultdict(list)
            for w, a in zip(whole, got, strict=True):
                own[a[p][1]].append(w[p])
            for e, v in own.items():
                books[p][e] = [sum(c) // len(v) for c in zip(*v, strict=True)]
    return [(bytes(e for _, e in a), sum(d for d, _ in a)) for a in assign()], books


@pytest.mark.parametrize(("n", "parts", "entries"), [(150, 4, 8), (5, 2, 8), (150, 8, 16)])
def test_op11_brute(spark, n, parts, entries):
    rows, x = some_vectors(n, copies=n // 3)
    got, books = op11.compress(vectors_frame(spark, rows), parts=parts, entries=entries, rounds=3)
    want, ref = brute_codes(x, list(range(n)), parts, entries, 3)
    assert books.tolist() == ref
    assert {r["id"]: (bytes(r["code"]), r["error"]) for r in got.collect()} == dict(enumerate(want))
    assert op11.digest(books) == hashlib.sha256(",".join(str(c) for p in ref for e in p for c in e).encode()).hexdigest()
    assert op11.decode(want[0][0], books).tolist() == sum((ref[p][k] for p, k in enumerate(want[0][0])), [])


def test_op11_awkward(spark):
    rows, _ = some_vectors(40, 10)
    # Repeated rows, a null id, components beyond 64 bits, a dimension that is no multiple of the parts.
    rows = rows[:40] + rows[:3] + [(None, [0.5] * 10, None), (50, [1e30] * 10, 1)]
    df = vectors_frame(spark, rows)
    got, books = op11.compress(df, parts=4)
    assert books.shape == (4, 16, 3)
    have = got.collect()
    assert len(have) == len(rows)
    assert Counter(r["id"] for r in have)[0] == 2 and None in {r["id"] for r in have}
    assert next(r["error"] for r in have if r["id"] == 50) >= 0
    none, books = op11.compress(df.where("false"))
    assert none.count() == 0 and books.shape[1] == 0


def test_op11_rows_of_label_and_blocks(spark, tmp_path):
    rows, _ = some_vectors()
    vectors_frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11.op11_vector_codes(spark, str(tmp_path)).collect()
    sums = defaultdict(int)
    label = {r[0]: r[2] for r in rows}
    for r in got:
        sums[label[r["vec_id"]]] += r["error"]
    assert len(got) == 400 and all(r["label_error"] == sums[label[r["vec_id"]]] for r in got)
    assert len({r["codebooks_sha256"] for r in got}) == 1 and {len(r["code"]) for r in got} == {16}


def brute_top(x, ids, queries, k, scale=1024):
    whole = [[int(np.floor(float(c) * scale)) for c in v] for v in x]
    out = []
    for q in queries:
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), ids[i]) for i in range(len(x)) if ids[i] != ids[q])[:k]
        out += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_op13_brute(spark, monkeypatch, block):
    for name in ("BLOCK", "QUERIES", "HEAD"):
        monkeypatch.setattr(op13, name, block)
    rows, x = some_vectors(300, copies=100)
    x = x * np.random.default_rng(1).uniform(0.1, 3, (300, 1)).astype(np.float32)
    x[200:] = x[3]
    rows = [(i, x[i].tolist(), None) for i in range(300)] + rows[300:]
    df = vectors_frame(spark, rows)
    got = op13.top_k(df, df.where("vec_id % 20 = 0"), k=7, group=64)
    assert Counter(map(tuple, got.collect())) == brute_top(x, list(range(300)), range(0, 300, 20), 7)


def test_op13_prunes(spark):
    rng = np.random.default_rng(5)
    x = np.floor(1024 * rng.normal(size=(4000, 32)) * 0.8 ** np.arange(32) * rng.uniform(0.05, 1, (4000, 1)))
    x = x[np.argsort(-(x * x).sum(1))]
    turn = op13.rotation(x.T @ x)
    best = op13.Best(40, 10, np.full(40, np.iinfo(np.int64).min))
    q, taken, pairs = x[::100], 0, 0
    for at in range(0, 4000, 500):
        a, b = op13.search(best, (np.arange(40) * 100, q), q @ turn, np.arange(at, at + 500), x[at : at + 500], turn)
        pairs, taken = pairs + a, taken + b
    assert pairs == 160_000 and taken < 60_000
    scores = q @ x.T
    for r in range(40):
        scores[r, 100 * r] = -np.inf
        want = sorted((-s, i) for i, s in enumerate(scores[r]))[:10]
        assert [(-s, i) for s, i in zip(best.score[best.row == r], best.id[best.row == r], strict=True)] == want


def test_op13_awkward(spark):
    rows = [(0, [1.0, 2.0], None), (0, [1.0, 2.0], None), (100, [1.0, 0.0], None), (None, [9.0, 9.0], None), (7, [1e30, -1e30], None), (8, None, None), (9, [1.0, 2.0, 3.0], None), (10, [0.0, 0.0], None)]
    df = vectors_frame(spark, rows)
    got = sorted(map(tuple, op13.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    big = op13.MOST * 1024
    # A repeated row is a candidate each time; it asks once.
    assert got == [(0, 1, 100, 1024 * 1024), (0, 2, 10, 0), (0, 3, 7, -big), (100, 1, 7, big), (100, 2, 0, 1024 * 1024), (100, 3, 0, 1024 * 1024), (100, 4, 10, 0)]
    assert op13.top_k(df.where("false"), df.where("false")).count() == 0
    assert op13.top_k(df, df.where("false")).count() == 0
    assert op13.pair_products(np.array([[2.0**24, 2.0**24], [1, 2]]), np.array([[2.0**24 - 1, 2.0**24], [3, 4]])).tolist() == [2**48 - 2**24 + 2**48, 11]
    assert op13.products(np.array([[2.0**24, 2.0**24]]), np.array([[2.0**24 - 1, 2.0**24]])).tolist() == [[2**48 - 2**24 + 2**48]]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least, top):
    docs, times, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)]
        docs[lang].update(set(found))
        times[lang, source].update(found)
    out = Counter()
    for lang in {g for g, _ in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        own = sorted((s for g, s in groups if g == lang), key=lambda s: s.encode())
        scaled = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p = {s: scaled(times[lang, s]) for s in own}
        q = scaled(sum((times[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if times[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out.update((lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found))
    return out


def audit_rows(seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcABCéßñ日"), int(rng.integers(1, 4)))) for _ in range(150)]
    rows = []
    for i in range(260):
        words = rng.choice(vocab, int(rng.integers(0, 60)))
        source = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((str(rng.choice([" ", "\n", "-", "1", "\x00", "_"])).join(words), [None, "de", "fr", "fr"][i % 4], source))
    rows += rows[:30]
    return rows + [("", "xx", "a"), (None, "xx", "b"), ("12 34", "xx", None), ("alone", "yy", "only"), ("z" * 9000 + " A", "fr", "s1"), (None, None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_op12_brute(spark, monkeypatch, small):
    if small:
        for name, value in (("HELD", 50), ("ROWS", 40), ("CELLS", 64), ("PIECE", 5)):
            monkeypatch.setattr(op12, name, value)
    rows = audit_rows()
    df = clashing(spark.createDataFrame(rows, "text string, lang string, source string").repartition(6))
    got = op12.source_divergence(df, least_docs=6, top=5)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_divergence(rows, 6, 5)


def test_op12_awkward(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert op12.source_divergence(none).count() == 0
    bare = spark.createDataFrame([(None, None, None), ("...", None, "a"), ("x", None, "b")], none.schema)
    got = sorted(map(tuple, op12.source_divergence(bare).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == [("", "", "pair", "a", 0, 1), ("", "", "pair", "b", 0, 2), ("", "a", "pair", "", 0, 1), ("", "a", "pair", "b", 0, 2), ("", "b", "pair", "", 0, 1), ("", "b", "pair", "a", 0, 2)]
    # Totals beyond 64 bits once multiplied.
    big, v = 9_000_000_000_000, 100
    assert op12.share(np.array([big, 0, 12345]), big, v).tolist() == [1 + 10**9 * (c + 2) // (big + 2 * v) for c in (big, 0, 12345)]
    text = ("ab " * 3_000_000).encode()
    assert sum(len(p.split()) for p in op12.pieces(text)) == 3_000_000
