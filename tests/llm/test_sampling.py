"""Importance resampling, hard negatives and fingerprints against brute force, and their defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import importance, negatives, winnowing
from tabularium.llm.common import numbered, span_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- resampling ----------------------------------------------------------------------------------------------------


def resampled(rows, target, orders=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank or None) run by run, in plain Python."""
    def runs(t):
        w = WORD.findall((t or "").translate(str.maketrans(importance.UPPER, importance.LOWER)))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(b for _, x in rows for b in runs(x)[1]), collections.Counter(b for x in target for b in runs(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for k, x in rows:
        w, own = runs(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(w), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = may[: len(may) * percent // 100]
    return sorted((r[0] is None, r[0], r[2], r[3], r[4]) for r in out), [(r[0], r[4]) for r in drawn]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma-delta", "été", "42", "X_y", "你好 omega", "the", "the"]) for _ in range(n))


@pytest.mark.parametrize("orders,piece,limit", [(1, 4096, 10**6), (3, 4, 10**6), (2, 4096, 0), (4, 2, 0)])
def test_resampling_by_brute_force(spark, monkeypatch, orders, piece, limit):
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance, "BROADCAST_BUCKETS", limit)
    rng = random.Random(orders)
    rows = [(i, words(rng, rng.choice([0, 1, 5, 19, 20, 30, 60]))) for i in range(120)]
    rows += [(None, words(rng, 40)), (None, None), (7, rows[7][1]), (9, words(rng, 25)), (200, None), (201, ""), (202, " .,-"), (203, words(rng, 3000))]
    target = ["the omega the omega", None, "", "alpha beta alpha beta 42"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", *[F.lit("x").alias(c) for c in ("rid", "words", "run", "bucket", "a.b")])
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), orders=orders, buckets=500, percent=30).collect()
    want, drawn = resampled(rows, target, orders, 500, 30)
    assert sorted((r.doc_id is None, r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r.doc_id, r.score) for r in ranked] == drawn and [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))


def test_resampling_of_one_key_and_of_nothing(spark):
    text = "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([(5, text)] * 300, "doc_id long, text string")
    target = spark.createDataFrame([("one",)], "text string")
    got = importance.resample(docs, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31)) and len({r.score for r in got}) == 1
    assert importance.resample(docs.limit(0), target).collect() == []
    assert {r["rank"] for r in importance.resample(docs.limit(9), target.limit(0)).collect()} == {None}


def test_text_keys_and_numbers_by_ranges(spark):
    docs = spark.createDataFrame([(f"k{i}", "w " * 20) for i in range(30)], "doc_id string, text string")
    got = importance.resample(docs, docs).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    rows = spark.range(1000).select((F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    placed = numbered(rows, [F.desc("a"), F.asc("b")], "n").collect()
    assert [(r.a, r.b) for r in sorted(placed, key=lambda r: r.n)] == sorted(((i % 10, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert sorted(r.n for r in placed) == list(range(1, 1001))


# --- hard negatives ------------------------------------------------------------------------------------------------


def mined(rows, every=100, likes=5, negatives_=5, low=80):
    rows = [(k, y, [math.floor(256 * x) for x in v]) for k, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [list(r) for r in {(k, y, tuple(v)) for k, y, v in rows}]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        scored = [(max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(a[2], b[2])))), b[0], b[1]) for b in rows if b is not a]
        for s, k, _ in sorted((x for x in scored if x[2] == a[1]), key=order)[:likes]:
            near = sorted((x for x in scored if x[2] != a[1] and low * s <= 100 * x[0] <= 100 * s), key=order)[:negatives_]
            out += [(a[0], k, i + 1, x[1], s, x[0]) for i, x in enumerate(near)]
    return sorted(map(str, out))


def vectors(rng, n, size, spread, centres):
    c = rng.normal(size=(centres, size))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, size))
    return (v / np.linalg.norm(v, axis=1)[:, None]).tolist()


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("spread,limit,pivots", [(0.05, 100_000, 16), (0.3, 0, 16), (2.0, 100_000, 3)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, spread, limit, pivots):
    for name, value in (("PIVOTS", pivots), ("ANCHORS", 3), ("CANDIDATES", 40), ("BROADCAST_ROUTES", limit)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(vectors(rng, 400, 12, spread, 6))]
    rows += [rows[10], (400, None, 1), (401, [0.1] * 12, None), (402, [float("nan")] + [0.0] * 11, 1), (403, [None, 0.2], 1), (404, [float("inf")] * 12, 1)]
    rows += [(420, [0.5, 0.5], 2), (440, [], 2), (None, rows[3][1], 1), (None, [0.3] * 12, 2)]
    rows += [(500 + i, rows[20][1], i % 2) for i in range(60)]  # one very common vector
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(1).alias(c) for c in ("rid", "v", "far", "cell", "block", "piece", "id")])
    got = negatives.mine(spark, df, every=20)
    assert sorted(str(tuple(r)) for r in got.collect()) == mined(rows, 20)


@pytest.mark.parametrize("unit", [1e3, 1e7])  # products beyond 2**53, and beyond 64 bits
def test_hard_negatives_of_large_numbers(spark, unit):
    rng = np.random.default_rng(3)
    rows = [(i, (unit * rng.integers(1, 1000, 3)).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(tuple(r)) for r in negatives.mine(spark, df, every=10).collect()) == mined(rows, 10)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(i, [1.0, i / 60], i % 2) for i in range(60)], SCHEMA)
    assert negatives.mine(spark, df.limit(0)).collect() == []
    assert negatives.mine(spark, df.where("label = 0"), every=10).collect() == []
    assert negatives.mine(spark, df.where("vec_id = 10"), every=10).collect() == []
    assert negatives.mine(spark, df.where("vec_id % 10 > 0"), every=10).collect() == []


def test_rows_go_only_where_they_may_serve(spark):
    """With well separated clusters of one label each and two labels a cluster, bounds leave out most rows."""
    rng = np.random.default_rng(8)
    rows = [(i, v, int(rng.integers(0, 2))) for i, v in enumerate(vectors(rng, 600, 16, 0.01, 8))]
    sent = []
    plain = negatives.joined

    def counted(anchors, rows, routes, on, share, schema, small):
        between = (F.col("far") >= F.col("lo")) & (F.col("far") <= F.col("hi"))
        sent.append((rows.join(routes, [*on, "cell"]).where(between).count(), rows.join(routes, [*on, "cell"]).count()))
        return plain(anchors, rows, routes, on, share, schema, small)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(negatives, "joined", counted)
        m.setattr(negatives, "ANCHORS", 4)
        m.setattr(negatives, "PIVOTS", 32)
        got = negatives.mine(spark, spark.createDataFrame(rows, SCHEMA), every=20).collect()
    assert sorted(str(tuple(r)) for r in got) == mined(rows, 20)
    assert all(some < 0.7 * every for some, every in sent), sent


# --- fingerprints --------------------------------------------------------------------------------------------------


def picked(text, gram, window):
    if not text:
        return []
    codes = np.array([ord(c) for c in text], np.uint32)
    h = [int(span_hashes(codes, np.array([i]), np.array([min(len(text), i + gram)]))[0]) >> 32 for i in range(max(1, len(text) - gram + 1))]
    out = []
    for a in range(max(1, len(h) - window + 1)):
        own = h[a : a + window]
        at = a + max(i for i, x in enumerate(own) if x == min(own))
        if not out or out[-1][1] != at:
            out.append((h[at], at))
    return out


RNG = random.Random(1)
TEXTS = ["", "a", "ab" * 50, "x" * 400, None, *["".join(RNG.choices("abc dé😀", k=RNG.randint(1, 500))) for _ in range(20)]]


@pytest.mark.parametrize("block", [winnowing.BLOCK, 100])
@pytest.mark.parametrize("gram,window", [(16, 64), (3, 4), (5, 1), (1, 7)])
def test_winnowing_by_brute_force(monkeypatch, block, gram, window):
    monkeypatch.setattr(winnowing, "BLOCK", block)
    for text, (h, pos) in zip(TEXTS, winnowing.winnow(TEXTS, gram, window)):
        assert list(zip(h.tolist(), pos.tolist())) == picked(text, gram, window)


def test_shared_passages_are_found():
    rng = random.Random(2)
    for _ in range(50):
        word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
        passage = word(winnowing.GRAM + winnowing.WINDOW - 1)
        (a, _), (b, _) = winnowing.winnow([word(rng.randint(0, 300)) + passage + word(200), word(rng.randint(0, 300)) + passage + word(90)])
        assert set(a.tolist()) & set(b.tolist())


def compared(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    out = []
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        prints = [picked(x, winnowing.GRAM, winnowing.WINDOW) for x in (t, changed, following)]
        a, b, c = ({h for h, _ in p} for p in prints)
        alike = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        out.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), *["".join(f"{h:08x}" for h, _ in p) for p in prints[:2]], alike(a, b), alike(a, c)))
    return sorted(map(str, out))


CASES = {
    "plain": list(enumerate(TEXTS)), "null keys": [(None, t) for t in TEXTS], "one": [(1, "abcdef")], "one row many times": [(7, TEXTS[8])] * 40,
    "mixed": [(RNG.choice([None, 1, 2, 3, 9, 9, 9, 9]), RNG.choice(TEXTS)) for _ in range(60)], "crowded": [(5, TEXTS[9])] * 20 + [(5, TEXTS[10])] * 9 + list(enumerate(TEXTS)),
}


@pytest.mark.parametrize("name", CASES)
def test_fingerprints_by_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(winnowing, "COPIES", 3)
    docs = spark.createDataFrame(CASES[name], "doc_id long, text string").repartition(3).select("*", *[F.lit("x").alias(c) for c in ("part", "digest", "copies", "in", "head", "a.b")])
    assert sorted(str(tuple(r)) for r in winnowing.with_next(spark, docs).collect()) == compared(CASES[name])


def test_fingerprints_of_long_texts_text_keys_and_nothing(spark):
    long = "".join(RNG.choices("abcdefgh \n", k=1_500_000))
    docs = spark.createDataFrame([("b", long), ("a", long), ("c", "short"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in winnowing.with_next(spark, docs).collect()}
    assert got["a"].fingerprint == got["b"].fingerprint and got["b"].near_next == 1.0 and got["a"].near_next == 0.0
    assert got["b"].edited_sha256 == hashlib.sha256((long[:750_000] * 2).encode()).hexdigest() and 0.49 < got["b"].near_edited < 0.51
    assert (got[None].fingerprint, got[None].near_next) == ("", 0.0)
    assert winnowing.with_next(spark, docs.limit(0)).collect() == []
    found = docs.select("doc_id", winnowing.fingerprint(F.col("text")).alias("f")).where("doc_id = 'c' OR doc_id IS NULL").collect()
    assert sorted((str(r.doc_id), [x.pos for x in r.f]) for r in found) == [("None", []), ("c", [0])]
