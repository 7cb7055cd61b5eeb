"""Cases that every corpus operator and stage defines, and comparisons with SQL and brute force on small tables."""

import glob
import math
import os
import random
import re
import struct

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabularium.llm import common, decontaminate, language, licenses, media, mixing, quality, queries, secrets, simhash, token_shards, toxicity

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, `a.b` string, `found` int, `row` string, grp int, `class` string, hash int, size string, k string, t int, lang_pred string, score string, features int, chunk int"
TEXTS = ["the cat sat on the mat", None, "", "der Hund und die Katze", "the cat sat on the mat", "All rights reserved. token=abcdef1", "123"]
TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Clashing and dotted column names, null and repeated keys, nulls in every column."""
    rows = [(i if i != 5 else None, t, "de" if i == 3 else "en", f"s{i % 2}", "x.y", i, "r", 7, "c", 1, "z", "k", 2, "l", "s", 3, 4) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (3, "another text under a repeated key", "en", *[None] * 14), (8, *[None] * 16)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "cat sat on"), (None, "Hund und"), (3, None), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(0, None, None), (None, 1, 1), (70, 1, 0), (3, 7, 7)], "doc_id long, quality int, toxic int")


def every(spark, docs, labels, benchmark):
    return {
        "tokens": token_shards.token_shards(spark, docs, TOKENS), "quality": quality.document_quality(spark, docs, labels), "media": media.media_features(media.with_media(docs)),
        "language": language.identify(spark, docs), "simhash": simhash.near_duplicates(docs), "licenses": licenses.scan(spark, docs), "secrets": secrets.scan(docs),
        "mixing": mixing.mix(docs), "toxicity": toxicity.document_toxicity(spark, docs, labels), "decontaminate": decontaminate.decontaminate(spark, docs, benchmark),
    }


def test_odd_columns_nulls_and_repeats(spark, odd, labels, benchmark):
    keys = sorted(str(r[0]) for r in odd.select("doc_id").collect())
    for name, df in every(spark, odd, labels, benchmark).items():
        assert sorted(str(r.doc_id) for r in df.collect()) == keys, name


def test_empty_tables(spark, odd, labels, benchmark):
    for name, df in every(spark, odd.limit(0), labels.limit(0), benchmark.limit(0)).items():
        assert df.collect() == [], name
    for name, df in every(spark, odd, labels.limit(0), benchmark.limit(0)).items():
        assert df.count() == odd.count(), name


def test_stages_keep_odd_columns(spark, odd, benchmark, tmp_path):
    sf = str(tmp_path)
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns and {str(tuple(r)) for r in got.collect()} <= {str(tuple(r)) for r in odd.collect()}, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == odd.count()


def test_text_keys(spark, labels, benchmark):
    docs = spark.createDataFrame([(f"k{i}", t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id string, text string, lang string, source string")
    named = labels.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    for df in (quality.document_quality(spark, docs, named), media.media_features(media.with_media(docs)), language.identify(spark, docs), simhash.near_duplicates(docs), licenses.scan(spark, docs), secrets.scan(docs), mixing.mix(docs), decontaminate.decontaminate(spark, docs, benchmark)):
        assert sorted(r.doc_id for r in df.collect()) == [f"k{i}" for i in range(len(TEXTS))]


def test_texts_of_several_megabytes(spark, labels, benchmark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    words = rng.choices(vocabulary, k=400_000)
    words[300_000:300_003] = ["cat", "sat", "on"]
    words[350_000:350_003] = ["All", "rights", "reserved"]
    words[200_000] = "token=abcdef1"
    long = "".join(w + ("\n" if i % 20 == 0 else " ") for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "short", "en", "b"), (3, "x" * 3_000_000, "en", "b"), (4, long, "en", "b")], "doc_id long, text string, lang string, source string")
    got = {k: {r.doc_id: r for r in v.collect()} for k, v in every(spark, docs, labels, benchmark).items()}
    assert all(len(v) == 4 for v in got.values())
    assert got["decontaminate"][1].n_hit == 3 and got["decontaminate"][1].n_words == len(re.findall("[A-Za-z0-9]+", long))
    assert [m.name for m in got["licenses"][1].matches] == ["reserved"] and got["licenses"][3].n_matches == 0
    assert got["secrets"][1].n_assign == 1 and got["mixing"][1].size == len(words)
    assert got["simhash"][4].component_id == 1 and got["simhash"][3].fingerprint != got["simhash"][1].fingerprint
    assert got["media"][1].n_bytes == len(long) and got["media"][1].payload_sha256 == got["media"][4].payload_sha256


# --- SQL -----------------------------------------------------------------------------------------------------------


def _plain(rows):
    return sorted(str([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert _plain(got.select(*want.columns).collect()) == _plain(want.fetchall())


def test_mixing_of_many_sources_by_sql(spark, monkeypatch):
    """Sources that reach their limits, a null one, one without words and one with most of the rows; several levels of chunks."""
    monkeypatch.setattr(mixing, "CHUNK", 3)
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        s = "big" if i % 2 else rng.choice([None, "", "é", "z", *[f"s{k}" for k in range(9)]])
        rows.append((rng.randint(0, 400) if i % 7 else None, " ".join(["w"] * (0 if s == "z" else rng.choice([0, 1, 3, 40]) * (1 + len(s or "")))), s))
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = duck.sql(mixing.ORACLE_SQL)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    assert _plain(got.select(*want.columns).collect()) == _plain(want.fetchall())
    taken = {r.target: 0 for r in got.collect()}
    for r in got.collect():
        taken[r.target] += r.taken
    assert any(t > 0 for t in taken)


# --- brute force ---------------------------------------------------------------------------------------------------


def test_language_by_brute_force():
    """Counts and scores written out n-gram by n-gram."""
    rows = [("abc abd", "x"), ("Xyz xyw", "y"), ("é abc", "x"), ("zz", "y"), ("", "y")]
    model = language.fit(rows)

    def grams(t):
        t = f" {t.lower()} "
        for n in language.ORDERS:
            codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            for i in range(len(t) - n + 1):
                yield int(language._grams(codes[i : i + n], n)[0])

    count = {lang: [0.5] * language.BUCKETS for lang in "xy"}
    for t, lang in rows:
        for g in grams(t):
            count[lang][g] += 1
    total = {lang: sum(c) for lang, c in count.items()}
    prior = {lang: math.log(sum(r[1] == lang for r in rows) / len(rows)) for lang in "xy"}
    texts = ["abc", "zz top", "É", "xyzabc " * 30]
    for t, s in zip(texts, model.scores(texts)):
        want = [prior[lang] + language.TEMPER * sum(math.log(count[lang][g] / total[lang]) for g in grams(t)) for lang in "xy"]
        assert s.tolist() == pytest.approx(want, rel=1e-4)


def _plain_align(template, text, need):
    """The best local alignment over all cells."""
    best, above = (0, 0, 0, 0), [(0, 0, 0)] * (len(text) + 1)
    for a in template:
        row = [(0, 0, 0)]
        for j, b in enumerate(text):
            s, m, at = above[j] if above[j][0] > 0 else (0, 0, j)
            cell = (s + 1, m + 1, at) if a == b else (s - 1, m, at)
            for s, m, at in (above[j + 1], row[j]):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, at)
            row.append(cell)
            if a == b and cell[1] >= need and (cell[0], cell[1]) > best[:2]:
                best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1:]


def test_licenses_by_brute_force():
    """Planted templates with few edits, against alignment of every template with the whole text."""
    rng = random.Random(5)
    templates = {"long": " ".join(f"l{i}" for i in range(40)), "mid": " ".join(f"m{i}" for i in range(17)), "short": "a b c d e", "two": "p q", "one": "solo", "none": "..."}
    index = licenses.Index.build(templates)
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.choice("uvwxyz") for _ in range(rng.randint(5, 30))]
            copy = templates[rng.choice(list(templates))].split()
            for _ in range(rng.randint(0, max(0, len(copy) // 12 + 1))):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[], ["v"], [copy[i], "w"]])
                copy = copy or ["u"]
            words += copy
        (found,) = index.find([" ".join(words)])
        for name, template in templates.items():
            t = re.findall("[a-z0-9]+", template)
            want, free = set(), [(0, len(words))] if t else []
            while free:
                x, y = free.pop()
                m, s, e = _plain_align(t, words[x:y], math.ceil(licenses.LEAST * len(t) - 1e-9))
                if m:
                    want.add((x + s, x + e, m))
                    free += [(x, x + s), (x + e, y)]
            starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
            assert {(starts.index(a), round(c * len(t))) for a, _, n, c in found if n == name} == {(s, m) for s, _, m in want}, (name, words)


def test_winnowed_fingerprints_leave_no_long_run_out():
    h = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    kept = licenses.winnow(h, 3)
    assert all(any(i <= k < i + 3 for k in kept) for i in range(198)) and len(kept) < 150
    assert licenses.Index.build({}).find(["any text"]) == [[]] and licenses.Index.build({"x": ""}).find(["any text"]) == [[]]


def test_network_by_plain_forward_pass():
    """Gates, attention and pooling written out word by word."""
    net, texts = toxicity.Network(), ["one two three", "a b a c d", ""]
    w = toxicity.windows(texts)
    got, p, n = net.scores(w), net.p, toxicity.STATE
    x = net.inputs(w).astype(float)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for i in range(len(w.at)):
        words = [k - 1 for k in w.at[i] if k > 0]
        states = {}
        for d in "fb":
            h, out = np.zeros(n), {}
            for t in range(len(words)) if d == "f" else reversed(range(len(words))):
                g, r = x[words[t]] @ p[f"in_{d}"] + p[f"b_{d}"], h @ p[f"rec_{d}"]
                z, reset = sig(g[:n] + r[:n]), sig(g[n : 2 * n] + r[n : 2 * n])
                h = (1 - z) * np.tanh(g[2 * n :] + reset * r[2 * n :]) + z * h
                out[t] = h
            states[d] = out
        both = [np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(words))]
        if not both:
            assert got[i] == pytest.approx(float(p["bias"][0]), abs=1e-5)
            continue
        a = np.exp([v @ p["attend"] for v in both])
        assert got[i] == pytest.approx(float(sum(k * v for k, v in zip(a / a.sum(), both)) @ p["out"] + p["bias"][0]), abs=1e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 12, 13, 24, 25, 36, 37, 100):
        w = toxicity.windows([" ".join(f"w{i}" for i in range(n)), "z"])
        own = w.at[w.doc == 0]
        assert {int(k) for k in own.ravel() if k} == set(np.unique(own[own > 0]).tolist()) and len(np.unique(own[own > 0])) == n


def test_line_features_by_hand():
    x, length, first = quality.line_features(["Ab 1!\nab ab", None, "ab ab\n\nab ab"])
    assert length.tolist() == [5, 5, 0, 5, 0, 5] and first.tolist() == [0, 2, 3, 6]
    assert x[0, 2] == pytest.approx(1 / 5) and x[0, 3] == pytest.approx(1 / 5)  # capitals, digits
    assert x[1, 10] == pytest.approx(1 / 2)  # a word that was there just before
    own = (x.shape[1] - 3) // 3
    assert x[1, own : 2 * own].tolist() == x[0, :own].tolist() and not x[0, own : 2 * own].any()  # the line before
    assert x[5, :own].tolist()[14] == 1.0 and x[3, :own].tolist()[14] == 0.0  # seen before in the document


def test_decontamination_by_brute_force(spark, monkeypatch):
    """Random texts over few words, whole shards indexed, blocks broadcast and as files."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BLOCKS", 1)
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(["a", "B", "c", "dd", "É", "9"]) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 5, 13, 16, 30]))) for i in range(12)]
    docs = [(i, make(rng.choice([0, 1, 4, 40, 300])) + (" " + items[i % 12][1] if i % 2 else "")) for i in range(40)]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    want = []
    for k, t in docs:
        w, hit, found = cut(t), set(), set()
        for i, b in items:
            b = cut(b)
            n = min(13, len(b))
            windows = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(i)
        want.append((k, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chars in (20, 10**6):
        got = decontaminate.decontaminate(spark, df, bench, chars=chars).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


@pytest.mark.parametrize("symbols", [2, 3, 70_000])
def test_suffix_array_by_sorting(symbols):
    rng = np.random.default_rng(symbols)
    for n in (0, 1, 2, 50, 257):
        s = np.append(rng.integers(1, symbols, n) if n < 200 else np.tile(rng.integers(1, symbols, 50), 5), 0).astype(np.int32)
        assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_secrets_with_very_many_matches(spark):
    text = " ".join(f"é token=abcdef{i}" for i in range(1300)) + " x" * 50
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_assign == 1300
    assert row.spans == ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=[A-Za-z0-9]+", text))


# --- damaged and other media ---------------------------------------------------------------------------------------


def test_damaged_media(spark):
    (good,) = media.encode([bytes(range(64))])
    streams = [good, None, b"", b"no image", good[:-40], good[:200], good.replace(b"\xff\xc0", b"\xff\xc2"), good + b"junk"]
    big = bytearray(good)
    at = good.index(b"\xff\xc0")
    big[at + 5 : at + 9] = struct.pack(">HH", 65535, 65535)
    df = spark.createDataFrame([(i, s, "a") for i, s in enumerate([*streams, bytes(big)])], "doc_id long, media binary, `x.y` string")
    got = {r.doc_id: r for r in media.media_features(df).collect()}
    assert len(got) == 9 and got[0].problem is None and got[0].payload_bytes == 64 and got[0]["x.y"] == "a"
    assert all(got[i].problem and got[i].feature is None for i in range(1, 9)) and got[1].media_bytes is None and got[3].media_bytes == 8


def test_media_of_several_scans():
    """Three components, a scan each: the thumbnail is that of the first."""
    dc = bytes([0x00, 0, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3])
    ac = bytes([0x10, 1] + [0] * 15 + [0])
    s = media._segment

    def scan(component, diffs):
        bits = "".join("100" + ("10" if d > 0 else "01") + "0" if d else "00" + "0" for d in diffs)
        bits += "1" * (-len(bits) % 8)
        return s(0xDA, bytes([1, component, 0, 0, 63, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

    head = bytes([0xFF, 0xD8]) + s(0xDB, bytes([0, 16] + [1] * 63)) + s(0xC0, bytes([8, 0, 16, 0, 24, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])) + s(0xC4, dc + ac)
    image = head + scan(1, [2, 0, -2, 2, 0, 0]) + scan(2, [2, 2, 2, 2]) + scan(3, [0, 0, 0, 0]) + bytes([0xFF, 0xD9])
    ((frame, thumb),) = media.decode([image])[0]
    assert (frame.width, frame.height) == (24, 16) and thumb.tolist() == [[132, 132, 128], [132, 132, 132]]


# --- shared folders ------------------------------------------------------------------------------------------------


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_names_of_stores():
    assert common.filesystem("/tmp/x")[1] == "/tmp/x" and common.filesystem("file:/tmp/x")[1] == "/tmp/x"
    assert common.SCHEMES["s3a"] == "s3"


# --- windows that many items share, words with one hash, long labelled texts, keys that look alike ------------------


def _decontaminated_by_sql(docs, items):
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    duck.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    return sorted(duck.sql(decontaminate.ORACLE_SQL).fetchall())


def test_items_that_share_windows(spark):
    rng = random.Random(4)
    prompt = " ".join(f"p{i}" for i in range(15))
    items = [(i, f"{prompt} q{i}" if i % 3 else "yes") for i in range(3000)]
    docs = [(i, " ".join(rng.choices(["yes", "no", "p1", prompt, "other"], k=rng.randint(0, 30)))) for i in range(60)] + [(100, "yes " * 500)]
    got = decontaminate.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.drop("spans").collect())) == _decontaminated_by_sql(docs, items)
    block = decontaminate.Block.build(items)
    assert len(block.start) == 1 + 3 + 2000  # "yes", the prompt's own windows, and one window to each item's end
    assert len(decontaminate.Shard([prompt] * 9).find(block)[0]) == 27


def test_words_with_one_hash(monkeypatch):
    monkeypatch.setattr(decontaminate, "span_hashes", lambda data, begin, end: (end - begin).astype(np.uint64))
    items = [(1, "cat dog"), (2, "dog cat"), (3, "bird"), (4, "fish cat")]
    block = decontaminate.Block.build(items)
    shard = decontaminate.Shard(["a cat dog cat", "dog dog", "bird fish", "fis cat dog"])
    which, word, doc = shard.find(block)
    found = {(items[i][0], d) for d, i in zip(*(x.tolist() for x in block.items(which, doc)))}
    assert found == {(1, 0), (2, 0), (3, 2), (1, 3)} and sorted(word.tolist()) == [1, 2, 6, 9]


def test_spans_of_each_text(spark):
    docs = spark.createDataFrame([(1, "x cat sat y cat"), (2, "cat sat"), (3, "sat cat sat cat sat"), (4, None)], "doc_id long, text string").coalesce(1)
    got = decontaminate.decontaminate(spark, docs, spark.createDataFrame([(1, "cat sat"), (2, "y")], "item_id long, text string"))
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got.collect()} == {1: [(1, 4)], 2: [(0, 2)], 3: [(1, 5)], 4: []}


def test_long_texts_of_a_label_or_language_are_learned(spark, monkeypatch):
    monkeypatch.setattr(common, "SAMPLE_CHARS", 2000)
    german, english = "der Hund und die Katze laufen im Garten. ", "the cat and the dog run in the garden. "
    rows = [(i, (german if i % 2 else english) * (300 if i % 2 else 3), "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(spark, docs)
    assert model.languages == ["de", "en"] and model.predict([german, english])[0] == ["de", "en"]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(i, 0, 0) for i in range(1000, 3000)], "doc_id long, quality int, toxic int")
    sample, counts = quality.labelled_sample(spark, docs, labels, "quality", 5, 0, 20)
    assert {y for _, y in sample} == {0, 1} and counts[0] + counts[1] < 60  # labels without a document aren't picked
    assert max(len(t) for t, _ in sample) <= 2000 + common.STRETCHES and sum(y for _, y in sample) > 5


def test_excerpts(spark, monkeypatch):
    long = "".join(chr(97 + i % 26) for i in range(10_000))
    rows = spark.createDataFrame([(long,), ("short",), ("x" * 900,)], "t string")
    monkeypatch.setattr(common, "SAMPLE_TOTAL", 2000)
    got = sorted((r.t for r in common.excerpts(rows, "t").collect()), key=len)
    assert got[:2] == ["short", "x" * 900] and 1000 < len(got[2]) <= 2000 - 905 + common.STRETCHES
    parts = got[2].split("\n")
    assert len(parts) == common.STRETCHES and all(p in long for p in parts) and long.startswith(parts[0]) and long.endswith(parts[-1])
    monkeypatch.setattr(common, "SAMPLE_TOTAL", 10**6)
    assert sorted(r.t for r in common.excerpts(rows, "t").collect()) == sorted([long, "short", "x" * 900])


def test_keys_and_texts_that_join_alike_stay_apart(spark):
    rows = [("a", "b:alpha beta gamma delta"), ("a:b", "alpha beta gamma delta"), (None, "epsilon zeta eta theta"), ("", "iota kappa lambda mu"), ("n", None), ("t", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if r.doc_id != "t")  # no text and an empty one are one group


def test_text_keys_in_stages(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([("i:1", "one two")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame([(f"k:{i}", f"word{i} and text {i} more", "en", "s") for i in range(20)] + [(None, "null key", "en", None), ("", "one two", "en", "s")], "doc_id string, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf).collect()
        assert {str(r) for r in got} <= {str(r) for r in docs.collect()}, name
        assert len(got) == (21 if "decont" in name else 22 if "mixing" not in name else len(got)), name
