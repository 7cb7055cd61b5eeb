"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, buckets by languages, learned from a bounded sample of labelled rows and
broadcast (its size is fixed by the number of buckets and languages). Texts are scored in batches: the n-grams of all
texts of a batch are hashed at once from their code points, and their matrix rows are summed up by text.

Defined cases: a null text, and one without a letter, is ``und`` with score 1; texts that are no longer than an n-gram
are scored by the shorter n-grams; long texts are scored whole, block by block; rows with a null language are not
learned from; with no labelled row at all every text is ``und`` with score 0; repeated rows stay (the sample has each
once); a null key isn't held out, and keys may be of any type; ties go to the language first by code point; an empty
table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, excerpts, key_remainder, picked_rows, quoted

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Most labelled rows a language that the model is fitted on (excerpts of very long ones).
PER_LANGUAGE = 600
#: Every n-gram counts as this much evidence: n-grams overlap, so they are far from independent.
TEMPER = 0.2
UNDETERMINED = "und"
#: Code points worked on at once.
BATCH = 400_000
#: Positions whose matrix rows are looked up at once, within a long text too.
BLOCK = 1 << 16


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each position (the last order - 1 positions have none)."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int32)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, a blank before and after each, and where each begins."""
    lowered = [f" {t.lower()} " for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), begin


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    table: np.ndarray  # buckets x languages, float32

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood and prior of each text by language."""
        codes, begin = _codes(texts)
        out = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        for order in ORDERS:
            grams = _grams(codes, order)
            last = np.maximum(begin[1:] - order + 1, begin[:-1])  # n-grams stay within their text
            for a in range(0, len(grams), BLOCK):
                rows = self.table[grams[a : a + BLOCK]]
                total = np.zeros((len(rows) + 1, rows.shape[1]))
                np.cumsum(rows, axis=0, dtype=np.float64, out=total[1:])
                i, j = np.searchsorted(begin, [a, a + len(rows)], "right")  # texts i - 1 to j - 1 reach into the block
                own = slice(i - 1, min(j, len(texts)))
                out[own] += TEMPER * (total[np.clip(last[own] - a, 0, len(rows))] - total[np.clip(begin[:-1][own] - a, 0, len(rows))])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, sure = [UNDETERMINED] * len(texts), np.ones(len(texts))
        if not self.languages:
            return names, np.zeros(len(texts))
        asked = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        a = 0
        while a < len(asked):
            b, size = a, 0
            while b < len(asked) and (b == a or size < BATCH):
                size += len(texts[asked[b]])
                b += 1
            s = self.scores([texts[i] for i in asked[a:b]])
            p = np.exp(s - s.max(axis=1, keepdims=True))
            best = s.argmax(axis=1)
            for i, k, v in zip(asked[a:b], best.tolist(), p[np.arange(b - a), best] / p.sum(axis=1)):
                names[i], sure[i] = self.languages[k], v
            a = b
        return names, sure


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, language) rows; add-one smoothing over the buckets each order has seen."""
    languages = sorted({lang for _, lang in rows})
    count = np.zeros((len(languages), BUCKETS))
    for k, lang in enumerate(languages):
        own = [t for t, x in rows if x == lang]
        for a in range(0, len(own), 50):
            codes, begin = _codes(own[a : a + 50])
            left = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(codes))  # code points to the end of the text
            for order in ORDERS:
                grams = _grams(codes, order)
                count[k] += np.bincount(grams[left[: len(grams)] >= order], minlength=BUCKETS)
    share = (count + 0.5) / (count + 0.5).sum(axis=1, keepdims=True) if languages else count
    docs = np.array([sum(x == lang for _, x in rows) for lang in languages], float)
    return Model(languages, np.log(docs / docs.sum()) if languages else docs, np.log(share).T.astype(np.float32).copy())


def train(spark: SparkSession, docs: DataFrame, *, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most ``per_language`` rows of each language of ``docs``, picked by a hash of key and text."""
    rows = docs.select(quoted(key).cast("string").alias("k"), quoted(text).cast("string").alias("t"), quoted(lang).cast("string").alias("l"))
    rows = rows.where(F.col("t").isNotNull() & F.col("l").isNotNull())
    ids = picked_rows(rows, "l", per_language, ["k", "t"])  # bounded by languages x per_language rows of 8 bytes
    same = (F.col("l") == F.col("s")) & (F.xxhash64(F.lit(7), "k", "t") == F.col("h"))
    found = rows.join(F.broadcast(ids), same).groupBy("s", "h").agg(F.min("t").alias("t"))  # a repeated row comes once
    return fit(sorted((r.t, r.s) for r in excerpts(found, "t").collect()))


def prediction(spark: SparkSession, text: Column, model: Model) -> Column:
    """(lang_pred, score) of a text."""
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by buckets x languages

    def work(texts: list) -> pa.Array:
        names, sure = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["lang_pred", "score"])

    return by_text("lang_pred string, score double", work)(text.cast("string"))


def identify(spark: SparkSession, docs: DataFrame, *, modulus: int = 4, held: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row's doc_id, held_out, lang_pred and score, learned from the rows whose key's crc32 isn't ``held`` modulo ``modulus``."""
    own = F.coalesce(key_remainder(key, modulus) == held, F.lit(False))
    model = train(spark, docs.where(key_remainder(key, modulus) != held), key=key, text=text, lang=lang)
    rows = docs.select(quoted(key).alias("doc_id"), own.alias("held_out"), prediction(spark, quoted(text), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
