"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rolled) by its place; a text's vector
bundles (adds) the vectors of its n-grams. The prototype of a language bundles the
unit vectors of its training documents; a document gets the language of the
prototype with the largest cosine.

Letters are lower-cased; everything else separates words, as one blank that is a
letter of its own. The model is fitted on a bounded sample of labelled rows; all
rows are judged.
"""

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
GRAM = 3
SEED = 20_011
#: Training documents per language, at most (expected; picked by a hash of the id).
MAX_TRAIN = 20_000
#: N-gram vectors that a task keeps.
CACHE = 1 << 14
#: Texts whose vectors are made at once.
BATCH = 128
UNKNOWN = "und"
#: A text in a language reaches at least this share of the median cosine of its size; texts with
#: fewer characters are not judged. Random letters reach some 0.1 of it, a word said over and over 0.2.
FLOOR, JUDGED = 0.15, 64


class Encoder:
    """Text vectors. Letter vectors depend on the seed and the letter alone, so every
    task makes the same ones."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        self.dim, self.gram, self.seed = dim, gram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.known = np.full(sys.maxunicode + 1, -1, np.int8)  # -1: not yet looked up; else: is a letter
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, dim), np.int8)  # of +1/-1; the worker keeps it, also in later stages

    def _letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = self.letters[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.int8), self.dim)
        return v

    def _codes(self, text: str) -> np.ndarray:
        """Letters of the text, a zero between words and at both ends; empty if it has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        new = np.unique(codes[self.known[codes] < 0])
        for c in new.tolist():
            self.known[c] = unicodedata.category(chr(c))[0] == "L"
        codes = np.where(self.known[codes] > 0, codes, 0).astype(np.int64)
        if not codes.any():
            return codes[:0]
        codes = np.concatenate(([0], codes, [0]))
        return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]

    def _grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = self._codes(text)
        if not len(codes):
            return codes, codes
        n = len(codes) - self.gram + 1
        key = np.zeros(n, np.int64)
        for k in range(self.gram):
            key = (key << 21) | codes[k:k + n]
        return np.unique(key, return_counts=True)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the table that hold the n-grams' vectors, which are made where missing."""
        if len(self.rows) + len(keys) > CACHE:
            self.rows.clear()
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            at = self.rows.get(key)
            if at is None:
                at = self.rows[key] = len(self.rows)
                if at >= len(self.table):
                    self.table = np.concatenate((self.table, np.empty_like(self.table)))
                v = np.ones(self.dim, np.int8)
                for k in range(self.gram):
                    code = key >> 21 * (self.gram - 1 - k) & 0x1FFFFF
                    v = v * np.roll(self._letter(code), self.gram - 1 - k)
                self.table[at] = v
            out[i] = at
        return out

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of the texts; zero for a text without letters."""
        found = [self._grams(t) for t in texts]
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.zeros((len(texts), len(keys)), np.float32)
        at = 0
        for i, (k, n) in enumerate(found):
            counts[i, back[at:at + len(k)]] = n
            at += len(k)
        out = np.zeros((len(texts), self.dim), np.float32)
        for a in range(0, len(keys), CACHE // 4):
            part = slice(a, a + CACHE // 4)
            at = self._places(keys[part])
            out += counts[:, part] @ self.table[at].astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


@lru_cache(maxsize=2)
def encoder(dim: int, gram: int, seed: int) -> Encoder:
    """The worker's encoder, kept for its next tasks."""
    return Encoder(dim, gram, seed)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dim: int = DIM,
          gram: int = GRAM, seed: int = SEED, max_train: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    """Prototypes by language from the rows of ``docs`` with a language.

    A language with more than ``max_train`` rows gives about that many, picked by a
    hash of the id. The driver gets one row per language.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.xxhash64(F.col(f"`{doc_id}`"), F.lit(seed)).alias("h")).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count()
    share = F.lit(float(max_train)) / F.col("count")
    # A row per language, as many as the prototypes that the driver holds in the end; no text is shuffled.
    rows = rows.join(F.broadcast(counts), "lang").filter(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)

    def bundle(batches):
        enc, sums = encoder(dim, gram, seed), {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(texts), BATCH):
                vectors = enc.vectors(texts[a:a + BATCH])
                for k, v in zip(langs[a:a + BATCH], vectors):
                    sums[k] = sums.get(k, 0) + v.astype(np.float64)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * dim, pa.string()), pa.array(np.arange(dim), pa.int32()), pa.array(v)], names=["lang", "place", "value"])

    sums = rows.select("lang", "text").mapInArrow(bundle, "lang string, place int, value double").groupBy("lang", "place").agg(
        F.sum("value").alias("value"))
    out = {}
    for r in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).collect():
        v = np.array([x.value for x in r.v], np.float64)
        if np.linalg.norm(v) > 0:
            out[r.lang] = (v / np.linalg.norm(v)).astype(np.float32)
    return dict(sorted(out.items()))


def predicted(text: Column, model: dict[str, np.ndarray], dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> Column:
    """Struct ``lang, score``: the nearest prototype and its cosine, cut to 0..1.

    ``und`` and 0 for a null text, a text without letters, or an empty model; the
    first language by name wins a tie.
    """
    names = list(model)
    matrix = np.stack(list(model.values())) if names else np.zeros((0, dim), np.float32)

    def over(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(dim, gram, seed)
        for texts in parts:
            out_lang, out_score = [], []
            values = [t or "" for t in texts]
            for a in range(0, len(values), BATCH):
                vectors = enc.vectors(values[a:a + BATCH])
                known = vectors.any(axis=1) & bool(names)
                cos = vectors @ matrix.T if names else np.zeros((len(vectors), 1))
                best = cos.argmax(axis=1)
                out_lang += [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                out_score += [float(min(1.0, max(0.0, cos[i, b]))) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]
            yield pd.DataFrame({"lang": out_lang, "score": out_score})

    return F.pandas_udf(over, "lang string, score double")(text)


def _size_class(text: Column) -> Column:
    """Logarithm of the number of characters: short texts lie farther from any prototype."""
    return F.floor(F.log2(F.length(text) + 1)).cast("int")


def floors(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", lang: str = "lang") -> dict[int, float]:
    """By class of size, the cosine that a text must reach: a share of the median over all
    documents of ``docs`` of that size which are predicted to be in their own language.

    Shorter texts than ``JUDGED`` characters have no floor: single words lie far from everything.
    """
    own = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), _size_class(own).alias("size"), predicted(own, model).alias("p"))
    middle = rows.filter("lang is not null and lang = p.lang").groupBy("size").agg(F.percentile_approx("p.score", 0.5).alias("middle"))
    return {r["size"]: FLOOR * r.middle for r in middle.collect() if 2 ** r["size"] >= JUDGED}  # a row per power of two


def accepted(text: Column, model: dict[str, np.ndarray], least: dict[int, float]) -> Column:
    """Whether a text is in a language of the model: its cosine reaches the floor of its size (that
    of the next smaller size where none is known). Never for a null text or one without a letter."""
    size, found = _size_class(text), predicted(text, model)
    floor = F.lit(0.0)
    for k in sorted(least):
        floor = F.when(size >= k, F.lit(float(least[k]))).otherwise(floor)
    return (found["lang"] != UNKNOWN) & (found["score"] >= floor)


def identify(docs: DataFrame, model: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang, score``. A null text or one without a letter is ``und``; equal texts
    score alike; an empty table gives an empty result. Other columns are not read."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), predicted(F.col(f"`{text}`").cast("string"), model).alias("p")).select(
        "doc_id", "p.lang", "p.score")
